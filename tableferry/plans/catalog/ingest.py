"""Files, workbooks, API responses and message logs made of the given tables, and read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableferry.functions.infer import infer_types, target_types
from tableferry.functions.names import validate_columns
from tableferry.functions.protect import derive_key, encrypt, gzip_base64
from tableferry.operators.export import export_records, export_result
from tableferry.plans.catalog.registry import query, table
from tableferry.session import scratch_dir
from tableferry.sources import files, messages, responses
from tableferry.sources.workbook import read_workbooks

CUSTOMER = "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer"


def written(spark, df: DataFrame, name: str, format: str, **options) -> str:
    path = scratch_dir(spark, name)
    df.write.format(format).options(**options).save(path)
    return path


@query("csv_ingest", CUSTOMER)
def csv_ingest(spark, sf):
    padded = table(spark, sf, "customer").withColumnRenamed("c_name", " c_name ")
    path = written(spark, padded, "csv", "csv", header=True, ignoreLeadingWhiteSpace=False)
    return files.read_csv(spark, path)


@query(
    "csv_no_header",
    "select p_partkey as column_1, p_name as column_2, p_retailprice as column_3 from part",
)
def csv_no_header(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_retailprice").cast("decimal(12,2)"))
    return files.read_csv(spark, written(spark, parts, "csv", "csv", sep=";"), header=False, sep=";")


@query(
    "infer_types",
    """select o_orderkey as id, o_totalprice as price, nullif(o_orderpriority, '5-LOW') as priority,
      (o_orderstatus = 'F') as done,
      case when o_orderstatus = 'P' then 'open' else cast(o_custkey as varchar) end as mixed,
      case when o_orderstatus = 'P' then 0.5 else cast(o_custkey as double) end as widened, cast(null as varchar) as empty
    from orders""",
)
def inferred(spark, sf):
    text = table(spark, sf, "orders").selectExpr(
        "concat(' ', o_orderkey, ' ') as id",
        "concat('+', o_totalprice) as price",
        "if(o_orderpriority = '5-LOW', '  ', o_orderpriority) as priority",
        "if(o_orderstatus = 'F', 'TRUE', 'false') as done",
        "if(o_orderstatus = 'P', 'open', cast(o_custkey as string)) as mixed",
        "if(o_orderstatus = 'P', '5e-1', cast(o_custkey as string)) as widened",
        "'' as empty",
    )
    return infer_types(text)


@query(
    "csv_rejected_rows",
    """select 'good' as kind, c_name as line from customer where c_acctbal >= 0
    union all select 'rejected', concat(c_custkey, ',', c_name, ',surplus,', c_mktsegment) from customer
    where c_acctbal < 0""",
)
def csv_rejected_rows(spark, sf):
    """Rows with a field too many go to the reject table; the others load."""
    lines = table(spark, sf, "customer").select(
        F.concat_ws(
            ",", "c_custkey", "c_name", F.when(F.col("c_acctbal") < 0, F.lit("surplus")), "c_mktsegment"
        ).alias("value")
    )
    good, rejected = files.csv_rejects(spark, written(spark, lines, "csv", "text"), ["id", "name", "segment"], header=False)
    return good.select(F.lit("good").alias("kind"), F.col("name").alias("line")).unionByName(
        rejected.select(F.lit("rejected").alias("kind"), "line")
    )


@query("json_lines", CUSTOMER)
def json_lines(spark, sf):
    path = written(spark, table(spark, sf, "customer"), "jsonl", "json")
    return files.read_json(spark, path, multiline=False)


@query("json_lines_dispatch", CUSTOMER + " union all " + CUSTOMER)
def json_lines_dispatch(spark, sf):
    """A folder of record-per-line files beside files of one array each: every record is read."""
    path = scratch_dir(spark, "mixed-json")
    table(spark, sf, "customer").write.json(f"{path}/lines")
    export_records(table(spark, sf, "customer"), f"{path}/arrays", "json")
    return files.read_file(spark, f"{path}/*")


@query("csv_quoted_breaks", "select doc_id, text from documents")
def csv_quoted_breaks(spark, sf):
    """Texts with line breaks in quoted cells."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = written(spark, docs, "csv", "csv", header=True, escape='"', quoteAll=True, ignoreTrailingWhiteSpace=False)
    return files.read_csv(spark, path, string_columns=("text",))


@query("json_array", CUSTOMER)
def json_array(spark, sf):
    path = scratch_dir(spark, "json")
    export_records(table(spark, sf, "customer"), path, "json")
    return files.read_json(spark, path)


@query("json_one_array", "select event_id, user_id, event_type, value, props from events")
def json_one_array(spark, sf):
    """All events as one array in one file and one line, read by many tasks."""
    path = scratch_dir(spark, "one-array")
    records = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = "["
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"value": [mark + ",".join(batch["value"])]})
                mark = ","
        yield pd.DataFrame({"value": ["]" if mark == "," else "[]"]})

    lines = records.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).mapInPandas(joined, "value string")
    lines.write.option("lineSep", " ").text(path)
    return files.read_json(spark, path)


@query(
    "json_lines_with_data",
    "select c_custkey as id, c_name as name, case when c_acctbal >= 0 then c_nationkey end as nation from customer",
)
def json_lines_with_data(spark, sf):
    """Records, one per line, that have a field called ``data``, filled or empty: each stays a record with its other fields."""
    data = F.when(F.col("c_acctbal") >= 0, F.array(F.struct(F.col("c_nationkey").alias("nation")))).otherwise(F.array().cast("array<struct<nation:int>>"))
    records = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), data.alias("data"))
    found = files.read_json(spark, written(spark, records, "jsonl", "json"))
    return found.select("id", "name", F.get(found["data"], F.lit(0))["nation"].cast("int").alias("nation"))


def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One response body with a ``data`` array per batch of records."""
    for batch in batches:
        if len(batch):
            yield pd.DataFrame({"value": ['{"data":[' + ",".join(batch["value"]) + '],"ok":true}']})


@query("json_wrapper", CUSTOMER)
def json_wrapper(spark, sf):
    records = table(spark, sf, "customer").select(F.to_json(F.struct("*")).alias("value"))
    path = written(spark, records.mapInPandas(wrapped, "value string"), "wrapper", "text")
    return files.read_json(spark, path, multiline=False, unwrap=True)


@query(
    "txt_lines",
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as line,
        generate_subscripts(string_split(text, chr(10)), 1) as n from documents)
    select trim(line, concat(' ', chr(9), chr(13), chr(12), chr(11))) as content, count(*) as lines from l
    where trim(line, concat(' ', chr(9), chr(13), chr(12), chr(11))) <> '' group by 1""",
)
def txt_lines(spark, sf):
    path = written(spark, table(spark, sf, "documents").select("text"), "txt", "text")
    return files.read_lines(spark, path).groupBy("content").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "txt_line_numbers",
    "select o_orderstatus as status, count(*) as lines, 1 as first_line, true as gapless from orders group by o_orderstatus",
)
def txt_line_numbers(spark, sf):
    """Files per status with a blank line after each order: the odd numbers, each once, up to the last."""
    path = scratch_dir(spark, "txt")
    lines = table(spark, sf, "orders").select(
        "o_orderstatus", F.concat(F.col("o_orderkey").cast("string"), F.lit("\n")).alias("value")
    )
    lines.write.partitionBy("o_orderstatus").text(path)
    per_file = files.read_lines(spark, path).groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"),
        F.min("line_number").alias("first_line"),
        F.max("line_number").alias("last_line"),
        F.countDistinct(F.when(F.col("line_number") % 2 == 1, F.col("line_number"))).alias("odd_lines"),
    )
    lines_right = (F.col("last_line") == F.col("lines") * 2 - 1) & (F.col("odd_lines") == F.col("lines"))
    return per_file.groupBy(F.regexp_extract("path", "o_orderstatus=([^/]*)", 1).alias("status")).agg(
        F.sum("lines").alias("lines"), F.min("first_line").alias("first_line"), F.bool_and(lines_right).alias("gapless")
    )


@query("txt_delimited", "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def txt_delimited(spark, sf):
    path = written(spark, table(spark, sf, "nation"), "txt", "csv", header=True)
    return files.read_file(spark, path, "txt")


@query(
    "file_select",
    "select distinct concat('lang=', lang) as folder, lang = (select min(lang) from documents) as first from documents",
)
def file_select(spark, sf):
    path = scratch_dir(spark, "tree")
    table(spark, sf, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    found = files.select_files(spark, path, "part-*.t?t", prefix="lang=", pick="all")
    first = files.select_files(spark, path, "part-*.txt", pick="first").select("key", F.lit(True).alias("first"))
    folder = F.split("key", "/")[0].alias("folder")
    return found.join(first, "key", "left").groupBy(folder).agg(
        F.bool_or(F.coalesce("first", F.lit(False))).alias("first")
    )


@query(
    "format_sniff",
    "select 'csv' as kind, c_custkey, c_name, c_acctbal from customer "
    "union all select 'json', c_custkey, c_name, c_acctbal from customer",
)
def format_sniff(spark, sf):
    customers = table(spark, sf, "customer")
    csv = files.read_file(spark, written(spark, customers, "csv", "csv", header=True))
    path = scratch_dir(spark, "json")
    export_records(customers, path, "json")
    json = files.read_file(spark, path)
    cols = ["c_custkey", "c_name", "c_acctbal"]
    return csv.select(F.lit("csv").alias("kind"), *cols).unionByName(json.select(F.lit("json").alias("kind"), *cols))


def workbook_bytes(columns: list[str], rows: Iterator[tuple]) -> bytes:
    """A minimal workbook: a header row, numbers as numbers, the rest as inline text."""

    def cell(value) -> str:
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        return f"<c><v>{value}</v></c>"

    lines = ["".join(cell(c) for c in columns), *("".join(cell(v) for v in row) for row in rows)]
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{package}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        rows_xml = "".join(f"<row>{line}</row>" for line in lines)
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{rows_xml}</sheetData></worksheet>')
    return out.getvalue()


@query("xlsx_ingest", CUSTOMER)
def xlsx_ingest(spark, sf):
    """A workbook per batch of customers, as many as the table needs."""
    path = scratch_dir(spark, "books")

    def write_books(batches):
        import uuid

        from pyarrow import fs

        where = path.removeprefix("file:") if path.startswith("file:") else path
        store, folder = fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            if len(batch):
                content = workbook_bytes(list(batch.columns), batch.itertuples(index=False, name=None))
                name = f"book-{batch['c_custkey'].iloc[0]}-{uuid.uuid5(uuid.NAMESPACE_OID, str(len(batch)))}.xlsx"
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content)
                yield pd.DataFrame({"rows": [len(batch)]})

    table(spark, sf, "customer").mapInPandas(write_books, "rows bigint").agg(F.sum("rows")).first()
    return infer_types(read_workbooks(spark, path))


@query(
    "validate_identifiers",
    "select o_orderkey as ok_1, o_orderstatus as order_status, o_totalprice as total_price_ from orders",
)
def validate_identifiers(spark, sf):
    odd = table(spark, sf, "orders").selectExpr(
        "o_orderkey as ok_1", "o_orderstatus as `order status`", "o_totalprice as `total-price%`"
    )
    return validate_columns(odd, "rename")


@query("validate_identifiers_drop", "select o_orderkey as ok_1 from orders")
def validate_identifiers_drop(spark, sf):
    odd = table(spark, sf, "orders").selectExpr("o_orderkey as ok_1", f"o_custkey as {'x' * 64}", "o_orderdate as `a.b`")
    return validate_columns(odd)


WHOLE = "case when bool_and({0} = floor({0})) then 'BIGINT' else 'DOUBLE PRECISION' end"


@query(
    "ensure_table_types",
    " union all ".join(
        [f"select '{c}' as column_name, 'BIGINT' as type from (select count(*) from lineitem)" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
        + [f"select '{c}', {WHOLE.format(c)} from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
        + [f"select '{c}', 'TEXT' from (select count(*) from lineitem)" for c in ("l_returnflag", "l_linestatus", "l_shipdate")]
    ),
)
def ensure_table_types(spark, sf):
    types = target_types(table(spark, sf, "lineitem"))
    return spark.createDataFrame(list(types.items()), "column_name string, type string")


def _export(format: str):
    def run(spark, sf):
        path = scratch_dir(spark, f"export-{format}")
        export_records(table(spark, sf, "customer"), path, format)
        if format == "parquet":
            return spark.read.parquet(path)
        if format == "csv":
            return files.read_csv(spark, path)
        return files.read_json(spark, path, multiline=format == "json")

    return run


for _format in ("csv", "json", "jsonl"):
    query(f"export_{_format}", CUSTOMER)(_export(_format))
query("export_parquet", "select * from customer")(_export("parquet"))


@query("result_export", CUSTOMER)
def result_export(spark, sf):
    path = scratch_dir(spark, "grid")
    export_result(table(spark, sf, "customer"), path)
    return files.read_csv(spark, path)


@query(
    "csv_append",
    """select s_suppkey as id, s_name as name, s_acctbal as balance from supplier
    union all select c_custkey, nullif(c_name, ''), case when c_acctbal >= 0 then c_acctbal end from customer""",
)
def csv_append(spark, sf):
    path = written(
        spark, table(spark, sf, "supplier").selectExpr("s_suppkey as id", "s_name as name", "s_acctbal as balance"), "accounts", "parquet"
    )
    rows = table(spark, sf, "customer").selectExpr("c_custkey as id", "c_name as name", "if(c_acctbal >= 0, c_acctbal, null) as balance")
    csv = written(spark, rows, "csv", "csv", header=True)
    files.read_csv(spark, csv, schema=rows.schema).write.mode("append").parquet(path)
    return spark.read.parquet(path)


# Attempts of the same request follow each other; the last one decides.
ATTEMPTS = """select user_id as request_id, event_id as attempt,
  case event_type when 'click' then 200 when 'view' then 201 when 'error' then 500 when 'signup' then 429 else 404 end
    as status,
  concat('https://api.example.org/', cast(user_id as varchar(20))) as url,
  case event_type when 'click' then concat('{"data":[', props, ',', props, ']}') when 'view' then concat('[', props, ']')
    else props end as body
from events"""


def attempts(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql(ATTEMPTS)


@query(
    "response_outcomes",
    f"""select request_id, attempt, status,
      case when status between 200 and 299 then 'ok' when status = 429 or status >= 500 then 'retryable' else 'final' end
        as outcome
    from (select *, row_number() over (partition by request_id order by attempt desc) as n from ({ATTEMPTS})) where n = 1""",
)
def response_outcomes(spark, sf):
    return responses.final_responses(attempts(spark, sf)).select("request_id", "attempt", "status", "outcome")


@query(
    "response_records",
    f"""with last as (select *, row_number() over (partition by request_id order by attempt desc) as n from ({ATTEMPTS})),
      ok as (select request_id, status, cast(json_extract(coalesce(json_extract(body, '$.data[0]'),
        json_extract(body, '$[0]')), '$.k') as bigint) as k from last where n = 1 and status between 200 and 299)
    select request_id, k from ok union all select request_id, k from ok where status = 200""",
)
def response_records(spark, sf):
    return responses.response_records(attempts(spark, sf), "k bigint")


BROKEN = "case when value > 60 then concat('<html>', props) else body end as body"


@query(
    "response_rejects",
    f"""select request_id, status, attempt, body from (select *, row_number() over (partition by request_id order by attempt desc) as n
      from (select request_id, status, attempt, case when value > 60 then concat('<html>', props) else body end as body
            from (select a.*, value, props from ({ATTEMPTS}) a join events on event_id = attempt)))
    where n = 1 and status between 200 and 299 and starts_with(body, '<html>')""",
)
def response_rejects(spark, sf):
    """Bodies that cannot be read stay as rows."""
    events = table(spark, sf, "events").select(F.col("event_id").alias("attempt"), "value", "props")
    landed = attempts(spark, sf).join(events, "attempt").selectExpr("request_id", "attempt", "status", "url", BROKEN)
    return responses.response_rejects(landed, "k bigint")


@query(
    "response_bad_cells",
    """select 'read' as kind, c_custkey as id, c_name as name from customer where c_acctbal >= 0
    union all select 'rejected', c_custkey, null from customer where c_acctbal < 0""",
)
def response_bad_cells(spark, sf):
    """One response per nation, a list of its customers; the number of those in debt is a text that is no number."""
    number = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("no "), "c_custkey")).otherwise(F.col("c_custkey").cast("string"))
    record = F.to_json(F.struct(number.alias("id"), F.col("c_name").alias("name")))
    bodies = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.collect_list(record).alias("records"))
    landed = bodies.select(
        F.col("c_nationkey").alias("request_id"), F.lit(200).alias("status"), F.lit(1).alias("attempt"),
        F.concat(F.lit("["), F.array_join("records", ","), F.lit("]")).alias("body"),
    )
    good = responses.response_records(landed, "id bigint, name string").select(F.lit("read").alias("kind"), "id", "name")
    bad = responses.response_rejects(landed, "id bigint, name string")
    number = F.regexp_extract("body", '"id":"no ([0-9]+)"', 1).cast("bigint")
    return good.unionByName(bad.select(F.lit("rejected").alias("kind"), number.alias("id"), F.lit(None).cast("string").alias("name")))


SECRET = derive_key("fixture secret", b"fixture salt")


def message_lines(spark, sf) -> DataFrame:
    """Events as message lines: plain, packed, encrypted and broken."""
    events = table(spark, sf, "events")
    data = F.struct("event_id", "user_id", "value")
    message = F.to_json(
        F.struct(
            F.upper("event_type").alias("type"),
            F.concat(F.lit("node"), F.col("user_id")).alias("agent_name"),
            F.lit("online").alias("status"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
            data.alias("data"),
        )
    )
    line = (
        F.when(F.col("value") > 100, F.concat(F.lit("{broken "), F.col("props")))
        .when(F.col("event_type") == "click", F.concat(F.lit("GZ:"), gzip_base64(message)))
        .when(F.col("event_type") == "error", encrypt(message, SECRET))
        .when(F.col("event_type") == "signup", encrypt(F.concat(F.lit("GZ:"), gzip_base64(message)), SECRET))
        .otherwise(message)
    )
    return events.select(line.alias("value"))


@query(
    "message_log",
    "select event_id, user_id, value, upper(event_type) as type, concat('node', user_id) as agent_name, ts from events "
    "where value <= 100",
)
def message_log(spark, sf):
    path = written(spark, message_lines(spark, sf), "messages", "text")
    parsed = messages.parse_messages(messages.read_message_log(spark, path), SECRET)
    data = F.col("data")
    return messages.good_messages(parsed).select(
        F.try_variant_get(data, "$.event_id", "bigint").alias("event_id"),
        F.try_variant_get(data, "$.user_id", "bigint").alias("user_id"),
        F.try_variant_get(data, "$.value", "double").alias("value"),
        "type",
        "agent_name",
        F.col("timestamp").cast("timestamp_ntz").alias("ts"),
    )


@query("message_heartbeats", "select concat('node', user_id) as agent_name, ts, value as cpu_usage, event_id as memory_total from events")
def message_heartbeats(spark, sf):
    """Node reports from a log of messages."""
    data = F.struct(F.col("value").alias("cpu_usage"), F.col("event_id").alias("memory_total"))
    path = written(spark, _typed_lines(spark, sf, "HEARTBEAT", data), "heartbeats", "text")
    found = messages.heartbeats(messages.parse_messages(messages.read_message_log(spark, path), SECRET))
    return found.select("agent_name", F.col("ts").cast("timestamp_ntz").alias("ts"), "cpu_usage", "memory_total")


@query(
    "message_run_batches",
    "select user_id as log_id, ts, event_type as status, event_id as record_count, value > 50 as partial from events",
)
def message_run_batches(spark, sf):
    """Batch reports from a log of messages."""
    data = F.struct(
        F.col("user_id").alias("log_id"), F.col("event_type").alias("status"), F.col("event_id").alias("record_count"),
        (F.col("value") > 50).alias("partial"),
    )
    path = written(spark, _typed_lines(spark, sf, "DATA_RESPONSE", data), "reports", "text")
    found = messages.run_batches(messages.parse_messages(messages.read_message_log(spark, path), SECRET))
    return found.select("log_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "status", "record_count", "partial")


def _typed_lines(spark, sf, kind, data):
    message = F.struct(
        F.lit(kind).alias("type"), F.concat(F.lit("node"), F.col("user_id")).alias("agent_name"), F.lit("online").alias("status"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), data.alias("data"),
    )
    return table(spark, sf, "events").select(F.to_json(message).alias("value"))


@query("message_log_rejects", "select concat('{broken ', props) as raw from events where value > 100")
def message_log_rejects(spark, sf):
    path = written(spark, message_lines(spark, sf), "messages", "text")
    return messages.bad_messages(messages.parse_messages(messages.read_message_log(spark, path), SECRET))

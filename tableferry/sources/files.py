"""Delimited, line, JSON and object files."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions.infer import WHITESPACE, infer_types, trim_space
from tableferry.functions.names import name_matches
from tableferry.session import BROADCAST_BYTES, first_bytes, qualified_path, scratch_dir, stored_bytes
from tableferry.sources.splits import csv_records, json_records, lines_of_records, pin_splits

# The size up to which a file may be one line, what tells a larger one, formats by the names a source may give them.
WHOLE_LINES = 8 * 1024 * 1024
HEAD_BYTES = 64 * 1024
FORMATS = {"csv": "csv", "txt": "text", "text": "text", "xlsx": "excel", "excel": "excel", "json": "json"}


def list_objects(spark: SparkSession, root: str, prefix: str = "", pattern: str = "") -> DataFrame:
    """Files under ``root`` as ``(key, size, modified, path)``; their content is not read.

    ``key`` is relative to ``root`` and starts with ``prefix``; ``pattern`` is a
    glob on the base name. Hidden names and empty files are files like any other. Folders are listed level by level in
    the tasks, and each level is written, so the driver holds no names however many there are.
    """
    base = qualified_path(spark, root)

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch["key"]:
                store, start = locate(f"{base}/{folder}".rstrip("/"))
                is_folder = store.get_file_info(start).type == fs.FileType.Directory
                infos = store.get_file_info(fs.FileSelector(start, allow_not_found=True)) if is_folder else []
                yield pd.DataFrame(
                    [
                        (
                            f"{folder}/{i.base_name}" if folder else i.base_name,
                            int(i.size or 0),
                            (i.mtime_ns or 0) // 1000,
                            i.type == fs.FileType.Directory,
                        )
                        for i in infos
                    ],
                    columns=["key", "size", "us", "is_folder"],
                )

    level, levels = spark.createDataFrame([("",)], "key string"), []
    while True:
        path = scratch_dir(spark, "listing")
        level.repartition(spark.sparkContext.defaultParallelism).mapInPandas(children, LISTING).write.parquet(path)
        listed = spark.read.schema(LISTING).parquet(path)
        levels.append(listed.filter("not is_folder"))
        level = listed.filter("is_folder").select("key")
        if level.isEmpty():
            break
    found = reduce(DataFrame.unionByName, levels)
    wanted = F.startswith("key", F.lit(prefix)) & name_matches(F.col("key"), pattern)
    return found.filter(wanted).select(
        "key", "size", F.timestamp_micros("us").alias("modified"), F.concat(F.lit(base + "/"), "key").alias("path")
    )


LISTING = "key string, size bigint, us bigint, is_folder boolean"


def locate(uri: str):
    """The store of a qualified path, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def select_files(
    spark: SparkSession, root: str, pattern: str, prefix: str = "", pick: str = "first", recursive: bool = True
) -> DataFrame:
    """The files a source means: the first match in path order, or all. No match is an error."""
    found = list_objects(spark, root, prefix, pattern)
    if not recursive:
        found = found.filter(~F.contains("key", F.lit("/")))
    if pick == "first":
        found = found.orderBy("key").limit(1)
    elif pick != "all":
        raise ValueError("pick is 'first' or 'all'")
    if found.isEmpty():
        raise FileNotFoundError(f"no file matches {pattern!r} under {root}")
    return found


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    header: bool = True,
    sep: str = ",",
    mode: str = "FAILFAST",
    multiline: bool | None = None,
    string_columns: tuple[str, ...] = (),
    schema: T.StructType | None = None,
) -> DataFrame:
    """Delimited text with inferred types.

    A row with too few or too many fields fails the read (``FAILFAST``), since
    what a short or long row lacks or has too much cannot be known; ``csv_rejects``
    keeps such rows aside. Cells may hold line breaks in quotes: where a line has an odd number of quotes, each split is
    read from the state its predecessors leave, so that files stay splittable; ``multiline`` says beforehand whether
    there are such cells. Without a header the columns are ``column_1`` and so on.
    """
    if mode != "FAILFAST":
        raise ValueError("ragged rows fail the read; use csv_rejects to keep them aside")
    if multiline or multiline is None and has_open_quotes(spark, path):
        return infer_types(_quoted_csv(spark, path, header, sep), string_columns, schema)
    reader = spark.read.option("header", header).option("sep", sep).option("mode", mode)
    reader = reader.option("escape", '"').option("enforceSchema", "false")
    # A ragged row must fail also when later steps use only some columns.
    reader = reader.option("columnPruning", "false")
    raw = reader.csv(path)
    return infer_types(raw.toDF(*_column_names(raw.columns, header)), string_columns, schema)


def _column_names(first: list[str], header: bool) -> list[str]:
    names = [c.strip() if header else f"column_{i + 1}" for i, c in enumerate(first)]
    if len(set(names)) < len(names):
        raise ValueError(f"duplicate headers after trimming: {names}")
    return names


def _quoted_csv(spark: SparkSession, path: str | list[str], header: bool, sep: str) -> DataFrame:
    """All columns as text, from rows whose cells may hold line breaks."""
    rows = csv_records(spark, path, sep)
    firsts = [r[0] for r in rows.filter("section = 'first'").select("value").distinct().limit(2 if header else 1).collect()]
    if header and len(firsts) > 1:
        raise ValueError(f"files under {path} differ in their headers")
    if not firsts:
        return spark.createDataFrame([], T.StructType())
    names = _column_names(next(csv.reader(io.StringIO(firsts[0], newline=""), delimiter=sep)), header)
    kind = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    if header:
        rows = rows.filter("section is null")
    options = {"sep": sep, "escape": '"', "mode": "FAILFAST", "multiLine": "true"}
    cells = rows.select(F.from_csv("value", kind.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("row"))
    return cells.select(*[F.col("row")[f"c{i}"].alias(n) for i, n in enumerate(names)])


def has_open_quotes(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a line has an odd number of quotes, as the first line of a cell with a line break has."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def csv_rejects(
    spark: SparkSession, path: str, columns: list[str], header: bool = True, sep: str = ","
) -> tuple[DataFrame, DataFrame]:
    """Rows with the right number of fields, and the text of the others for a reject table.

    The parsed rows are written once, so that both parts come from the same pass.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_rejected"]])
    reader = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE").option("escape", '"')
    parsed = scratch_dir(spark, "parsed")
    reader.option("columnNameOfCorruptRecord", "_rejected").schema(schema).csv(path).write.parquet(parsed)
    rows = spark.read.schema(schema).parquet(parsed)
    good = rows.filter(F.col("_rejected").isNull()).drop("_rejected")
    return good, rows.filter(F.col("_rejected").isNotNull()).select(F.col("_rejected").alias("line"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, line_number, content)`` of every non-blank line; blank lines count in the numbering.

    Files stay splittable. Each split's line count (one row per split) gives the
    number its first line has in the file; a line's place inside its split comes
    from the order in which the task read it. The counts are written first: they
    are broadcast if their stored size allows, so that the text itself is not
    shuffled.
    """
    pin_splits(spark)
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("seq"),
            trim_space(F.col("value")).alias("content"),
        )
    )
    splits = lines.groupBy("path", "split").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum("n").over(earlier)
    starts_path = scratch_dir(spark, "line-starts")
    splits.select("path", "split", "first", F.coalesce(before, F.lit(0)).alias("before")).write.parquet(starts_path)
    starts = spark.read.parquet(starts_path)
    if stored_bytes(spark, starts_path) <= BROADCAST_BYTES:
        starts = F.broadcast(starts)
    return (
        lines.join(starts, ["path", "split"])
        .filter(F.col("content") != "")
        .select("path", (F.col("before") + F.col("seq") - F.col("first") + 1).alias("line_number"), "content")
    )


def read_delimited_or_lines(
    spark: SparkSession, path: str | list[str], header: bool = True, sep: str = ",", string_columns: tuple[str, ...] = ()
) -> DataFrame:
    """A text file as a table if every row has the same fields, else as its lines."""
    try:
        table = read_csv(spark, path, header, sep, "FAILFAST", string_columns=string_columns)
        if set(table.columns) <= set(string_columns):
            # No inference pass has parsed the rows, so a ragged one must be met here.
            table.write.format("noop").mode("overwrite").save()
        if table.columns and not table.isEmpty():
            return table
    except Exception as error:  # noqa: BLE001 - Spark reports a ragged row by several error classes
        if "MALFORMED" not in str(error) and "malformed" not in str(error):
            raise
    return read_lines(spark, path).drop("path")


def read_json(
    spark: SparkSession, path: str | list[str], multiline: bool | None = None, schema: T.StructType | None = None, unwrap: bool = False
) -> DataFrame:
    """Records from an array, a single object, an object that wraps them in ``data``, or one record per line.

    ``multiline=False`` reads one record per line, ``True`` one document per file; both are split, an array also where all of
    it stands in one line. Unless told, a first pass finds out which files hold lines, and each is read in its own way. A
    line is a record, ``data`` one of its fields, unless ``unwrap`` says that lines wrap records. Fields missing
    from some records are NULL there.
    """
    if multiline is None:
        kinds = file_kinds(spark, path)
        if "csv" in kinds:
            raise ValueError(f"{path} holds files that are not JSON")
        return _union_records([read_json(spark, p, kind == "json", schema, unwrap) for kind, p in kinds.items()], spark)
    if multiline:
        return _documents(spark, path, schema)
    reader = spark.read.option("mode", "FAILFAST")
    if schema is not None:
        return reader.schema(schema).json(path)
    return unwrap_data(reader.json(path)) if unwrap else reader.json(path)


def _documents(spark: SparkSession, path: str | list[str], schema: T.StructType | None) -> DataFrame:
    """Arrays and wrapped arrays record by record, written as lines; files that hold one object as that."""
    records, others = json_records(spark, path)
    lines = scratch_dir(spark, "json-lines")
    records.select(F.regexp_replace("value", "[\r\n]+", " ")).write.text(lines)
    reader = spark.read.option("mode", "FAILFAST")
    reader = reader if schema is None else reader.schema(schema)
    parts = [] if spark.read.text(lines).isEmpty() else [reader.json(lines)]
    if single := [unquote(r[0]) for r in others.collect()]:
        parts.append(reader.option("multiLine", True).json(single))
    return _union_records(parts, spark) if parts or schema is None else spark.createDataFrame([], schema)


def _union_records(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], T.StructType())
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def unwrap_data(df: DataFrame) -> DataFrame:
    """The records inside ``data`` when that is an array, else the input. An empty array has no records."""
    fields = {f.name: f.dataType for f in df.schema}
    inner = fields.get("data")
    if isinstance(inner, T.ArrayType):
        if isinstance(inner.elementType, T.StructType):
            return df.selectExpr("inline(data)")
        if df.filter(F.size("data") > 0).isEmpty():
            return df.limit(0).select()
    return df


def sniff_format(head: str) -> str:
    """A bucket object's format from its first bytes: JSON if it starts like JSON, else CSV."""
    return "json" if head.lstrip(WHITESPACE + "\ufeff")[:1] in ("{", "[") else "csv"


def file_kinds(spark: SparkSession, path: str | list[str]) -> dict[str, list[str] | str]:
    """The files of a path by what they hold: ``csv``, ``json`` (one document) or ``lines`` (a record per line).

    A file whose first filled line is a whole JSON object, and that has more filled lines, holds lines. If all files agree,
    the path itself stands for them; only otherwise are they named one by one. A file above ``WHOLE_LINES`` may be one line,
    so that its lines are not read before its start has told what it holds.
    """
    stored = spark.read.format("binaryFile").load(path)
    large = _large_kinds(spark, [r[0] for r in stored.filter(F.col("length") > WHOLE_LINES).select("path").collect()])
    value = trim_space(F.regexp_replace("value", "^\ufeff", ""))
    texts = spark.read.text(path)
    filled = texts.filter(F.col("_metadata.file_size") <= WHOLE_LINES).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), value.alias("line")).alias("first"),
    )
    heads = filled.filter(F.col("first.line") != "").groupBy("file").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("lines"))
    line = F.col("first.line")
    whole = F.try_parse_json(line).isNotNull() & F.startswith(line, F.lit("{"))
    kind = (
        F.when(~F.substring(line, 1, 1).isin("{", "["), "csv").when(whole & (F.col("lines") > 1), "lines").otherwise("json")
    )
    kinds = heads.select("file", kind.alias("kind"))
    found = sorted({r[0] for r in kinds.select("kind").distinct().collect()} | set(large.values()))
    if len(found) <= 1:
        return {k: path for k in found}
    small = {k: [unquote(r[0]) for r in kinds.filter(F.col("kind") == k).select("file").collect()] for k in found}
    return {k: small[k] + [f for f, v in large.items() if v == k] for k in found}


def _large_kinds(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The kinds of large files, by their first bytes; blank ones have none.

    Behind a closing brace, a line break and no comma or bracket there is only another record. Files that begin with an object
    and a longer line are read up to the first break of their lines, by closing braces and in the tasks.
    """
    kinds, unknown = {}, []
    for path in paths:
        count, text = HEAD_BYTES, ""
        while not text:
            head = first_bytes(spark, path, count)
            text = head.decode("utf-8", "ignore").lstrip(WHITESPACE + "\ufeff")
            if len(head) < count:
                break
            count *= 16
        if not text:
            continue
        line, _, rest = re.sub("[\r\n]", "\n", text).partition("\n")
        rest = rest.lstrip(WHITESPACE)
        if text[0] not in "{[":
            kinds[path] = "csv"
        elif text[0] == "[":
            kinds[path] = "json"
        elif rest:
            kinds[path] = "lines" if line.rstrip(WHITESPACE).endswith("}") and rest[0] not in ",]}" else "json"
        else:
            unknown.append(path)
    of_lines = lines_of_records(spark, unknown) if unknown else []
    return kinds | {p: "lines" if p in of_lines else "json" for p in unknown}


def read_file(
    spark: SparkSession,
    path: str | list[str],
    format: str | None = None,
    header: bool = True,
    sep: str = ",",
    string_columns: tuple[str, ...] = (),
) -> DataFrame:
    """Read by format name; without one, look at the start of every file. JSON and delimited files do not mix."""
    if not format:
        kinds = file_kinds(spark, path)
        if "csv" in kinds and len(kinds) > 1:
            raise ValueError(f"{path} holds delimited and JSON files; read them one format at a time")
        if kinds and "csv" not in kinds:
            return _union_records([read_json(spark, p, kind == "json") for kind, p in kinds.items()], spark)
        format = "csv"
    kind = FORMATS.get(format.lower())
    sep = (sep or ",")[0]
    if kind == "csv":
        return read_csv(spark, path, header, sep, string_columns=string_columns)
    if kind == "text":
        return read_delimited_or_lines(spark, path, header, sep, string_columns)
    if kind == "json":
        return read_json(spark, path)
    if kind == "excel":
        from tableferry.sources.workbook import read_workbooks

        return infer_types(read_workbooks(spark, path, header), string_columns)
    raise ValueError(f"unsupported file format: {format}")

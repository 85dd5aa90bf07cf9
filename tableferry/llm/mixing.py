"""Mixing of sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tableferry.llm.store import staged

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
SEED = "mix-1"
# Documents of a source are ordered in slices of about this many rows, so that a running sum never holds a whole source.
SLICE_ROWS = 2_000
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(spark: SparkSession, sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: ``source, source_size, docs, target``.

    Sources take the weights in turn, by code point, null last. Shares above ``epochs`` times a source's size are clamped,
    and the excess is shared again by weight among the others until nothing exceeds its clamp. Each round is one small
    aggregate over the sources, of which only two sums reach the driver. A source of size 0 has target 0.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    # The rank is global, yet no task sees all sources: ranges are numbered inside, then shifted by the counts before them.
    ordered = by_source.repartitionByRange(
        spark.sparkContext.defaultParallelism, F.col("source").asc_nulls_last()
    ).sortWithinPartitions(F.col("source").asc_nulls_last())
    place = F.monotonically_increasing_id()
    ordered = staged(
        spark, ordered.withColumn("range", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND((1 << 33) - 1)), "sources"
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ordered.groupBy("range").agg(F.count(F.lit(1)).alias("c")).select(
        "range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("shift")
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") + F.col("shift"), len(weights)) + 1).cast("int"))
    cap = (F.col("source_size") * epochs).cast("double")
    ranked = staged(
        spark,
        ordered.join(F.broadcast(shift), "range").select(
            "source", "source_size", "docs", weight.alias("weight"), cap.alias("cap"), (cap / weight).alias("level")
        ),
        "weighted-sources",
    )
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        # Clamped are the sources whose clamp the present level reaches; the level can only rise from round to round.
        full = F.col("level") <= level
        count, taken, open_weight = ranked.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if count == clamped or not open_weight:
            break
        level, clamped = (total - taken) / open_weight, count
    return ranked.select("source", "source_size", "docs", F.least("cap", F.col("weight") * level).alias("target"))


def shuffle_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A seeded place in the order in which documents of a source are repeated."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, source, order_key``.

    A source is taken as often as its target asks: whole repetitions of every document, then a fractional one in which
    its documents follow in seeded order until the target is met; the document at the border gives only its first words.
    So the words taken differ from the target by less than one, and no document exceeds ``epochs`` times its size.

    Null text has size 0, null sources form one source. Rows that repeat a doc_id and text are separate rows. A reordering of
    the rows changes nothing, so reruns agree. An empty table gives no rows. Other columns are not read.
    """
    sized = staged(
        spark,
        docs.select("doc_id", "source", words(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), F.col("text"), seed).alias("order_key")),
        "sizes",
    )
    goal = staged(spark, targets(spark, sized, weights, epochs), "targets")
    same = sized.source.eqNullSafe(goal.source)
    rows = sized.join(goal, same, "left").select(
        "doc_id", sized.source, "size", "order_key", "source_size", "target", F.ceil(F.col("docs") / SLICE_ROWS).alias("slices")
    )
    # Slices follow each other in the order of the keys: their number grows with the first 15 hex digits.
    start = F.conv(F.substring("order_key", 1, 12), 16, 10).cast("double") / float(16**12)
    rows = rows.withColumn("slice", F.floor(start * F.col("slices")))
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged(spark, sums.select("source", "slice", F.coalesce(F.sum("in_slice").over(before), F.lit(0)).alias("start")), "slice-starts")
    placed = rows.alias("r").join(
        sums.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.slice") == F.col("s.slice"))
    ).select("r.*", "s.start")
    inside = Window.partitionBy("source", "slice").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") - F.col("whole") * F.col("source_size"))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("at")))
    return (
        placed.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("whole", whole)
        .withColumn("rest", rest)
        .select(
            "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"),
            "source", "order_key",
        )
    )


def repeat_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row as often as it is taken, a last partial one cut after its last word that is taken.

    A cut text has single spaces between its words. Rows equal in doc_id and text share their words evenly, each share rounded
    up. Columns of any name come back as they were; the table is carried as one struct.
    """
    plan = mix(spark, docs, **options).select(F.col("order_key").alias("key"), "size", "taken")
    plan = plan.groupBy("key").agg(F.max("size").alias("size"), F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    seed = options.get("seed", SEED)
    keyed = docs.select(shuffle_key(F.col("doc_id"), F.col("text"), seed).alias("key"), F.struct(*docs.columns).alias("row"))
    rows = keyed.join(plan, "key").withColumn("share", F.ceil(F.col("taken") / F.col("rows"))).filter("share > 0")
    times = F.ceil(F.col("share") / F.col("size")).cast("int")
    rows = rows.withColumn("time", F.explode(F.sequence(F.lit(1), times)))
    left = F.col("share") - (F.col("time") - 1) * F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})")), 1, F.greatest(left, F.lit(0)).cast("int")), " ")
    text = F.when(left >= F.col("size"), F.col("row.text")).otherwise(cut)
    return rows.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = f"""
with recursive sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
    md5('{SEED}' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as order_key
  from documents
), sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place
  from sized group by source
), weighted as (
  select source, source_size, [5.0, 2.0, 1.0][(place % 3 + 1)::int]::double as weight, (source_size * {EPOCHS})::double as cap
  from sources
), rounds(step, level) as (
  select 0, 0.0::double
  union all
  select step + 1, (select ((select sum(source_size)::double from weighted) - coalesce(sum(cap) filter (cap / weight <= level), 0))
      / sum(weight) filter (cap / weight > level) from weighted)
  from rounds where step < (select count(*) from weighted) and level is not null
), goals as (
  select source, source_size, least(cap, weight * (select max(level) from rounds)) as target from weighted
), placed as (
  select s.doc_id, s.size, g.source_size, g.target,
    coalesce(sum(s.size) over (partition by s.source order by s.order_key, s.doc_id, s.size
      rows between unbounded preceding and 1 preceding), 0) as ahead,
    case when g.source_size > 0 then floor(g.target / g.source_size) else 0 end as whole
  from sized s join goals g on s.source is not distinct from g.source
)
select doc_id, size, source_size, target,
  (whole * size + least(size, greatest(0, floor(target - whole * source_size) - ahead)))::bigint as taken
from placed
"""

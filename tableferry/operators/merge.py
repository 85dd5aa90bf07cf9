"""Insert-skip and upsert by one key column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.functions.names import quoted
from tableferry.operators.dedupe import one_per_key, split_null_keys
from tableferry.session import BROADCAST_BYTES, scratch_dir, stored_bytes

ACTION = "_action"


def project_to(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order; one the input lacks is NULL."""
    have = set(df.columns)
    return df.select([quoted(c) if c in have else F.lit(None).alias(c) for c in columns])


def name_folding(spark: SparkSession) -> Callable[[str], str]:
    """How this session tells column names apart."""
    return str if spark.conf.get("spark.sql.caseSensitive") == "true" else str.lower


def _with_action(df: DataFrame, action: str, wanted: bool) -> DataFrame:
    return df.withColumn(ACTION, F.lit(action)) if wanted else df


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def insert_skip(
    target: DataFrame,
    source: DataFrame,
    key: str | None = None,
    order_by: Sequence[str] = (),
    target_unique: bool = False,
    with_action: bool = False,
) -> DataFrame:
    """Add the source rows whose key the target lacks; no target row changes.

    Without a key every row is added. With one, the first source row of a key
    counts, and rows without a key are always added.
    """
    kept = _with_action(target, "kept", with_action)
    if not key:
        return _union([kept, _with_action(source, "inserted", with_action)])
    _, keyless = split_null_keys(source, key)
    first = one_per_key(source, key, order_by, pick="first")
    known = target.filter(quoted(key).isNotNull()).select(quoted(key))
    if not target_unique:
        # Thins a repeated target key before the shuffle the anti join needs anyway.
        known = known.distinct()
    fresh = first.join(known, key, "left_anti").select([quoted(c) for c in source.columns])
    return _union([kept] + [_with_action(p, "inserted", with_action) for p in (fresh, keyless)])


def upsert(
    target: DataFrame,
    source: DataFrame,
    key: str | None,
    order_by: Sequence[str],
    target_unique: bool = False,
    with_action: bool = False,
) -> DataFrame:
    """Insert or update by key; the latest source row of a key counts.

    A match overwrites every column the source has, with NULL too; columns only
    the target has keep their value, and are NULL in an inserted row. Rows
    without a key never match and are added.

    ``target_unique`` says the target holds each key once (any table this
    library maintains): then no key can be heavy on either side and one full
    outer join does it. Otherwise the target is the left side of a left join,
    which adaptive execution can split at a heavy key, and its keys are thinned
    before the search for new rows. ``staged_upsert`` measures the source and
    has a form in which the target does not shuffle at all.
    """
    if not key or len(source.columns) == 1:
        return insert_skip(target, source, key, order_by, target_unique, with_action)
    _, source_keyless = split_null_keys(source, key)
    latest = one_per_key(source, key, order_by)
    return _merge(target, latest, source_keyless, key, target_unique, False, with_action)


def _merge(
    target: DataFrame,
    latest: DataFrame,
    source_keyless: DataFrame,
    key: str,
    target_unique: bool,
    source_small: bool,
    with_action: bool,
) -> DataFrame:
    """The merge proper, for a source that already holds each key once."""
    keyed, target_keyless = split_null_keys(target, key)
    extra = [
        _with_action(target_keyless, "kept", with_action),
        _with_action(source_keyless, "inserted", with_action),
    ]
    if target_unique and not source_small:
        return _union([_merge_columns(keyed, latest, key, "full_outer", with_action), *extra])
    if source_small:
        latest = F.broadcast(latest)
        hit = keyed.select(quoted(key)).join(F.broadcast(latest.select(quoted(key))), key, "left_semi").distinct()
    else:
        hit = keyed.select(quoted(key)).distinct()
    merged = _merge_columns(keyed, latest, key, "left", with_action)
    fresh = latest.join(hit, key, "left_anti").select([quoted(c) for c in latest.columns])
    return _union([merged, _with_action(fresh, "inserted", with_action), *extra])


def _merge_columns(target: DataFrame, source: DataFrame, key: str, how: str, with_action: bool) -> DataFrame:
    """Join on the key and take each column from the side that owns it in that row."""
    t = target.withColumn("__in_t", F.lit(True)).alias("t")
    s = source.withColumn("__in_s", F.lit(True)).alias("s")

    def side(alias: str, name: str):
        return F.col(f"{alias}.`{name}`")

    from_source = F.col("s.__in_s").isNotNull()
    fold = name_folding(target.sparkSession)
    theirs = {fold(c): c for c in source.columns}
    out = []
    for name in target.columns:
        same = theirs.pop(fold(name), None)
        if fold(name) == fold(key):
            out.append(F.coalesce(side("t", name), side("s", same)).alias(name))
        elif same is not None:
            # A flag, not coalesce: a NULL from the source must overwrite.
            out.append(F.when(from_source, side("s", same)).otherwise(side("t", name)).alias(name))
        else:
            out.append(side("t", name))
    out += [side("s", name) for name in theirs.values()]
    if with_action:
        action = F.when(F.col("t.__in_t").isNull(), "inserted").when(from_source, "updated").otherwise("kept")
        out.append(action.alias(ACTION))
    return t.join(s, side("t", key) == side("s", key), how).select(out)


def staged_upsert(
    target: DataFrame,
    source: DataFrame,
    key: str,
    order_by: Sequence[str],
    target_unique: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    with_action: bool = False,
) -> DataFrame:
    """Upsert through a staging table in the shared folder, as one set-based merge.

    The deduplicated source is written once, which cuts its lineage and gives
    its true size. A source that fits is broadcast, so the target is neither
    shuffled nor sorted; a larger one takes the shuffling form of ``upsert``.
    """
    spark = source.sparkSession
    path = scratch_dir(spark, "staging")
    _, keyless = split_null_keys(source, key)
    one_per_key(source, key, order_by).unionByName(keyless).write.parquet(path)
    staged = spark.read.schema(source.schema).parquet(path)
    small = stored_bytes(spark, path) <= broadcast_bytes
    latest, keyless = split_null_keys(staged, key)
    return _merge(target, latest, keyless, key, target_unique, small, with_action)


def merge_counts(merged: DataFrame) -> DataFrame:
    """``inserted``, ``updated`` and ``kept`` rows of a merge made with ``with_action=True``."""
    return merged.agg(
        *[F.count_if(F.col(ACTION) == a).cast("bigint").alias(a) for a in ("inserted", "updated", "kept")]
    )

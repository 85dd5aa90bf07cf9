"""Tables in the lake: create if missing, replace, versions, key buckets."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions.infer import target_types
from tableferry.functions.names import is_valid_name, quoted, validate_columns
from tableferry.functions.text import flat_text
from tableferry.operators.merge import upsert
from tableferry.session import child_names, delete_folder, path_exists, read_text, scratch_dir, write_text

# Spark types of the four column types a created table has.
SPARK_TYPES = {
    "BIGINT": T.LongType(),
    "DOUBLE PRECISION": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "TEXT": T.StringType(),
}


def to_target_types(df: DataFrame, on_invalid: str = "drop", types: dict[str, str] | None = None) -> DataFrame:
    """Valid columns only, each as one of the four types; other values as text. Known ``types`` save a pass."""
    valid = validate_columns(df, on_invalid)
    types = types or target_types(valid)
    texts = flat_text(valid)
    return texts.select([quoted(c).cast(SPARK_TYPES[types[c]]).alias(c) for c in texts.columns])


def ensure_table(spark: SparkSession, name: str, sample: DataFrame, path: str | None = None) -> bool:
    """Create a table from the types of ``sample``; an existing one is left alone. True if created."""
    if not all(is_valid_name(part) for part in name.split(".")):
        raise ValueError(f"invalid table name: {name!r}")
    if spark.catalog.tableExists(name):
        return False
    valid = validate_columns(sample)
    types = target_types(valid)
    schema = T.StructType([T.StructField(c, SPARK_TYPES[t]) for c, t in types.items()])
    spark.catalog.createTable(name, path=path, source="parquet", schema=schema)
    return True


def truncate_load(df: DataFrame, path: str) -> DataFrame:
    """Replace a table's content; the result reads the table back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class VersionedTable:
    """A table whose every commit is a whole new version.

    A version counts once the writer has put its success marker, which happens
    last, so a reader sees the old state or the new one and a lost job leaves
    nothing behind that counts. ``tag`` names what produced a version; a tag
    that is already there is not written again, which makes replays harmless.
    One writer at a time.
    """

    _NAME = re.compile(r"v=(\d{12})(?:-(.+))?")

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def versions(self) -> list[tuple[int, str | None, str]]:
        found = []
        for name in child_names(self.spark, self.path):
            match = self._NAME.fullmatch(name)
            if match and path_exists(self.spark, f"{self.path}/{name}/_SUCCESS"):
                found.append((int(match.group(1)), match.group(2), f"{self.path}/{name}"))
        return sorted(found)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The latest version, or a given one; None when there is none yet."""
        known = [v for v in self.versions() if version is None or v[0] == version]
        return self.spark.read.parquet(known[-1][2]) if known else None

    def has_tag(self, tag: str) -> bool:
        return any(t == tag for _, t, _ in self.versions())

    def commit(self, df: DataFrame, tag: str | None = None, unique: str | None = None) -> DataFrame:
        """Write a new version. ``unique`` names a key that ``df`` is known to hold once per value, if the last version did."""
        if tag is not None:
            if not re.fullmatch(r"[A-Za-z0-9_.-]+", tag):
                raise ValueError(f"invalid tag: {tag!r}")
            if self.has_tag(tag):
                return self.read()
        known = self.versions()
        number = (known[-1][0] if known else 0) + 1
        path = f"{self.path}/v={number:012d}" + (f"-{tag}" if tag else "")
        # An unfinished attempt under the same name does not count and is replaced.
        once = unique is not None and self.holds_once(unique)
        df.write.mode("overwrite").parquet(path)
        if once:
            write_text(self.spark, f"{path}/{self._unique(unique)}", "")
        return self.spark.read.schema(df.schema).parquet(path)

    def expire(self, keep: int = 2) -> int:
        """Delete all but the newest ``keep`` versions, once no reader needs them; how many went."""
        if keep < 1:
            raise ValueError("the newest version stays")
        old = self.versions()[:-keep]
        for _, _, path in old:
            delete_folder(self.spark, path)
        return len(old)

    def upsert(self, source: DataFrame, key: str, order_by: Sequence[str], tag: str | None = None) -> DataFrame:
        if tag is not None and self.has_tag(tag):
            return self.read()
        current = self.read()
        if current is None:
            current = self.spark.createDataFrame([], source.schema)
        merged = upsert(current, source, key, order_by, target_unique=self.holds_once(key))
        return self.commit(merged, tag, unique=key)

    def holds_once(self, key: str) -> bool:
        """Whether the latest version is known to hold each value of ``key`` once: it came from a chain of merges by it."""
        known = self.versions()
        return not known or path_exists(self.spark, f"{known[-1][2]}/{self._unique(key)}")

    @staticmethod
    def _unique(key: str) -> str:
        return f"_UNIQUE-{key.encode().hex()}"


class BucketedTable:
    """A large table split by a hash of its key; a merge rewrites only the buckets it hits.

    Buckets are written into a folder of their own per commit, and a commit counts once its manifest is in place: one small
    file that names the folder of every live bucket, the schema, and what has been merged. Readers follow the newest
    manifest, so they see the state before a merge or after it, and a lost job leaves nothing behind that counts. Each
    key is held once. Rows without a key are spread over the buckets by their content. One writer at a time.
    """

    BUCKET = "_bucket"
    _MANIFEST = re.compile(r"m-(\d{12})\.json")
    _NUMBERED = re.compile(r"(.*?)-?(\d+)")

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 256):
        self.spark = spark
        self.path = path.rstrip("/")
        self.key = key
        self.buckets = buckets

    def manifest(self) -> dict | None:
        """The newest commit: ``version``, ``schema``, ``folders`` (bucket to folder), ``tags``; None before the first."""
        versions = self._versions()
        return json.loads(read_text(self.spark, self._manifest_path(versions[-1]))) if versions else None

    def _versions(self) -> list[int]:
        names = map(self._MANIFEST.fullmatch, child_names(self.spark, f"{self.path}/manifests"))
        return sorted(int(m.group(1)) for m in names if m)

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/m-{version:012d}.json"

    def _stamped(self, df: DataFrame) -> DataFrame:
        """Rows with their bucket, which they keep through every merge."""
        plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        content = F.xxhash64(*[quoted(c) for c in plain])
        code = F.when(quoted(self.key).isNull(), content).otherwise(F.xxhash64(quoted(self.key)))
        return df.withColumn(self.BUCKET, F.pmod(code, F.lit(self.buckets)).cast("int"))

    def _rows(self, manifest: dict, only: Iterable[int] | None = None) -> DataFrame:
        """The live rows of all or some buckets: only their folders are listed and read."""
        wanted = manifest["folders"] if only is None else {str(b): manifest["folders"].get(str(b)) for b in only}
        paths = [f"{self.path}/data/{folder}/{self.BUCKET}={bucket}" for bucket, folder in wanted.items() if folder]
        schema = T.StructType.fromJson(manifest["schema"])
        if not paths:
            return self.spark.createDataFrame([], schema)
        # Buckets written before a column came up do not have it; the stored schema fills it in.
        return self.spark.read.schema(schema).parquet(*paths)

    def has_tag(self, tag: str) -> bool:
        return self._merged(self.manifest(), tag)

    def _merged(self, manifest: dict | None, tag: str | None) -> bool:
        if manifest is None or tag is None:
            return False
        numbered = self._NUMBERED.fullmatch(tag)
        if numbered:
            return int(numbered[2]) <= manifest["tags"].get(numbered[1], -1)
        return tag in manifest["tags"]

    def _commit(self, rows: DataFrame, schema: T.StructType, manifest: dict | None, tag: str | None) -> list[int]:
        folder = f"c-{uuid.uuid4().hex}"
        # Rows of a bucket meet before the write, so it gets few files; adaptive execution
        # joins small buckets and splits large ones.
        out = rows.hint("rebalance", self.BUCKET)
        out.write.partitionBy(self.BUCKET).parquet(f"{self.path}/data/{folder}")
        written = [n.removeprefix(f"{self.BUCKET}=") for n in child_names(self.spark, f"{self.path}/data/{folder}")]
        written = [n for n in written if n.isdigit()]
        tags = dict(manifest["tags"]) if manifest else {}
        if tag is not None:
            # Numbers of a stream only rise, so the highest says all.
            numbered = self._NUMBERED.fullmatch(tag)
            tags.update({numbered[1]: int(numbered[2])} if numbered else {tag: 0})
        version = (manifest["version"] if manifest else 0) + 1
        live = {**(manifest["folders"] if manifest else {}), **{b: folder for b in written}}
        new = {"version": version, "schema": schema.jsonValue(), "folders": live, "tags": tags}
        write_text(self.spark, self._manifest_path(version), json.dumps(new))
        return sorted(map(int, written))

    def create(self, df: DataFrame, order_by: Sequence[str] = ()) -> None:
        """The first state of the table; of rows that share a key, the latest in the order stays."""
        if self._versions():
            raise ValueError(f"{self.path} holds a table already")
        self._merge(df, order_by, None, None)

    def read(self) -> DataFrame:
        manifest = self.manifest()
        if manifest is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._rows(manifest)

    def upsert(self, source: DataFrame, order_by: Sequence[str], tag: str | None = None) -> list[int]:
        """Merge and return the buckets that were rewritten: at most ``buckets`` numbers.

        A ``tag`` that has been merged already changes nothing; of tags that end in a number, neither has a lower one.
        """
        manifest = self.manifest()
        return [] if self._merged(manifest, tag) else self._merge(source, order_by, tag, manifest)

    def _merge(self, source: DataFrame, order_by: Sequence[str], tag: str | None, manifest: dict | None) -> list[int]:
        # Written once: the buckets to read and the rows to merge must come from the same evaluation of the source.
        held = scratch_dir(self.spark, "bucketed-source")
        stamped = self._stamped(source)
        stamped.write.parquet(held)
        staged = self.spark.read.schema(stamped.schema).parquet(held)
        hit = sorted(r[0] for r in staged.select(self.BUCKET).distinct().collect())
        if manifest is None:
            current = self.spark.createDataFrame([], source.schema)
        else:
            current = self._rows(manifest, hit)
        merged = upsert(current, staged.drop(self.BUCKET), self.key, order_by, target_unique=True)
        try:
            return self._commit(self._stamped_as(merged, current, staged, hit), merged.schema, manifest, tag)
        finally:
            delete_folder(self.spark, held)

    def _stamped_as(self, merged: DataFrame, current: DataFrame, staged: DataFrame, hit: list[int]) -> DataFrame:
        """Merged rows in their buckets. Rows without a key keep theirs, which their content, as first seen, decided."""
        keyed = self._stamped(merged.filter(quoted(self.key).isNotNull()))
        if not hit:
            return keyed
        path = F.regexp_extract(F.col("_metadata.file_path"), f"/{self.BUCKET}=(\\d+)/", 1)
        old = current.filter(quoted(self.key).isNull())
        if current.inputFiles():
            old = old.withColumn(self.BUCKET, path.cast("int"))
        else:
            old = self._stamped(old)
        new = staged.filter(quoted(self.key).isNull())
        return keyed.unionByName(old, allowMissingColumns=True).unionByName(new, allowMissingColumns=True)

    def expire(self, keep: int = 2) -> int:
        """Delete all but the newest ``keep`` manifests, and the folders that none of those names; how many folders went."""
        if keep < 1:
            raise ValueError("the newest version stays")
        versions = self._versions()
        for version in versions[:-keep]:
            delete_folder(self.spark, self._manifest_path(version))
        kept = [json.loads(read_text(self.spark, self._manifest_path(v))) for v in versions[-keep:]]
        live = {folder for m in kept for folder in m["folders"].values()}
        gone = [n for n in child_names(self.spark, f"{self.path}/data") if n not in live]
        for name in gone:
            delete_folder(self.spark, f"{self.path}/data/{name}")
        return len(gone)

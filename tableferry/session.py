"""Session settings, the shared scratch folder and storage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


# Data of up to this many stored bytes is sent to every executor; anything larger is shuffled.
BROADCAST_BYTES = 32 * 1024 * 1024


def build_session(app: str = "tableferry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Partition counts are left to adaptive execution; a cluster's own
    ``spark-defaults`` keep priority for anything not named here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    if master and master.startswith("local"):
        settings["spark.ui.enabled"] = "false"
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new, unused folder under the shared folder named in ``spark.checkpoint.dir``.

    Only a local session may fall back to this machine's temporary folder:
    on a cluster the executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _hadoop_path(spark: SparkSession, path: str):
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def qualified_path(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as the session's default file system completes it; executors then agree with Spark."""
    fs, hpath = _hadoop_path(spark, path.rstrip("/") or "/")
    return fs.makeQualified(hpath).toString().rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _hadoop_path(spark, path)
    return bool(fs.exists(hpath))


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder; empty when it does not exist."""
    fs, hpath = _hadoop_path(spark, path)
    if not fs.exists(hpath):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hpath))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes a folder really holds: the measure behind every broadcast choice."""
    fs, hpath = _hadoop_path(spark, path)
    return int(fs.getContentSummary(hpath).getLength()) if fs.exists(hpath) else 0


def first_bytes(spark: SparkSession, path: str, count: int) -> bytes:
    """The start of a file, unpacked as Spark's readers unpack it."""
    fs, hpath = _hadoop_path(spark, path)
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(hpath)
    stream = fs.open(hpath)
    try:
        return bytes((codec.createInputStream(stream) if codec else stream).readNBytes(count))
    finally:
        stream.close()


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, hpath = _hadoop_path(spark, path)
    fs.delete(hpath, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place and renamed."""
    fs, hpath = _hadoop_path(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if not fs.rename(beside, hpath):
        fs.delete(beside, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, hpath = _hadoop_path(spark, path)
    stream = fs.open(hpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()

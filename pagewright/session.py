"""Session, table reading and lineage cuts shared by every part of the library."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "pagewright", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own, which is
    deleted when Python ends; on a cluster there is no such place, and an error says so."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/pagewright-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: its lineage is cut and executor loss costs nothing. The result can be
    read until ``release``."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever file system the path names."""
    fs, where = _files(spark, path)
    return fs.exists(where)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that fit a pattern."""
    fs, where = _files(spark, pattern)
    return [x.getPath().toString() for x in fs.globStatus(where) or []]


def is_file(spark: SparkSession, path: str) -> bool:
    fs, where = _files(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isFile()


def release(spark: SparkSession) -> None:
    """Delete all that this application has stored, once its results are written."""
    fs, where = _files(spark, work_dir(spark))
    fs.delete(where, True)


def stored_once(df_of, sources: list[str], spark: SparkSession, name: str) -> DataFrame:
    """What ``df_of()`` gives for the files at ``sources``, stored under a name made of their paths, sizes and times, and only read if it is
    there already."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sources).select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    seen = files.agg(F.bit_xor("h").alias("x"), F.sum(F.shiftright("h", 20)).alias("s"), F.count("*").alias("n")).first()
    path = f"{work_dir(spark)}/{name}-{(seen.x or 0) & (1 << 64) - 1:016x}-{(seen.s or 0) & (1 << 64) - 1:016x}-{seen.n}"
    if not exists(spark, f"{path}/_SUCCESS"):
        df_of().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)

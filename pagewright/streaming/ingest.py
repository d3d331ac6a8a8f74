"""Pages and cache rows as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cache import merge_version
from ..session import is_file, work_dir


def arriving(spark: SparkSession, path: str, schema, files: int = 8) -> DataFrame:
    """A stream of the parquet files at ``path`` (a folder, or one file), ``files`` of them in a batch."""
    folder, _, name = path.rstrip("/").rpartition("/")
    # a stream reads folders; a pattern that only this name fits makes one file a folder of its own
    one = name.endswith(".parquet") and is_file(spark, path)
    folder = f"{folder}/[{name[0]}]{name[1:]}" if one else path
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def upsert_stream(stream: DataFrame, root: str, keys: list[str], keep: list[str], order: list[str]) -> None:
    """Every batch merged into the versioned table at ``root``, of which only the touched buckets are written again; a batch that runs again
    after a failure changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        merge_version(batch, root, keys, keep, order)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per window and ``by``; windows close ``late`` after the newest row, and later rows are left out."""
    rows = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", width), by).agg(F.count("*").alias("n"))


def run_to_table(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over all that is there, write what each batch gives, and read the result. In append mode a window is written once it is
    closed, so those that the watermark hasn't passed yet are still to come."""
    spark = df.sparkSession
    root = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/rows")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/rows")

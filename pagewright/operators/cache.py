"""Content-addressed caches as tables: lookups are semi- and anti-joins, upserts are full outer joins into a new version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import matching

#: Buckets of a table that batches are merged into.
BUCKETS = 16
EXTRACTION_KEY = ["file_hash", "images_scale", "ocr_language", "force_ocr"]
CACHE_KEY = ["namespace_id", "slide_hash", "model_id", "prompt_version", "prompt_hash"]


def latest(rows: DataFrame, keys: list[str], at: str, ties: list[str]) -> DataFrame:
    """The newest row of each key; ties are broken by the columns named."""
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), *ties)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def split_by_cache(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(cached, missing). Only the key of either side takes part; rows without one are missing."""
    held = cache.select(key).where(F.coalesce(key, F.lit("")) != "").distinct()
    return wanted.join(held, key, "left_semi"), wanted.join(held, key, "left_anti")


def lookup_totals(wanted: DataFrame, cache: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(by, requested, hits, misses) of rows with a key, each as often as it was asked for."""
    held = cache.select(F.col(key)).where(F.coalesce(key, F.lit("")) != "").distinct().withColumn("_hit", F.lit(1))
    rows = wanted.where(F.coalesce(key, F.lit("")) != "").join(held, key, "left")
    return rows.groupBy(*by).agg(F.count("*").alias("requested"), F.count("_hit").alias("hits"), (F.count("*") - F.count("_hit")).alias("misses"))


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str], order: list[str]) -> DataFrame:
    """Existing rows updated by incoming ones, but for the columns to ``keep``, and new ones added. Of several incoming rows
    of a key the last by ``order`` counts."""
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    new = incoming.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n").withColumn("_new", F.lit(True))
    old = existing.withColumn("_old", F.lit(True)).select(*[F.col(c).alias(c if c in keys else f"_o_{c}") for c in [*existing.columns, "_old"]])
    both = old.join(new, keys, "full_outer")

    def value(c: str):
        if c in keys:
            return F.col(c)
        if c in keep:
            return F.when(F.col("_o__old"), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c)

    return both.select(*[value(c) for c in existing.columns])


def strict_lookup(wanted: DataFrame, cache: DataFrame, keys: list[str], values: list[str], at: str) -> DataFrame:
    """``wanted`` with the ``values`` that the cache has for exactly these keys (the newest row of a key) and ``hit``. A null in a key hits nothing."""
    held = latest(cache.where(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull()), keys, at, values).select(*keys, *[F.col(v).alias(f"cached_{v}") for v in values])
    rows = wanted.join(held.withColumn("_hit", F.lit(True)), keys, "left")
    return rows.withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def _last_version(spark: SparkSession, root: str) -> int | None:
    return max((int(p.rsplit("n=", 1)[1].split("/")[0]) for p in matching(spark, f"{root}/pointers/*/_SUCCESS")), default=None)


def _pointer(spark: SparkSession, root: str) -> dict[int, str] | None:
    """Bucket and path of each part of the newest whole version; a version that isn't bucketed has one part, -1."""
    number = _last_version(spark, root)
    if number is None:
        return None
    lines = spark.read.text(f"{root}/pointers/n={number:012d}").toLocalIterator()  # a line for each bucket
    return {int(r.value.split("\t")[0]): r.value.split("\t")[1] for r in lines}


def _point(spark: SparkSession, root: str, parts: dict[int, str]) -> None:
    """A version counts once its pointer, a folder of its own, is written whole; a lost write leaves none, and readers that hold an old
    version aren't disturbed."""
    number = (_last_version(spark, root) or 0) + 1
    rows = [(f"{b}\t{path}",) for b, path in sorted(parts.items())]
    spark.createDataFrame(rows, "line string").coalesce(1).write.mode("overwrite").text(f"{root}/pointers/n={number:012d}")


def write_version(df: DataFrame, root: str) -> str:
    """A new version beside the old ones."""
    path = f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _point(df.sparkSession, root, {-1: path})
    return path


def read_version(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest version, or None where none is whole."""
    parts = _pointer(spark, root)
    return None if parts is None else spark.read.parquet(*parts.values())


def merge_version(batch: DataFrame, root: str, keys: list[str], keep: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """``batch`` merged into the newest version, as a new one: rows are in buckets by their key, only buckets with a row of the batch are
    written again, and the others are taken over as they are."""
    spark = batch.sparkSession
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    old = _pointer(spark, root) or {}
    touched = [r.b for r in batch.select(place.alias("b")).distinct().toLocalIterator()]  # at most as many as there are buckets
    if not touched:
        return
    if -1 in old:  # a version that isn't in buckets yet
        touched = list(range(buckets))
    paths = [old[b] for b in (-1, *touched) if b in old]
    held = spark.read.parquet(*paths) if paths else batch.limit(0)
    path = f"{root}/v-{uuid.uuid4().hex}"
    upserted(held, batch, keys, keep, order).withColumn("part_", place).write.partitionBy("part_").parquet(path)
    written = {b: f"{path}/part_={b}" for b in touched if matching(spark, f"{path}/part_={b}")}
    _point(spark, root, {b: x for b, x in old.items() if b >= 0} | written)


def merged_in_order(slides: DataFrame, cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """(doc_id, image_id, page_number, block, origin) in the slides' order: a cached description by hash, else a fresh one by hash,
    else a fresh one by id; slides without any are left out."""
    c = cached.where(F.coalesce("slide_hash", F.lit("")) != "").select("slide_hash", F.col("block").alias("_c"))
    h = fresh.where(F.coalesce("slide_hash", F.lit("")) != "").groupBy("slide_hash").agg(F.min("block").alias("_h"))
    i = fresh.select("doc_id", "image_id", F.col("block").alias("_i"))
    rows = slides.join(c, "slide_hash", "left").join(h, "slide_hash", "left").join(i, ["doc_id", "image_id"], "left")
    origin = F.when(F.col("_c").isNotNull(), "cached").when(F.col("_h").isNotNull(), "fresh").when(F.col("_i").isNotNull(), "by_id")
    return rows.select("doc_id", "image_id", "page_number", F.coalesce("_c", "_h", "_i").alias("block"), origin.alias("origin")).where("origin IS NOT NULL")

"""Problem 5: lines repeated across one site's documents.

The state is kept on disk (``LineState``), in append-only tables with a folder for each partition of rows that was merged: the
lines that could be cases, the presences ``(site, key, doc_id)`` that were new, the counts per site and line that they add,
and the documents that were new. A partition is a delta: its presences that the state lacks are added, and since each counts
once, documents per line and per site are exact however rows of one document are spread over partitions. Pages of old
partitions are never read again. A line *crosses* when a delta takes it over both thresholds, or, as the site grows, below
them again; only the pages that hold such a line have to be rebuilt.

Nulls and odd rows: a null ``content`` has no lines; rows with a null ``documentname`` belong to no site and are never
cases; a null ``doc_id`` counts as no document, though its lines can be cases. Repeated rows are reported each by its own
id. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists, work_dir

MIN_LETTERS, MIN_DOCS, MIN_SHARE = 20, 4, 0.05


def line_key(line: Column) -> Column:
    """Letters of the line, lower-cased; everything else is dropped."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def site_of(documentname: Column) -> Column:
    return F.substring_index(F.lower(documentname), "/", 1)


def site_lines(pages: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(site, doc_id, chunk_id, line_no, key): every line that is long enough to be a case. ``key`` is two hashes of the
    letters, 128 bits, in place of the letters themselves."""
    rows = pages.where(F.col("documentname").isNotNull() & F.col("content").isNotNull()).select(
        site_of(F.col("documentname")).alias("site"), "doc_id", "chunk_id", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line")
    )
    rows = rows.where(F.length("line") >= min_letters).select("site", "doc_id", "chunk_id", "line_no", line_key(F.col("line")).alias("letters"))
    return rows.where(F.length("letters") >= min_letters).select(
        "site", "doc_id", "chunk_id", "line_no", F.struct(F.xxhash64("letters").alias("a"), F.xxhash64(F.lit(1), "letters").alias("b")).alias("key")
    )


def site_documents(pages: DataFrame) -> DataFrame:
    """(site, doc_id) of all rows that belong to a site, with or without lines."""
    return pages.where(F.col("documentname").isNotNull() & F.col("doc_id").isNotNull()).select(site_of(F.col("documentname")).alias("site"), "doc_id").distinct()


_KEY = "key struct<a bigint, b bigint>"


class LineState:
    """The tables of all partitions merged so far, below ``root`` (a new folder unless stated). A merge that failed leaves no mark, and can
    be repeated."""

    TABLES = {
        "lines": f"site string, doc_id string, chunk_id bigint, line_no int, {_KEY}",
        "presence": f"site string, {_KEY}, doc_id string",
        "counts": f"site string, {_KEY}, docs bigint",
        "documents": "site string, doc_id string",
        "merged": "site string",
    }

    def __init__(self, spark: SparkSession, root: str | None = None, min_letters: int = MIN_LETTERS):
        self.spark, self.root, self.min_letters = spark, root or f"{work_dir(spark)}/site-lines-{uuid.uuid4().hex}", min_letters
        self.deltas = 0
        while exists(spark, f"{self.root}/merged/{self.deltas:06d}/_SUCCESS"):
            self.deltas += 1

    def table(self, name: str, upto: int | None = None) -> DataFrame:
        """A table as it was after ``upto`` deltas (all)."""
        paths = [f"{self.root}/{name}/{k:06d}" for k in range(self.deltas if upto is None else upto)]
        return self.spark.read.schema(self.TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.TABLES[name])

    def _add(self, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}/{self.deltas:06d}"
        rows.select(*[c.split()[0] for c in self.TABLES[name].replace(_KEY, "key").split(", ")]).write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(self.TABLES[name]).parquet(path)

    def merge(self, pages: DataFrame) -> None:
        """One partition of rows. The state's lines are joined with the delta's only."""
        lines = self._add("lines", site_lines(pages, self.min_letters))
        fresh = lines.where(F.col("doc_id").isNotNull()).select("site", "key", "doc_id").distinct()
        documents = site_documents(pages)
        if self.deltas:
            fresh = fresh.join(self.table("presence"), ["site", "key", "doc_id"], "left_anti")
            documents = documents.join(self.table("documents"), ["site", "doc_id"], "left_anti")
        fresh = self._add("presence", fresh)
        self._add("counts", fresh.groupBy("site", "key").agg(F.count("*").alias("docs")))
        self._add("documents", documents)
        self._add("merged", self.spark.createDataFrame([], self.TABLES["merged"]))
        self.deltas += 1

    def crossed(self, upto: int | None = None, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
        """(site, key, docs): lines at or above both thresholds after ``upto`` deltas. Counts are added up before the shuffle, so a line or
        a site that holds a third of all rows is no hot group. A site has at most 1 / min_share times its mean number of lines per document of them."""
        sizes = self.table("documents", upto).groupBy("site").agg(F.count("*").alias("site_docs"))
        counts = self.table("counts", upto).groupBy("site", "key").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        return counts.join(sizes, "site").where(F.col("docs") >= F.col("site_docs") * F.lit(min_share)).select("site", "key", "docs")

    def cases(self, **thresholds) -> DataFrame:
        """(chunk_id, line_no, site, docs): all lines of all partitions that are cases now."""
        return self.table("lines").join(self.crossed(**thresholds), ["site", "key"]).select("chunk_id", "line_no", "site", "docs")

    def crossings(self, **thresholds) -> DataFrame:
        """(site, key, docs, direction): lines that the last delta took over the thresholds ('up', with their documents now) or below them
        ('down', with their documents before)."""
        after, before = self.crossed(**thresholds), self.crossed(self.deltas - 1, **thresholds)
        up = after.join(before, ["site", "key"], "left_anti").withColumn("direction", F.lit("up"))
        return up.unionByName(before.join(after, ["site", "key"], "left_anti").withColumn("direction", F.lit("down")))

    def touched(self, **thresholds) -> DataFrame:
        """(chunk_id): the pages, of whatever partition, that hold a line that crossed with the last delta."""
        return self.table("lines").join(self.crossings(**thresholds), ["site", "key"], "left_semi").select("chunk_id").distinct()


def repeated_lines(pages: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(chunk_id, line_no, site, docs): all rows as one delta into an empty state."""
    state = LineState(pages.sparkSession, min_letters=min_letters)
    state.merge(pages)
    return state.cases(min_docs=min_docs, min_share=min_share)


def newly_crossed(old_pages: DataFrame, new_pages: DataFrame, **thresholds) -> DataFrame:
    """(site, key, docs): lines that pass the thresholds once the new partition is merged, and did not before."""
    state = LineState(old_pages.sparkSession)
    state.merge(old_pages)
    state.merge(new_pages)
    return state.crossings(**thresholds).where("direction = 'up'").drop("direction")


def rebuilt(pages: DataFrame, state: LineState, **thresholds) -> DataFrame:
    """(chunk_id, content): the pages that the last delta touched, whole again or without the lines that are cases now. Of ``pages`` only
    those are read that hold such a line."""
    touched = state.touched(**thresholds)
    drop = state.cases(**thresholds).join(touched, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.collect_set("line_no").alias("_drop"))
    kept = F.filter(F.split("content", "\n", -1), lambda line, i: ~F.array_contains(F.coalesce("_drop", F.array().cast("array<int>")), i))
    return pages.select("chunk_id", "content").join(touched, "chunk_id", "left_semi").join(drop, "chunk_id", "left").select("chunk_id", F.array_join(kept, "\n").alias("content"))


def without_lines(pages: DataFrame, cases: DataFrame) -> DataFrame:
    """(chunk_id, content): the pages among ``cases`` (chunk_id, line_no), rebuilt without those lines. Others are not touched."""
    drop = cases.groupBy(F.col("chunk_id").alias("_page")).agg(F.collect_set("line_no").alias("_drop"))
    kept = F.filter(F.split("content", "\n", -1), lambda line, i: ~F.array_contains("_drop", i))
    return pages.join(drop, pages["chunk_id"] == F.col("_page")).select("chunk_id", F.array_join(kept, "\n").alias("content"))

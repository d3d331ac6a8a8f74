"""Decks and pages in, Markdown out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name

DECKS = r"(?i)\.(pdf|pptx?|odp)$"
PAGES = "path string, idx int, page_number int, text string, warning string"


def uploads(spark: SparkSession, path: str, most: int = 1 << 30) -> tuple[DataFrame, DataFrame]:
    """(decks, rejected): files with their hash and name; other extensions and files above ``most`` bytes are rejected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1)).withColumn("ok", F.col("path").rlike(DECKS) & (F.col("length") <= most))
    decks = named.where("ok").select("path", "file_name", "length", F.sha2("content", 256).alias("file_hash"), "content")
    return decks, named.where("NOT ok").select("path", "file_name", "length")


def pages(decks: DataFrame, readers: list[Callable[[bytes], list[str]]]) -> DataFrame:
    """(path, idx, page_number, text, warning): each deck through the first reader that doesn't fail; one row with the reason if all do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                warning = None if readers else "no reader configured"
                for read in readers:
                    try:
                        out += [(path, i, i + 1, t, warning) for i, t in enumerate(read(bytes(content)))]
                        break
                    except Exception as e:  # noqa: BLE001
                        warning = str(e)
                else:
                    out.append((path, None, None, None, warning))
            yield pd.DataFrame(out, columns=["path", "idx", "page_number", "text", "warning"])

    return decks.select("path", "content").mapInPandas(run, PAGES)


def write_sections(sections: DataFrame, root: str) -> None:
    """The sections of all documents as text in order, in files of about one size; a document may go over several, one after the other."""
    sections.repartitionByRange("doc_id", "idx", "chunk_id").sortWithinPartitions("doc_id", "idx", "chunk_id").select("doc_id", "section").write.mode("overwrite").parquet(root)


def newest(files: DataFrame) -> DataFrame:
    """(folder, path): the file of each folder that was written last; of equals the one whose path is last."""
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def write_markdown(rows: DataFrame, root: str) -> None:
    """One folder per document, named after the deck, with its parts as text files."""
    rows.select(base_name(F.col("file_name")).alias("deck"), F.col("markdown").alias("value")).write.partitionBy("deck").mode("overwrite").text(root)

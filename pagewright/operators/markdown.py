"""Pages to Markdown and back: ordered assembly, splitting into sections, insertion of descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

def sections(chunks: DataFrame) -> DataFrame:
    """(doc_id, idx, chunk_id, page, section): the page number is the place in the deck plus one where it is missing or 0."""
    page = F.coalesce(F.nullif(F.col("pageno"), F.lit(0)), F.col("idx") + 1)
    return chunks.select("doc_id", "idx", "chunk_id", page.alias("page"), T.page_section(page, F.col("content")).alias("section"))


def joined(rows: DataFrame, keys: list[str], order: list[str], value: str, separator: str, name: str) -> DataFrame:
    """Group-concat in a stated order."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda x: x["_v"]), separator).alias(name))


def page_markdown(chunks: DataFrame) -> DataFrame:
    """(doc_id, markdown): a document's sections in order. A document is one value here; ``sections`` has them as rows, and
    ``sources.files.write_sections`` writes them in order, for documents of any size."""
    return joined(sections(chunks), ["doc_id"], ["idx", "chunk_id"], "section", T.SECTION_BREAK, "markdown")


def text_by_page(chunks: DataFrame) -> DataFrame:
    """(doc_id, page_key, text): the texts of a page, in order; pages without a number are 'Unknown'."""
    key = F.coalesce(F.nullif(F.col("pageno"), F.lit(0)).cast("string"), F.lit("Unknown"))
    rows = chunks.where(T.strip(F.coalesce("content", F.lit(""))) != "").select("doc_id", key.alias("page_key"), "idx", "chunk_id", T.strip(F.col("content")).alias("text"))
    return joined(rows, ["doc_id", "page_key"], ["idx", "chunk_id"], "text", "\n\n", "text")


def page_aware_markdown(chunks: DataFrame) -> DataFrame:
    """(doc_id, markdown): every page once, with all of its texts, in the order of the numbers; what has none stands last as 'Unknown'."""
    pages = text_by_page(chunks)
    section = F.concat(F.lit("[Page "), "page_key", F.lit("]\n\n"), "text")
    rows = pages.select("doc_id", F.expr("coalesce(try_cast(page_key as int), 2147483647)").alias("at"), section.alias("section"))
    return joined(rows, ["doc_id"], ["at"], "section", T.SECTION_BREAK, "markdown")


def split_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, page_key, body, claims): the sections of Markdown; the first of a page claims what belongs to the page."""
    rows = docs.select(id_col, F.posexplode(F.split(T.strip(F.col(text_col)), r"\n\n---\n\n")).alias("pos", "body"))
    rows = rows.withColumn("page_key", F.nullif(F.regexp_extract("body", r"^\[Page ([^\]]+)\]", 1), F.lit("")))
    first = F.row_number().over(Window.partitionBy(id_col, "page_key").orderBy("pos")) == 1
    return rows.withColumn("claims", F.col("page_key").isNotNull() & first)


def with_descriptions(parts: DataFrame, blocks: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, body): sections with their page's blocks (id, page_key, ord, block) added; blocks of pages without a section
    become sections of their own behind the last one, in page order."""
    grouped = joined(blocks, [id_col, "page_key"], ["ord"], "block", "\n\n", "blocks")
    claimed = parts.join(grouped.withColumn("claims", F.lit(True)), [id_col, "page_key", "claims"], "left")
    kept = claimed.select(id_col, "pos", F.when(F.col("blocks").isNull(), F.col("body")).otherwise(F.concat(T.strip(F.col("body")), F.lit("\n\n"), "blocks")).alias("body"))
    last = parts.groupBy(id_col).agg((F.max("pos") + 1).alias("n"))
    free = blocks.join(parts.where("claims").select(id_col, "page_key"), [id_col, "page_key"], "left_anti").join(last, id_col)
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.expr("try_cast(page_key as int)").asc_nulls_last(), "page_key", "ord")) - 1
    added = free.select(id_col, (F.col("n") + place).alias("pos"), F.concat(F.lit("[Page "), "page_key", F.lit("]\n\n"), "block").alias("body"))
    return kept.unionByName(added)


def force_ocr(chunks: DataFrame, share: float = 0.35) -> DataFrame:
    """(doc_id, pages, blank, retry): documents whose blank pages call for another reading with recognition forced."""
    stats = chunks.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(T.is_blank_page(F.col("content"))).alias("blank"))
    return stats.withColumn("retry", (F.col("blank") > 0) & (F.col("blank") >= F.ceil(F.col("pages") * F.lit(share))))

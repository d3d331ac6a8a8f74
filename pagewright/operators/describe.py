"""Description of slides by a provider: jobs, prompts, and the read-through cache around the provider's calls."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored

MAX_IMAGE_BYTES = 4 * 1024 * 1024
TEMPLATE = "Describe what this slide shows to someone who can't see it. Answer with one JSON object."


def jobs(images: DataFrame) -> DataFrame:
    """(doc_id, image_id, page_number, slide_hash, fingerprint, byte_estimate) with defaults for what is missing: the hash falls back on the
    fingerprint and then on the reference's own hash."""
    ident = T.first_filled(F.col("slide_hash"), F.col("fingerprint"), F.sha2(F.col("reference"), 256))
    return images.select("doc_id", F.coalesce(F.nullif("id", F.lit("")), F.lit("image")).alias("image_id"), "page_number", ident.alias("slide_hash"), F.coalesce(F.nullif("fingerprint", F.lit("")), F.substring(ident, 1, 16)).alias("fingerprint"), F.coalesce("byte_estimate", F.lit(0)).alias("byte_estimate"))


def metrics(boxes: Column, area: Column, residual: Column, edges: Column) -> Column:
    """The detector's figures as the prompt has them; nothing where none is known, None for a single missing one."""
    shown = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    lines = [F.concat(F.lit(f"\n- {k}: "), shown(v)) for k, v in (("pictureBoxCount", boxes), ("pictureAreaRatio", area), ("residualRatio", residual), ("edgeRatio", edges))]
    return F.when(F.coalesce(boxes.cast("string"), area.cast("string"), residual.cast("string"), edges.cast("string")).isNull(), "").otherwise(F.concat(F.lit("\n\nVisual detector metrics:"), *lines))


def with_page_text(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Each image with the text of its page (doc_id, page_key, text), empty where there is none."""
    key = F.coalesce(F.nullif(F.col("page_number"), F.lit(0)).cast("string"), F.lit("Unknown"))
    rows = images.withColumn("page_key", key).join(texts.select("doc_id", "page_key", F.col("text").alias("page_text")), ["doc_id", "page_key"], "left")
    return rows.withColumn("page_text", F.coalesce("page_text", F.lit("")))


def is_usable(error: Column, block: Column, *parts: Column) -> Column:
    """A description without an error that says anything: a block, or a part that is neither null nor empty."""
    said = F.coalesce(block, F.lit("")) != ""
    for p in parts:
        said = said | (F.coalesce(p, F.lit("")) != "")
    return (F.coalesce(error, F.lit("")) == "") & said


def prompt(page: Column, text: Column, template: str = TEMPLATE) -> Column:
    body = F.coalesce(F.nullif(T.compact(text), F.lit("")), F.lit("[No OCR text available]"))
    where = F.coalesce(F.concat(F.lit("Page "), F.nullif(page, F.lit(0)).cast("string")), F.lit("Unknown page"))
    return F.concat(F.lit(template + "\n\nSlide: "), where, F.lit("\nExisting OCR text from this slide:\n"), body)


def prompt_hash(version: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(version), text), 256)


def statuses(images: DataFrame, cache: DataFrame, most: int = MAX_IMAGE_BYTES) -> DataFrame:
    """(doc_id, image_id, status, error) in the order of the checks: no hash, cached, too large, else a miss to be described."""
    held = cache.select("slide_hash").where(F.coalesce("slide_hash", F.lit("")) != "").distinct().withColumn("_hit", F.lit(True))
    rows = images.select("doc_id", F.col("id").alias("image_id"), "slide_hash", "byte_estimate").join(held, "slide_hash", "left")
    none, large = F.coalesce("slide_hash", F.lit("")) == "", F.col("byte_estimate") > most
    status = F.when(none, "error").when(F.col("_hit"), "hit").when(large, "error").otherwise("miss")
    error = F.when(none, "Slide hash is missing.").when(F.col("_hit").isNull() & large, F.concat(F.lit("Slide image is "), F.col("byte_estimate").cast("string"), F.lit(f" bytes, above {most}.")))
    return rows.select("doc_id", "image_id", status.alias("status"), error.alias("error"))


def with_retry(call: Callable[[dict], str], tries: int = 6, base: float = 4.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[dict], str]:
    """``call`` repeated on connection errors and time-outs, each time after twice as long and up to a second more."""

    def run(job: dict) -> str:
        for n in range(tries):
            try:
                return call(job)
            except (ConnectionError, TimeoutError):
                sleep(base * 2**n + random.random())
        return call(job)

    return run


def described(todo: DataFrame, call: Callable[[dict], str], at_once: int = 1) -> DataFrame:
    """(doc_id, image_id, slide_hash, content, error): the provider called once per row inside the tasks, ``at_once`` calls side by side, the
    rows in the order that they came in; a failed call is a row."""

    def one(job: dict) -> tuple:
        try:
            return job["doc_id"], job["image_id"], job["slide_hash"], call(job), None
        except Exception as e:  # noqa: BLE001
            return job["doc_id"], job["image_id"], job["slide_hash"], None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                yield pd.DataFrame(list(pool.map(one, pdf.to_dict("records"))), columns=["doc_id", "image_id", "slide_hash", "content", "error"])

    return todo.select("doc_id", "image_id", "slide_hash").mapInPandas(run, "doc_id string, image_id string, slide_hash string, content string, error string")


def read_through(images: DataFrame, cache: DataFrame, call: Callable[[dict], str], most: int = MAX_IMAGE_BYTES, at_once: int = 1) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache rows). Answers (doc_id, image_id, slide_hash, status, content, error): the newest cached block of a hit, what the provider
    says of a miss, asked once per hash, and why there is neither. Errors are not cached."""
    asked = stored(statuses(images, cache, most).join(images.select("doc_id", F.col("id").alias("image_id"), "slide_hash").distinct(), ["doc_id", "image_id"]).distinct(), "asked")
    held = cache.where("slide_hash <> '' AND markdown_block IS NOT NULL").groupBy("slide_hash").agg(F.max_by("markdown_block", F.struct("updated_at", "desc_id")).alias("content"))
    hits = asked.where("status = 'hit'").join(held, "slide_hash", "left").select("doc_id", "image_id", "slide_hash", "status", "content", "error")
    misses = asked.where("status = 'miss'")
    todo = misses.groupBy("slide_hash").agg(F.min(F.struct("doc_id", "image_id")).alias("i")).select("i.doc_id", "i.image_id", "slide_hash")
    new = stored(described(todo, call, at_once), "described")
    fresh = misses.drop("error").join(new.select("slide_hash", "content", "error"), "slide_hash").withColumn("status", F.when(F.col("error").isNull(), "miss").otherwise("error"))
    answers = hits.unionByName(fresh).unionByName(asked.where("status = 'error'").withColumn("content", F.lit(None).cast("string")))
    return answers.select("doc_id", "image_id", "slide_hash", "status", "content", "error"), new.where("error IS NULL").select("slide_hash", "content")

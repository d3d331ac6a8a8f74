"""JSON as models and parsers write it: fenced, prefixed, cut off."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

DESCRIPTION = "pageNumber int, visualType string, visualDescription string, teachingExplanation string, importantVisualElements array<string>, visibleTextNotInOcr array<string>, confidence string"


def outermost_object(c: Column) -> Column:
    """From the first brace to the last, whatever stands around them; null without any."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def valid(c: Column) -> Column:
    return F.when(F.try_parse_json(c).isNotNull(), c)


def description(c: Column) -> Column:
    """The description's fields with defaults: type mixed, confidence medium, lists without blanks. Null for text that isn't JSON."""
    d = F.from_json(valid(outermost_object(c)), DESCRIPTION)
    items = lambda x: F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), strip), lambda v: v != "")
    word = lambda x, default: F.coalesce(F.nullif(strip(x), F.lit("")), F.lit(default))
    return F.when(
        valid(outermost_object(c)).isNotNull(),
        F.struct(
            word(d["visualType"], "mixed").alias("visual_type"), word(d["visualDescription"], "").alias("visual_description"), word(d["teachingExplanation"], "").alias("teaching_explanation"),
            items(d["importantVisualElements"]).alias("elements"), items(d["visibleTextNotInOcr"]).alias("missing_text"), word(d["confidence"], "medium").alias("confidence"),
        ),
    )


def markdown_block(d: Column) -> Column:
    """The description as Markdown: fixed headings and order, empty parts left out."""
    part = lambda x, head="": F.when(x != "", F.concat(F.lit(head), x))
    listed = lambda x, head: F.when(F.size(x) > 0, F.concat(F.lit(head), F.array_join(F.transform(x, lambda v: F.concat(F.lit("- "), v)), "\n")))
    return F.concat_ws(
        "\n\n", F.lit("### Visual Explanation"), part(d["visual_description"]), part(d["teaching_explanation"], "Teaching note:\n"),
        listed(d["elements"], "Important visual elements:\n"), listed(d["missing_text"], "Visible text or symbols not captured by OCR:\n"),
    )


def repaired_json(text: str) -> str | None:
    """Cut-off JSON closed where it stops: first an open string, then open brackets from the inside out. Null if that isn't JSON."""
    opened, in_string, escaped = [], False, False
    for ch in text:
        if in_string:
            in_string, escaped = escaped or ch != '"', not escaped and ch == "\\"
        elif ch == '"':
            in_string = True
        elif ch in "{[":
            opened.append("}" if ch == "{" else "]")
        elif ch in "}]" and opened:
            opened.pop()
    closed = text + '"' * in_string + "".join(reversed(opened))
    try:
        json.loads(closed)
    except ValueError:
        return None
    return closed


def parsed(df: DataFrame, id_col: str, value: str) -> DataFrame:
    """(id, status, json): 'valid', 'fenced' (found inside other text), 'repaired', 'empty' or 'error', and the JSON text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(v: str | None) -> tuple[str, str | None]:
            text = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", v or "").strip()
            if not text:
                return "empty", None
            start, end = text.find("{"), text.rfind("}")
            tries = [("valid", v), ("fenced", text), ("fenced", text[start : end + 1] if 0 <= start < end else None), ("repaired", repaired_json(text[start:]) if start >= 0 else None)]
            for status, t in tries:
                try:
                    json.loads(t or "-")
                    return status, t
                except ValueError:
                    continue
            return "error", None

        for pdf in batches:
            yield pd.DataFrame([(i, *one(v)) for i, v in zip(pdf["id"], pdf["value"])], columns=["id", "status", "json"])

    return df.select(F.col(id_col).alias("id"), F.col(value).alias("value")).mapInPandas(run, "id bigint, status string, json string").withColumnRenamed("id", id_col)


def descriptions(df: DataFrame, id_col: str, value: str) -> DataFrame:
    """(id, status, and the description's fields) of every value that can be read: by the built-in parser ('read'), and only what that leaves
    after repair ('repaired', or as ``parsed`` says)."""
    rows = df.select(id_col, value)
    read = rows.select(id_col, F.lit("read").alias("status"), description(F.col(value)).alias("d"))
    left = parsed(rows.where(valid(outermost_object(F.col(value))).isNull()), id_col, value).where("json IS NOT NULL")
    return read.unionByName(left.select(id_col, "status", description(F.col("json")).alias("d"))).where("d IS NOT NULL").select(id_col, "status", "d.*")

"""Text expressions. White space is Unicode's throughout; all of them stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two or more pipe rows in a run, and the signs of Markdown.
TABLE = r"(?mdU)(?:^\|.*\|\s*$\n?){2,}"
MARKDOWN_SIGNS = (r"(?m)^#{1,6}\s+\S", r"(?m)^\s*[-*]\s+\S", r"(?m)^\|.*\|", r"```", r"\n\s*\n")
SECTION_BREAK = "\n\n---\n\n"
UNITS = ("B", "KB", "MB", "GB")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def compact(c: Column, most: int = 1800) -> Column:
    """White space collapsed and stripped, at most ``most`` characters."""
    return F.substring(strip(F.regexp_replace(c, r"(?U)\s+", " ")), 1, most)


def is_blank_page(c: Column, least: int = 10) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) < least


def table_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(TABLE)), F.lit(0))


def looks_like_markdown(c: Column, least: int = 20) -> Column:
    signs = [c.rlike(p) for p in MARKDOWN_SIGNS]
    any_sign = signs[0]
    for s in signs[1:]:
        any_sign = any_sign | s
    return F.coalesce((F.length(strip(c)) >= least) & any_sign, F.lit(False))


def page_section(page: Column, text: Column) -> Column:
    """``[Page N]`` and, after a blank line, the stripped text if there is any."""
    body = strip(F.coalesce(text, F.lit("")))
    return F.concat(F.lit("[Page "), page.cast("string"), F.lit("]"), F.when(body == "", "").otherwise(F.concat(F.lit("\n\n"), body)))


def base64_bytes(c: Column) -> Column:
    """Bytes that base64 text stands for: three quarters of its length, halves to even."""
    return F.bround(F.length(strip(c)) * F.lit(0.75), 0).cast("bigint")


def short_hash(c: Column) -> Column:
    """Multiplicative hash in 32 bits, hexadecimal without leading zeros."""
    start, mask = F.lit(5381).cast("bigint"), F.lit(4294967295).cast("bigint")
    step = lambda h, ch: ((h * 33).bitwiseAND(mask)).bitwiseXOR(F.ascii(ch).cast("bigint"))
    return F.lower(F.hex(F.aggregate(F.filter(F.split(c, ""), lambda ch: ch != ""), start, step)))


def file_size_label(c: Column) -> Column:
    """Bytes in the largest unit that keeps the figure at 1 or more: whole from 10 on and for bytes, else with one decimal."""
    power = F.when(c > 0, F.least(F.floor(F.log2(c.cast("double")) / 10), F.lit(len(UNITS) - 1))).otherwise(F.lit(0)).cast("int")
    figure = c / F.pow(F.lit(1024.0), power)
    shown = F.when((figure >= 10) | (power == 0), F.round(figure, 0).cast("bigint").cast("string")).otherwise(F.round(figure, 1).cast("string"))
    return F.when(F.coalesce(c, F.lit(0)) == 0, F.lit("0 B")).otherwise(F.concat(shown, F.lit(" "), F.element_at(F.array(*map(F.lit, UNITS)), power + 1)))


def base_name(c: Column) -> Column:
    """File name without the extension of a deck."""
    return F.regexp_replace(c, r"(?i)\.(pdf|pptx?|odp)$", "")


def item_type(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.contains("table"), "table").when(low.contains("picture") | low.contains("figure") | low.contains("image"), "figure").otherwise("text")


def page_from_path(path: Column) -> Column:
    """The page number that a source path names, or null."""
    return F.nullif(F.regexp_extract(path, r"(?:^|\.)pages?[.\[](\d+)", 1), F.lit("")).cast("int")


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def cells(c: Column) -> Column:
    """The cells of the text's pipe rows, as an array of rows of trimmed text with white space collapsed; rules between rows are no cells,
    nor are rows without any text."""
    lines = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\|.*\|\s*$") & ~x.rlike(r"^\|[-:| ]+\|\s*$"))
    rows = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|\s*$", ""), r"\|"), lambda v: strip(F.regexp_replace(v, r"(?U)\s+", " "))))
    return F.filter(rows, lambda row: F.exists(row, lambda v: v != ""))


def pipe_table(rows: Column) -> Column:
    """Rows of cells as a Markdown table: the first is the head, short rows are filled up. Null without rows."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    filled = F.transform(rows, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(filled, 1, 1), F.array(rule), F.slice(filled, 2, 1 << 30)), "\n"))


def formatted(label: Column, text: Column) -> Column:
    """An item's text as Markdown: titles and section headers get ``## ``, list entries ``- ``, unless they have a sign of their own."""
    t, low = strip(F.coalesce(text, F.lit(""))), F.lower(label)
    heading = (low.contains("title") | low.contains("section_header")) & ~t.startswith("#")
    return F.when(t == "", "").when(heading, F.concat(F.lit("## "), t)).when(low.contains("list") & ~t.rlike(r"^[-*+]\s+"), F.concat(F.lit("- "), t)).otherwise(t)


def mime_type(c: Column) -> Column:
    """The image type that a loose name means."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t.startswith("image/"), t).when(t.contains("jpeg") | t.contains("jpg"), "image/jpeg").when(t.contains("webp"), "image/webp").when(t.contains("gif"), "image/gif").otherwise("image/png")


def image_source(c: Column, kind: Column) -> Column:
    """A data URI as it is, base64 of more than 100 characters as one, else nothing."""
    t, packed = strip(c), F.regexp_replace(c, r"(?U)\s", "")
    return F.when(t.rlike(r"(?i)^data:image/[^;]+;base64,"), t).when((F.length(packed) > 100) & packed.rlike(r"^[A-Za-z0-9+/]+={0,2}$"), F.concat(F.lit("data:"), mime_type(kind), F.lit(";base64,"), packed)).otherwise("")

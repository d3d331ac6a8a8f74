"""Documents as parsers write them: a JSON tree whose body points to items by reference."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARKDOWN_SIGNS, item_type

#: The collections of items, with the type of those that don't name one.
FIGURE_END = "TODO: send this image to Vision LLM only if OCR text is insufficient."
DOCUMENT_PATHS = (
    "document.json_content", "result.document.json_content", "result.document", "document", "result", "json_content", "result.json",
    "json", "output.formats.json", "output.json", "formats.json", "data.document", "data",
)
DOCUMENT_PARTS = ("body", "texts", "tables", "pictures", "figures", "pages", "schema_name", "name")
MARKDOWN_PATHS = ("result.document.md_content", "result.document.markdown", "result.markdown", "document.md_content", "document.markdown", "md_content", "markdown")
MARKDOWN_FIELDS = ("md_content", "markdown", "markdown_content", "md", "text_md", "content_md")
TEXTS = ("text", "orig", "content", "value", "markdown", "md")
COLLECTIONS = {"texts": "text", "tables": "table", "pictures": "figure", "figures": "figure", "images": "figure"}


def dereferenced(document: dict, pointer: str):
    """What a JSON pointer (``#/texts/3``, with ~1 for a slash and ~0 for a tilde) leads to, or None."""
    node = document
    for key in pointer.removeprefix("#").strip("/").split("/"):
        key = key.replace("~1", "/").replace("~0", "~")
        try:
            node = node[int(key)] if isinstance(node, list) else node[key]
        except (KeyError, IndexError, ValueError, TypeError):
            return None
    return node


def _filled(*values):
    return next((v for v in values if v not in (None, "")), "")


def kind(item: dict, default: str = "text") -> str:
    """'table', 'figure' or 'text', by the item's label."""
    label = str(_filled(item.get("label"), item.get("type"), item.get("kind"), default)).lower()
    return "table" if "table" in label else "figure" if any(x in label for x in ("picture", "figure", "image")) else "text"


def page_of(item: dict, inherited=None):
    """The page that an item names under any of the names for it (fixed values), or the one it inherits."""
    prov = item.get("prov")
    first = prov[0] if isinstance(prov, list) and prov and isinstance(prov[0], dict) else {}
    return _filled(first.get("page_no"), first.get("page"), *[item.get(k) for k in ("page_no", "pageNumber", "page_number", "page")]) or inherited


def _children(document: dict, item: dict) -> list[tuple[str | None, dict]]:
    """(reference, item) of the children that lead somewhere."""
    out = []
    for child in item.get("children") or []:
        ref = child.get("$ref") if isinstance(child, dict) else None
        found = dereferenced(document, ref) if ref else child
        if isinstance(found, dict):
            out.append((ref or _filled(*[found.get(k) for k in ("self_ref", "selfRef", "ref")]) or None, found))
    return out


def reading_order(document: dict) -> list[tuple[str, dict, int | None]]:
    """(reference, item, page) along the body, each item once, then the items that the body doesn't lead to. A page number holds for
    everything below it that names none; references that lead nowhere or back are passed over. Text below a figure belongs to the figure,
    and an item without place, text (under any of its names), data or image is only a way to its children."""
    out, seen = [], set()
    todo = [(ref, x, None, "") for ref, x in reversed(_children(document, document.get("body") or {}))]
    while todo:
        ref, item, page, above = todo.pop()
        mark = ref or id(item)
        if mark in seen:
            continue
        seen.add(mark)
        page, own = page_of(item, page), kind(item)
        if not (above == "figure" and own == "text") and any(item.get(k) for k in ("prov", "data", "image", *TEXTS)):
            out.append((ref or "", item, page))
        todo += [(r, x, page, own) for r, x in reversed(_children(document, item))]
    for name in COLLECTIONS:
        for k, item in enumerate(document.get(name) or []):
            if f"#/{name}/{k}" not in seen and isinstance(item, dict):
                out.append((f"#/{name}/{k}", item, page_of(item)))
    return out


def text_of(item: dict) -> str:
    """An item's text as Markdown: titles and section headers with ``## ``, list entries with ``- ``."""
    text = str(_filled(*[item.get(k) for k in TEXTS])).strip()
    label = str(_filled(item.get("label"), item.get("type"), item.get("kind"))).lower()
    if text and ("title" in label or "section_header" in label) and not text.startswith("#"):
        return f"## {text}"
    return f"- {text}" if text and "list" in label and not re.match(r"[-*+]\s+", text) else text


def caption_of(value) -> str:
    """A caption given as text, as an object with text, or as a list of either."""
    if isinstance(value, list):
        return " ".join(filter(None, map(caption_of, value)))
    return str(_filled(value.get("text"), value.get("content"), value.get("value")) if isinstance(value, dict) else value or "")


def figure_text(document: dict, figure: dict) -> str:
    """All text below a figure, in order."""
    out, seen, todo = [], set(), list(reversed(_children(document, figure)))
    while todo:
        _, item = todo.pop()
        if id(item) in seen:
            continue
        seen.add(id(item))
        if kind(item) == "text":
            out.append(text_of(item))
        else:
            todo += reversed(_children(document, item))
    return "\n\n".join(filter(None, out))


def grid_of(data: dict) -> str:
    """Cells with their rows and columns as a Markdown table; the first row with any text is the head, empty rows are left out, a later cell takes the
    place of an earlier one, and cells beyond a stated size are passed over."""
    cells = data.get("table_cells") or data.get("cells") or []
    at = lambda c, side, name: next((c[k] for k in (f"{side}_{name}_offset_idx", name, f"{name}_index") if c.get(k) is not None), 0)
    size = [data.get(f"num_{n}s") or data.get(f"{n}_count") or max((at(c, "end", n) for c in cells), default=-1) + 1 for n in ("row", "col")]
    grid = [[""] * size[1] for _ in range(size[0])]
    for c in cells:
        row, col = at(c, "start", "row"), at(c, "start", "col")
        if row < size[0] and col < size[1]:
            grid[row][col] = " ".join(str(_filled(c.get("text"), c.get("content"), c.get("value"))).split())
    rows = [r for r in grid if any(r)]
    return "\n".join(f"| {' | '.join(r)} |" for r in [*rows[:1], ["---"] * size[1], *rows[1:]]) if rows else ""


def content_of(document: dict, item: dict, page, own: str) -> str:
    """What an item becomes in the Markdown of its page."""
    if own == "table":
        data = item.get("data")
        return str(_filled(item.get("markdown"), item.get("md"), item.get("text"))).strip() or grid_of(data if isinstance(data, dict) else item)
    if own == "text":
        return text_of(item)
    image, data = (x if isinstance(x, dict) else {} for x in (item.get("image"), item.get("data")))
    caption = _filled(caption_of(item.get("caption")), caption_of(item.get("captions")), item.get("text"), item.get("title"), item.get("description"))
    image_of = _filled(image.get("uri"), image.get("path"), image.get("data"), item.get("uri"), item.get("path"), item.get("base64"), data.get("uri"), data.get("path"), item.get("self_ref"))
    read = figure_text(document, item)
    parts = [f"[Figure on Page {page or 'Unknown'}]", *(["Extracted text from image OCR:", read] if read else []), f"Caption: {caption}".rstrip(), f"Image reference: {image_of}".rstrip()]
    return "\n".join([*parts, FIGURE_END])


def table_count(value) -> int:
    """List entries, at any depth, that are labelled as tables or have rows or cells."""
    n, todo = 0, [value]
    while todo:
        x = todo.pop()
        todo += x.values() if isinstance(x, dict) else x if isinstance(x, list) else []
        for y in x if isinstance(x, list) else []:
            if isinstance(y, dict):
                named = " ".join(str(y.get(k) or "") for k in ("type", "label", "name")).lower()
                n += "table" in named or any(isinstance(y.get(k), list) for k in ("rows", "cells", "table_cells"))
    return n


def at_path(value, path: str):
    """What a dotted path leads to, or None; JSON in a text is opened on the way."""
    for key in path.split("."):
        value = opened(value)
        if not isinstance(value, dict):
            return None
        value = value.get(key)
    return opened(value)


def opened(value):
    """A text that holds a JSON object or list as that, all else as it is."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def structured(response: dict) -> tuple[dict | None, str]:
    """The parser document in a response, and the path where it stands: the first of DOCUMENT_PATHS with one of a document's parts."""
    for path in DOCUMENT_PATHS:
        found = at_path(response, path)
        if isinstance(found, dict) and any(found.get(k) for k in DOCUMENT_PARTS):
            return found, path
    return None, ""


def found_markdown(response) -> tuple[str, str]:
    """Markdown in a response and its path: at one of MARKDOWN_PATHS, else in a field named so, nearest to the top first, else the first text that
    looks like it."""
    for path in MARKDOWN_PATHS:
        found = at_path(response, path)
        if isinstance(found, str) and found.strip():
            return found, path
    strings, todo = [], [("", response)]
    while todo:
        path, x = todo.pop()
        pairs = list(x.items()) if isinstance(x, dict) else list(enumerate(x)) if isinstance(x, list) else []
        strings += [(f"{path}.{k}".strip("."), str(k), v) for k, v in sorted(pairs, key=lambda kv: MARKDOWN_FIELDS.index(kv[0]) if kv[0] in MARKDOWN_FIELDS else 99) if isinstance(v, str)]
        todo += [(f"{path}.{k}".strip("."), v) for k, v in reversed(pairs) if isinstance(v, (dict, list))]
    named = [(v, p) for p, k, v in strings if k in MARKDOWN_FIELDS and v.strip()]
    looks = [(v, p) for p, _, v in strings if len(v.strip()) >= 20 and any(re.search(x, v) for x in MARKDOWN_SIGNS)]
    return (named or looks or [("", "")])[0]


def items(documents: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, ord, ref, label, page, text, content, type): the items of each document in reading order, with their text and what they are in
    Markdown. A response is searched for the document in it; text that is no JSON object has no items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *k, text in pdf.itertuples(index=False):
                document = opened(text or "")
                if not isinstance(document, dict):
                    continue
                document = document if document.get("body") or document.get("texts") else structured(document)[0] or document
                for n, (ref, i, page) in enumerate(reading_order(document)):
                    label = i.get("label") or i.get("type") or COLLECTIONS.get(ref.strip("#/").split("/")[0])
                    own = kind(i, label or "text")
                    rows.append((*k, n, ref, label, page, i.get("text") or i.get("orig") or i.get("content"), content_of(document, i, page, own)))
            yield pd.DataFrame(rows, columns=[*keys, "ord", "ref", "label", "page", "text", "content"], dtype=object)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.select(*keys).schema)
    rows = documents.select(*keys, value).mapInPandas(run, f"{schema}, ord int, ref string, label string, page int, text string, content string")
    return rows.withColumn("type", item_type(F.coalesce("label", F.lit("text"))))


def as_document(rows: Column) -> Column:
    """JSON with all rows of a group as texts, and a body that leads to them in the order of the array."""
    refs = F.transform(rows, lambda _, i: F.struct(F.concat(F.lit("#/texts/"), i.cast("string")).alias("$ref")))
    texts = F.transform(rows, lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"), F.array(F.struct(x["page"].alias("page_no"))).alias("prov")))
    return F.to_json(F.struct(F.struct(refs.alias("children")).alias("body"), texts.alias("texts")))

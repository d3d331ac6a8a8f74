"""Problem 4: text read with the wrong character encoding.

Round-trip repair. Bytes of 0x80 and above are characters outside ASCII in every legacy encoding, so what was garbled is a
run of such characters. Each run is encoded again under every candidate encoding and the bytes are decoded strictly as
UTF-8; the result is accepted when its garbling cost is lower than the run's, and the step is repeated for text that was
garbled more than once, until the cost falls no more. Cyrillic of a one-byte encoding that was read as a western one is put back
run by run in the same way: encoded, strictly decoded as Cyrillic, and accepted where the garbling cost falls; for its letters the
cost is that of how vowels and consonants follow each other, and a page has to show it in one run of five letters or in eight letters of different runs. A run that has right and wrong characters side by side is repaired in its decodable parts.
Replacement characters, and leftovers of a sequence that lost bytes, mark a run as affected though nothing can restore it.

The work is per row without any shuffle; runs recur, so each task remembers the verdicts of up to ``MEMO`` runs.

Nulls and odd rows: a null or empty text is not affected; texts of any length are read whole; repeated rows are judged
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The encodings that text is mistaken for.
CANDIDATES = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "cp1250", "iso8859_15", "mac_cyrillic")
MEMO = 200_000

RUN = re.compile(r"[^\x00-\x7f]+")
_SEQUENCE = re.compile(r"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3})+")
#: Characters that ordinary pages hold beside ASCII: letters of western and Russian text, typographic and technical signs.
_USUAL = re.compile(r"[àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒА-яЁё–—‘’‚“”„…•«»‹›€£§°±×÷µ²³¹½¼¾→←↔↑↓≥≤≠≈∞√∑∏∫∂∈Ωα-ωΔΣΠΓΘΛΦΨ©®™¿¡ªº·†‡‰\xa0\xad‐‑−ﬁﬂ✓]")
#: Three letters or more that all are accented, in no word of ASCII letters: no western language has them, but Cyrillic in a
#: one-byte encoding looks so when it is read as a western one.
_WESTERN_ONLY = re.compile(r"(?<![A-Za-z\xc0-\xff])[\xc0-\xff\xa8\xb8]{3,}(?![A-Za-z])")
_WESTERN = re.compile(r"(?<![A-Za-z\xc0-\xff])[\x80-\xff]+(?![A-Za-z])")
_SINGLE = ("cp1251", "koi8_r")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_CONTROL = re.compile(r"[\x80-\x9f�]")


def cost(run: str) -> int:
    """Garbling cost: 1 for a usual character, 3 for an unusual one, 5 for a control or replacement character, 6 beyond the basic plane."""
    usual, control, far = len(_USUAL.findall(run)), len(_CONTROL.findall(run)), sum(c > "\uffff" for c in run)
    return usual + 5 * control + 6 * far + 3 * (len(run) - usual - control - far)


def _as_bytes(run: str, encoding: str) -> str:
    """The bytes of the run under the encoding, as characters of the same number; what it can't encode stays above 0xff, but
    for the C1 characters, by which decoders let undefined bytes through."""
    out = []
    for ch in run:
        try:
            b = ch.encode(encoding)
            out.append(chr(b[0]) if b[0] > 127 else "Ā")
        except UnicodeEncodeError:
            out.append(ch if "\x80" <= ch <= "\x9f" else "Ā")
    return "".join(out)


def _undo(run: str) -> str | None:
    """One layer off the run, or None where no encoding lowers the cost."""
    best, least = None, cost(run)
    for encoding in CANDIDATES:
        raw = _as_bytes(run, encoding)
        out, at = [], 0
        for m in _SEQUENCE.finditer(raw):
            was = run[m.start() : m.end()]
            try:
                now = m.group().encode("latin-1").decode("utf-8")
            except UnicodeDecodeError:
                continue
            lone = len(now) == 1 and _CYRILLIC.match(now) and encoding not in ("cp1252", "latin-1")
            if cost(now) < cost(was) and not lone:
                out += [run[at : m.start()], now]
                at = m.end()
        if at:
            whole = "".join([*out, run[at:]])
            if cost(whole) < least:
                best, least = whole, cost(whole)
    return best


def repair_run(run: str) -> tuple[str, int, bool]:
    """(text, layers taken off, whether garbled characters remain)."""
    layers = 0
    while (better := _undo(run)) is not None:
        run, layers = better, layers + 1
    return run, layers, bool(_CONTROL.search(run))


_VOWELS = frozenset("аеёиоуыэюяѐіїєў")


def letter_cost(run: str) -> int:
    """Garbling cost of the letters in a run: each pair of letters costs 1 where a vowel and a consonant meet and 2 otherwise; 3 where accented western letters
    stand side by side, or a small letter before a capital. A sign among letters costs 3."""
    cost = 0
    for a, b in zip(run, run[1:]):
        if not (a.isalpha() and b.isalpha()):
            cost += 3 if a.isalpha() != b.isalpha() and not (a.isspace() or b.isspace()) else 0
        elif a.islower() and b.isupper() or (a > "\x7f" and b > "\x7f" and (a < "\u0250") and (b < "\u0250")):
            cost += 3
        else:
            cost += 1 if (a.lower() in _VOWELS) != (b.lower() in _VOWELS) else 2
    return cost


def _decoded(run: str, encoding: str) -> str | None:
    try:
        return run.encode("cp1252" if any(c > "\xff" for c in run) else "latin-1").decode(encoding)
    except UnicodeError:
        return None


def _one_byte(text: str) -> str | None:
    """The text with Cyrillic restored that was read as western text, or None. The encoding is the one by which the cost falls most; runs
    that it can't decode, or makes no better, stay."""
    shown = {m for m in _WESTERN_ONLY.findall(text) if sum(c.isalpha() for c in m) >= 3}
    if sum(map(len, shown)) < 8 and max(map(len, shown), default=0) < 5:
        return None
    runs = set(_WESTERN.findall(text))
    best: dict[str, str] = {}
    gained = 0
    for encoding in _SINGLE:
        out = {r: d for r in runs if (d := _decoded(r, encoding)) is not None and (letter_cost(d) < letter_cost(r) or len(r) == 1 and d.isalpha() and _CYRILLIC.match(d))}
        gain = sum(letter_cost(r) - letter_cost(d) for r, d in out.items())
        if gain > gained and any(r in out for r in shown):
            best, gained = out, gain
    return _WESTERN.sub(lambda m: best.get(m.group(), m.group()), text) if best else None


def repair(text: str, memo: dict) -> tuple[str, int, bool] | None:
    """(text, layers, whether anything remains garbled), or None for a text that is not affected."""
    hit, layers, rest = False, 0, False
    for run in set(RUN.findall(text)):
        if run not in memo:
            if len(memo) >= MEMO:
                memo.clear()
            memo[run] = repair_run(run)
        _, n, left = memo[run]
        hit, layers, rest = hit or n > 0 or left, max(layers, n), rest or left
    better = RUN.sub(lambda m: (memo.get(m.group()) or repair_run(m.group()))[0], text) if layers else text
    if (swapped := _one_byte(better)) is not None:
        return swapped, layers + 1, "\ufffd" in swapped
    return (better, layers, rest) if hit else None


def garbled(df: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(id, restored, layers, complete): one row for each affected row. ``restored`` is the text with every run repaired that
    could be; ``complete`` says whether none is left garbled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for pdf in batches:
            rows = [(i, *r) for i, t in zip(pdf["id"], pdf["text"]) if (r := repair(t, memo))]
            yield pd.DataFrame([(i, t, n, not rest) for i, t, n, rest in rows], columns=["id", "restored", "layers", "complete"])

    odd = df.where(F.col(text_col).rlike(r"[^\x00-\x7f]")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return odd.mapInPandas(run, "id bigint, restored string, layers int, complete boolean").withColumnRenamed("id", id_col)

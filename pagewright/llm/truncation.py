"""Problem 3: values cut off by a field limit or in the middle of a transfer.

A value is cut if its log-odds are above 0. They are the sum of three terms, each of which can outweigh the others:

* *Prior: the censoring posterior.* The lengths of each source are taken as log-normal and right-censored: whole values
  contribute a density, cut ones the chance of being longer. The two parameters are the maximum-likelihood ones (EM over the
  source's length histogram). Where many values end at one length, more than the fitted density allows, that length is a
  candidate limit, and the share of the excess is the posterior chance that a value of this length was censored there. It is
  taken for whole values, in characters and in UTF-8 bytes (a byte limit can leave up to three bytes unused), and for every
  text inside them, since fields have limits of their own. At any other length the prior is the share of values that a
  transfer broke off, counted by those that are open or stop inside a sentence.
  A pile of values at one length is a limit only if what stands there looks cut, by the two other terms.
* *Structure.* Whether the JSON closes: string literals are taken out, then brackets counted. How often cut values are open is
  counted at the limit itself, so a field that is closed after it was cut speaks neither way there.
* *Ending.* What the text that stops would look like, cut or whole. A cut falls behind a closing mark as often as sentences
  end per character. An ending without a mark that recurs as most of what its first word begins with is a complete note,
  legend or formula, of a known share, and met by chance once in all characters for each that there is; it bears witness less
  the more of it stands at limits. One that doesn't recur is whole
  with the chance of a note that no other text has, by Turing's estimate from notes that are found just twice.

All weights are counts over all rows. Histograms and sentence counts are aggregations; only (source, length) histograms, with
a row for each length that occurs, are fitted on grouped tasks.

Nulls and odd rows: a null or blank value, ``{}`` and other complete JSON without text are not cases; a null source is a source
of its own; repeated rows are judged alike; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

MIN_EXCESS, EM_STEPS = 12, 40
COMPLETE_SHARE, COMPLETE_TIMES = 0.02, 2
#: Strings of up to so many words are judged by their own recurrence: labels, and texts of one short sentence.
SHORT = 6

_FENCE = re.compile(r"^\s*```\w*|```\s*$")
_STRING = re.compile(r'"[^"]*"')
_TEXT = re.compile(r'"(?:visualDescription|teachingExplanation)"\s*:\s*"([^"]*)"')
_LITERAL = re.compile(r'"([^"]*)"(\s*:)?')
_ENDED = re.compile(r"""[.!?。:;][)\]"'”’»“]*$""")
_BREAK = re.compile(r"""[.!?;][)\]"'”’»]?\s+""")
_EDGE = " \t\r\n-–•*…"


def plain_json(value: str) -> str:
    """Without code fences and outer blanks, and with escaped quotes and backslashes replaced, so that a quote is a string's edge."""
    return _FENCE.sub("", value).strip().replace("\\\\", "/").replace('\\"', "’")


def json_closes(plain: str) -> bool:
    """Whether the JSON text comes to its own end, however badly formed it is on the way."""
    left = _STRING.sub("", plain)
    return '"' not in left and sum(map(left.count, "{[")) <= sum(map(left.count, "}]"))


def skeleton(sentence: str) -> str:
    return re.sub(r"\d+", "0", sentence.strip(_EDGE).lower())


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


def sentence_evidence(text: str, own: int) -> tuple[list[tuple[str, int]], tuple[str, str, int] | None]:
    """First word and place of each sentence, and first word, skeleton and place of the last if it has no closing mark. The place is
    a hash of the text up to there, so copies have it in common; a text of one short sentence has ``own``."""
    text = re.sub(r"\\[nrt]", " ", re.sub(r"\\u20[0-9a-f]{2}", "’", text)).rstrip()
    text = text.removesuffix("...").rstrip(_EDGE)
    parts, places, so_far = [w for u in _BREAK.split(text) if (w := skeleton(u))], [], 0
    for w in parts:
        so_far = _hash(f"{so_far} {w}")
        places.append(so_far)
    if len(parts) == 1:
        places = [own if len(parts[0].split()) <= SHORT else _hash(text)]
    firsts = [(u.split()[0], h) for u, h in zip(parts, places)]
    return firsts, None if not parts or _ENDED.search(text) else (firsts[-1][0], parts[-1], places[-1])


def other_strings(plain: str) -> tuple[list[str], list[str]]:
    """The string values besides the two descriptions: longer texts as they are, and skeletons of labels."""
    found = [x for x, key in _LITERAL.findall(_TEXT.sub("", plain)) if x and not key]
    texts = [x for x in found if len(x.split()) > SHORT]
    labels = {skeleton(re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1), 16)), x)) for x in found if len(x.split()) <= SHORT}
    return texts, sorted(x for x in labels - {""} if x.isprintable())


def scan(df: DataFrame, id_col: str, source: str, value: str) -> DataFrame:
    """(id, source, chars, bytes, closed, firsts, texts, labels, copy) of every value that isn't blank: all later steps read this.
    ``texts`` has each text's length and, if it has no closing mark, the first word, skeleton and place of its last sentence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, s, v in zip(pdf["id"], pdf["source"], pdf["value"]):
                plain = plain_json(v)
                closed = json_closes(plain)
                more, labels = other_strings(plain) if closed else ([], [])
                texts = [t for t in _TEXT.findall(plain) + more if t.strip()] if closed else []
                seen = [sentence_evidence(t, i) for t in texts]
                firsts = [{"first": w, "place": h} for f, _ in seen for w, h in f]
                ends = [{"len": len(t), "same": _hash(t), "sentences": len(f), "first": e and e[0], "skeleton": e and e[1], "place": e and e[2]} for t, (f, e) in zip(texts, seen)]
                rows.append((i, s, len(v), len(v.encode()), closed, firsts, ends, labels, _hash(plain)))
            yield pd.DataFrame(rows, columns=["id", "source", "chars", "bytes", "closed", "firsts", "texts", "labels", "copy"])

    ok = df.where(F.trim(F.col(value)) != "").select(F.col(id_col).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(value).alias("value"))
    text = "struct<len int, same bigint, sentences int, first string, skeleton string, place bigint>"
    return ok.mapInPandas(run, f"id bigint, source string, chars int, bytes int, closed boolean, firsts array<struct<first string, place bigint>>, texts array<{text}>, labels array<string>, copy bigint")


def length_histogram(scanned: DataFrame, noted: DataFrame) -> DataFrame:
    """(source, unit, len, n) of all different values, in characters and in bytes, and of the different texts in them. One that is
    stored often would pile up at its length without any limit; so would values and texts with an ending that recurs (``noted``: id,
    nth), which are left out."""
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("len")) for u in ("chars", "bytes")]))
    values = scanned.join(noted.select("id").distinct(), "id", "left_anti").select("source", "chars", "bytes", "copy").distinct()
    texts = _texts(scanned).join(noted, ["id", "nth"], "left_anti").select("source", "len", "same").distinct()
    rows = values.select("source", units.alias("u")).select("source", "u.unit", "u.len").unionByName(texts.select("source", F.lit("text").alias("unit"), "len"))
    return rows.groupBy("source", "unit", "len").agg(F.count("*").alias("n"))


def _normal_tail(z: np.ndarray) -> np.ndarray:
    t = 1 / (1 + 0.3275911 * np.abs(z) / np.sqrt(2))
    erf = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-z * z / 2)
    return 0.5 * (1 - np.sign(z) * erf)


def fit_censored(lengths: np.ndarray, n: np.ndarray, unit: str) -> pd.DataFrame:
    """(len, limit, posterior) at the candidate limits of one source's histogram (lengths in order), and its parameters."""
    y, slack = np.log(np.maximum(lengths, 1)), 3 if unit == "bytes" else 0
    # the median of the 31 lengths around, those that don't occur among them
    some = [n[a:b] for a, b in zip(np.searchsorted(lengths, lengths - 15), np.searchsorted(lengths, lengths + 15, "right"))]
    around = np.array([np.sort(x)[::-1][15] if len(x) > 15 else 0.0 for x in some])
    # excess over the neighbourhood picks candidates, the fitted density then sets their posterior
    peaks = lengths[(n >= MIN_EXCESS) & (n > 4 * (around + 1)) & (lengths > 8)]
    near = np.searchsorted(peaks, lengths)
    group = np.where(near < len(peaks), np.append(peaks, 0)[near], 0)
    group = np.where(group - slack <= lengths, group, 0)
    w = np.where(group > 0, 1.0, 0.0)
    mu, sd = np.average(y, weights=n), 1.0
    for _ in range(EM_STEPS):
        z = (y - mu) / sd
        tail = np.maximum(_normal_tail(z), 1e-9)
        ratio = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) / tail  # of a value beyond the limit: its expected place and square
        ey = np.where(w > 0, w * (mu + sd * ratio) + (1 - w) * y, y)
        mu = np.average(ey, weights=n)
        e2 = w * (sd**2 * (1 + z * ratio - ratio**2) + (mu + 0 * y - (mu + sd * ratio)) ** 2) + (1 - w) * (y - mu) ** 2
        sd = max(0.05, float(np.sqrt(np.average(e2, weights=n))))
        density = n.sum() * np.exp(-(((y - mu) / sd) ** 2) / 2) / (sd * np.sqrt(2 * np.pi) * np.maximum(lengths, 1))
        w = np.where(group > 0, np.clip(1 - density / np.maximum(n, 1e-9), 0, 1), 0.0)
    return pd.DataFrame({"len": lengths, "limit": group, "posterior": w, "mu": mu, "sd": sd})


def censoring(hist: DataFrame) -> DataFrame:
    """(source, unit, len, limit, posterior, mu, sd): one row per candidate length of each source."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("len")
        out = fit_censored(pdf["len"].to_numpy(), pdf["n"].to_numpy(dtype=float), key[1])
        return out[out["limit"] > 0].assign(source=key[0], unit=key[1])[["source", "unit", "len", "limit", "posterior", "mu", "sd"]]

    return hist.groupBy("source", "unit").applyInPandas(run, "source string, unit string, len int, limit int, posterior double, mu double, sd double")


def _texts(scanned: DataFrame) -> DataFrame:
    rows = scanned.select("id", "source", "chars", "bytes", F.posexplode("texts").alias("nth", "t"))
    return rows.select("id", "source", "chars", "bytes", "nth", "t.*")


def _ends(texts: DataFrame) -> DataFrame:
    """Of texts, those that end without a closing mark."""
    return texts.where("skeleton IS NOT NULL")


def notes(scanned: DataFrame, ends: DataFrame, weight=None) -> DataFrame:
    """(first, skeleton, n): endings without a closing mark that are complete, since they recur as most of what their first word
    begins with. Sentences count once for each text that leads up to them, so copies don't bear each other out. ``weight`` is how
    much a text bears witness (1 unless stated)."""
    firsts = scanned.select(F.explode("firsts").alias("f")).select("f.first", "f.place").distinct().groupBy("first").agg(F.count("*").alias("all"))
    once = ends.groupBy("first", "skeleton", "place").agg(F.max(F.lit(1.0) if weight is None else weight).alias("n"))
    often = once.groupBy("first", "skeleton").agg(F.sum("n").alias("n")).where((F.col("n") >= COMPLETE_TIMES) & F.col("skeleton").contains(" "))
    return often.join(firsts, "first").where(F.col("n") >= F.lit(COMPLETE_SHARE) * F.col("all")).select("first", "skeleton", "n")


def cut_labels(scanned: DataFrame) -> DataFrame:
    """(id): values with a label that stops inside the word with which a recurring label goes on, and is rare beside it."""
    each = scanned.select("id", "copy", F.explode("labels").alias("label"))
    n = each.select("copy", "label").distinct().groupBy("label").agg(F.count("*").alias("n"))
    longer = n.where(F.col("n") >= COMPLETE_TIMES).select("label", "n", F.explode(F.expr("sequence(0, length(label) - 1)")).alias("k"))
    longer = longer.where(F.expr(r"k > 0 AND substring(label, k, 2) RLIKE '^\\p{L}\\p{L}$'")).select(F.expr("substring(label, 1, k)").alias("label"), F.col("n").alias("m"))
    beyond = longer.groupBy("label").agg(F.sum("m").alias("m"))
    cut = n.join(beyond, "label").where((F.col("n") < COMPLETE_TIMES) | (F.col("n") < F.lit(COMPLETE_SHARE) * (F.col("n") + F.col("m"))))
    return each.join(cut.select("label"), "label", "left_semi").select("id").distinct()


def field_limits(scanned: DataFrame) -> DataFrame:
    """Candidate limits of values and texts by source, each length with its censoring posterior."""
    ends = _ends(_texts(scanned))
    noted = ends.join(notes(scanned, ends), ["first", "skeleton"], "left_semi").select("id", "nth")
    return censoring(length_histogram(scanned, noted))


def _placed(rows: DataFrame, limits: DataFrame, units: dict[str, str]) -> DataFrame:
    """Rows with the greatest posterior that the lengths in the columns of ``units`` have, and its limit ("unit length")."""
    for column, unit in units.items():
        at = limits.where(F.col("unit") == unit).select("source", F.col("len").alias(column), F.struct("posterior", F.concat_ws(" ", "unit", "limit").alias("limit")).alias(f"_{unit}"))
        rows = rows.join(at, ["source", column], "left")
    best = F.greatest(*[F.col(f"_{u}") for u in units.values()]) if len(units) > 1 else F.col(f"_{next(iter(units.values()))}")
    return rows.withColumn("_best", best).drop(*[f"_{u}" for u in units.values()]).select("*", F.coalesce("_best.posterior", F.lit(0.0)).alias("posterior"), F.col("_best.limit").alias("limit")).drop("_best")


def _logit(p):
    return F.log(p / (1 - p))


def _weighed(df: DataFrame, id_col: str, source: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scores, the candidate limits (source, unit, len, limit, posterior, mu, sd), and those that are limits (source, "unit limit")."""
    rows = stored(scan(df, id_col, source, value), "values")
    limits = stored(field_limits(rows), "limits")
    values = _placed(rows.select("id", "source", "chars", "bytes", "closed"), limits, {"chars": "chars", "bytes": "bytes"})
    texts = _placed(_texts(rows), limits, {"len": "text"}).withColumnsRenamed({"posterior": "text_posterior", "limit": "text_limit"})
    texts = texts.join(values.select("id", F.col("posterior").alias("value_posterior")).groupBy("id").agg(F.max("value_posterior").alias("value_posterior")), "id", "left")
    ends = _ends(texts)
    known = stored(notes(rows, ends, 1 - F.greatest("text_posterior", F.coalesce("value_posterior", F.lit(0.0)))), "notes")
    texts = texts.join(known.select("first", "skeleton", F.lit(True).alias("note")), ["first", "skeleton"], "left")
    texts = texts.withColumn("ending", F.when(F.col("skeleton").isNull(), "ended").when(F.col("note"), "note").otherwise("cut"))
    texts = stored(texts.select("id", "nth", "len", "sentences", "ending", "text_posterior", "text_limit"), "texts")
    labels = cut_labels(rows).withColumn("label_cut", F.lit(True))

    # every weight is a count over all rows
    n = texts.agg(F.count("*").alias("n"), F.sum("sentences").alias("sentences"), F.sum("len").alias("chars"), *[F.count_if(F.col("ending") == k).alias(k) for k in ("ended", "note")]).first()
    twice = known.where(F.round("n") == 2).count()
    total = max(n.n, 1)
    behind = min(0.5, ((n.sentences or 0) + 1) / ((n.chars or 0) + 2))  # a cut anywhere falls behind a sentence
    whole = {"ended": (n.ended + 1) / (total + 3), "note": (n.note + 1) / (total + 3), "cut": (2 * twice + 0.5) / (total + 1)}
    cut = {"ended": behind, "note": (n.note + 1) / ((n.chars or 0) + 2), "cut": 1 - behind}
    odds = F.create_map(*[F.lit(x) for k in whole for x in (k, float(np.log(cut[k] / whole[k])))])

    values = values.join(texts.groupBy("id").agg(F.max_by("ending", "nth").alias("last")), "id", "left").join(labels, "id", "left")
    ending = F.when(~F.col("closed"), "open").when(F.col("label_cut"), "cut").otherwise(F.coalesce("last", F.lit("none")))
    of_ending = F.when(F.col("ending") == "open", 0.0).when(F.col("ending") == "none", F.lit(float(np.log(behind)))).otherwise(odds[F.col("ending")])
    values = stored(values.withColumn("ending", ending).withColumn("of_ending", of_ending).drop("last", "label_cut"), "evidence")
    v = values.agg(F.count("*").alias("n"), F.count_if(F.col("ending").isin("open", "cut") & (F.col("posterior") < 0.5)).alias("off")).first()
    base, whole_open = (v.off + 0.5) / (v.n + 1), 0.5 / (v.n + 1)

    # a pile of values at one length is a limit if what stands there looks cut
    seen = F.when(F.col("closed"), F.col("of_ending")).otherwise(F.lit(float(-np.log(whole_open))))
    piles = values.where("limit IS NOT NULL").select("source", "limit", "posterior", "ending", seen.alias("seen"), (~F.col("closed")).alias("open"))
    named = texts.join(values.select("id", "source").distinct(), "id").where("text_limit IS NOT NULL")
    piles = piles.unionByName(named.select("source", F.col("text_limit").alias("limit"), F.col("text_posterior").alias("posterior"), "ending", odds[F.col("ending")].alias("seen"), F.lit(False).alias("open")))
    speaks = F.sum(F.log(F.col("posterior") * F.exp("seen") + 1 - F.least("posterior", F.lit(1 - 1e-6))))
    # structure: how often what was cut there is open
    share = (F.least(F.count_if("open"), F.sum("posterior")) + 0.5) / (F.sum("posterior") + 1)
    # a note that recurs was left out of the histograms: where it stands at a limit, it is one of the notes there or of what was cut there
    other = F.when(F.col("ending") != "note", F.col("posterior")).otherwise(0.0)
    as_note = F.log((F.sum(other) + 0.5) / (F.sum(1 - other) + 0.5))
    real = stored(piles.groupBy("source", "limit").agg(speaks.alias("speaks"), share.alias("open_share"), as_note.alias("as_note")).where("speaks > 0"), "real-limits")

    def prior(p):
        """A length off the limits has the share of values that were broken off; at one, no chance is taken for certain."""
        odds = _logit(F.greatest(F.lit(base), F.least(p, F.lit(1 - 1e-6))))
        return F.when((F.col("ending") == "note") & F.col("as_note").isNotNull(), F.least("as_note", odds)).otherwise(odds)

    values = values.join(real.select("source", "limit", "open_share", "as_note"), ["source", "limit"], "left")
    at = F.when(F.col("open_share").isNotNull(), F.col("posterior")).otherwise(0.0)
    open_share = F.coalesce("open_share", F.lit(0.5))
    structure = F.when(F.col("closed"), F.log(1 - open_share) - float(np.log(1 - whole_open))).otherwise(F.log(open_share) - float(np.log(whole_open)))
    by_value = values.select("id", "source", "closed", "ending", at.alias("posterior"), F.when(F.col("open_share").isNotNull(), F.col("limit")).alias("limit"), (prior(at) + structure + F.col("of_ending")).alias("score"))

    at = F.when(F.col("open_share").isNotNull(), F.col("text_posterior")).otherwise(0.0)
    by_text = named.join(real.select("source", F.col("limit").alias("text_limit"), "open_share", "as_note"), ["source", "text_limit"])
    by_text = by_text.unionByName(texts.where("ending = 'cut'").join(values.select("id", "source").distinct(), "id"), allowMissingColumns=True)
    by_text = by_text.select("id", F.struct((prior(at) + odds[F.col("ending")]).alias("score"), "ending", at.alias("posterior"), F.when(F.col("open_share").isNotNull(), F.col("text_limit")).alias("limit")).alias("t"))
    out = by_value.join(by_text.groupBy("id").agg(F.max("t").alias("t")), "id", "left")
    more = F.coalesce(F.col("t.score") > F.col("score"), F.lit(False))
    best = [F.when(more, F.col(f"t.{c}")).otherwise(F.col(c)).alias(c) for c in ("ending", "posterior", "limit", "score")]
    return out.select("id", "source", "closed", *best), limits, real.select("source", F.col("limit").alias("named"))


def scores(df: DataFrame, id_col: str = "desc_id", source: str = "model_id", value: str = "description_json") -> DataFrame:
    """(id, source, closed, ending, posterior, limit, score): every value that isn't blank with the evidence that speaks most for a cut.
    ``ending`` is 'open', 'ended' (behind a closing mark), 'note', 'cut' or 'none' (no text)."""
    return _weighed(df, id_col, source, value)[0]


def real_limits(df: DataFrame, id_col: str = "desc_id", source: str = "model_id", value: str = "description_json") -> DataFrame:
    """(source, unit, len, limit, posterior, mu, sd): the lengths at which values or texts of a source were cut, as what stands there shows."""
    _, limits, real = _weighed(df, id_col, source, value)
    return limits.withColumn("named", F.concat_ws(" ", "unit", "limit")).join(real, ["source", "named"], "left_semi").drop("named")


def truncated(df: DataFrame, **columns) -> DataFrame:
    """(id): values more likely cut than not."""
    return scores(df, **columns).where(F.col("score") > 0).select("id").distinct()


def shares(df: DataFrame, id_col: str = "desc_id", source: str = "model_id", value: str = "description_json") -> DataFrame:
    """(source, n, cut, share): how often each source truncates, over all its rows."""
    bad = truncated(df, id_col=id_col, source=source, value=value).withColumn("_bad", F.lit(1))
    rows = df.select(F.col(id_col).alias("id"), F.col(source).alias(source)).join(bad, "id", "left")
    return rows.groupBy(source).agg(F.count("*").alias("n"), F.count("_bad").alias("cut"), (F.count("_bad") / F.count("*")).alias("share"))

"""Problem 8: the subject areas that each document treats.

A latent Dirichlet topic model is fitted by variational EM over all documents. Its unit is the sentence: a document has
proportions of topics, a sentence one topic, and the topic gives its words. So a document's expected proportions are shares of
its sentences, and a document treats the subjects whose topics make up at least a quarter. There is a topic for
each subject and language and two more per language, for all that belongs to no subject; a sentence is in the language whose topics
together give its words best, and has one of that language's topics. Words are hashed to ``2**BITS`` numbers, so every word
counts and the model has one size whatever the corpus.

Every iteration is a Spark job in which tasks infer the proportions of their documents and send the expected counts of each
topic's words, which are added up in two levels. It ends when the likelihood of a word rises by less than ``TOLERANCE``. The first assignment takes
documents with labels (at most ``LABELS`` rows are used for it) to their labels' topics and all others to their language's
rest; from then on labels play no part, so wrong and missing ones wash out. Afterwards every topic is mapped to a subject by
its top terms: the subject that labels tie most of these terms to, or none where unlabelled text claims more of them or
another subject comes near.

Nulls and odd rows: null, empty and wordless texts treat nothing; labels are compared in lower case, null, unknown and
documentless ones are ignored; a null or odd ``lang`` only counts in the first assignment; copies are judged alike; a doc_id
that occurs twice is judged by its rows' sentences together; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .words import WORD

BITS, LABELS, RESTS = 17, 50_000, ("", "~")
TOLERANCE, INNER, ALPHA, PRIOR, ETA, DOCS_AT_ONCE = 0.01, 3, 0.05, 300.0, 1e-4, 100
TOP_TERMS, CLEAR, SHARE, LEAST_WORDS = 40, 1.5, 0.25, 3
_END = re.compile(r"[.!?…][)\]\"”’»]*\s+")
_PAGE = re.compile(r"\s*(?:\[page [^\]]*\]|#+ .*|-{3,}|\|.*)\s*")


def sentences(text: str | None) -> Iterator[str]:
    """The sentences in small letters; one ends with its line at the latest. Page marks, headings and table rows are none."""
    for line in (text or "").lower().split("\n"):
        if line and not (line.lstrip()[:1] in "[#-|" and _PAGE.fullmatch(line)):
            yield from _END.split(line)


class Forms(dict):
    """A form between blanks -> the words in it, or what ``of`` makes of them. Remembered up to ``most`` forms."""

    def __init__(self, of=tuple, most: int = 300_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, form: str):
        if len(self) >= self.most:
            self.clear()
        value = self[form] = self.of(WORD.findall(form))
        return value


def language(lang):
    """Two small letters, or null for what names no language."""
    code = F.lower(F.substring(F.trim(lang), 1, 2))
    return F.when(code.rlike("^[a-z]{2}$") & (F.lower(F.trim(lang)) != "und"), code)


def number(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) & ((1 << BITS) - 1)


def bags(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, units, sizes): each document as the numbers of its words, sentence by sentence, in bytes, with the sentences' sizes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = Forms(lambda found: [number(w) for w in found]).__getitem__
        for pdf in batches:
            rows = []
            for i, lang, t in zip(pdf["doc_id"], pdf["lang"], pdf["text"]):
                split = [u for x in sentences(t) if len(u := list(chain.from_iterable(map(get, x.split())))) >= LEAST_WORDS]  # fewer are no sentence
                sizes = np.fromiter(map(len, split), np.int32, len(split))
                rows.append((i, lang, np.fromiter(chain.from_iterable(split), np.int32, int(sizes.sum())).tobytes(), sizes.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "units", "sizes"])

    ok = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", language(F.col("lang")).alias("lang"), "text")
    return ok.mapInPandas(run, "doc_id bigint, lang string, units binary, sizes binary").where(F.length("sizes") > 0)


@dataclass
class Topics:
    """``names`` of (subject or rest, language) as first assigned, in blocks of one language, ``chance`` of each number in each topic, which of them are ``used`` by words, and
    the subject that each topic's top terms speak for."""

    names: list[tuple[str, str]]
    chance: np.ndarray
    used: np.ndarray
    subjects: list[str]
    meaning: list[str | None]


def _digamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    out = np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4)
    for k in range(6):
        out -= 1 / (x + k)
    return out


class Model:
    """Logarithms of the topics' chances, laid out by language. All numbers without a word have the same chances, and one row."""

    def __init__(self, chance: np.ndarray, languages: int, used: np.ndarray):
        self.k = len(chance)
        self.width = self.k // languages
        rows = np.r_[np.flatnonzero(~used)[:1], np.flatnonzero(used)]
        self.row = np.zeros(len(used), np.int32)
        self.row[rows] = np.arange(len(rows))
        some = chance[:, rows]
        log = np.log(some).astype(np.float32)
        self.blocks = [np.ascontiguousarray(log[g * self.width : (g + 1) * self.width].T) for g in range(languages)]
        self.languages = np.ascontiguousarray(np.log(some.reshape(languages, self.width, -1).mean(axis=1)).T.astype(np.float32))

    def expected(self, units: np.ndarray, sizes: np.ndarray, docs: np.ndarray, acc: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """The expected number of each document's sentences in each topic, and the log-likelihood of all words. Adds the expected uses of
        each word by topic to ``acc``. ``docs`` has each sentence's document, from 0 on."""
        starts, row = np.cumsum(sizes) - sizes, self.row[units]
        lang = np.add.reduceat(self.languages[row], starts, axis=0).argmax(axis=1)
        n = int(docs[-1]) + 1
        like = np.empty((len(sizes), self.width), np.float32)
        own = np.repeat(lang, sizes)
        for g in np.unique(lang):
            some = lang == g
            size = sizes[some]
            like[some] = np.add.reduceat(self.blocks[g][row[own == g]], np.cumsum(size) - size, axis=0)
        at = lang[:, None] * self.width + np.arange(self.width)
        prior = np.zeros((n, self.k), np.float32)
        for _ in range(INNER + 1):
            score = like + prior[docs[:, None], at]
            top = score.max(axis=1, keepdims=True)
            share = np.exp(score - top)
            total = share.sum(axis=1, keepdims=True)
            share /= total
            count = np.bincount((docs[:, None] * self.k + at).ravel(), weights=share.ravel(), minlength=n * self.k).reshape(n, self.k)
            gamma = count + ALPHA
            prior = (_digamma(gamma) - _digamma(gamma.sum(axis=1, keepdims=True))).astype(np.float32)
        if acc is not None:
            sentence = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(own.astype(np.int64) << 32 | units, kind="stable")
            code = (own.astype(np.int64) << 32 | units)[order]
            firsts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            uses = np.add.reduceat(share[sentence[order]], firsts, axis=0)
            for g in np.unique(lang):
                mine = code[firsts] >> 32 == g
                acc[(code[firsts][mine] & 0xFFFFFFFF)[:, None], g * self.width + np.arange(self.width)] += uses[mine]
        return count, float((top + np.log(total)).sum())


def _batches(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, units, sizes, docs) of a few documents at a time."""
    for at in range(0, len(pdf), DOCS_AT_ONCE):
        part = pdf.iloc[at : at + DOCS_AT_ONCE]
        sizes = [np.frombuffer(x, np.int32) for x in part["sizes"]]
        n = np.array([len(x) for x in sizes])
        yield part, np.concatenate([np.frombuffer(x, np.int32) for x in part["units"]]), np.concatenate(sizes), np.repeat(np.arange(len(n)), n)


SUMS = "topic int, terms binary, counts binary, worth double, words bigint"


def _emitted(total: np.ndarray, worth: float = 0.0, words: int = 0) -> Iterator[pd.DataFrame]:
    """A topic's words with a count, for each topic, and one row with the likelihood."""
    for t, row in enumerate(total):
        terms = np.flatnonzero(row).astype(np.int32)
        if len(terms):
            yield pd.DataFrame({"topic": [t], "terms": [terms.tobytes()], "counts": [row[terms].astype(np.float32).tobytes()], "worth": [0.0], "words": [0]})
    yield pd.DataFrame({"topic": [-1], "terms": [b""], "counts": [b""], "worth": [worth], "words": [words]})


def _summed(rows: DataFrame, k: int) -> tuple[np.ndarray, float]:
    """The topics' counts of all tasks, added up in two levels, and the mean log-likelihood of a word."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        worth, words = 0.0, 0
        for pdf in batches:
            for t, terms, counts, x, n in zip(pdf["topic"], pdf["terms"], pdf["counts"], pdf["worth"], pdf["words"]):
                worth, words = worth + x, words + n
                if t >= 0:
                    sums.setdefault(t, np.zeros(1 << BITS))[np.frombuffer(terms, np.int32)] += np.frombuffer(counts, np.float32)
        for t, row in sums.items():
            yield next(_emitted(row[None])).assign(topic=t)
        if words or worth:
            yield from _emitted(np.zeros((0, 1)), worth, words)

    some = rows.withColumn("some", F.spark_partition_id() % 16)
    once = some.repartition(16, "topic", "some").select("topic", "terms", "counts", "worth", "words").mapInPandas(add, SUMS)
    out, worth, words = np.zeros((k, 1 << BITS)), 0.0, 0
    for r in once.repartition(8, "topic").mapInPandas(add, SUMS).toLocalIterator():  # k * 2**BITS numbers at most
        if r.topic >= 0:
            out[r.topic, np.frombuffer(r.terms, np.int32)] = np.frombuffer(r.counts, np.float32)
        worth, words = worth + r.worth, words + r.words
    return out, worth / max(words, 1)


def fit(docs: DataFrame, labels: DataFrame, subjects: list[str]) -> tuple[Topics, DataFrame]:
    """The fitted topics of all documents (doc_id, text, lang), and the documents as bags of numbers."""
    held = stored(bags(docs), "bags")
    spark = docs.sparkSession
    clean = labels.where(F.col("doc_id").isNotNull()).select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(subjects)).distinct()
    marks = clean.groupBy("doc_id").agg(F.collect_set("subject").alias("marks")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELS)
    known = {r.doc_id: r.marks for r in marks.toLocalIterator()}
    langs = [r.lang for r in held.where("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").toLocalIterator()] or ["xx"]  # at most 676
    names = [(s, g) for g in langs for s in [*subjects, *RESTS]]
    first = spark.sparkContext.broadcast((known, {x: i for i, x in enumerate(names)}))

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, at = first.value
        total = np.zeros((len(at), 1 << BITS), np.float32)
        for pdf in batches:
            for i, lang, units in zip(pdf["doc_id"], pdf["lang"], pdf["units"]):
                own = [at[m, lang] for m in marks.get(i, [""]) if (m, lang) in at]
                terms, counts = np.unique(np.frombuffer(units, np.int32), return_counts=True)
                for t in own:
                    total[t, terms] += counts / np.float32(len(own))
        yield from _emitted(total)

    total, _ = _summed(held.select("doc_id", "lang", "units").mapInPandas(assigned, SUMS), len(names))
    affinity = total.copy()
    # a language's second rest topic starts flat, with more than its share of rare words, and takes what fits no other
    rng = np.random.default_rng(8)
    for g in range(len(langs)):
        block = slice(g * (len(subjects) + 2), (g + 1) * (len(subjects) + 2))
        total[block.stop - 1] = np.sqrt(total[block].sum(axis=0)) * rng.uniform(0.5, 1.5, total.shape[1])

    # a topic's prior is PRIOR words of its language, so a word that it lacks speaks neither for nor against a small topic
    width = len(subjects) + len(RESTS)
    of_language = affinity.reshape(len(langs), width, -1).sum(axis=1) + ETA
    of_language = np.repeat(PRIOR * of_language / of_language.sum(axis=1, keepdims=True), width, axis=0)

    def chances(total: np.ndarray) -> np.ndarray:
        return (total + of_language) / (total + of_language).sum(axis=1, keepdims=True)

    worth = -np.inf
    while True:  # the likelihood never falls, so this ends
        model = spark.sparkContext.broadcast(Model(chances(total), len(langs), total.any(axis=0)))

        def step(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            acc = np.zeros((1 << BITS, model.value.k), np.float32)
            worth, words = 0.0, 0
            for pdf in batches:
                for _, units, sizes, of in _batches(pdf):
                    worth, words = worth + model.value.expected(units, sizes, of, acc)[1], words + len(units)
            yield from _emitted(np.ascontiguousarray(acc.T), worth, words)

        total, now = _summed(held.select("units", "sizes").mapInPandas(step, SUMS), len(names))
        model.destroy()
        if now - worth < TOLERANCE:
            break
        worth = now
    chance = chances(total)
    return Topics(names, chance, total.any(axis=0), subjects, topic_meanings(chance, chances(affinity), names, subjects)), held


def distinctive(chance: np.ndarray) -> np.ndarray:
    """How far each topic's chance of a word outweighs the mean of all topics: ranks its top terms."""
    return chance * np.log(np.maximum(chance, 1e-30) / np.maximum(chance.mean(axis=0, keepdims=True), 1e-30))


def topic_meanings(chance: np.ndarray, labelled: np.ndarray, names: list[tuple[str, str]], subjects: list[str]) -> list[str | None]:
    """Each topic's subject by its top terms. A term speaks for a subject in proportion to its rate in the documents ``labelled`` so,
    of whatever language, and counts by how distinctive of the topic it is."""
    firsts = [s for s, _ in names]
    share = np.stack([labelled[[i for i, x in enumerate(firsts) if x == s]].sum(axis=0) for s in [*subjects, ""]])
    share /= share.sum(axis=0, keepdims=True)
    out: list[str | None] = []
    for first, row in zip(firsts, distinctive(chance)):
        top = np.argsort(-row, kind="stable")[:TOP_TERMS]
        say = share[:, top] @ row[top]
        best = int(np.argmax(say[:-1]))
        second = max(np.delete(say[:-1], best), default=0.0)
        # the terms have to confirm the subject that a topic began with, or to speak clearly for another
        sure = say[best] > say[-1] and say[best] >= (1.0 if subjects[best] == first else CLEAR) * second
        out.append(subjects[best] if sure else None)
    return out


def subject_shares(held: DataFrame, topics: Topics) -> DataFrame:
    """(doc_id, subject, sentences, of, share): the proportions of each document's topics, added up by subject and taken to whole sentences."""
    languages = len(topics.names) // (len(topics.subjects) + len(RESTS))
    says = np.array([[m == s for s in topics.subjects] for m in topics.meaning], float).reshape(len(topics.names), len(topics.subjects))
    model = held.sparkSession.sparkContext.broadcast((Model(topics.chance, languages, topics.used), says))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted, says = model.value
        for pdf in batches:
            for part, units, sizes, of in _batches(pdf):
                treated = fitted.expected(units, sizes, of)[0] @ says
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "of": np.bincount(of, minlength=len(part)), **{f"s{k}": x for k, x in enumerate(treated.T)}})

    count = range(len(topics.subjects))
    rows = held.select("doc_id", "units", "sizes").mapInPandas(run, ", ".join(["doc_id bigint, of bigint", *[f"s{k} double" for k in count]]))
    rows = rows.groupBy("doc_id").agg(F.sum("of").alias("of"), *[F.round(F.sum(f"s{k}")).cast("bigint").alias(f"s{k}") for k in count])
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("subject"), F.col(f"s{k}").alias("sentences")) for k, x in enumerate(topics.subjects)])).alias("x")
    return rows.select("doc_id", "of", each).where("x.sentences > 0").select("doc_id", "x.subject", "x.sentences", "of", (F.col("x.sentences") / F.col("of")).alias("share"))


def top_terms(docs: DataFrame, topics: Topics, most: int = 12) -> list[list[str]]:
    """The words of each topic's most distinctive numbers, for inspection: of the words with one number the most frequent."""
    tops = [(-row).argsort(kind="stable")[:most] for row in distinctive(topics.chance)]
    wanted = docs.sparkSession.sparkContext.broadcast(set(np.concatenate(tops).tolist()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        get = Forms(lambda found: [w for w in found if number(w) in wanted.value]).__getitem__
        for pdf in batches:
            for t in pdf["text"]:
                seen.update(chain.from_iterable(map(get, t.lower().split())))
            yield pd.DataFrame([(number(w), w, n) for w, n in seen.items()], columns=["number", "word", "n"])
            seen.clear()

    rows = docs.where("text IS NOT NULL").select("text").mapInPandas(run, "number int, word string, n bigint").groupBy("number", "word").agg(F.sum("n").alias("n"))
    name = {r.number: r.word for r in rows.groupBy("number").agg(F.max_by("word", F.struct("n", "word")).alias("word")).toLocalIterator()}
    return [[name.get(int(i), "") for i in top] for top in tops]


def subject_names(subjects: DataFrame) -> list[str]:
    """The fixed, small table of areas; each as written there."""
    return sorted({r.subject for r in subjects.where("subject IS NOT NULL").select("subject").toLocalIterator()})


def assigned(docs: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, subject): every area whose topics make up at least ``share`` of the document's proportions, in whole sentences."""
    names = subject_names(subjects)
    if not names:
        return docs.select("doc_id", F.lit("").alias("subject")).where("false")
    topics, held = fit(docs, labels, names)
    return subject_shares(held, topics).where(F.col("share") >= share).select("doc_id", "subject")

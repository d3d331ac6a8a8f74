"""Problem 7: evaluation passages that stand in the corpus.

A distributed positional inverted index of the corpus, which knows nothing of the test items: a shard holds the postings of some
hundred thousand words of text, in the order (term, place), where a term is one word and a place its number in the shard's
texts. It is written once and read by any search; new documents are new shards.

A search reads the shards' counts for the items' terms and adds them up. In every stretch of ``n`` words of an item the rarest
term is its anchor. In each shard the anchor's postings, shifted by its offset in the item, are the alignments; the postings
of the next terms to either side, shifted by theirs, are intersected with them one after the other until no alignment is
left that could still grow to ``n`` words. A document lies in one shard, so nothing is shuffled but the matches.

The test items are the stated query set. They are read in blocks of about ``BLOCK_WORDS`` words, so that what is broadcast has a
bound however many items there are; the corpus is never broadcast, sampled or cut.

Nulls and odd rows: null or blank texts and passages, and those of fewer than ``n`` words, match nothing; null ids are left
out. Copies of a document, and items with the same passage, are each reported. A doc_id or item_id that occurs twice is
reported once. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .words import WordHashes, hashed_words

N_WORDS, TERM, LEAST_TERMS, SLACK = 12, 5, 8, 16
SHARD_WORDS, BLOCK_WORDS, ALIGNED_AT_ONCE = 400_000, 1_000_000, 1_000_000
INDEX = "terms binary, counts binary, places binary, docs binary, starts binary"


# -- the index -----------------------------------------------------------------------------------------------------------


def _shard(ids: list[np.ndarray], flat: list[np.ndarray], sizes: list[np.ndarray]) -> pd.DataFrame:
    docs, terms, n = np.concatenate(ids), np.concatenate(flat), np.concatenate(sizes)
    starts = np.cumsum(n + 1) - n - 1  # a free place behind every text, so that no run crosses it
    places = np.arange(len(terms)) + np.repeat(np.arange(len(n)), n)
    order = np.argsort(terms, kind="stable")
    own, counts = np.unique(terms[order], return_counts=True)
    columns = (own, counts.astype(np.uint32), places[order].astype(np.uint32), docs, starts.astype(np.uint32))
    return pd.DataFrame({k: [v.tobytes()] for k, v in zip(("terms", "counts", "places", "docs", "starts"), columns)})


def token_index(docs: DataFrame) -> DataFrame:
    """The shards of the index of (doc_id, text). A text is never divided, so a very long one makes a shard of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, ids, flat, sizes, held = WordHashes(), [], [], [], 0
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                terms, n = hashed_words(part["text"], memo)
                ids.append(part["doc_id"].to_numpy(np.int64))
                flat.append(terms)
                sizes.append(n)
                held += len(terms)
                if held >= SHARD_WORDS:
                    yield _shard(ids, flat, sizes)
                    ids, flat, sizes, held = [], [], [], 0
        if held:
            yield _shard(ids, flat, sizes)

    ok = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return ok.mapInPandas(run, INDEX)


class Shard:
    """The postings of a shard for a block of items."""

    def __init__(self, row, items: Items):
        terms, counts = np.frombuffer(row.terms, np.uint64), np.frombuffer(row.counts, np.uint32).astype(np.int64)
        self.places = np.frombuffer(row.places, np.uint32)
        self.docs, self.starts = np.frombuffer(row.docs, np.int64), np.frombuffer(row.starts, np.uint32)
        self.counts, self.first = counts, np.cumsum(counts) - counts
        # postings are in the order (term, place), so one search finds whether a term stands at a place
        self.code = np.repeat(np.arange(len(terms), dtype=np.uint64) << np.uint64(32), counts) | self.places
        at = np.minimum(np.searchsorted(terms, items.wanted), len(terms) - 1)
        self.local = np.where(terms[at] == items.wanted, at, -1)  # the number here of each wanted term

    def stands(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each wanted term stands at the place."""
        number = self.local[term]
        key = number.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.code, key), len(self.code) - 1)
        return (number >= 0) & (place >= 0) & (self.code[at] == key)

    def alignments(self, items: Items, anchors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item word, place) of the anchors' postings, some at a time. Anchors are numbers of words in the block's items."""
        number = self.local[items.terms[anchors]]
        anchors, number = anchors[number >= 0], number[number >= 0]
        n = self.counts[number]
        total, at = np.cumsum(n), 0
        while at < len(anchors):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + ALIGNED_AT_ONCE, "right")))
            m = n[at:to]
            within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            yield np.repeat(anchors[at:to], m), self.places[np.repeat(self.first[number[at:to]], m) + within].astype(np.int64)
            at = to

    def runs(self, items: Items, word: np.ndarray, place: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """How many words before and behind each alignment's word match without a gap, ``most`` at most on each side."""
        out = []
        for step in (-1, 1):
            length, alive = np.zeros(len(word), np.int64), np.arange(len(word))
            for d in range(1, most + 1):
                other = word[alive] + step * d
                inside = (other >= items.begin[word[alive]]) & (other < items.end[word[alive]])
                alive, other = alive[inside], other[inside]
                alive = alive[self.stands(items.terms[other], place[alive] + step * d)]
                if not len(alive):
                    break
                length[alive] = d
            out.append(length)
        return out[0], out[1]

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1


@dataclass
class Items:
    """A block of items: their words one after the other as numbers in ``wanted`` (sorted hashes), with each word's item and the
    first and last place of that item."""

    ids: np.ndarray
    wanted: np.ndarray
    terms: np.ndarray
    item: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def blocks(items: DataFrame, n: int) -> Iterator[Items]:
    """The items in blocks of about BLOCK_WORDS words; those of fewer than ``n`` words are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for pdf in batches:
            flat, sizes = hashed_words(pdf["passage"], memo)
            cuts = np.cumsum(sizes)[:-1] if len(sizes) else []
            yield pd.DataFrame({"item_id": pdf["item_id"], "n": sizes, "terms": [x.tobytes() for x in np.split(flat, cuts)]})

    ok = items.where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).select("item_id", "passage")
    rows = stored(ok.mapInPandas(run, "item_id bigint, n bigint, terms binary").where(F.col("n") >= n).distinct(), "items")
    parts = max(1, -(-(rows.agg(F.sum("n").alias("n")).first().n or 0) // BLOCK_WORDS))
    for b in range(parts):
        some = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == b)
        got = [(r.item_id, np.frombuffer(r.terms, np.uint64)) for r in some.toLocalIterator()]
        if got:
            flat, sizes = np.concatenate([x for _, x in got]), np.array([len(x) for _, x in got])
            wanted, terms = np.unique(flat, return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            yield Items(np.array([i for i, _ in got]), wanted, terms, np.repeat(np.arange(len(got)), sizes), np.repeat(starts, sizes), np.repeat(starts + sizes, sizes))


def frequencies(index: DataFrame, items: Items) -> np.ndarray:
    """How often the corpus has each wanted term: the shards' counts, added up."""
    known = index.sparkSession.sparkContext.broadcast(items.wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(len(known.value), np.int64)
        for pdf in batches:
            for terms, counts in zip(pdf["terms"], pdf["counts"]):
                terms, counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.uint32)
                at = np.minimum(np.searchsorted(terms, known.value), len(terms) - 1)
                out += np.where(terms[at] == known.value, counts[at], 0)
        some = np.flatnonzero(out)
        yield pd.DataFrame({"term": some, "n": out[some]})

    out = np.zeros(len(items.wanted), np.int64)
    for r in index.select("terms", "counts").mapInPandas(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.term] = r.n
    return out


def anchors(items: Items, frequency: np.ndarray, width: int) -> np.ndarray:
    """The rarest word of every stretch of ``width`` words of an item, the first of equals. A stretch with a term that the corpus lacks
    can't stand in it and has none."""
    f = frequency[items.terms]
    if len(f) < width:
        return np.zeros(0, np.int64)
    ahead = np.lib.stride_tricks.sliding_window_view(f, width)
    at = np.arange(len(ahead))
    whole = (at + width <= items.end[at]) & (ahead.min(axis=1) > 0)
    return np.unique((at + ahead.argmin(axis=1))[whole])


def _searched(index: DataFrame, items: DataFrame, n: int, width: int, search, schema: str) -> DataFrame:
    """What ``search(shard, items, anchors)`` finds in all shards, for all blocks of items."""
    spark, found = index.sparkSession, None
    for block in blocks(items, n):
        known = spark.sparkContext.broadcast((block, anchors(block, frequencies(index, block), width)))

        def run(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            own, rare = known.value
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    yield search(Shard(row, own), own, rare)

        rows = index.mapInPandas(run, schema)
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], schema) if found is None else found


def exact_phrases(index: DataFrame, items: DataFrame, n: int = N_WORDS) -> DataFrame:
    """(doc_id, item_id): the documents of the index that contain at least ``n`` consecutive words of an item."""

    def search(shard: Shard, own: Items, rare: np.ndarray) -> pd.DataFrame:
        hits = [np.zeros((0, 2), np.int64)]
        for word, place in shard.alignments(own, rare):
            before, behind = shard.runs(own, word, place, n - 1)
            whole = before + behind + 1 >= n
            hits.append(np.stack([shard.docs[shard.doc(place[whole])], own.ids[own.item[word[whole]]]], axis=1))
        return pd.DataFrame(np.unique(np.concatenate(hits), axis=0), columns=["doc_id", "item_id"])

    return _searched(index, items, n, n, search, "doc_id bigint, item_id bigint").distinct()


def proximity(index: DataFrame, items: DataFrame, least: int = LEAST_TERMS, slack: int = SLACK, term: int = TERM, n: int = N_WORDS) -> DataFrame:
    """(doc_id, item_id, terms): loose matches. Runs of ``term`` words of one item that lie within ``slack`` words of where they would
    stand if the passage began at one place count together, also where words were changed, inserted or left out between them; ``least``
    different ones have to meet. An exact phrase of ``n`` words has n - term + 1, so all exact matches are among these."""
    assert least <= n - term + 1

    def search(shard: Shard, own: Items, rare: np.ndarray) -> pd.DataFrame:
        met = [np.zeros((0, 4), np.int64)]
        for word, place in shard.alignments(own, rare):
            before, behind = shard.runs(own, word, place, term - 1)
            some = before + behind + 1 >= term
            word, place, before, behind = word[some], place[some], before[some], behind[some]
            m = before + behind + 2 - term
            first = np.repeat(word - before, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            doc = np.repeat(shard.doc(place), m)
            off = first - own.begin[first]
            shift = np.repeat(place - shard.starts[shard.doc(place)].astype(np.int64) - (word - own.begin[word]), m)
            for cell in (shift // slack, shift // slack + 1):
                met.append(np.stack([doc, own.item[first], cell, off], axis=1))
        rows = np.unique(np.concatenate(met), axis=0)
        groups, terms = np.unique(rows[:, :3], axis=0, return_counts=True)
        out = pd.DataFrame({"doc_id": shard.docs[groups[:, 0]], "item_id": own.ids[groups[:, 1]], "terms": terms})
        return out[out["terms"] >= least].groupby(["doc_id", "item_id"], as_index=False)["terms"].max()

    rows = _searched(index, items, n, term, search, "doc_id bigint, item_id bigint, terms bigint")
    return rows.groupBy("doc_id", "item_id").agg(F.max("terms").alias("terms"))


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, eval_set, documents): how many documents contain each item; items that leaked nowhere have 0."""
    n = found.groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "eval_set").join(n, "item_id", "left").fillna(0, ["documents"])

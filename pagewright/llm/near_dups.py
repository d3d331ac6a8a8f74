"""Problem 1: records that share most of their content.

A similarity self-join on sets of distinct word n-grams (``n`` = 3, Jaccard >= 0.6), exact: it reports every pair.

1. *Scan.* One pass hashes each text's n-grams, adds them to a count sketch, and keeps a 128-bit fingerprint of the set. The
   sketches, of as many tasks at most as the cluster has cores times ``TASKS_A_CORE``, are added up in two levels and order
   n-grams rare-first; any fixed order is correct, and this one keeps lists short. It has a bucket for every
   ``NGRAMS_A_BUCKET`` n-grams, and one byte a bucket, 2**24 at most, so it can be broadcast.
2. *Copies.* Records with one fingerprint are the same set. Only the one with the least id takes part in the join, so that a
   text repeated in a third of all rows is one record; its copies are put back at the end, large groups of them in parts.
3. *Prefix index.* Sets that reach the threshold share one of their first ``size - ceil(t * size) + 1`` n-grams. Postings
   ``(n-gram, position, record)`` of the prefixes go to buckets by n-gram, packed in columnar blocks with each record's id,
   size and parity bitmap once a block. A list that the sketch says may be long, far above the mean of its buckets, is split in ``s`` parts, and every pair
   of parts is a bucket entry of its own, so that no task has to hold or pair a whole long list.
4. *Filters.* In a bucket, lists are sorted by size. The length filter bounds the range of partners, and so does the positional filter
   with what can still be shared behind the common n-gram: the smaller set of a pair has it in the first quarter of its n-grams, so of the
   long lists, which rare-first order puts at the ends of prefixes, few postings are partners. The suffix filter is the symmetric difference, for which the bitmaps'
   differing bits are a lower bound. Pairs are formed block by block in arrays of bounded length.
5. *Verification.* Each remaining pair once, on the two full sets.

Nulls and odd rows: a null text and one of fewer than ``min_words`` words are no records; null ids are left out; an id that
occurs twice pairs with itself nowhere. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .words import WordHashes, gram_hashes, hashed_words, mix

N, THRESHOLD, MIN_WORDS = 3, 0.6, 30
SKETCH_BITS, BITS_LEAST, BITS_MOST, SLICES, NGRAMS_A_BUCKET, TASKS_A_CORE = 22, 16, 24, 64, 8, 8
#: Copies of one text in a part of their group.
COPIES_AT_ONCE = 5000
#: Words of 64 bits in a parity bitmap: the least, and the most however large a set is.
BITMAP_LEAST, BITMAP_MOST = 4, 512
#: Postings that a bucket should have, postings of a list from which it is split, and pairs formed at once in a task.
BUCKET_POSTINGS, LONG_LIST, PAIRS_AT_ONCE = 1_500_000, 20_000, 2_000_000
TEXTS_AT_ONCE = 1000


def gram_sets(texts, memo: WordHashes, n: int = N, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets of n-gram hashes, each sorted, one after the other, and the sets' sizes (0: no record)."""
    flat, sizes = hashed_words(texts, memo)
    h, owner, _ = gram_hashes(flat, sizes, n)
    keep = sizes[owner] >= max(min_words, n)
    h, owner = h[keep], owner[keep]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    return h, np.bincount(owner, minlength=len(sizes)).astype(np.int64)


def _slices(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for at in range(0, len(pdf), TEXTS_AT_ONCE):
        yield pdf.iloc[at : at + TEXTS_AT_ONCE]


def _records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def sketch_bits(records: DataFrame) -> int:
    """Binary logarithm of the sketch's buckets, from the length of all texts (about six characters to a word)."""
    chars = records.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    return min(BITS_MOST, max(BITS_LEAST, round(math.log2(max(chars, 1) / 6 / NGRAMS_A_BUCKET))))


def scan(records: DataFrame, n: int, min_words: int, bits: int = SKETCH_BITS) -> DataFrame:
    """Rows of two kinds: (slice, counts) with the task's sketch, and (id, size, fp_a, fp_b) of each record."""
    width = (1 << bits) // SLICES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, counts = WordHashes(), np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for pdf in _slices(batch):
                h, sizes = gram_sets(pdf["text"], memo, n, min_words)
                if not len(h):
                    continue
                np.add.at(counts, (h & np.uint64((1 << bits) - 1)).astype(np.int64), np.uint32(1))
                has = sizes > 0
                starts = (np.cumsum(sizes) - sizes)[has]
                a, b = np.add.reduceat(mix(h), starts), np.bitwise_xor.reduceat(mix(h ^ np.uint64(0x9E3779B97F4A7C15)), starts)
                yield pd.DataFrame({"slice": None, "counts": None, "id": pdf["id"].to_numpy()[has], "size": sizes[has].astype("int32"), "fp_a": a.view("int64"), "fp_b": b.view("int64")})
        for k in range(SLICES):
            part = counts[k * width : (k + 1) * width]
            if part.any():
                yield pd.DataFrame({"slice": [k], "counts": [part.tobytes()], "id": None, "size": None, "fp_a": None, "fp_b": None})

    some = records.coalesce(TASKS_A_CORE * records.sparkSession.sparkContext.defaultParallelism)
    return some.mapInPandas(run, "slice int, counts binary, id bigint, size int, fp_a bigint, fp_b bigint")


def rarity(scanned: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """One byte a bucket: four times the binary logarithm of its count."""
    width = (1 << bits) // SLICES

    def added(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, c in zip(pdf["slice"], pdf["counts"]):
                sums[k] = sums.get(k, np.zeros(width, np.uint64)) + np.frombuffer(c, np.uint32 if len(c) == 4 * width else np.uint64)
        return sums

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, c in added(batches).items():
            yield pd.DataFrame({"slice": [k], "counts": [c.tobytes()]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, c in added(batches).items():
            yield pd.DataFrame({"slice": [k], "level": [np.round(4 * np.log2(c + 1.0)).astype(np.uint8).tobytes()]})

    sketches = scanned.where(F.col("slice").isNotNull()).select("slice", "counts").withColumn("some", F.spark_partition_id() % 8)
    once = sketches.repartition(32, "slice", "some").select("slice", "counts").mapInPandas(part, "slice int, counts binary")
    out = np.zeros(1 << bits, np.uint8)
    for r in once.repartition(8, "slice").mapInPandas(whole, "slice int, level binary").toLocalIterator():  # 2**bits bytes in all
        out[r.slice * width : (r.slice + 1) * width] = np.frombuffer(r.level, np.uint8)
    return out


def need(size: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t * size - 1e-9).astype(np.int64)


def _widths(sizes: np.ndarray) -> np.ndarray:
    """Words of each set's bitmap: a power of two, with at least two bits for each member."""
    return np.clip(2 ** np.ceil(np.log2(np.maximum(sizes, 32) / 32)).astype(np.int64), BITMAP_LEAST, BITMAP_MOST)


def _parity(h: np.ndarray, owner: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The sets' bitmaps one after the other: a bit counts the members that fall on it, modulo 2. A bitmap folds to half its
    width by exclusive or, so bitmaps of different widths can be compared."""
    bits, starts = 64 * widths, 64 * (np.cumsum(widths) - widths)
    at = starts[owner] + (mix(h) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def _folded(maps: np.ndarray, widths: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width: the bitmaps folded down to it of all sets that have at least it, and each set's row there."""
    out, starts = {}, np.cumsum(widths) - widths
    rows, at = np.zeros((0, 1), np.uint64), np.zeros(0, np.int64)
    for w in sorted(set(widths.tolist()), reverse=True):
        while len(rows) and rows.shape[1] > w:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        own = np.flatnonzero(widths == w)
        mine = maps[starts[own][:, None] + np.arange(w)]
        rows, at = np.concatenate([rows.reshape(-1, w), mine]), np.concatenate([at, own])
        place = np.full(len(widths), -1)
        place[at] = np.arange(len(at))
        out[w] = (rows, place)
    return out


def prefix_blocks(records: DataFrame, level: np.ndarray, buckets: int, n: int, t: float, min_words: int, long_list: float | None = None) -> DataFrame:
    """(bucket, ids, sizes, bitmaps, counts, keys, places, sides): postings of the prefixes in columnar blocks, a record's postings
    side by side. Keys have 32 bits: two n-grams that share one only add pairs for the verification to refuse."""
    order = records.sparkSession.sparkContext.broadcast(level)
    mask, long_list = np.uint64(len(level) - 1), long_list or LONG_LIST

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, rare = WordHashes(), order.value
        held: list[tuple] = []
        held_n = 0

        def flush() -> Iterator[pd.DataFrame]:
            if not held:
                return
            base = np.cumsum([0] + [len(x[0]) for x in held])
            ids, sizes, maps = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2))
            keys, places, sides = (np.concatenate([x[i] for x in held]) for i in (3, 5, 6))
            owners = np.concatenate([x[4] + b for x, b in zip(held, base)])
            held.clear()
            widths = _widths(sizes)
            starts = np.cumsum(widths) - widths
            to = (keys % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((owners, to))
            ends = np.searchsorted(to[by], np.arange(buckets + 1))
            for b in range(buckets):
                rows = by[ends[b] : ends[b + 1]]
                if len(rows):
                    docs, counts = np.unique(owners[rows], return_counts=True)
                    w = widths[docs]
                    words = np.repeat(starts[docs] - (np.cumsum(w) - w), w) + np.arange(w.sum())
                    columns = {"ids": ids[docs], "sizes": sizes[docs], "bitmaps": maps[words], "counts": _small(counts), "keys": (keys[rows] >> np.uint64(32)).astype(np.uint32), "places": _small(places[rows]), "sides": sides[rows] if sides[rows].any() else sides[:0]}
                    yield pd.DataFrame({"bucket": [b], **{k: [v.tobytes()] for k, v in columns.items()}})

        for batch in batches:
            for pdf in _slices(batch):
                h, sizes = gram_sets(pdf["text"], memo, n, min_words)
                has = sizes > 0
                if not has.any():
                    continue
                ids, sizes = pdf["id"].to_numpy()[has], sizes[has]
                owner = np.repeat(np.arange(len(sizes)), sizes)
                maps = _parity(h, owner, _widths(sizes))
                lv = rare[(h & mask).astype(np.int64)]
                by = np.lexsort((h, lv, owner))
                h, lv = h[by], lv[by]
                place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = place < np.repeat(sizes - need(sizes, t) + 1, sizes)
                h, lv, owner, place = h[keep], lv[keep], owner[keep], place[keep]
                # how many parts a list is split in follows from the sketch alone, so all tasks agree
                parts = np.maximum(1, np.ceil(2.0 ** ((lv + 0.5) / 4) / long_list)).astype(np.int64)
                long = parts > 1
                keys, own, pl, side = [mix(h[~long])], [owner[~long]], [place[~long]], [np.zeros(int((~long).sum()), np.uint8)]
                for s in np.unique(parts[long]):
                    at = np.flatnonzero(parts == s)
                    mine = (mix(ids[owner[at]].view(np.uint64)) % np.uint64(s)).astype(np.int64)
                    for other in range(s):
                        lo, hi = np.minimum(mine, other), np.maximum(mine, other)
                        keys.append(mix(h[at] + mix((lo * s + hi + 1).astype(np.uint64))))
                        own.append(owner[at])
                        pl.append(place[at])
                        side.append(np.where(lo == hi, 0, np.where(mine == lo, 1, 2)).astype(np.uint8))
                held.append((ids, sizes.astype(np.int32), maps, np.concatenate(keys), np.concatenate(own), np.concatenate(pl), np.concatenate(side)))
                held_n += len(held[-1][3])
                if held_n > 2_000_000:
                    yield from flush()
                    held_n = 0
        yield from flush()

    return records.mapInPandas(run, "bucket int, ids binary, sizes binary, bitmaps binary, counts binary, keys binary, places binary, sides binary")


def _small(x: np.ndarray) -> np.ndarray:
    """In as few bytes as its largest value needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _large(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{max(1, len(raw) // max(n, 1))}").astype(np.int32)


def partners(rank: np.ndarray, size: np.ndarray, left: np.ndarray, alpha: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of postings sorted by list (``rank``) and size: which can be the smaller one of a pair, and for each posting where its partners begin among
    those and how many there are. The n-gram is the first that both share, so ``left`` members of each may be shared at most, and ``alpha`` must."""
    code = rank * (1 << 32) + size
    smaller = np.flatnonzero(left >= alpha[2 * size])
    low = np.searchsorted(code[smaller], rank * (1 << 32) + np.ceil(t * size - 1e-6).astype(np.int64))
    most = np.floor((left + 1e-6) * (1 + t) / t).astype(np.int64) - size
    high = np.minimum(np.searchsorted(code[smaller], rank * (1 << 32) + most, "right"), np.searchsorted(smaller, np.arange(len(code))))
    return smaller, low, np.maximum(high - low, 0)


def _bucket_pairs(blocks: pd.DataFrame, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (least id first) of one bucket."""
    def whole(col: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, kind) for x in blocks[col]])

    ids, sizes, keys, maps = whole("ids", np.int64), whole("sizes", np.int32), whole("keys", np.uint32), whole("bitmaps", np.uint64)
    docs, postings = [len(x) // 8 for x in blocks["ids"]], [len(x) // 4 for x in blocks["keys"]]
    counts = np.concatenate([_large(x, n) for x, n in zip(blocks["counts"], docs)])
    place = np.concatenate([_large(x, n) for x, n in zip(blocks["places"], postings)])
    side = np.concatenate([np.frombuffer(x, np.uint8) if len(x) else np.zeros(n, np.uint8) for x, n in zip(blocks["sides"], postings)])
    widths = _widths(sizes)
    folded = _folded(maps, widths)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    by = np.lexsort((sizes[doc], keys))
    keys, doc, place, side = keys[by], doc[by], place[by], side[by]
    size = sizes[doc]
    rank = np.cumsum(np.r_[0, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    left = size - place  # members from this place on
    alpha = np.ceil(t / (1 + t) * np.arange(2 * int(size.max(initial=0)) + 1) - 1e-9).astype(np.int32)
    smaller, low, n = partners(rank, size, left, alpha, t)
    split = bool(side.any())
    total, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        for lo in range(0, int(n[at]) if to == at + 1 else 1, PAIRS_AT_ONCE):  # one posting may have more partners than that
            if to == at + 1:
                j = smaller[int(low[at]) + lo : int(low[at]) + min(int(n[at]), lo + PAIRS_AT_ONCE)]
                i = np.full(len(j), at)
            else:
                m = n[at:to]
                i = np.repeat(np.arange(at, to), m)
                j = smaller[np.arange(len(i)) - np.repeat(np.cumsum(m) - m - low[at:to], m)]
            ok = np.minimum(left[i], left[j]) >= alpha[size[i] + size[j]]
            if split:
                ok &= np.where(side[i] == 0, side[j] == 0, side[i] + side[j] == 3)
            i, j = i[ok], j[ok]
            a, b = doc[i], doc[j]
            both = sizes[a] + sizes[b]
            gap, width = np.zeros(len(a), np.int32), np.minimum(widths[a], widths[b])
            for w, (rows, at_row) in folded.items():
                some = np.flatnonzero(width == w)
                gap[some] = np.bitwise_count(rows[at_row[a[some]]] ^ rows[at_row[b[some]]]).sum(axis=1, dtype=np.int32)
            ok = (gap <= both - 2 * alpha[both]) & (ids[a] != ids[b])
            x, y = ids[a[ok]], ids[b[ok]]
            yield np.minimum(x, y), np.maximum(x, y)
        at = to


def candidates(blocks: DataFrame, buckets: int, t: float) -> DataFrame:
    """(id_1, id_2): pairs that no filter rules out, each once. Every bucket is a partition of its own, so none waits behind another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pdf for pdf in batches if len(pdf)]
        for _, pdf in pd.concat(parts).groupby("bucket") if parts else ():
            found, some = np.zeros((0, 2), np.int64), []
            for x, y in _bucket_pairs(pdf, t):
                some.append(np.stack([x, y], axis=1))
                if sum(map(len, some)) > 500_000:
                    found, some = np.unique(np.concatenate([found, *some]), axis=0), []
            found = np.unique(np.concatenate([found, *some]), axis=0)
            yield pd.DataFrame(found, columns=["id_1", "id_2"])

    return blocks.repartitionById(buckets, F.col("bucket")).mapInPandas(run, "id_1 bigint, id_2 bigint").distinct()


def verified(pairs: DataFrame, records: DataFrame, n: int, t: float, min_words: int) -> DataFrame:
    """(id_1, id_2, similarity) of the pairs that reach the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                pdf = batch.iloc[at : at + TEXTS_AT_ONCE]
                m = len(pdf)
                texts, place = np.unique(np.concatenate([pdf["text_1"], pdf["text_2"]]), return_inverse=True)
                h, sizes = gram_sets(texts, memo, n, min_words)
                starts = np.cumsum(sizes) - sizes
                one, two = place[:m], place[m:]

                def rows(which):
                    s = sizes[which]
                    who = np.repeat(np.arange(m), s)
                    return h[np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + np.repeat(starts[which], s)], who

                (h1, w1), (h2, w2) = rows(one), rows(two)
                all_h, all_w = np.concatenate([h1, h2]), np.concatenate([w1, w2])
                by = np.lexsort((all_h, all_w))
                all_h, all_w = all_h[by], all_w[by]
                same = (all_h[1:] == all_h[:-1]) & (all_w[1:] == all_w[:-1])
                shared = np.bincount(all_w[1:][same], minlength=m)
                like = shared / np.maximum(sizes[one] + sizes[two] - shared, 1)
                ok = like >= t - 1e-12
                yield pd.DataFrame({"id_1": pdf["id_1"].to_numpy()[ok], "id_2": pdf["id_2"].to_numpy()[ok], "similarity": like[ok]})

    both = pairs.join(records.select(F.col("id").alias("id_1"), F.col("text").alias("text_1")), "id_1")
    both = both.join(records.select(F.col("id").alias("id_2"), F.col("text").alias("text_2")), "id_2")
    return both.mapInPandas(run, "id_1 bigint, id_2 bigint, similarity double")


def representatives(df: DataFrame, id_col: str, text_col: str, n: int = N, t: float = THRESHOLD, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Pairs (id_1, id_2, similarity) between records of different sets, each set shown by its least id, and the records of sets that occur more
    than once (id, first, copies), with that id and how many there are."""
    records = _records(df, id_col, text_col)
    bits = sketch_bits(records)
    scanned = stored(scan(records, n, min_words, bits), "scan")
    prints = scanned.where(F.col("id").isNotNull()).select("id", "size", "fp_a", "fp_b")
    sums = prints.agg(F.coalesce(F.sum(F.col("size") * F.lit(1 - t) + 1), F.lit(0.0)).alias("p"), F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()
    buckets = max(8, math.ceil(sums.p / BUCKET_POSTINGS))
    first = prints.groupBy("fp_a", "fp_b", "size").agg(F.min("id").alias("first"), F.count_distinct("id").alias("copies"))
    copies = stored(prints.join(first.where(F.col("copies") > 1), ["fp_a", "fp_b", "size"]).select("id", "first", "copies").distinct(), "copies")
    kept = records.join(copies.where(F.col("id") != F.col("first")).select("id"), "id", "left_anti")
    blocks = prefix_blocks(kept, rarity(scanned, bits), buckets, n, t, min_words, max(LONG_LIST, 4 * sums.n / (1 << bits)))
    pairs = stored(candidates(blocks, buckets, t), "candidates")
    return stored(verified(pairs, records, n, t, min_words), "pairs"), copies


def similar_pairs(df: DataFrame, id_col: str, text_col: str, n: int = N, t: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """(id_1, id_2, similarity), id_1 < id_2: every pair of records whose sets' Jaccard similarity is at least ``t``."""
    return _with_copies(*representatives(df, id_col, text_col, n, t, min_words))


def _in_parts(copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The copies with the part of their group that each is in, and (first, part) of all parts: a join on both halves of a key keeps no group
    in one task."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("copies") / COPIES_AT_ONCE))
    placed = copies.select("id", "first", F.pmod(F.xxhash64("id"), parts).alias("part"))
    return placed, copies.where("id = first").select("first", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))


def _with_copies(near: DataFrame, copies: DataFrame) -> DataFrame:
    """Pairs between records of equal sets added, and pairs of representatives carried over to their copies."""
    placed, parts = _in_parts(copies)

    def spread(pairs: DataFrame, side: str) -> DataFrame:
        rows = pairs.join(parts.withColumnRenamed("first", side), side, "left").join(placed.select(F.col("first").alias(side), "part", F.col("id").alias("_id")), [side, "part"], "left")
        rows = rows.where("part IS NULL OR _id IS NOT NULL")  # a part may have no member
        return rows.withColumn(side, F.coalesce("_id", side)).drop("part", "_id")

    both = spread(spread(near, "id_1"), "id_2")
    left = placed.join(parts.withColumnRenamed("part", "other"), "first").select("first", "other", F.col("id").alias("id_1"))
    equal = left.join(placed.select("first", F.col("part").alias("other"), F.col("id").alias("id_2")), ["first", "other"]).where("id_1 < id_2")
    rows = both.select("id_1", "id_2", "similarity").unionByName(equal.select("id_1", "id_2", F.lit(1.0).alias("similarity")))
    return rows.select(F.least("id_1", "id_2").alias("id_1"), F.greatest("id_1", "id_2").alias("id_2"), "similarity")


def classes_of(near: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, class_id, links) as ``classes`` gives for all pairs, from the pairs of representatives: copies get their representative's class,
    and links are counted, not made."""
    own = classes(near)
    size = copies.where("id = first").select(F.col("id").alias("rep"), "copies")
    ends = near.select(F.col("id_1").alias("id"), F.col("id_2").alias("rep")).unionByName(near.select(F.col("id_2").alias("id"), F.col("id_1").alias("rep")))
    links = ends.join(size, "rep", "left").groupBy("id").agg(F.sum(F.coalesce("copies", F.lit(1))).alias("links"))
    reps = own.select("id", "class_id").join(links, "id").join(size.withColumnRenamed("rep", "id"), "id", "full_outer")
    reps = reps.select("id", F.coalesce("class_id", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("links"))
    others = copies.where("id <> first").select(F.col("first").alias("id"), F.col("id").alias("copy")).join(reps, "id").select(F.col("copy").alias("id"), "class_id", "links")
    return reps.unionByName(others)


def classes(pairs: DataFrame) -> DataFrame:
    """(id, class_id, links): connected records get the least id they can reach. A smaller label that a record sees is also written
    to the label that it had, and labels are replaced by their own, so whole trees are hooked at once. Goes on until nothing moves;
    each round is written, never collected."""
    links = stored(pairs.select(F.col("id_1").alias("a"), F.col("id_2").alias("b")).distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count("*").alias("links")), "labels")
    while True:
        near = both.join(label.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        jump = label.select(F.col("a").alias("label"), F.col("label").alias("far"))
        hook = label.join(near, "a").groupBy("label").agg(F.min("near").alias("hook"))  # the least that any record with this label sees
        at = hook.select(F.col("label").alias("a"), F.col("hook").alias("own"))
        new = label.join(near, "a").join(jump, "label", "left").join(hook, "label", "left").join(at, "a", "left")
        new = new.select("a", F.least("label", "near", "far", "hook", "own").alias("new"), "links", F.col("label").alias("old"))
        new = stored(new, "labels")
        moved = new.where(F.col("new") != F.col("old")).limit(1).count()
        label = new.select("a", F.col("new").alias("label"), "links")
        if not moved:
            break
    return label.select(F.col("a").alias("id"), F.col("label").alias("class_id"), "links")

"""Problem 6: items of varying length in containers of one capacity.

Sizes are tokens of a public tokenizer. Items larger than the container are split into full pieces and a rest; all others
stay whole. Items are spread over shards by hash, so many that each has about ``SHARD_ITEMS``, and every shard is packed
by best-fit decreasing in its own task.

A dual-feasible function f maps sizes so that no full container holds more than 1 of it; the sum of f over the items, rounded
up, bounds the number of bins from below. The largest bound over a family of such functions certifies a shard's result: where
bins and bound agree, it is optimal. Shards with a gap hand the items of their worst-filled bins over; these are mixed anew
over fewer shards and packed again, the outcome is kept only if it saves bins, and this goes on while it does. ``certificate`` compares the whole
result with the bound over all items, which comes from the histogram of sizes (at most ``capacity`` rows).

Nulls and odd rows: a null or empty text has no tokens and takes no place; null ids are left out; copies and an id that occurs
twice are packed as often as they occur; a null capacity, or one below 1, is no container; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

TOKENIZER = os.environ.get("PAGEWRIGHT_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that cuts text before the merges of that vocabulary.
CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_ITEMS = 20_000


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = TOKENIZER) -> DataFrame:
    """(item_id, tokens) of every text with at least one token. The vocabulary file is read where the driver runs and shipped to the
    executors; each task loads it once."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoder = tiktoken.Encoding("own", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf["id"], "tokens": [len(encoder.encode_ordinary(t)) for t in pdf["text"]]})

    ok = docs.where(F.col(id_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return ok.mapInPandas(run, "item_id bigint, tokens bigint").where("tokens > 0")


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(item_id, piece, tokens): items cut only where they exceed the capacity."""
    whole = F.floor((F.col("tokens") - 1) / capacity)
    return sizes.select("item_id", F.posexplode(F.transform(F.sequence(F.lit(0).cast("bigint"), whole), lambda i: F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - i * capacity))).alias("piece", "tokens"))


def lower_bound(sizes: np.ndarray, n: np.ndarray, capacity: int) -> int:
    """Bins that the items (``n`` of each size) need at least: the best of the family f_k(x) = x if (k+1) x is whole, else
    floor((k+1) x) / k, and of the cut-off functions that count items above capacity - e as full and drop those below e."""
    x = sizes / capacity
    best = float((x * n).sum())
    for k in range(1, 21):
        y = (k + 1) * x
        whole = np.abs(y - np.round(y)) < 1e-12
        best = max(best, float((np.where(whole, x, np.floor(y) / k) * n).sum()))
    for e in np.unique(np.r_[np.linspace(0.005, 0.5, 100)]):
        f = np.where(x > 1 - e, 1.0, np.where(x < e, 0.0, x))
        best = max(best, float((f * n).sum()))
    return int(np.ceil(best - 1e-6))


def best_fit_decreasing(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item, and each bin's unused room. Open bins are kept in stacks by their room, and the rooms that occur in
    order, so an item takes the fullest bin that it fits."""
    bins, room = np.zeros(len(tokens), np.int64), []
    stacks: dict[int, list[int]] = {}
    rooms: list[int] = []
    for i in np.argsort(-tokens, kind="stable"):
        size = int(tokens[i])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            b, left = len(room), capacity
            room.append(capacity)
        else:
            left = rooms[at]
            b = stacks[left].pop()
            if not stacks[left]:
                del stacks[left], rooms[at]
        bins[i], left = b, left - size
        room[b] = left
        if left:
            if left not in stacks:
                stacks[left] = []
                bisect.insort(rooms, left)
            stacks[left].append(b)
    return bins, np.array(room, dtype=np.int64)


def _packed(rows: DataFrame, capacity: int) -> DataFrame:
    """(shard, item_id, piece, tokens, bin, room, gap) of rows (shard, item_id, piece, tokens)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "item_id", "piece"], ascending=[False, True, True], ignore_index=True)
        tokens = pdf["tokens"].to_numpy()
        bins, room = best_fit_decreasing(tokens, capacity)
        sizes, n = np.unique(tokens, return_counts=True)
        return pdf.assign(bin=bins, room=room[bins], gap=len(room) - lower_bound(sizes, n, capacity))

    schema = "shard int, item_id bigint, piece int, tokens bigint, bin bigint, room bigint, gap bigint"
    return rows.groupBy("shard").applyInPandas(run, schema)


def pack(sizes: DataFrame, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(bin_id, item_id, piece, tokens). Bins are named by the round and shard that made them."""
    items = stored(pieces(sizes, capacity), "pieces")
    n = items.count()
    shards = max(1, -(-n // shard_items))
    spread = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "piece"), F.lit(shards)).cast("int"))
    now = stored(_packed(spread, capacity).withColumn("round", F.lit(0)), "packed")
    for step in count(1):  # until an exchange saves no bin
        # bins filled worse than their shard's gap explains are opened again: those with the most room, and more for a larger gap
        gaps = now.groupBy("shard", "round").agg(F.max("gap").alias("gap"), F.count_distinct("bin").alias("bins"), F.sum("tokens").alias("t"))
        total = gaps.agg(F.sum("gap").alias("gap"), F.sum("bins").alias("bins"), F.sum("t").alias("t")).first()
        if not total.gap or total.bins <= -(-total.t // capacity):
            break
        loose = F.col("room") * 50 > capacity
        opened = now.where(loose & (F.col("gap") > 0))
        left = opened.count()
        if not left:
            break
        fewer = max(1, -(-left // shard_items))
        again = opened.select(F.pmod(F.xxhash64("piece", "item_id", F.lit(step)), F.lit(fewer)).cast("int").alias("shard"), "item_id", "piece", "tokens")
        redone = stored(_packed(again, capacity).withColumn("round", F.lit(step)), "repacked")
        before = opened.select("shard", "round", "bin").distinct().count()
        after = redone.select("shard", "bin").distinct().count()
        if after >= before:
            break
        now = now.where(~(loose & (F.col("gap") > 0))).unionByName(redone)
    return now.select(F.concat_ws("-", "round", "shard", "bin").alias("bin_id"), "item_id", "piece", "tokens")


def pack_all(sizes: DataFrame, containers: list[tuple[str, int]]) -> DataFrame:
    """(container, bin_id, item_id, piece, tokens) for every container of a short, fixed list."""
    out = None
    for name, capacity in containers:
        rows = pack(sizes, capacity).select(F.lit(name).alias("container"), "bin_id", "item_id", "piece", "tokens")
        out = rows if out is None else out.unionByName(rows)
    return out


def certificate(packed: DataFrame, containers: list[tuple[str, int]]) -> DataFrame:
    """(container, capacity, bins, lower_bound, unused): how far each container's packing is from the best there can be."""
    capacity = packed.sparkSession.createDataFrame(containers, "container string, capacity bigint")
    bins = packed.groupBy("container").agg(F.count_distinct("bin_id").alias("bins"), F.sum("tokens").alias("tokens"))
    hist = packed.groupBy("container", "tokens").agg(F.count("*").alias("n")).join(capacity, "container")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"container": [key[0]], "lower_bound": [lower_bound(pdf["tokens"].to_numpy(), pdf["n"].to_numpy(), int(key[1]))]})

    bound = hist.groupBy("container", "capacity").applyInPandas(run, "container string, lower_bound bigint")
    unused = 1 - F.col("tokens") / (F.col("bins") * F.col("capacity"))
    return bins.join(capacity, "container").join(bound, "container").select("container", "capacity", "bins", "lower_bound", unused.alias("unused"))

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_and_packing(sizes):
    sizes = np.array(sizes)
    bins, room = P.best_fit_decreasing(sizes, 20)
    fill = np.bincount(bins, weights=sizes)
    assert (fill <= 20).all() and (20 - fill == room).all()
    u, n = np.unique(sizes, return_counts=True)
    assert P.lower_bound(u, n, 20) <= fewest(sorted(sizes.tolist(), reverse=True), 20) <= len(room)


def fewest(sizes, capacity):
    best = len(sizes)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= capacity:
                put(k + 1, bins[:b] + [bins[b] + sizes[k]] + bins[b + 1 :])
        put(k + 1, [*bins, sizes[k]])

    put(0, [])
    return best


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([rng.randint(1, 60), rng.randint(1, 400)])) for i in range(800)] + [(900, 1300), (900, 5), (901, 512)]
    sizes = spark.createDataFrame(rows, "item_id bigint, tokens bigint")
    out = P.pack(sizes, 512, shard_items=150).toPandas()
    assert out.groupby("bin_id").tokens.sum().max() <= 512
    assert out.tokens.sum() == sum(t for _, t in rows)
    whole = out[(out.item_id != 900)]
    assert sorted(zip(whole.item_id, whole.tokens)) == sorted(r for r in rows if r[0] != 900)
    assert sorted(out[out.item_id == 900].tokens) == [5, 276, 512, 512]
    cert = P.certificate(spark.createDataFrame(out).selectExpr("'c' AS container", "bin_id", "item_id", "piece", "tokens"), [("c", 512)]).first()
    assert cert.lower_bound <= cert.bins <= 1.05 * cert.lower_bound + 2
    assert P.pack(sizes.where("false"), 512).count() == 0


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([(1, "Hello world", 9), (2, None, 9), (3, "", 9), (None, "x", 9), (4, "wörd " * 9000, 9)], "doc_id bigint, text string, tokens int")
    out = {r.item_id: r.tokens for r in P.token_counts(df).collect()}
    assert out[1] == 2 and set(out) == {1, 4} and out[4] > 9000

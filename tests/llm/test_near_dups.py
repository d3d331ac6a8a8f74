import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import near_dups as N
from pagewright.llm.words import words

SCHEMA = "id bigint, text string, id_1 string"  # a column that clashes with one of the result


def brute(rows, t=0.6, least=30):
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, x, _ in rows if i is not None and len(w := words(x)) >= least}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    rows, i = [], 0
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 4)):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(x) // 8))):
                k = rng.randrange(len(x))
                rng.choice([lambda: x.pop(k), lambda: x.insert(k, rng.choice(vocab)), lambda: x.__setitem__(k, rng.choice(vocab))])()
            rows.append((i, " ".join(x), "z"))
            i += 1
    return rows


def found(spark, rows):
    out = N.similar_pairs(spark.createDataFrame(rows, SCHEMA), "id", "text").collect()
    assert len({(r.id_1, r.id_2) for r in out}) == len(out)
    return {(r.id_1, r.id_2) for r in out}


def test_every_pair_and_no_other(spark):
    rows = corpus(1) + [(1000, None, "z"), (1001, "", "z"), (None, "a b c " * 20, "z"), (1002, "short text", "z")]
    assert found(spark, rows) == brute(rows)


def test_copies_and_one_word_texts(spark):
    text = " ".join(f"x{k}" for k in range(40))
    rows = [(k, text, "z") for k in range(6)] + [(10, text + " more words here", "z"), (11, "a " * 50, "z"), (12, "a " * 40, "z")]
    assert found(spark, rows) == brute(rows)


def test_long_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "LONG_LIST", 5)
    monkeypatch.setattr(N, "PAIRS_AT_ONCE", 7)
    rows = corpus(2, 30)
    level = np.full(1 << N.SKETCH_BITS, 20, np.uint8)  # as if every list were long
    records = N._records(spark.createDataFrame(rows, SCHEMA), "id", "text")
    blocks = [r.asDict() for r in N.prefix_blocks(records, level, 3, 3, 0.6, 30).collect()]
    import pandas as pd

    pairs = set()
    for _, pdf in pd.DataFrame(blocks).groupby("bucket"):
        for x, y in N._bucket_pairs(pdf.reset_index(drop=True), 0.6):
            pairs |= set(zip(x.tolist(), y.tolist()))
    assert brute(rows) <= pairs


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(0)
    for n in (10, 100, 1000, 5000):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.unique(np.r_[a[: n * 3 // 4], rng.integers(0, 1 << 62, n).astype(np.uint64)])
        sizes = np.array([len(a), len(b)])
        widths = N._widths(sizes)
        maps = N._parity(np.r_[a, b], np.repeat([0, 1], sizes), widths)
        w = min(widths)
        rows, at = N._folded(maps, widths)[w]
        gap = int(np.bitwise_count(rows[at[0]] ^ rows[at[1]]).sum())
        assert gap <= len(set(a.tolist()) ^ set(b.tolist()))


def test_empty_table_and_classes(spark):
    assert found(spark, []) == set()
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 9)], "id_1 bigint, id_2 bigint")
    out = {(r.id, r.class_id, r.links) for r in N.classes(pairs).collect()}
    assert out == {(1, 1, 1), (2, 1, 2), (3, 1, 2), (4, 1, 1), (7, 7, 1), (9, 7, 1)}
    assert N.classes(pairs.where(F.lit(False))).count() == 0


def test_a_long_chain_is_one_class(spark):
    ids = [*range(1, 61, 2), *range(60, 0, -2)]  # ids fall towards both ends of a path
    links = spark.createDataFrame([(min(x), max(x)) for x in zip(ids, ids[1:])], "id_1 bigint, id_2 bigint")
    out = N.classes(links).collect()
    assert sorted(r.id for r in out) == sorted(ids) and {r.class_id for r in out} == {1}
    assert sum(r.links for r in out) == 2 * (len(ids) - 1)


def test_groups_of_copies_in_parts_and_classes_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "COPIES_AT_ONCE", 3)
    text = " ".join(f"x{k}" for k in range(40))
    rows = [(k, text, "z") for k in range(20)] + [(30 + k, text + " more words", "z") for k in range(8)] + [(50, "y " + text, "z")] + [(60 + k, " ".join(f"q{j}" for j in range(35)), "z") for k in range(2)] + [(3, text, "z")]
    assert found(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(r.id, r.class_id, r.links) for r in N.classes(N.similar_pairs(df, "id", "text")).collect()}
    assert {(r.id, r.class_id, r.links) for r in N.classes_of(*N.representatives(df, "id", "text")).collect()} == want and len(want) == 31


def test_sketches_of_any_width(spark):
    df = spark.createDataFrame(corpus(4, 20), SCHEMA)
    records = N._records(df, "id", "text")
    assert N.sketch_bits(records) == N.BITS_LEAST and N.sketch_bits(records.where("false")) == N.BITS_LEAST
    wide, small = (N.rarity(N.scan(records, 3, 30, b), b) for b in (20, 16))
    assert len(wide) == 1 << 20 and len(small) == 1 << 16 and (wide > 0).sum() >= (small > 0).sum() > 0


def test_few_partners_in_a_long_list():
    rng = np.random.default_rng(3)
    t, n = 0.6, 600
    size = np.sort(rng.integers(100, 200, n))
    place = (size * rng.uniform(0.0, 0.4, n)).astype(np.int64)
    rank, left = np.repeat([0, 1], n // 2), size - place
    alpha = np.ceil(t / (1 + t) * np.arange(401) - 1e-9).astype(np.int32)
    smaller, low, m = N.partners(rank, size, left, alpha, t)
    formed = {(int(smaller[low[i] + k]), i) for i in range(n) for k in range(m[i])}
    every = [(i, j) for j in range(n) for i in range(j) if rank[i] == rank[j] and size[i] >= t * size[j]]
    right = {(i, j) for i, j in every if min(left[i], left[j]) >= alpha[size[i] + size[j]]}
    assert len(formed) == m.sum() and right <= formed and len(formed) < 1.6 * len(right) < len(every)
    late = N.partners(np.zeros(n, int), np.full(n, 150), np.full(n, 150 - 45), alpha, t)  # the last n-grams of all prefixes
    assert late[2].sum() == 0

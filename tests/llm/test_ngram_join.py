import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common as c
from tessera.llm import ngram_join as j

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, n, num):
    sets = {}
    for i, t in rows:
        w = WORD.findall(bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode()))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= num * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, rate):
    out = []
    for w in words:
        r = rng.random()
        out += [] if r < rate / 3 else [w, f"x{rng.random()}"] if r < 2 * rate / 3 else [f"y{rng.random()}"] if r < rate else [w]
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "one", "ONE", "one two three", "a b c d", "a b c d e"]
    passage = [f"p{i}" for i in range(40)]
    for size in (5, 6, 7, 8, 9, 11, 12, 13, 14, 17, 25, 60, 150, 400):
        base = [f"w{size}_{i}" for i in range(size)]
        texts += [" ".join(base)] * 2 + [" ".join(base[1:]), " ".join(base[:-1]), " ".join([*base, "end"])]
        texts += [" ".join(edited(rng, base, r)) for r in (0.003, 0.01, 0.02, 0.03, 0.04, 0.05, 0.08) for _ in range(2)]
        texts += [" ".join(base[: size // 2] + passage + base[size // 2 :])]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80), (1, 100)])
def test_against_brute_force(spark, n, num):
    rows = corpus(n)
    docs = spark.createDataFrame([(i, t, "x", t) for i, t in rows], "doc_id long, text string, hub string, hashes string")
    got = j.jaccard_components(docs, n, num).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, n, num) and len(got) == len(rows)


def test_empty_table(spark):
    assert j.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("num", [80, 85, 95])
def test_linked_sets_share_a_tile(num):
    rng = np.random.default_rng(num)
    bands = j.Bands(num)
    for size in [*range(2, 60), 100, 333, 1000, 4000]:
        for _ in range(3):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            most = bands.differ(len(a)) if 100 * len(a) // num > len(a) else 0
            cut, add = most // 2, most - most // 2
            b = np.unique(np.concatenate((a[cut:], rng.integers(0, 1 << 63, add, dtype=np.uint64))))
            if j.links(a, b, num):
                assert len(np.intersect1d(j.tiles(a, bands), j.tiles(b, bands))), (num, size)


def test_rounds_of_components_keep_the_planner_s_estimates_small(spark):
    n = 300
    chain = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = c.components(spark.range(n), chain)
    assert len(str(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 20  # digits; thousands, as estimates grew to their fourth power each round
    assert {r.component for r in got.collect()} == {0}

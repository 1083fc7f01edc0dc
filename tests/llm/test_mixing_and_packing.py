import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "b", "a", "ä", "Z", "a"]), " ".join(["w"] * rng.choice([0, 1, 1, 5, 50, 300]))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "solo", None), (n + 1, "solo", "x y"), (n + 1, "solo", "x y")], "doc_id long, source string, text string")


def levels(sizes, weights, share, most):
    """Targets by cutting and resharing until none is above."""
    total, cut = share * sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in cut)
        w = sum(weights[i] for i in range(len(sizes)) if i not in cut)
        t = [most * s if i in cut else left * weights[i] / w for i, s in enumerate(sizes)]
        new = {i for i in range(len(sizes)) if i not in cut and t[i] > most * sizes[i]}
        if not new:
            return t
        cut |= new


def test_mix(spark):
    d = docs(spark)
    rows = mixing.entropy_mix(d).collect()
    assert len(rows) == d.count()
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    assert all(r.source_size == size[r.source] for r in rows)
    assert np.allclose([target[s] for s in names], levels([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2))
    assert all(abs(taken[s] - target[s]) <= max(2, 0.01 * target[s]) for s in names)
    again = mixing.entropy_mix(d.repartition(3)).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)


def test_one_size_for_all_is_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NUMBERED", 16)
    d = spark.createDataFrame([(i, "a" if i < 300 else "b", "w w w") for i in range(600)], "doc_id long, source string, text string")
    taken = Counter()
    for r in mixing.entropy_mix(d).collect():
        taken[r.source] += r.taken
    assert abs(taken["a"] - 1800) <= 3 and abs(taken["b"] - 900) <= 3


def test_mix_of_nothing(spark):
    assert mixing.entropy_mix(docs(spark).limit(0)).count() == 0
    assert [r.taken for r in mixing.entropy_mix(spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string")).collect()] == [0]


def test_multiplier_is_an_exponential_tilt(spark):
    counts = spark.createDataFrame([(1, 1, 100), (1, 10, 10), (1, 100, 3)], "sid int, size long, n long")
    targets = spark.createDataFrame([(1, 500, 113, 350.0)], "sid int, source_size long, docs long, target double")
    x = mixing.newton(counts, targets).first().multiplier
    assert x < 0 and abs(sum(n * s * min(2, np.exp(x * s)) for s, n in ((1, 100), (10, 10), (100, 3))) - 350) < 1e-5


def test_pieces_and_sequences(spark):
    rng = random.Random(2)
    texts = [None, "", "It's <|endoftext|> OK, don't! H̱ 3,000", "ab cd. " * 30] + [" ".join(rng.choice(["the", "Fox,", "été", "x1-y", "ZZ!"]) for _ in range(rng.randint(1, 90))) for _ in range(200)]
    d = spark.createDataFrame([*enumerate(texts), (0, None)], "doc_id long, text string")
    rows = packing.pack_documents(d, PATH, capacity=64, shard=70).collect()
    from tokenizers import Tokenizer

    t, by = Tokenizer.from_file(PATH), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(by.pop(0)) == 2
    for i, text in list(enumerate(texts))[1:]:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        got = sorted(by[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in got] == [(s, min(64, len(ids) - s)) for s in range(0, len(ids), 64)]
        assert all(r.ids_crc32 == zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes()) for r in got)
    spans = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s[:-1], s[1:], strict=True)) and sum(n for _, n in s) <= 64
    assert packing.pack_documents(d.limit(0), PATH).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_binds(rule):
    rng = np.random.default_rng(3)
    length = rng.integers(1, 101, 2000)
    sequence, offset = packing.fit(length, 100, 4, 6000 + 4000, rule, (1.0, 0.3, 0.5))
    tokens, docs, cost = (np.bincount(sequence, w) for w in (length, np.ones(2000), length**2))
    assert tokens.max() <= 100 and docs.max() <= 4 and cost.max() <= 10000 and tokens.min() > 0
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], length[order]
    assert all(o[k] == (0 if k == 0 or s[k] != s[k - 1] else o[k - 1] + n[k - 1]) for k in range(2000))
    free, _ = packing.fit(length, 100, 100, 10000, rule)
    assert len(np.unique(free)) <= 1.03 * length.sum() / 100 + 1 if rule == "norm" else True
    with pytest.raises(ValueError):
        packing.fit(np.array([101]), 100, 4, 10000)


def test_empty_texts_fill_sequences(spark):
    """Documents of one token: as many to a sequence as it has tokens."""
    d = spark.range(20000).selectExpr("id AS doc_id", "'' AS text", "'x' AS piece", "7 AS offset")
    got = packing.pack_documents(d, PATH)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.select("sequence_id").distinct().count() == 5 and got.count() == 20000


def test_few_more_sequences_than_tokens_need(spark):
    rng = random.Random(4)
    rows = [(i if i % 9 else None, " ".join(["w"] * rng.choice([3, 40, 700, 2500, 9000]))) for i in range(200)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sum(r.doc_id is None for r in got) >= 23
    assert len({r.sequence_id for r in got}) <= 1.05 * -(-sum(r.length for r in got) // 4096) + 1

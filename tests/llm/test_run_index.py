import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import run_index as r


def brute(texts, k):
    count = Counter(t[p : p + k] for t in texts for p in range(len(t) - k + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for p in range(len(t) - k + 1):
            if count[t[p : p + k]] > 1:
                covered[p : p + k] = b"\1" * k
        kept = bytes(x for x, f in zip(t, covered, strict=True) if not f)
        out.append((len(t), sum(covered), sum(covered[i] and not (i and covered[i - 1]) for i in range(len(t))), hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(30), prose(400)
    out = [None, "", "short", passage, prose(100) + passage + prose(50), passage + prose(20) + passage, long, long, long[:700] + "X" + long[701:], "ab" * 300, "ab" * 100, "z" * 500, "y" * 41 + prose(5)]
    return out + [prose(rng.randint(10, 80)) + long[a : a + b] for a, b in ((0, 39), (5, 40), (100, 41), (300, 200))] + [prose(60) for _ in range(10)]


@pytest.mark.parametrize("gram", [16, 40])
def test_against_brute_force(spark, gram):
    rows = list(enumerate(texts(3)))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, spans int")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in r.remove_repeats(docs, 40, gram).collect()}
    assert [got[i] for i, _ in rows] == brute([(t or "").encode() for _, t in rows], 40)


def test_large_groups_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(r, "BIG_GROUP", 2)
    rows = list(enumerate(texts(4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in r.remove_repeats(docs, 40, 16).collect()}
    assert [got[i] for i, _ in rows] == brute([(t or "").encode() for _, t in rows], 40)


def test_long_texts_are_cut_and_classes_told_in_parts(spark, monkeypatch):
    monkeypatch.setattr(r, "_PIECE", 500)
    monkeypatch.setattr(r, "HELD", 7)
    rows = list(enumerate(texts(6) + ["the same again " * 9] * 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in r.remove_repeats(docs, 40, 16).collect()}
    assert [got[i] for i, _ in rows] == brute([(t or "").encode() for _, t in rows], 40)


def test_index_is_run_compressed():
    """Repetitive pieces: the index keeps far fewer runs than bytes, and its statistics alone mark what repeats."""
    rng = random.Random(8)
    base = bytes(rng.choice(b"abcd") for _ in range(500))
    pieces = [base] * 40
    index = r.RunIndex(pieces, np.ones(40, int))
    assert len(index.first) < 600 < 40 * 500 and index.statistics(pieces).tolist() == [*range(500, 0, -1)] * 40
    # a piece of weight 2 says what two equal ones do
    mixed = [base[:200], base[50:300] + b"x", bytes(rng.choice(b"ab") for _ in range(90)), b"abab"]
    weight = np.array([1, 2, 1, 2])
    double = [p for p, w in zip(mixed, weight, strict=True) for _ in range(w)]
    want, at = [], 0
    every = r.matching_statistics(double).tolist()
    for p, w in zip(mixed, weight, strict=True):
        want += every[at : at + len(p)]
        at += w * len(p)
    assert r.matching_statistics(mixed, weight).tolist() == want


def test_equal_rows_and_empty_table(spark):
    shared = prose = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "q" * 30 + "w" * 30)] * 2 + [(None, "lost" * 40), (None, "a" + shared), (7, "b" + shared), (7, "c " + prose[50:] + " d")]
    docs = spark.createDataFrame([(*x, 0, "e") for x in rows], "doc_id long, text string, row int, whole string")
    got = sorted(((x.doc_id or -1, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in r.remove_repeats(docs, 40, 16).collect()))
    assert got == sorted((i or -1, *x) for (i, _), x in zip(rows, brute([t.encode() for _, t in rows], 40), strict=True))
    assert r.remove_repeats(docs.limit(0)).count() == 0


def test_matching_statistics():
    rng = random.Random(5)
    for _ in range(20):
        pieces = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))] + [b"abababab" * 3]
        got = r.matching_statistics(pieces)
        want = []
        for i, p in enumerate(pieces):
            for a in range(len(p)):
                best = 0
                for k, q in enumerate(pieces):
                    for b in range(len(q)):
                        if (i, a) != (k, b):
                            n = 0
                            while a + n < len(p) and b + n < len(q) and p[a + n] == q[b + n]:
                                n += 1
                            best = max(best, n)
                want.append(best)
        assert np.array_equal(got, want)


def test_at_the_query_s_length(spark):
    """400 bytes in the default gram: a passage of over 50 words that has fewer stays, one byte decides."""
    prose = lambda tag, n: " ".join(f"{tag}{i:04d}" for i in range(n))
    short = " ".join(f"p{i:03d}" for i in range(60))  # 299 bytes
    rows = [prose("a", 90) + short + prose("b", 80), prose("c", 80) + short + prose("d", 90), short]
    rows += [prose(t, 60) + t + short + "x" * 101 + t + prose(t, 70) for t in "ef"] + [prose(t, 60) + t + "y" * 399 + t for t in "gh"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in r.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(rows))] == brute([t.encode() for t in rows], 400)
    assert [got[i][1] for i in range(len(rows))] == [0, 0, 0, 400, 400, 0, 0]


def brute_words(texts, k):
    at = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    strings = [[tuple(x[2] for x in w[i : i + k]) for i in range(len(w) - k + 1)] for w in at]
    count = Counter(x for w in strings for x in w)
    out = []
    for w, own in zip(at, strings, strict=True):
        out.append(len({b for i, x in enumerate(own) if count[x] > 1 for b in range(w[i][0], w[i + k - 1][1])}))
    return out


@pytest.mark.parametrize("piece, big, held", [(1 << 23, 4000, 200_000), (300, 2, 7)])
def test_passages_of_words(spark, monkeypatch, piece, big, held):
    """Passages of so many words are told whatever their bytes; what is removed stays as it is."""
    for name, value in (("_PIECE", piece), ("BIG_GROUP", big), ("HELD", held)):
        monkeypatch.setattr(r, name, value)
    rng = random.Random(9)
    passage = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(14))
    prose = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    rows = texts(3) + ["x y " * 30, passage, "q" * 90 + passage, *(f"{prose(20)} {passage}\n{prose(30)}" for _ in range(4)), prose(9) + "\t" + passage.replace(" ", "\n ") + " " + prose(150)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, x.passage_bytes) for x in r.remove_repeats(docs, 40, 16, words=12).collect()}
    raw = [(t or "").encode() for t in rows]
    want = [(*x, y) for x, y in zip(brute(raw, 40), brute_words(raw, 12), strict=True)]
    assert [got[i] for i in range(len(rows))] == want and sum(x[4] > 0 for x in want) > 9


def test_query_tells_short_passages(spark, tmp_path):
    """At the query's lengths: 51 words that have fewer than 400 bytes are told in passage_bytes, and not removed."""
    from tessera.llm import queries

    prose = lambda tag, n: " ".join(f"{tag}{i:04d}" for i in range(n))
    many, few = (" ".join(f"p{n}{i:02d}" for i in range(n)) for n in (51, 50))
    rows = [f"{prose(t, 40)} {x} {prose(t * 2, 40)}" for t, x in (("a", many), ("b", many), ("c", few), ("d", few))]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.n_removed, x.passage_bytes) for x in queries.op9_run_length_index(spark, str(tmp_path)).collect()}
    assert got == {0: (0, len(many)), 1: (0, len(many)), 2: (0, 0), 3: (0, 0)}

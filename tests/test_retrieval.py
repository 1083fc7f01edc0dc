import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.operators import dense, grading, ranking, sparse

TOY = ["the quick brown fox jumps over the lazy dog", "a fast brown fox runs through the dark forest", "the lazy dog sleeps all day long in the sun", "quick foxes and lazy dogs rarely meet at night", "machine learning models process large amounts of text data"]


@pytest.fixture(scope="module")
def toy(spark):
    return sparse.build(spark.createDataFrame(list(enumerate(TOY)), "doc_id long, text string")).cache()


def search(spark, toy, text, k=5):
    return sparse.search(toy, spark.createDataFrame([(1, text)], "query_id long, text string"), k, digits=14).orderBy("rank").collect()


def test_bm25_golden(spark, toy):
    rows = search(spark, toy, "quick fox")
    assert [r.doc_id for r in rows] == [0, 1, 3, 2, 4]
    assert np.allclose([r.score for r in rows], [0.6795926623304411, 0.33979633116522057, 0.33979633116522057, 0, 0], atol=1e-10)


def test_bm25_without_hits_and_with_repeats(spark, toy):
    assert [(r.doc_id, r.score) for r in search(spark, toy, "zebra", 3)] == [(0, 0), (1, 0), (2, 0)]
    assert [r.doc_id for r in search(spark, toy, "", 9)] == [0, 1, 2, 3, 4]
    once, twice = search(spark, toy, "fox", 1)[0].score, search(spark, toy, "fox fox", 1)[0].score
    assert abs(twice - 2 * once) < 1e-12


def test_dense_finds_itself_and_breaks_ties_by_id(spark):
    v = np.random.default_rng(42).standard_normal((4, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, v[i % 4].tolist()) for i in range(8)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = spark.createDataFrame([(9, v[2].tolist())], "query_id long, embedding array<double>")
    got = dense.search(vectors, q, 2).orderBy("rank").collect()
    assert [r.id for r in got] == [2, 6] and abs(got[0].score - 1) < 1e-4
    assert [r.id for r in dense.top_k(vectors, v[2].tolist(), 2).orderBy("rank").collect()] == [2, 6]
    assert dense.top_k(vectors, v[2].tolist(), 0).count() == 0 and dense.search(vectors, q.limit(0), 2).count() == 0
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(dense.normalised(F.col("v")).alias("n")).first().n
    assert zero == [0.0, 0.0]


def fuse(spark, rows):
    lists = spark.createDataFrame([(1, *r) for r in rows], "query_id int, list_no int, rank int, id string")
    return [(r.id, r.score) for r in ranking.fuse(lists).orderBy("rank").collect()]


def test_fusion_golden(spark):
    got = fuse(spark, [(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "c")])
    assert [i for i, _ in got] == ["b", "a", "c"] and np.allclose([s for _, s in got], [1 / 62 + 1 / 61, 1 / 61, 1 / 62])
    assert [i for i, _ in fuse(spark, [(1, 1, "a"), (0, 1, "z")])] == ["z", "a"] and fuse(spark, []) == []


def test_grades_never_leave_nothing(spark):
    g = spark.createDataFrame([(1, "a", "correct"), (1, "b", "incorrect"), (2, "a", "incorrect"), (2, "b", "incorrect")], "q int, id string, verdict string")
    assert sorted((r.q, r.id) for r in grading.survivors(g, ["q"]).collect()) == [(1, "a"), (2, "a"), (2, "b")]
    assert {r.q: r.stop for r in grading.decision(g, ["q"]).collect()} == {1: True, 2: False}
    got = spark.createDataFrame([(1, "a"), (1, "b")], "q int, id string")
    j = spark.createDataFrame([(1, 0, "a", "correct", "x"), (1, 1, "a", "wrong?", "y"), (1, 2, "ghost", "correct", "z")], "q int, pos int, id string, verdict string, reason string")
    assert sorted((r.id, r.verdict, r.reason) for r in grading.repaired(got, j, ["q"]).collect()) == [("a", "ambiguous", "y"), ("b", "ambiguous", "")]


def test_ordered_sets(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (1, 4, "c")], "q int, pos int, v string")
    assert [r.v for r in ranking.take_distinct(rows, ["q"], "v", 2, F.col("pos")).orderBy("rank").collect()] == ["a", "b"]
    assert [r.pos for r in ranking.last_attempt(rows, ["q"], "pos").collect()] == [4]
    a, b = spark.range(3).toDF("k"), spark.range(1, 4).toDF("k")
    assert sorted((r.k, r.problem) for r in ranking.missing_and_stale(a, b, ["k"]).collect()) == [(0, "missing"), (3, "stale")]


@pytest.mark.parametrize("tile", [7, 4096])
def test_tiles_meet_whatever_their_number(spark, monkeypatch, tile):
    """Every query against every vector in numpy; ties between equal vectors go by id."""
    monkeypatch.setattr(dense, "TILE", tile)
    monkeypatch.setattr(dense, "PRODUCT", 5)
    rng = np.random.default_rng(3)
    v, q = rng.standard_normal((90, 4)), rng.standard_normal((40, 4))
    v[60:] = v[:30]
    vectors = spark.createDataFrame([(100 - i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<double>")
    got = dense.search(vectors, asked, 3)
    score = np.round(q @ v.astype(np.float32).astype(float).T, 6)
    want = {(i, r + 1, 100 - j, score[i, j]) for i in range(40) for r, j in enumerate(sorted(range(90), key=lambda j: (-score[i, j], 100 - j))[:3])}
    assert {(r.query_id, r.rank, r.id, r.score) for r in got.collect()} == want
    assert dense.search(vectors, asked, 100).count() == 40 * 90 and dense.search(vectors.limit(0), asked, 3).count() == 0

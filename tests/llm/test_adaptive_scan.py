import numpy as np

from tessera.llm import adaptive_scan as a


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 20)) + 2 * rng.integers(0, 4, (3000, 1))
    v[10:200] = v[5]  # copies
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v.astype(np.float32))]
    bad = [(9000, None, 0), (9100, [0.0] * 20, 0), (9200, [float("nan")] * 20, 0), (9300, [1.0, None] + [1.0] * 18, 0), (9400, [1.0, 2.0], 0), (9500, [float("inf")] + [0.0] * 19, 0)]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int")
    got = a.nearest(vectors, k=10, lists=32).collect()
    x = v.astype(np.float32).astype(float)
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11)) and np.allclose([s for _, _, s in mine], d[[i for _, i, _ in mine]], atol=1e-12)
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hit += len({i for _, i, _ in mine} & set(want.tolist()))
    assert hit >= 0.9 * 300 and {r.query_id for r in got} == set(range(0, 3000, 100))
    copies = sorted((r.rank, r.vec_id) for r in got if r.query_id == 100)
    assert [i for _, i in copies] == [5, 10, 11, 12, 13, 14, 15, 16, 17, 18]


def _clusters(n):
    rng = np.random.default_rng(3)
    return (rng.standard_normal((n, 48)) + 2 * rng.integers(0, 4, (n, 1))).astype(np.float32)


def _recall(x, got, k=10):
    hit, asked = 0, range(0, len(x), 100)
    for q in asked:
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hit += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(d, kind="stable")[:k].tolist()))
    return hit / (k * len(asked))


def test_recall_of_the_scan_alone_above_the_sample(spark, monkeypatch):
    monkeypatch.setattr(a, "SAMPLE", 512)
    x = _clusters(8000)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    alone, whole = a.nearest(vectors, again=False).collect(), a.nearest(vectors).collect()
    assert _recall(x, alone) >= 0.9 and _recall(x, whole) >= _recall(x, alone)
    assert len(whole) == 800 and len({(r.query_id, r.vec_id) for r in whole}) == 800


def test_recall_with_few_sampled_vectors(spark, monkeypatch):
    monkeypatch.setattr(a, "SAMPLE", 200)
    x = np.random.default_rng(4).standard_normal((3000, 32)).astype(np.float32)  # no clusters: lists say little
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert _recall(x, a.nearest(vectors, again=False).collect()) >= 0.9


def test_probes_follow_the_data():
    rng = np.random.default_rng(5)
    apart = rng.standard_normal((640, 16)) + 50 * np.eye(16)[np.arange(640) % 8]
    mixed = rng.standard_normal((640, 16))
    ids = np.arange(640)
    few, many = (a.probes_needed(s, ids, a.fit_centres(s[160:], 20), 160, 10, 0.96) for s in (apart, mixed))
    assert few < many <= 20
    assert a.probes_needed(mixed, ids, a.fit_centres(mixed, 20), 160, 10, 1.0) >= many
    assert a.probes_needed(mixed[:1], ids[:1], mixed[:1], 0, 10, 0.96) == 1
    assert a.probes_needed(mixed[:4], np.zeros(4, int), mixed[:1], 4, 10, 0.96) == 1  # one id: no others


def test_results_come_from_the_scan_alone(spark, monkeypatch):
    monkeypatch.setattr(a, "COLUMNS", 8)
    x = _clusters(400)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rejecting = -9.0  # no candidate but near copies passes its tests
    assert a.nearest(vectors, epsilon=rejecting, again=False).count() < 40
    got = a.nearest(vectors, epsilon=rejecting).collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(q, r) for q in range(0, 400, 100) for r in range(1, 11)] and _recall(x, got) == 1


def test_small_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in a.nearest(few).collect()) == [(0, 1, 7), (0, 2, 100), (100, 1, 7), (100, 2, 0)]
    assert a.nearest(few.limit(0)).count() == 0 and a.nearest(few.where("vec_id = 7")).count() == 0


def test_scan_abandons_early_and_keeps_the_near():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 64)).astype(np.float32)
    q = x[:3] + 0.01
    kth = np.full(3, 4.0)
    i, j = a.scan(q, kth, x, 2.1)
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*np.nonzero(d <= 4.0), strict=True))

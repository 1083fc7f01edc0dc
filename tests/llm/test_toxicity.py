import random

import numpy as np

from tessera.llm import toxicity as t


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "the", "or", "in", "st", "er", "ou"]) for _ in range(rng.randint(1, 3)))
    texts, y = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 300))]
        y.append(i % 4 == 0)
        if y[-1]:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(["grobix", "zlurp", "vexo" + word()]))
        texts.append(" ".join(w).encode())
    return texts, np.array(y, int)


def test_held_out_accuracy():
    p = t.train(*corpus(600, 1))
    texts, y = corpus(200, 2)
    s = t.score_texts(p, texts)
    assert ((s >= 0.5) == y).mean() > 0.95 and ((s >= 0) & (s <= 1)).all()
    again = t.score_texts(p, [texts[5], b"", texts[5]])
    assert np.allclose(again[[0, 2]], s[5], atol=1e-6) and 0 <= again[1] < 0.5


def test_gradients():
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in t.start_parameters().items() if k not in ("word", "gram")}
    x, places = rng.standard_normal((6, t.DIMS)), rng.integers(0, 6, (4, t.WINDOW))
    x[-1] = 0
    weight = rng.standard_normal(4)
    loss = lambda: float((t.forward(p, x, places)[0].astype(float) * weight).sum())
    out, memo = t.forward(p, x, places, keep=True)
    g = t.backward(p, x, places, memo, weight)
    for name in ("in_f", "re_b", "new_f", "att", "att_v", "out", "bias_b"):
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        old, e = p[name][at], 1e-2
        p[name][at] = old + e
        up = loss()
        p[name][at] = old - e
        down = loss()
        p[name][at] = old
        assert abs((up - down) / (2 * e) - g[name][at]) < 2e-2 * max(1, abs(g[name][at])), name


def test_windows_cover_every_word():
    texts = [b"", b"a", b" ".join(b"w%d" % i for i in range(64)), b" ".join(b"w%d" % i for i in range(65)), b" ".join(b"w%d" % i for i in range(500))]
    for words in (t.Words(texts), t.Words.of(texts)):
        text, places = words.windows()
        assert np.bincount(text).tolist() == [1, 1, 1, 2, 15]
        for i in range(5):
            seen = set(places[text == i].ravel().tolist()) - {len(words.ids)}
            assert len(seen) == len(texts[i].split())


def test_query_shape_and_defined_cases(spark):
    texts, y = corpus(120, 4)
    docs = spark.createDataFrame([(i, x.decode(), 1) for i, x in enumerate(texts)] + [(500, None, 1), (501, "", 1), (None, "grobix", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(3, None), (7777, 1)], "doc_id long, toxic int")
    rows = t.toxicity(docs, t.fit(docs, labels)).collect()
    assert len(rows) == 123 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    by = {r.doc_id: r.score for r in rows}
    assert by[500] == by[501]
    assert {r.score for r in t.toxicity(docs, t.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert t.toxicity(docs.limit(0), t.fit(docs, labels)).count() == 0

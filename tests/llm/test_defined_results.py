"""Nulls, repeats, clashing columns, ties and very long texts: what each operator's docstring defines."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import adaptive_scan, line_alignment, matroska, merkle, mixing, ngram_join, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_nearest_with_one_id_twice(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)] + [(50, (x[0] + 1e-3).tolist(), 0), (100, (-x[100]).tolist(), 0)]
    got = adaptive_scan.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id int"), k=5, lists=4).collect()
    mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == 0)
    assert mine[0] == (1, 50) and {r for r, _ in mine} == {1, 2, 3, 4, 5}
    assert all(r.vec_id != 100 for r in got if r.query_id == 100)  # a query's own id is no candidate, whichever its vector


def test_media_columns_by_independent_sums(spark):
    rows = [(1, "héllo"), (None, "x" * 2000), (2, None), (2, "Ω" * 700)]
    docs = spark.createDataFrame([(*r, b"own", 3) for r in rows], "doc_id long, text string, media binary, n_bytes int")
    got = matroska.media_features(docs).collect()
    assert len(got) == 4
    for doc_id, text in rows:
        raw = (text or "").encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        (r,) = [r for r in got if r.doc_id == doc_id and r.n_bytes == len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        media = matroska.write_pcm(full)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_mix_with_nulls_long_texts_and_clashing_columns(spark):
    rows = [(i if i % 7 else None, f"s{i % 3}", "w " * (200_000 if i == 5 else i % 40), 1, 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, target int")
    got = mixing.entropy_mix(docs.select("doc_id", "source", "text")).collect()
    more = mixing.entropy_mix(docs).collect()
    key = lambda rs: Counter((r.doc_id, r.source, r.taken) for r in rs)
    assert len(got) == 200 and key(got) == key(more)
    assert sum(r.doc_id is None for r in got) == sum(i % 7 == 0 for i in range(200))


def test_audit_with_null_numbers_places_and_other_columns(spark):
    kinds = "record long, file long, start long, stop long, content binary, node int, digest_x string"
    rows = [(1, 0, 0, 3, b"abc", 0, "x"), (2, 0, None, 6, b"def", 0, "y"), (None, 0, 6, 9, b"ghi", 0, "z"), (3, None, 9, 12, None, 1, "q")]
    a = spark.createDataFrame(rows, kinds)
    assert merkle.audit(a, a).count() == 0
    b = a.withColumn("start", F.coalesce("start", F.lit(3)))
    assert [r.record for r in merkle.audit(a, b).collect()] == [2]
    assert {r.record for r in merkle.audit(a, a.where("record IS NOT NULL").limit(0)).collect()} == {1, 2, 3}


def test_toxicity_of_repeated_rows_and_long_texts(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["an", "the", "or", "in", "st"]) + rng.choice(["er", "ou", "al"]) for _ in range(n))
    rows = [(i, words(40) + (" grobix zlurp grobix" if i % 4 == 0 else "")) for i in range(120)]
    long = "an ther " * 200_000  # more than BLOCK bytes
    docs = spark.createDataFrame([*rows, rows[4], (900, long), (901, long)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 123 and len({r.score for r in got if r.doc_id == 4}) == 1
    by = {r.doc_id: r.score for r in got}
    assert by[900] == pytest.approx(by[901]) and 0 <= by[900] <= 1


def test_join_of_null_and_repeated_ids_and_long_texts(spark):
    long = " ".join(f"w{i % 5003}x{i % 97}" for i in range(120_000))
    rows = [(5, long), (9, long + " end"), (7, "a b c d e"), (7, "a b c d e"), (3, "p q r s")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    by = {r.doc_id: r.component_id for r in got}
    assert by[5] == by[9] == 5 and by[7] == 7 and by[3] == 3
    nulls = ngram_join.jaccard_components(spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in nulls if r.doc_id is not None} == by


def test_a_long_first_text_of_thousands(spark, monkeypatch):
    """Each later text holds one passage of the first: every part of the pairs gets the first text once."""
    monkeypatch.setattr(line_alignment, "PAIR_SHARE", 100)
    lines = [f"line {i} of the long text that all the later texts quote a passage of, word for word" for i in range(2000)]
    rows = [(0, "\n".join(lines))] + [(1 + i, f"own {i}\n" + "\n".join(lines[3 * (i % 600) : 3 * (i % 600) + 3]) + f"\nend {i}") for i in range(2500)]
    got = {r.doc_id: r for r in line_alignment.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and {got[i].n_removed for i in range(1, 2501)} == {3}
    assert all(got[1 + i].kept_sha256 == hashlib.sha256(f"own {i}\nend {i}".encode()).hexdigest() for i in range(2500))


@pytest.fixture(scope="module")
def labelled(tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    duckdb.sql(f"COPY (SELECT i AS doc_id, i % 2 AS toxic FROM range(40) t(i)) TO '{path}/labels.parquet'")
    return path


def test_pipeline_on_an_empty_table(spark, labelled):
    docs = spark.createDataFrame([], DOCS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(labelled))
        assert out.count() == 0 and (k == 4 or out.columns == docs.columns)


def test_mixing_stage_deals_copies_out_to_repeated_rows(spark, labelled):
    rows = [(1, "a b c d e", "en", "s0", 1)] * 3 + [(2, "f g h", "en", "s1", 1), (2, "other text of one id", "en", "s1", 1)] + [(10 + i, "w " * (i % 9), "de", f"s{i % 3}", 1) for i in range(60)]
    docs = spark.createDataFrame([(*r, 7, "y") for r in rows], DOCS + ", copies int, c0 string")
    out = corpus_pipeline.mixing_stage(spark, docs, str(labelled))
    assert out.columns == docs.columns
    taken = {r.doc_id: r.n for r in mixing.entropy_mix(docs, corpus_pipeline.WEIGHTS, corpus_pipeline.SHARE, corpus_pipeline.MOST).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()}
    made = Counter(r.doc_id for r in out.collect())
    assert all(made[i] == n for i, n in taken.items()) and set(made) <= set(taken)


def test_every_stage_keeps_clashing_columns(spark, labelled):
    rows = [(i, f"text number {i} with some words of its own {i * 7}", "en", "s", 1) for i in range(40)] + [(None, "no id", "en", "s", 1), (50, None, None, None, None)]
    docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], DOCS + ", score int, spans string, size double")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, str(labelled))
        assert out.columns == docs.columns, k
        assert {(r.score, r.spans, r.size) for r in out.collect()} <= {(1, "x", 2.0)}

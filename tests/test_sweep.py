import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import completion, trace
from tessera.plans import pipelines, sweep
from tessera.sources.store import IntegrityError

TEXTS = ["the quick brown fox jumps over the lazy dog", "a fast brown fox runs through the dark forest", "the lazy dog sleeps all day long", "machine learning models process text data"]
PLANS = ("naive", "hyde")


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = spark.createDataFrame([(i, f"n::{i}", None, t) for i, t in enumerate(TEXTS)], "id long, chunk_id string, heading string, text string")
    return pipelines.Corpus.of(chunks)


def questions(spark, n=3):
    rows = [(f"q{i}", TEXTS[i], "unanswerable" if i == 2 else "factual", [f"n::{i}"], ["fox"]) for i in range(n)]
    return spark.createDataFrame(rows, "id string, question string, type string, gold_chunk_ids array<string>, gold_answer_points array<string>")


def judge(reply='{"point_support": [true], "reads_as_appropriate_refusal": false, "reasoning": "so"}'):
    return [completion.from_column("judge", "m", lambda p: F.lit(reply))]


def test_a_sweep_goes_on_where_it_stopped(spark, corpus, tmp_path):
    path = str(tmp_path / "sweep")
    assert sweep.published(spark, path) is None
    assert sweep.resume(questions(spark, 2), corpus, path, judge(), PLANS) == 4
    assert sweep.resume(questions(spark, 2), corpus, path, judge(), PLANS) == 0
    assert sweep.resume(questions(spark, 3), corpus, path, judge(), PLANS) == 2
    rows = sweep.published(spark, path)
    by = {(r.architecture, r.question_id): r for r in rows.collect()}
    assert len(by) == 6 == rows.count()
    assert all(r.recall_at_5 == 1 and r.mrr_at_10 == 1 and r.faithfulness == 1 and r.judge_backend == "judge" for r in by.values())
    assert by["naive", "q2"].refusal_correctness is False and by["naive", "q0"].refusal_correctness is None
    assert by["hyde", "q0"].backend_calls == ["offline-extractive"] * 2
    report = str(tmp_path / "report")
    keys = spark.createDataFrame([(a, f"q{i}") for a in PLANS for i in range(3)], "architecture string, question_id string")
    sweep.write_report(rows, report, keys)
    told = [json.loads(x.value) for x in spark.read.text(report).collect()]
    assert {(r["architecture"], r.get("question_type")): r["n_questions"] for r in told} == {(a, t): n for a in PLANS for t, n in ((None, 3), ("factual", 2), ("unanswerable", 1))}
    for bad in (rows.where("question_id <> 'q1'"), rows.unionByName(rows.limit(1))):
        with pytest.raises(IntegrityError):
            sweep.write_report(bad, report, keys)
    assert [json.loads(x.value) for x in spark.read.text(report).collect()] == told


def test_a_sweep_that_fails_has_published_nothing(spark, corpus, tmp_path, monkeypatch):
    path = str(tmp_path / "sweep")
    sweep.resume(questions(spark, 1), corpus, path, judge(), PLANS)
    whole = pipelines.PIPELINES["hyde"]
    kinds = F.transform("nodes", lambda n: n.withField("kind", F.lit("strange")))
    monkeypatch.setitem(pipelines.PIPELINES, "hyde", lambda q, c: whole(q, c).withColumn("nodes", kinds.cast(f"array<{trace.NODE}>")))
    with pytest.raises(IntegrityError, match="unknown kind"):
        sweep.resume(questions(spark, 2), corpus, path, judge(), PLANS)
    assert {r.question_id for r in sweep.published(spark, path).collect()} == {"q0"}
    monkeypatch.setitem(pipelines.PIPELINES, "hyde", whole)
    assert sweep.resume(questions(spark, 2), corpus, path, judge("no JSON"), PLANS) == 2
    assert {r.faithfulness for r in sweep.published(spark, path).where("question_id = 'q1'").collect()} == {0.0}

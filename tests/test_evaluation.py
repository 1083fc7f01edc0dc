import math

from pyspark.sql import functions as F

from tessera.operators import evaluation as E


def test_metric_vectors(spark):
    rows = [(list("abc"), ["a"]), (list("abc"), ["a", "z"]), (list("abcdef"), ["f"]), (["z", "a", "b"], ["a", "b"]), (["z", "y"], ["a"]), (["z"] * 20 + ["a", "b"], ["a", "b"]), (["a"], [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r array<string>, g array<string>")
    r, g = F.col("r"), F.col("g")
    got = df.select("i", E.recall_at(r, g).alias("r5"), E.recall_full(r, g).alias("rf"), E.mrr_at(r, g).alias("mrr"), E.ndcg_at(r, g).alias("ndcg")).orderBy("i").collect()
    assert [x.r5 for x in got] == [1.0, 0.5, 0.0, 1.0, 0.0, 0.0, None]
    assert [x.rf for x in got] == [1.0, 0.5, 1.0, 1.0, 0.0, 1.0, None]
    assert [x.mrr for x in got][3:5] == [0.5, 0.0] and got[6].mrr is None and got[6].ndcg is None
    want = (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3))
    assert abs(got[3].ndcg - want) < 1e-12 and abs(want - 0.6934) < 1e-4 and got[0].ndcg == 1.0


def test_faithfulness_and_refusal(spark):
    row = spark.range(1).select(
        E.faithfulness(F.array(F.lit(True), F.lit(False), F.lit(True)), F.lit(2)).alias("cut"), E.faithfulness(F.array(F.lit(True)), F.lit(4)).alias("few"),
        E.faithfulness(F.lit(None).cast("array<boolean>"), F.lit(2)).alias("none"), E.faithfulness(F.array(F.lit(True)), F.lit(0)).alias("undefined"),
        E.refusal(F.lit("factual"), F.lit(True)).alias("f"), E.refusal(F.lit("unanswerable"), F.lit(False)).alias("u"),
    ).first()
    assert (row.cut, row.few, row.none, row.undefined, row.f, row.u) == (0.5, 0.25, 0.0, None, None, False)


def rows(spark):
    data = [("graph", "keyword", True), ("agentic", "keyword", True), ("agentic", "factual", False), ("naive", "keyword", False)]
    df = spark.createDataFrame(data, "architecture string, question_type string, graph_tool_involved boolean")
    return df.select("*", *(F.lit(0.5).alias(m) for m in E.MEASURES), F.lit(None).cast("boolean").alias("refusal_correctness"))


def test_report_has_notes_and_empty_cells(spark):
    got = {(r.architecture, r.question_type): r for r in E.full_report(rows(spark), ["keyword", "factual"]).collect()}
    assert len(got) == 21 and got["naive", "factual"].n_questions == 0 and got["naive", "factual"].rank_note == "no rows" and got["naive", "factual"].faithfulness is None
    assert got["graph", None].rank_note.startswith("NOT meaningful") and "1/2 rows" in got["agentic", None].rank_note and got["naive", None].rank_note.startswith("reliable")


def test_routing_accuracy(spark):
    df = spark.createDataFrame([("adaptive", "keyword", "hybrid"), ("adaptive", "keyword", "naive"), ("adaptive", "other", "naive"), ("naive", "keyword", None)], "architecture string, question_type string, adaptive_routed_to string")
    rubric = spark.createDataFrame([("keyword", ["hybrid"])], "question_type string, acceptable array<string>")
    r = E.routing_accuracy(df, rubric).first()
    assert (r.total, r.correct, r.accuracy) == (2, 1, 0.5)
    assert E.routing_accuracy(df.limit(0), rubric).first().accuracy is None


def test_consistency(spark):
    keys = "architecture string, question_id string"
    report = spark.createDataFrame([("naive", "q1", "t1", "a"), ("naive", "q2", "t2", "a"), ("naive", "old", "t3", "a")], f"{keys}, trace_id string, answer string")
    traces = spark.createDataFrame([("naive", "q1", "t1", "other"), ("naive", "old", "t3", "a")], f"{keys}, trace_id string, answer string")
    expected = spark.createDataFrame([("naive", "q1"), ("naive", "q2"), ("naive", "q3")], keys)
    assert {(r.question_id, r.problem) for r in E.consistency(report, traces, expected).collect()} == {("q3", "missing"), ("old", "stale"), ("q1", "answer differs"), ("q2", "missing trace")}

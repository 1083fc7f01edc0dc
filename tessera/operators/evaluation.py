"""Ranking metrics, evaluation rows and grouped reports. Undefined is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config


def _defined(gold: Column, value: Column) -> Column:
    return F.when(F.size(gold) > 0, value)


def recall_at(retrieved: Column, gold: Column, k: int = 5) -> Column:
    return _defined(gold, F.size(F.array_intersect(F.slice(retrieved, 1, k), gold)) / F.size(F.array_distinct(gold)))


def recall_full(retrieved: Column, gold: Column) -> Column:
    return _defined(gold, F.size(F.array_intersect(retrieved, gold)) / F.size(F.array_distinct(gold)))


def mrr_at(retrieved: Column, gold: Column, k: int = 10) -> Column:
    top = F.slice(retrieved, 1, k)
    hits = F.filter(F.transform(top, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda r: r.isNotNull())
    return _defined(gold, F.coalesce(F.lit(1.0) / F.array_min(hits), F.lit(0.0)))


def ndcg_at(retrieved: Column, gold: Column, k: int = 10) -> Column:
    gains = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(gold, x), F.lit(1.0) / F.log2(i + 2.0)).otherwise(0.0))
    ideal = F.transform(F.sequence(F.lit(1), F.least(F.size(gold), F.lit(k))), lambda i: F.lit(1.0) / F.log2(i + 1.0))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return _defined(gold, F.when(F.size(gold) > 0, add(gains) / add(ideal)))


def faithfulness(supported: Column, n_points: Column) -> Column:
    """Share of the gold points that are supported; judgements beyond their number don't count, and only true ones do."""
    hits = F.size(F.filter(F.slice(F.coalesce(supported, F.array().cast("array<boolean>")), 1, F.greatest(n_points, F.lit(1))), lambda x: F.coalesce(x, F.lit(False))))
    return F.when(n_points > 0, hits / n_points)


def refusal(question_type: Column, reads_as_refusal: Column) -> Column:
    return F.when(question_type == "unanswerable", reads_as_refusal)


def tone(score: Column) -> Column:
    return F.when(score >= config.TONE_GOOD, "good").when(score >= config.TONE_WARN, "warn").when(score.isNotNull(), "bad")


def rank_note(architecture: Column, involved: Column, n: Column) -> Column:
    """How far rank metrics can be trusted, given how many rows used the graph, whose chunks have no rank."""
    return (
        F.when(n == 0, "no rows")
        .when(architecture == "graph", "NOT meaningful: graph expansion returns an unranked set")
        .when(involved == 0, "reliable: no row used the graph")
        .otherwise(F.concat(F.lit("reduced meaning: the graph was involved in "), involved.cast("string"), F.lit("/"), n.cast("string"), F.lit(" rows")))
    )


MEASURES = ("recall_at_5", "mrr_at_10", "ndcg_at_10", "recall_full", "faithfulness", "latency_ms", "llm_calls", "prompt_tokens", "completion_tokens")


def _summary() -> list[Column]:
    means = [F.avg(m).alias(m) for m in MEASURES]
    refused = F.avg(F.when(F.col("question_type") == "unanswerable", F.col("refusal_correctness").cast("int"))).alias("refusal_rate")
    return [F.count("*").alias("n_questions"), *means, refused, F.count_if("graph_tool_involved").alias("involved")]


def report(rows: DataFrame) -> DataFrame:
    """(architecture, question_type, n_questions, means..., refusal_rate, rank_note): one pass over both levels; question_type is null for all."""
    out = rows.groupingSets([["architecture"], ["architecture", "question_type"]], "architecture", "question_type").agg(*_summary())
    return out.withColumn("rank_note", rank_note(F.col("architecture"), F.col("involved"), F.col("n_questions"))).drop("involved")


def full_report(rows: DataFrame, types: list[str], architectures: tuple[str, ...] = config.ARCHITECTURES) -> DataFrame:
    """report with a row for every cell, empty ones too."""
    spark = rows.sparkSession
    cells = spark.createDataFrame([(a, t) for a in architectures for t in [None, *types]], "architecture string, question_type string")
    r = report(rows)
    on = (cells.architecture == r.architecture) & cells.question_type.eqNullSafe(r.question_type)
    out = cells.join(r, on, "left").select(cells.architecture, cells.question_type, *(r[x] for x in r.columns if x not in ("architecture", "question_type")))
    return out.withColumn("n_questions", F.coalesce("n_questions", F.lit(0))).withColumn("rank_note", F.coalesce("rank_note", F.lit("no rows")))


def backend_mix(rows: DataFrame) -> DataFrame:
    """(architecture, backend, calls): calls of runs, and the judge's of each row."""
    calls = F.concat(F.coalesce("backend_calls", F.array().cast("array<string>")), F.filter(F.array("judge_backend"), lambda x: x.isNotNull()))
    return rows.select("architecture", F.explode(calls).alias("backend")).groupBy("architecture", "backend").agg(F.count("*").alias("calls"))


def routing_accuracy(rows: DataFrame, rubric: DataFrame) -> DataFrame:
    """(total, correct, accuracy) of adaptive rows. rubric(question_type, acceptable array); types without one don't count."""
    a = rows.where("architecture = 'adaptive' AND adaptive_routed_to IS NOT NULL").join(rubric, "question_type", "left")
    ok = F.array_contains("acceptable", F.col("adaptive_routed_to"))
    return a.agg(F.count(ok).alias("total"), F.count_if(ok).alias("correct"), F.avg(ok.cast("int")).alias("accuracy"))


def divergence(rows: DataFrame) -> DataFrame:
    """(question_id, chunk_id, architectures, rare): how many architectures found a chunk; rare if fewer than half of the question's."""
    n = rows.groupBy("question_id").agg(F.countDistinct("architecture").alias("of"))
    found = rows.select("question_id", "architecture", F.explode("retrieved_chunk_ids").alias("chunk_id")).distinct().groupBy("question_id", "chunk_id").agg(F.count("*").alias("architectures"))
    return found.join(n, "question_id").select("question_id", "chunk_id", "architectures", (2 * F.col("architectures") < F.col("of")).alias("rare"))


def faithfulness_spread(rows: DataFrame, gap: float = config.FAITHFULNESS_GAP) -> DataFrame:
    """(question_id, best, worst, spread) where two or more architectures differ by at least gap; ties to the earlier architecture."""
    order = F.array_position(F.array(*(F.lit(a) for a in config.ARCHITECTURES)), F.col("architecture"))
    f = F.col("faithfulness")
    g = rows.where(f.isNotNull()).groupBy("question_id").agg(F.count("*").alias("n"), F.max_by("architecture", F.struct(f, -order)).alias("best"), F.min_by("architecture", F.struct(f, order)).alias("worst"), (F.max(f) - F.min(f)).alias("spread"))
    return g.where((F.col("n") >= 2) & (F.round("spread", 9) >= gap)).drop("n")


def headline(rows: DataFrame) -> DataFrame:
    """(n_rows, n_architectures, n_questions): the latter by whole division, as every architecture answers each question."""
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("architecture").alias("n_architectures")).withColumn("n_questions", F.expr("n_rows div n_architectures"))


def consistency(report_rows: DataFrame, traces: DataFrame, expected: DataFrame) -> DataFrame:
    """(architecture, question_id, problem): what must stop a rewrite of a report: missing or stale keys, missing traces, traces of another id or answer."""
    from tessera.operators.ranking import missing_and_stale

    keys = ["architecture", "question_id"]
    t = traces.select(*keys, F.col("trace_id").alias("t_id"), F.col("answer").alias("t_answer"))
    joined = report_rows.select(*keys, "trace_id", "answer").join(t, keys, "left")
    problem = F.when(F.col("t_id").isNull(), "missing trace").when(~F.col("t_id").eqNullSafe(F.col("trace_id")), "trace id differs").when(~F.col("t_answer").eqNullSafe(F.col("answer")), "answer differs")
    return missing_and_stale(expected, report_rows, keys).unionByName(joined.select(*keys, problem.alias("problem")).where("problem IS NOT NULL"))


def last_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, as a later duplicate replaces an earlier one."""
    names = [x for x in rows.columns if x not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("r")).select(*keys, "r.*")

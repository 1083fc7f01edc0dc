"""An evaluation that goes on where it stopped: runs of all architectures on all questions, judged and measured.

Rows are published run by run: each ``resume`` works out the keys (architecture, question) that no
published run has, answers and judges these alone, checks what it made, writes it, and only then adds
its line to the list of published runs. A sweep that fails has published nothing, and one that is whole
does no work.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.operators import completion, evaluation, ranking, trace, views
from tessera.operators.lineage import cut
from tessera.plans.pipelines import PIPELINES, Corpus
from tessera.sources.store import IntegrityError

KEYS = ["architecture", "question_id"]


def numbered(questions: DataFrame) -> DataFrame:
    """(query_id, question_id, text, ...) of questions(id, question, type, gold_chunk_ids, gold_answer_points): numbers for the pipelines, from the ids' hashes."""
    number = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(9 * 10**17))  # sub-questions need ten times as many
    return questions.select(number.alias("query_id"), F.col("id").alias("question_id"), F.col("question").alias("text"), F.col("type").alias("question_type"), "gold_chunk_ids", "gold_answer_points")


def runs_of(questions: DataFrame, corpus: Corpus, architecture: str) -> DataFrame:
    """What eval_rows needs of each run, evidence from its trace; questions as ``numbered`` gives them."""
    made = cut(PIPELINES[architecture](questions.select("query_id", "text"), corpus))
    broken = trace.problems(trace.exploded(made), made)
    if bad := [f"{r.trace_id}: {r.problem}" for r in broken.limit(5).collect()]:
        raise IntegrityError("; ".join(sorted(bad)))
    found = trace.evidence(trace.exploded(made.dropDuplicates(["trace_id"])))  # equal questions have one trace
    rows = made.join(found.withColumnRenamed("chunk_ids", "retrieved_chunk_ids"), "trace_id").join(questions.select("query_id", "question_id"), "query_id")
    return rows.select(
        "architecture", "question_id", "question", "trace_id", "answer", "retrieved_chunk_ids", trace.uses_graph(F.col("nodes")).alias("graph_tool_involved"),
        F.aggregate("nodes", F.lit(0.0), lambda s, n: s + n["duration_ms"]).alias("latency_ms"), "llm_calls", "prompt_tokens", "completion_tokens",
        F.array_repeat(F.lit(corpus.completer.backend), F.col("llm_calls")).alias("backend_calls"), F.when(F.col("architecture") == "adaptive", trace.routed_to(F.col("nodes"))).alias("adaptive_routed_to"),
    )


def measured(questions: DataFrame, corpus: Corpus, architecture: str, judges: list[completion.Backend], cache: DataFrame | None = None) -> DataFrame:
    """The evaluation rows of one architecture on questions as ``numbered`` gives them."""
    runs = cut(runs_of(questions, corpus, architecture))
    judged = completion.judged(runs.join(questions.select("question_id", "gold_answer_points"), "question_id"), judges, cache)
    return views.eval_rows(runs, questions, judged)


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of published runs; None if there are none yet."""
    try:
        runs = [r.value for r in spark.read.text(f"{path}/published").collect()]  # a line for each resume
    except AnalysisException:
        return None
    return reduce(DataFrame.unionByName, (spark.read.parquet(f"{path}/rows/{r}") for r in sorted(runs)))


def faults(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(architecture, question_id, problem) of rows: missing, unexpected or twice."""
    twice = rows.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1").select(*KEYS, F.lit("twice").alias("problem"))
    return ranking.missing_and_stale(expected, rows, KEYS).unionByName(twice)


def resume(questions: DataFrame, corpus: Corpus, path: str, judges: list[completion.Backend], architectures: tuple[str, ...] = config.ARCHITECTURES, cache: DataFrame | None = None) -> int:
    """Makes and publishes the rows that are missing; their number."""
    spark = questions.sparkSession
    asked = cut(numbered(questions))
    wanted = views.expected_keys(asked, architectures)
    old = published(spark, path)
    left = cut(wanted if old is None else wanted.join(old.select(*KEYS), KEYS, "left_anti"))
    made = []
    for a in architectures:
        some = asked.join(left.where(F.col("architecture") == a).select("question_id"), "question_id", "left_semi")
        if some.limit(1).count():
            made.append(measured(cut(some), corpus, a, judges, cache))
    if not made:
        return 0
    run = f"run={uuid.uuid4().hex}"
    reduce(DataFrame.unionByName, made).write.parquet(f"{path}/rows/{run}")
    new = spark.read.parquet(f"{path}/rows/{run}")
    if bad := [f"{r.architecture}, {r.question_id}: {r.problem}" for r in faults(new, left).limit(5).collect()]:
        raise IntegrityError("; ".join(sorted(bad)))
    spark.createDataFrame([(run,)], "value string").coalesce(1).write.mode("append").text(f"{path}/published")
    return new.count()


def write_report(rows: DataFrame, path: str, expected: DataFrame) -> None:
    """The report of whole rows as JSON; rows with a fault leave the old report as it is."""
    if bad := [f"{r.architecture}, {r.question_id}: {r.problem}" for r in faults(rows, expected).limit(5).collect()]:
        raise IntegrityError("; ".join(sorted(bad)))
    evaluation.report(rows).coalesce(1).write.mode("overwrite").json(path)  # a row for each architecture and type

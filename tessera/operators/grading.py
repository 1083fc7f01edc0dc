"""Verdicts: repair, lexical grades, the filter that never leaves nothing, and the correction rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import text as T

VERDICTS = ("correct", "ambiguous", "incorrect")


def lexical_overlap(query: Column, passage: Column) -> Column:
    """Share of the query's token set that the passage holds; null without query tokens."""
    q = T.token_set(query)
    return F.size(F.array_intersect(q, T.token_set(passage))) / F.nullif(F.size(q), F.lit(0))


def lexical_verdict(overlap: Column) -> Column:
    share = F.coalesce(overlap, F.lit(0.0))
    return F.when(share >= config.GRADE_CORRECT_FROM, "correct").when(share > 0, "ambiguous").otherwise("incorrect")


def repaired(retrieved: DataFrame, judgements: DataFrame, keys: list[str]) -> DataFrame:
    """retrieved with (verdict, reason): unknown ids fall away, the last duplicate wins, bad or missing verdicts are ambiguous.

    retrieved(keys..., id, ...), judgements(keys..., pos, id, verdict, reason).
    """
    last = judgements.groupBy(*keys, "id").agg(F.max_by(F.struct("verdict", "reason"), "pos").alias("j"))
    verdict = F.when(F.col("j.verdict").isin(*VERDICTS), F.col("j.verdict")).otherwise("ambiguous")
    return retrieved.join(last, [*keys, "id"], "left").withColumn("verdict", verdict).withColumn("reason", F.coalesce("j.reason", F.lit(""))).drop("j")


def survivors(graded: DataFrame, keys: list[str]) -> DataFrame:
    """Drops the incorrect, unless a group would be left with nothing: then it stays whole."""
    kept = F.count_if(F.col("verdict") != "incorrect").over(Window.partitionBy(*keys))
    return graded.withColumn("__kept", kept).where((F.col("verdict") != "incorrect") | (F.col("__kept") == 0)).drop("__kept")


def decision(graded: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict counts of each group, and whether retrieval may stop: no more incorrect than correct."""
    counts = graded.groupBy(*keys).agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))
    return counts.withColumn("stop", F.col("incorrect") <= F.col("correct"))

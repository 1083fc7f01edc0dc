"""Ranked lists: ranks, fusion, cuts, ordered de-duplication and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import config


def ranked(rows: DataFrame, keys: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """1-based places; no two rows share one, so the order must be total to be stable."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_n(rows: DataFrame, keys: list[str], n: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first n of each group (a group-limited window, which cuts before the shuffle)."""
    return ranked(rows, keys, *order, name=name).where(F.col(name) <= n)


def fuse(lists: DataFrame, k: int = config.RRF_K, pool: int | None = config.POOL_K, digits: int = 12) -> DataFrame:
    """Reciprocal rank fusion: (query_id, id, score, rank).

    lists(query_id, list_no, id, rank). A score sums 1 / (k + rank) over the lists; ties go by first
    appearance, list by list.
    """
    seen = F.min(F.struct("list_no", "rank"))
    fused = lists.groupBy("query_id", "id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), digits).alias("score"), seen.alias("seen"))
    out = ranked(fused, ["query_id"], F.desc("score"), F.col("seen"), F.col("id"))
    return (out if pool is None else out.where(F.col("rank") <= pool)).select("query_id", "id", "score", "rank")


def rerank(scored: DataFrame, k: int = config.TOP_K) -> DataFrame:
    """The k best by ``rerank_score``, ties by the incoming rank. scored(query_id, id, rank, rerank_score)."""
    return first_n(scored, ["query_id"], k, F.desc("rerank_score"), F.col("rank"), name="new_rank").select("query_id", "id", "rerank_score", F.col("rank").alias("old_rank"), F.col("new_rank").alias("rank"))


def first_wins(rows: DataFrame, keys: list[str], value: str, *order: Column) -> DataFrame:
    """The first row of each value within each group."""
    return first_n(rows, [*keys, value], 1, *order, name="__n").drop("__n")


def take_distinct(rows: DataFrame, keys: list[str], value: str, n: int, *order: Column) -> DataFrame:
    """The first n distinct values of each group, in order, with their place in ``rank``."""
    return first_n(first_wins(rows, keys, value, *order), keys, n, *order)


def last_attempt(rows: DataFrame, keys: list[str], attempt: str = "attempt") -> DataFrame:
    """All rows of each group's last attempt."""
    last = F.max(attempt).over(Window.partitionBy(*keys))
    return rows.withColumn("__last", last).where(F.col(attempt) == F.col("__last")).drop("__last")


def missing_and_stale(expected: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with ``problem``: missing or stale."""
    e, h = expected.select(*keys).distinct(), have.select(*keys).distinct()
    return e.join(h, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(h.join(e, keys, "left_anti").withColumn("problem", F.lit("stale")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those that share its keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ``same``, whether the two hold the same set of rows."""
    off = a.subtract(b).union(b.subtract(a))
    return off.agg((F.count("*") == 0).alias("same"))


def nulls_last(name: str, ascending: bool = True) -> Column:
    return F.col(name).asc_nulls_last() if ascending else F.col(name).desc_nulls_last()

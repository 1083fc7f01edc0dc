"""Mixing sources to target weights by entropy balancing.

Among all document rates it takes those nearest to 1 in relative entropy whose words come to each
source's target, with rates up to ``most``. The dual is convex with one multiplier per source:
rate = min(most, exp(multiplier * size / mean size)). Newton iterations solve it for all sources at
once; each is one distributed aggregate over the counts of (source, size), and a bracket that
bisection falls back on makes every step safe. Sums are exact decimals, so reruns agree.

Rates become whole copies by carrying each source's error in words from its largest size to its
smallest: what a long document leaves over, short ones make up. Copies of one size differ by one at
most; documents of a size are numbered in blocks of bounded rows, so that a size that a third of all
documents share is no hot task.

Defined results: null and empty texts have size 0 and are taken 0 times; a null source is a source of
its own, after all others; equal rows are dealt copies like different rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as c

#: Documents of one (source, size) that are numbered together.
NUMBERED = 4096
_EXACT = "decimal(38,9)"


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size is the number of words ``[^\\x20\\x09-\\x0D]+``."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, size = c.as_bytes(c.column(b, "text")), []
            for i, j in c.blocks(texts):
                size.append(np.diff(c.Block(texts[i:j]).words()[2]))
            yield c.record_batch(schema, c.column(b, "doc_id"), c.column(b, "source"), np.concatenate(size) if size else [])

    return docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(c.tidied(run), "doc_id long, source string, size long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(sid, source, source_size, docs, target): words by weight, cut at most times a source's size, the excess reshared by weight.

    The cut-and-reshare rule ends at target = min(most * size, weight * level) with one level for all:
    sources in the order of most * size / weight are cut up to the first that its level reaches. Both
    windows order one row per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("docs"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int") + 1))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size"))
    w = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("left", F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(w), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(w), F.lit(0.0))))
    level = F.max(F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.col("level"))).over(every)
    # the level grows along the order while sources are cut, and falls from the first that isn't
    return s.select("sid", "source", "source_size", "docs", F.least("cap", F.coalesce(F.col("weight") * level, "cap")).alias("target"))


def newton(counts: DataFrame, targets: DataFrame, most: float = 2.0, rounds: int = 60, near: float = 1e-9) -> DataFrame:
    """(sid, multiplier): the dual's solution; null where the target is all that the source can give.

    counts(sid, size, n). One number reaches the driver in each round.
    """
    mean = F.col("source_size") / F.col("docs")
    state = targets.where("docs > 0").select(
        "sid", "target", mean.alias("mean"), (F.col("target") >= F.lit(most) * F.col("source_size") * (1 - 1e-12)).alias("all"),
        F.lit(0.0).alias("x"), (F.lit(-700.0) * mean).alias("low"), (F.lit(float(np.log(most)) + 1e-6) * mean).alias("high"),
    )
    state = c.checkpoint(state)
    for _ in range(rounds):
        rows = counts.join(state.where("NOT all").select("sid", "x", "mean"), "sid")
        z = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(most)), F.exp(F.col("x") * z))
        words = F.col("n") * F.col("size")
        sums = rows.groupBy("sid").agg(
            F.sum((words * rate).cast(_EXACT)).cast("double").alias("got"),
            F.sum(F.when(rate < most, words * rate * z).otherwise(0.0).cast(_EXACT)).cast("double").alias("slope"),
        )
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, F.col("x")).otherwise(F.col("low")), F.when(gap > 0, F.col("x")).otherwise(F.col("high"))
        step = F.col("x") - F.try_divide(gap, F.col("slope"))
        inside = F.coalesce((step > low) & (step < high), F.lit(False))
        done = F.coalesce(F.abs(gap) <= near * F.col("target"), F.lit(True))
        state = c.checkpoint(
            state.join(sums, "sid", "left").select(
                "sid", "target", "mean", "all", F.when(done, F.col("x")).when(inside, step).otherwise((low + high) / 2).alias("x"),
                F.when(done, F.col("low")).otherwise(low).alias("low"), F.when(done, F.col("high")).otherwise(high).alias("high"), done.alias("done"),
            )
        )
        if not state.where("NOT done").limit(1).count():
            break
        state = state.drop("done")
    return state.select("sid", F.when(F.col("all"), F.lit(None)).otherwise(F.col("x") / F.col("mean")).cast("double").alias("multiplier"))


def _round(rated: DataFrame, most: float) -> DataFrame:
    """(sid, size, n, copies): whole copies of all documents of a size, each source's error carried from its largest size down.

    A group has a row for each distinct size of a source, however many documents there are.
    """
    schema = pa.schema([("sid", pa.int32()), ("size", pa.int64()), ("n", pa.int64()), ("copies", pa.int64())])

    def run(group):
        g = sorted(zip(*(group.column(x).to_pylist() for x in ("size", "n", "rate", "sid")), strict=True), reverse=True)
        out, owed = [], 0.0
        for size, n, rate, sid in g:
            owed += size * n * rate
            k = min(max(round(owed / size), 0), int(most) * n)
            owed -= size * k
            out.append((sid, size, n, k))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return rated.select("sid", "size", "n", "rate").groupBy("sid").applyInArrow(run, "sid int, size long, n long, copies long")


def entropy_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of each document.

    docs(doc_id, source, text). weights repeat along the sources in code point order, null last; the
    mix has share times all words; no document is taken more than most (a whole number) times.
    """
    sizes = c.checkpoint(document_sizes(docs))
    targets = c.checkpoint(source_targets(sizes, weights, share, most))
    near = targets.select("sid", "source", "source_size", "target")
    placed = sizes.join(near, sizes.source.eqNullSafe(near.source)).select("doc_id", sizes.source.alias("source"), "size", "sid", "source_size", "target")
    counts = c.checkpoint(placed.where("size > 0").groupBy("sid", "size").agg(F.count("*").alias("n")))
    solved = newton(counts, targets, most)
    rate = F.when(F.col("multiplier").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.col("multiplier") * F.col("size"))))
    copies = c.checkpoint(_round(counts.join(solved, "sid").withColumn("rate", rate), most))
    some = placed.where("size > 0").join(copies, ["sid", "size"])
    some = some.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / NUMBERED)).cast("int"))
    before = some.where(F.col("n") > NUMBERED).groupBy("sid", "size", "bucket").agg(F.count("*").alias("k"))
    w = Window.partitionBy("sid", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("sid", "size", "bucket", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("before"))
    # the place among the documents of a size: of those in earlier buckets, then by doc_id within the bucket
    place = F.row_number().over(Window.partitionBy("sid", "size", "bucket").orderBy("doc_id")) - 1
    numbered = some.withColumn("place", place).join(before, ["sid", "size", "bucket"], "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0)))
    own = F.expr("((place + 1) * copies) div n - (place * copies) div n")
    names = ["doc_id", "source", "size", "source_size", "target"]
    taken = numbered.select(*names, own.alias("copies"))
    none = placed.where("size = 0").select(*names, F.lit(0).cast("long").alias("copies"))
    return taken.unionByName(none).withColumn("taken", F.col("copies") * F.col("size"))

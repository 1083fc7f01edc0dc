"""Streams (an extension): documents into postings as they arrive, and windowed latency of traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import text as T
from tessera.operators import sparse


def index_stream(documents: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends postings and lengths of a stream of (doc_id, text); a batch that is replayed overwrites its own files."""

    def write(batch: DataFrame, number: int) -> None:
        built = sparse.postings(batch)
        built.write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        batch.select("doc_id", F.size(T.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("dl")).write.mode("overwrite").parquet(f"{folder}/lengths/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latency_windows(runs: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, architecture, runs, mean_ms, max_ms) of runs(ts, architecture, latency_ms), streaming or not."""
    return runs.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "architecture").agg(F.count("*").alias("runs"), F.avg("latency_ms").alias("mean_ms"), F.max("latency_ms").alias("max_ms")).select(F.col("w.start").alias("start"), "architecture", "runs", "mean_ms", "max_ms")

"""Exact dense retrieval: inner products of queries with every vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.operators.lineage import stored

#: Rows of a tile, of vectors or queries, and queries of one matrix product.
TILE, PRODUCT = 4096, 512


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Of length 1; zero vectors stay."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: (x / F.when(norm == 0, 1.0).otherwise(norm)).cast("float"))


def top_k(vectors: DataFrame, query: list[float], k: int = config.TOP_K, digits: int = config.SCORE_DIGITS) -> DataFrame:
    """(id, score, rank) for one query; the limit is pushed into every task."""
    score = F.round(dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))), digits)
    best = vectors.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(max(k, 0))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # k rows


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, v) as tiles of TILE rows at most: (ids, cells), the vectors end to end."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("cells", pa.list_(pa.float64()))])
    for b in batches:
        for i in range(0, b.num_rows, TILE):
            part = b.slice(i, TILE)
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy()], schema.field(0).type), pa.array([part.column(1).flatten().to_numpy(zero_copy_only=False)], schema.field(1).type)], schema=schema)


def search(vectors: DataFrame, queries: DataFrame, k: int = config.TOP_K, digits: int = config.SCORE_DIGITS) -> DataFrame:
    """(query_id, id, score, rank): the k best vectors of each query, ties by id.

    vectors(id long, embedding), queries(query_id long, embedding). Both sides become tiles of TILE rows:
    vectors where they lie, queries by hash. A tile of vectors meets each tile of queries in an equi-join
    on the latter's number, which moves no vectors as long as all tiles of queries are small enough for
    Spark to send them around, and shuffles tiles beyond; a meeting is one matrix product, of which k rows
    for each query go on to the cut. It is one plan, whatever the number of queries, and only their count
    reaches the driver.
    """
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    many = max(1, -(-asked.count() // TILE))
    groups = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(many)).cast("int").alias("tile")).agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))  # about TILE rows
    asked_tiles = stored(groups.select("tile", F.col("asked.query_id").alias("query_ids"), F.flatten("asked.v").alias("query_cells")), "queries")
    own = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    tiles = own.mapInArrow(_tiled, "ids array<long>, cells array<double>").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                query_ids, q, ids, v = (b.column(x)[i].values.to_numpy(zero_copy_only=False) for x in ("query_ids", "query_cells", "ids", "cells"))
                q, v = q.reshape(len(query_ids), -1), v.reshape(len(ids), -1)
                for j in range(0, len(query_ids), PRODUCT):
                    s = np.round(q[j : j + PRODUCT] @ v.T, digits)
                    if k < s.shape[1]:  # all that reach the k-th best; of ties there may be more
                        edge = np.partition(s, -k, axis=1)[:, -k] if k > 0 else np.full(len(s), np.inf)
                        at, place = np.nonzero(s >= edge[:, None])
                    else:
                        at, place = np.nonzero(np.ones(s.shape, bool))
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[j + at]), pa.array(ids[place]), pa.array(s[at, place])], schema=schema)

    out = tiles.join(asked_tiles, "tile").select("query_ids", "query_cells", "ids", "cells").mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

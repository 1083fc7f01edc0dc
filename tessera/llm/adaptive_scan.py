"""Approximate nearest neighbours: adaptive dimension scan within the probed lists of an inverted file.

All vectors are rotated by one random orthogonal matrix and kept in blocks of columns. A candidate's
distance is summed block by block; after d of D columns the partial sum, scaled by D / d, estimates
the whole, and a candidate is abandoned once the hypothesis that it lies within the query's current
k-th distance is rejected: scaled partial distance > k-th distance * (1 + epsilon / sqrt(d)).
What survives is measured exactly, in double precision, on the original vectors.

The lists' centres are fitted on at most SAMPLE vectors, the ones of least hash; every vector is
indexed. How many lists a query looks into is measured on the sample: as many as hold the share
``recall`` of the k nearest others of ASKED of its vectors that the centres weren't fitted on. The k-th distance among the sampled vectors of a query's probed lists is the bound that it
starts with; results come from the scan alone. Queries for which it finds fewer than k are asked again,
in all lists and without abandoning, so that none finds fewer than k where there are k. Each (list,
share of the list, share of its queries) is one unit of work of bounded rows: a list that holds a third
of all vectors is many units.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; equal distances go by smaller vec_id; a repeated vec_id is one candidate for
each different vector, and never its own query's; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as c

SAMPLE = 16384
#: Vectors of the sample that measure how many lists to probe.
ASKED = 256
COLUMNS = 16
#: Candidates and queries of one unit of work; queries that are scanned at once.
LIST_SHARE = 16384
QUERY_SHARE = 1024
AT_ONCE = 64


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, in double precision."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def fit_centres(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's iterations from the first vectors of the sample."""
    centres = sample[:lists].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * sample @ centres.T, 1)
        count = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def probes_needed(sample: np.ndarray, ids: np.ndarray, centres: np.ndarray, asked: int, k: int, recall: float) -> int:
    """The least number of nearest lists that holds the share recall of the k nearest others, in the sample, of its first asked vectors."""
    norm = (sample**2).sum(1)
    member = np.argmin((centres**2).sum(1) - 2 * sample @ centres.T, 1)
    needed = []
    for at in range(0, asked, AT_ONCE):
        q = sample[at : min(at + AT_ONCE, asked)]
        d = norm - 2 * q @ sample.T
        d[ids[at : at + len(q), None] == ids] = np.inf
        near = np.argpartition(d, min(k, len(sample)) - 1, 1)[:, :k]
        order = np.argsort((centres**2).sum(1) - 2 * q @ centres.T, 1, kind="stable")
        place = np.argsort(order, 1)
        needed.append(np.take_along_axis(place, member[near], 1)[np.isfinite(np.take_along_axis(d, near, 1))])
    needed = np.sort(np.concatenate(needed)) if needed else np.zeros(0, int)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else len(centres)


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def scan(queries: np.ndarray, kth: np.ndarray, columns: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) indices that no test rejects. queries and columns: rotated; kth: squared distances."""
    dims = queries.shape[1]
    step = min(COLUMNS, dims)
    single = 1e-5 * (np.einsum("ij,ij->i", queries, queries) + kth)  # what sums in single precision may be off
    bound = lambda d: kth * (1 + epsilon / np.sqrt(d)) ** 2 + single if np.isfinite(epsilon) else np.full(len(kth), np.inf)
    b, q = columns[:, :step], queries[:, :step]
    partial = np.maximum((q * q).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * q @ b.T, 0)
    i, j = np.nonzero(partial * (dims / step) <= bound(step)[:, None])
    partial = partial[i, j]
    for s in range(step, dims, COLUMNS):
        e = min(s + COLUMNS, dims)
        d = columns[j, s:e] - queries[i, s:e]
        partial = partial + np.einsum("ij,ij->i", d, d)
        most = bound(e) if e < dims else kth * (1 + 1e-3) + single  # the last sum is whole
        keep = partial * (dims / e) <= most[i]
        i, j, partial = i[keep], j[keep], partial[keep]
    return i, j


def _best(q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k least (distance, id) of each query, one per id and query."""
    order = np.lexsort((ids, d, q))
    first = np.concatenate(([True], np.diff(q[order]) != 0)) if len(order) else np.zeros(0, bool)
    again = np.zeros(len(order), bool)
    again[1:] = ~first[1:] & (ids[order][1:] == ids[order][:-1])
    order, first = order[~again], first[~again]
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_UNIT = "list int, share int, qshare int, role int, vec_id long, kth double, raw binary, columns binary"


def nearest(vectors: DataFrame, query_rule: str = "vec_id % 100 = 0", k: int = 10, lists: int = 128, recall: float = 0.96, epsilon: float = 2.1, again: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector that query_rule selects its k nearest others found, by Euclidean distance.

    vectors(vec_id, embedding). recall: the share of the sample's nearest that the probed lists must hold; 1 probes what the sample needs at most.
    again: ask those that find fewer than k again; False leaves what the scan found.
    """
    spark = vectors.sparkSession
    sc, parts = spark.sparkContext, c.shuffle_partitions(spark)
    every = usable(vectors)
    most = every.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if most is None:
        return spark.createDataFrame([], schema)
    dims = most.d
    every = every.where(F.size("v") == dims)
    got = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()  # SAMPLE rows at most
    sample_ids = got.column("vec_id").to_numpy()
    sample = np.array(got.column("v").combine_chunks().flatten()).reshape(-1, dims)
    lists = max(1, min(lists, len(sample) // 32))
    asked = min(ASKED, len(sample) // 4)
    centres = fit_centres(sample[asked:], lists)
    turn = rotation(dims).astype(np.float32)
    model = sc.broadcast((centres, turn, sample_ids, sample))  # SAMPLE and as many centres as lists, whatever the input

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, turn, *_ = model.value
        for b in batches:
            v = np.array(c.column(b, "v").flatten()).reshape(-1, dims)
            own = np.argmin((centres**2).sum(1) - 2 * v @ centres.T, 1).astype(np.int32)
            turned = v.astype(np.float32) @ turn
            yield pa.RecordBatch.from_arrays([pa.array(own), c.column(b, "vec_id"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in turned], pa.binary())], ["list", "vec_id", "raw", "columns"])

    indexed = c.checkpoint(every.mapInArrow(c.tidied(placed), "list int, vec_id long, raw binary, columns binary"))
    sizes = dict(indexed.groupBy("list").count().collect())  # one row per list
    count = np.array([sizes.get(i, 0) for i in range(lists)])
    probes = probes_needed(sample, sample_ids, centres, asked, k, recall)

    def asking(queries: DataFrame, probes: int) -> DataFrame:
        def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, _, sample_ids, sample = model.value
            member = np.argmin((centres**2).sum(1) - 2 * sample @ centres.T, 1)
            for b in batches:
                rows = []
                for i, raw, columns in zip(*(c.column(b, x).to_pylist() for x in ("vec_id", "raw", "columns")), strict=True):
                    v = np.frombuffer(raw)
                    order = np.argsort(((centres - v) ** 2).sum(1), kind="stable")
                    n = max(probes, int(np.searchsorted(np.cumsum(count[order]), k + 1)) + 1)  # at least k candidates but for the query's own
                    to = order[:n]
                    near = np.flatnonzero(np.isin(member, to) & (sample_ids != i))
                    d = ((sample[near] - v) ** 2).sum(1)
                    d = d[np.unique(sample_ids[near], return_index=True)[1]] if len(near) else d
                    kth = np.partition(d, k - 1)[k - 1] if len(d) >= k else np.inf
                    rows += [(int(t), i, float(kth), raw, columns) for t in to if count[t]]
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary()), strict=True)], ["list", "vec_id", "kth", "raw", "columns"])

        return c.checkpoint(queries.mapInArrow(c.tidied(probing), "list int, vec_id long, kth double, raw binary, columns binary"))

    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")

    def scanned(asked: DataFrame, epsilon: float) -> DataFrame:
        asked_n = dict(asked.groupBy("list").count().collect())  # one row per list
        shares = F.create_map(*(F.lit(x) for i in range(lists) for x in (i, max(1, -(-int(count[i]) // LIST_SHARE)))))
        qshares = F.create_map(*(F.lit(x) for i in range(lists) for x in (i, max(1, -(-asked_n.get(i, 0) // QUERY_SHARE)))))
        candidates = indexed.where(F.col("list").isin([int(x) for x in asked_n])).select("list", part(shares[F.col("list")]).alias("share"), upto(qshares[F.col("list")]).alias("qshare"), F.lit(1).alias("role"), "vec_id", F.lit(None).cast("double").alias("kth"), "raw", "columns")
        queries = asked.select("list", upto(shares[F.col("list")]).alias("share"), part(qshares[F.col("list")]).alias("qshare"), F.lit(0).alias("role"), "vec_id", "kth", "raw", "columns")
        units = candidates.unionByName(queries).repartition(parts, "list", "share", "qshare").sortWithinPartitions("list", "share", "qshare", "role")
        return units.mapInArrow(lambda batches: work(batches, epsilon), "query_id long, vec_id long, score double")

    def work(batches: Iterator[pa.RecordBatch], epsilon: float) -> Iterator[pa.RecordBatch]:
        unit, waiting = None, []
        held: list[np.ndarray] = []
        for b in batches:
            keys = np.stack([c.column(b, x).to_numpy() for x in ("list", "share", "qshare", "role")], 1)
            edge = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))).tolist() + [len(keys)]
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                ids = c.column(b, "vec_id").to_numpy()[s:e]
                raw = np.frombuffer(b"".join(c.column(b, "raw").slice(s, e - s).to_pylist())).reshape(-1, dims)
                columns = np.frombuffer(b"".join(c.column(b, "columns").slice(s, e - s).to_pylist()), np.float32).reshape(-1, dims)
                if tuple(keys[s, :3]) != unit:
                    if held:
                        yield c.record_batch(_FOUND, *held)
                    unit, waiting, held = tuple(keys[s, :3]), [], []
                if keys[s, 3] == 0:
                    waiting.append((ids, c.column(b, "kth").to_numpy(zero_copy_only=False)[s:e], raw, columns))
                elif waiting:
                    if len(waiting) > 1 or held == []:
                        qid, kth, qraw, qcol = (np.concatenate(x) for x in zip(*waiting, strict=True))
                        waiting = [(qid, kth, qraw, qcol)]
                    for at in range(0, len(qid), AT_ONCE):
                        to = slice(at, at + AT_ONCE)
                        i, j = scan(qcol[to], kth[to], columns, epsilon)
                        other = qid[to][i] != ids[j]
                        i, j = i[other] + at, j[other]
                        d = qraw[i] - raw[j]
                        d = np.einsum("ij,ij->i", d, d)
                        kept = _best(i, ids[j], d, k)
                        i, j, d = i[kept], j[kept], d[kept]
                        new = [qid[i], ids[j], np.sqrt(d)]
                        held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
                        tenth = np.flatnonzero(np.diff(i, append=-1) != 0)
                        n = np.diff(np.concatenate(([-1], tenth)))
                        full = tenth[n == k]
                        kth[i[full]] = np.minimum(kth[i[full]], d[full])
        if held:
            yield c.record_batch(_FOUND, *held)

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = lambda found: found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    queries = indexed.where(query_rule)
    first = c.checkpoint(ranked(scanned(asking(queries, probes), epsilon)))
    if not again:
        return first
    whole = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = c.checkpoint(queries.join(whole, "vec_id", "left_anti").select(*queries.columns))
    if not short.limit(1).count():
        return first
    second = ranked(scanned(asking(short, lists), float("inf")))
    return first.join(whole.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(second)

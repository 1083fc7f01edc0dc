"""Helpers that the training-data operators share: tables, checkpoints, byte kernels, blooms.

Byte kernels work on whole batches of texts laid end to end in one ``uint8`` array, so that the cost
per document is a few array slices rather than a Python loop over words.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one kernel call takes at most, if no single text is longer.
BLOCK = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, and 5 mod 8: of full order
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.RandomState(20240229).randint(1, 1 << 63, 256).astype(U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables: dict[str, np.ndarray] = {"pow": np.ones(1, U), "inv": np.ones(1, U)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame, rows_per_batch: int | None = None) -> DataFrame:
    """Cut lineage reliably: into the folder of spark.checkpoint.dir; in local mode, where it may be unset, into a temporary one.

    rows_per_batch: rows that go to a Python worker at once, where rows are wide.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    if rows_per_batch is None:
        return df.checkpoint(eager=True)
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows_per_batch))
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the checkpoints, where driver and executors can reach it."""
    checkpoint(spark.range(1))  # makes sure that there is a checkpoint folder
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """df, written as Parquet and read again: its size is known to the planner, and lost tasks don't reach behind it."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of ids and labels that one task holds at least, where a table is small.
SMALL = 100_000


def tasks_for(df: DataFrame, rows: int = SMALL) -> int:
    """Tasks that a table of a few columns needs: by its rows, not by the cluster's partitions."""
    return min(max(1, -(-df.count() // rows)), shuffle_partitions(df.sparkSession))


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives freed memory back: idle workers of earlier stages stay beside those of the next."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _tables.update(pow=np.ones(1, U), inv=np.ones(1, U))  # as long as the longest text; soon made again
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can't trim
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidy


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0..n-1 modulo 2**64, and their inverses."""
    if len(_tables["pow"]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for key, b in (("pow", _BASE), ("inv", _INV)):
            out = np.full(size, b, U)
            out[0] = 1
            _tables[key] = np.multiply.accumulate(out)
    return _tables["pow"], _tables["inv"]


class Block:
    """Some texts end to end, each followed by a newline.

    data: the bytes; start, end: of each text; prefix: polynomial prefix hashes, so that the hash of
    bytes [s, e) is ``(prefix[e] - prefix[s]) * inverse_power[s]``.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        self._prefix: np.ndarray | None = None

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            p, _ = powers(len(self.data) + 1)
            h = np.empty(len(self.data) + 1, U)
            h[0] = 0
            np.cumsum(_BYTE[self.data] * p[: len(self.data)], out=h[1:])
            self._prefix = h
        return self._prefix

    def hashes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        _, inv = powers(len(self.data) + 1)
        return mix((self.prefix[e] - self.prefix[s]) * inv[s] + (e - s).astype(U))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each text the index of its first word (one more at the end)."""
        space = _SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        s, e = edge[::2], edge[1::2]
        return s, e, np.concatenate((np.searchsorted(s, self.start), [len(s)]))


def blocks(texts: list[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that together have at most limit bytes, or one text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def spans(batch: Iterable[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    """The named columns of all batches as arrays; a whole partition, whose size the caller bounds."""
    cols: list[list[np.ndarray]] = [[] for _ in names]
    for b in batch:
        for c, n in zip(cols, names, strict=True):
            c.append(column(b, n).to_numpy(zero_copy_only=False))
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]


#: Words of 64 bits in a member filter: at least and at most (16 MB), whatever the data's size.
FILTER_LEAST, FILTER_MOST = 1 << 10, 1 << 21


def row_key(doc_id: str = "doc_id", text: str = "text") -> F.Column:
    """With doc_id it tells rows apart by their contents: null ids, and texts that share an id."""
    return F.xxhash64(doc_id, text)


def member_filter(ids: DataFrame, cols: list[str]) -> np.ndarray:
    """A bitmap that has the bit of each row of ids; others' bits may be set too.

    It has 16 bits or more for each id, up to FILTER_MOST words, which bounds what reaches the driver,
    however many ids there are. Its users join afterwards, so a full filter only costs time.
    """
    n = ids.count()
    words = min(max(1 << max(n // 4, 1).bit_length(), FILTER_LEAST), FILTER_MOST)
    rows = ids.select(_slot(cols, words).alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 AS INT)))").alias("b"))
    out = np.zeros(words, np.int64)
    got = rows.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out


def _slot(cols: list[str], words: int) -> F.Column:
    return F.pmod(F.xxhash64(*(F.col(x).cast("long") for x in cols)), F.lit(words * 64))


def _masked(df: DataFrame, cols: list[str], bits: np.ndarray, inside: bool) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(bits)  # FILTER_MOST words at most
    names = [f"c{i}" for i in range(len(df.columns))]

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(len(names)).to_numpy()
            mask = ((held.value[s >> 6] >> (s & 63)) & 1).astype(bool)
            out = b.filter(pa.array(mask if inside else ~mask))
            if out.num_rows:
                yield out.select(names)

    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema.fields, strict=True))
    own = df.select("*", _slot(cols, len(bits)).alias("__slot")).toDF(*names, "__slot")
    return own.mapInArrow(tidied(keep), kinds).toDF(*df.columns)


def semi_filtered(df: DataFrame, cols: str | list[str], ids: DataFrame) -> DataFrame:
    """Rows of df whose id is in ids, and a few others: thins df before a join that shuffles its texts."""
    cols = [cols] if isinstance(cols, str) else cols
    return _masked(df, cols, member_filter(ids, cols), True)


def parted(df: DataFrame, cols: list[str], ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose id is in ids and a few others, all other rows): so that only the first need a shuffle."""
    bits = member_filter(ids, cols)
    return _masked(df, cols, bits, True), _masked(df, cols, bits, False)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: (id, component), component being the smallest id reached.

    nodes(id), edges(a, b): longs. Each round takes the least label of the neighbours and then the
    label of that label, so chains halve. Labels of all nodes stay in tables; only one count reaches
    the driver per round. Nodes without edges keep their own id and take no part in the rounds.

    Each round's labels are written as Parquet, whose size the planner knows: a checkpoint carries the
    estimate of the plan that it cuts, and a round raises it to the fourth power, so that planning came
    to hold numbers of millions of digits on the driver. Joins are told to merge, so that no table of
    labels is built on the driver to be sent around.
    """
    edges = edges.select("a", "b")
    tasks, folder = tasks_for(edges), shared_folder(edges.sparkSession, "components")
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().coalesce(tasks), f"{folder}/edges")
    label = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")).coalesce(tasks), f"{folder}/0")
    for r in range(1, rounds + 1):
        near = both.join(label.withColumnRenamed("id", "b").hint("merge"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = label.join(near.hint("merge"), label.id == near.a, "left").select("id", F.least("component", F.coalesce("m", "component")).alias("new"), F.col("component").alias("old"))
        jump = step.select(F.col("id").alias("j"), F.col("new").alias("jl"))
        new = stored(step.join(jump.hint("merge"), step.new == jump.j, "left").select("id", F.least("new", F.coalesce("jl", "new")).alias("component"), "old").coalesce(tasks), f"{folder}/{r}")
        changed = new.where("component <> old").limit(1).count()
        label = new.select("id", "component")
        if not changed:
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return nodes.join(label.hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))

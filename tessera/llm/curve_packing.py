"""Packing along a space-filling curve: documents that are alike lie together in a sequence.

A pass tokenizes each document once, hashes its words into a vector, and projects that to DIMS
dimensions. Centred and scaled by the whole table's means and deviations, the point gets a Hilbert key,
by which documents are range-sorted; where a document's tokens stand along the curve is the sum of
what lies before. The line of all tokens is cut into sequences of ``capacity``; the last, partial one is
cut into powers of two, which need no padding, so nothing is padded. Only keys and counts are sorted:
tokens wait in a table, narrow as the vocabulary allows, and move once, to meet their places.

Defined results: null and empty texts are the end token alone, and their point is that of no words; rows
that repeat a doc_id are documents of their own; equal points go by doc_id, null first, then by the
table's order of rows; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as c
from tessera.llm.packing import CACHE, WordIds

#: Dimensions of the curve and bits of each; buckets of the hashed vectors; deviations on either side of the mean that bits tell apart.
DIMS, BITS = 6, 10
BUCKETS, REACH = 1024, 2.5
#: Bytes of texts that are tokenized at once.
TEXTS = 2 << 20
#: Characters beyond ASCII that are white space, and four that some take for it. Unicode's White_Space, and the information separators.
SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\x1c\x1d\x1e\x1f"
_SPACES = [x.encode() for x in SPACES]


class ByteIds(WordIds):
    """Ids of byte-level BPE, learned for each word with the white space before it.

    A tokenizer that splits by the usual pattern never joins what stands before a run of white space to
    it, so a text is the sequence of such units; a probe tells whether this one does. Texts that hold
    white space beyond ASCII, or a special token, go to the tokenizer whole, as does all text of others.
    New units are told apart by the bytes that each id stands for, which the probe counts too, so that the
    tokenizer needn't follow offsets.
    """

    def __init__(self, path: str):
        super().__init__(path)
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        units = ["Wonder...", " quite", " \n bad?!", "  \u00fcber", "\t\tx1-y,", "\n\ndon't;", " \r\n'll", " a:b", "   "]
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a sign of a byte-level token is a byte
        self.size[list(vocabulary.values())] = [len(t) for t in vocabulary]
        told = all(self.size[one(u)].sum() == len(u.encode()) for u in units)
        self.apart = told and one("".join(units)) == [i for u in units for i in one(u)]
        self.odd = [*_SPACES, *self.special]

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Ids of new units; all that begin with white space and end without, end to end, as one text."""
        n, ids, at = np.zeros(len(words), np.int64), [self.ids], len(self.ids)
        alone = np.fromiter((not c._SPACE[w[0]] or c._SPACE[w[-1]] for w in words), bool, len(words))
        bare, rest = np.flatnonzero(alone), np.flatnonzero(~alone)
        for i, got in zip(bare.tolist(), self._encoded([words[i] for i in bare.tolist()]), strict=True):
            ids.append(got)
            n[i] = len(got)
        for i in range(0, len(rest), 20_000):
            some = rest[i : i + 20_000]
            told = [words[k] for k in some.tolist()]
            (got,) = self._encoded([b"".join(told)])
            end = np.cumsum(np.fromiter(map(len, told), np.int64, len(told)))
            n[some] = np.diff(np.searchsorted(np.cumsum(self.size[got]), end, side="right"), prepend=0)
            ids.append(got)
        order = np.concatenate((bare, rest))
        start = np.empty(len(words), np.int64)
        start[order] = at + np.cumsum(n[order]) - n[order]
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.ids = np.insert(self.hashes, place, hashes), np.concatenate(ids)
        self.at, self.n = np.insert(self.at, place, start), np.insert(self.n, place, n)

    def _encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)]

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        joined = b"\n".join(texts)
        odd = not self.apart or any(x in joined for x in self.odd)
        plain = [k for k, t in enumerate(texts) if t and not (odd and (not self.apart or any(x in t for x in self.odd)))]
        for k in set(range(len(texts))).difference(plain):
            out[k] = np.array(self.tokenizer.encode(texts[k].decode("utf-8"), add_special_tokens=False).ids, "<u4") if texts[k] else np.zeros(0, "<u4")
        if plain:
            for k, got in zip(plain, self._looked_up([texts[k] for k in plain]), strict=True):
                out[k] = got
        return out

    def _looked_up(self, texts: list[bytes]) -> list[np.ndarray]:
        block = c.Block(texts)
        space = c._SPACE[block.data]
        space[block.end] = False  # the newline after each text, which isn't part of it
        begins = space.copy()
        begins[1:] &= ~space[:-1]  # where runs of white space begin
        begins[block.start] = True  # no text is empty
        s = np.flatnonzero(begins)
        e = np.append(s[1:], len(block.data))
        ends = np.zeros(len(block.data), bool)
        ends[block.end] = True
        e -= ends[e - 1]
        u, at_first, back = np.unique(block.hashes(s, e), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE:
            self.clear()
        place = np.searchsorted(self.hashes, u)
        new = np.flatnonzero(self.hashes[np.minimum(place, len(self.hashes) - 1)] != u) if len(self.hashes) else np.arange(len(u))
        if len(new):
            data = block.data.tobytes()
            self._learn(u[new], [data[x:y] for x, y in zip(s[at_first[new]].tolist(), e[at_first[new]].tolist(), strict=True)])
            place = np.searchsorted(self.hashes, u)
        n, at = self.n[place][back].astype(np.int64), self.at[place][back]
        stop = np.cumsum(n)
        ids = self.ids[np.repeat(at - stop + n, n) + np.arange(n.sum())]
        edge = np.concatenate(([0], stop))[np.append(np.searchsorted(s, block.start), len(s))].tolist()
        return [ids[x:y] for x, y in itertools.pairwise(edge)]


_learned: dict[str, ByteIds] = {}


def byte_ids(path: str) -> ByteIds:
    if path not in _learned:
        _learned[path] = ByteIds(path)
    return _learned[path]


def projection(dims: int = DIMS, buckets: int = BUCKETS) -> np.ndarray:
    """The fixed projection of hashed vectors to few dimensions."""
    return np.random.RandomState(20240301).standard_normal((buckets, dims))


def points(texts: list[bytes], onto: np.ndarray) -> np.ndarray:
    """Of each text the projected vector of its hashed words, lower-cased: signed, by the root of their number, of length 1; zero without words."""
    out = np.zeros((len(texts), onto.shape[1]))
    for i, j in c.blocks(texts):
        block = c.Block(texts[i:j], lower=True)
        s, e, edge = block.words()
        h = block.hashes(s, e)
        text = np.repeat(np.arange(j - i), np.diff(edge))
        sign = 1.0 - 2.0 * ((h >> c.U(60)) & c.U(1)).astype(np.float64)
        cell, back = np.unique(text * len(onto) + (h % c.U(len(onto))).astype(np.int64), return_inverse=True)
        many = np.bincount(back, sign, len(cell))
        value = np.sign(many) * np.sqrt(np.abs(many))
        whole = np.sqrt(np.bincount(cell // len(onto), value * value, j - i))
        value /= np.where(whole == 0, 1, whole)[cell // len(onto)]
        for d in range(onto.shape[1]):
            out[i:j, d] = np.bincount(cell // len(onto), value * onto[cell % len(onto), d], j - i)
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of cells (whole numbers below 2 ** bits, one column for each dimension)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):  # undo the turns and flips of each level
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, dims: int = DIMS) -> DataFrame:
    """(doc_id, seq, tokens, point, ids): seq numbers the rows; ids are 16 or 32 bits each, the end token included."""
    kinds = "doc_id long, seq long, tokens long, point array<double>, ids binary"
    schema = pa.schema([("doc_id", pa.int64()), ("seq", pa.int64()), ("tokens", pa.int64()), ("point", pa.list_(pa.float64())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, onto = byte_ids(tokenizer), projection(dims)
        for b in batches:
            texts = c.as_bytes(c.column(b, "text"))
            for i, j in c.blocks(texts, TEXTS):
                got = [np.append(x, np.uint32(end_id)) for x in words.of(texts[i:j])]
                raw = [x.astype("<u2" if end_id < 1 << 16 and words.tokenizer.get_vocab_size() <= 1 << 16 else "<u4").tobytes() for x in got]
                at = points(texts[i:j], onto)
                yield c.record_batch(schema, c.column(b, "doc_id").slice(i, j - i).cast(pa.int64()), c.column(b, "seq").slice(i, j - i), [len(x) for x in got], list(at), raw)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("seq", F.monotonically_increasing_id())
    return rows.mapInArrow(c.tidied(run), kinds)


def keyed(rows: DataFrame, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """(doc_id, seq, tokens, key): Hilbert keys of points, each dimension centred and scaled by all rows' mean and deviation."""
    told = rows.agg(*(f(F.col("point")[d]).alias(f"{n}{d}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for d in range(dims))).first()  # one row
    mean, spread = (np.array([told[f"{n}{d}"] or 0.0 for d in range(dims)]) for n in "ms")
    spread = np.where(spread > 0, spread, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = c.column(b, "point").flatten().to_numpy().reshape(-1, dims)
            cells = np.floor(((x - mean) / spread / REACH + 1) / 2 * (1 << bits))
            key = hilbert(np.clip(cells, 0, (1 << bits) - 1), bits)
            yield pa.RecordBatch.from_arrays([*(c.column(b, n) for n in ("doc_id", "seq", "tokens")), pa.array(key)], names=["doc_id", "seq", "tokens", "key"])

    return rows.select("doc_id", "seq", "tokens", "point").mapInArrow(run, "doc_id long, seq long, tokens long, key long")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens before each row within its task."""
    before = 0
    for b in batches:
        n = c.column(b, "tokens").to_numpy()
        sums = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*(c.column(b, x) for x in ("seq", "part", "tokens")), pa.array(sums - n)], names=["seq", "part", "tokens", "within"])
        before = int(sums[-1]) if len(sums) else before


def placed(keys: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """(seq, place): tokens before each document along the curve; and the number of all tokens. Of each task only its sum goes through one."""
    order = [F.asc("key"), F.asc_nulls_first("doc_id"), F.asc("seq")]
    ranged = keys.repartitionByRange(c.tasks_for(keys), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    runs = c.stored(ranged.mapInArrow(_running, "seq long, part int, tokens long, within long"), f"{folder}/runs")
    sums = runs.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the sort
    offsets = c.stored(sums.select("part", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before")), f"{folder}/sums")
    total = offsets.agg(F.sum("tokens")).first()[0] or 0
    return runs.join(offsets.select("part", "before"), "part").select("seq", (F.col("before") + F.col("within")).alias("place")), total


def cuts(start: int, stop: int, total: int, capacity: int) -> list[tuple[int, int, int]]:
    """(place, sequence, offset) of each piece of the tokens from start to stop, of all in total; ends with (stop, -1, -1)."""
    full = total // capacity
    edge = full * capacity
    out = [(max(start, k * capacity), k, max(start - k * capacity, 0)) for k in range(start // capacity, min(-(-stop // capacity), full))]
    sequence, rest = full, total - edge
    while rest:
        size = 1 << (rest.bit_length() - 1)
        if start < edge + size and stop > edge:
            out.append((max(start, edge), sequence, max(start - edge, 0)))
        edge, rest, sequence = edge + size, rest - size, sequence + 1
    return [*out, (stop, -1, -1)]


_PACKED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack_along_curve(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): each piece of docs(doc_id, text) and where it goes.

    tokenizer: path of a tokenizer file that every executor can read. Sequences are numbered along the
    curve; all hold ``capacity`` tokens but the last, whose sizes are different powers of two.
    """
    folder = c.shared_folder(docs.sparkSession, "curve")
    rows = c.stored(tokenized(docs, tokenizer, end_id), f"{folder}/tokens")
    places, total = placed(c.stored(keyed(rows), f"{folder}/keys"), folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, n, place, raw in zip(*(c.column(b, x).to_pylist() for x in ("doc_id", "tokens", "place", "ids")), strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                for (at, sequence, offset), (end, _, _) in itertools.pairwise(cuts(place, place + n, total, capacity)):
                    out.append((doc_id, at - place, end - at, zlib.crc32(ids[at - place : end - place]), n, sequence, offset))
            yield c.record_batch(_PACKED, *(zip(*out, strict=True) if out else [[]] * 7))

    met = rows.select("doc_id", "seq", "tokens", "ids").join(places, "seq").select("doc_id", "tokens", "place", "ids")
    return met.mapInArrow(c.tidied(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

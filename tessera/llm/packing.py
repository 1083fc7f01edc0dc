"""Best-fit packing of token pieces into sequences, with several capacities.

A piece is a vector: its tokens, one document, and its attention cost (the square of its length). A
sequence has a capacity of each. Pieces go longest first to the open sequence that the rule prefers
among those with room in every dimension: ``norm``, the least weighted norm of what would be left, or
``dot``, the greatest weighted product of the piece and what is left. A new sequence is opened only if
none has room.

Pieces are dealt to shards by hash, about SHARD of them each, and every shard is packed on its own;
that leaves at most one half-filled sequence more per shard, and no global order. Within a shard equal
pieces are placed together: sequences alike in what is left form a class, so a step chooses a class;
ties go to the class made first, and equal lengths by doc_id and piece.

Defined results: null and empty texts are a piece of the end token alone; rows that repeat a doc_id
are packed as documents of their own; other columns are ignored. No text is cut unless it is longer
than a sequence.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as c

SHARD = 1 << 16
#: Weights of what is left of tokens, documents and cost.
WEIGHTS = (1.0, 0.3, 0.3)
#: Distinct words whose ids a worker keeps (about 34 bytes each); beyond, it starts anew. Words that the tokenizer gets at once; bytes of text that are looked up at once.
CACHE = 1_000_000
AT_ONCE = 20_000
TEXTS = 2 << 20
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int32())])
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True


class WordIds:
    """Ids of each word by the tokenizer, kept in sorted arrays under the word's 64-bit hash.

    Where the tokenizer treats words between white space, and letters and closing marks, apart from one
    another and folds letter case (a probe tells), parts of words are looked up, and new ones go to it
    joined by blanks, many at once: an id belongs to the part that its offset lies in. Any other
    tokenizer gets whole texts. A worker's tasks share what they have learned.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        parts = ["Wonder", "...", "quite", "bad", "?!", "\u00fcber", "x1-y", ",", "don't", ";", "a", ":", "b"]
        self.apart = one("Wonder...quite \n bad?!  \u00fcber x1-y, don't; a:b") == [i for p in parts for i in one(p)] and one("WoRd") == one("word")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at, self.n, self.ids = np.zeros(0, c.U), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        at, n, ids, base = [], [], [self.ids], len(self.ids)
        for i in range(0, len(words), AT_ONCE):
            some = [w.decode("utf-8") for w in words[i : i + AT_ONCE]]
            size = np.fromiter(map(len, some), np.int64, len(some))
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids.append(np.array(got.ids, "<u4"))
            offset = np.fromiter((o[0] for o in got.offsets), np.int64, len(ids[-1]))
            cut = np.append(np.searchsorted(offset, np.cumsum(size + 1) - size - 1), len(offset))
            at.append(base + cut[:-1])
            n.append(np.diff(cut))
            base += len(offset)
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.ids = np.insert(self.hashes, place, hashes), np.concatenate(ids)
        self.at, self.n = np.insert(self.at, place, np.concatenate(at)), np.insert(self.n, place, np.concatenate(n))

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.apart:
            return [np.array(self.tokenizer.encode(t.decode("utf-8"), add_special_tokens=False).ids, "<u4") for t in texts]
        raw = b"\n".join(texts).upper()
        plain = not any(x.upper() in raw for x in self.special)  # else folding or cutting could make or break a special token
        block = c.Block(texts, lower=plain)
        s, e, _ = block.words()
        letter, mark = _LETTER[block.data], _MARK[block.data]
        cut = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1 if plain else np.zeros(0, np.int64)
        s, e = np.sort(np.concatenate((s, cut))), np.sort(np.concatenate((e, cut)))
        u, first, back = np.unique(block.hashes(s, e), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE:
            self.clear()
        place = np.searchsorted(self.hashes, u)
        new = np.flatnonzero(self.hashes[np.minimum(place, len(self.hashes) - 1)] != u) if len(self.hashes) else np.arange(len(u))
        if len(new):
            data = block.data.tobytes()
            self._learn(u[new], [data[x:y] for x, y in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)])
            place = np.searchsorted(self.hashes, u)
        n, at = self.n[place][back].astype(np.int64), self.at[place][back]
        stop = np.cumsum(n)
        ids = self.ids[np.repeat(at - stop + n, n) + np.arange(n.sum())]
        edge = np.concatenate(([0], stop))[np.append(np.searchsorted(s, block.start), len(s))].tolist()
        return [ids[x:y] for x, y in itertools.pairwise(edge)]


_learned: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _learned:
        _learned[path] = WordIds(path)
    return _learned[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt) of each piece of each document's ids, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows, ids, texts = [], c.column(b, "doc_id").to_pylist(), c.as_bytes(c.column(b, "text"))
            for i, j in c.blocks(texts, TEXTS):
                for k, got in enumerate(words.of(texts[i:j]), i):
                    raw = got.tobytes() + end
                    n = len(raw) // 4
                    for p, s in enumerate(range(0, n, capacity)):
                        rows.append((ids[k], p, s, min(capacity, n - s), zlib.crc32(raw[4 * s : 4 * (s + capacity)]), k))
            yield c.record_batch(_PIECE, *(zip(*rows, strict=True) if rows else [[]] * 6))

    return docs.select("doc_id", "text").mapInArrow(c.tidied(run), "doc_id long, piece int, start long, length long, ids_crc32 long, salt int")


def fit(length: np.ndarray, capacity: int, max_docs: int, max_cost: int, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece of the lengths, which are 1 to capacity."""
    order = np.argsort(-length, kind="stable")
    sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    full = np.array([capacity, max_docs, max_cost], float)
    weight = np.array(weights)
    left = np.zeros((64, 3))  # of each class, as a share of the capacities
    count, first = np.zeros(64, np.int64), np.zeros(64, np.int64)
    used, bins, at = 0, 0, 0
    sizes, many = np.unique(-length, return_counts=True)
    for size, rest in zip((-sizes).tolist(), many.tolist(), strict=True):
        item = np.array([size, 1, size * size]) / full
        if (item > 1 + 1e-12).any():
            raise ValueError(f"a piece of {size} tokens exceeds a capacity")
        while rest:
            room = np.flatnonzero((count[:used] > 0) & (left[:used] >= item - 1e-12).all(1))
            if len(room):
                if rule == "norm":
                    k = room[np.argmin((((left[room] - item) ** 2) * weight).sum(1))]
                else:
                    k = room[np.argmax((left[room] * item * weight).sum(1))]
                start, have = first[k], int(count[k])
                each = int((left[k] / item + 1e-9).min()) if rule == "norm" else 1
            else:
                k, start = -1, bins
                each = int((1 / item + 1e-9).min()) if rule == "norm" else 1
                have = -(-rest // each)
                bins += have
            was = left[k].copy() if k >= 0 else np.ones(3)
            take = min(rest, have * each)
            whole, part = divmod(take, each)
            i = order[at : at + take]
            j = np.arange(take)
            sequence[i] = start + j // each
            offset[i] = round((1 - was[0]) * capacity) + (j % each) * size
            at, rest = at + take, rest - take
            spans = [(start, whole, was - each * item)] + ([(start + whole, 1, was - part * item)] if part else [])
            unused = have - whole - (part > 0)
            if k >= 0:
                count[k], first[k] = unused, start + have - unused
            for s, n, r in spans:
                if n and r[0] > 1e-12:
                    free = np.flatnonzero(count[:used] == 0) if used == len(count) else []
                    if len(free):
                        slot = free[0]
                    else:
                        if used == len(count):
                            left, count, first = (np.concatenate((x, np.zeros_like(x))) for x in (left, count, first))
                        slot, used = used, used + 1
                    left[slot], count[slot], first[slot] = r, n, s
    return sequence, offset


_PACKED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece goes.

    tokenizer: path of a tokenizer file that every executor can read. max_docs: documents in a sequence;
    max_cost: the sum of squared lengths in one. By default they are as many as there are tokens, and a
    full piece's, the least that lets every piece in: tokens alone then close a sequence, and the others
    count in the norm.
    """
    max_docs, max_cost = max_docs or capacity, max_cost or capacity * capacity
    pieces = c.checkpoint(token_pieces(docs, tokenizer, capacity, end_id))
    shards = max(1, round(pieces.count() / shard))

    def run(key, group):
        group = group.select(_PACKED.names[:5]).sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = fit(group.column("length").to_numpy(), capacity, max_docs, max_cost, rule, weights)
        return pa.Table.from_arrays([*group.columns, pa.array(sequence + (key[0].as_py() << 40)), pa.array(offset)], schema=_PACKED)

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

"""Repeated long strings by a run-length index (run-compressed Burrows-Wheeler transform).

Every byte that a string of ``length`` bytes covers which also starts anywhere else in the corpus is
removed. The steps, each exact:

* Anchors. Each window of ``length`` bytes owns the leftmost least hash of its GRAM-byte strings. The
  choice depends on the window's bytes alone, so equal windows have equal anchors at equal places. A
  run of windows with one anchor is a context: the bytes that those windows cover, about 500. Only
  hashes and offsets are shuffled to bring contexts of one anchor together; a context that no other
  meets can't repeat. This is a filter, and decides no match.
* Classes. Of contexts with equal bytes one goes to the index, with weight 2 if there are more: there it
  is two equal pieces, next to one another in suffix order, so the weight lengthens runs. What the index
  says of it holds for the others. A group of more than BIG_GROUP different contexts is dealt out again by parts of their windows, by
  what all windows of a part have in common, down to single windows, so no index is unbounded. A class that
  is alone at its anchor repeats whole and needs no index.
* Run-length index. The contexts of some groups form a shard. Its Burrows-Wheeler transform is kept as
  runs: character, first rank, and, for the runs' heads and ends, the common prefix of the suffix that
  they lead to with its neighbour. The contexts are streamed through it from their ends by the last-to-
  first mapping: within a run a suffix's common prefixes with its neighbours grow by one a step, at the
  heads and ends the samples hold. The greater one is the matching statistic, the longest match with
  any other place; windows whose statistic is ``length`` or more are marked.

Passages can also be told by words (``words``): each byte that a string of so many words covers which also
starts anywhere else, whatever stands between the words. Their windows have anchors of GRAM_WORDS words and go
the same way, but a window is compared by its hash, not in the index. They are counted, never removed, since what
is removed goes by bytes alone: 51 words may have as few as 101.

Matches never cross documents, as contexts don't. Defined results: null and empty texts have no bytes
and lose none; each row is a place of its own, also where doc_id is null or repeated, so equal rows of
``length`` bytes or more lose all; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as c

#: Bytes of an anchor's string, or its words where windows are of words; bits of its place in a packed minimum; bytes of one long text's piece.
GRAM = 96
GRAM_WORDS = 8
_PLACE = 24
_PIECE = 1 << 23
#: Bytes of text in one index, and different contexts of one group, at most (but for a group that comes last); parts of the windows by which larger groups are dealt out, step by step.
INDEX_BYTES = 1 << 20
BIG_GROUP = 4000
FINER = (8, 256)
#: Rows that a task holds while it tells classes apart.
HELD = 200_000
_SALT = [c.U(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _runs(full: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, lo, hi, own): runs lo..hi of windows that lie in one text (start, end) and whose leftmost least gram, of hash full, is own."""
    at = np.arange(len(full))
    packed = (full >> c.U(_PLACE) << c.U(_PLACE)) | at.astype(c.U)
    width, size = length - gram + 1, 1
    if len(full) < width:
        return (np.zeros(0, np.int64),) * 4
    while size * 2 <= width:
        packed = np.minimum(packed[:-size], packed[size:])
        size *= 2
    least = np.minimum(packed[: len(packed) - (width - size)], packed[width - size :])
    own = np.full(len(least) + 1, -1, np.int64)
    own[:-1] = (least & c.U((1 << _PLACE) - 1)).astype(np.int64)
    inside = np.zeros(len(full) + gram + 1, np.int32)
    np.add.at(inside, start, 1)
    np.add.at(inside, np.maximum(end - length + 1, start), -1)
    own[:-1][np.cumsum(inside[: len(least)]) <= 0] = -1
    lo = np.flatnonzero(np.concatenate(([own[0] >= 0], (own[1:] != own[:-1]) & (own[1:] >= 0))))
    ends = np.flatnonzero(own[1:] != own[:-1]) + 1
    hi = ends[np.searchsorted(ends, lo, "right")]  # one past the last window
    return np.searchsorted(start, lo, "right") - 1, lo, hi, own[lo]


def contexts(block: c.Block, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, lo, windows, rel, anchor hash, context hash) of each context of the block's texts of length bytes or more."""
    at = np.arange(max(len(block.data) - gram + 1, 0))
    full = block.hashes(at, at + gram)
    text, lo, hi, own = _runs(full, block.start, block.end, length, gram)
    rel = own - lo
    whole = c.mix(block.hashes(lo, hi + length - 1) + rel.astype(c.U) * _SALT[0] + (hi - lo).astype(c.U) * _SALT[1])
    return text, lo - block.start[text], hi - lo, rel, full[own], whole


def _strings(block: c.Block, s: np.ndarray, e: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The hash of the words i to j (one past the last) of a block's words s, e."""
    power, inv = c.powers(max(len(s), len(block.data)) + 1)
    prefix = np.concatenate((np.zeros(1, c.U), np.cumsum(block.hashes(s, e) * power[: len(s)])))
    return lambda i, j: c.mix((prefix[j] - prefix[i]) * inv[i] + _SALT[2] * (j - i).astype(c.U))


def word_contexts(block: c.Block, words: int, gram: int) -> tuple[np.ndarray, ...]:
    """As contexts(), for windows of so many words and anchors of gram words; in the place of windows the context's bytes, below zero."""
    s, e, first = block.words()
    of = _strings(block, s, e)
    at = np.arange(max(len(s) - gram + 1, 0))
    full = of(at, at + gram)
    text, lo, hi, own = _runs(full, first[:-1], first[1:], words, gram)
    rel = own - lo
    whole = c.mix(of(lo, hi + words - 1) + rel.astype(c.U) * _SALT[0] + (hi - lo).astype(c.U) * _SALT[1])
    return text, s[lo] - block.start[text], s[lo] - e[hi + words - 2], rel, full[own], whole


def _word_pieces(t: bytes, words: int) -> Iterator[tuple[int, bytes]]:
    """(start, piece) of a long text, so that each window of words lies in one piece."""
    s, e, _ = c.Block([t]).words()
    step = _PIECE // 8
    for i in range(0, len(s) - words + 1, step):
        yield int(s[i]), t[s[i] : e[min(i + step + words - 1, len(s)) - 1]]


_PLACES = "doc long, row long, lo long, windows int, rel int"
_ANCHOR = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("lo", pa.int64()), ("windows", pa.int32()), ("rel", pa.int32())])
_MET = pa.schema([("indexed", pa.bool_()), ("twice", pa.bool_()), *_ANCHOR])


def _third(anchor: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Whether an equal context comes twice before each, for contexts in any order."""
    order = np.lexsort((np.arange(len(anchor)), whole, anchor))
    a, w = anchor[order], whole[order]
    same = np.zeros(len(a), bool)
    same[2:] = (a[2:] == a[:-2]) & (w[2:] == w[:-2])
    out = np.empty(len(a), bool)
    out[order] = same
    return out


def _anchors(docs: DataFrame, length: int, gram: int, words: int | None) -> DataFrame:
    """A row for each context. Of a batch's equal ones, those after the second get a negative ``rel`` and a key of their own, so that a text that comes again and again makes no hot key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(c.column(b, "doc").to_pylist(), c.column(b, "row").to_pylist(), c.as_bytes(c.column(b, "text")), strict=True))
            # in one piece for both kinds of windows; long texts in pieces for each
            pieces = [(i, r, 0, t, 3) for i, r, t in rows if len(t) < _PIECE + length]
            for i, r, t in rows:
                if len(t) >= _PIECE + length:
                    pieces += [(i, r, s, t[s : s + _PIECE + length - 1], 1) for s in range(0, len(t), _PIECE) if len(t) - s >= length]
                    pieces += [(i, r, s, p, 2) for s, p in _word_pieces(t, words)] if words else []
            found = []
            for i, j in c.blocks([p[3] for p in pieces]):
                block = c.Block([p[3] for p in pieces[i:j]])
                doc, own, start, kind = (np.array([p[k] for p in pieces[i:j]]) for k in (0, 1, 2, 4))
                for bit, each in ((1, contexts(block, length, gram)), *([(2, word_contexts(block, words, min(GRAM_WORDS, words)))] if words else [])):
                    text, lo, windows, rel, anchor, whole = (x[(kind[each[0]] & bit) > 0] for x in each)
                    found.append((anchor, whole, doc[text], own[text], lo + start[text], windows.astype(np.int32), rel.astype(np.int32)))
            if found:
                anchor, whole, doc, own, lo, windows, rel = (np.concatenate(x) for x in zip(*found, strict=True))
                known = _third(anchor, whole)
                key = np.where(known, c.mix(own.view(c.U) + lo.astype(c.U)), anchor)
                rel = np.where(known, -1 - rel, rel).astype(np.int32)
                for i in range(0, len(key), 50_000):
                    p = slice(i, i + 50_000)
                    yield c.record_batch(_ANCHOR, c.signed(key[p]), c.signed(whole[p]), doc[p], own[p], lo[p], windows[p], rel[p])

    return docs.mapInArrow(c.tidied(run), f"anchor long, whole long, {_PLACES}")


def _meet(anchors: DataFrame, parts: int) -> DataFrame:
    """The contexts that meet another at their anchor: one of each class indexed, twice if the class has more. A task holds HELD rows."""
    names = _ANCHOR.names

    def close(rows: list[np.ndarray], last: bool, before: tuple) -> tuple[pa.RecordBatch | None, list[np.ndarray], tuple]:
        """What is told of sorted rows; what waits for those to come (a class's only row so far); and the last (anchor, whole, rows of the class, rows of the anchor)."""
        anchor, whole = rows[0], rows[1]
        n = len(anchor)
        group = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        kind = group | np.concatenate(([True], whole[1:] != whole[:-1]))
        in_group, in_kind = (np.arange(n) - np.maximum.accumulate(np.where(x, np.arange(n), 0)) for x in (group, kind))
        same = anchor == before[0]
        in_group = in_group + np.where(same, before[3], 0)
        in_kind = in_kind + np.where(same & (whole == before[1]), before[2], 0)
        alone = (in_group == 0) & np.concatenate((group[1:], [True]))
        twice = (in_kind == 0) & ~np.concatenate((kind[1:], [True]))
        wait = bool(in_kind[-1] == 0) and not last
        state = before if wait and n == 1 else tuple(int(x) for x in (anchor[-1 - wait], whole[-1 - wait], in_kind[-1 - wait] + 1, in_group[-1 - wait] + 1))
        pick = np.flatnonzero(~alone)
        pick = pick[:-1] if wait and len(pick) and pick[-1] == n - 1 else pick
        out = c.record_batch(_MET, in_kind[pick] == 0, twice[pick], *(x[pick] for x in rows)) if len(pick) else None
        return out, [x[-1:] for x in rows] if wait else [x[:0] for x in rows], state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, before = [], 0, (0, 0, 0, 0)
        for b in batches:
            rows = [c.column(b, x).to_numpy() for x in names]
            known = np.flatnonzero(rows[6] < 0)
            if len(known):
                yield c.record_batch(_MET, np.zeros(len(known), bool), np.zeros(len(known), bool), *(x[known] for x in rows[:6]), -1 - rows[6][known])
                rows = [x[rows[6] >= 0] for x in rows]
            held.append(rows)
            many += len(rows[0])
            if many >= HELD:
                out, rest, before = close([np.concatenate(x) for x in zip(*held, strict=True)], False, before)
                held, many = [rest], len(rest[0])
                if out is not None:
                    yield out
        rows = [np.concatenate(x) for x in zip(*held, strict=True)] if held else []
        if rows and len(rows[0]):
            out, *_ = close(rows, True, before)
            if out is not None:
                yield out

    dealt = anchors.repartition(parts, "anchor").sortWithinPartitions("anchor", "whole", "doc", "row", "lo")
    return dealt.mapInArrow(c.tidied(run), f"indexed boolean, twice boolean, anchor long, whole long, {_PLACES}")


def suffix_array(text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffixes in order; end: for each position the end of its own piece, at which its suffix ends (before all bytes, then by place)."""
    n = len(text)
    small = np.int32 if n < 1 << 30 else np.int64
    end = end.astype(small)
    left = end - np.arange(n, dtype=small)
    key, more = np.zeros(n, c.U), np.concatenate((text, np.zeros(7, np.uint8)))
    for j in range(7):
        key <<= c.U(8)
        key |= more[j : j + n]
    few = np.flatnonzero(left < 7)  # suffixes that end within the key: nothing of the next piece counts
    key[few] &= ~c.U(0) << (c.U(8) * (c.U(7) - left[few].astype(c.U)))
    key <<= c.U(8)
    key |= np.minimum(left, 7).astype(c.U)
    sa = np.argsort(key).astype(small)
    k = key[sa]
    few = np.flatnonzero(k & c.U(255) < c.U(7))
    sa[few] = sa[few][np.lexsort((sa[few], k[few]))]  # equal ones by place
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (k[1:] & c.U(255) < c.U(7))))
    first = np.flatnonzero(new).astype(small)
    rank = np.empty(n, small)
    rank[sa] = first[np.cumsum(new) - 1]
    h = 7
    while True:
        alone = new & np.concatenate((new[1:], [True]))
        slot = np.flatnonzero(~alone)
        if not len(slot):
            return sa.astype(np.int64)
        p = sa[slot]
        q = p + small(h)
        key2 = rank[p] * np.int64(2 * n + 2) + np.where(q < end[p], rank[np.minimum(q, small(n - 1))] + small(n + 1), p)
        order = np.argsort(key2)
        p, key2 = p[order], key2[order]
        sa[slot] = p
        fresh = np.concatenate(([True], key2[1:] != key2[:-1]))
        new[slot] = fresh
        rank[p] = slot[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        h *= 2


def common_prefix(prefix: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix at p and q, at most ``most``, by bisection on prefix hashes."""
    _, inv = c.powers(len(prefix))

    def bisected(p: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        before_p, before_q, inv_p, inv_q = prefix[p], prefix[q], inv[p], inv[q]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (prefix[p + mid] - before_p) * inv_p == (prefix[q + mid] - before_q) * inv_q
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    out = bisected(p, q, np.zeros(len(p), np.int64), np.minimum(most, 15))
    far = np.flatnonzero((out == 15) & (most > 15))  # few
    out[far] = bisected(p[far], q[far], out[far], most[far].astype(np.int64))
    return out


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of some pieces, with samples at the runs' heads and ends.

    A suffix ends with its piece, so a piece's last suffix is its last character alone; those of one
    character come first among the suffixes that begin with it. Only arrays of runs are kept.
    """

    def __init__(self, pieces: list[bytes], weight: np.ndarray):
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.end, self.weight = np.cumsum(size), weight
        end = np.repeat(self.end, size)
        raw = b"".join(pieces)
        text = np.frombuffer(raw, np.uint8)
        sa = suffix_array(text, end)
        many = np.repeat(weight, size)
        starts = np.zeros(len(text), bool)
        starts[self.end - size] = True
        bwt = np.where(starts[sa], 256, text[sa - 1].astype(np.int16))
        head = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        rank = np.cumsum(many[sa]) - many[sa]  # the first of each suffix
        n = int(many.sum())
        self.first, self.char = rank[head], bwt[head]  # of each run
        length = np.diff(np.append(self.first, n))
        self.last = self.first + length - 1
        count = np.bincount(text, many, 257).astype(np.int64)
        self.begin = np.cumsum(count) - count  # rank of the first suffix of each character
        bare = np.bincount(text[self.end - 1], weight, 257).astype(np.int64)  # of which are a piece's last
        order = np.argsort(self.char, kind="stable")
        kind, steps = self.char[order], length[order]
        before = np.cumsum(steps) - steps
        before -= before[np.searchsorted(kind, kind)]
        self.to = np.empty(len(head), np.int64)  # the rank that a run's head leads to
        self.to[order] = (self.begin + bare)[kind] + before
        leads = self.char < 256
        prefix = c.Block([raw]).prefix

        def common(at: np.ndarray) -> np.ndarray:
            """Common prefix of the suffix whose first rank it is with the one before; 0 beyond either end."""
            inside = (at > 0) & (at < n)
            j = np.searchsorted(rank, np.where(inside, at, rank[-1]))
            p, q = sa[j], sa[j - 1]
            return common_prefix(prefix, p, q, np.where(inside, np.minimum(end[p] - p, end[q] - q), 0))

        self.at_head, self.at_end = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
        self.at_head[leads] = common(self.to[leads])
        # where a run's end leads to, the next run of its character takes over: their common prefix is that one's
        self.at_end[order[:-1]] = self.at_head[order[1:]]
        final = np.flatnonzero(np.append(kind[1:] != kind[:-1], True) & (kind < 256))
        self.at_end[order[final]] = common((self.to + length)[order[final]])

    def statistics(self, pieces: list[bytes]) -> np.ndarray:
        """For each byte of the indexed pieces, one after another, the longest match that starts there with any other place in them."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(int(self.end[-1]), np.int32)
        char = np.fromiter((p[-1] for p in pieces), np.int64, len(pieces))
        by = np.argsort(char, kind="stable")
        place = np.empty(len(pieces), np.int64)
        steps = np.cumsum(self.weight[by]) - self.weight[by]
        place[by] = steps - steps[np.searchsorted(char[by], char[by])]
        rank = self.begin[char] + place
        before, after = (place > 0).astype(np.int64), (rank + 1 < self.begin[char + 1]).astype(np.int64)
        order = np.argsort(-size, kind="stable")
        kept = np.int32 if self.last[-1] < 1 << 30 else np.int64
        firsts, lasts, to, at_head, at_end = (x.astype(kept) for x in (self.first, self.last, self.to, self.at_head, self.at_end))
        rank, before, after, at = (x[order].astype(kept) for x in (rank, before, after, self.end - 1))
        one = kept(1)
        active = np.searchsorted(-size[order], -np.arange(1, int(size.max()) + 1), "right")  # pieces of t bytes or more
        for n in active.tolist():
            rank, before, after, at = rank[:n], before[:n], after[:n], at[:n]
            out[at] = np.maximum(before, after)
            run = np.searchsorted(firsts, rank, "right") - 1
            first = firsts[run]
            before = np.where(rank == first, at_head[run], before + one)
            after = np.where(rank == lasts[run], at_end[run], after + one)
            rank = to[run] + rank - first
            at = at - one
        return out.astype(np.int64)


def matching_statistics(pieces: list[bytes], weight: np.ndarray | None = None) -> np.ndarray:
    return RunIndex(pieces, np.ones(len(pieces), np.int64) if weight is None else weight).statistics(pieces)


_LISTED = ["lo", "windows", "rel", "anchor", "twice"]
_CONTEXT = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("lo", pa.int64()), ("windows", pa.int32()), ("twice", pa.bool_()), ("bytes", pa.binary())])
_MARK = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("of_words", pa.bool_())])


def _listed(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(doc, row, text, xs): the texts of the kinds' places, each with a list of them."""
    lists = c.checkpoint(kinds.groupBy("doc", "row").agg(F.collect_set(F.struct(*_LISTED)).alias("xs")))
    thin = c.semi_filtered(docs, ["doc", "row"], lists.select("doc", "row")).dropDuplicates(["doc", "row"])
    return thin.join(lists, ["doc", "row"])


def _finer(docs: DataFrame, kinds: DataFrame, parts: int, length: int, gram: int, words: int | None) -> DataFrame:
    """The kinds cut into parts of their windows; the anchor of each is what all windows of a part have in common. Windows of words are told apart at once."""
    width = max(1, -(-(length - gram + 1) // parts))
    digest = lambda b, *tell: int.from_bytes(hashlib.blake2b(b, digest_size=8, key=b"".join((x & (2**64 - 1)).to_bytes(8, "little") for x in tell)).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, own, t, xs in zip(c.column(b, "doc").to_pylist(), c.column(b, "row").to_pylist(), c.as_bytes(c.column(b, "text")), c.column(b, "xs").to_pylist(), strict=True):
                for x in xs:
                    lo, w, a, anchor = x["lo"], x["windows"], x["lo"] + x["rel"], x["anchor"]
                    if w < 0:
                        for s, e, h in zip(*(y.tolist() for y in word_windows([t[lo : lo - w]], words)[:3]), strict=True):
                            rows += [(h, h, doc, own, lo + s, s - e, 0)] * (1 + x["twice"])
                        continue
                    for q in range((a - lo - w + 1) // width, (a - lo) // width + 1):
                        s, e = max(lo, a - (q + 1) * width + 1), min(lo + w, a - q * width + 1)  # first windows, and one past the last
                        shared = t[a - q * width : a - (q + 1) * width + 1 + length]
                        rows += [(digest(shared, anchor, parts, q), digest(t[s : e + length - 1], a - s, e - s), doc, own, s, e - s, a - s)] * (1 + x["twice"])
                if len(rows) > 20_000:
                    yield c.record_batch(_ANCHOR, *zip(*rows, strict=True))
                    rows = []
            if rows:
                yield c.record_batch(_ANCHOR, *zip(*rows, strict=True))

    return _listed(docs, kinds).mapInArrow(c.tidied(run), f"anchor long, whole long, {_PLACES}")


def _cut(docs: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """(key, doc, row, lo, windows, twice, bytes): the contexts' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, own, t, xs in zip(c.column(b, "doc").to_pylist(), c.column(b, "row").to_pylist(), c.as_bytes(c.column(b, "text")), c.column(b, "xs").to_pylist(), strict=True):
                for x in xs:
                    lo, w = x["lo"], x["windows"]
                    rows.append((x["anchor"], doc, own, lo, w, x["twice"], t[lo : lo + w + length - 1 if w > 0 else lo - w]))
                if len(rows) > 4000:
                    yield c.record_batch(_CONTEXT, *zip(*rows, strict=True))
                    rows = []
            if rows:
                yield c.record_batch(_CONTEXT, *zip(*rows, strict=True))

    return _listed(docs, kinds).mapInArrow(c.tidied(run), "key long, doc long, row long, lo long, windows int, twice boolean, bytes binary")


def word_windows(pieces: list[bytes], words: int) -> tuple[np.ndarray, ...]:
    """(start, end, hash, piece) of each window of so many words."""
    block = c.Block(pieces)
    s, e, first = block.words()
    at = np.concatenate([np.arange(a, max(b - words + 1, a)) for a, b in zip(first[:-1], first[1:], strict=True)])
    piece = np.searchsorted(block.start, s[at], "right") - 1
    return s[at] - block.start[piece], e[at + words - 1] - block.start[piece], c.signed(_strings(block, s, e)(at, at + words)), piece


def _index(cut: DataFrame, length: int, parts: int, words: int | None) -> DataFrame:
    """(doc, row, s, e, of_words): spans of the windows that the index finds elsewhere, and of those of words that another equals."""

    def marks(every: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        rows = [r for r in every if r[4] < 0]
        if rows:
            s, e, h, piece = word_windows([r[6] for r in rows], words)
            _, same = np.unique(h, return_inverse=True)
            twice = np.array([1 + r[5] for r in rows])
            hit = np.bincount(same, twice[piece])[same] > 1
            s, e, piece = s[hit], e[hit], piece[hit]
            # windows that overlap go on together
            new = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (s[1:] > e[:-1]))) if len(s) else [])
            for i, j in zip(new.tolist(), [*(new[1:] - 1).tolist(), len(s) - 1], strict=False):
                _, doc, own, lo, *_ = rows[piece[i]]
                out.append((doc, own, lo + int(s[i]), lo + int(e[j]), True))
        rows, at = [r for r in every if r[4] > 0], 0
        ms = matching_statistics([r[6] for r in rows], np.array([1 + r[5] for r in rows])) if rows else None
        for _, doc, own, lo, w, _, b in rows:
            hit = np.flatnonzero(ms[at : at + w] >= length)
            if len(hit):
                gap = np.flatnonzero(np.diff(hit) > length)
                for s, e in zip(hit[np.concatenate(([0], gap + 1))].tolist(), hit[np.concatenate((gap, [len(hit) - 1]))].tolist(), strict=True):
                    out.append((doc, own, lo + s, lo + e + length, False))
            at += len(b)
        return c.record_batch(_MARK, *(zip(*out, strict=True) if out else [[]] * 5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, key = [], 0, None
        for b in batches:
            for r in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if r[0] != key and size >= INDEX_BYTES:
                    yield marks(rows)
                    rows, size = [], 0
                key = r[0]
                rows.append(r)
                size += len(r[6])
        if rows:
            yield marks(rows)

    return cut.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(c.tidied(run), "doc long, row long, s long, e long, of_words boolean")


def _identified(docs: DataFrame) -> DataFrame:
    """(doc, row, text, doc_id): null ids and texts that share an id are told apart by ``row``."""
    return docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), c.row_key().alias("row"), "text", F.col("doc_id").cast("long").alias("doc_id"))


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """(doc, row, s, e, of_words): byte spans, possibly overlapping, whose union is what repeats. docs(doc_id, text).

    With words, also those of strings of so many words that another place has too, whatever separates the words (of_words).
    """
    gram = min(gram, length)
    parts = c.shuffle_partitions(docs.sparkSession)
    docs = _identified(docs).drop("doc_id").where(F.octet_length("text") >= min(length, 2 * (words or length) - 1))
    met = c.checkpoint(_meet(_anchors(docs, length, gram, words), parts))
    known, kinds = [met.where("NOT indexed")], met.where("indexed")
    # a class that meets no other has nothing left to be found: all its windows repeat
    groups = c.checkpoint(kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.first(F.struct(*_MET.names)).alias("x")).select("anchor", "n", F.when(F.col("n") == 1, F.col("x")).alias("x")))
    known.append(groups.where("n = 1").select("x.*"))
    kinds = kinds.join(groups.where("n > 1").select("anchor"), "anchor", "left_semi").select(*_MET.names)
    for n in FINER:
        big = c.checkpoint(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > BIG_GROUP).select("anchor"))
        if not big.limit(1).count():
            break
        finer = c.checkpoint(_meet(_finer(docs, kinds.join(big, "anchor", "left_semi"), n, length, gram, words), parts))
        kinds = kinds.join(big, "anchor", "left_anti").select(*_MET.names).unionByName(finer.where("indexed"))
        known.append(finer.where("NOT indexed"))
    end = F.when(F.col("windows") > 0, F.col("lo") + F.col("windows") + (length - 1)).otherwise(F.col("lo") - F.col("windows"))
    whole = reduce(DataFrame.unionByName, known).select("doc", "row", F.col("lo").alias("s"), end.alias("e"), (F.col("windows") < 0).alias("of_words"))
    return whole.unionByName(_index(_cut(docs, kinds, length), length, parts, words))


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string()), ("passage_bytes", pa.int64())])


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = GRAM, keep_bytes: bool = True, words: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) of each document; kept is null unless keep_bytes. Texts that lose nothing aren't shuffled.

    With words, passage_bytes follows: bytes that a string of so many words covers which also starts anywhere else. They are told, not removed.
    """
    docs = docs.select("doc_id", "text")
    by_doc = c.checkpoint(repeated_spans(docs, length, gram, words).groupBy("doc", "row").agg(F.collect_set(F.struct("s", "e", "of_words")).alias("spans")))
    some, rest = c.parted(_identified(docs), ["doc", "row"], by_doc.select("doc", "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, t, spans in zip(c.column(b, "doc_id").to_pylist(), c.as_bytes(c.column(b, "text")), c.column(b, "spans").to_pylist(), strict=True):
                kept, n_spans, at = [], 0, 0
                for s, e in sorted((x["s"], x["e"]) for x in spans or [] if not x["of_words"]):
                    if s > at or not n_spans:
                        kept.append(t[at:s])
                        n_spans += 1
                    at = max(at, e)
                kept.append(t[at:])
                rest = b"".join(kept)
                told = at = 0
                for s, e in sorted((x["s"], x["e"]) for x in spans or [] if x["of_words"]):
                    told += max(0, e - max(s, at))
                    at = max(at, e)
                out.append((doc, len(t), len(t) - len(rest), n_spans, rest if keep_bytes else None, hashlib.sha256(rest).hexdigest(), told))
            yield c.record_batch(_KEPT, *(zip(*out, strict=True) if out else [[]] * 7))

    cut = some.join(by_doc, ["doc", "row"], "left").mapInArrow(c.tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, passage_bytes long")
    raw, none = F.coalesce("text", F.lit("")).cast("binary"), F.lit(0).cast("long")
    whole = rest.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), (raw if keep_bytes else F.lit(None).cast("binary")).alias("kept"), F.sha2(raw, 256).alias("kept_sha256"), none.alias("passage_bytes"))
    out = cut.unionByName(whole)
    return out if words else out.drop("passage_bytes")

"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, then exact sorted-array intersection.

Two texts link when the Jaccard similarity of their sets of word n-grams is at least num/100. The
join is exact for every pair:

* Tiles. If t <= s are the sizes of a linked pair, their sets differ in at most d(t) elements. Within
  a band of sizes, every set is cut by hash range into m = max d + 1 + spare parts, so a linked pair
  has more than spare parts in common. A tile is (band, m, part, the part's content); a document
  enters the tiles of its own band and, where a smaller partner can be in the band below, of that too.
  A tile is thus far more selective than a shared n-gram: a passage that thousands of texts share is
  spread over many parts and mixed with each text's own n-grams. Empty parts make no tile; the few sets
  with more than spare of them also enter the tiles of each combination of spare + 1 empty parts. Sets so
  small that only one element can differ use the sums of the set less one element instead.
* A tile's hub is its member of most tiles; all tiles of a hub make a family. Each document is first
  compared with the hubs that it meets most often, and links join components. Only where a family still
  holds several components are its members compared with one another, in blocks, by bitmaps: the bits
  that differ bound the overlap from above.
* Exact intersection of the sorted hash arrays decides every link.

Texts of equal sets enter tiles once. Nothing is capped or sampled. 64-bit hashes stand for n-grams.

Defined results: null and empty texts have an empty set, no link, and are their own component; texts
with fewer than n words have one shingle, the whole sequence; repeated ids are merged into one row per
id and set; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as c

#: Least number of spare parts.
SPARE = 2
BAND_RATIO = 1.5
#: Members of one comparison block, and rows of a hub's share in exact checks.
BLOCK = 256
#: Rows with texts, sets or bitmaps that go to a Python worker at once.
WIDE = 256
SHARE = 256
_MUL = [c.U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25)]


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles."""
    out: list[np.ndarray] = []
    for i, j in c.blocks(texts):
        block = c.Block(texts[i:j], lower=True)
        s, e, first = block.words()
        h = block.hashes(s, e)
        if len(h) >= n:
            roll = np.zeros(len(h) - n + 1, c.U)
            for k in range(n):
                roll += h[k : k + len(roll)] * _MUL[k % 8] + c.U(k)
            roll = c.mix(roll)
        for a, b in itertools.pairwise(first.tolist()):
            if b - a >= n:
                out.append(np.unique(roll[a : b - n + 1]))
            elif b > a:
                whole = np.array([b - a], c.U)
                for k in range(a, b):
                    whole = c.mix(whole * _MUL[1] + h[k : k + 1])
                out.append(whole)
            else:
                out.append(np.zeros(0, c.U))
    return out


class Bands:
    """The bands of set sizes for a similarity of num/100, with their number of parts."""

    def __init__(self, num: int):
        if not 80 <= num <= 100:
            raise ValueError(f"a similarity of {num}/100 is outside 80 to 100")
        self.num = num
        self.small = 1 << 62 if num == 100 else next(t for t in itertools.count(1) if self.differ(t) > 1)  # below: at most one element differs
        self._low, self._parts = [self.small], []

    def need(self, s: int, t: int) -> int:
        """Least intersection of sets of sizes s and t that link."""
        return -(-self.num * (s + t) // (100 + self.num))

    def differ(self, t: int) -> int:
        """Most elements in which a set of t and a linked one of t or more can differ."""
        return max(s + t - 2 * self.need(s, t) for s in range(t, 100 * t // self.num + 1) if self.need(s, t) <= t)

    def _upto(self, size: int) -> None:
        while self._low[-1] <= size:
            low = self._low[-1]
            high = max(low + 1, int(low * BAND_RATIO))
            self._low.append(high)
            # s + t - 2 * need(s, t) grows with s and t but for rounding, which is at most two
            near = {t for t in range(max(low, high - 8), high)}
            least = max(map(self.differ, near)) + 1
            self._parts.append((least + (spare := self._spare(least, low)), spare))

    @staticmethod
    def _spare(least: int, low: int) -> int:
        """Parts that may match emptily: few in small bands, else about the most empty parts that a set of size low has."""
        spare = SPARE
        for _ in range(6 if least > 12 else 0):
            empty = (least + spare) * math.exp(-low / (least + spare))
            spare = max(SPARE, math.ceil(empty + 3 * math.sqrt(empty) + 1))
        return spare

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(band, parts, spare) of each band whose tiles a set of this size enters."""
        self._upto(size)
        b = int(np.searchsorted(self._low, size, "right")) - 1
        found = [(b, *self._parts[b])] if b >= 0 else []
        if b > 0 and 100 * (self._low[b] - 1) >= self.num * size:
            found.append((b - 1, *self._parts[b - 1]))
        return found


def tiles(h: np.ndarray, bands: Bands) -> np.ndarray:
    """Hashes of the tiles that a set (sorted hashes) enters."""
    out = []
    size = len(h)
    if not size:
        return np.zeros(0, c.U)
    m1 = c.mix(h ^ _MUL[2])
    if 100 * (bands.small - 1) >= bands.num * size:
        total = m1.sum(dtype=c.U)
        out += [c.mix(np.concatenate(([total], total - m1)) ^ _MUL[3])]
    if size >= bands.small:
        top = h >> c.U(32)
        for band, m, spare in bands.of(size):
            cut = np.searchsorted(top, (np.arange(m + 1, dtype=c.U) << c.U(32)) // c.U(m), "left")
            full = np.flatnonzero(cut[1:] > cut[:-1])
            sums = np.add.reduceat(m1, cut[full])
            key = np.array([band], c.U) * _MUL[4] + c.U(m)
            out.append(c.mix(sums + c.mix(full.astype(c.U) * _MUL[5] + key)))
            if m - len(full) > spare:
                empty = np.setdiff1d(np.arange(m), full)
                combos = np.array(list(itertools.combinations(empty.tolist(), spare + 1)), np.uint64)
                k = key + _MUL[6]
                for i in range(spare + 1):
                    k = c.mix(k + combos[:, i] * _MUL[i % 8] + c.U(i))
                out.append(k)
    return np.concatenate(out)


def _width(size: int) -> int:
    """Bits of the bitmap of sets about this size; alike for sets that can link, but for one step."""
    return max(256, 1 << (4 * max(size, 1) - 1).bit_length())


def bitmap(h: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, bool)
    bits[(c.mix(h ^ _MUL[7]) % c.U(width)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def links(a: np.ndarray, b: np.ndarray, num: int) -> bool:
    """Whether sorted sets link, exactly: sizes, then bits, then intersection."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    width = _width(max(len(a), len(b)))
    differ = len(a) + len(b) - 2 * (-(-num * (len(a) + len(b)) // (100 + num)))
    if int(np.bitwise_count(bitmap(a, width) ^ bitmap(b, width)).sum()) > differ:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= num * (len(a) + len(b) - same)


_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
_TILED = pa.schema([("tile", pa.int64()), ("key", pa.int64())])
_MET = pa.schema([("tile", pa.int64()), ("key", pa.int64()), ("shared", pa.int32())])


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit content hashes of each set."""
    out = np.zeros((2, len(sets)), c.U)
    for i, h in enumerate(sets):
        out[0, i] = c.mix(h ^ _MUL[0]).sum(dtype=c.U) + c.U(len(h))
        out[1, i] = c.mix(h ^ _MUL[1]).sum(dtype=c.U)
    return c.mix(out)


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2): size and 128-bit content hash of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(c.as_bytes(c.column(b, "text")), n)
            k = _keys(sets)
            yield c.record_batch(_SETS, c.column(b, "doc_id"), [len(s) for s in sets], c.signed(k[0]), c.signed(k[1]))

    return docs.select("doc_id", "text").mapInArrow(c.tidied(run), "doc_id long, n_shingles long, h1 long, h2 long")


def _tiled(docs: DataFrame, n: int, num: int) -> DataFrame:
    """(tile, key): a row for each tile of each distinct set of a partition; key is the set's h1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num), set()
        for b in batches:
            texts = c.as_bytes(c.column(b, "text"))
            for i, j in c.blocks(texts):
                sets = shingle_sets(texts[i:j], n)
                out, key, size = [], [], []
                for h, k in zip(sets, _keys(sets)[0].tolist(), strict=True):
                    if len(h) and k not in seen:
                        seen.add(k)
                        out.append(tiles(h, bands))
                        key.append(k)
                        size.append(len(out[-1]))
                if out:
                    yield c.record_batch(_TILED, c.signed(np.concatenate(out)), c.signed(np.repeat(np.array(key, c.U), size)))

    return docs.select("text").mapInArrow(c.tidied(run), "tile long, key long")


def _meet(tiled: DataFrame, parts: int) -> DataFrame:
    """(tile, key, shared): the members of each tile that has several; tiles of equal members are one, and shared counts them.

    A task holds the distinct (tile, key) of its partition: about the rows of all tiles over parts.
    """

    def squeeze(t: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((k, t))
        t, k = t[order], k[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        return t[new], k[new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ts, ks, held = [], [], 0
        for b in batches:
            ts.append(c.column(b, "tile").to_numpy())
            ks.append(c.column(b, "key").to_numpy())
            held += b.num_rows
            if held > 6_000_000:
                t, k = squeeze(np.concatenate(ts), np.concatenate(ks))
                ts, ks, held = [t], [k], 0
        if not ts:
            return
        t = np.concatenate(ts)
        order = np.argsort(t)
        t, k = t[order], np.concatenate(ks)[order]
        twin = np.zeros(len(t), bool)
        twin[1:] = t[1:] == t[:-1]
        twin[:-1] |= twin[1:]
        t, k = squeeze(t[twin], k[twin])
        if not len(t):
            return
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        count = np.diff(np.concatenate((first, [len(t)])))
        group = c.signed(np.add.reduceat(c.mix(k.view(c.U)), first) + count.astype(c.U) * _MUL[3])
        _, once, alike = np.unique(group, return_index=True, return_counts=True)
        for i in range(0, len(once), 20_000):
            o, times = once[i : i + 20_000], alike[i : i + 20_000].astype(np.int32)
            n = count[o]
            at = np.repeat(first[o] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield c.record_batch(_MET, np.repeat(group[o], n), k[at], np.repeat(times, n))

    return tiled.repartition(parts, "tile").mapInArrow(c.tidied(run), "tile long, key long, shared int")


def _arrays(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(id, n, hashes): the sorted set of each wanted document, hashes as bytes."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = c.as_bytes(c.column(b, "text")), c.column(b, "doc_id")
            for i, j in c.blocks(texts):
                sets = shingle_sets(texts[i:j], n)
                yield c.record_batch(schema, ids.slice(i, j - i), [len(h) for h in sets], [h.tobytes() for h in sets])

    thin = c.semi_filtered(docs.select("doc_id", "text"), "doc_id", wanted.withColumnRenamed("id", "doc_id"))
    return thin.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(c.tidied(run), "id long, n long, hashes binary")


def verify(pairs: DataFrame, arrays: DataFrame, num: int, parts: int) -> DataFrame:
    """Those of the distinct pairs (a, b) that link.

    Each first member is sent to as many shares as its partners need, SHARE to each, so a member of
    thousands of pairs is dealt out; a task holds one set of a first member and one of a partner.
    """
    pairs = c.checkpoint(pairs, WIDE)
    arrays = c.semi_filtered(arrays.select("id", "hashes"), "id", pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))
    n_share = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    left = n_share.select(F.col("a").alias("id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"))
    right = pairs.join(n_share, "a").select(F.col("b").alias("id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("role"))
    rows = left.unionByName(right).join(arrays, "id").select("hub", "share", "role", "id", "hashes")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, c.U)
        for batch in batches:
            a, b = [], []
            for hub, share, role, i, h in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                h = np.frombuffer(h, c.U)
                if role == 0:
                    at, own = (hub, share), h
                elif at == (hub, share) and links(own, h, num):
                    a.append(hub)
                    b.append(i)
            yield c.record_batch(schema, a, b)

    return rows.repartition(parts, "hub", "share").sortWithinPartitions("hub", "share", "role", "id").mapInArrow(c.tidied(run), "a long, b long")


def _maps(arrays: DataFrame) -> DataFrame:
    """(id, n, m1, m2): the bitmaps of each set's own width and of twice that."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("m1", pa.binary()), ("m2", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(h, c.U) for h in c.column(b, "hashes").to_pylist()]
            wide = [_width(len(h)) for h in sets]
            yield c.record_batch(schema, c.column(b, "id"), c.column(b, "n"), *([bitmap(h, k * w).tobytes() for h, w in zip(sets, wide, strict=True)] for k in (1, 2)))

    return arrays.mapInArrow(c.tidied(run), "id long, n long, m1 binary, m2 binary")


def _stack(rows: list[tuple]) -> dict[int, tuple[np.ndarray, ...]]:
    """Rows (id, component, n, m1, m2) by bitmap width: ids, components, sizes and bitmaps."""
    by: dict[int, list] = {}
    for r in rows:
        for m in r[3:5]:
            by.setdefault(len(m), []).append((r, m))
    return {w: (*(np.array([r[k] for r, _ in v]) for k in range(3)), np.stack([np.frombuffer(m, c.U) for _, m in v])) for w, v in by.items()}


def _allowed(rows: list[tuple], stacked: dict[int, tuple[np.ndarray, ...]], num: int) -> set[tuple[int, int]]:
    """Pairs of different components whose sizes and bitmaps allow a link."""
    found: set[tuple[int, int]] = set()
    for i, g, s, *more in rows:
        for m in more[:2]:
            if len(m) not in stacked:
                continue
            ids, comps, sizes, bits = stacked[len(m)]
            go = np.flatnonzero((comps != g) & (100 * np.minimum(s, sizes) >= num * np.maximum(s, sizes)))
            if len(go):
                differ = np.bitwise_count(bits[go] ^ np.frombuffer(m, c.U)).sum(1).astype(np.int64)
                total = s + sizes[go]
                go = go[differ <= total - 2 * (-(-num * total // (100 + num)))]
                found.update((min(i, j), max(i, j)) for j in ids[go].tolist())
    return found


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _possible(pairs: DataFrame, maps: DataFrame, num: int) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and bitmaps allow a link. Only the two bitmaps of one width go on."""
    for side in ("a", "b"):
        pairs = pairs.join(maps.select(F.col("id").alias(side), *(F.col(x).alias(f"{x}_{side}") for x in ("n", "m1", "m2"))), side)
    pairs = pairs.where(100 * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
    narrow = F.octet_length("m1_a") - F.octet_length("m1_b")
    pick = pairs.select("a", "b", "n_a", "n_b", F.when(narrow < 0, F.col("m2_a")).otherwise(F.col("m1_a")).alias("m_a"), F.when(narrow > 0, F.col("m2_b")).otherwise(F.col("m1_b")).alias("m_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (c.column(batch, k).to_pylist() for k in ("a", "b", "n_a", "n_b", "m_a", "m_b"))
            keep = []
            for i in range(len(a)):
                total = n[i] + m[i]
                wide = len(x[i]) != len(y[i])  # further apart than one step, so no bitmap is shared: left to the exact check
                differ = 0 if wide else int(np.bitwise_count(np.frombuffer(x[i], c.U) ^ np.frombuffer(y[i], c.U)).sum())
                if differ <= total - 2 * (-(-num * total // (100 + num))):
                    keep.append(i)
            yield c.record_batch(_PAIR, [a[i] for i in keep], [b[i] for i in keep])

    return pick.mapInArrow(c.tidied(run), "a long, b long")


def _crossing(families: DataFrame, comp: DataFrame, maps: DataFrame, num: int, parts: int) -> DataFrame:
    """Pairs (a, b), a < b, of one family and different components whose bitmaps allow a link.

    A family of more than BLOCK members is cut into blocks; a task holds two blocks at a time.
    """
    placed = families.select("hub", "id").join(comp, "id")
    mixed = placed.groupBy("hub").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).where("x <> y")
    blocks = placed.join(mixed.select("hub", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "hub")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(maps, "id")
    names = ["id", "component", "n", "m1", "m2"]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(at: tuple, rows: list[tuple]) -> pa.RecordBatch:
            out = [(a, b, None, None, None) for a, b in _allowed(rows, _stack(rows), num)]
            if at[2] > 1:
                out.append((None, None, at[0], at[1], pickle.dumps(rows)))
            return c.record_batch(_OWN, *(zip(*out, strict=True) if out else [[]] * 5))

        at, rows = None, []
        for batch in batches:
            for hub, block, n, *r in zip(*(c.column(batch, x).to_pylist() for x in ("hub", "block", "blocks", *names)), strict=True):
                if at and at[:2] != (hub, block):
                    yield close(at, rows)
                    rows = []
                at = (hub, block, n)
                rows.append(tuple(r))
        if at:
            yield close(at, rows)

    dealt = blocks.select("hub", "block", "blocks", *names).repartition(parts, "hub", "block").sortWithinPartitions("hub", "block")
    first = c.checkpoint(dealt.mapInArrow(c.tidied(own), "a long, b long, hub long, block int, data binary"), WIDE)
    packed = first.where("hub IS NOT NULL")
    x, y = packed.select("hub", "block", "data"), packed.select("hub", F.col("block").alias("block2"), F.col("data").alias("data2"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q in zip(*(c.column(batch, k).to_pylist() for k in ("data", "data2")), strict=True):
                found = _allowed(pickle.loads(p), _stack(pickle.loads(q)), num)
                yield c.record_batch(_PAIR, [f[0] for f in found], [f[1] for f in found])

    across = x.join(y, "hub").where("block < block2").select("data", "data2").repartition(parts).mapInArrow(c.tidied(compare), "a long, b long")
    return first.where("hub IS NULL").select("a", "b").unionByName(across).distinct()


_OWN = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hub", pa.int64()), ("block", pa.int32()), ("data", pa.binary())])


def _still(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Those of the pairs that lie in different components."""
    p, q = comp.select(F.col("id").alias("a"), F.col("component").alias("p")), comp.select(F.col("id").alias("b"), F.col("component").alias("q"))
    return pairs.join(p, "a").join(q, "b").where("p <> q").select("a", "b")


#: First partners of a document.
FIRST = 2


def _families(members: DataFrame) -> DataFrame:
    """(hub, id, n, weight): each document with the hubs of its tiles, itself among them where it is one, and the number of tiles.

    A tile's hub is its member that is in most tiles: the text that others are edited from keeps all
    its parts, while each edited one has parts of its own. All tiles of a hub make a family, so two
    that meet in a tile are in a family together; a family's rows are documents, not tiles.
    """
    weight = members.groupBy("id").agg(F.sum("shared").alias("weight"))
    hub = members.join(weight, "id").groupBy("tile").agg(F.max(F.struct("weight", -F.col("id"))).alias("h")).select("tile", (-F.col("h.col2")).alias("hub"), F.col("h.weight").alias("weight"))
    return members.join(hub, "tile").groupBy("hub", "id").agg(F.sum("shared").alias("n"), F.max("weight").alias("weight"))


def _first_pairs(families: DataFrame) -> DataFrame:
    """(a, b): each document with the FIRST hubs that it shares most tiles with."""
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), F.desc("weight"), "hub"))
    few = families.where("id <> hub").withColumn("place", best).where(F.col("place") <= FIRST)
    return few.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): component_id is the smallest doc_id reachable by links, class_id the smallest of an equal set.

    docs(doc_id long, text string). A link: 100 * intersection >= num * union of the sets of n-word
    shingles. num from 80 to 100.
    """
    spark = docs.sparkSession
    parts = c.shuffle_partitions(spark)
    docs = docs.select("doc_id", "text")
    sets = c.checkpoint(document_sets(docs, n))
    some = sets.where("n_shingles > 0")
    classes = c.checkpoint(some.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("id")))
    met = c.checkpoint(_meet(_tiled(docs, n, num), parts))
    reps = classes.select(F.col("h1").alias("key"), "id")
    members = c.checkpoint(met.groupBy("tile", "key").agg(F.sum("shared").alias("shared")).join(reps, "key").select("tile", "id", "shared"))
    families = c.checkpoint(_families(members))
    pairs = c.checkpoint(_first_pairs(families))
    wanted = members.select("id").distinct()
    arrays = c.checkpoint(_arrays(docs, wanted, n), WIDE)
    maps = c.checkpoint(_maps(arrays), WIDE)
    nodes = arrays.select("id").distinct()
    linked = c.checkpoint(verify(_possible(pairs, maps, num), arrays, num, parts), WIDE)
    comp = c.checkpoint(c.components(nodes, linked))
    more = c.checkpoint(_crossing(families, comp, maps, num, parts), 4)  # rows of two blocks
    for last in (False, True):  # first one pair of each document, then all that still lie apart
        now = more if last else more.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        late = c.checkpoint(verify(now, arrays, num, parts), WIDE)
        linked = c.checkpoint(linked.unionByName(late))
        comp = c.checkpoint(c.components(nodes, linked))
        more = c.checkpoint(_still(more.join(now, ["a", "b"], "left_anti"), comp))
    of_class = classes.join(comp, "id", "left").select("n_shingles", "h1", "h2", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))
    linked_docs = some.join(of_class, ["n_shingles", "h1", "h2"]).select("doc_id", "n_shingles", "component_id", "class_id")
    return linked_docs.unionByName(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id")))


"""Line dedup by pairwise alignment: shared passages and rare lines find pairs, a patience diff aligns them.

A passage is the least run of lines from a line on that a block may consist of: ``block_bytes`` bytes
(blank lines count none) or ``block_lines`` lines. Passages that 2 texts or more hold are keys, however
many hold them; so are lines that 2 to ``rare`` texts hold, whatever their length. Each text that holds
a key is aligned with the first text (smallest doc_id) that holds it, so a key makes as many pairs as it
has later holders; the first text of many pairs goes to several tasks. Common blocks of an alignment, of
at least ``block_bytes`` bytes or ``block_lines`` lines, are deleted from the later document; a line's
first holder always keeps it. Equal texts count once, and the later of them lose every line. Alignments
move hashes of lines, not texts, and texts that lose nothing aren't shuffled. ``rare`` is a part of the
method: a line that more texts hold, too short to be a passage, starts no alignment of its own.

Defined results: null and empty texts have no lines and lose none; blank lines are no keys, but go with
their block; rows that repeat a doc_id must repeat its text and are one document, none of which is the
later; rows without doc_id come back as they are; other columns are kept.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as c

RARE, BLOCK_LINES, BLOCK_BYTES = 50, 3, 64
#: Pairs of one first text that go to a task.
PAIR_SHARE = 4096


def line_hashes(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each text its lines' hashes (0: blank), their lengths, and the hash of the whole."""
    out = []
    for i, j in c.blocks(texts):
        block = c.Block(texts[i:j])
        end = np.flatnonzero(block.data == 10)
        start = np.concatenate(([0], end[:-1] + 1))
        h = block.hashes(start, end)
        full = np.concatenate(([0], np.cumsum(~c._SPACE[block.data])))
        h[full[end] == full[start]] = 0
        first = np.searchsorted(start, block.start)
        last = np.append(first[1:], len(start))
        whole = block.hashes(block.start, block.end)
        for a, b, w in zip(first, last, c.signed(whole).tolist(), strict=True):
            out.append((h[a:b], (end - start)[a:b], w))
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (place in a, place in b, lines), in order, of a patience diff.

    Lines that are unique in both and lie in the longest increasing order are anchors; equal ends are
    trimmed first, and the gaps between anchors are aligned likewise.
    """
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            pairs.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            pairs.append((j, m))
        if i == j or k == m:
            continue
        once_a, once_b = _once(a, i, j), _once(b, k, m)
        common = sorted((once_a[x], y) for x, y in once_b.items() if x in once_a)
        anchors = _increasing(common)
        if not anchors:
            continue
        edge = [(i - 1, k - 1), *anchors, (j, m)]
        pairs += anchors
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edge[:-1], edge[1:], strict=True)]
    blocks: list[tuple[int, int, int]] = []
    for x, y in sorted(pairs):
        if blocks and blocks[-1][0] + blocks[-1][2] == x and blocks[-1][1] + blocks[-1][2] == y:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((x, y, 1))
    return blocks


def _once(lines: list[int], i: int, j: int) -> dict[int, int]:
    """Places of the lines of [i, j) that come once in it, but for blank ones."""
    at: dict[int, int] = {}
    for k in range(i, j):
        at[lines[k]] = -1 if lines[k] in at else k
    return {x: k for x, k in at.items() if k >= 0 and x}


def _increasing(common: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, whose second increases."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(common)
    for n, (_, y) in enumerate(common):
        k = bisect.bisect_left(tails, y)
        if k == len(tails):
            tails.append(y)
            at.append(n)
        else:
            tails[k], at[k] = y, n
        back[n] = at[k - 1] if k else -1
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(common[n])
        n = back[n]
    return out[::-1]


def block_keys(h: np.ndarray, sizes: np.ndarray, counts: np.ndarray, block_lines: int, block_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, passage) of texts with so many lines each: their lines' hashes and, marked, their passages', once a text."""
    text = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(h))
    total = np.concatenate(([0], np.cumsum(np.where(h == 0, 0, sizes), dtype=np.int64)))
    filled = np.concatenate(([0], np.cumsum(h != 0)))
    lines, at = np.flatnonzero(h), np.arange(len(h))
    texts, keys, marks = [text[lines]], [h[lines]], [np.zeros(len(lines), bool)]
    key = c.U(0)
    for w in range(1, block_lines + 1):
        at = at[left[at] >= w]
        key = h[at].view(c.U) if w == 1 else c.mix(key[left[prior] >= w] + c.U(w)) + h[at + w - 1].view(c.U)
        whole = (total[at + w] - total[at] >= block_bytes) | (w == block_lines)
        held = whole & (filled[at + w] > filled[at])
        texts.append(text[at[held]])
        keys.append(c.signed(key[held]))
        marks.append(np.ones(int(held.sum()), bool))
        at, key = at[~whole], key[~whole]
        prior = at
    text, key, mark = np.concatenate(texts), np.concatenate(keys), np.concatenate(marks)
    order = np.lexsort((~mark, key, text))
    text, key, mark = text[order], key[order], mark[order]
    once = np.concatenate(([True], (np.diff(text) != 0) | (key[1:] != key[:-1])))[: len(text)]
    return text[once], key[once], mark[once]


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, whole, also, lines, hashes, sizes) of each document; whole and also are two 64-bit hashes of its text."""
    schema = pa.schema([("doc_id", pa.int64()), ("whole", pa.int64()), ("also", pa.int64()), ("lines", pa.int32()), ("hashes", pa.binary()), ("sizes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = line_hashes(c.as_bytes(c.column(b, "text")))
            yield c.record_batch(schema, c.column(b, "doc_id"), [w for *_, w in got], c.column(b, "also"), [len(h) for h, *_ in got], [h.tobytes() for h, *_ in got], [s.astype(np.int32).tobytes() for _, s, _ in got])

    return docs.withColumn("also", F.xxhash64("text")).mapInArrow(c.tidied(run), "doc_id long, whole long, also long, lines int, hashes binary, sizes binary")


def removed_lines(docs: DataFrame, rare: int = RARE, block_lines: int = BLOCK_LINES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, spans, all_lines): for each document that loses lines the spans (first line, lines) of the deleted blocks, which may overlap, and whether it loses all."""
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND octet_length(text) > 0")
    every = c.checkpoint(_documents(docs))
    same = ["whole", "also", "lines"]
    first = every.groupBy(*same).agg(F.min("doc_id").alias("first"))
    marked = c.checkpoint(every.join(first, same))
    own = marked.where("doc_id = first").dropDuplicates(["doc_id"])
    keys = pa.schema([("line", pa.int64()), ("passage", pa.bool_()), ("doc_id", pa.int64())])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, counts = (c.column(b, x).to_numpy() for x in ("doc_id", "lines"))
            h, sizes = (np.frombuffer(b"".join(c.column(b, x).to_pylist()), t) for x, t in (("hashes", np.int64), ("sizes", np.int32)))
            text, key, passage = block_keys(h, sizes, counts, block_lines, block_bytes)
            yield c.record_batch(keys, key, passage, ids[text])

    held = own.select("doc_id", "lines", "hashes", "sizes").mapInArrow(c.tidied(lines), "line long, passage boolean, doc_id long")
    shared = held.groupBy("line").agg(F.count("*").alias("n"), F.max("passage").alias("passage"), F.min("doc_id").alias("a")).where((F.col("n") >= 2) & (F.col("passage") | (F.col("n") <= rare))).select("line", "a")
    shared = c.checkpoint(shared)
    few = c.semi_filtered(held.select("line", "doc_id"), "line", shared)  # lines that are no keys, the very common ones among them, aren't shuffled
    pairs = c.checkpoint(few.join(shared, "line").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct())
    body = own.select("doc_id", "hashes", "sizes")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIR_SHARE).cast("int").alias("parts"))
    firsts = body.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")).join(parts, "a").select("a", "ha", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    # a part gets its first text's hashes once, ahead of those of the later texts
    later = dealt.join(body.select(F.col("doc_id").alias("b"), "hashes", "sizes"), "b").select("a", "part", "b", "hashes", "sizes")
    heads = firsts.select("a", "part", F.lit(None).cast("long").alias("b"), F.col("ha").alias("hashes"), F.lit(None).cast("binary").alias("sizes"))
    met = heads.unionByName(later).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    spans = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("n", pa.int32())])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[int] = []
        for batch in batches:
            rows = []
            for b, hashes, sizes in zip(*(c.column(batch, x).to_pylist() for x in ("b", "hashes", "sizes")), strict=True):
                own = np.frombuffer(hashes, np.int64).tolist()
                if b is None:
                    first = own
                    continue
                size = np.frombuffer(sizes, np.int32)
                for _, at, n in patience(first, own):
                    if n >= block_lines or int(size[at : at + n].sum()) >= block_bytes:
                        rows.append((b, at, n))
            yield c.record_batch(spans, *(zip(*rows, strict=True) if rows else [[]] * 3))

    blocks = met.mapInArrow(c.tidied(align), "doc_id long, line int, n int").groupBy("doc_id").agg(F.collect_set(F.struct("line", "n")).alias("spans"))
    copies = marked.where("doc_id <> first").select("doc_id", F.array(F.struct(F.lit(0).alias("line"), F.col("lines").alias("n"))).alias("spans"), F.lit(True).alias("all_lines")).distinct()
    return blocks.withColumn("all_lines", F.lit(False)).unionByName(copies)


def _apply(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """docs with ``kept`` (the text that is left), ``n_lines``, ``n_removed`` and ``n_blocks``; the text itself stays."""
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_blocks", pa.int64())])
    names = [f"c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    text, ids = names[docs.columns.index("text")], names[docs.columns.index("doc_id")]
    cuts = c.checkpoint(cuts.select(F.col("doc_id").alias("__id"), "spans"))
    some, rest = c.parted(docs.toDF(*names), [ids], cuts.select(F.col("__id").alias(ids)))
    joined = some.join(cuts, F.col(ids) == F.col("__id"), "left").select(*names, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, counts = [], []
            for t, spans in zip(c.column(b, text).to_pylist(), c.column(b, "spans").to_pylist(), strict=True):
                if not spans:
                    kept.append(t)
                    counts.append((t.count("\n") + 1 if t else 0, 0, 0))
                    continue
                lines = t.split("\n")
                drop = np.zeros(len(lines) + 1, bool)
                for s in spans:
                    drop[s["line"] : s["line"] + s["n"]] = True
                kept.append("\n".join(x for x, d in zip(lines, drop, strict=False) if not d))
                counts.append((len(lines), int(drop.sum()), int((drop[1:] > drop[:-1]).sum() + drop[0])))
            n, r, k = zip(*counts, strict=True) if counts else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(kept, pa.string()), *(pa.array(x, pa.int64()) for x in (n, r, k))], [*names, *schema.names[1:]])

    cut = joined.mapInArrow(c.tidied(run), f"{kinds}, kept string, n_lines long, n_removed long, n_blocks long")
    n_lines = F.when(F.octet_length(text) > 0, F.length(text) - F.length(F.translate(text, "\n", "")) + 1).otherwise(0).cast("long")
    none = F.lit(0).cast("long")
    whole = rest.select(*names, F.col(text).alias("kept"), n_lines.alias("n_lines"), none.alias("n_removed"), none.alias("n_blocks"))
    return cut.unionByName(whole).toDF(*docs.columns, "kept", "n_lines", "n_removed", "n_blocks")


def deduplicated(docs: DataFrame, rare: int = RARE, block_lines: int = BLOCK_LINES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of docs(doc_id, text, ...) with the text that is left; documents that lose all go."""
    clash = [x for x in docs.columns if x not in ("doc_id", "text")]
    out = _apply(docs, removed_lines(docs, rare, block_lines, block_bytes))
    kept = out.toDF(*[f"c{i}" for i in range(len(docs.columns))], "kept", "n_lines", "n_removed", "n_blocks").where("n_removed = 0 OR n_removed < n_lines")
    names = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    own = lambda n: F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col(names[n])).cast(docs.schema[n].dataType).alias(n)
    return kept.select(*(F.col("kept").alias(n) if n == "text" else own(n) if n == "n_chars" and n in clash else F.col(names[n]).alias(n) for n in docs.columns))


def line_report(docs: DataFrame, rare: int = RARE, block_lines: int = BLOCK_LINES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_blocks, kept_sha256) of each document."""
    docs = docs.select("doc_id", "text")
    out = _apply(docs, removed_lines(docs, rare, block_lines, block_bytes))
    return out.select("doc_id", "n_lines", "n_removed", "n_blocks", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))

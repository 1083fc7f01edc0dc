"""Merkle dataset manifest: an external-memory tree over the rows of a table.

Leaves are hashed where the texts are read and range-sorted by (group, order) into runs on disk; sums
over the runs' pieces give each leaf its coordinate, (group, index). A level of the tree is a folder of
Parquet, ``level=k``, written by tasks that stream through the files of the level below, hold FAN hashes
at once and need no shuffle: a node whose children lie in two splits of a file comes out as fragments,
at most two for each stretch of consecutive nodes, and only those are grouped. The groups' subroots are
the leaves of a second tree of the same kind, whose top is the root. Proofs are extracted from the top
down by merges of each level with the one above on the coordinate, so a node's path is read once for its
children, and texts are never read again.

Defined results: null groups come first, as a group of their own, apart from empty ones; null order
values come first in their group; ties go by the leaf's hash, and equal rows, whose leaves are equal, in
any order; empty and null texts differ; an empty table has no leaves and a null root; columns that the
leaf doesn't name are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as c

#: Children of a node, as a power of two.
FAN_BITS = 3
FAN = 1 << FAN_BITS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("kids", pa.list_(pa.string())), ("hash", pa.string())])


def digest(*columns: Column) -> Column:
    """SHA-256, in hexadecimal, of each value as ``-`` if null, else its UTF-8 length, a colon and itself."""
    told = (x.cast("string") for x in columns)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in told)), 256)


@dataclass(frozen=True)
class Tree:
    """levels[0]: the leaves with their coordinates (grp, idx) among n; levels[k]: (grp, idx, n, kids, hash). Groups end at the level where n is 1."""

    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """(level, grp, idx, kids, hash): one node for each group."""
        found = None
        for k, x in enumerate(self.levels):
            kids = F.col("kids") if k else F.lit(None).cast("array<string>")
            top = x.where("n = 1").select(F.lit(k).alias("level"), "grp", "idx", kids.alias("kids"), "hash")
            found = top if found is None else found.unionByName(top)
        return found


def numbered(rows: DataFrame, order: str, folder: str) -> DataFrame:
    """Leaves rows(grp, hash, order, ...) as sorted runs with idx, the place within grp by order, and n, the rows of grp.

    Rows are range-sorted, so a group of any size is dealt to many tasks; of each task only the counts
    of its groups, (tasks + groups) rows at most, take part in the sums.
    """
    rows = c.stored(rows.withColumn("seq", F.monotonically_increasing_id()), f"{folder}/rows")
    keys = [F.asc("grp"), F.asc_nulls_first(order), F.asc("hash"), F.asc("seq")]
    ranged = rows.repartitionByRange(c.tasks_for(rows), *keys).sortWithinPartitions(*keys)
    runs = c.stored(ranged.drop("seq").withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), f"{folder}/runs")
    pieces = runs.groupBy("grp", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = pieces.select("grp", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("grp")).alias("n"))
    spans = c.stored(spans, f"{folder}/spans")
    placed = runs.join(spans, ["grp", "part"]).withColumn("idx", F.expr("place - first + before"))
    return c.stored(placed.drop("part", "place", "first", "before").sortWithinPartitions("grp", "idx"), f"{folder}/level=0")


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of consecutive children, and fragments (hash null) of nodes whose children aren't all beside one another."""
    held: tuple[str, int, int, int, list[str]] | None = None

    def told(found: list[tuple[str, int, int, int, list[str]]]) -> pa.RecordBatch:
        rows = [(g, run, -(-n // FAN), at, kids, hashlib.sha256("".join(kids).encode()).hexdigest() if len(kids) == min(FAN, n - FAN * run) else None) for g, run, n, at, kids in found]
        return c.record_batch(_NODE, *(zip(*rows, strict=True) if rows else [[]] * 6))

    for b in batches:
        if not b.num_rows:
            continue
        group = c.column(b, "grp").dictionary_encode().indices.to_numpy()
        idx, n = (c.column(b, x).to_numpy() for x in ("idx", "n"))
        run = idx >> FAN_BITS
        starts = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (idx[1:] != idx[:-1] + 1) | (group[1:] != group[:-1]))))
        names, hashes = c.column(b, "grp").take(pa.array(starts)).to_pylist(), c.column(b, "hash").to_pylist()
        found = []
        for s, e, name in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows], names, strict=True):
            if held and held[:2] == (name, int(run[s])) and held[3] + len(held[4]) == idx[s]:
                held[4].extend(hashes[s:e])
                continue
            if held:
                found.append(held)
            held = (name, int(run[s]), int(n[s]), int(idx[s]), hashes[s:e])
        yield told(found)
    if held:
        yield told([held])


def build(rows: DataFrame, order: str, folder: str) -> Tree:
    """The trees of all groups of rows(grp, hash, order, ...); grp isn't null."""
    levels = [numbered(rows, order, folder)]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        path = f"{folder}/level={len(levels)}"
        kinds = "grp string, idx long, n long, at long, kids array<string>, hash string"
        part = c.stored(levels[-1].where("n > 1").select("grp", "idx", "n", "hash").mapInArrow(c.tidied(_climb), kinds), path)
        torn = part.where("hash IS NULL").groupBy("grp", "idx", "n").agg(F.array_sort(F.collect_list(F.struct("at", "kids"))).alias("parts"))  # FAN at most
        mended = torn.select("grp", "idx", "n", F.lit(0).cast("long").alias("at"), F.flatten("parts.kids").alias("kids")).withColumn("hash", F.sha2(F.array_join("kids", ""), 256))
        levels.append(c.stored(mended, path, "append").where("hash IS NOT NULL").drop("at"))
        most = -(-most // FAN)
    return Tree(levels)


def proofs(tree: Tree, above: DataFrame, folder: str) -> DataFrame:
    """The leaves with ``steps``, the siblings (before, after) on each level from the leaf up, and above's columns.

    above(grp, steps, ...): what follows at the top of each group.
    """
    tops = c.stored(tree.tops().drop("hash").join(above, "grp"), f"{folder}/tops")
    carried = [x for x in above.columns if x != "grp"]
    upper: DataFrame | None = None
    for k in range(len(tree.levels) - 1, -1, -1):
        level = tree.levels[k]
        own = ["grp", "idx", "kids"] if k else level.columns
        found = level.where("n = 1").join(tops.where(F.col("level") == k).select("grp", *carried), "grp").select(*own, *carried)
        if upper is not None:
            near = upper.select("grp", F.col("idx").alias("up"), F.col("kids").alias("run"), *carried)
            place = F.col("idx").bitwiseAND(FAN - 1).cast("int")
            step = F.struct(F.array_join(F.slice("run", 1, place), "").alias("before"), F.array_join(F.slice("run", place + 2, FAN), "").alias("after"))
            below = level.where("n > 1").withColumn("up", F.shiftright("idx", FAN_BITS)).join(near, ["grp", "up"])
            found = found.unionByName(below.withColumn("steps", F.concat(F.array(step), "steps")).select(*own, *carried))
        upper = found
    return upper


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def manifest(rows: DataFrame, order: str) -> tuple[DataFrame, str | None]:
    """(the leaves with subroot and steps, the root) of rows(grp, hash, order, ...), where grp may be null."""
    folder = c.shared_folder(rows.sparkSession, "manifest")
    named = rows.withColumn("grp", F.coalesce(F.concat(F.lit("="), F.col("grp").cast("string")), F.lit("")))  # null first, then bytewise
    tree = build(named, order, f"{folder}/groups")
    roots = build(tree.tops().select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash"), "name", f"{folder}/root")
    top = roots.tops().select("hash").first()
    nothing = rows.sparkSession.createDataFrame([("", [])], "grp string, steps array<struct<before: string, after: string>>")
    above = proofs(roots, nothing, f"{folder}/root").select(F.col("name").alias("grp"), F.col("hash").alias("subroot"), "steps")
    return proofs(tree, above, f"{folder}/groups"), top and top[0]


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, grp, hash, forged) of documents: lang is the group; forged is the leaf after a known tampering, which lower-cases A-Z of the texts of every third document by checksum, else null."""
    rest = [F.col(x) for x in ("doc_id", "source", "lang", "n_chars")]
    struck = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return docs.select("doc_id", F.col("lang").alias("grp"), digest(*rest, F.col("text")).alias("hash"), F.when(struck, digest(*rest, F.translate("text", UPPER, LOWER))).alias("forged"))


def audited(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents; see document_leaves for the tampering that the last two face."""
    found, root = manifest(document_leaves(docs), "doc_id")
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    out = found.select("doc_id", F.col("hash").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), folded(F.coalesce("forged", "hash"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Conversation prefix trie: nodes by chained digests, subtree sums by exploding nodes to their ancestors.

A turn is a digest of role and text, made where the texts are read; nothing after that moves texts. A
task streams through a conversation's turns in order and chains them, a cryptographic digest for every
prefix, holding one state. Prefixes grouped by (depth, digest) are the nodes; the smallest member names
a node, and the nodes that a conversation names are a chain, the lower end of its path, because what is
the smallest of all members stays the smallest below. So the explosion of nodes to all ancestors needs a
row for each chain and ancestor chain, with the depth at which it leaves it, rather than one for each
pair of nodes: what hangs on a chain is summed there, and running sums from a chain's lower end give the
subtrees. The rows are as many as branchings on the paths, however long the conversations are.

Lists of the conversations that end at a node are hashed as a stream: a range sort by node and
conversation deals them out, whatever one node's share; tasks join them to strings of PIECE bytes, and
only those pass in order through the hash, which none can compute but one after the other.

Defined results: rows without conversation take no part; null role and text are empty, and roles and
texts are told apart ("a" + "bc" isn't "ab" + "c"); null turns come first; turns of one number go by
their digests; repeated rows are turns of their own; a conversation without turns after rebuilding is a
member of the root; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as c

#: Bytes of joined ids that one row holds.
PIECE = 1 << 16
_PREFIX = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("bytes", pa.int64())])
_ROOT = hashlib.sha256(b"").digest()


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, place, digest, bytes): each turn's place in its conversation, from 1, the digest of its role and text, and its text's UTF-8 length."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    told = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", told.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.withColumn("place", F.row_number().over(order)).drop("turn")


def shared_turns(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first one of its five: a checksum modulo 9."""
    return F.crc32(conv_id.cast("string")) % 9


def rebuilt(turns: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """(conv_id, part, place, digest, bytes) of turn_digests' rows: part 0 is what each conversation takes from conversation ``conv_id - conv_id % group``, part 1 what it keeps.

    At most ``most`` turns are taken, so a conversation of any length is copied in that part only.
    """
    first = F.col("conv_id") % group == 0
    kept = turns.where(first | (F.col("place") > shared_turns(F.col("conv_id")))).withColumn("part", F.lit(1))
    others = turns.where(first & (F.col("place") <= most)).withColumn("near", F.explode(F.sequence(F.lit(1 - group), F.lit(group - 1))))
    others = others.withColumn("to", F.col("conv_id") + F.col("near")).where("near <> 0").where((F.col("to") - F.col("to") % group == F.col("conv_id")) & (F.col("place") <= shared_turns(F.col("to"))))
    taken = others.drop("conv_id", "near").withColumnRenamed("to", "conv_id").join(turns.where("place = 1").select("conv_id"), "conv_id", "left_semi")
    return kept.unionByName(taken.withColumn("part", F.lit(0)))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest for every prefix, of rows in order of conversation and turn."""
    last, depth, state = None, 0, _ROOT
    for b in batches:
        conv, depths, digests = c.column(b, "conv_id"), [], []
        for x, told in zip(conv.to_pylist(), c.column(b, "digest").to_pylist(), strict=True):
            if x != last:
                last, depth, state = x, 0, _ROOT
            depth, state = depth + 1, hashlib.sha256(state + told).digest()
            depths.append(depth)
            digests.append(state)
        yield c.record_batch(_PREFIX, conv, depths, digests, c.column(b, "bytes"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, bytes) of every prefix of at least one turn of turns(conv_id, part, place, digest, bytes)."""
    order = ["conv_id", "part", "place"]
    dealt = turns.select(*order, "digest", "bytes").repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(c.tidied(_chain), "conv_id long, depth long, digest binary, bytes long")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of ids of rows sorted by (node, depth, conv_id): (node, depth, first, ids) for runs of one node."""
    schema = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    for b in batches:
        if not b.num_rows:
            continue
        node, depth, conv = (c.column(b, x).to_numpy() for x in ("node", "depth", "conv_id"))
        cut = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (depth[1:] != depth[:-1]))))
        size = np.diff(np.append(cut, len(node)))
        step = PIECE // 21  # digits of a long, its sign and a comma
        starts = np.concatenate([np.arange(s, s + n, step) for s, n in zip(cut.tolist(), size.tolist(), strict=True)])
        told = list(map(str, conv.tolist()))
        yield c.record_batch(schema, node[starts], depth[starts], conv[starts], [",".join(told[s:e]) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(told)], strict=True)])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, depth, ends_sha256) of pieces in order."""
    schema = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    last, state = None, hashlib.sha256()
    for b in batches:
        rows = []
        for node, depth, ids in zip(*(c.column(b, x).to_pylist() for x in ("node", "depth", "ids")), strict=True):
            if (node, depth) == last:
                state.update(b",")
            else:
                if last:
                    rows.append((*last, state.hexdigest()))
                last, state = (node, depth), hashlib.sha256()
            state.update(ids.encode())
        yield c.record_batch(schema, *(zip(*rows, strict=True) if rows else [[]] * 3))
    if last:
        yield c.record_batch(schema, *([x] for x in (*last, state.hexdigest())))


def ends(last: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of last(conv_id, node, depth): SHA-256 of the ids of those that end at a node, ascending."""
    order = ["node", "depth", "conv_id"]
    ranged = last.select(*order).repartitionByRange(c.tasks_for(last), *order).sortWithinPartitions(*order)
    pieces = ranged.mapInArrow(c.tidied(_joined), "node long, depth long, first long, ids string")
    return pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(c.tidied(_hashed), "node long, depth long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    turns(conv_id, part, place, digest, bytes): of each conversation, in the order of part and place.
    convs(conv_id): all conversations, distinct, those without turns too. Skewed prefixes, which many
    conversations begin with, meet their node in a join, whose large partitions Spark divides.
    """
    folder = c.shared_folder(convs.sparkSession, "trie")
    convs = c.stored(convs, f"{folder}/convs")
    made = c.stored(prefixes(turns), f"{folder}/prefixes")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")  # one row
    named = made.groupBy("depth", "digest").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"))
    named = c.stored(named, f"{folder}/named")
    nodes = named.select(F.col("node").alias("conv_id"), "depth", "n_convs", "bytes").unionByName(root.select("conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("bytes")))

    # Every prefix, told by its node; then a row for each conversation and chain on its path, with the depths where they part.
    told = made.select("conv_id", "depth", "digest").join(named.select("depth", "digest", "node"), ["depth", "digest"]).select("conv_id", "depth", "node")
    told = told.unionByName(convs.crossJoin(F.broadcast(root.select(F.col("conv_id").alias("node")))).select("conv_id", F.lit(0).cast("long").alias("depth"), "node"))  # one row
    runs = c.stored(told.groupBy("conv_id", "node").agg(F.min("depth").alias("low"), F.max("depth").alias("high")), f"{folder}/runs")
    own = runs.where("conv_id = node").select("conv_id", "low", "high")
    over = runs.where("conv_id <> node").select("conv_id", F.col("node").alias("above"), F.col("high").alias("at"))
    parents = over.groupBy("conv_id").agg(F.max_by("above", "at").alias("above"), F.max("at").alias("at"))
    chains = c.stored(own.join(parents, "conv_id", "left"), f"{folder}/chains")

    hung = chains.where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("hung"))
    known = nodes.join(hung, ["conv_id", "depth"], "left").join(chains, "conv_id")
    children = F.coalesce("hung", F.lit(0)) + F.when(F.col("depth") < F.col("high"), 1).otherwise(0)
    known = known.select("conv_id", "depth", "n_convs", F.when(F.col("depth") > F.col("low"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"), children.alias("n_children"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    known = c.stored(known.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0)), f"{folder}/nodes")

    sums = known.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    below = over.join(sums, "conv_id").groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("more_saved"), F.sum("leaf").alias("more_leaf"))
    down = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda own, more: F.sum(F.col(own) + F.coalesce(more, F.lit(0))).over(down)
    summed = known.join(below, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), total("leaf", "more_leaf").alias("n_leaves"), total("saved", "more_saved").alias("saved_tokens"))

    last = c.stored(runs.groupBy("conv_id").agg(F.max_by("node", "high").alias("node"), F.max("high").alias("depth")), f"{folder}/last")
    listed = ends(last).withColumnRenamed("node", "conv_id")
    return summed.join(listed, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations(conv_id, turn, role, text)."""
    turns = c.checkpoint(turn_digests(conversations))
    return trie(rebuilt(turns), turns.where("place = 1").select("conv_id"))

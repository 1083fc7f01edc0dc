"""WARC: Merkle fixity audit of replicas.

Every record is hashed, with its file and range of offsets; record numbers in order, FAN to a node, make
a tree whose nodes also hash the range of places below them. Two replicas' roots are compared, and only
branches that differ are descended, so what is exchanged shrinks with the damage. DataFrame functions
only.

Defined results: a record whose bytes are whole but lie elsewhere is damage, with equal digests and its
two places; so are those that lost or inserted bytes shift; a null place differs from all others; rows without record number take no part; null record bytes are empty; rows that
repeat a number make one leaf of all of them, whatever their order; a number that only one replica has
is damage, with null on the other side; an empty replica differs in every leaf; two empty ones nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as c

#: Children of a node, as a power of two.
FAN_BITS = 4
_PARTS = 4


def page_records(pages: DataFrame, per_file: int = 256) -> DataFrame:
    """(record, file, content): each page as a WARC/1.1 response record, per_file numbers to a file."""
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "))
    body = F.coalesce("html", F.lit(""))
    content = F.concat(head, F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))
    return pages.where("page_id IS NOT NULL").select(F.col("page_id").alias("record"), F.floor(F.col("page_id") / per_file).alias("file"), content.cast("binary").alias("content"))


def placed(records: DataFrame) -> DataFrame:
    """records(record, file, size, digest, ...) with (start, stop): the range of bytes of each in its file, in order of record. Give it digests, not contents, so that only these are shuffled."""
    order = Window.partitionBy("file").orderBy("record", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return records.withColumn("stop", F.sum("size").over(order)).withColumn("start", F.col("stop") - F.col("size"))


def warc_records(pages: DataFrame, per_file: int = 256) -> DataFrame:
    """(record, file, start, stop, content): pages as records, with their contents and places."""
    rows = page_records(pages, per_file)
    return placed(rows.withColumn("size", F.octet_length("content")).withColumn("digest", F.sha2("content", 256))).select("record", "file", "start", "stop", "content")


def leaves(records: DataFrame) -> DataFrame:
    """(node, digest, seal, file, start, stop): one leaf for each record number; digest is of its bytes, seal of bytes and place. Sums of parts of the hashes make repeated numbers one digest, without collecting them."""
    digest = F.col("digest") if "digest" in records.columns else F.sha2(F.coalesce("content", F.lit(b"")), 256)
    part = lambda h, i: F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    told = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("-"))
    rows = records.where("record IS NOT NULL").select(F.col("record").cast("long").alias("node"), digest.alias("h"), "file", "start", "stop")
    rows = rows.withColumn("s", F.sha2(F.concat_ws(":", "h", told("start"), told("stop"), told("file")), 256))
    got = rows.groupBy("node").agg(F.count("*").alias("n"), *(F.min(h).alias(h) for h in "hs"), *(part(h, i).alias(f"{h}{i}") for h in "hs" for i in range(_PARTS)), F.min("file").alias("file"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    one = lambda h: F.when(F.col("n") == 1, F.col(h)).otherwise(F.sha2(F.concat_ws(":", "n", *(f"{h}{i}" for i in range(_PARTS))), 256))
    return got.select("node", one("h").alias("digest"), one("s").alias("seal"), "file", "start", "stop")


def _parent(node: Column) -> Column:
    return F.shiftright(node, FAN_BITS)


def tree(leaf: DataFrame, levels: int) -> list[DataFrame]:
    """Levels 0 (leaves) to ``levels``: (node, seal, first, last): of each node its hash and the first and last place, (file, offset), below it."""
    out = [leaf.select("node", "seal", F.struct("file", F.col("start").alias("at")).alias("first"), F.struct("file", F.col("stop").alias("at")).alias("last"))]
    told = lambda n: F.coalesce(F.to_json(n), F.lit("-"))
    for _ in range(levels):
        kids = out[-1].groupBy(_parent(F.col("node")).alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "seal"))).alias("kids"), F.min("first").alias("first"), F.max("last").alias("last"))
        joined = F.array_join(F.transform("kids", lambda k: F.concat_ws("=", k["node"].cast("string"), k["seal"])), ";")
        out.append(c.checkpoint(kids.select(F.col("up").alias("node"), F.sha2(F.concat_ws("|", joined, told("first"), told("last")), 256).alias("seal"), "first", "last")))
    return out


def _height(a: DataFrame, b: DataFrame) -> int:
    """Levels until all numbers of both replicas share a node, or one on each side of zero."""
    low, high = a.select("node").unionByName(b.select("node")).agg(F.min("node"), F.max("node")).first()
    if low is None:
        return 0
    n = 0
    while (top := (low >> FAN_BITS * n, high >> FAN_BITS * n)) != (-1, 0) and top[0] != top[1]:
        n += 1
    return n


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(record, file, start, stop, digest_a, digest_b, file_b, start_b, stop_b): each damaged, moved, missing or extra record, where it lies (in a, or where a lacks it in b), and where in b.

    a, b: replicas, as warc_records gives them, or with ``digest`` (SHA-256 in hexadecimal) in place of ``content``.
    """
    leaf_a, leaf_b = c.checkpoint(leaves(a)), c.checkpoint(leaves(b))
    height = _height(leaf_a, leaf_b)
    trees = tree(leaf_a, height), tree(leaf_b, height)
    below: DataFrame | None = None
    for k in range(height, -1, -1):
        x, y = (t[k].select("node", F.col("seal").alias(f"seal_{s}")) for t, s in zip(trees, "ab", strict=True))
        if below is not None:
            up = below.select(F.col("node").alias("up"))
            x, y = (z.join(up, _parent(z.node) == up.up, "left_semi") for z in (x, y))
        level = x.join(y, "node", "full_outer")
        below = level.where(~F.col("seal_a").eqNullSafe(F.col("seal_b")))
        if k:
            below = c.checkpoint(below)
            if not below.limit(1).count():
                break
    assert below is not None
    places = (z.select(F.col("node").alias(f"node_{s}"), *(F.col(n).alias(f"{n}_{s}") for n in ("digest", "file", "start", "stop"))) for z, s in ((leaf_a, "a"), (leaf_b, "b")))
    pa_, pb_ = places
    found = below.join(pa_, below.node == pa_.node_a, "left").join(pb_, below.node == pb_.node_b, "left")
    return found.select(F.col("node").alias("record"), *(F.coalesce(f"{n}_a", f"{n}_b").alias(n) for n in ("file", "start", "stop")), "digest_a", "digest_b", "file_b", "start_b", "stop_b")

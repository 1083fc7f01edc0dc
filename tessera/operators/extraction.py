"""Triples from what a model replies about each chunk: parsed, filtered by the vocabulary, and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import prompts as P
from tessera.functions import text as T
from tessera.operators import completion, mentions
from tessera.operators.graph import accepted
from tessera.operators.lineage import cut
from tessera.operators.ranking import first_n

_SHAPE = '{"triples": [{"subject": "", "relation": "", "object": ""}]}'


def proposed(replies: DataFrame) -> DataFrame:
    """(chunk_id, n, src, rel, dst) of replies(chunk_id, json): what each says, an element for each of its list. What is no list has none; an element that is no object has no parts."""
    return _told(replies).where("n IS NOT NULL")


def _told(replies: DataFrame) -> DataFrame:
    """As ``proposed``, with a row without n for each reply that proposes nothing."""
    body = F.get_json_object("json", "$.triples")
    listed = F.when(body.rlike(r"^\s*\["), F.from_json(body, "array<string>"))
    rows = replies.select("chunk_id", F.posexplode_outer(listed).alias("n", "t"))
    part = lambda x: F.coalesce(F.get_json_object("t", f"$.{x}"), F.lit(""))
    return rows.select("chunk_id", "n", part("subject").alias("src"), part("relation").alias("rel"), part("object").alias("dst"))


def extracted(replies: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges(src, rel, dst, chunk_id), counts(chunk_id, proposed, kept, dropped)) of replies(chunk_id, json) and vocabulary(id).

    An edge's ends are in the vocabulary, normalised, and no part of it is empty. Every chunk with a reply
    has counts.
    """
    every = cut(_told(replies))
    edges = cut(accepted(every.where("n IS NOT NULL"), vocabulary))
    kept = edges.groupBy("chunk_id").agg(F.count("*").alias("kept"))
    counts = every.groupBy("chunk_id").agg(F.count("n").alias("proposed")).join(kept, "chunk_id", "left")
    counts = counts.select("chunk_id", "proposed", F.coalesce("kept", F.lit(0)).alias("kept"))
    return edges, counts.withColumn("dropped", F.col("proposed") - F.col("kept"))


def asked(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(chunk_id, prompt) of chunks(chunk_id, note_id, heading, text): each prompt lists the entities that its chunk mentions, as others can't be ends of its edges; chunks that mention fewer than two aren't asked about."""
    near = mentions.mentioned(chunks.select(F.col("chunk_id").alias("query_id"), "text"), vocabulary)
    lists = near.groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("known")).where(F.size("known") > 1)
    rows = chunks.join(lists, chunks.chunk_id == lists.query_id)
    prompt = P.with_json(P.extraction(F.col("note_id").cast("string"), F.col("heading"), F.col("text"), F.col("known")), _SHAPE)
    return rows.select("chunk_id", prompt.alias("prompt"))


def triples(chunks: DataFrame, vocabulary: DataFrame, backends: list[completion.Backend], cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges and counts of chunks, by asking a model about each; chunks that no backend answered have no edges and count nothing."""
    orders = cut(asked(chunks, vocabulary))
    replies = cut(orders.join(completion.complete(orders, backends, cache, as_json=True), "prompt").where("json IS NOT NULL").select("chunk_id", "json"))
    return extracted(replies, vocabulary)


def co_mentioned(known: Column) -> Column:
    """A stand-in's reply to an extraction: neighbours of a list of names co-occur."""
    pairs = F.transform(F.slice(known, 1, F.greatest(F.size(known) - 1, F.lit(0))), lambda a, i: F.struct(a.alias("subject"), F.lit("co-occurs with").alias("relation"), F.element_at(known, i + 2).alias("object")))
    return F.to_json(F.struct(pairs.alias("triples")))


def edge_samples(edges: DataFrame, membership: DataFrame, chunks: DataFrame, n: int = 15) -> DataFrame:
    """(community, entities, edges, excerpts): what a community's summary is asked from: its members, the first n edges within it in order of chunk and ends, and the chunks of these."""
    own = edges.join(membership.select(F.col("id").alias("src"), "community"), "src").join(membership.select(F.col("id").alias("dst"), F.col("community").alias("other")), "dst").where("community = other")
    first = cut(first_n(own, ["community"], n, F.col("chunk_id"), F.col("src"), F.col("dst"), F.col("rel")))
    lines = first.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "src", "rel", "dst"))), lambda e: F.struct(e["src"].alias("src"), e["rel"].alias("rel"), e["dst"].alias("dst"))).alias("edges"))
    texts = first.select("community", "chunk_id").distinct().join(chunks.select("chunk_id", "text"), "chunk_id").groupBy("community").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("excerpts"))  # n chunks
    members = membership.groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("entities"))
    return members.join(lines, "community", "left").join(texts, "community", "left")


def summaries(edges: DataFrame, membership: DataFrame, chunks: DataFrame, backends: list[completion.Backend], cache: DataFrame | None = None) -> DataFrame:
    """(id, entity_ids, summary): each community, told by a model from its edges and excerpts; null where no backend answered."""
    rows = edge_samples(edges, membership, chunks)
    none = F.array().cast("array<struct<src:string,rel:string,dst:string>>")
    empty = F.array().cast("array<struct<chunk_id:string,text:string>>")
    rows = cut(rows.withColumn("prompt", P.community(F.col("entities"), F.coalesce("edges", none), F.coalesce("excerpts", empty))))
    done = completion.complete(rows, backends, cache)
    return rows.join(done.select("prompt", "text"), "prompt", "left").select(F.col("community").alias("id"), F.col("entities").alias("entity_ids"), T.strip(F.col("text")).alias("summary"))

"""The entity graph: vocabulary, edges, mentions, hops, communities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import text as T
from tessera.operators import mentions
from tessera.operators.lineage import bucketed, cut, sent, stored
from tessera.operators.ranking import take_distinct


def vocabulary(notes: DataFrame) -> DataFrame:
    """(id): distinct normalised entities of notes(entities)."""
    return notes.select(F.explode(F.transform("entities", T.normal_entity)).alias("id")).where("id <> ''").distinct()


def note_frequency(notes: DataFrame, least: int = config.ENTITY_NOTES) -> DataFrame:
    """(id, notes): entities of at least so many notes, each note counted once."""
    rows = notes.select("note_id", F.explode(F.transform("entities", T.normal_entity)).alias("id")).distinct()
    return rows.groupBy("id").agg(F.count("*").alias("notes")).where(F.col("notes") >= least)


def accepted(triples: DataFrame, vocab: DataFrame) -> DataFrame:
    """Triples whose ends are both in the vocabulary and whose parts are not empty, normalised."""
    t = triples.select(*(T.normal_entity(F.col(x)).alias(x) for x in ("src", "dst")), T.strip(F.col("rel")).alias("rel"), "chunk_id").where("src <> '' AND dst <> '' AND rel <> ''")
    return t.join(vocab.select(F.col("id").alias("src")), "src", "left_semi").join(vocab.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "rel", "dst", "chunk_id")


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst): every edge from both ends, repeats kept: what walks over few entities join with."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst): distinct neighbours, both ways."""
    return both_ways(edges).distinct()


def degree(adj: DataFrame) -> DataFrame:
    """(id, degree): distinct neighbours; a self loop counts itself."""
    return adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def pair_weights(edges: DataFrame) -> DataFrame:
    """(a, b, weight): parallel and opposite edges of two different entities, counted."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("weight"))


def ends_with_chunks(edges: DataFrame) -> DataFrame:
    """(id, chunk_id) of both ends of every edge, repeats kept."""
    return edges.select(F.col("src").alias("id"), "chunk_id").unionByName(edges.select(F.col("dst").alias("id"), "chunk_id"))


def entity_chunks(edges: DataFrame) -> DataFrame:
    """(id, chunk_id): the evidence of each entity at either end; entities without an edge are not there."""
    return ends_with_chunks(edges).distinct()


def seeds(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, id): entities that a question mentions at word boundaries, by n-grams (see ``mentions``)."""
    return mentions.mentioned(questions, entities)


def expand(start: DataFrame, adj: DataFrame, hops: int = config.GRAPH_HOPS) -> DataFrame:
    """(query_id, id, hop): what lies within so many hops; starts outside the graph give nothing.

    adj(src, dst), both ways; repeats do no harm. A hop joins the edges with the frontier alone, which is
    sent to them while it is small, so that no edge is shuffled but those that were walked.
    """
    frontier = cut(start.select("query_id", "id").distinct())
    known = adj.join(sent(frontier.select(F.col("id").alias("src")).distinct()), "src").select(F.col("src").alias("id")).distinct()
    frontier = cut(frontier.join(known, "id", "left_semi").select("query_id", "id", F.lit(0).alias("hop")))
    visited = frontier
    for h in range(1, hops + 1):
        near = adj.join(sent(frontier.select("query_id", F.col("id").alias("src"))), "src").select("query_id", F.col("dst").alias("id")).distinct()
        frontier = cut(near.join(visited, ["query_id", "id"], "left_anti").withColumn("hop", F.lit(h)))
        visited = visited.unionByName(frontier)
    return visited


def induced(visited: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, src, rel, dst, chunk_id): edges with both ends visited, parallel ones kept."""
    seen = cut(visited.select("query_id", "id"))
    found = edges.join(sent(seen.withColumnRenamed("id", "src")), "src")
    return found.join(sent(seen.withColumnRenamed("id", "dst")), ["query_id", "dst"]).select("query_id", "src", "rel", "dst", "chunk_id")


def hop_chunks(visited: DataFrame, adj: DataFrame, evidence: DataFrame, most: int = config.GRAPH_MAX_CHUNKS) -> DataFrame:
    """(query_id, chunk_id, rank): distinct chunks by entity, entities of most neighbours first, then by id.

    evidence(id, chunk_id); repeats in it and in adj do no harm. Degrees and evidence are those of visited
    entities alone.
    """
    seen = cut(visited.select("query_id", "id"))
    ids = cut(seen.select("id").distinct())
    degrees = degree(adj.join(sent(ids.withColumnRenamed("id", "src")), "src").select("src", "dst").distinct())
    rows = seen.join(degrees, "id").join(evidence.join(sent(ids), "id").distinct(), "id")
    return take_distinct(rows, ["query_id"], "chunk_id", most, F.desc("degree"), F.col("id"), F.col("chunk_id")).select("query_id", "chunk_id", "rank")


def touched_communities(start: DataFrame, found: DataFrame, entities: DataFrame, communities: DataFrame) -> DataFrame:
    """(query_id, community, summary) of the seeds' and edges' entities; unknown ones are left out."""
    ids = start.select("query_id", "id").unionByName(found.select("query_id", F.col("src").alias("id"))).unionByName(found.select("query_id", F.col("dst").alias("id"))).distinct()
    return ids.join(entities.select("id", "community").where("community IS NOT NULL"), "id").select("query_id", "community").distinct().join(communities.select(F.col("id").alias("community"), "summary"), "community").select("query_id", "community", "summary")


#: Levels of communities at most; each merges at least two nodes of the last, and in practice most of them. Deals of halves that a level has; then they come again.
LEVELS, DEALS = 64, 63
#: A phase of moves goes on while a stretch of rounds raises modularity by more than this.
RISE = 1e-4


def _halves(name: Column, level: int) -> Column:
    """A bit for each deal of a level: in which half it puts the node of this name."""
    one = lambda i: F.shiftleft(F.pmod(F.xxhash64(name, F.lit(level * DEALS + i)), F.lit(2)), i)
    return reduce(Column.bitwiseOR, map(one, range(DEALS))).alias("halves")


def _moved(both: DataFrame, label: DataFrame, twice: int, half: int, deal: int) -> DataFrame:
    """One round of local moves: (id, label, d, halves, moved). Half of the nodes, by a hash that the deal seeds, may join the neighbouring community of most gain (its links there, less those that chance would give), ties to the smaller label; so two that swap in one deal don't in another.

    Labels go to where the edges lie, and of these only those move that end in the half whose turn it is, once.
    """
    turn = F.shiftright("halves", deal % DEALS).bitwiseAND(F.lit(1)) == half
    told = label.join(label.groupBy("label").agg(F.sum("d").alias("total")), "label")
    links = both.where(turn).join(told.select(F.col("id").alias("near"), "label", "total").hint("shuffle_hash"), "near").select("id", "label", "total", F.col("weight").alias("links"))
    links = links.unionByName(told.where(turn).select("id", "label", "total", F.lit(0).cast("long").alias("links"))).repartition("id")
    options = links.groupBy("id", "label", "total").agg(F.sum("links").alias("links"))
    others = F.col("total") - F.when(F.col("own") == F.col("label"), F.col("d")).otherwise(0)
    gain = F.round(F.col("links") - F.col("d") * others / F.lit(twice), 9)
    rated = options.join(label.where(turn).select("id", F.col("label").alias("own"), "d"), "id").withColumn("gain", gain)
    best = rated.groupBy("id").agg(F.min_by("label", F.struct(-F.col("gain"), F.col("label"))).alias("best"))
    new = F.coalesce("best", "label")
    return label.join(best, "id", "left").select("id", new.alias("label"), "d", "halves", (new != F.col("label")).alias("moved"))


def _quality(both: DataFrame, label: DataFrame, twice: int) -> float:
    """The modularity of label(id, label, d, ...), less what lies within nodes, which no move changes."""
    of = lambda node: label.select(F.col("id").alias(node), F.col("label").alias(f"{node}_label"))
    own = both.where("near < id").select("near", "id", "weight").join(of("near").hint("shuffle_hash"), "near").join(of("id"), "id").where("near_label = id_label")
    squares = label.groupBy("label").agg(F.sum("d").cast("double").alias("d")).agg(F.sum(F.col("d") * F.col("d")))
    return 2 * (own.agg(F.sum("weight")).first()[0] or 0) / twice - squares.first()[0] / twice**2


def _kept(rows: DataFrame) -> DataFrame:
    """rows as a table of known size: estimates of checkpoints' sizes would multiply with each round's joins."""
    return stored(rows, "communities")


def _connected(both: DataFrame, label: DataFrame, tables: list[str], rounds: int = 40) -> DataFrame:
    """label(id, label, d, ...) with communities cut into their connected parts, each named by its least node.

    Least names spread along edges within a community, from nodes that got a new one, and each round also
    to the name of the name, so the rounds are about the logarithm of the longest way.
    """
    of = lambda node, name: label.select(F.col("id").alias(node), F.col("label").alias(name))
    own = both.where("near < id").select("near", "id").join(of("near", "other").hint("shuffle_hash"), "near").join(of("id", "label"), "id").where("label = other")
    ways = F.array(*(F.struct(F.col(x).alias("near"), F.col(y).alias("id")) for x, y in (("near", "id"), ("id", "near"))))
    own = bucketed(own.select(F.inline(ways)), "near", tables)
    part = _kept(label.select("id", F.col("id").alias("part"), F.lit(True).alias("fresh")))
    for _ in range(rounds):
        least = own.join(part.where("fresh").select(F.col("id").alias("near"), F.col("part").alias("beside")).hint("shuffle_hash"), "near").groupBy("id").agg(F.min("beside").alias("beside"))
        step = part.join(least, "id", "left").select("id", "part", F.least("part", F.coalesce("beside", "part")).alias("now"))
        jump = step.select(F.col("id").alias("now"), F.col("now").alias("further"))
        step = step.join(jump, "now", "left").select("id", "part", F.least("now", F.coalesce("further", "now")).alias("now"))
        part = _kept(step.select("id", F.col("now").alias("part"), (F.col("now") != F.col("part")).alias("fresh")))
        if not part.where("fresh").limit(1).count():
            return _kept(label.drop("label").join(part.select("id", F.col("part").alias("label")), "id"))
    raise RuntimeError(f"connected parts still grow after {rounds} rounds")


def communities(edges: DataFrame, rounds: int = 8, levels: int | None = None) -> DataFrame:
    """(id, community): connected communities of high modularity, in three phases a level.

    First, from one community per node, stretches of ``rounds`` rounds of local moves (pairs, in which every
    node has a turn) for as long as a stretch raises modularity by more than ``RISE``, or until a pair moves
    no more than a hundredth of the nodes; of what the stretches reached, the best counts. Then communities
    that have come apart are cut into their connected parts, which never lowers modularity; then each becomes
    a node whose weights are summed, and the next level begins, until one merges nothing or ``levels`` are
    done. Communities are numbered from 0 in the order of their least member; every entity of an edge is in one.

    Nodes are told by their numbers in the order of names, and edges lie in buckets by an end, so that
    a round moves a few numbers for each edge, once. The bucketed tables leave the catalog at the end.
    """
    spark, tables = edges.sparkSession, []
    try:
        every = _kept(edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).where("id IS NOT NULL").distinct())
        names = _kept(_numbered(every.select(F.col("id").alias("node"), F.col("id").alias("least"))).select(F.col("node").alias("name"), F.col("number").alias("id"), _halves(F.col("node"), 1)))
        end = lambda x: names.select(F.col("name").alias(x), F.col("id").alias(f"{x}_id"), F.col("halves").alias(f"{x}_halves"))
        pairs = pair_weights(edges).join(end("a"), "a").drop("a").join(end("b"), "b")
        ways = F.array(*(F.struct(F.col(f"{x}_id").alias("near"), F.col(f"{y}_id").alias("id"), "weight", F.col(f"{y}_halves").alias("halves")) for x, y in ("ab", "ba")))
        both = bucketed(pairs.select(F.inline(ways)), "near", tables)
        ends = both.groupBy(F.col("near").alias("id")).agg(F.sum("weight").alias("d"))
        label = _kept(names.join(ends, "id", "left").select("id", F.col("id").alias("label"), F.coalesce("d", F.lit(0)).alias("d"), "halves"))
        twice = label.agg(F.sum("d")).first()[0] or 1
        member = label.select("id", F.col("id").alias("node"))
        for level in range(1, LEVELS + 1):
            nodes, deal, rising = label.count(), 0, True
            best, high = label, _quality(both, label, twice)
            while rising:
                for _ in range(-(-max(rounds, 2) // 2)):
                    moved = 0
                    for half in (0, 1):
                        label = _kept(_moved(both, label, twice, half, deal))
                        moved += label.where("moved").count()
                        label = label.drop("moved")
                    deal += 1
                    if 100 * moved <= nodes:
                        break
                reached = _quality(both, label, twice)
                rising = 100 * moved > nodes and reached > high + RISE
                if reached > high:
                    best, high = label, reached
            label = _connected(both, best, tables)
            member = _kept(member.join(label.select(F.col("id").alias("node"), "label"), "node").select("id", F.col("label").alias("node")))
            if level == levels:
                break
            merged = label.groupBy(F.col("label").alias("id")).agg(F.sum("d").alias("d")).join(names.select("id", "name"), "id")
            merged = _kept(merged.select("id", F.col("id").alias("label"), "d", _halves(F.col("name"), level + 1)))
            if merged.count() == nodes:
                break
            of = lambda n: label.select(F.col("id").alias(n), F.col("label").alias(f"{n}_label"))  # noqa: E731,B023
            joined = both.join(of("id"), "id").join(of("near"), "near").where("id_label <> near_label")
            joined = joined.groupBy(F.col("id_label").alias("id"), F.col("near_label").alias("near")).agg(F.sum("weight").alias("weight"))
            both = bucketed(joined.join(merged.select("id", "halves"), "id").select("near", "id", "weight", "halves"), "near", tables)
            label = merged
        else:
            raise RuntimeError(f"communities still merge after {LEVELS} levels")
        numbers = _numbered(member.groupBy("node").agg(F.min("id").alias("least")))
        return _kept(member.join(numbers, "node").join(names.select("id", "name"), "id").select(F.col("name").alias("id"), F.col("number").cast("int").alias("community")))
    finally:
        for t in tables:
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def _numbered(rows: DataFrame) -> DataFrame:
    """(node, number) of rows(node, least), from 0 in the order of least: sorted by ranges, and counted by task."""
    ranged = rows.repartitionByRange("least").sortWithinPartitions("least")
    runs = stored(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "numbered")
    parts = runs.groupBy("part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    offsets = parts.select("part", "first", before.alias("before"))
    return runs.join(offsets, "part").select("node", (F.col("at") - F.col("first") + F.col("before")).alias("number"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: the modularity of the partition on the weighted undirected projection."""
    w = pair_weights(edges)
    m = membership.select("id", "community")
    inside = w.join(m.withColumnRenamed("id", "a").withColumnRenamed("community", "ca"), "a").join(m.withColumnRenamed("id", "b").withColumnRenamed("community", "cb"), "b")
    total = inside.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"))
    ends = inside.select(F.col("ca").alias("community"), "weight").unionByName(inside.select(F.col("cb").alias("community"), "weight")).groupBy("community").agg(F.sum("weight").alias("d"))
    return ends.agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("dd")).crossJoin(total).select((F.col("inside") / F.col("m") - F.col("dd") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))


def co_mentions(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Offline triples: entities of a note that one of its chunks both mentions co-occur there."""
    e = notes.select("note_id", F.explode(F.transform("entities", T.normal_entity)).alias("id")).distinct()
    found = chunks.join(e, "note_id").withColumn("pattern", T.mention_pattern(F.col("id"))).where(T.mentions(F.col("text"), F.col("pattern"))).select("chunk_id", "id")
    b = found.select("chunk_id", F.col("id").alias("dst"))
    return found.withColumnRenamed("id", "src").join(b, "chunk_id").where("src < dst").select("src", F.lit("co-occurs").alias("rel"), "dst", "chunk_id")


def community_members(membership: DataFrame) -> DataFrame:
    return membership.groupBy(F.col("community").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("entity_ids"))


def community_edges(edges: DataFrame, membership: DataFrame, n: int = config.COMMUNITY_EDGES) -> DataFrame:
    """The first n edges of each community with both ends in it, in the order of ``ord``."""
    a = membership.select(F.col("id").alias("src"), "community")
    b = membership.select(F.col("id").alias("dst"), F.col("community").alias("other"))
    own = edges.join(a, "src").join(b, "dst").where("community = other").drop("other")
    return own.withColumn("n", F.row_number().over(Window.partitionBy("community").orderBy("ord"))).where(F.col("n") <= n)

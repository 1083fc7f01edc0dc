"""Run traces: schema, structural checks, splicing, and the walk from an answer back to its evidence."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.operators.lineage import cut

NODE = "struct<id string, kind string, label string, parent_ids array<string>, duration_ms double, explain string, payload string>"
METRICS = "struct<latency_ms double, llm_calls int, prompt_tokens int, completion_tokens int>"
TRACE = f"trace_id string, architecture string, question string, answer string, metrics {METRICS}, nodes array<{NODE}>"


def exploded(traces: DataFrame) -> DataFrame:
    """(trace_id, pos, id, kind, label, parent_ids, duration_ms, explain, payload) of each node, with defaults for what may be left out."""
    rows = traces.select("trace_id", F.posexplode("nodes").alias("pos", "n"))
    return rows.select("trace_id", "pos", "n.id", "n.kind", "n.label", F.coalesce("n.parent_ids", F.array().cast("array<string>")).alias("parent_ids"), F.coalesce("n.duration_ms", F.lit(0.0)).alias("duration_ms"), "n.explain", F.coalesce("n.payload", F.lit("{}")).alias("payload"))


def problems(nodes: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """(trace_id, problem): empty, unknown kind, duplicate id, dangling parent, cycle. nodes as ``exploded`` gives them."""
    out = nodes.where(~F.col("kind").isin(*config.NODE_KINDS)).select("trace_id", F.lit("unknown kind").alias("problem"))
    out = out.unionByName(nodes.groupBy("trace_id", "id").agg(F.count("*").alias("n")).where("n > 1").select("trace_id", F.lit("duplicate id").alias("problem")))
    parents = nodes.select("trace_id", "id", F.explode("parent_ids").alias("parent"))
    lost = parents.join(nodes.select("trace_id", F.col("id").alias("parent")), ["trace_id", "parent"], "left_anti")
    out = out.unionByName(lost.select("trace_id", F.lit("dangling parent").alias("problem"))).unionByName(_cycles(nodes))
    if traces is not None:
        out = out.unionByName(traces.where("nodes IS NULL OR size(nodes) = 0").select("trace_id", F.lit("empty").alias("problem")))
    return out.distinct()


def _cycles(nodes: DataFrame) -> DataFrame:
    """(trace_id, problem): traces with a cycle, all at once.

    Round by round the nodes that depend on no other are peeled off, with the edges to those that depend
    on them; where a round takes nothing, what is left stands on cycles. A round is a join of the edges
    that are left, and there are as many as the longest way, not as many as traces. Nodes that share an
    id share their parents.
    """
    known = nodes.select("trace_id", F.col("id").alias("parent"))
    edges = cut(nodes.select("trace_id", "id", F.explode("parent_ids").alias("parent")).distinct().join(known, ["trace_id", "parent"], "left_semi"))
    left = edges.count()
    while left:
        bound = edges.select("trace_id", F.col("id").alias("parent"))
        edges = cut(edges.join(bound, ["trace_id", "parent"], "left_semi"))
        before, left = left, edges.count()
        if left == before:
            break
    return edges.select("trace_id").distinct().select("trace_id", F.lit("cycle").alias("problem"))


def checked(traces: DataFrame) -> DataFrame:
    """traces, or an error from the first malformed one that is read."""
    bad = problems(exploded(traces), traces).groupBy("trace_id").agg(F.array_join(F.array_sort(F.collect_set("problem")), ", ").alias("problem"))
    joined = traces.join(bad, "trace_id", "left")
    ok = F.when(F.col("problem").isNull(), F.col("trace_id")).otherwise(F.raise_error(F.concat(F.lit("malformed trace "), F.col("trace_id"), F.lit(": "), F.col("problem"))))
    return joined.withColumn("trace_id", ok.cast("string")).drop("problem")


def spliced(nodes: Column, prefix: Column, parent: Column) -> Column:
    """The nodes of a delegate's trace below a parent node: ids get the prefix, roots the parent."""
    name = lambda i: F.concat(prefix, F.lit("::"), i)

    def one(n: Column) -> Column:
        parents = F.when(F.size(n["parent_ids"]) == 0, F.array(parent)).otherwise(F.transform(n["parent_ids"], name))
        return n.withField("id", name(n["id"])).withField("parent_ids", parents)

    return F.transform(nodes, one)


def uses_graph(nodes: Column) -> Column:
    return F.exists(nodes, lambda n: n["kind"] == "graph_expand")


def routed_to(nodes: Column) -> Column:
    """Where the first node, if it is a route, sends the question."""
    first = F.element_at(nodes, 1)
    return F.when(first["kind"] == "route", F.get_json_object(first["payload"], "$.chosen"))


_RESULTS = "array<struct<chunk_id: string>>"
_TOLD = f"struct<after: {_RESULTS}, results: {_RESULTS}, chunk_ids: array<string>, judgements: array<struct<chunk_id: string, verdict: string>>>"


def _steps(nodes: DataFrame) -> DataFrame:
    """(trace_id, id, parent_ids, found, bad): of each node what its payload says: the chunks that end a branch there (null where it goes on), and those that a grade judges incorrect. Of nodes that share an id the last counts."""
    told = F.from_json("payload", _TOLD)
    kind, none = F.col("kind"), F.array().cast("array<string>")
    ids = lambda name: F.coalesce(F.transform(told[name], lambda r: r["chunk_id"]), none)
    found = F.when(kind == "rerank", ids("after")).when(kind.startswith("retrieve_"), ids("results")).when(kind == "graph_expand", F.coalesce(told["chunk_ids"], none))
    bad = F.when(kind == "grade", F.transform(F.filter(told["judgements"], lambda j: j["verdict"] == "incorrect"), lambda j: j["chunk_id"]))
    rows = nodes.select("trace_id", "pos", "id", "kind", "parent_ids", found.alias("found"), F.coalesce(bad, none).alias("bad"))
    return rows.groupBy("trace_id", "id").agg(F.max_by(F.struct("parent_ids", "found", "bad"), "pos").alias("n")).select("trace_id", "id", "n.*")


def evidence(nodes: DataFrame) -> DataFrame:
    """(trace_id, chunk_ids): what the answer of each trace rests on, in order, each chunk once.

    All traces are walked at once, from their last nodes, which must be answers, towards their roots. A
    token stands for a node and the chunks known to be wrong on the way to it; a step moves every token
    that isn't at an end to its node's parents, in order. Tokens that stood before aren't moved again,
    so cycles end. A branch ends where chunks were ranked or found; those known to be wrong are left
    out, unless that leaves none.
    """
    steps = cut(_steps(nodes))
    last = nodes.groupBy("trace_id").agg(F.max_by(F.struct("id", "kind"), "pos").alias("n"))
    start = F.when(F.col("n.kind") == "generate", F.col("n.id")).otherwise(F.raise_error(F.concat(F.lit("a trace ends in a generate node, not "), "trace_id")).cast("string"))
    none = F.array().cast("array<string>")
    order = "array<int>"
    tokens = last.select("trace_id", start.alias("id"), none.alias("wrong"), F.array(F.lit(0)).cast(order).alias("way"))
    known: DataFrame | None = None
    ends: DataFrame | None = None
    for depth in itertools.count():
        here = tokens.join(steps, ["trace_id", "id"])
        here = cut(here.select("trace_id", "id", "wrong", "way", "parent_ids", "found", "bad", F.lit(depth).alias("depth")))
        if not here.limit(1).count():
            break
        right = F.filter("found", lambda i: ~F.array_contains("wrong", i))
        ended = here.where("found IS NOT NULL").select("trace_id", "depth", "way", F.posexplode(F.when(F.size(right) > 0, right).otherwise(F.col("found"))).alias("n", "chunk_id"))
        ends = ended if ends is None else ends.unionByName(ended)
        stood = here.select("trace_id", "id", "wrong")
        known = stood if known is None else known.unionByName(stood)
        on = here.where("found IS NULL").select("trace_id", "way", F.array_sort(F.array_union("wrong", "bad")).alias("wrong"), F.posexplode("parent_ids").alias("n", "id"))
        # a token's way is the place among those of its step, so that it stays short
        first = on.groupBy("trace_id", "id", "wrong").agg(F.min(F.struct("way", "n")).alias("way"))
        fresh = first.join(known, ["trace_id", "id", "wrong"], "left_anti")
        place = F.row_number().over(Window.partitionBy("trace_id").orderBy("way"))  # a trace's tokens
        tokens = fresh.select("trace_id", "id", "wrong", F.array(place).cast(order).alias("way"))
    every = last.select("trace_id")
    if ends is None:
        return every.select("trace_id", none.alias("chunk_ids"))
    once = ends.groupBy("trace_id", "chunk_id").agg(F.min(F.struct("depth", "way", "n")).alias("at"))
    lists = once.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    return every.join(lists, "trace_id", "left").select("trace_id", F.coalesce("chunk_ids", none).alias("chunk_ids"))

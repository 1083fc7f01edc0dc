import json

import pytest

from tessera.operators import graph, lineage, trace
from tessera.plans import catalog


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("seed", "r", "topic-a", "note::1"), ("seed", "r", "topic-b", "note::0"), ("topic-c", "r", "seed", "note::2"), ("topic-b", "r", "far", "note::3"), ("seed", "s", "topic-a", "note::1")]
    return spark.createDataFrame(rows, "src string, rel string, dst string, chunk_id string")


def test_hops_degree_and_chunks(spark, edges):
    start = spark.createDataFrame([(1, "seed"), (1, "unknown")], "query_id int, id string")
    adj = graph.adjacency(edges)
    assert {r.id: r.degree for r in graph.degree(adj).collect()} == {"seed": 3, "topic-a": 1, "topic-b": 2, "topic-c": 1, "far": 1}
    one = graph.expand(start, adj, 1)
    assert {r.id: r.hop for r in one.collect()} == {"seed": 0, "topic-a": 1, "topic-b": 1, "topic-c": 1}
    assert {r.id for r in graph.expand(start, adj, 2).collect()} == {"seed", "topic-a", "topic-b", "topic-c", "far"}
    assert graph.induced(one, edges).count() == 4
    got = graph.hop_chunks(one, adj, graph.entity_chunks(edges), 2).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["note::0", "note::1"]
    assert {(r.a, r.b): r.weight for r in graph.pair_weights(edges).collect()}[("seed", "topic-a")] == 2


def test_communities_cover_every_entity_and_find_cliques(spark):
    rows = [(f"{g}{i}", "r", f"{g}{j}", "c") for g in "xy" for i in range(5) for j in range(i)] + [("x0", "r", "y0", "c")]
    e = spark.createDataFrame(rows, "src string, rel string, dst string, chunk_id string")
    m = graph.communities(e)
    by = {r.id: r.community for r in m.collect()}
    assert len(by) == 10 and len({by[f"x{i}"] for i in range(5)}) == 1 and by["x0"] != by["y0"] and min(by.values()) == 0
    assert graph.modularity(e, m).first().modularity > 0.3


def test_stars_are_communities_whatever_their_names(spark):
    """A hub and its leaves may stand in the same half and swap communities; the halves are dealt anew, so that none stays cut."""
    e = spark.createDataFrame([(f"leaf {h}-{i}", "r", f"hub {h}", "c") for h in range(12) for i in range(5)], "src string, rel string, dst string, chunk_id string")
    by = {r.id: r.community for r in graph.communities(e).collect()}
    assert all(len({by[f"hub {h}"]} | {by[f"leaf {h}-{i}"] for i in range(5)}) == 1 for h in range(12)) and len(set(by.values())) == 12


def louvain(pairs):
    """Modularity of a plain one-by-one search for communities, moving nodes and merging until nothing gains."""
    weight, member = {}, {}
    for a, b in pairs:
        if a != b:
            weight[a, b] = weight.get((a, b), 0) + 1
            weight[b, a] = weight.get((b, a), 0) + 1
    twice = sum(weight.values())
    nodes = {a: {a} for a, _ in weight}
    links = {a: {} for a in nodes}
    for (a, b), w in weight.items():
        links[a][b] = w
    degree = {a: sum(links[a].values()) for a in nodes}
    member = {a: a for a in nodes}
    while True:
        label = {a: a for a in nodes}
        total = dict(degree)
        gained = True
        while gained:
            gained = False
            for a in nodes:
                total[label[a]] -= degree[a]
                near = {label[a]: 0}
                for b, w in links[a].items():
                    if b != a:
                        near[label[b]] = near.get(label[b], 0) + w
                best = max(near, key=lambda c: (near[c] - degree[a] * total[c] / twice, c == label[a]))
                gained |= best != label[a]
                label[a] = best
                total[best] += degree[a]
        member = {a: label[c] for a, c in member.items()}
        if len(set(label.values())) == len(nodes):
            break
        merged = {}
        for a in nodes:
            for b, w in links[a].items():
                merged.setdefault(label[a], {})
                merged[label[a]][label[b]] = merged[label[a]].get(label[b], 0) + w
        links = merged
        nodes = {c: None for c in merged}
        degree = {c: sum(merged[c].values()) for c in merged}
    share = {}
    for (a, _), w in weight.items():
        share[member[a]] = share.get(member[a], 0) + w
    return sum(w for (a, b), w in weight.items() if member[a] == member[b]) / twice - sum((x / twice) ** 2 for x in share.values())


@pytest.mark.parametrize("seed", [1])
def test_communities_are_connected_and_as_good_as_one_by_one(spark, seed):
    import random

    rng = random.Random(seed)
    pairs = [(f"{g}-{rng.randrange(12)}", f"{g if rng.random() < 0.9 else rng.randrange(6)}-{rng.randrange(12)}") for g in range(6) for _ in range(50)]
    e = spark.createDataFrame([(a, "r", b, "c") for a, b in pairs], "src string, rel string, dst string, chunk_id string")
    m = graph.communities(e)
    by = {r.id: r.community for r in m.collect()}
    assert set(by) == {x for p in pairs for x in p} and set(by.values()) == set(range(len(set(by.values()))))
    least = {}
    for i, c in by.items():
        least[c] = min(least.get(c, i), i)
    assert [least[c] for c in sorted(least)] == sorted(least.values())
    near = {}
    for a, b in pairs:
        if by[a] == by[b]:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for c in set(by.values()):
        inside = {i for i in by if by[i] == c}
        seen, todo = set(), [min(inside)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near.get(x, ())
        assert seen == inside
    assert graph.modularity(e, m).first().modularity >= 0.98 * louvain(pairs)


def test_communities_query_takes_every_edge(spark, tmp_path):
    rows = [(i % 3, i, 100 + i, float(i)) for i in range(60)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.id for r in catalog.QUERIES["g3_communities"](spark, str(tmp_path)).collect()}
    assert got == {f"s{i}" for i in range(3)} | {f"p{i}" for i in range(60)}


def test_communities_query_merges_and_moves_until_modularity_rises_no_more(spark, tmp_path):
    """A chain of suppliers and parts needs more levels than one: there is no community left that gains by joining another."""
    links = [(i // 2, (i + 1) // 2) for i in range(96)]
    spark.createDataFrame([(s, p, i, 1.0) for i, (s, p) in enumerate(links)], "l_suppkey long, l_partkey long, l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    m = catalog.QUERIES["g3_communities"](spark, str(tmp_path))
    by = {r.id: r.community for r in m.collect()}
    pairs = [(f"s{s}", f"p{p}") for s, p in links]
    d = {}
    between = {}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            d[by[x]] = d.get(by[x], 0) + 1
            between[by[x], by[y]] = between.get((by[x], by[y]), 0) + 1
    assert all(n * 2 * len(pairs) <= d[a] * d[b] for (a, b), n in between.items() if a != b)
    share = sum(n for (a, b), n in between.items() if a == b) / (2 * len(pairs)) - sum((x / 2 / len(pairs)) ** 2 for x in d.values())
    assert share >= 0.97 * louvain(pairs)


def test_phases_of_moves_end_by_modularity(spark, monkeypatch):
    """A phase ends by modularity, of few equal links as of none."""
    reached = []
    quality = graph._quality
    monkeypatch.setattr(graph, "_quality", lambda *a: reached.append(quality(*a)) or reached[-1])
    e = spark.createDataFrame([(f"s{s}", "r", f"p{p}", "c") for s in range(4) for p in range(40)], "src string, rel string, dst string, chunk_id string")
    assert graph.communities(e, 2).count() == 44
    assert len(reached) < 40
    assert graph.communities(e.where("src = dst").unionByName(spark.createDataFrame([("z", "r", "z", "c")], e.schema)), 2).collect()[0].community == 0


def test_rounds_of_communities_leave_edges_in_their_buckets(spark):
    """A round joins labels where the edges lie, and only rows of the half whose turn it is move; no table stays in the catalog."""
    tables = []
    both = lineage.bucketed(spark.createDataFrame([(1, 2, 1, 1), (2, 1, 1, 0), (2, 3, 1, 1), (3, 2, 1, 1)], "near long, id long, weight long, halves long"), "near", tables)
    label = spark.createDataFrame([(1, 1, 1, 0), (2, 2, 2, 1), (3, 3, 1, 1)], "id long, label long, d long, halves long")
    moved = graph._moved(both, label, 4, 1, 0)
    assert "Bucketed: true" in moved._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.label, r.moved) for r in moved.collect()} == {(1, 1, False), (2, 1, True), (3, 2, True)}
    spark.sql(f"DROP TABLE {tables[0]}")
    e = spark.createDataFrame([("a", "r", "b", "c"), ("b", "r", "b", "c"), ("z", "r", "z", "c")], "src string, rel string, dst string, chunk_id string")
    assert {(r.id, r.community) for r in graph.communities(e, 2, 1).collect()} == {("a", 0), ("b", 0), ("z", 1)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessera_")]


def traced(spark, *traces):
    """Nodes as ``exploded`` gives them, of traces of (id, kind, parents, payload)."""
    rows = [(f"t{t}", p, i, k, ps, json.dumps(d)) for t, ns in enumerate(traces) for p, (i, k, ps, d) in enumerate(ns)]
    return spark.createDataFrame(rows, "trace_id string, pos int, id string, kind string, parent_ids array<string>, payload string")


def walked(spark, *traces):
    got = {r.trace_id: r.chunk_ids for r in trace.evidence(traced(spark, *traces)).collect()}
    return [got[f"t{i}"] for i in range(len(traces))]


def hits(*ids):
    return {"results": [{"chunk_id": i} for i in ids]}


def grade(**verdicts):
    return {"judgements": [{"chunk_id": i, "verdict": v} for i, v in verdicts.items()]}


def test_evidence_walk(spark):
    dense = ("1", "retrieve_dense", [], hits("a", "b"))
    traces = [
        [dense, ("2", "generate", ["1"], {})],
        [dense, ("2", "rerank", ["1"], {"after": [{"chunk_id": "z"}]}), ("3", "generate", ["2"], {})],
        [("1", "retrieve_dense", [], hits("keep1", "drop1", "keep2")), ("2", "grade", ["1"], grade(keep1="correct", drop1="incorrect")), ("3", "generate", ["2"], {})],
        [dense, ("2", "grade", ["1"], grade(a="incorrect", b="incorrect")), ("3", "generate", ["2"], {})],
        [dense, ("2", "retrieve_sparse", [], hits("b", "c")), ("3", "generate", ["1", "2"], {})],
        [("1", "graph_expand", [], {"chunk_ids": ["x", "y", "x"]}), ("2", "generate", ["1", "gone"], {})],
        [("1", "retrieve_dense", [], {}), ("2", "generate", ["1"], {})],
        [("1", "generate", [], {})],
        # the nearer branch comes first, whatever the order of the nodes; grades hold for their own branch alone
        [dense, ("2", "grade", ["1"], grade(a="incorrect")), ("3", "reflect", ["2"], {}), ("4", "retrieve_sparse", [], hits("c", "a")), ("5", "generate", ["3", "4"], {})],
        [dense, ("2", "grade", ["1"], grade(a="incorrect")), ("3", "generate", ["2", "1"], {})],
        # nodes in a circle, and an id that is there twice
        [("1", "route", ["2"], {}), ("2", "plan", ["1", "3"], {}), ("3", "retrieve_dense", [], hits("q")), ("4", "generate", ["1"], {})],
        [("1", "retrieve_dense", [], hits("old")), ("1", "retrieve_dense", [], hits("new")), ("2", "generate", ["1"], {})],
    ]
    assert walked(spark, *traces) == [["a", "b"], ["z"], ["keep1", "keep2"], ["a", "b"], ["a", "b", "c"], ["x", "y"], [], [], ["c", "a", "b"], ["a", "b"], ["q"], ["new"]]
    with pytest.raises(Exception, match="generate node"):
        walked(spark, [dense])


def test_evidence_has_no_python_in_its_plan(spark):
    plan = trace.evidence(traced(spark, [("1", "retrieve_dense", [], hits("a")), ("2", "generate", ["1"], {})]))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan


def test_cycles_of_many_traces(spark):
    """Long chains without a cycle, and cycles behind chains."""
    chain = [(f"n{i}", "plan", [f"n{i - 1}"] if i else [], {}) for i in range(12)]
    ring = [*chain, ("a", "plan", ["c", "n11"], {}), ("b", "plan", ["a"], {}), ("c", "plan", ["b"], {}), ("d", "plan", ["c"], {})]
    own = [("1", "plan", ["1"], {})]
    split = [("1", "plan", ["9"], {}), ("2", "plan", ["1", "1"], {}), ("3", "plan", ["1", "2"], {})]
    assert {r.trace_id for r in trace._cycles(traced(spark, chain, ring, own, split)).collect()} == {"t1", "t2"}


def test_trace_problems_and_checked_write(spark):
    def t(name, *ns):
        return (name, "naive", "q", "a", (0.0, 1, 1, 1), [(i, k, k, p, 0.0, "", "{}") for i, k, p in ns])

    rows = [t("ok", ("1", "plan", []), ("2", "generate", ["1"])), t("kind", ("1", "magic", [])), t("twice", ("1", "plan", []), ("1", "plan", [])), t("dangling", ("1", "plan", ["9"])), t("cycle", ("1", "plan", ["2"]), ("2", "plan", ["1"])), t("empty")]
    traces = spark.createDataFrame(rows, trace.TRACE)
    found = {(r.trace_id, r.problem) for r in trace.problems(trace.exploded(traces), traces).collect()}
    assert found == {("kind", "unknown kind"), ("twice", "duplicate id"), ("dangling", "dangling parent"), ("cycle", "cycle"), ("empty", "empty")}
    assert trace.checked(traces.where("trace_id = 'ok'")).count() == 1
    with pytest.raises(Exception, match="malformed trace"):
        trace.checked(traces).collect()

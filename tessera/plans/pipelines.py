"""The seven retrieval pipelines, set at a time: a batch of questions in, runs with traces out.

A run is (query_id, architecture, question, answer, chunk_ids, llm_calls, prompt_tokens,
completion_tokens, trace_id, nodes). Loops that a question may leave early are rounds of DataFrames
over those still active; there are at most three.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import prompts
from tessera.functions import text as T
from tessera.operators import blockmax, dense, graph, grading, ranking, sparse
from tessera.operators.lineage import cut, stored
from tessera.operators.models import Embedder, ExtractiveCompleter, HashingEmbedder, LexicalReranker
from tessera.operators.trace import NODE, spliced

_HITS = "array<struct<rank int, chunk_id string, score double, text string, heading string>>"
_RANKS = "array<struct<rank int, chunk_id string, score double>>"


@dataclass
class Corpus:
    """chunks(id long, chunk_id, heading, text), vectors(id, embedding), and what of an index and an entity graph there is: edges(src, rel, dst, chunk_id), entities(id, community), communities(id, summary).

    Without a stored index, texts are searched as they are. Communities are sought when a plan first needs them.
    """

    chunks: DataFrame
    vectors: DataFrame
    index: blockmax.BlockIndex | None = None
    edges: DataFrame | None = None
    embedder: Embedder = field(default_factory=HashingEmbedder)
    reranker: LexicalReranker = field(default_factory=LexicalReranker)
    completer: ExtractiveCompleter = field(default_factory=ExtractiveCompleter)

    @staticmethod
    def of(chunks: DataFrame, edges: DataFrame | None = None, **parts) -> Corpus:
        """The corpus of chunks(id, chunk_id, heading, text)."""
        embedder = parts.get("embedder") or HashingEmbedder()
        chunks = chunks if "heading" in chunks.columns else chunks.withColumn("heading", F.lit(None).cast("string"))
        return Corpus(chunks, stored(embedder.embed(chunks, "id"), "vectors"), edges=edges, **parts)

    @cached_property
    def entities(self) -> DataFrame | None:
        return None if self.edges is None else stored(graph.communities(self.edges), "entities")

    @cached_property
    def communities(self) -> DataFrame | None:
        return None if self.entities is None else graph.community_members(self.entities).withColumn("summary", F.concat(F.lit("Entities: "), F.array_join("entity_ids", ", ")))

    @cached_property
    def names(self) -> DataFrame:
        """(id): the entities of the edges."""
        return stored(self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst")).distinct(), "names")

    def embedded(self, questions: DataFrame) -> DataFrame:
        """(query_id, vector) of questions(query_id, text), cut."""
        return cut(self.embedder.embed(questions, "query_id").withColumnRenamed("embedding", "vector"))

    def dense(self, questions: DataFrame, k: int, vectors: DataFrame | None = None) -> DataFrame:
        """questions(query_id, text) to (query_id, id, score, rank); vectors: what ``embedded`` gives for them, if it is there already."""
        vectors = self.embedded(questions) if vectors is None else vectors
        return dense.search(self.vectors, vectors.withColumnRenamed("vector", "embedding"), k)

    def sparse(self, questions: DataFrame, k: int) -> DataFrame:
        asked = questions.select("query_id", "text")
        found = sparse.search_texts(self.chunks.select(F.col("id").alias("doc_id"), "text"), asked, k) if self.index is None else blockmax.search(self.index, asked, k)
        return found.withColumnRenamed("doc_id", "id")

    def named(self, ranked: DataFrame) -> DataFrame:
        """(query_id, hits): each list as an array of (rank, chunk_id, score) in rank order."""
        rows = ranked.join(self.chunks.select("id", "chunk_id"), "id")
        return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).cast(_RANKS).alias("hits"))

    def listed(self, ranked: DataFrame) -> DataFrame:
        """As ``named``, with texts and headings, which come in only here, for the few chunks that go on to a prompt."""
        rows = ranked.join(self.chunks.select("id", "chunk_id", "text", "heading"), "id")
        return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "text", "heading"))).cast(_HITS).alias("hits"))

    def graph_chunks(self, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(seeds, induced edges, ranked chunks (query_id, id, score, rank)) of questions."""
        if self.edges is None:
            empty = questions.sparkSession.createDataFrame
            return empty([], "query_id long, id string"), empty([], "query_id long, src string, rel string, dst string, chunk_id string"), empty([], "query_id long, id long, score double, rank int")
        adj = graph.both_ways(self.edges)
        start = graph.seeds(questions.select("query_id", "text"), self.names)
        visited = graph.expand(start, adj)
        found = graph.hop_chunks(visited, adj, graph.ends_with_chunks(self.edges))
        known = found.join(self.chunks.select("id", "chunk_id"), "chunk_id").select("query_id", "id", F.lit(None).cast("double").alias("score"), "rank")
        return start, graph.induced(visited, self.edges), known


def context(hits: Column) -> Column:
    """The prompt's context: each chunk under its id and heading, if it has one, in rank order."""
    head = lambda h: F.when(h["heading"].isNull(), "").otherwise(F.concat(F.lit(" ("), h["heading"], F.lit(")")))
    return F.array_join(F.transform(hits, lambda h: F.concat(F.lit("["), h["chunk_id"], F.lit("]"), head(h), F.lit("\n"), h["text"])), "\n\n")


def answer_prompt(question: Column, hits: Column, background: Column | None = None) -> Column:
    parts = [F.lit("Answer from the context alone and cite the ids of the chunks that you use.")]
    if background is not None:
        parts.append(F.when(background != "", F.concat(F.lit("Background, not to be cited:\n"), background)))
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("Context:\n"), context(hits)), F.concat(F.lit("Question: "), question))


def _n_words(text: Column) -> Column:
    return F.size(T.words(text))


def node(name: str | Column, kind: str | Column, parents: Column | list[str], **payload: Column) -> Column:
    parents = F.array(*map(F.lit, parents)).cast("array<string>") if isinstance(parents, list) else parents
    body = F.to_json(F.struct(*(v.alias(k) for k, v in payload.items()))) if payload else F.lit("{}")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("id"), kind.alias("kind"), kind.alias("label"), parents.alias("parent_ids"), F.lit(0.0).alias("duration_ms"), F.lit("").alias("explain"), body.alias("payload")).cast(NODE)


def numbered(nodes: Column) -> Column:
    """Ids n1, n2, ... in order, parents along with them."""
    ids = F.transform(nodes, lambda n: n["id"])
    name = lambda i: F.concat(F.lit("n"), F.array_position(ids, i).cast("string"))
    return F.transform(nodes, lambda n: n.withField("parent_ids", F.transform(n["parent_ids"], name)).withField("id", name(n["id"])))


def _results(hits: Column) -> Column:
    return F.transform(hits, lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["score"].alias("score"), h["rank"].alias("rank")))


def _ids(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["chunk_id"])


def _embed_node(name: str, parents: Column | list[str], corpus: Corpus, vector: Column) -> Column:
    return node(name, "embed_query", parents, dims=F.lit(corpus.embedder.dims), preview=F.slice(vector, 1, config.VECTOR_PREVIEW))


def _generate_node(name: str, parents: Column | list[str]) -> Column:
    return node(name, "generate", parents, output=F.col("answer"), prompt_preview=T.preview(F.col("prompt")), tokens=_n_words(F.col("answer")))


def _answered(rows: DataFrame, corpus: Corpus, background: Column | None = None) -> DataFrame:
    """rows(text, hits, ...) with prompt and answer."""
    rows = rows.withColumn("hits", F.coalesce("hits", F.array().cast(_HITS)))
    return rows.withColumn("prompt", answer_prompt(F.col("text"), F.col("hits"), background)).withColumn("answer", corpus.completer.answer(F.col("text"), F.col("hits")))


def _runs(rows: DataFrame, architecture: str, calls: Column, nodes: Column, extra_prompt: Column | None = None) -> DataFrame:
    prompt_tokens = _n_words(F.col("prompt")) + (extra_prompt if extra_prompt is not None else F.lit(0))
    name = F.lit(architecture)
    return rows.select(
        "query_id", name.alias("architecture"), F.col("text").alias("question"), "answer", _ids(F.col("hits")).alias("chunk_ids"), calls.cast("int").alias("llm_calls"),
        prompt_tokens.cast("int").alias("prompt_tokens"), _n_words(F.col("answer")).cast("int").alias("completion_tokens"), T.trace_id(name, F.col("text")).alias("trace_id"), nodes.alias("nodes"),
    )


def naive(questions: DataFrame, corpus: Corpus, k: int = config.TOP_K) -> DataFrame:
    """Dense top-k, then an answer."""
    v = corpus.embedded(questions)
    q = questions.select("query_id", "text").join(v, "query_id")
    rows = _answered(q.join(corpus.listed(corpus.dense(questions, k, v)), "query_id", "left"), corpus)
    nodes = F.array(_embed_node("n1", [], corpus, F.col("vector")), node("n2", "retrieve_dense", ["n1"], results=_results(F.col("hits")), k=F.lit(k)), _generate_node("n3", ["n2"]))
    return _runs(rows, "naive", F.lit(1), nodes)


def hybrid(questions: DataFrame, corpus: Corpus, k: int = config.TOP_K, pool: int = config.POOL_K) -> DataFrame:
    """Dense and sparse pools, fused by reciprocal rank, reranked to k."""
    v = corpus.embedded(questions)
    d, s = cut(corpus.dense(questions, pool, v)), cut(corpus.sparse(questions, pool))
    lists = d.select("query_id", F.lit(0).alias("list_no"), "id", "rank").unionByName(s.select("query_id", F.lit(1).alias("list_no"), "id", "rank"))
    fused = cut(ranking.fuse(lists, pool=pool))
    text = fused.join(corpus.chunks.select("id", F.col("text").alias("passage")), "id").join(questions.select("query_id", "text"), "query_id")
    best = ranking.rerank(text.withColumn("rerank_score", corpus.reranker.score(F.col("text"), F.col("passage"))), k)
    q = questions.select("query_id", "text").join(v, "query_id")
    for name, lst in (("dense", d), ("sparse", s), ("fused", fused)):
        q = q.join(corpus.named(lst).withColumnRenamed("hits", name), "query_id", "left")
    rows = _answered(q.join(corpus.listed(best.select("query_id", "id", F.col("rerank_score").alias("score"), "rank")), "query_id", "left"), corpus)
    nodes = F.array(
        _embed_node("n1", [], corpus, F.col("vector")), node("n2", "retrieve_dense", ["n1"], results=_results(F.col("dense")), k=F.lit(pool)), node("n3", "retrieve_sparse", ["n1"], results=_results(F.col("sparse")), k=F.lit(pool)),
        node("n4", "fuse", ["n2", "n3"], method=F.lit("rrf"), k=F.lit(config.RRF_K), inputs=F.array(F.lit("n2"), F.lit("n3")), results=_results(F.col("fused"))),
        node("n5", "rerank", ["n4"], model=F.lit(corpus.reranker.backend), before=_results(F.col("fused")), after=_results(F.col("hits"))), _generate_node("n6", ["n5"]),
    )
    return _runs(rows, "hybrid", F.lit(1), nodes)


def hyde(questions: DataFrame, corpus: Corpus, k: int = config.TOP_K) -> DataFrame:
    """Retrieves by a hypothetical passage, answers the question itself."""
    q = cut(questions.select("query_id", "text", corpus.completer.hypothetical(F.col("text")).alias("draft"), prompts.hyde(F.col("text")).alias("order")))
    drafts = q.select("query_id", F.col("draft").alias("text"))
    v = corpus.embedded(drafts)
    rows = _answered(q.join(v, "query_id").join(corpus.listed(corpus.dense(drafts, k, v)), "query_id", "left"), corpus)
    nodes = F.array(
        node("n1", "generate_hypothetical", [], output=F.col("draft"), prompt_preview=T.preview(F.col("order")), tokens=_n_words(F.col("draft"))), _embed_node("n2", ["n1"], corpus, F.col("vector")),
        node("n3", "retrieve_dense", ["n2"], results=_results(F.col("hits")), k=F.lit(k)), _generate_node("n4", ["n3"]),
    )
    return _runs(rows, "hyde", F.lit(2), nodes, _n_words(F.col("order")))


def corrective(questions: DataFrame, corpus: Corpus, k: int = config.TOP_K, most: int = config.MAX_CORRECTIONS) -> DataFrame:
    """Grades what it finds against the question; while more is incorrect than correct, rewrites and retrieves again, at most ``most`` times."""
    judged = lambda hits: F.transform(hits, lambda h: F.struct(h["chunk_id"].alias("chunk_id"), grading.lexical_verdict(grading.lexical_overlap(F.col("text"), h["text"])).alias("verdict"), F.lit("token overlap").alias("reason")))
    state = questions.select("query_id", "text", F.col("text").alias("asked"), F.lit(False).alias("stop"), F.lit(0).alias("rounds"), F.lit(0).alias("spent"), F.array().cast(_HITS).alias("hits"), F.array().cast("array<struct<chunk_id string, verdict string, reason string>>").alias("grades"), F.array().cast(f"array<{NODE}>").alias("nodes"))
    for a in range(1, most + 2):
        active = state.where(~F.col("stop"))
        query = active.select("query_id", F.col("asked").alias("text"))
        v = corpus.embedded(query)
        found = corpus.listed(corpus.dense(query, k, v)).withColumnRenamed("hits", "new")
        got = active.join(v, "query_id").join(found, "query_id", "left").withColumn("new", F.coalesce("new", F.array().cast(_HITS))).withColumn("judged", judged(F.col("new")))
        reasons = F.transform(F.filter("judged", lambda j: j["verdict"] == "incorrect"), lambda j: j["reason"])
        got = got.withColumn("grading", prompts.grading(F.col("text"), F.col("new"))).withColumn("rewriting", prompts.rewrite(F.col("asked"), reasons))
        count = lambda v: F.size(F.filter("judged", lambda j: j["verdict"] == v))
        base = 4 * (a - 1)
        again = corpus.completer.rewrite(F.col("text"))
        ok = (count("incorrect") <= count("correct")) if a <= most else F.lit(True)
        steps = F.array(
            _embed_node(f"n{base + 1}", [f"n{base}"] if base else [], corpus, F.col("vector")), node(f"n{base + 2}", "retrieve_dense", [f"n{base + 1}"], results=_results(F.col("new")), k=F.lit(k)),
            node(f"n{base + 3}", "grade", [f"n{base + 2}"], judgements=F.col("judged"), prompt_preview=T.preview(F.col("grading"))),
        )
        rewrite = F.array(node(f"n{base + 4}", "rewrite", [f"n{base + 3}"], **{"from": F.col("asked"), "to": again, "reason": F.lit("more incorrect than correct"), "prompt_preview": T.preview(F.col("rewriting"))}))
        got = got.withColumn("ok", ok).withColumn("steps", steps)
        moved = got.select(
            "query_id", "text", F.when(F.col("ok"), F.col("asked")).otherwise(again).alias("asked"), F.col("ok").alias("stop"), F.lit(a).alias("rounds"), (F.col("spent") + _n_words(F.col("grading")) + F.when(F.col("ok"), 0).otherwise(_n_words(F.col("rewriting")))).alias("spent"), F.col("new").alias("hits"), F.col("judged").alias("grades"),
            F.when(F.col("ok"), F.concat("nodes", "steps")).otherwise(F.concat("nodes", "steps", rewrite)).alias("nodes"),
        )
        state = cut(moved.unionByName(state.where("stop")))
    wrong = F.transform(F.filter("grades", lambda g: g["verdict"] == "incorrect"), lambda g: g["chunk_id"])
    kept = F.filter("hits", lambda h: ~F.array_contains(F.col("wrong"), h["chunk_id"]))
    rows = _answered(state.withColumn("wrong", wrong).withColumn("hits", F.when(F.size(kept) > 0, kept).otherwise(F.col("hits"))), corpus)
    last = F.concat(F.lit("n"), (4 * F.col("rounds") - 1).cast("string"))
    end = _generate_node("end", F.array(last)).withField("id", F.concat(F.lit("n"), (4 * F.col("rounds")).cast("string")))
    return _runs(rows, "corrective", 2 * F.col("rounds"), F.concat("nodes", F.array(end)), F.col("spent"))


def graph_hops(questions: DataFrame, corpus: Corpus) -> DataFrame:
    """Entities that the question names, their neighbourhood, and its chunks; communities give background."""
    start, edges, found = corpus.graph_chunks(questions)
    names = start.groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("seeds"))
    links = edges.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("src", "rel", "dst"))).alias("edges"))
    q = questions.select("query_id", "text").join(names, "query_id", "left").join(links, "query_id", "left").join(corpus.listed(found), "query_id", "left")
    background = None
    if corpus.entities is not None and corpus.communities is not None:
        told = graph.touched_communities(start, edges, corpus.entities, corpus.communities).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("community", "summary"))), lambda c: c["summary"]), "\n").alias("background"))
        q = q.join(told, "query_id", "left")
        background = F.coalesce("background", F.lit(""))
    rows = _answered(q, corpus, background)
    nodes = F.array(
        node("n1", "graph_seed", [], entities=F.coalesce("seeds", F.array().cast("array<string>"))),
        node("n2", "graph_expand", ["n1"], hops=F.lit(config.GRAPH_HOPS), edges=F.coalesce(F.col("edges"), F.array().cast("array<struct<src string, rel string, dst string>>")), chunk_ids=_ids(F.col("hits"))), _generate_node("n3", ["n2"]),
    )
    return _runs(rows, "graph", F.lit(1), nodes)


#: The tool of a second attempt.
RETRY = {"dense": "sparse", "sparse": "dense", "graph": "sparse"}


def tool_route(questions: DataFrame, corpus: Corpus) -> DataFrame:
    """(query_id, text, tool): graph if the question names an entity, else sparse if it holds an exact token, else dense."""
    start, _, _ = corpus.graph_chunks(questions)
    named = start.select("query_id").distinct().withColumn("named", F.lit(True))
    tool = F.when(F.col("named"), "graph").when(T.has_exact_token(F.col("text")), "sparse").otherwise("dense")
    return questions.join(named, "query_id", "left").withColumn("tool", tool).drop("named")


def _by_tool(routed: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    """(query_id, hits) of routed(query_id, text, tool)."""
    take = lambda t: routed.where(F.col("tool") == t).select("query_id", "text")
    lists = [corpus.dense(take("dense"), k), corpus.sparse(take("sparse"), k), corpus.graph_chunks(take("graph"))[2]]
    return corpus.listed(reduce(DataFrame.unionByName, (x.select("query_id", "id", F.col("score").cast("double").alias("score"), "rank") for x in lists)))


def agentic(questions: DataFrame, corpus: Corpus, k: int = config.TOP_K) -> DataFrame:
    """Up to three sub-questions, a tool for each, one more attempt by another tool where the first isn't enough.

    Sub-questions get ids ten to a question, so query_id must leave room for that.
    """
    subs = questions.select("query_id", F.posexplode(corpus.completer.plan(F.col("text"))).alias("no", "part")).select(F.col("query_id").alias("of"), "no", (F.col("query_id") * 10 + F.col("no")).alias("query_id"), F.col("part").alias("text"))
    enough = F.exists("hits", lambda h: F.coalesce(grading.lexical_overlap(F.col("text"), h["text"]), F.lit(0.0)) >= config.GRADE_CORRECT_FROM)
    subs = cut(subs)
    v = corpus.embedded(subs)
    first = cut(tool_route(subs, corpus))
    got = cut(first.join(_by_tool(first.select("query_id", "text", "tool"), corpus, k), "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(_HITS))).withColumn("attempt", F.lit(1)).withColumn("enough", enough))
    other = F.create_map(*(F.lit(x) for kv in RETRY.items() for x in kv))[F.col("tool")]
    second = cut(got.where(~F.col("enough")).select("of", "no", "query_id", "text", other.alias("tool")))
    more = second.join(_by_tool(second.select("query_id", "text", "tool"), corpus, k), "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(_HITS))).withColumn("attempt", F.lit(2)).withColumn("enough", enough)
    order = prompts.reflect(F.col("text"), F.transform("hits", lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["text"].alias("text"))))
    tries = cut(got.unionByName(more).join(v, "query_id").withColumn("order", order))
    key = F.concat(F.lit("s"), F.col("no").cast("string"), F.lit("a"), F.col("attempt").cast("string"))
    name = lambda s: F.concat(key, F.lit(f"-{s}"))
    before = F.when(F.col("attempt") == 1, F.array(F.lit("plan"))).otherwise(F.array(F.concat(F.lit("s"), F.col("no").cast("string"), F.lit("a1-reflect"))))
    route = node(name("route"), "route", before, chosen=F.col("tool"), scores=F.create_map().cast("map<string,double>"), reason=F.lit("rule"))
    results = {"results": _results(F.col("hits")), "k": F.lit(k)}
    branch = (
        F.when(F.col("tool") == "dense", F.array(_embed_node("x", F.array(name("route")), corpus, F.col("vector")).withField("id", name("embed")), node(name("got"), "retrieve_dense", F.array(name("embed")), **results)))
        .when(F.col("tool") == "sparse", F.array(node(name("got"), "retrieve_sparse", F.array(name("route")), **results)))
        .otherwise(F.array(node(name("seed"), "graph_seed", F.array(name("route"))), node(name("got"), "graph_expand", F.array(name("seed")), hops=F.lit(config.GRAPH_HOPS), edges=F.array().cast("array<struct<src string, rel string, dst string>>"), chunk_ids=_ids(F.col("hits")))))
    )
    reflect = node(name("reflect"), "reflect", F.array(name("got")), sufficient=F.col("enough"), reason=F.lit("token overlap"), next_action=F.when(F.col("enough"), "answer").otherwise("retry"), prompt_preview=T.preview(F.col("order")))
    steps = cut(tries.select("of", "no", "attempt", "hits", _n_words(F.col("order")).alias("spent"), F.concat(F.array(route), branch, F.array(reflect)).alias("steps")))
    per = steps.groupBy("of", "no").agg(F.max("attempt").alias("attempts"), F.sum("spent").alias("spent"), F.max_by("hits", "attempt").alias("hits"), F.array_sort(F.collect_list(F.struct("attempt", "steps"))).alias("t"))
    whole = per.groupBy("of").agg(F.sum("spent").alias("spent"), F.array_sort(F.collect_list(F.struct("no", "attempts", "hits", "t"))).alias("subs"))
    q = questions.select("query_id", "text").join(whole, F.col("query_id") == F.col("of"), "left").drop("of")
    every = F.flatten(F.transform("subs", lambda s: s["hits"]))
    once = F.filter(every, lambda h, i: F.array_position(F.transform(every, lambda x: x["chunk_id"]), h["chunk_id"]) == i + 1)
    rows = _answered(q.withColumn("hits", once), corpus)
    planning = prompts.plan(F.col("text"))
    plan = F.array(node("plan", "plan", [], sub_questions=corpus.completer.plan(F.col("text")), prompt_preview=T.preview(planning)))
    inner = F.flatten(F.transform("subs", lambda s: F.flatten(F.transform(s["t"], lambda t: t["steps"]))))
    ends = F.transform("subs", lambda s: F.concat(F.lit("s"), s["no"].cast("string"), F.lit("a"), s["attempts"].cast("string"), F.lit("-reflect")))
    n_tries = F.aggregate("subs", F.lit(0), lambda a, s: a + s["attempts"])
    rows = cut(rows.select("query_id", "text", "hits", "prompt", "answer", n_tries.alias("tries"), (F.col("spent") + _n_words(planning)).alias("spent"), F.concat(plan, inner, F.array(_generate_node("end", ends))).alias("steps")))
    return _runs(rows, "agentic", 2 + F.col("tries"), numbered(F.col("steps")), F.col("spent"))


def architecture_route(questions: DataFrame, corpus: Corpus) -> DataFrame:
    """(query_id, text, chosen): by rule, in place of a model's choice; anything unknown would be naive."""
    start, _, _ = corpus.graph_chunks(questions)
    named = start.groupBy("query_id").agg(F.count("*").alias("named"))
    parts = F.size(corpus.completer.plan(F.col("text")))
    word = lambda p: F.col("text").rlike(p)
    chosen = (
        F.when(F.coalesce("named", F.lit(0)) >= 2, "graph").when(T.has_exact_token(F.col("text")), "hybrid").when(parts > 1, "agentic")
        .when(word(r"(?i)^\s*(why|how)(?!\w)"), "hyde").when(word(r"(?i)(?<!\w)(not|never|without)(?!\w)"), "corrective").otherwise("naive")
    )
    return questions.join(named, "query_id", "left").withColumn("chosen", chosen).drop("named")


def adaptive(questions: DataFrame, corpus: Corpus) -> DataFrame:
    """Routes each question to one of the others and splices its trace below the route."""
    routed = cut(architecture_route(questions.select("query_id", "text"), corpus))
    runs = [PIPELINES[a](routed.where(F.col("chosen") == a).select("query_id", "text"), corpus) for a in DELEGATES]
    every = cut(reduce(DataFrame.unionByName, runs))
    route = F.array(node("n1", "route", [], chosen=F.col("architecture"), scores=F.create_map().cast("map<string,double>"), reason=F.lit("rule"), prompt_preview=T.preview(prompts.route(F.col("question")))))
    name = F.lit("adaptive")
    return every.select(
        "query_id", name.alias("architecture"), "question", "answer", "chunk_ids", (F.col("llm_calls") + 1).alias("llm_calls"), (F.col("prompt_tokens") + _n_words(prompts.route(F.col("question")))).alias("prompt_tokens"), "completion_tokens",
        T.trace_id(name, F.col("question")).alias("trace_id"), F.concat(route, spliced(F.col("nodes"), F.col("architecture"), F.lit("n1"))).alias("nodes"),
    )


#: What ``adaptive`` chooses from.
DELEGATES = ("naive", "hybrid", "hyde", "corrective", "graph", "agentic")
PIPELINES = {"naive": naive, "hybrid": hybrid, "hyde": hyde, "corrective": corrective, "graph": graph_hops, "agentic": agentic, "adaptive": adaptive}


def run_all(questions: DataFrame, corpus: Corpus, architectures: tuple[str, ...] = config.ARCHITECTURES) -> DataFrame:
    """Runs of every architecture on every question."""
    return reduce(DataFrame.unionByName, (PIPELINES[a](questions, corpus) for a in architectures))

"""Further registered queries, of prompts and views, with their SQL; they join those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import prompts as P
from tessera.functions import text as T
from tessera.operators import completion, evaluation, extraction, graph, views
from tessera.plans import catalog as C
from tessera.plans import pipeline_sql as SQL
from tessera.plans import sweep
from tessera.plans.catalog import ORACLE, QUERIES, query, table

_N = "chr(10)"


def _sql(step: str, *parts: str) -> str:
    """SQL of a step's prompt; each part is SQL."""
    return f" || {_N} || ".join((_text(P.head(step)), *parts))


def _tag(name: str, sql: str, opened: str | None = None) -> str:
    return f"{opened or _text(f'<{name}>')} || {_N} || {sql} || {_N} || '</{name}>'"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", f"' || {_N} || '") + "'"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))


def _sha(c):
    return F.sha2(c, 256)


_SHAPE = '{"chosen": "string"}'


@query(f"SELECT item_id, sha256({_sql('generate_hypothetical', _tag('question', 'text'))}) AS prompt_sha FROM benchmark")
def q3_hyde_prompts(spark, sf_dir):
    return _items(spark, sf_dir).select("item_id", _sha(P.hyde(F.col("q"))).alias("prompt_sha"))


_CHUNK = "'<chunk id=\"c::' || turn || '\">' || chr(10) || {} || chr(10) || '</chunk>'"
_TURNS = f"""FROM (SELECT conv_id, 'what of ' || conv_id AS q, string_agg({_CHUNK.format('text')}, chr(10) ORDER BY turn) AS hits, coalesce(string_agg(role || ' ' || turn, chr(10) ORDER BY turn) FILTER (turn % 2 = 1), 'none') AS reasons,
  coalesce(string_agg({_CHUNK.format('text[:200]')}, chr(10) ORDER BY turn) FILTER (turn % 2 = 1), 'none') AS odd FROM conversations GROUP BY conv_id)"""


def _turns(spark, sf_dir):
    """Each conversation's turns as chunks, and those of odd number apart."""
    t = F.struct("turn", F.concat(F.lit("c::"), F.col("turn").cast("string")).alias("chunk_id"), "text", F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("reason"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("t"))
    hits = F.transform("t", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text")))
    odd = F.filter("t", lambda x: x["turn"] % 2 == 1)
    return rows.select("conv_id", F.concat(F.lit("what of "), F.col("conv_id").cast("string")).alias("q"), hits.alias("hits"), F.transform(odd, lambda x: x["reason"]).alias("reasons"), F.transform(odd, lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text"))).alias("odd"))


@query(f"SELECT conv_id, sha256({_sql('grade', 'hits', _tag('question', 'q'))}) AS grading_sha, sha256({_sql('rewrite', _tag('reasons', 'reasons'), _tag('query', 'q'))}) AS rewrite_sha {_TURNS}")
def q4_corrective_prompts(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", _sha(P.grading(F.col("q"), F.col("hits"))).alias("grading_sha"), _sha(P.rewrite(F.col("q"), F.col("reasons"))).alias("rewrite_sha"))


@query(f"SELECT conv_id, sha256({_sql('plan', _tag('question', 'q'))}) AS plan_sha, sha256({_sql('reflect', 'odd', _tag('sub_question', 'q'))}) AS reflect_sha {_TURNS}")
def q5_agentic_prompts(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", _sha(P.plan(F.col("q"))).alias("plan_sha"), _sha(P.reflect(F.col("q"), F.col("odd"))).alias("reflect_sha"))


@query(f"SELECT item_id, sha256({_sql('route', _tag('plans', _text(P.plans())), _tag('question', 'text'))}) AS prompt_sha FROM benchmark")
def q6_route_prompts(spark, sf_dir):
    return _items(spark, sf_dir).select("item_id", _sha(P.route(F.col("q"))).alias("prompt_sha"))


_NOTE = "'<chunk note=\"' || doc_id || '\" heading=\"' || CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE source END || '\">'"


@query(f"""
WITH v AS (SELECT string_agg(lower(r_name), chr(10) ORDER BY r_name) AS v FROM region)
SELECT doc_id, sha256({_sql('triples', _tag('vocabulary', 'v'), _tag('chunk', 'text', _NOTE))}) AS prompt_sha FROM documents, v
""")
def q7_extraction_prompts(spark, sf_dir):
    v = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(F.lower("r_name"))).alias("v"))  # the vocabulary: one row
    heading = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").crossJoin(F.broadcast(v)).select("doc_id", _sha(P.extraction(F.col("doc_id").cast("string"), heading, F.col("text"), F.col("v"))).alias("prompt_sha"))


@query(f"""
WITH e AS (SELECT r_regionkey, r_name, n_name, 'c::' || n_nationkey AS chunk_id, CASE WHEN n_nationkey % 4 > 0 THEN n_name || ' of ' || r_name END AS text FROM nation JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT r_regionkey, string_agg(n_name, chr(10) ORDER BY n_name) AS ents, string_agg(n_name || ' | lies in | ' || r_name, chr(10) ORDER BY n_name) AS rels, coalesce(string_agg('<chunk id="' || chunk_id || '">' || chr(10) || text[:300] || chr(10) || '</chunk>', chr(10) ORDER BY chunk_id) FILTER (text <> ''), 'none') AS ex FROM e GROUP BY 1)
SELECT CAST(r_regionkey AS BIGINT) AS community, sha256({_sql('summary', _tag('members', 'ents'), _tag('edges', 'rels'), 'ex')}) AS prompt_sha FROM g
""")
def q7_community_prompts(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    e = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_regionkey").cast("long").alias("community"), F.col("n_name").alias("src"), F.lit("lies in").alias("rel"), F.col("r_name").alias("dst"), F.concat(F.lit("c::"), F.col("n_nationkey").cast("string")).alias("chunk_id"), F.when(F.col("n_nationkey") % 4 > 0, F.concat("n_name", F.lit(" of "), "r_name")).alias("text"))
    g = e.groupBy("community").agg(F.array_sort(F.collect_list("src")).alias("entities"), F.array_sort(F.collect_list(F.struct("src", "rel", "dst"))).alias("edges"), F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("excerpts"))
    return g.select("community", _sha(P.community(F.col("entities"), F.col("edges"), F.col("excerpts"))).alias("prompt_sha"))


_POINTS = "SELECT conv_id, any_value('what of ' || conv_id) AS q, arg_max(text, turn) AS answer, string_agg('#' || (turn + 1) || ' ' || role, chr(10) ORDER BY turn) AS points FROM (SELECT conv_id, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations) GROUP BY conv_id"


@query(f"SELECT conv_id, sha256({_sql('judge', _tag('points', 'points'), _tag('question', 'q'), _tag('answer', 'answer'), _text(P.REPLY), _text(_SHAPE))}) AS prompt_sha FROM ({_POINTS})")
def q8_judge_prompts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"), F.max_by("text", "turn").alias("answer"))
    prompt = P.judge(F.concat(F.lit("what of "), F.col("conv_id").cast("string")), F.col("answer"), F.transform("t", lambda x: x["role"]))
    return rows.select("conv_id", _sha(P.with_json(prompt, _SHAPE)).alias("prompt_sha"))


# --- views ------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn FROM conversations WHERE contains(text, 'er')")
def f6_marked_answers(spark, sf_dir):
    return views.containing(table(spark, sf_dir, "conversations"), "text", "er").select("conv_id", "turn")


_BY_TYPE = C._ROWS + "SELECT architecture, question_type, count(*) AS n_questions, round(avg(recall_at_5) + 1e-9, 4) AS recall_at_5 FROM rows GROUP BY GROUPING SETS ((architecture), (architecture, question_type)) "


@query(f"SELECT * FROM ({_BY_TYPE}) WHERE question_type = 'keyword' UNION ALL SELECT * FROM ({_BY_TYPE}) WHERE question_type IS NULL")
def f11_report_of_type(spark, sf_dir):
    r = evaluation.report(C._eval_rows(spark, sf_dir))
    return views.of_type(r, "keyword").unionByName(views.of_type(r, None)).select("architecture", "question_type", "n_questions", F.round(F.col("recall_at_5") + 1e-9, 4).alias("recall_at_5"))


@query("SELECT lang, count(*) AS n, sha256(string_agg(doc_id || ' ' || coalesce(source, ''), ',' ORDER BY doc_id)) AS items_sha FROM documents GROUP BY lang")
def a22_questions_by_type(spark, sf_dir):
    g = views.grouped(table(spark, sf_dir, "documents").select("lang", "doc_id", F.coalesce("source", F.lit("")).alias("source")), "lang", "doc_id", "source")
    return g.select("lang", "n", _sha(F.array_join(F.transform("items", lambda x: F.concat_ws(" ", x["doc_id"].cast("string"), x["source"])), ",")).alias("items_sha"))


@query("""
WITH n AS (SELECT conv_id AS graph, turn AS id, ['plan', 'grade', 'generate'][turn % 3 + 1] AS kind FROM conversations),
e AS (SELECT conv_id AS graph, turn - 1 AS src, turn AS dst FROM conversations UNION ALL SELECT conv_id, turn + 2, turn FROM conversations),
r AS (SELECT 'grade' AS kind, ['plan'] AS accepted, CAST(1 AS BIGINT) AS least UNION ALL SELECT 'generate', ['grade', 'plan'], 2),
c AS (SELECT e.graph, e.dst, count(*) AS parents FROM e JOIN n s ON s.graph = e.graph AND s.id = e.src JOIN n t ON t.graph = e.graph AND t.id = e.dst JOIN r ON r.kind = t.kind WHERE list_contains(r.accepted, s.kind) GROUP BY ALL)
SELECT n.graph, n.id, n.kind, CAST(coalesce(parents, 0) AS BIGINT) AS parents, least, coalesce(parents, 0) >= least AS ok FROM n JOIN r USING (kind) LEFT JOIN c ON c.graph = n.graph AND c.dst = n.id
""")
def j13_parent_kinds(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph"), F.col("turn").alias("id")).distinct()
    nodes = t.withColumn("kind", F.get(F.array(F.lit("plan"), F.lit("grade"), F.lit("generate")), (F.col("id") % 3).cast("int")))
    edges = t.select("graph", (F.col("id") - 1).alias("src"), F.col("id").alias("dst")).unionByName(t.select("graph", (F.col("id") + 2).alias("src"), F.col("id").alias("dst")))
    required = spark.createDataFrame([("grade", ["plan"], 1), ("generate", ["grade", "plan"], 2)], "kind string, accepted array<string>, least long")
    return views.parent_kinds(nodes, edges, required)


@query("SELECT conv_id AS graph, 's' || turn AS id, 'r' || (turn + 1) AS target, role AS payload FROM conversations")
def j16_preset_replay(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    nodes = t.select(F.col("conv_id").alias("graph"), name("s", F.col("turn")).alias("id"))
    mapping = t.select(F.col("conv_id").alias("graph"), name("s", F.col("turn")).alias("id"), name("r", F.col("turn") + 1).alias("target"))
    return views.replayed(nodes, mapping, t.select(F.col("conv_id").alias("graph"), name("r", F.col("turn") + 1).alias("target"), F.col("role").alias("payload")))


@query("SELECT conv_id, turn AS item, CAST(length(text) AS DOUBLE) AS score FROM conversations")
def j12_scored_by_position(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    z = views.zipped(F.transform("t", lambda x: x["turn"].cast("string")), F.transform("t", lambda x: F.length(x["text"]).cast("double")))
    turn = table(spark, sf_dir, "conversations").schema["turn"].dataType
    return g.select("conv_id", F.explode(z).alias("z")).select("conv_id", F.col("z.item").cast(turn).alias("item"), "z.score")


@query("""
WITH v AS (SELECT DISTINCT lower(n_name) AS id FROM nation), q AS (SELECT r_regionkey AS query_id, string_agg(lower(n_name), ' and ') AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT CAST(query_id AS BIGINT) AS query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY length(id) DESC, id) AS INTEGER) AS place FROM q, v WHERE regexp_matches(text, '\\b' || replace(id, ' ', '[ -]+') || '\\b')
""")
def l7_seeds_longest_first(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    q = n.groupBy(F.col("n_regionkey").cast("long").alias("query_id")).agg(F.array_join(F.collect_list(F.lower("n_name")), " and ").alias("text"))
    return views.seed_order(graph.seeds(q, n.select(F.lower("n_name").alias("id")).distinct()))


@query("SELECT doc_id, lang || chr(10) || '  ' || coalesce(source, 'x') AS code, CAST(3 AS INTEGER) AS first, CAST(4 AS INTEGER) AS last FROM documents")
def t14_regions(spark, sf_dir):
    source = F.concat(F.lit("def f():\n  # region: run\n    "), "lang", F.lit("\n      "), F.coalesce("source", F.lit("x")), F.lit("\n  # endregion\n# endregion\n"))
    return table(spark, sf_dir, "documents").select("doc_id", views.regions(source, "run").alias("r")).select("doc_id", "r.code", "r.first", "r.last")


@query("""
WITH v AS (SELECT DISTINCT lower(n_name) AS id FROM nation), t AS (SELECT lower(n_name) AS src, lower(r_name) AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT lower(a.n_name), lower(b.n_name) FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey),
k AS (SELECT * FROM t WHERE src IN (FROM v) AND dst IN (FROM v))
SELECT (SELECT count(*) FROM nation) AS chunks, (SELECT count(*) FROM v) AS entities_before, (SELECT count(*) FROM t) AS triples_extracted, (SELECT count(*) FROM k) AS triples_accepted, (SELECT count(*) FROM (SELECT src FROM k UNION SELECT dst FROM k)) AS entities_after, (SELECT count(*) FROM region) AS communities, (SELECT count(*) FROM t) - (SELECT count(*) FROM k) AS triples_dropped
""")
def a19_build_stats(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    low = lambda df, k, a: df.select(F.lower(k).alias(a))
    m = n.select("n_regionkey", F.col("n_nationkey").alias("k"), F.lower("n_name").alias("dst"))
    a = n.join(r, n.n_regionkey == r.r_regionkey).select(F.lower("n_name").alias("src"), F.lower("r_name").alias("dst"), F.lit("near").alias("rel"), F.lit("c").alias("chunk_id"))
    b = n.join(m, "n_regionkey").where("n_nationkey < k").select(F.lower("n_name").alias("src"), "dst", F.lit("near").alias("rel"), F.lit("c").alias("chunk_id"))
    triples, vocabulary = a.unionByName(b), low(n, "n_name", "id").distinct()
    return views.build_stats(n, vocabulary, triples, graph.accepted(triples, vocabulary), r)


_CONV = """
WITH c AS (SELECT conv_id AS question_id, list(CAST(turn AS VARCHAR) ORDER BY text, turn) AS r, list(CAST(turn AS VARCHAR) ORDER BY turn) AS every, sum(length(text)) AS n FROM conversations GROUP BY conv_id),
q AS (SELECT *, list_filter(every, lambda x: CAST(x AS BIGINT) % 2 = 0) AS g FROM c), h AS (SELECT *, list_filter(range(1, len(r) + 1), lambda i: list_contains(g, r[i])) AS hits FROM q)
"""


def _runs(spark, sf_dir):
    """Runs, questions and judgements made from conversations."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct("text", "turn"))).alias("t"), F.sum(F.length("text")).alias("n"))
    ids = F.transform("t", lambda x: x["turn"].cast("string"))
    runs = c.select(
        F.lit("naive").alias("architecture"), "question_id", F.concat(F.lit("t"), F.col("question_id").cast("string")).alias("trace_id"), F.lit("a").alias("answer"), ids.alias("retrieved_chunk_ids"), F.lit(False).alias("graph_tool_involved"),
        F.lit(1.5).alias("latency_ms"), F.lit(1).cast("long").alias("llm_calls"), F.col("n").alias("prompt_tokens"), F.lit(7).cast("long").alias("completion_tokens"), F.array(F.lit("b")).alias("backend_calls"), F.lit(None).cast("string").alias("adaptive_routed_to"),
    )
    gold = F.filter(F.array_distinct(ids), lambda x: x.cast("long") % 2 == 0)
    kind = F.when(F.col("n") % 4 == 0, "unanswerable").otherwise("factual")
    questions = c.select("question_id", kind.alias("question_type"), gold.alias("gold_chunk_ids"), F.array(F.lit("p1"), F.lit("p2")).alias("gold_answer_points"))
    judged = c.select(F.lit("naive").alias("architecture"), "question_id", F.array(F.lit(True), F.col("n") % 2 == 0).alias("point_support"), (F.col("n") % 3 == 0).alias("reads_as_refusal"), F.lit("why").alias("judge_reasoning"), F.lit("j").alias("judge_backend"), (F.col("n") % 10).alias("judge_prompt_tokens"), F.lit(3).cast("long").alias("judge_completion_tokens"))
    return runs, questions, judged


_EVAL = _CONV + """
SELECT question_id, CASE WHEN n % 4 = 0 THEN 'unanswerable' ELSE 'factual' END AS question_type, round(len(list_filter(hits, lambda i: i <= 5)) / nullif(len(g), 0), 6) AS recall_at_5, round(len(hits) / nullif(len(g), 0), 6) AS recall_full,
  CASE WHEN len(g) > 0 THEN round(CASE WHEN list_min(hits) <= 10 THEN 1 / list_min(hits) ELSE 0 END, 6) END AS mrr_at_10, CASE WHEN n % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS faithfulness, CASE WHEN n % 4 = 0 THEN n % 3 = 0 END AS refusal_correctness, CAST(n + n % 10 AS BIGINT) AS prompt_tokens, CAST(10 AS BIGINT) AS completion_tokens, CAST(1 AS BIGINT) AS llm_calls, 'j' AS judge_backend FROM h
"""
_SHOWN = ("question_id", "question_type", "recall_at_5", "recall_full", "mrr_at_10", "faithfulness", "refusal_correctness", "prompt_tokens", "completion_tokens", "llm_calls", "judge_backend")


@query(_EVAL)
def m9_eval_rows(spark, sf_dir):
    return C._rounded(views.eval_rows(*_runs(spark, sf_dir)).select(*_SHOWN))


@query(_EVAL)
def m11_recomputed(spark, sf_dir):
    runs, questions, judged = _runs(spark, sf_dir)
    return C._rounded(views.recomputed(views.eval_rows(runs, questions, judged), runs, questions).select(*_SHOWN))


@query(C._ROWS + f", a AS (SELECT unnest({C._ARCH}) AS architecture), t AS (SELECT unnest([NULL, 'factual', 'multi_hop', 'keyword', 'unanswerable', 'never']) AS question_type), r AS (SELECT architecture, question_type, count(*) AS n FROM rows GROUP BY GROUPING SETS ((architecture), (architecture, question_type))) SELECT a.architecture, t.question_type, coalesce(n, 0) AS n_questions, n IS NULL AS empty FROM a CROSS JOIN t LEFT JOIN r ON r.architecture = a.architecture AND r.question_type IS NOT DISTINCT FROM t.question_type")
def a14_full_report(spark, sf_dir):
    return evaluation.full_report(C._eval_rows(spark, sf_dir), [*C._TYPES, "never"]).select("architecture", "question_type", "n_questions", (F.col("rank_note") == "no rows").alias("empty"))


@query(C._ROWS + "SELECT architecture, count(*) AS runs, CAST(sum(llm_calls) AS BIGINT) AS llm_calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM rows GROUP BY 1")
def a17_costs(spark, sf_dir):
    return views.costs(C._eval_rows(spark, sf_dir))


@query(C._ROWS + "SELECT count(DISTINCT architecture) AS n_architectures, count(*) // count(DISTINCT architecture) AS n_questions, count(*) AS traces, (SELECT count(*) FROM conversations) AS chunks FROM rows")
def a23_home_counts(spark, sf_dir):
    return views.home_counts(C._eval_rows(spark, sf_dir).withColumn("trace_id", F.lit("t")), table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN CAST(5 AS BIGINT) ELSE CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) END AS prompt_tokens, CAST(len(list_filter(regexp_split_to_array(role, '\\s+'), lambda x: x <> '')) AS BIGINT) AS completion_tokens FROM conversations")
def x5_word_usage(spark, sf_dir):
    own = F.when(F.col("turn") % 2 == 0, F.lit(5))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", views.word_usage(F.col("text"), F.col("role"), own, F.lit(None).cast("int")).alias("u")).select("conv_id", "turn", "u.prompt_tokens", "u.completion_tokens")


@query("SELECT doc_id, lang || ' notes' AS title, ['a', lower(lang)] AS tags, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS words, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'no tags' WHEN 2 THEN 'no created' ELSE 'no opening ---' END AS problem FROM documents".replace("['a', lower(lang)] AS tags", "CASE WHEN doc_id % 4 = 1 THEN '' ELSE 'a,' || lang END AS tags").replace("len(list", "CAST(len(list").replace("x <> '')) AS words", "x <> '')) AS BIGINT) AS words"))
def s19_strict_notes(spark, sf_dir):
    d, m = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    text = F.concat(F.when(m == 3, "\n").otherwise(""), F.lit("---\ntitle: \""), "lang", F.lit(" notes\"\ntags: ["), F.when(m == 1, "").otherwise(F.concat(F.lit("a, "), "lang")), F.lit("]\nentities:\n  - One\n  - 'two b'\n"), F.when(m == 2, "").otherwise("created: 2024-05-01\n"), F.lit("---\n"), F.coalesce("text", F.lit("")))
    got = views.strict_notes(d.select(F.col("doc_id").alias("name"), text.alias("text")))
    return got.select(F.col("name").alias("doc_id"), "title", F.array_join("tags", ",").alias("tags"), F.col("words").cast("long").alias("words"), "problem")


__all__ = ["ORACLE", "QUERIES"]


# --- completion, extraction and evaluation of runs --------------------------------------------------


@query("""
WITH p AS (SELECT DISTINCT c_mktsegment || ' ' || c_custkey AS prompt FROM customer)
SELECT prompt, CASE WHEN prompt LIKE 'BUILDING%' THEN CASE WHEN prompt LIKE '%7' THEN NULL ELSE '{"by": "second"}' END WHEN prompt LIKE '%3' THEN '{"by": "repair"}' WHEN prompt LIKE '%5' THEN '{"by": "second"}' ELSE '{"by": "first"}' END AS json,
  CASE WHEN prompt LIKE 'BUILDING%7' THEN NULL WHEN prompt LIKE 'BUILDING%' OR prompt LIKE '%5' THEN 'second' ELSE 'first' END AS backend,
  prompt NOT LIKE 'BUILDING%' AND prompt LIKE '%3' AS repaired, CASE WHEN prompt LIKE 'BUILDING%7' THEN 'second is down' END AS error
FROM p
""")
def x5_fallback(spark, sf_dir):
    """Customers as prompts: the first backend is down for some, replies without JSON to others, once or whenever it's asked; the second is down for a few of these."""
    prompt = F.col("prompt")
    again = prompt.contains("<rejected>")
    own = F.when(again & prompt.rlike(r"^\S+ \d*3\n"), '{"by": "repair"}').when(prompt.endswith("3"), "not yet").when(prompt.rlike(r"^\S+ \d*5(\n|$)"), "never").otherwise('{"by": "first"}')
    first = completion.from_column("first", "m1", lambda _: own, lambda p: F.when(p.startswith("BUILDING"), "first is down"))
    second = completion.from_column("second", "m2", lambda _: F.lit('{"by": "second"}'), lambda p: F.when(p.startswith("BUILDING") & p.endswith("7"), "second is down"))
    asked = table(spark, sf_dir, "customer").select(F.concat_ws(" ", "c_mktsegment", F.col("c_custkey").cast("string")).alias("prompt"))
    return completion.complete(asked, [first, second], as_json=True).select("prompt", "json", "backend", "repaired", "error")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, 's' || l_suppkey AS s, 'p' || l_partkey AS p, l_orderkey % 6 AS rule FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, count(*) AS n, any_value(rule) AS rule FROM r GROUP BY ALL)
SELECT 'o' || l_orderkey || '-' || l_linenumber AS chunk_id, CAST(CASE WHEN rule = 5 THEN 0 ELSE 2 * n END AS BIGINT) AS proposed, CAST(CASE rule WHEN 0 THEN 2 * n WHEN 1 THEN 2 * n WHEN 2 THEN n WHEN 3 THEN n WHEN 4 THEN n ELSE 0 END AS BIGINT) AS kept FROM c
""")
def g5_triples(spark, sf_dir):
    """Each line of an order as a chunk with a model's reply: clean, in prose, with an empty relation, an unknown subject, an element that is no object, or no list at all. What is kept of it, by chunk."""
    t = table(spark, sf_dir, "lineitem")
    s, p, rule = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.col("l_orderkey") % 6
    triple = lambda a, r, b: F.format_string('{"subject": "%s", "relation": "%s", "object": "%s"}', a, F.lit(r), b)
    one = triple(s, "ships", F.upper(p))
    other = F.when(rule == 2, triple(s, " ", p)).when(rule == 3, triple(F.lit("nobody"), "ships", p)).when(rule == 4, F.lit('"no object"')).otherwise(triple(p, "comes from", F.concat(F.lit("  "), s)))
    chunk = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    rows = t.select(chunk.alias("chunk_id"), rule.alias("rule"), F.concat_ws(", ", one, other).alias("own"), s.alias("s"), p.alias("p"))
    told = rows.groupBy("chunk_id").agg(F.any_value("rule").alias("rule"), F.array_join(F.collect_list("own"), ", ").alias("own"))  # a line of an order
    whole = F.concat(F.lit('{"triples": ['), F.col("own"), F.lit("]}"))
    reply = F.when(F.col("rule") == 1, F.concat(F.lit("Here they are: "), whole, F.lit(" as asked."))).when(F.col("rule") == 5, '{"triples": "none"}').otherwise(whole)
    replies = told.select("chunk_id", T.json_of(reply).alias("json"))
    vocabulary = rows.select(F.col("s").alias("id")).unionByName(rows.select(F.col("p").alias("id"))).distinct()
    return extraction.extracted(replies, vocabulary)[1].select("chunk_id", "proposed", "kept")


_GOLD = "list_transform(range(query_id % 7, 1000, 7), lambda i: 'd::' || i)"


@query(f"""
WITH x AS ({SQL.plan(C._POSED, "naive")}), y AS (SELECT query_id, string_split(chunk_ids, ' ') AS r, {_GOLD} AS g, llm_calls FROM x),
z AS (SELECT *, list_filter(range(1, len(r) + 1), lambda i: list_contains(g, r[i])) AS hit FROM y)
SELECT 'naive' AS architecture, query_id AS question_id, round(len(list_intersect(r[:5], g)) / len(g), 9) AS recall_at_5, round(coalesce(1.0::DOUBLE / list_min(hit), 0), 9) AS mrr_at_10,
  round(coalesce(list_sum(list_transform(hit, lambda i: 1.0::DOUBLE / log2(i + 1))), 0) / list_sum(list_transform(range(1, 11), lambda i: 1.0::DOUBLE / log2(i + 1))), 9) AS ndcg_at_10, llm_calls
FROM z
""")
def m9_measured_runs(spark, sf_dir):
    """The naive plan's runs, measured by their traces' evidence against gold by a fixed rule."""
    asked = C._posed(spark, sf_dir).withColumn("question_id", F.col("query_id"))
    gold = F.transform(F.sequence((F.col("query_id") % 7).cast("int"), F.lit(999), F.lit(7)), lambda i: F.concat(F.lit("d::"), i.cast("string")))
    questions = asked.select("query_id", "question_id", "text", F.lit("factual").alias("question_type"), gold.alias("gold_chunk_ids"), F.array().cast("array<string>").alias("gold_answer_points"))
    judge = completion.from_column("offline", "m", lambda _: F.lit('{"point_support": [], "reads_as_appropriate_refusal": false}'))
    rows = sweep.measured(questions, C._corpus(spark, sf_dir), "naive", [judge])
    return rows.select("architecture", "question_id", *(F.round(m, 9).alias(m) for m in ("recall_at_5", "mrr_at_10", "ndcg_at_10")), "llm_calls")


@query("""
WITH w AS (SELECT DISTINCT lower(p_type) AS id FROM part), q AS (SELECT p_partkey AS query_id, 'A ' || upper(p_type) || ', or ' || replace(p_type, ' ', '-') || 's and ' || p_name AS text FROM part)
SELECT query_id, id FROM q JOIN w ON contains(lower(replace(text, '-', ' ')), id) AND regexp_matches(lower(text), '\\b' || replace(id, ' ', '[ -]+') || '\\b')
""")
def j4_part_mentions(spark, sf_dir):
    """The types of all parts as vocabulary, matched in what is said about each part."""
    parts = table(spark, sf_dir, "part")
    q = parts.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("A "), F.upper("p_type"), F.lit(", or "), F.replace(F.col("p_type"), F.lit(" "), F.lit("-")), F.lit("s and "), "p_name").alias("text"))
    return graph.seeds(q, parts.select(F.lower("p_type").alias("id")).distinct())

"""The registered retrieval queries, each over its whole tables, and equivalent SQL where SQL can say it.

Keys start with the id of the operator that they show. ``documents`` stand for notes and chunks,
``benchmark`` for questions, ``embeddings`` for the dense store; evaluation rows are derived from
``documents`` and ``labels`` by fixed arithmetic, and the entity graph from ``lineitem``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import text as T
from tessera.operators import blockmax, dense, evaluation, graph, grading, models, ranking, sparse, trace
from tessera.operators.lineage import cut
from tessera.plans import pipeline_sql as SQL
from tessera.plans import pipelines, spec
from tessera.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: A literal query with a repeated word.
ASKED = "the the of ther nderia que tion"
DIMS = 64


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text, spread over the cores: small files come as one split."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.repartition(spark.sparkContext.defaultParallelism) if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else docs


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, ASKED)], "query_id long, text string")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- text -------------------------------------------------------------------------------------------

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')"
_SET = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: length(x) > 1))"


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_TOKENS})) AS BIGINT) AS n_distinct FROM documents")
def t6_tokens(spark, sf_dir):
    w = T.tokens(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, CAST(len({_SET.format('text')}) AS BIGINT) AS n, sha256(array_to_string(list_sort({_SET.format('text')}), ' ')) AS tokens_sha FROM documents")
def t7_token_sets(spark, sf_dir):
    s = T.token_set(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.sha2(F.array_join(F.array_sort(s), " "), 256).alias("tokens_sha"))


@query("""
WITH b AS (SELECT doc_id, regexp_split_to_array('Intro ' || source || chr(10) || '## ' || lang || chr(10) || text, '(?m)^##\\s+') AS parts FROM documents),
p AS (SELECT doc_id, i, parts[i] AS part FROM b, unnest(range(1, len(parts) + 1)) t(i)),
s AS (SELECT doc_id, i, CASE WHEN i > 1 THEN trim(regexp_extract(part, '^([^\\n]*)', 1)) END AS heading, CASE WHEN i = 1 THEN part ELSE regexp_replace(part, '^[^\\n]*\\n?', '') END AS body FROM p)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS section, heading, CAST(length(body) AS BIGINT) AS n_chars FROM s
""")
def t1_sections(spark, sf_dir):
    body = F.concat(F.lit("Intro "), "source", F.lit("\n## "), "lang", F.lit("\n"), "text")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sections(body)).alias("section", "s"))
    return rows.select("doc_id", F.col("section").cast("long").alias("section"), "s.heading", F.length("s.text").cast("long").alias("n_chars"))


_PARAGRAPHS = "list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')"


@query(f"SELECT doc_id, CAST(len({_PARAGRAPHS}) AS BIGINT) AS paragraphs, CAST(coalesce(list_max(list_transform({_PARAGRAPHS}, lambda p: length(p))), 0) AS BIGINT) AS longest FROM documents")
def t2_paragraphs(spark, sf_dir):
    p = T.paragraphs(F.col("text"), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(p).cast("long").alias("paragraphs"), F.coalesce(F.array_max(F.transform(p, F.length)), F.lit(0)).cast("long").alias("longest"))


_CHUNKS = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PARAGRAPHS} AS ps FROM documents),
p AS (SELECT doc_id, i, list_filter(regexp_split_to_array(ps[i], '\\s+'), lambda x: x <> '') AS w FROM d, unnest(range(1, len(ps) + 1)) t(i)),
r AS (
  SELECT doc_id, i, w AS cur, CAST(NULL AS VARCHAR[]) AS done FROM p WHERE i = 1
  UNION ALL
  SELECT r.doc_id, p.i, CASE WHEN len(r.cur) + len(p.w) > 250 THEN list_concat(r.cur[-50:], p.w) ELSE list_concat(r.cur, p.w) END, CASE WHEN len(r.cur) + len(p.w) > 250 THEN r.cur END
  FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1
),
e AS (
  SELECT doc_id, i, done AS ws FROM r WHERE done IS NOT NULL
  UNION ALL
  SELECT doc_id, i + 1, cur FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1
),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, ws FROM e)
"""


@query(_CHUNKS + "SELECT doc_id || '::' || idx AS chunk_id, doc_id AS note_id, CAST(len(ws) AS BIGINT) AS n_words, sha256(array_to_string(ws, ' ')) AS text_sha FROM c")
def t3_chunks(spark, sf_dir):
    # each text as one section
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.pack(T.paragraphs(F.col("text"), "\n"))).alias("i", "t"))
    return docs.select(F.concat_ws("::", "doc_id", "i").alias("chunk_id"), F.col("doc_id").alias("note_id"), F.size(T.words(F.col("t"))).cast("long").alias("n_words"), F.sha2("t", 256).alias("text_sha"))


@query(_CHUNKS + "SELECT CAST(count(*) AS BIGINT) AS chunks, CAST(count(DISTINCT doc_id) AS BIGINT) AS notes, CAST(max(len(ws)) AS BIGINT) AS longest FROM c")
def t5_chunk_counts(spark, sf_dir):
    return t3_chunks(spark, sf_dir).agg(F.count("*").alias("chunks"), F.countDistinct("note_id").alias("notes"), F.max("n_words").alias("longest"))


@query("SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || chr(9) || ' ' || upper(p_type) || chr(10)), '\\s+', ' ', 'g')) AS entity FROM part")
def t8_normal_entities(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.normal_entity(F.concat(F.lit("  "), "p_name", F.lit("\t "), F.upper("p_type"), F.lit("\n"))).alias("entity"))


_VOCABULARY = "SELECT DISTINCT trim(regexp_replace(lower(e), '\\s+', ' ', 'g')) AS id FROM (SELECT n_name AS e FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT p_type FROM part)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with entities: what nations, regions and parts are called."""
    rows = [table(spark, sf_dir, t).select(F.concat(F.lit(t), F.col(k).cast("string")).alias("note_id"), F.array(n).alias("entities")) for t, k, n in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"), ("part", "p_partkey", "p_type"))]
    return reduce(DataFrame.unionByName, rows)


@query(_VOCABULARY)
def t9_vocabulary(spark, sf_dir):
    return graph.vocabulary(_named(spark, sf_dir))


@query("SELECT id, CAST(notes AS BIGINT) AS notes FROM (SELECT trim(regexp_replace(lower(e), '\\s+', ' ', 'g')) AS id, count(*) AS notes FROM (SELECT n_name AS e FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT p_type FROM part) GROUP BY 1) WHERE notes >= 3")
def a9_note_frequency(spark, sf_dir):
    return graph.note_frequency(_named(spark, sf_dir))


@query("SELECT source, sha256(string_agg(sha256(text), chr(10) ORDER BY sha256(text))) AS build FROM documents GROUP BY source")
def t10_content_hash(spark, sf_dir):
    h = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h"))
    return h.groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("build"))


@query("""
WITH t AS (SELECT conv_id, turn, text || ' [note' || chr(8208) || conv_id || '::' || turn || '] so [ Citation: other-' || role || '::' || conv_id || ' ] and [' || chr(8203) || 'x::1]' AS t FROM conversations),
c AS (SELECT conv_id, turn, regexp_extract_all(t, '(?i)\\[\\x{200B}?\\s*(?:citation:)?\\s*\\x{200B}?([a-z0-9_\\-\\x{2010}\\x{2011}]+::[0-9]+)\\s*\\x{200B}?\\]', 1) AS cs FROM t)
SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS pos, translate(cs[i], chr(8208) || chr(8209), '--') AS cited FROM c, unnest(range(1, len(cs) + 1)) u(i)
""")
def t11_citations(spark, sf_dir):
    t = F.concat("text", F.lit(" [note‐"), F.col("conv_id").cast("string"), F.lit("::"), F.col("turn").cast("string"), F.lit("] so [ Citation: other-"), "role", F.lit("::"), F.col("conv_id").cast("string"), F.lit(" ] and [​x::1]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.citations(t)).alias("pos", "cited")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN rtrim(text[:100]) || '…' ELSE text END AS excerpt, text[:200] AS preview FROM documents")
def t12_excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"), T.preview(F.col("text")).alias("preview"))


@query("SELECT item_id, 'naive::' || sha256(text)[:10] AS trace_id, sha256(concat_ws(chr(31), 'offline', 'm', text, '{}')) AS key FROM benchmark")
def t13_trace_ids(spark, sf_dir):
    lit = F.lit
    return table(spark, sf_dir, "benchmark").select("item_id", T.trace_id(lit("naive"), F.col("text")).alias("trace_id"), T.cache_key(lit("offline"), lit("m"), F.col("text"), lit("{}")).alias("key"))


@query("""
SELECT conv_id, turn, regexp_matches(q, '"[^"]+"') OR regexp_matches(q, '--\\w+') OR regexp_matches(q, '\\b[A-Z]{2,}\\b') AS exact
FROM (SELECT conv_id, turn, role || CASE turn % 4 WHEN 0 THEN ' "as is"' WHEN 1 THEN ' --top' WHEN 2 THEN ' use RRF now' ELSE ' plain' END AS q FROM conversations)
""")
def f5_exact_tokens(spark, sf_dir):
    m = F.col("turn") % 4
    q = F.concat("role", F.when(m == 0, ' "as is"').when(m == 1, " --top").when(m == 2, " use RRF now").otherwise(" plain"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.has_exact_token(q).alias("exact"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) NOT BETWEEN 250 AND 700")
def f9_word_band(spark, sf_dir):
    low, high = config.WORD_BAND
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("words")).where(~F.col("words").between(low, high))


# --- sparse index -----------------------------------------------------------------------------------

_BM25 = f"""
WITH tok AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, len({_TOKENS}) AS dl FROM documents),
st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
av AS (SELECT avg(raw) AS avg_idf, 0.25::DOUBLE * avg(raw) AS eps FROM raw),
idf AS (SELECT term, df, raw, CASE WHEN raw < 0 THEN eps ELSE raw END AS idf FROM raw, av)
"""
_SCORED = """,
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM q) GROUP BY ALL),
hit AS (
  SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL
),
scored AS (SELECT q.query_id, dl.doc_id, coalesce(hit.score, 0) AS score FROM q CROSS JOIN dl LEFT JOIN hit ON hit.query_id = q.query_id AND hit.doc_id = dl.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
"""
_ONE = f", q AS (SELECT CAST(1 AS BIGINT) AS query_id, '{ASKED}' AS text)"
_ALL = ", q AS (SELECT item_id AS query_id, text FROM benchmark)"
_RANKED = "SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= "


@query(f"SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL")
def a1_term_postings(spark, sf_dir):
    return sparse.postings(_docs(spark, sf_dir))


@query(_BM25 + "SELECT term, CAST(df AS BIGINT) AS df FROM raw")
def k1_document_frequency(spark, sf_dir):
    return sparse.document_frequencies(sparse.postings(_docs(spark, sf_dir)))


@query(_BM25 + "SELECT CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl, round(avg_idf, 9) AS avg_idf, round(eps, 9) AS eps FROM st, av")
def a2_corpus_stats(spark, sf_dir):
    return sparse.build(_docs(spark, sf_dir)).corpus.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 9).alias("avg_idf"), F.round("eps", 9).alias("eps"))


@query(f"""
WITH n AS (SELECT count(*) AS n FROM documents),
d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TOKENS})) AS term FROM documents) GROUP BY term),
r AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM d, n)
SELECT term, CAST(df AS BIGINT) AS df, round(CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM r) ELSE raw END, 9) AS idf FROM r
""")
def a3_idf_table(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    table, _ = sparse.idf_table(cut(sparse.text_frequencies(docs)), docs.agg(F.count("*").alias("n")))
    return table.select("term", "df", F.round("idf", 9).alias("idf"))


@query(_BM25 + _ONE + _SCORED + _RANKED + "50")
def r2_bm25_topk(spark, sf_dir):
    return sparse.search_texts(_docs(spark, sf_dir), _asked(spark), 50).select("query_id", "doc_id", "score", "rank")


@query(_BM25 + _ALL + _SCORED + _RANKED + "5")
def l2_bm25_batch(spark, sf_dir):
    return sparse.search_texts(_docs(spark, sf_dir), _questions(spark, sf_dir), 5).select("query_id", "doc_id", "score", "rank")


@query(_BM25 + _ONE + _SCORED + _RANKED + "50")
def r2_block_max(spark, sf_dir):
    """The literal query through the stored index."""
    return blockmax.search(blockmax.build(_docs(spark, sf_dir)), _asked(spark), 50).select("query_id", "doc_id", "score", "rank")


@query(_BM25 + _ALL + _SCORED + _RANKED + "5")
def l2_block_max_batch(spark, sf_dir):
    return blockmax.search(blockmax.build(_docs(spark, sf_dir)), _questions(spark, sf_dir), 5).select("query_id", "doc_id", "score", "rank")


@query(_BM25 + "SELECT term, CAST(df AS BIGINT) AS postings, round(peak, 9) AS peak FROM (SELECT term, count(*) AS df, max(tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS peak FROM tf JOIN dl USING (doc_id), st GROUP BY term)")
def k1_block_peaks(spark, sf_dir):
    """Of each word the postings that its blocks hold, and the highest score among their peaks."""
    blocks = blockmax.build(_docs(spark, sf_dir)).blocks
    return blocks.groupBy("term").agg(F.sum(F.size("posts")).alias("postings"), F.round(F.max("peak"), 9).alias("peak"))


# --- dense retrieval --------------------------------------------------------------------------------

_DOT = "round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query(f"SELECT v.vec_id AS id, {_DOT} AS score, CAST(row_number() OVER (ORDER BY {_DOT} DESC, v.vec_id) AS INTEGER) AS rank FROM embeddings v, (SELECT list_transform(range(64), lambda i: CASE WHEN i % 3 = 0 THEN 1.0 ELSE -0.5 END) AS embedding) q QUALIFY rank <= 20")
def l1_dense_topk(spark, sf_dir):
    return dense.top_k(_vectors(spark, sf_dir), [1.0 if i % 3 == 0 else -0.5 for i in range(DIMS)], 20)


@query(f"SELECT q.vec_id AS query_id, v.vec_id AS id, {_DOT} AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, v.vec_id) AS INTEGER) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5")
def j2_dense_batch(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return dense.search(v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), 5)


@query(f"SELECT v.label, v.vec_id AS id, {_DOT} AS score, CAST(row_number() OVER (PARTITION BY v.label ORDER BY {_DOT} DESC, v.vec_id) AS INTEGER) AS rank FROM embeddings v, embeddings q WHERE q.vec_id = 0 QUALIFY rank <= 3")
def w5_dense_topk_per_label(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    one = v.where("id = 0").select(F.col("embedding").alias("q")).limit(1)
    scored = v.crossJoin(F.broadcast(one)).select("label", "id", F.round(dense.dot(F.col("q"), F.col("embedding")), 6).alias("score"))  # one row
    return ranking.first_n(scored, ["label"], 3, F.desc("score"), F.col("id"))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def x1_vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(dense.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"))


# --- fusion, rerank, grades -------------------------------------------------------------------------

_OVERLAP = f"len(list_intersect({_SET.format('q.text')}, {_SET.format('d.text')})) / nullif(len({_SET.format('q.text')}), 0)"
_LISTS = f"""
, lex AS (
  SELECT q.query_id, d.doc_id, row_number() OVER (PARTITION BY q.query_id ORDER BY round(coalesce({_OVERLAP}, 0), 9) DESC, d.doc_id) AS rank FROM q, documents d QUALIFY rank <= 20
), lists AS (SELECT query_id, 0 AS list_no, doc_id, rank FROM ranked WHERE rank <= 20 UNION ALL SELECT query_id, 1, doc_id, rank FROM lex),
fused AS (
  SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(list_no * 1000000 + rank) AS seen FROM lists GROUP BY ALL
), pool AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, doc_id) AS rank FROM fused QUALIFY rank <= 20)
"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25's list and the lexical overlap's, for the literal query."""
    docs, q = _docs(spark, sf_dir), _asked(spark)
    first = sparse.search_texts(docs, q, 20).select("query_id", F.lit(0).alias("list_no"), F.col("doc_id").alias("id"), "rank")
    over = docs.crossJoin(F.broadcast(q.withColumnRenamed("text", "q"))).select("query_id", F.col("doc_id").alias("id"), F.round(F.coalesce(grading.lexical_overlap(F.col("q"), F.col("text")), F.lit(0.0)), 9).alias("o"))  # one query
    second = ranking.first_n(over, ["query_id"], 20, F.desc("o"), F.col("id")).select("query_id", F.lit(1).alias("list_no"), "id", "rank")
    return first.unionByName(second)


@query(_BM25 + _ONE + _SCORED + _LISTS + "SELECT query_id, doc_id AS id, score, CAST(rank AS INTEGER) AS rank FROM pool")
def a5_rrf_fusion(spark, sf_dir):
    return ranking.fuse(_lists(spark, sf_dir))


@query(_BM25 + _ONE + _SCORED + _LISTS + f", re AS (SELECT p.query_id, p.doc_id, p.rank AS old_rank, round(coalesce({_OVERLAP}, 0), 9) AS rerank_score FROM pool p JOIN q USING (query_id) JOIN documents d ON d.doc_id = p.doc_id) SELECT query_id, doc_id AS id, rerank_score, CAST(old_rank AS INTEGER) AS old_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old_rank) AS INTEGER) AS rank FROM re QUALIFY rank <= 5")
def l5_hybrid_rerank(spark, sf_dir):
    fused = ranking.fuse(_lists(spark, sf_dir))
    rows = fused.join(_docs(spark, sf_dir).withColumnRenamed("doc_id", "id").withColumnRenamed("text", "passage"), "id").join(_asked(spark), "query_id")
    return ranking.rerank(rows.withColumn("rerank_score", models.LexicalReranker().score(F.col("text"), F.col("passage"))))


_GRADED = _BM25 + _ALL + _SCORED + f""", g AS (
  SELECT r.query_id, r.doc_id AS id, CASE WHEN coalesce({_OVERLAP}, 0) >= 0.3 THEN 'correct' WHEN coalesce({_OVERLAP}, 0) > 0 THEN 'ambiguous' ELSE 'incorrect' END AS verdict
  FROM ranked r JOIN q USING (query_id) JOIN documents d USING (doc_id) WHERE r.rank <= 20
)
"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical verdict on each document that BM25 ranks among the first 20 for a benchmark item."""
    docs, q = _docs(spark, sf_dir), _questions(spark, sf_dir)
    found = sparse.search_texts(docs, q, 20).select("query_id", "doc_id")
    rows = found.join(docs, "doc_id").join(q.withColumnRenamed("text", "q"), "query_id")
    return rows.select("query_id", F.col("doc_id").alias("id"), grading.lexical_verdict(grading.lexical_overlap(F.col("q"), F.col("text"))).alias("verdict"))


@query(_GRADED + "SELECT * FROM g")
def p9_lexical_grades(spark, sf_dir):
    return _graded(spark, sf_dir)


@query(_GRADED + "SELECT query_id, id, verdict FROM (SELECT *, sum(CASE WHEN verdict <> 'incorrect' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS kept FROM g) WHERE verdict <> 'incorrect' OR kept = 0")
def f3_grade_filter(spark, sf_dir):
    return grading.survivors(_graded(spark, sf_dir), ["query_id"])


@query(_GRADED + "SELECT query_id, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'ambiguous') AS ambiguous, count(*) FILTER (verdict = 'incorrect') AS incorrect, count(*) FILTER (verdict = 'incorrect') <= count(*) FILTER (verdict = 'correct') AS stop FROM g GROUP BY query_id")
def a10_grade_decision(spark, sf_dir):
    return grading.decision(_graded(spark, sf_dir), ["query_id"])


@query("""
WITH j AS (SELECT conv_id, turn // 2 AS id, turn AS pos, CASE turn % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' ELSE 'maybe' END AS verdict, role AS reason FROM conversations),
l AS (SELECT conv_id, id, arg_max(verdict, pos) AS verdict, arg_max(reason, pos) AS reason FROM j GROUP BY ALL),
r AS (SELECT DISTINCT conv_id, turn AS id FROM conversations)
SELECT r.conv_id, r.id, CASE WHEN l.verdict IN ('correct', 'ambiguous', 'incorrect') THEN l.verdict ELSE 'ambiguous' END AS verdict, coalesce(l.reason, '') AS reason FROM r LEFT JOIN l USING (conv_id, id)
""")
def f7_judgement_repair(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    m = F.col("turn") % 3
    j = conv.select("conv_id", F.expr("turn div 2").alias("id"), F.col("turn").alias("pos"), F.when(m == 0, "correct").when(m == 1, "incorrect").otherwise("maybe").alias("verdict"), F.col("role").alias("reason"))
    return grading.repaired(conv.select("conv_id", F.col("turn").alias("id")).distinct(), j, ["conv_id"]).select("conv_id", "id", "verdict", "reason")


# --- the entity graph -------------------------------------------------------------------------------

_EDGES = "WITH e AS (SELECT 's' || l_suppkey AS src, 'ships' AS rel, 'p' || l_partkey AS dst, 'o' || l_orderkey AS chunk_id FROM lineitem), adj AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
_HOPS = _EDGES + """,
q AS (SELECT 1 AS query_id, 's1' AS id UNION ALL SELECT 2, 'p7' UNION ALL SELECT 2, 'p8' UNION ALL SELECT 3, 'nowhere'),
h0 AS (SELECT DISTINCT query_id, id FROM q WHERE id IN (SELECT src FROM adj)),
h1 AS (SELECT DISTINCT query_id, dst AS id FROM h0 JOIN adj ON src = id),
h2 AS (SELECT DISTINCT query_id, dst AS id FROM h1 JOIN adj ON src = id),
v AS (SELECT query_id, id, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL)
"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order joins its supplier and its part, in the order's chunk."""
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return table(spark, sf_dir, "lineitem").select(name("s", "l_suppkey").alias("src"), F.lit("ships").alias("rel"), name("p", "l_partkey").alias("dst"), name("o", "l_orderkey").alias("chunk_id"))


def _starts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "s1"), (2, "p7"), (2, "p8"), (3, "nowhere")], "query_id int, id string")


@query(_EDGES + "SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(count(*) AS BIGINT) AS weight FROM e WHERE src <> dst GROUP BY ALL")
def a6_pair_weights(spark, sf_dir):
    return graph.pair_weights(_edges(spark, sf_dir))


@query(_EDGES + "SELECT src AS id, CAST(count(*) AS BIGINT) AS degree FROM adj GROUP BY src")
def a18_degrees(spark, sf_dir):
    return graph.degree(graph.adjacency(_edges(spark, sf_dir)))


@query(_EDGES + "SELECT src AS id, chunk_id FROM e UNION SELECT dst, chunk_id FROM e")
def a7_entity_chunks(spark, sf_dir):
    return graph.entity_chunks(_edges(spark, sf_dir))


@query(_HOPS + "SELECT query_id, id, hop FROM v")
def g2_two_hops(spark, sf_dir):
    return graph.expand(_starts(spark), graph.both_ways(_edges(spark, sf_dir)))


@query(_HOPS + "SELECT a.query_id, e.src, e.rel, e.dst, e.chunk_id FROM e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst AND b.query_id = a.query_id")
def j6_induced_edges(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.induced(graph.expand(_starts(spark), graph.both_ways(e)), e)


@query(_HOPS + """, deg AS (SELECT src AS id, count(*) AS degree FROM adj GROUP BY src), ev AS (SELECT src AS id, chunk_id FROM e UNION SELECT dst, chunk_id FROM e),
c AS (SELECT v.query_id, ev.chunk_id, degree, v.id, row_number() OVER (PARTITION BY v.query_id, ev.chunk_id ORDER BY degree DESC, v.id) AS n FROM v JOIN deg USING (id) JOIN ev USING (id))
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY degree DESC, id, chunk_id) AS INTEGER) AS rank FROM c WHERE n = 1 QUALIFY rank <= 40
""")
def w3_hop_chunks(spark, sf_dir):
    e = _edges(spark, sf_dir)
    adj = graph.both_ways(e)
    return graph.hop_chunks(graph.expand(_starts(spark), adj), adj, graph.ends_with_chunks(e))


@query()
def g3_communities(spark, sf_dir):
    """All levels, each until its moves settle."""
    return graph.communities(_edges(spark, sf_dir))


_MEMBERS = _EDGES + ", m AS (SELECT src AS id, CAST(src[2:] AS INTEGER) % 7 AS community FROM adj GROUP BY src)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed partition, for what builds on communities."""
    return graph.adjacency(_edges(spark, sf_dir)).select(F.col("src").alias("id")).distinct().withColumn("community", F.substring("id", 2, 10).cast("int") % 7)


@query(_MEMBERS + "SELECT community AS id, CAST(count(*) AS BIGINT) AS members, sha256(string_agg(id, ',' ORDER BY id)) AS members_sha FROM m GROUP BY community")
def a8_community_members(spark, sf_dir):
    g = graph.community_members(_members(spark, sf_dir))
    return g.select("id", F.size("entity_ids").cast("long").alias("members"), F.sha2(F.array_join("entity_ids", ","), 256).alias("members_sha"))


@query(_MEMBERS + ", w AS (SELECT src AS a, dst AS b, count(*) AS weight FROM e GROUP BY ALL), i AS (SELECT w.weight, x.community AS ca, y.community AS cb FROM w JOIN m x ON x.id = a JOIN m y ON y.id = b), t AS (SELECT sum(weight) AS m, sum(CASE WHEN ca = cb THEN weight ELSE 0 END) AS inside FROM i), d AS (SELECT sum(d * d) AS dd FROM (SELECT CAST(sum(weight) AS DOUBLE) AS d FROM (SELECT ca AS c, weight FROM i UNION ALL SELECT cb, weight FROM i) GROUP BY c)) SELECT round(inside / m - dd / (4.0::DOUBLE * m * m), 9) AS modularity FROM t, d")
def g3_modularity(spark, sf_dir):
    return graph.modularity(_edges(spark, sf_dir), _members(spark, sf_dir)).select(F.round("modularity", 9).alias("modularity"))


@query(_HOPS + ", m AS (SELECT src AS id, CAST(src[2:] AS INTEGER) % 7 AS community FROM adj GROUP BY src), t AS (SELECT query_id, id FROM q UNION SELECT a.query_id, e.src FROM e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst AND b.query_id = a.query_id UNION SELECT a.query_id, e.dst FROM e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst AND b.query_id = a.query_id) SELECT DISTINCT t.query_id, m.community, 'community ' || m.community AS summary FROM t JOIN m USING (id)")
def j7_touched_communities(spark, sf_dir):
    e, members = _edges(spark, sf_dir), _members(spark, sf_dir)
    visited = graph.expand(_starts(spark), graph.both_ways(e))
    told = members.select(F.col("community").alias("id"), F.concat(F.lit("community "), F.col("community").cast("string")).alias("summary")).distinct()
    return graph.touched_communities(_starts(spark), graph.induced(visited, e), members, told)


@query(_MEMBERS + ", o AS (SELECT e.*, x.community, row_number() OVER (PARTITION BY x.community ORDER BY chunk_id, src, dst) AS n FROM e JOIN m x ON x.id = src JOIN m y ON y.id = dst AND y.community = x.community) SELECT community, src, dst, chunk_id, CAST(n AS INTEGER) AS n FROM o WHERE n <= 15")
def w5_community_edges(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumn("ord", F.struct("chunk_id", "src", "dst"))
    return graph.community_edges(e, _members(spark, sf_dir)).select("community", "src", "dst", "chunk_id", "n")


@query("""
WITH v AS (SELECT DISTINCT lower(n_name) AS id FROM nation), t AS (
  SELECT ' ' || upper(n_name) || ' ' AS src, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'near' END AS rel, r_name AS dst, 'c' || n_nationkey AS chunk_id FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT a.n_name, 'near', b.n_name, 'd' || a.n_nationkey FROM nation a JOIN nation b USING (n_regionkey)
)
SELECT trim(lower(src)) AS src, rel, trim(lower(dst)) AS dst, chunk_id FROM t WHERE trim(lower(src)) IN (FROM v) AND trim(lower(dst)) IN (FROM v) AND rel <> ''
""")
def f1_vocabulary_filter(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    a = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit(" "), F.upper("n_name"), F.lit(" ")).alias("src"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise("near").alias("rel"), F.col("r_name").alias("dst"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("chunk_id"))
    m = n.select("n_regionkey", F.col("n_name").alias("dst"))
    b = n.join(m, "n_regionkey").select(F.col("n_name").alias("src"), F.lit("near").alias("rel"), "dst", F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("chunk_id"))
    return graph.accepted(a.unionByName(b), n.select(F.lower("n_name").alias("id")))


@query("""
WITH v AS (SELECT DISTINCT lower(n_name) AS id FROM nation),
q AS (SELECT c_custkey AS query_id, 'Ships from ' || n_name || '-bound ports, x' || n_name || ' to ' || c_mktsegment || '.' AS text FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT query_id, id FROM q, v WHERE regexp_matches(lower(text), '\\b' || replace(id, ' ', '[ -]+') || '\\b')
""")
def j4_entity_mentions(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    q = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("Ships from "), "n_name", F.lit("-bound ports, x"), "n_name", F.lit(" to "), "c_mktsegment", F.lit(".")).alias("text"))
    return graph.seeds(q, n.select(F.lower("n_name").alias("id")).distinct())


# --- ranked rows and keys ---------------------------------------------------------------------------


@query("SELECT role, text, conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) = 1")
def w2_first_wins(spark, sf_dir):
    return ranking.first_wins(table(spark, sf_dir, "conversations"), ["role"], "text", F.col("conv_id"), F.col("turn")).select("role", "text", "conv_id", "turn")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)")
def w4_last_attempt(spark, sf_dir):
    return ranking.last_attempt(table(spark, sf_dir, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role")


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events QUALIFY rank <= 3")
def w1_ranked_events(spark, sf_dir):
    return ranking.first_n(table(spark, sf_dir, "events"), ["user_id"], 3, F.desc("value"), F.col("event_id")).select("user_id", "event_id", "rank")


@query("SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT conv_id, 'stale' FROM (SELECT DISTINCT conv_id FROM conversations) WHERE false")
def u5_missing_and_stale(spark, sf_dir):
    return ranking.missing_and_stale(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr') UNION ALL SELECT doc_id, CAST(7 AS INTEGER), CAST(-1 AS INTEGER) FROM documents WHERE lang = 'fr'")
def j14_upsert(spark, sf_dir):
    new = table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id", F.lit(7).alias("quality"), F.lit(-1).alias("toxic"))
    return ranking.upsert(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), new, ["doc_id"])


@query("SELECT NOT EXISTS (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer) AND NOT EXISTS (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation) AS same")
def u7_same_rows(spark, sf_dir):
    return ranking.same_rows(table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "customer").select("c_nationkey"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CAST(row_number() OVER (PARTITION BY d.source ORDER BY l.quality DESC NULLS LAST, d.doc_id) AS INTEGER) AS place FROM documents d LEFT JOIN labels l USING (doc_id)")
def l8_nulls_last(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return ranking.ranked(j, ["source"], ranking.nulls_last("quality", False), F.col("doc_id"), name="place").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), "place")


@query("SELECT p_type AS name, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, p_type) AS INTEGER) AS place FROM part GROUP BY p_type")
def l9_frequency_table(spark, sf_dir):
    n = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    return ranking.ranked(n, ["one"], F.desc("n"), F.col("name"), name="place").drop("one")


# --- evaluation -------------------------------------------------------------------------------------

_ARCH = "['naive', 'hybrid', 'hyde', 'corrective', 'graph', 'agentic', 'adaptive']"
_TYPES = ("factual", "multi_hop", "keyword", "unanswerable")
_ROWS = f"""
WITH rows AS (
  SELECT {_ARCH}[doc_id % 7 + 1] AS architecture, doc_id // 7 AS question_id, ['factual', 'multi_hop', 'keyword', 'unanswerable'][(doc_id // 7) % 4 + 1] AS question_type,
    CASE WHEN (doc_id // 7) % 4 < 3 THEN (n_chars % 101) / 100 END AS recall_at_5, CASE WHEN (doc_id // 7) % 4 < 3 THEN 1 / (1 + n_chars % 5) END AS mrr_at_10,
    CASE WHEN (doc_id // 7) % 4 < 3 THEN (n_chars % 11) / 10 END AS ndcg_at_10, CASE WHEN (doc_id // 7) % 4 < 3 THEN (n_chars % 3) / 2 END AS recall_full,
    CASE WHEN doc_id % 11 > 0 THEN (doc_id * 37 % 101) / 100 END AS faithfulness, CAST(n_chars AS DOUBLE) AS latency_ms, doc_id % 7 + 1 AS llm_calls, n_chars AS prompt_tokens, n_chars % 300 AS completion_tokens,
    doc_id % 7 = 4 OR (doc_id % 7 > 4 AND doc_id % 3 = 0) AS involved, CASE WHEN (doc_id // 7) % 4 = 3 THEN toxic = 0 END AS refusal_correctness,
    CASE WHEN doc_id % 7 = 6 THEN {_ARCH}[n_chars % 6 + 1] END AS routed, lang AS backend, source AS chunk
  FROM documents LEFT JOIN labels USING (doc_id)
)
"""


def _eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows made from documents and labels by fixed arithmetic."""
    d, c = F.col("doc_id"), F.col("n_chars")
    q = F.expr("doc_id div 7")
    arch = F.array(*(F.lit(a) for a in config.ARCHITECTURES))
    scored = lambda x: F.when(q % 4 < 3, x)
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.get(arch, (d % 7).cast("int")).alias("architecture"), q.alias("question_id"), F.get(F.array(*(F.lit(t) for t in _TYPES)), (q % 4).cast("int")).alias("question_type"),
        scored(c % 101 / 100).alias("recall_at_5"), scored(1 / (1 + c % 5)).alias("mrr_at_10"), scored(c % 11 / 10).alias("ndcg_at_10"), scored(c % 3 / 2).alias("recall_full"),
        F.when(d % 11 > 0, d * 37 % 101 / 100).alias("faithfulness"), c.cast("double").alias("latency_ms"), (d % 7 + 1).alias("llm_calls"), c.alias("prompt_tokens"), (c % 300).alias("completion_tokens"),
        ((d % 7 == 4) | ((d % 7 > 4) & (d % 3 == 0))).alias("graph_tool_involved"), F.when(q % 4 == 3, F.col("toxic") == 0).alias("refusal_correctness"), F.when(d % 7 == 6, F.get(arch, (c % 6).cast("int"))).alias("adaptive_routed_to"),
        F.array(F.col("lang"), F.lit("cache")).alias("backend_calls"), F.lit("judge").alias("judge_backend"), F.array("source").alias("retrieved_chunk_ids"),
    )


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


_MEANS = ", ".join(f"round(avg({m}) + 1e-9, 4) AS {m}" for m in evaluation.MEASURES)
_NOTE = "CASE WHEN architecture = 'graph' THEN 'NOT meaningful: graph expansion returns an unranked set' WHEN count(*) FILTER (involved) = 0 THEN 'reliable: no row used the graph' ELSE 'reduced meaning: the graph was involved in ' || count(*) FILTER (involved) || '/' || count(*) || ' rows' END"


@query(_ROWS + f"SELECT architecture, question_type, count(*) AS n_questions, {_MEANS}, round(avg(CASE WHEN question_type = 'unanswerable' OR question_type IS NULL THEN CAST(refusal_correctness AS INTEGER) END) + 1e-9, 4) AS refusal_rate, {_NOTE} AS rank_note FROM rows GROUP BY GROUPING SETS ((architecture), (architecture, question_type))")
def a14_report(spark, sf_dir):
    r = evaluation.report(_eval_rows(spark, sf_dir))
    return _rounded(r.select(*((F.col(n) + 1e-9).alias(n) if t == "double" else F.col(n) for n, t in r.dtypes)), 4)  # off the ties of rounding


@query(_ROWS + "SELECT architecture, backend, count(*) AS calls FROM (SELECT architecture, unnest([backend, 'cache', 'judge']) AS backend FROM rows) GROUP BY ALL")
def a12_backend_mix(spark, sf_dir):
    return evaluation.backend_mix(_eval_rows(spark, sf_dir))


_OK = "list_contains(CASE question_type WHEN 'factual' THEN ['naive', 'hybrid'] WHEN 'multi_hop' THEN ['graph', 'agentic'] WHEN 'keyword' THEN ['hybrid'] END, routed)"


@query(_ROWS + f"SELECT count({_OK}) AS total, count(*) FILTER ({_OK}) AS correct, round(avg(CAST({_OK} AS INTEGER)), 6) AS accuracy FROM rows WHERE architecture = 'adaptive' AND routed IS NOT NULL")
def a15_routing_accuracy(spark, sf_dir):
    rubric = spark.createDataFrame([("factual", ["naive", "hybrid"]), ("multi_hop", ["graph", "agentic"]), ("keyword", ["hybrid"])], "question_type string, acceptable array<string>")
    return _rounded(evaluation.routing_accuracy(_eval_rows(spark, sf_dir), rubric))


@query(_ROWS + ", n AS (SELECT question_id, count(DISTINCT architecture) AS k FROM rows GROUP BY 1) SELECT question_id, chunk AS chunk_id, count(DISTINCT architecture) AS architectures, 2 * count(DISTINCT architecture) < any_value(k) AS rare FROM rows JOIN n USING (question_id) GROUP BY 1, 2")
def a20_divergence(spark, sf_dir):
    return evaluation.divergence(_eval_rows(spark, sf_dir))


@query(_ROWS + f", f AS (SELECT *, list_position({_ARCH}, architecture) AS o FROM rows WHERE faithfulness IS NOT NULL) SELECT question_id, first(architecture ORDER BY faithfulness DESC, o) AS best, first(architecture ORDER BY faithfulness, o) AS worst, round(max(faithfulness) - min(faithfulness), 6) AS spread FROM f GROUP BY 1 HAVING count(*) >= 2 AND round(max(faithfulness) - min(faithfulness), 9) >= 0.2")
def a21_faithfulness_spread(spark, sf_dir):
    return _rounded(evaluation.faithfulness_spread(_eval_rows(spark, sf_dir)))


@query(_ROWS + "SELECT count(*) AS n_rows, count(DISTINCT architecture) AS n_architectures, count(*) // count(DISTINCT architecture) AS n_questions FROM rows")
def a24_headline(spark, sf_dir):
    return evaluation.headline(_eval_rows(spark, sf_dir))


_RANKS = """
WITH t AS (SELECT conv_id, list(CAST(turn AS VARCHAR) ORDER BY text, turn) AS r, list_filter(list_distinct(list(CAST(turn AS VARCHAR) ORDER BY turn)), lambda x: CAST(x AS BIGINT) % 3 = conv_id % 3) AS g FROM conversations GROUP BY conv_id),
h AS (SELECT conv_id, r, g, list_filter(range(1, len(r) + 1), lambda i: list_contains(g, r[i])) AS hits FROM t)
"""


@query(_RANKS + """
SELECT conv_id, CASE WHEN len(g) > 0 THEN round(len(list_filter(hits, lambda i: i <= 5)) / len(g), 6) END AS recall_at_5, CASE WHEN len(g) > 0 THEN round(len(hits) / len(g), 6) END AS recall_full,
  CASE WHEN len(g) > 0 THEN round(CASE WHEN list_min(hits) <= 10 THEN 1 / list_min(hits) ELSE 0 END, 6) END AS mrr_at_10,
  CASE WHEN len(g) > 0 THEN round(coalesce(list_sum(list_transform(list_filter(hits, lambda i: i <= 10), lambda i: 1 / log2(i + 1))), 0) / list_sum(list_transform(range(1, least(len(g), 10) + 1), lambda i: 1 / log2(i + 1))), 6) END AS ndcg_at_10
FROM h
""")
def m1_rank_metrics(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("text", "turn"))).alias("t"))
    rows = turns.select("conv_id", F.transform("t", lambda x: x["turn"].cast("string")).alias("r")).withColumn("g", F.filter(F.array_distinct("r"), lambda x: x.cast("long") % 3 == F.col("conv_id") % 3))
    r, g = F.col("r"), F.col("g")
    return _rounded(rows.select("conv_id", evaluation.recall_at(r, g).alias("recall_at_5"), evaluation.recall_full(r, g).alias("recall_full"), evaluation.mrr_at(r, g).alias("mrr_at_10"), evaluation.ndcg_at(r, g).alias("ndcg_at_10")))


@query("SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN round(len(list_filter([true, n_chars % 2 = 0, NULL, n_chars % 3 = 0][:greatest(doc_id % 5, 1)], lambda x: coalesce(x, false))) / (doc_id % 5), 6) END AS faithfulness, CASE WHEN doc_id % 4 = 3 THEN CAST(n_chars % 2 = 0 AS VARCHAR) END AS refusal FROM documents")
def m5_judged(spark, sf_dir):
    c, n = F.col("n_chars"), (F.col("doc_id") % 5).cast("int")
    kind = F.when(F.col("doc_id") % 4 == 3, "unanswerable").otherwise("factual")
    f = evaluation.faithfulness(F.array(F.lit(True), c % 2 == 0, F.lit(None).cast("boolean"), c % 3 == 0), n)
    return _rounded(table(spark, sf_dir, "documents").select("doc_id", f.alias("faithfulness"), evaluation.refusal(kind, c % 2 == 0).cast("string").alias("refusal")))


@query("""
WITH e AS (SELECT doc_id AS question_id FROM documents), r AS (SELECT doc_id AS question_id, 't' || doc_id AS trace_id, 'a' || quality AS answer FROM labels), t AS (SELECT doc_id AS question_id, CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE 't' || doc_id END AS trace_id, 'a' || toxic AS answer FROM labels WHERE doc_id % 7 > 0)
SELECT 'naive' AS architecture, question_id, 'missing' AS problem FROM e WHERE question_id NOT IN (SELECT question_id FROM r)
UNION ALL SELECT 'naive', r.question_id, CASE WHEN t.trace_id IS NULL THEN 'missing trace' WHEN t.trace_id <> r.trace_id THEN 'trace id differs' WHEN t.answer <> r.answer THEN 'answer differs' END FROM r LEFT JOIN t USING (question_id) WHERE t.trace_id IS NULL OR t.trace_id <> r.trace_id OR t.answer <> r.answer
""")
def j9_consistency(spark, sf_dir):
    lab, a, i = table(spark, sf_dir, "labels"), F.lit("naive").alias("architecture"), F.col("doc_id").alias("question_id")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    rows = lab.select(a, i, name("t", "doc_id").alias("trace_id"), name("a", "quality").alias("answer"))
    traces = lab.where("doc_id % 7 > 0").select(a, i, F.when(F.col("doc_id") % 5 == 0, "other").otherwise(name("t", "doc_id")).alias("trace_id"), name("a", "toxic").alias("answer"))
    return evaluation.consistency(rows, traces, table(spark, sf_dir, "documents").select(a, i))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type AS architecture, count(*) AS runs, round(avg(value), 6) AS mean_ms, round(max(value), 6) AS max_ms FROM events GROUP BY 1, 2")
def stream_latency_windows(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("architecture"), F.col("value").alias("latency_ms"))
    return _rounded(ingest.latency_windows(runs).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")))


# --- pipelines --------------------------------------------------------------------------------------


def _corpus(spark: SparkSession, sf_dir: str) -> pipelines.Corpus:
    """Documents as chunks; nations, regions and what customers of each buy as the entity graph."""
    docs = _docs(spark, sf_dir)
    chunks = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("d::"), F.col("doc_id").cast("string")).alias("chunk_id"), "text")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edges = n.join(r, n.n_regionkey == r.r_regionkey).select(F.lower("n_name").alias("src"), F.lit("lies in").alias("rel"), F.lower("r_name").alias("dst"), F.concat(F.lit("d::"), F.col("n_nationkey").cast("string")).alias("chunk_id"))
    return pipelines.Corpus.of(chunks, edges)


def _posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages, with a nation's name, an acronym, a second part, a question word or a negation added to some."""
    m = F.col("query_id") % 6
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 6 + 1).cast("long").alias("query_id"), "n_name")
    extra = F.when(m == 1, F.concat(F.lit(" in "), F.coalesce("n_name", F.lit("France")))).when(m == 2, " via RRF").when(m == 3, " and the rest of it").when(m == 5, " without it").otherwise("")
    return _questions(spark, sf_dir).join(n, "query_id", "left").select("query_id", F.concat(F.when(m == 4, "why ").otherwise(""), "text", extra).alias("text"))


def _flat(runs: DataFrame) -> DataFrame:
    return runs.select("query_id", "architecture", "trace_id", F.array_join("chunk_ids", " ").alias("chunk_ids"), F.sha2("answer", 256).alias("answer_sha"), "llm_calls", "prompt_tokens", "completion_tokens", F.size("nodes").alias("n_nodes"))


def _pipeline(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(pipelines.PIPELINES[name](_posed(spark, sf_dir), _corpus(spark, sf_dir)))

    return run


for _i, _a in enumerate(config.ARCHITECTURES, 1):
    QUERIES[f"p{_i}_{_a}"] = _pipeline(_a)

_POSED = """q AS (SELECT item_id AS query_id, CASE item_id % 6 WHEN 4 THEN 'why ' ELSE '' END || text || CASE item_id % 6 WHEN 1 THEN ' in ' || coalesce(n_name, 'France') WHEN 2 THEN ' via RRF' WHEN 3 THEN ' and the rest of it' WHEN 5 THEN ' without it' ELSE '' END AS text
  FROM benchmark LEFT JOIN nation ON n_nationkey * 6 + 1 = item_id)"""
ORACLE |= {f"p{i}_{a}": SQL.adaptive(_POSED) if a == "adaptive" else SQL.plan(_POSED, a) for i, a in enumerate(config.ARCHITECTURES, 1)}


@query(SQL.spec_hybrid(_POSED))
def p9_spec_hybrid(spark, sf_dir):
    out = spec.compile_spec(spec.PRESETS["hybrid"], _corpus(spark, sf_dir))(_posed(spark, sf_dir))
    return out.select("query_id", "node", F.array_join("chunk_ids", " ").alias("chunk_ids"), F.sha2("answer", 256).alias("answer_sha"))


@query(SQL.evidence(_POSED))
def g8_evidence(spark, sf_dir):
    runs = pipelines.corrective(_posed(spark, sf_dir), _corpus(spark, sf_dir))
    return trace.evidence(trace.exploded(runs)).select("trace_id", F.array_join("chunk_ids", " ").alias("chunk_ids"))


_BROKEN = """
WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations),
n AS (
  SELECT CAST(conv_id AS VARCHAR) AS trace_id, CASE WHEN conv_id % 6 = 4 AND t = k - 1 THEN 'n0' ELSE 'n' || t END AS id, CASE WHEN conv_id % 6 = 1 AND t = 0 THEN 'strange' ELSE 'grade' END AS kind,
    CASE WHEN conv_id % 6 = 2 AND t = 1 THEN 'gone' WHEN conv_id % 6 = 3 AND t = 0 THEN 'n' || (k - 1) WHEN t > 0 THEN 'n' || (t - 1) END AS parent
  FROM c WHERE conv_id % 6 < 5
),
r AS (SELECT a.trace_id, a.id, a.parent FROM n a WHERE a.parent IS NOT NULL UNION SELECT r.trace_id, r.id, n.parent FROM r JOIN n ON n.trace_id = r.trace_id AND n.id = r.parent WHERE n.parent IS NOT NULL)
SELECT DISTINCT trace_id, 'unknown kind' AS problem FROM n WHERE kind <> 'grade'
UNION SELECT trace_id, 'duplicate id' FROM n GROUP BY trace_id, id HAVING count(*) > 1
UNION SELECT trace_id, 'dangling parent' FROM n a WHERE parent IS NOT NULL AND NOT EXISTS (FROM n b WHERE b.trace_id = a.trace_id AND b.id = a.parent)
UNION SELECT trace_id, 'cycle' FROM r WHERE id = parent
UNION SELECT DISTINCT CAST(conv_id AS VARCHAR), 'empty' FROM conversations WHERE conv_id % 6 = 5
"""


@query(_BROKEN)
def f13_trace_problems(spark, sf_dir):
    """Traces made from conversations, five of six kinds broken by rule: unknown kind, lost parent, cycle, id twice, no nodes."""
    every = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    rule, k = F.col("conv_id") % 6, F.size("turns")
    name = lambda i: F.concat(F.lit("n"), i.cast("string"))

    def made(_, t: Column) -> Column:
        own = F.when((rule == 4) & (t == k - 1), F.lit("n0")).otherwise(name(t))
        kind = F.when((rule == 1) & (t == 0), F.lit("strange")).otherwise(F.lit("grade"))
        parent = F.when((rule == 2) & (t == 1), F.lit("gone")).when((rule == 3) & (t == 0), name(k - 1)).when(t > 0, name(t - 1))
        return F.struct(own.alias("id"), kind.alias("kind"), kind.alias("label"), F.filter(F.array(parent), lambda x: x.isNotNull()).alias("parent_ids"), F.lit(0.0).alias("duration_ms"), F.lit("").alias("explain"), F.lit("{}").alias("payload"))

    nodes = F.when(rule < 5, F.transform("turns", lambda x, i: made(x, i)))
    traces = every.select(F.col("conv_id").cast("string").alias("trace_id"), nodes.alias("nodes"))
    return trace.problems(trace.exploded(traces.where("nodes IS NOT NULL")), traces)


_Q = "'Answer from the context alone and cite the ids of the chunks that you use.' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg('[c::' || turn || '] (' || role || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Question: what was said in ' || conv_id"


@query(f"SELECT conv_id, sha256({_Q}) AS prompt_sha FROM conversations GROUP BY conv_id")
def q2_answer_prompts(spark, sf_dir):
    hit = F.struct(F.col("turn").cast("int").alias("rank"), F.concat(F.lit("c::"), F.col("turn").cast("string")).alias("chunk_id"), F.lit(0.0).alias("score"), "text", F.col("role").alias("heading"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    prompt: Column = pipelines.answer_prompt(F.concat(F.lit("what was said in "), F.col("conv_id").cast("string")), F.col("hits"))
    return rows.select("conv_id", F.sha2(prompt, 256).alias("prompt_sha"))


@query("SELECT prompt, CASE WHEN prompt LIKE 'src1%' THEN 'known ' || prompt ELSE 'made ' || prompt END AS text, CASE WHEN prompt LIKE 'src1%' THEN 'b' ELSE 'offline' END AS backend FROM (SELECT DISTINCT source AS prompt FROM documents)")
def x4_completion_cache(spark, sf_dir):
    prompts = table(spark, sf_dir, "documents").select(F.col("source").alias("prompt"))
    cache = prompts.distinct().where("prompt LIKE 'src1%'").select(T.cache_key(F.lit("b"), F.lit("m2"), F.col("prompt"), F.lit("{}")).alias("key"), F.concat(F.lit("known "), "prompt").alias("text"))
    return models.completed(prompts, cache, [("a", "m1"), ("b", "m2")], lambda p: p.select("prompt", F.concat(F.lit("made "), "prompt").alias("text"), F.lit("offline").alias("backend")))

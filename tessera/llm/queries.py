"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common as c

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.adaptive_scan import nearest

    return nearest(c.table(spark, sf_dir, "embeddings"), query_rule="vec_id % 100 = 0", k=10)


@query
def op2_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.matroska import media_features

    return media_features(c.table(spark, sf_dir, "documents"))


@query
def op3_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import entropy_mix

    return entropy_mix(c.table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.packing import pack_documents

    return pack_documents(c.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


@query
def op9_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.run_index import remove_repeats

    return remove_repeats(c.table(spark, sf_dir, "documents"), length=400, keep_bytes=False, words=51).drop("kept")


@query
def op5_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the pages' WARC files in which a known rule has damaged, lost and added records, each at the original's offsets."""
    from tessera.llm.merkle import audit, page_records, placed

    rotten = F.concat(F.substring("content", 1, 40), F.lit(b"~"), F.expr("substring(content, 42)"))
    rows = page_records(c.table(spark, sf_dir, "pages")).select("record", "file", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("digest"), F.sha2(rotten, 256).alias("rotten"))
    records = placed(rows)
    mark = F.pmod(F.col("record"), F.lit(37))
    replica = records.where(mark != 1).withColumn("digest", F.when(mark == 0, F.col("rotten")).otherwise(F.col("digest")))
    extra = records.where(mark == 2).withColumn("record", -1 - F.col("record"))
    return audit(records, replica.unionByName(extra)).drop("file_b", "start_b", "stop_b")


@query
def op6_surrogate_generation(spark: SparkSession, sf_dir: str, key: bytes = b"a key for tests; give your own") -> DataFrame:
    """key: what surrogates depend on; whoever has it can tell which entity became which."""
    from tessera.llm.surrogates import replaced

    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    return replaced(docs, key).select("doc_id", "n_entities", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")


@query
def op7_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import fit, toxicity

    docs = c.table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, c.table(spark, sf_dir, "labels"), train_rows=5000))


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngram_join import jaccard_components

    return jaccard_components(c.table(spark, sf_dir, "documents"), n=4, num=85).select("doc_id", "n_shingles", "component_id")


@query
def op10_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_alignment import line_report

    return line_report(c.table(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.manifest import audited

    return audited(c.table(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.trie import rebuilt_trie

    return rebuilt_trie(c.table(spark, sf_dir, "conversations"))


@query
def op13_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.curve_packing import pack_along_curve

    return pack_along_curve(c.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


_RECORDS = r"""
WITH r AS (
  SELECT page_id AS record, page_id // 256 AS file,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS content
  FROM pages
), o AS (
  SELECT record, file, content, octet_length(encode(content)) AS n, sum(octet_length(encode(content))) OVER (PARTITION BY file ORDER BY record) AS stop
  FROM r
), x AS (SELECT record, file, CAST(stop - n AS BIGINT) AS "start", CAST(stop AS BIGINT) AS "stop", content FROM o)
"""
ORACLE["op5_merkle_fixity"] = _RECORDS + """
SELECT record, file, "start", "stop", sha256(content) AS digest_a, sha256(content[:40] || '~' || content[42:]) AS digest_b FROM x WHERE record % 37 = 0
UNION ALL SELECT record, file, "start", "stop", sha256(content), NULL FROM x WHERE record % 37 = 1
UNION ALL SELECT -1 - record, file, "start", "stop", NULL, sha256(content) FROM x WHERE record % 37 = 2
"""
ORACLE["op8_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS s
  FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS id, doc_id AS reached FROM g
  UNION
  SELECT r.id, p.b FROM r JOIN p ON r.reached = p.a
)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, m.component_id
FROM g JOIN (SELECT id, min(reached) AS component_id FROM r GROUP BY id) m ON m.id = g.doc_id
"""


def _crc32(number: str) -> str:
    """SQL for the unsigned CRC-32 of the decimal digits of an integer, a bit at a time (0xEDB88320 is its reversed polynomial)."""
    byte = f"list_transform(range(1, length({number}::VARCHAR) + 1), lambda i: ord(({number}::VARCHAR)[i])::BIGINT)"
    bits = "list_reduce(list_concat([xor(acc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295]::BIGINT[], {byte}), lambda acc, b: {bits}), 4294967295)"


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """SQL of the nodes (lvl, g, i, n, h) of each group's tree of eights, and of the siblings (g, i, lvl, b, a) of each leaf."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(levels):
        out.append(f"{name}{k + 1} AS (SELECT g, i // 8 AS i, max(n + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE n > 1 GROUP BY g, i // 8)")
    step = "SELECT x.g, x.i, {k} AS lvl, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < x.j), '') AS b, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > x.j), '') AS a FROM (SELECT g, i, i // {d} AS j FROM {t}0) x JOIN {t}{k} s ON s.g = x.g AND s.i // 8 = x.j // 8 AND s.n > 1 GROUP BY x.g, x.i, x.j"
    out.append(f"{name}_steps AS ({' UNION ALL '.join(step.format(k=k, d=8**k, t=name) for k in range(levels))})")
    out.append(f"{name}_top AS ({' UNION ALL '.join(f'SELECT g, h FROM {name}{k} WHERE n = 1' for k in range(levels + 1))})")
    return ",\n".join(out)


#: Levels that the SQL can tell: 8^7 rows of a language.
_LEVELS = 7
ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR] AS head, text,
    {_crc32("doc_id")} % 3 = 0 AS struck
  FROM documents
), f AS (
  SELECT *, array_to_string(list_transform(head, lambda x: coalesce(strlen(x) || ':' || x, '-')), '') AS pre,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM d
), v AS (
  SELECT doc_id, g, sha256(pre || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN struck THEN sha256(pre || coalesce(strlen(low) || ':' || low, '-')) END AS forged
  FROM f
), w AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM v
),
{_tree_sql("t", "SELECT g, i, n, leaf AS h FROM w", _LEVELS)},
{_tree_sql("u", "SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM t_top", _LEVELS)},
s AS (
  SELECT g, i, lvl, b, a FROM t_steps
  UNION ALL SELECT w.g, w.i, {_LEVELS} + u.lvl, u.b, u.a FROM w JOIN (SELECT g, row_number() OVER (ORDER BY g) - 1 AS place FROM t_top) p ON p.g = w.g JOIN u_steps u ON u.i = p.place
), l AS (
  SELECT g, i, list({{'b': b, 'a': a}} ORDER BY lvl) AS steps, string_agg(b || a, '' ORDER BY lvl) AS proof FROM s GROUP BY g, i
), z AS (
  SELECT w.g, w.i, 0 AS k, coalesce(w.forged, w.leaf) AS h, coalesce(l.steps, []) AS steps FROM w LEFT JOIN l ON l.g = w.g AND l.i = w.i
  UNION ALL SELECT g, i, k + 1, sha256(steps[k + 1].b || h || steps[k + 1].a), steps FROM z WHERE k < len(steps)
)
SELECT w.doc_id, w.leaf, t.h AS subroot, u.h AS root, sha256(coalesce(l.proof, '')) AS proof_sha256, z.h AS folded_root, z.h = u.h AS verified
FROM w JOIN t_top t ON t.g = w.g CROSS JOIN u_top u LEFT JOIN l ON l.g = w.g AND l.i = w.i JOIN z ON z.g = w.g AND z.i = w.i AND z.k = len(z.steps)
"""
ORACLE["op12_prefix_trie"] = f"""
WITH k AS (SELECT DISTINCT conv_id, {_crc32("conv_id")} % 9 AS h FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations
), r AS (
  SELECT k.conv_id, 0 AS part, t.place, role, text FROM k JOIN t ON t.conv_id = k.conv_id - k.conv_id % 5 AND t.place <= k.h
  UNION ALL SELECT k.conv_id, 1, t.place, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.place > k.h
), o AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes, list(strlen(role) || ':' || role || text) OVER w AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
), p AS (
  SELECT conv_id, depth, bytes, path FROM o UNION ALL SELECT conv_id, 0, 0, [] FROM k
), e AS (SELECT conv_id, max(depth) AS stop FROM p GROUP BY conv_id
), n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stop = depth), '') AS ends
  FROM p JOIN e USING (conv_id) GROUP BY path, depth
), c AS (SELECT path[:-2] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY path[:-2]
), m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (path)
), u AS (
  SELECT x.path[:d] AS path, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM m) x GROUP BY x.path[:d]
)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN u ON u.path = m.path LEFT JOIN n q ON m.depth > 0 AND q.path = m.path[:-2]
"""

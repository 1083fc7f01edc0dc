"""SQL of the seven pipelines, for the tables as ``catalog`` poses them: documents as chunks ``d::doc_id``.

Each function gives the common table expressions of one step or plan over a relation of questions
(query_id, text); names begin with a prefix of the caller's. A plan ends in a relation of the columns that
the registered queries have.
"""

from __future__ import annotations

from tessera import config
from tessera.functions import prompts

WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
SET = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: length(x) > 1))"
REFUSAL = "'The context does not answer this question.'"
ASK = "'Answer from the context alone and cite the ids of the chunks that you use.'"
GAP = "chr(10) || chr(10)"


def count(text: str) -> str:
    return f"len({WORDS.format(text)})"


def overlap(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({SET.format(a)}, {SET.format(b)})) / nullif(len({SET.format(a)}), 0), 0)"


def order(step: str) -> int:
    """Words of an order, without its inputs."""
    return len(prompts.head(step).split())


def vectors(p: str, rows: str, key: str) -> str:
    """{p}(key, place, x): hashed vectors, without places that are zero."""
    return f"""{p}_w AS (SELECT {key} AS key, md5(unnest({WORDS.format("lower(coalesce(text, ''))")})) AS h FROM {rows}),
{p}_s AS (SELECT key, ('0x' || h[1:8])::BIGINT % 64 AS place, sum(CASE WHEN ('0x' || h[9:9])::BIGINT < 8 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {p}_w GROUP BY ALL),
{p} AS (SELECT key, place, CAST(v / sqrt(sum(v * v) OVER (PARTITION BY key)) AS FLOAT) AS x FROM {p}_s WHERE v <> 0)"""


CORPUS = "d AS MATERIALIZED (SELECT doc_id AS id, 'd::' || doc_id AS chunk_id, text FROM documents),\n" + vectors("dv", "documents", "doc_id")


def dense(p: str, q: str, k: int) -> str:
    """{p}(query_id, id, score, rank)."""
    return f"""{vectors(f"{p}_v", q, "query_id")},
{p}_d AS (SELECT a.key AS query_id, b.key AS id, sum(a.x::DOUBLE * b.x::DOUBLE) AS score FROM {p}_v a JOIN dv b USING (place) GROUP BY ALL),
{p} AS (SELECT q.query_id, d.id, round(coalesce(score, 0), 6) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round(coalesce(score, 0), 6) DESC, d.id) AS rank FROM {q} q CROSS JOIN d LEFT JOIN {p}_d s ON s.query_id = q.query_id AND s.id = d.id QUALIFY rank <= {k})"""


def bm25() -> str:
    return f"""tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({WORDS.format("lower(text)")}) AS term FROM d) GROUP BY ALL),
dl AS (SELECT id, {count("lower(text)")} AS dl FROM d), st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl),
raw AS MATERIALIZED (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def sparse(p: str, q: str, k: int) -> str:
    """{p}(query_id, id, score, rank); needs ``bm25``."""
    return f"""{p}_t AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({WORDS.format("lower(text)")}) AS term FROM {q}) GROUP BY ALL),
{p}_h AS (SELECT query_id, id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM {p}_t JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (id), st GROUP BY ALL),
{p} AS (SELECT q.query_id, d.id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(score, 0) DESC, d.id) AS rank FROM {q} q CROSS JOIN d LEFT JOIN {p}_h h ON h.query_id = q.query_id AND h.id = d.id QUALIFY rank <= {k})"""


def fused(p: str, a: str, b: str, pool: int = config.POOL_K) -> str:
    return f"""{p}_l AS (SELECT query_id, id, round(sum(1.0::DOUBLE / ({config.RRF_K} + rank)), 12) AS score, min(no * 1000000 + rank) AS seen FROM (SELECT *, 0 AS no FROM {a} UNION ALL SELECT *, 1 FROM {b}) GROUP BY query_id, id),
{p} AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, id) AS rank FROM {p}_l QUALIFY rank <= {pool})"""


EDGES = """e AS (SELECT lower(n_name) AS src, lower(r_name) AS dst, 'd::' || n_nationkey AS chunk_id FROM nation JOIN region ON n_regionkey = r_regionkey),
adj AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
deg AS (SELECT src AS id, count(*) AS degree FROM adj GROUP BY src),
ev AS (SELECT src AS id, chunk_id FROM e UNION SELECT dst, chunk_id FROM e),
m AS (SELECT dst AS region, 'Entities: ' || dst || ', ' || string_agg(src, ', ') AS summary FROM e GROUP BY dst)"""


def seeds(p: str, q: str) -> str:
    return f"{p} AS (SELECT query_id, id FROM {q} JOIN deg ON regexp_matches(lower(text), '(^|[^a-z0-9_])' || id || '($|[^a-z0-9_])'))"


def hops(p: str, q: str) -> str:
    """{p}(query_id, id, rank) and {p}_n(query_id, id), the entities visited; needs ``EDGES``."""
    return f"""{seeds(f"{p}_0", q)},
{p}_1 AS (SELECT DISTINCT query_id, dst AS id FROM {p}_0 JOIN adj ON src = id),
{p}_2 AS (SELECT DISTINCT query_id, dst AS id FROM {p}_1 JOIN adj ON src = id),
{p}_n AS (SELECT * FROM {p}_0 UNION SELECT * FROM {p}_1 UNION SELECT * FROM {p}_2),
{p}_c AS (SELECT query_id, chunk_id, degree, id FROM {p}_n JOIN deg USING (id) JOIN ev USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY degree DESC, id) = 1),
{p}_r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY degree DESC, id, chunk_id) AS rank FROM {p}_c QUALIFY rank <= {config.GRAPH_MAX_CHUNKS}),
{p} AS (SELECT query_id, d.id, rank FROM {p}_r JOIN d USING (chunk_id))"""


def answered(p: str, q: str, hits: str, architecture: str, calls: str, extra: str, nodes: str, background: str = "''") -> str:
    """{p}: the final columns. hits(query_id, id, rank); q may have more columns for calls, extra words and nodes."""
    return f"""{p}_x AS (SELECT query_id, string_agg(chunk_id, ' ' ORDER BY rank) AS chunk_ids, string_agg('[' || chunk_id || ']' || chr(10) || text, {GAP} ORDER BY rank) AS context, arg_min(text || ' [' || chunk_id || ']', rank) AS answer FROM {hits} JOIN d USING (id) GROUP BY query_id),
{p}_y AS (SELECT q.*, coalesce(chunk_ids, '') AS chunk_ids, coalesce(answer, {REFUSAL}) AS answer, {ASK} || {GAP} || {background} || 'Context:' || chr(10) || coalesce(context, '') || {GAP} || 'Question: ' || text AS prompt FROM {q} q LEFT JOIN {p}_x USING (query_id)),
{p} AS (SELECT query_id, '{architecture}' AS architecture, '{architecture}::' || sha256(text)[:10] AS trace_id, chunk_ids, sha256(answer) AS answer_sha, CAST({calls} AS INTEGER) AS llm_calls, CAST({count("prompt")} + {extra} AS INTEGER) AS prompt_tokens, CAST({count("answer")} AS INTEGER) AS completion_tokens, CAST({nodes} AS INTEGER) AS n_nodes, text FROM {p}_y)"""


def naive(p: str, q: str) -> str:
    return f"{dense(f'{p}_h', q, config.TOP_K)},\n{answered(p, q, f'{p}_h', 'naive', '1', '0', '3')}"


def hybrid(p: str, q: str) -> str:
    rerank = f"""{p}_o AS (SELECT f.query_id, f.id, row_number() OVER (PARTITION BY f.query_id ORDER BY round({overlap("q.text", "d.text")}, 9) DESC, f.rank) AS place FROM {p}_f f JOIN {q} q USING (query_id) JOIN d ON d.id = f.id),
{p}_h AS (SELECT query_id, id, place AS rank FROM {p}_o WHERE place <= {config.TOP_K})"""
    return f"{dense(f'{p}_a', q, config.POOL_K)},\n{sparse(f'{p}_b', q, config.POOL_K)},\n{fused(f'{p}_f', f'{p}_a', f'{p}_b')},\n{rerank},\n{answered(p, q, f'{p}_h', 'hybrid', '1', '0', '6')}"


def hyde(p: str, q: str) -> str:
    draft = f"{p}_q AS (SELECT query_id, 'A passage about: ' || text AS text FROM {q})"
    return f"{draft},\n{dense(f'{p}_h', f'{p}_q', config.TOP_K)},\n{answered(p, q, f'{p}_h', 'hyde', '2', f'{order('generate_hypothetical') + 2} + {count('text')}', '4')}"


def corrective(p: str, q: str) -> str:
    """Three rounds; {p}_r1 to {p}_r3 are the searches of those still active."""
    tokens = f"array_to_string({SET.format('text')}, ' ')"
    parts = [f"{p}_q1 AS (SELECT query_id, text AS asked, text FROM {q})"]
    for a in (1, 2, 3):
        asked = f"{p}_q{a}"
        parts += [
            f"{p}_a{a} AS (SELECT query_id, asked AS text FROM {asked})",
            dense(f"{p}_s{a}", f"{p}_a{a}", config.TOP_K),
            f"{p}_g{a} AS (SELECT s.query_id, s.id, s.rank, {count('d.text')} AS words, CASE WHEN {overlap('q.text', 'd.text')} >= 0.3 THEN 'correct' WHEN {overlap('q.text', 'd.text')} > 0 THEN 'ambiguous' ELSE 'incorrect' END AS verdict FROM {p}_s{a} s JOIN {asked} q USING (query_id) JOIN d ON d.id = s.id)",
            f"{p}_c{a} AS (SELECT query_id, count(*) FILTER (verdict = 'incorrect') AS bad, count(*) FILTER (verdict = 'correct') AS good, sum(words + 3) AS shown FROM {p}_g{a} GROUP BY query_id)",
            f"{p}_r{a} AS (SELECT q.query_id, q.text, {'true' if a == 3 else 'bad <= good'} AS stop, {order('grade') + 2} + {count('q.text')} + shown AS grading, {order('rewrite') + 4} + 2 * bad + {count('q.asked')} AS rewriting FROM {asked} q JOIN {p}_c{a} USING (query_id))",
        ]
        if a < 3:
            parts.append(f"{p}_q{a + 1} AS (SELECT query_id, CASE WHEN {tokens} = '' THEN text ELSE {tokens} END AS asked, text FROM {p}_r{a} WHERE NOT stop)")
    rounds = " UNION ALL ".join(f"SELECT query_id, stop, {a} AS round, grading + CASE WHEN stop THEN 0 ELSE rewriting END AS spent FROM {p}_r{a}" for a in (1, 2, 3))
    parts += [
        f"{p}_t AS (SELECT query_id, max(round) AS rounds, sum(spent) AS spent FROM ({rounds}) GROUP BY query_id)",
        f"{p}_l AS ({' UNION ALL '.join(f'SELECT g.* FROM {p}_g{a} g JOIN {p}_t t USING (query_id) WHERE t.rounds = {a}' for a in (1, 2, 3))})",
        f"{p}_h AS (SELECT query_id, id, rank FROM {p}_l QUALIFY verdict <> 'incorrect' OR count(*) FILTER (verdict <> 'incorrect') OVER (PARTITION BY query_id) = 0)",
        f"{p}_z AS (SELECT q.query_id, q.text, rounds, spent FROM {q} q JOIN {p}_t USING (query_id))",
        answered(p, f"{p}_z", f"{p}_h", "corrective", "2 * rounds", "spent", "4 * rounds"),
    ]
    return ",\n".join(parts)


def graph(p: str, q: str) -> str:
    """Communities are the regions here, as each is linked to its nations alone."""
    told = f"{p}_b AS (SELECT query_id, 'Background, not to be cited:' || chr(10) || string_agg(summary, chr(10)) || {GAP} AS background FROM {p}_h_n JOIN m ON region = id GROUP BY query_id)"
    asked = f"{p}_q AS (SELECT q.query_id, q.text, coalesce(background, '') AS background FROM {q} q LEFT JOIN {p}_b USING (query_id))"
    return f"{hops(f'{p}_h', q)},\n{told},\n{asked},\n{answered(p, f'{p}_q', f'{p}_h', 'graph', '1', '0', '3', 'background')}"


def tool_lists(p: str, q: str) -> str:
    """{p}(query_id, id, rank) of questions(query_id, text, tool)."""
    of = lambda t: f"{p}_{t}q AS (SELECT query_id, text FROM {q} WHERE tool = '{t}')"
    k = config.TOP_K
    return f"{of('dense')},\n{of('sparse')},\n{of('graph')},\n{dense(f'{p}_d', f'{p}_denseq', k)},\n{sparse(f'{p}_s', f'{p}_sparseq', k)},\n{hops(f'{p}_g', f'{p}_graphq')},\n{p} AS (SELECT query_id, id, rank FROM {p}_d UNION ALL SELECT query_id, id, rank FROM {p}_s UNION ALL SELECT query_id, id, rank FROM {p}_g)"


EXACT = "(regexp_matches(text, '\"[^\"]+\"') OR regexp_matches(text, '--\\w+') OR regexp_matches(text, '\\b[A-Z]{2,}\\b'))"


def split(text: str) -> str:
    """The parts of a question, three at most; the question itself if there are none."""
    parts = f"list_filter(list_transform(regexp_split_to_array({text}, '[?;]\\s+|\\s+and\\s+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
    return f"(CASE WHEN len({parts}) > 0 THEN {parts}[:{config.MAX_SUB_QUESTIONS}] ELSE [{text}] END)"


def agentic(p: str, q: str) -> str:
    enough = f"coalesce(bool_or({overlap('t.text', 'd.text')} >= 0.3), false)"
    shown = count(f"d.text[:{config.PROMPT_PREVIEW}]")

    def tried(n: int, asked: str) -> list[str]:
        return [
            tool_lists(f"{p}_l{n}", asked),
            f"{p}_e{n} AS (SELECT t.query_id, any_value(t.of) AS of, any_value(t.no) AS no, any_value(t.text) AS text, any_value(t.tool) AS tool, {enough} AS enough, {order('reflect') + 2} + {count('any_value(t.text)')} + coalesce(sum({shown} + 3), 1) AS spent, {n} AS attempt FROM {asked} t LEFT JOIN {p}_l{n} l USING (query_id) LEFT JOIN d ON d.id = l.id GROUP BY t.query_id)",
        ]

    parts = [
        f"{p}_p AS (SELECT query_id AS of, unnest({split('text')}) AS text, unnest(range(len({split('text')}))) AS no FROM {q})",
        f"{p}_u AS (SELECT of, no, of * 10 + no AS query_id, text FROM {p}_p)",
        seeds(f"{p}_k", f"{p}_u"),
        f"{p}_t1 AS (SELECT *, CASE WHEN query_id IN (SELECT query_id FROM {p}_k) THEN 'graph' WHEN {EXACT} THEN 'sparse' ELSE 'dense' END AS tool FROM {p}_u)",
        *tried(1, f"{p}_t1"),
        f"{p}_t2 AS (SELECT of, no, query_id, text, CASE tool WHEN 'sparse' THEN 'dense' ELSE 'sparse' END AS tool FROM {p}_e1 WHERE NOT enough)",
        *tried(2, f"{p}_t2"),
        f"{p}_e AS (SELECT * FROM {p}_e1 UNION ALL SELECT * FROM {p}_e2)",
        f"{p}_i AS (SELECT of AS query_id, count(*) AS tries, sum(spent) AS spent, sum(CASE tool WHEN 'sparse' THEN 3 ELSE 4 END) AS steps FROM {p}_e GROUP BY of)",
        f"{p}_f AS (SELECT e.of AS query_id, e.no, l.id, l.rank FROM {p}_e2 e JOIN {p}_l2 l USING (query_id) UNION ALL SELECT e.of, e.no, l.id, l.rank FROM {p}_e1 e JOIN {p}_l1 l USING (query_id) WHERE enough)",
        f"{p}_h AS (SELECT query_id, id, min(no * 1000 + rank) AS rank FROM {p}_f GROUP BY query_id, id)",
        f"{p}_z AS (SELECT q.query_id, q.text, tries, spent, steps FROM {q} q JOIN {p}_i USING (query_id))",
        answered(p, f"{p}_z", f"{p}_h", "agentic", "2 + tries", f"spent + {order('plan') + 2} + {count('text')}", "2 + steps"),
    ]
    return ",\n".join(parts)


PLANS = {"naive": naive, "hybrid": hybrid, "hyde": hyde, "corrective": corrective, "graph": graph, "agentic": agentic}
COLUMNS = "query_id, architecture, trace_id, chunk_ids, answer_sha, llm_calls, prompt_tokens, completion_tokens, n_nodes"


def plan(posed: str, name: str) -> str:
    """The whole query of one plan; posed: the relation q(query_id, text)."""
    return f"WITH {posed},\n{CORPUS},\n{bm25()},\n{EDGES},\n{PLANS[name]('r', 'q')}\nSELECT {COLUMNS} FROM r"


def adaptive(posed: str) -> str:
    named = "(SELECT count(*) FROM k WHERE k.query_id = q.query_id)"
    word = "regexp_matches(text, '{}')"
    chosen = f"CASE WHEN {named} >= 2 THEN 'graph' WHEN {EXACT} THEN 'hybrid' WHEN len({split('text')}) > 1 THEN 'agentic' WHEN {word.format('(?i)^\\s*(why|how)\\b')} THEN 'hyde' WHEN {word.format('(?i)\\b(not|never|without)\\b')} THEN 'corrective' ELSE 'naive' END"
    plans = ",\n".join(f"q_{a} AS (SELECT query_id, text FROM c WHERE chosen = '{a}'),\n{f(f'r_{a}', f'q_{a}')}" for a, f in PLANS.items())
    every = " UNION ALL ".join(f"SELECT * FROM r_{a}" for a in PLANS)
    routing = order("route") + 2 + len(prompts.plans().split()) + 2
    return f"""WITH {posed},
{CORPUS},
{bm25()},
{EDGES},
{seeds("k", "q")},
c AS MATERIALIZED (SELECT query_id, text, {chosen} AS chosen FROM q),
{plans}
SELECT query_id, 'adaptive' AS architecture, 'adaptive::' || sha256(text)[:10] AS trace_id, chunk_ids, answer_sha, llm_calls + 1 AS llm_calls, CAST(prompt_tokens + {routing} + {count("text")} AS INTEGER) AS prompt_tokens, completion_tokens, n_nodes + 1 AS n_nodes FROM ({every})"""


def spec_hybrid(posed: str) -> str:
    """The declared plan: both searches of POOL_K, fused, and reranked to TOP_K."""
    return f"WITH {posed},\n{CORPUS},\n{bm25()},\n{hybrid('r', 'q')}\nSELECT query_id, 'generate' AS node, chunk_ids, answer_sha FROM r"


def evidence(posed: str) -> str:
    """What the corrective plan's answers rest on: their traces end in the last grade, above its search."""
    return f"WITH {posed},\n{CORPUS},\n{corrective('r', 'q')}\nSELECT trace_id, chunk_ids FROM r"

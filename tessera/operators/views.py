"""Views of runs, questions and graphs: filters, groups, counts, replay, evaluation rows and their recomputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import text as T
from tessera.operators import evaluation


def of_type(report: DataFrame, question_type: str | None) -> DataFrame:
    """The report's rows of a question type; None asks for the overall rows, whose type is null."""
    return report.where(F.col("question_type").eqNullSafe(F.lit(question_type)))


def grouped(rows: DataFrame, by: str, order: str, *names: str) -> DataFrame:
    """(by, n, items): rows of each group as structs of names, in order."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(order, *names))).alias("items"))


def parent_kinds(nodes: DataFrame, edges: DataFrame, required: DataFrame) -> DataFrame:
    """(graph, id, kind, parents, least, ok): how many incoming edges come from nodes of an accepted kind; edges from unknown nodes don't count.

    nodes(graph, id, kind), edges(graph, src, dst), required(kind, accepted array, least): a row for each kind that needs parents.
    """
    need = nodes.join(required, "kind")
    source = nodes.select("graph", F.col("id").alias("src"), F.col("kind").alias("src_kind"))
    found = edges.join(source, ["graph", "src"]).join(need.select("graph", F.col("id").alias("dst"), "accepted"), ["graph", "dst"]).where(F.array_contains("accepted", F.col("src_kind")))
    count = found.groupBy("graph", F.col("dst").alias("id")).agg(F.count("*").alias("parents"))
    out = need.join(count, ["graph", "id"], "left").withColumn("parents", F.coalesce("parents", F.lit(0)))
    return out.select("graph", "id", "kind", "parents", "least", (F.col("parents") >= F.col("least")).alias("ok"))


def replayed(nodes: DataFrame, mapping: DataFrame, recorded: DataFrame) -> DataFrame:
    """(graph, id, target, payload): what was recorded for each node; a node that has no target, or a target that wasn't recorded, is an error.

    nodes(graph, id), mapping(graph, id, target), recorded(graph, target, payload).
    """
    out = nodes.select("graph", "id").join(mapping, ["graph", "id"], "left").join(recorded.withColumn("__found", F.lit(True)), ["graph", "target"], "left")
    missing = F.raise_error(F.concat(F.lit("no recorded node for "), F.col("graph").cast("string"), F.lit(" "), F.col("id").cast("string")))
    return out.select("graph", "id", F.when(F.col("__found"), F.col("target")).otherwise(missing.cast("string")).alias("target"), "payload")


def zipped(items: Column, scores: Column) -> Column:
    """Structs (item, score) by position; arrays of different length are an error."""
    pairs = F.transform(F.arrays_zip(items.alias("item"), scores.alias("score")), lambda x: F.struct(x["item"].alias("item"), x["score"].alias("score")))
    return F.when(F.size(items) == F.size(scores), pairs).otherwise(F.raise_error(F.lit("as many scores as items are needed")).cast("array<struct<item:string,score:double>>"))


def containing(rows: DataFrame, column: str, marker: str) -> DataFrame:
    """Rows whose column holds the marker, as it is; null holds none."""
    return rows.where(F.contains(F.col(column), F.lit(marker)))


def seed_order(seeds: DataFrame) -> DataFrame:
    """(query_id, id, place): each question's seeds, the longest first, ties by id."""
    return seeds.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.length("id")), "id")))


def regions(text: Column, name: str) -> Column:
    """(code, first, last): the lines between ``# region: name`` and the next ``# endregion``, without their common indent, and their numbers from 1; a missing marker or an empty region is an error."""
    lines = F.split(text, "\r?\n")
    trimmed = F.transform(lines, T.strip)
    start = F.array_position(trimmed, f"# region: {name}")
    stop = F.array_position(F.slice(trimmed, start + 1, F.size(lines)), "# endregion") + start
    body = F.slice(lines, start + 1, F.greatest(stop - start - 1, F.lit(0)))
    full = F.filter(body, lambda x: T.strip(x) != "")
    indent = F.array_min(F.transform(full, lambda x: F.length(F.regexp_extract(x, r"^([ \t]*)", 1))))
    code = F.regexp_replace(F.array_join(F.transform(body, lambda x: F.when(T.strip(x) == "", "").otherwise(F.substr(x, indent + 1))), "\n"), r"^\n+|\n+$", "")
    fail = lambda why: F.raise_error(F.lit(f"region {name}: {why}")).cast("struct<code:string,first:int,last:int>")
    found = F.struct(code.alias("code"), (start + 1).cast("int").alias("first"), (stop - 1).cast("int").alias("last"))
    return F.when(start == 0, fail("no start")).when(stop == start, fail("no end")).when(F.size(full) == 0, fail("empty")).otherwise(found)


def build_stats(chunks: DataFrame, vocabulary: DataFrame, extracted: DataFrame, accepted: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: what a graph build took and kept."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    ends = accepted.select(F.col("src").alias("id")).unionByName(accepted.select(F.col("dst").alias("id"))).distinct()
    parts = (count(chunks, "chunks"), count(vocabulary, "entities_before"), count(extracted, "triples_extracted"), count(accepted, "triples_accepted"), count(ends, "entities_after"), count(communities, "communities"))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.withColumn("triples_dropped", F.col("triples_extracted") - F.col("triples_accepted"))


def eval_rows(runs: DataFrame, questions: DataFrame, judged: DataFrame) -> DataFrame:
    """One row for each run: rank metrics against the question's gold, the judge's verdicts, and costs.

    runs(architecture, question_id, trace_id, answer, retrieved_chunk_ids, graph_tool_involved, latency_ms,
    llm_calls, prompt_tokens, completion_tokens, backend_calls, adaptive_routed_to), questions(question_id,
    question_type, gold_chunk_ids, gold_answer_points), judged(architecture, question_id, point_support,
    reads_as_refusal, judge_reasoning, judge_backend, judge_prompt_tokens, judge_completion_tokens). Tokens
    are the run's and the judge's; calls are the run's alone.
    """
    r, g = F.col("retrieved_chunk_ids"), F.coalesce("gold_chunk_ids", F.array().cast("array<string>"))
    rows = runs.join(questions, "question_id").join(judged, ["architecture", "question_id"], "left")
    points = F.size(F.coalesce("gold_answer_points", F.array().cast("array<string>")))
    return rows.select(
        "architecture", "question_id", "question_type", "trace_id", "answer", "retrieved_chunk_ids", g.alias("gold_chunk_ids"),
        evaluation.recall_at(r, g).alias("recall_at_5"), evaluation.mrr_at(r, g).alias("mrr_at_10"), evaluation.ndcg_at(r, g).alias("ndcg_at_10"), evaluation.recall_full(r, g).alias("recall_full"),
        "graph_tool_involved", evaluation.faithfulness(F.col("point_support"), points).alias("faithfulness"), "reads_as_refusal",
        evaluation.refusal(F.col("question_type"), F.col("reads_as_refusal")).alias("refusal_correctness"), "judge_reasoning", "latency_ms", "llm_calls",
        (F.col("prompt_tokens") + F.coalesce("judge_prompt_tokens", F.lit(0))).alias("prompt_tokens"), (F.col("completion_tokens") + F.coalesce("judge_completion_tokens", F.lit(0))).alias("completion_tokens"),
        "backend_calls", "judge_backend", "adaptive_routed_to",
    )


def recomputed(old: DataFrame, runs: DataFrame, questions: DataFrame) -> DataFrame:
    """eval_rows of recorded runs without asking the judge again: its verdicts come from the old rows, its tokens are the old rows' less the runs', and the old route stays."""
    keys = ["architecture", "question_id"]
    own = runs.select(*keys, F.col("prompt_tokens").alias("__p"), F.col("completion_tokens").alias("__c"))
    kept = old.join(own, keys).select(
        *keys, F.col("faithfulness").alias("__faithfulness"), "reads_as_refusal", "judge_reasoning", "judge_backend", F.col("adaptive_routed_to").alias("__route"),
        (F.col("prompt_tokens") - F.col("__p")).alias("judge_prompt_tokens"), (F.col("completion_tokens") - F.col("__c")).alias("judge_completion_tokens"), F.lit(None).cast("array<boolean>").alias("point_support"),
    )
    made = eval_rows(runs, questions, kept.drop("__faithfulness", "__route"))
    out = made.join(kept.select(*keys, "__faithfulness", "__route"), keys)
    return out.withColumn("faithfulness", F.col("__faithfulness")).withColumn("adaptive_routed_to", F.coalesce("__route", "adaptive_routed_to")).select(*made.columns)


def costs(runs: DataFrame) -> DataFrame:
    """(architecture, runs, llm_calls, prompt_tokens, completion_tokens): totals; a delegating architecture's are its own call and the delegate's, as runs hold them."""
    return runs.groupBy("architecture").agg(F.count("*").alias("runs"), *(F.sum(x).alias(x) for x in ("llm_calls", "prompt_tokens", "completion_tokens")))


def home_counts(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: architectures, questions, traces and chunks."""
    return rows.agg(F.countDistinct("architecture").alias("n_architectures"), F.expr("count(*) div count(DISTINCT architecture)").alias("n_questions"), F.count("trace_id").alias("traces")).crossJoin(chunks.agg(F.count("*").alias("chunks")))  # one row each


def word_usage(prompt: Column, text: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Token counts of a completion: the backend's own where it tells them, else numbers of words."""
    words = lambda t: F.size(T.words(F.coalesce(t, F.lit(""))))
    return F.struct(F.coalesce(prompt_tokens, words(prompt)).cast("long").alias("prompt_tokens"), F.coalesce(completion_tokens, words(text)).cast("long").alias("completion_tokens"))


def strict_notes(files: DataFrame) -> DataFrame:
    """(name, title, tags, entities, created, words, problem) of files(name, text), parsed apart from ``read_notes``.

    The header is what lies between the first two ``---`` anywhere, and must begin the text. Flow lists
    (``[a, b]``) and block lists are read. problem tells the first fault, in the order of the checks; null: none.
    """
    parts = F.split("text", "---", 3)
    head = F.get(parts, F.lit(1))
    field = lambda n: F.regexp_extract(head, rf"(?m)^{n}:[ \t]*(.*)$", 1)
    has = lambda n: F.regexp_like(head, F.lit(rf"(?m)^{n}:"))
    bare = lambda x: F.regexp_replace(T.strip(x), "^[\"']|[\"']$", "")
    block = lambda n: F.split(F.regexp_extract(head, rf"(?m)^{n}:[ \t]*\n((?:[ \t]*- .*\n?)+)", 1), r"\n")

    def items(n: str) -> Column:
        flow = F.regexp_extract(field(n), r"^\[(.*)\]\s*$", 1)
        rows = F.when(F.regexp_like(field(n), F.lit(r"^\[.*\]\s*$")), F.split(flow, ",")).otherwise(F.transform(block(n), lambda x: F.regexp_replace(x, r"^[ \t]*- ", "")))
        return F.filter(F.transform(rows, bare), lambda x: x != "")

    tags, entities = items("tags"), F.transform(items("entities"), lambda x: F.lower(x))
    missing = F.lit(None).cast("string")
    for n in ("created", "entities", "tags", "title"):
        missing = F.when(~has(n), f"no {n}").otherwise(missing)
    problem = F.when(~F.startswith(F.col("text"), F.lit("---")), "no opening ---").when(F.size(parts) < 3, "no closing ---").when(missing.isNotNull(), missing).when(F.size(entities) == 0, "no entities").when(F.size(tags) == 0, "no tags")
    return files.select("name", bare(field("title")).alias("title"), tags.alias("tags"), entities.alias("entities"), bare(field("created")).alias("created"), F.size(T.words(F.coalesce(F.get(parts, F.lit(2)), F.lit("")))).alias("words"), problem.alias("problem"))


def expected_keys(questions: DataFrame, architectures: tuple[str, ...] = config.ARCHITECTURES) -> DataFrame:
    """(architecture, question_id): every run that a full sweep has."""
    return questions.select(F.explode(F.array(*map(F.lit, architectures))).alias("architecture"), "question_id")

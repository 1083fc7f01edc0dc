"""Completions of a table of prompts: cache, fallback between backends, one repair of malformed replies.

A backend that fails on a prompt says so in the ``error`` column; nothing raises while a batch runs, and
rows that failed go to the next backend in one pass, so a batch costs as many passes as there are
backends, however its failures are spread. Where a JSON object is asked for, a reply without one is sent
back once, to the same backend, with what was wrong; what fails again goes on as a failure.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import prompts as P
from tessera.functions import text as T
from tessera.operators.lineage import cut
from tessera.operators.views import word_usage


@dataclass(frozen=True)
class Backend:
    """complete: DataFrame(prompt) to (prompt, text, error, ...), where prompt_tokens and completion_tokens may be left out; ready: whether it can be asked at all, as without a key it can't."""

    name: str
    model: str
    complete: Callable[[DataFrame], DataFrame]
    ready: bool = True


def from_column(name: str, model: str, text: Callable[[Column], Column], error: Callable[[Column], Column] | None = None) -> Backend:
    """A backend whose replies are expressions of the prompt."""
    why = error(F.col("prompt")) if error else F.lit(None).cast("string")
    return Backend(name, model, lambda p: p.select("prompt", F.when(why.isNull(), text(F.col("prompt"))).alias("text"), why.cast("string").alias("error")))


def repair_prompt(prompt: Column, reply: Column) -> Column:
    """The order once more, with the reply that held no JSON object."""
    return F.concat_ws("\n", prompt, F.lit("<rejected>"), reply, F.lit("</rejected>"), F.lit("No JSON object was found in what was rejected. " + P.REPLY))


def _asked(backend: Backend, prompts: DataFrame) -> DataFrame:
    """(prompt, text, error, prompt_tokens, completion_tokens) of distinct prompts; a prompt without a row is an error."""
    got = backend.complete(prompts)
    for x in ("prompt_tokens", "completion_tokens"):
        got = got if x in got.columns else got.withColumn(x, F.lit(None).cast("long"))
    got = prompts.join(got.select("prompt", "text", "error", "prompt_tokens", "completion_tokens"), "prompt", "left")
    told = word_usage(F.col("prompt"), F.col("text"), F.col("prompt_tokens"), F.col("completion_tokens"))
    error = F.coalesce("error", F.when(F.col("text").isNull(), "no reply"))
    return got.select("prompt", "text", error.alias("error"), told["prompt_tokens"].alias("prompt_tokens"), told["completion_tokens"].alias("completion_tokens"))


def _served(backend: Backend, prompts: DataFrame, as_json: bool) -> DataFrame:
    """Replies of one backend, malformed ones repaired once: the columns of _asked, with json and repaired."""
    first = cut(_asked(backend, prompts).withColumn("json", T.json_of(F.col("text")) if as_json else F.lit(None).cast("string")).withColumn("repaired", F.lit(False)))
    if not as_json:
        return first
    bad = F.col("error").isNull() & F.col("json").isNull()
    broken = cut(first.where(bad).withColumn("again", repair_prompt(F.col("prompt"), F.col("text"))))
    if not broken.limit(1).count():
        return first
    second = _asked(backend, broken.select(F.col("again").alias("prompt")).distinct()).toDF("again", "text2", "error2", "in2", "out2")
    json = T.json_of(F.col("text2"))
    error = F.coalesce("error2", F.when(json.isNull(), "malformed reply"))
    mended = broken.join(second, "again").select("prompt", F.col("text2").alias("text"), error.alias("error"), (F.col("prompt_tokens") + F.col("in2")).alias("prompt_tokens"), (F.col("completion_tokens") + F.col("out2")).alias("completion_tokens"), json.alias("json"), F.lit(True).alias("repaired"))
    return first.where(~bad).unionByName(mended)


def complete(prompts: DataFrame, backends: list[Backend], cache: DataFrame | None = None, as_json: bool = False, params: str = "{}") -> DataFrame:
    """(prompt, text, json, backend, cached, repaired, prompt_tokens, completion_tokens, error) of each distinct prompt of prompts(prompt).

    cache(key, text): looked up under every backend, in order, before any is asked. json is the reply's
    object as text; error is null but where all backends failed, and then the last one's, with no backend.
    """
    left = cut(prompts.select("prompt").where("prompt IS NOT NULL").distinct())
    done: list[DataFrame] = []
    json = lambda t: T.json_of(t) if as_json else F.lit(None).cast("string")
    columns = ["prompt", "text", "json", "backend", "cached", "repaired", "prompt_tokens", "completion_tokens", "error"]
    if cache is not None:
        keys = F.array(*(F.struct(F.lit(i).alias("n"), F.lit(b.name).alias("backend"), T.cache_key(F.lit(b.name), F.lit(b.model), F.col("prompt"), F.lit(params)).alias("key")) for i, b in enumerate(backends)))
        known = left.select("prompt", F.explode(keys).alias("k")).select("prompt", "k.*").join(cache.select("key", "text"), "key").where(json(F.col("text")).isNotNull() if as_json else F.lit(True))
        best = cut(known.groupBy("prompt").agg(F.min_by(F.struct("text", "backend"), "n").alias("h")).select("prompt", "h.text", "h.backend"))
        told = word_usage(F.col("prompt"), F.col("text"), F.lit(None).cast("long"), F.lit(None).cast("long"))
        done.append(best.select("prompt", "text", json(F.col("text")).alias("json"), "backend", F.lit(True).alias("cached"), F.lit(False).alias("repaired"), told["prompt_tokens"].alias("prompt_tokens"), told["completion_tokens"].alias("completion_tokens"), F.lit(None).cast("string").alias("error")))
        left = cut(left.join(best.select("prompt"), "prompt", "left_anti"))
    failed = left.select("prompt", F.lit("no backend is ready").alias("error"))
    for b in backends:
        if not b.ready:
            continue
        got = cut(_served(b, left, as_json).withColumn("backend", F.lit(b.name)).withColumn("cached", F.lit(False)))
        done.append(got.where("error IS NULL").select(*columns))
        failed = got.where("error IS NOT NULL").select("prompt", "error")
        left = failed.select("prompt")
        if not left.limit(1).count():
            break
    none = {"text": "string", "json": "string", "backend": "string", "prompt_tokens": "long", "completion_tokens": "long"}
    lost = failed.select("prompt", "error", F.lit(False).alias("cached"), F.lit(False).alias("repaired"), *(F.lit(None).cast(t).alias(n) for n, t in none.items())).select(*columns)
    out = lost
    for d in done:
        out = out.unionByName(d)
    return out


def new_cache_rows(completed: DataFrame, backends: list[Backend], params: str = "{}") -> DataFrame:
    """(key, text) to append to a cache: what backends have served now, under the one that did. A repaired reply is kept under the prompt that it answers."""
    model = F.create_map(*(F.lit(x) for b in backends for x in (b.name, b.model)))
    return completed.where("error IS NULL AND NOT cached").select(T.cache_key(F.col("backend"), model[F.col("backend")], F.col("prompt"), F.lit(params)).alias("key"), "text")


def judged(answers: DataFrame, backends: list[Backend], cache: DataFrame | None = None) -> DataFrame:
    """(architecture, question_id, point_support, reads_as_refusal, judge_reasoning, judge_backend, judge_prompt_tokens, judge_completion_tokens) of answers(architecture, question_id, question, answer, gold_answer_points).

    Only true JSON booleans count as support or refusal; a reply without them, and one that no backend
    gave in two tries, supports nothing.
    """
    points = F.coalesce("gold_answer_points", F.array().cast("array<string>"))
    asked = cut(answers.withColumn("prompt", P.with_json(P.judge(F.col("question"), F.col("answer"), points), '{"point_support": [true], "reads_as_appropriate_refusal": false, "reasoning": ""}')))
    done = complete(asked, backends, cache, as_json=True)
    listed = F.coalesce(F.regexp_extract(F.get_json_object("json", "$.point_support"), r"(?s)^\s*\[(.*)\]\s*$", 1), F.lit(""))
    marks = F.transform(F.filter(F.split(listed, ","), lambda m: T.strip(m) != ""), lambda m: T.strip(m) == "true")  # "true" in quotes isn't true
    rows = asked.select("architecture", "question_id", "prompt").join(done, "prompt", "left")
    return rows.select(
        "architecture", "question_id", marks.alias("point_support"), F.coalesce(F.from_json("json", "reads_as_appropriate_refusal boolean")["reads_as_appropriate_refusal"], F.lit(False)).alias("reads_as_refusal"),
        F.coalesce(F.get_json_object("json", "$.reasoning"), F.lit("")).alias("judge_reasoning"), F.col("backend").alias("judge_backend"), F.coalesce("prompt_tokens", F.lit(0)).alias("judge_prompt_tokens"), F.coalesce("completion_tokens", F.lit(0)).alias("judge_completion_tokens"),
    )

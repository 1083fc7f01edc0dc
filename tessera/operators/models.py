"""Model interfaces and their deterministic offline stand-ins.

Nothing here is a language model: the stand-ins are lexical, and every answer carries the backend that
made it. Real models plug in by the same signatures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import text as T
from tessera.operators import grading


class Embedder(Protocol):
    dims: int

    def embed(self, rows: DataFrame, key: str, text: str = "text") -> DataFrame:
        """(key, embedding array<float>) of rows, whose keys are distinct."""
        ...


class Reranker(Protocol):
    def score(self, query: Column, passage: Column) -> Column: ...


class Completer(Protocol):
    backend: str

    def answer(self, question: Column, context: Column) -> Column: ...


class Judge(Protocol):
    backend: str

    def supported(self, answer: Column, points: Column) -> Column: ...


class HashingEmbedder:
    """Signed feature hashing of words into ``dims`` dimensions, of length 1; texts without words are zero.

    A word's place and sign come from its MD5, which is taken once for each different word of a batch of
    rows; a text's vector is the sum of its words' signs, of all texts that share a key.
    """

    backend = "offline-hashing"

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, rows: DataFrame, key: str, text: str = "text") -> DataFrame:
        dims, names = self.dims, [f"v{i}" for i in range(self.dims)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = b.column(1).flatten().dictionary_encode()
                told = b"".join(hashlib.md5(w, usedforsecurity=False).digest() for w in words.dictionary.cast(pa.binary()).to_pylist())
                told = np.frombuffer(told, np.uint8).reshape(-1, 16)
                place = told[:, :4].copy().view(">u4")[:, 0] % dims
                sign = np.where(told[:, 4] < 128, 1.0, -1.0)
                at = words.indices.to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
                sums = np.bincount(row * dims + place[at], sign[at], b.num_rows * dims).astype(np.int64).reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(sums[:, i]) for i in range(dims))], names=["key", *names])

        words = rows.select(F.col(key).alias("key"), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))
        kinds = ", ".join((f"key {words.schema['key'].dataType.simpleString()}", *(f"{n} long" for n in names)))
        sums = words.mapInArrow(run, kinds).groupBy(F.col("key").alias(key)).agg(*(F.sum(n).alias(n) for n in names))
        square = sum((F.col(f"v{i}") * F.col(f"v{i}") for i in range(self.dims)), F.lit(0))
        sums = sums.withColumn("size", F.sqrt(square))
        return sums.select(key, F.array(*(F.when(F.col("size") == 0, 0.0).otherwise(F.col(f"v{i}") / F.col("size")).cast("float") for i in range(self.dims))).alias("embedding"))


class LexicalReranker:
    """Share of the query's token set that the passage holds."""

    backend = "offline-lexical"

    def score(self, query: Column, passage: Column) -> Column:
        return F.round(F.coalesce(grading.lexical_overlap(query, passage), F.lit(0.0)), 9)


class ExtractiveCompleter:
    """Quotes the first passage of the context and cites it; without context it says so."""

    backend = "offline-extractive"
    refusal = "The context does not answer this question."

    def answer(self, question: Column, context: Column) -> Column:
        top = F.element_at(context, 1)
        return F.when(F.size(context) > 0, F.concat(top["text"], F.lit(" ["), top["chunk_id"], F.lit("]"))).otherwise(self.refusal)

    def hypothetical(self, question: Column) -> Column:
        return F.concat(F.lit("A passage about: "), question)

    def rewrite(self, question: Column) -> Column:
        """The question's distinct tokens; the question itself if it has none."""
        q = F.array_join(T.token_set(question), " ")
        return F.when(q == "", question).otherwise(q)

    def plan(self, question: Column) -> Column:
        """Up to three parts between question marks, semicolons or the word ``and``."""
        parts = F.filter(F.transform(F.split(question, r"[?;]\s+|\s+and\s+"), T.strip), lambda x: x != "")
        return F.when(F.size(parts) > 0, F.slice(parts, 1, config.MAX_SUB_QUESTIONS)).otherwise(F.array(question))


class LexicalJudge:
    """A gold point is supported if the answer holds at least half of its token set."""

    backend = "offline-lexical"

    def supported(self, answer: Column, points: Column) -> Column:
        return F.transform(points, lambda p: F.coalesce(grading.lexical_overlap(p, answer), F.lit(0.0)) >= 0.5)

    def refuses(self, answer: Column) -> Column:
        return answer.rlike(r"(?i)\b(does not|cannot|can't|no) (answer|information|context)\b|does not answer")


def completed(prompts: DataFrame, cache: DataFrame | None, backends: list[tuple[str, str]], run, params: str = "{}") -> DataFrame:
    """(prompt, text, backend) of each distinct prompt: from the cache by the first backend that has it, else from ``run``.

    cache(key, text); backends: (backend, model) in order of preference; run: DataFrame of prompts to
    (prompt, text, backend). Equal prompts are completed once.
    """
    distinct = prompts.select("prompt").distinct()
    if cache is None:
        return run(distinct)
    keys = F.array(*(F.struct(F.lit(i).alias("n"), F.lit(b).alias("backend"), T.cache_key(F.lit(b), F.lit(m), F.col("prompt"), F.lit(params)).alias("key")) for i, (b, m) in enumerate(backends)))
    hits = distinct.select("prompt", F.explode(keys).alias("k")).select("prompt", "k.*").join(cache.select("key", "text"), "key")
    best = hits.groupBy("prompt").agg(F.min_by(F.struct("text", "backend"), "n").alias("h")).select("prompt", "h.text", "h.backend")
    return best.unionByName(run(distinct.join(best.select("prompt"), "prompt", "left_anti")))


def cache_rows(completed_prompts: DataFrame, models: dict[str, str], params: str = "{}") -> DataFrame:
    """(key, text) to append to a cache, under the backend that served."""
    model = F.create_map(*(F.lit(x) for kv in models.items() for x in kv))
    return completed_prompts.select(T.cache_key(F.col("backend"), model[F.col("backend")], F.col("prompt"), F.lit(params)).alias("key"), "text")

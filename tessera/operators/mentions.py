"""Dictionary matching: which names of a vocabulary a text mentions, by equi-joins on token n-grams.

A name is its parts between white space and hyphens, and a mention has the same parts, joined by either,
at word boundaries. Where all parts of a name are words, it is mentioned exactly if its parts are
neighbours in a stretch of the text that holds nothing but words, white space and hyphens: so n-grams of
such stretches, of the lengths that names have, are joined with the names, and no pattern is tried.
Names with other signs in them ("node.js") are found by the n-grams of their words in the whole text, and
only texts that hold these are tried against the pattern. A name without any word in it has no n-gram: such
names, if there are any, are tried against every text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.lineage import cut, sent

_BETWEEN = r"(?U)[\s\-]+"


def names(entities: DataFrame) -> DataFrame:
    """(id, key, n, whole) of entities(id), normalised: the words of each name, their number, and whether they are all of it."""
    parts = F.split("id", _BETWEEN)
    whole = F.forall(parts, lambda p: p.rlike(r"(?U)^\w+$"))
    words = F.when(whole, parts).otherwise(F.regexp_extract_all("id", F.lit(r"((?U)\w+)"), F.lit(1)))
    return entities.where("id IS NOT NULL").select("id", F.array_join(words, " ").alias("key"), F.size(words).alias("n"), whole.alias("whole"))


def grams(words: Column, lengths: list[int]) -> Column:
    """Every run of so many neighbours, joined by blanks."""
    none = F.array().cast("array<string>")
    of = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(none)
    return F.concat(*(words if n == 1 else of(n) for n in lengths)) if lengths else none


def _lengths(known: DataFrame) -> list[int]:
    """The different numbers of words that names have: few, whatever the names' number."""
    return sorted(r[0] for r in known.select("n").distinct().collect())


def mentioned(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, id) of texts(query_id, text) and entities(id), each pair once."""
    known = cut(names(entities.select("id").distinct()))
    low = texts.where("text IS NOT NULL").select("query_id", F.lower("text").alias("text"))
    found = []
    plain = known.where("whole")
    if lengths := _lengths(plain):
        stretches = F.split("text", r"(?U)[^\w\s\-]+")
        held = F.flatten(F.transform(stretches, lambda s: grams(F.filter(F.split(s, _BETWEEN), lambda x: x != ""), lengths)))
        rows = low.select("query_id", F.explode(F.array_distinct(held)).alias("key"))
        found.append(rows.join(sent(plain.select("key", "id")), "key").select("query_id", "id"))
    marked = known.where("NOT whole AND n > 0")
    if lengths := _lengths(marked):
        rows = low.select("query_id", F.explode(F.array_distinct(grams(F.regexp_extract_all("text", F.lit(r"((?U)\w+)"), F.lit(1)), lengths))).alias("key"))
        maybe = rows.join(sent(marked.select("key", "id")), "key").select("query_id", "id")
        found.append(_tried(maybe.join(low, "query_id")))
    bare = known.where("n = 0")
    if bare.limit(1).count():
        found.append(_tried(low.join(bare.select("id"), F.lit(True))))
    if not found:
        return texts.select("query_id", F.lit("").alias("id")).limit(0)
    return reduce(DataFrame.unionByName, found).distinct()


def _tried(rows: DataFrame) -> DataFrame:
    return rows.where(F.regexp("text", T.mention_pattern(F.col("id")))).select("query_id", "id")

import random
import re

import pytest

from tessera.operators import mentions

NAMES = ["new york", "york", "node.js", "c++", "coca-cola", "straße", "москва", "u.s. army", "a", "rock and roll", ".net", "++", "-x", "it's", "new york city"]
TEXTS = [
    "New-York and new   york, York!", "yorkshire newyork", "node.js nodexjs node js", "C++ and c+ +", "Coca Cola coca\n-\ncola cocacola", "STRAßE straßenbahn", "в Москва, москвабад", "the U.S. Army; us army",
    "A. a1 _a", "rock  and-roll; rock, and roll", "asp.net .net", "a++b ++", "a -x b-x -xy", "it's its", "new york city limits", None, "", "new, york",
]


def by_hand(texts, names):
    """Python's patterns, which know all scripts."""
    for i, t in texts:
        for n in names:
            parts = re.split(r"[\s\-]+", n)
            if t is not None and re.search(r"\b" + r"[\s\-]+".join(map(re.escape, parts)) + r"\b", t.lower()):
                yield i, n


def found(spark, texts, names):
    t = spark.createDataFrame(texts, "query_id long, text string")
    return sorted(tuple(r) for r in mentions.mentioned(t, spark.createDataFrame([(n,) for n in names], "id string")).collect())


def test_every_kind_of_name(spark):
    texts = list(enumerate(TEXTS))
    assert found(spark, texts, NAMES) == sorted(by_hand(texts, NAMES))


@pytest.mark.parametrize("seed", range(3))
def test_against_patterns(spark, seed):
    rng = random.Random(seed)
    words = ["ab", "abc", "b", "x1", "é", "a_b", "c.d", "e'f"]
    names = sorted({rng.choice([" ", "-"]).join(rng.choices(words, k=rng.choice([1, 1, 2, 3]))) for _ in range(40)})
    texts = [(i, "".join(rng.choice(words).upper() + rng.choice([" ", "-", ", ", ".", "", " - ", "\n"]) for _ in range(12))) for i in range(60)]
    assert found(spark, texts, names) == sorted(by_hand(texts, names))


def test_a_large_vocabulary_is_joined(spark):
    """10^5 names, some in texts: no nested loop over them."""
    names = spark.range(100_000).selectExpr("concat('name ', id, ' of ', id % 1000) AS id")
    texts = spark.range(300).selectExpr("id AS query_id", "concat('x Name ', id * 7, ' of ', (id * 7) % 1000, ' y') AS text")
    got = mentions.mentioned(texts, names)
    assert got.count() == 300
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_no_names_and_no_texts(spark):
    assert found(spark, [(1, "x")], []) == [] and found(spark, [], ["x"]) == []

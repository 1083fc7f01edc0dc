import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import completion as c
from tessera.operators import extraction

ECHO = lambda p: F.concat(F.lit("a: "), p)


def prompts(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "prompt string")


def by_prompt(df):
    return {r.prompt: r for r in df.collect()}


def fails(word):
    return lambda p: F.when(p.contains(word), F.concat(F.lit("down for "), p))


def test_what_fails_goes_to_the_next(spark):
    a, b = c.from_column("a", "m1", ECHO, fails("x")), c.from_column("b", "m2", lambda p: F.upper(p), fails("xx"))
    got = by_prompt(c.complete(prompts(spark, "one", "x", "xx", "one", None), [a, b]))
    assert {p: (r.text, r.backend) for p, r in got.items()} == {"one": ("a: one", "a"), "x": ("X", "b"), "xx": (None, None)}
    assert got["xx"].error == "down for xx" and got["one"].error is None and (got["one"].prompt_tokens, got["one"].completion_tokens) == (1, 2)


def test_a_backend_that_is_not_ready_is_not_asked(spark):
    def never(_):
        raise AssertionError("asked without a key")

    got = c.complete(prompts(spark, "p"), [c.Backend("a", "m", never, ready=False), c.from_column("b", "m", ECHO)]).first()
    assert (got.text, got.backend) == ("a: p", "b")
    assert c.complete(prompts(spark, "p"), [c.Backend("a", "m", never, ready=False)]).first().error == "no backend is ready"


def test_the_cache_comes_before_every_backend(spark):
    a, b = c.from_column("a", "m1", ECHO), c.from_column("b", "m2", ECHO)
    key = T.cache_key(F.lit("b"), F.lit("m2"), F.col("prompt"), F.lit("{}"))
    cache = prompts(spark, "known").select(key.alias("key"), F.lit("kept").alias("text"))
    done = c.complete(prompts(spark, "known", "new"), [a, b], cache)
    got = by_prompt(done)
    assert (got["known"].text, got["known"].backend, got["known"].cached) == ("kept", "b", True) and not got["new"].cached
    more = c.new_cache_rows(done, [a, b])
    assert more.count() == 1
    again = by_prompt(c.complete(prompts(spark, "known", "new"), [c.Backend("a", "m1", None, ready=False), b], cache.unionByName(more).where("text <> ''")))
    assert (again["new"].backend, again["new"].cached) == ("a", True)  # what a has served is there, ready or not
    assert not by_prompt(c.complete(prompts(spark, "new"), [b], more))["new"].cached  # and isn't b's
    assert by_prompt(c.complete(prompts(spark, "new"), [a, b], more))["new"].cached


def test_a_malformed_reply_is_repaired_once(spark):
    fixes = c.from_column("a", "m", lambda p: F.when(p.contains("<rejected>"), F.lit('so: {"k": 2} .')).when(p.contains("good"), F.lit('{"k": 1}')).otherwise("none"))
    never = c.from_column("b", "m", lambda p: F.lit("prose"))
    got = by_prompt(c.complete(prompts(spark, "good", "bad"), [fixes], as_json=True))
    assert (got["good"].json, got["good"].repaired) == ('{"k": 1}', False) and (got["bad"].json, got["bad"].repaired) == ('{"k": 2}', True)
    assert got["bad"].completion_tokens == 1 + 4 and got["bad"].prompt_tokens > 1
    next_one = by_prompt(c.complete(prompts(spark, "bad"), [never, fixes], as_json=True))["bad"]
    assert (next_one.backend, next_one.json) == ("a", '{"k": 2}')
    lost = c.complete(prompts(spark, "bad"), [never], as_json=True).first()
    assert (lost.error, lost.json, lost.backend) == ("malformed reply", None, None)


def test_judges_count_true_booleans_only(spark):
    replies = {
        "a1": '{"point_support": [true, false, true], "reads_as_appropriate_refusal": false, "reasoning": "r"}', "a2": '{"point_support": [], "reads_as_appropriate_refusal": true}',
        "a3": '{"point_support": ["false", "true", true], "reads_as_appropriate_refusal": "true"}', "a4": '{"point_support": "true"}', "a5": "no JSON at all",
    }
    text = F.lit(None).cast("string")
    for k, v in replies.items():
        text = F.when(F.col("prompt").contains(f"answer {k}"), v).otherwise(text)
    judge = c.Backend("j", "m", lambda p: p.select("prompt", text.alias("text"), F.lit(None).cast("string").alias("error")))
    answers = spark.createDataFrame([("naive", k, "q", f"answer {k}", ["p1", "p2", "p3"]) for k in replies] + [("naive", "a6", "q", "answer a2", None)], "architecture string, question_id string, question string, answer string, gold_answer_points array<string>")
    got = {r.question_id: r for r in c.judged(answers, [judge]).collect()}
    assert got["a1"].point_support == [True, False, True] and got["a1"].judge_reasoning == "r" and got["a1"].judge_backend == "j"
    assert got["a2"].reads_as_refusal is True and got["a2"].point_support == [] == got["a6"].point_support
    assert got["a3"].point_support == [False, False, True] and got["a3"].reads_as_refusal is False
    assert got["a4"].point_support == [] and got["a5"].point_support == [] and got["a5"].judge_backend is None and not got["a5"].reads_as_refusal


VOCABULARY = ["alpha", "beta two", "gamma"]


def test_triples_are_filtered_and_counted(spark):
    t = lambda *rows: json.dumps({"triples": list(rows)})
    one = {"subject": " Alpha ", "relation": "is near", "object": "BETA  two"}
    replies = [
        ("c1", t(one, {"subject": "alpha", "relation": " ", "object": "gamma"}, {"subject": "alpha", "relation": "r", "object": "delta"}, "no object", {"relation": "r"})),
        ("c2", '{"triples": "none"}'), ("c3", "{}"), ("c4", t()), ("c5", t({"subject": 5, "relation": "r", "object": "gamma"}, one)),
    ]
    vocabulary = spark.createDataFrame([(v,) for v in VOCABULARY], "id string")
    edges, counts = extraction.extracted(spark.createDataFrame(replies, "chunk_id string, json string"), vocabulary)
    assert sorted(tuple(r) for r in edges.collect()) == [("alpha", "is near", "beta two", "c1"), ("alpha", "is near", "beta two", "c5")]
    assert {r.chunk_id: (r.proposed, r.kept, r.dropped) for r in counts.collect()} == {"c1": (5, 1, 4), "c2": (0, 0, 0), "c3": (0, 0, 0), "c4": (0, 0, 0), "c5": (2, 1, 1)}


def test_from_chunks_to_edges_and_summaries(spark):
    vocabulary = spark.createDataFrame([(v,) for v in VOCABULARY], "id string")
    chunks = spark.createDataFrame([("n::0", "n", "h", "Alpha and beta-two here"), ("n::1", "n", None, "only gamma"), ("m::0", "m", "", "gamma, alpha")], "chunk_id string, note_id string, heading string, text string")
    orders = {r.chunk_id: r.prompt for r in extraction.asked(chunks, vocabulary).collect()}
    assert set(orders) == {"n::0", "m::0"} and "alpha\nbeta two" in orders["n::0"] and "gamma" not in orders["n::0"] and 'heading="none"' in orders["m::0"]
    listed = F.split(F.regexp_extract("prompt", r"(?s)<vocabulary>\n(.*?)\n</vocabulary>", 1), "\n")
    pairs = c.Backend("p", "m", lambda p: p.select("prompt", extraction.co_mentioned(listed).alias("text"), F.lit(None).cast("string").alias("error")))
    edges, counts = extraction.triples(chunks, vocabulary, [c.from_column("down", "m", ECHO, lambda p: F.lit("down")), pairs])
    assert sorted(tuple(r) for r in edges.collect()) == [("alpha", "co-occurs with", "beta two", "n::0"), ("alpha", "co-occurs with", "gamma", "m::0")]
    assert all(r.dropped == 0 for r in counts.collect())
    members = spark.createDataFrame([("alpha", 0), ("beta two", 0), ("gamma", 1)], "id string, community int")
    told = {r.id: r for r in extraction.summaries(edges, members, chunks, [c.from_column("s", "m", lambda p: F.concat(F.lit("  words: "), F.size(T.words(p)).cast("string"), F.lit(" ")))]).collect()}
    assert told[0].entity_ids == ["alpha", "beta two"] and told[0].summary.startswith("words: ") and told[1].summary != told[0].summary
    sample = {r.community: r for r in extraction.edge_samples(edges, members, chunks).collect()}
    assert [tuple(e) for e in sample[0].edges] == [("alpha", "co-occurs with", "beta two")] and [x.chunk_id for x in sample[0].excerpts] == ["n::0"] and sample[1].edges is None


@pytest.mark.parametrize("bad", ["{", "[1]", "x {y", ""])
def test_json_of_prose(spark, bad):
    assert spark.createDataFrame([(bad,)], "t string").select(T.json_of(F.col("t")).alias("j")).first().j is None


def test_replies_are_read_once_for_triples_and_counts(spark):
    rows = [("a", '{"triples": [{"subject": "x", "relation": "r", "object": "y"}, null, 3]}'), ("b", '{"triples": []}'), ("c", '{"triples": "none"}'), ("d", "{}")]
    replies = spark.createDataFrame(rows, "chunk_id string, json string").mapInArrow(lambda batches: batches, "chunk_id string, json string")
    edges, counts = extraction.extracted(replies, spark.createDataFrame([("x",), ("y",)], "id string"))
    assert "MapInArrow" not in counts._jdf.queryExecution().toString()
    assert {tuple(r) for r in counts.collect()} == {("a", 3, 1, 2), ("b", 0, 0, 0), ("c", 0, 0, 0), ("d", 0, 0, 0)}
    assert [tuple(r) for r in edges.collect()] == [("x", "r", "y", "a")] and extraction.proposed(replies).count() == 3

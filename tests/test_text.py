from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sections_and_headings(spark):
    s = one(spark, T.sections(F.lit("intro\n## A\nbody a\n### not\n##  B  \nbody b")))
    assert [(x.heading, x.text.strip()) for x in s] == [(None, "intro"), ("A", "body a\n### not"), ("B", "body b")]
    assert one(spark, T.sections(F.lit("  \n"))) == []
    assert [x.heading for x in one(spark, T.sections(F.lit("## A\n")))] == ["A"]


def test_packing_overlaps_and_never_splits(spark):
    paras = [" ".join(f"w{p}_{i}" for i in range(60)) for p in range(6)]
    notes = spark.createDataFrame([("n", "\n\n".join(paras)), ("empty", ""), ("long", "x " * 700), ("headed", "## One\n\na b\n\n## None\n\n## Two\n\nc")], "note_id string, body string")
    rows = sorted(T.chunks(notes).collect(), key=lambda r: (r.note_id, r.chunk_idx))
    by = {n: [r for r in rows if r.note_id == n] for n in ("n", "empty", "long", "headed")}
    assert [r.n_words for r in by["n"]] == [240, 170] and [r.chunk_id for r in by["n"]] == ["n::0", "n::1"]
    assert by["n"][1].text.split()[:50] == by["n"][0].text.split()[-50:]
    assert by["empty"] == [] and [r.n_words for r in by["long"]] == [700]
    assert [(r.chunk_idx, r.heading, r.text) for r in by["headed"]] == [(0, "One", "a b"), (1, "Two", "c")]


def test_tokens_keep_punctuation(spark):
    assert one(spark, T.tokens(F.lit(" The fox,  the FOX.\n"))) == ["the", "fox,", "the", "fox."]
    assert one(spark, T.token_set(F.lit("A bc, bc d2 x"))) == ["bc", "d2"]
    assert one(spark, T.normal_entity(F.lit("\t Big   Sky\n"))) == "big sky"


def test_citations_with_noise(spark):
    cited = one(spark, T.citations(F.lit("a [my-note::0] b [​citation: x‐y::12 ] c [no] d–e")))
    assert cited == ["my-note::0", "x-y::12"]
    assert one(spark, F.size(T.citation_parts(F.lit("a [n::0] b [n::1]")))) == 3


def test_exact_tokens_json_and_mentions(spark):
    assert [one(spark, T.has_exact_token(F.lit(t))) for t in ('say "it"', "use --top", "the RRF way", "A plain one")] == [True, True, True, False]
    assert one(spark, T.json_of(F.lit('so: {"a": 1} ok'))) == '{"a": 1}' and one(spark, T.json_of(F.lit("none"))) is None
    p = T.mention_pattern(F.lit("new york"))
    assert [one(spark, T.mentions(F.lit(t), p)) for t in ("In New-York now", "in new  york", "renew york", "a.b")] == [True, True, False, False]
    assert one(spark, T.mentions(F.lit("a.b c"), T.mention_pattern(F.lit("a.b")))) and not one(spark, T.mentions(F.lit("axb"), T.mention_pattern(F.lit("a.b"))))


def test_exact_tokens_end_at_letters_beyond_ascii(spark):
    assert [one(spark, T.has_exact_token(F.lit(t))) for t in ("tz. SSö tz", "éAB", "xAB", "AB_")] == [True, True, False, False]

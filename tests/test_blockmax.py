"""The stored index against the plain search, which scores every document."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import blockmax, lineage, sparse


def texts(rng, n, vocabulary=400):
    """Words by a steep law: the first in most texts, most in few."""
    words = [f"w{i}" for i in range(vocabulary)]
    weight = [1 / (i + 1) for i in range(vocabulary)]
    return [" ".join(rng.choices(words, weight, k=rng.choice([0, 3, 20, 60]))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = [(7 * i - 900, f"all {t}" if i % 2 else t) for i, t in enumerate(texts(rng, 500))] + [(9999, None), (10000, "   ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    return docs, blockmax.build(docs, span=4), sparse.build(docs).cache()


def listed(rows):
    return sorted((r.query_id, r.rank, r.doc_id, r.score) for r in rows.collect())


@pytest.mark.parametrize("k", [5, 40])
def test_equal_to_the_plain_search(spark, corpus, k):
    docs, index, plain = corpus
    rng = random.Random(k)
    asked = [(i, t) for i, t in enumerate(texts(rng, 40))] + [(100, "w0"), (101, "all"), (102, "all w3 w3 w90"), (103, "nothing known"), (104, ""), (105, None), (106, "w0 w1 w2 w3 w4 w399 w398")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    want = listed(sparse.search(plain, queries, k).select("query_id", "rank", "doc_id", "score"))
    assert listed(blockmax.search(index, queries, k, first=2)) == want
    assert listed(blockmax.search(index, queries, k, prune=False)) == want
    assert listed(sparse.search_texts(docs, queries, k)) == want


def test_a_word_that_all_documents_hold(spark):
    """Its weight is a share of the mean; every document is a hit, and few blocks tell the best."""
    rows = [(i, "everywhere " * (1 + i % 5) + f"own{i}" + " pad" * (i % 17)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index, plain = blockmax.build(docs, span=8), sparse.build(docs)
    queries = spark.createDataFrame([(1, "everywhere"), (2, "everywhere own77"), (3, "own5 own6 pad everywhere")], "query_id long, text string")
    for k in (3, 30):
        assert listed(blockmax.search(index, queries, k, first=1)) == listed(sparse.search(plain, queries, k).select("query_id", "rank", "doc_id", "score"))


def test_numbers_of_the_index(corpus):
    docs, index, plain = corpus
    told = plain.corpus.first()
    assert (index.n, index.avgdl) == (told.n, pytest.approx(told.avgdl)) and (index.avg_idf, index.eps) == pytest.approx((told.avg_idf, told.eps))
    assert sorted((r.term, r.df, round(r.idf, 9)) for r in index.terms.collect()) == sorted((r.term, r.df, round(r.idf, 9)) for r in plain.terms.collect())
    assert sorted(map(tuple, index.lengths.collect())) == sorted(map(tuple, plain.lengths.collect()))
    rows = index.blocks.selectExpr("n", "size(posts) AS held", "term", "block").collect()
    assert all(r.n == r.held for r in rows) and max(r.n for r in rows) < 40  # about 4 each
    assert len({(r.term, r.block) for r in rows}) == len(rows)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_question_reads_its_words_files_alone(spark, corpus):
    _, index, _ = corpus
    needed = spark.createDataFrame([(1, "w5", 0, 1.0, 1.0)], "query_id long, term string, block long, weight double, top double")
    words = needed.select("term")
    pruned = blockmax._of_words(index.blocks, index, words)
    (bucket,) = {r.bucket for r in index.terms.where("term = 'w5'").collect()}
    files = {r.f for r in pruned.selectExpr("input_file_name() AS f").distinct().collect()}
    assert files and all(f"/bucket={bucket}/" in f for f in files)
    assert "PartitionFilters: [isnotnull(bucket" in plan(pruned) or "PartitionFilters: [bucket" in plan(pruned)
    text = plan(blockmax._postings(pruned, needed.checkpoint(), index))
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_numbers_of_blocks_are_read_without_postings(spark, corpus):
    _, index, _ = corpus
    text = plan(blockmax._of_words(index.blocks, index, spark.createDataFrame([("w5",)], "term string")).select("term", "block", "peak"))
    assert "posts" not in text.split("ReadSchema")[1]


def test_common_blocks_are_skipped(spark, monkeypatch):
    """A rare word and one of all documents: postings of the common word are read for few blocks."""
    rows = [(i, "common " * (1 + i % 3) + ("rare " * 5 if i % 200 == 0 else f"x{i % 50} y{i % 41}")) for i in range(2000)]
    index = blockmax.build(spark.createDataFrame(rows, "doc_id long, text string"), span=8)
    read = []
    whole = blockmax._postings
    monkeypatch.setattr(blockmax, "_postings", lambda blocks, needed, index: read.append(needed.count()) or whole(blocks, needed, index))
    got = blockmax.search(index, spark.createDataFrame([(1, "rare common")], "query_id long, text string"), 5, first=1)
    assert got.count() == 5 and all(r.doc_id % 200 == 0 for r in got.collect())
    every = index.blocks.where("term = 'common'").count()
    assert every > 100 and sum(read) < every / 3


def test_many_words_and_large_lists(spark, corpus, monkeypatch):
    """Beyond NAMED words and SENT rows, buckets are read and joins shuffle; the results are the same."""
    _, index, plain = corpus
    monkeypatch.setattr(blockmax, "NAMED", 3)
    monkeypatch.setattr(lineage, "SENT", 0)
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts(random.Random(5), 10))], "query_id long, text string")
    assert listed(sparse.search_texts(corpus[0], queries, 5)) == listed(blockmax.search(index, queries, 5)) == listed(sparse.search(plain, queries, 5).select("query_id", "rank", "doc_id", "score"))


def test_empty_and_unfinished(spark, tmp_path):
    index = blockmax.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "a"))
    assert blockmax.search(index, spark.createDataFrame([(1, "x")], "query_id long, text string")).count() == 0
    again = blockmax.open_index(spark, str(tmp_path / "a"))
    assert again.n == 0
    with pytest.raises(Exception, match="index"):
        blockmax.open_index(spark, str(tmp_path / "b"))


def test_a_batch_shuffles_each_posting_once(spark):
    posts = spark.createDataFrame([(d, t, 1.0 / (1 + d % 7 + len(t))) for d in range(3000) for t in ("a", "bb")], "doc_id long, term string, part double")
    weight = spark.createDataFrame([(q, t, w) for q in range(40) for t, w in (("a", 1.0), ("bb", -2.0 if q == 7 else 0.5))], "query_id long, term string, weight double")
    hits = sparse.best_of(posts, weight, 4).collect()
    best = {}
    for r in sorted(hits, key=lambda r: (-r.score, r.doc_id)):
        best.setdefault(r.query_id, []).append((r.doc_id, r.score))
    part = lambda d, n: 1.0 / (1 + d % 7 + n)
    for q in range(40):
        every = sorted(((-round(part(d, 1) + (-2.0 if q == 7 else 0.5) * part(d, 2), 6), d) for d in range(3000)))
        assert [(d, round(-s, 6)) for s, d in every[:4]] == [(d, round(s, 6)) for d, s in best[q][:4]]
    assert len(best[7]) == 3000  # all that aren't above 0 are told
    assert len(hits) - 3000 <= 39 * 4 * 16  # not a row for each of the 120,000 pairs


def test_frequencies_without_postings(spark):
    docs = spark.createDataFrame([(1, "a b A"), (2, "b"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.term: r.df for r in sparse.text_frequencies(docs).collect()} == {"a": 1, "b": 2}


def test_words_told_by_numbers_give_what_their_names_give(spark):
    posts = spark.createDataFrame([(d, w, 1.0 + d / 10) for d in range(30) for w in range(6) if (d + w) % 4], "doc_id long, term long, part double")
    weight = spark.createDataFrame([(q, w, 0.5 + q - w) for q in range(3) for w in (0, 2, 5, 9)], "query_id long, term long, weight double")
    named = [x.withColumn("term", F.concat(F.lit("w"), F.col("term").cast("string"))) for x in (posts, weight)]
    got, want = (sorted(map(tuple, sparse.best_of(p, w, 4).collect())) for p, w in ((posts, weight), named))
    assert got == want and {r[0] for r in got} == {0, 1, 2}


def test_documents_without_words_count_in_all_numbers(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "a a c")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "c a")], "query_id long, text string")
    assert list(map(tuple, sparse.search_texts(docs, q, 4).collect())) == list(map(tuple, sparse.search(sparse.build(docs), q, 4).collect()))
    assert sparse.search_texts(docs.limit(0), q, 4).collect() == []


def test_words_are_counted_where_documents_lie(spark):
    import pyarrow as pa

    rows = [(5, ["b", "a", "b"]), (None, []), (7, ["ä"] * 3 + ["a"]), (8, [])]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["doc_id", "w"])
    got = [tuple(r.values()) for b in blockmax._counted(iter([batch, batch.slice(0, 0), batch.slice(1, 1)])) for r in b.to_pylist()]
    assert sorted(got, key=repr) == sorted([(5, 3, "a", 1), (5, 3, "b", 2), (7, 4, "a", 1), (7, 4, "ä", 3), (None, 0, None, 1), (8, 0, None, 1), (None, 0, None, 1)], key=repr)

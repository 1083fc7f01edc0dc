"""BM25 over an inverted index: build and batch search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import text as T
from tessera.operators.lineage import cut, sent, stored

#: Queries of a tile, about, and postings and documents of a block, at most.
QUERIES, POSTINGS, DOCUMENTS = 256, 50_000, 1024


@dataclass(frozen=True)
class SparseIndex:
    """lengths(doc_id, dl), postings(doc_id, term, tf), terms(term, df, idf), corpus(n, avgdl, eps)."""

    lengths: DataFrame
    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame

    def cache(self) -> SparseIndex:
        """Keeps the tables that several searches share; they spill to disk rather than recompute."""
        return SparseIndex(*(x.persist() for x in (self.lengths, self.postings, self.terms, self.corpus)))


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf): one shuffle, combined on the map side."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(T.tokens(F.col(text))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def text_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) of docs(text), each a document of its own: without postings, one shuffle of counts."""
    return docs.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))


def idf_table(df: DataFrame, stats: DataFrame, epsilon: float = config.BM25_EPSILON) -> tuple[DataFrame, DataFrame]:
    """(term, df, raw, idf) and (avg_idf, eps). The average is over all raw values, negative ones too; these then become epsilon times it."""
    raw = df.crossJoin(F.broadcast(stats.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw").alias("avg_idf")).withColumn("eps", F.col("avg_idf") * epsilon)
    table = raw.crossJoin(F.broadcast(mean)).select("term", "df", "raw", F.when(F.col("raw") < 0, F.col("eps")).otherwise(F.col("raw")).alias("idf"))  # one row
    return table, mean


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", epsilon: float = config.BM25_EPSILON) -> SparseIndex:
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    posts = postings(docs)
    lengths = docs.select("doc_id", F.size(T.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("dl"))
    stats = corpus_stats(lengths)
    terms, mean = idf_table(document_frequencies(posts), stats, epsilon)
    return SparseIndex(lengths, posts, terms, stats.crossJoin(F.broadcast(mean)))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term, qtf): each occurrence of a query's word counts."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(T.tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def scores(index: SparseIndex, queries: DataFrame, k1: float = config.BM25_K1, b: float = config.BM25_B, digits: int = config.SCORE_DIGITS) -> DataFrame:
    """(query_id, doc_id, score) of the documents that share a word with a query; scores are rounded, so that ties don't hang on the order of summing."""
    weight = query_terms(queries).join(index.terms.select("term", "idf"), "term")
    hits = index.postings.join(weight, "term").join(index.lengths, "doc_id").crossJoin(F.broadcast(index.corpus.select("avgdl")))  # one row
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl / F.col("avgdl")))
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), digits).alias("score"))


def search(index: SparseIndex, queries: DataFrame, k: int = config.TOP_K, **options) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query, ties by doc_id.

    queries(query_id, text). Documents without a shared word score 0 and stay eligible, in order of
    doc_id: if a query has fewer than k hits, k of the first 2 k documents are free to fill its list.
    """
    return _ranked(scores(index, queries, **options), queries, index.lengths, k)


def _ranked(hits: DataFrame, queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    first = documents.select("doc_id").orderBy("doc_id").limit(2 * k)  # 2 k rows
    rest = queries.select("query_id").crossJoin(F.broadcast(first)).join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_texts(docs: DataFrame, queries: DataFrame, k: int = config.TOP_K, k1: float = config.BM25_K1, b: float = config.BM25_B, epsilon: float = config.BM25_EPSILON, digits: int = config.SCORE_DIGITS) -> DataFrame:
    """As ``search``, of docs(doc_id, text) that no index holds, for one batch of queries.

    Nothing is indexed: of the texts' words only those that queries ask for become postings, where the
    texts are read, and only these are shuffled; of the others, which the mean weight depends on, counts.
    Texts are read twice: for all counts, and for postings.
    """
    asked = cut(query_terms(queries))
    words = docs.select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    ends = F.array_append(F.array_distinct("w"), F.lit(None).cast("string"))  # null, which no word is, stands for the document itself
    counts = cut(words.select(F.size("w").alias("dl"), F.explode(ends).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("total")))
    n, total = counts.where("term IS NULL").select("df", "total").first() or (0, 0)
    avgdl = total / n if n else 0.0
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = counts.where("term IS NOT NULL").select("term", "df", raw.alias("raw"))
    eps = (df.agg(F.avg("raw")).first()[0] or 0.0) * epsilon
    idf = F.when(F.col("raw") < 0, F.lit(eps)).otherwise(F.col("raw"))
    weight = cut(df.join(sent(asked), "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight")))
    terms = sent(told_by_number(weight))
    weight = cut(weight.join(terms, "term").select("query_id", F.col("word").alias("term"), "weight"))
    tf, dl = F.col("tf"), F.col("dl")
    part = tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl / F.lit(avgdl)))
    posts = words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(terms, "term").groupBy("doc_id", "dl", "word").agg(F.count("*").alias("tf"))
    posts = posts.select("doc_id", F.col("word").alias("term"), part.alias("part"))
    if numbered(docs, "doc_id") and numbered(queries, "query_id"):
        hits = best_of(posts, weight, max(k, 0), digits)
    else:
        hits = posts.join(sent(weight), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("part")), digits).alias("score"))
    return _ranked(cut(hits), queries, docs, k)


def numbered(rows: DataFrame, name: str) -> bool:
    """Whether an id is a whole number, as ``best_of`` takes them."""
    return rows.schema[name].dataType.typeName() in ("byte", "short", "integer", "long")


def told_by_number(weight: DataFrame) -> DataFrame:
    """(term, word): a number for each different word of weight(term), cut."""
    return cut(weight.select("term").distinct().withColumn("word", F.monotonically_increasing_id()))


def best_of(posts: DataFrame, weight: DataFrame, k: int, digits: int = config.SCORE_DIGITS) -> DataFrame:
    """(query_id, doc_id, score): of each query the k best of the documents that share a word with it, ties by doc_id, and others.

    posts(doc_id long, term, part), weight(query_id long, term, weight). Terms that aren't numbers yet are
    told by them, which tasks look up without making an object of each. A posting is shuffled once,
    however many queries ask for its word: documents form blocks, queries tiles, a meeting of the two is
    a matrix product, and only k rows of it for each query go on. So what is shuffled, and what a task
    holds, doesn't depend on the number of pairs that share a word.
    """
    if not numbered(posts, "term"):
        names = sent(told_by_number(weight))
        posts, weight = (x.join(names, "term").drop("term").withColumnRenamed("word", "term") for x in (posts, weight))
    kind = posts.schema["doc_id"].dataType
    many = max(1, -(-weight.select("query_id").distinct().count() // QUERIES))
    tile = F.pmod(F.xxhash64("query_id"), F.lit(many)).cast("int").alias("tile")
    groups = weight.groupBy(tile).agg(F.collect_list(F.struct("query_id", "term", "weight")).alias("q"))  # the words of about QUERIES queries
    asked = stored(groups.select("tile", F.col("q.query_id").cast("array<long>").alias("query_ids"), F.col("q.term").alias("asked"), F.col("q.weight").alias("weights")), "queries")
    dealt = posts.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "term", "part").repartition("doc_id").sortWithinPartitions("doc_id")
    blocks = dealt.mapInArrow(_blocked, "ids array<long>, words array<long>, parts array<double>").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, query_ids, names, matrix = None, None, None, None
        for b in batches:
            for i in range(b.num_rows):
                get = lambda n: b.column(b.schema.get_field_index(n))[i]  # noqa: E731,B023
                if (t := get("tile").as_py()) != at:
                    at = t
                    query_ids, row = np.unique(get("query_ids").values.to_numpy(zero_copy_only=False), return_inverse=True)
                    names, column = np.unique(get("asked").values.to_numpy(zero_copy_only=False), return_inverse=True)
                    matrix = np.zeros((len(names), len(query_ids)))
                    matrix[column, row] = get("weights").values.to_numpy(zero_copy_only=False)
                words = get("words").values.to_numpy(zero_copy_only=False)
                where = np.minimum(np.searchsorted(names, words), len(names) - 1)
                own = names[where] == words
                ids, doc = np.unique(get("ids").values.to_numpy(zero_copy_only=False)[own], return_inverse=True)
                if not len(ids):
                    continue
                used, word = np.unique(where[own], return_inverse=True)
                parts = get("parts").values.to_numpy(zero_copy_only=False)[own]
                held = np.bincount(doc * len(used) + word, parts, len(ids) * len(used)).reshape(len(ids), -1)
                raw = matrix[used].T @ held.T
                met = (matrix[used].T != 0).astype(np.float32) @ (held.T != 0).astype(np.float32) > 0
                score = np.where(met, np.round(raw, digits), -np.inf)
                if k < score.shape[1]:  # ids ascend, so the first of equal ones are those of smaller ids
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                else:
                    best = np.broadcast_to(np.arange(score.shape[1]), score.shape)
                kept = np.zeros_like(met)
                np.put_along_axis(kept, best, True, axis=1)
                q, d = np.nonzero(met & (kept | (score <= 0)))  # those not above 0 too, as they must not pass for documents without a hit
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids[d]), pa.array(raw[q, d])], schema=schema)

    found = blocks.join(asked, "tile").select("tile", "ids", "words", "parts", "query_ids", "asked", "weights").mapInArrow(run, "query_id long, doc_id long, score double")
    return found.select(F.col("query_id").cast(weight.schema["query_id"].dataType).alias("query_id"), F.col("doc_id").cast(kind).alias("doc_id"), F.round("score", digits).alias("score"))


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (doc_id, word, part) in order of doc_id as blocks of whole documents: (ids, words, parts), a value for each posting."""
    kinds = (pa.int64(), pa.int64(), pa.float64())
    schema = pa.schema([(n, pa.list_(t)) for n, t in zip(("ids", "words", "parts"), kinds, strict=True)])

    def packed(columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(t)) for x, t in zip(columns, kinds, strict=True)], schema=schema)

    rest: list[pa.Array] | None = None
    for b in batches:
        columns = [pa.concat_arrays([x, y.cast(x.type)]) for x, y in zip(rest, b.columns, strict=True)] if rest else list(b.columns)
        ids = columns[0].to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        begin = 0
        while True:
            later = edges[edges > begin]
            if not len(later):
                break
            ends = later[: DOCUMENTS]
            end = int(max(ends[ends <= begin + POSTINGS], default=ends[0]))
            if len(later) < DOCUMENTS and len(ids) - begin < POSTINGS:
                break  # more of the same block may follow
            yield packed([x.slice(begin, end - begin) for x in columns])
            begin = end
        rest = [x.slice(begin) for x in columns]
    if rest and len(rest[0]):
        yield packed(rest)

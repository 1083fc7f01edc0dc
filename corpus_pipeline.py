"""Corpus pipeline: five training-data stages from ``documents`` to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``, further columns
included, whatever their names. Documents without doc_id, which no decision can name, leave at the
second stage. Rows that repeat a doc_id share its fate: decisions are made by id, but the mix deals out
copies to each row. An empty table passes through as an empty table; null and empty texts aren't toxic,
have no lines and no shingles, and leave at the mix, which takes only words.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common as c

TRAIN_ROWS = 5000
#: The last stages: copies of up to MOST, targets of SHARE of all words, sequences of CAPACITY tokens.
WEIGHTS, SHARE, MOST, CAPACITY = (5, 2, 1), 1.5, 2.0, 4096
TOKENIZER = "word_bpe_49k.json"


def _with(docs: DataFrame, decided: DataFrame, how: str = "left_semi") -> DataFrame:
    return docs.join(decided.select("doc_id"), "doc_id", how).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score is 0.5 or more, in any row of their id; a score of exactly 0.5 goes."""
    from tessera.llm.toxicity import fit, toxicity

    scored = toxicity(docs, fit(docs, c.table(spark, sf_dir, "labels"), train_rows=TRAIN_ROWS))
    return _with(docs, c.checkpoint(scored.where("predicted = 1").select("doc_id").distinct()), "left_anti")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes the blocks of lines that a later document shares with an earlier one; documents that lose all go. Of equal texts the smallest doc_id stays."""
    from tessera.llm.line_alignment import deduplicated

    return deduplicated(docs.where("doc_id IS NOT NULL"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of the smallest doc_id, of each group of near duplicates: five-word shingles, similarity 0.8."""
    from tessera.llm.ngram_join import jaccard_components

    groups = jaccard_components(docs, n=5, num=80)
    return _with(docs, c.checkpoint(groups.where("doc_id = component_id").select("doc_id").distinct()))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as many times as the mix does; a document that it takes twice comes as two equal rows. Rows of one doc_id are dealt its copies in the order of their texts' hashes."""
    from tessera.llm.mixing import entropy_mix

    mixed = entropy_mix(docs, WEIGHTS, SHARE, MOST).groupBy("doc_id").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    names = [f"c{i}" for i in range(len(docs.columns))]
    ids, text = (names[docs.columns.index(n)] for n in ("doc_id", "text"))
    place = F.row_number().over(Window.partitionBy(ids).orderBy(F.xxhash64(text))) - 1
    rows = docs.toDF(*names).join(mixed.withColumnRenamed("doc_id", "__id"), F.col(ids).eqNullSafe(F.col("__id"))).withColumn("__place", place)
    own = F.expr("((__place + 1) * copies) div rows - (__place * copies) div rows")
    dealt = rows.withColumn("__copies", own).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return dealt.select(*names).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; returns a row for each piece. Each row is a document of its own; ties go by doc_id."""
    import public_tokenizers

    from tessera.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path(TOKENIZER), CAPACITY)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't train the network of the first stage, nor tokenize for the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written beside the checkpoints, which all executors share."""
    sc = spark.sparkContext
    c.checkpoint(spark.range(1))  # makes sure that there is a checkpoint folder
    folder = f"{sc._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = c.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

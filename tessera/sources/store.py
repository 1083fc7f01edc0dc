"""Versioned tables under one manifest, vector files, traces, questions and exports.

Tables of a build are written under ``build=<id>/``; a version of the manifest, added last, makes them
visible. A reader sees the newest complete build or none, never a mixture of two.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.trace import TRACE, checked

MANIFEST = "build_id string, table string, n_rows long, requires string, published_at timestamp, version int"
_BUILD = re.compile(r"[0-9a-f]{64}")


class IntegrityError(ValueError):
    """Artifacts that don't belong together, or aren't what they claim."""


def valid_build(build_id: str) -> str:
    if not _BUILD.fullmatch(build_id or ""):
        raise IntegrityError(f"not a build id: {build_id!r}")
    return build_id


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the manifest's versions; none if there is no manifest yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def publish(tables: dict[str, DataFrame], folder: str, build_id: str, requires: str | None = None) -> None:
    """Writes every table, counts what was written, then adds one version to the manifest.

    The version's number is the next after the newest when the publishing began. If another publisher
    has taken it meanwhile, this one fails, and what it wrote stays unseen. requires: the build that
    these tables were made from, and that may only be opened with them.
    """
    valid_build(build_id)
    spark = next(iter(tables.values())).sparkSession
    number = max(_versions(spark, folder), default=0) + 1
    rows = []
    for name, df in sorted(tables.items()):
        path = f"{folder}/build={build_id}/{name}"
        df.write.mode("overwrite").parquet(path)
        rows.append((build_id, name, spark.read.parquet(path).count(), requires and valid_build(requires)))
    done = spark.createDataFrame(rows, "build_id string, table string, n_rows long, requires string").withColumn("published_at", F.current_timestamp())
    try:
        done.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/manifest/version={number}")
    except AnalysisException as e:
        raise IntegrityError(f"another build was published while {build_id} was written") from e


def open_build(spark: SparkSession, folder: str, tables: list[str], build_id: str | None = None) -> dict[str, DataFrame]:
    """The tables of a build, by default the newest that has them all. Row counts must be those published."""
    return _opened(spark, folder, tables, build_id)[0]


def _opened(spark: SparkSession, folder: str, tables: list[str], build_id: str | None = None) -> tuple[dict[str, DataFrame], str, str | None]:
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").where(F.col("table").isin(tables))
    if build_id is not None:
        manifest = manifest.where(F.col("build_id") == valid_build(build_id))
    last = manifest.groupBy("build_id", "table").agg(F.max_by("n_rows", "version").alias("n_rows"), F.max("version").alias("version"), F.max_by("requires", "version").alias("requires"))
    whole = last.groupBy("build_id").agg(F.count("*").alias("n"), F.max("version").alias("at"), F.max("requires").alias("requires"), F.map_from_entries(F.collect_list(F.struct("table", "n_rows"))).alias("rows")).where(F.col("n") == len(set(tables)))
    newest = whole.orderBy(F.desc("at"), "build_id").first()
    if newest is None:
        raise IntegrityError(f"no build in {folder} has {', '.join(tables)}")
    out = {}
    for name in tables:
        out[name] = spark.read.parquet(f"{folder}/build={newest.build_id}/{name}")
        if (n := out[name].count()) != newest.rows[name]:
            raise IntegrityError(f"{name} of {newest.build_id} has {n} rows, not {newest.rows[name]}")
    return out, newest.build_id, newest.requires


GRAPH = ("entities", "edges", "communities")


def publish_graph(graph: dict[str, DataFrame], folder: str, build_id: str, chunks_build: str) -> None:
    """Publishes entities(id, chunk_ids, community), edges(src, rel, dst, chunk_id) and communities(id, entity_ids, summary), made from the chunks of chunks_build.

    The chunks must be there, edges may name only their ids, and ends and members only entities.
    """
    if lost := sorted(set(GRAPH) - set(graph)):
        raise IntegrityError(f"a graph needs {', '.join(lost)}")
    spark = graph["edges"].sparkSession
    chunks = open_build(spark, folder, ["chunks"], chunks_build)["chunks"]
    ids, edges = graph["entities"].select("id"), graph["edges"]
    faults = edges.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select(F.concat(F.lit("an edge of unknown chunk "), "chunk_id").alias("why"))
    for end in ("src", "dst"):
        faults = faults.unionByName(edges.select(F.col(end).alias("id")).join(ids, "id", "left_anti").select(F.concat(F.lit("an edge of unknown entity "), "id").alias("why")))
    members = graph["communities"].select(F.explode("entity_ids").alias("id"))
    faults = faults.unionByName(members.join(ids, "id", "left_anti").select(F.concat(F.lit("a member that is no entity, "), "id").alias("why")))
    if bad := [r.why for r in faults.limit(5).collect()]:
        raise IntegrityError("; ".join(sorted(bad)))
    publish({t: graph[t] for t in GRAPH}, folder, build_id, requires=chunks_build)


def open_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The newest graph with its chunks. If chunks have been built anew since, the graph is out of date and an error."""
    graph, build, made_from = _opened(spark, folder, list(GRAPH))
    chunks, newest, _ = _opened(spark, folder, ["chunks"])
    if made_from is None:
        raise IntegrityError(f"graph {build} doesn't tell which chunks it was made from")
    if made_from != newest:
        raise IntegrityError(f"graph {build} was made from chunks {made_from}, the newest are {newest}")
    return graph | chunks


def build_mismatches(artifacts: DataFrame, expected: DataFrame) -> DataFrame:
    """(artifact, problem): missing, of another build, or of another row count. Both are (artifact, build_id, n_rows)."""
    e = expected.select("artifact", F.col("build_id").alias("want_build"), F.col("n_rows").alias("want_rows"))
    j = e.join(artifacts, "artifact", "left")
    problem = F.when(F.col("build_id").isNull(), "missing").when(F.col("build_id") != F.col("want_build"), "another build").when(F.col("n_rows") != F.col("want_rows"), "another row count")
    return j.select("artifact", problem.alias("problem")).where("problem IS NOT NULL")


def encode_vectors(build_id: str, matrix: bytes, magic: bytes) -> bytes:
    """A vector file: magic, build id, newline, raw float32 rows."""
    return magic + valid_build(build_id).encode() + b"\n" + matrix


def decode_vectors(raw: bytes, dims: int, magic: bytes) -> tuple[str, list[list[float]]]:
    """(build id, rows) of a vector file."""
    head = len(magic) + 65
    if not raw.startswith(magic) or len(raw) < head or raw[head - 1 : head] != b"\n":
        raise IntegrityError("not a vector file")
    body = raw[head:]
    if len(body) % (4 * dims):
        raise IntegrityError(f"{len(body)} bytes are no whole rows of {dims} values")
    flat = struct.unpack(f"<{len(body) // 4}f", body)
    return valid_build(raw[len(magic) : head - 1].decode("ascii", "replace")), [list(flat[i : i + dims]) for i in range(0, len(flat), dims)]


def read_vectors(spark: SparkSession, path: str, dims: int, magic: bytes) -> DataFrame:
    """(build_id, row, embedding) of vector files; import only, the engine's own vectors are Parquet."""
    schema = pa.schema([("build_id", pa.string()), ("row", pa.int32()), ("embedding", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                build, rows = decode_vectors(raw, dims, magic)
                for i in range(0, max(len(rows), 1), 10_000):
                    part = rows[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([build] * len(part)), pa.array(range(i, i + len(part)), pa.int32()), pa.array(part, schema.field(2).type)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "build_id string, row int, embedding array<float>")


def read_traces(spark: SparkSession, path: str, variant: bool = False) -> DataFrame:
    """Traces, one JSON document per file; payloads as JSON text, or as variants."""
    schema = TRACE.replace("payload string", "payload variant") if variant else TRACE
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def write_traces(traces: DataFrame, path: str) -> None:
    """Checked traces by architecture; a malformed one fails the write."""
    checked(traces).write.mode("overwrite").partitionBy("architecture").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, type, gold_chunk_ids, gold_answer_points) from JSON, a list or a line each."""
    return spark.read.schema("id string, question string, type string, gold_chunk_ids array<string>, gold_answer_points array<string>").option("multiLine", True).json(path)


def read_yaml_questions(spark: SparkSession, path: str) -> DataFrame:
    """As read_questions, from YAML: a list of mappings of plain, quoted and block scalars, and lists of these."""
    from tessera.sources.yaml_lists import records

    names = ["id", "question", "type", "gold_chunk_ids", "gold_answer_points"]
    kinds = "id string, question string, type string, gold_chunk_ids array<string>, gold_answer_points array<string>"
    lists = pa.list_(pa.string())
    schema = pa.schema([(n, lists if n.startswith("gold") else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                rows = records(text)
                told = lambda r, n: [str(x) for x in r.get(n) or []] if n.startswith("gold") else r.get(n)
                yield pa.RecordBatch.from_arrays([pa.array([told(r, n) for r in rows], schema.field(n).type) for n in names], schema=schema)

    return spark.read.text(path, wholetext=True).select("value").mapInArrow(run, kinds)


def public_questions(questions: DataFrame) -> DataFrame:
    """What may be shown: no gold."""
    return questions.select("id", "question", "type")


def export(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Replaces each table's JSON export; returns what was written."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
    return sorted(tables)


def replace_all(old: DataFrame, new: DataFrame, problems: DataFrame, path: str) -> None:
    """Writes new in place of old only if there are no problems; else nothing is written."""
    bad = problems.limit(5).collect()
    if bad:
        raise IntegrityError("; ".join(json.dumps(r.asDict(), default=str) for r in bad))
    new.write.mode("overwrite").parquet(path)

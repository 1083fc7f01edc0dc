"""Markdown notes with a header between ``---`` lines, and the checks of a note corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import text as T

NOTE = "note_id string, title string, tags array<string>, entities array<string>, created string, body string"
_KEY = re.compile(r"^([A-Za-z_][\w-]*):\s*(.*)$")


def _scalar(raw: str) -> str | None:
    raw = raw.strip()
    if raw in ("", "~", "null"):
        return None
    if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'":
        return raw[1:-1]
    return raw


def parse_header(lines: list[str], where: str) -> dict[str, str | list[str] | None]:
    """The header's mapping: scalars, ``[a, b]`` lists and ``- a`` lists. Anything else is an error."""
    out: dict[str, str | list[str] | None] = {}
    key = None
    for line in lines:
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("- ") and key is not None and (out[key] is None or isinstance(out[key], list)):
            items = out[key] if isinstance(out[key], list) else []
            out[key] = [*items, _scalar(line.lstrip()[2:]) or ""]
        elif m := _KEY.match(line):
            key, raw = m[1], m[2].strip()
            out[key] = [x for x in (_scalar(x) for x in re.split(r",(?=(?:[^\"']|\"[^\"]*\"|'[^']*')*$)", raw[1:-1])) if x is not None] if raw.startswith("[") and raw.endswith("]") else _scalar(raw)
        else:
            raise ValueError(f"{where}: the header isn't a mapping at {line!r}")
    return out


def parse_note(name: str, text: str) -> tuple[str, str, list[str], list[str], str, str]:
    """One row of NOTE from a file's stem and text."""
    lines = text.split("\n")
    if not lines or lines[0].strip() != "---":
        raise ValueError(f"{name}: no opening ---")
    end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
    if end is None:
        raise ValueError(f"{name}: no closing ---")
    head = parse_header(lines[1:end], name)

    def strings(field: str) -> list[str]:
        v = head.get(field)
        if v is None:
            return []
        if not isinstance(v, list):
            raise ValueError(f"{name}: {field} must be a list, not {v!r}")
        return v

    return name, str(head.get("title") or ""), strings("tags"), strings("entities"), str(head.get("created") or ""), "\n".join(lines[end + 1 :]).lstrip("\n")


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """NOTE rows of the ``*.md`` files right in a folder; order by note_id where order matters."""
    schema = pa.schema([("note_id", pa.string()), ("title", pa.string()), ("tags", pa.list_(pa.string())), ("entities", pa.list_(pa.string())), ("created", pa.string()), ("body", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse_note(n, t) for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("name"), F.decode("content", "UTF-8").alias("text")).mapInArrow(run, NOTE)


def build_id(spark: SparkSession, folder: str, **settings) -> str:
    """Identity of an index: a hash of every note's path and content, at any depth, and the settings that shape it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)
    rows = files.select(F.concat_ws("\x00", F.regexp_extract("path", re.escape(folder.rstrip("/").rsplit("/", 1)[-1]) + r"/(.+)$", 1), F.sha2("content", 256)).alias("x"))
    whole = rows.agg(F.array_join(F.array_sort(F.collect_list("x")), "\n").alias("x"))  # one line per note file
    chosen = {"target": config.CHUNK_TARGET_WORDS, "overlap": config.CHUNK_OVERLAP_WORDS} | settings
    return whole.select(F.sha2(F.concat_ws("\n", "x", *(F.lit(f"{k}={v}") for k, v in sorted(chosen.items()))), 256)).first()[0]


def corpus_problems(notes: DataFrame) -> DataFrame:
    """(note_id, problem, fatal): missing fields and lists, and bodies outside the word band (not fatal)."""
    n = F.size(T.words(F.col("body")))
    low, high = config.WORD_BAND
    checks = [(F.col(x) == "", f"no {x}", True) for x in ("title", "created")] + [(F.size(x) == 0, f"no {x}", True) for x in ("tags", "entities")] + [((n < low) | (n > high), "word count outside the band", False)]
    found = F.filter(F.array(*(F.when(c, F.struct(F.lit(p).alias("problem"), F.lit(f).alias("fatal"))) for c, p, f in checks)), lambda x: x.isNotNull())
    return notes.select("note_id", F.explode(found).alias("p")).select("note_id", "p.problem", "p.fatal")


def corpus_gate(notes: DataFrame) -> DataFrame:
    """One row: notes, entities, frequent entities, and whether the corpus is large enough."""
    from tessera.operators.graph import note_frequency, vocabulary

    frequent = note_frequency(notes).agg(F.count("*").alias("frequent_entities"))
    return notes.agg(F.count("*").alias("notes")).crossJoin(vocabulary(notes).agg(F.count("*").alias("entities"))).crossJoin(frequent).withColumn("passes", (F.col("notes") >= config.MIN_NOTES) & (F.col("frequent_entities") >= config.MIN_ENTITIES))

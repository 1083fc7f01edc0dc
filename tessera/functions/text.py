"""Text as Columns: sections, paragraphs, packing, tokens, entities, citations and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config

_SPACE = r"(?U)\s+"
_EDGE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without white space at both ends (``trim`` only takes spaces)."""
    return F.regexp_replace(text, _EDGE, "")


def tokens(text: Column) -> Column:
    """Lower-cased words between white space; nothing else is stripped."""
    return F.filter(F.split(F.lower(text), _SPACE), lambda x: x != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda x: x != "")


def token_set(text: Column) -> Column:
    """Distinct runs of ``[a-z0-9]`` of two or more, lower-cased."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda x: F.length(x) > 1))


def normal_entity(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), _SPACE, " ")


def sections(body: Column) -> Column:
    """Array of (heading, text): what precedes the first ``## `` line has no heading and is left out if blank."""
    parts = F.split(body, r"(?m)^##\s+")
    head = F.struct(F.lit(None).cast("string").alias("heading"), F.element_at(parts, 1).alias("text"))
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(strip(F.regexp_extract(p, r"^([^\n]*)", 1)).alias("heading"), F.regexp_replace(p, r"^[^\n]*\n?", "").alias("text")))
    return F.filter(F.concat(F.array(head), rest), lambda s: s["heading"].isNotNull() | (strip(s["text"]) != ""))


def paragraphs(text: Column, delimiter: str = r"\n\s*\n") -> Column:
    return F.filter(F.transform(F.split(text, delimiter), strip), lambda p: p != "")


def pack(parts: Column, target: int = config.CHUNK_TARGET_WORDS, overlap: int = config.CHUNK_OVERLAP_WORDS) -> Column:
    """Greedy chunks of an array of paragraphs.

    A paragraph that would take the current chunk beyond target words closes it; the next one starts
    with its last ``overlap`` words. Paragraphs are never split.
    """
    each = F.transform(parts, words)
    spans = "array<struct<s: int, e: int>>"
    empty = F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.array().cast(spans).alias("done"))

    def step(state: Column, n: Column) -> Column:
        """A chunk is a run of the text's words, [s, e): only numbers are carried along."""
        s, e, done = state["s"], state["e"], state["done"]
        full = (e > s) & (e - s + n > target)
        start = F.when(full, F.greatest(e - overlap, s)).otherwise(s)
        return F.struct(start.alias("s"), (e + n).alias("e"), F.when(full, F.concat(done, F.array(F.struct(s.alias("s"), e.alias("e"))))).otherwise(done).alias("done"))

    def finish(state: Column) -> Column:
        last = F.array(F.struct(state["s"].alias("s"), state["e"].alias("e")))
        return F.when(state["e"] > state["s"], F.concat(state["done"], last)).otherwise(state["done"])

    cuts = F.aggregate(F.transform(each, F.size), empty, step, finish)
    every = F.flatten(each)
    return F.transform(cuts, lambda c: F.array_join(F.slice(every, c["s"] + 1, c["e"] - c["s"]), " "))


def chunks(notes: DataFrame, note_id: str = "note_id", body: str = "body", delimiter: str = r"\n\s*\n", target: int = config.CHUNK_TARGET_WORDS, overlap: int = config.CHUNK_OVERLAP_WORDS) -> DataFrame:
    """(chunk_id, note_id, chunk_idx, heading, text, n_words): indices run over all sections of a note; sections without paragraphs take none."""
    per = F.transform(sections(F.col(body)), lambda s: F.transform(pack(paragraphs(s["text"], delimiter), target, overlap), lambda t: F.struct(s["heading"].alias("heading"), t.alias("text"))))
    rows = notes.select(F.col(note_id).alias("note_id"), F.posexplode(F.flatten(per)).alias("chunk_idx", "c"))
    return rows.select(
        F.concat_ws("::", F.col("note_id").cast("string"), F.col("chunk_idx").cast("string")).alias("chunk_id"), "note_id", "chunk_idx",
        F.col("c.heading").alias("heading"), F.col("c.text").alias("text"), F.size(words(F.col("c.text"))).alias("n_words"),
    )


#: A citation: brackets around an optional label, an id of word characters and hyphens, ``::`` and a number.
CITATION = r"(?i)\[​?\s*(?:citation:)?\s*​?([\w\-‐‑]+::\d+)\s*​?\]"


def citations(text: Column) -> Column:
    """Cited chunk ids in order; unusual hyphens within them become plain."""
    return F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda x: F.translate(x, "‐‑", "--"))


def citation_parts(text: Column) -> Column:
    """Prose between citations, alternating with them: one element more than citations."""
    return F.split(text, CITATION.replace("([", "(?:["))


def has_exact_token(text: Column) -> Column:
    """A quoted string, a long option, or a word of two or more capitals: what keyword search serves best. Words end at other signs than ``[A-Za-z0-9_]``, as in SQL; Java's ``\\b`` would count other letters too."""
    return text.rlike('"[^"]+"') | text.rlike(r"--\w+") | text.rlike(r"(?<!\w)[A-Z]{2,}(?!\w)")


def preview(text: Column, n: int = config.PROMPT_PREVIEW) -> Column:
    return F.substring(text, 1, n)


def excerpt(text: Column, n: int = 100) -> Column:
    """The first n characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n)), F.lit("…"))).otherwise(text)


def trace_id(architecture: Column, question: Column) -> Column:
    return F.concat(architecture, F.lit("::"), F.substring(F.sha2(question, 256), 1, 10))


def cache_key(*parts: Column) -> Column:
    """Key of a completion: backend, model, prompt and parameters."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def mentions(text: Column, pattern: Column) -> Column:
    """Whether the lower-cased text matches a row's own mention pattern (see mention_pattern)."""
    return F.regexp(F.lower(text), pattern)


def mention_pattern(entity: Column) -> Column:
    """Pattern of an entity: its parts between white space or hyphens, joined by either, at word boundaries."""
    return F.concat(F.lit(r"(?U)\b\Q"), F.regexp_replace(entity, r"(?U)[\s\-]+", r"\\E[\\s\\-]+\\Q"), F.lit(r"\E\b"))


def json_of(text: Column) -> Column:
    """The text if it is a JSON object, else its outermost braces if these hold one, else null."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    ok = lambda x: F.get_json_object(x, "$").isNotNull() & x.rlike(r"(?s)^\s*\{.*\}\s*$")
    return F.when(ok(text), text).when(ok(body), body)

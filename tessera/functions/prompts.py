"""Prompts as Columns: what each step of a pipeline asks a language model.

A prompt is an order for one step: the step's kind, the fields that it returns, how the plan goes on from
there, which is what the model has to decide by, and the step's inputs between tags. The texts of the
orders state what our own steps do with the reply.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import config

_SEARCHES = config.MAX_CORRECTIONS + 1
#: For each step: the fields that it returns, and what becomes of them.
ORDERS = {
    "generate_hypothetical": (
        "text",
        f"The text becomes a search vector and is then thrown away. Chunks have {config.CHUNK_TARGET_WORDS} words at most; invent the one that would settle the question, in its own vocabulary. Made-up details do no harm.",
    ),
    "grade": (
        "judgements: chunk_id, verdict, reason, for every chunk in the order given",
        "Chunks marked incorrect are removed before the answer is written. If they outnumber those marked correct, another search is made. Mark correct what you would cite, incorrect what an answer would lose nothing without, and ambiguous all else.",
    ),
    "rewrite": (
        "to, reason",
        f"The next of {_SEARCHES} searches at most is made with the text of `to`, by vectors, over the chunks that the last one saw. The reasons tell what went wrong: steer away from it.",
    ),
    "plan": (
        f"sub_questions: 1 to {config.MAX_SUB_QUESTIONS} strings",
        "Every sub-question is searched for alone, by one of the tools dense, sparse and graph, and sees none of the others. What one search can find stays whole.",
    ),
    "reflect": (
        "sufficient: true or false; reason",
        "With true, the lines below go to the answer. With false, another tool searches once more for the sub-question. Cut lines end in the middle; judge what is there.",
    ),
    "route": (
        "chosen; scores: a number from 0 to 1 under each name; reason",
        "One of these plans is run with the question. Each is given with its searches and its model calls; of those that would bring the passage to light, the cheapest is best.",
    ),
    "triples": (
        "triples: subject, relation, object",
        f"A triple becomes an edge from subject to object, labelled by the relation, with this chunk as evidence. Ends that aren't lines of the vocabulary are discarded, so copy them. Labels longer than {config.RELATION_WORDS} words are hard to draw. Chunks without an edge are common.",
    ),
    "summary": (
        "summary",
        "The summary stands above the chunks as background of answers that touch this group; it is not cited. Two or three sentences on what holds the group together, from its edges and excerpts.",
    ),
    "judge": (
        "point_support: true or false for each point, in order; reads_as_appropriate_refusal: true or false",
        "Shares of supported points are reported as faithfulness, so a point that the answer contradicts or leaves out is false. The second field is about tone: true for an answer that says openly that its sources are silent, also where they aren't.",
    ),
}
#: The plans that a route chooses from, by their searches and model calls.
PLANS = {
    "agentic": f"up to {config.MAX_SUB_QUESTIONS} sub-questions, each searched by one tool or two; 4 to {2 + 2 * config.MAX_SUB_QUESTIONS} calls",
    "corrective": f"1 to {_SEARCHES} vector searches, graded one by one; 2 to {2 * _SEARCHES} calls",
    "graph": f"{config.GRAPH_HOPS} hops over edges from the entities that the question names; 1 call",
    "hybrid": "vectors and literal words, merged and reranked; 1 call",
    "hyde": "one vector search by an invented passage; 2 calls",
    "naive": "one vector search; 1 call",
}
REPLY = "Reply: one JSON object of this shape."
NONE = "none"


def head(step: str) -> str:
    """The step, its fields and what becomes of them."""
    fields, then = ORDERS[step]
    return f"Step: {step}\nReturns: {fields}\n{then}"


def _tag(name: str, value: Column, *attributes: tuple[str, Column]) -> Column:
    opened = [F.lit(f"<{name}")] + [x for k, v in attributes for x in (F.lit(f' {k}="'), v, F.lit('"'))] + [F.lit(">\n")]
    return F.concat(*opened, value, F.lit(f"\n</{name}>"))


def order(step: str, *inputs: Column) -> Column:
    return F.concat_ws("\n", F.lit(head(step)), *inputs)


def lines(items: Column) -> Column:
    items = F.coalesce(items, F.array().cast("array<string>"))
    return F.when(F.size(items) == 0, NONE).otherwise(F.array_join(items, "\n"))


def chunks(hits: Column, width: int | None = None) -> Column:
    """Chunks of an array of structs with chunk_id and text, in order; of each at most width characters."""
    hits = F.coalesce(hits, F.array().cast("array<struct<chunk_id:string,text:string>>")) if width else hits
    one = lambda h: _tag("chunk", F.substring(h["text"], 1, width) if width else h["text"], ("id", h["chunk_id"]))
    return F.when(F.size(hits) == 0, NONE).otherwise(F.array_join(F.transform(hits, one), "\n"))


def hyde(question: Column) -> Column:
    return order("generate_hypothetical", _tag("question", question))


def grading(question: Column, hits: Column) -> Column:
    return order("grade", chunks(hits), _tag("question", question))


def rewrite(query: Column, reasons: Column) -> Column:
    return order("rewrite", _tag("reasons", lines(reasons)), _tag("query", query))


def plan(question: Column) -> Column:
    return order("plan", _tag("question", question))


def reflect(part: Column, hits: Column, width: int = config.PROMPT_PREVIEW) -> Column:
    return order("reflect", chunks(hits, width), _tag("sub_question", part))


def plans() -> str:
    return "\n".join(f"{k} = {v}" for k, v in sorted(PLANS.items()))


def route(question: Column) -> Column:
    return order("route", _tag("plans", F.lit(plans())), _tag("question", question))


def extraction(note_id: Column, heading: Column, text: Column, vocabulary: Column) -> Column:
    shown = F.when(F.coalesce(heading, F.lit("")) == "", NONE).otherwise(heading)
    return order("triples", _tag("vocabulary", lines(vocabulary)), _tag("chunk", text, ("note", note_id), ("heading", shown)))


def community(entities: Column, edges: Column, excerpts: Column, width: int = config.COMMUNITY_EXCERPT) -> Column:
    """edges: array of structs src, rel, dst; excerpts: array of structs chunk_id and text, those without a text left out."""
    drawn = F.transform(edges, lambda e: F.concat(e["src"], F.lit(" | "), e["rel"], F.lit(" | "), e["dst"]))
    some = F.filter(excerpts, lambda x: F.coalesce(x["text"], F.lit("")) != "")
    return order("summary", _tag("members", lines(entities)), _tag("edges", lines(drawn)), chunks(some, width))


def judge(question: Column, answer: Column, points: Column) -> Column:
    numbered = F.transform(points, lambda p, i: F.concat(F.lit("#"), (i + 1).cast("string"), F.lit(" "), p))
    return order("judge", _tag("points", lines(numbered)), _tag("question", question), _tag("answer", answer))


def with_json(prompt: Column, shape: str) -> Column:
    """The prompt with the shape that the reply must have."""
    return F.concat_ws("\n", prompt, F.lit(REPLY), F.lit(shape))

import pytest

from tessera.sources import notes, store, yaml_lists

NOTE = "---\ntitle: A \"b\"\ntags: [x, y]\nentities:\n  - Foo Bar\n  - baz\ncreated: 2024-01-02\n---\n\nBody here.\n"


def test_note_parsing():
    assert notes.parse_note("n", NOTE) == ("n", 'A "b"', ["x", "y"], ["Foo Bar", "baz"], "2024-01-02", "Body here.\n")
    assert notes.parse_note("n", "---\n---\nx") == ("n", "", [], [], "", "x")
    for bad in ("no header", "---\ntitle: x\n", "---\nentities: foo\n---\n", "---\n!!\n---\n"):
        with pytest.raises(ValueError):
            notes.parse_note("n", bad)


def test_corpus_scan_and_build_id(spark, tmp_path):
    (tmp_path / "b.md").write_text(NOTE)
    (tmp_path / "a.md").write_text(NOTE.replace("Foo", "foo"))
    (tmp_path / "c.txt").write_text("no")
    n = notes.read_notes(spark, str(tmp_path))
    assert [r.note_id for r in n.orderBy("note_id").collect()] == ["a", "b"]
    gate = notes.corpus_gate(n).first()
    assert (gate.notes, gate.entities, gate.passes) == (2, 2, False)
    assert {(r.note_id, r.fatal) for r in notes.corpus_problems(n).collect()} == {("a", False), ("b", False)}
    first = notes.build_id(spark, str(tmp_path))
    assert first == notes.build_id(spark, str(tmp_path)) != notes.build_id(spark, str(tmp_path), target=100)
    (tmp_path / "b.md").write_text(NOTE + "!")
    assert notes.build_id(spark, str(tmp_path)) != first


def test_manifest_shows_whole_builds_only(spark, tmp_path):
    one, two, folder = "1" * 64, "2" * 64, str(tmp_path)
    store.publish({"a": spark.range(3), "b": spark.range(2)}, folder, one)
    store.publish({"a": spark.range(5)}, folder, two)
    assert store.open_build(spark, folder, ["a", "b"])["a"].count() == 3
    assert store.open_build(spark, folder, ["a"])["a"].count() == 5
    spark.range(1).write.mode("overwrite").parquet(f"{folder}/build={one}/b")
    for tables, build in ((["a", "b"], None), (["c"], None), (["a"], "no")):
        with pytest.raises(store.IntegrityError):
            store.open_build(spark, folder, tables, build)


def test_build_mismatches(spark):
    have = spark.createDataFrame([("v", "b1", 3), ("s", "b2", 3), ("n", "b1", 2)], "artifact string, build_id string, n_rows long")
    want = spark.createDataFrame([("v", "b1", 3), ("s", "b1", 3), ("n", "b1", 3), ("x", "b1", 1)], "artifact string, build_id string, n_rows long")
    assert {(r.artifact, r.problem) for r in store.build_mismatches(have, want).collect()} == {("s", "another build"), ("n", "another row count"), ("x", "missing")}


def test_vector_files(spark, tmp_path):
    import struct

    magic, build = b"VECTORS-1\n", "a" * 64
    raw = store.encode_vectors(build, struct.pack("<4f", 1, 2, 3, 4), magic)
    assert store.decode_vectors(raw, 2, magic) == (build, [[1, 2], [3, 4]])
    (tmp_path / "v.f32").write_bytes(raw)
    assert store.read_vectors(spark, str(tmp_path / "v.f32"), 2, magic).count() == 2
    for bad, dims in ((raw[1:], 2), (raw, 3), (raw[:20], 2)):
        with pytest.raises(store.IntegrityError):
            store.decode_vectors(bad, dims, magic)


def test_nothing_is_replaced_while_there_are_problems(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(store.IntegrityError):
        store.replace_all(spark.range(1), spark.range(2), spark.createDataFrame([("stale",)], "problem string"), path)
    assert not (tmp_path / "t").exists()
    store.replace_all(spark.range(1), spark.range(2), spark.range(0), path)
    assert spark.read.parquet(path).count() == 2


def test_questions_and_streams(spark, tmp_path):
    from tessera.streaming import ingest

    (tmp_path / "q.json").write_text('[{"id": "q1", "question": "w?", "type": "factual", "gold_chunk_ids": ["a::0"], "gold_answer_points": []}]')
    q = store.read_questions(spark, str(tmp_path / "q.json"))
    assert store.public_questions(q).first().asDict() == {"id": "q1", "question": "w?", "type": "factual"}
    spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string").write.json(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").json(str(tmp_path / "in"))
    ingest.index_stream(docs, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert {(r.doc_id, r.term, r.tf) for r in spark.read.parquet(str(tmp_path / "out/postings")).drop("batch").collect()} == {(1, "a", 2), (1, "b", 1), (2, "b", 1)}


def graph_of(spark, chunk="n::0", end="b", member="a"):
    return {
        "entities": spark.createDataFrame([("a", ["n::0"], 0), ("b", ["n::0"], 0)], "id string, chunk_ids array<string>, community int"),
        "edges": spark.createDataFrame([("a", "r", end, chunk)], "src string, rel string, dst string, chunk_id string"),
        "communities": spark.createDataFrame([(0, [member, "b"], "s")], "id int, entity_ids array<string>, summary string"),
    }


def test_a_graph_is_opened_with_its_own_chunks_only(spark, tmp_path):
    one, two, three, folder = "1" * 64, "2" * 64, "3" * 64, str(tmp_path)
    chunks = spark.createDataFrame([("n::0", "text")], "chunk_id string, text string")
    store.publish({"chunks": chunks}, folder, one)
    with pytest.raises(store.IntegrityError):
        store.open_graph(spark, folder)
    for bad, why in ((graph_of(spark, chunk="n::9"), "unknown chunk"), (graph_of(spark, end="z"), "unknown entity"), (graph_of(spark, member="z"), "no entity"), ({"edges": graph_of(spark)["edges"]}, "needs")):
        with pytest.raises(store.IntegrityError, match=why):
            store.publish_graph(bad, folder, two, one)
    with pytest.raises(store.IntegrityError):
        store.publish_graph(graph_of(spark), folder, two, three)
    store.publish_graph(graph_of(spark), folder, two, one)
    opened = store.open_graph(spark, folder)
    assert set(opened) == {"entities", "edges", "communities", "chunks"} and opened["chunks"].count() == 1
    store.publish({"chunks": chunks}, folder, three)
    with pytest.raises(store.IntegrityError, match="the newest are 333"):
        store.open_graph(spark, folder)
    store.publish_graph(graph_of(spark), folder, "4" * 64, three)
    assert store.open_graph(spark, folder)["edges"].count() == 1
    store.publish(graph_of(spark), folder, "5" * 64)
    with pytest.raises(store.IntegrityError, match="doesn't tell"):
        store.open_graph(spark, folder)


def test_of_two_publishers_at_once_one_fails(spark, tmp_path, monkeypatch):
    folder, seen = str(tmp_path), store._versions(spark, str(tmp_path))
    store.publish({"a": spark.range(3)}, folder, "1" * 64)
    monkeypatch.setattr(store, "_versions", lambda *_: seen)  # began before the first was done
    with pytest.raises(store.IntegrityError, match="another build"):
        store.publish({"a": spark.range(4)}, folder, "2" * 64)
    assert store.open_build(spark, folder, ["a"])["a"].count() == 3


YAML = """# questions
- id: q01
  question: "What does \\"LoRA\\" freeze: a, or b? # no comment"
  type: factual  # a comment
  gold_chunk_ids:
    - a-note::0
    - 'it''s::1'
  gold_answer_points:
    - "one: two"
    - plain - text, with: signs

- id: q02
  question: >-
    A folded
    text.

    Next.
  type: keyword
  gold_chunk_ids: [x::0, "y, z::1"]
  gold_answer_points: []
- id: q03
  question: |
    kept
      as it is
  type: unanswerable
  gold_chunk_ids:
  gold_answer_points:
  - flush left
"""


def test_yaml_questions(spark, tmp_path):
    (tmp_path / "q.yaml").write_text(YAML)
    rows = store.read_yaml_questions(spark, str(tmp_path / "q.yaml")).collect()
    assert [tuple(r) for r in rows] == [
        ("q01", 'What does "LoRA" freeze: a, or b? # no comment', "factual", ["a-note::0", "it's::1"], ["one: two", "plain - text, with: signs"]),
        ("q02", "A folded text.\nNext.", "keyword", ["x::0", "y, z::1"], []),
        ("q03", "kept\n  as it is\n", "unanswerable", [], ["flush left"]),
    ]
    for bad in ("id: x", "- id: a\n  id: b", "- id: &x y", "- id: [a", '- id: "open', "- id: a\n  - b"):
        with pytest.raises(ValueError):
            yaml_lists.records(bad)

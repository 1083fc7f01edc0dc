import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import common, curve_packing, manifest, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(level, picked):
    """(top, siblings of picked from below) of a list of hashes."""
    steps = []
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        run, at = runs[picked // 8], picked % 8
        steps.append((run[:at], run[at + 1 :]))
        level, picked = [h(*r) for r in runs], picked // 8
    return level[0], steps


def brute_manifest(rows):
    """Rows (doc_id, text, lang, source, n_chars) as audited gives them."""
    leaf = lambda r, text: h(told(r[0]), told(r[3]), told(r[2]), told(r[4]), told(text))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0], leaf(r, r[1]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: x[:3] if x[0] else (False, 0, x[2]))
    tops = [climb([x[2] for x in groups[g]], 0)[0] for g in names]
    root = climb(tops, 0)[0]
    for k, g in enumerate(names):
        for i, (_, doc_id, own, r) in enumerate(groups[g]):
            steps = climb([x[2] for x in groups[g]], i)[1] + climb(tops, k)[1]
            bad = r[1] is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
            at = leaf(r, "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in r[1])) if bad else own
            for before, after in steps:
                at = h(*before, at, *after)
            yield doc_id, own, tops[k], root, h(*(x for b, a in steps for x in b + a)), at, at == root


@pytest.mark.parametrize("partitions", [1, 5])
def test_manifest_against_brute_force(spark, partitions, monkeypatch):
    monkeypatch.setattr(common, "SMALL", 40)  # several tasks for few rows
    rng = random.Random(partitions)
    rows = [(i if rng.random() < 0.97 else None, rng.choice([None, "", "Ein Text", "AÉZ", "x" * 3000, f"Text {i}"]), rng.choice(["en"] * 6 + [None, "", "=", "de", "é"]), rng.choice([None, "s"]), rng.choice([None, 7])) for i in rng.sample(range(-50, 700), 600)]
    rows += [(9001, "Same", "en", None, 1)] * 40 + [(9002, "One", "xx", "s", 1)] + [(9003, t, "en", "s", 1) for t in ("A", "B", "b")]
    docs = spark.createDataFrame(rows, DOCS).repartition(partitions)
    assert sorted(map(repr, brute_manifest(rows))) == sorted(repr(tuple(r)) for r in manifest.audited(docs).collect())


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_manifest_of_one_group(spark, n):
    rows = [(i, f"Text {i}", None, "s", 1) for i in range(n)]
    assert sorted(map(repr, brute_manifest(rows))) == sorted(repr(tuple(r)) for r in manifest.audited(spark.createDataFrame(rows, DOCS)).collect())


def test_manifest_of_many_groups_and_clashing_columns(spark):
    rows = [(i, "T", f"l{i % 70}", None, None) for i in range(100)]
    docs = spark.createDataFrame([(*r, 0, "x", 1, 2) for r in rows], DOCS + ", grp long, hash string, idx long, steps long")
    assert sorted(map(repr, brute_manifest(rows))) == sorted(repr(tuple(r)) for r in manifest.audited(docs).collect())


def test_empty_manifest(spark):
    assert manifest.audited(spark.createDataFrame([], DOCS)).collect() == []


def test_tampering_of_an_upper_node_is_seen(spark):
    docs = spark.createDataFrame([(i, f"Text {i}", "en", "s", 1) for i in range(70)], DOCS)
    leaves, root = manifest.manifest(manifest.document_leaves(docs), "doc_id")
    row = leaves.where("doc_id = 3").first()
    for k in range(len(row.steps)):
        at = row.hash
        for j, s in enumerate(row.steps):
            at = h(s.before, at, s.after if j != k else h("other"))
        assert at != root


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append(((t is not None, t or 0, h(told(r), x)), (r, x)))
    own = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c in own:
        n, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        made[c] = tuple(own.get(base, [])[:n] + own[c][n:])
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    for p, m in members.items():
        yield m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], h(",".join(str(c) for c in m if len(made[c]) == len(p)))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def same_trie(spark, rows):
    got = trie.rebuilt_trie(spark.createDataFrame(rows, TURNS))
    assert sorted(map(repr, brute_trie(rows))) == sorted(repr(tuple(r)) for r in got.select(*COLUMNS).collect())


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(common, "SMALL", 20)
    monkeypatch.setattr(trie, "PIECE", 64)
    rng = random.Random(seed)
    ids = rng.sample(range(-60, 400), 150)
    rows = [(c, rng.choice([None, t, t, t]), rng.choice(["user", None, "ab", "a"]), rng.choice(["", None, "b", "bc", "é", "long " * 500])) for c in ids for t in range(rng.choice([1, 2, 5, 12]))]
    rows += [(None, 0, "user", "none")] + [(700 + c, t, "u", f"same {t}") for c in range(120) for t in range(4)] + rows[:20]
    rng.shuffle(rows)
    same_trie(spark, rows)


def test_a_deep_conversation_and_branches(spark):
    """600 turns that others leave at every tenth: as many rows as branchings, not as pairs of nodes."""
    long = [("u", f"turn {i}") for i in range(600)]
    rows = [(5 * k, i, *t) for k in range(60) for i, t in enumerate([*long[: 600 - 10 * k], *([("u", f"end {k}")] if k else [])])]
    same_trie(spark, rows)


def test_turnless_and_empty(spark):
    same_trie(spark, [(c, 0, "u", "x") for c in range(1, 60) if c % 5])  # first ones of five are absent
    assert trie.rebuilt_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert trie.rebuilt_trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)).collect() == []


def test_trie_ignores_other_columns(spark):
    rows = [(c, t, "u", f"{t}") for c in range(20) for t in range(3)]
    more = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], TURNS + ", depth int, digest string, node int, bytes int")
    assert sorted(map(repr, brute_trie(rows))) == sorted(repr(tuple(r)) for r in trie.rebuilt_trie(more).select(*COLUMNS).collect())


PATH = public_tokenizers.path("byte_bpe_50k.json")


def checked(rows, got, capacity=1024):
    """Every document's ids lie in its pieces, sequences are gapless, and need no padding."""
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in rows:
        want[doc_id, tuple(plain.encode(text or "", add_special_tokens=False).ids) + (0,)] += 1
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        assert r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    held = Counter()
    for (doc_id, ids), many in want.items():
        held[doc_id, len(ids)] += many
        mine = Counter(pieces[doc_id, len(ids)])
        for start, length, crc in mine:
            assert any(zlib.crc32(np.array(x[start : start + length], "<u4").tobytes()) == crc for d, x in want if d == doc_id and len(x) == len(ids))
    for key, many in held.items():
        assert sum(n for _, n, _ in pieces[key]) == many * key[1]
        ends = Counter(s + n for s, n, _ in pieces[key])
        starts = Counter(s for s, _, _ in pieces[key])
        assert starts[0] == many == ends[key[1]] and all(starts[x] == ends[x] for x in starts | ends if 0 < x < key[1])
    sizes = []
    for found in sequences.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(n == capacity or (n < capacity and n & (n - 1) == 0) for n in sizes) and len({n for n in sizes if n < capacity}) == sum(n < capacity for n in sizes)
    assert sum(sizes) == sum(len(ids) * many for (_, ids), many in want.items())


def test_curve_packing(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL", 30)
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    texts = [None, "", " ", "\n", "a \n b", "<|endoftext|> x", "あ\n\nあ", "long " * 9000]
    rows = [(i if i % 50 else None, rng.choice([*texts, *(" ".join(rng.choices(words, k=rng.choice([1, 30, 400]))) for _ in range(12))])) for i in range(300)]
    rows += [(1000, "a copy of one text")] * 80
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, tokens long, place string").repartition(5)
    got = curve_packing.pack_along_curve(docs, PATH).collect()
    checked(rows, got)
    again = curve_packing.pack_along_curve(docs, PATH).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_no_documents_and_one(spark):
    kinds = "doc_id long, text string"
    assert curve_packing.pack_along_curve(spark.createDataFrame([], kinds), PATH).collect() == []
    rows = [(7, None)]
    got = curve_packing.pack_along_curve(spark.createDataFrame(rows, kinds), PATH).collect()
    assert [tuple(r) for r in got] == [(7, 0, 1, zlib.crc32(bytes(4)), 1, 0, 0)]
    checked([(7, "x " * 3000)], curve_packing.pack_along_curve(spark.createDataFrame([(7, "x " * 3000)], kinds), PATH).collect())


def test_ids_are_the_tokenizers(spark):
    plain, own = Tokenizer.from_file(PATH), curve_packing.ByteIds(PATH)
    rng = random.Random(9)
    parts = ["a", "Wort", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", ".", "?!", "12", "é", " ", " ", "日本", "\x1f", "<|endoftext|>", "_", "​"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 40))) for _ in range(3000)]
    assert own.apart
    got = own.of([t.encode() for t in texts])
    assert all(x.tolist() == plain.encode(t, add_special_tokens=False).ids for x, t in zip(got, texts, strict=True))


def test_new_units_are_told_apart_by_their_ids_bytes():
    """No offsets are followed: an id's bytes say where units end, whatever stands in them."""
    plain, own = Tokenizer.from_file(PATH), curve_packing.ByteIds(PATH)

    class Fast:
        encode_batch_fast = own.tokenizer.encode_batch_fast

    own.tokenizer = Fast()  # has no other call
    texts = ["une \u00e9t\u00e9,\n\n  x1 \U0001f600\u65e5 don't   ", "a", " b ", "".join(f" w\u00f6rd{i}" for i in range(30_000))]
    for x, t in zip(own.of([t.encode() for t in texts]), texts, strict=True):
        assert x.tolist() == plain.encode(t, add_special_tokens=False).ids
        assert own.size[x].sum() == len(t.encode())


def test_hilbert_keys_walk_from_neighbour_to_neighbour():
    for dims, bits in ((2, 4), (3, 3), (6, 2)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = curve_packing.hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        assert set(np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1)) == {1}


def test_neighbours_are_alike(spark):
    """Documents of one topic meet in sequences more often than by chance."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"t{i % 8}w{k}" for k in range(60)], k=60))) for i in range(400)]
    got = curve_packing.pack_along_curve(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append(r.doc_id % 8)
    pairs = [a == b for x in held.values() for a, b in itertools.combinations(x, 2)]
    assert np.mean(pairs) > 3 / 8

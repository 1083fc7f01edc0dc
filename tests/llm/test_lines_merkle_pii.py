import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_alignment as la
from tessera.llm import merkle
from tessera.llm import surrogates as s


def test_patience():
    a, b = list("abcdxyz"), list("qbcdrxyzs")
    assert la.patience(a, b) == [(1, 1, 3), (4, 5, 3)]
    assert la.patience(a, a) == [(0, 0, 7)] and la.patience(a, []) == [] and la.patience(list("aab"), list("aacb")) == [(0, 0, 2), (2, 3, 1)]
    rng = random.Random(1)
    for _ in range(200):
        x, y = ([rng.randint(1, 9) for _ in range(rng.randint(0, 20))] for _ in range(2))
        blocks = la.patience(x, y)
        assert all(x[i : i + n] == y[k : k + n] for i, k, n in blocks)
        assert all(i + n <= p and k + n <= q for (i, k, n), (p, q, _) in zip(blocks[:-1], blocks[1:], strict=True))


def test_line_dedup(spark):
    block = "a shared line of some length here\nand a second one that follows it\nand then a third for good measure"
    rows = [(5, "own five\n" + block + "\nmore five", 1), (7, "seven\n" + block + "\ntail seven", 2), (9, "same text of nine\nwith two lines", 3), (8, "same text of nine\nwith two lines", 4), (1, None, 5), (2, "", 6), (3, "clean", 7), (4, "\n\n", 8), (6, "x\n", 9), (10, "x\ny", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int")
    got = {r.doc_id: r for r in la.line_report(docs).collect()}
    assert (got[5].n_removed, got[7].n_removed, got[7].n_blocks) == (0, 3, 1)
    assert got[7].kept_sha256 == hashlib.sha256(b"seven\ntail seven").hexdigest()
    assert (got[8].n_removed, got[9].n_removed) == (0, 2) and got[10].n_removed == 0 and got[1].n_lines == 0
    kept = {r.doc_id: r for r in la.deduplicated(docs).collect()}
    assert set(kept) == {1, 2, 3, 4, 5, 6, 7, 8, 10} and kept[7].text == "seven\ntail seven" and kept[7].n_removed == 2 and kept[1].text is None
    assert la.deduplicated(docs.limit(0)).count() == 0 and la.deduplicated(docs).columns == docs.columns
    twice = docs.where("doc_id = 5").unionByName(docs.where("doc_id = 5"))
    assert [r.n_removed for r in la.line_report(twice).collect()] == [0, 0]


def test_line_dedup_of_passages_that_hundreds_hold(spark):
    long, short, lone = "one long line that several hundred different texts hold, word for word", "if x:\n\n  go()\nelse:", "}"
    rows = [(i, f"own {i}\n{lone}\nand {i}\n" + (long, short)[i % 2] + f"\nend {i}") for i in range(600)]
    got = {r.doc_id: r for r in la.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in (0, 1)] == [0, 0] and {got[i].n_removed for i in range(2, 600, 2)} == {1} and {got[i].n_removed for i in range(3, 600, 2)} == {4}
    assert got[599].kept_sha256 == hashlib.sha256(b"own 599\n}\nand 599\nend 599").hexdigest()


def test_keys_are_lines_and_least_passages():
    h, sizes = np.array([1, 2, 0, 3, 4, 1, 2, 0, 0], np.int64), np.array([70, 40, 90, 5, 5, 70, 40, 9, 9], np.int32)
    text, key, passage = la.block_keys(h, sizes, np.array([5, 0, 4]), 3, 64)
    assert key[(text == 0) & ~passage].tolist() == [2, 3, 4] and key[(text == 2) & ~passage].tolist() == [2]
    assert (key[passage] == 1).sum() == 2 and [int((passage & (text == i)).sum()) for i in range(3)] == [3, 0, 2]
    assert len(la.block_keys(h[:0], sizes[:0], np.array([0]), 3, 64)[0]) == 0


def test_merkle_audit(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", None if i == 4 else "x" * (i % 7)) for i in range(-3, 600)], "page_id long, url string, html string")
    a = merkle.warc_records(pages)
    assert merkle.audit(a, a).count() == 0
    b = a.where("record <> 10").withColumn("content", F.when(F.col("record").isin(300, -2), F.lit(b"rot")).otherwise(F.col("content")))
    b = b.unionByName(a.where("record = 5").withColumn("record", F.lit(100000).cast("long")))
    got = {r.record: r for r in merkle.audit(a, b).collect()}
    assert set(got) == {10, 300, -2, 100000} and got[10].digest_b is None and got[100000].digest_a is None
    for r in a.where("record IN (10, 300)").collect():
        assert (got[r.record].start, got[r.record].stop) == (r.start, r.stop) and got[r.record].digest_a == hashlib.sha256(r.content).hexdigest()
    files = a.groupBy("file").agg(F.sum(F.octet_length("content")).alias("n"), F.max("stop").alias("stop")).collect()
    assert all(f.n == f.stop for f in files)
    empty = a.limit(0)
    assert merkle.audit(empty, empty).count() == 0 and merkle.audit(a, empty).count() == 603
    double = a.unionByName(a.where("record = 7"))
    assert [r.record for r in merkle.audit(a, double).collect()] == [7] and merkle.audit(double, double.repartition(3)).count() == 0


def test_merkle_audit_finds_moved_records(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (i % 7)) for i in range(600)], "page_id long, url string, html string")
    a = merkle.c.checkpoint(merkle.warc_records(pages))
    at = {r.record: (r.file, r.start, r.stop) for r in a.collect()}
    one = F.col("record") == 300
    shifted, elsewhere = a.withColumns({n: F.when(one, F.col(n) + 10).otherwise(F.col(n)) for n in ("start", "stop")}), a.withColumn("file", F.when(one, F.col("file") + 1).otherwise(F.col("file")))
    for b, to in ((shifted, (1, at[300][1] + 10, at[300][2] + 10)), (elsewhere, (2, *at[300][1:]))):
        r, = merkle.audit(a, b).collect()
        assert (r.record, (r.file, r.start, r.stop), (r.file_b, r.start_b, r.stop_b)) == (300, at[300], to) and r.digest_a == r.digest_b
    swapped = a.withColumn("record", F.when(one, 301).when(F.col("record") == 301, 300).otherwise(F.col("record")))
    assert {r.record for r in merkle.audit(a, swapped).collect()} == {300, 301}
    lost = {r.record: r for r in merkle.audit(a, merkle.warc_records(pages.where("page_id <> 10"))).collect()}
    assert set(lost) == set(range(10, 256)) and lost[10].digest_b is None and all(lost[i].digest_a == lost[i].digest_b and lost[i].start_b < lost[i].start for i in range(11, 256))
    double = a.unionByName(a.where("record = 7"))
    assert [r.record for r in merkle.audit(double, a.unionByName(a.where("record = 7").withColumn("file", F.lit(2).cast("long")))).collect()] == [7]


TEXT = 'Dr. Ada Byron (ada.b@mail.example.org, +1 (212) 555-0199, 4111 1111 1111 1111) at 10.1.2.3; token = "0123456789abcdef0123". Ada Byron again; Frau Eva Kant, г-н Иван Петров.'


def test_detection():
    found = [(k, TEXT[a:b]) for a, b, k, _ in s.detect(TEXT)]
    assert found == [("person", "Ada Byron"), ("email", "ada.b@mail.example.org"), ("phone", "+1 (212) 555-0199"), ("card", "4111 1111 1111 1111"), ("ip", "10.1.2.3"), ("secret", "0123456789abcdef0123"), ("person", "Ada Byron"), ("person", "Eva Kant"), ("person", "Иван Петров")]
    assert s.detect("plain text, 3.14 in 1999 @ home, v1.2.3, at @x") == [] and s.detect("") == []


def test_surrogates_keep_format_and_are_one_to_one():
    key = b"k"
    for kind, raw, pattern in (("email", "ada.b9@x.org", r"[a-z]{3}\.[a-z]\d@h[0-9a-z]{12}\.example\.(com|org|net)"), ("ip", "10.1.2.3", r"\d+\.\d+\.\d+\.\d+"), ("secret", "00ff" * 5, r"[0-9a-f]{20}"), ("phone", "1:2125550199", r"1:\d{10}")):
        assert re.fullmatch(pattern, out := s.surrogate(key, kind, raw)) and out != raw and out == s.surrogate(key, kind, raw) != s.surrogate(b"other", kind, raw)
    valid = s.surrogate(key, "card", "4111111111111111")
    assert s.luhn(valid[:-1]) == int(valid[-1]) and len(valid) == 16
    for n in (1, 2, 3):
        made = {s.encipher(key, "t", f"{i:0{n}d}") for i in range(10**n)}
        assert len(made) == 10**n
    assert len({s.surrogate(key, "ip", f"1.2.{i}.{j}") for i in range(40) for j in range(40)}) == 1600
    name = s.surrogate(key, "person", "f:Анна Каренина").split(":")[1].split()
    assert len(name) == 2 and name[0] in s.GIVEN["cyrillic", "f"] and all("Ѐ" <= x <= "ӿ" for x in name[1])
    assert s.render("+1 (212) 555-0199", "phone", "1:9876543210") == "+1 (987) 654-3210"


def test_replacement_in_tables(spark):
    many = [(100 + i, f"Mr A{chr(97 + i % 26)}{chr(97 + i // 26)} Bo wrote") for i in range(600)]
    docs = spark.createDataFrame([(1, TEXT, "x"), (2, "no entities", "y"), (3, None, "z"), (4, "", "z"), (5, "see ada.b@mail.example.org", "z"), (None, "a@b.co", "z")] + [(i, t, "m") for i, t in many], "doc_id long, text string, kind string")
    rows = {r.doc_id: r for r in s.replaced(docs, b"key").collect()}
    assert len(rows) == 606 and re.fullmatch(r"[a-z]@h\w+\.example\.\w+", rows[None].text) and rows[2].text == "no entities" and rows[3].text is None and rows[4].text == "" and rows[1].n_entities == 9 and rows[1].kind == "x"
    for secret in ("Ada", "ada.b", "212", "4111", "10.1.2.3", "0123456789abcdef", "Eva", "Иван"):
        assert secret not in rows[1].text
    mail = re.search(r"\S+@h\w+\.example\.\w+", rows[5].text)[0]
    assert mail in rows[1].text
    names = [rows[i].text for i, _ in many]
    assert len(set(names)) == 600
    assert s.replaced(docs.limit(0), b"key").count() == 0


def test_mentions_of_one_person_stay_one():
    text = "Dr Anna Weber met Mr John Smith. Smith and Frau Anna Weber left; Mr Smith and Frau Weber came back."
    of = {}
    for a, b, k, e in s.detect(text):
        assert k == "person"
        of.setdefault(e, []).append(text[a:b])
    assert of == {"f:Anna Weber": ["Anna Weber", "Anna Weber", "Weber"], "m:John Smith": ["John Smith", "Smith", "Smith"]}
    whole = s.surrogate(b"k", "person", "m:John Smith")
    assert s.render("John Smith", "person", whole) == whole[2:] and s.render("Smith", "person", whole) == whole.split()[-1]
    two = {e for *_, e in s.detect("Mr Al Roe and Ms Bea Roe. Roe spoke.")}
    assert two == {"m:Al Roe", "f:Bea Roe", "n:Roe"}


@pytest.mark.parametrize(
    ("text", "captured", "gender"),
    [
        ("Prof. Dr. Hans Müller came; Müller spoke", "Hans Müller", "n"),
        ("Herr Dr. Müller kam", "Müller", "m"),
        ("Frau Dr. Anna Weber kam, Weber ging", "Anna Weber", "f"),
        ("Mr. J. R. Tolkien wrote", "J. R. Tolkien", "m"),
        ("Mr. J.R.R. Tolkien wrote", "J.R.R. Tolkien", "m"),
        ("Herr von Braun sprach", "von Braun", "m"),
        ("Dr. med. Eva Klein", "Eva Klein", "n"),
        ("gez. Dr.\nHans Weber", "Hans Weber", "n"),
        ("Herr Prof. Dr. h. c. Ludwig van Beethoven", "Ludwig van Beethoven", "m"),
        ("Señora Ana de la Cruz", "Ana de la Cruz", "f"),
        ("г-н Иван Петров", "Иван Петров", "m"),
    ],
)
def test_titles_initials_and_particles(spark, text, captured, gender):
    assert {e for *_, e in s.detect(text)} == {f"{gender}:{captured}"}
    out = s.replaced(spark.createDataFrame([(1, text)], "doc_id long, text string"), b"key").first().text
    assert not {w for w in captured.split() if w not in s.PARTICLES and "." not in w} & set(re.findall(r"\w+", out))
    titles = re.match(r"(?:gez\. )?[\w-]+\.?", text)[0]
    assert out.startswith(titles) and len(s.detect(out)) == len(s.detect(text))


def test_a_title_is_no_name():
    assert s.detect("Mrs. Dr") == [] and s.detect("Prof. Dr. came") == [] and [e for *_, e in s.detect("Mr Smith. Dr Jones")] == ["m:Smith", "n:Jones"]


@pytest.mark.parametrize(
    ("text", "kind", "raw", "pattern"),
    [
        ("call 030 1234567 now", "phone", "030 1234567", r"0\d\d \d{7}"),
        ("call 0171/1234567.", "phone", "0171/1234567", r"0\d{3}/\d{7}"),
        ("tel. 01.23.45.67.89", "phone", "01.23.45.67.89", r"0\d(\.\d\d){4}"),
        ("tel. 612 345 678,", "phone", "612 345 678", r"\d{3} \d{3} \d{3}"),
        ("tel. 212.555.0123", "phone", "212.555.0123", r"\d{3}\.\d{3}\.\d{4}"),
        ("no 123-45-6789!", "national", "123-45-6789", r"\d{3}-\d\d-\d{4}"),
        ("to DE89 3704 0044 0532 0130 00 by", "iban", "DE89 3704 0044 0532 0130 00", r"DE\d\d( \d{4}){4} \d\d"),
        ("to GB82WEST12345698765432 by", "iban", "GB82WEST12345698765432", r"GB\d\d[A-Z]{4}\d{14}"),
        ("to IT60 X054 2811 1010 0000 0123 456 MEHR", "iban", "IT60 X054 2811 1010 0000 0123 456", r"IT\d\d [A-Z]\d{3}( \d{4}){4} \d{3}"),
    ],
)
def test_numbers_of_more_kinds(text, kind, raw, pattern):
    ((a, b, k, e),) = s.detect(text)
    assert (text[a:b], k) == (raw, kind)
    out = s.render(raw, kind, s.surrogate(b"key", kind, e))
    assert out != raw and re.fullmatch(pattern, out)
    if kind == "iban":
        plain = out.replace(" ", "")
        assert int("".join(str(int(x, 36)) for x in plain[4:] + plain[:4])) % 97 == 1


def test_dates_are_no_numbers_and_neighbours_stay_apart():
    assert s.detect("on 01-02-2024 or 01/02/2024 and 12-34-5678") == []
    assert [x[2:] for x in s.detect("+1 (826) 555-4081 190.137.223.204 +1 (826) 555-4082 4111111111111111")] == [("phone", "1:8265554081"), ("ip", "190.137.223.204"), ("phone", "1:8265554082"), ("card", "4111111111111111")]
    assert len({s.surrogate(b"k", "iban", f"DE{s.iban_check('DE', f'{i:018d}')}{i:018d}") for i in range(2000)}) == 2000


def test_replacement_equals_one_by_one(spark):
    """Every row against detection, surrogates and their collision checks in plain Python."""
    texts = [TEXT, TEXT, "ip 10.0.0.%d " * 3 % (1, 2, 3), None, "", "x@a.org " * 3000, "call 123-456-7890 or a1@b.org", "Mr Al Roe wrote; Roe left"] + [f"host 10.0.{i % 7}.{i} and u{i}@m{i % 3}.org" for i in range(60)]
    rows = [(i % 50 if i % 11 else None, t, i, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_entities long, spans int")
    key, found = b"own key", {(k, e) for t in texts if t for *_, k, e in s.detect(t)}
    attempt = dict.fromkeys(found, 0)
    while True:
        made = {f: s.surrogate(key, *f, attempt[f]) for f in found}
        again = {f for f in found if (f[0], made[f]) in found or f != min(g for g in found if g[0] == f[0] and made[g] == made[f])}
        if not again:
            break
        for f in again:
            attempt[f] += 1
    want = []
    for i, t, n, x in rows:
        for a, b, k, e in reversed(s.detect(t or "")):
            t = t[:a] + s.render(t[a:b], k, made[k, e]) + t[b:]
        want.append((i, t, n, x, len(s.detect(rows[n][1] or ""))))
    got = s.replaced(docs, key)
    assert got.columns == ["doc_id", "text", "n_entities", "spans", "n_entities"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def by_hand(texts, rare, block_lines, block_bytes):
    """Lines that each text (in order of doc_id, all different) loses: every pair of a key's first holder and a later one, aligned."""
    lines = [t.split("\n") for t in texts]
    holders = {}
    for i, ls in enumerate(lines):
        for a in range(len(ls)):
            if ls[a].strip():
                holders.setdefault((ls[a],), [set(), False])[0].add(i)
            for n in range(1, block_lines + 1):
                run = [x if x.strip() else "" for x in ls[a : a + n]]
                if len(run) == n and (n == block_lines or sum(len(x.encode()) for x in run if x.strip()) >= block_bytes):
                    if any(x.strip() for x in run):
                        got = holders.setdefault(tuple(run), [set(), False])
                        got[0].add(i)
                        got[1] = True
                    break
    lost = [set() for _ in texts]
    for who, passage in holders.values():
        if len(who) >= 2 and (passage or len(who) <= rare):
            for b in who - {min(who)}:
                ids = {x: k for k, x in enumerate(dict.fromkeys(x if x.strip() else "" for t in (min(who), b) for x in lines[t]), 1)} | {"": 0}
                one, two = ([ids[x if x.strip() else ""] for x in lines[t]] for t in (min(who), b))
                for _, at, n in la.patience(one, two):
                    if n >= block_lines or sum(len(x.encode()) for x in lines[b][at : at + n]) >= block_bytes:
                        lost[b].update(range(at, at + n))
    return [hashlib.sha256("\n".join(x for k, x in enumerate(ls) if k not in gone).encode()).hexdigest() for ls, gone in zip(lines, lost, strict=True)], [len(x) for x in lost]


def test_lines_against_brute_force(spark):
    rng = random.Random(12)
    pool = [f"line {i} " + "x" * rng.randint(0, 40) for i in range(25)] + ["", " ", "é" * 40]
    texts = list(dict.fromkeys("\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(120)))
    block = "\n".join(f"a passage line {k} of many words that everyone shares" for k in range(3))
    texts += [f"own {i}\n{block}\ntail {i}" for i in range(90)]
    texts = [t for t in texts if t]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)] + [(None, block, "x", 3)], "doc_id long, text string, kept string, n_lines int")
    for rare in (5,):
        got = {r.doc_id: (r.kept_sha256, r.n_removed) for r in la.line_report(docs, rare).collect()}
        assert got.pop(None)[1] == 0
        sha, n = by_hand(texts, rare, la.BLOCK_LINES, la.BLOCK_BYTES)
        assert [got[i] for i in range(len(texts))] == list(zip(sha, n, strict=True))

"""PII: surrogate generation. Detected entities get keyed replacements that keep type and format.

* Detection: e-mail addresses, phone numbers (international, and national forms of several countries),
  IPv4 addresses, payment card numbers, account numbers (IBAN, by their check digits), national
  identity numbers of the form 123-45-6789, long hexadecimal secrets after a naming word, and persons
  after titles: any run of them, then initials, particles and names (with later mentions of the same
  name). A title is never taken for a name.
* A surrogate depends on the key and the entity alone, so mentions anywhere in the corpus stay one.
  Digits and letters are enciphered class by class by a Feistel network over the entity's own pattern
  of classes, which is one-to-one; cards and account numbers keep their check digits valid; e-mail
  domains become reserved ones; persons get a name of the same gender (by the first title that has
  one), script and number of words, initials for initials; particles stay.
* Collision checks: if two entities of a type get one surrogate, or a surrogate equals an entity of the
  corpus, all but the least entity are enciphered again with the next tweak until none collides. The
  checks are aggregates over the distinct entities; no list of them reaches the driver.

* Persons: within a document, mentions by family name alone, and by the same name under another title,
  are mentions of the one full name that ends so; a gendered title decides over a neutral one, the first
  of several. Two full names of one family name leave a bare family name an entity of its own.

Defined results: null texts stay null and empty ones empty; rows without doc_id, and texts that share
one, are documents of their own; equal rows come out equal; overlapping entities go to the first, then
the longest, then by type; an empty table gives an empty one; other columns are kept.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as c

# Titles by gender, and given names and family names for surrogates by gender and script.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н", "κ."),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "г-жа", "κα"),
    "n": ("Dr", "Prof", "Professor", "Doktor", "Dipl.-Ing"),
}
# Academic degrees in lower case that stand between a title and a name, and particles of family names; both stay as they are.
DEGREES = ("med", "dent", "vet", "phil", "rer", "nat", "jur", "iur", "pol", "oec", "techn", "theol", "habil", "h", "c", "ing")
PARTICLES = ("von", "vom", "van", "zu", "zum", "zur", "de", "den", "der", "del", "della", "di", "da", "dos", "du", "des", "la", "le", "ten", "ter", "bin", "al", "y")
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Nils", "Oscar", "Paul", "Quentin", "Robert", "Simon", "Thomas"),
    ("latin", "f"): ("Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sara", "Tina", "Vera"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Максим", "Олег"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения", "Мария", "Ольга", "Софья"),
    ("greek", "m"): ("Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"),
    ("greek", "f"): ("Άννα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"),
}
SYLLABLES = {
    "latin": ("ba", "del", "fen", "gor", "hal", "kin", "lar", "mon", "nor", "pel", "ros", "sand", "tor", "ven", "wes", "zan"),
    "cyrillic": ("ба", "вел", "гор", "дан", "зем", "кол", "лар", "мир", "нов", "пет", "рад", "сол", "тим", "фед", "хар", "чер"),
    "greek": ("βα", "γαρ", "δημ", "ζαν", "θεο", "καρ", "λαμ", "μαν", "νικ", "παπ", "ραλ", "σαρ", "τασ", "φωτ", "χατ", "ψαρ"),
}
ENDINGS = {"latin": ("son", "er", "man", "ley"), "cyrillic": ("ов", "ин", "енко", "ский"), "greek": ("ίδης", "άκης", "όπουλος", "έας")}

_EMAIL = re.compile(r"[A-Za-z0-9À-ɏ._%+\-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.)+[A-Za-z]{2,24}")
_LOCAL = re.compile(r"[A-Za-z0-9À-ɏ._%+\-]*$")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)", re.ASCII)
_PHONE = re.compile(
    r"(?<![\w+])(?:\+1[ .\-]?\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}|\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}"  # international
    r"|\(\d{3}\) ?\d{3}-\d{4}|[2-9]\d{2}([ .\-])\d{3}\1\d{4}|[6-9]\d{2} \d{3} \d{3}"  # North American, Spanish
    r"|(?!\d\d([\-/])\d\d\2\d{4}(?!\d))(?:\(0\d{1,4}\) ?|0\d{1,4}[ \-/])\d{2,8}(?:[ \-]\d{2,5}){0,4}|0\d(?:\.\d{2}){4})(?!\w)",  # with the national 0, no dates
    re.ASCII,
)
_IDENTITY = re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])", re.ASCII)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)", re.ASCII)
_CARD = re.compile(r"(?<![\w.])\d(?:[ \-]?\d){12,18}(?![\w.]*\d)", re.ASCII)
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\b\s*[=:]\s*[\"']?([0-9A-Za-z_\-]{16,128})")
_DIGITS = re.compile(r"[+(]?\d[\d .\-()/]{5,}\d", re.ASCII)
_TITLE = {t: g for g, ts in TITLES.items() for t in ts}
_ALL = "|".join(map(re.escape, sorted(_TITLE, key=len, reverse=True)))
_CAPITAL = "[A-ZÀ-ÖØ-ÞΆ-ΫА-ЯЁ]"
_WORD = rf"(?!(?:{_ALL})(?!\w)){_CAPITAL}[\w'’\-]+"
_INITIALS = rf"(?:{_CAPITAL}\.(?:-?{_CAPITAL}\.)*)"
_PARTICLES = rf"(?:(?:{'|'.join(PARTICLES)}) )*"
#: Between a title and what follows: a full stop, blanks, at most one end of line.
_GAP = r"(?:(?:\.[ \u00a0\t]*|[ \u00a0\t]+)(?:\r?\n[ \t]*)?|\r?\n[ \t]*)"
_PERSON = re.compile(rf"(?<!\w)((?:{_ALL})(?:{_GAP}(?:{_ALL})(?!\w))*){_GAP}(?:(?:{'|'.join(DEGREES)})\. ?){{0,4}}((?:{_INITIALS} ?){{0,3}}{_PARTICLES}{_WORD}(?: (?:{_INITIALS} ){{0,2}}{_PARTICLES}{_WORD}){{0,2}})")
_ONE_TITLE = re.compile(rf"(?<!\w)(?:{_ALL})(?!\w)")


def luhn(digits: str) -> int:
    """The check digit after these digits."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, account: str) -> str:
    """The two check digits of a country's account number."""
    return f"{98 - int(''.join(str(int(x, 36)) for x in account + country + '00')) % 97:02d}"


def _gender(titles: str) -> str:
    """Of a run of titles: of the first that has one."""
    return next((g for t in _ONE_TITLE.findall(titles) if (g := _TITLE[t]) != "n"), "n")


def _persons(text: str) -> list[tuple[int, int, str, str]]:
    """Mentions of the persons that a title names somewhere in the text."""
    gender: dict[str, str] = {}
    titled = [(m.span(2), m[2], _gender(m[1])) for m in _PERSON.finditer(text)]
    for _, name, g in titled:
        if gender.get(name, "n") == "n":
            gender[name] = g
    full: dict[str, set[str]] = {}
    for name in gender:
        if " " in name:
            full.setdefault(name.rsplit(" ", 1)[1], set()).add(name)
    of = {name: name for name in gender}
    for family, names in full.items():
        if len(names) == 1:
            (name,) = names
            if family in gender and gender[name] == "n":
                gender[name] = gender[family]
            if gender.get(family, "n") in ("n", gender[name]):
                of[family] = name
        else:  # whose family name a bare one is, no one can tell
            of.setdefault(family, family)
            gender.setdefault(family, "n")
    out = [(*span, "person", f"{gender[of[name]]}:{of[name]}") for span, name, _ in titled]
    for name, whole in of.items():
        out += [(*m.span(), "person", f"{gender[whole]}:{whole}") for m in re.finditer(rf"(?<!\w){re.escape(name)}(?!\w)", text)]
    return out


def _accounts(text: str) -> list[tuple[int, int, str, str]]:
    out = []
    for m in _IBAN.finditer(text):
        raw = m[0]
        while raw:  # what follows may look like its last group
            plain = raw.replace(" ", "")
            if len(plain) >= 15 and iban_check(plain[:2], plain[4:]) == plain[2:4]:
                out.append((m.start(), m.start() + len(raw), "iban", plain))
                break
            raw = raw.rpartition(" ")[0]
    return out


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, entity) of each entity, in order, not overlapping. The entity is what mentions share: type ``person`` has the gender before the name."""
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        s = at - len(_LOCAL.search(text[max(0, at - 64) : at])[0])
        if m := _EMAIL.match(text, s):
            s += len(m[0]) - len(m[0].lstrip(".-"))
            found.append((s, m.end(), "email", text[s : m.end()].lower()))
        at = text.find("@", max(at + 1, m.end() if m else 0))
    for run in _DIGITS.finditer(text):
        s, e = run.span()
        while s and (text[s - 1].isalnum() or text[s - 1] in "+("):
            s -= 1
        view, base = text[max(0, s - 1) : e + 5], max(0, s - 1)
        for kind, pattern in (("ip", _IP), ("national", _IDENTITY), ("phone", _PHONE), ("card", _CARD)):
            for m in pattern.finditer(view, s - base, min(len(view), e + 4 - base)):
                digits = re.sub(r"\D", "", m[0])
                if kind == "phone" and not 7 <= len(digits) <= 15 or kind == "card" and not 13 <= len(digits) <= 19:
                    continue
                if kind == "phone" and m[0][0] == "+":
                    country = len(re.match(r"\+(\d*)", m[0])[1])
                    digits = f"{digits[:country]}:{digits[country:]}"
                elif kind == "phone" and digits[0] == "0":
                    digits = f"0:{digits[1:]}"
                found.append((base + m.start(), base + m.end(), kind, m[0] if kind == "ip" else digits))
                if kind in ("ip", "national"):  # what is one isn't a part of a number beside it
                    view = view[: m.start()] + "\n" * len(m[0]) + view[m.end() :]
    found += _accounts(text)
    low = text.lower() if any(w in text for w in ("oken", "OKEN", "ecret", "ECRET", "assw", "ASSW", "key", "KEY", "Key")) else ""
    if low:
        found += [(*m.span(1), "secret", m[1]) for m in _SECRET.finditer(text) if any(x.isdigit() for x in m[1])]
    if any(t in text for t in _TITLE):
        found += _persons(text)
    out: list[tuple[int, int, str, str]] = []
    for f in sorted(set(found), key=lambda f: (f[0], -f[1], f[2], f[3])):
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def _number(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(parts).encode(), "sha256"), "big")


def _classes(s: str) -> list[tuple[int, int]]:
    """(first code point, size) of each character's class; size 1 for those that stay."""
    return [(48, 10) if "0" <= x <= "9" else (97, 26) if "a" <= x <= "z" else (65, 26) if "A" <= x <= "Z" else (ord(x), 1) for x in s]


def encipher(key: bytes, tweak: str, s: str, hexadecimal: bool = False) -> str:
    """A one-to-one map on the strings of s's pattern of character classes: a Feistel network over two halves, as mixed-radix numbers."""
    if hexadecimal:
        upper = any("A" <= x <= "F" for x in s)
        alphabet = "0123456789ABCDEF" if upper else "0123456789abcdef"
        radix, value = [16] * len(s), [alphabet.index(x) for x in s]
    else:
        kinds = _classes(s)
        radix, value = [n for _, n in kinds], [ord(x) - a for x, (a, _) in zip(s, kinds, strict=True)]
    free = [i for i, n in enumerate(radix) if n > 1]
    halves = free[: len(free) // 2], free[len(free) // 2 :]
    pattern = "".join("-" if n == 1 else chr(60 + n) for n in radix)
    for r in range(8):
        move, by = halves[r % 2], halves[1 - r % 2]
        add = _number(key, tweak, pattern, str(r), ",".join(str(value[i]) for i in by))
        for i in reversed(move):  # addition of mixed-radix numbers, modulo the half's size
            value[i], add = (value[i] + add) % radix[i], (value[i] + add) // radix[i]
    if hexadecimal:
        return "".join(alphabet[v] for v in value)
    return "".join(chr(a + v) for v, (a, _) in zip(value, kinds, strict=True))


def _script(name: str) -> str:
    return next(("cyrillic" if "Ѐ" <= x <= "ӿ" else "greek" for x in name if "Ͱ" <= x <= "ӿ"), "latin")


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The replacement, in the entity's normal form."""
    tweak = f"{kind}{attempt}"
    if kind == "email":
        local, domain = entity.rsplit("@", 1)
        host = _number(key, "domain", domain) % 36**12
        name = "".join("0123456789abcdefghijklmnopqrstuvwxyz"[host // 36**k % 36] for k in range(12))
        return f"{encipher(key, tweak + domain, local)}@h{name}.example.{('com', 'org', 'net')[host % 3]}"
    if kind == "ip":
        n = int.from_bytes(bytes(map(int, entity.split("."))), "big")
        left, right = n >> 16, n & 0xFFFF
        for r in range(8):
            left, right = right, left ^ _number(key, tweak, str(r), str(right)) & 0xFFFF
        return ".".join(map(str, ((left << 16) | right).to_bytes(4, "big")))
    if kind == "card":
        if luhn(entity[:-1]) == int(entity[-1]):
            body = encipher(key, tweak + "luhn", entity[:-1])
            return body + str(luhn(body))
        out = encipher(key, tweak, entity)
        walks = 0
        while luhn(out[:-1]) == int(out[-1]):  # cycle walking: invalid numbers stay among the invalid ones
            walks += 1
            out = encipher(key, tweak, out)
        return out
    if kind == "phone":
        country, mark, rest = entity.rpartition(":")
        return country + mark + encipher(key, tweak + country, rest)
    if kind == "national":
        return encipher(key, tweak, entity)
    if kind == "iban":
        account = encipher(key, tweak + entity[:2], entity[4:])
        return entity[:2] + iban_check(entity[:2], account) + account
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", entity):
            return encipher(key, tweak, entity, True)
        return encipher(key, tweak, entity)
    gender, name = entity.split(":", 1)
    words, n, script = name.split(), _number(key, tweak, entity), _script(name)
    pool = GIVEN[script, gender] if gender != "n" else GIVEN[script, "m"] + GIVEN[script, "f"]
    out = []
    for k, word in enumerate(words):
        if word in PARTICLES:
            out.append(word)
        elif k < len(words) - 1 and "." in word:
            letters = []
            for x in word:
                if x.isalpha():
                    first, size = {"latin": ("A", 26), "cyrillic": ("А", 24), "greek": ("Α", 16)}[script]
                    x, n = chr(ord(first) + n % size), n // size
                letters.append(x)
            out.append("".join(letters))
        elif k < len(words) - 1:
            out.append(pool[n % len(pool)])
            n //= len(pool)
        else:
            syllables, endings = SYLLABLES[script], ENDINGS[script]
            last = ""
            for _ in range(2 + attempt):
                last += syllables[n % len(syllables)]
                n //= len(syllables)
            out.append((last + endings[n % len(endings)]).capitalize())
    return f"{gender}:{' '.join(out)}"


def render(raw: str, kind: str, value: str) -> str:
    """The surrogate as this mention is written: its separators, or its letter case."""
    if kind == "person":
        words = value.split(":", 1)[1].split()
        return " ".join(words[-len(raw.split()) :])  # the family name where the mention is that alone
    if kind == "email":
        return value.upper() if raw.isupper() else value
    if kind == "iban":
        letters = iter(value)
        return "".join(x if x == " " else next(letters) for x in raw)
    if kind in ("phone", "card", "national"):
        digits = iter(value.replace(":", ""))
        return "".join(next(digits) if x.isdigit() else x for x in raw)
    return value


#: Keys among which the mentions of one entity are dealt out.
SALTS = 16
_SPAN = "doc_id long, row long, s int, e int, kind string, entity string"


def detected(docs: DataFrame) -> DataFrame:
    """(doc_id, row, s, e, kind, entity): every entity of every whole text; doc_id is 0 where it is null, and row tells such rows apart."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string()), ("entity", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc, row, *f) for doc, row, t in zip(*(c.column(b, x).to_pylist() for x in ("doc_id", "row", "text")), strict=True) if t for f in detect(t)]
            yield c.record_batch(schema, *(zip(*rows, strict=True) if rows else [[]] * 6))

    return docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), c.row_key().alias("row"), "text").mapInArrow(c.tidied(run), _SPAN)


def assign(entities: DataFrame, key: bytes, rounds: int = 12) -> DataFrame:
    """(kind, entity, surrogate) of distinct entities(kind, entity), distinct and unlike every entity of its kind."""
    schema = pa.schema([("kind", pa.string()), ("entity", pa.string()), ("attempt", pa.int32()), ("surrogate", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, e, a = (c.column(b, x).to_pylist() for x in ("kind", "entity", "attempt"))
            yield c.record_batch(schema, k, e, a, [surrogate(key, *x) for x in zip(k, e, a, strict=True)])

    made = c.checkpoint(entities.withColumn("attempt", F.lit(0)).mapInArrow(c.tidied(run), "kind string, entity string, attempt int, surrogate string"))
    for _ in range(rounds):
        least = made.groupBy("kind", "surrogate").agg(F.min("entity").alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "surrogate", "first")
        clash = made.join(least, ["kind", "surrogate"]).where("entity <> first").select("kind", "entity", "attempt")
        real = made.join(entities.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "entity", "attempt")
        again = c.checkpoint(clash.unionByName(real).distinct())
        if not again.limit(1).count():
            return made.select("kind", "entity", "surrogate")
        fresh = again.withColumn("attempt", F.col("attempt") + 1).mapInArrow(c.tidied(run), "kind string, entity string, attempt int, surrogate string")
        made = c.checkpoint(made.join(again, ["kind", "entity"], "left_anti").unionByName(fresh))
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """The columns of docs(doc_id, text, ...) with every entity replaced, and ``n_entities``. Rows without entities aren't shuffled."""
    spans = c.checkpoint(detected(docs).distinct())
    table = assign(c.checkpoint(spans.select("kind", "entity").distinct()), key)
    # an entity that a third of all texts name is many rows of one key: salted, with its surrogate once for each salt
    salted = spans.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row"), F.lit(SALTS)).cast("int"))
    wide = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lists = salted.join(wide, ["kind", "entity", "salt"]).groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("s", "e", "kind", "surrogate"))).alias("spans"))
    lists = c.checkpoint(lists)
    names = [f"c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    at, ids = docs.columns.index("text"), names[docs.columns.index("doc_id")]
    keyed = docs.toDF(*names).withColumn("__id", F.coalesce(F.col(ids), F.lit(0)).cast("long")).withColumn("__row", c.row_key(ids, names[at]))
    some, rest = c.parted(keyed, ["__id", "__row"], lists.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")))
    joined = some.join(lists.toDF("__id", "__row", "spans"), ["__id", "__row"], "left").select(*names, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, count = [], []
            for t, spans in zip(b.column(at).to_pylist(), c.column(b, "spans").to_pylist(), strict=True):
                count.append(len(spans or []))
                if spans:
                    out, last = [], 0
                    for x in spans:
                        out += [t[last : x["s"]], render(t[x["s"] : x["e"]], x["kind"], x["surrogate"])]
                        last = x["e"]
                    t = "".join(out) + t[last:]
                texts.append(t)
            columns = [pa.array(texts, pa.string()) if i == at else x for i, x in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64())], [*names, "n_entities"])

    done = joined.mapInArrow(c.tidied(run), f"{kinds}, n_entities long")
    return done.unionByName(rest.select(*names, F.lit(0).cast("long").alias("n_entities"))).toDF(*docs.columns, "n_entities")

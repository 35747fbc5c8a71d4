"""Personal data replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

import hashlib
import hmac
import re
import string
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.shared import free_name, written
from certloom.shipping import by_value

# Titles before a name, by gender.
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "г-жа"],
}

_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
_CARD = re.compile(r"(?<!\d)(?:\d[ \-]?){12,18}\d(?!\d)")
_PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .\-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}[\-.]\d{4}|\d{3}-\d{3}-\d{4}|(?<!\d\.)\d{3}\.\d{3}\.\d{4}(?!\.\d))(?!\d)")
_SSN = re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CLOUD_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?i)(?:password|passwd|pwd|token|secret|api[_\-]?key)[\"']?\s*[=:]\s*[\"']?(?P<part>[^\s\"',;]{6,})")
# Small words inside a name, which stay.
PARTICLES = ["van", "von", "der", "den", "de", "la", "le", "del", "da", "di", "du", "dos", "bin", "ibn", "al", "el", "y"]

_CAPITAL = r"[^\W\d_a-zа-яё]"
_NAME = rf"(?:{_CAPITAL}\.[ \-]?)*{_CAPITAL}[^\W\d_]*"
_SMALL = "(?:(?:" + "|".join(PARTICLES) + ") )*"
_PERSON = re.compile(r"(?<!\w)(?:(?P<m>" + "|".join(map(re.escape, TITLES["m"])) + r")|(?P<f>" + "|".join(map(re.escape, TITLES["f"]))
                     + rf"))\.? (?P<part>{_SMALL}{_NAME}(?:[ \-'’]{_SMALL}{_NAME})*)(?!\w)")
_WORD = re.compile(r"[^\W\d_]+")
_BARE = re.compile(rf"(?<!\w){_CAPITAL}[^\W\d_]+(?!\w)")
_INITIALS = re.compile(rf"(?<!\w)(?:{_CAPITAL}(?:\.[ \-]?|['’]))+$")

_LETTERS = {
    "latin": (list("bdfgklmnprstvz"), list("aeiou"), ["o", "an", "us"], ["a", "ia", "ine"]),
    "cyrillic": (list("бвгдзклмнпрст"), list("аеиоу"), ["ов", "ий", "ин"], ["ова", "ая", "ина"]),
}


#: After so many attempts a surrogate is drawn from a larger space; after so many the job ends with an error.
WIDER = 8
ATTEMPTS = 96


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    canonical: str


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        x = int(c) * (2 - i % 2)
        total += x - 9 * (x > 9)
    return str(-total % 10)


def iban_digits(country: str, rest: str) -> str:
    value = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - value % 97:02d}"


def _script(name: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", name) else "latin"


def _parts(name: str) -> list[re.Match]:
    """The words of a name that are replaced, initials among them."""
    return [m for m in _WORD.finditer(name) if m[0] not in PARTICLES]


def _canonical(name: str) -> str:
    return " ".join(m[0].casefold() for m in _parts(name))


def _bare(text: str, known: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    """start, end, kind of untitled mentions of known parts; neighbours of one kind are one mention, initials before it go with it."""
    run: tuple[int, int, str] | None = None
    for m in _BARE.finditer(text):
        kind = known.get(m[0].casefold())
        if kind is None:
            continue
        if run and run[2] == kind and text[run[1] : m.start()] in (" ", "-"):
            run = (run[0], m.end(), kind)
            continue
        if run:
            yield run
        low = max(run[1] if run else 0, m.start() - 24)
        before = _INITIALS.search(text[low : m.start()])
        run = (low + before.start() if before else m.start(), m.end(), kind)
    if run:
        yield run


def detect(text: str) -> list[Entity]:
    """Entities of a whole text, from left to right; of overlapping ones the first, the longer of two that begin together.

    A person is found by a title; other capitalised mentions of the parts of that name in the text are the same person's.
    """
    found: list[tuple[int, int, int, str, str]] = []

    def add(rank: int, kind: str, pattern: re.Pattern, canonical, part: str | int = 0) -> None:
        for m in pattern.finditer(text):
            value = canonical(m[part])
            if value:
                found.append((m.start(part), -m.end(part), rank, kind, value))

    digits = lambda s: re.sub(r"\D", "", s)
    if "@" in text:
        add(0, "email", _EMAIL, str.lower)
    if "AKIA" in text or "ASIA" in text:
        add(1, "cloud_key", _CLOUD_KEY, str)
    if "=" in text or ":" in text:
        add(2, "secret", _SECRET, lambda s: s if any(map(str.isalnum, s)) else "", "part")  # not of marks alone, as ******
    if re.search("[0-9]{2}", text):
        add(3, "iban", _IBAN, lambda s: (c := s.replace(" ", "")) and (c if iban_digits(c[:2], c[4:]) == c[2:4] else ""))
        add(4, "card", _CARD, lambda s: (d := digits(s)) and (d if luhn_digit(d[:-1]) == d[-1] else ""))
        add(5, "ssn", _SSN, digits)
        add(6, "phone", _PHONE, lambda s: ("+" if s[0] == "+" else "") + digits(s))
    if "." in text and re.search(r"\d\.\d", text):
        add(7, "ip", _IP, str)
    known: dict[str, str] = {}
    for m in _PERSON.finditer(text):
        gender = "m" if m["m"] else "f"
        kind = f"person_{gender}_{_script(m['part'])}"
        found.append((m.start("part"), -m.end("part"), 8, kind, _canonical(m["part"])))
        for part in _parts(m["part"]):
            if len(part[0]) > 1:
                known.setdefault(part[0].casefold(), kind)
    if known:
        found += [(start, -end, 9, kind, _canonical(text[start:end])) for start, end, kind in _bare(text, known)]
    out: list[Entity] = []
    for start, end, _, kind, canonical in sorted(found):
        if not out or start >= out[-1].end:
            out.append(Entity(start, -end, kind, canonical))
    return out


def _stream(key: str, *parts: object) -> Iterator[int]:
    """Endless keyed numbers from 0 to 255."""
    block = 0
    while True:
        yield from hmac.new(key.encode(), "\x1f".join(map(str, (*parts, block))).encode(), hashlib.sha256).digest()
        block += 1


def _pick(stream: Iterator[int], choices) -> str:
    return choices[(next(stream) * 256 + next(stream)) % len(choices)]


def _alike(c: str) -> str:
    """All letters (of the same case) or digits of a character's own block of 256, for characters outside ASCII."""
    block = [chr(x) for x in range(ord(c) & ~255, (ord(c) | 255) + 1)]
    if c.isdigit():
        return "".join(x for x in block if x.isdigit())
    return "".join(x for x in block if x.isalpha() and x.isupper() == c.isupper() and x.islower() == c.islower())


def _like(stream: Iterator[int], text: str, extra: int = 0) -> str:
    """Digits for digits, letters for letters of their script (hexadecimal texts stay so), all else as it is; then `extra` more."""
    lower = "abcdef" if re.fullmatch("[0-9a-f]+", text) else string.ascii_lowercase
    classes = ((string.digits, string.digits), (string.ascii_lowercase, lower), (string.ascii_uppercase, string.ascii_uppercase))

    def drawn(c: str) -> str:
        out = next((out for of, out in classes if c in of), None)
        if out is None:
            if not (c.isalpha() or c.isdigit()):
                return c
            out = _alike(c)
        return _pick(stream, out if len(out) > 1 else string.ascii_lowercase)

    return "".join(map(drawn, text)) + "".join(_pick(stream, string.ascii_lowercase) for _ in range(extra))


def _initial(letter: str, script: str, key: str) -> str:
    """The next letter in a keyed order of the alphabet: never itself, and two letters of it never alike."""
    alphabet = string.ascii_lowercase if script == "latin" else "абвгдежзиклмнопрстуфхцчшэюя"
    order = sorted(alphabet, key=lambda c: hmac.new(key.encode(), f"initial\x1f{c}".encode(), hashlib.sha256).digest())
    plain = unicodedata.normalize("NFKD", letter)[0]
    return order[(order.index(plain) + 1) % len(order)] if plain in order else _pick(_stream(key, "initial", letter), order)


def _name(stream: Iterator[int], script: str, gender: str, syllables: int) -> str:
    consonants, vowels, male, female = _LETTERS[script]
    return "".join(_pick(stream, consonants) + _pick(stream, vowels) for _ in range(syllables)) + _pick(stream, consonants) + _pick(stream, male if gender == "m" else female)


def surrogate(kind: str, canonical: str, attempt: int, key: str) -> str:
    """The canonical form of what stands in for an entity. Another attempt gives another one.

    Every WIDER attempts the space that is drawn from grows where a kind's form allows: longer hosts, secrets and
    names, private addresses of the largest private network.
    """
    s = _stream(key, kind, canonical, attempt)
    wider = attempt // WIDER
    if kind == "email":
        local, _, domain = canonical.partition("@")
        host = _like(_stream(key, "domain", domain, wider), domain.split(".")[0], wider)
        return f"{_like(s, local)}@{host}.example.{domain.rsplit('.', 1)[-1] if domain.endswith(('.org', '.net')) else 'com'}"
    if kind == "ip":
        a, b = canonical.split(".")[:2]
        if a == "10" or ((a, b) == ("192", "168") and wider):
            head = ["10", str(next(s))]
        elif (a, b) == ("192", "168"):
            head = [a, b]
        else:
            head = [str(11 + next(s) % 110), str(next(s))]
        return ".".join([*head, str(next(s)), str(1 + next(s) % 254)])
    if kind == "card":
        body = canonical[0] + _like(s, canonical[1:-1])
        return body + luhn_digit(body)
    if kind == "iban":
        rest = _like(s, canonical[4:])
        return canonical[:2] + iban_digits(canonical[:2], rest) + rest
    if kind == "phone":
        lead = "+" if canonical[0] == "+" else ""
        body = canonical[len(lead):]
        keep = max(0, len(body) - 10) if lead else 0
        changed = [_pick(s, string.digits[2:]) if i % 10 in (0, 3) and len(body) - keep == 10 else _pick(s, string.digits) for i in range(len(body) - keep)]
        return lead + body[:keep] + "".join(changed)
    if kind == "cloud_key":
        return canonical[:4] + "".join(_pick(s, string.ascii_uppercase + string.digits) for _ in canonical[4:])
    if kind.startswith("person"):
        _, gender, script = kind.split("_")
        return " ".join(_initial(part, script, key) if len(part) == 1 else _name(_stream(key, kind, part, attempt), script, gender, 2 + attempt // 4)
                        for part in canonical.split(" "))
    return _like(s, canonical, wider if kind == "secret" else 0)


def dress(kind: str, surface: str, value: str) -> str:
    """A surrogate in the format of the text that it replaces: its separators and its capitals."""
    if kind in ("card", "ssn", "phone", "iban"):
        drawn = iter(value.lstrip("+"))
        return "".join(next(drawn) if c.isalnum() else c for c in surface)
    if kind.startswith("person"):
        out, at = [], 0
        for new, m in zip(value.split(" "), _parts(surface), strict=True):
            out += [surface[at : m.start()], new.upper() if m[0].isupper() and len(m[0]) > 1 else new.capitalize()]
            at = m.end()
        return "".join([*out, surface[at:]])
    if kind == "email":
        at = surface.index("@")
        return "".join(v.upper() if o.isupper() else v for v, o in zip(value[:at], surface[:at], strict=True)) + value[at:]
    return value


def _settled(e: Entity) -> list[tuple[str, str]]:
    """What gets a surrogate of its own: the parts of a name (its initials have a fixed one), else the entity."""
    if e.kind.startswith("person"):
        return [(e.kind, part) for part in e.canonical.split(" ") if len(part) > 1]
    return [(e.kind, e.canonical)]


def replace(text: str, attempts: dict[tuple[str, str], int], key: str) -> tuple[str, list[Entity]]:
    out, at, found = [], 0, detect(text)
    for e in found:
        pieces = e.canonical.split(" ") if e.kind.startswith("person") else [e.canonical]
        value = " ".join(surrogate(e.kind, x, attempts.get((e.kind, x), 0), key) for x in pieces)
        out += [text[at : e.start], dress(e.kind, text[e.start : e.end], value)]
        at = e.end
    return "".join([*out, text[at:]]) if out else text, found


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text_key, kind, canonical): the distinct entities of each text, of names their parts, known by its MD5."""

    def run(batches):
        for batch in batches:
            rows = [(k, *x) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    for x in dict.fromkeys(x for e in detect(t) for x in _settled(e))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["text_key", "kind", "canonical"])

    kept = docs.where(F.col(text).isNotNull()).select(F.md5(F.col(text).cast("binary")).alias("text_key"), F.col(text).alias("text"))
    return kept.mapInArrow(run, "text_key string, kind string, canonical string")


def _with_surrogate(rows: DataFrame, key: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            kinds, values, attempts = (batch.column(i).to_pylist() for i in range(3))
            made = [surrogate(k, v, n, key) for k, v, n in zip(kinds, values, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["kind", "canonical", "attempt", "made"])

    return rows.select("kind", "canonical", "attempt").mapInArrow(run, "kind string, canonical string, attempt int, made string")


def settle(known: DataFrame, key: str) -> DataFrame:
    """kind, canonical, attempt: no two entities of a kind get the same surrogate, and none gets an entity of the corpus.

    known: distinct (kind, canonical). Of entities that collide the one with the
    earliest attempt and least canonical form keeps its surrogate, the others make another attempt, until none collides.
    """
    now = written(_with_surrogate(known.withColumn("attempt", F.lit(0)), key))
    while True:
        order = F.concat_ws("\x1f", F.lpad(F.col("attempt").cast("string"), 6, "0"), "canonical")
        first = now.groupBy("kind", "made").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        originals = known.select(F.col("kind").alias("known_kind"), F.col("canonical").alias("known_as"))
        marked = now.join(first, ["kind", "made"], "left").join(
            originals, (F.col("kind") == F.col("known_kind")) & (F.col("made") == F.col("known_as")), "left")
        again = (F.col("first").isNotNull() & (F.col("first") != order)) | F.col("known_as").isNotNull()
        marked = written(marked.select("kind", "canonical", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("again")))
        if marked.where("again").isEmpty():
            return marked.select("kind", "canonical", "attempt")
        tried = marked.agg(F.max("attempt")).first()[0]
        if tried > ATTEMPTS:
            raise ValueError(f"no surrogate was free in {ATTEMPTS} attempts: a kind has more entities than its form allows")
        now = written(_with_surrogate(marked, key))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", spans: str = "entities") -> DataFrame:
    """The documents with every detected entity replaced by its surrogate, and where the entities were.

    The same entity gets the same surrogate in all documents and spellings
    (letters' case, separators), different entities get different ones. Without the
    key the originals can't be told. Null texts stay null without entities, empty ones empty; repeated rows are
    treated alike. Adds `spans`; other columns are kept, a column of that name is an error.

    Only entities that needed another attempt are joined to the texts that hold them. That
    table is written, so Spark sends it along if its size is below the broadcast threshold, else it joins by text hash.
    """
    if spans.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the column {spans} is there already")
    found = written(entities(docs, text).distinct())
    settled = settle(written(found.select("kind", "canonical").distinct()), key)
    moved = written(found.join(settled.where("attempt > 0"), ["kind", "canonical"]).groupBy("text_key").agg(
        F.collect_list(F.struct("kind", "canonical", "attempt")).alias("fixes")))
    taken = docs.columns
    name, of, fixes = (free_name(taken, x) for x in ("text_key", "fix_key", "fixes"))
    joined = docs.withColumn(name, F.md5(F.col(text).cast("binary"))).join(
        moved.select(F.col("text_key").alias(of), F.col("fixes").alias(fixes)), F.col(name) == F.col(of), "left").select(*taken, fixes)
    at = taken.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts, marks = [], []
            for t, fix in zip(batch.column(at), batch.column(len(taken)), strict=True):
                value = t.as_py()
                attempts = {(x["kind"], x["canonical"]): x["attempt"] for x in fix.as_py() or ()}
                new, seen = replace(value, attempts, key) if value else (value, [])
                texts.append(new)
                marks.append([{"kind": e.kind, "start": e.start, "end": e.end} for e in seen])
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[: len(taken)])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(marks, kind)], names=[*taken, spans])

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(spans, SPANS)]))


by_value(__name__)

"""PII surrogates: keyed, type-consistent replacements of detected entities.

A surrogate is a keyed permutation of all strings of the entity's own shape: letters
stay letters of their script and case, digits stay digits, everything else stays where
it is. A permutation gives equal entities equal surrogates in every document
(coreference) and different entities different ones (distinctness), without any table.
It is `f^-1(f(x) + 1)` for a keyed Feistel network f, so nothing maps to itself. What a
format asks for is kept by walking along the permutation, or by permuting only what is
free: cards keep their first digit and the Luhn check, account numbers their country and
check digits, area and exchange codes their valid first digits, social security numbers
stay valid, addresses of private networks stay in their network, and streets keep their
kind. Names stay apart by gender, as known given names are permuted within their own
list, and other names keep vowels, consonants and their ending.

Candidates that fail a check of their own are no entities: card numbers without a Luhn
check or of no issuer, book numbers, account numbers with wrong check digits. Persons are
found after a title, and without one where a known given name and another name stand
together; from there on each of those names is replaced wherever it stands in the text.

`collisions` looks over all documents for surrogates that stand for several originals of
a kind, or that are another entity's original. `checked` gives those entities another
surrogate, and looks again until none is left. Names alone are exempt from the second
rule: a list of given names maps into itself.

Scale: entities leave the tasks as keyed hashes, once a task; the two checks are equi-joins
of these. Only the few entities that collide are joined back to their documents.

Edge cases: null and empty texts stay; a text without entities is returned as it is;
overlapping candidates go to the one that begins first, then to the first kind in
`KINDS`; repeated documents get equal texts, also without a doc_id; a very long text is
one batch of the work; an empty table stays empty; `n_chars`, where there is such a
column, follows the new text; other columns are passed on, but for those of the report's
names, which are replaced.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, slices, unused

ROUNDS = 6
#: Most rows of colliding entities' documents that are broadcast.
SMALL_ROWS = 200_000
#: Alphabets that a character is replaced within.
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àâäáãåæçèéêëìíîïñòóôöõøœùúûüýÿß", "ÀÂÄÁÃÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖÕØŒÙÚÛÜÝŸ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρσςτυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
#: Vowels and consonants of names.
SOUNDS = ("aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", *ALPHABETS[3:5], "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ")
#: Given names by gender and script.
GIVEN = (
    ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Daniel", "Paul", "Mark", "George", "Peter", "Hans", "Pierre", "Carlos",
     "Joseph", "Charles", "Steven", "Andrew", "Kevin", "Brian", "Edward", "Ahmed", "Jürgen", "Klaus", "Stefan", "Jean", "Jacques", "François", "José", "Juan", "Luis", "Miguel", "Antonio"),
    ("Mary", "Anna", "Linda", "Sarah", "Laura", "Julia", "Emma", "Alice", "Helen", "Maria", "Karen", "Susan", "Claire", "Sophie", "Petra", "Carmen",
     "Patricia", "Jennifer", "Elizabeth", "Barbara", "Jessica", "Nancy", "Sandra", "Emily", "Fatima", "Ursula", "Monika", "Sabine", "Marie", "Camille", "Élodie", "Ana", "Lucía", "Isabel", "Rosa"),
    ("Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай"),
    ("Анна", "Мария", "Ольга", "Елена", "Наталья", "Ирина"),
)
#: Endings of Russian family names, which tell gender.
ENDINGS = ("ова", "ева", "ина", "ская", "ов", "ев", "ин", "ский")
_OF = {c: a for a in ALPHABETS for c in a}
_SOUND_OF = {c: a for a in SOUNDS for c in a}
_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}
_GIVEN_OF = {n: names for names in GIVEN for n in names}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω][a-zß-öø-ÿа-яёα-ω'’-]+"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora?|Господин|Госпожа)"
_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)"
#: Kinds in order of precedence, with their patterns and what a text must have at all; a
#: group `v` is the part to replace.
KINDS = {
    "email": (r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "@"),
    "secret": (r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?(?P<v>[^\s\"'<>,;]{6,})", "=:"),
    "access_key": (r"\b(?:AKIA|ASIA)(?P<v>[A-Z0-9]{16})\b", "K"),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b", "0123456789"),
    "card": (r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)", "0123456789"),
    "ip": (rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)", "0123456789"),
    "ssn": (r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])", "0123456789"),
    "phone": (r"(?<![\w.])(?<!\d[ .-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?!\w|[ .-]\d)|(?<![\w.])\+\d{8,15}(?!\w)", "0123456789"),
    "hex": (r"\b(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{32,64}\b", "0123456789"),
    "street": (
        rf"\b\d{{1,5}} (?:{_NAME} ){{1,3}}{_STREET}\b|\b\d{{1,4}},? (?:rue|avenue|boulevard|place) (?:de la |de |du |des )?{_NAME}|"
        rf"\b(?:Calle|Avenida|Plaza) (?:de la |de |del )?{_NAME},? \d{{1,4}}\b|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|platz|gasse) \d{{1,4}}\b",
        "0123456789",
    ),
    "person": (rf"\b{_TITLE}\.? (?P<v>{_NAME}(?: {_NAME})?)|\b(?P<u>(?:{'|'.join(_GIVEN_OF)}) {_NAME})", ""),
}
_PATTERNS = [(k, re.compile(p), set(need)) for k, (p, need) in KINDS.items()]
#: Words of streets that stay.
_FIXED_WORDS = re.compile(rf"\b{_STREET}\b|rue|avenue|boulevard|place|Calle|Avenida|Plaza|\b(?:de la|de|du|des|del|la)\b|straße|strasse|weg|platz|gasse")


def session_key(spark: SparkSession) -> str:
    """The key of spark.codebrook.pii.key; where it is unset, a new one for the whole session."""
    if not spark.conf.get("spark.codebrook.pii.key", None):
        spark.conf.set("spark.codebrook.pii.key", secrets.token_hex(16))
    return spark.conf.get("spark.codebrook.pii.key")


def _digest(key: str, *parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key.encode()[:64], digest_size=64).digest(), "big")


class Permutation:
    """A keyed permutation of the strings of one shape, without fixed points."""

    def __init__(self, key: str, kind: str, shape: str, radices: list[int]):
        half = (len(radices) + 1) // 2
        self.name, self.key = f"{kind}\x1f{shape}", key
        self.left = self.right = 1
        for r in radices[:half]:
            self.left *= r
        for r in radices[half:]:
            self.right *= r

    def mixed(self, x: int, sign: int) -> int:
        a, b = divmod(x, self.right)
        for k in range(ROUNDS) if sign > 0 else reversed(range(ROUNDS)):
            if k % 2:
                b = (b + sign * _digest(self.key, self.name, k, a)) % self.right
            else:
                a = (a + sign * _digest(self.key, self.name, k, b)) % self.left
        return a * self.right + b

    def __call__(self, x: int) -> int:
        return self.mixed((self.mixed(x, 1) + 1) % (self.left * self.right), -1)


def permuted(key: str, kind: str, text: str, of: dict[str, str] = _OF, fixed: int = 0, same=None, own: dict[int, str | None] | None = None) -> str:
    """`text` with its known characters replaced, but for the last `fixed` of them.

    `own` gives places an alphabet of their own, or none. With `same`, walks on until that
    property is the original's; the permutation is one cycle, so this is one too.
    """
    alphabets = [of.get(c) if own is None or i not in own else own[i] for i, c in enumerate(text)]
    spots = [i for i, a in enumerate(alphabets) if a]
    spots = spots[: len(spots) - fixed] if len(spots) > fixed else spots
    if not spots:
        return text
    free = set(spots)
    shape = "".join(f"[{alphabets[i][0]}{len(alphabets[i])}]" if i in free else c for i, c in enumerate(text))
    radices = [len(alphabets[i]) for i in spots]
    step = Permutation(key, kind, shape, radices)
    x = 0
    for i, r in zip(spots, radices):
        x = x * r + alphabets[i].index(text[i])
    while True:
        x = step(x)
        out, y = list(text), x
        for i, r in zip(reversed(spots), reversed(radices)):
            y, k = divmod(y, r)
            out[i] = alphabets[i][k]
        made = "".join(out)
        if same is None or same(made) == same(text):
            return made


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def card(text: str) -> bool:
    """A number with the Luhn check and the first digits of an issuer of cards."""
    return luhn(text) and re.match("4|5|6|3[04-9]|2[2-7]", re.sub("[ -]", "", text)) is not None and not book(text)


def book(text: str) -> bool:
    """A book number of 13 digits."""
    digits = [int(c) for c in text if c.isdigit()]
    return len(digits) == 13 and digits[:2] == [9, 7] and digits[2] > 7 and (sum(digits[::2]) + 3 * sum(digits[1::2])) % 10 == 0


def remainder(account: str) -> int:
    """An account number by 97; 1 if its check digits are right."""
    plain = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def account(key: str, text: str) -> str:
    """An account number of the same country, with its own check digits."""
    made = text[:2] + "00" + permuted(key, "iban", text[4:])
    return f"{made[:2]}{98 - remainder(made):02d}{made[4:]}"


def telephone(key: str, text: str) -> str:
    """The country code stays, and so does a leading 0; in ten digits, 2 to 9 begin area and exchange."""
    code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d|", text).end()
    spots = [i for i in range(code, len(text)) if text[i].isdigit()]
    own: dict[int, str | None] = dict.fromkeys(range(code))
    for i in (spots[0], spots[3]) if len(spots) == 10 else ():
        own[i] = "23456789" if text[i] in "23456789" else None
    if len(spots) != 10 and text[spots[0]] == "0":
        own[spots[0]] = None
    return permuted(key, "phone", text, own=own)


def street(key: str, text: str) -> str:
    """Another number and name of the same kind of street."""
    own: dict[int, str | None] = {i: None for m in _FIXED_WORDS.finditer(text) for i in range(*m.span())}
    for m in re.finditer(r"\d+", text):
        own[m.start()] = "123456789" if text[m.start()] != "0" else None
        own |= dict.fromkeys(range(m.start() + 1, m.end()), ALPHABETS[0])
    return permuted(key, "street", text, _SOUND_OF, own=own)


def address(key: str, text: str) -> str:
    """An address in the same private network, or a public one for a public one."""
    parts = [int(p) for p in text.split(".")]
    private = lambda p: 1 if p[0] in (0, 10, 127) or p[0] >= 224 else 2 if p[:2] in ([192, 168], [169, 254]) or p[0] == 172 and 16 <= p[1] < 32 else 0
    keep = private(parts)
    step = Permutation(key, "ip", ".".join(map(str, parts[:keep])), [256] * (4 - keep))
    x = int.from_bytes(bytes(parts[keep:]), "big")
    while True:
        x = step(x)
        made = parts[:keep] + list(x.to_bytes(4 - keep, "big"))
        if keep or not private(made):
            return ".".join(map(str, made))


def given(key: str, name: str) -> str:
    """Another known name of the list (gender and script) for a known one, else a made-up one."""
    names = _GIVEN_OF.get(name)
    if names is None:
        ending = next((e for e in ENDINGS if name.endswith(e) and len(name) > len(e) + 1), name[-1])
        return permuted(key, "person", name, _SOUND_OF, len(ending), lambda n: n in _GIVEN_OF)
    return names[Permutation(key, "given", names[0], [len(names)])(names.index(name))]


def hexadecimal(text: str) -> bool:
    return all(c in _HEX for c in text)


def surrogate(key: str, kind: str, text: str, again: int = 0) -> str:
    """The replacement of an entity; the next ones where the first `again` ones collide."""
    if again:
        key = f"{_digest(key, 'again', again):x}"
    if kind == "ip":
        return address(key, text)
    if kind == "card":
        return permuted(key, kind, text, same=card, own={0: None})
    if kind == "email":
        name, _, domain = text.partition("@")
        body, _, top = domain.rpartition(".")
        return f"{permuted(key, kind, name)}@{permuted(key, kind, body)}.{top}"
    if kind == "phone":
        return telephone(key, text)
    if kind == "iban":
        return account(key, text)
    if kind == "ssn":
        return permuted(key, kind, text, same=lambda t: bool(_SSN.fullmatch(t)))
    if kind == "street":
        return street(key, text)
    if kind == "secret":
        return permuted(key, kind, text, _HEX if hexadecimal(text) else _OF, same=hexadecimal)
    if kind == "hex":
        return permuted(key, kind, text, _HEX, same=lambda t: bool(re.search("[a-f]", t) and re.search(r"\d", t)))
    if kind == "person":
        return given(key, text)
    return permuted(key, kind, text)


_SSN = re.compile(KINDS["ssn"][0])


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind), in order, without overlaps; names also where they stand alone later."""
    if not text:
        return []
    have = set(text)
    candidates = []
    for rank, (kind, pattern, need) in enumerate(_PATTERNS):
        if need and not have & need:
            continue
        for m in pattern.finditer(text):
            if kind == "card" and not card(m.group()) or kind == "iban" and remainder(m.group()) != 1:
                continue
            part = m.lastgroup if m.lastgroup in ("u", "v") else 0
            candidates.append((m.start(), rank, m.end(), *m.span(part), kind))
    found, names, taken, at = [], set(), [], 0
    for begin, _, end, a, b, kind in sorted(candidates):
        if begin >= at:
            at = end
            taken.append((a, b))
            if kind == "person":
                parts = [(a + m.start(), a + m.end()) for m in re.finditer("[^ ]+", text[a:b])]
                names.update(text[x:y] for x, y in parts)
                found += [(x, y, kind) for x, y in parts]
            else:
                found.append((a, b, kind))
    if names:
        starts = [a for a, _ in taken]
        for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, sorted(names, reverse=True))) + r")\b", text):
            k = bisect_right(starts, m.start()) - 1
            if (k < 0 or taken[k][1] <= m.start()) and (k + 1 == len(taken) or m.end() <= starts[k + 1]):
                found.append((*m.span(), "person"))
    return sorted(found)


def identity(key: str, kind: str, text: str) -> str:
    """What stands for an entity outside the tasks."""
    return f"{_digest(key, 'id', kind, text):0128x}"[:32]


def rewrite(key: str, text: str | None, again: dict[tuple[str, str], int] | None = None) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, original, surrogate) of each entity."""
    spans = entities(text)
    if not spans:
        return text, []
    out, told, at = [], [], 0
    for a, b, kind in spans:
        made = surrogate(key, kind, text[a:b], again.get((kind, identity(key, kind, text[a:b])), 0) if again else 0)
        told.append((kind, text[a:b], made))
        out += [text[at:a], made]
        at = b
    return "".join([*out, text[at:]]), told


def _again(rows: list[dict] | None) -> dict[tuple[str, str], int]:
    return {(r["kind"], r["original"]): r["again"] for r in rows or ()}


def _told(docs: DataFrame, key: str) -> DataFrame:
    """Distinct (kind, original, surrogate, again) over all documents, as keyed hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            told = set()
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                again = _again(own)
                told |= {(k, i, identity(key, k, s), again.get((k, i), 0)) for k, o, s in rewrite(key, text, again)[1] for i in [identity(key, k, o)]}
            columns = list(zip(*told)) or ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(),) * 3 + (pa.int32(),))], ["kind", "original", "surrogate", "again"])

    return docs.select("text", docs.columns[-1]).mapInArrow(rows, "kind string, original string, surrogate string, again int").distinct()


def _plain(docs: DataFrame) -> DataFrame:
    """`docs` and, as its last column, the colliding entities of each text: none so far."""
    return docs.withColumn(unused(docs.columns, "_again")[0], F.lit(None).cast("array<struct<kind: string, original: string, again: int>>"))


def _clashing(told: DataFrame) -> DataFrame:
    """(kind, original, again): of those with one surrogate all but the first, and those whose surrogate is another's original."""
    first = told.groupBy("kind", "surrogate").agg(F.min("original").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = told.join(first, ["kind", "surrogate"]).where("original <> first")
    real = told.where("kind <> 'person'").join(told.select("kind", F.col("original").alias("surrogate")), ["kind", "surrogate"], "left_semi")
    return shared.select("kind", "original", "again").unionByName(real.select("kind", "original", "again")).distinct()


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """Rows (kind, original, again) of entities whose surrogate stands for another one too, or is one."""
    return _clashing(_told(_plain(docs), key))


def _with_again(docs: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """`docs` and, as its last column, the colliding entities of each text; only documents that have some are joined."""
    name, text_hash = unused(docs.columns, "_again", "_text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [(h, k, i) for text, h in zip(*(c.to_pylist() for c in batch.columns)) for k, i in {(k, identity(key, k, text[a:b])) for a, b, k in entities(text)}]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or ([],) * 3, (pa.int64(), pa.string(), pa.string()))], ["text", "kind", "original"])

    held = docs.select("text", F.xxhash64("text").alias("hash")).mapInArrow(rows, "text long, kind string, original string").distinct()
    own = held.join(again, ["kind", "original"]).groupBy(F.col("text").alias(text_hash)).agg(F.collect_list(F.struct("kind", "original", "again")).alias(name))
    own = keep(own)
    own = F.broadcast(own) if own.count() <= SMALL_ROWS else own
    return docs.withColumn(text_hash, F.xxhash64("text")).join(own, text_hash, "left").select(*docs.columns, name)


def replace(docs: DataFrame, key: str, report: bool = False) -> DataFrame:
    """All columns of `docs` with surrogates in the text; with `report` also n_entities and kinds."""
    return _replaced(_plain(docs), key, report)


def _replaced(docs: DataFrame, key: str, report: bool) -> DataFrame:
    extra = [T.StructField("n_entities", T.IntegerType()), T.StructField("kinds", T.StringType())] if report else []
    docs = docs.drop(*(f.name for f in extra))
    names = docs.columns[:-1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, length = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            done = [rewrite(key, text, _again(own)) for text, own in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            columns = list(batch.columns)[: len(names)]
            columns[at] = pa.array([text for text, _ in done], pa.string())
            if length >= 0:
                old = columns[length].to_pylist()
                columns[length] = pa.array([len(text) if told else n for (text, told), n in zip(done, old)], columns[length].type)
            if report:
                columns += [pa.array([len(told) for _, told in done], pa.int32()), pa.array([",".join(sorted({k for k, _, _ in told})) for _, told in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *(f.name for f in extra)])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields[: len(names)], *extra]))


def checked(docs: DataFrame, key: str | None = None, report: bool = False, rounds: int = 100) -> DataFrame:
    """`replace`, with other surrogates for entities that collide over all documents.

    Without a key, the session's is taken. Each round gives those that still collide their next surrogate. A round leaves about
    the share of an entity's shapes that are taken, so `rounds` is a guard against loops.
    """
    key = key or session_key(docs.sparkSession)
    seen, again = _plain(docs), None
    for _ in range(rounds):
        told = keep(_told(seen, key))
        clash = _clashing(told)
        if clash.isEmpty():
            return _replaced(seen, key, report)
        held = told.where("again > 0").select("kind", "original", "again").join(clash.select("kind", "original"), ["kind", "original"], "left_anti")
        again = keep(held.unionByName(clash.withColumn("again", F.col("again") + 1)))
        seen = _with_again(docs, again, key)
    raise RuntimeError(f"entities still collide after {rounds} rounds")

"""Surrogates for personal data: detected entities get keyed replacements of the same type and shape.

A replacement depends on the key, the entity's type and its normalised value alone, so the same entity gets the same
one wherever it stands. Digits are replaced by a keyed permutation of all numbers of their length, which keeps
different entities different; names come from lists of the same gender and script. That no two entities share a
replacement is checked over the whole corpus, and a type in which two do is keyed anew.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.llm.shared import pieces

#: The setting of the session that holds the key, and a key for tests and synthetic tables, which protects nothing.
KEY_SETTING, TEST_KEY = "spark.sonarium.surrogates.key", b"a key for synthetic tables"
#: Times that a type is keyed anew before the check gives up.
ATTEMPTS = 8

# Given names by script and gender, and surnames by script.
GIVEN = {
    ("latin", "f"): ["Anna", "Maria", "Julia", "Laura", "Emma", "Clara", "Alice", "Sofia", "Helen", "Martha", "Irene", "Paula"],
    ("latin", "m"): ["Peter", "Paul", "Thomas", "Martin", "David", "Simon", "Daniel", "Robert", "Victor", "Oscar", "Hugo", "Felix"],
    ("cyrillic", "f"): ["Анна", "Мария", "Ольга", "Елена", "Ирина", "Татьяна"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Сергей", "Андрей", "Павел", "Виктор"],
    ("greek", "f"): ["Μαρία", "Ελένη", "Άννα", "Σοφία"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Πέτρος", "Παύλος"],
}
SURNAME_PARTS = {
    "latin": (["Al", "Ber", "Cor", "Dal", "Er", "Fen", "Gar", "Hol", "Ker", "Lam", "Mor", "Nor", "Os", "Per", "Ros", "Sal", "Tor", "Ver", "Win", "Zel"], ["ba", "de", "fi", "go", "ke", "la", "mo", "na", "ri", "sa", "te", "vo"], ["man", "ner", "berg", "son", "ley", "ton", "lin", "der", "mont", "field"]),
    "cyrillic": (["Бе", "Во", "Го", "Да", "Ки", "Ла", "Мо", "Но", "Пе", "Ро", "Со", "То"], ["ба", "ви", "га", "до", "ки", "ле", "ма", "ни"], ["нов", "лин", "ров", "тин", "шев", "ков"]),
    "greek": (["Αλ", "Βα", "Γε", "Δη", "Κα", "Λα", "Μα", "Νι", "Πα", "Στα"], ["βα", "γο", "κα", "λι", "μα", "νο", "ρι", "τα"], ["δης", "λος", "κης", "πουλος", "ρης"]),
}
# Titles that stand before a name, by gender.
TITLES = {"Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Mme": "f", "Sra": "f", "Mr": "m", "Herr": "m", "Sr": "m", "Dr": "", "Prof": ""}

GIVEN_NAMES = "|".join(sorted({n for names in GIVEN.values() for n in names}, key=lambda n: (-len(n), n)))
LETTERS = r"[^\W\d_]"
UPPER = "[" + "".join(c for c in map(chr, (*range(0x530), *range(0x1E00, 0x2000))) if c.isupper()) + "]"
LOWER = "[" + "".join(c for c in map(chr, (*range(0x530), *range(0x1E00, 0x2000))) if c.islower()) + "]"
TITLED = rf"(?:\b(?:{'|'.join(TITLES)})\b\.? )+"
#: A capitalised word of a name, also McDonald, O'Brien and Anna-Maria.
NAME = rf"(?:{UPPER}['’])?{UPPER}{LETTERS}*{LOWER}(?!{LETTERS})"
NAME = rf"{NAME}(?:-{NAME})*"
#: Words within a name that are left as they are.
PARTICLES = {"von", "van", "de", "der", "den", "di", "da", "del", "la", "le", "zu"}
BEFORE = rf"(?:(?:{'|'.join(PARTICLES)}) )*"
#: Type and pattern, in order: where two match at a place, the first is taken.
PATTERNS = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ipv6", r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}(?![\w:]|\.\d)"),
    ("ipv4", r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)"),
    ("secret", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32,64}|[0-9A-F]{32,64})\b"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w-])(?:\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{13,16})(?![\w-])"),
    ("phone", r"(?<![\w+])\+\d(?:[ ./-]?\(?\d\)?){7,14}(?![\w-])|(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w+])\+\d{8,15}(?!\w)"),
    ("person", rf"{TITLED}{BEFORE}{NAME}(?: {BEFORE}{NAME}){{0,3}}|(?<!\w)(?:{GIVEN_NAMES})(?: {BEFORE}{NAME}){{1,3}}"),
]
FINDER = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS))
#: A text without a digit, an @, a title or a given name has no entity.
HINT = re.compile(r"[0-9@]|\b(?:" + "|".join(TITLES) + "|" + GIVEN_NAMES + r")\b")


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """Start, end and type of the entities of a text, in order, without overlaps; of a null or empty text, none."""
    if not text or not HINT.search(text):
        return []
    found = []
    for m in FINDER.finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind == "ipv6" and not _address(value):
            continue
        if kind == "secret" and not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
            continue
        found.append((m.start(), m.end(), kind))
    names = {n for a, b, kind in found if kind == "person" for n in _bare(text[a:b])}
    if not names:
        return found
    spans, k = list(found), 0
    for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(names, key=lambda n: (-len(n), n))))})(?!\w)", text):
        while k < len(found) and found[k][1] <= m.start():
            k += 1
        if k == len(found) or found[k][0] >= m.end():
            spans.append((m.start(), m.end(), "person"))
    return sorted(spans)


def _address(value: str) -> bool:
    """Whether an address is valid; a short form with few digits, such as the slice 1::2, is none."""
    groups = [g for g in value.split(":") if g]
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return "::" not in value or len(groups) > 1 and max(map(len, groups)) > 2 and any(c.isdigit() for c in value)


def _named(value: str) -> tuple[str, str]:
    """The titles of a mention, with the space after them, and the name; a bare name has no title."""
    at = m.end() if (m := re.match(TITLED, value)) else 0
    return value[:at], value[at:]


def _bare(value: str) -> list[str]:
    """The whole name of a mention and each word of it, by which it may be mentioned again."""
    name = _named(value)[1]
    return [name, *(part for part in name.split(" ") if part not in PARTICLES)]


def _full(value: str) -> bool:
    """Whether an untitled name begins with a given name of the lists and has more to it."""
    first, _, more = value.partition(" ")
    return bool(more and gender_of(first))


def normal(kind: str, value: str) -> str:
    """What makes two mentions the same entity: spelling and separators left aside."""
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "phone":
        return re.sub(r"[^\d+]", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "email":
        return value.lower()
    if kind == "ipv6":
        return ipaddress.IPv6Address(value).exploded
    if kind == "person":
        return _named(value)[1]
    return value


def _stream(key: bytes, *what: str) -> Iterator[int]:
    """Bytes that follow from the key and the words, without end."""
    n = 0
    while True:
        yield from hmac.digest(key, "\x1f".join([*what, str(n)]).encode("utf-8", "surrogatepass"), "sha256")
        n += 1


def _number(key: bytes, below: int, *what: str) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(what).encode("utf-8", "surrogatepass"), "sha256"), "big") % below


def permuted(key: bytes, symbols: str, domain: int) -> str:
    """A keyed permutation of the strings of one length over digits of a base: a Feistel network of ten rounds."""
    n = len(symbols)
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    if n == 1:
        return digits[(int(symbols, domain) + _number(key, domain, "one", str(domain))) % domain]
    u = n // 2
    v = n - u
    a, b = int(symbols[:u], domain), int(symbols[u:], domain)
    sizes = (domain**u, domain**v)
    for i in range(10):
        if i % 2 == 0:
            a = (a + _number(key, sizes[0], str(n), str(domain), str(i), str(b))) % sizes[0]
        else:
            b = (b + _number(key, sizes[1], str(n), str(domain), str(i), str(a))) % sizes[1]

    def text(x: int, length: int) -> str:
        out = []
        for _ in range(length):
            x, r = divmod(x, domain)
            out.append(digits[r])
        return "".join(reversed(out))

    return text(a, u) + text(b, v)


def _luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _digits(key: bytes, value: str, leave: int, alike: Callable[[str], object]) -> str:
    """value with its digits, after the first `leave`, permuted together.

    The permutation is walked on until the number differs and is like the old one (a valid checksum stays valid):
    so walked, it is still a permutation.
    """
    found = "".join(c for c in value if c.isdigit())
    own = found[leave:]
    fresh = permuted(key, own, 10)
    while len(own) > 1 and fresh != own and alike(found[:leave] + fresh) != alike(found):
        fresh = permuted(key, fresh, 10)
    pool = iter(found[:leave] + fresh)
    return "".join(next(pool) if c.isdigit() else c for c in value)


def _letters(key: bytes, kind: str, value: str) -> str:
    """Every ASCII letter and digit replaced by another of its class, by a stream that follows from the value."""
    stream, out = _stream(key, kind, value), []
    for c in value:
        if "a" <= c <= "z":
            out.append(chr(97 + next(stream) % 26))
        elif "A" <= c <= "Z":
            out.append(chr(65 + next(stream) % 26))
        else:
            out.append(chr(48 + next(stream) % 10) if "0" <= c <= "9" else c)
    return "".join(out)


def _hex(key: bytes, value: str) -> str:
    return permuted(key, value.lower(), 16)


def script_of(name: str) -> str:
    """The script of a name's first letter."""
    first = ord(name[0])
    return "cyrillic" if 0x400 <= first < 0x530 else "greek" if 0x370 <= first < 0x400 else "latin"


@lru_cache(maxsize=4096)
def gender_of(given: str) -> str:
    """f or m for a given name of the lists, else nothing."""
    return next((gender for (_, gender), names in GIVEN.items() if given in names), "")


def _person(key: bytes, value: str, attempt: int) -> str:
    """Title kept, given name from the list of its gender and script, surname made up; each follows from its own part,
    so that a surname alone is replaced as it is after a given name."""
    title, name = _named(value)
    *first, last = name.split(" ")
    told = [g for t in title.split() if (g := TITLES[t.rstrip(".")])]
    gender = (gender_of(first[0]) if first else "") or (told[-1] if told else "fm"[_number(key, 2, "gender", name)])
    script = script_of(name)
    heads, middles, tails = SURNAME_PARTS[script]
    parts = [heads, *[middles] * (2 + 2 * attempt), tails]
    surname = "".join(table[_number(key, len(table), "surname", str(i), last)] for i, table in enumerate(parts))
    given = GIVEN[(script, gender)]
    longer = lambda g: "".join(middles[_number(key, len(middles), "longer", str(i), g)] for i in range(2 * attempt))
    return title + " ".join([*(g if g in PARTICLES else given[_number(key, len(given), "given", g)] + longer(g) for g in first), surname])


def _email(key: bytes, value: str, attempt: int) -> str:
    local, _, domain = value.lower().partition("@")
    stream = _stream(key, "local", value.lower())
    fresh = "".join(chr(97 + next(stream) % 26) if c.isalpha() else str(next(stream) % 10) if c.isdigit() else c for c in local)
    fresh += "".join(chr(97 + next(stream) % 26) for _ in range(len(fresh), 12 + 4 * attempt))  # room enough that none collide
    return f"{fresh}@{_letters(key, 'domain', domain.rpartition('.')[0])}.example"


def _ipv4(key: bytes, value: str) -> str:
    x = int.from_bytes(bytes(map(int, value.split("."))), "big")
    a, b = x >> 16, x & 0xFFFF
    for i in range(10):
        if i % 2 == 0:
            a ^= _number(key, 1 << 16, "ip", str(i), str(b))
        else:
            b ^= _number(key, 1 << 16, "ip", str(i), str(a))
    return ".".join(map(str, (a << 16 | b).to_bytes(4, "big")))


def _ipv6(key: bytes, value: str) -> str:
    fresh = permuted(key, ipaddress.IPv6Address(value).exploded.replace(":", ""), 16)
    return ":".join(fresh[i : i + 4] for i in range(0, 32, 4))


def _shaped(fresh: str, symbols: Callable[[str], bool], value: str) -> str:
    pool = iter(c for c in fresh if symbols(c))
    return "".join(next(pool) if symbols(c) else c for c in value)


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of a mention: it follows from the key, the type and the normalised value, in the mention's form.

    Later attempts draw given names, surnames and addresses from longer, so many more, possible ones.
    """
    own = hmac.digest(key, kind.encode(), "sha256")
    plain = normal(kind, value)
    if kind == "person":
        return _person(own, value, attempt)
    if kind == "email":
        return _email(own, value, attempt)
    if kind == "ipv4":
        return _ipv4(own, value)
    if kind == "ipv6":
        return _ipv6(own, value)
    if kind == "secret":
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
            fresh = _hex(own, value)
            return fresh.upper() if value.upper() == value else fresh
        cut = max(value.find("_"), value.find("-")) + 1 if not value.startswith("AKIA") else 4
        return value[:cut] + _letters(own, kind, value[cut:])
    if kind == "iban":
        fresh = plain[:2] + _letters(own, kind, plain[2:])
        if _mod97(plain) == 1:  # a valid checksum stays valid
            fresh = f"{fresh[:2]}{98 - _mod97(f'{fresh[:2]}00{fresh[4:]}'):02d}{fresh[4:]}"
        return _shaped(fresh, str.isalnum, value)
    leave = max(0, len(plain) - 11) if kind == "phone" and plain.startswith("+") else 0
    return _shaped(_digits(own, plain, leave, alike=_luhn if kind == "card" else len), str.isdigit, value)


def key_of(spark: SparkSession, otherwise: bytes | None = None) -> bytes:
    """The key that the session is set to; without one, the other, and without that there is no going on."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key and otherwise is None:
        raise ValueError(f"surrogates need a secret key: set {KEY_SETTING}")
    return key.encode() if key else otherwise


def keys_for(attempts: dict[str, int], key: bytes) -> dict[str, tuple[bytes, int]]:
    """A key and the attempt's number for each type; a type that has been keyed anew has another key."""
    return {kind: (hashlib.sha256(key + b"/%d" % n).digest() if (n := attempts.get(kind, 0)) else key, n) for kind, _ in PATTERNS}


def replaced(text: str, found: list[tuple[int, int, str]], keys: dict[str, tuple[bytes, int]]) -> str:
    """The text with its entities' replacements; a bare name gets what replaces it after a title or a given name."""
    out, at, known = [], 0, {}
    people = [text[start:end] for start, end, kind in found if kind == "person"]
    for value in sorted(people, key=lambda v: not _named(v)[0]):  # the titled ones first
        if _named(value)[0] or value not in known and _full(value):
            fresh = surrogate("person", value, *keys["person"])
            known = dict(zip(_bare(value), _bare(fresh), strict=True)) | known
    for start, end, kind in found:
        value = text[start:end]
        out += [text[at:start], known[value] if kind == "person" and not _named(value)[0] else surrogate(kind, value, *keys[kind])]
        at = end
    return "".join(out) + text[at:]


def known_entities(df: DataFrame, text: str, keys: dict[str, tuple[bytes, int]]) -> DataFrame:
    """kind, entity (normalised) and surrogate (normalised) of all entities of the texts, repeats within a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            seen = {(kind, normal(kind, t[a:b])): t[a:b] for t in batch.column(0).to_pylist() for a, b, kind in entities(t) if kind != "person" or _named(t[a:b])[0] or _full(t[a:b])}
            rows = [(kind, entity, normal(kind, surrogate(kind, value, *keys[kind]))) for (kind, entity), value in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["kind", "entity", "surrogate"])

    return df.select(text).mapInArrow(run, "kind string, entity string, surrogate string")


def settled_keys(df: DataFrame, text: str, key: bytes) -> dict[str, tuple[bytes, int]]:
    """Keys under which no two entities of the texts share a surrogate, one for each type.

    Collisions are counted by aggregation over the distinct entities; only their number a type comes to the driver.
    """
    attempts: dict[str, int] = {}
    for _ in range(ATTEMPTS):
        pairs = known_entities(df, text, keys_for(attempts, key))
        shared = pairs.groupBy("kind", "surrogate").agg(F.min("entity").alias("one"), F.max("entity").alias("other")).filter("one <> other")
        found = {r["kind"]: r["n"] for r in shared.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        if not found:
            return keys_for(attempts, key)
        attempts |= {kind: attempts.get(kind, 0) + 1 for kind in found}
    raise ValueError(f"surrogates of {sorted(found)} collide under {ATTEMPTS} keys")


def with_surrogates(df: DataFrame, text: str = "text", key: bytes | None = None, count: str | None = None) -> DataFrame:
    """df with the text's entities replaced; count names a column to add, the number of entities replaced.

    The key is the session's unless one is given; who knows it can take digits' replacements back, so keep it.

    Null and empty texts stay as they are. All other columns, and all rows, stay; the same entity has the same
    surrogate in every row, and different entities of a type have different ones.
    """
    keys = settled_keys(df, text, key or key_of(df.sparkSession))
    place = df.columns.index(text)
    schema = df.select("*", F.lit(0).cast("long").alias(count)).schema if count else df.schema
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(place).to_pylist()
            found = [entities(t) for t in texts]
            fresh = pa.array([replaced(t, f, keys) if f else t for t, f in zip(texts, found, strict=True)], pa.string())
            columns = list(batch.columns)
            columns[place] = fresh
            if count:
                columns.append(pa.array([len(f) for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)

"""PII: keyed, type-consistent surrogates for detected entities.

Detected: e-mail addresses, phone numbers (international, bracketed, ddd ddd dddd, and national ones
from a 0 on, in two or three groups), IPv4 and IPv6 addresses, long digit numbers (cards, accounts), social security
numbers, long hexadecimal secrets, access key ids with a digit, and persons (a known given
name followed by a surname; later mentions of either part alone in the same text follow).
Not detected: other persons, postal addresses, IBANs, secrets of other forms.

Every entity is spelled in slots -- digits, hexadecimal digits, vowels or consonants of its
script, address octets by their number of digits -- and the slots are read as one number in
mixed radix.  A keyed Feistel permutation of that range, conjugated with a step of one,
gives the surrogate: same type, script, length, case and punctuation, never the original,
and never the same for two originals.  Digits that pass the check of card numbers pass it after, others fail it after.  An e-mail
address keeps its top-level domain and, unless that is reserved already (example.com, .net, .org), gets ``.example``
behind it, so that no surrogate reaches anybody.  Given names are permuted within the names of their
script and gender.  So distinctness and coreference hold over the whole corpus without any
table of entities; ``collisions`` checks it on the entities that really occur.  The key is the
caller's: whoever has it can turn surrogates back.  ``session_key`` reads it from the session's settings.

Defined cases: null text stays null, empty text empty; overlapping candidates go to the
earlier start, then to the type listed first; texts of any length are read whole; repeated
rows get equal results; an empty table gives an empty result; other columns are carried, one named as the spans is refused.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from bisect import bisect
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histofold.llm.common import refuse, ship

# Given names by script and gender (fixed values).
NAMES: dict[tuple[str, str], tuple[str, ...]] = {
    ("latin", "f"): ("Anna", "Maria", "Julia", "Laura", "Sophie", "Emma", "Clara", "Elena", "Lucia", "Marie", "Alice", "Sarah"),
    ("latin", "m"): ("Peter", "Paul", "Thomas", "John", "James", "Robert", "David", "Daniel", "Carlos", "Pierre", "Hans", "Michael"),
    ("cyrillic", "f"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Юлия"),
    ("cyrillic", "m"): ("Иван", "Пётр", "Алексей", "Дмитрий", "Сергей", "Андрей", "Михаил", "Павел"),
    ("greek", "f"): ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Άννα", "Ιωάννα"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Κώστας", "Δημήτρης", "Γιάννης", "Πέτρος"),
}
# Letters of a script by kind (fixed values).
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäèéêëìíîïòóôöùúûü", "çñßšžćč", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ",
           "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ")
DIGITS, HEX = "0123456789", "0123456789abcdef"
#: Setting that holds the key (Spark hides settings of this name in its logs).
SECRET = "spark.histofold.pii.secret"

_GIVEN = {n: group for group, names in NAMES.items() for n in names}
_EMAIL = r"[^\W_](?:[\w.%+-]{0,62}[\w%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
TYPES: tuple[tuple[str, str], ...] = (
    ("email", rf"(?<![^\W_]){_EMAIL}(?![A-Za-z0-9])"),
    ("access", r"(?<![0-9A-Za-z])A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    ("ip6", r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
            r"|[0-9A-Fa-f]{4}:(?:[0-9A-Fa-f]{1,4}:){0,5}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"),
    ("secret", r"(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{32,64}(?![0-9A-Za-z])"
               r"|(?<![0-9A-Za-z])(?=[0-9A-F]*[A-F])(?=[0-9A-F]*\d)[0-9A-F]{32,64}(?![0-9A-Za-z])"),
    ("phone", r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
              r"|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]\d)"
              r"|(?<![\d.-])(?<!\d )(?:\d{3} \d{3} \d{4}|0\d{2,4} \d{3,4} \d{3,4}|0\d{3,4} \d{6,7})(?![ .-]?\d)"),
    ("ip", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]\d)"),
    ("number", r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"),
)
_DETECT = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in TYPES))
#: Every entity but a person holds one of these, and is at most so long after the first of them.
_HINT, _REACH = re.compile(r"[@\d]"), 400
_RESERVED = re.compile(r"(?i)(?<=[@.])example\.(?:com|net|org)$")
_ENDING = re.compile(r"\.[A-Za-z]+$")
_CAPITAL = re.compile(r"[A-ZÀ-ÞА-ЯЁΆ-Ω]\w{2,}")
_PERSON = re.compile(r"\b(" + "|".join(sorted(_GIVEN)) + r")\s+([A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω][A-Za-zÀ-ÖØ-öø-ÿА-яЁёΆ-ώ]+)\b")


def _permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """Keyed permutation of range(size): a balanced Feistel network, walked until inside the range."""
    half = max(1, (size.bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def turn(k: int, right: int) -> int:
        message = f"{tweak}|{size}|{k}|{right}".encode()
        return int.from_bytes(hmac.digest(key, message, "sha256")[:half // 8 + 1], "big") & mask if half <= 240 else (
            int.from_bytes(hashlib.shake_256(key + message).digest(half // 8 + 1), "big") & mask)

    while True:
        left, right = value >> half, value & mask
        for k in reversed(range(4)) if back else range(4):
            if back:
                left, right = right ^ turn(k, left), left
            else:
                left, right = right, left ^ turn(k, right)
        value = left << half | right
        if value < size:
            return value


def _other(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed bijection of range(size) without fixed points (for size > 1)."""
    if size < 2:
        return value
    return _permute((_permute(value, size, key, tweak) + 1) % size, size, key, tweak, back=True)


def _slots(kind: str, text: str) -> list[tuple[int, int, int, object]]:
    """(start, end, radix, spelling) of the parts of an entity that change."""
    out: list[tuple[int, int, int, object]] = []
    if kind == "ip":
        for m in re.finditer(r"\d+", text):
            low, high = {1: (0, 9), 2: (10, 99), 3: (100, 255)}[len(m.group())]
            out.append((m.start(), m.end(), high - low + 1, low))
        return out
    stop = len(text)
    skip = 0
    if kind == "email":
        stop = (_RESERVED.search(text) or _ENDING.search(text)).start()  # the top-level domain stays, and so do reserved ones
    if kind == "access":
        skip = 4  # the prefix names the kind of key
    if kind == "phone" and text.startswith("+"):
        skip = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", text).end()  # so does the country code
    for i in range(skip, stop):
        c = text[i].lower()
        alphabet = HEX if kind in ("secret", "ip6") else DIGITS if c in DIGITS else next((a for a in LETTERS if c in a), "")
        if c in alphabet and alphabet:
            out.append((i, i + 1, len(alphabet), alphabet))
    return out


def canonical(kind: str, text: str) -> str:
    """The entity behind a mention: case does not matter in addresses and secrets."""
    return text.lower() if kind in ("email", "secret", "ip6") else text


def _check_sum(text: str) -> int:
    """Weighted digit sum of a card number, modulo 10: 0 where its check digit is right."""
    digits = [int(c) for c in reversed(text) if c in DIGITS]
    return sum(sum(divmod(d * (1 + k % 2), 10)) for k, d in enumerate(digits)) % 10


def _respelled(kind: str, text: str, key: bytes) -> str:
    """The text with its slots permuted among all spellings of its shape."""
    slots = _slots(kind, text)
    base = canonical(kind, text)
    value, size = 0, 1
    shape = list(base)
    for a, b, radix, spelling in slots:
        digit = int(base[a:b]) - spelling if isinstance(spelling, int) else spelling.index(base[a].lower())
        value, size = value * radix + digit, size * radix
        shape[a:b] = "#" * (b - a)
    value = _other(value, size, key, f"{kind}|{''.join(shape)}|{','.join(str(s[2]) for s in slots)}")
    out = list(text)
    for a, b, radix, spelling in reversed(slots):
        value, digit = divmod(value, radix)
        new = str(digit + spelling) if isinstance(spelling, int) else spelling[digit]
        out[a:b] = new.upper() if text[a].isupper() else new
    return "".join(out)


def surrogate(kind: str, text: str, key: bytes) -> str:
    """The replacement of one mention (persons: given name and surname apart)."""
    if kind == "given":
        names = NAMES[_GIVEN[text]]
        return names[_other(names.index(text), len(names), key, "/".join(_GIVEN[text]))]
    if kind == "number" and not _check_sum(text):  # the last digit follows from the others
        new = _respelled("checked", text[:-1], key)
        return f"{new}{-_check_sum(new + '0') % 10}"
    new = _respelled(kind, text, key)
    while kind == "number" and not _check_sum(new):  # walked on among the numbers without a right check digit
        new = _respelled(kind, new, key)
    return f"{new}.example" if kind == "email" and not _RESERVED.search(text) else new


@lru_cache(maxsize=1 << 16)
def _cached(kind: str, text: str, key: bytes) -> str:
    return surrogate(kind, text, key)


def _regions(text: str):
    """(start, end) of the stretches that may hold entities other than persons."""
    start = end = -1
    for m in _HINT.finditer(text):
        at = m.start()
        if at <= end:
            end = max(end, at + _REACH)
            continue
        if end >= 0:
            yield start, end
        token = max((text.rfind(c, max(0, at - _REACH), at) for c in " \t\n\r"), default=-1)
        start, end = max(token + 1, at - _REACH, end + 1), at + _REACH
    if end >= 0:
        yield start, end


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text, in order and without overlap."""
    found: list[tuple[int, int, str]] = []
    for start, end in _regions(text):
        found += [(m.start(), m.end(), m.lastgroup) for m in _DETECT.finditer(text, start, min(end, len(text)))]
    if not _GIVEN.keys().isdisjoint(_CAPITAL.findall(text)):
        parts: dict[str, str] = {}
        for m in _PERSON.finditer(text):
            parts |= {m[2]: "surname", m[1]: "given"} if m[2] not in _GIVEN else {m[1]: "given", m[2]: "given"}
        if parts:  # whole mentions and later parts alone, the same everywhere in the text
            taken = sorted(found)
            either = "|".join(sorted(map(re.escape, parts), key=len, reverse=True))
            for m in re.finditer(rf"(?<![\w@.-])(?:{either})(?![\w@])", text):
                k = bisect(taken, (m.end(),))
                if not (k and taken[k - 1][1] > m.start()) and (parts[m.group()] == "given" or _slots("surname", m.group())):
                    found.append((m.start(), m.end(), parts[m.group()]))
    return sorted(found)


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the (start, end, type) they have in it."""
    out, spans, at, size = [], [], 0, 0
    for a, b, kind in entities(text):
        new = _cached(kind, text[a:b], key)
        out += [text[at:a], new]
        size += a - at
        spans.append((size, size + len(new), kind))
        size += len(new)
        at = b
    return ("".join([*out, text[at:]]), spans) if out else (text, spans)


def session_key(spark: SparkSession) -> bytes:
    """The key of the setting ``SECRET``; a session without it gets a random one, kept until it ends."""
    if not spark.conf.get(SECRET, ""):
        spark.conf.set(SECRET, secrets.token_hex(32))
    return spark.conf.get(SECRET).encode()


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str | None = "entities") -> DataFrame:
    """``docs`` with surrogates in the text and, if named, their (start, end, type) in ``spans_col``."""
    refuse(docs, *([spans_col] if spans_col else []))
    ship(docs.sparkSession)
    found = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                      T.StructField("type", T.StringType())]))
    schema = T.StructType([*docs.schema.fields, *([T.StructField(spans_col, found)] if spans_col else [])])
    names = schema.names
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string())]))

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            done = [(None, []) if not t.is_valid else replaced(t.as_py(), key) for t in batch.column(place)]
            columns = list(batch.columns)
            columns[place] = pa.array([t for t, _ in done], pa.string())
            if spans_col:
                spans = [[{"start": a, "end": b, "type": k} for a, b, k in s] for _, s in done]
                columns.append(pa.array(spans, kind))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


def mentions(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(type, original, surrogate) of every entity that occurs, once each."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = set()
            for t in batch.column(0):
                text = t.as_py() or ""
                rows |= {(k, canonical(k, text[a:b]), canonical(k, _cached(k, text[a:b], key))) for a, b, k in entities(text)}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*sorted(rows))],
                                                 ["type", "original", "surrogate"])

    return docs.select(text_col).mapInArrow(run, "type string, original string, surrogate string").distinct()


def collisions(found: DataFrame) -> DataFrame:
    """(type, surrogate, n) of surrogates given to more than one original, or to itself."""
    return (found.groupBy("type", "surrogate").agg(F.count(F.lit(1)).alias("n"),
                                                   F.max(F.col("original") == F.col("surrogate")).alias("same"))
            .where((F.col("n") > 1) | F.col("same")).select("type", "surrogate", "n"))


def checked(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str | None = "entities") -> DataFrame:
    """``pseudonymise`` after the collision check over all entities of ``docs``; raises where one is found."""
    bad = collisions(mentions(docs, key, text_col)).limit(1).collect()
    if bad:
        raise ValueError(f"surrogate of type {bad[0]['type']} stands for {bad[0]['n']} originals")
    return pseudonymise(docs, key, text_col, spans_col)

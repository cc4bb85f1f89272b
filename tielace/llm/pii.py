"""Format-preserving pseudonyms: keyed Feistel permutations of validated numbers, dates and addresses."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import text_batches, tidy

#: Not a secret: a default for tests and reports. Pass your own.
DEFAULT_KEY = b"tielace-pseudonyms"
ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

LOWER, UPPER, DIGITS, HEXES = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
SMALL = str.maketrans(UPPER, LOWER)
#: What a secret may hold besides letters and digits.
SYMBOLS = "!#$%*+-./:=?@\\^_~"
#: Letters outside ASCII are permuted within their block of so many code points, by category where that has LEAST_ALIKE letters there.
BLOCK, LEAST_ALIKE = 128, 8
#: Values of more characters than this are permuted character by character, shorter ones as one number.
LONGEST_NUMBER = 32

#: Country calling codes of one and of two digits; all others have three.
SHORT_CODES = ("1", "7")
TWO_DIGIT_CODES = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
    "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86",
    "90", "91", "92", "93", "94", "95", "98",
)

#: What names the secret that follows it, and what a secret is made of.
SECRET = r"\b(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*"
OWN = r"[^\s\"'`<>,;&|()\[\]{}]"

#: A pattern a kind, tried in this order at a place. Numbers and dates are validated afterwards; what fails stays.
PATTERNS = {
    "email": r"[\w.%+\-]+@(?:[\w\-]+\.)+[^\W\d_]{2,}",
    # After a colon, what has neither quotes nor a digit nor a capital within it is a word of prose.
    "value": rf"{SECRET}(?:=\s*[\"']?|:\s*[\"']|:\s*(?={OWN}*(?:\d|[a-z][A-Z])))(?P<own>{OWN}{{6,}})",
    "access": r"\bA[KS]IA(?P<own>[A-Z0-9]{16})\b",
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "date": r"(?<![\d./\-])(?:(?:19|20)\d\d([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2(?:19|20)\d\d)(?![\d/\-]|\.\d)",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "ip6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{0,4}){2,8}(?![\w:]|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d])",
    "phone": r"(?<![\w+])(?:(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}|\+\d{1,3}(?:[ .\-/]?\(\d{1,4}\))?(?:[ .\-/]?\d{2,8}){1,5}|\+\d{8,15})(?![\w\-])",
}
COMPILED = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
#: Where any of them may begin; the groups within are numbered anew.
BEGINS = re.compile(rf"(?<![\w.%+\-])[\w.%+\-]++@|{SECRET}[=:]|\bA[KS]IA[A-Z0-9]|\b[A-Z]{{2}}\d{{2}}[ A-Z0-9]|(?<![\w:.])(?:[0-9A-Fa-f]{{1,4}}|:):[0-9A-Fa-f:]|(?<!\w)[+(]?\d(?=[\d ().\-/]{{6}})")
#: Every match has one of these.
HINT = re.compile(r"[0-9@]|[=:]")


class Pseudonyms:
    """Permutations under one key; equal values of a kind always map to equal ones, distinct to distinct."""

    def __init__(self, key: bytes = DEFAULT_KEY):
        self.key = hashlib.blake2b(key).digest()
        self.seen: dict[tuple[str, str], str] = {}

    def mixed(self, label: bytes, turn: int, half: bytes, size: int) -> bytes:
        """size bytes that hang on the key, the label, the round and all of the other half."""
        return hashlib.shake_256(self.key + len(label).to_bytes(4) + label + bytes([turn]) + half).digest(size)

    def permute(self, kind: str, x: int, size: int) -> int:
        """A keyed permutation of range(size): an alternating Feistel network on a grid that covers it, walked until it is back inside."""
        if size < 2:
            return x
        high = math.isqrt(size - 1) + 1
        low = -(-size // high)
        width = -(-high.bit_length() // 8)
        label = f"{kind}|".encode() + size.to_bytes(2 * width + 1)
        while True:
            halves, ranges = list(divmod(x, low)), (high, low)
            for turn in range(ROUNDS):
                own = turn % 2
                mixed = self.mixed(label, turn, halves[1 - own].to_bytes(width), width + 16)
                halves[own] = (halves[own] + int.from_bytes(mixed)) % ranges[own]
            x = halves[0] * low + halves[1]
            if x < size:
                return x

    def permute_all(self, kind: str, codes: list[int], sizes: list[int]) -> list[int]:
        """A keyed permutation of lists with 0 <= codes[i] < sizes[i]: the network's halves are the list's, place by place."""
        label, half = f"{kind}|".encode() + bytes(sizes), len(codes) // 2
        halves, ranges = [codes[:half], codes[half:]], [sizes[:half], sizes[half:]]
        for turn in range(ROUNDS):
            own = turn % 2
            mixed = self.mixed(label, turn, bytes(halves[1 - own]), 8 * len(halves[own]))
            halves[own] = [(c + int.from_bytes(mixed[8 * i : 8 * i + 8])) % n for i, (c, n) in enumerate(zip(halves[own], ranges[own], strict=True))]
        return halves[0] + halves[1]

    def spelled(self, kind: str, text: str, alphabets: list[str | None]) -> str:
        """text with its characters permuted together, each within its alphabet; None keeps a character."""
        at = [i for i, a in enumerate(alphabets) if a]
        codes, sizes = [alphabets[i].index(text[i]) for i in at], [len(alphabets[i]) for i in at]
        if len(at) > LONGEST_NUMBER:
            codes = self.permute_all(kind, codes, sizes)
        else:
            x = 0
            for c, n in zip(codes, sizes, strict=True):
                x = x * n + c
            x = self.permute(kind, x, math.prod(sizes))
            for k in reversed(range(len(at))):
                x, codes[k] = divmod(x, sizes[k])
        found = list(text)
        for i, c in zip(at, codes, strict=True):
            found[i] = alphabets[i][c]
        return "".join(found)

    def replaced(self, kind: str, text: str) -> str | None:
        """The pseudonym of a match, or None if the text isn't a valid one of its kind."""
        found = self.seen.get((kind, text))
        if found is None:
            found = KINDS[kind](self, text)
            found = None if found == text else found  # of one character that has no other: nothing is replaced
            if len(self.seen) > 50_000:
                self.seen.clear()
            if found is not None and len(text) < 256:
                self.seen[kind, text] = found
        return found


@cache
def block_alphabets(block: int) -> dict[str, str]:
    """The alphabet of each letter and digit of a block of code points beyond ASCII; alphabets don't overlap."""
    alike: dict[str, str] = {}
    for c in map(chr, range(block * BLOCK, (block + 1) * BLOCK)):
        if c.isalnum():
            kind = unicodedata.category(c)
            alike[kind] = alike.get(kind, "") + c
    rest = "".join(a for a in alike.values() if len(a) < LEAST_ALIKE)
    return {c: a if len(a) >= LEAST_ALIKE else rest for a in alike.values() for c in a}


def classes(text: str, others: str = "") -> list[str | None]:
    """Each character's own class: small, capital, digit, one of the others, letters of its block beyond ASCII, or None."""
    ascii_classes = (LOWER, UPPER, DIGITS, others)
    return [next((a for a in ascii_classes if c in a), None) if c.isascii() else block_alphabets(ord(c) // BLOCK).get(c) for c in text]


def onto(text: str, digits: str) -> str:
    """text with its digits replaced one by one."""
    rest = iter(digits)
    return "".join(next(rest) if c in DIGITS else c for c in text)


def luhn(digits: str) -> int:
    return sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(digits))) % 10


def _card(p: Pseudonyms, text: str) -> str | None:
    digits = "".join(c for c in text if c in DIGITS)
    if not 13 <= len(digits) <= 19 or luhn(digits) or len(set(digits)) == 1:
        return None
    body = digits[0] + p.spelled("card", digits[1:-1], [DIGITS] * (len(digits) - 2))
    return onto(text, body + str(-luhn(body + "0") % 10))


def _ssn(p: Pseudonyms, text: str) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(p.permute("ssn", x, 898 * 99 * 9999), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03}-{group + 1:02}-{serial + 1:04}"


def _phone(p: Pseudonyms, text: str) -> str | None:
    # The zero of +49 (0)30 isn't part of the number.
    head, zero, tail = text.partition("(0)") if text.startswith("+") else (text, "", "")
    digits = "".join(c for c in head + tail if c in DIGITS)
    code = "1" if digits[0] == "1" and len(digits) == 11 else ""
    if len(digits) - len(code) == 10 and (code or not text.startswith("+")):
        own = digits[len(code) :]  # the same with and without +1
        # Area codes that begin with 0 or 1 stay among themselves.
        found = code + p.spelled("phone", own, ["01" if own[0] in "01" else "23456789"] + [DIGITS] * 9)
    elif 8 <= len(digits) <= 15 and text.startswith("+"):
        n = 1 if digits.startswith(SHORT_CODES) else 2 if digits.startswith(TWO_DIGIT_CODES) else 3
        found = digits[:n] + p.spelled("phone", digits[n:], [DIGITS] * (len(digits) - n))
    else:
        return None
    shown = onto(head + tail, found)
    return shown[: len(head)] + zero + shown[len(head) :]


def _ip(p: Pseudonyms, text: str) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    x = p.permute("ip", int.from_bytes(bytes(map(int, parts))), 1 << 32)
    return ".".join(map(str, x.to_bytes(4)))


def _ip6(p: Pseudonyms, text: str) -> str | None:
    groups = [g for g in text.split(":") if g]
    if len(groups) < 3 and len(groups[:1] and groups[0]) < 4:  # a::b is rather code than an address
        return None
    try:
        x = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    return str(ipaddress.IPv6Address(p.permute("ip6", x, 1 << 128)))


def _date(p: Pseudonyms, text: str) -> str | None:
    separator = next(c for c in text if c not in DIGITS)
    a, _, _ = parts = text.split(separator)
    if len(a) == 4:
        order = "ymd"
    elif separator == "/" and int(a) <= 12:
        order = "mdy"
    else:
        order = "dmy"
    own = dict(zip(order, map(int, parts), strict=True))
    try:
        day = datetime.date(own["y"], own["m"], own["d"])
    except ValueError:
        return None
    # Days over 12 stay among themselves: a date with slashes is read day first only if its day is one.
    x = day.toordinal() - FIRST_DAY
    while True:
        x = p.permute("date", x, LAST_DAY - FIRST_DAY + 1)
        found = datetime.date.fromordinal(FIRST_DAY + x)
        if (found.day > 12) == (day.day > 12):
            break
    width = 1 if min(map(len, parts)) == 1 else 2  # without leading zeros where the given one has none
    shown = {"y": f"{found.year}", "m": f"{found.month:0{width}}", "d": f"{found.day:0{width}}"}
    return separator.join(shown[o] for o in order)


def _iban(p: Pseudonyms, text: str) -> str | None:
    plain = text.replace(" ", "")
    value = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
    if not 15 <= len(plain) <= 34 or plain != plain.upper() or value(plain[4:] + plain[:4]) != 1:
        return None
    own = p.spelled("iban", plain[4:], classes(plain[4:]))
    rest = iter(plain[:2] + f"{98 - value(own + plain[:2] + '00'):02}" + own)
    return "".join(c if c == " " else next(rest) for c in text)


def _email(p: Pseudonyms, text: str) -> str:
    name, _, domain = text.translate(SMALL).rpartition("@")
    top = domain.rfind(".")
    own = f"{name}@{domain[:top]}"
    found = p.spelled("email", own, classes(own)) + domain[top:]
    return "".join(n.upper() if o in UPPER else n for o, n in zip(text, found, strict=True))


def is_hex(text: str) -> bool:
    return all(c in HEXES for c in text) and not all(c in DIGITS for c in text)


def _value(p: Pseudonyms, text: str) -> str:
    """Hexadecimal values stay so; others keep each character's class and stay others, so no two values meet."""
    own = is_hex(text)
    found, alphabets = text, [HEXES] * len(text) if own else classes(text, SYMBOLS)
    while True:
        found = p.spelled("secret", found, alphabets)
        if is_hex(found) == own:
            return found


def _access(p: Pseudonyms, text: str) -> str:
    return p.spelled("access", text, [UPPER + DIGITS] * len(text))


KINDS: dict[str, Callable[[Pseudonyms, str], str | None]] = {
    "email": _email, "value": _value, "access": _access, "iban": _iban, "date": _date, "ip": _ip, "ip6": _ip6, "ssn": _ssn, "card": _card, "phone": _phone,
}


def found_at(text: str, at: int, names: Pseudonyms) -> tuple[str, int, int, str] | None:
    """(kind, start, end, pseudonym) of what begins at a place; a number may end before any of its separators."""
    for kind, pattern in COMPILED.items():
        if not (match := pattern.match(text, at)):
            continue
        start, end = match.span("own" if "own" in pattern.groupindex else 0)
        ends = [end]
        if kind in ("card", "iban"):
            ends += [start + m.start() for m in re.finditer(r"[ \-]", match[0])][::-1]
        for e in ends:
            if e - start >= 13 or kind not in ("card", "iban"):
                name = names.replaced(kind, text[start:e])
                if name is not None:
                    return kind, start, e, name
    return None


def pseudonymise(text: str, names: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its matches replaced, and (kind, start, end) of each in the text given."""
    if not HINT.search(text):
        return text, []
    parts, spans, done, at = [], [], 0, 0
    while match := BEGINS.search(text, at):
        found = found_at(text, match.start(), names)
        if found is None:
            at = match.start() + 1
            continue
        kind, start, end, name = found
        parts += [text[done:start], name]
        spans.append((kind, start, end))
        done = at = end
    return "".join([*parts, text[done:]]), spans


def pseudonymise_documents(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """The documents with pseudonyms in text, and spans (array of kind, start, end in the text given).

    Kinds: e-mail, IPv4 and IPv6 addresses, phone, card (Luhn), social security and bank account (mod 97) numbers, dates
    of 1900 to 2099, access key ids, and values of password= and the like. A value is validated, permuted within the values of
    its format (check digits are made anew) and written in its own spelling, so equal values give equal pseudonyms
    in all documents, in whatever separators, and distinct values distinct ones. Invalid numbers stay. A value may be of
    any length: all of it is mixed. Letters of any script are replaced by others of their block and case. What a
    permutation leaves as it is isn't reported as replaced. (IPv6 pseudonyms are written in the short form.)

    A null text stays null with null spans, an empty one has none. Texts are taken whole, row by row, without a
    shuffle. All columns are kept; one called spans is renamed (see base.tidy). No rows: no rows.
    """
    docs = tidy(docs, ("text",), ("spans", "_done"))
    kind = "kind string, start int, end int"

    def run(batches):
        names = Pseudonyms(key)
        for batch in text_batches(batches):
            found = [None if t is None else pseudonymise(t, names) for t in batch.column("text").to_pylist()]
            columns = [pa.array([f and f[0] for f in found], pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names]
            spans = [None if f is None else [dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[1]] for f in found]
            as_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, as_type)], names=[*batch.schema.names, "spans"])

    from pyspark.sql.types import ArrayType, StructField, StructType, _parse_datatype_string

    schema = StructType([*docs.schema.fields, StructField("spans", ArrayType(_parse_datatype_string(kind)))])
    return docs.mapInArrow(run, schema)


def op1_pii_feistel(spark, sf_dir: str) -> DataFrame:
    """doc_id, text and the number of replaced values of every document."""
    docs = pseudonymise_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return docs.select("doc_id", "text", F.coalesce(F.size("spans"), F.lit(0)).alias("n_replaced"), F.array_distinct(F.transform("spans", lambda s: s["kind"])).alias("kinds"))

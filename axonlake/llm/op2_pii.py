"""PII: format-preserving Feistel pseudonyms.

Validated numbers and dates (payment cards by Luhn, IBANs by mod 97, social security numbers by their rules, phone
numbers, IPv4 addresses, calendar dates) and mail addresses are replaced by a keyed
permutation of the values of the same format: digits stay digits, separators, widths and letter case stay, check digits hold. Equal
values get equal pseudonyms in every document, and the key's holder can invert them. The key is an argument; nothing in
the source undoes a pseudonym.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table

ROUNDS = 10
#: Setting with the key, in hexadecimal digits. Where it is unset, a key is drawn at random for the application and forgotten with it.
KEY_SETTING = "spark.axonlake.pseudonymKey"
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


class Feistel:
    """Keyed permutation of 0 .. n - 1: a balanced Feistel network on the square of isqrt(n - 1) + 1, cycle-walking."""

    def __init__(self, key: bytes, tweak: str, n: int) -> None:
        self.key, self.n, self.a = hashlib.sha256(key + b"|" + tweak.encode() + b"|" + str(n).encode()).digest(), n, isqrt(max(0, n - 1)) + 1
        self.bytes = (self.a.bit_length() + 7) // 8 + 8

    def _f(self, i: int, x: int) -> int:
        size, out = self.bytes, b""
        while len(out) < size:
            out += hmac.new(self.key, bytes([i, len(out) & 255]) + x.to_bytes(size, "big"), "sha256").digest()
        return int.from_bytes(out[:size], "big") % self.a

    def forward(self, x: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        while True:
            left, right = divmod(x, self.a)
            for i in range(ROUNDS):
                left, right = right, (left + self._f(i, right)) % self.a
            x = left * self.a + right
            if x < self.n and valid(x):
                return x

    def backward(self, x: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        while True:
            left, right = divmod(x, self.a)
            for i in reversed(range(ROUNDS)):
                left, right = (right - self._f(i, left)) % self.a, left
            x = left * self.a + right
            if x < self.n and valid(x):
                return x


class Pseudonyms:
    """Pseudonyms of each kind under one key; invert=True undoes them."""

    def __init__(self, key: bytes, invert: bool = False) -> None:
        self.key, self.invert = key, invert
        self.net = lru_cache(4096)(lambda tweak, n: Feistel(key, tweak, n))
        self.of = lru_cache(65536)(self._of)

    def _step(self, tweak: str, n: int, x: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        net = self.net(tweak, n)
        return net.backward(x, valid) if self.invert else net.forward(x, valid)

    def _of(self, kind: str, value: str) -> str:
        return getattr(self, kind)(value)

    def _digits(self, value: str, new: str) -> str:
        it = iter(new)
        return "".join(next(it) if "0" <= c <= "9" else c for c in value)

    def card(self, value: str) -> str:
        d = digits(value)
        body = str(self._step("card", 10 ** (len(d) - 1), int(d[:-1]))).zfill(len(d) - 1)
        return self._digits(value, body + luhn_digit(body))

    def ssn(self, value: str) -> str:
        d = digits(value)
        return self._digits(value, str(self._step("ssn", 10**9, int(d), lambda x: valid_ssn(str(x).zfill(9)))).zfill(9))

    def phone(self, value: str) -> str:
        d = digits(value)
        keep = len(d) - 10 if len(d) > 10 else min(2, max(0, len(d) - 6))  # the country code stays
        body = d[keep:]
        return self._digits(value, d[:keep] + str(self._step("phone", 10 ** len(body), int(body))).zfill(len(body)))

    def ip(self, value: str) -> str:
        """An address whose parts are as wide as they were."""
        parts = value.split(".")
        low = [10 ** (len(p) - 1) if len(p) > 1 and p[0] != "0" else 0 for p in parts]
        base = [min(256, 10 ** len(p) if p[0] != "0" or len(p) == 1 else 10 ** (len(p) - 1)) - a for p, a in zip(parts, low, strict=True)]
        size, x = 1, 0
        for p, a, n in zip(parts, low, base, strict=True):
            size, x = size * n, x * n + int(p) - a
        x, out = self._step(f"ip{low}{base}", size, x), []
        for p, a, n in zip(reversed(parts), reversed(low), reversed(base), strict=True):
            x, at = divmod(x, n)
            out.append(str(a + at).zfill(len(p)))
        return ".".join(reversed(out))

    def iban(self, value: str) -> str:
        plain = re.sub(r"\s", "", value)
        head, body = plain[:2], plain[4:]
        d = digits(body)
        new = self._digits(body, str(self._step("iban" + head, 10 ** len(d), int(d))).zfill(len(d)) if d else "")
        plain = head + str(98 - iban_number(new + head + "00") % 97).zfill(2) + new
        it = iter(plain)
        return "".join(c if c.isspace() else next(it) for c in value)

    def email(self, value: str) -> str:
        """Letters and digits of the local part, and of the domain but its last label; addresses that differ in case alone stay so."""
        local, _, domain = value.rpartition("@")
        name, dot, top = domain.rpartition(".")
        return f"{self._letters('email', local)}@{self._letters('domain', name)}{dot}{top}"

    def _letters(self, tweak: str, value: str) -> str:
        size, x = 1, 0
        for c in value:
            base, at = _alphabet(c)
            size, x = size * base, x * base + at
        form = "".join(_class(c) for c in value)
        x = self._step(tweak + form, size, x) if size > 1 else x
        out = []
        for c, k in zip(reversed(value), reversed(form), strict=True):
            base, _ = _alphabet(c)
            x, at = divmod(x, base)
            new = c if base == 1 else chr(ord(k) + at)
            out.append(new.upper() if "A" <= c <= "Z" else new)
        return "".join(reversed(out))

    def date(self, value: str) -> str:
        """A date among those that can be written in the same form, so that the pseudonym reads as the original does."""
        day, form = parse_date(value)
        n = LAST_DAY - FIRST_DAY + 1
        new = self._step("date", n, day.toordinal() - FIRST_DAY, lambda x: form(date.fromordinal(FIRST_DAY + x)) is not None)
        return form(date.fromordinal(FIRST_DAY + new))


def _class(c: str) -> str:
    return "a" if "a" <= c <= "z" or "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c


def _alphabet(c: str) -> tuple[int, int]:
    k = _class(c)
    return (10, ord(c) - 48) if k == "0" else (26, ord(c.lower()) - 97) if k == "a" else (1, 0)


def digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def luhn_digit(body: str) -> str:
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def valid_card(d: str) -> bool:
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn_digit(d[:-1]) == d[-1]


def valid_ssn(d: str) -> bool:
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def iban_number(moved: str) -> int:
    return int("".join(str(int(c, 36)) for c in moved))


def valid_iban(value: str) -> bool:
    """Check digits run from 02 to 98: 00, 01 and 99 leave the same remainder as others and are never given out."""
    plain = re.sub(r"\s", "", value)
    return 15 <= len(plain) <= 34 and "02" <= plain[2:4] <= "98" and iban_number(plain[4:] + plain[:4]) % 97 == 1


def valid_phone(value: str) -> bool:
    d = digits(value)
    return 7 <= len(d) <= 15 and (value.lstrip().startswith("+") or len(d) == 10 or (len(d) == 11 and d[0] == "1"))


def _number(x: int, old: str) -> str | None:
    """x as wide as the old number was written, or None if it takes more."""
    new = str(x).zfill(len(old))
    return new if len(new) == len(old) else None


def _month(x: int, old: str) -> str | None:
    """The month's name in the old one's case; where that is mixed, only a name of the same length can take it."""
    new = MONTHS[x - 1]
    for case in (str.lower, str.upper, str.capitalize):
        if old == case(old):
            return case(new)
    return "".join(c.upper() if o.isupper() else c for c, o in zip(new, old, strict=True)) if len(new) == len(old) else None


def parse_date(value: str) -> tuple[date, Callable[[date], str | None]] | None:
    """A calendar date from 1900 to 2099 and what writes another date in its form (None where that form can't), or None.

    With blanks, points and hyphens the day comes first, with slashes the month, unless that is over 12: such a form
    only takes days over 12, so that what is written is read again in the same order.
    """
    if m := re.fullmatch(r"([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})", value):
        y, mo, d, parts = m[1], m[3], m[4], (lambda x, y, mo, d: (y, m[2], mo, m[2], d))
    elif m := re.fullmatch(r"([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})", value):
        if m[2] == "/" and int(m[1]) <= 12:
            y, mo, d, parts = m[4], m[1], m[3], (lambda x, y, mo, d: (mo, m[2], d, m[2], y))
        else:
            y, mo, d, parts = m[4], m[3], m[1], (lambda x, y, mo, d: (d if m[2] != "/" or x.day > 12 else None, m[2], mo, m[2], y))
    elif (m := re.fullmatch(r"([0-9]{1,2})( +)([A-Za-z]+)( +)([0-9]{4})", value)) and m[3].lower() in MONTHS:
        y, mo, d, parts = m[5], m[3], m[1], (lambda x, y, mo, d: (d, m[2], mo, m[4], y))
    elif (m := re.fullmatch(r"([A-Za-z]+)( +)([0-9]{1,2})(, *| +)([0-9]{4})", value)) and m[1].lower() in MONTHS:
        y, mo, d, parts = m[5], m[1], m[3], (lambda x, y, mo, d: (mo, m[2], d, m[4], y))
    else:
        return None
    month = int(mo) if mo.isdigit() else MONTHS.index(mo.lower()) + 1

    def form(x: date) -> str | None:
        out = parts(x, _number(x.year, y), _number(x.month, mo) if mo.isdigit() else _month(x.month, mo), _number(x.day, d))
        return None if None in out else "".join(out)

    try:
        return (date(int(y), month, int(d)), form) if 1900 <= int(y) <= 2099 else None
    except ValueError:
        return None


EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: A run that starts at a digit (or +, or an opening bracket before one) and goes on with digits and single separators.
NUMBER = re.compile(r"(?<![A-Za-z0-9])(?:\+ ?)?\(?[0-9](?:[0-9]|[ .()/-]{1,2}(?=[0-9(]))*[0-9](?![A-Za-z0-9])")
#: Groups of digits that single hyphens join, or blanks, or both: a card is looked for in this order.
_JOINED, _DIGITS = [re.compile(rf"[0-9]+(?:{sep}[0-9]+)*") for sep in ("-", " ", "[ -]")], re.compile(r"[0-9]+")
DATE_WORDS = re.compile(rf"(?<![A-Za-z0-9])(?:[0-9]{{1,2}} {{1,3}}(?:{'|'.join(MONTHS)}) {{1,3}}[0-9]{{4}}|(?:{'|'.join(MONTHS)}) {{1,3}}[0-9]{{1,2}}(?:, {{0,3}}| {{1,3}})[0-9]{{4}})(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)
#: What a part of a number run may be, tried in this order; a longer kind first.
_PARTS = (
    ("date", re.compile(r"(?<![0-9])(?<![0-9][.-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[.-][0-9])"), lambda v: parse_date(v) is not None),
    ("ip", re.compile(r"(?<![0-9])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"), lambda v: all(int(p) < 256 for p in v.split("."))),
    ("card", None, lambda v: valid_card(digits(v))),  # by cards()
    ("ssn", re.compile(r"(?<![0-9])(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"), lambda v: valid_ssn(digits(v))),
    ("phone", re.compile(r"(?<![0-9])(?:\+ ?[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9])"), valid_phone),
)


def cards(text: str, a: int, b: int, free: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """Cards among the groups of digits in text[a:b]: from each group on the longest valid run of whole groups that is free."""
    for m in (m for joined in _JOINED for m in joined.finditer(text, a, b)):
        groups = [g.span() for g in _DIGITS.finditer(text, *m.span())]
        i = 0
        while i < len(groups):
            s, d, best = groups[i][0], "", None
            for j in range(i, len(groups)):
                d += text[groups[j][0] : groups[j][1]]
                if len(d) > 19:
                    break
                if valid_card(d) and free(s, groups[j][1]):
                    best = j
            if best is not None:
                yield s, groups[best][1]
                i = best
            i += 1


def find(text: str) -> list[tuple[int, int, str]]:
    """Ordered, non-overlapping (start, end, kind)."""
    got: list[tuple[int, int, str]] = []

    def free(start: int, end: int) -> bool:
        i = bisect_left(got, (start,))
        return (i == 0 or got[i - 1][1] <= start) and (i == len(got) or got[i][0] >= end)

    def add(start: int, end: int, kind: str) -> None:
        if free(start, end):
            insort(got, (start, end, kind))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    for m in IBAN.finditer(text):
        s, e = m.span()
        while e - s >= 15 and not valid_iban(text[s:e]):  # following words may have joined the run
            e = text.rfind(" ", s, e)
        if e - s >= 15:
            add(s, e, "iban")
    low = text.lower()
    if any(month in low for month in MONTHS):
        for m in DATE_WORDS.finditer(text):
            if parse_date(m[0]):
                add(m.start(), m.end(), "date")
    for run in NUMBER.finditer(text):
        if run.end() - run.start() < 7:
            continue
        a, b = run.span()
        for kind, pattern, valid in _PARTS:
            if pattern is None:
                for s, e in cards(text, a, b, free):
                    add(s, e, kind)
                continue
            for m in pattern.finditer(text, a, b):
                if valid(m[0]):
                    add(m.start(), m.end(), kind)
    return got


def replace(text: str, names: Pseudonyms) -> tuple[str, list[tuple[int, int, str]]]:
    found = find(text)
    out, at = [], 0
    for s, e, kind in found:
        out += [text[at:s], names.of(kind, text[s:e])]
        at = e
    return "".join([*out, text[at:]]), found


SCHEMA = "doc_id long, text string, spans array<struct<kind:string,start:int,end:int>>"


def key_of(spark: SparkSession) -> bytes:
    """The key that the session's setting names, or one drawn at random, the same for the whole application."""
    named = spark.conf.get(KEY_SETTING, None)
    if named:
        return bytes.fromhex(named)
    application = spark.sparkContext.applicationId
    if application not in _DRAWN:
        _DRAWN[application] = secrets.token_bytes(32)
    return _DRAWN[application]


_DRAWN: dict[str, bytes] = {}


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans) for every row: the text with pseudonyms, and the spans replaced (code points of the input).

    Null stays null, empty stays empty, without spans; whole texts are read; repeated rows come out alike; an
    empty table gives no rows; other columns are ignored. Where kinds overlap, the one listed first in KINDS
    wins but dates and addresses before cards and phones. Numbers that fail validation stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            got = [replace(t, names) if t else (t, []) for t in b.column(1).to_pylist()]
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in g[1]] for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array(spans, kind)], ["doc_id", "text", "spans"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(table(spark, sf_dir, "documents"), key_of(spark))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", "text", *map(count, KINDS))

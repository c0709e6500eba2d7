"""Format-preserving pseudonyms for personal data by a keyed Feistel permutation.

Validated numbers and dates are permuted within their format: a card number
becomes another one with a right check digit, a date another date.  The
permutation depends on the key, the kind and the format only, so equal values
stay equal in all documents, and who has the key can undo it (``key`` and
``undo=True``).  Nothing maps to itself.

A value is written as a number below the count of all values of its format (one
radix for each position); an alternating Feistel network permutes a x b >= N
pairs, and walks on while it is outside N.

Texts are worked on row by row: no shuffle, and nothing is kept between rows
but a cache of values.

Edge cases: a null text stays null, an empty one empty; numbers that fail
validation are left as they are, and so are parts of longer numbers (``inside``);
a comma always ends a value.  Where a match fails, shorter ends of it and then
the other kinds at the same place are tried; an IBAN that can end where its
country's length says ends there.  Overlapping finds go to the one that begins first, then
in the order of ``KINDS``; what is within a match that fails to its end is no
value.  Rows repeat; columns other than the id
and the text are not carried.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
#: Characters of a name that are permuted at once; names of mails are seldom longer.
STRETCH = 64
#: The key of the registered query and of tests; every other caller gives its own.
KEY = b"pseudonyms-1"
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # 1900 to 2099

KINDS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ip": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "card": r"[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}[ .-]?(?:\(?[0-9]{1,4}\)?[ .-]?){1,4}[0-9]{2,4}|[2-9][0-9]{2}-[0-9]{4}",
}
SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
BEGIN, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Mails are found by their @: names may be long, and no other kind is.
FIND = re.compile(BEGIN + "(?:" + "|".join(p for k, p in KINDS.items() if k != "email") + ")" + END)
NAME, NAME_BEGIN = frozenset("".join(SETS) + "._%+-"), re.compile(BEGIN + "[A-Za-z0-9]")
EACH = {k: re.compile(f"(?:{p}){END}") for k, p in KINDS.items()}

#: Lengths of IBANs by country; those of others have any.
IBAN = {
    t[:2]: int(t[2:])
    for t in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30".split()
}


def inside(kind: str, text: str, at: int, end: int) -> bool:
    """Whether the value goes on as a longer number: a digit beyond a separator that the kind is written with."""
    value = text[at:end]
    if kind in ("email", "iban"):
        return False
    if kind == "card":
        marks = "." if value.isdigit() else "-" if "-" in value else ""
    else:
        marks = {"ip": ".", "ssn": "-", "phone": "-."}.get(kind) or next(c for c in value if not c.isdigit())
    return at > 1 and text[at - 1] in marks and text[at - 2] in SETS[0] or end + 1 < len(text) and text[end] in marks and text[end + 1] in SETS[0]



def ends(kind: str, text: str, at: int) -> Iterator[int]:
    """Where values of a kind that begin at ``at`` can end: the longest first; an IBAN only at its country's length if it can end there."""
    if kind == "iban":
        every = list(shorter(kind, text, at))
        yield from [end for end in every if len(text[at:end].replace(" ", "")) == IBAN.get(text[at : at + 2])] or every
    else:
        yield from shorter(kind, text, at)


def shorter(kind: str, text: str, at: int) -> Iterator[int]:
    v = EACH[kind].match(text, at)
    while v:
        if v.end() == len(text) or not (text[v.end()].isascii() and (text[v.end()].isalnum() or text[v.end()] == "_")):
            yield v.end()
        v = EACH[kind].match(text, at, v.end() - 1)


class Mails:
    """Where names before an @ begin, in order; each character is looked at once or twice, whatever the text."""

    def __init__(self, text: str):
        self.text, self.low, self.sign = text, 0, text.find("@")

    def next(self, pos: int) -> int | None:
        """The first begin at or after ``pos``."""
        while self.sign >= 0:
            first = self.sign
            while first > max(self.low, pos) and self.text[first - 1] in NAME:
                first -= 1
            m = NAME_BEGIN.search(self.text, first, self.sign)
            if m and (m.start() == self.sign - 1 or self.text[self.sign - 1] != "."):
                return m.start()
            self.skip()
        return None

    def skip(self) -> None:
        self.low = self.sign + 1
        self.sign = self.text.find("@", self.low)


class Feistel:
    """A keyed permutation of 0..n-1 without fixed points (for n > 1), and its inverse."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.key, self.tweak, self.n = hashlib.blake2b(key, digest_size=32).digest(), tweak.encode(), n
        self.a = isqrt(n - 1) + 1 if n > 1 else 1
        self.b = -(-n // self.a)

    def mix(self, k: int, half: int, size: int) -> int:
        width = max(40, -(-self.n.bit_length() // 8))
        data = k.to_bytes(1, "big") + self.n.to_bytes(width, "big") + half.to_bytes(width, "big") + self.tweak
        out = hashlib.blake2b(data, key=self.key, digest_size=48).digest()
        while len(out) * 8 < size.bit_length() + 80:
            out += hashlib.blake2b(out[-48:] + data, key=self.key, digest_size=48).digest()
        return int.from_bytes(out, "big") % size

    def once(self, x: int, sign: int) -> int:
        left, right = divmod(x, self.b)
        for k in range(ROUNDS) if sign > 0 else reversed(range(ROUNDS)):
            if k % 2:
                right = (right + sign * self.mix(k, left, self.b)) % self.b
            else:
                left = (left + sign * self.mix(k, right, self.a)) % self.a
        return left * self.b + right

    def walk(self, x: int, sign: int) -> int:
        x = self.once(x, sign)
        while x >= self.n:
            x = self.once(x, sign)
        return x

    def permute(self, x: int, undo: bool = False) -> int:
        return self.walk((self.walk(x, 1) + (-1 if undo else 1)) % self.n, -1)


def permuted(key: bytes, kind: str, digits: list[int], radices: list[int], undo: bool) -> list[int]:
    x = 0
    for d, r in zip(digits, radices):
        x = x * r + d
    x = Feistel(key, f"{kind}:{','.join(map(str, radices))}", prod(radices)).permute(x, undo)
    out = []
    for r in reversed(radices):
        x, d = divmod(x, r)
        out.append(d)
    return out[::-1]


def luhn(digits: list[int]) -> int:
    """Sum modulo 10: 0 for a valid number."""
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10


def put(form: str, digits: list[int]) -> str:
    """``form`` with its digits replaced."""
    it = iter(digits)
    return "".join(str(next(it)) if c.isdigit() else c for c in form)


def letters(key: bytes, kind: str, text: str, undo: bool) -> str:
    """Each letter and digit becomes one of its own kind; others stay.  Texts beyond ``STRETCH`` are permuted a stretch at a time."""
    out = []
    for k in range(0, len(text), STRETCH):
        part = text[k : k + STRETCH]
        own = [next((s for s in SETS if c in s), None) for c in part]
        some = [(s, s.index(c)) for s, c in zip(own, part) if s]
        it = iter(permuted(key, f"{kind}#{k}" if k else kind, [i for _, i in some], [len(s) for s, _ in some], undo))
        out += [s[next(it)] if s else c for s, c in zip(own, part)]
    return "".join(out)


@lru_cache(100_000)
def pseudonym(kind: str, value: str, key: bytes, undo: bool = False) -> str | None:
    """The value's pseudonym; None if it isn't valid."""
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "email":
        name, _, host = value.partition("@")
        return f"{letters(key, kind, name, undo)}@{host}"
    if kind == "iban":
        flat = value.replace(" ", "")
        as_number = lambda t: int("".join(str(int(c, 36)) for c in t))
        if as_number(flat[4:] + flat[:4]) % 97 != 1:
            return None
        own = letters(key, kind + flat[:2], flat[4:], undo)
        new = iter(f"{flat[:2]}{98 - as_number(own + flat[:2] + '00') % 97:02d}{own}")
        return "".join(" " if c == " " else next(new) for c in value)
    if kind == "ip":
        parts = [int(p) for p in value.split(".")]
        if any(p > 255 for p in parts) or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
            return None
        return ".".join(map(str, permuted(key, kind, parts, [256] * 4, undo)))
    if kind == "date":
        order = {"-": "%Y-%m-%d", ".": "%d.%m.%Y", "/": "%m/%d/%Y"}[next(c for c in value if not c.isdigit())]
        try:
            day = datetime.datetime.strptime(value, order).date().toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day < DAYS:
            return None
        return datetime.date.fromordinal(permuted(key, kind, [day], [DAYS], undo)[0] + FIRST_DAY).strftime(order)
    if kind == "card":
        if not 13 <= len(digits) <= 19 or luhn(digits) or not any(digits):
            return None
        new = digits[:1] + permuted(key, kind, digits[1:-1], [10] * (len(digits) - 2), undo) + [0]
        return put(value, new[:-1] + [-luhn(new) % 10])
    if kind == "ssn":
        area, group, serial = digits[:3], digits[3:5], digits[5:]
        n = area[0] * 100 + area[1] * 10 + area[2]
        if n in (0, 666) or n >= 900 or not any(group) or not any(serial):
            return None
        rank = lambda x: x - 1 - (x > 666)  # noqa: E731  areas 1..899 without 666
        a, g, s = permuted(key, kind, [rank(n), group[0] * 10 + group[1] - 1, int("".join(map(str, serial))) - 1], [898, 99, 9999], undo)
        a += 1 + (a >= 665)
        return f"{a:03d}-{g + 1:02d}-{s + 1:04d}"
    if kind == "phone":
        fixed = 1 if value.startswith("+1") or len(digits) == 11 and digits[0] == 1 else 0
        own = digits[fixed:]
        if len(own) in (7, 10) and (fixed or not value.startswith("+")):  # North American: 2-9 lead area and exchange
            lead = {0} if len(own) == 7 else {0, 3}
            if any(own[k] < 2 for k in lead):
                return None
            got = permuted(key, kind, [d - 2 * (k in lead) for k, d in enumerate(own)], [8 if k in lead else 10 for k in range(len(own))], undo)
            return put(value, digits[:fixed] + [d + 2 * (k in lead) for k, d in enumerate(got)])
        if not value.startswith("+") or not 8 <= len(digits) <= 15:
            return None
        return put(value, digits[:2] + permuted(key, kind, digits[2:], [10] * (len(digits) - 2), undo))
    raise ValueError(kind)


def replaced(text: str, key: bytes, undo: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind were found."""
    found: dict[str, int] = {}
    out: list[str] = []
    done = pos = 0
    mails, m = Mails(text), FIND.search(text)
    while True:
        if m and m.start() < pos:
            m = FIND.search(text, pos)
        mail = mails.next(pos)
        if m is None and mail is None:
            break
        at = min(x for x in (m and m.start(), mail) if x is not None)
        pos = at + 1
        for kind, end in ((k, e) for k in EACH if k != "email" or at == mail for e in ends(k, text, at)):
            if inside(kind, text, at, end):
                continue
            pos = max(pos, end)
            new = pseudonym(kind, text[at:end], key, undo)
            if new is not None:
                found[kind] = found.get(kind, 0) + 1
                out += [text[done:at], new]
                done = pos = end
                break
        else:
            if at == mail:  # what follows the @ is no host, whatever the name
                mails.skip()
    return "".join(out) + text[done:], found


def pseudonymised(docs: DataFrame, key: bytes, undo: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_private and ``kinds`` (kind:count, comma-joined) of each row."""
    some = re.compile("[0-9@]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts, counts, kinds = [], [], []
                for t in part.column(1).to_pylist():
                    new, found = replaced(t, key, undo) if t and some.search(t) else (t, {})
                    texts.append(new)
                    counts.append(sum(found.values()))
                    kinds.append(",".join(f"{k}:{found[k]}" for k in KINDS if k in found))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], ["doc_id", "text", "n_private", "kinds"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id bigint, text string, n_private bigint, kinds string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), KEY)

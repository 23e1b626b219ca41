"""Format-preserving pseudonyms for personal data by a keyed Feistel network.

Values are found by form, then validated; what fails validation stays as it is. A valid value is
permuted inside its format by a key: equal values get equal pseudonyms in all documents, different
ones different pseudonyms, and whoever has the key can invert them (``Pseudonyms(key, inverse=True)``).

kind     validation                                  permuted
card     13 to 19 digits, also in groups, Luhn       all digits but the last, which is computed anew
iban     mod 97                                      the digits and letters after the check digits, which are computed anew
ssn      ddd-dd-dddd, no part all zeros              nine digits
phone    +c (aaa) bbb-cccc and like, 7 to 15 digits  the digits after the country code
ip       four parts of 0 to 255, no leading zero     the 32-bit address
date     y-m-d, d/m/y or m/d/y that exist            the day within the same span of 200 years; m/d/y is read only
                                                     where the day is over 12, so such pseudonyms may not read back
email    local@domain.tld                            letters and digits of the local part, each within its alphabet
secret   16 or more characters assigned to a key word   digits and letters, each within its alphabet

Values of more than LONG characters (e-mails and secrets have any length) are permuted part by part, each
part under the plain ones before it: still invertible, still equal for equal values, in linear time.

Defined cases: null texts stay null and empty ones empty, with zero counts; very long texts are
scanned whole, in time linear in their length, and so are values; repeated rows give equal rows; an empty table gives
an empty result; further columns stay as they are, whatever their names (added columns give way).
"""

from __future__ import annotations

import datetime
import hashlib
import logging
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexitide.llm.common import free_names

KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email", "secret")
#: For tests and public data only: whoever reads this can invert it. Production passes its own.
TEST_KEY = b"lexitide public test key"
#: The session setting that holds the key of registered queries and of the corpus pipeline.
KEY_SETTING = "spark.lexitide.pii.key"
ROUNDS = 10
#: Characters that one permutation takes.
LONG = 256


class Pseudonyms:
    """Keyed permutations of numbers and of strings over mixed alphabets."""

    def __init__(self, key: bytes, inverse: bool = False):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key, self.inverse = hashlib.blake2b(key, digest_size=32).digest(), inverse

    def number(self, x: int, size: int, tweak: str) -> int:
        """A permutation of range(size): an unbalanced Feistel network on range(a * b), walked until it is back inside."""
        if size < 2:
            return x
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        head = tweak.encode() + b"|%d|" % size
        while True:
            left, right = x % a, x // a
            for j in reversed(range(ROUNDS)) if self.inverse else range(ROUNDS):
                half = right if j % 2 == 0 else left
                f = int.from_bytes(hashlib.blake2b(head + b"%d|%d" % (j, half), key=self.key, digest_size=max(16, min(64, half.bit_length() // 8 + 16))).digest())
                f = -f if self.inverse else f
                if j % 2 == 0:
                    left = (left + f) % a
                else:
                    right = (right + f) % b
            x = right * a + left
            if x < size:
                return x

    def digits(self, s: str, tweak: str) -> str:
        return str(self.number(int(s), 10 ** len(s), tweak)).zfill(len(s)) if s else s

    def characters(self, s: str, tweak: str, only_hex: bool = False) -> str:
        """Permutes ASCII letters among letters (cases stay) and digits among digits; with only_hex, hexadecimal digits."""
        if len(s) > LONG:
            out, plain = [], hashlib.blake2b(digest_size=16)
            for a in range(0, len(s), LONG):
                new = self.characters(s[a : a + LONG], f"{tweak}+{a}:{len(s)}:{plain.hexdigest()}", only_hex)
                plain.update((new if self.inverse else s[a : a + LONG]).encode())
                out.append(new)
            return "".join(out)
        places: list[tuple[int, int, int]] = []
        x, size = 0, 1
        for i, c in enumerate(s):
            base, zero = (16, 0) if only_hex else (10, 48) if c in "0123456789" else (26, 97) if "a" <= c <= "z" else (26, 65) if "A" <= c <= "Z" else (0, 0)
            if base:
                places.append((i, base, zero))
                x = x * base + (int(c, 16) if only_hex else ord(c) - zero)
                size *= base
        shape = "h" if only_hex else "".join(str(b) for _, b, _ in places)
        y, out = self.number(x, size, f"{tweak}:{shape}"), list(s)
        upper = s.upper() == s
        for i, base, zero in reversed(places):
            y, r = divmod(y, base)
            out[i] = ("0123456789ABCDEF" if upper else "0123456789abcdef")[r] if only_hex else chr(zero + r)
        return "".join(out)


def luhn(digits: str) -> int:
    """The sum that is 0 modulo 10 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10


def _refill(form: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def card(s: str, p: Pseudonyms) -> str | None:
    d = re.sub(r"\D", "", s)
    if luhn(d):
        return None
    body = p.digits(d[:-1], "card")
    return _refill(s, body + str(-luhn(body + "0") % 10))


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def iban(s: str, p: Pseudonyms) -> str | None:
    plain = s.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1 or not 2 <= int(plain[2:4]) <= 98:
        return None
    body = p.characters(plain[4:], f"iban{plain[:2]}")
    new = iter(plain[:2] + str(98 - _mod97(f"{plain[:2]}00{body}")).zfill(2) + body)
    return "".join(c if c == " " else next(new) for c in s)


def ssn(s: str, p: Pseudonyms) -> str | None:
    if "000" == s[:3] or "00" == s[4:6] or "0000" == s[7:]:
        return None
    d = s.replace("-", "")
    while True:  # walked until it is valid again, so still a permutation
        d = p.digits(d, "ssn")
        if d[:3] != "000" and d[3:5] != "00" and d[5:] != "0000":
            return _refill(s, d)


def phone(s: str, p: Pseudonyms) -> str | None:
    code = re.match(r"\+?\d{1,3}(?=[ .(-])(?=.*\()|\+\d{1,3}(?=[ .-])|", s).group()
    d = re.sub(r"\D", "", s[len(code) :])
    if not 7 <= len(d) <= 15:
        return None
    return code + _refill(s[len(code) :], p.digits(d, "phone"))


def ip(s: str, p: Pseudonyms) -> str | None:
    parts = s.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    x = p.number(int.from_bytes(bytes(map(int, parts))), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4)))


def date(s: str, p: Pseudonyms) -> str | None:
    a, sep, b, _, c = re.match(r"(\d+)(\D)(\d+)(\D)(\d+)$", s).groups()
    order = "ymd" if len(a) == 4 else "mdy" if int(b) > 12 else "dmy"
    got = dict(zip(order, (a, b, c), strict=True))
    try:
        day = datetime.date(int(got["y"]), int(got["m"]), int(got["d"]))
    except ValueError:
        return None
    era = (day.year - 1900) // 200 * 200 + 1900
    first, last = datetime.date(max(1, era), 1, 1), datetime.date(min(9999, era + 199), 12, 31)
    new = first + datetime.timedelta(days=p.number((day - first).days, (last - first).days + 1, "date"))
    out = {"y": f"{new.year:04d}", "m": new.month, "d": new.day}
    return sep.join(out[k] if k == "y" else str(out[k]).zfill(len(got[k]) if len(got[k]) == 2 else 1) for k in order)


_START = re.compile(r"[+(]?[0-9]")
_RUN = re.compile(r"[+(]?[0-9]+")
_NUMBERS = re.compile(
    r"(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)"
    r"|(?P<date>\d{4}([-/.])\d{1,2}\3\d{1,2}|\d{1,2}([-/.])\d{1,2}\4\d{4})(?!\w|[-/.]\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?!\w|-\d)"
    r"|(?P<phone>(?:\+?\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}|\d{3}([-.])\d{3}\7\d{4})(?!\w|-\d)"
    r"|(?P<card>\d{4}([ -])\d{4}\9\d{4}\9\d{1,7}|\d{4}([ -])\d{6}\10\d{5}|\d{13,19})(?!\w|-\d)",
    re.ASCII,
)
_NUMBER_KINDS = {"ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IBAN_HINT = re.compile(r"[A-Z]{2}\d\d")
_SECRET = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_+/-]{16,})")
_SECRET_WORDS = ("token", "secret", "passw", "api_key", "api-key", "apikey", "access_key", "access-key", "accesskey")


def _emails(text: str, p: Pseudonyms):
    at, floor = text.find("@"), 0
    while at >= 0:
        a = at
        while a > floor and text[a - 1] in _LOCAL:
            a -= 1
        while a < at and text[a] in ".-+%":
            a += 1
        m = _DOMAIN.match(text, at + 1) if a < at and text[at - 1] != "." else None
        if m:
            yield a, at, "email", p.characters(text[a:at], "email")
            floor = m.end()
        at = text.find("@", m.end() if m else at + 1)


def _whole(text: str, p: Pseudonyms):
    """Replacements that are found by more than digits: (begin, end, kind, new), sorted and apart."""
    found = []
    if "@" in text:
        found += _emails(text, p)
    low = text.lower()
    if any(w in low for w in _SECRET_WORDS):
        for m in _SECRET.finditer(text):
            s = m[1]
            if re.search(r"\d", s) and re.search(r"[A-Za-z]", s):
                found.append((m.start(1), m.end(1), "secret", p.characters(s, "secret", bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s)))))
    if _IBAN_HINT.search(text):
        for m in _IBAN.finditer(text):
            new = iban(m[0], p)
            if new:
                found.append((m.start(), m.end(), "iban", new))
    found.sort()
    last = 0
    for f in found:
        if f[0] >= last:
            yield f
            last = f[1]


def pseudonymise(text: str, p: Pseudonyms) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind."""
    counts = dict.fromkeys(KINDS, 0)
    if not text:
        return text, counts
    digits = _START.search(text)
    if not digits and "@" not in text and "=" not in text and ":" not in text:
        return text, counts
    out, last = [], 0

    def numbers(a: int, b: int):
        nonlocal last
        pos = a
        while (m := _START.search(text, pos, b)) is not None:
            s, pos = m.start(), _RUN.match(text, m.start()).end()
            before = text[s - 1] if s else " "
            if before.isalnum() or before in "_@" or (before in ".-/" and s > 1 and text[s - 2].isdigit()):
                continue
            m = _NUMBERS.match(text, s, b)
            new = m and _NUMBER_KINDS[m.lastgroup](m[0], p)
            if new:
                counts[m.lastgroup] += 1
                out.append(text[last:s])
                out.append(new)
                last = pos = m.end()

    edge = 0
    for a, b, kind, new in _whole(text, p):
        if digits:
            numbers(edge, a)
        counts[kind] += 1
        out.append(text[last:a])
        out.append(new)
        last = edge = b
    if digits:
        numbers(edge, len(text))
    return ("".join(out) + text[last:] if out else text), counts


def _run(text: int, cols: list[str], key: bytes, inverse: bool):
    def run(batches):
        p = Pseudonyms(key, inverse)
        for batch in batches:
            new, counts = [], np.zeros((len(KINDS), batch.num_rows), np.int64)
            for i, t in enumerate(batch.column(text).to_pylist()):
                body, n = pseudonymise(t, p)
                new.append(body)
                counts[:, i] = list(n.values())
            out = [batch.column(i) for i in range(len(cols))]
            out[text] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*out, *map(pa.array, counts)], [*cols, *(f"__n_{k}" for k in KINDS)])

    return run


def key_of(spark) -> bytes:
    """The key that the session is set to. Without one the public test key goes, with a warning: enough for public data, and hides nothing."""
    key = spark.conf.get(KEY_SETTING, None)
    if key:
        return key.encode()
    logging.getLogger(__name__).warning("%s is not set: pseudonyms under the public test key can be inverted by anyone", KEY_SETTING)
    return TEST_KEY


def with_pseudonyms(docs: DataFrame, key: bytes, text: str = "text", inverse: bool = False) -> DataFrame:
    """docs with text pseudonymised and a count n_<kind> for each kind added at the end; no shuffle."""
    cols, at = docs.columns, docs.columns.index(text)
    plain = docs.toDF(*(f"__c{i}" for i in range(len(cols))))
    schema = T.StructType([*plain.schema.fields[:at], T.StructField(f"__c{at}", T.StringType()), *plain.schema.fields[at + 1 :], *(T.StructField(f"__n_{k}", T.LongType()) for k in KINDS)])
    return plain.mapInArrow(_run(at, plain.columns, key, inverse), schema).toDF(*cols, *free_names([f"n_{k}" for k in KINDS], cols))


def op1(spark, sf_dir: str) -> DataFrame:
    return with_pseudonyms(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key_of(spark))


QUERIES = {"op1_pii_pseudonyms": op1}
ORACLES: dict[str, str] = {}

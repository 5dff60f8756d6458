"""Format-preserving pseudonyms for personal numbers, dates and mail names.

Values are found by pattern and validated (Luhn, IBAN modulo 97, calendar, octets,
national number rules), then permuted by a keyed Feistel network over the values of
their own format, walking the cycle until the result is valid again. The same value
gives the same pseudonym in every document, so links survive; the key reverses it.
Everything is local to a row: no shuffle, and only texts with a digit or an @ are
searched.

Edge cases: null and empty texts come back empty with nothing found. Values glued to
letters or longer numbers are left alone. A card or IBAN followed by another short
group is tried without it; its pseudonym then also depends on that group where else the
two together would read as one number. Null and repeated ids give a row each.
Other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bytesops as B

ROUNDS = 10
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
N_DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY

PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-]))
  | (?P<iban>(?<![\w])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\w]))
  | (?P<iso>(?<![\w./-])\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}(?![\w/-]|\.\d))
  | (?P<ssn>(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d))
  | (?P<date>(?<![\w./-])\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4}(?![\w/-]|\.\d))
  | (?P<ip>(?<![\w.-])\d{1,3}(?:\.\d{1,3}){3}(?![\w-]|\.\d))
  | (?P<intl>(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?![\w]))
  | (?P<phone>(?<![\w+.-])(?:\(\d{3}\)[ ]?|\d{3}[-.])\d{3}[-.]\d{4}(?![\w-]|\.\d))
  | (?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d))
    """,
    re.VERBOSE | re.ASCII,
)


class Feistel:
    """Keyed permutation of 0..size-1 for any size."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _f(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        body = tweak + bytes([i]) + half.to_bytes((bits + 7) // 8 + 1, "big")
        return int.from_bytes(hashlib.blake2b(body, key=self.key, digest_size=16).digest(), "big") & ((1 << bits) - 1)

    def permute(self, x: int, size: int, tweak: bytes, back: bool = False) -> int:
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for i in reversed(range(self.rounds)) if back else range(self.rounds):
                a, b = (b ^ self._f(tweak, i, a, half), a) if back else (b, a ^ self._f(tweak, i, b, half))
            x = (a << half) | b
            if x < size:
                return x

    def walk(self, x: int, size: int, tweak: bytes, valid, back: bool = False) -> int:
        """A permutation of the valid values among 0..size-1."""
        while True:
            x = self.permute(x, size, tweak, back)
            if valid(x):
                return x


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(shape: str, chars: str) -> str:
    """``shape`` with its letters and digits replaced in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _is_card(plain: str) -> bool:
    return len(set(plain)) > 1 and luhn_digit(plain[:-1]) == plain[-1]


def _iban_check(country: str, body: str) -> str:
    n = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - n % 97:02d}"


def _is_iban(plain: str) -> bool:
    return _iban_check(plain[:2], plain[4:]) == plain[2:4]


# Lengths of the register of IBANs.
IBAN_LENGTH = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def _plain(value: str) -> str:
    return re.sub(r"[^A-Za-z0-9]", "", value)


def readings(kind: str, value: str) -> list[str]:
    """The match, and for cards and IBANs its shorter beginnings that end with a group, longest first."""
    if kind not in ("card", "iban"):
        return [value]
    out = [value]
    for edge in reversed([m.start() for m in re.finditer("[ -]", value)]):
        n = len(_plain(value[:edge]))
        if n >= 13 if kind == "card" else n == IBAN_LENGTH.get(value[:2], max(n, 15)):
            out.append(value[:edge])
    return out


class Pseudonyms:
    """Pseudonym of a validated value, or None where it isn't one."""

    def __init__(self, key: bytes, back: bool = False):
        self.f, self.back = Feistel(key), back
        self.of = lru_cache(1 << 16)(self._of)

    def _digits(self, digits: str, tweak: str, valid=lambda s: True) -> str:
        n = len(digits)
        x = self.f.walk(int(digits), 10**n, f"{tweak}{n}".encode(), lambda y: valid(f"{y:0{n}d}"), self.back)
        return f"{x:0{n}d}"

    def _classes(self, text: str, tweak: str, valid=lambda s: True) -> str:
        """Permutes letters and digits within their own classes."""
        radix = [10 if c.isdigit() else 26 for c in text]
        zero = ["0" if c.isdigit() else "A" if c.isupper() else "a" for c in text]
        x = 0
        for c, r, z in zip(text, radix, zero, strict=True):
            x = x * r + ord(c) - ord(z)
        size = 1
        for r in radix:
            size *= r

        def chars(x: int) -> str:
            out = []
            for r, z in zip(reversed(radix), reversed(zero), strict=True):
                x, d = divmod(x, r)
                out.append(chr(ord(z) + d))
            return "".join(reversed(out))

        return chars(self.f.walk(x, size, (tweak + "".join(zero)).encode(), lambda y: valid(chars(y)), self.back))

    def _date(self, y: str, m: str, d: str) -> tuple[int, int, int] | None:
        try:
            day = datetime.date(int(y), int(m), int(d)).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day < N_DAYS:
            return None
        # Days above the 12th stay above it, so a pseudonym is read in the order its date was.
        late = int(d) > 12
        new = datetime.date.fromordinal(FIRST_DAY + self.f.walk(day, N_DAYS, b"date", lambda x: (datetime.date.fromordinal(FIRST_DAY + x).day > 12) == late, self.back))
        return new.year, new.month, new.day

    def _of(self, kind: str, value: str, tails: tuple[str, ...] = ()) -> str | None:
        """``tails`` follow the value in longer readings that failed; they fail after the pseudonym too."""
        plain = _plain(value)
        if kind == "card":
            if not _is_card(plain):
                return None
            card = lambda s: plain[0] + s + luhn_digit(plain[0] + s)
            body = self._digits(plain[1:-1], "card" + plain[0], lambda s: not any(_is_card(card(s) + t) for t in tails))
            return _refill(value, card(body))
        if kind == "iban":
            country, body = plain[:2], plain[4:]
            if not _is_iban(plain):
                return None
            iban = lambda s: country + _iban_check(country, s) + s
            return _refill(value, iban(self._classes(body, "iban" + country, lambda s: not any(_is_iban(iban(s) + t) for t in tails))))
        if kind == "ssn":
            ok = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
            return _refill(value, self._digits(plain, "ssn", ok)) if ok(plain) else None
        if kind == "ip":
            parts = [int(p) for p in value.split(".")]
            if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
                return None
            x = self.f.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip", self.back)
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind in ("iso", "date"):
            sep = re.search(r"[-/.]", value)[0]
            a, b, c = value.split(sep)
            if kind == "iso":
                new = self._date(a, b, c)
                return new and f"{new[0]:04d}{sep}{new[1]:02d}{sep}{new[2]:02d}"
            # Day first, unless only month first is a date.
            new = self._date(c, b, a)
            if new:
                return f"{new[2]:02d}{sep}{new[1]:02d}{sep}{new[0]:04d}"
            new = self._date(c, a, b)
            return new and f"{new[1]:02d}{sep}{new[2]:02d}{sep}{new[0]:04d}"
        if kind == "email":
            name, domain = value.split("@")
            return _refill(name, self._classes(re.sub(r"[^A-Za-z0-9]", "", name), "email" + domain.lower())) + "@" + domain
        if kind == "intl":
            if not 8 <= len(plain) <= 15:
                return None
            n = 1 if plain[0] in "17" else min(3, len(re.match(r"\+(\d+)", value)[1]))
            code, number = plain[:n], plain[n:]
            if len(number) < 6:
                return None
            zero = number[0] == "0"
            return _refill(value, code + self._digits(number, "phone" + code, lambda s: (s[0] == "0") == zero))
        # A national number: neither part begins with 0 or 1.
        ok = lambda s: s[0] > "1" and s[3] > "1"
        return _refill(value, self._digits(plain, "national", ok)) if ok(plain) else None


NAMES = {"iso": "date", "intl": "phone"}


def replace(text: str, names: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of each in the new text."""
    out, found, end, size = [], [], 0, 0
    at = 0
    while m := PATTERN.search(text, at):
        kind = next(k for k in ("email", "iban", "iso", "ssn", "date", "ip", "intl", "phone", "card") if m[k] is not None)
        failed: list[str] = []
        for value in readings(kind, m[0]):
            new = names.of(kind, value, tuple(_plain(v[len(value) :]) for v in failed))
            if new is not None:
                break
            failed.append(value)
        if new is None:
            # Not valid as this kind; another kind may begin a little further on.
            at = m.start() + 1
            continue
        out.append(text[end : m.start()])
        size += m.start() - end
        out.append(new)
        found.append((NAMES.get(kind, kind), size, len(new)))
        size += len(new)
        at = end = m.start() + len(value)
    return ("".join(out) + text[end:] if out else text), found


_ASKS = np.zeros(256, np.int32)
_ASKS[[*range(48, 58), 64]] = 1


def _replaced(text_at: int, names: list[str], key: bytes, back: bool):
    def run(batches):
        fake = Pseudonyms(key, back)
        for batch, data, off in B.rows_of(batches, col=names[text_at]):
            total = np.concatenate(([0], np.cumsum(_ASKS[data])))
            asked = np.flatnonzero(total[off[1:]] - total[off[:-1]] > 0)
            texts = batch.column(text_at).to_pylist()
            found: list[list] = [[] for _ in texts]
            for i in asked.tolist():
                texts[i], found[i] = replace(texts[i], fake)
            cols = list(batch.columns)
            cols[text_at] = pa.array([t or "" for t in texts], pa.string())
            rows = [[{"kind": k, "start": s, "length": n} for k, s, n in f] for f in found]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(f) for f in found], pa.int32()), pa.array(rows, _FOUND)], names=[*names, "_n_found", "_found"])

    return run


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
_FOUND_SPARK = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """The documents with pseudonyms in ``text``, and ``_n_found``, ``_found`` (kind, start, length in the new text).

    ``back`` reverses it under the same key.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField("_n_found", T.IntegerType()), T.StructField("_found", _FOUND_SPARK)])
    return docs.mapInArrow(_replaced(docs.columns.index("text"), docs.columns, key, back), schema)


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, n_found, found, text of each document."""
    return pseudonymise(docs.select("doc_id", "text"), key).selectExpr("doc_id", "_n_found as n_found", "_found as found", "text")

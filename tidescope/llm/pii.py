"""Format-preserving pseudonyms for numbers and dates, by a keyed Feistel permutation.

Found are payment cards (13 to 19 digits, Luhn), IBANs (length of the country, modulo 97), telephone numbers in international form and
in the national form (nnn) nnn-nnnn, social security numbers (valid areas), IPv4 addresses and calendar dates from 1900 to 2099. Each
is validated, permuted within the numbers of its own format, and written back with the separators it came with: a card stays a
Luhn-valid card of that length, a date a real date. The permutation depends on the key and the format alone, so equal values stay equal
across documents and different ones stay apart. A domain that is no square is met by cycle walking.

A run of groups that fails validation as a whole is tried without its last groups and then from its next group on, so a value is found with other numbers
or words next to it. Of nn/nn/nnnn the month is read first; where that gives no date (a first number over 12) the day is, and such
dates are permuted among each other. A short number after a telephone number with separators counts as its last group. What fails validation every way stays as it is.

Defined cases: null stays null, empty stays empty; a card or date inside a longer run of digits or letters is not touched; digits other
than ASCII are not read. Extra columns are not read.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescope.llm.common import slices

FOUND = re.compile(
    r"(?<![\w+])(?:"
    r"(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,3}(?!/\d)|\(\d{3}\) ?\d{3}[ .-]\d{4})"
    r"|(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)"
    r"|(?P<date>\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3})"
    r"|(?P<card>\d(?:[ -]?\d){12,33}(?!/\d))"
    r")(?![\w]|[.-]\d)",
    re.A,
)
DIGIT, GROUP, FIRST_RUN = re.compile("[0-9]"), re.compile("[A-Za-z0-9]+"), re.compile(r"[+(]?\w*", re.A)
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Days after the 12th of their month: read with the day first, they can't be taken for another date.
LATE = [d for d in range(FIRST, LAST + 1) if datetime.date.fromordinal(d).day > 12]
ROUNDS = 8
KINDS = ("phone", "iban", "date", "ssn", "ip", "card")
#: Telephone country codes of two digits; 1 and 7 have one, the others three.
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: The length of an IBAN by country.
LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def permuted(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """The image of ``value`` under the keyed permutation of range(size): alternating Feistel rounds over two halves, walked back into range."""
    if size < 2:
        return value
    low = math.isqrt(size - 1) + 1
    high = -(-size // low)
    while True:
        left, right = divmod(value, low)
        for n in range(ROUNDS):
            if n % 2:
                mixed = hashlib.blake2b(b"%s|%d|%d" % (tweak, n, left), key=key, digest_size=16).digest()
                right = (right + int.from_bytes(mixed, "big")) % low
            else:
                mixed = hashlib.blake2b(b"%s|%d|%d" % (tweak, n, right), key=key, digest_size=16).digest()
                left = (left + int.from_bytes(mixed, "big")) % high
        value = left * low + right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced one by one."""
    new = iter(digits)
    return DIGIT.sub(lambda _: next(new), shape)


def iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


@lru_cache(maxsize=20_000)
def pseudonym(kind: str, text: str, key: bytes) -> str | None:
    """The pseudonym of a validated value in its own format, or None where it isn't valid."""
    digits = "".join(DIGIT.findall(text))
    if kind == "card":
        if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]):
            return None
        body = str(permuted(int(digits[:-1]), 10 ** (len(digits) - 1), key, b"card%d" % len(digits))).zfill(len(digits) - 1)
        return refill(text, body + str(luhn(body)))
    if kind == "phone" and text[0] == "(":
        area, exchange = int(digits[:3]) - 200, int(digits[3:6]) - 200
        if area < 0 or exchange < 0:
            return None
        slot, line = divmod(permuted((area * 800 + exchange) * 10_000 + int(digits[6:]), 800 * 800 * 10_000, key, b"national"), 10_000)
        area, exchange = divmod(slot, 800)
        return refill(text, f"{area + 200}{exchange + 200}{line:04}")
    if kind == "phone":
        code = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGITS else 3  # the country code stays
        rest = digits[code:]
        if not 7 <= len(digits) <= 15 or digits[0] == "0" or (digits[0] == "1" and len(digits) != 11):
            return None
        return refill(text, digits[:code] + str(permuted(int(rest), 10 ** len(rest), key, b"phone%d" % len(digits))).zfill(len(rest)))
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        slot = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        slot, serial = divmod(permuted(slot, 898 * 99 * 9999, key, b"ssn"), 9999)
        area, group = divmod(slot, 99)
        return refill(text, f"{area + 1 + (area >= 665):03}{group + 1:02}{serial + 1:04}")
    if kind == "ip":
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
            return None
        n = permuted(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"ip")
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "date":
        form = "%Y-%m-%d" if text[4] == "-" else "%Y/%m/%d" if text[4] == "/" else "%d.%m.%Y" if text[2] == "." else "%m/%d/%Y"
        form = "%d/%m/%Y" if form == "%m/%d/%Y" and int(text[:2]) > 12 else form
        try:
            day = datetime.datetime.strptime(text, form).date().toordinal()
        except ValueError:
            return None
        if not FIRST <= day <= LAST:
            return None
        if form == "%d/%m/%Y":
            day = LATE[permuted(bisect_left(LATE, day), len(LATE), key, b"late")]
        else:
            day = FIRST + permuted(day - FIRST, LAST - FIRST + 1, key, b"date")
        return datetime.date.fromordinal(day).strftime(form)
    whole = text.replace(" ", "")
    if len(whole) != LENGTHS.get(whole[:2]) or iban_number(whole[4:] + whole[:4]) % 97 != 1:
        return None
    body = "".join(DIGIT.findall(whole[4:]))
    body = str(permuted(int(body or 0), 10 ** len(body), key, b"iban%d" % len(body))).zfill(len(body)) if body else ""
    account = refill(whole[4:], body)
    check = 98 - iban_number(account + whole[:2] + "00") % 97
    made = iter(f"{whole[:2]}{check:02}{account}")
    return "".join(c if c == " " else next(made) for c in text)


def tries(m: re.Match) -> Iterator[tuple[int, int]]:
    """Where in the text of a match a value may lie: from its start to the end of each of its groups, the longest first."""
    ends = [m.end()]
    if m.lastgroup in ("card", "iban", "phone") and m[0][0] != "(":
        ends = [g.end() for g in GROUP.finditer(m.string, m.start(), m.end())]
        if m.lastgroup == "phone" and ends[0] - m.start() > 8:  # a number without separators ends with its digits
            ends = ends[:1]
    return ((m.start(), b) for b in reversed(ends))


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, end, kind) in the new text of each."""
    if not text:
        return text, []
    out, spans, at, size, place = [], [], 0, 0, 0
    while m := FOUND.search(text, place):
        for a, b in tries(m):
            new = pseudonym(m.lastgroup, text[a:b], key)
            if new is not None:
                break
        else:
            place = max(m.start() + 1, FIRST_RUN.match(text, m.start()).end())
            continue
        out += [text[at:a], new]
        size += a - at
        spans.append((size, size + len(new), m.lastgroup))
        size += len(new)
        at = place = b
    return "".join(out) + text[at:], spans


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text with pseudonyms, spans array<struct<start, end, kind>>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in slices(batches):
            done = [replace(t, key) for t in batch.column("text").to_pylist()]
            spans = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for _, s in done], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t for t, _ in done], pa.string()), spans], names=["doc_id", "text", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string, spans array<struct<start:int,end:int,kind:string>>")

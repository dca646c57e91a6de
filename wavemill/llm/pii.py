"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Found values are validated (check digits, ranges, calendar), read as a number within their format, and permuted by a
keyed Feistel network over exactly that set of numbers (cycle walking). Equal values get equal pseudonyms in every
document and every run with the key, different values stay different, and the pseudonym is again a valid value of
the format: card numbers keep their length and a right check digit, IBANs their country and right check digits, dates
stay dates in the same notation and with the same digits, IPv4 addresses stay addresses, case stays in e-mail addresses.
Dates are permuted as calendar days within classes of equal form, so one day in two notations stays one day. A phone
number with its country code and the same number without are linked, because the code is left as it is. With the key the
mapping can be undone (``reveal=True``).

One pass without a shuffle: texts without a digit or an @ leave untouched after a look at their bytes. Null text stays
null with no spans; empty texts stay empty. Very long texts are read in whole, in time linear in their length and values.
Where two kinds could claim the same characters the earlier one of ``KINDS`` has them. Repeated rows are treated alike, an
empty table stays empty. Extra columns are kept; a column named like an output column is replaced.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_slices

ROUNDS = 8


class Feistel:
    """A keyed permutation of range(size), unbalanced split, cycle walking inside the next rectangle."""

    def __init__(self, key: bytes, name: str, size: int):
        self.key, self.name, self.size = key, name.encode(), size
        self.low = max(2, int(size**0.5))
        while self.low * self.low < size:
            self.low += 1
        self.high = -(-size // self.low)

    def _round(self, k: int, half: int, modulus: int) -> int:
        said = b"%s|%d|%d|%d" % (self.name, self.size, k, half)
        return int.from_bytes(hmac.new(self.key, said, hashlib.sha256).digest()[:16], "big") % modulus

    def _once(self, x: int, back: bool) -> int:
        high, low = divmod(x, self.low)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                high = (high + sign * self._round(k, low, self.high)) % self.high
            else:
                low = (low + sign * self._round(k, high, self.low)) % self.low
        return high * self.low + low

    def apply(self, x: int, back: bool = False) -> int:
        x = self._once(x, back)
        while x >= self.size:  # the rectangle is little larger than the range
            x = self._once(x, back)
        return x


def luhn(digits: str) -> int:
    """The check sum modulo 10, 0 for a valid number."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10


_DAY_0, _DAY_1 = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
# Month names as written in English dates.
_MONTHS = "January February March April May June July August September October November December".split()


def _day_class(month: int, day: int) -> str:
    """How a date is written depends on whether day and month have one digit, and slashes are read by whether the day can be a month."""
    return ("short" if day < 10 else "middle" if day < 13 else "late") + ("-short" if month < 10 else "-long")


@functools.cache
def _day_classes() -> dict[str, list[int]]:
    """The ordinals of all days from 1900 to 2099 by class."""
    out: dict[str, list[int]] = {}
    for x in range(_DAY_0, _DAY_1 + 1):
        date = datetime.date.fromordinal(x)
        out.setdefault(_day_class(date.month, date.day), []).append(x)
    return out


class Pseudonyms:
    """Replacement of one validated value; every method gives None when the value is not valid for its format."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self.known: dict[tuple[str, int], Feistel] = {}

    def permute(self, name: str, size: int, x: int) -> int:
        if (name, size) not in self.known:
            self.known[name, size] = Feistel(self.key, name, size)
        return self.known[name, size].apply(x, self.back)

    def digits(self, name: str, text: str) -> str:
        return str(self.permute(name, 10 ** len(text), int(text))).zfill(len(text)) if text else text

    def refill(self, value: str, digits: str) -> str:
        """value with its digits replaced in order."""
        new = iter(digits)
        return "".join(next(new) if c.isdigit() else c for c in value)

    def card(self, value: str) -> str | None:
        plain = re.sub(r"\D", "", value)
        if luhn(plain) or len(set(plain)) == 1:
            return None
        body = self.digits("card", plain[:-1])
        return self.refill(value, body + str(-luhn(body + "0") % 10))

    def phone(self, value: str) -> str | None:
        """The national number is permuted, a country code stays. Ten digits are read as area, exchange and line, neither of the first two beginning with 0 or 1, where that is so; other numbers stay outside of that plan."""
        plain = re.sub(r"\D", "", value)
        if not 8 <= len(plain) <= 15:
            return None
        code = re.match(r"\+(\d{1,3})[ .(-]", value)
        country = len(code[1]) if code else 0
        national = plain[country:]
        if len(national) == 10 and national[0] > "1" and national[3] > "1":
            x = ((int(national[0]) - 2) * 100 + int(national[1:3])) * 8 + int(national[3]) - 2
            x, rest = divmod(self.permute("phone|n", 800 * 8 * 10**6, x * 10**6 + int(national[4:])), 10**6)
            area, exchange = divmod(x, 8)
            return self.refill(value, f"{plain[:country]}{area + 200}{exchange + 2}{rest:06}")
        if len(national) == 10:  # outside of that plan it stays outside: the two digits that say so are kept
            rest = self.digits("phone|o", national[1:3] + national[4:])
            return self.refill(value, f"{plain[:country]}{national[0]}{rest[:2]}{national[3]}{rest[2:]}")
        zeros = len(national) - len(national.lstrip("0"))
        if zeros == len(national):
            return None
        # trunk zeros stay, and the digit after them stays other than zero
        least = 10 ** (len(national) - zeros - 1)
        return self.refill(value, f"{plain[:country]}{national[:zeros]}{least + self.permute('phone', 9 * least, int(national) - least)}")

    def ssn(self, value: str) -> str | None:
        def number(plain: str) -> int | None:
            area, group, serial = int(plain[:3]), int(plain[3:5]), int(plain[5:])
            if not area or area == 666 or area > 899 or not group or not serial:
                return None
            return ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1

        x = number(re.sub(r"\D", "", value))
        if x is None:
            return None
        rest, serial = divmod(self.permute("ssn", 898 * 99 * 9999, x), 9999)
        area, group = divmod(rest, 99)
        return self.refill(value, f"{area + 1 + (area >= 665):03}{group + 1:02}{serial + 1:04}")

    def ip(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = self.permute("ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        as_number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if as_number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self.mixed("iban", plain[4:])
        check = 98 - as_number(body + plain[:2] + "00") % 97
        new = iter(f"{plain[:2]}{check:02}{body}")
        return "".join(c if c == " " else next(new) for c in value)

    def mixed(self, name: str, text: str) -> str:
        """Letters stay letters of their case, digits digits, everything else stays."""
        radix = [10 if "0" <= c <= "9" else 26 if "a" <= c.lower() <= "z" else 1 for c in text]
        x, size = 0, 1
        for c, r in zip(text, radix):
            if r > 1:
                x, size = x * r + (int(c) if r == 10 else ord(c.lower()) - 97), size * r
        if size == 1:
            return text
        x = self.permute(name + "|" + "".join("d" if r == 10 else "a" if r == 26 else c for c, r in zip(text, radix)), size, x)
        out = []
        for c, r in zip(reversed(text), reversed(radix)):
            if r > 1:
                x, d = divmod(x, r)
                c = str(d) if r == 10 else chr(d + (65 if c.isupper() else 97))
            out.append(c)
        return "".join(reversed(out))

    def email(self, value: str) -> str | None:
        local, _, domain = value.rpartition("@")
        name, dot, top = domain.rpartition(".")
        return f"{self.mixed('email', local)}@{self.mixed('domain', name)}{dot}{top}"

    def day(self, year: int, month: int, day: int) -> datetime.date | None:
        """Another day of the same class, see ``_day_classes``: written in the same way it has the same form."""
        try:
            x = datetime.date(year, month, day).toordinal()
        except ValueError:
            return None
        if not _DAY_0 <= x <= _DAY_1:
            return None
        name, days = _day_class(month, day), _day_classes()
        members = days[name]
        return datetime.date.fromordinal(members[self.permute(f"date|{name}", len(members), bisect.bisect_left(members, x))])

    def iso_date(self, value: str) -> str | None:
        y, m, d = (int(x) for x in re.split(r"\D", value))
        new = self.day(y, m, d)
        return new and self.refill(value, f"{new.year:04}{new.month:02}{new.day:02}")

    def local_date(self, value: str) -> str | None:
        """Day and month in front of the year, written in the order and with the digits they came in. With a slash the month is first where it can be."""
        a, b, y = re.split(r"\D", value)
        month_first = "/" in value and int(a) <= 12
        new = self.day(int(y), int(a), int(b)) if month_first else self.day(int(y), int(b), int(a))
        if new is None:
            return None
        first, second = (new.month, new.day) if month_first else (new.day, new.month)
        return self.refill(value, f"{first:0{len(a)}}{second:0{len(b)}}{new.year:04}")

    def word_date(self, value: str) -> str | None:
        m = re.fullmatch(r"([A-Za-z]+)( )(\d{1,2})(,? )(\d{4})", value)
        new = self.day(int(m[5]), 1 + [x.lower() for x in _MONTHS].index(m[1].lower()), int(m[3]))
        return new and f"{_MONTHS[new.month - 1]}{m[2]}{new.day:0{len(m[3])}}{m[4]}{new.year}"


# Kinds in order of precedence with their patterns.
KINDS: tuple[tuple[str, str, str], ...] = (
    ("email", "email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
    ("iban", "iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", "ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"),
    ("date", "iso_date", r"(?<![\w-])\d{4}([-/.])\d{2}\1\d{2}(?![\w-])"),
    ("date", "local_date", r"(?<![\w/.-])\d{1,2}([/.-])\d{1,2}\1\d{4}(?![\w-])"),
    ("date", "word_date", rf"(?<!\w)(?:{'|'.join(_MONTHS)}) \d{{1,2}},? \d{{4}}(?!\w)"),
    ("ssn", "ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", "card", r"(?<![\w-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])"),
    ("phone", "phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"),
)
NAMES = tuple(dict.fromkeys(k for k, *_ in KINDS))
_PATTERNS = [(kind, method, re.compile(pattern, re.ASCII)) for kind, method, pattern in KINDS]


def pseudonymise(text: str, names: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with validated values replaced, and (kind, start, end) of the replaced values in the old text."""
    found: list[tuple[int, int, str, str]] = []  # in order, disjoint
    for kind, method, pattern in _PATTERNS:
        merged, k = [], 0
        for m in pattern.finditer(text):  # matches of one pattern come in order and are disjoint
            a, b = m.span()
            while k < len(found) and found[k][1] <= a:
                merged.append(found[k])
                k += 1
            if k < len(found) and found[k][0] < b:
                continue
            new = getattr(names, method)(m[0])
            if new is not None:
                merged.append((a, b, kind, new))
        found = merged + found[k:]
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join((*out, text[at:])), [(kind, a, b) for a, b, kind, _ in found]


def _worker(key: bytes, reveal: bool, make: Callable = Pseudonyms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = make(key, reveal)
        for batch in batches:
            texts = batch.column(0)
            touched: dict[int, tuple[str, list]] = {}
            for i, j, data, offsets in text_slices(texts):
                mark = np.concatenate(([0], np.cumsum(((data - np.uint8(48)) <= np.uint8(9)) | (data == 64))))[offsets]
                for k in np.flatnonzero(np.diff(mark)).tolist():
                    new, spans = pseudonymise(texts[i + k].as_py(), names)
                    if spans:
                        touched[i + k] = new, spans
            if touched:
                plain = texts.to_pylist()
                for k, (new, _) in touched.items():
                    plain[k] = new
                texts = pa.array(plain, pa.string())
            spans = [touched[k][1] if k in touched else [] for k in range(len(batch))]
            said = [",".join(f"{kind}:{a}:{b}" for kind, a, b in s) for s in spans]
            counts = [pa.array([sum(kind == name for kind, *_ in s) for s in spans], pa.int64()) for name in NAMES]
            yield pa.record_batch([*batch.columns[1:], texts, *counts, pa.array(said, pa.string())], [*batch.schema.names[1:], "text", *(f"n_{n}" for n in NAMES), "pii_spans"])

    return run


def replace_personal_data(docs: DataFrame, key: bytes, text_col: str = "text", reveal: bool = False) -> DataFrame:
    """docs with text replaced, n_<kind> and pii_spans (kind:start:end in the old text, comma-joined) added. reveal undoes it."""
    small_batches(docs.sparkSession)
    outputs = ["text", *(f"n_{n}" for n in NAMES), "pii_spans"]
    kept = [c for c in docs.columns if c != text_col and c not in outputs]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "text string", *(f"n_{n} long" for n in NAMES), "pii_spans string"])
    out = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), *(F.col(f"`{c}`") for c in kept)).mapInArrow(_worker(key, reveal), schema)
    return out if text_col == "text" else out.withColumnRenamed("text", text_col)

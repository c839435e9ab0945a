"""Format-preserving pseudonyms for personal numbers, dates and addresses.

What validates (check digits, calendar, ranges) is ranked within its format, moved by a keyed Feistel permutation of
the ranks and written in the same format, check digits included. Equal values get equal pseudonyms in all documents
and on all executors, since the key alone decides.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnis.llm.common import fresh

ROUNDS = 10
#: Rows of a result batch.
ROWS = 1_000
#: Characters of a value that are ranked together.
PIECE = 128


class Feistel:
    """A keyed permutation of 0 .. size-1 without fixed points.

    A two-sided Feistel network over an a x b grid, walked until it falls within the size, gives a permutation P;
    the pseudonym of x is the value whose place under P follows that of x.
    """

    def __init__(self, key: bytes, kind: str, size: int):
        if size < 2:
            raise ValueError("a format with a single value can't be permuted")
        self.size, self.a = size, math.isqrt(size - 1) + 1
        self.b = -(-size // self.a)
        self.key = hashlib.blake2b(f"{kind}/{size}".encode(), key=hashlib.blake2b(key).digest()).digest()

    def _f(self, i: int, x: int) -> int:
        data = i.to_bytes(1, "big") + x.to_bytes((x.bit_length() + 7) // 8, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=40).digest(), "big")

    def _place(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in range(0, ROUNDS, 2):
                left = (left + self._f(i, right)) % self.a
                right = (right + self._f(i + 1, left)) % self.b
            x = left * self.b + right
            if x < self.size:
                return x

    def _value(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in range(ROUNDS - 2, -1, -2):
                right = (right - self._f(i + 1, left)) % self.b
                left = (left - self._f(i, right)) % self.a
            x = left * self.b + right
            if x < self.size:
                return x

    def move(self, x: int, back: bool = False, valid: Callable[[int], bool] = lambda x: True) -> int:
        """The pseudonym of a rank, or the rank of a pseudonym; both among the valid ranks."""
        while True:
            x = self._value((self._place(x) + (-1 if back else 1)) % self.size)
            if valid(x):
                return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_digits(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


_PLAIN = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _shape(text: str) -> list[str | None]:
    return [next((a for a in _ALPHABETS if c in a), None) for c in text]


def _read(text: str) -> tuple[int, int]:
    """Rank of a text among those of its shape, and their number; other characters are fixed."""
    rank, size = 0, 1
    for c, alphabet in zip(text, _shape(text), strict=True):
        if alphabet:
            rank, size = rank * len(alphabet) + alphabet.index(c), size * len(alphabet)
    return rank, size


def _write(like: str, rank: int) -> str:
    out = []
    for c, alphabet in reversed([*zip(like, _shape(like), strict=True)]):
        if alphabet:
            rank, d = divmod(rank, len(alphabet))
            c = alphabet[d]
        out.append(c)
    return "".join(reversed(out))


def _fill(like: str, digits: str) -> str:
    """Digits put in the places of a text's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in like)


DAY_ONE, DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days

#: Candidates by kind, in the order in which they are tried at a place.
PATTERNS = {
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z])(?i:password|passwd|secret|api_key|token) ?[=:] ?[\"']?(?=[A-Za-z]*+\d)[A-Za-z0-9]{8,}+",
    "email": r"(?<![\w.+\x80-\U0010FFFF-])[A-Za-z0-9\x80-\U0010FFFF](?:[A-Za-z0-9._+\x80-\U0010FFFF-]*[A-Za-z0-9\x80-\U0010FFFF])?@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}(?P<sep>[./])\d{1,2}(?P=sep)\d{4})(?![\w]|[./-]\d)",
    "phone": r"(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}-\d{4}|[2-9]\d{2}-[2-9]\d{2}-\d{4}|\+[2-9]\d{1,2}(?:[ .-]?\(?\d{1,4}\)?){2,5})(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}(?P<wide>[ -])\d{6}(?P=wide)\d{5})(?!\w|-\d)",
}
CANDIDATE = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()), re.ASCII)
#: Every candidate holds one of these.
HINT = re.compile(r"[0-9@=]")


class Pseudonyms:
    def __init__(self, key: bytes, kinds: tuple[str, ...] = tuple(PATTERNS), back: bool = False):
        self.key, self.kinds, self.back = key, kinds, back
        self.network = lru_cache(maxsize=10_000)(lambda kind, size: Feistel(key, kind, size))
        self.of = lru_cache(maxsize=100_000)(self._of)

    def _move(self, kind: str, rank: int, size: int, valid: Callable[[int], bool] = lambda x: True) -> int:
        return self.network(kind, size).move(rank, self.back, valid)

    def _of(self, kind: str, text: str) -> str | None:
        """The pseudonym of a candidate, or None if it doesn't validate."""
        return getattr(self, kind)(text)

    def secret(self, text: str) -> str:
        fixed = 4 if text.startswith("AKIA") else len(text.rstrip(_PLAIN))
        return text[:fixed] + self._shaped("secret", text[fixed:])

    def _shaped(self, kind: str, text: str) -> str:
        """Long values are moved piece by piece, each with a permutation of its place."""
        out = []
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE]
            rank, size = _read(piece)
            own = f"{kind}/{at // PIECE}" if at else kind
            out.append(_write(piece, self._move(own, rank, size)) if size > 1 else piece)
        return "".join(out)

    def email(self, text: str) -> str:
        local, domain = text.split("@")
        return f"{self._shaped('email', local)}@{domain}"

    def iban(self, text: str) -> str | None:
        flat = text.replace(" ", "")
        country, rest = flat[:2], flat[4:]
        if not 15 <= len(flat) <= 34 or iban_digits(country, rest) != flat[2:4]:
            return None
        new = self._shaped("iban" + country, rest)
        it = iter(country + iban_digits(country, new) + new)
        return "".join(c if c == " " else next(it) for c in text)

    def ip(self, text: str) -> str | None:
        octets = text.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        rank = int.from_bytes(bytes(map(int, octets)), "big")
        return ".".join(map(str, self._move("ip", rank, 1 << 32).to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        parts = re.split(r"[-./]", text)
        if "-" in text:
            orders = ((2, 1, 0),)
        else:
            orders = ((0, 1, 2), (1, 0, 2))  # day first, if that is a date
        for day, month, year in orders:
            try:
                found = datetime.date(int(parts[year]), int(parts[month]), int(parts[day]))
            except ValueError:
                continue
            if not 0 <= (rank := (found - DAY_ONE).days) < DAYS:
                return None

            sep = re.search(r"[-./]", text)[0]
            short = min(len(parts[day]), len(parts[month])) == 1
            if short and "0" in (parts[day][0], parts[month][0]):
                return None  # 03/4/2020 follows neither way of writing
            first = (day, month, year) == orders[0]

            def valid(r: int, first=first, short=short) -> bool:
                """A date stays in its way of writing: without zeros, or month first where day first is no date."""
                when = DAY_ONE + datetime.timedelta(r)
                return (first or when.day > 12) and (not short or min(when.day, when.month) < 10)

            when = DAY_ONE + datetime.timedelta(self._move("date", rank, DAYS, valid))
            new = list(parts)
            new[day], new[month] = (str(x) if short else f"{x:02d}" for x in (when.day, when.month))
            new[year] = f"{when.year:04d}"
            return sep.join(new)
        return None

    def phone(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        if text[0] == "+" and digits[0] != "1":
            fixed, rest, valid = digits[:2], digits[2:], lambda r: True
            if not 8 <= len(digits) <= 15:
                return None
        else:
            # a country code or parentheses mark any number; area and exchange that begin with 0 or 1 stay so
            fixed, rest = digits[:-10], digits[-10:]
            form = lambda r: (r // 10**9 >= 2, r // 10**6 % 10 >= 2)
            valid = lambda r, own=form(int(rest)): form(r) == own
        new = self._move(f"phone{fixed}", int(rest), 10 ** len(rest), valid)
        return _fill(text, fixed + str(new).zfill(len(rest)))

    def ssn(self, text: str) -> str | None:
        def valid(rank: int) -> bool:
            area, group, serial = rank // 10**6, rank // 10**4 % 100, rank % 10**4
            return 0 < area < 900 and area != 666 and group > 0 and serial > 0

        rank = int(text.replace("-", ""))
        return _fill(text, str(self._move("ssn", rank, 10**9, valid)).zfill(9)) if valid(rank) else None

    def card(self, text: str) -> str | None:
        digits = re.sub(r"[ -]", "", text)
        if luhn_digit(digits[:-1]) != digits[-1] or digits[0] == "0":
            return None
        body = digits[1:-1]  # the first digit tells the industry
        new = digits[0] + str(self._move(f"card{digits[0]}", int(body), 10 ** len(body))).zfill(len(body))
        return _fill(text, new + luhn_digit(new))

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and their spans in it (in characters)."""
        if not HINT.search(text):
            return text, []
        out, spans, at, shift, sought = [], [], 0, 0, 0
        while m := CANDIDATE.search(text, sought):
            kind = m.lastgroup  # the outermost group that closed last
            if kind not in self.kinds or (new := self.of(kind, m[0])) is None:
                sought = m.start() + 1
                continue
            sought = m.end()
            out += [text[at : m.start()], new]
            spans.append((m.start() + shift, m.start() + shift + len(new), kind))
            shift += len(new) - len(m[0])
            at = m.end()
        return ("".join([*out, text[at:]]), spans) if spans else (text, [])


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str = "spans", kinds: tuple[str, ...] = tuple(PATTERNS), back: bool = False) -> DataFrame:
    """The table with pseudonyms in its text column, and `spans`: array of (start, end, kind) in the new text.

    Kinds: secret, email, iban, ip, date, phone, ssn, card, of any length. What doesn't validate is left as it is, so ordinary numbers
    stay. Left as well, since prose and codes look alike: values behind a keyword without a digit or with other characters than letters and
    digits, North American numbers without country code and parentheses whose area or exchange begins with 0 or 1 or whose groups
    are joined by dots, dates with month names or before 1900, IPv6 addresses, bearer tokens. The domain of an address and characters beyond ASCII in it stay. A null text stays null and has no spans; empty texts stay empty. Rows are changed one by one: repeated rows
    give repeated results. `back` restores the originals with the same key. A column named like the spans is replaced.
    """
    if not key:
        raise ValueError("a key is needed")
    docs = docs.drop(spans_col)
    work = fresh(docs, "text_to_change")
    at = docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {'string' if i == at else f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    schema += f", `{spans_col}` array<struct<start:int,end:int,kind:string>>"

    def run(batches):
        pseudonyms = Pseudonyms(key, kinds, back)
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                batch = whole.slice(begin, ROWS)
                texts, spans = [], []
                for text in batch.column(batch.num_columns - 1).to_pylist():
                    new, found = (None, []) if text is None else pseudonyms.replace(text)
                    texts.append(new)
                    spans.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
                columns = list(batch.columns[:-1])
                columns[at] = pa.array(texts, pa.string())
                yield pa.record_batch([*columns, pa.array(spans, SPANS)], names=[*batch.schema.names[:-1], spans_col])

    return docs.withColumn(work, F.col(f"`{text_col}`").cast("string")).withColumn(text_col, F.lit(None).cast("string")).mapInArrow(run, schema)

"""Format-preserving pseudonyms for personal data.

Values that pass their check (card numbers by Luhn, account numbers by modulo 97, dates by the calendar, addresses
by parts up to 255; any digits in telephone numbers that are written with a plus, brackets or separators) are permuted by a keyed
Feistel network within the set of values of the same format. The same value and key always give the same pseudonym, so documents stay linked; the key undoes it.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame

from logweave.llm.common import transform_text

ROUNDS = 8
LETTERS = "abcdefghijklmnopqrstuvwxyz"


class Feistel:
    """A keyed permutation of the integers below any size, by an unbalanced network and walking until the result is in range."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tag: bytes, i: int, value: int, size: int) -> int:
        text = b"%s|%d|%d|%d" % (tag, i, size, value)
        return int.from_bytes(hmac.digest(self.key, text, "sha256"), "big")

    def _once(self, x: int, a: int, b: int, tag: bytes, back: bool) -> int:
        """One pass over pairs (left below a, right below b)."""
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2:
                step = self._round(tag, i, left, b)
                right = (right - step if back else right + step) % b
            else:
                step = self._round(tag, i, right, a)
                left = (left - step if back else left + step) % a
        return left * b + right

    def permute(self, x: int, size: int, tag: str, back: bool = False) -> int:
        """The image of ``x`` among ``0 .. size - 1``; with ``back`` the value whose image it is."""
        if size < 2:
            return x
        a = max(2, int(size**0.5))
        b = -(-size // a)
        mark = tag.encode()
        x = self._once(x, a, b, mark, back)
        while x >= size:
            x = self._once(x, a, b, mark, back)
        return x


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


# Telephone numbers of the North American layout, with or without a country code.
_NATIONAL = r"(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}"
_PHONE_3_3_4 = re.compile(_NATIONAL)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _number(f: Feistel, digits: str, tag: str, back: bool) -> str:
    return str(f.permute(int(digits), 10 ** len(digits), f"{tag}{len(digits)}", back)).zfill(len(digits)) if digits else ""


def _card(f: Feistel, text: str, back: bool) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) < 2:
        return None
    # The first digit tells the kind of card and stays.
    body = digits[0] + _number(f, digits[1:-1], "card", back)
    return _refill(text, body + luhn_digit(body))


def _phone(f: Feistel, text: str, back: bool) -> str | None:
    digits = _digits(text)
    if digits == text:
        # Ten or more digits in a row may be any number: only those whose area code and exchange begin with 2 to 9.
        head, own = digits[:-10], digits[-10:]
        if own[0] in "01" or own[3] in "01":
            return None
        n = ((int(own[0]) - 2) * 8 + int(own[3]) - 2) * 10**8 + int(own[1:3] + own[4:])
        n = f.permute(n, 64 * 10**8, "phone", back)
        first, rest = divmod(n, 10**8)
        rest = str(rest).zfill(8)
        return head + str(first // 8 + 2) + rest[:2] + str(first % 8 + 2) + rest[2:]
    # A number that is written as one has any digits. The country code stays: what stands before ten digits of the
    # North American layout, else the first group after the plus, of which a longer one gives two digits.
    if _PHONE_3_3_4.fullmatch(text):
        head = len(digits) - 10
    else:
        group = len(re.match(r"\+(\d+)", text)[1])
        head = group if group <= 3 else 2
    return _refill(text, digits[:head] + _number(f, digits[head:], "phone", back))


def _ip(f: Feistel, text: str, back: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if any(p > 255 for p in parts) or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    n = f.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", back)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _iban_check(country: str, body: str) -> str:
    return str(98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97).zfill(2)


def _mixed(f: Feistel, text: str, tag: str, back: bool) -> str:
    """Digits stay digits and letters letters, in upper or lower case; other characters stay as they are."""
    sizes = [10 if "0" <= c <= "9" else 26 if c.lower() in LETTERS else 1 for c in text]
    total, value = 1, 0
    for c, size in zip(text, sizes):
        d = int(c) if size == 10 else LETTERS.index(c.lower()) if size == 26 else 0
        total, value = total * size, value * size + d
    shape = "".join("9" if s == 10 else "a" if s == 26 else c for c, s in zip(text, sizes))
    value = f.permute(value, total, f"{tag}:{shape}", back)
    out = []
    for c, size in zip(reversed(text), reversed(sizes)):
        value, d = divmod(value, size)
        out.append(str(d) if size == 10 else (LETTERS[d].upper() if c.isupper() else LETTERS[d]) if size == 26 else c)
    return "".join(reversed(out))


def _hex(f: Feistel, text: str, back: bool) -> str:
    return format(f.permute(int(text, 16), 16 ** len(text), f"hex{len(text)}", back), "x").zfill(len(text))


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    plain = text.replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, body) != check:
        return None
    body = _mixed(f, body, "iban", back)
    plain = iter(country + _iban_check(country, body) + body)
    return "".join(next(plain) if c != " " else c for c in text)


def _issued(area: int, group: int, serial: int) -> bool:
    return 1 <= area <= 899 and area != 666 and group > 0 and serial > 0


def _ssn(f: Feistel, text: str, back: bool) -> str:
    area, group, serial = (int(p) for p in text.split("-"))
    if not _issued(area, group, serial):
        # Numbers that are never issued are permuted among themselves.
        n = int(_digits(text))
        while True:
            n = f.permute(n, 10**9, "other ssn", back)
            if not _issued(n // 10**6, n // 10**4 % 100, n % 10**4):
                return _refill(text, f"{n:09d}")
    n = (((area - 1 - (area > 666)) * 99) + group - 1) * 9999 + serial - 1
    n = f.permute(n, 898 * 99 * 9999, "ssn", back)
    n, serial = divmod(n, 9999)
    area, group = divmod(n, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


# Days that dates are permuted within; all days outside of them are permuted among themselves.
_FIRST_DAY, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
_BEFORE, _ALL = _FIRST_DAY.toordinal() - 1, date.max.toordinal()


def _moved(f: Feistel, day: date, back: bool) -> date:
    n = day.toordinal() - 1 - _BEFORE
    if 0 <= n < _DAYS:
        return _FIRST_DAY + timedelta(f.permute(n, _DAYS, "date", back))
    n = f.permute(n + _BEFORE if n < 0 else n + _BEFORE - _DAYS, _ALL - _DAYS, "far date", back)
    return date.fromordinal(n + 1 if n < _BEFORE else n + 1 + _DAYS)


def _date(order: str, other: str | None = None) -> Callable:
    """Dates written in the order of 'ymd', 'dmy' or 'mdy'; separators and the width of the parts stay.

    A text that is no date in ``order`` may be one in the ``other`` order, with a day beyond 12; so is its pseudonym. Beside a
    part of one digit, parts of two digits stay below 10 or not, so that the pseudonym can be undone.
    """

    def written(day: date, order: str, widths: list[int]) -> tuple[list[str], list]:
        value = {"y": day.year, "m": day.month, "d": day.day}
        parts = [str(value[k]).zfill(w) for k, w in zip(order, widths)]
        mixed = 1 in widths
        return parts, [len(p) if mixed else w for p, w in zip(parts, widths)] + [mixed and value[k] > 9 for k in order]

    def permute(f: Feistel, text: str, back: bool) -> str | None:
        parts = re.split(r"([-./])", text)
        widths = [len(p) for p in parts[::2]]
        for way in (order, other):
            value = dict(zip(way or "", (int(p) for p in parts[::2])))
            try:
                day = date(value["y"], value["m"], value["d"])
            except (KeyError, ValueError):
                continue
            shape = written(day, way, widths)[1]
            # Walks on until the pseudonym has the form of the value.
            while True:
                day = _moved(f, day, back)
                made, form = written(day, way, widths)
                if form == shape and (way == order or day.day > 12):
                    return parts[1].join(made)
        return None

    return permute


def _email(f: Feistel, text: str, back: bool) -> str | None:
    local, _, host = text.rpartition("@")
    return f"{_mixed(f, local, 'mail', back)}@{host}"


def _key_id(f: Feistel, text: str, back: bool) -> str | None:
    return text[:4] + _mixed(f, text[4:], "key", back)


def _secret(f: Feistel, text: str, back: bool) -> str | None:
    head, value = re.match(r"(.*?[=:]\s*[\"']?)(.*)", text, re.S).groups()
    return head + (_hex(f, value, back) if re.fullmatch("[0-9a-f]+", value) else _mixed(f, value, "secret", back))


# Kinds in the order in which they claim a place of the text: name, pattern (fixed formats), permutation. Days, months,
# account numbers and the rest are written as these formats are written everywhere.
KINDS: tuple[tuple[str, str, Callable], ...] = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])", _email),
    ("key_id", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", _key_id),
    ("secret", r"(?<![\w])(?:password|passwd|token|secret|api_key|apikey)\s*[=:]\s*[\"']?[A-Za-z0-9+/_-]{8,}", _secret),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _ip),
    ("date_ymd", r"(?<![\d./-])\d{4}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{1,2}(?![\d]|[./-]\d)", _date("ymd")),
    ("date_dmy", r"(?<![\d./-])\d{1,2}(?:\.\d{1,2}\.|-\d{1,2}-)\d{4}(?![\d]|[./-]\d)", _date("dmy", "mdy")),
    ("date_mdy", r"(?<![\d./-])\d{1,2}/\d{1,2}/\d{4}(?![\d]|[./-]\d)", _date("mdy", "dmy")),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])", _card),
    ("phone", rf"(?<![\w+(]){_NATIONAL}(?![\w-])|(?<![\w+])\+\d(?:(?:[ ./-]|[ .-]?\(|\)[ .-]?)?\d){{6,14}}(?![\w-])", _phone),
)
NAMES = [name for name, _, _ in KINDS]
_CLAIM = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern, _ in KINDS))
_MAY_HOLD = re.compile(r"\d|@|password|token|secret|api")
_PERMUTE = {name: function for name, _, function in KINDS}


def pseudonymise(text: str | None, feistel: Feistel, back: bool = False) -> tuple[str | None, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind were replaced."""
    counts: dict[str, int] = {}
    if not text or not _MAY_HOLD.search(text):
        return text, counts
    parts, at, start = [], 0, 0
    while m := _CLAIM.search(text, start):
        kind = m.lastgroup
        new = _PERMUTE[kind](feistel, m[0], back)
        if new is None:
            # Not a value of this kind; another kind may still claim the place.
            for name, pattern, function in KINDS[NAMES.index(kind) + 1 :]:
                m2 = re.compile(pattern).match(text, m.start())
                if m2 and (new := function(feistel, m2[0], back)) is not None:
                    kind, m = name, m2
                    break
        if new is None:
            start = m.start() + 1
            while start < len(text) and text[start - 1].isalnum() and text[start].isalnum():
                start += 1
            continue
        parts += [text[at : m.start()], new]
        at = start = m.end()
        counts[kind] = counts.get(kind, 0) + 1
    return ("".join([*parts, text[at:]]) if parts else text), counts


def pseudonymise_documents(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``n_<kind>`` (long) for every kind. ``back`` restores the texts of the same key.

    Nulls and odd rows: a null text stays null, an empty one empty, with zero counts. Repeated rows give equal results; an
    empty table stays empty. Further columns are passed on; columns named like the counts are replaced.
    """
    secret = hashlib.sha256(key.encode()).digest()

    def run(texts: list, _: dict) -> dict[str, list]:
        feistel = Feistel(secret)
        done = [pseudonymise(t, feistel, back) for t in texts]
        return {"text": [t for t, _ in done], **{f"n_{k}": [c.get(k, 0) for _, c in done] for k in NAMES}}

    return transform_text(docs, {}, run, {f"n_{k}": "bigint" for k in NAMES})

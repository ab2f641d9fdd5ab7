"""Format-preserving pseudonyms for personal numbers, dates and addresses."""

from __future__ import annotations

import re
from datetime import date
from functools import lru_cache, partial
from hashlib import shake_256
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictgraph.llm.common import place_of, release, ship_package

ROUNDS = 10

# Digits are those of ASCII throughout: other scripts' digits make no value.
_DIGITS = "0123456789"

# Candidates; what they must satisfy besides is checked in the functions below.
_EMAIL = re.compile(r"(?<![\w.%+-])([A-Za-z0-9._%+-]+)@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_SECRET = re.compile(
    r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|(?:api|access|private)[_-]?key)[\"']?\s{0,4}[:=]\s{0,4}[\"']?([a-z0-9+/_-]{8,})"
)
_NUMBER = re.compile(
    r"(?<![\w.])(?P<ip>(?:[0-9]{1,3}\.){3}[0-9]{1,3})(?!\w|\.[0-9])"
    r"|(?<![\w+])(?P<phone>\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,5}){1,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}(?P<s5>[ .-])[0-9]{3}(?P=s5)[0-9]{4})(?![\w-]|\.[0-9])"
    r"|(?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"
    r"|(?<![\w/.-])(?P<date>[0-9]{4}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2}|[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4})(?!(?!T[0-9])\w|[-/.][0-9])"
    r"|(?<![\w-])(?P<card>[0-9]{4}(?P<s3>[ .-])[0-9]{4}(?P=s3)[0-9]{4}(?P=s3)[0-9]{1,7}|[0-9]{4}(?P<s4>[ .-])[0-9]{6}(?P=s4)[0-9]{5}|[0-9]{13,19})(?![\w-]|\.[0-9])"
    r"|(?<!\w)(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
)

# Lengths of IBANs by country (public registry).
_IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 "
        "GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 "
        "MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 "
        "VA22 VG24 XK20"
    ).split()
}

# Digits of a phone number after its country code, at the most, by code (public
# numbering plans). Under other codes a number has 15 digits in all at the most.
_PHONE_LENGTHS = {
    c.split(":")[0]: int(c.split(":")[1])
    for c in (
        "1:10 7:10 20:10 27:9 30:10 31:9 32:9 33:9 34:9 36:9 39:11 40:9 41:9 43:13 44:10 45:8 46:9 47:8 48:9 49:11 51:9 52:10 53:8 54:11 "
        "55:11 56:9 57:10 58:10 60:10 61:9 62:12 63:10 64:10 65:8 66:9 81:10 82:11 84:10 86:11 90:10 91:10 92:10 93:9 94:9 95:10 98:10 "
        "212:9 213:9 216:8 218:9 234:10 254:10 351:9 352:11 353:9 354:9 358:12 359:9 370:8 371:8 372:8 380:9 381:9 385:9 386:8 420:9 421:9 "
        "852:8 853:8 855:9 880:10 886:9 960:7 961:8 962:9 963:9 964:10 965:8 966:9 968:8 971:9 972:9 973:8 974:8 977:10 992:9 994:9 995:9 "
        "996:9 998:9"
    ).split()
}

# Names of the months, in full and, in English, their first letters.
_MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "en short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
# A name that two lists share counts for the first of them.
_MONTH_OF: dict[str, tuple[str, int]] = {}
for _list, _names in _MONTHS.items():
    for _at, _name in enumerate(_names):
        _MONTH_OF.setdefault(_name, (_list, _at + 1))
_MONTH = "|".join(sorted(_MONTH_OF, key=len, reverse=True))
_NAMED = re.compile(
    rf"(?<![\w.,/-])(?P<d1>[0-9]{{1,2}})(?:st|nd|rd|th|\.|er)?(?: de)? (?P<m1>{_MONTH})\.?(?: de|,)? (?P<y1>[0-9]{{4}})(?![\w-])"
    rf"|(?<!\w)(?P<m2>{_MONTH})\.? (?P<d2>[0-9]{{1,2}})(?:st|nd|rd|th)?,? (?P<y2>[0-9]{{4}})(?![\w-])"
)


class Permutation:
    """Keyed permutation of 0..size-1 without fixed points.

    A Feistel network over two halves in mixed radix, walked along its cycle
    until it is back in range, gives a permutation f; the value mapped is
    f^-1(f(x) + 1), one single cycle through all values.
    """

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.left = isqrt(size - 1) + 1
        self.right = -(-size // self.left)
        self.head = len(key).to_bytes(4, "big") + key + tweak.encode() + b"\0"
        self.width = self.left.bit_length() // 8 + 16

    def _round(self, k: int, half: int) -> int:
        data = self.head + bytes([k]) + half.to_bytes(self.width, "big")
        return int.from_bytes(shake_256(data).digest(self.width), "big")

    def _forward(self, x: int) -> int:
        while True:
            a, b = divmod(x, self.right)
            for k in range(ROUNDS):
                if k % 2:
                    b = (b + self._round(k, a)) % self.right
                else:
                    a = (a + self._round(k, b)) % self.left
            x = a * self.right + b
            if x < self.size:
                return x

    def _backward(self, x: int) -> int:
        while True:
            a, b = divmod(x, self.right)
            for k in reversed(range(ROUNDS)):
                if k % 2:
                    b = (b - self._round(k, a)) % self.right
                else:
                    a = (a - self._round(k, b)) % self.left
            x = a * self.right + b
            if x < self.size:
                return x

    def __call__(self, x: int, step: int = 1) -> int:
        return self._backward((self._forward(x) + step) % self.size)


@lru_cache(4096)
def _permutation(key: bytes, tweak: str, size: int) -> Permutation:
    return Permutation(key, tweak, size)


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in _DIGITS else c for c in shape)


def _card(text: str, key: bytes, step: int) -> str | None:
    digits = re.sub("[^0-9]", "", text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]) or not digits.strip("0"):
        return None
    n = len(digits) - 2
    x = _permutation(key, f"card{len(digits)}{digits[0]}", 10**n)(int(digits[1:-1]), step)
    payload = digits[0] + str(x).zfill(n)
    return _fill(text, payload + str(luhn_digit(payload)))


def _iban(text: str, key: bytes, step: int) -> str | None:
    code = text.replace(" ", "")
    country, body = code[:2], code[4:]
    if not 15 <= len(code) <= 34 or iban_check(country, body) != int(code[2:4]):
        return None
    body = _characters(body, "iban" + country, key, step)
    if body is None:
        return None
    it = iter(f"{country}{iban_check(country, body):02d}{body}")
    return "".join(c if c == " " else next(it) for c in text)


def _country(digits: str) -> tuple[str, int]:
    """Country code and the most digits that can follow it."""
    for n in (1, 2, 3):
        if digits[:n] in _PHONE_LENGTHS:
            return digits[:n], _PHONE_LENGTHS[digits[:n]]
    return digits[:1], 14


def _phone(text: str, key: bytes, step: int) -> str | None:
    """The country code stays, as it decides how long a number can be."""
    digits = re.sub("[^0-9]", "", text)
    if not text.startswith("+"):
        digits = "1" + digits  # a number of ten digits is the same with or without +1
    code, most = _country(digits)
    n = len(digits) - len(code)
    if len(digits) < 8 or n > most:
        return None
    new = code + str(_permutation(key, f"phone{n}{code}", 10**n)(int(digits[len(code) :]), step)).zfill(n)
    return _fill(text, new if text.startswith("+") else new[1:])


def _ip(text: str, key: bytes, step: int) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = 0
    for p in parts:
        x = x << 8 | int(p)
    x = _permutation(key, "ip", 1 << 32)(x, step)
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _ssn(text: str, key: bytes, step: int) -> str | None:
    area, group, serial = (int(p) for p in text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x = _permutation(key, "ssn", 898 * 99 * 9999)(x, step)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


_FIRST = date(1900, 1, 1).toordinal()
_DAYS = date(2099, 12, 31).toordinal() - _FIRST + 1


def _date(text: str, key: bytes, step: int) -> str | None:
    """A day of 1900 to 2099. With the year last, dots mean day first; slashes
    and hyphens mean month first where that is a date, else day first (such
    dates stay among those that can only be read so)."""
    sep = re.search("[^0-9]", text).group()
    parts = text.split(sep)
    if len(parts[0]) == 4:
        order = (0, 1, 2)
    elif sep == "." or int(parts[0]) > 12:
        order = (2, 1, 0)
    else:
        order = (2, 0, 1)
    try:
        day = date(*(int(parts[i]) for i in order))
    except ValueError:
        return None
    x = day.toordinal() - _FIRST
    if not 0 <= x < _DAYS:
        return None
    permute = _permutation(key, "date", _DAYS)
    while True:
        x = permute(x, step)
        day = date.fromordinal(x + _FIRST)
        if sep == "." or order != (2, 1, 0) or day.day > 12:
            break
    pad = 1 if any(len(p) == 1 for p in parts) else 2
    out = [""] * 3
    for place, value, width in zip(order, (day.year, day.month, day.day), (4, pad, pad)):
        out[place] = str(value).zfill(width)
    return sep.join(out)


def _named_date(text: str, key: bytes, step: int) -> str | None:
    """A day of 1900 to 2099 with its month in letters. The new month is written
    in the same list of names, among the names that are read as of that list."""
    m = _NAMED.fullmatch(text)
    k = "1" if m.group("m1") else "2"
    names, month = _MONTH_OF[m.group("m" + k)]
    try:
        day = date(int(m.group("y" + k)), month, int(m.group("d" + k)))
    except ValueError:
        return None
    x = day.toordinal() - _FIRST
    if not 0 <= x < _DAYS:
        return None
    permute = _permutation(key, "date", _DAYS)
    while True:
        x = permute(x, step)
        day = date.fromordinal(x + _FIRST)
        if _MONTH_OF[name := _MONTHS[names][day.month - 1]][0] == names:
            break
    wide = 2 if m.group("d" + k)[0] == "0" else 1
    new = {"d" + k: str(day.day).zfill(wide), "m" + k: name, "y" + k: f"{day.year:04d}"}
    out, at = [], 0
    for group in sorted(new, key=m.start):
        out += [text[at : m.start(group)], new[group]]
        at = m.end(group)
    return "".join([*out, text[at:]])


_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]


def _characters(text: str, tweak: str, key: bytes, step: int, alphabet: str | None = None) -> str | None:
    """Characters permuted within their classes (or within ``alphabet``)."""
    classes = [alphabet or next((k for k in _CLASSES if c in k), "") for c in text]
    size, x = 1, 0
    for c, k in zip(text, classes):
        if k:
            size, x = size * len(k), x * len(k) + k.index(c)
    if size < 2:
        return None
    shape = "".join("-" if not k else str(_CLASSES.index(k)) if k in _CLASSES else "h" for k in classes)
    x = _permutation(key, f"{tweak}{shape}", size)(x, step)
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if classes[i]:
            x, at = divmod(x, len(classes[i]))
            out[i] = classes[i][at]
    return "".join(out)


def _secret(text: str, key: bytes, step: int) -> str | None:
    if not any(c in _DIGITS for c in text):
        return None
    hexes = next((a for a in ("0123456789abcdef", "0123456789ABCDEF") if set(text) <= set(a)), None)
    return _characters(text, "secret", key, step, hexes)


def _email(text: str, key: bytes, step: int) -> str | None:
    """Small and capital letters are one class here: addresses that differ in
    them alone are one person's, and so are their pseudonyms."""
    new = _characters(text.lower(), "email", key, step)
    return new and "".join(c.upper() if old.isupper() else c for c, old in zip(new, text))


_NUMBER_KINDS = ("ip", "phone", "ssn", "date", "card", "iban")
_KINDS = {"ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card, "iban": _iban, "email": _email, "secret": _secret, "named date": _named_date}


@lru_cache(65_536)
def pseudonym(kind: str, value: str, key: bytes, step: int = 1) -> str | None:
    """The value's stand-in in the same format; null if the value is not valid
    for its kind. ``step`` -1 undoes it."""
    return _KINDS[kind](value, key, step)


_WORD = re.compile(r"\w+")


def _ends(kind: str, found: str) -> list[int]:
    """Where a candidate may end, in the order of trial: it can have taken in a
    word that follows the value. What decides (the form, the country of an
    IBAN, the country code of a phone number) is the same in the pseudonym."""
    ends = [m.end() for m in _WORD.finditer(found)][::-1]
    if kind == "iban":
        size = _IBAN_LENGTHS.get(found[:2])
        return [e for e in ends if size in (None, e - found.count(" ", 0, e))]
    if kind == "phone" and found[0] == "+":
        # the longest that its country's plan allows; a longer one is another number's
        return ends
    return [len(found)]


def _spans(text: str, valid):
    """Candidates as (start, end, end of what they are part of, kind)."""
    if "@" in text:
        yield from ((*m.span(1), m.end(), "email") for m in _EMAIL.finditer(text))
    if "=" in text or ":" in text:
        yield from ((*m.span(1), m.end(1), "secret") for m in _SECRET.finditer(text))
    yield from ((m.start(), m.end(), m.end(), "named date") for m in _NAMED.finditer(text))
    at = 0
    while m := _NUMBER.search(text, at):
        kind = next(k for k in _NUMBER_KINDS if m.group(k) is not None)
        start = m.start()
        end = next((e for e in _ends(kind, m.group()) if valid(kind, m.group()[:e])), None)
        if end is None:  # its first word begins no value, but the next may
            at = _WORD.search(text, start).end()
        else:
            at = start + end
            yield start, at, at, kind


_DIGIT = re.compile("[0-9]")


def pseudonymise(text: str, key: bytes, step: int = 1) -> tuple[str, list[str]]:
    """The text with every valid value replaced, and the values' kinds in order."""
    if "@" not in text and not _DIGIT.search(text):
        return text, []
    found = []
    for rank, (start, end, whole, kind) in enumerate(_spans(text, lambda kind, value: pseudonym(kind, value, key, step) is not None)):
        new = pseudonym(kind, text[start:end], key, step)
        if new is not None:
            found.append((start, rank, end, whole, kind, new))
    out, kinds, at, taken = [], [], 0, 0
    for start, _, end, whole, kind, new in sorted(found):
        if start >= taken:  # an address or credential begins before a number inside it
            out += [text[at:start], new]
            kinds.append("date" if kind == "named date" else kind)
            at, taken = end, whole
    return "".join([*out, text[at:]]), kinds


def _replace(key, step, text_at, with_kinds, batches):
    release()
    for batch in batches:
        texts, kinds = [], []
        for text in batch.column(text_at).to_pylist():
            new, found = (None, []) if text is None else pseudonymise(text, key, step)
            texts.append(new)
            kinds.append(found)
        out = batch.set_column(text_at, batch.schema.field(text_at).name, pa.array(texts, pa.string()))
        yield out.append_column("kinds", pa.array(kinds, pa.list_(pa.string()))) if with_kinds else out


def pseudonymise_documents(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal values in ``text_col`` replaced.

    Card numbers (Luhn), IBANs (mod 97), phone numbers (length), IPv4 addresses
    (octets), US social security numbers (ranges), dates (calendar, 1900 to
    2099), the local part of mail addresses and credentials are mapped by a
    Feistel permutation of all values of their format under ``key``: the result
    is valid in the same format and written the same way, never the value
    itself, and equal values give equal results in every document, however they
    are grouped. Months may be digits or names (English, German, French, Spanish).
    Numbers that are not valid stay as they are, and so do digits other than
    those of ASCII. A phone number keeps its country code and ends where its
    country's plan must end; mail addresses link whatever their capitals.

    Null texts stay null, and rows without such values stay as they are, other
    columns always; repeated rows stay repeated, an empty table stays empty. Every
    row is worked on by itself, a very long text is held whole by its task;
    whoever holds the key can undo it (``restore_documents``).
    """
    return _mapped(docs, key, 1, text_col)


def restore_documents(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Undo ``pseudonymise_documents`` under the same key."""
    return _mapped(docs, key, -1, text_col)


def _mapped(docs: DataFrame, key: bytes, step: int, text_col: str) -> DataFrame:
    ship_package(docs.sparkSession)
    rows = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(partial(_replace, key, step, place_of(rows, text_col), False), rows.schema)


def pii_report(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text`` with pseudonyms, ``n_values`` and ``kinds`` (in the
    order of the text) of every row; see ``pseudonymise_documents``. A null text
    stays null with no values; repeated rows and null ids are kept, an empty table
    gives an empty result."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, text string, kinds array<string>"
    out = rows.mapInArrow(partial(_replace, key, 1, 1, True), schema)
    return out.withColumn("n_values", F.size("kinds"))

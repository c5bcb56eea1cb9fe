"""Format-preserving pseudonyms for personal data (operator 6).

E-mail addresses, card and account numbers, telephone and social security numbers, IBANs, IP addresses, dates and quoted
secrets are recognised and validated, then replaced within their own format by a keyed Feistel permutation: digits stay
digits, letters stay letters, separators stay, a number's check digit is valid again, a date becomes another date of the
same widths. What does not validate is left as it is: numbers of a card's length without a valid check digit, days that no
calendar has, addresses with parts above 255 or with leading zeros. The permutation sees the value without its separators,
and e-mail addresses without their case, so equal values get equal pseudonyms in all documents, different values different
ones, and the holder of the key can turn them back.

Edge cases: a null text stays null, an empty one empty; nothing is cut from a text; repeated rows each give a row; other
columns stay as they are in :func:`pseudonymise`; an empty table gives an empty one.
"""

from __future__ import annotations

import datetime
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import forget, slices

KEY = b"set a key of your own"
ROUNDS = 10
KINDS = ("email", "card", "phone", "ssn", "iban", "ip", "date", "secret")

_email = re.compile(r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_secret = re.compile(r"(?i:token|secret|api_?key|password)[ \t]*[=:][ \t]*\"?([0-9A-Za-z_-]{16,})")
_iban = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![0-9A-Za-z])")
_number = re.compile(
    r"""(?<![\w.])(?:
      (?P<date>\d{4}(?:-\d\d?-\d\d?|/\d\d?/\d\d?|\.\d\d\.\d\d)|\d\d?(?:-\d\d?-|[./]\d\d?[./])\d{4})
     |(?P<ip>\d{1,3}(?:\.\d{1,3}){3})
     |(?P<card>\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})
     |(?P<ssn>\d{3}-\d\d-\d{4})
     |(?P<phone>\d{3}[-. ]\d{3}[-. ]\d{4})
    )(?!\w|\.\d)
    |(?P<called>\+\d{1,3}[ ]?\(\d{2,4}\)[ ]?\d{3}[ -]\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ ]?\d{3}-\d{4})(?!\w|\.\d)""",
    re.X | re.A,
)
#: Alphabets that a character may be permuted in.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, range(0xE0, 0xF7))), "".join(map(chr, range(0xC0, 0xD7))))
_place = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def _prf(key: bytes, tweak: bytes, number: int, value: int) -> int:
    return int.from_bytes(hashlib.blake2b(tweak + bytes([number]) + value.to_bytes((value.bit_length() + 8) // 8, "little"), key=key[:64], digest_size=32).digest(), "little")


def feistel(left: int, right: int, sizes: tuple[int, int], key: bytes, tweak: bytes, back: bool = False) -> tuple[int, int]:
    """A keyed permutation of pairs with left < sizes[0] and right < sizes[1], or its inverse."""
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if r % 2:
            right = (right + sign * _prf(key, tweak, r, left)) % sizes[1]
        else:
            left = (left + sign * _prf(key, tweak, r, right)) % sizes[0]
    return left, right


def permute(chars: str, key: bytes, kind: str, back: bool = False) -> str:
    """The characters that are in ALPHABETS, each within its own alphabet; others stay. A permutation for each layout."""
    known = [(i, *_place[c]) for i, c in enumerate(chars) if c in _place]
    if not known:
        return chars
    layout = "".join(str(ALPHABETS.index(_place[c][0])) if c in _place else c for c in chars)
    half, halves = len(known) // 2, []
    for part in (known[:half], known[half:]):
        value = size = 1
        value = 0
        for _, alphabet, n in part:
            value, size = value * len(alphabet) + n, size * len(alphabet)
        halves.append((value, size))
    values = feistel(halves[0][0], halves[1][0], (halves[0][1], halves[1][1]), key, f"{kind}:{layout}:".encode(), back)
    out = list(chars)
    for part, value in zip((known[:half], known[half:]), values, strict=True):
        for i, alphabet, _ in reversed(part):
            value, n = divmod(value, len(alphabet))
            out[i] = alphabet[n]
    return "".join(out)


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _relaid(raw: str, digits: str) -> str:
    """``raw`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in raw)


def _card(raw, key, back):
    digits = "".join(c for c in raw if c in "0123456789")
    if not luhn(digits):
        return None
    own = permute(digits[:-1], key, "luhn", back)
    return _relaid(raw, own + next(d for d in "0123456789" if luhn(own + d)))


def _ip(raw, key, back):
    parts = [int(x) for x in raw.split(".")]
    if max(parts) > 255 or ".".join(map(str, parts)) != raw:
        return None
    a, b = feistel(parts[0] << 8 | parts[1], parts[2] << 8 | parts[3], (1 << 16, 1 << 16), key, b"ip:", back)
    return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"


def _date(raw, key, back):
    """Year, month and day in any usual order, kept with separators and widths. Days up to 12 and beyond stay apart, so that the pseudonym is read in the same order."""
    fields = re.split(r"[-./]", raw)
    for order in ("ymd", "ydm") if len(fields[0]) == 4 else ("dmy", "mdy"):
        at = dict(zip(order, fields, strict=True))
        try:
            first = datetime.date(*(int(at[c]) for c in "ymd"))
            break
        except ValueError:
            continue
    else:
        return None
    day = first.toordinal() - FIRST_DAY
    if not 0 <= day < DAYS:
        return None
    while True:  # walk along the cycle until the number is a day that fits the layout
        a, b = feistel(day >> 9, day & 511, (1 << 8, 1 << 9), key, b"date:", back)
        day = a << 9 | b
        if day < DAYS:
            d = datetime.date.fromordinal(FIRST_DAY + day)
            if (d.day > 12) == (first.day > 12) and d.day < 10 ** len(at["d"]) and d.month < 10 ** len(at["m"]):
                break
    new = {"y": f"{d.year:04}", "m": f"{d.month:0{len(at['m'])}}", "d": f"{d.day:0{len(at['d'])}}"}
    return _relaid(raw, "".join(new[c] for c in order))


def _phone(raw, key, back):
    digits = "".join(c for c in raw if c in "0123456789")
    if not 8 <= len(digits) <= 15:
        return None
    lead = len(re.match(r"\+?(\d{1,3}(?=\D))?", raw)[1] or "") if raw[0] == "+" else 0
    return _relaid(raw, digits[:lead] + permute(digits[lead:], key, "phone", back))


#: Characters of an IBAN by country, to tell one printed in groups from words after it.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split()}


def _ibans(raw, key, back):
    """The pseudonym of an IBAN, with the spaces of ``raw``; words of capitals after its last group are not read."""
    def check(country, account):
        return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97

    groups = raw.split(" ")
    for n in range(len(groups), 0, -1):
        own = "".join(groups[:n])
        if len(groups) > 1 and (n < 3 or len(own) != IBAN_LENGTHS.get(own[:2], len(own)) or not 15 <= len(own) <= 34):
            continue
        if int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1:
            break
    else:
        return None
    account = permute(own[4:], key, "iban" + own[:2], back)
    new = iter(f"{own[:2]}{check(own[:2], account):02}{account}")
    return "".join(c if c == " " else next(new) for c in " ".join(groups[:n]))


def _mail(raw, key, back):
    local, _, domain = raw.partition("@")
    labels = domain.split(".")
    own = max(0, len(labels) - 2)
    head, tail = local + "@" + ".".join(labels[:own]), ".".join(labels[own:])
    # Case stays where it is but says nothing, so an address is the same one in any case.
    upper = [c in _place and c != c.lower() for c in head]
    low = "".join(c.lower() if u else c for c, u in zip(head, upper, strict=True))
    new = permute(low, key, "email:" + tail.lower(), back)
    return "".join(c.upper() if u else c for c, u in zip(new, upper, strict=True)) + ("." if own else "") + tail


def mask_text(text: str, key: bytes = KEY, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms (or, ``back``, with the values again), and how many of each kind."""
    found: dict[str, int] = {}
    spans: list[tuple[int, int, str]] = []
    taken = bytearray()

    def take(kind, start, end, new):
        nonlocal taken
        if new is not None:
            taken = taken or bytearray(len(text))
            if taken.find(1, start, end) < 0:
                taken[start:end] = b"\1" * (end - start)
                spans.append((start, end, new))
                found[kind] = found.get(kind, 0) + 1

    if "@" in text:
        for m in _email.finditer(text):
            take("email", m.start(), m.end(), _mail(m[0], key, back))
    if "=" in text or ":" in text:
        for m in _secret.finditer(text):
            take("secret", m.start(1), m.end(1), permute(m[1], key, "secret", back))
    if not text.isalpha():
        for m in _iban.finditer(text):  # before numbers, which its groups look like
            new = _ibans(m[0], key, back)
            take("iban", m.start(), m.start() + len(new or ""), new)
        for m in _number.finditer(text):
            kind, raw = m.lastgroup, m[0]
            if kind == "ssn":
                new = _relaid(raw, permute(raw.replace("-", ""), key, "ssn", back))
            else:
                new = {"date": _date, "ip": _ip, "card": _card, "phone": _phone, "called": _phone}[kind](raw, key, back)
            take("phone" if kind == "called" else kind, m.start(), m.end(), new)
    if not spans:
        return text, found
    out, at = [], 0
    for s, e, new in sorted(spans):
        out += [text[at:s], new]
        at = e
    return "".join(out) + text[at:], found


def _rows(names: list[str], text: str, key: bytes, counts: bool):
    def run(batches):
        forget()
        for batch in slices(batches, text):
            got = [(None, {}) if t is None else mask_text(t, key) for t in batch.column(text).to_pylist()]
            columns = [pa.array([g[0] for g in got], pa.string()) if n == text else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            if counts:
                columns += [pa.array([g[1].get(k, 0) for g in got], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pseudonymise(docs: DataFrame, text: str = "text", key: bytes = KEY, counts: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; with ``counts`` also ``n_<kind>`` for each of KINDS."""
    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + "".join(f", n_{k} long" for k in KINDS if counts)
    names = docs.columns + [f"n_{k}" for k in KINDS if counts]
    return docs.mapInArrow(_rows(names, text, key, counts), fields)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms, and how many of each kind."""
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), counts=True)

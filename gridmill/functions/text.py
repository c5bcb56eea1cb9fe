"""Lines, fields, tokens and keys as Column expressions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v)


def key_value(line="value", separator: str = "\t") -> tuple[Column, Column]:
    """A line cut at its first separator; without one, the whole line and an empty value."""
    line = _c(line)
    at = F.instr(line, separator)
    key = F.when(at > 0, F.substring(line, F.lit(1), at - 1)).otherwise(line)
    value = F.when(at > 0, F.substring(line, at + len(separator), F.length(line))).otherwise(F.lit(""))
    return key, value


def key_value_line(key, value, separator: str = "\t") -> Column:
    """A line of key and value; a null side goes without separator, two nulls give null (no line)."""
    key, value = _c(key).cast("string"), _c(value).cast("string")
    return F.when(key.isNull() & value.isNull(), F.lit(None)).otherwise(F.concat_ws(separator, key, value))


def tokens(text="text") -> Column:
    """Words between spaces, tabs, line ends and form feeds."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"[ \t\n\r\f]+"), lambda w: w != "")


def pieces(text="text") -> Column:
    """What lies between single spaces or tabs, empty words included."""
    return F.split(F.coalesce(_c(text), F.lit("")), r"[ \t]")


def matches(text, pattern: str, group: int = 0) -> Column:
    """The group of every match."""
    return F.regexp_extract_all(_c(text), F.lit(pattern if group else f"({pattern})"), F.lit(group or 1))


def parse_spec(spec: str) -> tuple[list[tuple[int, int | None]], list[tuple[int, int | None]]]:
    """``6,5,1-3:0-`` to the key's and the value's items: (first, last), last null where open."""
    def items(part):
        out = []
        for item in filter(None, part.split(",")):
            a, dash, b = item.partition("-")
            out.append((int(a), (int(b) if b else None) if dash else int(a)))
        return out

    key, _, value = spec.partition(":")
    return items(key), items(value)


def select_fields(line, items: list[tuple[int, int | None]], separator: str = "\t") -> Column:
    """The listed fields joined again; a field that the line lacks is empty."""
    fields, parts = F.split(_c(line), re.escape(separator)), []
    for first, last in items:
        if last is None:
            parts.append(F.slice(fields, first + 1, F.greatest(F.size(fields) - first, F.lit(0))))
        else:
            parts.append(F.array(*(F.coalesce(F.get(fields, F.lit(i)), F.lit("")) for i in range(first, last + 1))))
    return F.array_join(F.concat(*parts), separator) if parts else F.lit("")


def field_selection(df: DataFrame, spec: str, key: str | None = None, value: str = "value", separator: str = "\t", key_sep: str = "") -> DataFrame:
    """key and value after a selection ``keyfields:valuefields`` over the line ``key + key_sep + value``."""
    keys, values = parse_spec(spec)
    line = F.col(value) if key is None else F.concat(F.col(key), F.lit(key_sep), F.col(value))
    return df.select(select_fields(line, keys, separator).alias("key"), select_fields(line, values, separator).alias("value"))


_part = re.compile(r"-k(\d+)(?:\.(\d+))?([nr]*)(?:,(\d+)(?:\.(\d+))?([nr]*))?")


def key_parts(text, spec: str, separator: str = "\t") -> list[tuple[Column, bool, bool]]:
    """The parts of a ``-kF[.C][nr][,F[.C][nr]]`` spec: (text of the part or null, numeric, reversed). Global ``-n -r -nr`` hold where a part has no flag."""
    text = _c(text)
    flags = "".join(re.findall(r"(?:^|\s)-([nr]+)(?=\s|$)", spec))
    found = list(_part.finditer(spec))
    if not found:
        return [(text, "n" in flags, "r" in flags)]
    fields = F.split(text, re.escape(separator))
    # 0-based start of each field in the text.
    def start(i):
        return F.length(F.array_join(F.slice(fields, 1, i - 1), separator)) + (len(separator) if i > 1 else 0)

    out = []
    for m in found:
        first, char, last, last_char = int(m[1]), int(m[2] or 1), int(m[4] or 0), int(m[5] or 0)
        own = (m[3] or "") + (m[6] or "") or flags
        begin = start(first) + char
        if last:
            end = start(last) + (last_char if last_char else F.length(F.get(fields, F.lit(last - 1))))
            end = F.when(F.size(fields) >= last, F.least(end, F.length(text))).otherwise(F.length(text))
        else:
            end = F.length(text)
        part = F.when((F.size(fields) >= first) & (begin <= F.length(text)), F.substring(text, begin, F.greatest(end - begin + 1, F.lit(0))))
        out.append((part, "n" in own, "r" in own))
    return out


def number(text: Column) -> Column:
    """The number at the start of a text: sign, digits, point, digits; zero where there is none."""
    found = F.regexp_extract(text, r"^\s*(-?[0-9]*(?:\.[0-9]*)?)", 1)
    return F.coalesce(found.try_cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)"))


def sort_columns(text, spec: str, separator: str = "\t") -> list[Column]:
    """Sort keys for a key spec; a part that a line lacks comes first, or last if reversed."""
    out = []
    for part, numeric, back in key_parts(text, spec, separator):
        c = F.when(part.isNotNull(), number(part)) if numeric else part
        out.append(c.desc_nulls_last() if back else c.asc_nulls_first())
    return out


def byte_hash(text: Column, start: int = 1) -> Column:
    """The 31-based hash of a text's bytes, as a signed 32-bit number."""
    # Whole batches at once: a round for each place, over the texts that reach it.
    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        data = np.frombuffer(b"".join(t for t in texts.to_pylist() if t), np.int8)
        at = np.cumsum(size) - size
        h = np.where(size == 0, 0, start).astype(np.int32)
        left, i = np.flatnonzero(size), 0
        while len(left):
            h[left] = h[left] * np.int32(31) + data[at[left] + i]
            i += 1
            left = left[size[left] > i]
        return pa.array(h.astype(np.int64), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return hashed(text.cast("binary"))


def key_partition(text, spec: str, n: int, separator: str = "\t") -> Column:
    """The partition, of n, of the selected bytes of a key; an empty key goes to 0."""
    parts = [p for p, _, _ in key_parts(text, spec, separator)]
    h = byte_hash(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)), 0)
    return F.pmod(h.bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(n)).cast("int")


def binary_partition(key: Column, n: int, left: int = 0, right: int = -1) -> Column:
    """The partition, of n, of the bytes from left to right, negative ones counted from the end."""
    size = F.octet_length(key)
    at = lambda i: F.lit(i) if i >= 0 else size + i
    part = F.substring(key.cast("binary"), (at(left) + 1).cast("int"), (at(right) - at(left) + 1).cast("int"))
    return F.pmod(byte_hash(part).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(n)).cast("int")


def range_partition(key: Column, splits: list) -> Column:
    """The number of split points that are not above the key: a key equal to one goes right. Splits must rise strictly."""
    if any(a >= b for a, b in zip(splits, splits[1:], strict=False)):
        raise ValueError("split points must rise strictly")
    return sum((F.when(key >= F.lit(s), 1).otherwise(0) for s in splits), F.lit(0)).cast("int")

"""Joins of several sources by key: inner, outer and override with all multiplicities, their expression language, and the tagged join."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _sources(frames: list[DataFrame], key: str) -> list[DataFrame]:
    """Each source as key and one struct of its other columns, named s0, s1, ..."""
    return [f.select(F.col(key), F.struct(*(c for c in f.columns if c != key)).alias(f"s{i}")) for i, f in enumerate(frames)]


#: Rows of a key's product that one task gives, about.
PRODUCT_ROWS = 16_000_000


def _product(sources: list[DataFrame], key: str) -> DataFrame:
    """key, s0, s1, ...: the product of all sources' rows for each key that every source has.

    A key whose product is beyond PRODUCT_ROWS is cut in slices: its rows in the source that has most of them are dealt out,
    the others' rows go to each slice. All sources are dealt once, so no product is shuffled.
    They are joined from the smallest to the largest, so that what is joined on stays small.
    """
    sizes = reduce(lambda a, b: a.join(b, key), (f.groupBy(key).agg(F.count("*").alias(f"_n{i}")) for i, f in enumerate(sources)))
    ns = [F.col(f"_n{i}") for i in range(len(sources))]
    rows = reduce(lambda a, b: a * b, (n.cast("double") for n in ns))
    most = F.greatest(*ns) if len(ns) > 1 else ns[0]
    slices = F.least(F.ceil(rows / PRODUCT_ROWS), most).cast("long")
    dealt = F.coalesce(*(F.when(n == most, F.lit(i)) for i, n in enumerate(ns)))
    beyond = sizes.where(rows > PRODUCT_ROWS).select(key, slices.alias("_slices"), dealt.alias("_dealt"), *ns)
    total, *frequent = beyond.agg(F.sum("_slices"), *map(F.sum, ns)).first()
    large = beyond.select(key, "_slices", "_dealt")
    if not total:
        return reduce(lambda a, b: a.join(b, key), sources)
    tasks = max(64, min(2048, total))
    light, heavy = [], []
    for i, f in enumerate(sources):
        light.append(f.join(large.select(key), key, "left_anti"))
        # By the row's own values, so that a task that is run again deals alike.
        values = F.to_json(f"s{i}") if "map<" in f.schema[f"s{i}"].dataType.simpleString() else F.col(f"s{i}")
        own = F.when(F.col("_dealt") == i, F.array(F.pmod(F.xxhash64(values, F.lit(i)), F.col("_slices")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))
        heavy.append(f.join(large, key).select(*f.columns, F.explode(own).alias("_slice")).repartition(tasks, key, "_slice"))
    heavy = [heavy[i] for i in sorted(range(len(heavy)), key=frequent.__getitem__)]
    out = reduce(lambda a, b: a.hint("merge").join(b.hint("merge"), [key, "_slice"]), heavy).drop("_slice")
    return reduce(lambda a, b: a.join(b, key), light).unionByName(out)


def inner_join(*frames: DataFrame, key: str) -> DataFrame:
    """key, s0, s1, ...: the product of all sources' rows for each key that every source has. Null keys match nothing."""
    return _product(_sources(list(frames), key), key)


def outer_join(*frames: DataFrame, key: str) -> DataFrame:
    """key, s0, s1, ... (null where a source lacks the key) and ``present``, a bit for each source that has it.

    Each source gets a row without values for each key that only others have, so that one product gives the join. Rows
    without a key match nothing and follow by themselves.
    """
    sources = _sources(list(frames), key)
    keys = reduce(lambda a, b: a.unionByName(b), (f.select(key).where(F.col(key).isNotNull()) for f in sources)).distinct()
    padded = [f.unionByName(keys.join(f, key, "left_anti").withColumn(f"s{i}", F.lit(None).cast(f.schema[f"s{i}"].dataType))) for i, f in enumerate(sources)]
    without = [f.where(F.col(key).isNull()) for f in sources]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (_product(padded, key), *without))
    bits = sum((F.when(F.col(f"s{i}").isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i in range(len(frames))), F.lit(0).cast("bigint"))
    return out.withColumn("present", bits)


def override_join(*frames: DataFrame, key: str) -> DataFrame:
    """For each key, all rows of the last source that has it, and ``source``, its position. Sources have the same columns.

    Winners per key are found first from partial maxima, then joined back, so a frequent key is split like any join's.
    """
    tagged = [f.withColumn("source", F.lit(i)) for i, f in enumerate(frames)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    last = rows.groupBy(key).agg(F.max("source").alias("source"))
    return rows.join(last, [key, "source"])


class JoinExpression:
    """``inner(tbl(a), outer(tbl(b), tbl(c)))`` over named tables; more operations can be registered."""

    operations: dict[str, Callable[..., DataFrame]] = {"inner": inner_join, "outer": outer_join, "override": override_join}
    _token = re.compile(r"\s*(?:([A-Za-z_][\w.]*)|\"([^\"]*)\"|([(),]))")

    def __init__(self, tables: dict[str, DataFrame] | Callable[[str], DataFrame], key: str):
        self.table = tables.__getitem__ if isinstance(tables, dict) else tables
        self.key = key

    @classmethod
    def define(cls, name: str, operation: Callable[..., DataFrame]) -> None:
        cls.operations = cls.operations | {name: operation}

    def __call__(self, text: str) -> DataFrame:
        tokens, at = [], 0
        while at < len(text.rstrip()):
            m = self._token.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:at + 10]!r} in a join expression")
            tokens.append(m[1] or m[2] or m[3])
            at = m.end()
        out, rest = self._read(tokens)
        if rest:
            raise ValueError(f"unexpected {rest[0]!r} after a join expression")
        return out

    def _read(self, tokens: list[str]) -> tuple[DataFrame, list[str]]:
        if len(tokens) < 3 or tokens[1] != "(":
            raise ValueError("a join expression is name(...)")
        name, rest = tokens[0], tokens[2:]
        if name == "tbl":
            if rest[1:2] != [")"]:
                raise ValueError("tbl takes one name")
            return self.table(rest[0]), rest[2:]
        if name not in self.operations:
            raise ValueError(f"no operation {name!r}")
        parts = []
        while True:
            part, rest = self._read(rest)
            parts.append(part)
            if not rest:
                raise ValueError("a bracket is missing")
            if rest[0] == ")":
                return self.operations[name](*parts, key=self.key), rest[1:]
            rest = rest[1:]


def tagged_join(sources: dict[str, DataFrame], key: str, how: str = "inner", max_values_per_group: int | None = None) -> DataFrame:
    """Product of the sources' rows for each key, each source a struct named by its tag.

    ``how``: inner, outer, left or anti (rows of the first source whose key no other has). ``max_values_per_group`` keeps
    that many rows for each key and source (in the order of their columns); by default all.
    """
    tags = list(sources)
    frames = []
    for tag in tags:
        f = sources[tag]
        if max_values_per_group is not None:
            order = Window.partitionBy(key).orderBy(*(c for c in f.columns if c != key))
            f = f.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_values_per_group).drop("_n")
        frames.append(f.select(F.col(key), F.struct(*(c for c in f.columns if c != key)).alias(tag)))
    kind = {"inner": "inner", "outer": "full_outer", "left": "left", "anti": "left_anti"}[how]
    return reduce(lambda a, b: a.join(b, key, kind), frames)


def joined_line(frame: DataFrame, key: str, tags: list[str], separator: str = "\t") -> DataFrame:
    """key and ``value``: all columns of all tags as text, one after another."""
    parts = [F.col(f"{t}.{f.name}").cast("string") for t in tags for f in frame.schema[t].dataType]
    return frame.select(F.col(key), F.concat_ws(separator, *parts).alias("value"))

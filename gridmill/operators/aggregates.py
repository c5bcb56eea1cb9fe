"""Named aggregates, histograms, counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aggregate types by name: a value column to an aggregate column. More can be registered.
TYPES: dict[str, Callable[[Column], Column]] = {
    "LongValueSum": lambda v: F.sum(v.cast("bigint")),
    "DoubleValueSum": lambda v: F.sum(v.cast("double")),
    "LongValueMax": lambda v: F.max(v.cast("bigint")),
    "LongValueMin": lambda v: F.min(v.cast("bigint")),
    "StringValueMax": lambda v: F.max(v.cast("string")),
    "StringValueMin": lambda v: F.min(v.cast("string")),
    "UniqValueCount": lambda v: F.count_distinct(v),
}


def register(name: str, aggregate: Callable[[Column], Column]) -> None:
    """A user's own aggregate type. It casts its values itself: a mapper's rows hold them as text."""
    TYPES[name] = aggregate


def uniq_count(value: Column, cap: int | None = None) -> Column:
    """Distinct values; with a cap, at most one more than it."""
    n = F.count_distinct(value)
    return n if cap is None else F.least(n, F.lit(cap + 1).cast("bigint"))


def named(df: DataFrame, specs: list[tuple[str, str, Column]] | None = None) -> DataFrame:
    """(type, id, value) for each spec (type, id, column), all in one pass; without specs, the number of records."""
    specs = specs or [("LongValueSum", "record_count", F.lit(1))]
    one = df.agg(*(TYPES[t](c).cast("string").alias(f"a{i}") for i, (t, _, c) in enumerate(specs)))
    rows = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(n).alias("id"), F.col(f"a{i}").alias("value")) for i, (t, n, _) in enumerate(specs)))
    return one.select(F.inline(rows))


def keyed(df: DataFrame, kind: str = "type", key: str = "id", value: str = "value") -> DataFrame:
    """Rows (type, id, value: string) that a mapper has made, to one row for each type and id, in one pass over the rows.

    Each row's aggregate is that of its type; a type that is not registered is an error.
    """
    own = lambda t: F.when(F.col(kind) == t, F.col(value))
    out = df.groupBy(kind, key).agg(*(TYPES[t](own(t)).cast("string").alias(f"_a{i}") for i, t in enumerate(TYPES)))
    picked = F.coalesce(*(F.when(F.col(kind) == t, F.struct(F.col(f"_a{i}").alias("v"))) for i, t in enumerate(TYPES)), F.raise_error(F.concat(F.lit("no aggregate type "), F.coalesce(kind, F.lit("null")))).cast("struct<v: string>"))
    return out.select(kind, key, picked["v"].alias("value"))


def value_counts(df: DataFrame, value: str = "value", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """How often each value occurs: the histogram's details."""
    n = F.count("*") if weight is None else F.sum(F.col(weight).cast("bigint"))
    return df.groupBy(*(by or []), value).agg(n.alias("n"))


def histogram(df: DataFrame, value: str = "value", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Of the values' counts: how many, least, upper median, largest, mean and population standard deviation.

    Counts of counts are formed first, so the median comes from a short list whatever the number of values.
    """
    by = by or []
    counts = value_counts(df, value, by, weight).groupBy(*by, "n").agg(F.count("*").alias("m"))
    pairs = F.array_sort(F.collect_list(F.struct("n", "m")))
    out = counts.groupBy(*by).agg(F.sum("m").alias("n_values"), F.min("n").alias("least"), F.max("n").alias("largest"), F.sum(F.col("n") * F.col("m")).alias("total"), pairs.alias("pairs"))
    # Walk the sorted counts up to the half of their number.
    walked = F.aggregate("pairs", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("at")), lambda s, p: F.struct((s["seen"] + p["m"]).alias("seen"), F.when(s["at"].isNull() & (s["seen"] + p["m"] > F.floor(F.col("n_values") / 2)), p["n"]).otherwise(s["at"]).alias("at")))
    mean = F.col("total") / F.col("n_values")
    # Deviations from the mean are squared, not the counts, which would cancel where these are large.
    spread = F.aggregate("pairs", F.lit(0.0), lambda s, p: s + p["m"] * (p["n"] - F.col("mean")) * (p["n"] - F.col("mean")))
    out = out.withColumn("mean", mean)
    return out.select(*by, "n_values", "least", walked["at"].alias("median"), "largest", "mean", F.sqrt(spread / F.col("n_values")).alias("stddev"))


def record_count(df: DataFrame, text: str | None = None) -> DataFrame:
    """All rows, or those whose text is not empty."""
    return (df if text is None else df.where(F.length(text) > 0)).agg(F.count("*").alias("n"))


def estimated_count(lines: DataFrame, total_bytes: int, text: str = "value", fraction: float = 0.01, seed: int = 1) -> DataFrame:
    """Lines in so many bytes, from the mean length of a sample: ``estimate``, and ``low`` and ``high`` at two standard errors."""
    size = F.octet_length(text) + 1
    s = lines.sample(fraction, seed).agg(F.avg(size).alias("m"), F.coalesce(F.stddev_pop(size), F.lit(0.0)).alias("d"), F.count("*").alias("k"))
    error = 2 * F.col("d") / F.sqrt(F.col("k"))
    return s.select((total_bytes / F.col("m")).alias("estimate"), (total_bytes / (F.col("m") + error)).alias("low"), (total_bytes / F.greatest(F.lit(1.0), F.col("m") - error)).alias("high"))

"""Samples, split points and shuffles; all seeded, so a task that is run again gives the same rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sorting import numbered


def by_ratio(df: DataFrame, ratio: float, seed: int = 1) -> DataFrame:
    return df.sample(ratio, seed)


def by_count(df: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n rows, by a seeded hash of the whole row; each task keeps n rows."""
    return df.orderBy(F.xxhash64(*df.columns, F.lit(seed)), *df.columns).limit(n)


def by_bytes(df: DataFrame, size: int, text: str = "value", seed: int = 1) -> DataFrame:
    """About so many bytes of lines, from the mean length of all."""
    r = df.agg(F.avg(F.octet_length(text) + 1)).first()[0]
    return by_count(df, int(size // r) if r else 0, seed)


def shuffled(df: DataFrame, seed: int = 1) -> DataFrame:
    """All rows in a random order."""
    return df.orderBy(F.rand(seed))


def every(df: DataFrame, step: int, order: str) -> DataFrame:
    """The first of every ``step`` rows in the order of a dense integer column."""
    return df.where(F.pmod(F.col(order), F.lit(step)) == 0)


def by_digest(df: DataFrame, key: str | Column, step: int) -> DataFrame:
    """Rows whose key's MD5 (its first fifteen hexadecimal digits, as a number) divides by ``step``; equal keys stay or go together."""
    key = key if isinstance(key, Column) else F.col(key)
    return df.where(F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(step)) == 0)


def matching(df: DataFrame, key: str, pattern: str) -> DataFrame:
    return df.where(F.col(key).rlike(pattern))


def first_of_each(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of every partition."""
    def run(batches):
        left = n
        for batch in batches:
            if left <= 0:
                return
            yield batch.slice(0, left)
            left -= batch.num_rows

    return df.mapInArrow(run, df.schema)


def interval_of_each(df: DataFrame, share: float) -> DataFrame:
    """Rows of every partition at even steps: one is kept while fewer than ``share`` of the rows up to it are."""
    def run(batches):
        done = 0
        for batch in batches:
            n = np.arange(done + 1, done + batch.num_rows + 1)
            yield batch.filter(pa.array(np.ceil(share * n) > np.ceil(share * (n - 1))))
            done += batch.num_rows

    return df.mapInArrow(run, df.schema)


#: Keys that split points are taken from on the driver, at most.
MAX_KEYS = 1_000_000


def split_points(sample: DataFrame, key: str, partitions: int) -> list:
    """Distinct keys that cut the sample in ``partitions`` ranges of like weight: those at the shares 1/partitions, 2/partitions, ... of it.

    A key that holds several shares is given once, as no split can divide it. Up to MAX_KEYS keys are cut on the driver;
    more are sorted and numbered by ranges, so that the same points come from all of them.
    """
    held = sample.select(key).where(F.col(key).isNotNull())
    n = held.count()
    shares = np.unique(np.arange(1, partitions) * n // partitions).tolist() if n else []
    if n > MAX_KEYS:
        placed = numbered(held, key, name="_gridmill_place").where(F.col("_gridmill_place").isin([p + 1 for p in shares]))
        return sorted({r[0] for r in placed.collect()})
    weights = sorted(map(tuple, held.groupBy(key).agg(F.count("*").alias("weight")).collect()), key=lambda r: r[0])
    upto = np.cumsum([w for _, w in weights])
    return [weights[i][0] for i in np.unique(np.searchsorted(upto, shares, side="right")).tolist()]

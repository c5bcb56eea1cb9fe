"""Bloom filters over a column: plain, counting (keys can be removed) and dynamic (a row of filters that grows with the keys)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest filter that is built and sent to tasks; beyond it false hits grow, and nothing else changes.
MAX_BYTES = 64 << 20
#: Places that come to the driver as one row of bytes.
BLOCK = 1 << 14


class Filter:
    """Counts at hashed places; a key may be held where all of its places are set."""

    def __init__(self, places: int, hashes: int, parts: int = 1):
        self.places, self.hashes = places, hashes
        self.counts = np.zeros((parts, places), np.uint8)

    def at(self, h: np.ndarray) -> np.ndarray:
        h = h.astype(np.uint64)
        low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        return ((low[:, None] + np.arange(self.hashes, dtype=np.uint64) * high[:, None]) % np.uint64(self.places)).astype(np.int64)

    def part(self, h: np.ndarray) -> np.ndarray:
        """The filter of the row that a key goes to."""
        return ((h.astype(np.uint64) >> np.uint64(7)) % np.uint64(len(self.counts))).astype(np.int64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        return (self.counts[self.part(h)[:, None], self.at(h)] > 0).all(axis=1)

    def may_hold(self, df: DataFrame, key: str) -> DataFrame:
        """Rows whose key may be held; none that is held is missing."""
        kept = df.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(kept.value.holds(batch.column("_h").to_numpy(zero_copy_only=False))))

        hashed = df.withColumn("_h", F.xxhash64(key))
        return hashed.mapInArrow(run, hashed.schema).drop("_h")

    def remove(self, keys: list[int]) -> None:
        """Take keys out of a counting filter; each must have been put in. Counts that have reached 255 stay."""
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        h = np.array([r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(F.xxhash64("k")).collect()])
        for row in self.at(h):
            for i in set(row.tolist()):
                if 0 < self.counts[0, i] < 255:
                    self.counts[0, i] -= 1


def _filled(df: DataFrame, key: str, places: int, hashes: int, parts: int = 1) -> Filter:
    """Places are counted on the executors; what comes back is bounded by the filter's size."""
    out = Filter(places, hashes, parts)

    def run(batches):
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            part = out.part(h)
            at = out.at(h)
            # A key counts once at each of its places.
            first = np.ones(at.shape, bool)
            for k in range(1, hashes):
                first[:, k] = (at[:, :k] != at[:, k : k + 1]).all(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, hashes)[first.ravel()]), pa.array(at.ravel()[first.ravel()])], ["part", "place"])

    def packed(table: pa.Table) -> pa.Table:
        block = np.zeros(BLOCK, np.uint8)
        block[table.column("place").to_numpy() % BLOCK] = table.column("n").to_numpy()
        return pa.table({"part": table.column("part")[:1], "block": table.column("block")[:1], "counts": pa.array([block.tobytes()], pa.binary())})

    keys = df.select(F.xxhash64(key).alias("h")).distinct()
    counts = keys.mapInArrow(run, "part long, place long").groupBy("part", "place").agg(F.least(F.count("*"), F.lit(255)).alias("n"))
    blocks = counts.withColumn("block", F.floor(F.col("place") / BLOCK)).groupBy("part", "block").applyInArrow(packed, "part long, block long, counts binary")
    for part, block, data in zip(*(c.to_pylist() for c in blocks.toArrow().columns), strict=True):
        row = out.counts[part, block * BLOCK : (block + 1) * BLOCK]
        row[:] = np.frombuffer(data, np.uint8)[: len(row)]
    return out


def _size(keys: int, rate: float) -> tuple[int, int]:
    places = max(64, min(MAX_BYTES, math.ceil(-keys * math.log(rate) / math.log(2) ** 2)))
    return places, max(1, min(16, round(places / max(1, keys) * math.log(2))))


def plain(df: DataFrame, key: str, keys: int, rate: float = 0.01) -> Filter:
    out = _filled(df, key, *_size(keys, rate))
    out.counts = np.minimum(out.counts, 1)
    return out


def counting(df: DataFrame, key: str, keys: int, rate: float = 0.01) -> Filter:
    return _filled(df, key, *_size(keys, rate))


def dynamic(df: DataFrame, key: str, keys: int, rate: float = 0.01, per_filter: int = 100_000) -> Filter:
    """As many filters as the keys need at ``per_filter`` keys each."""
    parts = max(1, math.ceil(keys / per_filter))
    places, hashes = _size(min(keys, per_filter), rate / parts)
    return _filled(df, key, min(places, MAX_BYTES // parts), hashes, parts)


def retouch(f: Filter, unwanted: np.ndarray) -> Filter:
    """Clear, for each unwanted hash that is held, its place with the least count: fewer false hits, at the price of some misses."""
    for row in f.at(unwanted):
        for counts in f.counts:
            if counts[row].all():
                counts[row[counts[row].argmin()]] = 0
    return f

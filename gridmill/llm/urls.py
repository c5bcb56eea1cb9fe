"""URL filtering by a blocked Bloom filter and an exact join (operator 10).

Listed entries are canonical URLs: a host and a path prefix, each to be allowed or blocked. An entry fits its host and all
subdomains, if the URL's path starts with the entry's; the longest entry that fits decides, and a URL that none fits gets
the default verdict. A URL's candidates (each suffix of its host at a dot, with each prefix of its path that has the
length of a listed path) are tried against a Bloom filter whose bits for one entry all lie in one 256-bit block; possible
hits go on to an exact hash join with the list, which removes false positives. Each distinct URL is judged once.

The filter is broadcast up to ``FILTER_BYTES``; a longer list gets the largest allowed filter, which lets more false
positives through to the join but changes no result. The list itself is joined, never collected.

Edge cases: a null URL or one without "://" has an empty host and path and gets the default verdict; repeated pages each
give a row; other columns are not read; with an empty list every URL gets the default; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, randoms

#: The rules of the query, as (entry, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FILTER_BYTES = 16 << 20
#: Bits set for each entry, one in each 32-bit word of its block.
WORDS = 8
_salt = randoms(WORDS, 41) | np.uint64(1)


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _positions(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and its bit in each of the block's words."""
    h = mix(hashes.astype(np.uint64))
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bits = (np.multiply.outer(h & np.uint64(0xFFFFFFFF), _salt) >> np.uint64(27)) & np.uint64(31)
    return block.astype(np.int64), bits.astype(np.uint32)


def build_filter(listed: DataFrame, bits_each: int = 16) -> np.ndarray:
    """A blocked Bloom filter (blocks x WORDS unsigned 32-bit words) of the column ``entry``, built on the executors.

    Each task gives the blocks that it has set, combined per block before they come together; their size is bounded by
    FILTER_BYTES, not by the list.
    """
    n = listed.count()
    blocks = max(1, min(FILTER_BYTES // (4 * WORDS), -(-n * bits_each // (32 * WORDS))))

    def run(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            block, bits = _positions(batch.column("h").to_numpy(zero_copy_only=False), blocks)
            for b, row in zip(block.tolist(), np.uint32(1) << bits, strict=True):
                own[b] = own[b] | row if b in own else row
        if own:
            words = np.array(list(own.values()), np.uint32).reshape(-1, WORDS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), *(pa.array(words[:, k]) for k in range(WORDS))], ["block", *(f"w{k}" for k in range(WORDS))])

    set_ = listed.select(F.xxhash64("entry").alias("h")).mapInArrow(run, "block long, " + ", ".join(f"w{k} long" for k in range(WORDS)))
    merged = set_.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)))
    out = np.zeros((blocks, WORDS), np.uint32)
    for batch in [merged.toArrow()]:
        at = batch.column("block").to_numpy()
        for k in range(WORDS):
            out[at, k] = batch.column(f"w{k}").to_numpy().astype(np.uint32)
    return out


def _may_hold(kept):
    def run(batches):
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            block, bits = _positions(h, len(kept.value))
            hit = ((kept.value[block] >> bits) & np.uint32(1)).all(axis=1)
            if hit.any():
                yield batch.filter(pa.array(hit))

    return run


def judge(pages: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Each page's ``key``, ``host``, ``path``, ``rule`` (the entry that decides, else null) and ``verdict``.

    ``listed``: rows of entry (host, then path from its first slash) and verdict; an entry listed twice counts with the
    least verdict in alphabetical order.
    """
    spark = pages.sparkSession
    listed = listed.where(F.col("entry").isNotNull()).groupBy("entry").agg(F.min("verdict").alias("verdict"))
    lengths = [r[0] for r in listed.select(F.expr("length(entry) - length(substring_index(entry, '/', 1))").alias("n")).distinct().collect()]
    read = pages.select(F.col(key).alias("key"), F.col(url).alias("u"))
    urls = read.select("u").where("u is not null").distinct().withColumns({"host": host_of(F.col("u")), "path": path_of(F.col("u"))}).where("host <> ''")
    kept = spark.sparkContext.broadcast(build_filter(listed))
    # Each suffix of the host at a dot, with each listed length of path that the URL's path has.
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.transform(F.filter(F.array(*(F.lit(n) for n in sorted(lengths))).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    tried = urls.select("u", F.explode(suffixes).alias("s"), heads.alias("heads")).select("u", "s", F.explode("heads").alias("head")).select("u", F.concat("s", "head").alias("entry"))
    possible = tried.withColumn("h", F.xxhash64("entry")).mapInArrow(_may_hold(kept), "u string, entry string, h long")
    found = possible.join(listed, "entry").groupBy("u").agg(F.max_by(F.struct("entry", "verdict"), F.length("entry")).alias("best"))
    # Written first: a small table is then broadcast by its known size, and beside a large one a hot URL's pages can be split,
    # which adaptive execution can't do next to an aggregate.
    out = read.join(cut(found, "urls"), "u", "left")
    return out.select(F.col("key").alias(key), host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), F.col("best.entry").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op10_urls(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(list(RULES), "entry string, verdict string"))


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
rules(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
judged AS (
  SELECT page_id, host, path,
    (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule
  FROM parts)
SELECT page_id, host, path, rule, coalesce((SELECT verdict FROM rules WHERE h || p = rule), 'allow') AS verdict FROM judged
"""

"""A sharded inverted index of documents, with inserts, deletes and updates."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text whose postings are made at once, in whole documents.
BLOCK_BYTES = 16 << 20
#: Rows of a batch that goes back to Spark.
BATCH_ROWS = 200_000
#: Documents deleted by one update that are sent to all executors; beyond them, index and deletions are dealt by key.
GONE_MOST = 4_000_000
#: Files that a task holds open; further shards are sorted first.
OPEN_FILES = 16


def _split(texts: pa.Array) -> pa.Array:
    """Words between spaces, tabs, line ends and form feeds, as ``functions.text.tokens``, and empty ones at the ends."""
    # The plain way cuts at vertical tabs too, which are parts of words here.
    if pc.any(pc.match_substring(texts, "\x0b")).as_py():
        return pc.split_pattern_regex(texts, r"[ \t\n\r\f]+")
    return pc.ascii_split_whitespace(texts)


def _counted(texts: pa.Array, place: np.ndarray, group: np.ndarray | None = None):
    """The terms; and for each used group, term (by its number) and place of a document, sorted by these: them and the number of uses."""
    lists = _split(pc.fill_null(texts, ""))
    sizes, words = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
    whole = pc.not_equal(pc.binary_length(words), 0)
    words = words.filter(whole).dictionary_encode()
    terms = words.dictionary.take(order := pc.array_sort_indices(words.dictionary))
    rank = np.empty(len(terms), np.int64)
    rank[order.to_numpy()] = np.arange(len(terms))
    code = rank[words.indices.to_numpy()]
    whole = whole.to_numpy(zero_copy_only=False)
    if group is not None:
        code += np.repeat(group, sizes)[whole] * len(terms)
    code *= len(place)
    code += np.repeat(place, sizes)[whole]
    code.sort()
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    n, code = np.diff(starts, append=len(code)), code[starts]
    code, place = np.divmod(code, len(place))
    group, rank = np.divmod(code, max(1, len(terms)))
    return terms, group, rank, place, n


def _blocks(batches):
    """The columns of whole documents, as many as BLOCK_BYTES of their last column hold, one at least."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes + 64, dtype=np.int64), 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + BLOCK_BYTES - size, side="right")))
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1]) - done
            at = stop
            if at < batch.num_rows or size >= BLOCK_BYTES:
                yield [pa.concat_arrays(c) for c in zip(*(b.columns for b in held), strict=True)]
                held, size = [], 0
    if held:
        yield [pa.concat_arrays(c) for c in zip(*(b.columns for b in held), strict=True)]


def _batches(names: list[str], size: int, columns):
    """Record batches of at most BATCH_ROWS of the ``size`` rows; ``columns`` gives those of a range."""
    for at in range(0, size, BATCH_ROWS):
        yield pa.RecordBatch.from_arrays(columns(slice(at, at + BATCH_ROWS)), names)


def _posted(key: str):
    """key, shard, text to term, key, n, shard: by shard and term within a block."""
    def posted(batches):
        for keys, shards, texts in _blocks(batches):
            terms, group, rank, place, n = _counted(texts, np.arange(len(keys)), shards.to_numpy().astype(np.int64))
            yield from _batches(["term", key, "n", "shard"], len(n), lambda s: [terms.take(pa.array(rank[s])), keys.take(pa.array(place[s])), pa.array(n[s], pa.int64()), pa.array(group[s], pa.int32())])

    return posted


def _summed(batches):
    """key, text to a block's sums for each term: term, n_docs, n_uses, first_doc."""
    for keys, texts in _blocks(batches):
        order = pc.array_sort_indices(keys)  # nulls come last
        place = np.empty(len(keys), np.int64)
        place[order.to_numpy()] = np.arange(len(keys))
        terms, _, rank, place, n = _counted(texts, place)
        starts = np.flatnonzero(np.diff(rank, prepend=-1))
        docs, uses = np.diff(starts, append=len(rank)), np.add.reduceat(n, starts) if len(n) else n
        first, rank = keys.take(order.take(pa.array(place[starts]))), rank[starts]
        yield from _batches(["term", "n_docs", "n_uses", "first_doc"], len(rank), lambda s: [terms.take(pa.array(rank[s])), pa.array(docs[s], pa.int64()), pa.array(uses[s], pa.int64()), first[s]])


def _repeated(docs: DataFrame, key: str) -> bool:
    """Whether some key has several rows."""
    return bool(docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").take(1))


def _rows(docs: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """term, key, n, shard of each row of ``docs`` by itself, without a shuffle."""
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField(key, docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("shard", T.IntegerType())])
    return docs.select(key, shard_of(key, shards).alias("shard"), text).mapInArrow(_posted(key), schema)


def _postings(docs: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    rows = _rows(docs, key, text, shards)
    return rows.groupBy("term", key, "shard").agg(F.sum("n").alias("n")).select(rows.columns) if _repeated(docs, key) else rows


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, n): how often each document uses each term. Only where keys have several rows is anything shuffled, to sum them."""
    return _postings(docs, key, text, 1).drop("shard")


def summary(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, n_docs, n_uses, first_doc) over all postings: the documents that use a term, its uses, the smallest key. Blocks of documents are summed before the shuffle by term."""
    if _repeated(docs, key):
        return postings(docs, key, text).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_uses"), F.min(key).alias("first_doc"))
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_uses", T.LongType()), T.StructField("first_doc", docs.schema[key].dataType)])
    blocks = docs.select(key, text).mapInArrow(_summed, schema)
    return blocks.groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_uses").alias("n_uses"), F.min("first_doc").alias("first_doc"))


def shard_of(key: str, shards: int):
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


@contextmanager
def _open_files(spark: SparkSession, n: int):
    """While this lasts, a task that writes to folders keeps up to ``n`` files open instead of sorting its rows by folder."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def build(docs: DataFrame, path: str, key: str, text: str, shards: int = 8) -> None:
    """Postings by shard of the document, in runs sorted by term (one for each block of documents), and the documents' shards. Nothing is shuffled unless keys repeat."""
    rows = _postings(docs, key, text, shards)
    with _open_files(docs.sparkSession, min(shards, OPEN_FILES) + 1):  # the last of this number begins the sort
        rows.write.option("parquet.block.size", 16 << 20).partitionBy("shard").parquet(path)


def update(index: DataFrame, changes: DataFrame, key: str, text: str, shards: int = 8) -> DataFrame:
    """The index's postings after ``changes`` (key, text, op: insert, delete or update): old postings of named documents go, new ones come."""
    gone = changes.where(F.col("op").isin("delete", "update")).select(key).distinct()
    if gone.count() <= GONE_MOST:
        gone = F.broadcast(gone)
    new = _postings(changes.where(F.col("op").isin("insert", "update")), key, text, shards)
    return index.join(gone, key, "left_anti").select(new.columns).unionByName(new)


def search(index: DataFrame, terms: list[str], key: str) -> DataFrame:
    """Documents that hold all the terms, and their uses."""
    hits = index.where(F.col("term").isin(terms)).groupBy(key).agg(F.count_distinct("term").alias("found"), F.sum("n").alias("n_uses"))
    return hits.where(F.col("found") == len(set(terms))).drop("found")

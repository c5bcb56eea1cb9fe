"""Helpers shared by the training-data operators: Arrow batches, scratch tables, vectorised hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step in a Python worker takes at once.
SLICE_BYTES = 1 << 20
#: The setting that bounds Arrow batches to Python workers.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_own: dict[str, str] = {}
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all nodes share: spark.checkpoint.dir. Where it is unset, a local one of our own, in local mode only (tests); elsewhere an error."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="gridmill-")
    return _own[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/gridmill/{name}-{uuid.uuid4().hex}"
    _tables.append((spark, path))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which ends its lineage there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete tables made by :func:`cut` that no later step reads."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            _delete(df.sparkSession, file.rpartition("/")[0])


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _delete_scratch() -> None:
    for spark, path in _tables:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended
            return


def slices(batches, column: str, limit: int = SLICE_BYTES):
    """Pieces of the record batches with at most ``limit`` bytes in ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
        del batch
    trim()


@contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20):
    """While this lasts, Arrow batches to Python workers hold about ``size`` bytes at most, which bounds the buffers on both sides. For work that is done at once: a lazy result reads the setting when it is asked for."""
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


def trim() -> None:
    """Give memory that a worker's libraries hold without use back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


_cache: dict = {}


def once(kind, path: str):
    """``kind(path)``, kept by this process until :func:`forget`."""
    if (kind, path) not in _cache:
        _cache[kind, path] = kind(path)
    return _cache[kind, path]


def forget() -> None:
    """Drop what :func:`once` keeps (a worker's tokenizers are large) and give free memory back to the system."""
    if _cache:
        _cache.clear()
        gc.collect()
        trim()


def utf8(column: pa.Array) -> list[bytes]:
    """The strings as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random unsigned 64-bit integers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = randoms(256, 1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Powers that are kept between calls; longer rows of them are made anew.
_KEPT = 1 << 21
_kept: dict[int, np.ndarray] = {}


def _power_row(base: np.uint64, n: int) -> np.ndarray:
    held = _kept.get(int(base))
    if held is not None and len(held) >= n:
        return held[:n]
    p = np.full(max(n, 1) if n > _KEPT else min(_KEPT, max(1 << 16, 2 * n)), base, np.uint64)
    p[0] = 1
    np.multiply.accumulate(p, out=p)
    if len(p) <= _KEPT:
        _kept[int(base)] = p
    return p[:n]


def powers(n: int) -> np.ndarray:
    """Powers of an odd base modulo 2**64."""
    return _power_row(_BASE, n)


def inverses(n: int) -> np.ndarray:
    """Powers of the base's inverse."""
    return _power_row(_INVERSE, n)


#: ASCII white space: space, and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space in all texts.

    Returns the bytes of all texts (each followed by a space), the first byte and end of each word, its 64-bit hash,
    and the number of words in each text.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of_texts = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if len(ends) < len(starts):  # not reached: the last byte is a space
        ends = np.append(ends, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverses(len(data))[starts] + (ends - starts).astype(np.uint64)
    counts = np.diff(np.searchsorted(starts, ends_of_texts), prepend=0)
    return data, starts, ends, mix(hashes), counts

"""Token files: ids compressed document by document under one shared dictionary (operator 3).

A shard holds documents in ascending key order::

    magic "GMTOK1\\0\\0" | n documents (u64) | n frames' bytes (u64) | 32 bytes SHA-256 of the dictionary
    keys (i64 x n) | token counts (u64 x n) | frame offsets (u64 x n+1) | frames

Each frame is one document's ids, zstandard-compressed by itself with the dictionary, so one short document is read with
two small reads: its index entry, then its frame. The dictionary is trained on a bounded sample of serialized id arrays.

Edge cases: null text is empty (only the end id); rows with a null key come first, as one more document each (their key is
written as the smallest integer and read back as null); equal keys stay side by side, ordered by a hash of the text, so
that a frequent key is dealt over many ranges; a key that is no integer is read as null; other columns are not read; an
empty table gives no shard.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import struct
import uuid
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import _byte_letters, _odd, default_tokenizer, library, split_pattern
from .common import cut, forget, scratch_path, slices
from .common import once as _once

MAGIC = b"GMTOK1\0\0"
NO_KEY = -(1 << 63)
#: The dictionary's sample and size: so many documents, characters of each, and bytes, whatever the corpus. Only training uses the sample.
DICTIONARY_DOCS, DICTIONARY_CHARS, DICTIONARY_BYTES = 2000, 20_000, 64 << 10
#: Bytes of frames that are unpacked at once, ranges of keys whose shards one task numbers, and tasks that shards are read by.
READ_BYTES, RANGES_EACH, READ_TASKS = 1 << 18, 4096, 100_000


class FastEncoder:
    """Ids as the tokenizers library gives them. Texts of characters that all splitters treat alike take a quicker library with the same merges."""

    def __init__(self, path: str):
        import tiktoken

        self.library = library(path)
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.whole = re.compile("|".join([f"(?:{_odd.pattern})", *map(re.escape, special)]))
        byte_of = {c: b for b, c in _byte_letters().items()}
        vocabulary = json.loads(Path(path).read_text())["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
        self.quick = tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.whole.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.quick.encode_ordinary(text), np.uint32)


def _open(path: str):
    """The file system and the path in it; any store that pyarrow or Spark's shared mounts reach."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from serialized id arrays; a plain prefix of them where there are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"\0" * 8


def _write(tokenizer: str, end_id: int, folder: str, dictionary: bytes, shard_bytes: int):
    def run(batches):
        encoder, system = _once(FastEncoder, tokenizer), _open(folder)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        tag = np.array([end_id], np.uint32)
        keys, counts, frames, size, place, own_range = [], [], [], 0, 0, TaskContext.get().partitionId()

        def flush():
            name = f"{uuid.uuid4().hex}.tok"  # an attempt that is run again writes another file; only the manifest's files count
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype(np.uint64)
            head = MAGIC + struct.pack("<QQ", len(frames), int(offsets[-1])) + hashlib.sha256(dictionary).digest()
            system[0].create_dir(system[1], recursive=True)
            with system[0].open_output_stream(f"{system[1]}/{name}") as out:
                for part in (head, np.array(keys, np.int64).tobytes(), np.array(counts, np.uint64).tobytes(), offsets.tobytes(), b"".join(frames)):
                    out.write(part)
            return pa.RecordBatch.from_pydict({"range": pa.array([own_range], pa.int64()), "place": pa.array([place], pa.int64()), "file": [name], "first_key": pa.array([keys[0]], pa.int64()), "n_docs": pa.array([len(keys)], pa.int64()), "n_tokens": pa.array([sum(counts)], pa.int64())})

        for batch in slices(batches, "text"):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.concatenate((encoder(text or ""), tag))
                keys.append(NO_KEY if key is None else key)
                counts.append(len(ids))
                frames.append(packer.compress(ids.astype("<u4").tobytes()))
                size += len(frames[-1])
                if size >= shard_bytes:
                    yield flush()
                    keys, counts, frames, size, place = [], [], [], 0, place + 1
        if keys:
            yield flush()

    return run


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2, shard_bytes: int = 8 << 20, task_bytes: int = 16 << 20) -> DataFrame:
    """Write every document's ids and the end id under ``folder``; returns the manifest: ``file``, ``shard``, ``first_key``, ``n_docs``, ``n_tokens``, ``start``.

    The manifest has a row for each shard, not for each document, and is written to ``folder``/manifest as Parquet. The
    only shuffle of texts puts whole documents into ranges of the key. Shards are numbered in the order of the ranges and,
    in a range, of their writing: by tasks that take RANGES_EACH ranges each, of which only the sums come to the driver (a
    few thousand rows for a hundred terabytes).
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    read = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    n, size = read.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # Picked by hash, so each task sends its share of the sample only, and the dictionary is the same in each run.
    picked = F.pmod(F.xxhash64("key", "text"), F.lit(max(1, n // DICTIONARY_DOCS))) == 0
    sample = read.where((F.length("text") > 0) & picked).select(F.xxhash64("key", "text").alias("h"), F.substring("text", 1, DICTIONARY_CHARS).alias("text"))
    encoder = _once(FastEncoder, tokenizer)
    dictionary = train_dictionary([encoder(r.text).tobytes() for r in sample.orderBy("h", "text").limit(2 * DICTIONARY_DOCS).collect()])
    _put(folder, "dictionary.json", json.dumps({"sha256": hashlib.sha256(dictionary).hexdigest(), "end_id": end_id, "zstd": base64.b64encode(dictionary).decode()}))
    ranged = read.withColumn("h", F.xxhash64("text")).repartitionByRange(max(1, math.ceil(size / task_bytes)), "key", "h").sortWithinPartitions("key", "h", "text").select("key", "text")
    shards = cut(ranged.mapInArrow(_write(tokenizer, end_id, folder, dictionary, shard_bytes), "range long, place long, file string, first_key long, n_docs long, n_tokens long"), "shards")
    shards = shards.withColumn("block", F.floor(F.col("range") / RANGES_EACH))
    shard = tokens = 0
    before = [(-1, 0, 0)]
    for block, s, t in sorted(map(tuple, shards.groupBy("block").agg(F.count("*"), F.sum("n_tokens")).collect())):
        before.append((block, shard, tokens))
        shard, tokens = shard + s, tokens + t
    so_far = Window.partitionBy("block").orderBy("range", "place").rowsBetween(Window.unboundedPreceding, -1)
    own = shards.withColumns({"shard": F.count("*").over(so_far), "start": F.coalesce(F.sum("n_tokens").over(so_far), F.lit(0))})
    own = own.join(spark.createDataFrame(before, "block long, shards_before long, tokens_before long"), "block")
    own = own.select("file", (F.col("shard") + F.col("shards_before")).alias("shard"), "first_key", "n_docs", "n_tokens", (F.col("start") + F.col("tokens_before")).alias("start"))
    own.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(own.schema).parquet(f"{folder}/manifest")


def _put(folder: str, name: str, content: str) -> None:
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(content.encode())


def read_dictionary(folder: str) -> bytes:
    system, path = _open(folder)
    with system.open_input_stream(f"{path}/dictionary.json") as f:
        meta = json.loads(f.read())
    raw = base64.b64decode(meta["zstd"])
    if hashlib.sha256(raw).hexdigest() != meta["sha256"]:
        raise ValueError("the dictionary is not the one that the token files were written with")
    return raw


def _head(f, dictionary: bytes) -> tuple[int, int]:
    head = f.read(56)
    n, _ = struct.unpack("<QQ", head[8:24])
    if head[:8] != MAGIC or head[24:] != hashlib.sha256(dictionary).digest():
        raise ValueError("not a token file, or written with another dictionary")
    return n, 56


def read_document(folder: str, file: str, position: int, dictionary: bytes) -> np.ndarray:
    """One document's ids by its position in a shard, without reading the others."""
    system, path = _open(folder)
    with system.open_input_file(f"{path}/{file}") as f:
        n, base = _head(f, dictionary)
        f.seek(base + 16 * n + 8 * position)
        i, j = struct.unpack("<QQ", f.read(16))
        f.seek(base + 24 * n + 8 + i)
        frame = f.read(j - i)
    raw = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(frame)
    return np.frombuffer(raw, "<u4")


def _read(folder: str, dictionary: bytes, names: list[str]):
    """Shards (file, start) to rows of documents with the columns ``names``; holds a shard's index and READ_BYTES of its frames, one frame at least."""

    def run(batches):
        forget()  # this worker may have written the shards; their encoders are large
        system, path = _open(folder)
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(f"{path}/{r['file']}") as f:
                    n, _ = _head(f, dictionary)
                    keys = np.frombuffer(f.read(8 * n), np.int64)
                    counts = np.frombuffer(f.read(8 * n), np.uint64).astype(np.int64)
                    offsets = np.frombuffer(f.read(8 * n + 8), np.uint64).astype(np.int64)
                    starts, i = r["start"] + np.cumsum(counts) - counts, 0
                    while i < n:
                        # Frames pack some ids very well, so what they hold is bounded too.
                        j = min(int(np.searchsorted(offsets, offsets[i] + READ_BYTES, side="right")) - 1, int(np.searchsorted(starts, starts[i] + READ_BYTES, side="right")))
                        j = min(n, max(i + 1, j))
                        data = f.read(int(offsets[j] - offsets[i]))
                        ids, sums = [], []
                        for a, b in zip(offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i], strict=True):
                            raw = unpack.decompress(data[a:b])
                            sums.append(zlib.crc32(raw))
                            if "ids" in names:
                                ids.append(raw)
                        columns = {"key": pa.array(keys[i:j], mask=keys[i:j] == NO_KEY), "start": pa.array(starts[i:j]), "n_tokens": pa.array(counts[i:j]), "ids_crc32": pa.array(sums, pa.int64())}
                        if ids:
                            columns["ids"] = pa.array(ids, pa.binary())
                        yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)
                        i = j

    return run


_FIELDS = {"key": "long", "start": "long", "n_tokens": "long", "ids": "binary", "ids_crc32": "long"}


def read(manifest: DataFrame, folder: str, key: str = "doc_id", columns: tuple[str, ...] = ("start", "n_tokens", "ids", "ids_crc32")) -> DataFrame:
    """All documents of the shards: ``key``, and of ``columns``: ``start`` (ids before it), ``n_tokens``, ``ids``, ``ids_crc32``. Ids that aren't asked for don't leave the worker."""
    names = ["key", *columns]
    fields = ", ".join(f"{n} {_FIELDS[n]}" for n in names)
    parts = max(1, min(manifest.count(), READ_TASKS))
    out = manifest.select("file", "start").repartition(parts).mapInArrow(_read(folder, read_dictionary(folder), names), fields)
    return out.withColumnRenamed("key", key)


def op3_tokenfile(spark, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum as read back from the token files."""
    folder = scratch_path(spark, "tokens")
    manifest = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read(manifest, folder, columns=("start", "n_tokens", "ids_crc32"))

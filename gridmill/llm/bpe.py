"""BPE encoding and decoding through a table of distinct words (operator 2).

Documents are cut into chunks of a few MB. Each chunk is split into words and keeps, for each word of each document, the
word's position in the chunk's own list of distinct words. These lists, dealt by a hash of the word, meet in parts of the
distinct-word table; a part encodes each of its words once and sends the ids back to the chunks, which put them in order
by position. A frequent word thus reaches its part once for each chunk, never once for each occurrence. A part reads its
lists as a stream and holds only its distinct words, so there are MAX_PARTS at most, and a chunk sends so many rows at most.

The input's rows must come in the same order when lost tasks run again, as those of files do; write others (``common.cut``)
first. Each chunk has a stamp of its contents, which its words' ids bring back, so a chunk that was made anew in another
order is an error and never gives wrong ids.

Edge cases: null text is taken as empty and gives no ids; a null key, or one that is no integer, is null; repeated rows each
give a row; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import array
import math
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once as _once
from .common import slices, trim

#: Characters that the splitters of all Unicode versions treat alike; a text with others goes through the library whole.
ALIKE = r"\x00-\u0557\u2000-\u2060\u20a0-\u20bf\u3001-\u3020\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fef\uac00-\ud7a3\U0001f300-\U0001f64f"
#: Bytes of text in a chunk: longer chunks repeat fewer words, and take more memory.
CHUNK_BYTES = 4 << 20
#: Parts of the distinct-word table.
MAX_PARTS = 1024
_odd = re.compile(f"[^{ALIKE}]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def library(path: str):
    # Tasks run side by side already, and each thread of the library's own would hold memory.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTokenizer:
    """The tokenizer in two steps: texts to words as its own splitter cuts them, and single words to ids.

    Special tokens in a text are words of their own. A word is encoded without being split again.
    """

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        self.library = library(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.find = regex.compile(split_pattern()).findall
        self.split = self.library.pre_tokenizer.pre_tokenize_str
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.library.encode_special_tokens = True

    def words(self, text: str) -> list[str]:
        if self.at_special and self.at_special.search(text):
            return [w for piece in self.at_special.split(text) if piece for w in ([piece] if piece in self.special else self.plain(piece))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if _odd.search(text):
            return [text[i:j] for _, (i, j) in self.split(text)]
        return self.find(text)

    def ids(self, words: list[str]) -> list[bytes]:
        """Each word's ids as unsigned 32-bit integers."""
        out = []
        for i in range(0, len(words), 4000):
            part = words[i : i + 4000]
            for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                out.append(array.array("I", [self.special[w]] if w in self.special else e.ids).tobytes())
        return out


def _pack(*arrays: np.ndarray) -> bytes:
    raw = [a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(struct.pack(f"<{len(raw)}q", *map(len, raw)) + b"".join(raw))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = struct.unpack(f"<{len(kinds)}q", raw[: 8 * len(kinds)]), 8 * len(kinds), []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


_ROW = pa.schema([("dest", pa.int64()), ("chunk", pa.int64()), ("part", pa.int32()), ("blob", pa.binary())])
_ROW_SQL = "dest long, chunk long, part int, blob binary"


def _pack_codes(codes: np.ndarray) -> list[np.ndarray]:
    """Numbers, small ones being frequent, to bytes that compress well: one byte, two more from 240 on, four more where these don't do."""
    high, huge = (codes >= 240) & (codes < 15 << 16), codes >= 15 << 16
    low = np.where(high, 240 + (codes >> np.uint32(16)), codes)
    low[huge] = 255
    return [low.astype(np.uint8), codes[high].astype(np.uint16), codes[huge]]


def _unpack_codes(low: np.ndarray, rest: np.ndarray, huge: np.ndarray) -> np.ndarray:
    out = low.astype(np.uint32)
    high = (low >= 240) & (low < 255)
    out[high] = ((out[high] - 240) << np.uint32(16)) | rest
    out[low == 255] = huge
    return out


def _chunks(path: str, parts: int):
    """Documents to one row for each chunk (part -1) and one for each part that its distinct words fall in.

    The words' codes go by falling frequency, so they pack well; the part of each goes along, from which its place in the parts' lists follows.
    """

    def run(batches):
        tokenizer, count, first = _once(WordTokenizer, path), 0, TaskContext.get().partitionId() << 32

        def rows(chunk, keys, n_words, codes, words):
            codes = np.frombuffer(codes, np.uint32)
            freq = np.bincount(codes, minlength=len(words))
            by_rank = np.argsort(-freq, kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[by_rank] = np.arange(len(words), dtype=np.uint32)
            values = np.array([*words, ""], object)[:-1][by_rank]
            part = np.fromiter((zlib.crc32(w.encode()) % parts for w in values.tolist()), np.int32, len(values))
            order = np.argsort(part, kind="stable")
            head = [np.array([k is not None for k in keys], bool), np.array([k or 0 for k in keys], np.int64), np.array(n_words, np.int64)]
            packed = _pack_codes(rank[codes])
            stamp = blake2b(digest_size=8)
            for x in (*head, *packed):
                stamp.update(x.tobytes())
            for w in values.tolist():
                stamp.update(w.encode() + b"\0")
            stamp = np.frombuffer(stamp.digest(), np.int64)
            yield -1 - chunk, chunk, -1, _pack(stamp, *head, *packed, part.astype(np.uint32))
            part, values = part[order], values[order]
            edges = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            for i, j in zip(edges, [*edges[1:], len(part)][: len(edges)], strict=True):
                own = [w.encode() for w in values[i:j]]
                yield int(part[i]), chunk, int(part[i]), _pack(stamp, np.fromiter(map(len, own), np.uint32, j - i), np.frombuffer(b"".join(own), np.uint8))

        for batch in slices(batches, "text", CHUNK_BYTES):
            words: defaultdict = defaultdict()
            words.default_factory = words.__len__
            codes, n_words = array.array("I"), []
            for text in batch.column(1):
                split = tokenizer.words(text.as_py() or "")
                codes.extend(map(words.__getitem__, split))
                n_words.append(len(split))
            yield pa.RecordBatch.from_pylist([dict(zip(_ROW.names, r, strict=True)) for r in rows(first + count, batch.column(0).to_pylist(), n_words, codes, words)], _ROW)
            count += 1

    return run


def _encode_part(path: str):
    """The rows of one part of the distinct-word table: each distinct word is encoded once. The ids go to their chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, bytes] = {}
        for batch in batches:
            if not batch.num_rows or batch.column("part")[0].as_py() < 0:
                continue
            stamps, lists = [], []
            for blob in batch.column("blob").to_pylist():
                stamp, lengths, data = _unpack(blob, np.int64, np.uint32, np.uint8)
                ends, data = np.cumsum(lengths), data.tobytes()
                stamps.append(stamp)
                lists.append([data[e - n : e] for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)])
            new = list(dict.fromkeys(w for ws in lists for w in ws if w not in ids))
            ids.update(zip(new, _once(WordTokenizer, path).ids([w.decode() for w in new]), strict=True))
            blobs = []
            for stamp, ws in zip(stamps, lists, strict=True):
                got = [ids[w] for w in ws]
                blobs.append(_pack(stamp, np.fromiter(map(len, got), np.uint32, len(got)) // 4, np.frombuffer(b"".join(got), np.uint32)))
            chunks = batch.column("chunk").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(-1 - chunks), pa.array(chunks), batch.column("part"), pa.array(blobs, pa.binary())], schema=_ROW)

    return run


def _join_back(finish, empty: pa.Schema):
    """The ids of a chunk's distinct words and the chunk: ids of each document, by position, then ``finish``."""

    def run(ids_of_words: pa.Table, chunk: pa.Table) -> pa.Table:
        if not chunk.num_rows or chunk.column("part")[0].as_py() >= 0:
            return empty.empty_table()
        stamp, valid, keys, n_words, low, rest, huge, part = _unpack(chunk.column("blob")[0].as_py(), np.int64, bool, np.int64, np.int64, np.uint8, np.uint16, np.uint32, np.uint32)
        place = np.empty(len(part), np.int64)
        place[np.argsort(part, kind="stable")] = np.arange(len(part))
        codes = place[_unpack_codes(low, rest, huge)] if len(low) else np.zeros(0, np.int64)
        counts, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for r in sorted(ids_of_words.select(["part", "blob"]).to_pylist(), key=lambda r: r["part"]):
            own, a, b = _unpack(r["blob"], np.int64, np.uint32, np.uint32)
            if own[0] != stamp[0]:
                raise RuntimeError("a chunk was made anew from rows in another order: write the documents before they are encoded")
            counts.append(a)
            ids.append(b)
        counts, ids = np.concatenate(counts).astype(np.int64), np.concatenate(ids)
        starts, flat, ends, total = np.cumsum(counts) - counts, [ids[:0]], [np.zeros(1, np.int64)], 0
        for i in range(0, len(codes), 1 << 18):  # in pieces: the positions take eight bytes for each id
            own = codes[i : i + (1 << 18)]
            each = counts[own]
            stops = np.cumsum(each)
            flat.append(ids[np.arange(stops[-1]) + np.repeat(starts[own] - stops + each, each)])
            ends.append(stops + total)
            total += int(stops[-1])
        flat, ends = np.concatenate(flat), np.concatenate(ends)
        ends = ends[np.concatenate(([0], np.cumsum(n_words)))]
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer((4 * ends).astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())])
        table = pa.table({"key": pa.array(keys, mask=~valid), "n_tokens": np.diff(ends).astype(np.int64), "ids": out.cast(pa.binary())})
        table = finish(table) if finish else table
        trim()
        return table

    return run


_ENCODED = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, part_bytes: int = 4 << 20, finish=None, schema: pa.Schema = _ENCODED) -> DataFrame:
    """Encode every text; returns ``key``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers).

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library, on every node. ``key`` is an integer.
    ``finish`` may turn a chunk's table of key, n_tokens and ids into one of ``schema`` before it leaves the worker.

    The shuffle of chunks and their words is read twice: by the parts for the words, and by the join for the chunks.
    """
    path = tokenizer or default_tokenizer()
    read = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = read.mapInArrow(_chunks(path, min(MAX_PARTS, max(8, math.ceil(size / part_bytes)))), _ROW_SQL)
    ids = rows.groupBy("dest").applyInArrow(_encode_part(path), _ROW_SQL)
    fields = ", ".join(f"`{f.name}` {_SQL[f.type]}" for f in schema)
    out = ids.groupBy("dest").cogroup(rows.groupBy("dest")).applyInArrow(_join_back(finish, schema), fields)
    return out.withColumnRenamed("key", key)


_SQL = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}


class Pieces:
    """The id-to-piece table: as large as the vocabulary, whatever the corpus."""

    def __init__(self, path: str):
        own = library(path)
        byte_of = {c: b for b, c in _byte_letters().items()}
        special = {t.content for t in own.get_added_tokens_decoder().values()}
        pieces: list[bytes] = [b""] * own.get_vocab_size()
        for piece, i in own.get_vocab().items():
            known = all(c in byte_of for c in piece)
            pieces[i] = bytes(byte_of[c] for c in piece) if known and piece not in special else piece.encode()
        self.table = pa.array(pieces, pa.large_binary())

    def join(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All pieces one after another, and the bytes of each."""
        taken = self.table.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1)
        return (taken.buffers()[2].to_pybytes() if len(ids) and taken.buffers()[2] else b""), ends


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _texts(pieces: Pieces, ids: list[bytes | None]) -> list[str]:
    """The text of each array of ids: its pieces joined, bytes that are no UTF-8 replaced as the library does."""
    raw = [x or b"" for x in ids]
    data, ends = pieces.join(np.frombuffer(b"".join(raw), np.uint32))
    at = ends[np.cumsum([0] + [len(x) // 4 for x in raw])]
    return [data[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:], strict=True)]


def _decode(path: str):
    def run(batches):
        for batch in slices(batches, "ids"):
            texts = _texts(_once(Pieces, path), batch.column("ids").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``encoded`` (with a column ``ids`` as from :func:`encode`) and the column ``decoded``: its text."""
    fields = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(_decode(tokenizer or default_tokenizer()), f"{fields}, decoded string")


_DIGESTS = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(path: str):
    """A chunk's ids decoded where they are, and digests of both."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for batch in slices(table.to_batches(), "ids"):
            ids = batch.column("ids").to_pylist()
            texts = _texts(_once(Pieces, path), ids)
            out.append(pa.table([batch.column("key"), batch.column("n_tokens"), pa.array([sha256(x).hexdigest() for x in ids]), pa.array([sha256(t.encode()).hexdigest() for t in texts])], schema=_DIGESTS))
        return pa.concat_tables(out) if out else _DIGESTS.empty_table()

    return run


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text for every document."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), finish=_digests(default_tokenizer()), schema=_DIGESTS)

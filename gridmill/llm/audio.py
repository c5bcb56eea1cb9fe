"""Chroma audio fingerprints (operator 1).

A recording (signed 16-bit mono samples) is cut into overlapping frames; each frame's spectrum is summed into twelve pitch
classes and normalised. Over the image of frames by pitch classes an integral image lets sixteen rectangle filters be taken
at each position with four look-ups each; each filter's value, quantised to two Gray-coded bits, makes one packed 32-bit
code per position. For two recordings, a histogram over all offsets counts the bits that agree less those that differ; each
offset whose count can reach the threshold is aligned, and the share of bits that differ over the aligned stretch (bit
errors) decides whether they match. Counting bits, not whole codes, the histogram misses no match, however its errors lie.

Recordings with equal fingerprints form one class, named by its smallest key. Matches are pairs of class representatives,
found by comparing blocks of them, so copies are never expanded into pairs; a search takes the classes of every key divisible
by ``QUERY_STEP`` as queries against all classes. Its time grows with queries times classes.

Edge cases: null or too short recordings have no codes, are a class by themselves and match nothing; repeated rows each
give a row; a null key, or one that is no integer, matches nothing; other columns are not read; an empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

RATE, FRAME, HOP = 5512, 2048, 682
LOW, HIGH = 28.0, 2000.0
#: Frames that a filter spans.
SPAN = 16
#: Codes that an alignment must cover, and the bit errors up to which it is a match.
LEAST_OVERLAP, MAX_BIT_ERROR = 12, 0.15
QUERY_STEP = 20
#: Recordings, and bytes of their codes, in a block of the search.
BLOCK_ROWS, BLOCK_BYTES = 2048, 1 << 19


def _filters():
    """Sixteen rectangles by rule: (kind, first pitch, pitches, frames). Kinds: whole against nothing, early/late halves, low/high halves, quarters crossed, middle third in time, middle third in pitch."""
    kinds = [0, 1, 2, 3, 4, 5]
    return [(kinds[i % 6], (5 * i) % 9, 3 + (i % 3) if (5 * i) % 9 + 3 + (i % 3) <= 12 else 3, 4 + 4 * (i % 4)) for i in range(16)]


FILTERS = _filters()
_note = None


def _note_of() -> np.ndarray:
    """The pitch class of each spectral line, or 12 outside the range."""
    global _note
    if _note is None:
        f = np.arange(FRAME // 2 + 1) * RATE / FRAME
        note = np.full(len(f), 12)
        inside = (f >= LOW) & (f < HIGH)
        note[inside] = np.round(12 * np.log2(f[inside] / 440)).astype(int) % 12
        _note = np.eye(13, dtype=np.float32)[note][:, :12]
    return _note


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by twelve pitch classes, each frame of unit length (or zero where it is near silent)."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32) / 32768, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hamming(FRAME).astype(np.float32), axis=1)) ** 2
    out = power.astype(np.float32) @ _note_of()
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return np.where(size > 1e-3, out / np.maximum(size, 1e-3), 0)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One packed unsigned 32-bit code for each position of the filters."""
    image = chroma(samples)
    n = len(image) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0, t1, p0, p1):
        return total[at + t1, p1] - total[at + t0, p1] - total[at + t1, p0] + total[at + t0, p0]

    code = np.zeros(n, np.uint32)
    for kind, p, height, width in FILTERS:
        q, m, c = p + height, width // 2, p + max(1, height // 2)
        whole = area(0, width, p, q)
        if kind == 0:
            part, rest = whole, area(0, width, 0, 12) - whole
        elif kind == 1:
            part, rest = area(0, m, p, q), area(m, width, p, q)
        elif kind == 2:
            part, rest = area(0, width, p, c), area(0, width, c, q)
        elif kind == 3:
            part = area(0, m, p, c) + area(m, width, c, q)
            rest = whole - part
        elif kind == 4:
            part = area(width // 4, 3 * width // 4, p, q)
            rest = whole - part
        else:
            part = area(0, width, p + height // 3, q - height // 3)
            rest = whole - part
        value = np.log((1 + part) / (1 + rest))
        step = (value > -0.35).astype(np.uint32) + (value > 0.0) + (value > 0.35)
        code = (code << np.uint32(2)) | (step ^ (step >> np.uint32(1)))
    return code


_sine = (np.sin(2 * np.pi * np.arange(4096) / 4096) * 12000).astype(np.int16)


def melody(values: list[float] | None) -> np.ndarray | None:
    """A recording that plays one note for each number: its pitch, in semitones, follows the number. Stands in for audio, which the tables don't hold."""
    if values is None:
        return None
    v = np.nan_to_num(np.array([np.nan if x is None else x for x in values], np.float64), posinf=3, neginf=-3)
    if not len(v):
        return np.zeros(0, np.int16)
    spread = np.sqrt((v * v).mean()) or 1.0
    notes = np.clip(np.round(6 * v / spread), -18, 18)
    step = 440 * 2 ** (notes / 12) * 4096 / RATE
    phase = np.cumsum(np.repeat(step, HOP))
    return _sine[phase.astype(np.int64) & 4095]


def _render(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 64):  # rendered audio is large
            part = batch.slice(i, 64)
            audio = [melody(v) for v in part.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([None if a is None else a.tobytes() for a in audio], pa.binary())], ["key", "audio"])


def recordings(vectors: DataFrame, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """(key, audio): each vector played as a recording."""
    return vectors.select(F.col(key).cast("long").alias("key"), F.col(values).alias("embedding")).mapInArrow(_render, "key long, audio binary")


def _prints(batches):
    for batch in batches:
        codes = [np.zeros(0, np.uint32) if a is None else fingerprint(np.frombuffer(a[: len(a) // 2 * 2], np.int16)) for a in batch.column("audio").to_pylist()]
        raw = [c.tobytes() for c in codes]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(c) for c in codes], pa.int64()), pa.array(raw, pa.binary()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())], ["key", "n_codes", "codes", "fingerprint"])


def fingerprints(audio: DataFrame) -> DataFrame:
    """(key, audio) to ``key``, ``n_codes``, ``codes`` (unsigned 32-bit) and ``fingerprint`` (their SHA-256)."""
    return audio.mapInArrow(_prints, "key long, n_codes long, codes binary, fingerprint string")


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """The share of bits that differ where ``b`` moved by ``offset`` lies over ``a``, and the codes compared."""
    i, j = max(0, offset), max(0, -offset)
    n = min(len(a) - i, len(b) - j)
    if n <= 0:
        return 1.0, 0
    return float(np.bitwise_count(a[i : i + n] ^ b[j : j + n]).sum()) / (32 * n), n


def _blocks(batches):
    """(ids, lengths, codes) of recordings in a row, as many as BLOCK_ROWS and BLOCK_BYTES (of codes, padded to the longest) allow."""
    kind = pa.schema([("ids", pa.binary()), ("lengths", pa.binary()), ("codes", pa.binary())])

    def block(ids, codes):
        return pa.RecordBatch.from_pydict({"ids": [np.array(ids, np.int64).tobytes()], "lengths": [np.array([len(c) // 4 for c in codes], np.int64).tobytes()], "codes": [b"".join(codes)]}, kind)

    for batch in batches:
        ids, codes = batch.column("id").to_pylist(), batch.column("codes").to_pylist()
        at = longest = 0
        for end, c in enumerate(codes):
            longest = max(longest, len(c))
            if end > at and (end - at == BLOCK_ROWS or longest * (end + 1 - at) > BLOCK_BYTES):
                yield block(ids[at:end], codes[at:end])
                at, longest = end, len(c)
        if ids:
            yield block(ids[at:], codes[at:])


def _spectra(codes: list[np.ndarray], size: int) -> np.ndarray:
    """The Fourier transforms over time of each bit as a sign, nothing beyond a recording's end: (frequencies, recordings, 32)."""
    signs = np.zeros((len(codes), size, 32), np.float32)
    for row, c in zip(signs, codes, strict=True):
        row[: len(c)] = np.unpackbits(np.ascontiguousarray(c).view(np.uint8)).reshape(-1, 32) * np.float32(2) - 1
    return np.ascontiguousarray(np.fft.rfft(signs, axis=1).transpose(1, 0, 2))


def alignments(asked: list[np.ndarray], codes: list[np.ndarray]):
    """(place in ``asked``, place in ``codes``, offset) of each alignment of two sides that can be a match.

    The histogram of agreeing less differing bits over all offsets is a correlation, taken through its Fourier transform.
    What comes out is rounded, so a margin far above its error is allowed; each alignment is counted exactly afterwards.
    """
    na, nb = np.array([len(c) for c in asked]), np.array([len(c) for c in codes])
    if not len(na) or not len(nb) or min(na.max(), nb.max()) < LEAST_OVERLAP:
        return
    size = -(-int(na.max() + nb.max() - LEAST_OVERLAP) // 16) * 16  # offsets with enough overlap don't wrap round
    offsets = np.arange(LEAST_OVERLAP - int(nb.max()), int(na.max()) - LEAST_OVERLAP + 1)
    pairs = max(1, (1 << 20) // size)
    many = min(64, pairs)
    a = _spectra(asked, size)
    for j in range(0, len(codes), max(1, pairs // many)):
        part = slice(j, j + max(1, pairs // many))
        b = np.ascontiguousarray(_spectra(codes[part], size).conj().transpose(0, 2, 1))
        for i in range(0, len(asked), many):
            agree = np.fft.irfft(a[:, i : i + many] @ b, size, axis=0)
            la, lb = na[i : i + many, None], nb[None, part]
            if (la == la[0]).all() and (lb == lb[0, 0]).all():
                la, lb = la[:1], lb[:, :1]
            at = offsets[:, None, None]
            overlap = np.minimum(la - np.maximum(0, at), lb - np.maximum(0, -at))
            least = np.where(overlap >= LEAST_OVERLAP, 32 * (1 - 2 * MAX_BIT_ERROR) * overlap - 0.5 - 1e-4 * size, np.inf).astype(np.float32)
            for k, x, y in zip(*np.nonzero(agree[offsets % size] >= least), strict=True):
                yield i + int(x), j + int(y), int(offsets[k])


def _verify(batches):
    def side(r, name):
        return np.frombuffer(r[name + "ids"], np.int64), np.split(np.frombuffer(r[name + "codes"], np.uint32), np.cumsum(np.frombuffer(r[name + "lengths"], np.int64))[:-1])

    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            (queries, asked), (ids, codes) = side(r, "q_"), side(r, "")
            got = []
            for x, y, offset in alignments(asked, codes):
                e, n = bit_errors(asked[x], codes[y], offset)
                if e <= MAX_BIT_ERROR and n >= LEAST_OVERLAP and queries[x] != ids[y]:
                    got.append((int(queries[x]), int(ids[y]), offset, e))
            for at in range(0, len(got), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got[at : at + 100_000], strict=True)], ["query", "id", "offset", "bit_error"])


def _dealt(df: DataFrame, rows: int, name: str) -> DataFrame:
    """The recordings in blocks, in parts of about so many rows, written once."""
    parts = max(8, df.count() // rows + 1)
    return cut(df.select("id", "codes").repartition(parts, "id").mapInArrow(_blocks, "ids binary, lengths binary, codes binary"), name)


def matches(classes: DataFrame, queries: DataFrame) -> DataFrame:
    """All alignments of query classes (id, codes) with all other classes (id, codes) within MAX_BIT_ERROR over at least LEAST_OVERLAP codes: ``query``, ``id``, ``offset``, ``bit_error``.

    No votes are asked for: a match need not share a whole code. Every offset of every pair is looked at, in blocks.
    """
    asked = _dealt(queries, 2_000, "queries").withColumnsRenamed({c: "q_" + c for c in ("ids", "lengths", "codes")})
    blocks = _dealt(classes, 20_000, "blocks").crossJoin(asked.hint("shuffle_replicate_nl"))
    return blocks.mapInArrow(_verify, "query long, id long, offset long, bit_error double")


def op1_audio(spark, sf_dir: str) -> DataFrame:
    """A row for each vector's recording: ``vec_id``, ``n_codes``, ``fingerprint``, ``class_id``, and for queries ``n_matches`` (classes that match).

    Beside these, a row for each match of a query class, with the class's smallest query key as ``vec_id``, its
    ``class_id``, and ``match_id`` (the other class), ``match_offset`` and ``bit_error``; a class's other queries find
    them by class_id, so copies repeat no match.
    """
    table = cut(fingerprints(recordings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))), "fingerprints")
    full = table.where("n_codes > 0 and key is not null")
    ids = cut(full.groupBy("fingerprint").agg(F.min("key").alias("id"), F.min(F.when(F.col("key") % QUERY_STEP == 0, F.col("key"))).alias("asked")), "ids")
    classes = cut(full.join(ids.withColumnRenamed("fingerprint", "own"), (F.col("key") == F.col("id")) & (F.col("fingerprint") == F.col("own"))).dropDuplicates(["id"]).select("id", "codes", "asked"), "classes")
    found = cut(matches(classes, classes.where("asked is not null")), "matches")
    counts = cut(found.groupBy("query").agg(F.count_distinct("id").alias("n_matches")), "counts")
    member = table.join(ids, "fingerprint", "left").select("key", "n_codes", "fingerprint", F.coalesce("id", "key").alias("class_id"))
    member = member.join(counts, member.class_id == counts["query"], "left")
    number = F.when(F.col("key") % QUERY_STEP == 0, F.coalesce("n_matches", F.lit(0)))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("match_id", "long"), ("match_offset", "long"), ("bit_error", "double"))]
    rows = member.select(F.col("key").alias("vec_id"), "n_codes", "fingerprint", "class_id", number.alias("n_matches"), *nothing)
    own = found.join(classes.select(F.col("id").alias("query"), "asked"), "query")
    pairs = own.select(F.col("asked").alias("vec_id"), F.lit(None).cast("long").alias("n_codes"), F.lit(None).cast("string").alias("fingerprint"), F.col("query").alias("class_id"), F.lit(None).cast("long").alias("n_matches"), F.col("id").alias("match_id"), F.col("offset").alias("match_offset"), F.round("bit_error", 6).alias("bit_error"))
    return rows.unionByName(pairs)

"""Benchmark decontamination by the q-gram lemma (operator 4).

Texts and benchmark items are normalised (lower case; each run of characters that are no letters or digits becomes one
space). An item of m characters occurs in a text within k edits only if, within some diagonal span of k, text and item
share at least m + 1 - q - k*q character q-grams. Hits of the texts' q-grams among the items' are therefore counted in
overlapping diagonal bands; bands that meet the bound are verified by a banded alignment, which gives the edits.

The edits allowed are EDIT_RATE of an item's characters, or as many fewer as the bound needs to stay at one q-gram at least
(:func:`budget`). An item of fewer than ``SHORT_CHARS`` characters must stand in the text exactly and as whole words: it is
searched with a space at both ends, by q-grams no longer than it is, without edits.

The benchmark is taken in blocks of ``BLOCK_CHARS``; ``WAVE`` blocks are broadcast at once and searched in one scan, so what
is broadcast and what the driver holds have a fixed bound however large the benchmark is. A benchmark of several waves takes
a scan for each, whose result is written before the next begins. The documents are never shuffled.

Edge cases: null or empty texts hold nothing; items without letters and digits name no passage; repeated rows and items are
all reported; a key that is no integer is read as null; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, inverses, powers, randoms, slices

Q = 9
#: Edits allowed as a share of an item's length.
EDIT_RATE = 0.08
#: Items shorter than this are searched exactly, as whole words.
SHORT_CHARS = 20
#: Characters of items in a block, and blocks that are searched in one scan.
BLOCK_CHARS, WAVE = 2 << 20, 4
_CHAR = randoms(1 << 16, 31)
_other = re.compile(r"[\W_]+")
_FILTER_BITS = 22


def normalise(text: str | None) -> str:
    return _other.sub(" ", (text or "").lower()).strip()


def budget(m: int) -> tuple[int, int]:
    """The edits allowed for an item of m characters, and the least number of q-grams shared then (1 at least)."""
    k = int(EDIT_RATE * m)
    while k and m + 1 - Q - k * Q < 1:
        k -= 1
    return k, max(1, m + 1 - Q - k * Q)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all q-grams, by differences of one running sum."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_CHAR[codes & np.uint32(0xFFFF)] * powers(len(codes)), out=sums[1:])
    h = (sums[q:] - sums[:-q]) * inverses(len(codes))[: len(codes) - q + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


class Index:
    """The q-grams of items; ``pad``: the items, and the texts to search, have a space at both ends and allow no edits."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, pad: bool = False):
        self.q, self.pad = q, pad
        self.ids = [i for i, _ in items]
        self.texts = [f" {t} " if pad else t for _, t in items]
        self.codes = [_codes(t) for t in self.texts]
        grams = [_grams(c, q) for c in self.codes]
        h = np.concatenate(grams)
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order].astype(np.int64), place[order].astype(np.int64)
        self.grams, self.first = np.unique(h[order], return_index=True)
        self.last = np.append(self.first[1:], len(h))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.grams >> np.uint64(64 - _FILTER_BITS)] = True
        limits = [(0, len(t) + 1 - q) if pad else budget(len(t)) for t in self.texts]
        self.edits = np.array([k for k, _ in limits], np.int64)
        self.least = np.array([t for _, t in limits], np.int64)
        #: Makes all diagonals positive.
        self.shift = max(map(len, self.texts))

    @staticmethod
    def of(items: list[tuple[int, str]]) -> list[Index]:
        """Indexes of normalised items: one of the long, and for the short ones one for each length of q-gram that they take."""
        kinds: dict[tuple[int, bool], list[tuple[int, str]]] = {}
        for i, t in items:
            kinds.setdefault((Q, False) if len(t) >= SHORT_CHARS else (min(Q, len(t) + 2), True), []).append((i, t))
        return [Index(own, q, pad) for (q, pad), own in sorted(kinds.items())]

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal) of every band that shares enough q-grams."""
        h = _grams(codes, self.q)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
        where = np.searchsorted(self.grams, h[at])
        where[where == len(self.grams)] = 0
        real = self.grams[where] == h[at]
        at, where = at[real], where[real]
        n = self.last[where] - self.first[where]
        ends = np.cumsum(n)
        hit = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[where] - ends + n, n)
        item = self.item[hit]
        width = self.edits[item] + 1
        diagonal = np.repeat(at, n) - self.place[hit] + self.shift + width
        band = diagonal // width  # 1 at least, and below 2**40
        key = np.concatenate(((item << 40) + band, (item << 40) + band - 1))
        key, count = np.unique(key, return_counts=True)
        item = key >> 40
        good = count >= self.least[item]
        return [(int(i), int((b - 1) * (self.edits[i] + 1) - self.shift)) for i, b in zip(item[good], (key & ((1 << 40) - 1))[good], strict=True)]


def align(item: np.ndarray, text: np.ndarray, start: int, edits: int) -> tuple[int, int] | None:
    """The least edits, if at most ``edits``, that turn the item into a stretch of the text on the diagonals of one band, and the stretch's end."""
    low, width = start - edits, 2 * (edits + 1) + 2 * edits
    window = np.full(len(item) + width + 1, 0xFFFFFFFF, np.uint32)
    i, j = max(0, low), min(len(text), low + len(window))
    if i >= j:
        return None
    window[i - low : j - low] = text[i:j]
    x = np.arange(width, dtype=np.int32)
    cost = np.zeros(width, np.int32)
    for r in range(len(item)):
        step = cost + (window[r : r + width] != item[r])
        np.minimum(step[:-1], cost[1:] + 1, out=step[:-1])
        cost = np.minimum.accumulate(step - x) + x
        if cost.min() > edits:
            return None
    best = int(cost.argmin())
    return int(cost[best]), low + len(item) + best


def find(indexes: list[Index], texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text, item's id, edits, start, end) for each text and item that it holds: its best place, in normalised characters."""
    return sorted(r for index in indexes for r in _find(index, texts))


def _find(index: Index, texts: list[str]):
    if index.pad:
        texts = [f" {t} " for t in texts]
    joined = "\0".join(texts) + "\0" * Q
    codes = _codes(joined)
    ends = np.cumsum([len(t) + 1 for t in texts])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for item, start in index.candidates(codes):
        own, k = index.codes[item], int(index.edits[item])
        middle = min(max(0, start + k + len(own) // 2), len(codes) - 1)
        which = int(np.searchsorted(ends, middle, side="right"))
        if which >= len(texts):
            continue
        base = int(ends[which - 1]) if which else 0
        if best.get((which, item), (1,))[0] == 0:
            continue
        low = max(base, start - k)
        exact = joined.find(index.texts[item], low, min(int(ends[which]) - 1, start + 3 * k + 2 + len(own)))
        if exact >= 0:
            best[which, item] = (0, exact - base, exact - base + len(own) - 2 * index.pad)
        elif not index.pad and (found := align(own, codes[base : ends[which] - 1], start - base, k)) and found[0] < best.get((which, item), (1 << 30,))[0]:
            best[which, item] = (found[0], max(0, found[1] - len(own)), found[1])
    for (w, i), v in best.items():
        yield (w, index.ids[i], *v)


def _waves(benchmark: DataFrame, item: str, text: str):
    """Lists of at most about WAVE blocks' indexes each, and whether it is the last."""
    held, size, wave = [], 0, []
    for r in benchmark.select(F.col(item).cast("long"), F.col(text)).toLocalIterator():
        if t := normalise(r[1]):
            if size and size + len(t) > BLOCK_CHARS:
                if len(wave) >= WAVE:
                    yield wave, False
                    wave = []
                wave += Index.of(held)
                held, size = [], 0
            held.append((r[0], t))
            size += len(t)
    if held:
        if len(wave) >= WAVE:
            yield wave, False
            wave = []
        wave += Index.of(held)
    yield wave, True


def _search(indexes):
    def run(batches):
        forget()
        for batch in slices(batches, "text"):
            keys = batch.column(0).to_pylist()
            rows = find(indexes.value, [normalise(t) for t in batch.column("text").to_pylist()])
            if rows:
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([keys[r[0]] for r in rows], pa.int64()), "item_id": pa.array([r[1] for r in rows], pa.int64()), "edits": pa.array([r[2] for r in rows], pa.int64()), "start": pa.array([r[3] for r in rows], pa.int64()), "end": pa.array([r[4] for r in rows], pa.int64())})

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and benchmark item that it holds: ``doc_id``, ``item_id``, ``edits``, ``start``, ``end`` (normalised characters)."""
    spark, out = docs.sparkSession, None
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    for wave, last in _waves(benchmark, item, item_text):
        sent = spark.sparkContext.broadcast(wave)
        found = read.mapInArrow(_search(sent), "doc_id long, item_id long, edits long, start long, end long")
        if not last:
            found = cut(found, "found")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _without(indexes):
    def run(batches):
        forget()
        for batch in slices(batches, "text"):
            good = np.ones(batch.num_rows, bool)
            good[[r[0] for r in find(indexes.value, [normalise(t) for t in batch.column("text").to_pylist()])]] = False
            yield batch.filter(pa.array(good))

    return run


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item."""
    for wave, last in _waves(benchmark, "item_id", "text"):
        sent = docs.sparkSession.sparkContext.broadcast(wave)
        docs = docs.mapInArrow(_without(sent), docs.schema)
        if not last:
            docs = cut(docs, "left")
            sent.destroy()
    return docs


def op4_decontam(spark, sf_dir: str) -> DataFrame:
    """All benchmark items found in all documents."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

"""Quality classifier on subword embeddings (operator 8).

A document's features are its words, pairs of neighbouring words, marks of repeated words, and the character n-grams of
its bytes, each hashed to one of ``BUCKETS`` learned vectors. The document is the average of the vectors of its features,
and a softmax layer on it gives the score. Vectors and layer are learned together by stochastic gradient descent in numpy.
As the layer is linear in the average, scoring needs one learned number for each bucket (vector times layer): sums over a
text's features, taken in pieces of PIECE_BYTES that overlap by a word, so that memory has a bound for texts of any length
(of any length of words, that is: a piece ends at white space).

Training takes at most ``TRAIN_DOCS`` labelled documents (the least hashes of doc_id, one text for each), of at most
``TRAIN_BYTES`` together (one that no longer fits is passed over); scoring takes every row and whole texts.

Edge cases: null text is taken as empty; a text without features gets the score of the layer's bias; repeated rows each
get a row; a null key is not held out and nothing is learned from it; other columns are not read; without any labelled row
every score is 0.5; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, cut, forget, randoms, slices, trim, utf8, words_of

#: The bounds on labelled documents that training takes: how many, and their bytes.
TRAIN_DOCS, TRAIN_BYTES = 3000, 64 << 20
#: Bytes of one text that are scored at once.
PIECE_BYTES = 1 << 20
BITS, DIM, EPOCHS, RATE = 18, 8, 6, 2.0
BUCKETS = 1 << BITS
GRAMS = (3, 4, 5)
_SPACES = b" \t\n\x0b\x0c\r"
_space = re.compile(rb"[\x20\x09-\x0D]")


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: list[bytes]):
    """For each text, its arrays of bucket numbers, one for each kind of feature, repeats included."""
    data, starts, _, words, counts = words_of(texts)
    f = randoms(8, 23) | np.uint64(1)
    pairs = _bucket(words[:-1] * f[0] + words[1:] * f[1]) if len(words) else np.zeros(0, np.int32)
    again = _bucket((words[1:] == words[:-1]).astype(np.uint64) * f[2] + f[3]) if len(words) else pairs
    singles = _bucket(words)
    mapped, grams = _BYTE[data], {}
    for n in GRAMS:
        size = max(0, len(data) - n + 1)
        h = mapped[:size] * f[4]
        for k in range(1, n):
            h *= f[5]
            h += mapped[k : k + size] * f[4]
        grams[n] = _bucket(h)
    at = word = 0
    for text, count in zip(texts, counts.tolist(), strict=True):
        end, last = at + len(text), word + count
        yield [singles[word:last], pairs[word : max(word, last - 1)], again[word : max(word, last - 1)], *(grams[n][at : max(at, end - n + 1)] for n in GRAMS)]
        at, word = end + 1, last


@dataclass
class Model:
    #: For each bucket, its vector times the layer's difference between good and bad; the same for the bias.
    table: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        short = [i for i, t in enumerate(texts) if len(t) <= PIECE_BYTES]
        for i, kinds in zip(short, features([texts[i] for i in short]), strict=True):
            means = [float(self.table[k].sum(dtype=np.float64)) / len(k) for k in kinds if len(k)]
            out[i] += sum(means) / len(kinds)
        for i in sorted({*range(len(texts))} - {*short}):
            sums, sizes = np.zeros(3 + len(GRAMS)), np.zeros(3 + len(GRAMS))
            for piece, n_bytes, n_words in _pieces(texts[i]):
                known = [n_words, max(0, n_words - 1), max(0, n_words - 1), *(max(0, n_bytes - n + 1) for n in GRAMS)]
                for k, (kind, seen) in enumerate(zip(next(features([piece])), known, strict=True)):
                    sums[k] += self.table[kind[seen:]].sum(dtype=np.float64)
                    sizes[k] += len(kind[seen:])
            out[i] += (sums / np.maximum(1, sizes)).sum() / len(sums)
        return 1 / (1 + np.exp(-out))


def _pieces(text: bytes):
    """(piece, bytes of it that the one before holds, words in these). Pieces begin with the last word before them, and hold max(GRAMS) - 1 bytes from before."""
    at = begin = 0
    while at < len(text):
        m = _space.search(text, min(len(text), at + PIECE_BYTES))
        end = m.end() if m else len(text)
        yield text[begin:end], at - begin, len(text[begin:at].split())
        at = begin = end
        while begin and end - begin < max(GRAMS):  # word by word
            while begin and text[begin - 1] in _SPACES:
                begin -= 1
            while begin and text[begin - 1] not in _SPACES:
                begin -= 1


def train(texts: list[bytes], labels: np.ndarray, seed: int = 1) -> Model:
    """Fit vectors and layer; each kind of feature has the same share in a document's average, whatever its count."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    bags = []
    at = 0
    while at < len(texts):  # some texts at once, of a bounded size but for a longer one by itself
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) <= 1 << 18:
            size += len(texts[stop])
            stop += 1
        for kinds in features(texts[at:stop]):
            ids = np.concatenate(kinds)
            share = np.concatenate([np.full(len(k), 1 / (max(1, len(k)) * len(kinds))) for k in kinds]) if len(ids) else np.zeros(0)
            distinct, where = np.unique(ids, return_inverse=True)
            bags.append((distinct, np.bincount(where, share, len(distinct)).astype(np.float32)))
        at = stop
    steps, step = max(1, EPOCHS * len(bags)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)).tolist():
            ids, share = bags[i]
            rate = RATE * (1 - step / steps)
            step += 1
            own = vectors[ids]
            hidden = share @ own
            logit = hidden @ layer + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= np.float32(rate * 0.1) * np.outer(hidden, p)
            bias -= np.float32(rate * 0.02) * p
            # As each feature's share is small, its step is scaled up to that of a mean feature.
            vectors[ids] = own - np.float32(rate) * np.outer(share * min(len(ids), 64), back)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> Model:
    """A model from labelled rows (doc_id, quality) that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_docs)
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = cut(found, "labelled")
    fits, size = [], 0
    for r in found.select("doc_id", "quality", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").collect():
        if size + r.n <= TRAIN_BYTES:
            fits.append((r.doc_id, r.quality))
            size += r.n
    if not fits:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    fits = docs.sparkSession.createDataFrame(fits, found.select("doc_id", "quality").schema)
    rows = found.join(F.broadcast(fits), ["doc_id", "quality"]).collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality))
    texts, given = [(r.text or "").encode() for r in rows], np.array([int(r.quality > 0) for r in rows])
    del rows
    model = train(texts, given)
    del texts
    trim()  # this is the driver, which goes on
    return model


def _score(model):
    def run(batches):
        forget()
        for batch in slices(batches, "text"):
            scores = model.value.score(utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher is better) of each row's whole text."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_score(kept), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def _keep(model, threshold: float):
    def run(batches):
        forget()
        for batch in slices(batches, "text"):
            good = model.value.score(utf8(batch.column("text"))) >= threshold
            yield batch.filter(pa.array(good))

    return run


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``."""
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model), threshold), docs.schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that has seen no held-out label."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

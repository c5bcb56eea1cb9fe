"""Near-duplicate documents by MinHash (operator 7).

1. A document's set of word shingles gives a digest and the minima of many universal hash functions. A shingle is kept as
   128 bits, made from the BLAKE2b hashes of its words; minima are taken over the first 64, sets are compared by all.
   Documents with equal digests are exact copies as far as the sets go; one of them stands for its class from here on.
2. Bands of the minima put classes into buckets. Within a bucket, signatures are compared, and a spanning forest of the
   pairs whose estimate is not far below the threshold goes out: linear in the bucket, though no pair is left out. The
   trees of all buckets together, as connected components, are the candidate groups.
3. The sets of a candidate group's members are read anew from their whole texts and compared exactly; again a spanning
   forest of the true links goes out. Its connected components are the result.

A bucket or group of any size is compared in cells of bounded rows and bytes (:func:`_forest`): first each member with a few
pivots of its group and with the members of its own cell, which joins nearly all of a group of near copies; then what is
not in the group's largest tree yet with all members of the group. Pairs in one tree need no look, so none is missed. The
bands leave a linked pair unfound with a chance below ``MISS``.

Edge cases: null, empty and white-space texts have an empty set and are linked with nothing; a null key is linked with
nothing (component null, kept); rows with the same key are one node, whatever their texts, so their classes come together;
a key that is no integer is read as null; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import array
import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, forget, mix, randoms, slices, small_batches, utf8
from .components import connected_components

MISS = 1e-7
#: Bytes of keys that may be broadcast to pick candidates' texts in the scan; beyond it a shuffled join picks them.
BROADCAST_BYTES = 32 << 20
#: Members and pivots of a group that one cell takes, and the bytes of either beyond which it takes fewer, one at least.
MEMBERS, PIVOTS, CELL_BYTES = 48, 16, 4 << 20
#: Bytes of text that are cut into words at once.
PIECE_BYTES = 1 << 20


def bands_for(threshold: float) -> tuple[int, int]:
    """The longest bands, and their number, that find a pair at the threshold but for a chance of MISS, with 160 minima at most."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-(threshold**rows)))
        if rows * bands <= 160 or rows == 1:
            return rows, bands


def _pieces(text: bytes):
    """A text in pieces of about PIECE_BYTES that end at white space."""
    if len(text) <= PIECE_BYTES:
        yield text
        return
    at = 0
    while at < len(text):
        m = _space.search(text, min(len(text), at + PIECE_BYTES))
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


_space = re.compile(rb"[\x20\x09-\x0D]")


def shingle_sets(texts: list[bytes], width: int):
    """The distinct shingles of each text, sorted, as rows of two unsigned 64-bit numbers: ``width`` words, or all words where there are fewer.

    Each distinct word of the texts is hashed once, by BLAKE2b. A shingle's numbers are mixed sums, over its words, of a mix
    of both halves of the word's hash and its place.
    """
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    codes, counts = array.array("I"), []
    for text in texts:
        before = len(codes)
        for piece in _pieces(text):
            codes.extend(map(known.__getitem__, piece.translate(LOWER).split()))
        counts.append(len(codes) - before)
    codes = np.frombuffer(codes, np.uint32)
    hashed = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in known]), np.uint64).reshape(-1, 2)
    factors = randoms(4 * width, 7).reshape(2, width, 2) | np.uint64(1)
    at_place = [[mix(hashed[:, 0] * factors[lane, k, 0]) + mix(hashed[:, 1] * factors[lane, k, 1]) for k in range(width)] for lane in (0, 1)]

    def sums(own, size):
        # The number of words tells short texts' shingles apart.
        out = np.full((2, len(own) - size + 1), np.uint64(size))
        for lane in (0, 1):
            for k in range(size):
                out[lane] += at_place[lane][k][own[k : k + out.shape[1]]]
            mix(out[lane])
        return out

    every, at = sums(codes, width) if len(codes) >= width else None, 0
    for n in counts:
        if not n:
            yield np.zeros((0, 2), np.uint64)
            continue
        a, b = every[:, at : at + n - width + 1] if n >= width else sums(codes[at : at + n], n)
        at += n
        order = np.argsort(a)
        out = np.column_stack((a[order], b[order]))
        same = out[1:, 0] == out[:-1, 0]
        if same.any():
            if (out[1:, 1] != out[:-1, 1])[same].any():  # equal in the first half only
                out = out[np.lexsort((out[:, 1], out[:, 0]))]
            out = out[np.concatenate(([True], (out[1:] != out[:-1]).any(axis=1)))]
        yield out


def _minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), ~np.uint64(0))
    for i in range(0, len(x), 512):
        np.minimum(out, (np.multiply.outer(a, x[i : i + 512]) + b).min(axis=1), out=out)
    return out >> np.uint64(32)


def _signatures(width: int, rows: int, bands: int):
    a, b = randoms(rows * bands, 3) | np.uint64(1), randoms(rows * bands, 5)[:, None]
    factor, salt = randoms(rows, 13) | np.uint64(1), randoms(bands, 17)

    def run(batches):
        forget()
        for batch in slices(batches, "text"):
            sizes, digests, sigs, keys = [], [], [], []
            for s in shingle_sets(utf8(batch.column("text")), width):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                m = _minima(np.ascontiguousarray(s[:, 0]), a, b) if len(s) else np.zeros(rows * bands, np.uint64)
                sigs.append(m.astype(np.uint16).tobytes())
                keys.append(mix((m.reshape(bands, rows) * factor).sum(axis=1, dtype=np.uint64) + salt).astype(np.int64))
            bands_col = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(keys) + 1, bands, dtype=np.int32)), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), bands_col], ["key", "n", "digest", "sig", "bands"])

    return run


class _Trees:
    """Union-find over 0..n-1 that notes the pairs that joined two trees."""

    def __init__(self, n: int):
        self.parent, self.edges = list(range(n)), []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def _by_signature(least: int):
    """Rows of ``values`` that agree in enough minima with row i, among those from ``start`` on."""

    def prepare(values):
        sig = np.frombuffer(b"".join(values), np.uint16).reshape(len(values), -1)
        return lambda i, start: start + np.flatnonzero((sig[start:] == sig[i]).sum(axis=1) >= least)

    return prepare


def _by_set(percent: int):
    """Rows of ``values`` whose sets share enough with row i's, among those from ``start`` on."""

    def prepare(values):
        sets = [np.frombuffer(s, np.uint64).reshape(-1, 2) for s in values]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets)
        order = np.argsort(flat[:, 0], kind="stable")
        flat = flat[order]
        first = np.concatenate(([True], flat[1:, 0] != flat[:-1, 0]))
        if (flat[1:, 1] != flat[:-1, 1])[~first[1:]].any():  # equal in the first half only
            again = np.lexsort((flat[:, 1], flat[:, 0]))
            flat, order = flat[again], order[again]
            first = np.concatenate(([True], (flat[1:] != flat[:-1]).any(axis=1)))
        run = np.cumsum(first) - 1  # the number of the distinct shingle, in sorted order
        owner = np.repeat(np.arange(len(sets)), sizes)[order]
        starts = np.append(np.flatnonzero(first), len(flat))
        code = np.empty(len(flat), np.int64)
        code[order] = run
        ends = np.cumsum(sizes)

        def near(i, start):
            own = code[ends[i] - sizes[i] : ends[i]]
            lengths = starts[own + 1] - starts[own]
            stops = np.cumsum(lengths)
            where = np.arange(stops[-1]) + np.repeat(starts[own] - stops + lengths, lengths)
            shared = np.bincount(owner[where], minlength=len(sets))[start:]
            return start + np.flatnonzero(100 * shared >= percent * (sizes[start:] + sizes[i] - shared))

        return near

    return prepare


def _close(ids, sides, values, across, prepare):
    """Edges of a spanning forest of a cell's linked pairs: of all pairs, or of those ``across`` its two sides."""
    split = sum(s == 0 for s in sides) if across else len(ids) - 1
    if len(ids) < 2 or across and split in (0, len(ids)):
        return []
    order = sorted(range(len(ids)), key=sides.__getitem__)
    near, trees = prepare([values[k] for k in order]), _Trees(len(ids))
    for i in range(split):
        for j in near(i, split if across else i + 1).tolist():
            trees.link(i, j)
    return [(ids[order[i]], ids[order[j]]) for i, j in trees.edges]


def _cells(value: str, prepare):
    """Rows sorted by cell (g, i, j) to the edges of each cell's forest. Holds one cell, which has a bound."""

    def run(batches):
        held, last = ([], [], []), None
        for batch in slices(batches, value):
            marks = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "i", "j")]
            change = np.flatnonzero(np.concatenate(([True], np.any([m[1:] != m[:-1] for m in marks], axis=0)))).tolist() if batch.num_rows else []
            columns = [batch.column(c).to_pylist() for c in ("id", "side", value)]
            out = []
            for s, e in zip(change, [*change[1:], batch.num_rows], strict=True):
                mark = tuple(m[s] for m in marks)
                if mark != last:
                    out += _close(*held, bool(last) and last[2] >= 0, prepare)
                    held, last = ([], [], []), mark
                for h, c in zip(held, columns, strict=True):
                    h += c[s:e]
            if out:
                yield _edges(out)
        if out := _close(*held, bool(last) and last[2] >= 0, prepare):
            yield _edges(out)

    return run


def _edges(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _forest(members: DataFrame, with_values, value: str, prepare) -> DataFrame:
    """Components (node, component) of all pairs within the groups that ``prepare``'s test links.

    ``members``: rows (g, id, size), size being the bytes of the member's value; ``with_values`` adds the column ``value``
    by id to rows that have been dealt to cells. Cells have at most about MEMBERS and PIVOTS rows in the first round; in
    the second, a group of n members has cells of about four times the square root of n.
    """

    def links(dealt: DataFrame) -> DataFrame:
        rows = with_values(cut(dealt, "dealt")).select("g", "i", "j", "id", "side", value)
        rows = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "id", "side")
        return rows.mapInArrow(_cells(value, prepare), "a long, b long")

    n, mean = F.col("n"), F.greatest(F.lit(1.0), F.col("mean"))
    sizes = cut(members.groupBy("g").agg(F.count("*").alias("n"), F.avg("size").alias("mean")).where("n > 1"), "sizes")
    cells = F.when((n <= MEMBERS + PIVOTS) & (n * mean <= 2 * CELL_BYTES), 1).otherwise(F.ceil(F.greatest(n / MEMBERS, n * mean / CELL_BYTES))).cast("int")
    pivots = F.greatest(F.lit(1.0), F.least(F.lit(float(PIVOTS)), CELL_BYTES / mean))
    chosen = (F.col("cells") > 1) & (F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(n / pivots)) == 0)
    dealt = members.join(sizes.withColumn("cells", cells), "g")
    own = F.pmod(F.xxhash64("id", F.lit(2)), F.col("cells")).cast("int")
    dealt = dealt.withColumn("i", F.explode(F.when(chosen, F.sequence(F.lit(0), F.col("cells") - 1)).otherwise(F.array(own))))
    first = cut(connected_components(links(dealt.select("g", "id", "i", F.lit(-1).alias("j"), F.lit(0).alias("side")))), "trees")

    large = cut(sizes.withColumn("cells", cells).where("cells > 1").drop("cells"), "large")
    if large.isEmpty():
        return first
    placed = cut(members.join(large, "g").join(first, F.col("id") == F.col("node"), "left").select("g", "id", "n", "mean", F.coalesce("component", "id").alias("tree")), "placed")
    trees = placed.groupBy("g", "tree").agg(F.count("*").alias("m"))
    most = cut(trees.groupBy("g").agg(F.max_by("tree", F.struct("m", "tree")).alias("most"), (F.sum("m") - F.max("m")).alias("rest")).where("rest > 0"), "most")
    if most.isEmpty():
        return first
    placed = placed.join(most, "g")
    side = F.greatest(F.lit(1.0), F.least(CELL_BYTES / mean, F.greatest(F.lit(64.0), 2 * F.sqrt("n"))))
    placed = placed.withColumns({"rows": F.ceil(F.col("rest") / side).cast("int"), "cols": F.ceil(n / side).cast("int")})
    hashed = lambda c: F.pmod(F.xxhash64("id", F.lit(3)), F.col(c)).cast("int")
    rest = placed.where("tree <> most").select("g", "id", hashed("rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), F.lit(0).alias("side"))
    everyone = placed.select("g", "id", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), hashed("cols").alias("j"), F.lit(1).alias("side"))
    second = links(rest.unionByName(everyone.select(rest.columns)))
    return cut(connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second)), "trees")


def _sets(width: int):
    def run(batches):
        forget()
        for batch in slices(batches, "text"):
            sets = [s.tobytes() for s in shingle_sets(utf8(batch.column("text")), width)]
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(sets, pa.binary())], [*rest, "set"])

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked whose shingle sets share at least ``percent`` hundredths of their union; component_id is the
    smallest key reachable by links, kept says whether that is the row's own.
    """
    with small_batches(docs.sparkSession):  # all that goes through workers is done here; what is returned is a join
        return _classified(docs, key, text, width, percent)


def _classified(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    rows, bands = bands_for(percent / 100)
    read = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    signed = cut(read.mapInArrow(_signatures(width, rows, bands), "key long, n long, digest binary, sig binary, bands array<long>"), "signatures")
    full = signed.where("n > 0 and key is not null")
    # Written first, so that the join has two plain shuffles, and Spark can split the one with many copies.
    classes = cut(full.groupBy("digest").agg(F.min("key").alias("rep")), "digests")
    member = cut(signed.select("key", "n", "digest").join(classes, "digest", "left").select("key", "n", "rep"), "members")
    reps = full.join(classes.withColumnRenamed("digest", "own"), (F.col("key") == F.col("rep")) & (F.col("digest") == F.col("own"))).dropDuplicates(["key", "digest"])  # as they are dealt, without another shuffle
    reps = cut(reps.select(F.col("key").alias("id"), "n", "sig", "bands"), "classes")
    # A key with texts of several classes is one node: its classes come together.
    known = member.where("rep is not null")
    repeated = cut(known.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("m > 1"), "repeated")
    once = repeated.isEmpty()
    minima = rows * bands
    least = math.floor(minima * (percent / 100 - 6 * math.sqrt(percent / 100 * (1 - percent / 100) / minima)))
    signatures = reps.select("id", "sig")
    spread = reps.select(F.explode("bands").alias("g"), "id", F.lit(2 * minima).alias("size"))
    spread = spread if once else spread.distinct()
    group = _forest(spread, lambda dealt: dealt.join(signatures, "id"), "sig", _by_signature(least)).select(F.col("node").alias("id"), F.col("component").alias("g"))

    def with_sets(dealt: DataFrame) -> DataFrame:
        small = dealt.count() * 32 <= BROADCAST_BYTES
        dealt, ids = (F.broadcast(dealt), F.broadcast(dealt.select("id").distinct())) if small else (dealt, dealt.select("id").distinct())
        sets = read.join(ids, F.col("key") == F.col("id")).select("id", "text").mapInArrow(_sets(width), "id long, set binary").where(F.octet_length("set") > 0)
        if not once:  # a key may repeat the same text many times
            sets = sets.withColumn("own", F.sha2("set", 256)).dropDuplicates(["id", "own"])
        return sets.join(dealt, "id")

    found = _forest(group.join(reps.groupBy("id").agg((16 * F.sum("n")).alias("size")), "id"), with_sets, "set", _by_set(percent))
    if not once:
        joined = known.join(repeated.where("low < high").select("key", "low"), "key").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
        found = cut(connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(joined)), "components")
    out = member.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "rep", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"))


def op7_neardup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, Jaccard similarity 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)


#: The same by comparing all sets directly.
OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [v FOR v IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF v <> ''] AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 1, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.m AS component_id, d.doc_id = r.m AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

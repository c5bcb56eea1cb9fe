"""Range queries and nearest neighbours, over plain tables and over indexes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import Box, circle_box, circle_overlaps
from ..scratch import shared_path
from .grid import Cells, Grid, assign
from .index import Index


def _exact(box: Box, circle: tuple[float, float, float] | None, mode: str) -> Column | None:
    return circle_overlaps(*circle, box) if circle and mode == "exact" else None


def range_query(df: DataFrame, query: Box | tuple, box: Box | None = None, circle: tuple[float, float, float] | None = None, mode: str = "mbr") -> DataFrame:
    """Rows whose box overlaps the query's box. A circle is queried by its bounds, or exactly with mode="exact"."""
    box = box or Box()
    query = circle_box(*circle) if circle else query if isinstance(query, Box) else Box(*query)
    out = df.where(box.overlaps(query))
    exact = _exact(box, circle, mode)
    return out if exact is None else out.where(exact)


def in_cell(cells: Cells, cell_id: Column, a: Box, b: Box) -> Column:
    """Whether the lower corner of the common box lies in the cell: true in exactly one of the cells that both overlap."""
    return cells.cell_at(F.greatest(a.x, b.x), F.greatest(a.y, b.y)) == cell_id


def indexed_range_query(spark: SparkSession, index: Index, query: tuple[int, int, int, int], box: Box | None = None) -> DataFrame:
    """The same rows from an index: reads the cells that the query overlaps, and keeps each shape in one of its cells."""
    box, q = box or Box(), Box(*query)
    rows = index.data(spark, index.cells.overlapping(*query)).where(box.overlaps(q))
    keep = (F.col("cell_id") < 0) | in_cell(index.cells, F.col("cell_id"), box, q)
    return rows.where(keep).drop("cell_id", "is_home")


def batch_range_query(df: DataFrame, queries: DataFrame, cells: Cells | None = None, box: Box | None = None) -> DataFrame:
    """Many range queries at once: queries (query_id, qx, qy, qwidth, qheight) as one join over cells."""
    from .spatial_join import spatial_join

    right = queries.select("query_id", *(F.col(f"q{c}").alias(c) for c in ("x", "y", "width", "height")))
    return spatial_join(df, right, cells, box or Box())


def knn(df: DataFrame, px: int, py: int, k: int, box: Box | None = None, dedupe: bool = True, measure: str = "max", whole: bool = False) -> DataFrame:
    """The k nearest rows and their ``distance``, ascending; ties by all columns. Each task keeps k rows (top-k, no full sort).

    ``dedupe`` counts equal rows once (False: each); ``whole`` cuts distances to whole numbers, so that ties within one unit go by columns.
    """
    distance = _distance(box, px, py, measure)
    distance = F.floor(distance).cast("double") if whole else distance
    out = df.dropDuplicates() if dedupe else df
    return out.withColumn("distance", distance).orderBy("distance", *df.columns).limit(k)


def _distance(box: Box | None, px, py, measure: str) -> Column:
    box = box or Box("x", "y", F.lit(0), F.lit(0))
    return (box.min_distance if measure == "min" else box.max_distance)(px, py)


def indexed_knn(spark: SparkSession, index: Index, px: int, py: int, k: int, box: Box | None = None, measure: str = "max") -> DataFrame:
    """The same from an index. Cells are read by distance until k rows are found; then all cells that can hold a nearer one."""
    def gap(b):
        return max(b[1] - px, 0, px - (b[1] + b[3])) ** 2 + max(b[2] - py, 0, py - (b[2] + b[4])) ** 2

    bounds, n = sorted(index.cells.bounds(), key=lambda b: (gap(b), b[0])), 1
    while True:
        near = [b[0] for b in bounds[:n]]
        first = knn(index.data(spark, near).where("is_home").drop("cell_id", "is_home"), px, py, k, box, measure=measure)
        worst = first.agg(F.count("*").alias("n"), F.max("distance").alias("d")).first()
        if worst.n >= k or n >= len(bounds):
            break
        n = min(len(bounds), 2 * n)
    if n >= len(bounds):
        return first
    reach = worst.d * worst.d
    if measure == "max":  # a shape's farthest corner is no nearer than its home
        rows = index.data(spark, [b[0] for b in bounds if gap(b) <= reach]).where("is_home")
    else:
        # A shape that comes so near has a copy in a cell that does, if the outer cells reach on without end; copies count once.
        left, low, right, high = min(b[1] for b in bounds), min(b[2] for b in bounds), max(b[1] + b[3] for b in bounds), max(b[2] + b[4] for b in bounds)

        def outer_gap(b):
            x1, x2 = -math.inf if b[1] == left else b[1], math.inf if b[1] + b[3] == right else b[1] + b[3]
            y1, y2 = -math.inf if b[2] == low else b[2], math.inf if b[2] + b[4] == high else b[2] + b[4]
            return max(x1 - px, 0, px - x2) ** 2 + max(y1 - py, 0, py - y2) ** 2

        rows = index.data(spark, [b[0] for b in bounds if outer_gap(b) <= reach])
    return knn(rows.drop("cell_id", "is_home"), px, py, k, box, measure=measure)


#: Queries that one pass takes; more go in blocks.
QUERY_BLOCK = 2000


def batch_knn(df: DataFrame, queries: list[tuple[int, int, int]], k: int, key: str = "id") -> DataFrame:
    """The k nearest points for each of a stated list of queries (query_id, px, py): query_id, key, d2 (squared distance), rank.

    Each task keeps k points for each query; a window merges them. Queries go in blocks, so what is sent has a bound.
    """
    out = None
    for i in range(0, max(1, len(queries)), QUERY_BLOCK):
        block = queries[i : i + QUERY_BLOCK]
        part = df.select(F.col(key).alias(key), "x", "y").mapInArrow(_nearest(block, k, key), f"query_id long, `{key}` long, d2 long")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("d2", key)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_join(df: DataFrame, queries: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k nearest points for each row of ``queries`` (query_id, qx, qy), however many: query_id, qx, qy, key, d2, rank; ties by key.

    Rounds of a join over cells about as wide as a round's reach, so that a query meets a few cells; queries that have found
    k points are done, the others reach twice as far. Of points at one place only the k least keys can count; the others go
    first. Equal queries count once; those without a place, and points without one, have no neighbours. Squared distances
    must fit in 64 bits.
    """
    spark = df.sparkSession

    def written(rows: DataFrame) -> DataFrame:
        path = shared_path(spark, "knn")
        rows.write.parquet(path)
        return spark.read.parquet(path)

    def ends(rows: DataFrame, x: str, y: str):
        return rows.agg(F.count("*").alias("n"), F.min(x).alias("x1"), F.max(x).alias("x2"), F.min(y).alias("y1"), F.max(y).alias("y2")).first()

    place = Window.partitionBy("x", "y").orderBy("_key")
    points = df.select(F.col(key).alias("_key"), F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y")).where("x is not null and y is not null")
    points = written(points.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k).drop("_n"))
    rest = written(queries.select("query_id", F.col("qx").cast("bigint").alias("qx"), F.col("qy").cast("bigint").alias("qy")).where("qx is not null and qy is not null").distinct())
    p, q = ends(points, "x", "y"), ends(rest, "qx", "qy")
    if not p.n or not q.n:
        return rest.limit(0).join(points.limit(0)).select("query_id", "qx", "qy", F.col("_key").alias(key), F.lit(0).cast("bigint").alias("d2"), F.lit(0).alias("rank"))
    width, height = p.x2 - p.x1 + 1, p.y2 - p.y1 + 1
    farthest = max(p.x2, q.x2) - min(p.x1, q.x1) + max(p.y2, q.y2) - min(p.y1, q.y1)
    own = ["query_id", "qx", "qy"]
    same = F.expr("query_id <=> _query_id and qx = _qx and qy = _qy")  # a query's id may be null
    nearest = Window.partitionBy(*own).orderBy("d2", "_key")
    reach, out = max(1, math.isqrt(k * width * height // p.n)), None
    while True:
        grid = Grid(p.x1, p.y1, width, height, max(1, width // reach), max(1, height // reach))
        squares = assign(rest, grid, Box(F.col("qx") - reach, F.col("qy") - reach, F.lit(2 * reach + 1), F.lit(2 * reach + 1))).where("cell_id >= 0").drop("is_home")
        d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
        met = squares.join(points.withColumn("cell_id", grid.cell_at(F.col("x"), F.col("y"))), "cell_id").withColumn("d2", d2).where(F.col("d2") <= reach * reach)
        found = written(met.select(*own, "_key", "d2").withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k))
        full = found.where(F.col("rank") == k).select(*(F.col(c).alias(f"_{c}") for c in own))
        part = found if reach >= farthest else found.join(full, same, "left_semi")
        out = part if out is None else out.unionByName(part)
        if reach >= farthest:
            break
        rest = written(rest.join(full, same, "left_anti"))
        if rest.isEmpty():
            break
        reach *= 2
    return out.select(*own, F.col("_key").alias(key), "d2", "rank")


def _nearest(queries, k, key):
    def run(batches):
        q = np.array(queries, np.int64).reshape(-1, 3)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
        for batch in batches:
            ids, x, y = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            for i, (_, px, py) in enumerate(q):
                d = np.concatenate((best[i][0], (x - px) ** 2 + (y - py) ** 2))
                own = np.concatenate((best[i][1], ids))
                if len(d) > k:
                    cut = np.partition(d, k - 1)[k - 1]
                    at = np.flatnonzero(d <= cut)
                    at = at[np.lexsort((own[at], d[at]))[:k]]
                    d, own = d[at], own[at]
                best[i] = (d, own)
        for i in range(len(q)):
            d, own = best[i]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), q[i, 0])), pa.array(own), pa.array(d)], ["query_id", key, "d2"])

    return run

"""Partitioning of the plane: uniform grids, sample-balanced (STR) cells, and the assignment of boxes to cells.

A box is replicated to each cell that it overlaps (one without area counts as one by one); one that lies outside all cells
goes to cell -1. ``is_home`` marks the one copy in the cell of the box's own corner, so counts need no distinct.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, div


def partition_count(size_bytes: int, block_bytes: int, overhead: float = 0.1) -> int:
    return max(1, math.ceil(size_bytes * (1 + overhead) / block_bytes))


class Cells:
    """What a grid and STR cells have in common: cell ids, column after column, and bounds."""

    def bounds(self) -> list[tuple[int, int, int, int, int]]:
        """(cell_id, x, y, width, height) of every cell."""
        raise NotImplementedError

    def column(self, x: Column) -> Column:
        raise NotImplementedError

    def row(self, column: Column, y: Column) -> Column:
        raise NotImplementedError

    def cell_at(self, x: Column, y: Column) -> Column:
        """The id of the cell that holds a point; one before the first edges counts as on them."""
        low, _ = _extent(self)
        c = self.column(F.greatest(x, F.lit(low[0])))
        return self.cell_id(c, self.row(c, F.greatest(y, F.lit(low[1]))))

    def cell_id(self, column: Column, row: Column) -> Column:
        raise NotImplementedError

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.bounds(), "cell_id long, x long, y long, width long, height long")

    def overlapping(self, x: int, y: int, width: int, height: int) -> list[int]:
        """Ids of the cells that a box overlaps, on the driver: the index has a row for each cell only."""
        return [i for i, cx, cy, w, h in self.bounds() if cx + w > x and x + width > cx and cy + h > y and y + height > cy]


@dataclass(frozen=True)
class Grid(Cells):
    x: int
    y: int
    width: int
    height: int
    cols: int = 1
    rows: int = 1

    @classmethod
    def of(cls, x: int, y: int, width: int, height: int, cells: int) -> Grid:
        """At least so many cells. Cuts go one by one to the longer side of a cell (in whole units, the height where they are alike) until there are enough.

        The sides that the cuts meet are width // 1, width // 2, ... and the like for the height, so the cuts' order is
        that of these numbers, falling.
        """
        count = np.arange(1, max(2, cells + 1))
        side = np.concatenate((height // count, width // count))
        across = np.repeat([0, 1], len(count))
        across = across[np.argsort(-side, kind="stable")]  # of equal sides, the height comes first
        cols, rows = 1 + np.cumsum(across), 1 + np.cumsum(1 - across)
        first = int(np.argmax(cols * rows >= cells))
        return cls(x, y, width, height, 1, 1) if cells <= 1 else cls(x, y, width, height, int(cols[first]), int(rows[first]))

    @classmethod
    def parse(cls, text: str) -> Grid:
        return cls(*map(int, text.split(",")))

    def text(self) -> str:
        return f"{self.x},{self.y},{self.width},{self.height},{self.cols},{self.rows}"

    def bounds(self):
        xs = [self.x + self.width * i // self.cols for i in range(self.cols + 1)]
        ys = [self.y + self.height * i // self.rows for i in range(self.rows + 1)]
        return [(c * self.rows + r, xs[c], ys[r], xs[c + 1] - xs[c], ys[r + 1] - ys[r]) for c in range(self.cols) for r in range(self.rows)]

    def column(self, x):
        return div((x - self.x + 1) * self.cols - 1, self.width).cast("int")

    def cell_id(self, column, row):
        return column.cast("bigint") * self.rows + row

    def row(self, column, y):
        return div((y - self.y + 1) * self.rows - 1, self.height).cast("int")


@dataclass(frozen=True)
class Packed(Cells):
    """Columns of cells at sample quantiles of x, each cut at its own sample quantiles of y."""

    x_edges: tuple[int, ...]
    y_edges: tuple[tuple[int, ...], ...]

    @classmethod
    def of(cls, sample: list[tuple[int, int]], x: int, y: int, width: int, height: int, cells: int) -> Packed:
        """From a bounded sample of points: quantiles of x, and of y within each column; equal edges are one."""
        shape = Grid.of(x, y, width, height, cells)
        px, py = np.array(sample, np.int64).reshape(-1, 2).T

        def edges(values, parts, low, high):
            inner = np.quantile(values, np.arange(1, parts) / parts, method="inverted_cdf").astype(np.int64) if len(values) else []
            return tuple(sorted({low, high, *(int(v) for v in inner if low < v < high)}))

        x_edges = edges(px, shape.cols, x, x + width)
        column = np.searchsorted(x_edges, px, side="right") - 1
        return cls(x_edges, tuple(edges(py[column == c], shape.rows, y, y + height) for c in range(len(x_edges) - 1)))

    @property
    def first(self) -> list[int]:
        """The id of each column's first cell."""
        out = [0]
        for e in self.y_edges:
            out.append(out[-1] + len(e) - 1)
        return out

    def bounds(self):
        return [(f + r, self.x_edges[c], e[r], self.x_edges[c + 1] - self.x_edges[c], e[r + 1] - e[r]) for c, (f, e) in enumerate(zip(self.first, self.y_edges, strict=False)) for r in range(len(e) - 1)]

    def column(self, x):
        edges = F.array(*(F.lit(e) for e in self.x_edges))
        return F.size(F.filter(edges, lambda e: e <= x)) - 1

    def row(self, column, y):
        edges = F.element_at(F.array(*(F.array(*(F.lit(v) for v in e)) for e in self.y_edges)), column + 1)
        return F.size(F.filter(edges, lambda e: e <= y)) - 1

    def cell_id(self, column, row):
        return F.element_at(F.array(*(F.lit(f).cast("bigint") for f in self.first)), column + 1) + row


def assign(df: DataFrame, cells: Cells, box: Box | None = None) -> DataFrame:
    """``df`` with ``cell_id`` and ``is_home``, a row for each cell that the row's box overlaps. No join, no shuffle."""
    box = box or Box()
    if clash := {"cell_id", "is_home"} & set(df.columns):
        raise ValueError(f"rename the columns {sorted(clash)}: cells are given in columns of that name")
    low, high = _extent(cells)
    w, h = F.greatest(box.width, F.lit(1)), F.greatest(box.height, F.lit(1))
    inside = (box.x < high[0]) & (box.x + w > low[0]) & (box.y < high[1]) & (box.y + h > low[1])
    x1, x2 = F.greatest(box.x, F.lit(low[0])), F.least(box.x + w - 1, F.lit(high[0] - 1))
    y1, y2 = F.greatest(box.y, F.lit(low[1])), F.least(box.y + h - 1, F.lit(high[1] - 1))
    columns = F.when(inside, F.sequence(cells.column(x1), cells.column(x2))).otherwise(F.array(F.lit(-1)))
    out = df.withColumns({"_gridmill_y1": y1, "_gridmill_y2": y2, "_gridmill_home_x": x1, "_gridmill_inside": inside}).withColumn("_gridmill_col", F.explode(columns))
    rows = F.when(F.col("_gridmill_inside"), F.sequence(cells.row(F.col("_gridmill_col"), F.col("_gridmill_y1")), cells.row(F.col("_gridmill_col"), F.col("_gridmill_y2")))).otherwise(F.array(F.lit(-1)))
    out = out.withColumn("_gridmill_row", F.explode(rows))
    home = (F.col("_gridmill_col") == cells.column(F.col("_gridmill_home_x"))) & (F.col("_gridmill_row") == cells.row(F.col("_gridmill_col"), F.col("_gridmill_y1")))
    out = out.withColumns({"cell_id": F.when(F.col("_gridmill_inside"), cells.cell_id(F.col("_gridmill_col"), F.col("_gridmill_row"))).otherwise(F.lit(-1).cast("bigint")), "is_home": ~F.col("_gridmill_inside") | home})
    return out.drop("_gridmill_y1", "_gridmill_y2", "_gridmill_home_x", "_gridmill_inside", "_gridmill_col", "_gridmill_row")


def _extent(cells: Cells):
    if isinstance(cells, Grid):
        return (cells.x, cells.y), (cells.x + cells.width, cells.y + cells.height)
    return (cells.x_edges[0], cells.y_edges[0][0]), (cells.x_edges[-1], cells.y_edges[0][-1])


def mbr(df: DataFrame, box: Box | None = None) -> DataFrame:
    """One row x, y, width, height: the bounds of the data (nulls where there is none)."""
    box = box or Box()
    e = df.agg(F.min(box.x).alias("x"), F.min(box.y).alias("y"), F.max(box.x2).alias("x2"), F.max(box.y2).alias("y2"))
    return e.select("x", "y", (F.col("x2") - F.col("x")).alias("width"), (F.col("y2") - F.col("y")).alias("height"))


def grid_for(df: DataFrame, cells: int, box: Box | None = None) -> Grid:
    r = mbr(df, box).first()
    return Grid.of(r.x or 0, r.y or 0, max(1, r.width or 1), max(1, r.height or 1), cells)


def packed_for(df: DataFrame, cells: int, box: Box | None = None, sample: int = 10_000, seed: int = 1) -> Packed:
    """STR cells from at most about ``sample`` points, picked by a seeded hash."""
    box = box or Box()
    r = df.agg(F.count("*").alias("n")).first()
    m = mbr(df, box).first()
    step = max(1, r.n // sample)
    picked = df.select(box.x.alias("x"), box.y.alias("y")).where(F.pmod(F.xxhash64("x", "y", F.lit(seed)), F.lit(step)) == 0).limit(2 * sample).collect()
    return Packed.of([(p.x, p.y) for p in picked], m.x or 0, m.y or 0, max(1, m.width or 1), max(1, m.height or 1), cells)


#: Rows of the larger side that a cell of a join's grid holds on average.
ROWS_PER_CELL = 64


def grid_for_join(left: DataFrame, right: DataFrame, left_box: Box | None = None, right_box: Box | None = None, rows_per_cell: int = ROWS_PER_CELL, flat: bool = False) -> Grid:
    """A grid over both sides, fine enough for short lists in its cells and on each axis no finer than the mean box of the side with the larger ones; ``flat``: as fine as that on y before x is cut."""
    got = []
    for df, box in ((left, left_box or Box()), (right, right_box or Box())):
        got.append(df.agg(F.count("*").alias("n"), F.min(box.x).alias("x"), F.min(box.y).alias("y"), F.max(box.x2).alias("x2"), F.max(box.y2).alias("y2"), F.avg(box.width).alias("w"), F.avg(box.height).alias("h")).first())
    full = [r for r in got if r.n]
    if not full:
        return Grid(0, 0, 1, 1)
    x, y = min(r.x for r in full), min(r.y for r in full)
    width, height = max(1, max(r.x2 for r in full) - x), max(1, max(r.y2 for r in full) - y)
    across, along = max(1.0, *(r.w for r in full)), max(1.0, *(r.h for r in full))
    cells = max(1, max(r.n for r in full) // rows_per_cell)
    shape = cells / max(1, min(cells, int(height / along))) if flat else math.sqrt(cells * width / height)
    return Grid(x, y, width, height, max(1, min(int(shape), int(width / across))), max(1, min(int(cells / max(1.0, shape)), int(height / along))))

"""Spatial joins on overlap. All of them meet in cells, by an equi-join that Spark can split where a cell is crowded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geometry import Box
from .grid import ROWS_PER_CELL, Cells, Grid, _extent, grid_for_join
from .index import Index

#: Cell pairs that may be broadcast: a bound on the index tables, checked on the driver.
MAX_PAIRS = 1_000_000
#: Rows of the larger side in a cell that is swept, on average.
SWEEP_ROWS = 2000
#: Rows that are swept at once, about, and pairs that are looked at and given at once.
SWEEP_AT_ONCE = 50_000
PAIRS_AT_ONCE = 500_000
#: Rows that are dealt to cells at once, about.
DEALT_AT_ONCE = 100_000


def _named(df: DataFrame, side: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{side}_{c}") for c in df.columns])


def _box(side: str) -> Box:
    return Box(*(f"{side}_{c}" for c in ("x", "y", "width", "height")))


def spatial_join(left: DataFrame, right: DataFrame, cells: Cells | None = None, left_box: Box | None = None, right_box: Box | None = None, columns: list[str] | None = None) -> DataFrame:
    """Pairs of overlapping rows, columns named l_* and r_* (those in ``columns``, by default all): both sides replicated to cells, each pair kept in one cell only.

    Without cells, a grid is laid by the sides' sizes. True duplicates in the inputs give pairs of their own. Given cells
    are cut and carried on as :func:`_laid` says, so crowded ones are not searched row against row and nothing is beyond them.
    """
    left, right = _flat(left, left_box), _flat(right, right_box)
    return _met(left, right, _laid(left, right, cells, ROWS_PER_CELL), columns)


def _laid(left: DataFrame, right: DataFrame, cells: Cells | None, rows_per_cell: int, flat: bool = False) -> Grid:
    """A grid over both sides. A given grid's edges stay edges where its cells are larger than the sides' sizes ask for: each is cut in equal parts, and as many of these follow on each side as the shapes reach."""
    fine = grid_for_join(left, right, rows_per_cell=rows_per_cell, flat=flat)
    if not isinstance(cells, Grid):
        return fine
    x, width, cols = _carried_on(cells.x, cells.width, cells.cols, fine.x, fine.width, fine.cols)
    y, height, rows = _carried_on(cells.y, cells.height, cells.rows, fine.y, fine.height, fine.rows)
    return Grid(x, y, width, height, cols, rows)


def _carried_on(start: int, size: int, n: int, low: int, extent: int, fine: int) -> tuple[int, int, int]:
    """Start, size and number of cells on one axis: those given, cut and carried on, or the fine ones if these are larger."""
    if size * fine <= extent * n:
        return low, extent, fine
    cut = n * -(-size * fine // (extent * n))
    before, after = max(0, -((low - start) // size)), max(0, -((start + size - low - extent) // size))
    return start - before * size, (before + 1 + after) * size, (before + 1 + after) * cut


def _edges(cells: Grid) -> tuple[np.ndarray, np.ndarray]:
    return np.array([cells.x + cells.width * c // cells.cols for c in range(cells.cols + 1)], np.int64), np.array([cells.y + cells.height * r // cells.rows for r in range(cells.rows + 1)], np.int64)


def _dealt(df: DataFrame, cells: Grid, side: str, columns: list[str] | None = None, part: Box | None = None) -> DataFrame:
    """Rows of a side with a row for each cell that the box overlaps (its ``part`` only, if one is given), in ``cell_id``.

    ``_gridmill_l`` or ``_gridmill_r`` tells where the box begins in the cell: 1 on x, 2 on y, 3 on both. Of the other
    columns those in ``columns`` are kept, by default all. Whole batches are dealt, by the cells' edges.
    """
    box = _box(side)
    at = {f"_gridmill_{side}{n}": c.cast("bigint") for n, c in (("x", box.x), ("y", box.y), ("w", box.width), ("h", box.height))}
    parts = {} if part is None else {f"_gridmill_part_{n}": c for n, c in (("x", part.x), ("y", part.y), ("x2", part.x2), ("y2", part.y2))}
    kept = [c for c in df.columns if columns is None or c in columns]
    rows = df.select(*kept, *(c.alias(n) for n, c in {**at, **parts}.items())).dropna(subset=list(at))
    out = StructType([f for f in rows.schema.fields if f.name not in parts]).add("cell_id", "long").add(f"_gridmill_{side}", "byte")
    box_names, part_names, names = list(at), list(parts), out.names

    def deal(batches):
        x_edges, y_edges = _edges(cells)
        for batch in batches:
            x, y, w, h = (batch.column(n).to_numpy(zero_copy_only=False) for n in box_names)
            low, high = [np.maximum(x, x_edges[0]), np.maximum(y, y_edges[0])], [np.minimum(x + np.maximum(w, 1), x_edges[-1]) - 1, np.minimum(y + np.maximum(h, 1), y_edges[-1]) - 1]
            begins = [np.ones(len(x), bool)] * 2
            if part_names:
                from_x, from_y, to_x, to_y = (batch.column(n).to_numpy(zero_copy_only=False) for n in part_names)
                begins = [low[0] >= from_x, low[1] >= from_y]
                low, high = [np.maximum(low[0], from_x), np.maximum(low[1], from_y)], [np.minimum(high[0], to_x - 1), np.minimum(high[1], to_y - 1)]
            here = np.flatnonzero((low[0] <= high[0]) & (low[1] <= high[1]))
            col, row = (np.searchsorted(e, v[here], side="right") - 1 for e, v in zip((x_edges, y_edges), low, strict=True))
            cols, rows_ = (np.searchsorted(e, v[here], side="right") - c for e, v, c in zip((x_edges, y_edges), high, (col, row), strict=True))
            upto = np.cumsum(cols * rows_)
            cuts = [0, *(np.searchsorted(upto, np.arange(DEALT_AT_ONCE, upto[-1], DEALT_AT_ONCE)) + 1).tolist(), len(here)] if len(here) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                n, tall = (cols[a:b] * rows_[a:b]), rows_[a:b]
                of = np.repeat(np.arange(b - a), n)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                i, j = nth // tall[of], nth % tall[of]
                own = (begins[0][here[a:b]][of] & (i == 0)) + 2 * (begins[1][here[a:b]][of] & (j == 0)).astype(np.int8)
                cell = (col[a:b][of] + i) * cells.rows + row[a:b][of] + j
                picked = pa.array(here[a:b][of])
                yield pa.RecordBatch.from_arrays([*(batch.column(name).take(picked) for name in names[:-2]), pa.array(cell.astype(np.int64)), pa.array(own.astype(np.int8))], names=names)

    return rows.mapInArrow(deal, out)


def _met(left: DataFrame, right: DataFrame, cells: Grid, columns: list[str] | None = None) -> DataFrame:
    return _meet(_dealt(_named(left, "l"), cells, "l", columns), _dealt(_named(right, "r"), cells, "r", columns), ["cell_id"])


def _meet(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping pairs of dealt rows, each in the one cell where the later beginning lies on both axes.

    Both sides are sorted, at any size: a cell's rows are then looked through one after another in memory.
    """
    pairs = a.hint("merge").join(b.hint("merge"), keys).where(F.col("_gridmill_l").bitwiseOR(F.col("_gridmill_r")) == 3)
    l, r = (Box(*(f"_gridmill_{side}{n}" for n in "xywh")) for side in "lr")
    return pairs.where(l.overlaps(r)).select([c for c in (*a.columns, *b.columns) if c not in keys and not c.startswith("_gridmill_")])


def _with_beyond(met: DataFrame, left: DataFrame, right: DataFrame, within: Column, columns: list[str] | None = None) -> DataFrame:
    """``met``, the pairs of shapes ``within`` some bounds, and those of which one shape or both reach beyond."""
    for a, b, beyond in ((left.where(~within), right, left), (left.where(within), right.where(~within), right)):
        if not beyond.where(~within).isEmpty():
            met = met.unionByName(spatial_join(a, b, columns=columns))
    return met


def _flat(df: DataFrame, box: Box | None) -> DataFrame:
    return df if box is None else df.withColumns(dict(zip(("x", "y", "width", "height"), (box.x, box.y, box.width, box.height), strict=True)))


def cell_pairs(left: Cells, right: Cells, most: int | None = None) -> list[tuple[int, int]] | None:
    """Overlapping cells of two indexes, by a sweep over x; nothing as soon as there are more than ``most``."""
    a, b, out, active = sorted(left.bounds(), key=lambda c: c[1]), sorted(right.bounds(), key=lambda c: c[1]), [], []
    k = 0
    for c in a:
        while k < len(b) and b[k][1] < c[1] + c[3]:
            active.append(b[k])
            k += 1
        active = [d for d in active if d[1] + d[3] > c[1]]
        out += [(c[0], d[0]) for d in active if c[2] + c[4] > d[2] and d[2] + d[4] > c[2] and d[1] < c[1] + c[3]]
        if most is not None and len(out) > most:
            return None
    return sorted(out)


def _within(left: Cells, right: Cells, box: Box) -> Column:
    """Whether a box lies wholly in the bounds that both sides' cells cover."""
    (low, high), (r_low, r_high) = _extent(left), _extent(right)
    w, h = F.greatest(box.width, F.lit(1)), F.greatest(box.height, F.lit(1))
    return (box.x >= max(low[0], r_low[0])) & (box.x + w <= min(high[0], r_high[0])) & (box.y >= max(low[1], r_low[1])) & (box.y + h <= min(high[1], r_high[1]))


def distributed_join(spark: SparkSession, left: Index, right: Index, columns: list[str] | None = None) -> DataFrame:
    """Pairs of overlapping rows of two indexes, met through the table of overlapping cells (``columns``: those of the result that are wanted, by default all).

    Within a pair of cells, rows meet in the cells of a fine grid, so that large cells are not searched row against row.
    Shapes that reach beyond the cells of either index are joined by themselves, on a grid over both sides.
    """
    pairs = cell_pairs(left.cells, right.cells, MAX_PAIRS)
    if pairs is None:
        return spatial_join(left.home(spark), right.home(spark), columns=columns)
    # What two cells have in common, by number: rows are dealt within it only, so a row is not repeated for each other cell.
    bounds = [{c: (x, y, x + w, y + h) for c, x, y, w, h in cells.bounds()} for cells in (left.cells, right.cells)]
    common = [(c, d, n, *map(max, bounds[0][c][:2], bounds[1][d][:2]), *map(min, bounds[0][c][2:], bounds[1][d][2:])) for n, (c, d) in enumerate(pairs)]
    table = F.broadcast(spark.createDataFrame(common or [(-2, -2, 0, 0, 0, 0, 0)], "l_own long, r_own long, _pair long, _x long, _y long, _x2 long, _y2 long"))
    within = _within(left.cells, right.cells, Box())
    a, b = left.home(spark), right.home(spark)
    fine = grid_for_join(a, b)
    part = Box("_x", "_y", F.col("_x2") - F.col("_x"), F.col("_y2") - F.col("_y"))
    dealt = []
    for side, index, home in (("l", left, a), ("r", right, b)):
        rows = _named(index.data(spark).drop("is_home").withColumnRenamed("cell_id", "own").where(within), side).join(table, f"{side}_own")
        wanted = [f"{side}_{c}" for c in home.columns if columns is None or f"{side}_{c}" in columns]
        rows = _dealt(rows, fine, side, [*wanted, "_pair"], part)
        dealt.append(rows.withColumn("cell_id", F.col("_pair") * (fine.cols * fine.rows) + F.col("cell_id")).drop("_pair"))
    return _with_beyond(_meet(*dealt, ["cell_id"]), a, b, within, columns)


def should_repartition(left: Cells, right: Cells) -> bool:
    """Whether dealing the side with fewer cells by the other's cells costs less than reading all pairs of cells."""
    small, large = sorted((len(left.bounds()), len(right.bounds())))
    pairs = cell_pairs(left, right, 3 * small + large)
    return pairs is None


def join_indexed(spark: SparkSession, left: Index, right: Index, repartition: str = "auto", columns: list[str] | None = None) -> DataFrame:
    """Pairs of two indexes; ``repartition``: auto, yes or no. Columns stay (left, right) whichever side is dealt anew."""
    if repartition == "yes" or (repartition == "auto" and should_repartition(left.cells, right.cells)):
        return spatial_join(left.home(spark), right.home(spark), columns=columns)
    return distributed_join(spark, left, right, columns)


def plane_sweep(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in two sets of boxes (cell, x, y, width, height) that overlap in one cell, by a sweep over x, in blocks: each box meets the others that begin within it, of which those apart in y are left out."""
    sides = []
    for cell, x, y, w, h in (left, right):
        order = np.lexsort((x, cell))
        sides.append((order, cell[order], x[order], x[order] + w[order], y[order], y[order] + h[order]))
    (a_at, a_cell, ax, ax2, ay, ay2), (b_at, b_cell, bx, bx2, by, by2) = sides
    if not len(ax) or not len(bx):
        return
    # Cells lie beside each other on one axis, as far apart as no box reaches.
    low = min(int(ax.min()), int(bx.min()))
    span = max(int(ax2.max()), int(bx2.max())) - low + 1
    ids = np.unique(np.concatenate((a_cell, b_cell)))
    if span * len(ids) >= 1 << 62:
        for c in ids if len(ids) > 1 else ():
            i, j = np.flatnonzero(left[0] == c), np.flatnonzero(right[0] == c)
            for first, second in plane_sweep(tuple(v[i] for v in left), tuple(v[j] for v in right)):
                yield i[first], j[second]
        if len(ids) > 1:
            return
    a_off, b_off = np.searchsorted(ids, a_cell) * span - low, np.searchsorted(ids, b_cell) * span - low
    # Boxes without width begin in another without lying over it.
    narrow = bool((ax2 <= ax).any() or (bx2 <= bx).any())
    # A pair's later beginning lies within the other box: of the left sides' (a tie counts here), then of the right ones'.
    for begin, end, other, tie, swap in ((ax + a_off, ax2 + a_off, bx + b_off, "left", False), (bx + b_off, bx2 + b_off, ax + a_off, "right", True)):
        first = np.searchsorted(other, begin, side=tie)
        n = np.maximum(0, np.searchsorted(other, end, side="left") - first)
        upto = np.cumsum(n)
        cuts = np.unique(np.concatenate(([0], np.searchsorted(upto, np.arange(PAIRS_AT_ONCE, int(upto[-1]), PAIRS_AT_ONCE)), [len(n)])))
        for k, m in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part, total = n[k:m], int(n[k:m].sum())
            one = np.repeat(np.arange(k, m), part)
            two = np.arange(total) + np.repeat(first[k:m] - (np.cumsum(part) - part), part)
            i, j = (two, one) if swap else (one, two)
            meet = (ay2[i] > by[j]) & (by2[j] > ay[i])
            if narrow:
                meet &= (ax2[i] > bx[j]) & (bx2[j] > ax[i])
            meet = np.flatnonzero(meet)
            yield a_at[i[meet]], b_at[j[meet]]


def sweep_join(left: DataFrame, right: DataFrame, cells: Cells | None = None, columns: list[str] | None = None) -> DataFrame:
    """As :func:`spatial_join`, by a plane sweep within each cell; ``columns``: those of the result that are wanted, by default all.

    The shapes of one cell are in one task's memory, their pairs are not: these are given in blocks. Cells are strips along x, as
    what is swept together but apart in y is looked at in vain.
    """
    return _swept(left, right, _laid(left, right, cells, SWEEP_ROWS, flat=True), columns)


def _swept(left: DataFrame, right: DataFrame, cells: Grid, columns: list[str] | None = None) -> DataFrame:
    named = {"l": _named(left, "l"), "r": _named(right, "r")}
    fields = [f for d in named.values() for f in d.schema.fields if columns is None or f.name in columns]
    both = None
    for side, df in named.items():
        at = [F.col(f"_gridmill_{side}{n}").alias(f"_gridmill_{n}") for n in ("x", "y", "w", "h")]
        rest = [F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        rows = _dealt(df, cells, side, columns).select("cell_id", F.lit(side == "r").alias("_gridmill_right"), F.col(f"_gridmill_{side}").alias("_gridmill_begins"), *at, *rest)
        both = rows if both is None else both.unionByName(rows)
    names = [f.name for f in fields]
    ours = [n in named["l"].columns for n in names]

    def pairs(table: pa.Table):
        right = table.column("_gridmill_right").to_numpy()
        tables, boxes, begins = [], [], []
        for side in (~right, right):
            t = table.filter(pa.array(side)).combine_chunks()
            boxes.append(tuple(t.column(n).to_numpy() for n in ("cell_id", "_gridmill_x", "_gridmill_y", "_gridmill_w", "_gridmill_h")))
            begins.append(t.column("_gridmill_begins").to_numpy())
            tables.append([t.column(n).combine_chunks() for n, own in zip(names, ours, strict=True) if own == (len(tables) == 0)])
        for i, j in plane_sweep(*boxes):
            # A pair is kept in the one cell where the later beginning lies on both axes.
            home = np.flatnonzero((begins[0][i] | begins[1][j]) == 3)
            for k in range(0, len(home), 100_000):
                picked = [pa.array(v[home[k : k + 100_000]]) for v in (i, j)]
                yield pa.RecordBatch.from_arrays([c.take(at) for t, at in zip(tables, picked, strict=True) for c in t], names=names)

    def run(batches):
        held, n, enough = [], 0, SWEEP_AT_ONCE
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n < enough:
                continue
            table = pa.Table.from_batches(held)
            cell = table.column("cell_id").to_numpy()
            # All but the last cell are whole; a large one is looked at again when it is twice as long.
            whole = int(np.searchsorted(cell, cell[-1]))
            if whole:
                yield from pairs(table.slice(0, whole))
            held, n = table.slice(whole).to_batches(), n - whole
            enough = max(SWEEP_AT_ONCE, 2 * n)
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return both.repartition("cell_id").sortWithinPartitions("cell_id").mapInArrow(run, StructType(fields))

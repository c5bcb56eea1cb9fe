"""Spatial indexes: data as Parquet partitioned by cell, sorted in Z-order within each, and a small table of cells beside it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geometry import Box, morton
from .grid import Cells, Grid, Packed, assign, grid_for, packed_for


@dataclass(frozen=True)
class Index:
    path: str
    cells: Cells
    #: The stored columns, as JSON: known even where no file is.
    schema: str

    def data(self, spark: SparkSession, cell_ids: list[int] | None = None) -> DataFrame:
        """All copies of all shapes, or those of some cells; other cells' folders are not read."""
        df = spark.read.schema(StructType.fromJson(json.loads(self.schema))).parquet(f"{self.path}/data")
        return df if cell_ids is None else df.where(F.col("cell_id").isin([-1, *cell_ids]))

    def pruned(self, spark: SparkSession, keep: Callable[[list[tuple[int, int, int, int, int]]], Iterable[int]]) -> DataFrame:
        """The data of the cells that a filter of one's own keeps: it gets (cell_id, x, y, width, height) of all and gives ids."""
        return self.data(spark, list(keep(self.cells.bounds())))

    def home(self, spark: SparkSession) -> DataFrame:
        """Each shape once."""
        return self.data(spark).where("is_home").drop("cell_id", "is_home")


def build(df: DataFrame, path: str, cells: int | Cells = 16, kind: str = "grid", box: Box | None = None, records_per_file: int = 5_000_000) -> Index:
    """Write an index. ``cells``: how many, or another index's cells, so that both are partitioned alike. ``kind``: grid or str."""
    box = box or Box()
    if isinstance(cells, int):
        cells = (packed_for if kind == "str" else grid_for)(df, cells, box)
    # Dealt by cell and, within it, by Z-order, so that a crowded cell is written by several tasks.
    out = assign(df, cells, box).withColumn("_z", morton(box.x, box.y))
    out = out.repartition("cell_id", F.pmod(F.xxhash64(F.shiftright("_z", 16)), F.lit(8))).sortWithinPartitions("cell_id", "_z").drop("_z")
    out.write.option("maxRecordsPerFile", records_per_file).partitionBy("cell_id").parquet(f"{path}/data")
    kind = "grid:" + cells.text() if isinstance(cells, Grid) else "str"
    schema = out.select([c for c in out.columns if c != "cell_id"] + ["cell_id"]).schema.json()
    cells.frame(df.sparkSession).withColumns({"kind": F.lit(kind), "schema": F.lit(schema)}).write.parquet(f"{path}/_cells")
    return Index(path, cells, schema)


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/_cells").orderBy("cell_id").collect()
    if rows[0].kind.startswith("grid:"):
        return Index(path, Grid.parse(rows[0].kind[5:]), rows[0].schema)
    xs = sorted({r.x for r in rows})
    edges = tuple(tuple(sorted({r.y for r in rows if r.x == x} | {max(r.y + r.height for r in rows if r.x == x)})) for x in xs)
    return Index(path, Packed((*xs, max(r.x + r.width for r in rows)), edges), rows[0].schema)


def describe(spark: SparkSession, index: Index) -> DataFrame:
    """Each cell, its bounds, and its number of rows and of shapes whose home it is, in the order of cells."""
    counts = index.data(spark).groupBy("cell_id").agg(F.count("*").alias("n_rows"), F.sum(F.col("is_home").cast("bigint")).alias("n_home"))
    return index.cells.frame(spark).join(counts, "cell_id", "left").na.fill(0, ["n_rows", "n_home"]).orderBy("cell_id")

"""Sorting, partitioning and order checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import sort_columns
from ..scratch import shared_path


def key_sort(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Rows with equal keys in one partition, each partition sorted: what a shuffle gives its reducers."""
    out = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return out.sortWithinPartitions(*keys)


def secondary_sort(df: DataFrame, group: str, order: str) -> DataFrame:
    """Rows grouped by one column and sorted by another within, with ``position`` in the group."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def sort_by_spec(df: DataFrame, spec: str, key: str = "key", separator: str = "\t") -> DataFrame:
    """Globally sorted by a ``-k`` spec; ties by the whole key."""
    return df.orderBy(*sort_columns(key, spec, separator), F.col(key))


def total_order(df: DataFrame, *keys: str | Column) -> DataFrame:
    """A global sort: ranges of the key from a sample, each sorted by itself."""
    return df.orderBy(*keys)


def numbered(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows in a global order, with their place from 1 in ``name``. Ranges are sorted and numbered by themselves; only their sizes meet.

    The ranges are written to the shared folder once, so that sizes and rows come from the same ones.
    """
    if name in df.columns:
        raise ValueError(f"the table has a column {name}: give another name for the places")

    def number(batches):
        done = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(done + 1, done + 1 + batch.num_rows))], [*batch.schema.names, name])
            done += batch.num_rows

    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_gridmill_range", F.spark_partition_id())
    path = shared_path(df.sparkSession, "numbered")
    ranged.mapInArrow(number, StructType([*ranged.schema.fields, StructField(name, LongType())])).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    before, total = [], 0
    for p, n in sorted(map(tuple, rows.groupBy("_gridmill_range").count().collect())):
        before.append(F.struct(F.lit(p), F.lit(total).cast("bigint")))
        total += n
    if not before:
        return rows.drop("_gridmill_range")
    return rows.withColumn(name, F.col(name) + F.element_at(F.map_from_entries(F.array(*before)), F.col("_gridmill_range"))).drop("_gridmill_range")


def order_errors(df: DataFrame, key: str, position: str) -> DataFrame:
    """Rows, in the order of ``position``, whose key is below the one before.

    Ranges of positions are checked by themselves, then their edges against each other, so no task sees all rows.
    """
    step = 100_000
    block = F.floor(F.col(position) / step)
    w = Window.partitionBy("_block").orderBy(position)
    rows = df.withColumn("_block", block).withColumn("_before", F.lag(key).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = rows.groupBy("_block").agg(F.max_by(key, position).alias("_edge")).withColumn("_block", F.col("_block") + 1)
    rows = rows.join(last, "_block", "left").withColumn("_before", F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_before")))
    return rows.where(F.col(key) < F.col("_before")).drop("_block", "_before", "_first", "_edge")


def inverse(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    return df.select(F.col(value).alias(key), F.col(key).alias(value))

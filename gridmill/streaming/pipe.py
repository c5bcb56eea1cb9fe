"""Records through external programs: lines to a program's standard input, its standard output as lines again."""

from __future__ import annotations

import os
import subprocess
import threading

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_value, key_value_line

#: The reducer's name for the built-in aggregates.
AGGREGATE = "aggregate"


def _run(command: list[str], env: dict[str, str]):
    def run(batches):
        with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=os.environ | env) as p:
            failure = []

            def feed():
                try:
                    with p.stdin as out:
                        for batch in batches:
                            for line in batch.column(0).to_pylist():
                                if line is not None:
                                    out.write(line.encode() + b"\n")
                except BrokenPipeError:
                    pass  # the program has read enough
                except Exception as e:  # told by the reading thread
                    failure.append(e)

            thread = threading.Thread(target=feed, daemon=True)
            thread.start()
            lines = []
            for raw in p.stdout:
                lines.append(raw.rstrip(b"\n").decode("utf-8", "replace"))
                if len(lines) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
                    lines = []
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
            thread.join()
            if failure:
                raise failure[0]
            if p.wait():
                raise RuntimeError(f"{command[0]} ended with status {p.returncode}")

    return run


def pipe(lines: DataFrame, command: list[str], value: str = "value", env: dict[str, str] | None = None) -> DataFrame:
    """Each partition's lines through one run of the program. A program that fails fails the task, which is then run again."""
    return lines.select(F.col(value).cast("string").alias("value")).mapInArrow(_run(command, env or {}), "value string")


def map_reduce(lines: DataFrame, mapper: list[str], reducer: list[str] | str | None = None, separator: str = "\t", key_fields: int = 1, partitions: int | None = None, env: dict[str, str] | None = None, combiner: list[str] | None = None, partition_fields: int | None = None) -> DataFrame:
    """A mapper, a shuffle by the first fields of its lines, and a reducer that sees its lines sorted by key.

    The reducer ``aggregate`` takes lines ``type:id<sep>value`` and gives ``id<sep>aggregate``. A ``combiner`` sees each
    task's own lines in the same order before they are shuffled. ``partition_fields``, where given, deals lines by fewer
    fields than ``key_fields`` sorts them by.
    """
    out = pipe(lines, mapper, env=env)
    if reducer is None:
        return out
    if reducer == AGGREGATE:
        from ..operators.aggregates import keyed

        key, value = key_value("value", separator)
        rows = out.select(F.substring_index(key, ":", 1).alias("type"), _after_colon(key).alias("id"), value.alias("value"))
        return keyed(rows).select(key_value_line("id", "value", separator).alias("value"))
    key = F.substring_index("value", separator, key_fields)
    if combiner:
        out = pipe(out.sortWithinPartitions(key, "value"), combiner, env=env)
    dealt = F.substring_index("value", separator, partition_fields or key_fields)
    shuffled = out.repartition(partitions, dealt) if partitions else out.repartition(dealt)
    return pipe(shuffled.sortWithinPartitions(key, "value"), reducer, env=env)


def _after_colon(key: Column) -> Column:
    return F.substring(key, F.instr(key, ":") + 1, F.length(key))

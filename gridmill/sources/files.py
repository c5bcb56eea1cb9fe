"""Readers and writers: text lines, keys and values, shapes, sequence files, XML, several inputs and outputs, databases."""

from __future__ import annotations

import datetime
import glob
import os
import zipfile
from collections.abc import Callable, Iterable
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..functions.text import key_value, key_value_line


def read_lines(spark: SparkSession, paths: str | list[str], max_length: int | None = None, glob: str | None = None) -> DataFrame:
    """``value``: the lines of text files, compressed or not; lines above max_length bytes are skipped."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    out = reader.text(paths)
    return out if max_length is None else out.where(F.octet_length("value") <= max_length)


def read_key_values(spark: SparkSession, paths: str | list[str], separator: str = "\t") -> DataFrame:
    key, value = key_value("value", separator)
    return spark.read.text(paths).select(key.alias("key"), value.alias("value"))


def write_key_values(df: DataFrame, path: str, key: str = "key", value: str = "value", separator: str = "\t", compression: str = "none") -> None:
    lines = df.select(key_value_line(key, value, separator).alias("value")).where("value is not null")
    lines.write.option("compression", compression).text(path)


def lines_in_groups(lines: DataFrame, n: int, order: str) -> DataFrame:
    """``split``: n lines to a split, by a dense integer column."""
    return lines.withColumn("split", F.floor(F.col(order) / n))


def read_sequence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Keys and values of a binary sequence file."""
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), schema)


def write_sequence(df: DataFrame, path: str) -> None:
    """Two columns as keys and values of a binary sequence file."""
    df.rdd.map(tuple).saveAsSequenceFile(path)


def xml_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """``value``: each stretch from a begin tag to its end tag, wherever lines and roots are. Files are split at end tags."""
    cut = spark.read.option("lineSep", f"</{tag}>").text(path)
    begin = F.regexp_extract("value", rf"(?s)<{tag}(?:\s[^>]*)?>.*$", 0)
    return cut.select(begin.alias("value")).where("value <> ''").select(F.concat("value", F.lit(f"</{tag}>")).alias("value"))


def read_xml(spark: SparkSession, path: str, tag: str, schema: str | None = None) -> DataFrame:
    """One row for each element of a tag; the schema follows from the first one where it isn't given."""
    records = xml_records(spark, path, tag)
    if schema is None:
        schema = spark.range(1).select(F.schema_of_xml(F.lit(records.first()[0]))).first()[0]
    return records.select(F.from_xml("value", schema).alias("r")).select("r.*")


def multiple_inputs(*inputs: tuple[DataFrame, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each input through its own mapper, then all together."""
    out = None
    for frame, mapper in inputs:
        part = mapper(frame)
        out = part if out is None else out.unionByName(part)
    return out


def write_routed(df: DataFrame, path: str, route: str, format: str = "parquet") -> None:
    """Each row to the folder of its route; a frequent route is written by several tasks."""
    df.write.partitionBy(route).format(format).save(path)


def write_named(df: DataFrame, outputs: dict[str, tuple[Column, str]], format: str = "parquet") -> None:
    """Rows that meet a condition to a path, for each named output."""
    for condition, path in outputs.values():
        df.where(condition).write.format(format).save(path)


def write_nowhere(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def sort_log(lines: DataFrame, pattern: str, columns: Iterable[int], separator: str = " ") -> DataFrame:
    """Lines that hold a pattern, sorted by some of their fields."""
    fields = F.split("value", separator)
    return lines.where(F.col("value").rlike(pattern)).orderBy(*(F.get(fields, F.lit(i)) for i in columns), "value")


def last_lines(lines: DataFrame, n: int, order: str) -> DataFrame:
    """The last n lines that are not empty."""
    return lines.where(F.length("value") > 0).orderBy(F.col(order).desc()).limit(n)


# Shapes as text lines.

def _number(c: Column, kind: str = "bigint") -> Column:
    return c.try_cast(kind)


def shape_batches(df: DataFrame, fn: Callable, schema: str, rows: int = 1_000_000) -> DataFrame:
    """Shapes in Arrow batches of at most ``rows`` through a function of one batch."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield fn(batch.slice(i, rows))

    return df.mapInArrow(run, schema)


def parse_shape(line: Column, kind: str) -> dict[str, Column]:
    """The columns of one shape line: point, rectangle, cell, circle, polygon, boundary."""
    f = F.split(line, ",")
    at = lambda i, k="bigint": _number(F.get(f, F.lit(i)), k)
    if kind == "point":
        return {"x": at(0), "y": at(1)}
    if kind == "rectangle":
        return {"x": at(0), "y": at(1), "width": at(2), "height": at(3)}
    if kind == "cell":
        return {"cell_id": at(0), "x": at(1), "y": at(2), "width": at(3), "height": at(4)}
    if kind == "circle":
        return {"cx": at(0, "double"), "cy": at(1, "double"), "r": at(2, "double")}
    if kind == "polygon":
        corners = F.transform(F.slice(f, 2, F.greatest(2 * at(0, "int"), F.lit(0))), lambda v: v.try_cast("int"))
        return {"xs": F.filter(corners, lambda v, i: i % 2 == 0), "ys": F.filter(corners, lambda v, i: i % 2 == 1)}
    if kind == "boundary":  # degrees, times 10^10
        scaled = lambda i: F.round(at(i, "decimal(20,12)") * F.lit(Decimal(10**10))).cast("bigint")
        x1, y1, x2, y2 = scaled(1), scaled(2), scaled(3), scaled(4)
        return {"id": at(0), "x": F.least(x1, x2), "y": F.least(y1, y2), "width": F.abs(x2 - x1), "height": F.abs(y2 - y1), "extra": F.array_join(F.slice(f, 6, 1000), ",")}
    if kind in SHAPES:
        return SHAPES[kind](line)
    raise ValueError(f"no shape {kind!r}")


#: Further shapes by name: a line to its columns.
SHAPES: dict[str, Callable[[Column], dict[str, Column]]] = {}


def infer_shape(line: str) -> str:
    """The kind of a sample line by its number of fields."""
    n = len(line.split(","))
    if n == 2:
        return "point"
    if n == 4:
        return "rectangle"
    if n > 4:
        return "boundary"
    raise ValueError("a shape line has two, four or more fields")


def read_shapes(spark: SparkSession, path: str | list[str], kind: str | None = None) -> DataFrame:
    """Shapes of text lines; the kind follows from the first line where it isn't given. Lines that don't parse give nulls."""
    lines = spark.read.text(path).where(F.length("value") > 0)
    if kind is None:
        kind = infer_shape(lines.first()[0])
    return lines.select(*(c.alias(n) for n, c in parse_shape(F.col("value"), kind).items()))


def shape_line(df: DataFrame, kind: str) -> Column:
    """A shape's line."""
    if kind == "polygon":
        corners = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.concat_ws(",", p["xs"].cast("string"), p["ys"].cast("string")))
        return F.concat_ws(",", F.size("xs").cast("string"), F.array_join(corners, ","))
    names = {"point": ("x", "y"), "rectangle": ("x", "y", "width", "height"), "cell": ("cell_id", "x", "y", "width", "height"), "circle": ("cx", "cy", "r")}[kind]
    return F.concat_ws(",", *(F.col(n).cast("string") for n in names))


def write_shapes(df: DataFrame, path: str, kind: str) -> None:
    df.select(shape_line(df, kind).alias("value")).write.text(path)


def random_shapes(spark: SparkSession, n: int, kind: str, x: int, y: int, width: int, height: int, max_size: int = 100, seed: int = 1) -> DataFrame:
    """n seeded random points, rectangles (sides of 1 to max_size, cut to the bounds) or polygons (3 to 5 corners)."""
    def draw(k, upto):
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), upto if isinstance(upto, Column) else F.lit(upto))

    df = spark.range(n).withColumns({"x": x + draw(1, width), "y": y + draw(2, height)})
    if kind == "point":
        return df
    w = F.least(1 + draw(3, max_size), x + width - F.col("x"))
    h = F.least(1 + draw(4, max_size), y + height - F.col("y"))
    if kind == "rectangle":
        return df.withColumns({"width": w, "height": h})
    corners = F.sequence(F.lit(1), (3 + draw(5, 3)).cast("int"))
    axis = lambda k, low, high: F.transform(corners, lambda i: F.least(F.col(low) + F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k), i), F.lit(max_size)), F.lit(high)).cast("int"))
    return df.withColumns({"xs": axis(6, "x", x + width), "ys": axis(7, "y", y + height)}).select("id", "xs", "ys")


def sort_rows(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Rows of the sort benchmark: a random ten-byte key, a ten-byte row id, and 78 bytes of filler."""
    letter = lambda i: F.chr((32 + F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(95))).cast("int"))
    filler = F.substring(F.repeat(F.chr((65 + F.pmod("id", F.lit(26))).cast("int")), 78), 1, 78)
    return spark.range(n).select(F.concat(*(letter(i) for i in range(10))).alias("key"), F.lpad(F.col("id").cast("string"), 10, " ").alias("row_id"), filler.alias("filler"))


def random_words(spark: SparkSession, n: int, words: list[str], per_line: int = 10, seed: int = 1) -> DataFrame:
    """Lines of words drawn from a list."""
    pick = lambda i: F.element_at(F.array(*map(F.lit, words)), (1 + F.pmod(F.xxhash64("id", F.lit(seed), i), F.lit(len(words)))).cast("int"))
    return spark.range(n).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(per_line)), pick), " ").alias("value"))


# Databases.

def split_ranges(low, high, n: int, column: str) -> list[str]:
    """Conditions that cut a column's values from low to high into n ranges, the last one closed; a null bound adds one for nulls."""
    if low is None or high is None:
        return [f"{column} IS NULL"] + ([] if low is None and high is None else split_ranges(low if low is not None else high, high if high is not None else low, n, column))
    points = split_points(low, high, n)
    quoted = [_quote(p) for p in points]
    return [f"{column} >= {a} AND {column} {'<=' if i == len(quoted) - 2 else '<'} {b}" for i, (a, b) in enumerate(zip(quoted, quoted[1:], strict=False))]


def _quote(v) -> str:
    return "'" + str(v).replace("'", "''") + "'" if isinstance(v, (str, datetime.date, datetime.datetime)) else str(v).upper() if isinstance(v, bool) else str(v)


def split_points(low, high, n: int) -> list:
    """n + 1 rising values from low to high: numbers, booleans, dates, timestamps, or texts (halved again and again)."""
    if isinstance(low, bool):
        return [low, high] if low == high else [False, True]
    if isinstance(low, str):
        points = [low, high]
        while len(points) < n + 1:
            inner = [_between(a, b) for a, b in zip(points, points[1:], strict=False)][: n + 1 - len(points)]
            if all(v is None for v in inner):
                break
            points = sorted({*points, *(v for v in inner if v is not None)})
        return points
    if isinstance(low, (datetime.date, datetime.datetime)):
        step = (high - low) / n
        return [low, *dict.fromkeys(p for i in range(1, n) if low < (p := low + step * i) < high), high]
    if isinstance(low, int):
        return [low, *dict.fromkeys(p for i in range(1, n) if low < (p := low + (high - low) * i // n) < high), high]
    return [low + (high - low) * i / n for i in range(n)] + [high]


def _between(low: str, high: str) -> str | None:
    """A short text above ``low`` and below ``high``, if there is one: half way at the first place where there is room."""
    out = ""
    for i in range(max(len(low), len(high)) + 1):
        a = ord(low[i]) if i < len(low) else 0
        b = ord(high[i]) if high is not None and i < len(high) else 0x80 if high is None else 0
        if high is not None and a == b:
            if i >= len(low):
                return None
            out += low[i]
            continue
        middle = (a + max(a, b)) // 2
        if a < middle < b and not 0xD800 <= middle < 0xE000:
            return out + chr(middle)
        if i >= len(low):
            return out + chr(0x40) if high is None else None
        out, high = out + low[i], None  # any text that goes on like this is below
    return out + chr(0x40) if high is None else None


def read_table(spark: SparkSession, url: str, table: str, column: str | None = None, low=None, high=None, splits: int = 8, properties: dict | None = None) -> DataFrame:
    """A database table, read in ranges of a column if one is given."""
    if column is None:
        return spark.read.jdbc(url, table, properties=properties or {})
    return spark.read.jdbc(url, table, predicates=split_ranges(low, high, splits, column), properties=properties or {})


def write_table(df: DataFrame, url: str, table: str, properties: dict | None = None, mode: str = "append") -> None:
    df.write.jdbc(url, table, mode=mode, properties=properties or {})


_DERBY = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "float": "REAL", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "string": "CLOB"}


def embedded_database(df: DataFrame, path: str, table: str) -> tuple[str, dict]:
    """The URL and properties of a database of one table under ``path``, a folder that all nodes see as a local one.

    Spark's embedded database serves one process at a time. So tasks write the rows as text, the driver has the database
    load these files, and what is read is an archive of it, which any number of processes may open at once.
    """
    if not path.startswith(("file:", "/")):
        raise ValueError("an embedded database needs a shared folder that all nodes see as a local one")
    jvm, root = df.sparkSession._jvm, "/" + path.removeprefix("file:").lstrip("/")
    texts = [F.concat(F.lit('"'), F.replace(F.col(n), F.lit('"'), F.lit('""')), F.lit('"')) if k == "string" else F.col(n).cast("string") for n, k in df.dtypes]
    df.select(F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in texts)).alias("value")).write.text(f"{path}/rows")
    jvm.org.apache.derby.jdbc.EmbeddedDriver()
    connection = jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{root}/made/db;create=true")
    statement = connection.createStatement()
    statement.execute(f"CREATE TABLE {table} (" + ", ".join(f'"{n}" {_DERBY[t]}' for n, t in df.dtypes) + ")")
    for name in sorted(glob.glob(f"{root}/rows/part-*")):
        if os.path.getsize(name):
            statement.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table}', '{name}', ',', '\"', 'UTF-8', 0)")
    connection.close()
    try:
        jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{root}/made/db;shutdown=true")
    except Py4JJavaError as e:  # how the database tells that it has shut down
        if e.java_exception.getSQLState() != "08006":
            raise
    # Stored, not deflated: a page is then found by its place, where a deflated table would be read from its start for each page.
    with zipfile.ZipFile(f"{root}/part", "w", zipfile.ZIP_STORED) as archive:
        for folder, _, names in sorted(os.walk(f"{root}/made")):
            for name in ("", *sorted(names)):
                archive.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), f"{root}/made"))
    os.replace(f"{root}/part", f"{root}/db.zip")
    return f"jdbc:derby:jar:({root}/db.zip)db", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def box_of(kind: str) -> Box:
    """The box columns of a kind of shape that has them."""
    return Box("x", "y", F.lit(1), F.lit(1)) if kind == "point" else Box()

"""Every operator as a query over the driver's tables, with the same in DuckDB's SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bloom
from ..functions import geometry as G
from ..functions import text as T
from ..functions.geometry import Box, div
from ..operators import aggregates as A
from ..operators import grid as GR
from ..operators import keyjoin as J
from ..operators import sampling as S
from ..operators import selection as Q
from ..operators import sorting as O
from ..operators import spatial_join as SJ
from ..operators.index import build
from ..scratch import shared_path
from ..sources import files
from ..streaming.pipe import map_reduce, pipe

#: Integer geometry over the driver's tables, the same arithmetic in both engines.
VIEWS = {
    "pt_part": "SELECT p_partkey AS id, (p_partkey*7919)%10000 AS x, (p_partkey*104729)%10000 AS y FROM part",
    "pt_customer": "SELECT c_custkey AS id, (c_custkey*6101)%10000 AS x, (c_custkey*3571+c_nationkey*97)%10000 AS y FROM customer",
    "rect_lineitem": "SELECT l_orderkey AS okey, CAST(l_linenumber AS BIGINT) AS line, (l_orderkey*31+l_linenumber*977)%10000 AS x, (l_partkey*17+l_suppkey*13)%10000 AS y, CAST(l_quantity AS BIGINT) AS width, CAST(l_linenumber+1 AS BIGINT) AS height FROM lineitem",
    "rect_orders": "SELECT o_orderkey AS id, (o_orderkey*131)%10000 AS x, (o_custkey*257)%10000 AS y, 1+o_custkey%40 AS width, 1+o_orderkey%40 AS height FROM orders",
    "tri_part": "SELECT p_partkey AS id, [CAST((p_partkey*7919)%10000 AS INT), CAST((p_partkey*7919)%10000 + 5 + p_partkey%50 AS INT), CAST((p_partkey*7919)%10000 AS INT)] AS xs, [CAST((p_partkey*104729)%10000 AS INT), CAST((p_partkey*104729)%10000 AS INT), CAST((p_partkey*104729)%10000 + 5 + p_partkey%70 AS INT)] AS ys FROM part",
    "lines": "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS value FROM documents",
    "items": "SELECT l_orderkey, l_linenumber, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT)) AS value FROM lineitem",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """The driver's tables, and the views over them, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name == "lines":
            return self.documents.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("value"))
        if name == "items":
            return self.lineitem.selectExpr("l_orderkey", "l_linenumber", "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT)) AS value")
        if name in VIEWS:
            body, table = re.fullmatch(r"SELECT (.*) FROM (\w+)", VIEWS[name]).groups()
            body = re.sub(r"\[(.*?)\]", r"array(\1)", body)
            return self.spark.sql(f"SELECT {body} FROM {{t}}", t=getattr(self, table))
        raise AttributeError(name)


def oracle(body: str) -> str:
    """The query with the views that it names."""
    used = [f"{n} AS ({v})" for n, v in VIEWS.items() if re.search(rf"\b{n}\b", body)]
    with_, rest = ("WITH RECURSIVE ", body[15:]) if body.startswith("WITH RECURSIVE ") else ("WITH ", body[5:]) if body.startswith("WITH ") else ("WITH ", None)
    if not used:
        return body
    return with_ + ", ".join(used) + (", " + rest if rest is not None else " " + body)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            SQL[name] = oracle(sql)
        return fn

    return add


LI = Box()
WINDOW = (1000, 500, 2500, 2000)
#: A grid that covers the views' coordinates.
GRID = GR.Grid(0, 0, 10100, 10100, 20, 20)
OVER = "(x + width > {0} AND {0} + {2} > x AND y + height > {1} AND {1} + {3} > y)".format(*WINDOW)


# Geometry.
query("G01_point_mbr", "SELECT id, x, y, 1::BIGINT AS width, 1::BIGINT AS height FROM pt_part")(lambda t: t.pt_part.select("id", *G.point_box().columns()))
query("G02_point_distance", "SELECT id, sqrt(((x-5000)*(x-5000)+(y-5000)*(y-5000))::DOUBLE) AS d FROM pt_part")(lambda t: t.pt_part.select("id", G.point_distance("x", "y", 5000, 5000).alias("d")))
query("G03_point_intersects", f"SELECT id FROM (SELECT *, 1 AS width, 1 AS height FROM pt_part) WHERE {OVER}")(lambda t: t.pt_part.where(G.point_box().overlaps(Box(*WINDOW))).select("id"))
query("G04_morton", "SELECT id, (SELECT sum(((x >> i) & 1) << (2*i))::BIGINT + sum(((y >> i) & 1) << (2*i+1))::BIGINT FROM range(14) r(i)) AS z FROM pt_part")(lambda t: t.pt_part.select("id", G.morton().alias("z")))
query("G05_point_order", "SELECT id, x, y, row_number() OVER (ORDER BY x, y, id) AS n FROM pt_part")(lambda t: O.numbered(t.pt_part, "x", "y", "id"))
query("G06_box_parts", "SELECT okey, line, x + width AS x2, y + height AS y2, x + width // 2 AS x_mid, y + height // 2 AS y_mid FROM rect_lineitem")(lambda t: t.rect_lineitem.select("okey", "line", LI.x2.alias("x2"), LI.y2.alias("y2"), LI.center()[0].alias("x_mid"), LI.center()[1].alias("y_mid")))
query("G07_max_distance", "SELECT id, sqrt((greatest(5000-x, x+width-5000)*greatest(5000-x, x+width-5000)+greatest(5000-y, y+height-5000)*greatest(5000-y, y+height-5000))::DOUBLE) AS d FROM rect_orders")(lambda t: t.rect_orders.select("id", LI.max_distance(5000, 5000).alias("d")))
query("G08_min_distance", "SELECT id, sqrt((greatest(x-5000, 0, 5000-x-width)*greatest(x-5000, 0, 5000-x-width)+greatest(y-5000, 0, 5000-y-height)*greatest(y-5000, 0, 5000-y-height))::DOUBLE) AS d FROM rect_orders")(lambda t: t.rect_orders.select("id", LI.min_distance(5000, 5000).alias("d")))
query("G09_contains_point", "SELECT id FROM rect_orders WHERE 5000 >= x AND 5000 < x + 50*width AND 4000 >= y AND 4000 < y + 50*height")(lambda t: t.rect_orders.where(Box("x", "y", F.col("width") * 50, F.col("height") * 50).contains_point(5000, 4000)).select("id"))
query("G10_contains_box", "SELECT id FROM rect_orders WHERE x >= 1000 AND x + width <= 3500 AND y >= 500 AND y + height <= 2500")(lambda t: t.rect_orders.where(Box(*WINDOW).contains(LI)).select("id"))
query("G11_box_meets_point", "SELECT okey, line FROM rect_lineitem WHERE 1200 >= x AND 1200 < x + width*20 AND 900 >= y AND 900 < y + height*20")(lambda t: t.rect_lineitem.where(Box("x", "y", F.col("width") * 20, F.col("height") * 20).contains_point(1200, 900)).select("okey", "line"))
query("G12_overlap", f"SELECT id FROM rect_orders WHERE {OVER}")(lambda t: t.rect_orders.where(LI.overlaps(Box(*WINDOW))).select("id"))
query("G13_intersection", f"SELECT id, greatest(x, 1000) AS x, greatest(y, 500) AS y, least(x+width, 3500)-greatest(x, 1000) AS width, least(y+height, 2500)-greatest(y, 500) AS height FROM rect_orders WHERE {OVER}")(lambda t: t.rect_orders.where(LI.overlaps(Box(*WINDOW))).select("id", *_long(LI.intersection(Box(*WINDOW)))))
query("G14_union", "SELECT id, least(x, 1000) AS x, least(y, 500) AS y, greatest(x+width, 3500)-least(x, 1000) AS width, greatest(y+height, 2500)-least(y, 500) AS height FROM rect_orders")(lambda t: t.rect_orders.select("id", *_long(LI.union(Box(*WINDOW)))))
query("G15_center", "SELECT id, x + width // 2 AS cx, y + height // 2 AS cy FROM rect_orders")(lambda t: t.rect_orders.select("id", LI.center()[0].alias("cx"), LI.center()[1].alias("cy")))
query("G16_circle_mbr", "SELECT id, trunc(x + 0.5 - 7.25)::BIGINT AS x, trunc(y - 7.25)::BIGINT AS y, trunc(x + 0.5 + 7.25)::BIGINT - trunc(x + 0.5 - 7.25)::BIGINT AS width, trunc(y + 7.25)::BIGINT - trunc(y - 7.25)::BIGINT AS height FROM pt_part")(lambda t: t.pt_part.select("id", *G.circle_box(F.col("x") + F.lit(0.5), F.col("y").cast("double"), 7.25).columns()))
query("G17_circle_distance", "SELECT id, sqrt((x+0.5::DOUBLE-5000)*(x+0.5::DOUBLE-5000)+(y-5000)::DOUBLE*(y-5000)) AS d FROM pt_part")(lambda t: t.pt_part.select("id", G.circle_distance(F.col("x") + F.lit(0.5), F.col("y").cast("double"), 5000, 5000).alias("d")))
query("G18_circle_overlap", "SELECT id FROM rect_orders WHERE (5000 - greatest(x, least(5000, x+width)))*(5000 - greatest(x, least(5000, x+width))) + (5000 - greatest(y, least(5000, y+height)))*(5000 - greatest(y, least(5000, y+height))) < 1500*1500")(lambda t: t.rect_orders.where(G.circle_overlaps(5000.0, 5000.0, 1500.0, LI)).select("id"))
query("G19_polygon_mbr", "SELECT id, list_min(xs)::BIGINT AS x, list_min(ys)::BIGINT AS y, list_max(xs)::BIGINT - list_min(xs) AS width, list_max(ys)::BIGINT - list_min(ys) AS height FROM tri_part")(lambda t: t.tri_part.select("id", *_long(G.polygon_box())))
query("G20_polygon_distance", "SELECT id, sqrt(((cx-5000)*(cx-5000)+(cy-5000)*(cy-5000))::DOUBLE) AS d FROM (SELECT id, list_min(xs)::BIGINT + (list_max(xs)::BIGINT - list_min(xs)) // 2 AS cx, list_min(ys)::BIGINT + (list_max(ys)::BIGINT - list_min(ys)) // 2 AS cy FROM tri_part)")(lambda t: t.tri_part.select("id", G.polygon_distance("xs", "ys", 5000, 5000).alias("d")))
# A right triangle shares an area with a box where the box's lower corner, moved into its legs, lies under its long side.
query("G21_polygon_overlap", "SELECT id FROM (SELECT id, xs[1]::BIGINT AS x, ys[1]::BIGINT AS y, (xs[2]-xs[1])::BIGINT AS a, (ys[3]-ys[1])::BIGINT AS b FROM tri_part) WHERE x + a > 1000 AND x < 3500 AND y + b > 500 AND y < 2500 AND (greatest(x, 1000) - x) * b + (greatest(y, 500) - y) * a < a * b")(lambda t: t.tri_part.where(G.polygon_overlaps("xs", "ys", Box(*WINDOW))).select("id"))
query("G22_shape_identity", "SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey")(lambda t: t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n")))
query("G23_shape_text", "SELECT id, concat_ws(',', x, y, width, height) AS line, x, y, width, height, lower(to_hex(x)) AS hex FROM rect_orders")(lambda t: _reparsed(t))


def _long(box: Box):
    return [c.cast("bigint").alias(n) for c, n in ((box.x, "x"), (box.y, "y"), (box.width, "width"), (box.height, "height"))]


def _reparsed(t: Tables) -> DataFrame:
    lines = t.rect_orders.select("id", files.shape_line(t.rect_orders, "rectangle").alias("line"))
    out = lines.select("id", "line", *(c.alias(n) for n, c in files.parse_shape(F.col("line"), "rectangle").items()))
    return out.withColumn("hex", F.lower(F.hex("x")))


# Sources and sinks: written to the shared folder and read back.
def _lines_back(t: Tables, df: DataFrame, **options) -> tuple[SparkSession, str]:
    path = shared_path(t.spark, "lines")
    df.write.options(**options).text(path)
    return t.spark, path


query("S02_heap_file", "SELECT id, x, y, width, height FROM rect_orders")(lambda t: _shapes_back(t, t.rect_orders, "rectangle", "id"))


def _shapes_back(t: Tables, df: DataFrame, kind: str, key: str) -> DataFrame:
    path = shared_path(t.spark, "shapes")
    df.select(F.concat_ws(";", F.col(key).cast("string"), files.shape_line(df, kind)).alias("value")).write.text(path)
    f = F.split("value", ";")
    line = F.get(f, F.lit(1))
    return t.spark.read.text(path).select(F.get(f, F.lit(0)).cast("bigint").alias(key), *(c.alias(n) for n, c in files.parse_shape(line, kind).items()))


def _round_trip(kind: str):
    def run(t: Tables) -> DataFrame:
        path = shared_path(t.spark, "shapes")
        source = {"point": t.pt_part, "rectangle": t.rect_orders, "polygon": t.tri_part}[kind]
        files.write_shapes(source, path, kind)
        return files.read_shapes(t.spark, path, kind if kind == "polygon" else None)

    return run


query("S03_read_points", "SELECT x, y FROM pt_part")(_round_trip("point"))
query("S03_read_rectangles", "SELECT x, y, width, height FROM rect_orders")(_round_trip("rectangle"))
query("S03_read_polygons", "SELECT array_to_string(xs, ' ') AS xs, array_to_string(ys, ' ') AS ys FROM tri_part")(lambda t: _round_trip("polygon")(t).select(F.concat_ws(" ", F.col("xs").cast("array<string>")).alias("xs"), F.concat_ws(" ", F.col("ys").cast("array<string>")).alias("ys")))
query("S04_shape_lines", "SELECT concat_ws(',', x, y) AS value FROM pt_part")(lambda t: t.spark.read.text(_lines_back(t, t.pt_part.select(files.shape_line(t.pt_part, "point").alias("value")))[1]))
query("S13_text_lines", "SELECT value FROM lines WHERE strlen(value) <= 500")(lambda t: files.read_lines(*_lines_back(t, t.lines.select(F.regexp_replace("value", "\r", "").alias("value"))), max_length=500))
query("S14_key_values", "SELECT o_orderpriority AS key, concat_ws('|', o_orderkey, o_orderstatus) AS value FROM orders")(lambda t: _key_values(t))


def _key_values(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "kv")
    files.write_key_values(t.orders.select(F.col("o_orderpriority").alias("key"), F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("value")), path)
    return files.read_key_values(t.spark, path)


query("S15_lines_in_groups", "SELECT split, count(*) AS n, min(o_orderkey) AS low FROM (SELECT o_orderkey, o_orderkey // 100 AS split FROM orders) GROUP BY split")(lambda t: files.lines_in_groups(t.orders, 100, "o_orderkey").groupBy("split").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low")))
query("S16_sequence_file", "SELECT c_custkey AS key, c_name AS value FROM customer")(lambda t: _sequence(t))


def _sequence(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "sequence")
    files.write_sequence(t.customer.select("c_custkey", "c_name"), path)
    return files.read_sequence(t.spark, path, "key long, value string")


query("S17_as_text", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer")(lambda t: _sequence(t).select(F.col("key").cast("string").alias("key"), "value"))
query("S18_filter_regex", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '7$')")(lambda t: S.matching(t.customer, "c_name", "7$").select("c_custkey"))
query("S18_filter_percent", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0")(lambda t: S.every(t.orders, 10, "o_orderkey").select("o_orderkey"))
query("S18_filter_md5", "SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT % 7 = 0")(lambda t: S.by_digest(t.orders, "o_orderkey", 7).select("o_orderkey"))
query("S21_multiple_inputs", "SELECT 'c' AS tag, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier")(lambda t: files.multiple_inputs((t.customer, lambda d: d.select(F.lit("c").alias("tag"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))), (t.supplier, lambda d: d.select(F.lit("s").alias("tag"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))))
query("S22_text_output", "SELECT concat_ws(chr(9), o_orderkey, o_orderstatus) AS value FROM orders")(lambda t: _text_output(t))


def _text_output(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "text")
    files.write_key_values(t.orders, path, "o_orderkey", "o_orderstatus", compression="gzip")
    return t.spark.read.text(path)


query("S24_sorted_map_file", "SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_custkey BETWEEN 50 AND 90")(lambda t: _map_file(t))


def _map_file(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "map")
    t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value")).repartitionByRange(4, "key").sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)
    return t.spark.read.parquet(path).where(F.col("key").between(50, 90))


query("S27_multiple_outputs", "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_orderstatus")(lambda t: _routed(t))


def _routed(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "routed")
    files.write_routed(t.orders.select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


query("S30_range_splits", "SELECT (SELECT count(*) FROM range(1, 8) r(i) WHERE o_orderkey >= lo + (hi - lo) * i // 8)::INT AS split, count(*) AS n FROM orders, (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders) GROUP BY 1")(lambda t: _range_splits(t))


def _range_splits(t: Tables) -> DataFrame:
    r = t.orders.agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).first()
    conditions = files.split_ranges(r.lo, r.hi, 8, "o_orderkey")
    split = F.coalesce(*(F.when(F.expr(c), i) for i, c in enumerate(conditions)))
    return t.orders.groupBy(split.alias("split")).agg(F.count("*").alias("n"))


query("S29_database", "SELECT c_custkey AS k, c_name AS v FROM customer")(lambda t: _database(t))


def _database(t: Tables) -> DataFrame:
    """A table written to a database and read back in ranges. The database is Spark's own embedded one, in the shared folder."""
    url, properties = files.embedded_database(t.customer.selectExpr("c_custkey AS k", "c_name AS v"), shared_path(t.spark, "database"), "T")
    high = t.customer.agg(F.max("c_custkey")).first()[0]
    return files.read_table(t.spark, url, "T", '"k"', 0, high, 4, properties)


query("S33_xml", "SELECT c_custkey AS id, c_name AS name FROM customer")(lambda t: _xml(t))


def _xml(t: Tables) -> DataFrame:
    lines = t.customer.select(F.concat(F.lit("<c><id>"), F.col("c_custkey").cast("string"), F.lit("</id><name>"), F.col("c_name"), F.lit("</name></c>")).alias("value"))
    return files.read_xml(t.spark, _lines_back(t, lines)[1], "c", "id long, name string")


query("S36_codecs", "SELECT c_custkey, c_name FROM customer")(lambda t: _codec(t))


def _codec(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "bz")
    t.customer.select("c_custkey", "c_name").write.option("compression", "bzip2").csv(path)
    return t.spark.read.schema("c_custkey long, c_name string").csv(path)


query("S38_random_rectangles", "SELECT 20000::BIGINT AS n, true AS inside, true AS sized, true AS spread FROM range(1)")(lambda t: files.random_shapes(t.spark, 20_000, "rectangle", 0, 0, 10_000, 10_000).agg(F.count("*").alias("n"), F.every(F.expr("x >= 0 AND y >= 0 AND x + width <= 10000 AND y + height <= 10000")).alias("inside"), F.every(F.expr("width BETWEEN 1 AND 100 AND height BETWEEN 1 AND 100")).alias("sized"), ((F.count_distinct("x") > 8000) & (F.count_distinct("y") > 8000) & (F.count_distinct(F.floor(F.col("x") / 2500), F.floor(F.col("y") / 2500)) == 16)).alias("spread")))
query("S38_random_polygons", "SELECT 5000::BIGINT AS n, true AS inside, 3 AS fewest, 5 AS most FROM range(1)")(lambda t: files.random_shapes(t.spark, 5_000, "polygon", 0, 0, 10_000, 10_000).agg(F.count("*").alias("n"), F.every(F.expr("size(xs) = size(ys) AND array_min(xs) >= 0 AND array_max(xs) <= 10000 AND array_min(ys) >= 0 AND array_max(ys) <= 10000")).alias("inside"), F.min(F.size("xs")).alias("fewest"), F.max(F.size("xs")).alias("most")))
query("S39_describe_index", "SELECT c.cell_id, c.x, c.y, c.width, c.height, count(r.id) AS n_rows, count(r.id) FILTER (greatest(r.x, c.x) = r.x AND greatest(r.y, c.y) = r.y AND r.x >= c.x AND r.y >= c.y) AS n_home FROM (SELECT (i*4+j)::BIGINT AS cell_id, 10100*i//4 AS x, 10100*j//4 AS y, 10100*(i+1)//4-10100*i//4 AS width, 10100*(j+1)//4-10100*j//4 AS height FROM range(4) a(i), range(4) b(j)) c LEFT JOIN rect_orders r ON r.x + r.width > c.x AND c.x + c.width > r.x AND r.y + r.height > c.y AND c.y + c.height > r.y GROUP BY ALL")(lambda t: _described(t))


def _described(t: Tables) -> DataFrame:
    from ..operators.index import describe

    index = build(t.rect_orders, shared_path(t.spark, "index"), GR.Grid(0, 0, 10100, 10100, 4, 4))
    return describe(t.spark, index)


query("S40_tail", "SELECT o_orderkey, o_orderstatus AS value FROM orders ORDER BY o_orderkey DESC LIMIT 25")(lambda t: files.last_lines(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("value")), 25, "o_orderkey"))
query("S42_random_words", "SELECT w AS word, 10000::BIGINT AS lines, 100000::BIGINT AS words, true AS fair FROM (VALUES ('alpha'), ('beta'), ('gamma'), ('delta')) v(w)")(lambda t: _drawn(t))
query("S44_sort_log", "SELECT value FROM items WHERE regexp_matches(value, '-R-F-')")(lambda t: files.sort_log(t.items.select("value"), "-R-F-", [1, 0], "-"))

def _drawn(t: Tables) -> DataFrame:
    lines = files.random_words(t.spark, 10_000, ["alpha", "beta", "gamma", "delta"])
    words = lines.select("id", F.explode(F.split("value", " ")).alias("word"))
    total = words.agg(F.count_distinct("id").alias("lines"), F.count("*").alias("words"))
    return words.groupBy("word").agg(F.count("*").alias("n")).crossJoin(total).select("word", "lines", "words", F.expr("abs(n - words / 4) < 1000").alias("fair"))  # total is one row


# Indexes.
query("I03_partition_count", "SELECT greatest(1, ceil(count(*) * 40 * 1.1 / 65536))::BIGINT AS n FROM orders")(lambda t: t.spark.createDataFrame([(GR.partition_count(t.orders.count() * 40, 65536),)], "n long"))
query("I04_uniform_grid", "WITH RECURSIVE m AS (SELECT max(x+width)-min(x) AS w, max(y+height)-min(y) AS h FROM rect_orders), g(c, r) AS (SELECT 1, 1 UNION ALL SELECT CASE WHEN w // c > h // r THEN c + 1 ELSE c END, CASE WHEN w // c > h // r THEN r ELSE r + 1 END FROM g, m WHERE c * r < 50) SELECT max(c)::BIGINT AS cols, max(r)::BIGINT AS nrows FROM g")(lambda t: t.spark.createDataFrame([(g.cols, g.rows) for g in [GR.grid_for(t.rect_orders, 50)]], "cols long, nrows long"))
query("I05_grid_cells", "SELECT (i*20+j)::BIGINT AS cell_id, 10100*i//20 AS x, 10100*j//20 AS y, 10100*(i+1)//20-10100*i//20 AS width, 10100*(j+1)//20-10100*j//20 AS height FROM range(20) a(i), range(20) b(j)")(lambda t: GRID.frame(t.spark))
CELLS20 = "(SELECT (i*20+j)::BIGINT AS cell_id, 10100*i//20 AS cx, 10100*j//20 AS cy, 10100*(i+1)//20-10100*i//20 AS cw, 10100*(j+1)//20-10100*j//20 AS ch FROM range(20) a(i), range(20) b(j))"
query("I01_repartition", f"SELECT okey, line, cell_id, (x >= cx AND y >= cy) AS is_home FROM rect_lineitem JOIN {CELLS20} ON x + width > cx AND cx + cw > x AND y + height > cy AND cy + ch > y")(lambda t: GR.assign(t.rect_lineitem, GRID).select("okey", "line", "cell_id", "is_home"))
query("I01_index_home", "SELECT id, x, y, width, height FROM rect_orders")(lambda t: build(t.rect_orders, shared_path(t.spark, "index"), 16).home(t.spark))
query("I06_packed_index", "SELECT id, x, y, width, height FROM rect_orders")(lambda t: build(t.rect_orders, shared_path(t.spark, "index"), 16, "str").home(t.spark))
query("I09_cells_of", f"SELECT cell_id, count(*) AS n FROM rect_lineitem JOIN {CELLS20} ON x + width > cx AND cx + cw > x AND y + height > cy AND cy + ch > y GROUP BY cell_id")(lambda t: _cells_of_another(t))


def _cells_of_another(t: Tables) -> DataFrame:
    """An index of lines in the cells of an index of orders, read from where that is stored."""
    from ..operators.index import load

    path = shared_path(t.spark, "index")
    build(t.rect_orders, path, GRID)
    own = build(t.rect_lineitem, shared_path(t.spark, "index"), load(t.spark, path).cells)
    return own.data(t.spark).groupBy(F.col("cell_id").cast("bigint").alias("cell_id")).agg(F.count("*").alias("n"))


# Selection.
query("Q01_range_query", f"SELECT okey, line, x, y, width, height FROM rect_lineitem WHERE {OVER}")(lambda t: Q.range_query(t.rect_lineitem, WINDOW))
query("Q02_indexed_range", f"SELECT id, x, y, width, height FROM rect_orders WHERE {OVER}")(lambda t: Q.indexed_range_query(t.spark, build(t.rect_orders, shared_path(t.spark, "index"), 64), WINDOW))
query("Q03_packed_range", f"SELECT id, x, y, width, height FROM rect_orders WHERE {OVER}")(lambda t: Q.indexed_range_query(t.spark, build(t.rect_orders, shared_path(t.spark, "index"), 16, "str"), WINDOW))
query("Q01_circle_range_mbr", "SELECT id FROM rect_orders WHERE x + width > 3500 AND 6500 > x AND y + height > 3500 AND 6500 > y")(lambda t: Q.range_query(t.rect_orders, (), circle=(5000.0, 5000.0, 1500.0)).select("id"))
query("Q01_circle_range_exact", "SELECT id FROM rect_orders WHERE (5000 - greatest(x, least(5000, x+width)))*(5000 - greatest(x, least(5000, x+width))) + (5000 - greatest(y, least(5000, y+height)))*(5000 - greatest(y, least(5000, y+height))) < 1500*1500")(lambda t: Q.range_query(t.rect_orders, (), circle=(5000.0, 5000.0, 1500.0), mode="exact").select("id"))
query("Q05_batch_range", "SELECT q.id AS query_id, r.okey, r.line FROM rect_lineitem r JOIN (SELECT * FROM rect_orders WHERE id % 20 = 0) q ON r.x + r.width > q.x AND q.x + q.width > r.x AND r.y + r.height > q.y AND q.y + q.height > r.y")(lambda t: Q.batch_range_query(t.rect_lineitem, t.rect_orders.where("id % 20 = 0").selectExpr("id AS query_id", "x AS qx", "y AS qy", "width AS qwidth", "height AS qheight")).select(F.col("r_query_id").alias("query_id"), F.col("l_okey").alias("okey"), F.col("l_line").alias("line")))
query("Q06_cell_pruning", "SELECT (i*20+j)::BIGINT AS cell_id FROM range(20) a(i), range(20) b(j) WHERE 10100*(i+1)//20 > 1000 AND 10100*i//20 < 3500 AND 10100*(j+1)//20 > 500 AND 10100*j//20 < 2500")(lambda t: t.spark.createDataFrame([(i,) for i in GRID.overlapping(*WINDOW)], "cell_id long"))

# Nearest neighbours.
KNN = "SELECT id, x, y, sqrt(((x-5000)*(x-5000)+(y-5000)*(y-5000))::DOUBLE) AS distance FROM pt_customer ORDER BY distance, id, x, y LIMIT 50"
query("K01_knn", KNN)(lambda t: Q.knn(t.pt_customer, 5000, 5000, 50))
query("K01_indexed_knn", KNN)(lambda t: Q.indexed_knn(t.spark, build(t.pt_customer, shared_path(t.spark, "index"), 25, box=G.point_box()), 5000, 5000, 50))
query("K03_knn_distinct", "SELECT x, y, sqrt(((x-100)*(x-100)+(y-100)*(y-100))::DOUBLE) AS distance FROM (SELECT DISTINCT x, y FROM rect_lineitem) ORDER BY distance, x, y LIMIT 40")(lambda t: Q.knn(t.rect_lineitem.select("x", "y"), 100, 100, 40, dedupe=True))
query("K05_knn_rectangles", "SELECT id, x, y, width, height, sqrt((greatest(5000-x, x+width-5000)*greatest(5000-x, x+width-5000)+greatest(5000-y, y+height-5000)*greatest(5000-y, y+height-5000))::DOUBLE) AS distance FROM rect_orders ORDER BY distance, id LIMIT 30")(lambda t: Q.knn(t.rect_orders, 5000, 5000, 30, LI))
query("K06_batch_knn", "SELECT query_id, id, d2, rank FROM (SELECT q.query_id, c.id, (c.x-q.px)*(c.x-q.px)+(c.y-q.py)*(c.y-q.py) AS d2, row_number() OVER (PARTITION BY q.query_id ORDER BY (c.x-q.px)*(c.x-q.px)+(c.y-q.py)*(c.y-q.py), c.id)::INT AS rank FROM pt_customer c, (SELECT i AS query_id, (i*997)%10000 AS px, (i*613)%10000 AS py FROM range(100) r(i)) q) WHERE rank <= 5")(lambda t: Q.batch_knn(t.pt_customer, [(i, i * 997 % 10000, i * 613 % 10000) for i in range(100)], 5))
query("K06_knn_join", "SELECT query_id, id, d2, rank FROM (SELECT c.id AS query_id, p.id AS id, (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y) AS d2, row_number() OVER (PARTITION BY c.id ORDER BY (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y), p.id)::INT AS rank FROM pt_customer c, pt_part p) WHERE rank <= 3")(lambda t: Q.knn_join(t.pt_part, t.pt_customer.select(F.col("id").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy")), 3).select("query_id", "id", "d2", "rank"))

# Spatial joins.
PAIRS = "FROM rect_lineitem l JOIN rect_orders r ON l.x + l.width > r.x AND r.x + r.width > l.x AND l.y + l.height > r.y AND r.y + r.height > l.y"
#: The columns of the pairs that their queries give.
PAIR = ["l_okey", "l_line", "r_id"]
query("J01_spatial_join", f"SELECT l.okey AS okey, l.line AS line, r.id AS id {PAIRS}")(lambda t: _pairs(SJ.spatial_join(t.rect_lineitem, t.rect_orders, columns=PAIR)))
query("J01_rect_point_join", "SELECT l.okey AS okey, l.line AS line, r.id AS id FROM rect_lineitem l JOIN pt_part r ON l.x + l.width > r.x AND r.x + 1 > l.x AND l.y + l.height > r.y AND r.y + 1 > l.y")(lambda t: _pairs(SJ.spatial_join(t.rect_lineitem, t.pt_part, None, None, G.point_box())))
query("J02_distributed_join", f"SELECT l.okey AS okey, l.line AS line, r.id AS id {PAIRS}")(lambda t: _pairs(SJ.join_indexed(t.spark, *_two(t), repartition="no", columns=PAIR)))
query("J03_repartition_join", f"SELECT l.okey AS okey, l.line AS line, r.id AS id {PAIRS}")(lambda t: _pairs(SJ.join_indexed(t.spark, *_two(t), repartition="yes", columns=PAIR)))
query("J04_join_cost", "SELECT n AS pairs, 3 * 25 + 36 < n AS repartition FROM (SELECT count(*) AS n FROM (SELECT 10100*i//6 AS x1, 10100*(i+1)//6 AS x2, 10100*j//6 AS y1, 10100*(j+1)//6 AS y2 FROM range(6) a(i), range(6) b(j)) p JOIN (SELECT 10100*i//5 AS x1, 10100*(i+1)//5 AS x2, 10100*j//5 AS y1, 10100*(j+1)//5 AS y2 FROM range(5) a(i), range(5) b(j)) q ON p.x2 > q.x1 AND q.x2 > p.x1 AND p.y2 > q.y1 AND q.y2 > p.y1)")(lambda t: t.spark.createDataFrame([(len(SJ.cell_pairs(G6, G5)), SJ.should_repartition(G6, G5))], "pairs long, repartition boolean"))
query("J05_cell_pairs", "SELECT p.c AS left_cell, q.c AS right_cell FROM (SELECT (i*6+j)::BIGINT AS c, 10100*i//6 AS x1, 10100*(i+1)//6 AS x2, 10100*j//6 AS y1, 10100*(j+1)//6 AS y2 FROM range(6) a(i), range(6) b(j)) p JOIN (SELECT (i*5+j)::BIGINT AS c, 10100*i//5 AS x1, 10100*(i+1)//5 AS x2, 10100*j//5 AS y1, 10100*(j+1)//5 AS y2 FROM range(5) a(i), range(5) b(j)) q ON p.x2 > q.x1 AND q.x2 > p.x1 AND p.y2 > q.y1 AND q.y2 > p.y1")(lambda t: t.spark.createDataFrame(SJ.cell_pairs(G6, G5), "left_cell long, right_cell long"))
query("J06_plane_sweep", f"SELECT l.okey AS okey, l.line AS line, r.id AS id {PAIRS}")(lambda t: _pairs(SJ.sweep_join(t.rect_lineitem, t.rect_orders, columns=PAIR)))
query("J01_beyond_the_cells", f"SELECT l.okey AS okey, l.line AS line, r.id AS id {PAIRS}")(lambda t: _pairs(SJ.spatial_join(t.rect_lineitem, t.rect_orders, GR.Grid(2000, 3000, 4000, 4000, 8, 8), columns=PAIR)))
query("J06_sweep_beyond_the_cells", f"SELECT l.okey AS okey, l.line AS line, r.id AS id {PAIRS}")(lambda t: _pairs(SJ.sweep_join(t.rect_lineitem, t.rect_orders, GR.Grid(2000, 3000, 4000, 4000, 8, 8), PAIR)))
query("J02_beyond_the_cells", f"SELECT l.okey AS okey, l.line AS line, r.id AS id {PAIRS}")(lambda t: _pairs(SJ.join_indexed(t.spark, build(t.rect_lineitem, shared_path(t.spark, "index"), GR.Grid(0, 0, 5000, 10100, 6, 6)), build(t.rect_orders, shared_path(t.spark, "index"), GR.Grid(3000, 0, 7100, 6000, 5, 5)), repartition="no", columns=PAIR)))
query("J06_self_sweep", "SELECT l.id AS l_id, r.id AS r_id, l.id AS l_cell_id, r.id AS r_n FROM rect_orders l JOIN rect_orders r ON l.x + l.width > r.x AND r.x + r.width > l.x AND l.y + l.height > r.y AND r.y + r.height > l.y")(lambda t: SJ.sweep_join(*(2 * [t.rect_orders.selectExpr("*", "id AS cell_id", "id AS _col", "id AS n")]), columns=["l_id", "r_id", "l_cell_id", "r_n"]).selectExpr("l_id", "r_id", "l_cell_id", "r_n"))
query("J01_self_join", "SELECT l.id AS l_id, r.id AS r_id, l.id AS l_cell_id, r.id AS r__col FROM rect_orders l JOIN rect_orders r ON l.x + l.width > r.x AND r.x + r.width > l.x AND l.y + l.height > r.y AND r.y + r.height > l.y")(lambda t: SJ.spatial_join(*(2 * [t.rect_orders.selectExpr("*", "id AS cell_id", "id AS _col", "id AS n")]), columns=["l_id", "r_id", "l_cell_id", "r__col"]).selectExpr("l_id", "r_id", "l_cell_id", "r__col"))
G6, G5 = GR.Grid(0, 0, 10100, 10100, 6, 6), GR.Grid(0, 0, 10100, 10100, 5, 5)


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col("l_okey").alias("okey"), F.col("l_line").alias("line"), F.col("r_id").alias("id"))


def _two(t: Tables):
    return build(t.rect_lineitem, shared_path(t.spark, "index"), G6), build(t.rect_orders, shared_path(t.spark, "index"), G5)


# Joins by key.
def _whole(t: Tables):
    return (t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v")), t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("v")), t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("bigint").alias("v")))


def _small_tables(t: Tables):
    _, suppliers, nations = _whole(t)
    least = suppliers.groupBy("k").agg(F.min("v").alias("v")).unionByName(nations.select("k", F.lit(None).cast("bigint").alias("v")).join(suppliers, "k", "left_anti"))
    inner = J.JoinExpression({"nations": nations, "least": least, "none": nations.where("false")}, "k")("inner(tbl(nations), outer(tbl(least), tbl(none)))")
    return {"nations": nations, "least": least, "none": nations.where("false"), "nothing": inner.where("false")}


def _own_operation(t: Tables) -> DataFrame:
    """An operation of one's own in the expression language: how many rows of all sources have each key."""
    class Counting(J.JoinExpression):
        pass

    Counting.define("rows", lambda *frames, key: files.multiple_inputs(*((f, lambda d: d.select(key)) for f in frames)).groupBy(key).agg(F.count("*").alias("n")))
    customers, suppliers, _ = _whole(t)
    return Counting({"customers": customers, "suppliers": suppliers}, "k")("rows(tbl(customers), tbl(suppliers))")


WHOLE = "WITH a AS (SELECT c_nationkey AS k, c_custkey AS v FROM customer), b AS (SELECT s_nationkey AS k, s_suppkey AS v FROM supplier), c AS (SELECT n_nationkey AS k, n_regionkey::BIGINT AS v FROM nation) "
query("J08_inner_join", WHOLE + "SELECT a.k, a.v AS v0, b.v AS v1, c.v AS v2 FROM a JOIN b ON a.k = b.k JOIN c ON a.k = c.k")(lambda t: J.inner_join(*_whole(t), key="k").select("k", *(F.col(f"s{i}.v").alias(f"v{i}") for i in range(3))))
query("J09_outer_join", WHOLE + "SELECT coalesce(a.k, b.k, c.k) AS k, a.v AS v0, b.v AS v1, c.v AS v2, ((a.v IS NOT NULL)::BIGINT + 2 * (b.v IS NOT NULL)::BIGINT + 4 * (c.v IS NOT NULL)::BIGINT) AS present FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k")(lambda t: J.outer_join(*_whole(t), key="k").select("k", *(F.col(f"s{i}.v").alias(f"v{i}") for i in range(3)), "present"))
query("J10_override_join", WHOLE + ", u AS (SELECT *, 0 AS source FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c) SELECT k, v, source FROM u QUALIFY source = max(source) OVER (PARTITION BY k)")(lambda t: J.override_join(*_whole(t), key="k").select("k", "v", "source"))
query("J11_join_expression", WHOLE + "SELECT a.k, a.v AS v0, b.v AS v1 FROM a JOIN b ON a.k = b.k")(lambda t: J.JoinExpression(dict(zip("abc", _whole(t), strict=True)), "k")("inner(tbl(a), tbl(b))").select("k", F.col("s0.v").alias("v0"), F.col("s1.v").alias("v1")))
query("J11_nested_expression", WHOLE + "SELECT c.k, c.v AS v0, b.v AS v1 FROM c LEFT JOIN (SELECT k, min(v) AS v FROM b GROUP BY k) b ON c.k = b.k")(lambda t: J.JoinExpression(_small_tables(t), "k")("override(inner(tbl(nations), outer(tbl(least), tbl(none))), tbl(nothing))").select("k", F.col("s0.v").alias("v0"), F.col("s1.s0.v").alias("v1")))
query("J11_own_operation", WHOLE + "SELECT k, count(*) AS n FROM (SELECT k FROM a UNION ALL SELECT k FROM b) GROUP BY k")(lambda t: _own_operation(t))
query("J13_tagged_join", "SELECT o_custkey AS k, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")(lambda t: J.tagged_join({"o": t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey"), "c": t.customer.select(F.col("c_custkey").alias("k"), "c_name")}, "k").select("k", "o.o_orderkey", "c.c_name"))
query("J13_tagged_join_capped", "SELECT k, o_orderkey, c_name FROM (SELECT o_custkey AS k, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3) JOIN customer ON k = c_custkey")(lambda t: J.tagged_join({"o": t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey"), "c": t.customer.select(F.col("c_custkey").alias("k"), "c_name")}, "k", max_values_per_group=3).select("k", "o.o_orderkey", "c.c_name"))
query("J13_tagged_anti", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")(lambda t: J.tagged_join({"c": t.customer.select(F.col("c_custkey").alias("k"), "c_name"), "o": t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), "o_orderkey")}, "k", "anti").select("k"))
query("J13_tagged_outer", "SELECT coalesce(c_custkey, o_custkey) AS k, c_name, o_orderkey FROM customer FULL JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")(lambda t: J.tagged_join({"c": t.customer.select(F.col("c_custkey").alias("k"), "c_name"), "o": t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), "o_orderkey")}, "k", "outer").select("k", "c.c_name", "o.o_orderkey"))
query("J14_joined_line", "SELECT o_custkey AS k, concat_ws(chr(9), o_orderkey, c_name) AS value FROM orders JOIN customer ON o_custkey = c_custkey")(lambda t: J.joined_line(J.tagged_join({"o": t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey"), "c": t.customer.select(F.col("c_custkey").alias("k"), "c_name")}, "k"), "k", ["o", "c"]))

# Aggregates.
query("A01_mbr", "SELECT min(x) AS x, min(y) AS y, max(x+width)-min(x) AS width, max(y+height)-min(y) AS height FROM rect_lineitem")(lambda t: GR.mbr(t.rect_lineitem))
query("A02_record_count", "SELECT count(*) AS n FROM lines")(lambda t: A.record_count(t.lines))
query("A03_nonempty_count", "SELECT count(*) AS n FROM lines WHERE length(value) > 0")(lambda t: A.record_count(t.lines, "value"))
query("A04_estimated_count", "SELECT true AS within, true AS near FROM range(1)")(lambda t: _estimated(t))
query("A05_long_sum", "SELECT o_orderstatus, sum(o_custkey)::BIGINT AS n FROM orders GROUP BY o_orderstatus")(lambda t: t.orders.groupBy("o_orderstatus").agg(A.TYPES["LongValueSum"](F.col("o_custkey")).alias("n")))
query("A06_double_sum", "SELECT l_returnflag, sum(l_quantity) AS n FROM lineitem GROUP BY l_returnflag")(lambda t: t.lineitem.groupBy("l_returnflag").agg(A.TYPES["DoubleValueSum"](F.col("l_quantity")).alias("n")))
query("A07_long_extremes", "SELECT o_orderstatus, max(o_custkey) AS high, min(o_custkey) AS low FROM orders GROUP BY o_orderstatus")(lambda t: t.orders.groupBy("o_orderstatus").agg(A.TYPES["LongValueMax"](F.col("o_custkey")).alias("high"), A.TYPES["LongValueMin"](F.col("o_custkey")).alias("low")))
query("A08_string_extremes", "SELECT p_brand, max(p_name) AS high, min(p_name) AS low FROM part GROUP BY p_brand")(lambda t: t.part.groupBy("p_brand").agg(A.TYPES["StringValueMax"](F.col("p_name")).alias("high"), A.TYPES["StringValueMin"](F.col("p_name")).alias("low")))
query("A09_uniq_count", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, least(count(DISTINCT l_suppkey), 15) AS capped FROM lineitem GROUP BY l_returnflag")(lambda t: t.lineitem.groupBy("l_returnflag").agg(A.uniq_count(F.col("l_suppkey")).alias("n"), A.uniq_count(F.col("l_suppkey"), 14).cast("bigint").alias("capped")))
query("A10_histogram", "SELECT count(*) AS n_values, min(n) AS least, list_sort(list(n))[count(*) // 2 + 1] AS median, max(n) AS largest, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS stddev FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)")(lambda t: A.histogram(t.lineitem, "l_suppkey").withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)}))
query("A11_value_counts", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")(lambda t: A.value_counts(t.lineitem, "l_suppkey"))
query("A12_named_aggregates", "SELECT 'LongValueSum' AS type, 'keys' AS id, CAST(sum(o_orderkey)::BIGINT AS VARCHAR) AS value FROM orders UNION ALL SELECT 'LongValueMax', 'customer', CAST(max(o_custkey) AS VARCHAR) FROM orders UNION ALL SELECT 'StringValueMin', 'priority', min(o_orderpriority) FROM orders UNION ALL SELECT 'UniqValueCount', 'customers', CAST(count(DISTINCT o_custkey) AS VARCHAR) FROM orders")(lambda t: A.named(t.orders, [("LongValueSum", "keys", F.col("o_orderkey")), ("LongValueMax", "customer", F.col("o_custkey")), ("StringValueMin", "priority", F.col("o_orderpriority")), ("UniqValueCount", "customers", F.col("o_custkey"))]))
query("A12_keyed_aggregates", "SELECT 'LongValueSum' AS type, o_orderpriority AS id, CAST(count(*) AS VARCHAR) AS value FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'LongValueMax', o_orderpriority, CAST(max(o_custkey) AS VARCHAR) FROM orders GROUP BY o_orderpriority")(lambda t: A.keyed(t.orders.select(F.inline(F.array(F.struct(F.lit("LongValueSum").alias("type"), F.col("o_orderpriority").alias("id"), F.lit("1").alias("value")), F.struct(F.lit("LongValueMax").alias("type"), F.col("o_orderpriority").alias("id"), F.col("o_custkey").cast("string").alias("value")))))))
query("A13_default_aggregate", "SELECT 'LongValueSum' AS type, 'record_count' AS id, CAST(count(*) AS VARCHAR) AS value FROM orders")(lambda t: A.named(t.orders))
query("A14_sum_per_key", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")(lambda t: t.orders.groupBy("o_custkey").agg(F.sum(F.lit(1).cast("bigint")).alias("n")))
query("A16_identity_sort", "SELECT o_custkey, count(*) AS n, true AS together FROM orders GROUP BY o_custkey")(lambda t: _together(O.key_sort(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], 5)))
query("A17_pi", "WITH RECURSIVE d(i, a, fa, x, b, fb, y) AS (SELECT i + 1, i + 1, 0.5::DOUBLE, 0.0::DOUBLE, i + 1, (1.0/3)::DOUBLE, 0.0::DOUBLE FROM range(20000) r(i) UNION ALL SELECT i, a // 2, fa / 2, x + (a % 2) * fa, b // 3, fb / 3, y + (b % 3) * fb FROM d WHERE a > 0 OR b > 0) SELECT count(*) AS inside FROM d WHERE a = 0 AND b = 0 AND (x-0.5)*(x-0.5)+(y-0.5)*(y-0.5) <= 0.25")(lambda t: _pi(t, 20_000))
query("A18_counters", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")(lambda t: t.orders.where("o_orderstatus = 'F'").observe("counters", F.count("*").alias("seen")).agg(F.count("*").alias("n")))


def _pi(t: Tables, n: int) -> DataFrame:
    """Points of a Halton sequence (bases 2 and 3) that lie in the circle within the unit square."""
    def halton(base: int):
        digits = 15 if base == 2 else 10
        def step(s, k):
            return F.struct(div(s["r"], base).alias("r"), (s["x"] + (s["r"] % base) * s["f"]).alias("x"), (s["f"] / base).alias("f"))
        start = F.struct((F.col("id") + 1).alias("r"), F.lit(0.0).alias("x"), F.lit(1.0 / base).alias("f"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), start, step)["x"]

    x, y = halton(2) - 0.5, halton(3) - 0.5
    return t.spark.range(n).where(x * x + y * y <= 0.25).agg(F.count("*").alias("inside"))


def _estimated(t: Tables) -> DataFrame:
    """The estimate from a sample, held against the lines that there are."""
    n, size = t.lines.agg(F.count("*"), F.sum(F.octet_length("value") + 1)).first()
    out = A.estimated_count(t.lines, size, fraction=0.2)
    return out.select(F.expr("low <= estimate AND estimate <= high").alias("within"), (F.abs(F.col("estimate") - n) < 0.2 * n).alias("near"))


# Sorting, partitioning, sampling.
query("O01_key_sort", "SELECT o_custkey, count(*) AS n, true AS together FROM orders GROUP BY o_custkey")(lambda t: _together(O.key_sort(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"])))
query("O02_secondary_sort", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS position FROM events")(lambda t: O.secondary_sort(t.events.select("user_id", "event_id"), "user_id", "event_id"))
query("O03_key_field_sort", "SELECT value, row_number() OVER (ORDER BY CAST(string_split(value, '-')[2] AS BIGINT) DESC, string_split(value, '-')[5], value) AS n FROM items")(lambda t: _spec_sorted(t))
query("O04_key_field_partition", "SELECT value, list_reduce(list_prepend(0::BIGINT, [ord(c)::BIGINT FOR c IN string_split(string_split(value, '-')[3], '')]), lambda h, v: (h * 31 + v) % 4294967296) % 2147483648 % 10 AS p FROM items")(lambda t: t.items.select("value", T.key_partition("value", "-k3,3", 10, "-").cast("bigint").alias("p")))
query("O05_hash_partition", "SELECT o_custkey, count(*) AS n, 1::BIGINT AS partitions, true AS known FROM orders GROUP BY o_custkey")(lambda t: t.orders.repartition(8, "o_custkey").withColumn("p", F.spark_partition_id()).groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("p").alias("partitions"), (F.max("p") < 8).alias("known")))
query("O06_binary_partition", "SELECT c_custkey, (list_reduce(list_prepend(1::BIGINT, [ord(c)::BIGINT FOR c IN string_split(right(c_name, 3), '')]), lambda h, v: (h * 31 + v) % 4294967296) % 2147483648 % 10)::INT AS p FROM customer")(lambda t: t.customer.select("c_custkey", T.binary_partition(F.col("c_name"), 10, -3, -1).alias("p")))
query("O07_range_partition", "SELECT o_orderkey, ((o_custkey >= 100)::INT + (o_custkey >= 500)::INT + (o_custkey >= 1000)::INT) AS p FROM orders")(lambda t: t.orders.select("o_orderkey", T.range_partition(F.col("o_custkey"), [100, 500, 1000]).alias("p")))
query("O08_split_points", "SELECT i, o_orderkey AS key FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders) JOIN range(1, 8) t(i) ON place = i * n // 8")(lambda t: _split_points(t, t.orders))
query("O08_split_sampler")(lambda t: _split_points(t, S.first_of_each(t.orders.select("o_orderkey"), 1000)))
query("O08_random_sampler")(lambda t: _split_points(t, S.by_ratio(t.orders.select("o_orderkey"), 0.1)))
query("O08_interval_sampler")(lambda t: _split_points(t, S.interval_of_each(t.orders.select("o_orderkey"), 0.1)))
query("O09_total_order", "SELECT o_orderkey, o_orderdate, n FROM (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)")(lambda t: O.numbered(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey"))
query("O10_sort_rows", "SELECT 0::BIGINT AS errors, 20000::BIGINT AS n, true AS same_rows, true AS places")(lambda t: _sort_benchmark(t, 20_000))
query("O11_sample_ratio", "SELECT true AS known, true AS distinct_rows, true AS near, true AS spread FROM range(1)")(lambda t: _sampled(t))
query("O11_sample_count", "SELECT least(count(*), 500) AS n FROM orders")(lambda t: S.by_count(t.orders, 500).agg(F.count("*").alias("n")))
query("O12_shuffle", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, true AS moved FROM orders")(lambda t: _shuffled(t))
query("O13_descending", "SELECT l_suppkey, n, row_number() OVER (ORDER BY n DESC, l_suppkey) AS place FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)")(lambda t: O.numbered(A.value_counts(t.lineitem, "l_suppkey").withColumn("k", -F.col("n")), "k", "l_suppkey", name="place").drop("k"))


def _split_points(t: Tables, sample: DataFrame) -> DataFrame:
    """The seven points that cut the sample's order keys in eight ranges."""
    return t.spark.createDataFrame(list(enumerate(S.split_points(sample, "o_orderkey", 8), 1)), "i long, key long")


def _together(sorted_rows: DataFrame) -> DataFrame:
    """Each key's rows, and whether they lie side by side."""
    placed = sorted_rows.withColumn("i", F.monotonically_increasing_id())
    return placed.groupBy("o_custkey").agg(F.count("*").alias("n"), (F.max("i") - F.min("i") + 1 == F.count("*")).alias("together"))


def _sort_benchmark(t: Tables, n: int) -> DataFrame:
    """Rows made, sorted and validated: keys that fall, and whether the sorted rows are those that were made, by a checksum of each."""
    rows = files.sort_rows(t.spark, n)
    check = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.crc32(F.concat("key", "row_id", "filler"))).alias("sums"))
    made, done = check(rows), O.numbered(rows, "key", "row_id")
    errors = O.order_errors(done, "key", "n").agg(F.count("*").alias("errors"))
    after = check(done.drop("n")).crossJoin(done.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count_distinct("n").alias("all_places")))  # one row each
    out = errors.crossJoin(made.select(F.col("n").alias("was"), F.col("sums").alias("had"))).crossJoin(after)
    return out.select("errors", "n", F.expr("n = was AND sums = had").alias("same_rows"), F.expr("low = 1 AND high = n AND all_places = n").alias("places"))


def _sampled(t: Tables) -> DataFrame:
    """A sample by ratio, held against its table: rows of it, none twice, about a tenth, from all of it."""
    n, high = t.orders.agg(F.count("*"), F.max("o_orderkey")).first()
    got = S.by_ratio(t.orders, 0.1).select("o_orderkey")
    known = got.join(t.orders.select(F.col("o_orderkey").alias("k")), F.col("o_orderkey") == F.col("k"), "left_semi").agg(F.count("*").alias("k"))
    out = got.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("d"), F.count_distinct(F.floor(F.col("o_orderkey") * 10 / (high + 1))).alias("tenths")).crossJoin(known)  # one row each
    return out.select(F.expr("n = k").alias("known"), F.expr("n = d").alias("distinct_rows"), (F.abs(F.col("n") - 0.1 * n) <= 5 * (0.09 * n) ** 0.5).alias("near"), F.expr("tenths = 10").alias("spread"))


def _shuffled(t: Tables) -> DataFrame:
    """All rows, and whether neighbours have come apart: a third of the steps between rows go back."""
    placed = S.shuffled(t.orders.select("o_orderkey")).withColumns({"i": F.monotonically_increasing_id(), "p": F.spark_partition_id()})
    back = placed.withColumn("before", F.lag("o_orderkey").over(Window.partitionBy("p").orderBy("i")))
    return back.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), (F.sum((F.col("before") > F.col("o_orderkey")).cast("bigint")) > F.count("*") / 3).alias("moved"))


def _spec_sorted(t: Tables) -> DataFrame:
    """The order of ``-k2,2nr -k5,5`` as plain columns, so that ranges can be laid on it."""
    (number, _, _), (flag, _, _) = T.key_parts("value", "-k2,2nr -k5,5", "-")
    keyed = t.items.select("value", (-T.number(number)).alias("k0"), flag.alias("k1"))
    return O.numbered(keyed, "k0", "k1", "value").select("value", "n")


# Projection and text.
query("P01_field_selection", "SELECT array_to_string([f[7], f[6], f[2], f[3], f[4]], '-') AS key, array_to_string(f, '-') AS value FROM (SELECT string_split(value, '-') AS f FROM items)")(lambda t: T.field_selection(t.items, "6,5,1-3:0-", separator="-"))
query("P03_inverse", "SELECT o_custkey AS key, o_orderkey AS value FROM orders")(lambda t: O.inverse(t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value"))))
WORDS = "(SELECT unnest(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f]+')) AS word FROM documents)"
query("P04_token_count", f"SELECT word, count(*) AS n FROM {WORDS} WHERE word <> '' GROUP BY word")(lambda t: A.value_counts(t.documents.select(F.explode(T.tokens()).alias("word")), "word"))
query("P05_regex_matches", "SELECT m, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), 'th[a-z]+')) AS m FROM documents) GROUP BY m")(lambda t: A.value_counts(t.documents.select(F.explode(T.matches(F.coalesce("text", F.lit("")), "th[a-z]+")).alias("m")), "m"))
query("P07_chain", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 1000 GROUP BY o_custkey")(lambda t: t.orders.transform(lambda d: d.where("o_orderstatus <> 'F'")).transform(lambda d: d.where("o_totalprice > 1000")).groupBy("o_custkey").agg(F.count("*").alias("n")))
query("P09_skip_bad_records", "SELECT count(*) FILTER (try_cast(p AS BIGINT) IS NULL) AS bad, sum(try_cast(p AS BIGINT))::BIGINT AS total FROM (SELECT string_split(value, '-')[5] AS p FROM items UNION ALL SELECT string_split(value, '-')[1] FROM items)")(lambda t: t.items.select(F.explode(F.array(F.get(F.split("value", "-"), F.lit(4)), F.get(F.split("value", "-"), F.lit(0)))).alias("p")).select(F.col("p").try_cast("bigint").alias("v")).agg(F.sum(F.col("v").isNull().cast("bigint")).alias("bad"), F.sum("v").alias("total")))

# Programs.
query("E01_wordcount", f"SELECT word, count(*) AS n FROM {WORDS} WHERE word <> '' GROUP BY word")(lambda t: t.documents.select(F.explode(T.tokens()).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
query("E02_aggregate_wordcount", f"SELECT 'LongValueSum' AS type, word AS id, CAST(count(*) AS VARCHAR) AS value FROM {WORDS} WHERE word <> '' GROUP BY word")(lambda t: A.keyed(t.documents.select(F.lit("LongValueSum").alias("type"), F.explode(T.tokens()).alias("id"), F.lit("1").alias("value"))))
query("E03_word_histogram", "SELECT count(*) AS n_values, min(n) AS least, list_sort(list(n))[count(*) // 2 + 1] AS median, max(n) AS largest, round(avg(n), 6) AS mean, round(stddev_pop(n), 4) AS stddev FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(coalesce(text, ''), '[ \\t]')) AS word FROM documents) GROUP BY word)")(lambda t: A.histogram(t.documents.select(F.explode(T.pieces()).alias("value"))).withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 4)}))
query("E04_grep", "SELECT count(*) AS n, m FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[a-z]+tion')) AS m FROM documents) GROUP BY m")(lambda t: A.value_counts(t.documents.select(F.explode(T.matches(F.coalesce("text", F.lit("")), "[a-z]+tion")).alias("m")), "m").orderBy(F.desc("n"), "m").select("n", "m"))
query("E05_sort", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")(lambda t: O.numbered(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", name="place"))
query("E06_secondarysort", "SELECT l_orderkey AS a, l_partkey AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber)::INT AS position FROM lineitem")(lambda t: t.lineitem.withColumn("position", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber"))).select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), "position"))
query("E07_join", "SELECT o_orderkey AS k, o_custkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey")(lambda t: J.inner_join(t.orders.select(F.col("o_orderkey").alias("k"), "o_custkey"), t.lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber"), key="k").groupBy("k", "s0.o_custkey").agg(F.count("*").alias("n")))
query("E08_multifile_wordcount", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f]+')) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)) WHERE word <> '' GROUP BY word")(lambda t: files.multiple_inputs((t.documents, lambda d: d.select("text")), (t.benchmark, lambda d: d.select("text"))).select(F.explode(T.tokens()).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
query("E09_pageview_count", "SELECT event_type AS url, count(*) AS pageview FROM events GROUP BY event_type")(lambda t: t.events.groupBy(F.col("event_type").alias("url")).agg(F.count("*").alias("pageview")))
query("E09_database_pageviews", "SELECT event_type AS url, count(*) AS pageview, (SELECT count(*) FROM events) AS total FROM events GROUP BY event_type")(lambda t: _pageviews(t))


def _pageviews(t: Tables) -> DataFrame:
    """Accesses counted by url, the counts kept in a database, and their sum held against the number of accesses."""
    counts = t.events.groupBy(F.col("event_type").alias("url")).agg(F.count("*").alias("pageview"))
    url, properties = files.embedded_database(counts, shared_path(t.spark, "database"), "PAGEVIEW")
    back = files.read_table(t.spark, url, "PAGEVIEW", properties=properties)
    return back.join(F.broadcast(back.agg(F.sum("pageview").cast("bigint").alias("total"))))  # one row


query("U05_pipe", "SELECT upper(o_orderstatus || '-' || o_orderpriority) AS value FROM orders")(lambda t: pipe(t.orders.select(F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("value")), ["tr", "a-z", "A-Z"]))
query("U05_map_reduce", "SELECT o_orderpriority || chr(9) || count(*) AS value FROM orders GROUP BY o_orderpriority")(lambda t: _piped_count(t))


def _piped_count(t: Tables) -> DataFrame:
    return map_reduce(t.orders.select(F.col("o_orderpriority").alias("value")), ["sed", "s/.*/LongValueSum:&\\t1/"], "aggregate")


query("X01_inverted_index", "SELECT term, count(*) AS n_docs, sum(n)::BIGINT AS n_uses, min(doc_id) AS first_doc FROM (SELECT doc_id, word AS term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f]+')) AS word FROM documents) WHERE word <> '' GROUP BY doc_id, word) GROUP BY term")(lambda t: _inverted(t))


def _inverted(t: Tables) -> DataFrame:
    from ..operators.inverted import summary

    return summary(t.documents, "doc_id", "text")


def _per_file(t: Tables) -> DataFrame:
    """The records of each file, files being known by the folder that they were written to."""
    path = shared_path(t.spark, "files")
    files.write_routed(t.orders.select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    read = t.spark.read.parquet(path).select(F.input_file_name().alias("name"))
    return read.groupBy(F.regexp_extract("name", "o_orderstatus=([^/]*)/", 1).alias("file")).agg(A.TYPES["LongValueSum"](F.lit(1)).alias("n"))


ADD_UP = ["awk", "-F", "\t", "-v", "OFS=\t", "{n[$1 FS $2] += $3} END {for (k in n) print k, n[k]}"]
query("U05_reducer", "SELECT o_orderstatus || chr(9) || o_orderpriority || chr(9) || count(*) AS value FROM orders GROUP BY o_orderstatus, o_orderpriority")(lambda t: map_reduce(t.orders.select(F.concat_ws("\t", "o_orderstatus", "o_orderpriority").alias("value")), ["sed", "s/$/\t1/"], ADD_UP, key_fields=2, combiner=ADD_UP, partition_fields=1))
TERMS = "SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f]+')) AS term FROM documents"
query("X01_index_search", f"SELECT doc_id, count(*) AS n_uses FROM ({TERMS}) WHERE term IN ('the', 'of') GROUP BY doc_id HAVING count(DISTINCT term) = 2")(lambda t: _searched(t))
query("X01_index_update", "SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, '') || CASE WHEN doc_id % 3 = 1 THEN ' changed now' ELSE '' END, '[ \\t\\n\\r\\f]+')) AS term FROM documents WHERE doc_id % 3 <> 2) WHERE term <> '' GROUP BY doc_id, term")(lambda t: _updated(t))


def _index(t: Tables) -> DataFrame:
    from ..operators import inverted

    path = shared_path(t.spark, "inverted")
    inverted.build(t.documents, path, "doc_id", "text")
    return t.spark.read.parquet(path)


def _searched(t: Tables) -> DataFrame:
    """Documents that hold both words, from the written index."""
    from ..operators import inverted

    return inverted.search(_index(t), ["the", "of"], "doc_id")


def _updated(t: Tables) -> DataFrame:
    """The postings of a written index after changes to it: of each three documents one stays, one gets another text, one goes."""
    from ..operators import inverted

    changes = t.documents.where("doc_id % 3 <> 0").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" changed now")).alias("text"), F.expr("if(doc_id % 3 = 1, 'update', 'delete')").alias("op"))
    return inverted.update(_index(t), changes, "doc_id", "text").select("doc_id", "term", "n")


# The rest of the library's surface.
query("A13_per_file_count", "SELECT o_orderstatus AS file, count(*) AS n FROM orders GROUP BY o_orderstatus")(lambda t: _per_file(t))
query("P02_identity", "SELECT o_orderkey, o_custkey FROM orders")(lambda t: t.orders.select("o_orderkey", "o_custkey"))
FILTERED = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"


def _filtered(kind: str):
    """Lines that a filter of some orders lets through, then held against the orders themselves."""
    def run(t: Tables) -> DataFrame:
        some = t.orders.where("o_orderstatus = 'P'").select("o_orderkey")
        held = getattr(bloom, kind)(some, "o_orderkey", max(1, some.count())).may_hold(t.lineitem.select("l_orderkey", "l_linenumber"), "l_orderkey")
        return held.join(some, held.l_orderkey == some.o_orderkey, "left_semi")

    return run


for _kind in ("plain", "counting", "dynamic"):
    query(f"P08_bloom_{_kind}", FILTERED)(_filtered(_kind))


def _retouched(t: Tables) -> DataFrame:
    """A filter of some orders that must not let given other keys through: whether it does, and whether it did before."""
    some, other = (t.orders.where(f"o_orderstatus {op} 'P'").select("o_orderkey") for op in ("=", "<>"))
    held = bloom.counting(some, "o_orderkey", max(1, some.count()), 0.3)
    unwanted = held.may_hold(other, "o_orderkey").select(F.xxhash64("o_orderkey").alias("h")).orderBy("h").limit(100).toArrow().column("h").to_numpy()
    before = bool(len(unwanted)) and bool(held.holds(unwanted).all())
    return t.spark.createDataFrame([(before, bool(bloom.retouch(held, unwanted).holds(unwanted).any()))], "before boolean, after boolean")


query("P08_bloom_retouched", "SELECT true AS before, false AS after")(_retouched)


def _globbed(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "glob")
    t.customer.select(F.col("c_name").alias("value")).write.text(f"{path}/kept.d")
    t.supplier.select(F.col("s_name").alias("value")).write.text(f"{path}/_logs")
    return files.read_lines(t.spark, f"{path}/kept.d", glob="part-*")


query("P10_path_filter", "SELECT c_name AS value FROM customer")(_globbed)
query("K02_whole_distances", "SELECT id, x, y, floor(sqrt(((x-5000)*(x-5000)+(y-5000)*(y-5000))::DOUBLE)) AS distance FROM pt_customer ORDER BY distance, id, x, y LIMIT 50")(lambda t: Q.knn(t.pt_customer, 5000, 5000, 50, whole=True))
query("Q07_own_cell_filter", "SELECT DISTINCT id FROM rect_orders WHERE x < 2525 AND x + width > 0")(lambda t: build(t.rect_orders, shared_path(t.spark, "index"), GR.Grid(0, 0, 10100, 10100, 4, 4)).pruned(t.spark, lambda cells: [c[0] for c in cells if c[1] == 0]).where("is_home OR x < 2525").select("id").distinct())
query("S05_shape_batches", "SELECT count(*) AS n, sum(width * height)::BIGINT AS area FROM rect_orders")(lambda t: files.shape_batches(t.rect_orders, _batch_area, "n long, area long").agg(F.sum("n").alias("n"), F.sum("area").alias("area")))
query("S20_many_files", "SELECT c_name AS value FROM customer UNION ALL SELECT s_name FROM supplier")(lambda t: files.read_lines(t.spark, [_lines_back(t, d.select(F.col(c).alias("value")))[1] for d, c in ((t.customer, "c_name"), (t.supplier, "s_name"))]))
query("S27_named_outputs", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")(lambda t: _named_outputs(t))
query("U01_own_mapper", "SELECT o_orderkey, o_custkey % 7 AS r FROM orders WHERE o_custkey % 7 < 3")(lambda t: t.orders.select("o_orderkey", "o_custkey").mapInArrow(_own_mapper, "o_orderkey long, r long"))
query("U04_own_aggregate", "SELECT 'LongValueSpan' AS type, 'keys' AS id, CAST(max(o_orderkey) - min(o_orderkey) AS VARCHAR) AS value FROM orders")(lambda t: _own_aggregate(t))
query("U09_side_data", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")(lambda t: t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name"))
query("R_union", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")(lambda t: t.customer.select(F.col("c_nationkey").alias("k")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"))))


def _batch_area(batch):
    area = pc.sum(pc.multiply(batch.column("width"), batch.column("height"))).as_py()
    return pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([area or 0], pa.int64())], ["n", "area"])


def _own_mapper(batches):
    for batch in batches:
        rest = pa.array(batch.column("o_custkey").to_numpy() % 7, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("o_orderkey"), rest], ["o_orderkey", "r"]).filter(pc.less(rest, 3))


def _named_outputs(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "named")
    files.write_named(t.orders.select("o_orderkey", "o_totalprice"), {"dear": (F.col("o_totalprice") > 100000, f"{path}/dear"), "cheap": (F.col("o_totalprice") <= 100000, f"{path}/cheap")})
    return t.spark.read.parquet(f"{path}/dear").select("o_orderkey")


def _own_aggregate(t: Tables) -> DataFrame:
    A.register("LongValueSpan", lambda v: F.max(v.cast("bigint")) - F.min(v.cast("bigint")))
    return A.named(t.orders, [("LongValueSpan", "keys", F.col("o_orderkey"))])

"""Small cases with known answers, and properties that must hold for any data."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridmill.functions import bloom
from gridmill.functions import geometry as G
from gridmill.functions import text as T
from gridmill.functions.geometry import Box
from gridmill.operators import aggregates as A
from gridmill.operators import grid as GR
from gridmill.operators import inverted, keyjoin, sampling, selection, sorting
from gridmill.operators import spatial_join as SJ
from gridmill.operators.index import build, load
from gridmill.sources import files
from gridmill.streaming.pipe import pipe


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def boxes(spark, n, seed, span=1000, side=60):
    r = random.Random(seed)
    data = [(i, r.randrange(-50, span), r.randrange(-50, span), r.randrange(0, side), r.randrange(0, side)) for i in range(n)]
    edge = [(n, 0, 0, 0, 0), (n + 1, span // 2, span // 2, 0, 0), (n + 2, 0, 0, 0, 0), (n + 3, -10, -10, 5, 5)]
    return spark.createDataFrame(data + edge, "id long, x long, y long, width long, height long")


@pytest.mark.parametrize("kind", ["grid", "str"])
def test_index_gives_what_the_heap_gives(spark, tmp_path, kind):
    df = boxes(spark, 400, 3)
    index = build(df, str(tmp_path / "i"), 16, kind)
    assert rows(index.home(spark)) == rows(df)
    again = load(spark, str(tmp_path / "i"))
    assert again.cells.bounds() == index.cells.bounds()
    for q in [(100, 100, 300, 200), (-100, -100, 2000, 2000), (500, 500, 1, 1), (-20, -20, 30, 30), (5000, 5000, 10, 10)]:
        assert rows(selection.indexed_range_query(spark, again, q)) == rows(selection.range_query(df, q)), q


@pytest.mark.parametrize("point", [(500, 500), (-3000, 40), (2500, 2500)])
def test_indexed_knn(spark, tmp_path, point):
    df = boxes(spark, 300, 4).where("width > 0 and height > 0")
    index = build(df, str(tmp_path / "i"), 12)
    for k in (1, 7, 1000):
        assert rows(selection.indexed_knn(spark, index, *point, k, Box())) == rows(selection.knn(df, *point, k, Box()))


@pytest.mark.parametrize("point", [(350, 200), (-3000, 40), (1200, 1200)])
def test_indexed_knn_by_nearest_side(spark, tmp_path, point):
    df = boxes(spark, 300, 4).where("width > 0 and height > 0")
    for name, cells in (("all", 12), ("some", GR.Grid(200, 100, 400, 500, 4, 4))):
        index = build(df, str(tmp_path / name), cells)
        for k in (1, 7, 1000):
            got = selection.indexed_knn(spark, index, *point, k, Box(), measure="min")
            assert rows(got) == rows(selection.knn(df, *point, k, Box(), measure="min")), (name, k)


def test_knn_join_by_brute_force(spark):
    r = random.Random(5)
    points = [(i, r.randrange(-50, 300), r.randrange(0, 900)) for i in range(200)] + [(200 + i, 7, 7) for i in range(100)] + [(300, None, 1)]
    asked = [(i, r.randrange(-600, 900), r.randrange(-600, 1500)) for i in range(60)] + [(60, 7, 7), (60, 7, 7), (60, 8, 8), (None, 40_000, 0), (61, None, 0)]
    df, queries = spark.createDataFrame(points, "id long, x long, y long"), spark.createDataFrame(asked, "query_id long, qx long, qy long")
    for k in (1, 4, 500):
        want = []
        for i, x, y in {a for a in asked if a[1] is not None}:
            near = sorted(((p[1] - x) ** 2 + (p[2] - y) ** 2, p[0]) for p in points if p[1] is not None)[:k]
            want += [(i, x, y, p, d, n) for n, (d, p) in enumerate(near, 1)]
        assert sorted(map(str, map(tuple, selection.knn_join(df, queries, k).collect()))) == sorted(map(str, want)), k
    assert selection.knn_join(df.limit(0), queries, 3).count() == selection.knn_join(df, queries.limit(0), 3).count() == 0


def test_spatial_joins_agree(spark, tmp_path):
    a, b = boxes(spark, 200, 5), boxes(spark, 150, 6)
    want = rows(a.alias("l").crossJoin(b.alias("r")).where("l.x + l.width > r.x and r.x + r.width > l.x and l.y + l.height > r.y and r.y + r.height > l.y").select("l.id", "r.id"))
    cells = GR.Grid.of(-100, -100, 1300, 1300, 20)
    pairs = lambda d: rows(d.select("l_id", "r_id"))
    assert pairs(SJ.spatial_join(a, b, cells)) == want
    assert pairs(SJ.sweep_join(a, b, cells)) == want
    left, right = build(a, str(tmp_path / "a"), cells), build(b, str(tmp_path / "b"), GR.Grid.of(-100, -100, 1300, 1300, 7))
    assert pairs(SJ.join_indexed(spark, left, right, "no")) == want
    assert pairs(SJ.join_indexed(spark, left, right, "yes")) == want
    assert pairs(SJ.join_indexed(spark, left, right)) == want


def test_empty_tables(spark, tmp_path):
    empty = boxes(spark, 0, 1).limit(0)
    index = build(empty, str(tmp_path / "i"), 4)
    assert selection.indexed_range_query(spark, index, (0, 0, 10, 10)).count() == 0
    assert SJ.spatial_join(empty, boxes(spark, 10, 2), GR.Grid(0, 0, 10, 10)).count() == 0
    assert A.histogram(empty, "x").first().n_values in (None, 0)
    assert sorting.order_errors(empty.select("id", "x"), "x", "id").count() == 0


def test_polygons_and_circles(spark):
    df = spark.createDataFrame([(1, [0, 10, 0], [0, 0, 10]), (2, [8, 20, 20], [8, 8, 20])], "id long, xs array<int>, ys array<int>")
    assert rows(df.where(G.polygon_overlaps("xs", "ys", Box(7, 7, 2, 2))).select("id")) == [(2,)]
    assert rows(df.where(G.polygon_overlaps("xs", "ys", Box(1, 1, 1, 1))).select("id")) == [(1,)]
    p = spark.createDataFrame([(1, 9, 9), (2, 0, 9)], "id long, x long, y long")
    assert rows(p.where(G.circle_overlaps(0.0, 0.0, 10.0, G.point_box())).select("id")) == [(2,)]


def test_aggregate_case(spark):
    lines = [(f"{i:02d}", i) for i in range(1, 20) for _ in range(i)]
    df = spark.createDataFrame(lines, "w string, n long")
    got = {r.id: r.value for r in A.named(df, [("LongValueMax", "max", F.col("n")), ("LongValueMin", "min", F.col("n")), ("StringValueMax", "smax", F.col("n")), ("StringValueMin", "smin", F.col("n"))]).collect()}
    assert got == {"max": "19", "min": "1", "smax": "9", "smin": "1"}
    assert df.agg(A.uniq_count(F.col("w"), 14).alias("n")).first().n == 15
    assert A.value_counts(df, "w").where("w = '07'").first().n == 7
    h = A.histogram(df, "w").first()
    assert (h.n_values, h.least, h.median, h.largest, h.mean) == (19, 1, 10, 19, 10.0)


def test_field_selection_case(spark):
    df = spark.createDataFrame([("3-4-5-6-7-8-9",), ("1-2",)], "value string")
    got = T.field_selection(df, "6,5,1-3:0-", separator="-").collect()
    assert tuple(got[0]) == ("9-8-4-5-6", "3-4-5-6-7-8-9")
    assert tuple(got[1]) == ("--2--", "1-2")
    again = T.field_selection(df.limit(1).select(F.lit("a-b-").alias("k"), "value"), ":4,3,2,1,0,0-", key="k", separator="-").first()
    assert again.value == "5-4-3-b-a-a-b-3-4-5-6-7-8-9"


LINES = ("123 -123 005120 123.9 0.01 0.18 010 10.0 4444.1 011 011 234", "134 -12 005100 123.10 -1.01 0.19 02 10.1 4444")


@pytest.mark.parametrize(("spec", "first"), [("-k1,1n", 1), ("-k2,2n", 1), ("-k2.2,2n", 2), ("-k3.4,3n", 2), ("-k3.2,3.3n -k4,4n", 2), ("-k3.2,3.3n -k4,4nr", 1), ("-k2.4,2.4n", 2), ("-k7,7", 1), ("-k7,7n", 2), ("-k8,8n", 1), ("-k9,9", 2), ("-k11,11", 2), ("-k10,10", 2)])
def test_key_specs(spark, spec, first):
    df = spark.createDataFrame([(x,) for x in LINES], "key string")
    assert sorting.sort_by_spec(df, spec, separator=" ").first().key == LINES[first - 1]


def test_range_partition_case(spark):
    splits = "aabbb babbb daddd dddee ddhee dingo hijjj n yak".split()
    keys = {"aaaaa": 0, "aaabb": 0, "aabbb": 1, "babbb": 2, "baabb": 1, "yai": 8, "yak": 9, "z": 9, "ddngo": 5, "hi": 6}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r.k: r.p for r in df.select("k", T.range_partition(F.col("k"), splits).alias("p")).collect()} == keys
    with pytest.raises(ValueError):
        T.range_partition(F.col("k"), ["b", "a"])


def test_keyed_joins(spark):
    f = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    a, b, c = f((1, "a"), (1, "b"), (2, "c")), f((1, "d"), (1, "e"), (3, "f")), f((3, "g"), (None, "h"))
    assert keyjoin.inner_join(a, b, key="k").count() == 4
    outer = {r.k: r.present for r in keyjoin.outer_join(a, b, c, key="k").where("k is not null").collect()}
    assert outer == {1: 3, 2: 1, 3: 6}
    assert rows(keyjoin.override_join(a, b, c, key="k").where("k is not null").select("k", "v")) == [(1, "d"), (1, "e"), (2, "c"), (3, "g")]
    read = keyjoin.JoinExpression({"a": a, "b": b}, "k")
    assert read('inner(tbl("a"), tbl(b))').count() == 4
    for bad in ("inner(tbl(a)", "what(tbl(a))", "tbl(a) tbl(b)", "inner(tbl(a);tbl(b))"):
        with pytest.raises((ValueError, KeyError)):
            read(bad)
    assert keyjoin.tagged_join({"a": a, "b": b}, "k", "anti").count() == 1


def test_database_ranges():
    assert files.split_ranges(0, 10, 2, "c") == ["c >= 0 AND c < 5", "c >= 5 AND c <= 10"]
    assert files.split_ranges(3, 3, 4, "c") == ["c >= 3 AND c <= 3"]
    assert files.split_ranges(None, 3, 2, "c")[0] == "c IS NULL"
    texts = files.split_points("aardvark", "azure", 4)
    assert texts == sorted(texts) and texts[0] == "aardvark" and texts[-1] == "azure" and len(texts) == 5
    days = files.split_points(datetime.date(2020, 1, 1), datetime.date(2020, 1, 9), 4)
    assert days[1] == datetime.date(2020, 1, 3)


def test_text_lines(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), (None, "2"), ("c", None), (None, None), ("d", "x\ty")], "key string, value string")
    files.write_key_values(df, str(tmp_path / "kv"))
    assert rows(files.read_key_values(spark, str(tmp_path / "kv"))) == sorted([("a", "1"), ("2", ""), ("c", ""), ("d", "x\ty")], key=repr)
    shapes = spark.createDataFrame([("7,-1.5,2.25,-1.25,2.0,road,a",), ("junk",)], "line string")
    got = shapes.select(*(c.alias(n) for n, c in files.parse_shape(F.col("line"), "boundary").items())).collect()
    assert tuple(got[0]) == (7, -15000000000, 20000000000, 2500000000, 2500000000, "road,a")
    assert got[1].id is None
    assert [files.infer_shape(s) for s in ("1,2", "1,2,3,4", "1,2,3,4,5,6")] == ["point", "rectangle", "boundary"]


def test_xml_records(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<all>\n<r a="1"><b>x</b></r> <r><b>y\nz</b></r></all>')
    assert files.xml_records(spark, str(tmp_path / "x.xml"), "r").count() == 2
    assert rows(files.read_xml(spark, str(tmp_path / "x.xml"), "r", "b string")) == [("x",), ("y\nz",)]


def test_pipe(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "value string").coalesce(1)
    assert rows(pipe(df, ["sort"])) == [("a",), ("b",)]
    assert rows(pipe(df, ["sh", "-c", "echo $X"], env={"X": "7"})) == [("7",)]
    with pytest.raises(Exception, match="status 3"):
        pipe(df, ["sh", "-c", "exit 3"]).collect()


def test_order_errors(spark):
    df = spark.createDataFrame([(i, i if i != 150_000 else 3) for i in range(149_990, 150_010)] + [(99_999, 9), (100_000, 8)], "n long, k long")
    assert rows(sorting.order_errors(df, "k", "n").select("n")) == [(100_000,), (150_000,)]


def test_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert sampling.by_count(df, 10).count() == 10
    assert rows(sampling.by_count(df, 10, 7)) == rows(sampling.by_count(df.repartition(5), 10, 7))
    assert sampling.split_points(df, "k", 4) == [250, 500, 750]
    assert sampling.first_of_each(df.repartition(4), 2).count() == 8
    assert 30 < sampling.by_digest(df, "k", 20).count() < 70


def test_bloom_filters(spark):
    df = spark.range(500)
    for kind in (bloom.plain, bloom.counting, bloom.dynamic):
        f = kind(df, "id", 500)
        hit = {r.id for r in f.may_hold(spark.range(5000), "id").collect()}
        assert set(range(500)) <= hit and len(hit) < 800, kind
    f = bloom.counting(df, "id", 500)
    f.remove([3])
    assert 3 not in {r.id for r in f.may_hold(spark.range(10), "id").collect()}


def test_inverted_index(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "")], "id long, t string")
    index = inverted.postings(docs, "id", "t").withColumn("shard", inverted.shard_of("id", 4))
    assert rows(inverted.search(index, ["a", "b"], "id")) == [(1, 3)]
    changes = spark.createDataFrame([(1, None, "delete"), (2, "a b", "update"), (5, "b a", "insert")], "id long, t string, op string")
    assert rows(inverted.search(inverted.update(index, changes, "id", "t", 4), ["a", "b"], "id")) == [(2, 2), (5, 2)]

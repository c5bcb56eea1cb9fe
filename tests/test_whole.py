"""Each query or operator does the whole job: nothing that belongs to a result is left out."""

import random
import re
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from gridmill.functions import bloom, text
from gridmill.operators import grid as GR
from gridmill.operators import inverted, keyjoin, sampling
from gridmill.operators import spatial_join as SJ
from gridmill.operators.index import build
from gridmill.plans import queries as plans
from gridmill.sources import files


@pytest.mark.parametrize(("name", "rows"), [("J08_inner_join", None), ("J09_outer_join", None), ("J10_override_join", 25), ("J11_join_expression", None)])
def test_key_joins_read_whole_tables(spark, name, rows):
    sf = "/root/testdata/sf0.01"
    got = plans.QUERIES[name](spark, sf)
    if rows:
        assert got.count() == rows
    else:
        matched = spark.read.parquet(f"{sf}/customer.parquet").join(spark.read.parquet(f"{sf}/supplier.parquet"), [plans.F.col("c_nationkey") == plans.F.col("s_nationkey")], "left_semi")
        assert {r[0] for r in got.where("v0 is not null and v1 is not null").select("v0").collect()} == {r.c_custkey for r in matched.collect()}


def test_descending_numbers_all_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = plans.QUERIES["O13_descending"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey").distinct().count() > 100
    assert sorted(r.place for r in got) == list(range(1, len(got) + 1))


def test_indexed_joins_agree_beyond_the_cells(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    frames = [spark.createDataFrame([(i, r.randrange(-300, 900), r.randrange(-300, 900), r.randrange(0, 90), r.randrange(0, 90)) for i in range(250)], "id long, x long, y long, width long, height long") for _ in range(2)]
    a, b = frames
    want = sorted(map(tuple, a.alias("l").crossJoin(b.alias("r")).where("l.x + l.width > r.x and r.x + r.width > l.x and l.y + l.height > r.y and r.y + r.height > l.y").select("l.id", "r.id").collect()))
    for n, (left_cells, right_cells) in enumerate([(GR.Grid(0, 0, 400, 400, 4, 4), GR.Grid(0, 0, 400, 400, 3, 3)), (GR.Grid(0, 0, 300, 300, 3, 3), GR.Grid(-300, -300, 1300, 1300, 5, 5)), (GR.Grid(-300, -300, 200, 200, 2, 2), GR.Grid(500, 500, 200, 200, 2, 2))]):
        left, right = build(a, str(tmp_path / f"a{n}"), left_cells), build(b, str(tmp_path / f"b{n}"), right_cells)
        for way in ("no", "yes", "auto"):
            assert sorted(map(tuple, SJ.join_indexed(spark, left, right, way).select("l_id", "r_id").collect())) == want, (n, way)
    monkeypatch.setattr(SJ, "MAX_PAIRS", 0)
    assert sorted(map(tuple, SJ.join_indexed(spark, build(a, str(tmp_path / "a"), GR.Grid(0, 0, 400, 400, 4, 4)), right, "no").select("l_id", "r_id").collect())) == want


def test_split_points_cut_all_rows(spark):
    n = 2_400_000
    got = sampling.split_points(spark.range(0, n, 1, 4), "id", 8)
    assert len(got) == 7 and all(abs(p - n * i / 8) < n / 200 for i, p in enumerate(got, 1))


def test_interval_sampler(spark):
    got = [r.id for r in sampling.interval_of_each(spark.range(0, 2000, 1, 2), 0.1).collect()]
    assert len(got) == 200 and got[:3] == [0, 10, 20] and got[100] == 1000


def test_given_cells_are_cut_and_carried_on(spark, monkeypatch):
    r = random.Random(9)
    a, b = (spark.createDataFrame([(i, r.randrange(-300, 900), r.randrange(-300, 900), r.randrange(0, 40), r.randrange(0, 40)) for i in range(900)], "id long, x long, y long, width long, height long") for _ in range(2))
    want = sorted(map(tuple, a.alias("l").crossJoin(b.alias("r")).where("l.x + l.width > r.x and r.x + r.width > l.x and l.y + l.height > r.y and r.y + r.height > l.y").select("l.id", "r.id").collect()))
    given = GR.Grid(100, 100, 300, 300, 1, 1)
    laid = SJ._laid(a, b, given, 16)
    corners = {c[1:3] for c in laid.bounds()}
    assert {(100, 100), (400, 400)} <= corners and max(max(c[3:]) for c in laid.bounds()) <= 150
    monkeypatch.setattr(SJ, "SWEEP_AT_ONCE", 100)
    monkeypatch.setattr(SJ, "PAIRS_AT_ONCE", 50)
    for cells in (given, None, GR.Grid(0, 0, 10, 10, 5, 5), GR.Grid(-1000, -1000, 4000, 4000, 1, 1)):
        assert sorted(map(tuple, SJ.sweep_join(a, b, cells, ["l_id", "r_id"]).collect())) == want
        assert sorted(map(tuple, SJ.spatial_join(a, b, cells).select("l_id", "r_id").collect())) == want


def test_split_points_are_exact_beyond_the_driver(spark, monkeypatch):
    df = spark.range(0, 3000, 1, 4).selectExpr("if(id < 900, 7, id * 7919 % 3001) AS k")
    want = sampling.split_points(df, "k", 8)
    monkeypatch.setattr(sampling, "MAX_KEYS", 100)
    assert sampling.split_points(df, "k", 8) == want


def test_key_joins_of_frequent_keys_are_cut(spark, monkeypatch):
    frames = [spark.createDataFrame([(k if k < 6 else None, i * 10 + k) for k in ks for i in range(n)], "k int, v int") for ks, n in (((0, 1, 2, 6), 40), ((0, 1, 3, 6), 9), ((0, 2, 4, 6), 3))]
    rows = lambda df: sorted(map(repr, df.collect()))
    inner, outer = rows(keyjoin.inner_join(*frames, key="k")), rows(keyjoin.outer_join(*frames, key="k"))
    assert len(inner) == 40 * 9 * 3 and len(outer) == 40 * 9 * 3 + 40 * 9 + 40 * 3 + 9 + 3 + 40 + 9 + 3
    monkeypatch.setattr(keyjoin, "PRODUCT_ROWS", 50)
    cut = keyjoin.inner_join(*frames, key="k")
    assert rows(cut) == inner and rows(keyjoin.outer_join(*frames, key="k")) == outer
    # The frequent key's product is given by many tasks.
    assert len({r[0] for r in cut.select(plans.F.spark_partition_id()).collect()}) > 10


def test_filters_come_to_the_driver_as_blocks(spark):
    df = spark.range(0, 90_000).withColumnRenamed("id", "k")
    got = bloom._filled(df, "k", 300_000, 4, 2)
    h = np.array([r[0] for r in df.select(plans.F.xxhash64("k")).collect()])
    want = bloom.Filter(300_000, 4, 2)
    for part, row in zip(want.part(h), want.at(h)):
        for place in set(row.tolist()):
            want.counts[part, place] += 1
    assert (got.counts == want.counts).all() and got.holds(h).all()


def test_byte_hash_of_batches(spark):
    texts = ["", "a", "é中", "x" * 300, None, "-\x00-"]
    def plain(v, h):
        for b in v.encode():
            h = (h * 31 + (b - 256 if b > 127 else b)) % 2**32
        return (h - 2**32 if h >= 2**31 else h) if v else 0
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for start in (0, 1):
        assert [r[0] for r in df.select(text.byte_hash(plans.F.col("t"), start)).collect()] == [None if t is None else plain(t, start) for t in texts]
        assert "ArrowEvalPython" in df.select(text.byte_hash(plans.F.col("t"), start))._jdf.queryExecution().toString()


def test_embedded_database_keeps_all_values(spark, tmp_path):
    rows = [(1, "a"), (2, None), (3, ""), (4, 'x "y", z'), (5, "two\nlines"), (6, "back\\slash"), (None, "é中"), (7, " lead ")]
    url, properties = files.embedded_database(spark.createDataFrame(rows, "k long, v string").repartition(3), f"file://{tmp_path}", "T")
    # An archive: a second process can open it beside this one.
    assert url.startswith("jdbc:derby:jar:")
    assert sorted(map(tuple, files.read_table(spark, url, "T", properties=properties).collect()), key=repr) == sorted(rows, key=repr)


def test_spatial_joins_deal_whole_batches(spark, monkeypatch):
    r = random.Random(11)
    a, b = (spark.createDataFrame([(i, r.randrange(0, 2000), r.randrange(0, 2000), r.randrange(0, 300), r.randrange(0, 5)) for i in range(n)], "id long, x long, y long, width long, height long") for n in (3000, 500))
    # Flat boxes get flat cells.
    grid = GR.grid_for_join(a, b, rows_per_cell=1)
    assert grid.cols < 20 < 50 < grid.rows
    monkeypatch.setattr(SJ, "DEALT_AT_ONCE", 40)
    got = SJ.spatial_join(a, b, columns=["l_id", "r_id"])
    plan = got._jdf.queryExecution().toString()
    # Neither side is sent to all tasks, and cells are not found by expressions, which are too long to be compiled.
    assert "MapInArrow" in plan and "SortMergeJoin" in plan and "sequence(" not in plan
    want = sorted(map(tuple, a.alias("l").crossJoin(b.alias("r")).where("l.x + l.width > r.x and r.x + r.width > l.x and l.y + l.height > r.y and r.y + r.height > l.y").select("l.id", "r.id").collect()))
    assert sorted(map(tuple, got.collect())) == want


def test_indexed_join_deals_rows_in_common_parts_only(spark, tmp_path):
    rows = [(i, i % 100 * 10, i // 100 * 100, 3, 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, x long, y long, width long, height long")
    left, right = build(df, str(tmp_path / "a"), GR.Grid(0, 0, 1000, 1000, 4, 4)), build(df, str(tmp_path / "b"), GR.Grid(0, 0, 1000, 1000, 3, 3))
    dealt = []
    meet = SJ._meet
    SJ._meet = lambda a, b, keys: dealt.append((a.count(), b.count())) or meet(a, b, keys)
    try:
        assert SJ.join_indexed(spark, left, right, "no").count() == 1000
    finally:
        SJ._meet = meet
    assert max(dealt[0]) < 1500


def test_embedded_database_is_read_by_place(spark, tmp_path):
    url, properties = files.embedded_database(spark.range(5000).selectExpr("id AS k", "cast(id AS float) AS v"), f"file://{tmp_path}", "T")
    # A deflated table would be inflated from its start for each page.
    assert {i.compress_type for i in zipfile.ZipFile(f"{tmp_path}/db.zip").infolist()} == {zipfile.ZIP_STORED}
    assert files.read_table(spark, url, "T", '"k"', 0, 4999, 4, properties).distinct().count() == 5000


def test_frequent_keys_are_joined_from_the_smallest(spark, monkeypatch):
    frames = [spark.createDataFrame([(0, i) for i in range(n)], "k int, v int") for n in (30, 8, 2)]
    monkeypatch.setattr(keyjoin, "PRODUCT_ROWS", 50)
    got = keyjoin.inner_join(*frames, key="k").select("k", *(plans.F.col(f"s{i}.v").alias(f"v{i}") for i in range(3)))
    assert {tuple(r) for r in got.collect()} == {(0, a, b, c) for a in range(30) for b in range(8) for c in range(2)} and got.count() == 480
    # The largest comes last, so the product of the others is what it is joined to.
    plan = got._jdf.queryExecution().analyzed().toString()
    assert re.findall(r"RepartitionByExpression \[k#\d+, _slice#\d+L?\], \d+\n[^\n]*Project \[k#\d+, (s\d)#", plan) == ["s2", "s1", "s0"]


def test_sweeps_deal_whole_batches_to_strips(spark):
    r = random.Random(12)
    a, b = (spark.createDataFrame([(i, r.randrange(0, 1000), r.randrange(0, 1000), r.randrange(0, 40), r.randrange(0, 12)) for i in range(n)], "id long, x long, y long, width long, height long") for n in (4000, 900))
    laid = SJ._laid(a, b, None, 50, flat=True)
    assert laid.rows > 60 and laid.cols == 1
    got = SJ.sweep_join(a, b, columns=["l_id", "r_id"])
    plan = got._jdf.queryExecution().toString()
    # Cells are found by whole batches, not by expressions.
    assert plan.count("MapInArrow") >= 3 and "sequence(" not in plan
    want = sorted(map(tuple, a.alias("l").crossJoin(b.alias("r")).where("l.x + l.width > r.x and r.x + r.width > l.x and l.y + l.height > r.y and r.y + r.height > l.y").select("l.id", "r.id").collect()))
    assert sorted(map(tuple, got.collect())) == want


ODD = [(1, "a b a"), (2, "b\x0bc  b"), (3, None), (4, " \t\n"), (None, "a z\f\r"), (5, "é é a b"), (7, "b")]


def _uses(docs):
    """term, key, n of each document, by a plain search."""
    words = ((k, re.findall(r"[^ \t\n\r\f]+", t or "")) for k, t in docs)
    return sorted((w, k, v.count(w)) for k, v in words for w in set(v))


def test_postings_need_no_shuffle(spark, tmp_path):
    """words of a document are counted where it is read, and the index is written from there."""
    docs = spark.createDataFrame(ODD, "id long, t string")
    found = inverted.postings(docs, "id", "t")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    known = [d for d in ODD if d[0] is not None]
    assert sorted(tuple(r) for r in found.where("id is not null").collect()) == _uses(known)
    assert sorted((r.term, r.n) for r in found.where("id is null").collect()) == [("a", 1), ("z", 1)]
    path = str(tmp_path / "index")
    inverted.build(docs, path, "id", "t", 3)
    index = spark.read.parquet(path)
    assert sorted((r.term, r.id or 0, r.n) for r in index.collect()) == sorted((r.term, r.id or 0, r.n) for r in found.collect())
    assert index.where(index.shard != inverted.shard_of("id", 3)).count() == 0
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert {r.id: r.n_uses for r in inverted.search(index, ["a", "b"], "id").collect()} == {1: 3}


def test_postings_of_repeated_keys(spark, tmp_path):
    """rows of one key are one document, wherever they are."""
    docs = spark.createDataFrame([(1, "a b"), (1, "a"), (2, "b"), (None, "c"), (None, "c")] * 2, "id long, t string").repartition(4)
    assert sorted((r.term, r.id or 0, r.n) for r in inverted.postings(docs, "id", "t").collect()) == [("a", 1, 4), ("b", 1, 2), ("b", 2, 2), ("c", 0, 4)]
    path = str(tmp_path / "index")
    inverted.build(docs, path, "id", "t")
    assert sorted((r.term, r.id or 0, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1, 4), ("b", 1, 2), ("b", 2, 2), ("c", 0, 4)]


def test_blocks_of_documents(monkeypatch):
    """blocks end between documents, whatever the batches."""
    monkeypatch.setattr(inverted, "BLOCK_BYTES", 200)
    monkeypatch.setattr(inverted, "BATCH_ROWS", 3)
    texts = ["a b c d " * n for n in (1, 0, 30, 2, 3, 1, 50, 1)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([n % 2 for n in range(8)], pa.int32()), pa.array(texts)], ["id", "shard", "t"])
    for size in (1, 3, 8):
        got = [r for b in inverted._posted("id")(whole.slice(i, size) for i in range(0, 8, size)) for r in b.to_pylist()]
        assert sorted((r["term"], r["id"], r["n"]) for r in got) == _uses(list(enumerate(texts)))
        assert all(r["shard"] == r["id"] % 2 for r in got)
    # Bytes that are no UTF-8 stay as they are.
    odd = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0], pa.int32()), pa.Array.from_buffers(pa.string(), 1, pa.array([b"\xff a \xff"], pa.binary()).buffers())], ["id", "shard", "t"])
    (got,) = inverted._posted("id")([odd])
    assert sorted(zip(got.column("term").cast(pa.binary()).to_pylist(), got.column("n").to_pylist(), strict=True)) == [(b"a", 1), (b"\xff", 2)]


def test_update_sends_deletions(spark, monkeypatch):
    """the index isn't dealt by key to take out deleted documents, unless they are very many."""
    docs = spark.createDataFrame([(i, f"w{i} x") for i in range(50)], "id long, t string")
    changes = docs.where("id % 3 > 0").selectExpr("id", "concat(t, ' x new') as t", "if(id % 3 = 1, 'update', 'delete') as op")
    index = inverted.postings(docs, "id", "t").withColumn("shard", inverted.shard_of("id", 8))
    want = _uses([(i, f"w{i} x" + " x new" * (i % 3)) for i in range(50) if i % 3 < 2])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for most, threshold, sent in ((inverted.GONE_MOST, "-1", True), (0, "-1", False), (0, before, None)):
            monkeypatch.setattr(inverted, "GONE_MOST", most)
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            out = inverted.update(index, changes, "id", "t")
            assert sorted((r.term, r.id, r.n) for r in out.collect()) == want
            if sent is not None:
                assert ("BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()) == sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_terms_summed_before_the_shuffle(spark):
    """what is shuffled is one row for each term of a block of documents, not for each term of a document."""
    docs = spark.createDataFrame([(i, "same words in all") for i in range(1000)] + [(None, "words")], "id long, t string").repartition(2)
    out = inverted.summary(docs, "id", "t")
    assert sorted(tuple(r) for r in out.collect()) == [("all", 1000, 1000, 0), ("in", 1000, 1000, 0), ("same", 1000, 1000, 0), ("words", 1001, 1001, 0)]
    many = pa.RecordBatch.from_arrays([pa.array([5, None, 3, 4]), pa.array(["b a", "a", "a a", None])], ["id", "t"])
    (got,) = inverted._summed([many])
    assert got.to_pylist() == [{"term": "a", "n_docs": 3, "n_uses": 4, "first_doc": 3}, {"term": "b", "n_docs": 1, "n_uses": 1, "first_doc": 5}]
    twice = spark.createDataFrame([(2, "a"), (2, "a b"), (1, "b"), (None, "c")], "id long, t string")
    assert sorted(tuple(r) for r in inverted.summary(twice, "id", "t").collect()) == [("a", 1, 2, 2), ("b", 2, 2, 1), ("c", 1, 1, None)]
    assert inverted.summary(docs.where("false"), "id", "t").count() == 0

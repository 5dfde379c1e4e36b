"""Joins by place, formats and folds on inputs that only larger tables have: crowded pages, copies, large numbers."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import model, relate, rulings
from quire.plans.registry import ORACLES, QUERIES
from quire.sources import tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Parts and customers of sf0.001 four times over, and orders of large keys."""
    path = tmp_path_factory.mktemp("scale")
    for name, key in (("part", "p_partkey"), ("customer", "c_custkey")):
        one = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        n = one.count()
        one.crossJoin(spark.range(4).withColumnRenamed("id", "_i")).withColumn(key, (F.col(key) + F.col("_i") * n).cast(one.schema[key].dataType)).drop("_i").coalesce(1).write.parquet(str(path / f"{name}.parquet"))
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.withColumn("o_orderkey", (F.col("o_orderkey") * 2_999).cast("long")).coalesce(1).write.parquet(str(path / "orders.parquet"))
    return path


def agrees(spark, folder, name):
    con = duckdb.connect()
    for t in ("part", "customer", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    wanted = con.sql(ORACLES[name])
    found = QUERIES[name](spark, str(folder)).select(*wanted.columns)
    assert sorted(map(repr, wanted.fetchall())) == sorted(repr(tuple(r)) for r in found.collect())


def test_sizes_of_large_orders(spark, folder):
    agrees(spark, folder, "p8_formats")


CROWDED = ["j3_smallest_at_point", "j4_topmost_at_point", "j5_first_at_point", "j10_covering", "j8_outside", "j6_in_cells", "j16_shading", "u10_outermost", "j9_overlapping_tables", "j14_widgets"]


@pytest.mark.parametrize("name", CROWDED)
def test_joins_on_crowded_pages(spark, folder, name):
    """All boxes lie on three pages of each document, however many there are."""
    assert "p_partkey % 3 AS INTEGER" in ORACLES[name]
    assert tables.crowded(spark, str(folder)).select("doc_id", "page_no").distinct().count() == 21
    agrees(spark, folder, name)


@pytest.mark.parametrize("name", CROWDED)
def test_exploded_boxes_are_never_broadcast(spark, folder, name):
    assert "Broadcast" not in QUERIES[name](spark, str(folder))._jdf.queryExecution().toString()


def test_copies_of_boxes_and_points(spark):
    """Of boxes of one outline the first or last is picked; points of one place, and those without one, each get their row."""
    box = [(1, 0, ord_, 0.0, 0.0, 10.0, 10.0) for ord_ in (5, 3, 9)] + [(1, 0, 4, 0.0, 0.0, 80.0, 80.0)]
    boxes = spark.createDataFrame(box, "doc_id long, page_no int, ord long, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 0, 1, 5.0, 5.0), (1, 0, 2, 5.0, 5.0), (1, 0, 3, 70.0, 70.0), (1, 0, 4, 99.0, 5.0), (1, 0, 5, None, 5.0)], "doc_id long, page_no int, point long, x double, y double")
    at = lambda pick, **how: sorted((r["point"], r["box"]) for r in relate.at_point(points, boxes, pick, **how).collect())
    assert at("smallest") == [(1, 3), (2, 3), (3, 4)]
    assert at("first") == [(1, 3), (2, 3), (3, 4)]
    assert at("topmost", keep_unmatched=True) == [(1, 9), (2, 9), (3, 4), (4, None), (5, None)]
    named = boxes.withColumn("name", F.lit(None).cast("string"))
    assert {r["widget"] for r in model.find_widget(named.where("ord = 4"), named.where("ord <> 4").withColumn("name", F.lit(""))).collect()} == {3}


def exchanged(spark, df):
    """The rows that all exchanges of a run of df write."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = context.statusStore().stageList(None, False, False, none, None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for stage, n in written().items() if stage not in before)


def test_lines_of_equal_cells_are_exchanged_once(spark):
    """A page of 300 lines in 300 cells of one outline has 90,000 rows, of which none crosses the network."""
    lines = spark.range(300).selectExpr("1L AS doc_id", "0 AS page_no", "id AS ord", "20D + id % 7 AS x0", "20D AS y0", "30D AS x1", "30D AS y1")
    cells = spark.range(300).selectExpr("1L AS doc_id", "0 AS page_no", "id AS ord", "0D AS x0", "0D AS y0", "50D AS x1", "50D AS y1")
    rows = relate.in_cells(lines, cells)
    assert rows.count() == 90_000
    assert exchanged(spark, rows) < 3_000


def test_cells_of_equal_and_shared_ords(spark):
    """Boxes that share their ord are one cell, as in the SQL, and equal to others only by all of them; lines of one height and edge go by ord."""
    shape = "doc_id long, page_no int, ord long, x0 double, y0 double, x1 double, y1 double"
    small, large, far = (0.0, 0.0, 20.0, 20.0), (0.0, 0.0, 200.0, 200.0), (100.0, 100.0, 140.0, 140.0)
    cells = [(1, 0, 2, *small), (1, 0, 2, *far), (1, 0, 3, *small), (1, 0, 4, *large), (1, 0, 5, *far), (1, 0, 5, *small), (1, 0, 6, *large), (1, 0, 6, *large), (1, 0, 7, *small), (1, 1, 3, *small), (1, 1, 4, *small), (1, 0, None, *small), (1, 0, 9, None, 0.0, 20.0, 20.0)]
    lines = [(1, page, n, x, y, x + w, y + 4.0) for page in (0, 1) for n, (x, y, w) in enumerate([(2.0, 2.0, 8.0), (2.0, 2.04, 40.0), (2.0, 2.0, 4.0), (110.0, 110.0, 5.0), (1.0, 2.0, 5.0), (110.0, 2.0, 5.0)], 10)]
    db = duckdb.connect()
    for name, rows in (("a", lines), ("b", cells)):
        db.execute(f"CREATE TABLE {name} (doc_id BIGINT, page_no INT, ord BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)")
        db.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?, ?, ?, ?)", rows)
    wanted = db.sql("""
WITH m AS (SELECT a.doc_id, a.page_no, b.ord AS cell, a.ord AS line, round_even(a.y0, 1) AS y, a.x0 AS x FROM a JOIN b ON a.doc_id = b.doc_id AND a.page_no = b.page_no
  AND (a.x0 + a.x1) / 2 BETWEEN b.x0 - 1 AND b.x1 + 1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 - 1 AND b.y1 + 1)
SELECT doc_id, page_no, cell, line, CAST(row_number() OVER (PARTITION BY doc_id, page_no, cell ORDER BY y, x, line) - 1 AS INTEGER) AS place FROM m""")
    found = relate.in_cells(spark.createDataFrame(lines, shape), spark.createDataFrame(cells, shape)).select(*wanted.columns)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted.fetchall()))


@pytest.mark.parametrize("name", ["e5_comparison_marks", "c17_character_maps"])
def test_exploded_words_and_codes_are_never_broadcast(spark, folder, name):
    assert "Broadcast" not in QUERIES[name](spark, str(folder))._jdf.queryExecution().toString()
    agrees(spark, folder, name)


def test_harm_and_regions(spark, folder):
    """Neither broadcasts spans under their cells nor calls Python once for each page."""
    assert "Broadcast" not in rulings.harmed(tables.sheets(spark, str(folder)))._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in QUERIES["f4_diagrams"](spark, str(folder))._jdf.queryExecution().toString()
    agrees(spark, folder, "f4_diagrams")


def test_plain_texts_pass_repair_by_one_look(spark):
    given = ["plain", "a\tb", "a b", "a­b", "é", "é\u007f\n", "x\u0001", "ก า", None, "ÿ˿"]
    shown = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", T.repair_text("t").alias("t"))
    assert [r["t"] for r in shown.orderBy("i").collect()] == ["plain", "a b", "a b", "ab", "é", "é\u007f\n", "x", "กา", "", "ÿ˿"]


CROWDED = ["j4_topmost_at_point", "j10_covering", "j5_first_at_point", "j8_outside", "j6_in_cells", "j16_shading", "u10_outermost", "j9_overlapping_tables"]


@pytest.fixture(scope="module")
def placed(tmp_path_factory):
    """A folder of parts and customers whose keys go far beyond their number."""
    folder = tmp_path_factory.mktemp("placed")
    keys = list(range(1, 5400, 7))
    pq.write_table(pa.table({"p_partkey": pa.array(keys, pa.int64()), "p_size": pa.array([1 + k * 13 % 50 for k in keys], pa.int32())}), folder / "part.parquet")
    pq.write_table(pa.table({"c_custkey": pa.array(keys, pa.int64())}), folder / "customer.parquet")
    return folder


@pytest.mark.parametrize("name", CROWDED)
def test_pages_are_as_full_as_tables_are_long(spark, placed, name):
    """Boxes and points lie on three pages of a document whatever their keys, and the query gives the rows of its SQL."""
    db = duckdb.connect()
    for t in ("part", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{placed}/{t}.parquet'")
    found = QUERIES[name](spark, str(placed))
    wanted = db.execute(ORACLES[name]).to_arrow_table().select(found.columns).to_pylist()
    rows = [r.asDict() for r in found.collect()]
    assert {r["page_no"] for r in rows} == {0, 1, 2}
    key = lambda r: tuple((v is not None, v) for v in r.values())
    assert sorted(rows, key=key) == sorted(wanted, key=key)

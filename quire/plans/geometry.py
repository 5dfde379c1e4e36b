"""Queries of joins by place, over the layout that sources.tables makes of the parts' and customers' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import relate
from quire.plans.registry import query
from quire.sources.tables import BOXES_SQL, CROWDED_SQL, POINTS_SQL, boxes, crowded, points, table

_WITH = f"WITH b AS ({CROWDED_SQL}), p AS ({POINTS_SQL})"
_SPREAD = f"WITH b AS ({BOXES_SQL})"
_IN = "p.doc_id = b.doc_id AND p.page_no = b.page_no AND p.x BETWEEN b.x0 - {0} AND b.x1 + {0} AND p.y BETWEEN b.y0 - {0} AND b.y1 + {0}"
_PICK = _WITH + ", m AS (SELECT p.*, b.ord, row_number() OVER (PARTITION BY p.doc_id, p.page_no, p.point ORDER BY {order}) AS n FROM p JOIN b ON " + _IN + ") SELECT doc_id, page_no, point, ord AS box FROM m WHERE n = 1"
_AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"
_CENTRE = "a.doc_id = b.doc_id AND a.page_no = b.page_no AND (a.x0 + a.x1) / 2 BETWEEN b.x0 - {0} AND b.x1 + {0} AND (a.y0 + a.y1) / 2 BETWEEN b.y0 - {0} AND b.y1 + {0}"


@query(_PICK.format("2.5", order=_AREA.format("b") + ", b.ord"))
def j3_smallest_at_point(spark: SparkSession, folder: str) -> DataFrame:
    return relate.at_point(points(spark, folder), crowded(spark, folder), "smallest", 2.5)


@query(_PICK.format("0", order="b.ord DESC"))
def j4_topmost_at_point(spark: SparkSession, folder: str) -> DataFrame:
    return relate.at_point(points(spark, folder), crowded(spark, folder), "topmost")


@query(_PICK.format("6", order="b.ord"))
def j5_first_at_point(spark: SparkSession, folder: str) -> DataFrame:
    return relate.at_point(points(spark, folder), crowded(spark, folder), "first", 6.0)


@query(_WITH + f", m AS (SELECT p.doc_id, p.page_no, p.point, b.ord, row_number() OVER (PARTITION BY p.doc_id, p.page_no, p.point ORDER BY {_AREA.format('b')}, b.ord) AS n FROM p LEFT JOIN b ON {_IN.format('1')}) SELECT doc_id, page_no, point, ord AS box FROM m WHERE n = 1")
def j10_covering(spark: SparkSession, folder: str) -> DataFrame:
    return relate.at_point(points(spark, folder), crowded(spark, folder), "smallest", 1.0, keep_unmatched=True)


@query(_WITH + f" SELECT a.doc_id, a.page_no, a.ord FROM b a WHERE a.ord % 2 = 0 AND NOT EXISTS (SELECT 1 FROM b WHERE b.ord % 2 = 1 AND {_CENTRE.format('0')})")
def j8_outside(spark: SparkSession, folder: str) -> DataFrame:
    all_ = crowded(spark, folder)
    return relate.outside(all_.where("ord % 2 = 0"), all_.where("ord % 2 = 1")).select("doc_id", "page_no", "ord")


@query(_WITH + f"""
, m AS (SELECT a.doc_id, a.page_no, b.ord AS cell, a.ord AS line, round_even(a.y0, 1) AS y, a.x0 AS x FROM b a JOIN b ON {_CENTRE.format('1')} WHERE a.ord % 2 = 0 AND b.ord % 2 = 1)
SELECT doc_id, page_no, cell, line, CAST(row_number() OVER (PARTITION BY doc_id, page_no, cell ORDER BY y, x, line) - 1 AS INTEGER) AS place FROM m""")
def j6_in_cells(spark: SparkSession, folder: str) -> DataFrame:
    all_ = crowded(spark, folder)
    return relate.in_cells(all_.where("ord % 2 = 0"), all_.where("ord % 2 = 1"))


@query(_WITH + f"""
, m AS (SELECT a.doc_id, a.page_no, a.ord, b.ord AS fill, row_number() OVER (PARTITION BY a.ord ORDER BY {_AREA.format('b')}, b.ord) AS n
  FROM b a LEFT JOIN b ON {_CENTRE.format('0')} AND b.ord % 2 = 1 AND {_AREA.format('b')} >= 0.5 * {_AREA.format('a')} AND {_AREA.format('b')} < 0.9 * 10000 WHERE a.ord % 2 = 0)
SELECT doc_id, page_no, ord, fill FROM m WHERE n = 1""")
def j16_shading(spark: SparkSession, folder: str) -> DataFrame:
    all_ = crowded(spark, folder)
    return relate.shading(all_.where("ord % 2 = 0"), all_.where("ord % 2 = 1"), 10_000.0)


@query(_WITH + f"""
SELECT a.doc_id, a.page_no, a.ord FROM b a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b.page_no = a.page_no AND a.x0 >= b.x0 - 1.5 AND a.x1 <= b.x1 + 1.5 AND a.y0 >= b.y0 - 1.5 AND a.y1 <= b.y1 + 1.5 AND {_AREA.format('b')} > 1.05 * {_AREA.format('a')})""")
def u10_outermost(spark: SparkSession, folder: str) -> DataFrame:
    return relate.outermost(crowded(spark, folder).withColumn("table_no", F.lit(0))).select("doc_id", "page_no", "ord")


@query(_WITH + f"""
SELECT a.doc_id, a.page_no, a.ord, b.ord AS other FROM b a JOIN b ON a.doc_id = b.doc_id AND a.page_no = b.page_no
WHERE a.ord % 2 = 0 AND b.ord % 2 = 1 AND greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) >= 0.5 * {_AREA.format('a')}""")
def j9_overlapping_tables(spark: SparkSession, folder: str) -> DataFrame:
    all_ = crowded(spark, folder)
    return relate.overlapping_tables(all_.where("ord % 2 = 0"), all_.where("ord % 2 = 1"))


@query(_SPREAD + " SELECT doc_id, ord, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, round_even(y0, 1), x0, ord) - 1 AS INTEGER) AS place FROM b")
def w5_reading_order(spark: SparkSession, folder: str) -> DataFrame:
    return relate.reading_order(boxes(spark, folder)).select("doc_id", "ord", "place")


@query(_SPREAD + " SELECT doc_id, ord % 50 AS xref, min(page_no) AS page_no, max(x1 - x0) AS width FROM b GROUP BY 1, 2")
def a6_images(spark: SparkSession, folder: str) -> DataFrame:
    return relate.images_by_first_page(boxes(spark, folder).withColumn("xref", F.col("ord") % 50))


@query(_SPREAD + """
SELECT doc_id, greatest(18.0, least(min(x0), 210.0)) AS "left", greatest(18.0, least(600.0 - max(x1), 210.0)) AS "right", greatest(18.0, least(min(y0), 240.0)) AS top, greatest(18.0, least(800.0 - max(y1), 240.0)) AS bottom FROM b GROUP BY doc_id""")
def a7_margins(spark: SparkSession, folder: str) -> DataFrame:
    return relate.margins(boxes(spark, folder), 600.0, 800.0)


@query("""
WITH i AS (SELECT p_partkey, 40 + p_size * 20 AS px_w, 40 + p_size * 20 AS px_h, p_partkey % 400 AS shown_pt, p_partkey % 11 = 0 AS masked, CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 8 END AS bits FROM part),
s AS (SELECT *, least(1.0, 150.0 / (px_w * 72.0 / CASE WHEN shown_pt > 0 THEN shown_pt ELSE 11.7 * 72 END)) AS scale FROM i)
SELECT p_partkey, scale, CASE WHEN masked THEN 'mask' WHEN bits = 1 THEN 'bitonal' WHEN px_w * px_h < 10000 THEN 'small' WHEN scale > 0.95 THEN 'sharp enough' END AS skip FROM s
""")
def c21_shrink(spark: SparkSession, folder: str) -> DataFrame:
    k, size = F.col("p_partkey"), 40 + F.col("p_size") * 20
    images = table(spark, folder, "part").select("p_partkey", size.alias("px_w"), size.alias("px_h"), (k % 400).alias("shown_pt"), (k % 11 == 0).alias("masked"), F.when(k % 13 == 0, 1).otherwise(8).alias("bits"))
    return relate.shrink_decision(images, 150).select("p_partkey", F.col("scale").cast("double").alias("scale"), "skip")


@query("""
WITH c AS (SELECT p_partkey % 300 AS glyph, p_size AS cp, p_size % 7 = 0 AS preferred FROM part)
SELECT glyph, count(DISTINCT cp) AS n, coalesce(min(CASE WHEN preferred THEN cp END), min(cp)) AS cp FROM c GROUP BY glyph HAVING count(DISTINCT cp) > 1
""")
def a11_code_points(spark: SparkSession, folder: str) -> DataFrame:
    cmap = table(spark, folder, "part").select((F.col("p_partkey") % 300).alias("glyph"), F.col("p_size").alias("cp"), (F.col("p_size") % 7 == 0).alias("preferred"))
    return relate.preferred_code_point(cmap)


@query("SELECT 'text_' || (SELECT min(n) FROM range(1, 10000) t(n) WHERE n NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey <> 5)) AS name")
def a15_free_name(spark: SparkSession, folder: str) -> DataFrame:
    fields = table(spark, folder, "nation").where("n_nationkey <> 5").select(F.concat(F.lit("text_"), F.col("n_nationkey")).alias("name"))
    return relate.free_name(fields, "text")


@query("""
WITH u AS (SELECT n_nationkey AS k, 'a' AS v, 0 AS r FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'b', 1 FROM nation WHERE n_nationkey < 10)
SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r) AS n FROM u) WHERE n = 1
""")
def u8_first_by_rank(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    return relate.first_by_rank([nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), F.lit("a").alias("v")), nation.where("n_nationkey < 10").select(F.col("n_nationkey").alias("k"), F.lit("b").alias("v"))], "k")

"""Queries of the page model, over made tables: the layout that sources.tables makes, and conversations seen as pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import export, model
from quire.plans.registry import query
from quire.sources.tables import BOXES_SQL, CROWDED_SQL, boxes, crowded, table, turns

_BOXES = f"WITH b AS ({BOXES_SQL})"
def _corners() -> list[Column]:
    return [F.col(c) for c in ("x0", "y0", "x1", "y1")]



def _pages(folder_boxes: DataFrame) -> DataFrame:
    return folder_boxes.select("doc_id", "page_no").distinct().select("*", F.lit(600.0).alias("width"), F.lit(840.0).alias("height"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """boxes() as lines, with the part's name as text in two spans, of which the second may be blank."""
    names = table(spark, folder, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("_name"), F.col("p_size").alias("_size"))
    span = lambda text, size: F.struct(text.alias("text"), size.alias("size"), F.when(F.col("ord") % 3 == 0, "ABCDEF+Arial-BoldMT").otherwise("Times-Italic").alias("font"), (F.col("ord") % 32).cast("int").alias("flags"), (F.col("ord") % 16777216).cast("int").alias("color"), *_corners())
    both = F.array(span(F.col("_name"), F.col("_size") + 0.25), span(F.when(F.col("ord") % 2 == 0, " ").otherwise(F.lit("tail")), F.lit(9.0)))
    return boxes(spark, folder).join(names, "ord").select("doc_id", "page_no", (F.col("ord") / 100).cast("int").alias("block_no"), (F.col("ord") % 100).cast("int").alias("line_no"), *_corners(), F.when(F.col("ord") % 11 == 0, 0.0).otherwise(1.0).alias("dx"), F.lit(0.0).alias("dy"), both.alias("spans"))


_LINES = f"""WITH b AS ({BOXES_SQL}), l AS (
  SELECT b.*, p_name AS name, p_size AS psize, CAST(ord // 100 AS INTEGER) AS block_no, CAST(ord % 100 AS INTEGER) AS line_no FROM b JOIN part ON p_partkey = ord)"""


@query(_LINES + """, s AS (SELECT doc_id, page_no, block_no, line_no, 0 AS n, name AS text FROM l UNION ALL SELECT doc_id, page_no, block_no, line_no, 1, 'tail' FROM l WHERE ord % 2 <> 0)
SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY block_no, line_no, n) - 1 AS INTEGER) AS ord, text FROM s""")
def s3_spans(spark: SparkSession, folder: str) -> DataFrame:
    return model.spans(model.page_lines(_lines(spark, folder))).select("doc_id", "page_no", "ord", "text")


@query(_BOXES + " SELECT doc_id, page_no, ord FROM b WHERE NOT (ord % 4 <= 2 AND ord % 5 <= 2) AND (x1 - x0) * (y1 - y0) <= 0.85 * 600 * 840")
def s5_images(spark: SparkSession, folder: str) -> DataFrame:
    all_ = boxes(spark, folder)
    images = all_.select("*", (F.col("ord") % 4).alias("pixel_width"), (F.col("ord") % 5).alias("pixel_height"))
    return model.placed_images(images, _pages(all_)).select("doc_id", "page_no", "ord")


@query("""
SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_no, CASE WHEN turn % 3 = 0 THEN 'Text' ELSE 'Ink' END AS type, role AS author, coalesce(text, '') AS text,
  CASE WHEN turn % 4 = 0 THEN 'changed' WHEN turn % 2 = 0 THEN 'made' ELSE '' END AS date
FROM conversations WHERE turn % 3 < 2""")
def s11_all_comments(spark: SparkSession, folder: str) -> DataFrame:
    said, n = turns(spark, folder), F.col("page_no")
    kinds = F.when(n % 3 == 0, "Text").when(n % 3 == 1, "Ink").otherwise("Link")
    return model.all_comments(said.select("doc_id", "page_no", kinds.alias("type"), F.col("role").alias("title"), F.col("text").alias("content"), F.when(n % 4 == 0, "changed").otherwise("").alias("mod_date"), F.when(n % 2 == 0, "made").alias("creation_date")))


@query(_BOXES + " SELECT doc_id, page_no, ord FROM b WHERE least((ord % 10) / 10.0, (ord % 7) / 7.0) < 0.97 AND ord % 3 > 0")
def s15_fills(spark: SparkSession, folder: str) -> DataFrame:
    fill = F.when(F.col("ord") % 3 > 0, F.array((F.col("ord") % 10) / F.lit(10.0), (F.col("ord") % 7) / F.lit(7.0), F.lit(1.0)))
    return model.page_fills(boxes(spark, folder).withColumn("fill", fill)).select("doc_id", "page_no", "ord")


_SHRUNK = "CASE WHEN x0 + {dx} >= x1 - {dx} OR y0 + {dy} >= y1 - {dy} THEN {c} ELSE {c} {sign} {d} END AS {k}{c}"


@query(_BOXES + " SELECT ord, " + ", ".join(_SHRUNK.format(dx=dx, dy=dy, c=c, d=dx if c[0] == "x" else dy, sign="+" if c[1] == "0" else "-", k=k) for k, dx, dy in (("core_", "least(0.6, (x1 - x0) * 0.1)", "(y1 - y0) * 0.18"), ("risk_", "0.3", "(y1 - y0) * 0.05")) for c in ("x0", "y0", "x1", "y1")) + " FROM (SELECT ord, x0, y0, x0 + (ord % 9) / 10.0 AS x1, y1 FROM b)")
def p18_core_and_risk(spark: SparkSession, folder: str) -> DataFrame:
    narrow = boxes(spark, folder).withColumn("x1", F.col("x0") + (F.col("ord") % 9) / F.lit(10.0))
    found = narrow.select("ord", model.core_box(*_corners()).alias("core"), model.risk_box(*_corners()).alias("risk"))
    return found.select("ord", *[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in ("core", "risk") for c in ("x0", "y0", "x1", "y1")])


@query(_BOXES + """ SELECT ord, CASE ord % 4 WHEN 1 THEN 840 - y1 WHEN 2 THEN 600 - x1 WHEN 3 THEN y0 ELSE x0 END AS x0, CASE ord % 4 WHEN 1 THEN x0 WHEN 2 THEN 840 - y1 WHEN 3 THEN 600 - x1 ELSE y0 END AS y0,
  CASE ord % 4 WHEN 1 THEN 840 - y0 WHEN 2 THEN 600 - x0 WHEN 3 THEN y1 ELSE x1 END AS x1, CASE ord % 4 WHEN 1 THEN x1 WHEN 2 THEN 840 - y0 WHEN 3 THEN 600 - x0 ELSE y1 END AS y1 FROM b""")
def p17_view_boxes(spark: SparkSession, folder: str) -> DataFrame:
    turn = (F.col("ord") % 4) * 90
    return boxes(spark, folder).select("ord", model.view_box(*_corners(), F.lit(600.0), F.lit(840.0), turn).alias("b")).select("ord", "b.*")


@query(_BOXES + " SELECT ord, x0, y0, x1, y1 FROM b WHERE ord % 2 = 0 UNION ALL SELECT ord, NULL, NULL, NULL, NULL FROM b WHERE ord % 2 = 1")
def p20_pdf_boxes(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("["), F.concat_ws(" ", "x1", "y0", "x0", "y1"), F.lit("]"))).otherwise("[1 2 x 4]")
    return boxes(spark, folder).select("ord", model.pdf_box(text).alias("b")).select("ord", "b.*")


@query(_LINES + """ SELECT doc_id, page_no, block_no, line_no, name || CASE WHEN ord % 2 = 0 THEN ' ' ELSE 'tail' END AS text, greatest(psize + 0.25, 9.0) AS size, ord % 11 <> 0 AS flat,
  ord % 3 = 0 OR (ord % 32) & 16 <> 0 AS bold, ord % 3 <> 0 OR (ord % 32) & 2 <> 0 AS italic FROM l""")
def p29_line_text(spark: SparkSession, folder: str) -> DataFrame:
    first = _lines(spark, folder).withColumn("_font", F.col("spans")[0]["font"]).withColumn("_flags", F.col("spans")[0]["flags"])
    return first.select("doc_id", "page_no", "block_no", "line_no", model.line_text().alias("text"), model.line_size().cast("double").alias("size"), model.is_flat().alias("flat"), model.is_bold("_font", "_flags").alias("bold"), model.is_italic("_font", "_flags").alias("italic"))


@query("SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_no, length(trim(coalesce(text, ''))) < 20 AND turn % 2 = 0 AS is_scanned FROM (SELECT conv_id, turn, substr(text, 1, CASE WHEN turn % 3 = 0 THEN 15 ELSE 200 END) AS text FROM conversations)")
def f3_scanned(spark: SparkSession, folder: str) -> DataFrame:
    said = turns(spark, folder).withColumn("text", F.substring("text", F.lit(1), F.when(F.col("page_no") % 3 == 0, 15).otherwise(200)))
    return model.scanned_pages(said, "text", said.where("page_no % 2 = 0")).select("doc_id", "page_no", "is_scanned")


_AREA = "greatest(least(x1, 600) - greatest(x0, 0), 0) * greatest(least(y1, 840) - greatest(y0, 0), 0)"


@query(_LINES + f""", t AS (SELECT doc_id, page_no, count(*) AS n, bool_or(ord % 11 = 0 OR greatest(psize + 0.25, 9.0) >= 36) AS loud FROM l WHERE ord % 9 = 0 GROUP BY doc_id, page_no),
i AS (SELECT doc_id, page_no, sum({_AREA}) AS a FROM b WHERE ord % 2 = 0 GROUP BY doc_id, page_no),
s AS (SELECT doc_id, page_no, sum({_AREA}) AS a FROM b WHERE ord % 50 = 1 AND ord % 10 < 9 GROUP BY doc_id, page_no),
p AS (SELECT DISTINCT doc_id, page_no FROM b)
SELECT p.doc_id, p.page_no, CASE WHEN coalesce(n, 0) > 60 THEN false ELSE coalesce(n, 0) <= 40 AND coalesce(loud, false) OR CASE WHEN coalesce(i.a, 0) < 0.45 * 600 * 840 THEN coalesce(i.a, 0) + coalesce(s.a, 0) ELSE i.a END >= 0.45 * 600 * 840 END AS is_designed
FROM p LEFT JOIN t USING (doc_id, page_no) LEFT JOIN i USING (doc_id, page_no) LEFT JOIN s USING (doc_id, page_no)""")
def f4_designed(spark: SparkSession, folder: str) -> DataFrame:
    """Drawings are few and small, so that no graphic region forms and no page is a diagram."""
    all_ = boxes(spark, folder)
    images = all_.where("ord % 2 = 0").select("*", F.lit(9).alias("pixel_width"), F.lit(9).alias("pixel_height"))
    drawings = all_.where("ord % 50 = 1").select("*", F.lit(0).alias("items"), F.array((F.col("ord") % 10) / F.lit(10.0), F.lit(1.0)).alias("fill"))
    return model.designed_pages(_pages(all_), _lines(spark, folder).where("(block_no * 100 + line_no) % 9 = 0"), images, drawings)


@query(_BOXES + " SELECT doc_id, page_no, max(y1) AS bottom, max(y1) < 0.8 * 840 - 72 AS ends_early FROM b WHERE ord % 40 = 0 GROUP BY doc_id, page_no")
def a8_ends_early(spark: SparkSession, folder: str) -> DataFrame:
    all_ = boxes(spark, folder)
    return model.ends_early(all_.where("ord % 40 = 0"), _pages(all_), 72.0)


@query(_LINES + """, f AS (SELECT doc_id, page_no, block_no, line_no, greatest(0.0, least(x0, 590.0)) AS x, greatest(0.0, least(y0, 834.0)) AS y, greatest(psize + 0.25, 9.0) AS z, x0, x1, y0, y1 FROM l WHERE ord % 6 <> 0)
SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y, x, block_no, line_no) - 1 AS INTEGER) AS ord, x, y,
  least(greatest(1.1 * (x1 - x0) + 8, 2 * z), greatest(600 - x0, 20.0)) AS width, greatest(y1 - y0, 1.05 * z) AS height FROM f""")
def w14_frames(spark: SparkSession, folder: str) -> DataFrame:
    all_ = boxes(spark, folder)
    hidden = F.transform("spans", lambda s: s.withField("text", F.lit("\u200b")))  # nothing is left of it after repair
    lines = _lines(spark, folder).withColumn("spans", F.when((F.col("block_no") * 100 + F.col("line_no")) % 6 == 0, hidden).otherwise(F.col("spans")))
    return model.frames(lines, _pages(all_))


@query(_BOXES + " SELECT doc_id, page_no, CAST(ord AS VARCHAR) AS text, round_even(x0 / 7, 1) AS x0, round_even(y0 / 7, 1) AS y0, round_even(x1 / 7, 1) AS x1, round_even(y1 / 7, 1) AS y1 FROM b")
def u3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    small = boxes(spark, folder).select("doc_id", "page_no", F.col("ord").cast("string").alias("text"), *[(F.col(c) / 7).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return model.fingerprints(small)


@query("""
SELECT p_brand AS family, list_sort(list(DISTINCT CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'BoldItalic' WHEN p_size % 2 = 0 THEN 'Bold' WHEN p_size % 3 = 0 THEN 'Italic' ELSE 'Regular' END))::VARCHAR AS styles FROM part GROUP BY p_brand""")
def a12_used_fonts(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "part").select(F.col("p_brand").alias("family"), (F.col("p_size") % 2 == 0).alias("bold"), (F.col("p_size") % 3 == 0).alias("italic"))
    return model.used_fonts(runs).select("family", F.concat(F.lit("["), F.array_join("styles", ", "), F.lit("]")).alias("styles"))


@query("""
SELECT l_orderkey, l_linenumber, saved, CASE WHEN before <> 0 THEN saved * 100.0::DOUBLE / before ELSE 0.0 END AS percent, saved <= 0 AS unchanged
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 9 AS before, CAST(l_quantity AS BIGINT) % 9 - l_linenumber AS saved FROM lineitem)""")
def a10_compression(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") % 9).alias("before"), F.col("l_linenumber").alias("after"))
    return model.compression_report(files).drop("before", "after")


@query("""
WITH n AS (SELECT page_id, '/a/' || CAST(page_id % 50 AS VARCHAR) || '.pdf' AS path FROM pages WHERE page_id % 3 > 0)
SELECT min(page_id) AS ord, path FROM n WHERE path NOT IN ('/a/1.pdf', '/a/2.pdf') GROUP BY path""")
def a14_add_files(spark: SparkSession, folder: str) -> DataFrame:
    way = F.when(F.col("page_id") % 2 == 0, "/a/b/../").otherwise("/a/./")
    new = table(spark, folder, "pages").select(F.col("page_id").alias("ord"), F.concat(way, (F.col("page_id") % 50).cast("string"), F.when(F.col("page_id") % 3 > 0, ".pdf").otherwise(".txt")).alias("path"))
    have = spark.createDataFrame([("/a/1.pdf",), ("/a/c/../2.pdf",)], "path string")
    return model.add_files(have, new).select("ord", F.regexp_replace("path", r"/b/\.\./|/\./", "/").alias("path"))


@query("""
SELECT conv_id AS doc_id, count_if(turn % 3 = 0) AS passed, count_if(turn % 3 = 1) AS failed, count_if(turn % 3 = 2) AS manual,
  coalesce(string_agg(CASE WHEN turn % 3 = 1 THEN role || CAST(turn AS VARCHAR) END, ',' ORDER BY turn), '') AS issues FROM conversations GROUP BY conv_id""")
def a16_checks(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("page_no")
    results = turns(spark, folder).select("doc_id", n.alias("ord"), F.concat("role", n.cast("string")).alias("name"), F.col("role").alias("category"), F.when(n % 3 == 0, "passed").when(n % 3 == 1, "failed").otherwise("manual").alias("status"))
    return model.checks_summary(results).withColumn("issues", F.array_join(F.transform("issues", lambda i: i["name"]), ","))


@query(f"WITH b AS ({CROWDED_SQL})" + """, f AS (SELECT a.ord, min(b.ord) AS widget FROM b a JOIN b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.ord % 5 = b.ord % 5 AND b.ord % 2 = 1 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 WHERE a.ord % 2 = 0 GROUP BY a.ord)
SELECT a.ord, f.widget FROM b a LEFT JOIN f USING (ord) WHERE a.ord % 2 = 0""")
def j14_widgets(spark: SparkSession, folder: str) -> DataFrame:
    named = crowded(spark, folder).withColumn("name", (F.col("ord") % 5).cast("string"))
    return model.find_widget(named.where("ord % 2 = 0"), named.where("ord % 2 = 1")).select("ord", "widget")


@query("WITH RECURSIVE" + _LINES.removeprefix("WITH") + """, c AS MATERIALIZED (
  SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY block_no, line_no) AS i FROM l WHERE ord % 4 > 1 AND line_no % 13 <> 0
), g AS (
  SELECT doc_id, page_no, list({'r': ord, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} ORDER BY ord) AS around FROM b WHERE ord % 40 = 0 GROUP BY doc_id, page_no
), w AS (
  SELECT doc_id, page_no, CAST(0 AS BIGINT) AS i, around, CAST(0 AS BIGINT) AS home, CAST(0 AS BIGINT) AS ord FROM g
  UNION ALL
  SELECT doc_id, page_no, i, list_transform(around, lambda r, n: CASE WHEN n = home THEN {'r': r.r, 'x0': least(r.x0, x0), 'y0': least(r.y0, y0), 'x1': greatest(r.x1, x1), 'y1': greatest(r.y1, y1)} ELSE r END), home, ord FROM (
    SELECT w.doc_id, w.page_no, c.i, around, c.ord, x0, y0, x1, y1, CAST(coalesce(list_position(list_transform(around, lambda r: c.cx >= r.x0 AND c.cx <= r.x1 AND c.cy >= r.y0 AND c.cy <= r.y1), TRUE), 0) AS BIGINT) AS home
    FROM w JOIN c ON c.doc_id = w.doc_id AND c.page_no = w.page_no AND c.i = w.i + 1)
), o AS (SELECT ord, around[home].r AS region FROM w WHERE i > 0 AND home > 0
), k AS (SELECT DISTINCT c.ord FROM c JOIN b ON b.ord % 4 = 1 AND b.doc_id = c.doc_id AND b.page_no = c.page_no AND cx BETWEEN b.x0 - 1 AND b.x1 + 1 AND cy BETWEEN b.y0 - 1 AND b.y1 + 1)
SELECT l.ord, CASE WHEN line_no % 13 = 0 THEN 'furniture' WHEN region IS NOT NULL THEN 'region' WHEN k.ord IS NOT NULL THEN 'cell' ELSE 'body' END AS place, region
FROM l LEFT JOIN o ON o.ord = l.ord LEFT JOIN k ON k.ord = l.ord WHERE l.ord % 4 > 1""")
def j7_routes(spark: SparkSession, folder: str) -> DataFrame:
    all_, lines = boxes(spark, folder), _lines(spark, folder).withColumn("ord", (F.col("block_no") * 100 + F.col("line_no")).cast("long")).where("ord % 4 > 1")
    regions = all_.where("ord % 40 = 0").withColumnRenamed("ord", "region")
    return model.route_lines(lines, lines.where("line_no % 13 = 0"), regions, all_.where("ord % 4 = 1")).select("ord", "place", F.col("region").cast("long").alias("region"))


# spans that need repair, and what becomes of each by itself: a blank before a mark, a composition, a whole SARA AM and marks in
# disorder count only within a span
_RAW = ["ก", " ", "า", "ก า", "\u1112\u1161", "\u1112", "\u1161", "x\u200by", "\u0e4d\u0e32", "ก\u0e48\u0e38", "a\u00a0b", "\u0001", "e\u0301"]
_WHOLE = ["ก", " ", "า", "กา", "\ud558", "\u1112", "\u1161", "xy", "\u0e33", "ก\u0e38\u0e48", "a b", "", "\u00e9"]
_SPAN = "[" + ", ".join(f"'{t}'" for t in _WHOLE) + "]"


@query(f"SELECT p_partkey AS ord, {_SPAN}[1 + p_partkey % 13] || {_SPAN}[1 + (p_partkey // 13) % 13] || {_SPAN}[1 + (p_partkey // 7) % 13] AS text FROM part")
def p29_repaired_lines(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey").cast("int")
    of = lambda n: F.struct(F.array(*map(F.lit, _RAW))[n % 13].alias("text"))
    made = F.array(of(k), of(F.floor(k / 13).cast("int")), of(F.floor(k / 7).cast("int")))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("ord"), made.alias("spans")).select("ord", model.line_text().alias("text"))


# each part is a page with 6 + k % 6 lines in or beside twelve drawings that form one region, which on some pages is a table
@query("""SELECT p_partkey % 7 AS doc_id, CAST(p_partkey AS INTEGER) AS page_no, 6 + p_partkey % 6 >= 8 AND p_partkey % 2 = 0 AND p_partkey % 5 <> 0 AS is_designed FROM part""")
def f4_diagrams(spark: SparkSession, folder: str) -> DataFrame:
    k, i = F.col("ord"), F.col("i")
    pages = table(spark, folder, "part").select((F.col("p_partkey") % 7).alias("doc_id"), F.col("p_partkey").cast("int").alias("page_no"), F.lit(600.0).alias("width"), F.lit(840.0).alias("height"), F.col("p_partkey").cast("int").alias("ord"))
    box = lambda x0, y0, x1, y1: [v.cast("double").alias(n) for v, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)]
    drawn = pages.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(11)))).select("doc_id", "page_no", i.alias("ord"), *box(100 + i * 10, 100 + i * 10, 110 + i * 10, 110 + i * 10), F.array(F.lit(1.0)).alias("fill"))
    side = F.when(k % 2 == 0, 0).otherwise(300)
    span = F.struct(F.lit("label").alias("text"), F.lit(9.0).alias("size"))
    lines = pages.withColumn("i", F.explode(F.sequence(F.lit(0), 5 + k % 6))).select("doc_id", "page_no", F.lit(0).alias("block_no"), i.alias("line_no"), *box(side + 105, 105 + i * 8, side + 145, 112 + i * 8), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.array(span).alias("spans"))
    tables = pages.where(k % 5 == 0).select("doc_id", "page_no", *box(F.lit(95), F.lit(95), F.lit(230), F.lit(230)))
    none = drawn.where("false").select("*", F.lit(9).alias("pixel_width"), F.lit(9).alias("pixel_height"))
    return model.designed_pages(pages, lines, none, drawn, tables).select("doc_id", "page_no", "is_designed")


@query("""WITH t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'Page ' || (1 + p_partkey % 30) || ' of 40' WHEN p_partkey % 3 = 1 THEN '- ' || (1 + p_partkey % 30) || ' -' ELSE p_name END AS text, p_partkey % 3 = 2 AS plain FROM part)
SELECT k % 7 AS doc_id, CAST(k AS INTEGER) AS page_no, ['left', 'center', 'right'][1 + k % 3] AS align, text, CASE WHEN NOT plain THEN CAST(1 + k % 30 AS VARCHAR) END AS field, CASE WHEN k % 3 = 0 THEN '40' END AS total,
  CASE k % 3 WHEN 0 THEN 'text=Page |page=' || (1 + k % 30) || '|text= of |pages=40' WHEN 1 THEN 'text=- |page=' || (1 + k % 30) || '|text= -' ELSE 'text=' || text END AS runs FROM t""")
def w13_header_runs(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey").cast("int")
    number = (1 + k % 30).cast("string")
    pieces = F.when(k % 3 == 0, F.array(F.lit(" "), F.lit("Page "), number, F.lit(" of 40"), F.lit(" "))).when(k % 3 == 1, F.array(F.lit("- "), number, F.lit(" -"))).otherwise(F.array(F.lit(""), F.col("p_name")))
    spans = F.transform(pieces, lambda t: F.struct(t.alias("text"), F.lit(9.0).alias("size"), F.lit("Arial").alias("font"), F.lit(0).alias("flags"), F.lit(0).alias("color")))
    x = (k % 3) * 200.0 + 50
    lines = table(spark, folder, "part").select((F.col("p_partkey") % 7).alias("doc_id"), k.alias("page_no"), F.lit(0).alias("block_no"), F.lit(0).alias("line_no"), x.alias("x0"), F.lit(20.0).alias("y0"), (x + 100).alias("x1"), F.lit(30.0).alias("y1"), spans.alias("spans"))
    found = model.header_paragraphs(lines, _pages(lines))
    return found.select("doc_id", "page_no", "align", "text", "field", "total", F.array_join(F.transform("runs", lambda r: F.concat_ws("=", r["kind"], r["text"])), "|").alias("runs"))


def _exported(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each part is a page of one of seven documents: some without lines, some of signs that mean nothing, some in huge letters, in two sizes and two ways of numbering."""
    k, i = F.col("p_partkey").cast("int"), F.col("i")
    part = table(spark, folder, "part").withColumn("doc_id", F.col("p_partkey") % 7).withColumn("page_no", k)
    pages = part.select("doc_id", "page_no", F.when(F.floor(k / 50) % 2 == 0, 600.0).otherwise(500.0).alias("width"), F.lit(840.0).alias("height"))
    number = F.when(F.floor(k / 70) % 2 == 0, "Page 12").otherwise("- xii -")
    text = F.when(k % 11 == 0, "").when((i == 0) & (k % 3 == 0), number).otherwise(F.col("p_name"))
    spans = F.array(F.struct(text.alias("text"), F.when((k % 5 == 0) & (i == 1), 40.0).otherwise(12.0).alias("size"), F.when(k % 2 == 0, "Arial-BoldMT").otherwise("Tahoma").alias("font"), F.lit(0).alias("flags"), F.lit(0).alias("color")))
    lines = part.where("page_no % 13 > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("doc_id", "page_no", F.lit(0).alias("block_no"), i.alias("line_no"), F.lit(100.0).alias("x0"), (10 + i * 300.0).alias("y0"), F.lit(300.0).alias("x1"), (22 + i * 300.0).alias("y1"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), spans.alias("spans"))
    images = pages.where("page_no % 4 = 0").select("doc_id", "page_no", F.col("page_no").alias("ord"), (F.col("page_no") % 9).alias("xref"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(30.0).alias("x1"), F.lit(30.0).alias("y1"), F.lit(9).alias("pixel_width"), F.lit(9).alias("pixel_height"))
    return pages, lines, images


_EXPORTED = """
p AS MATERIALIZED (
  SELECT p_partkey % 7 AS doc_id, p_partkey AS k, CASE WHEN p_partkey % 13 = 0 OR p_partkey % 11 = 0 THEN 'picture' WHEN p_partkey % 5 = 0 THEN 'pinned' ELSE 'flow' END AS route, p_partkey % 11 = 0 AND p_partkey % 13 > 0 AS reported,
    CASE WHEN p_partkey // 50 % 2 = 0 THEN 600 ELSE 500 END AS w, CASE WHEN p_partkey % 3 = 0 THEN p_partkey // 70 % 2 END AS f, row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_partkey) AS n FROM part
), s AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS n, -1 AS section, NULL::INTEGER AS w, NULL::BIGINT AS f FROM p WHERE n = 1
  UNION ALL
  SELECT p.doc_id, p.n, s.section + CASE WHEN p.route <> 'flow' OR s.w IS NULL OR s.w <> p.w OR s.f <> p.f THEN 1 ELSE 0 END, CASE WHEN p.route = 'flow' THEN p.w END,
    CASE WHEN p.route <> 'flow' THEN NULL WHEN s.w IS NULL OR s.w <> p.w OR s.f <> p.f THEN p.f ELSE coalesce(p.f, s.f) END
  FROM s JOIN p ON p.doc_id = s.doc_id AND p.n = s.n + 1
), r AS MATERIALIZED (SELECT p.*, section FROM p JOIN s USING (doc_id, n))"""


@query(f"WITH RECURSIVE {_EXPORTED} SELECT doc_id, CAST(k AS INTEGER) AS page_no, route, reported, section FROM r")
def k6_page_routes(spark: SparkSession, folder: str) -> DataFrame:
    pages, lines, images = _exported(spark, folder)
    return export.page_routes(pages, lines, images, images.where("false").withColumn("fill", F.array(F.lit(1.0))))


@query(f"""WITH RECURSIVE {_EXPORTED}
SELECT doc_id, count(*) AS pages, max(section) + 1 AS sections, coalesce(string_agg(CASE WHEN reported THEN CAST(k + 1 AS VARCHAR) END, ',' ORDER BY k), '') AS picture_pages, count_if(route = 'pinned') AS pinned_pages,
  count_if(route = 'picture') + count(DISTINCT CASE WHEN route <> 'picture' AND k % 4 = 0 THEN k % 9 END) AS images,
  array_to_string(list_sort(list(DISTINCT CASE WHEN k % 2 = 0 THEN 'Arial Bold' ELSE 'Tahoma Regular' END) FILTER (route <> 'picture')), ',') AS fonts FROM r GROUP BY doc_id""")
def k6_export_summary(spark: SparkSession, folder: str) -> DataFrame:
    pages, lines, images = _exported(spark, folder)
    routes = export.page_routes(pages, lines, images, images.where("false").withColumn("fill", F.array(F.lit(1.0))))
    return export.export_summary(routes, lines, images).withColumns({"picture_pages": F.array_join("picture_pages", ","), "fonts": F.array_join("fonts", ",")})

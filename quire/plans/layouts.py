"""Queries of layout operators, over made geometry and over versions of sources; folds have no SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import compare, flow, layout, search
from quire.plans.registry import query
from quire.sources.tables import BOXES_SQL, boxes, table, turns


@query()
def a17_regions(spark: SparkSession, folder: str) -> DataFrame:
    drawings = boxes(spark, folder)
    pages = drawings.select("doc_id", "page_no").distinct().select("*", F.lit(700.0).alias("width"), F.lit(900.0).alias("height"))
    return layout.regions(drawings, pages, shapes=3)


@query()
def u10_table_slots(spark: SparkSession, folder: str) -> DataFrame:
    return layout.table_slots(boxes(spark, folder).withColumn("table_no", (F.col("ord") % 4).cast("int")))


@query()
def w3_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents laid out at a fixed pitch, a line as wide as its text."""
    lines = search.lines(table(spark, folder, "documents"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    y0 = (place % 40) * 18.0 + 60
    laid = lines.withColumn("p", place).select(
        "doc_id", (F.col("p") / 40).cast("int").alias("page_no"), F.col("line_no").cast("long").alias("ord"), "text", F.lit(12.0).alias("size"),
        F.lit(72.0).alias("x0"), F.least(F.lit(523.0), 72 + F.length("text") * 6.0).alias("x1"), y0.alias("y0"), (y0 + 14).alias("y1"), F.lit(72.0).alias("left"), F.lit(523.0).alias("right"),
    )
    return layout.paragraph_text(layout.paragraphs(laid))


# each part is a paragraph of one to four rows, some of them indented, centred, to the right, or full
@query("""
WITH p AS (SELECT p_partkey AS k, p_name AS name, p_partkey % 4 AS n, CASE p_partkey % 5 WHEN 0 THEN 150.0 WHEN 1 THEN 300.0 WHEN 2 THEN 92.0 ELSE 72.0 END AS x, CASE p_partkey % 5 WHEN 0 THEN 445.0 WHEN 3 THEN 400.0 ELSE 522.0 END AS z FROM part
), a AS (
  SELECT *, CASE WHEN k % 5 = 0 THEN 'center' WHEN k % 5 = 1 AND n = 0 THEN 'right' WHEN n >= 2 AND k % 5 <> 3 THEN 'both' ELSE 'left' END AS align FROM p)
SELECT k AS doc_id, name || repeat(' ' || name, CAST(n AS INTEGER)) AS text, align,
  CAST(CASE WHEN align IN ('left', 'both') AND CASE WHEN n = 0 OR k % 5 <> 2 THEN x ELSE 72 END - 72 > 2 THEN CASE WHEN n = 0 OR k % 5 <> 2 THEN x ELSE 72 END - 72 END AS DOUBLE) AS left_indent,
  CAST(CASE WHEN align IN ('left', 'both') AND k % 5 = 2 AND n > 0 THEN 20.0 END AS DOUBLE) AS first_indent FROM a""")
def w11_flowed_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    k, i = F.col("p_partkey"), F.col("row_no")
    rows = table(spark, folder, "part").withColumn("row_no", F.explode(F.sequence(F.lit(0), (k % 4).cast("int"))))
    x0 = F.when(k % 5 == 0, 150.0).when(k % 5 == 1, 300.0).when((k % 5 == 2) & (i == 0), 92.0).otherwise(72.0)
    x1 = F.when(k % 5 == 0, 445.0).when(k % 5 == 3, 400.0).otherwise(522.0)
    cells = rows.select(k.alias("doc_id"), F.lit(0).alias("para_no"), "row_no", F.lit(0).alias("cell_no"), x0.alias("x0"), x1.alias("x1"), F.lit(72.0).alias("left"), F.lit(523.0).alias("right"), F.array(F.struct(F.lit("k").alias("key"), F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("text"))).alias("runs"))
    found = flow.flowed(cells)
    return found.select("doc_id", F.regexp_replace(F.array_join(F.transform("runs", lambda r: r["text"]), ""), " +", " ").alias("text"), "align", "left_indent", "first_indent")


@query()
def w4_sections(spark: SparkSession, folder: str) -> DataFrame:
    pages = turns(spark, folder).select("doc_id", "page_no", F.lit(595.0).alias("width"), F.when(F.length("text") % 3 == 0, 842.0).otherwise(595.0).alias("height"), F.col("role").alias("numbering"))
    return layout.sections(pages)


# each part is a document of twelve words, of which the new version has one replaced and, on some, one six words further gone
@query("""
WITH p AS (SELECT p_partkey AS k, CAST(p_partkey % 12 AS INTEGER) AS r, CASE WHEN p_partkey % 3 = 0 THEN CAST((p_partkey + 6) % 12 AS INTEGER) END AS d FROM part
), m AS (
  SELECT k, CASE WHEN d < r THEN 1 ELSE 0 END AS ord, 'Highlight' AS type, 'Replaced: w' || r || ' -> X' AS content, 10.0 * (r - CASE WHEN d < r THEN 1 ELSE 0 END) AS x0, 10.0 * (r - CASE WHEN d < r THEN 1 ELSE 0 END) + 8 AS x1 FROM p
  UNION ALL SELECT k, CASE WHEN r < d THEN 1 ELSE 0 END, 'Caret', 'Deleted: w' || d, CASE WHEN d < 11 THEN 10.0 * d ELSE 108.0 END, CASE WHEN d < 11 THEN 10.0 * d ELSE 108.0 END FROM p WHERE d IS NOT NULL
)
SELECT k AS doc_id, 0 AS page_no, ord, type, content, CAST(x0 AS DOUBLE) AS x0, CAST(5 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(15 AS DOUBLE) AS y1 FROM m""")
def e5_comparison_marks(spark: SparkSession, folder: str) -> DataFrame:
    k, i = F.col("p_partkey"), F.sequence(F.lit(0), F.lit(11))
    name = lambda n: F.concat(F.lit("w"), n.cast("string"))
    changed = F.filter(F.transform(i, lambda n: F.when(n == k % 12, "X").when((k % 3 == 0) & (n == (k + 6) % 12), None).otherwise(name(n))), lambda w: w.isNotNull())
    part = table(spark, folder, "part")
    old = part.select(k.alias("doc_id"), F.posexplode(F.transform(i, name)).alias("ord", "word")).withColumn("page_no", F.lit(0))
    new = part.select(k.alias("doc_id"), F.posexplode(changed).alias("ord", "word")).withColumn("page_no", F.lit(0))
    boxed = new.withColumns({"x0": F.col("ord") * 10.0, "y0": F.lit(5.0), "x1": F.col("ord") * 10.0 + 8, "y1": F.lit(15.0)})
    return compare.marks(boxed, old)


@query()
def j19_compare(spark: SparkSession, folder: str) -> DataFrame:
    """What users and assistants say in a conversation, compared as two versions."""
    said = turns(spark, folder)
    return layout.compare(said.where("role = 'user'"), said.where("role <> 'user'"))


@query()
def j15_underlined(spark: SparkSession, folder: str) -> DataFrame:
    all_ = boxes(spark, folder)
    rows = all_.where("ord % 5 > 0").select("doc_id", "page_no", "ord", "y1", F.col("x0").alias("left"), F.col("x1").alias("right"))
    return layout.underlined(rows, all_.where("ord % 5 = 0")).select("doc_id", "page_no", "ord", F.array_join("rules", ",").alias("rules"), "style", "size")


@query("""
SELECT doc_id, CAST(n AS INTEGER) AS line_no, CASE WHEN f LIKE '\\_%' ESCAPE '\\' THEN 'text' ELSE 'checkbox' END AS kind FROM (
  SELECT doc_id, n, unnest(regexp_extract_all(t, '_{3,}|[☐□]')) AS f FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents))
""")
def e3_blanks(spark: SparkSession, folder: str) -> DataFrame:
    return layout.blanks(search.lines(table(spark, folder, "documents")))


@query(f"""
WITH b AS ({BOXES_SQL}), s AS (
  SELECT doc_id, CAST(round_even(10 + ord % 4, 0) AS INTEGER) AS size, lead(y0) OVER (PARTITION BY doc_id, page_no ORDER BY y0, ord) - y0 AS d, 10.0 + ord % 4 AS z FROM b
), u AS (SELECT * FROM s WHERE d > 0.8 * z AND d < 3 * z),
r AS (SELECT doc_id, size, d, row_number() OVER (PARTITION BY doc_id, size ORDER BY d) AS k, count(*) OVER (PARTITION BY doc_id, size) AS n FROM u),
q AS (SELECT doc_id, d / size AS ratio, row_number() OVER (PARTITION BY doc_id ORDER BY d / size) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM u),
a AS (SELECT DISTINCT doc_id, size FROM s)
SELECT a.doc_id, a.size, coalesce(r.d, q.ratio * a.size) AS pitch
FROM a LEFT JOIN r ON a.doc_id = r.doc_id AND a.size = r.size AND r.k = r.n // 2 + 1 LEFT JOIN q ON a.doc_id = q.doc_id AND q.k = q.n // 2 + 1
""")
def a5_pitches(spark: SparkSession, folder: str) -> DataFrame:
    rows = boxes(spark, folder).select("doc_id", F.col("page_no").alias("para_no"), F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("y0", "ord")).alias("row_no"), "y0", (10.0 + F.col("ord") % 4).alias("size"))
    return layout.pitches(rows)


@query("""
SELECT conv_id AS doc_id, '<fields>' || string_agg('<field name="t' || lpad(CAST(turn AS VARCHAR), 5, '0') || '"><value>' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</value></field>', '' ORDER BY lpad(CAST(turn AS VARCHAR), 5, '0')) || '</fields>' AS xfdf
FROM conversations GROUP BY conv_id
""")
def k12_export_form(spark: SparkSession, folder: str) -> DataFrame:
    fields = turns(spark, folder).select("doc_id", F.concat(F.lit("t"), F.lpad(F.col("page_no").cast("string"), 5, "0")).alias("name"), F.col("text").alias("value"))
    return layout.to_xfdf(fields)


@query("SELECT conv_id AS doc_id, 't' || lpad(CAST(turn AS VARCHAR), 5, '0') AS name, text AS value FROM conversations")
def s20_import_form(spark: SparkSession, folder: str) -> DataFrame:
    """What k12_export_form writes, read again."""
    return layout.from_xfdf(k12_export_form(spark, folder))


@query("SELECT role AS category, count(*) AS count FROM conversations GROUP BY role")
def a13_hidden_counts(spark: SparkSession, folder: str) -> DataFrame:
    return layout.hidden_counts(turns(spark, folder).select("doc_id", F.col("role").alias("category")))

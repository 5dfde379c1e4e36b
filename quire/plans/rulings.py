"""Queries of ruled tables and of deletions, over pages that are made of the parts, one for each, so that they grow with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import rulings
from quire.plans.registry import query
from quire.sources.tables import SHEETS_SQL, sheets, table

# Each part is a page with a table of 1 + k % 4 rows (and a shaded header for some) and 2 + k % 3 columns, 60 by 20 points, drawn
# as segments that are a little off, with a cell over two columns on some, and slanted lines and a stub besides.


def drawings(spark: SparkSession, folder: str) -> DataFrame:
    k, i, j = F.col("p_partkey"), F.col("i"), F.col("j")
    part = table(spark, folder, "part").select("p_partkey", (1 + k % 4).alias("r"), (2 + k % 3).alias("c"))
    off = lambda n: ((k * 7 + n) % 3) * F.lit(0.5)
    line = lambda *xy: F.struct(*(v.cast("double").alias(n) for v, n in zip(xy, ("x0", "y0", "x1", "y1"), strict=True)), F.lit("line").alias("kind"), F.lit(True).alias("stroked"))
    rows = part.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("r").cast("int"))))
    across = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c").cast("int") - 1))).select("p_partkey", line(50 + j * 60, 100 + i * 20 + off(j), 110 + j * 60, 100 + i * 20 + off(j)).alias("d"))
    down = rows.where("i < r").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c").cast("int")))).where((F.col("i") > 0) | (j != 1) | (k % 5 > 0))
    down = down.select("p_partkey", line(50 + j * 60 + off(i), 100 + i * 20, 50 + j * 60 + off(i), 120 + i * 20).alias("d"))
    fill = lambda *xy: line(*xy).withField("kind", F.lit("rect")).withField("stroked", F.lit(False))
    shade = part.where(k % 2 == 0).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c").cast("int") - 1))).select("p_partkey", fill(50 + j * 60, F.lit(80), 110 + j * 60, F.lit(100)).alias("d"))
    odd = part.select("p_partkey", F.explode(F.array(line(F.lit(10), F.lit(10), F.lit(90), F.lit(60)), line(F.lit(400), F.lit(100), F.lit(402), F.lit(100)))).alias("d"))
    return across.union(down).union(shade).union(odd).select((k % 7).alias("doc_id"), k.cast("int").alias("page_no"), "d.*")


_DRAWINGS = """
WITH p AS (SELECT p_partkey AS k, 1 + p_partkey % 4 AS r, 2 + p_partkey % 3 AS c FROM part),
a AS (SELECT k, unnest(range(0, r + 1)) AS i, r, c FROM p),
line AS (
  SELECT k, TRUE AS across, 100 + i * 20 + ((k * 7 + j) % 3) * 0.5 AS pos, CAST(50 + j * 60 AS DOUBLE) AS low, CAST(110 + j * 60 AS DOUBLE) AS high FROM (SELECT *, unnest(range(0, c)) AS j FROM a)
  UNION ALL
  SELECT k, FALSE, 50 + j * 60 + ((k * 7 + i) % 3) * 0.5, 100 + i * 20, 120 + i * 20 FROM (SELECT *, unnest(range(0, c + 1)) AS j FROM a WHERE i < r) WHERE i > 0 OR j <> 1 OR k % 5 > 0
  UNION ALL SELECT k, TRUE, 100.0, 400, 402 FROM p
), fill AS (
  SELECT * FROM line
  UNION ALL SELECT k, TRUE, unnest([80.0, 100.0]), 50 + j * 60, 110 + j * 60 FROM (SELECT *, unnest(range(0, c)) AS j FROM p WHERE k % 2 = 0)
  UNION ALL SELECT k, FALSE, 50 + (j + unnest([0, 1])) * 60, 80, 100 FROM (SELECT *, unnest(range(0, c)) AS j FROM p WHERE k % 2 = 0)
)"""


def _ruled_sql(edges: str, name: str) -> str:
    """Positions by gaps, joined edges, crossings, and cells as the least of all closed rectangles at a crossing."""
    return f""", {name}_s AS (
  SELECT *, avg(pos) OVER (PARTITION BY k, across, run) AS mid FROM (SELECT *, sum(gap) OVER (PARTITION BY k, across ORDER BY pos) AS run FROM (
    SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY k, across ORDER BY pos) > 3 THEN 1 ELSE 0 END AS gap FROM {edges}))
), {name}_e AS MATERIALIZED (
  SELECT k, across, run, part, any_value(mid) AS mid, min(low) AS low, max(high) AS high FROM (
    SELECT *, sum(gap2) OVER (PARTITION BY k, across, run ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS part FROM (
      SELECT *, CASE WHEN low - max(high) OVER (PARTITION BY k, across, run ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 3 THEN 1 ELSE 0 END AS gap2 FROM {name}_s))
  GROUP BY k, across, run, part HAVING max(high) - min(low) >= 3
), {name}_x AS MATERIALIZED (
  SELECT h.k, v.mid AS x, h.mid AS y, (h.run, h.part) AS h, (v.run, v.part) AS v FROM {name}_e h JOIN {name}_e v ON h.k = v.k AND h.across AND NOT v.across
  WHERE v.mid BETWEEN h.low - 3 AND h.high + 3 AND h.mid BETWEEN v.low - 3 AND v.high + 3
), {name}_c AS MATERIALIZED (
  SELECT k, x AS x0, y AS y0, m[2] AS x1, m[1] AS y1 FROM (
    SELECT a.k, a.x, a.y, min([b.y, c.x]) AS m FROM {name}_x a JOIN {name}_x b ON a.k = b.k AND a.v = b.v AND b.y > a.y JOIN {name}_x c ON a.k = c.k AND a.h = c.h AND c.x > a.x
    JOIN {name}_x d ON a.k = d.k AND d.h = b.h AND d.v = c.v GROUP BY a.k, a.x, a.y)
)"""


@query(_DRAWINGS + _ruled_sql("line", "s") + " SELECT k % 7 AS doc_id, CAST(k AS INTEGER) AS page_no, x, y FROM s_x")
def s7_crossings(spark: SparkSession, folder: str) -> DataFrame:
    return rulings.crossings(rulings.ruled(rulings.edges(drawings(spark, folder)))).select("doc_id", "page_no", "x", "y")


# on these pages all cells of a kind are one table; the shaded row is the plain table's first, and ends where the strict one begins
@query(_DRAWINGS + _ruled_sql("line", "s") + _ruled_sql("fill", "p") + """,
strict AS (SELECT * FROM s_c WHERE k IN (SELECT k FROM s_c GROUP BY k HAVING count(DISTINCT x0) > 1)),
plain AS (SELECT * FROM p_c WHERE k IN (SELECT k FROM p_c GROUP BY k HAVING count(DISTINCT x0) > 1))
SELECT k % 7 AS doc_id, CAST(k AS INTEGER) AS page_no, 0 AS table_no, x0, y0, x1, y1 FROM (
  SELECT * FROM strict
  UNION ALL SELECT p.* FROM plain p JOIN (SELECT k, min(y0) AS top FROM strict GROUP BY k) s ON p.k = s.k AND p.y1 <= top + 2
  UNION ALL SELECT p.* FROM plain p WHERE k NOT IN (SELECT k FROM strict))""")
def s7_tables(spark: SparkSession, folder: str) -> DataFrame:
    drawn = drawings(spark, folder)
    return rulings.with_headers(rulings.tables(drawn), rulings.tables(drawn, strict=False))


@query("WITH RECURSIVE b AS (" + SHEETS_SQL + """), s AS (
  SELECT *, y1 - y0 AS h, least(0.6, (x1 - x0) * 0.1) AS dx FROM b
), c AS (
  SELECT doc_id, page_no, ord, x0 + dx AS cx0, y0 + 0.18 * h AS cy0, x1 - dx AS cx1, y1 - 0.18 * h AS cy1, x0 + 0.3 AS rx0, y0 + 0.05 * h AS ry0, x1 - 0.3 AS rx1, y1 - 0.05 * h AS ry1 FROM s
), e AS MATERIALIZED (
  SELECT a.ord AS a, b.ord AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.ord <> b.ord AND a.cx0 < b.rx1 AND b.rx0 < a.cx1 AND a.cy0 < b.ry1 AND b.ry0 < a.cy1
), r AS (
  SELECT ord AS target, ord FROM b WHERE ord % 5 = 0 UNION SELECT r.target, e.b FROM r JOIN e ON e.a = r.ord
)
SELECT doc_id, page_no, target, r.ord FROM r JOIN b ON b.ord = r.ord""")
def a18_victims(spark: SparkSession, folder: str) -> DataFrame:
    spans = sheets(spark, folder)
    return rulings.victims(spans, spans.where("ord % 5 = 0").withColumn("target", F.col("ord"))).select("doc_id", "page_no", "target", "ord")

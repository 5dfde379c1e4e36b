"""Tables of a folder of Parquet files, and the test tables seen as what a document reader would give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def source_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each source as a document, its rows as pages: doc_id (the source), page_no in the order of the rows' ids, text, row_id."""
    docs = table(spark, folder, "documents")
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return docs.select(F.col("source").alias("doc_id"), number.alias("page_no"), "text", F.col("doc_id").alias("row_id"))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation as a document, its turns as pages: doc_id, page_no, role, text."""
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_no"), "role", "text")


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """A layout made of the parts' numbers: doc_id, page_no, ord, x0, y0, x1, y1, a hundred on a page. The tables hold no geometry of their own."""
    k = F.col("p_partkey")
    corner = table(spark, folder, "part").select((k % 7).alias("doc_id"), F.floor(k / 700).cast("int").alias("page_no"), k.alias("ord"), (k * 37 % 500).cast("double").alias("x0"), (k * 91 % 700).cast("double").alias("y0"), "p_size")
    return corner.select("doc_id", "page_no", "ord", "x0", "y0", (F.col("x0") + 10 + F.col("p_size") * 3).alias("x1"), (F.col("y0") + 8 + F.col("p_size") * 2).alias("y1"))


def crowded(spark: SparkSession, folder: str) -> DataFrame:
    """As boxes(), all on three pages of each document, so that a page holds more the more rows there are."""
    return boxes(spark, folder).withColumn("page_no", (F.col("ord") % 3).cast("int"))


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Places on the pages of crowded(), from the customers' numbers: doc_id, page_no, point, x, y."""
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select((k % 7).alias("doc_id"), (k % 3).cast("int").alias("page_no"), k.alias("point"), (k * 53 % 560).cast("double").alias("x"), (k * 71 % 780).cast("double").alias("y"))


def sheets(spark: SparkSession, folder: str) -> DataFrame:
    """As boxes(), on pages of forty boxes each, so that there are more pages where there are more rows."""
    k = F.col("p_partkey")
    corner = table(spark, folder, "part").select((k % 7).alias("doc_id"), F.floor(k / 280).cast("int").alias("page_no"), k.alias("ord"), (k * 37 % 500).cast("double").alias("x0"), (k * 91 % 700).cast("double").alias("y0"), "p_size")
    return corner.select("doc_id", "page_no", "ord", "x0", "y0", (F.col("x0") + 10 + F.col("p_size") * 3).alias("x1"), (F.col("y0") + 8 + F.col("p_size")).alias("y1"))


#: boxes(), crowded() and points() for an SQL engine over the same tables.
BOXES_SQL = """
SELECT p_partkey % 7 AS doc_id, CAST(p_partkey // 700 AS INTEGER) AS page_no, p_partkey AS ord,
       CAST(p_partkey * 37 % 500 AS DOUBLE) AS x0, CAST(p_partkey * 91 % 700 AS DOUBLE) AS y0,
       CAST(p_partkey * 37 % 500 AS DOUBLE) + 10 + p_size * 3 AS x1, CAST(p_partkey * 91 % 700 AS DOUBLE) + 8 + p_size * 2 AS y1
FROM part
"""
CROWDED_SQL = BOXES_SQL.replace("CAST(p_partkey // 700 AS INTEGER)", "CAST(p_partkey % 3 AS INTEGER)")
POINTS_SQL = """
SELECT c_custkey % 7 AS doc_id, CAST(c_custkey % 3 AS INTEGER) AS page_no, c_custkey AS point,
       CAST(c_custkey * 53 % 560 AS DOUBLE) AS x, CAST(c_custkey * 71 % 780 AS DOUBLE) AS y
FROM customer
"""
#: As sheets().
SHEETS_SQL = """
SELECT p_partkey % 7 AS doc_id, CAST(p_partkey // 280 AS INTEGER) AS page_no, p_partkey AS ord,
       CAST(p_partkey * 37 % 500 AS DOUBLE) AS x0, CAST(p_partkey * 91 % 700 AS DOUBLE) AS y0,
       CAST(p_partkey * 37 % 500 AS DOUBLE) + 10 + p_size * 3 AS x1, CAST(p_partkey * 91 % 700 AS DOUBLE) + 8 + p_size AS y1
FROM part
"""

"""Queries on what the given texts don't hold: each part takes some of a few literal texts, beside which stands what must come of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import edits, layout, model
from quire.plans.registry import query
from quire.sources.tables import SHEETS_SQL, sheets, table


def _taken(texts: list[str], spark: SparkSession, folder: str) -> DataFrame:
    """ord, text: a text of the list for each part."""
    k = F.col("p_partkey").cast("int")
    return table(spark, folder, "part").select(F.col("p_partkey").alias("ord"), F.array(*map(F.lit, texts))[k % len(texts)].alias("text"))


def _given(values: list, kind: str = "VARCHAR") -> str:
    """SQL that takes the value that belongs to a part's text."""
    shown = ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"CAST([{shown}][1 + p_partkey % {len(values)}] AS {kind})"


_REPAIRS = {"นํา": "นำ", "นํ้า": "น้ำ", "กุ่": "กุ่", "ก ิ": "กิ", "a\u200bb\u00ad": "ab", "a\u00a0b": "a b", "e\u0301": "é", "\u1112\u1161": "하", "x\u0001y": "xy", "plain": "plain", "": ""}
_PAGE_LINES = {"- 7 -": "7", "Page iv": "iv", "หน้า ๓ / ๑๒": "๓", "p. 12 of 40": "12", "ก": "ก", "|XIV|": "XIV", "12345": None, "Page": None, "7 apples": None, "ivy x": None}
_ITEMS = {"● one": True, "1. two": True, "(3) three": True, "2.1.4 four": True, "ก. ห้า": True, "a) six": True, "- dash": True, "12 nothing": False, "word. no": False, "●none": False}
_ENTRIES = {"Chapter 1 ........ 12": True, "บทที่ ๑ ……… ๓": False, "Intro . . . . . iv": True, "One ..... ": False, "ellipsis... 3": False, "dots ···· 9": True}
_FAILED = {"abc": 0.0, "\ue000\ue001ab": 0.5, "\ufffd": 1.0, "a \ufffd b c": 0.25, "": 0.0, " \n": 0.0}
_BLANKS = {"Name: ____ Date: ___": "text,text", "☐ yes □ no": "checkbox,checkbox", "__ too short": "", "____________": "text", "none": "", "_____ ☐": "text,checkbox"}
_MIXED = {"Thai ไทย 12": "Thai =f|ไทย=t| 12=f", "ไทย": "ไทย=t", "abc": "abc=f", "กa": "ก=t|a=f", "๑๒ x": "๑๒=t| x=f"}


@query(f"SELECT p_partkey AS ord, {_given(list(_REPAIRS.values()))} AS text FROM part")
def c1_repaired_literals(spark: SparkSession, folder: str) -> DataFrame:
    return _taken(list(_REPAIRS), spark, folder).select("ord", T.repair_text("text").alias("text"))


@query(f"SELECT p_partkey AS ord, {_given(list(_FAILED.values()), 'DOUBLE')} AS ratio FROM part")
def f1_undecodable_literals(spark: SparkSession, folder: str) -> DataFrame:
    return _taken(list(_FAILED), spark, folder).select("ord", T.undecodable_ratio("text").alias("ratio"))


@query(f"SELECT p_partkey AS ord, {_given(list(_PAGE_LINES.values()))} AS number, {_given([v is not None for v in _PAGE_LINES.values()], 'BOOLEAN')} AS page_number FROM part")
def f12_page_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return _taken(list(_PAGE_LINES), spark, folder).select("ord", T.page_token("text").alias("number"), T.is_page_number("text").alias("page_number"))


@query(f"SELECT p_partkey AS ord, {_given(list(_ITEMS.values()), 'BOOLEAN')} AS list_item FROM part")
def f13_list_items(spark: SparkSession, folder: str) -> DataFrame:
    return _taken(list(_ITEMS), spark, folder).select("ord", T.is_list_item("text").alias("list_item"))


@query(f"SELECT p_partkey AS ord, {_given(list(_ENTRIES.values()), 'BOOLEAN')} AS contents_line FROM part")
def f14_contents_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _taken(list(_ENTRIES), spark, folder).select("ord", T.is_contents_line("text").alias("contents_line"))


@query(f"SELECT p_partkey AS ord, {_given(list(_MIXED.values()))} AS runs FROM part")
def p28_script_literals(spark: SparkSession, folder: str) -> DataFrame:
    shown = F.transform(T.script_runs("text"), lambda r: F.concat(r["piece"], F.when(r["thai"], "=t").otherwise("=f")))
    return _taken(list(_MIXED), spark, folder).select("ord", F.array_join(shown, "|").alias("runs"))


@query(f"SELECT ord, kind FROM (SELECT p_partkey AS ord, unnest(string_split({_given(list(_BLANKS.values()))}, ',')) AS kind FROM part) WHERE kind <> ''")
def e3_blanks_of_forms(spark: SparkSession, folder: str) -> DataFrame:
    lines = _taken(list(_BLANKS), spark, folder).select(F.col("ord").alias("doc_id"), F.lit(0).alias("line_no"), "text")
    return layout.blanks(lines).select(F.col("doc_id").alias("ord"), "kind")


@query("SELECT p_partkey AS ord FROM part WHERE p_partkey % 7 <> 0 AND NOT (p_partkey % 4 <= 2 AND p_partkey % 5 <= 2) AND p_partkey % 3 <> 0")
def s5_full_page_images(spark: SparkSession, folder: str) -> DataFrame:
    """Every third image covers 90 % of its page, every seventh has no width."""
    k = F.col("p_partkey").cast("int")
    images = table(spark, folder, "part").select((k % 7).cast("long").alias("doc_id"), k.alias("page_no"), F.col("p_partkey").alias("ord"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.when(k % 7 == 0, 0.0).when(k % 3 == 0, 540.0).otherwise(300.0).alias("x1"), F.lit(840.0).alias("y1"), (k % 4).alias("pixel_width"), (k % 5).alias("pixel_height"))
    pages = images.select("doc_id", "page_no", F.lit(600.0).alias("width"), F.lit(840.0).alias("height"))
    return model.placed_images(images, pages).select("ord")


# on every page the first box is moved by (30, 20), a little off; on some pages too far off, or something else changes, goes or comes
@query("WITH b AS (" + SHEETS_SQL + "), f AS (SELECT doc_id, page_no, min(ord) AS ord, count(*) AS n FROM b GROUP BY doc_id, page_no) SELECT doc_id, page_no, ord, page_no % 5 = 0 OR page_no % 5 = 4 AND n = 1 OR page_no % 5 IN (2, 3) AND n = 1 AS verified FROM f")
def u2_verified_moves(spark: SparkSession, folder: str) -> DataFrame:
    before = sheets(spark, folder).withColumn("text", (F.col("ord") % 3).cast("string"))
    first = before.groupBy("doc_id", "page_no").agg(F.min("ord").alias("_first"), F.max("ord").alias("_last"))
    kind, moved = F.col("page_no") % 5, F.col("ord") == F.col("_first")
    shift = lambda by: F.when(moved, F.when(kind == 1, by + 2.0).otherwise(by + 1.0)).when((kind == 2) & (F.col("ord") == F.col("_last")), 0.2).otherwise(0.0)
    both = before.join(first, ["doc_id", "page_no"])
    after = both.where((kind != 3) | moved | (F.col("ord") != F.col("_last"))).withColumns({"x0": F.col("x0") + shift(30), "x1": F.col("x1") + shift(30), "y0": F.col("y0") + shift(20), "y1": F.col("y1") + shift(20)})
    after = after.withColumn("text", F.when((kind == 4) & ~moved & (F.col("ord") == F.col("_last")), "other").otherwise(F.col("text")))
    return edits.verified_moves(before, after.drop("_first", "_last"), first.select("doc_id", "page_no", F.col("_first").alias("ord"), F.lit(30.0).alias("dx"), F.lit(20.0).alias("dy")))


@query("""
WITH RECURSIVE l AS (
  SELECT conv_id AS doc_id, turn AS n, CASE WHEN turn = 0 THEN 'open' WHEN length(text) % 4 = 0 THEN 'undo' WHEN length(text) % 4 = 1 THEN 'redo' ELSE 'edit' END AS action, CAST(turn AS VARCHAR) AS version, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations
), s AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i, NULL::VARCHAR AS now, []::VARCHAR[] AS back, []::VARCHAR[] AS ahead FROM l WHERE i = 1
  UNION ALL
  SELECT s.doc_id, l.i, CASE WHEN action IN ('open', 'edit') THEN version WHEN action = 'undo' AND len(back) > 0 THEN back[-1] WHEN action = 'redo' AND len(ahead) > 0 THEN ahead[-1] ELSE now END,
    CASE WHEN action = 'open' THEN [] WHEN action = 'edit' THEN CASE WHEN now IS NULL THEN back ELSE list_append(back, now)[-2:] END WHEN action = 'undo' AND len(back) > 0 THEN back[1:len(back) - 1] WHEN action = 'redo' AND len(ahead) > 0 THEN list_append(back, now) ELSE back END,
    CASE WHEN action IN ('open', 'edit') THEN [] WHEN action = 'undo' AND len(back) > 0 THEN list_append(ahead, now) WHEN action = 'redo' AND len(ahead) > 0 THEN ahead[1:len(ahead) - 1] ELSE ahead END
  FROM s JOIN l ON l.doc_id = s.doc_id AND l.i = s.i + 1
)
SELECT doc_id, arg_max(CASE WHEN now IS NULL THEN '' ELSE now END, i) AS version, CAST(arg_max(len(back), i) AS INTEGER) AS can_undo, CAST(arg_max(len(ahead), i) AS INTEGER) AS can_redo FROM s GROUP BY doc_id""")
def u9_undo_and_redo(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of conversations as a log of edits, of which two can be undone."""
    n = F.length("text") % 4
    action = F.when(F.col("turn") == 0, "open").when(n == 0, "undo").when(n == 1, "redo").otherwise("edit")
    log = table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("n"), action.alias("action"), F.col("turn").cast("string").alias("version"))
    return edits.undone(log, most=2).withColumn("version", F.coalesce("version", F.lit("")))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN q % 11 = 0 THEN 'smask' WHEN q % 13 = 0 THEN 'mask' WHEN q % 17 = 0 THEN 'stencil' WHEN q % 7 = 0 THEN 'bitonal' WHEN q % 19 = 0 THEN 'empty' WHEN w * h < 10000 THEN 'small' WHEN scale > 0.95 AND q * 1000 < 24576 THEN 'fine' END AS skip
FROM (SELECT *, least(CAST(1 AS DOUBLE), CASE WHEN l_linenumber > 1 THEN CAST(150 AS DOUBLE) * (l_linenumber * 40) / (w * CAST(72 AS DOUBLE)) ELSE CAST(150 AS DOUBLE) * CAST(11.7 AS DOUBLE) / greatest(w, h) END) AS scale
  FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_quantity AS BIGINT) * 10 + 50 AS w, l_linenumber * 100 AS h FROM lineitem))""")
def f7_shrink_plan(spark: SparkSession, folder: str) -> DataFrame:
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    every = lambda m: q % m == 0
    images = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (q * 10 + 50).alias("px_w"), (n * 100).alias("px_h"), F.when(n > 1, n * 40).otherwise(1).alias("shown_pt"), F.when(every(19), 0).otherwise(q * 1000).alias("stored"), every(11).alias("soft_mask"), every(13).alias("mask"), every(17).alias("stencil"), F.when(every(7), 1).otherwise(8).alias("bits"))
    return edits.shrink_plan(images, dpi=150, floor=24 * 1024).select("l_orderkey", "l_linenumber", "skip")

"""Queries over the table of documents: lines, search, redaction, repeated lines, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import relate, search
from quire.plans.registry import query
from quire.sources.tables import table

_LINES = """
SELECT doc_id, source, n AS line_no, t AS text FROM (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS t, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents
) WHERE trim(t, ' ') <> ''
"""
_PAGE_NUMBER = T.PAGE_NUMBER.replace("'", "''")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return search.lines(_docs(spark, folder), "source")


@query(f"""
WITH l AS ({_LINES}), k AS (
  SELECT *, regexp_replace(regexp_replace(text, '\\s', '', 'g'), '[0-9๐-๙]+', '#', 'g') AS furniture_key FROM l
), p AS (SELECT source, count(DISTINCT doc_id) AS n FROM l GROUP BY source),
o AS (
  SELECT k.source, furniture_key, count(DISTINCT doc_id) AS key_pages, any_value(n) AS n FROM k JOIN p USING (source) GROUP BY 1, 2
  HAVING count(DISTINCT doc_id) >= greatest(2, CAST(ceil(any_value(n) * 0.1) AS BIGINT))
)
SELECT k.source, k.doc_id, CAST(k.line_no AS INTEGER) AS line_no, k.furniture_key, o.key_pages
FROM k LEFT JOIN o ON k.source = o.source AND k.furniture_key = o.furniture_key
WHERE o.key_pages IS NOT NULL OR regexp_matches(k.text, '{_PAGE_NUMBER}')
""")
def a1_furniture(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that run through a source's documents, at a tenth of them."""
    return search.furniture(_lines(spark, folder), "source", "doc_id", min_ratio=0.1).select("source", "doc_id", "line_no", "furniture_key", "key_pages")


@query(f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, text FROM ({_LINES})")
def s3_lines(spark: SparkSession, folder: str) -> DataFrame:
    return search.lines(_docs(spark, folder))


@query("SELECT CAST(sum(len(regexp_extract_all(text, 'the'))) AS BIGINT) AS n_hits FROM documents")
def a2_count_matches(spark: SparkSession, folder: str) -> DataFrame:
    return search.count_matches(_docs(spark, folder), "the")


@query("""
WITH p AS (SELECT doc_id, string_split(text, 'tion') AS parts FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, parts, unnest(range(len(parts) - 1)) AS hit FROM p)
SELECT doc_id, CAST(hit AS INTEGER) AS hit, CAST(list_sum([length(x) for x in parts[1:hit + 1]]) + hit * 4 AS INTEGER) AS position FROM q
""")
def c4_find(spark: SparkSession, folder: str) -> DataFrame:
    return search.find(_docs(spark, folder), "tion")


@query("SELECT doc_id, replace(text, 'tion', '-$TION\\') AS text, CAST(len(regexp_extract_all(text, 'tion')) AS INTEGER) AS n_replaced FROM documents")
def c5_replace(spark: SparkSession, folder: str) -> DataFrame:
    return search.replace_text(_docs(spark, folder), "tion", "-$TION\\").select("doc_id", "text", "n_replaced")


@query(f"""
WITH f AS (SELECT doc_id, text, regexp_extract_all(text, '{search.EMAIL}') AS found, string_split_regex(text, '{search.EMAIL}') AS parts FROM documents)
SELECT doc_id, CAST(len(found) AS INTEGER) AS n_redacted, array_to_string([parts[i] || coalesce(repeat('█', length(found[i])), '') for i in range(1, len(parts) + 1)], '') AS text FROM f
""")
def c6_redact_emails(spark: SparkSession, folder: str) -> DataFrame:
    return search.redact(_docs(spark, folder), search.EMAIL_ONCE).select("doc_id", "n_redacted", "text")


@query("SELECT doc_id, CASE WHEN doc_id IN (1, 5, 7) THEN '' ELSE text END AS text FROM documents")
def c7_redact_pages(spark: SparkSession, folder: str) -> DataFrame:
    return search.redact_pages(_docs(spark, folder), [1, 5, 7]).select("doc_id", "text")


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def c1_repair(spark: SparkSession, folder: str) -> DataFrame:
    """On these texts, which hold nothing to repair, the identity."""
    return _docs(spark, folder).select("doc_id", T.repair_text("text").alias("text"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\x{E000}-\\x{F8FF}\\x{FFFD}]')) AS DOUBLE) / length(regexp_replace(text, '\\s', '', 'g')) AS ratio FROM documents")
def f1_undecodable(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", T.undecodable_ratio("text").alias("ratio"))


@query(f"""
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_matches(text, '{_PAGE_NUMBER}') AS page_number,
       regexp_matches(text, '{T.LIST_ITEM}') AS list_item, regexp_matches(text, '{T.ENTRY}') AS contents_line FROM ({_LINES})
""")
def f12_line_classes(spark: SparkSession, folder: str) -> DataFrame:
    return search.lines(_docs(spark, folder)).select("doc_id", "line_no", T.is_page_number("text").alias("page_number"), T.is_list_item("text").alias("list_item"), T.is_contents_line("text").alias("contents_line"))


@query(f"""
WITH l AS (SELECT doc_id, line_no, text, lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS following FROM ({_LINES}))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no,
       CASE WHEN following IS NULL OR regexp_matches(right(text, 1), '\\s') OR regexp_matches(left(following, 1), '\\s') THEN '' ELSE ' ' END AS joint FROM l
""")
def p14_joints(spark: SparkSession, folder: str) -> DataFrame:
    following = F.lead("text").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return search.lines(_docs(spark, folder)).withColumn("following", following).select("doc_id", "line_no", T.joiner("text", "following").alias("joint"))


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\x{0E00}-\\x{0E7F}]+|[^\\x{0E00}-\\x{0E7F}]+')) AS piece FROM documents)
SELECT doc_id, piece, regexp_matches(piece, '^[\\x{0E00}-\\x{0E7F}]') AS thai FROM w
""")
def p28_script_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.explode(T.script_runs("text")).alias("r")).select("doc_id", "r.piece", "r.thai")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'stion')")
def f18_all_words(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).where(T.all_words_in(F.lit(" The  stion "), "text")).select("doc_id")


@query("SELECT doc_id, regexp_matches(text, '[^\\x{00}-\\x{FF}]') AS own_font FROM documents")
def f9_needs_own_font(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", T.needs_own_font("text").alias("own_font"))


@query("""
SELECT doc_id, replace(replace(replace(replace(CASE WHEN length(text) > 40 THEN left(text, 40) || '…' ELSE text END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM documents
""")
def c9_escape(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", T.escape_xml("text", 40).alias("escaped"))


@query("""
SELECT lang, source, weight FROM (SELECT lang, source, CAST(sum(length(trim(text, ' '))) AS BIGINT) AS weight, min(doc_id) AS f FROM documents GROUP BY 1, 2) ORDER BY weight DESC, f LIMIT 1
""")
def a3_commonest(spark: SparkSession, folder: str) -> DataFrame:
    return relate.commonest(_docs(spark, folder), ["lang", "source"], F.length(F.trim("text")), "doc_id")


@query("""
WITH b AS (SELECT doc_id, source, text FROM documents), a AS (SELECT text, lang FROM documents WHERE regexp_matches(coalesce(source, ''), '[02468]$')), c AS (SELECT text, lang FROM documents WHERE NOT regexp_matches(coalesce(source, ''), '[02468]$'))
SELECT text, lang, 'old' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM c) UNION ALL SELECT text, lang, 'new' AS side FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM a)
""")
def u2_bag_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of even numbers against the others."""
    docs, even = _docs(spark, folder), F.coalesce("source", F.lit("")).rlike("[02468]$")
    return relate.bag_difference(docs.where(even).select("text", "lang"), docs.where(~even).select("text", "lang"))


@query("""
SELECT source, CAST(n_chars AS BIGINT) AS upper_median FROM (
  SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars IS NOT NULL
) WHERE r = n // 2 + 1
""")
def a4_upper_median(spark: SparkSession, folder: str) -> DataFrame:
    return relate.upper_median_by(_docs(spark, folder), "source", "n_chars")


@query("SELECT source, CAST(count(*) AS BIGINT) AS files, CAST(sum(n_chars) AS BIGINT) AS before FROM documents GROUP BY source")
def s25_info(spark: SparkSession, folder: str) -> DataFrame:
    """What there is of each source."""
    return _docs(spark, folder).groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("before"))


@query("""
WITH f AS (SELECT n_chars AS before, CAST(n_chars * 2 // 3 AS BIGINT) AS after FROM documents WHERE lang <> 'es')
SELECT count(*) AS files, CAST(sum(before) AS BIGINT) AS before, CAST(sum(after) AS BIGINT) AS after, CAST(sum(before) - sum(after) AS BIGINT) AS saved, 100.0 * (sum(before) - sum(after)) / sum(before) AS percent FROM f
""")
def a9_batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    files = _docs(spark, folder).select(F.col("n_chars").alias("before"), F.expr("n_chars * 2 div 3").alias("after"), (F.col("lang") != "es").alias("ok"))
    return relate.batch_summary(files)

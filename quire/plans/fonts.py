"""Queries of font matching, character maps, styled runs and wrapping, over names, samples and texts that are made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import fonts, runs
from quire.plans.registry import query
from quire.sources.tables import table, turns

BASES = ("Sarabun", "Noto Sans", "Times", "Arial", "Sara", "Lato (Google)", "Noto", "TH Sarabun New")
STYLES = ("", "-Bold", "-Italic", "-BoldItalic", "-Light", "-Medium", "-SemiBold", "-ExtraLight", "-Regular", "-Black")


def _pick(names: tuple[str, ...], n) -> object:
    return F.array(*map(F.lit, names))[n]


def _sql_list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _font_names(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey").cast("int")
    return table(spark, folder, "part").select(F.concat(F.when(k % 2 == 0, "ABCDEF+").otherwise(""), _pick(BASES, k % 8), F.when(k % 5 == 0, (k % 3).cast("string")).otherwise(""), _pick(STYLES, F.floor(k / 8).cast("int") % 10)).alias("font"))


def _bundled(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey").cast("int")
    path = F.concat(F.lit("fonts/"), F.regexp_replace(_pick(BASES, k % 7), " ", ""), F.when(k % 4 == 0, (k % 3).cast("string")).otherwise(""), _pick(STYLES, F.floor(k / 7).cast("int") % 10), F.lit(".ttf"))
    return table(spark, folder, "supplier").select(path.alias("path"), F.col("s_suppkey").alias("ord"))


_NORM = "replace(regexp_replace(regexp_replace(lower({0}), '\\(.*?\\)', '', 'g'), '[^a-z0-9]', '', 'g'), 'regular', '')"
_FAMILY = "regexp_replace({0}, '" + "|".join(fonts.STYLE_WORDS) + "', '', 'g')"
_WEIGHT = "CASE " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{p}') THEN {w}" for p, w in fonts.WEIGHTS) + " ELSE 400 END"


@query(f"""
WITH n AS (
  SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'ABCDEF+' ELSE '' END || {_sql_list(BASES)}[1 + p_partkey % 8] || CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 3 AS VARCHAR) ELSE '' END || {_sql_list(STYLES)}[1 + (p_partkey // 8) % 10] AS font FROM part
), b AS (
  SELECT s_suppkey AS ord, replace({_sql_list(BASES)}[1 + s_suppkey % 7], ' ', '') || CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey % 3 AS VARCHAR) ELSE '' END || {_sql_list(STYLES)}[1 + (s_suppkey // 7) % 10] || '.ttf' AS file FROM supplier
), w AS (
  SELECT font, {_FAMILY.format(_NORM.format("regexp_extract(font, '[^+]*$')"))} AS fam, regexp_matches(lower(font), '{fonts.BOLD}') AS b, regexp_matches(lower(font), '{fonts.ITALIC}') AS i, {_WEIGHT.format("font")} AS wt FROM n
), o AS (
  SELECT ord, file, {_FAMILY.format(_NORM.format("file"))} AS fam, regexp_matches(lower(file), '{fonts.BOLD}') AS b, regexp_matches(lower(file), '{fonts.ITALIC}') AS i, {_WEIGHT.format("file")} AS wt FROM b
)
SELECT font, 'fonts/' || file AS path FROM (
  SELECT font, file, row_number() OVER (PARTITION BY font ORDER BY CAST(w.b <> o.b AS INT) + CAST(w.i <> o.i AS INT), abs(w.wt - o.wt), abs(len(w.fam) - len(o.fam)), ord) AS r
  FROM w JOIN o ON starts_with(w.fam, o.fam) OR starts_with(o.fam, w.fam)) WHERE r = 1""")
def j11_bundled_fonts(spark: SparkSession, folder: str) -> DataFrame:
    return fonts.matched(_font_names(spark, folder), _bundled(spark, folder))


FAMILIES = ("Alpha", "Beta", "Gamma", "Arial", "Delta")


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey").cast("int")
    width = F.length("p_name") * (F.lit(10.0) + k % 3) * 0.5 * (1 + (k % 25) * 0.01)
    return table(spark, folder, "part").select((k % 30).cast("long").alias("doc_id"), _pick(FAMILIES, k % 5).alias("family"), (k % 3 == 0).alias("bold"), (k % 4 == 0).alias("italic"), (F.lit(10.0) + k % 3).alias("size"), F.col("p_name").alias("text"), width.alias("width"))


def _files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Regular and bold files of families made of the nations, of which some are called as those of the samples are."""
    n = F.col("n_nationkey").cast("int")
    name = F.when(n < 3, _pick(FAMILIES, n % 5)).otherwise(F.col("n_name"))
    kinds = table(spark, folder, "nation").select(n.alias("n"), F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", "")).alias("key"), name.alias("name"), F.explode(F.when(n % 2 == 0, F.array(F.lit("Regular"), F.lit("Bold"))).otherwise(F.array(F.lit("Regular")))).alias("style"))
    files = kinds.withColumn("file", F.concat("key", F.lit("/"), "style"))
    advance = 400 + n * 9 + (F.col("cp") * 7 + n) % 40 + F.when(F.col("style") == "Bold", 30).otherwise(0)
    return files.select("key", "name", "style", "file"), files.withColumn("n_nationkey", F.col("n")).select("file", "style", "n_nationkey", F.explode(F.sequence(F.lit(32), F.lit(120))).alias("cp")).select("file", "cp", advance.cast("int").alias("advance"))


@query(f"""
WITH s AS (
  SELECT row_number() OVER () AS s, p_partkey % 30 AS doc_id, {_sql_list(FAMILIES)}[1 + p_partkey % 5] AS family, p_partkey % 3 = 0 AS bold, p_partkey % 4 = 0 AS italic, CAST(10 + p_partkey % 3 AS DOUBLE) AS size, p_name AS text,
    length(p_name) * CAST(10 + p_partkey % 3 AS DOUBLE) * CAST(0.5 AS DOUBLE) * (1 + (p_partkey % 25) * CAST(0.01 AS DOUBLE)) AS width FROM part WHERE p_partkey % 5 <> 3
), f AS (
  SELECT n_nationkey AS n, CASE WHEN n_nationkey < 3 THEN {_sql_list(FAMILIES)}[1 + n_nationkey % 5] ELSE n_name END AS name FROM nation
), k AS (SELECT *, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS key FROM f
), c AS (SELECT s, ascii(ch) AS cp, count(*) AS times FROM (SELECT s, unnest(string_split(text, '')) AS ch FROM s) GROUP BY ALL
), w AS (
  SELECT s, key, sum(times * CASE WHEN cp BETWEEN 32 AND 120 THEN 400 + n * 9 + (cp * 7 + n) % 40 + CASE WHEN bold AND n % 2 = 0 THEN 30 ELSE 0 END ELSE 0 END) AS units
  FROM s JOIN c USING (s), k GROUP BY s, key
), r AS (
  SELECT doc_id, family, key, width / (CAST(units AS DOUBLE) * size / 1000) AS ratio, row_number() OVER (PARTITION BY doc_id, family, key ORDER BY width / (CAST(units AS DOUBLE) * size / 1000)) AS i, count(*) OVER (PARTITION BY doc_id, family, key) AS n
  FROM w JOIN s USING (s)
), m AS (SELECT * FROM r WHERE i = n // 2 + 1
), b AS (SELECT doc_id, family, arg_min(name, (abs(ratio - 1), m.key)) AS best FROM m JOIN k USING (key) WHERE abs(ratio - 1) <= 0.06 GROUP BY doc_id, family
), d AS (
  SELECT x.doc_id, x.family, k.key IS NOT NULL AS bundled, m.ratio FROM (SELECT DISTINCT doc_id, family FROM s) x LEFT JOIN k ON k.key = lower(x.family) LEFT JOIN m ON m.doc_id = x.doc_id AND m.family = x.family AND m.key = lower(x.family)
)
SELECT * FROM (SELECT d.doc_id, d.family, CASE WHEN best <> d.family THEN best END AS rename, bundled AS reject FROM d LEFT JOIN b ON b.doc_id = d.doc_id AND b.family = d.family WHERE NOT (bundled AND (ratio IS NULL OR abs(ratio - 1) <= 0.06)))
WHERE rename IS NOT NULL OR reject""")
def j13_fitted_fonts(spark: SparkSession, folder: str) -> DataFrame:
    files, advances = _files(spark, folder)
    return fonts.fitted(_samples(spark, folder), files, advances)


@query("""
WITH m AS (
  SELECT p_partkey AS font, 'beginbfchar <0001> <0041> <' || printf('%x', p_partkey % 7) || '> <' || printf('%04x', 65 + p_partkey % 26) || '0301> <0001> <zz> endbfchar beginbfrange <0003> <0006> <0061> <0004> <0005> [<0E01> <0000> <0E03>] endbfrange beginbfrange <0002> <' || printf('%04x', 8 + 40 * (p_partkey % 500)) || '> <' || printf('%04x', 913 + p_partkey % 20) || '> <0003> <0003> [<0042>] endbfrange' AS t FROM part
), block AS (
  SELECT font, 'c' AS kind, unnest(regexp_extract_all(t, 'beginbfchar(.*?)endbfchar', 1)) AS body, generate_subscripts(regexp_extract_all(t, 'beginbfchar(.*?)endbfchar', 1), 1) AS n FROM m
  UNION ALL SELECT font, 'r', unnest(regexp_extract_all(t, 'beginbfrange(.*?)endbfrange', 1)), generate_subscripts(regexp_extract_all(t, 'beginbfrange(.*?)endbfrange', 1), 1) FROM m
), e AS (
  SELECT font, 1 AS kind, n, generate_subscripts(regexp_extract_all(body, '<([0-9A-Fa-f]+)>\\s*<([0-9A-Fa-f]+)>', 1), 1) AS i, 0 AS j,
    unnest(regexp_extract_all(body, '<([0-9A-Fa-f]+)>\\s*<([0-9A-Fa-f]+)>', 1)) AS a, NULL AS z, unnest(regexp_extract_all(body, '<([0-9A-Fa-f]+)>\\s*<([0-9A-Fa-f]+)>', 2)) AS d FROM block WHERE kind = 'c'
  UNION ALL SELECT font, 0, n, generate_subscripts(regexp_extract_all(body, '<([0-9A-Fa-f]+)>\\s*<([0-9A-Fa-f]+)>\\s*<([0-9A-Fa-f]+)>', 1), 1), 0,
    unnest(regexp_extract_all(body, '<([0-9A-Fa-f]+)>\\s*<([0-9A-Fa-f]+)>\\s*<([0-9A-Fa-f]+)>', 1)), unnest(regexp_extract_all(body, '<([0-9A-Fa-f]+)>\\s*<([0-9A-Fa-f]+)>\\s*<([0-9A-Fa-f]+)>', 2)), unnest(regexp_extract_all(body, '<([0-9A-Fa-f]+)>\\s*<([0-9A-Fa-f]+)>\\s*<([0-9A-Fa-f]+)>', 3)) FROM block WHERE kind = 'r'
  UNION ALL SELECT font, 2, n, i, unnest(range(len(l))), a, z, unnest(l) FROM (SELECT *, regexp_extract_all(x, '<([0-9A-Fa-f]+)>', 1) AS l FROM (
    SELECT font, n, generate_subscripts(regexp_extract_all(body, '<([0-9A-Fa-f]+)>\\s*<([0-9A-Fa-f]+)>\\s*\\[(.*?)\\]', 1), 1) AS i, unnest(regexp_extract_all(body, '<([0-9A-Fa-f]+)>\\s*<([0-9A-Fa-f]+)>\\s*\\[(.*?)\\]', 1)) AS a,
      unnest(regexp_extract_all(body, '<([0-9A-Fa-f]+)>\\s*<([0-9A-Fa-f]+)>\\s*\\[(.*?)\\]', 2)) AS z, unnest(regexp_extract_all(body, '<([0-9A-Fa-f]+)>\\s*<([0-9A-Fa-f]+)>\\s*\\[(.*?)\\]', 3)) AS x FROM block WHERE kind = 'r'))
), v AS (
  SELECT font, kind, n, i, j, CAST('0x' || a AS BIGINT) AS a, CAST('0x' || z AS BIGINT) AS z, CAST('0x' || d[1:4] AS BIGINT) AS d FROM e
), x AS (
  SELECT font, kind, n, i, j, a + j AS cid, d AS cp FROM v WHERE kind = 1 OR kind = 2 AND a + j <= z
  UNION ALL SELECT font, 0, n, i, 0, a + s, d + s FROM (SELECT *, unnest(range(z - a + 1)) AS s FROM v WHERE kind = 0)
), best AS (
  SELECT font, cid, cp, row_number() OVER (PARTITION BY font, cid ORDER BY kind = 0, CASE WHEN kind = 0 THEN 0 ELSE -kind END, CASE WHEN kind = 0 THEN n ELSE -n END, CASE WHEN kind = 0 THEN i ELSE -i END, -j) AS r FROM x WHERE cp BETWEEN 1 AND 1114111
), g AS (SELECT p_partkey AS font, unnest(range(0, 20000, 1 + p_partkey % 977)) AS cid FROM part WHERE p_partkey % 977 > 400 UNION SELECT p_partkey, unnest(range(12)) FROM part)
SELECT g.font, g.cid, cp FROM g LEFT JOIN best ON best.font = g.font AND best.cid = g.cid AND r = 1""")
def c17_character_maps(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    hexed = lambda n: F.format_string("%04x", n.cast("int"))
    text = F.concat(
        F.lit("beginbfchar <0001> <0041> <"), F.lower(F.hex(k % 7)), F.lit("> <"), hexed(65 + k % 26), F.lit("0301> <0001> <zz> endbfchar beginbfrange <0003> <0006> <0061> <0004> <0005> [<0E01> <0000> <0E03>] endbfrange beginbfrange <0002> <"),
        hexed(8 + 40 * (k % 500)), F.lit("> <"), hexed(913 + k % 20), F.lit("> <0003> <0003> [<0042>] endbfrange"),
    )
    part = table(spark, folder, "part")
    codes = part.where(k % 977 > 400).select(k.alias("font"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19999).cast("long"), 1 + k % 977)).alias("cid"))
    codes = codes.union(part.select(k, F.explode(F.sequence(F.lit(0), F.lit(11)).cast("array<long>")))).distinct()
    return fonts.decoded(codes, fonts.character_maps(part.select(k.alias("font"), text.alias("text")))).select("font", "cid", "cp")


@query("""
WITH p AS (SELECT p_partkey AS k, [p_name, ' ', p_type, '', ' tail '] AS r FROM part
), s AS (SELECT k, i, r[i] AS t, coalesce(list_sum(list_transform(r[1:i - 1], lambda x: len(x))), 0) AS a FROM (SELECT *, unnest(range(1, 6)) AS i FROM p)
), q AS (SELECT *, a + len(t) AS b, k % 10 AS st, k % 10 + k % 15 AS en FROM s
), f AS (SELECT k, min(i) AS first FROM q WHERE NOT (b <= st OR a >= en) GROUP BY k
), c AS (
  SELECT k, i, a + n AS pos, t[n + 1] AS ch FROM (SELECT *, unnest(range(len(t))) AS n FROM q) WHERE NOT (a + n >= st AND a + n < en)
  UNION ALL SELECT k, first, st - 0.5, 'NEW' FROM f JOIN (SELECT DISTINCT k, st FROM q) USING (k)
), o AS (
  SELECT k, i, coalesce(string_agg(ch, '' ORDER BY pos), '') AS t FROM c GROUP BY k, i UNION ALL SELECT k, i, '' FROM q WHERE t = '' AND (b <= st OR a >= en)
)
SELECT k AS ord, string_agg((i - 1) || '=' || t, '|' ORDER BY i) AS runs FROM o GROUP BY k""")
def p31_spliced_runs(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey").cast("int")
    made = F.array(*(F.struct(F.lit(i).alias("key"), t.alias("text")) for i, t in enumerate((F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(""), F.lit(" tail ")))))
    changed = runs.spliced(made, k % 10, k % 10 + k % 15, F.lit("NEW"))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("ord"), F.array_join(F.transform(changed, lambda r: F.concat(r["key"].cast("string"), F.lit("="), r["text"])), "|").alias("runs"))


@query("""
WITH p AS (SELECT p_partkey AS k, [(0, repeat(' ', p_partkey % 3)), (1, ' ' || p_name || ' '), (2, CASE WHEN p_partkey % 2 = 0 THEN '  ' ELSE p_type END), (3, ' ')] AS r FROM part
), c AS (SELECT k, i, n, r[i][2][n] AS ch, row_number() OVER (PARTITION BY k ORDER BY i, n) AS pos FROM (SELECT *, unnest(range(1, len(r[i][2]) + 1)) AS n FROM (SELECT *, unnest(range(1, 5)) AS i FROM p))
), e AS (SELECT k, min(pos) AS a, max(pos) AS b FROM c WHERE ch <> ' ' GROUP BY k
), o AS (SELECT k, i, string_agg(ch, '' ORDER BY pos) AS t FROM c JOIN e USING (k) WHERE pos BETWEEN a AND b GROUP BY k, i)
SELECT k AS ord, string_agg((i - 1) || '=' || t, '|' ORDER BY i) AS runs FROM o GROUP BY k""")
def p31_stripped_runs(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey").cast("int")
    texts = (F.repeat(F.lit(" "), k % 3), F.concat(F.lit(" "), "p_name", F.lit(" ")), F.when(k % 2 == 0, "  ").otherwise(F.col("p_type")), F.lit(" "))
    kept = runs.stripped(F.array(*(F.struct(F.lit(i).alias("key"), t.alias("text")) for i, t in enumerate(texts))))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("ord"), F.array_join(F.transform(kept, lambda r: F.concat(r["key"].cast("string"), F.lit("="), r["text"])), "|").alias("runs"))


UNITS = {chr(97 + i): 300 + 17 * i for i in range(26)} | {" ": 250}


@query("""
WITH RECURSIVE p AS (
  SELECT conv_id, turn, para, list_filter(string_split(body, ' '), lambda w: TRUE) AS words FROM (SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) AS para, unnest(string_split(text, chr(10))) AS body FROM conversations WHERE text IS NOT NULL)
), u AS MATERIALIZED (
  SELECT conv_id, turn, para, i, words[i] AS word, coalesce(list_sum(list_transform(string_split(words[i], ''), lambda c: CASE WHEN c = '' THEN 0 WHEN c = ' ' THEN 250 WHEN c BETWEEN 'a' AND 'z' AND ascii(c) BETWEEN 97 AND 122 THEN 300 + 17 * (ascii(c) - 97) ELSE 500 END)), 0) AS w
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM p)
), m AS (SELECT conv_id, turn, greatest(40000, max(w)) AS most FROM u GROUP BY conv_id, turn
), l AS (
  SELECT conv_id, turn, para, i, word AS line, w AS held, 1 AS n FROM u WHERE i = 1
  UNION ALL
  SELECT l.conv_id, l.turn, l.para, u.i,
    CASE WHEN l.line = '' THEN u.word WHEN l.held + 250 + u.w <= most THEN l.line || ' ' || u.word ELSE u.word END,
    CASE WHEN l.line = '' THEN u.w WHEN l.held + 250 + u.w <= most THEN l.held + 250 + u.w ELSE u.w END,
    CASE WHEN l.line = '' OR l.held + 250 + u.w <= most THEN n ELSE n + 1 END
  FROM l JOIN u ON u.conv_id = l.conv_id AND u.turn = l.turn AND u.para = l.para AND u.i = l.i + 1 JOIN m ON m.conv_id = l.conv_id AND m.turn = l.turn
), o AS (
  SELECT conv_id, turn, para, n, arg_max(line, i) AS line, max(i) AS i FROM l GROUP BY ALL
)
SELECT conv_id, CAST(turn AS INTEGER) AS turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY para, n) - 1 AS INTEGER) AS ord, line
FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, turn, para) AS many, (SELECT len(words) FROM p WHERE p.conv_id = o.conv_id AND p.turn = o.turn AND p.para = o.para) AS nw FROM o) WHERE line <> '' OR nw = 1""")
def p32_wrapped_text(spark: SparkSession, folder: str) -> DataFrame:
    said = turns(spark, folder).where("text IS NOT NULL")
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    width_of = lambda w: F.aggregate(F.filter(F.split(w, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + F.coalesce(units[c], F.lit(500)))
    longest = F.array_max(F.transform(F.split("text", "[ \n]"), width_of))
    made = runs.wrapped(said.withColumn("size", F.lit(1000.0)).withColumn("width", F.greatest(F.lit(40000), longest)), UNITS)
    return made.select(F.col("doc_id").alias("conv_id"), F.col("page_no").alias("turn"), F.posexplode("lines").alias("ord", "line"))

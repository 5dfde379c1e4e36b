"""Fonts by name, by width and by their character maps: which bundled font stands in for one that a document names.

A family lines up with another if either begins with the other. The families of one side are listed under all their
beginnings, so that both directions are joins on equal keys, and nobody is compared with all fonts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import font_key
from quire.operators.grid import shuffled
from quire.operators.iterate import cut

#: Words of styles, which no family holds, and the weights they stand for; the first that occurs counts.
STYLE_WORDS = ("extralight", "ultralight", "bold", "italic", "oblique", "black", "heavy", "medium", "light", "thin", "hairline")
WEIGHTS = (("thin|hairline", 100), ("extralight|ultralight", 200), ("light", 300), ("medium", 500), ("semibold|demibold", 600), ("bold|heavy|black", 700))
REGULAR = 400
BOLD, ITALIC = "bold|black|heavy", "italic|oblique"
#: How far widths may differ, and the families that every reader has.
CLOSE = 0.06
SYSTEM_FAMILIES = ("tahoma", "arial", "timesnewroman", "couriernew", "calibri", "cambria", "segoeui", "verdana", "symbol", "wingdings", "leelawadee", "leelawadeeui", "angsananew", "cordianew", "browallianew", "angsanaupc", "cordiaupc", "browalliaupc")


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def family(name: Column) -> Column:
    """The letters and digits of a font's name without its subset tag, what is in brackets, and words of style."""
    plain = F.regexp_replace(F.lower(F.substring_index(name, "+", -1)), r"\(.*?\)|[^a-z0-9]", "")
    return F.regexp_replace(F.regexp_replace(plain, "regular", ""), "|".join(STYLE_WORDS), "")


def weight(name: Column) -> Column:
    low, out = F.lower(name), F.lit(REGULAR)
    for pattern, value in reversed(WEIGHTS):
        out = F.when(low.rlike(pattern), value).otherwise(out)
    return out


def _described(df: DataFrame, name: Column, full: Column) -> DataFrame:
    low = F.lower(name)
    return df.select("*", family(full).alias("_family"), low.rlike(BOLD).alias("_bold"), low.rlike(ITALIC).alias("_italic"), weight(name).alias("_weight"))


def _beginnings(df: DataFrame) -> DataFrame:
    return df.withColumn("_key", F.explode(F.transform(F.sequence(F.lit(0), F.length("_family")), lambda n: F.substring(F.col("_family"), F.lit(1), n))))


def matched(names: DataFrame, bundled: DataFrame) -> DataFrame:
    """font, path: for each distinct font of names, the bundled font (path, ord) of its family that is nearest.

    Nearest: fewest differences in bold and italic, then in weight, then in the length of the family's name, then the first
    by ord. A file without a name of its own, and an empty or null font, match nothing.
    """
    wanted = _described(names.select("font").where(F.col("font") != "").distinct(), F.col("font"), F.col("font"))
    file = _file_name(F.col("path"))
    named = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(file, "+", -1)), r"\(.*?\)|[^a-z0-9]", ""), "regular", "") != ""
    offered = _described(bundled.where(F.col("path").isNotNull()).select("path", "ord").where(named), file, file)
    key = [F.col(f"_{c}").alias(f"_o{c}") for c in ("family", "bold", "italic", "weight")]
    right = offered.select("path", "ord", *key)
    longer = _beginnings(wanted).join(right.withColumn("_key", F.col("_ofamily")), "_key")  # the bundled family begins the wanted one
    shorter = wanted.withColumn("_key", F.col("_family")).join(_beginnings(offered).where("_key <> _family").select("path", "ord", "_key", *key), "_key")
    both = longer.unionByName(shorter)
    differ = (F.col("_bold") != F.col("_obold")).cast("int") + (F.col("_italic") != F.col("_oitalic")).cast("int")
    order = F.struct(differ.alias("a"), F.abs(F.col("_weight") - F.col("_oweight")).alias("b"), F.abs(F.length("_family") - F.length("_ofamily")).alias("c"), F.col("ord").alias("d"), F.col("path").alias("e"))
    return both.groupBy("font").agg(F.min_by("path", order).alias("path"))


def fitted(samples: DataFrame, fonts: DataFrame, advances: DataFrame, skip: tuple[str, ...] = SYSTEM_FAMILIES) -> DataFrame:
    """doc_id, family, rename, reject: what to write in place of a document's families, by the widths that were measured.

    samples: as model.width_samples gives them; fonts: key (of the family), name, style, file; advances: file, cp, advance, in
    thousandths of the size, with cp 0 for a sign that a file lacks. A family's ratio in a font is the upper median of the
    measured width over the width set in the file of the sample's style, or of bold, or of regular. A family whose key is a
    font's own is left alone if that font can't be measured or is within CLOSE of one, and is rejected else; the others and
    the rejected are renamed to the font nearest to one within CLOSE, the first by key, unless that is its own name.
    """
    able = samples.where((F.col("width") > 0) & (F.col("size") > 0)).withColumn("_s", F.monotonically_increasing_id()).withColumn("_own", font_key("family"))
    able = able.where(~F.col("_own").isin(*skip)) if skip else able
    able = cut(able)
    letters = able.select("_s", F.explode(F.filter(F.split("text", ""), lambda c: c != "")).alias("_c")).groupBy("_s", F.ascii("_c").alias("cp")).agg(F.count("*").alias("_times"))
    exact = F.concat(F.when(F.col("bold"), "Bold").otherwise(""), F.when(F.col("italic"), "Italic").otherwise(""))
    tries = F.array(F.when(exact == "", "Regular").otherwise(exact), F.when(F.col("bold"), "Bold").otherwise("Regular"), F.lit("Regular"))
    styles = fonts.groupBy("key").agg(F.min("name").alias("name"), F.map_from_entries(F.collect_list(F.struct("style", "file"))).alias("files"))
    # a sample is set in every family once: fonts are few, and what is joined next is their letters, by equal keys
    kinds = able.select("bold", "italic", tries.alias("_tries")).distinct()
    picked = kinds.join(F.broadcast(styles.select("key", "files")), F.lit(True)).select("bold", "italic", "key", F.filter(F.transform("_tries", lambda t: F.col("files")[t]), lambda f: f.isNotNull())[0].alias("file"))
    picked = picked.where("file IS NOT NULL")
    own = letters.join(shuffled(able.select("_s", "bold", "italic")), "_s").join(F.broadcast(picked), ["bold", "italic"])
    known = advances.dropDuplicates(["file", "cp"])
    lacking = known.where("cp = 0").select("file", F.col("advance").alias("_none"))
    set_ = own.join(known.where("cp <> 0"), ["file", "cp"], "left").join(F.broadcast(lacking), "file", "left")
    wide = set_.groupBy("_s", "key").agg(F.sum(F.coalesce("advance", "_none", F.lit(0)) * F.col("_times")).alias("_units")).where("_units > 0")
    of = Window.partitionBy("doc_id", "family", "key")
    ratio = F.col("width") / (F.col("_units") * F.col("size") / 1000)
    ranked = wide.join(shuffled(able.select("_s", "doc_id", "family", "_own", "size", "width")), "_s").withColumn("ratio", ratio)
    ranked = ranked.withColumn("_r", F.row_number().over(of.orderBy("ratio"))).withColumn("_n", F.count("*").over(of))
    ratios = ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select("doc_id", "family", "key", "ratio")
    best = ratios.where(F.abs(F.col("ratio") - 1) <= CLOSE).join(F.broadcast(styles.select("key", "name")), "key")
    best = best.groupBy("doc_id", "family").agg(F.min_by("name", F.struct(F.abs(F.col("ratio") - 1), F.col("key"))).alias("_best"))
    families = able.select("doc_id", "family", "_own").distinct().join(F.broadcast(styles.select(F.col("key").alias("_own"), F.lit(True).alias("_bundled"))), "_own", "left")
    families = families.join(ratios.select("doc_id", "family", F.col("key").alias("_own"), "ratio"), ["doc_id", "family", "_own"], "left")
    fine = F.col("_bundled") & (F.col("ratio").isNull() | (F.abs(F.col("ratio") - 1) <= CLOSE))
    judged = families.where(~F.coalesce(fine, F.lit(False))).withColumn("reject", F.coalesce("_bundled", F.lit(False))).join(best, ["doc_id", "family"], "left")
    rename = F.when(F.col("_best") != F.col("family"), F.col("_best"))
    return judged.select("doc_id", "family", rename.alias("rename"), "reject").where(F.col("rename").isNotNull() | F.col("reject"))


# --- character maps

_HEX = "<([0-9A-Fa-f]+)>"
MOST = 0x10FFFF
#: Bits of an interval's buckets: an interval is listed under the finest of which it meets 257 at most.
LEVELS = (8, 16, 24)


def _number(hexadecimal: Column) -> Column:
    """Of up to eight digits; null of longer ones, which no font has."""
    return F.when(F.length(F.ltrim(hexadecimal, F.lit("0"))) <= 8, F.conv(hexadecimal, 16, 10).cast("long"))


def _first(target: Column) -> Column:
    """The first code unit of a target, which may be several."""
    return _number(F.when(F.length(target) >= 4, F.substring(target, 1, 4)).otherwise(target))


def _sections(maps: DataFrame, kind: str) -> DataFrame:
    return maps.select("font", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s)begin{kind}(.*?)end{kind}"), 1)).alias("_block", "_body"))


def _entries(sections: DataFrame, pattern: str) -> DataFrame:
    return sections.select("font", "_block", F.posexplode(F.regexp_extract_all("_body", F.lit(pattern), 0)).alias("_line", "_entry"))


def character_maps(maps: DataFrame) -> DataFrame:
    """font, low, high, cp, rank of maps (font, text): the codes from low to high stand for cp and those after it.

    Text is what a font says of its codes: single ones (bfchar), ranges with a list of targets, and ranges of targets in a
    row (bfrange). Of what says the same code the highest rank counts: the last single code or list, and only without
    one the first range in a row. Targets outside of 1 to 10FFFF, and what isn't hexadecimal, are skipped.
    """
    part = lambda pattern, n: F.regexp_extract("_entry", pattern, n)
    pair, triple, listed = rf"{_HEX}\s*{_HEX}", rf"{_HEX}\s*{_HEX}\s*{_HEX}", rf"(?s){_HEX}\s*{_HEX}\s*\[(.*?)\]"
    order = F.struct(F.col("_block"), F.col("_line"))
    single = _entries(_sections(maps, "bfchar"), pair).select("font", _number(part(pair, 1)).alias("low"), _number(part(pair, 1)).alias("high"), _first(part(pair, 2)).alias("cp"), F.lit(1).alias("_kind"), order.alias("_at"), F.lit(0).alias("_i"))
    lists = _entries(_sections(maps, "bfrange"), listed).select("font", _number(part(listed, 1)).alias("_low"), _number(part(listed, 2)).alias("_end"), order.alias("_at"), F.posexplode(F.regexp_extract_all(part(listed, 3), F.lit(_HEX), 1)).alias("_i", "_to"))
    lists = lists.where(F.col("_low") + F.col("_i") <= F.col("_end")).select("font", (F.col("_low") + F.col("_i")).alias("low"), (F.col("_low") + F.col("_i")).alias("high"), _first(F.col("_to")).alias("cp"), F.lit(2).alias("_kind"), "_at", "_i")
    runs = _entries(_sections(maps, "bfrange"), triple).select("font", _number(part(triple, 1)).alias("low"), _number(part(triple, 2)).alias("high"), _first(part(triple, 3)).alias("cp"), F.lit(0).alias("_kind"), order.alias("_at"), F.lit(0).alias("_i"))
    # a row that begins at 0 has its first target outside; one that ends beyond the last code point is cut
    skip = F.when(F.col("cp") == 0, 1).otherwise(0)
    runs = runs.withColumns({"low": F.col("low") + skip, "cp": F.col("cp") + skip}).withColumn("high", F.least("high", F.col("low") + MOST - F.col("cp")))
    all_ = single.unionByName(lists).unionByName(runs).where(F.col("low").isNotNull() & (F.col("high") >= F.col("low")) & F.col("cp").between(1, MOST))
    sign = F.when(F.col("_kind") == 0, -1).otherwise(1)  # of ranges in a row the first counts
    rank = F.row_number().over(Window.partitionBy("font").orderBy(F.col("_kind") > 0, F.when(F.col("_kind") > 0, F.col("_kind")), F.col("_at._block") * sign, F.col("_at._line") * sign, "_i"))
    return all_.select("font", "low", "high", "cp", rank.alias("rank"))


def _level(low: Column, high: Column) -> Column:
    out = F.lit(LEVELS[-1])
    for bits in reversed(LEVELS[:-1]):
        out = F.when(F.shiftright(high, bits) - F.shiftright(low, bits) <= 256, bits).otherwise(out)
    return out


def decoded(codes: DataFrame, maps: DataFrame) -> DataFrame:
    """codes (font, cid and others) with cp, what character_maps() says of them, or null.

    Intervals aren't written out: each lies under the buckets of one level, and a code asks for its bucket of every level.
    """
    level = _level(F.col("low"), F.col("high"))
    listed = maps.withColumn("_level", level).withColumn("_bucket", F.explode(F.expr("sequence(shiftright(low, _level), shiftright(high, _level))")))
    asked = codes.select("font", "cid").distinct().withColumn("_level", F.explode(F.array(*map(F.lit, LEVELS)))).withColumn("_bucket", F.expr("shiftright(cid, _level)"))
    met = asked.join(shuffled(listed), ["font", "_level", "_bucket"]).where(F.col("cid").between(F.col("low"), F.col("high")))
    said = met.groupBy("font", "cid").agg(F.max_by(F.col("cp") + F.col("cid") - F.col("low"), "rank").alias("cp"))
    return codes.join(shuffled(said), ["font", "cid"], "left")


def glyph_characters(characters: DataFrame) -> DataFrame:
    """font, gid, cps (in ascending order) of characters (font, cp, gid): what a font's own table says each glyph draws."""
    return characters.where(F.col("gid").isNotNull()).groupBy("font", "gid").agg(F.sort_array(F.collect_set("cp")).alias("cps"))


def font_resources(fonts: DataFrame) -> DataFrame:
    """doc_id, page_no, resource, font of page fonts (doc_id, page_no, ord, font, resource): of a name given twice the last one."""
    return fonts.where(F.col("resource") != "").groupBy("doc_id", "page_no", "resource").agg(F.max_by("font", "ord").alias("font"))

"""Page algebra, numbering and versions: tables with an ordinal, from which rows are chosen, added, moved and renumbered.

A table of pages has doc_id, page_no (from 0) and any other columns. What changes the order gives rows a new key and
renumbers within each document, so one window by document is all that is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by_doc(*order: str | Column) -> Window:
    return Window.partitionBy("doc_id").orderBy(*order)


def renumbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """page_no from 0 in the given order, within each document."""
    return df.withColumn("_n", F.row_number().over(_by_doc(*order)) - 1).drop("page_no").withColumnRenamed("_n", "page_no")


def extract_pages(df: DataFrame, first: int, last: int) -> DataFrame:
    """Pages first to last, from 1 and with the last."""
    return df.where(F.col("page_no").between(first - 1, last - 1))


def choose_pages(df: DataFrame, pages: list[int]) -> DataFrame:
    """The pages (from 0) that are listed, in the order of the list, renumbered. An empty list is an error."""
    if not pages:
        raise ValueError("no pages are given")
    wanted = df.sparkSession.createDataFrame(list(enumerate(pages)), "_at int, page_no int")  # as long as what the caller wrote
    return renumbered(df.join(F.broadcast(wanted), "page_no"), "_at").drop("_at")


def merge_pages(df: DataFrame, other: DataFrame, pages: list[int] | None = None, at: int | None = None) -> DataFrame:
    """df with the pages of other's document of the same id (all, or those listed; out-of-range ones are ignored) from position `at` on, or at the end."""
    count = F.max("page_no").over(Window.partitionBy("doc_id")) + 1
    rank = lambda c: F.lit(c).alias("_from")
    if pages:
        wanted = df.sparkSession.createDataFrame(list(enumerate(pages)), "_at int, page_no int")
        other = other.join(F.broadcast(wanted), "page_no")
    else:
        other = other.withColumn("_at", F.col("page_no"))
    mine = df.withColumn("_at", F.col("page_no")).withColumn("_n", count)
    before = F.lit(True) if at is None else (F.col("page_no") < at) | (F.col("_n") <= at)
    mine = mine.select("*", F.when(before, 0).otherwise(2).alias("_from")).drop("_n")
    both = mine.unionByName(other.select("*", rank(1)))
    return renumbered(both, "_from", "_at").drop("_at", "_from")


def duplicate_page(df: DataFrame, page: int) -> DataFrame:
    copies = df.withColumn("_copy", F.explode(F.when(F.col("page_no") == page, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return renumbered(copies, "page_no", "_copy").drop("_copy")


def delete_page(df: DataFrame, page: int) -> DataFrame:
    return renumbered(df.where(F.col("page_no") != page), "page_no")


def insert_blank(df: DataFrame, at: int) -> DataFrame:
    """A row of nulls before page `at` of each document."""
    blank = df.select("doc_id").distinct().select("doc_id", F.lit(at).alias("page_no"), F.lit(0).alias("_copy"))
    return renumbered(df.withColumn("_copy", F.lit(1)).unionByName(blank, allowMissingColumns=True), "page_no", "_copy").drop("_copy")


def reorder_page(df: DataFrame, source: int, target: int) -> DataFrame:
    """Page `source` at place `target`; nothing changes where either is out of range."""
    count = F.max("page_no").over(Window.partitionBy("doc_id")) + 1
    moved = df.withColumn("_n", count)
    valid = (F.lit(source) < F.col("_n")) & (F.lit(target) < F.col("_n")) & F.lit(source >= 0 and target >= 0 and source != target)
    # between its new neighbours
    place = F.lit(float(target)) + (0.5 if target > source else -0.5)
    key = F.when(valid & (F.col("page_no") == source), place).otherwise(F.col("page_no").cast("double"))
    return renumbered(moved.withColumn("_key", key).drop("_n"), "_key").drop("_key")


def move_page(df: DataFrame, page: int, by: int) -> DataFrame:
    return reorder_page(df, page, page + by)


def replace_pages(df: DataFrame, other: DataFrame, pages: list[int], column: str, from_pages: list[int] | None = None) -> DataFrame:
    """df with `column` of the listed pages taken from other's pages of the same, or the given, numbers; other columns stay."""
    pairs = df.sparkSession.createDataFrame(list(zip(pages, from_pages or pages, strict=True)), "page_no int, _other int")
    new = other.select("doc_id", F.col("page_no").alias("_other"), F.col(column).alias("_new"))
    return df.join(F.broadcast(pairs), "page_no", "left").join(new, ["doc_id", "_other"], "left").withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def combine(tables: list[DataFrame], names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pages of several files one after the other, and an outline with an entry for each file."""
    parts = [t.withColumn("_file", F.lit(i)) for i, t in enumerate(tables)]
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("doc_id", F.lit(0).cast("long"))
    pages = renumbered(all_, "_file", "page_no")
    outline = pages.groupBy("_file").agg((F.min("page_no") + 1).alias("page_no"))
    stem = F.regexp_replace(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_file") + 1), r"^.*/|\.[^.]*$", "")
    return pages.drop("_file"), outline.select(F.lit(1).alias("level"), stem.alias("title"), "page_no")


def split_every(df: DataFrame, n: int) -> DataFrame:
    """df with part, from 0: every n pages."""
    return df.withColumn("part", F.floor(F.col("page_no") / n).cast("int"))


def split_before(df: DataFrame, starts: DataFrame) -> DataFrame:
    """df with part: a new one begins at each page of `starts` (doc_id, page_no)."""
    marks = starts.select("doc_id", "page_no", F.lit(1).alias("_mark")).distinct()
    begins = F.when((F.col("_mark") == 1) & (F.col("page_no") > 0), 1).otherwise(0)
    return df.join(marks, ["doc_id", "page_no"], "left").withColumn("part", F.sum(begins).over(_by_doc("page_no")).cast("int")).drop("_mark")


def split_by_size(df: DataFrame, size: str, limit: int) -> DataFrame:
    """df with part: pages in order, a new part where the next page would make the last one larger than the limit; a larger page stands alone."""
    ordered = F.sort_array(F.collect_list(F.struct("page_no", F.col(size).cast("long").alias("size"))))
    state = "struct<part:int,size:bigint,out:array<struct<page_no:int,part:int>>>"

    def step(acc: Column, page: Column) -> Column:
        new = (acc["size"] > 0) & (acc["size"] + page["size"] > limit)
        part = acc["part"] + F.when(new, 1).otherwise(0)
        held = F.when(new, page["size"]).otherwise(acc["size"] + page["size"])
        return F.struct(part.alias("part"), held.alias("size"), F.array_append(acc["out"], F.struct(page["page_no"].cast("int").alias("page_no"), part.alias("part"))).alias("out")).cast(state)

    start = F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("size"), F.array().cast("array<struct<page_no:int,part:int>>").alias("out")).cast(state)
    parts = df.groupBy("doc_id").agg(ordered.alias("pages")).select("doc_id", F.explode(F.aggregate("pages", start, step, lambda acc: acc["out"])).alias("p"))
    return df.join(parts.select("doc_id", F.col("p.page_no").alias("page_no"), F.col("p.part").alias("part")), ["doc_id", "page_no"])


def first_pages(df: DataFrame) -> DataFrame:
    """The parts of a split, and the first page of each, from 1."""
    return df.groupBy("doc_id", "part").agg((F.min("page_no") + 1).alias("first_page"), F.count("*").alias("pages"))


def page_ranges(df: DataFrame) -> DataFrame:
    """Runs of consecutive page numbers of each document."""
    island = F.col("page_no") - F.row_number().over(_by_doc("page_no"))
    return df.select("doc_id", "page_no").distinct().withColumn("_i", island).groupBy("doc_id", "_i").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page")).drop("_i")


# --- numbering


def number_text(df: DataFrame, template: str = "{n}", start: int = 1) -> DataFrame:
    """df with label: {n} the page's number, {total} the pages of its document."""
    total = F.count("*").over(Window.partitionBy("doc_id"))
    label = F.replace(F.replace(F.lit(template), F.lit("{n}"), (F.col("page_no") + start).cast("string")), F.lit("{total}"), total.cast("string"))
    return df.withColumn("label", label)


def header_footer(df: DataFrame, texts: dict[str, str], pages: list[int] | None = None, bates: tuple[str, int, int] | None = None, date: str = "") -> DataFrame:
    """A row for each slot (tl, tc, tr, bl, bc, br) of the chosen pages (all, if none are listed).

    Templates hold {n}, {total}, {date} and {bates}; Bates numbers are (prefix, first number, digits) and run over the
    chosen pages in their order.
    """
    slots = {k: v for k, v in texts.items() if v and k in ("tl", "tc", "tr", "bl", "bc", "br")}
    df = df.withColumn("_total", F.count("*").over(Window.partitionBy("doc_id")))
    if pages:
        df = df.join(F.broadcast(df.sparkSession.createDataFrame(list(enumerate(pages)), "_k int, page_no int")), "page_no")
    else:
        df = df.withColumn("_k", F.row_number().over(_by_doc("page_no")) - 1)
    number = F.lit("")
    if bates:
        prefix, first, digits = bates
        number = F.format_string(f"%s%0{max(1, int(digits))}d", F.lit(prefix), F.lit(int(first)) + F.col("_k"))
    rows = df.withColumn("_slot", F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), F.lit(v).alias("text")) for k, v in slots.items()])))
    text = F.col("_slot.text")
    for sign, value in (("{n}", (F.col("page_no") + 1).cast("string")), ("{total}", F.col("_total").cast("string")), ("{date}", F.lit(date)), ("{bates}", number)):
        text = F.replace(text, F.lit(sign), value)
    return rows.select("doc_id", "page_no", F.col("_slot.slot").alias("slot"), text.alias("text"))


def set_label_rule(rules: DataFrame, start: int, style: str, prefix: str = "", first: int = 1) -> DataFrame:
    """Page-label rules (doc_id, startpage, prefix, style, firstpagenum) with one set for each document; one for page 0 is always there."""
    docs = rules.select("doc_id").distinct()
    new = docs.select("doc_id", F.lit(start).alias("startpage"), F.lit(prefix).alias("prefix"), F.lit(style).alias("style"), F.lit(max(1, first)).alias("firstpagenum"))
    kept = rules.where(F.col("startpage") != start).unionByName(new)
    zero = docs.join(kept.where("startpage = 0"), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("startpage"), F.lit("").alias("prefix"), F.lit("D").alias("style"), F.lit(1).alias("firstpagenum"))
    return kept.unionByName(zero)


def to_roman(n: Column) -> Column:
    """Lower-case Roman numeral of a positive number, digit by digit."""
    digit = lambda unit, one, five, ten: F.element_at(
        F.array(*[F.lit(d) for d in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), (F.floor(n / unit) % 10 + 1).cast("int")
    )
    return F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), digit(100, "c", "d", "m"), digit(10, "x", "l", "c"), digit(1, "i", "v", "x"))


def page_labels(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages with label, by the last rule at or before each page: D 1, r i, R I, a a, A A, and without a style the prefix alone."""
    of = rules.select("doc_id", F.col("startpage").alias("page_no"), F.struct("startpage", "prefix", "style", "firstpagenum").alias("_rule"), F.lit(0).alias("_page"))
    rows = pages.withColumn("_page", F.lit(1)).unionByName(of, allowMissingColumns=True)
    rule = F.last("_rule", ignorenulls=True).over(_by_doc("page_no", "_page").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_r", rule).where("_page = 1")
    n = (F.col("page_no") - F.col("_r.startpage") + F.col("_r.firstpagenum")).cast("int")
    letter = F.repeat(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), ((n - 1) % 26 + 1), F.lit(1)), F.floor((n - 1) / 26).cast("int") + 1)
    style = F.col("_r.style")
    shown = F.when(style == "D", n.cast("string")).when(style == "r", to_roman(n)).when(style == "R", F.upper(to_roman(n))).when(style == "a", letter).when(style == "A", F.upper(letter)).otherwise("")
    return rows.withColumn("label", F.when(F.col("_r").isNull(), (F.col("page_no") + 1).cast("string")).otherwise(F.concat(F.col("_r.prefix"), shown))).drop("_r", "_rule", "_page")


# --- versions


def newest(df: DataFrame, key: str | list[str], order: str, keep: int) -> DataFrame:
    """The newest `keep` rows of each key."""
    window = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= keep).drop("_n")


def recent(df: DataFrame, key: str, order: str, keep: int = 6) -> DataFrame:
    """The newest row of each key, the newest `keep` of these."""
    return newest(df, key, order, 1).orderBy(F.desc(order), key).limit(keep)


def version_key(path: Column | str) -> Column:
    """The name under which versions of a path are kept: its stem and eight digits of the path's MD5."""
    path = F.col(path) if isinstance(path, str) else path
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    return F.concat(stem, F.lit("__"), F.substring(F.md5(path), 1, 8))


def list_versions(files: DataFrame, path: str) -> DataFrame:
    """The kept versions (column name: key__yyyyMMdd_HHmmss.pdf) of a path, newest first; names with a bad time are left out."""
    key = version_key(F.lit(path))
    stamp = F.try_to_timestamp(F.regexp_extract("name", r"__(\d{8}_\d{6})\.[^.]*$", 1), F.lit("yyyyMMdd_HHmmss"))
    return files.where(F.startswith(F.col("name"), F.concat(key, F.lit("__")))).withColumn("stamp", stamp).where("stamp IS NOT NULL").orderBy(F.desc("stamp"))


def state_at(versions: DataFrame, cursor: int) -> DataFrame:
    """Of a log of versions (doc_id, version, …) the state of each document after undoing back to `cursor`."""
    return newest(versions.where(F.col("version") <= cursor), "doc_id", "version", 1)


def free_names(df: DataFrame, name: str, extension: str) -> DataFrame:
    """df with output: the name, and for the second and later rows of a name " (2)", " (3)"… before the extension."""
    n = F.row_number().over(Window.partitionBy(name, extension).orderBy("ord"))
    return df.withColumn("output", F.concat(F.col(name), F.when(n > 1, F.concat(F.lit(" ("), n, F.lit(")"))).otherwise(""), F.col(extension)))

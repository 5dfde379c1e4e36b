"""Lines, search, replacement, redaction and repeated lines over tables of documents.

Text is cut into lines with explicit ordinals once; everything after is expressions, one aggregation or one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import furniture_key, is_page_number

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: The same matches without trying again at each character of a long word, for engines with look-behind.
EMAIL_ONCE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"(?:https?://|www\.)[^\s<>\"']*[^\s<>\"'.,;:!?)\]]"


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each line that isn't blank: doc_id, line_no (from 0), text, and the columns to keep."""
    cut = docs.select("doc_id", *keep, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))
    return cut.where(F.trim("text") != "")


def pattern(term: str, match_case: bool = True) -> str:
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return quoted if match_case else "(?iu)" + quoted


def hits(text: Column | str, term: str, match_case: bool = True) -> Column:
    """How often a term occurs, without overlaps; 0 for the empty term."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_count(text, F.lit(pattern(term, match_case))) if term else F.lit(0)


def find(docs: DataFrame, term: str, match_case: bool = True) -> DataFrame:
    """doc_id, hit (from 0), position (from 0) of each occurrence."""
    if not term:
        return docs.select("doc_id", F.lit(0).alias("hit"), F.lit(0).alias("position")).where(F.lit(False))
    parts = F.split("text", pattern(term, match_case))
    has = docs.where(F.col("text").isNotNull() & F.regexp_like("text", F.lit(pattern(term, match_case))))
    numbered = has.select(F.monotonically_increasing_id().alias("_row"), "doc_id", parts.alias("_parts"))
    pieces = numbered.select("_row", "doc_id", F.posexplode("_parts").alias("hit", "_part"), F.size("_parts").alias("_n"))
    # where a part ends, a hit begins: a running sum over the parts of a text
    window = Window.partitionBy("_row").orderBy("hit")
    length = F.sum(F.length("_part")).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return pieces.withColumn("position", (length + F.col("hit") * len(term)).cast("int")).where(F.col("hit") < F.col("_n") - 1).select("doc_id", "hit", "position")


def count_matches(docs: DataFrame, term: str, match_case: bool = True) -> DataFrame:
    """One row: the occurrences in all documents."""
    return docs.agg(F.coalesce(F.sum(hits("text", term, match_case)), F.lit(0)).cast("long").alias("n_hits"))


def replace_text(docs: DataFrame, term: str, by: str, match_case: bool = True) -> DataFrame:
    """docs with each occurrence replaced, in one pass: what replacement brings in isn't searched again."""
    if not term:
        return docs.withColumn("n_replaced", F.lit(0))
    escaped = by.replace("\\", "\\\\").replace("$", "\\$")
    return docs.withColumn("n_replaced", hits("text", term, match_case)).withColumn("text", F.regexp_replace("text", pattern(term, match_case), escaped))


def redact(docs: DataFrame, regex: str, sign: str = "█") -> DataFrame:
    """docs with every match covered by as many signs as it has characters, and their number; texts without a match stay as they are."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({regex})"), 1)
    between = F.split(F.coalesce("text", F.lit("")), regex)
    covered = F.transform(found, lambda m: F.repeat(F.lit(sign), F.length(m)))
    text = F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.try_element_at(covered, i + 1), F.lit("")))), "")
    return docs.withColumn("n_redacted", F.size(found)).withColumn("text", F.when(F.col("n_redacted") > 0, text).otherwise(F.col("text")))


def redact_term(docs: DataFrame, term: str, match_case: bool = True, pages: list[int] | None = None) -> DataFrame:
    """As redact(), of a term; only on the listed doc_ids, where any are listed."""
    if not term:
        return docs.withColumn("n_redacted", F.lit(0))
    chosen = F.coalesce(F.col("doc_id").isin(pages), F.lit(False)) if pages else F.lit(True)
    kept = docs.withColumn("_plain", F.col("text")).withColumn("_chosen", chosen)
    out = redact(kept, pattern(term, match_case))
    return out.withColumn("text", F.when(F.col("_chosen"), F.col("text")).otherwise(F.col("_plain"))).withColumn("n_redacted", F.when(F.col("_chosen"), F.col("n_redacted")).otherwise(0)).drop("_plain", "_chosen")


def redact_pages(docs: DataFrame, pages: list[int]) -> DataFrame:
    """The text of the listed rows wiped; the rows stay."""
    return docs.withColumn("text", F.when(F.col("doc_id").isin(pages), F.lit("")).otherwise(F.col("text")))


def next_hit_page(pages: DataFrame, term: str, start: int, key: str = "doc_id") -> DataFrame:
    """Of each document (key: page) the first page after `start` that has the term, from the beginning after the last, start itself last."""
    found = pages.withColumn("n_hits", hits("text", term)).where("n_hits > 0")
    total = pages.groupBy(key).agg((F.max("page_no") + 1).alias("_n"))
    away = F.pmod(F.col("page_no") - start - 1, F.col("_n"))
    return found.join(total, key).groupBy(key).agg(F.min_by(F.struct("page_no", "n_hits"), away).alias("h")).select(key, "h.page_no", "h.n_hits")


def goto(hits_: DataFrame, at: int, step: int) -> DataFrame:
    """The hit `step` away from number `at`, around the ends, of ordered hits (doc_id, hit)."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return hits_.withColumn("_n", n).where(F.col("hit") == F.pmod(F.lit(at + step), F.col("_n"))).drop("_n")


def first_hit_from(hits_: DataFrame, page: int) -> DataFrame:
    """The number of the first hit on or after a page, 0 if there is none, of each document's hits (doc_id, hit, page_no)."""
    return hits_.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("page_no") >= page, F.col("hit"))), F.lit(0)).alias("hit"))


def furniture(lines_: DataFrame, group: str, page: str, min_ratio: float = 0.5, band: Column | None = None) -> DataFrame:
    """The lines that run through a group's pages: bare page numbers, and lines whose key is on at least max(2, a share of the pages).

    Keys are counted once a page. `band` says which lines are candidates (those at the top and bottom, where there is a
    layout). Lines are first reduced to (group, key, page), so a line that is on every page leaves each task once.
    """
    near = lines_ if band is None else lines_.where(band)
    keyed = near.withColumn("furniture_key", furniture_key("text"))
    pages = lines_.select(group, page).distinct().groupBy(group).agg(F.count("*").alias("n_pages"))
    # half of the pages, rounded up; another share likewise
    need = F.greatest(F.lit(2), F.ceil(F.col("n_pages") * F.lit(min_ratio)).cast("long"))
    often = keyed.select(group, "furniture_key", page).distinct().groupBy(group, "furniture_key").agg(F.count("*").alias("key_pages"))
    often = often.join(pages, group).where(F.col("key_pages") >= need).select(group, "furniture_key", "key_pages")
    found = keyed.join(often, [group, "furniture_key"], "left")
    return found.where(F.col("key_pages").isNotNull() | is_page_number("text"))


def contents(docs: DataFrame) -> DataFrame:
    """All of a document's pages as one text, each under a line with its number."""
    page = F.concat(F.lit("===== หน้า "), (F.col("page_no") + 1).cast("string"), F.lit(" =====\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return docs.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", page.alias("t")))), lambda p: p["t"]), "").alias("text"))


# --- HTML pages


def links(pages: DataFrame) -> DataFrame:
    """page_id, ord, uri of the links of HTML pages whose address isn't empty."""
    found = F.regexp_extract_all("html", F.lit(r"<a\s[^>]*?href=\"([^\"]*)\""), 1)
    return pages.select("page_id", F.posexplode(found).alias("ord", "uri")).where(F.trim("uri") != "")


def outline(pages: DataFrame) -> DataFrame:
    """page_id, ord, level, title of the headings of HTML pages."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<h([1-6])[^>]*>.*?</h[1-6]>"), 0)
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "h"))
    title = F.trim(F.regexp_replace(F.regexp_replace("h", r"(?s)<[^>]*>", ""), r"\s+", " "))
    return rows.select("page_id", "ord", F.substring("h", 3, 1).cast("int").alias("level"), title.alias("title"))


def clamp_outline(toc: DataFrame, n: Column | int) -> DataFrame:
    """An outline whose page numbers (from 1) lie in the document."""
    return toc.withColumn("page_no", F.greatest(F.lit(1), F.least(F.col("page_no"), n if isinstance(n, Column) else F.lit(n))))


def outline_parents(toc: DataFrame, key: str = "page_id") -> DataFrame:
    """toc with parent, the ord of the nearest entry before of a smaller level; null for the top.

    For each of the six levels the last entry so far is carried along the order; the largest one below the own level wins.
    """
    window = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.max(F.when(F.col("level") == n, F.col("ord"))).over(window) for n in range(1, 7)}
    parent = F.greatest(F.lit(-1), *[F.when(F.col("level") > n, F.coalesce(at, F.lit(-1))).otherwise(-1) for n, at in last.items()])
    return toc.withColumn("parent", F.nullif(parent, F.lit(-1)))


def unlinked_urls(pages: DataFrame) -> DataFrame:
    """page_id, uri of addresses in the text of HTML pages that no link of the page has."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    found = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({URL})"), 1))).alias("uri"))
    return found.join(links(pages).select("page_id", "uri").distinct(), ["page_id", "uri"], "left_anti")


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, text of HTML pages: no markup, scripts, styles and comments, entities undone, white space collapsed."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return pages.select("page_id", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))


def to_html(pages: DataFrame) -> DataFrame:
    """A document's pages (page_no, text) as one XHTML text."""
    from quire.functions.text import escape_xml, repair_text

    page = F.concat(F.lit('<div class="page"><p>'), F.regexp_replace(escape_xml(repair_text("text", compose=False)), "\n", "</p><p>"), F.lit("</p></div>"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", page.alias("t")))), lambda p: p["t"]), "\n")
    return pages.groupBy("doc_id").agg(F.concat(F.lit('<!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml"><body>'), body, F.lit("</body></html>")).alias("html"))

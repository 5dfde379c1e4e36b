"""What becomes of each page when a document is exported: the decisions, without the writing.

A page is a picture if nothing on it can be read, a pinned page if it is made to be looked at, and else flows; pages that
flow one after the other, of one size and one kind of numbering, are a section, and every other page is one of its own.
Each page is judged once, by aggregates and joins on (doc_id, page_no); sections come from one walk over a document's pages.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import font_style
from quire.operators.model import PAGE, designed_pages, garbled_pages, page_number_of

_ROUTES = "doc_id long, page_no int, route string, reported boolean, section int"


def page_routes(pages: DataFrame, lines: DataFrame, images: DataFrame, drawings: DataFrame, tables: DataFrame | None = None, keep_layout: bool = False) -> DataFrame:
    """doc_id, page_no, route (picture, pinned or flow), reported (a picture of a page that has text), section (from 0).

    With keep_layout all pages but pictures are pinned. A flowing page begins a section after one that doesn't flow, where
    its width or height differs by over a point from that of the section's first page, or where its kind of page number
    is known and differs from the last one known in the section.
    """
    garbled = garbled_pages(lines, pages).select(*PAGE, "as_picture", "reported")
    label = page_number_of(lines, pages).select(*PAGE, F.col("label.format").alias("_format"))
    judged = pages.select(*PAGE, "width", "height").join(garbled, PAGE, "left").join(label, PAGE, "left")
    if keep_layout:
        judged = judged.withColumn("is_designed", F.lit(True))
    else:
        judged = judged.join(designed_pages(pages, lines, images, drawings, tables), PAGE, "left")
    route = F.when(F.coalesce("as_picture", F.lit(True)), "picture").when(F.coalesce("is_designed", F.lit(False)), "pinned").otherwise("flow")
    routed = judged.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), route.alias("route"), F.coalesce("reported", F.lit(False)).alias("reported"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), "_format")

    def walk(batches):
        doc, section, size, known = object(), -1, None, None
        for b in batches:
            numbers = []
            for doc_id, kind, width, height, numbering in zip(*(b.column(c).to_pylist() for c in ("doc_id", "route", "width", "height", "_format")), strict=True):
                if doc_id != doc:
                    doc, section, size = doc_id, -1, None
                if kind != "flow":
                    section, size = section + 1, None
                else:
                    if size is None or abs(size[0] - width) > 1 or abs(size[1] - height) > 1 or (numbering and known and numbering != known):
                        section, size, known = section + 1, (width, height), None
                    known = numbering or known
                numbers.append(section)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "page_no", "route", "reported")), pa.array(numbers, pa.int32())], names=["doc_id", "page_no", "route", "reported", "section"])

    return routed.repartition("doc_id").sortWithinPartitions("doc_id", "page_no").mapInArrow(walk, _ROUTES)


def export_summary(routes: DataFrame, lines: DataFrame, images: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """doc_id, pages, sections, picture_pages (from 1, those with text), pinned_pages, images (pictures of pages and distinct ones on others), fonts (families and styles).

    images: doc_id, page_no, ord and, if there is such a column, xref, by which one that is used again counts once.
    renames: doc_id, family, rename, reject as fonts.fitted() gives them: families that are renamed, and those left out.
    """
    counts = routes.groupBy("doc_id").agg(
        F.count("*").alias("pages"), (F.max("section") + 1).alias("sections"), F.sort_array(F.collect_list(F.when((F.col("route") == "picture") & F.col("reported"), F.col("page_no") + 1))).alias("picture_pages"),
        F.count_if(F.col("route") == "pinned").alias("pinned_pages"), F.count_if(F.col("route") == "picture").alias("_pictures"),
    )
    key = "xref" if "xref" in images.columns else "ord"
    shown = routes.where("route <> 'picture'").select(*PAGE)
    media = images.join(shown, PAGE, "left_semi").groupBy("doc_id").agg(F.count_distinct(key).alias("_media"))
    looks = lines.join(shown, PAGE, "left_semi").select("doc_id", F.explode("spans").alias("s")).where(F.col("s.text") != "").select("doc_id", font_style("s.font", "s.flags").alias("f")).select("doc_id", "f.family", "f.bold", "f.italic").distinct()
    if renames is not None:
        looks = looks.join(renames.select("doc_id", "family", "rename", "reject"), ["doc_id", "family"], "left").where(F.col("rename").isNotNull() | ~F.coalesce("reject", F.lit(False))).withColumn("family", F.coalesce("rename", "family"))
    style = F.concat(F.when(F.col("bold"), "Bold").otherwise(""), F.when(F.col("italic"), "Italic").otherwise(""))
    named = looks.select("doc_id", F.concat_ws(" ", "family", F.when(style == "", "Regular").otherwise(style)).alias("_f")).groupBy("doc_id").agg(F.sort_array(F.collect_set("_f")).alias("fonts"))
    all_ = counts.join(media, "doc_id", "left").join(named, "doc_id", "left")
    return all_.select("doc_id", "pages", "sections", "picture_pages", "pinned_pages", (F.col("_pictures") + F.coalesce("_media", F.lit(0))).alias("images"), F.coalesce("fonts", F.array().cast("array<string>")).alias("fonts"))

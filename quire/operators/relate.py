"""Joins by order and by place, and statistics that break ties by position.

Boxes are columns x0, y0, x1, y1. Joins by place go by document, page and cell of a grid on the page, so they compare
what lies close together only; the as-of join has no comparison at all: it is one window over the union of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.grid import centred, home, listed, placed, same_cell, shuffled

PAGE = ["doc_id", "page_no"]
CORNERS = ["x0", "y0", "x1", "y1"]


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], strict: bool = True, keep_unmatched: bool = False) -> DataFrame:
    """left with `values` of the last row of right before it (strict) or at its position, of equal `by` columns."""
    side = F.col("_side")
    a = left.select("*", F.lit(0 if strict else 1).alias("_side"))
    b = right.select(*by, on, F.struct(*values).alias("_value"), F.lit(1 if strict else 0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    window = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_found", F.last("_value", ignorenulls=True).over(window)).where(side == (0 if strict else 1))
    if not keep_unmatched:
        both = both.where("_found IS NOT NULL")
    return both.select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in values])


def contains(box: str, x: Column, y: Column, slack: float = 0.0) -> Column:
    """Whether a point lies in a box of a table under the alias `box`."""
    return x.between(F.col(f"{box}.x0") - slack, F.col(f"{box}.x1") + slack) & y.between(F.col(f"{box}.y0") - slack, F.col(f"{box}.y1") + slack)


def area(box: str = "") -> Column:
    c = lambda n: F.col(f"{box}.{n}" if box else n)
    return F.greatest(c("x1") - c("x0"), F.lit(0.0)) * F.greatest(c("y1") - c("y0"), F.lit(0.0))


def overlap(a: str, b: str) -> Column:
    """The area that two boxes share."""
    w = F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0"))
    h = F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def at_point(points: DataFrame, boxes: DataFrame, pick: str = "smallest", slack: float = 0.0, keep_unmatched: bool = False) -> DataFrame:
    """points (doc_id, page_no, point, x, y) with box, the ord of the box there: the smallest, the first or the topmost (last)."""
    # points of one place meet the same boxes, and of boxes of one outline only one can be the answer
    own = points.select(*PAGE, "x", "y").distinct()
    outlines = boxes.groupBy(*PAGE, *CORNERS).agg((F.max if pick == "topmost" else F.min)("ord").alias("ord"))
    p, b = placed(own, "x", "y").alias("p"), shuffled(listed(outlines, slack).alias("b"))
    met = p.join(b, same_cell("p", "b") & contains("b", F.col("p.x"), F.col("p.y"), slack))
    order = {"smallest": F.struct(area("b"), F.col("b.ord")), "first": F.struct(F.col("b.ord")), "topmost": F.struct(-F.col("b.ord"))}[pick]
    best = met.groupBy("p.doc_id", "p.page_no", "p.x", "p.y").agg(F.min(F.struct(order.alias("_order"), F.col("b.ord").alias("box"))).alias("_best"))
    found = points.select(*PAGE, "point", "x", "y").join(shuffled(best), [*PAGE, "x", "y"], "left" if keep_unmatched else "inner")
    return found.groupBy(*PAGE, "point").agg(F.min("_best").alias("_best")).select(*PAGE, "point", F.col("_best.box").alias("box"))


def _centre(a: str) -> tuple[Column, Column]:
    return (F.col(f"{a}.x0") + F.col(f"{a}.x1")) / 2, (F.col(f"{a}.y0") + F.col(f"{a}.y1")) / 2


def outside(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """The boxes whose centre no region of their page contains."""
    return centred(boxes).alias("a").join(shuffled(listed(regions.select(*PAGE, *CORNERS).distinct()).alias("b")), same_cell("a", "b") & contains("b", *_centre("a")), "left_anti").select(boxes.columns)


def in_cells(lines: DataFrame, cells: DataFrame, slack: float = 1.0) -> DataFrame:
    """Lines by the cell (ord) that their centre lies in, in reading order: cell, line, place (from 0)."""
    # cells of one outline hold the same lines at the same places: one of them crosses the network with its lines, the rows of
    # the others come of a join that exchanges them no more (boxes that share their ord are one cell, known by all of its boxes)
    whole = cells.groupBy(*PAGE, "ord").agg(F.sort_array(F.collect_list(F.struct(*CORNERS))).alias("_boxes"))
    first = Window.partitionBy(*PAGE, "_boxes").orderBy(F.col("ord").asc_nulls_last())
    # ordinals are not negative: -1 stands for a cell without one
    alike = whole.withColumn("_like", F.coalesce(F.first("ord").over(first), F.lit(-1))).withColumn("_n", F.row_number().over(first))
    shown = alike.where("_n = 1").select(*PAGE, "_like", F.inline("_boxes"))
    met = centred(lines).alias("a").join(shuffled(listed(shown, slack).alias("b")), same_cell("a", "b") & contains("b", *_centre("a"), slack))
    rows = met.select("a.doc_id", "a.page_no", "b._like", F.col("a.ord").alias("line"), F.bround("a.y0", 1).alias("y"), F.col("a.x0").alias("x"))
    order = Window.partitionBy(*PAGE, "_like").orderBy("y", "x", "line")
    ranked = rows.withColumn("place", F.row_number().over(order) - 1)
    return ranked.join(shuffled(alike.select(*PAGE, "_like", F.col("ord").alias("cell"))), [*PAGE, "_like"]).select(*PAGE, "cell", "line", "place")


def shading(cells: DataFrame, fills: DataFrame, table_area: float) -> DataFrame:
    """cells with fill, the ord of the smallest fill that holds a cell's centre, is at least half the cell and under nine tenths of the table."""
    # cells of one outline have the same fill, and of fills of one outline the first counts
    own, offered = cells.select(*PAGE, *CORNERS).distinct(), fills.groupBy(*PAGE, *CORNERS).agg(F.min("ord").alias("ord"))
    met = centred(own).alias("a").join(shuffled(listed(offered).alias("b")), same_cell("a", "b") & contains("b", *_centre("a")) & (area("b") >= 0.5 * area("a")) & (area("b") < 0.9 * table_area))
    best = met.groupBy(*[F.col(f"a.{c}") for c in (*PAGE, *CORNERS)]).agg(F.min(F.struct(area("b").alias("_area"), F.col("b.ord").alias("fill"))).alias("_best"))
    found = cells.select(*PAGE, "ord", *CORNERS).join(shuffled(best), [*PAGE, *CORNERS], "left")
    return found.groupBy(*PAGE, "ord").agg(F.min("_best").alias("_best")).select(*PAGE, "ord", F.col("_best.fill").alias("fill"))


def outermost(cells: DataFrame, tolerance: float = 1.5, ratio: float = 1.05) -> DataFrame:
    """Cells that no clearly larger cell of the same table contains."""
    a, b = placed(cells, "x0", "y0").alias("a"), shuffled(listed(cells.select(*PAGE, "table_no", *CORNERS).distinct(), tolerance).alias("b"))  # what contains a box contains its corner
    inside = (F.col("a.x0") >= F.col("b.x0") - tolerance) & (F.col("a.x1") <= F.col("b.x1") + tolerance) & (F.col("a.y0") >= F.col("b.y0") - tolerance) & (F.col("a.y1") <= F.col("b.y1") + tolerance)
    return a.join(b, same_cell("a", "b") & (F.col("a.table_no") == F.col("b.table_no")) & inside & (area("b") > ratio * area("a")), "left_anti").select(cells.columns)


def overlapping_tables(strict: DataFrame, plain: DataFrame, share: float = 0.5) -> DataFrame:
    """Pairs of tables (ord, other) of a page that share at least half of the first one's area."""
    met = listed(strict).alias("a").join(shuffled(listed(plain).alias("b")), same_cell("a", "b") & home("a", "b") & (overlap("a", "b") >= share * area("a")) & (area("a") > 0))
    return met.select("a.doc_id", "a.page_no", "a.ord", F.col("b.ord").alias("other"))


def rules(drawings: DataFrame, exclude: DataFrame, slack: float = 2.0) -> DataFrame:
    """Horizontal rules among drawings (kind line or rect): flat lines, and rectangles at most 4 high and at least 20 wide, outside `exclude`."""
    flat = ((F.col("kind") == "line") & (F.abs(F.col("y1") - F.col("y0")) <= 0.5)) | ((F.col("kind") == "rect") & (F.col("y1") - F.col("y0") <= 4) & (F.col("x1") - F.col("x0") >= 20))
    a, b = placed(drawings.where(flat), "x0", "y0").alias("a"), shuffled(listed(exclude, slack).alias("b"))
    inside = (F.col("a.x0") >= F.col("b.x0") - slack) & (F.col("a.x1") <= F.col("b.x1") + slack) & (F.col("a.y0") >= F.col("b.y0") - slack) & (F.col("a.y1") <= F.col("b.y1") + slack)
    return a.join(b, same_cell("a", "b") & inside, "left_anti").select(drawings.columns)


def glyph_fixes(glyphs: DataFrame, fonts: DataFrame) -> DataFrame:
    """Characters of runs that their font knows otherwise.

    glyphs: run, ord, gid, cp (the extracted code point); fonts: font, font_ord, gid, cp. The font that agrees with most
    characters of a run is its own (the first of equals), if it agrees with half of them but not all; of what it says
    differently only blanks, the Thai AM, the replacement sign and private use are corrected, to a Thai one if there is a choice.
    """
    agree = glyphs.join(fonts.select("font", "font_ord", "gid", F.col("cp").alias("_cp")).distinct(), "gid").groupBy("run", "font", "font_ord").agg(F.count_if(F.col("cp") == F.col("_cp")).alias("hits"))
    best = agree.groupBy("run").agg(F.min_by(F.struct("font", "hits"), F.struct(-F.col("hits"), F.col("font_ord"))).alias("b")).select("run", "b.font", "b.hits")
    size = glyphs.groupBy("run").agg(F.count("*").alias("n"))
    best = best.join(size, "run").where((F.col("hits") * 2 >= F.col("n")) & (F.col("hits") < F.col("n"))).select("run", "font")
    thai = (F.col("cp").between(0x0E00, 0x0E7F)).cast("int")
    said = fonts.groupBy("font", "gid").agg(F.min_by("cp", F.struct(-thai, F.col("cp"))).alias("fixed"), F.collect_set("cp").alias("all"))
    suspect = F.col("cp").isin(0x20, 0xA0, 0x0E33, 0xFFFD) | F.col("cp").between(0xE000, 0xF8FF)
    return glyphs.join(best, "run").join(said, ["font", "gid"]).where(suspect & ~F.array_contains("all", F.col("cp"))).select("run", "ord", "cp", "fixed")


# --- statistics


def upper_median(values: Column | str) -> Column:
    """The upper one of the two middle values, of an aggregate's values."""
    ordered = F.array_sort(F.collect_list(values))
    return F.when(F.size(ordered) > 0, F.try_element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1))


def upper_median_by(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, upper_median of each group: by rank rather than a collected list, so a group may be of any size."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(value))
    counts = df.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("_n"))
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", rank).join(counts, by)
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(by, F.col(value).alias("upper_median"))


def commonest(df: DataFrame, by: list[str], weight: Column, order: str) -> DataFrame:
    """One row: the combination of `by` of the largest total weight, the first seen of equals."""
    return df.groupBy(*by).agg(F.sum(weight).alias("weight"), F.min(order).alias("_first")).orderBy(F.desc("weight"), "_first").limit(1).drop("_first")


def runs(df: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """Runs of rows of equal key that follow each other: by, run (from 1), key, first, last, n."""
    window = Window.partitionBy(by).orderBy(order)
    new = F.when(F.lag(key).over(window).eqNullSafe(F.col(key)) & (F.row_number().over(window) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(window)).groupBy(by, "run", key).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def reading_order(lines: DataFrame) -> DataFrame:
    """lines with place, from 0 in each document: by page, height (to a tenth) and left edge."""
    order = Window.partitionBy("doc_id").orderBy("page_no", F.bround("y0", 1), "x0", "ord")
    return lines.withColumn("place", F.row_number().over(order) - 1)


def images_by_first_page(images: DataFrame) -> DataFrame:
    """Each image once: the first page that shows it and the largest width."""
    return images.groupBy("doc_id", "xref").agg(F.min("page_no").alias("page_no"), F.max(F.col("x1") - F.col("x0")).alias("width"))


def margins(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Margins of each document by what its pages hold: at least 18, at most 35 % of the width and 30 % of the height, 72 without content."""
    clamp = lambda v, most: F.coalesce(F.greatest(F.lit(18.0), F.least(v, F.lit(most))), F.lit(72.0))
    return boxes.groupBy("doc_id").agg(
        clamp(F.min("x0"), 0.35 * width).alias("left"), clamp(F.lit(width) - F.max("x1"), 0.35 * width).alias("right"), clamp(F.min("y0"), 0.3 * height).alias("top"), clamp(F.lit(height) - F.max("y1"), 0.3 * height).alias("bottom")
    )


def preferred_code_point(cmap: DataFrame) -> DataFrame:
    """Glyphs that more than one code point leads to, with the preferred one (column preferred), else the lowest."""
    return cmap.groupBy("glyph").agg(F.count_distinct("cp").alias("n"), F.min_by("cp", F.struct((~F.col("preferred")).cast("int"), F.col("cp"))).alias("cp")).where("n > 1")


def free_name(fields: DataFrame, kind: str) -> DataFrame:
    """The first of kind_1, kind_2 … that no field is called."""
    used = fields.select(F.regexp_extract("name", f"^{kind}_([1-9][0-9]{{0,8}})$", 1).alias("n")).where("n <> ''").select(F.col("n").cast("long").alias("n")).distinct()
    # the first gap follows a number that is there (or 0) and whose successor isn't
    starts = used.unionByName(fields.sparkSession.range(1).select(F.lit(0).cast("long").alias("n")))
    gaps = starts.select((F.col("n") + 1).alias("n")).join(used, "n", "left_anti")
    return gaps.agg(F.min("n").alias("n")).select(F.concat(F.lit(f"{kind}_"), F.col("n").cast("string")).alias("name"))


def first_by_rank(tables: list[DataFrame], key: str) -> DataFrame:
    """The union of tables of which an earlier one's row of a key goes before a later one's."""
    parts = [t.withColumn("_rank", F.lit(i)) for i, t in enumerate(tables)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_rank"))).where("_n = 1").drop("_n", "_rank")


def batch_summary(files: DataFrame) -> DataFrame:
    """Count, bytes before and after, saved and percent over the rows that are ok; 0 percent of nothing."""
    ok = files.where("ok").agg(F.count("*").alias("files"), F.coalesce(F.sum("before"), F.lit(0)).alias("before"), F.coalesce(F.sum("after"), F.lit(0)).alias("after"))
    return ok.withColumn("saved", F.col("before") - F.col("after")).withColumn("percent", F.when(F.col("before") > 0, 100.0 * F.col("saved") / F.col("before")).otherwise(0.0))


def shrink_decision(images: DataFrame, dpi: int) -> DataFrame:
    """images (px_w, px_h, shown_pt, masked, bits) with skip (why an image is left alone, else null) and scale."""
    shown = F.when(F.col("shown_pt") > 0, F.col("shown_pt")).otherwise(11.7 * 72)
    scale = F.least(F.lit(1.0), F.lit(float(dpi)) / (F.col("px_w") * 72.0 / shown))
    skip = F.when(F.col("masked"), "mask").when(F.col("bits") == 1, "bitonal").when(F.col("px_w") * F.col("px_h") < 10_000, "small").when((scale > 0.95) & F.lit(True), "sharp enough")
    return images.withColumn("scale", scale).withColumn("skip", skip)


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other has fewer times, with side."""
    return a.exceptAll(b).withColumn("side", F.lit("old")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))

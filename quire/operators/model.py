"""The page model: filters and derived columns over the tables that a document reader gives.

Lines are rows doc_id, page_no, block_no, line_no, a box x0, y0, x1, y1, a direction dx, dy, and spans, an array of
structs (text, size, font, flags, color, x0, y0, x1, y1). Pages are doc_id, page_no, width, height. All of it is column
expressions, aggregations and joins by document and page.

Cases: a null text is the empty one; a null size is 12; a null array of spans has none; pages without rows of a kind
count none of them; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import PAGE_PARTS, color_hex, font_family, font_style, is_thai, page_label, page_token, repair_text, undecodable_ratio
from quire.operators.grid import centred, listed, placed, same_cell, shuffled
from quire.operators.iterate import cut
from quire.operators.layout import regions as graphic_regions
from quire.operators.relate import PAGE
from quire.operators.runs import stripped

# The kinds of annotation that count as comments, and those with a kind of their own on the page.
COMMENT_TYPES = ("Text", "FreeText", "Line", "Square", "Circle", "Polygon", "PolyLine", "Highlight", "Underline", "Squiggly", "StrikeOut", "Stamp", "Caret", "Ink", "FileAttachment", "Sound")
COMMENT_KINDS = {"Text": "note", "Line": "arrow", "FreeText": "textbox"}
METADATA = ("title", "author", "subject", "keywords")
# The share of a page's height in which headers and footers lie; the share of failed characters of a garbled page.
BAND, GARBLED = 0.08, 0.15


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _visible(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# --- sources


def page_lines(lines: DataFrame) -> DataFrame:
    """The lines that have any text but white space."""
    return lines.where(F.exists(F.coalesce("spans", F.array()), lambda s: _visible(F.coalesce(s["text"], F.lit(""))) != ""))


def spans(lines: DataFrame) -> DataFrame:
    """A row for each span with text: doc_id, page_no, ord (in the order of blocks, lines and spans), and its columns."""
    each = lines.select("doc_id", "page_no", "block_no", "line_no", F.posexplode("spans").alias("span_no", "s")).where(_visible(F.coalesce("s.text", F.lit(""))) != "")
    order = Window.partitionBy("doc_id", "page_no").orderBy("block_no", "line_no", "span_no")
    return each.withColumn("ord", F.row_number().over(order) - 1).select("doc_id", "page_no", "ord", "s.*")


def placed_images(images: DataFrame, pages: DataFrame, keep_full: bool = False) -> DataFrame:
    """Images (pixel_width, pixel_height, box) with an area, without specks of 2 by 2 pixels or less and, unless asked for, without those over 85 % of their page."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    shown = images.where((width > 0) & (height > 0) & ~((F.col("pixel_width") <= 2) & (F.col("pixel_height") <= 2)))
    if keep_full:
        return shown
    sized = shown.join(pages.select(*PAGE, F.col("width").alias("_w"), F.col("height").alias("_h")), PAGE)
    return sized.where(width * height <= 0.85 * F.col("_w") * F.col("_h")).select(*images.columns)


def form_fields(widgets: DataFrame) -> DataFrame:
    """Widgets as fields: name and value without nulls."""
    return widgets.withColumn("name", _text("name")).withColumn("value", _text("value"))


def has_form(docs: DataFrame, widgets: DataFrame) -> DataFrame:
    """doc_id, has_form, is_signed: whether a document has any widget, and any signature with a value."""
    signed = F.bool_or((F.col("type") == "Signature") & (_text("value") != ""))
    found = widgets.groupBy("doc_id").agg(F.lit(True).alias("has_form"), signed.alias("is_signed"))
    return docs.select("doc_id").distinct().join(found, "doc_id", "left").fillna(False, ["has_form", "is_signed"])


def page_comments(annotations: DataFrame) -> DataFrame:
    """Annotations (type, title, content) that lie on the page as notes, arrows and text boxes: author, text, kind."""
    kind = F.create_map(*[F.lit(x) for pair in COMMENT_KINDS.items() for x in pair])[F.col("type")]
    return annotations.where(F.col("type").isin(*COMMENT_KINDS)).withColumn("kind", kind).withColumn("author", _text("title")).withColumn("text", _text("content"))


def all_comments(annotations: DataFrame) -> DataFrame:
    """doc_id, page_no, type, author, text, date of the annotations that are comments; the date of change, else of creation."""
    date = F.coalesce(F.nullif("mod_date", F.lit("")), F.nullif("creation_date", F.lit("")), F.lit(""))
    return annotations.where(F.col("type").isin(*COMMENT_TYPES)).select(*PAGE, "type", _text("title").alias("author"), _text("content").alias("text"), date.alias("date"))


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id and the four entries, empty where there is none."""
    return docs.select("doc_id", *[_text(k).alias(k) for k in METADATA])


def set_metadata(docs: DataFrame, values: dict[str, str]) -> DataFrame:
    """docs with the entries that are given; other keys are ignored."""
    return docs.withColumns({k: F.lit(v) for k, v in values.items() if k in METADATA})


def page_fills(drawings: DataFrame) -> DataFrame:
    """Drawings with a fill (an array of red, green, blue from 0 to 1) that isn't nearly white."""
    return drawings.where(F.size(F.coalesce("fill", F.array().cast("array<double>"))) > 0).where(F.array_min("fill") < 0.97)


def page_counts(files: DataFrame) -> DataFrame:
    """doc_id, pages, needs_password of files (doc_id, page_count, encrypted, error): nothing is known of a file that failed or is locked."""
    failed, locked = F.col("error").isNotNull(), F.coalesce(F.col("encrypted"), F.lit(False))
    return files.select("doc_id", F.when(failed | locked, 0).otherwise(F.coalesce("page_count", F.lit(0))).cast("int").alias("pages"), (~failed & locked).alias("needs_password"))


def blank_pages(docs: DataFrame, count: Column | int, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """Empty pages of each document, one at least."""
    n = F.greatest(F.lit(1), count if isinstance(count, Column) else F.lit(count))
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("page_no"), F.lit(width).alias("width"), F.lit(height).alias("height"))


# --- geometry


def core_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """What deleting a text's box takes: without 18 % of the height above and below, and up to 0.6 at the sides."""
    return _shrunk(x0, y0, x1, y1, F.least(F.lit(0.6), (x1 - x0) * 0.1), (y1 - y0) * 0.18)


def risk_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Where a deletion nearby can harm a text: without 5 % of the height above and below, and 0.3 at the sides."""
    return _shrunk(x0, y0, x1, y1, F.lit(0.3), (y1 - y0) * 0.05)


def _shrunk(x0: Column, y0: Column, x1: Column, y1: Column, dx: Column, dy: Column) -> Column:
    box = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    empty = (x0 + dx >= x1 - dx) | (y0 + dy >= y1 - dy)
    return F.when(empty, box(x0, y0, x1, y1)).otherwise(box(x0 + dx, y0 + dy, x1 - dx, y1 - dy))


def view_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, rotation: Column, back: bool = False) -> Column:
    """A box of an unrotated page of that width and height as it is seen after a turn by rotation (clockwise, by quarters), or back."""
    turn = F.pmod(rotation, F.lit(360))
    w, h = width, height
    box = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    quarter = box(h - y1, x0, h - y0, x1) if not back else box(y0, h - x1, y1, h - x0)
    three = box(y0, w - x1, y1, w - x0) if not back else box(w - y1, x0, w - y0, x1)
    return F.when(turn == 90, quarter).when(turn == 180, box(w - x1, h - y1, w - x0, h - y0)).when(turn == 270, three).otherwise(box(x0, y0, x1, y1))


def placement_rotation(a: Column, b: Column) -> Column:
    """(rotate, bake) of a placement matrix: the quarter turn that undoes it where it is within 1.5 degrees of one, else the angle itself."""
    angle = F.degrees(F.atan2(b, a))
    snapped = F.bround(angle / 90, 0) * 90
    near = F.abs(angle - snapped) <= 1.5
    return F.struct(F.when(near, F.pmod(-snapped, F.lit(360.0))).otherwise(0).cast("int").alias("rotate"), F.when(near, 0.0).otherwise(angle).alias("bake"))


def pdf_box(text: Column | str) -> Column:
    """The box of an array of four numbers as text, with its corners in order; null if it is none."""
    parts = F.filter(F.split(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"^\s*\[|\]\s*$", ""), r"\s+"), lambda p: p != "")
    n = F.transform(parts, lambda p: p.try_cast("double"))
    low, high = lambda i, j: F.least(n[i], n[j]), lambda i, j: F.greatest(n[i], n[j])
    whole = (F.size(n) == 4) & F.forall(n, lambda x: x.isNotNull())
    return F.when(whole, F.struct(low(0, 2).alias("x0"), low(1, 3).alias("y0"), high(0, 2).alias("x1"), high(1, 3).alias("y1")))


# --- lines


def line_text(spans_: Column | str = "spans") -> Column:
    """The repaired texts of a line's spans, joined: a control character keeps them apart while all are repaired at once, and goes with that."""
    texts = F.transform(F.coalesce(F.col(spans_) if isinstance(spans_, str) else spans_, F.array()), lambda s: F.coalesce(s["text"], F.lit("")))
    return repair_text(F.array_join(texts, "\u0001"))


def line_size(spans_: Column | str = "spans") -> Column:
    """The largest size of a line's spans; 12 without any."""
    return F.coalesce(F.array_max(F.transform(F.col(spans_) if isinstance(spans_, str) else spans_, lambda s: F.coalesce(s["size"], F.lit(12.0)))), F.lit(12.0))


def is_bold(font: Column | str, flags: Column | str) -> Column:
    return F.regexp_like(F.lower(_text(font)), F.lit("bold|black|heavy")) | (F.coalesce(F.col(flags), F.lit(0)).bitwiseAND(16) != 0)


def is_italic(font: Column | str, flags: Column | str) -> Column:
    return F.regexp_like(F.lower(_text(font)), F.lit("italic|oblique")) | (F.coalesce(F.col(flags), F.lit(0)).bitwiseAND(2) != 0)


def is_flat(dx: Column | str = "dx", dy: Column | str = "dy") -> Column:
    """Whether a line runs from left to right."""
    return (F.coalesce(F.col(dx), F.lit(1.0)) > 0.99) & (F.abs(F.coalesce(F.col(dy), F.lit(0.0))) < 0.05)


def line_segments(lines: DataFrame) -> DataFrame:
    """A row for each span that has a text after repair: doc_id, page_no, block_no, line_no, segment, family, size (to a tenth), color, style, text."""
    each = lines.select(*PAGE, "block_no", "line_no", F.posexplode("spans").alias("_n", "s")).select("*", repair_text("s.text").alias("text")).where(F.col("text") != "")
    order = Window.partitionBy(*PAGE, "block_no", "line_no").orderBy("_n")
    kept = each.withColumn("segment", F.row_number().over(order) - 1).select("*", F.col("s.font").alias("_font"), F.col("s.flags").alias("_flags"), F.col("s.color").alias("_color"))
    return kept.select(*PAGE, "block_no", "line_no", "segment", font_family("_font").alias("family"), F.bround(F.coalesce("s.size", F.lit(12.0)), 1).alias("size"), color_hex("_color").alias("color"), font_style("_font", "_flags").alias("style"), "text")


# --- pages


def garbled_pages(lines: DataFrame, pages: DataFrame, limit: float = GARBLED) -> DataFrame:
    """doc_id, page_no, as_picture (nothing can be read on it), reported (there was something to read), page (from 1)."""
    texts = page_lines(lines).groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "line_no", line_text().alias("t")))), lambda x: x["t"]), "").alias("_text"))
    found = pages.select(*PAGE).join(texts, PAGE, "left")
    bad = F.col("_text").isNull() | (undecodable_ratio("_text") > limit)
    return found.select(*PAGE, bad.alias("as_picture"), (bad & F.col("_text").isNotNull()).alias("reported"), (F.col("page_no") + 1).alias("page"))


def scanned_pages(pages: DataFrame, text: str, images: DataFrame) -> DataFrame:
    """Pages with is_scanned: fewer than 20 characters, but an image."""
    n = images.groupBy(*PAGE).agg(F.lit(True).alias("_image"))
    scanned = (F.length(_visible(_text(text))) < 20) & F.coalesce("_image", F.lit(False))
    return pages.join(n, PAGE, "left").withColumn("is_scanned", scanned).drop("_image")


def _in_page(box: DataFrame) -> Column:
    """The area of a box that lies in its page (columns _w, _h)."""
    side = lambda a, b, most: F.greatest(F.least(F.col(b), F.col(most)) - F.greatest(F.col(a), F.lit(0.0)), F.lit(0.0))
    return side("x0", "x1", "_w") * side("y0", "y1", "_h")


def diagram_pages(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, page_no, is_diagram of pages with lines: of eight lines or more, 70 % of the characters lie in graphic regions."""
    x, y = (F.col("l.x0") + F.col("l.x1")) / 2, (F.col("l.y0") + F.col("l.y1")) / 2
    marked = lines.select(*PAGE, "x0", "y0", "x1", "y1", F.monotonically_increasing_id().alias("_line"), F.length(_visible(line_text())).alias("_n"))
    within = x.between(F.col("r.x0"), F.col("r.x1")) & y.between(F.col("r.y0"), F.col("r.y1"))
    met = centred(marked).alias("l").join(shuffled(listed(regions).alias("r")), same_cell("l", "r") & within, "left_semi").groupBy(*PAGE).agg(F.sum("_n").alias("_inside"))
    total = marked.groupBy(*PAGE).agg(F.sum("_n").alias("_all"), F.count("*").alias("_lines"))
    inside = F.coalesce("_inside", F.lit(0))
    return total.join(met, PAGE, "left").select(*PAGE, ((F.col("_lines") >= 8) & (F.col("_all") > 0) & (inside >= 0.7 * F.col("_all"))).alias("is_diagram"))


def designed_pages(pages: DataFrame, lines: DataFrame, images: DataFrame, drawings: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """doc_id, page_no, is_designed: made to be looked at rather than read.

    A diagram; or up to 40 lines with one that doesn't run from left to right or has a span of 36 points; or up to 60
    lines and images that cover 45 % of the page, together with coloured shapes where they alone don't. What is drawn in
    tables (boxes) makes no diagram.
    """
    size = pages.select(*PAGE, F.col("width").alias("_w"), F.col("height").alias("_h"))
    text = lines.groupBy(*PAGE).agg(F.count("*").alias("_lines"), F.bool_or(~is_flat() | (F.coalesce(F.array_max(F.transform("spans", lambda s: F.coalesce(s["size"], F.lit(0.0)))), F.lit(0.0)) >= 36)).alias("_loud"))
    covered = lambda df, name: df.join(size, PAGE).groupBy(*PAGE).agg(F.sum(_in_page(df)).alias(name))
    coloured = drawings.where(F.size(F.coalesce("fill", F.array().cast("array<double>"))) > 0).where(F.array_min("fill") < 0.92)
    diagram = diagram_pages(lines, graphic_regions(drawings, pages, tables))
    all_ = size
    for part in (text, covered(placed_images(images, pages, keep_full=True), "_pictures"), covered(coloured, "_shapes"), diagram):
        all_ = all_.join(part, PAGE, "left")
    n, pictures, area = F.coalesce("_lines", F.lit(0)), F.coalesce("_pictures", F.lit(0.0)), F.greatest(F.col("_w") * F.col("_h"), F.lit(1e-9))
    artwork = F.when(pictures < 0.45 * area, pictures + F.coalesce("_shapes", F.lit(0.0))).otherwise(pictures) >= 0.45 * area
    loud = (n <= 40) & F.coalesce("_loud", F.lit(False))
    return all_.select(*PAGE, F.when(F.coalesce("is_diagram", F.lit(False)), True).when(n > 60, False).otherwise(loud | artwork).alias("is_designed"))


def in_band(height: Column | str, band: float = BAND) -> Column:
    """Whether a line lies where headers and footers do."""
    h = F.col(height) if isinstance(height, str) else height
    return (F.col("y1") <= h * band) | (F.col("y0") >= h * (1 - band))


def page_number_of(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_no, label (format, value; null if its number can't be read) of pages whose band holds a page number: the first one."""
    banded = lines.join(pages.select(*PAGE, "height"), PAGE).where(in_band("height")).withColumn("_token", page_token(line_text())).where("_token IS NOT NULL")
    return banded.groupBy(*PAGE).agg(F.min_by("_token", F.struct("block_no", "line_no")).alias("_token")).select(*PAGE, page_label("_token").alias("label"))


def section_numbering(sections: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, section, format, start of sections (doc_id, page_no, section): by the first page that has a label."""
    index = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("page_no")) - 1
    known = sections.withColumn("_i", index).join(labels, PAGE).where("label IS NOT NULL")
    first = known.groupBy("doc_id", "section").agg(F.min_by(F.struct("label", "_i"), "page_no").alias("f"))
    return first.select("doc_id", "section", F.col("f.label.format").alias("format"), F.greatest(F.lit(1), F.col("f.label.value") - F.col("f._i")).alias("start"))


def header_paragraphs(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Header and footer lines as paragraphs: doc_id, page_no, ord (from top to bottom), align, text, field, total, runs.

    field is the page number, total the number of pages after it, each null if there is none. runs, with the looks of the
    line's spans: kind (text, page or pages; the last two are fields, and a line that has one looks like its first run),
    text, thai (whether a total is to be written in Thai digits), family, size, color and style.
    """
    segments = line_segments(lines).select(*PAGE, "block_no", "line_no", "segment", F.struct("family", "size", "color", "style").alias("key"), "text")
    own = segments.groupBy(*PAGE, "block_no", "line_no").agg(F.sort_array(F.collect_list(F.struct("segment", "key", "text"))).alias("_s"))
    own = own.select(*PAGE, "block_no", "line_no", stripped(F.transform("_s", lambda r: F.struct(r["key"].alias("key"), r["text"].alias("text")))).alias("_runs")).where(F.size("_runs") > 0)
    text = F.array_join(F.transform("_runs", lambda r: r["text"]), "")
    shown = own.withColumn("text", text).join(lines.select(*PAGE, "block_no", "line_no", "x0", "x1", "y0"), [*PAGE, "block_no", "line_no"]).join(pages.select(*PAGE, "width"), PAGE)
    middle = (F.col("x0") + F.col("x1")) / 2
    align = F.when(F.abs(middle - F.col("width") / 2) < 0.1 * F.col("width"), "center").when(middle > F.col("width") / 2, "right").otherwise("left")
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "block_no", "line_no")
    part = lambda n: F.nullif(F.regexp_extract("text", PAGE_PARTS, n), F.lit(""))
    numbered = F.col("text").rlike(PAGE_PARTS)
    first, plain = F.col("_runs")[0]["key"], F.lit(False)
    run = lambda kind, text, key, thai=plain: F.struct(F.lit(kind).alias("kind"), text.alias("text"), thai.alias("thai"), key["family"].alias("family"), key["size"].alias("size"), key["color"].alias("color"), key["style"].alias("style"))
    fields = F.array(run("text", part(1), first), run("page", part(2), first), run("text", part(3), first), run("pages", part(4), first, is_thai(F.substring(part(4), 1, 1))), run("text", part(5), first))
    runs = F.when(numbered, F.filter(fields, lambda r: r["text"].isNotNull())).otherwise(F.transform("_runs", lambda r: run("text", r["text"], r["key"])))
    field = lambda n: F.when(numbered, part(n))
    return shown.select(*PAGE, (F.row_number().over(order) - 1).alias("ord"), align.alias("align"), "text", field(2).alias("field"), field(4).alias("total"), runs.alias("runs"))


def frames(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines at fixed places: doc_id, page_no, ord (by y, x), x, y, width, height; with some room to the right, and within the page. Lines without text after repair have none."""
    size = line_size()
    placed = lines.where(line_text() != "").join(pages.select(*PAGE, F.col("width").alias("_w"), F.col("height").alias("_h")), PAGE)
    width = F.least(F.greatest(1.1 * (F.col("x1") - F.col("x0")) + 8, 2 * size), F.greatest(F.col("_w") - F.col("x0"), F.lit(20.0)))
    x, y = (F.greatest(F.lit(0.0), F.least(F.col(c), F.col(of) - room)) for c, of, room in (("x0", "_w", 10), ("y0", "_h", 6)))
    all_ = placed.select(*PAGE, "block_no", "line_no", x.alias("x"), y.alias("y"), width.alias("width"), F.greatest(F.col("y1") - F.col("y0"), 1.05 * size).alias("height"))
    order = Window.partitionBy(*PAGE).orderBy("y", "x", "block_no", "line_no")
    return all_.withColumn("ord", F.row_number().over(order) - 1).select(*PAGE, "ord", "x", "y", "width", "height")


def ends_early(content: DataFrame, pages: DataFrame, bottom_margin: float) -> DataFrame:
    """doc_id, page_no, bottom, ends_early of pages with content (boxes): over a fifth of the page is left empty above the margin."""
    bottom = content.groupBy(*PAGE).agg(F.greatest(F.max("y1"), F.lit(0.0)).alias("bottom"))
    return bottom.join(pages.select(*PAGE, "height"), PAGE).select(*PAGE, "bottom", (F.col("bottom") < 0.8 * F.col("height") - bottom_margin).alias("ends_early"))


def route_lines(lines: DataFrame, furniture: DataFrame, regions: DataFrame, cells: DataFrame) -> DataFrame:
    """lines with place: furniture (rows block_no, line_no of it), else region, else cell (by the middle, 1 point around), else body; and region, the first that holds it.

    A region takes in the box of each line that goes to it, so that later ones may lie in what it has become: the lines
    of a page with regions are walked in their order (block_no, line_no), the regions of the page being the state.
    """
    l_ = lines.withColumn("_id", F.monotonically_increasing_id())
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    is_furniture = furniture.select(*PAGE, "block_no", "line_no").distinct().withColumn("_furniture", F.lit(True))
    l_ = cut(l_.join(is_furniture, [*PAGE, "block_no", "line_no"], "left"))  # ids are joined on below
    at = l_.where("_furniture IS NULL").select("_id", *PAGE, "x0", "y0", "x1", "y1", x.alias("_x"), y.alias("_y"), F.struct("block_no", "line_no", "_id").alias("_at"))
    drawn = regions.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("region", "x0", "y0", "x1", "y1"))).alias("_regions"))
    walked = at.join(drawn, PAGE).groupBy(*PAGE).agg(F.first("_regions").alias("_regions"), F.sort_array(F.collect_list(F.struct("_at", "_x", "_y", "x0", "y0", "x1", "y1"))).alias("_lines"))
    schema = "_id long, region int"

    def walk(batches):
        for b in batches:
            out = []
            for around, own in zip(b.column("_regions").to_pylist(), b.column("_lines").to_pylist(), strict=True):
                boxes = [[r["region"], r["x0"], r["y0"], r["x1"], r["y1"]] for r in around]
                for r in own:
                    home = next((g for g in boxes if g[1] <= r["_x"] <= g[3] and g[2] <= r["_y"] <= g[4]), None)
                    if home is not None:
                        home[1:] = min(home[1], r["x0"]), min(home[2], r["y0"]), max(home[3], r["x1"]), max(home[4], r["y1"])
                        out.append((r["_at"]["_id"], home[0]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32())], names=["_id", "region"])

    in_region = walked.select("_regions", "_lines").mapInArrow(walk, schema)
    a, c = placed(at, "_x", "_y").alias("a"), shuffled(listed(cells, 1.0).alias("c"))
    inside = F.col("a._x").between(F.col("c.x0") - 1, F.col("c.x1") + 1) & F.col("a._y").between(F.col("c.y0") - 1, F.col("c.y1") + 1)
    in_cell = a.join(c, same_cell("a", "c") & inside, "left_semi").select("_id", F.lit(True).alias("_cell"))
    found = l_.drop("region").join(in_region, "_id", "left").join(in_cell, "_id", "left")
    place = F.when(F.col("_furniture"), "furniture").when(F.col("region").isNotNull(), "region").when(F.col("_cell"), "cell").otherwise("body")
    return found.select(*[c for c in lines.columns if c != "region"], place.alias("place"), "region")


def grown_regions(routed: DataFrame, regions: DataFrame) -> DataFrame:
    """regions with the boxes that they have after route_lines(): each with the lines that went to it."""
    boxes = regions.select(*PAGE, "region", "x0", "y0", "x1", "y1").unionByName(routed.where("place = 'region'").select(*PAGE, "region", "x0", "y0", "x1", "y1"))
    return boxes.groupBy(*PAGE, "region").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def find_widget(wanted: DataFrame, widgets: DataFrame) -> DataFrame:
    """wanted (doc_id, page_no, name, box) with widget: the ord of the first widget of that name whose box meets it; null if there is none."""
    numbered = wanted.withColumn("_id", F.monotonically_increasing_id())
    # of widgets of one name and outline the first counts
    offered = widgets.groupBy(*PAGE, F.coalesce("name", F.lit("")).alias("name"), "x0", "y0", "x1", "y1").agg(F.min("ord").alias("ord"))
    a, b = listed(numbered).alias("a"), shuffled(listed(offered).alias("b"))
    meets = F.lit(True)
    for low, high in (("x0", "x1"), ("y0", "y1")):
        meets = meets & (F.col(f"a.{low}") < F.col(f"b.{high}")) & (F.col(f"b.{low}") < F.col(f"a.{high}"))
    same = same_cell("a", "b") & (F.coalesce("a.name", F.lit("")) == F.col("b.name"))
    found = a.join(b, same & meets).groupBy("a._id").agg(F.min("b.ord").alias("widget"))
    return numbered.join(shuffled(found), "_id", "left").select(*wanted.columns, "widget")


def fingerprints(spans_: DataFrame) -> DataFrame:
    """doc_id, page_no, text and box to a tenth of a point, of each span: what a check after an edit compares as a bag."""
    return spans_.select(*PAGE, "text", *[F.bround(c, 1).alias(c) for c in ("x0", "y0", "x1", "y1")])


# --- fonts


def used_fonts(runs: DataFrame) -> DataFrame:
    """family, styles (in order) of runs (family, bold, italic)."""
    style = F.concat(F.when(F.col("bold"), "Bold").otherwise(""), F.when(F.col("italic"), "Italic").otherwise(""))
    return runs.groupBy("family").agg(F.sort_array(F.collect_set(F.when(style == "", "Regular").otherwise(style))).alias("styles"))


def font_variants(wanted: DataFrame, fonts: DataFrame) -> DataFrame:
    """wanted (path, bold, italic) with variant: the file of fonts (ord, path) of the same family in that style.

    The first exact one; else the first that has more of the style than others, if it is another file; else path itself.
    """
    words = "bold|italic|oblique|black|heavy"
    plain = lambda p: F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(p, r"([^/\\]*)$", 1)), r"[ \-_.]", ""), "regular|ttf|otf", "")
    heavy, slanted = (lambda n: F.regexp_like(n, F.lit("bold|black|heavy"))), (lambda n: F.regexp_like(n, F.lit("italic|oblique")))
    w = wanted.withColumn("_id", F.monotonically_increasing_id()).withColumn("_stem", F.regexp_replace(plain(F.col("path")), words, ""))
    f = fonts.select("ord", F.col("path").alias("variant"), plain(F.col("path")).alias("_name"), F.regexp_replace(plain(F.col("path")), words, "").alias("_stem"))
    score = (heavy(F.col("_name")) == F.col("bold")).cast("int") + (slanted(F.col("_name")) == F.col("italic")).cast("int")
    best = w.where(F.col("bold") | F.col("italic")).join(f, "_stem").withColumn("_score", score).groupBy("_id").agg(F.min_by(F.struct("variant", "_name", "_score"), F.struct(-F.col("_score"), "ord")).alias("b"))
    use = (F.col("b._score") == 2) | (F.col("b._name") != plain(F.col("path")))
    return w.join(best, "_id", "left").select(*wanted.columns, F.when(use, F.col("b.variant")).otherwise(F.col("path")).alias("variant"))


def font_chain(text: Column | str, candidates: Column, covers, thai_font: str | None = None) -> Column:
    """The fonts to try for a text, in order: those that cover it, for Thai text the Thai font if it does, then the others, and null (the built-in font) unless the text has Thai.

    candidates: an array of paths; covers(path, text): whether a font has all of a text's signs.
    """
    text = F.col(text) if isinstance(text, str) else text
    has_thai = F.regexp_like(text, F.lit(r"[\x{0E00}-\x{0E7F}]"))
    cand = F.array_distinct(F.filter(candidates, lambda p: p.isNotNull() & (p != "")))
    good = F.filter(cand, lambda p: covers(p, text))
    net = F.when(has_thai & covers(F.lit(thai_font), text), F.array(F.lit(thai_font))).otherwise(F.array().cast("array<string>")) if thai_font else F.array().cast("array<string>")
    chain = F.array_distinct(F.concat(good, net, cand))
    return F.when(has_thai, chain).otherwise(F.concat(chain, F.array(F.lit(None).cast("string"))))


def metrics_close(text: Column | str, ours: Column, theirs: Column, threshold: float = 0.1) -> Column:
    """Whether two fonts (maps of a sign to its width) set the signs that both have, three at least, to nearly the same width."""
    signs = F.filter(F.split(F.col(text) if isinstance(text, str) else text, ""), lambda c: (c != "") & ~F.regexp_like(c, F.lit(r"(?U)^\s$")))
    common = F.filter(signs, lambda c: F.map_contains_key(ours, c) & F.map_contains_key(theirs, c))
    width = lambda font: F.aggregate(F.transform(common, lambda c: F.try_element_at(font, c)), F.lit(0.0), lambda n, x: n + x) * 10
    return (F.size(common) >= 3) & (width(ours) >= 0.1) & (F.abs(width(theirs) - width(ours)) < threshold * width(ours))


def width_samples(spans_: DataFrame, pages: int = 12, most: int = 80) -> DataFrame:
    """The first `most` spans of each family with six characters or more, on the first pages of each document: doc_id, family, n, bold, italic, size, text, width."""
    text = repair_text("text")
    long = spans_.where(F.col("page_no") < pages).select("doc_id", "page_no", "ord", font_family("font").alias("family"), is_bold("font", "flags").alias("bold"), is_italic("font", "flags").alias("italic"), F.coalesce("size", F.lit(12.0)).alias("size"), text.alias("text"), (F.col("x1") - F.col("x0")).alias("width"))
    order = Window.partitionBy("doc_id", "family").orderBy("page_no", "ord")
    return long.where(F.length(_visible(F.col("text"))) >= 6).withColumn("n", F.row_number().over(order) - 1).where(F.col("n") < most).drop("page_no", "ord")


# --- reports


def compression_report(files: DataFrame) -> DataFrame:
    """files (before, after) with saved, percent (0 of an empty file) and unchanged."""
    saved = F.col("before") - F.col("after")
    return files.withColumn("saved", saved).withColumn("percent", F.when(F.col("before") != 0, saved * 100.0 / F.col("before")).otherwise(0.0)).withColumn("unchanged", saved <= 0)


def checks_summary(results: DataFrame) -> DataFrame:
    """doc_id, passed, failed, manual, issues (name and category of those that failed, in order) of results (doc_id, ord, name, category, status)."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    failed = F.sort_array(F.collect_list(F.when(F.col("status") == "failed", F.struct("ord", "name", "category"))))
    return results.groupBy("doc_id").agg(count("passed"), count("failed"), count("manual"), F.transform(failed, lambda x: F.struct(x["name"].alias("name"), x["category"].alias("category"))).alias("issues"))


def add_files(have: DataFrame, new: DataFrame, folder: str = "") -> DataFrame:
    """The files (ord, path) of `new` that join a list: PDF files by name, of equal normalised paths the first, without those already there. Relative paths are of `folder`."""
    path = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(f"{folder}/" if folder else ""), "path"))
    steps = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def walk(out: Column, p: Column) -> Column:
        """A step up takes the last one back; there is none above the root, and above an unknown folder it stays."""
        back = F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit("..")) != ".."
        further = F.concat(out, F.array(p))
        return F.when(p != "..", further).when(back, F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(path.startswith("/"), out).otherwise(further)

    key = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/"))
    pdf = new.where(F.lower(F.coalesce("path", F.lit(""))).endswith(".pdf")).withColumn("_key", key)
    first = pdf.groupBy("_key").agg(F.min_by(F.struct(*new.columns), "ord").alias("f"))
    return first.join(have.select(key.alias("_key")).distinct(), "_key", "left_anti").select("f.*")


def thai_share(text: Column | str) -> Column:
    """The share of Thai signs among a text's characters; 0 for the empty text."""
    signs = F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), ""), lambda c: c != "")
    return F.when(F.size(signs) > 0, F.size(F.filter(signs, is_thai)) / F.size(signs)).otherwise(0.0)

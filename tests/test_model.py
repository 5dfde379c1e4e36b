"""The page model on made tables: each operator on literal cases, nulls and empty tables among them."""

import pytest
from pyspark.sql import functions as F

from quire.operators import model, pages, relate, search

BOX = "x0 double, y0 double, x1 double, y1 double"
SPAN = f"struct<text: string, size: double, font: string, flags: int, color: int, {BOX.replace(' double', ': double')}>"
LINE = f"doc_id long, page_no int, block_no int, line_no int, {BOX}, dx double, dy double, spans array<{SPAN}>"


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def span(text, size=12.0, font="ABCDEF+Arial-BoldMT", flags=0, color=0xFF0010, box=(0.0, 0.0, 10.0, 10.0)):
    return (text, size, font, flags, color, *box)


def line(block, no, box, *spans, page=0, dx=1.0, dy=0.0):
    return (1, page, block, no, *map(float, box), dx, dy, list(spans) or None)


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([
        line(0, 0, (250, 20, 350, 30), span("- 7 -")), line(1, 0, (72, 100, 500, 114), span("Hello "), span("world", 14.26, "Times-Italic", 1)), line(1, 1, (72, 120, 500, 134), span("   "), span(None)),
        line(2, 0, (72, 300, 90, 400), span("turned"), dx=0.0, dy=-1.0), line(0, 0, (72, 810, 200, 825), span("Page iv"), page=1), line(1, 0, (72, 100, 200, 114), span(" x"), page=1), line(0, 0, (10, 10, 20, 20), page=2),
    ], LINE)


@pytest.fixture(scope="module")
def sizes(spark):
    return spark.createDataFrame([(1, p, 595.0, 842.0) for p in range(4)], "doc_id long, page_no int, width double, height double")


def test_lines_and_spans(lines):
    assert got(model.page_lines(lines), "page_no", "block_no", "line_no") == [(0, 0, 0), (0, 1, 0), (0, 2, 0), (1, 0, 0), (1, 1, 0)]
    found = got(model.spans(lines), "page_no", "ord", "text")
    assert found == [(0, 0, "- 7 -"), (0, 1, "Hello "), (0, 2, "world"), (0, 3, "turned"), (1, 0, "Page iv"), (1, 1, " x")]
    assert got(lines.select(model.line_text().alias("t"), model.line_size().alias("s"), "page_no", "block_no", "line_no").where("page_no = 0 AND block_no = 1"), "t", "s") == [("   ", 12.0), ("Hello world", 14.26)]
    segments = got(model.line_segments(lines.where("block_no = 1 AND page_no = 0 AND line_no = 0")), "segment", "family", "size", "color", "text")
    assert segments == [(0, "Arial", 12.0, "FF0010", "Hello "), (1, "Times New Roman", 14.3, "FF0010", "world")]
    assert got(lines.where("page_no = 0").select("block_no", "line_no", model.is_flat().alias("f")).where("NOT f"), "block_no") == [(2,)]
    assert got(model.fingerprints(model.spans(lines)).where("text = 'world'"), "x0", "y1") == [(0.0, 10.0)]
    assert model.spans(lines.limit(0)).count() == 0 and model.line_segments(lines.limit(0)).count() == 0


def test_bold_and_italic(spark):
    df = spark.createDataFrame([("Arial-Bold", 0), ("ArialBlack", None), ("Times-Oblique", 0), (None, 18), ("Plain", 2)], "font string, flags int")
    assert [(r["b"], r["i"]) for r in df.select(model.is_bold("font", "flags").alias("b"), model.is_italic("font", "flags").alias("i")).collect()] == [(True, False), (True, False), (False, True), (True, True), (False, True)]


def test_images_and_fills(spark, sizes):
    images = spark.createDataFrame([(1, 0, 0, 2, 2, 0.0, 0.0, 50.0, 50.0), (1, 0, 1, 2, 90, 0.0, 0.0, 50.0, 50.0), (1, 0, 2, 900, 900, 0.0, 0.0, 595.0, 800.0), (1, 0, 3, 9, 9, 5.0, 5.0, 5.0, 50.0)], f"doc_id long, page_no int, ord int, pixel_width int, pixel_height int, {BOX}")
    assert got(model.placed_images(images, sizes), "ord") == [(1,)] and got(model.placed_images(images, sizes, keep_full=True), "ord") == [(1,), (2,)]
    fills = spark.createDataFrame([(0, [1.0, 1.0, 0.98]), (1, [1.0, 0.5, 1.0]), (2, None), (3, [])], "ord int, fill array<double>")
    assert got(model.page_fills(fills), "ord") == [(1,)]


def test_fields_comments_metadata(spark):
    widgets = spark.createDataFrame([(1, "Signature", "s", None), (2, "Signature", "s", "x"), (2, "Text", None, "v")], "doc_id long, type string, name string, value string")
    docs = spark.createDataFrame([(1, "T", None, None, "k"), (2, None, None, None, None), (3, None, "A", "S", None)], "doc_id long, title string, author string, subject string, keywords string")
    assert got(model.has_form(docs, widgets), "doc_id", "has_form", "is_signed") == [(1, True, False), (2, True, True), (3, False, False)]
    assert got(model.form_fields(widgets), "doc_id", "name", "value") == [(1, "s", ""), (2, "", "v"), (2, "s", "x")]
    assert got(model.metadata(docs), "doc_id", "title", "author") == [(1, "T", ""), (2, "", ""), (3, "", "A")]
    assert got(model.set_metadata(docs, {"author": "Z", "pages": "9"}), "doc_id", "title", "author") == [(1, "T", "Z"), (2, None, "Z"), (3, None, "Z")]
    notes = spark.createDataFrame([(1, 0, "Text", "a", "b", "", "D:1"), (1, 0, "Link", "a", "b", "m", "c"), (1, 1, "Ink", None, None, "D:2", "D:1"), (1, 2, "Line", "x", "y", None, None)], "doc_id long, page_no int, type string, title string, content string, mod_date string, creation_date string")
    assert got(model.all_comments(notes), "page_no", "type", "author", "text", "date") == [(0, "Text", "a", "b", "D:1"), (1, "Ink", "", "", "D:2"), (2, "Line", "x", "y", "")]
    assert got(model.page_comments(notes), "page_no", "kind") == [(0, "note"), (2, "arrow")]
    files = spark.createDataFrame([(1, 5, False, None), (2, 5, True, None), (3, 5, True, "broken"), (4, None, None, None)], "doc_id long, page_count int, encrypted boolean, error string")
    assert got(model.page_counts(files), "doc_id", "pages", "needs_password") == [(1, 5, False), (2, 0, True), (3, 0, False), (4, 0, False)]
    assert model.blank_pages(docs, 0).count() == 3 and model.blank_pages(docs, 2).count() == 6


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 100.0, 10.0), (0.0, 0.0, 0.5, 0.0)], BOX)
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    flat = lambda r: [round(x, 6) for x in r]
    assert [flat(r["b"]) for r in df.select(model.core_box(*box).alias("b")).collect()] == [[0.6, 1.8, 99.4, 8.2], [0.0, 0.0, 0.5, 0.0]]
    assert [flat(r["b"]) for r in df.select(model.risk_box(*box).alias("b")).collect()] == [[0.3, 0.5, 99.7, 9.5], [0.0, 0.0, 0.5, 0.0]]
    turns = spark.createDataFrame([(r, 10.0, 20.0, 40.0, 60.0) for r in (0, 90, 180, 270)], f"r int, {BOX}")
    seen = turns.select("r", model.view_box(*box, F.lit(600.0), F.lit(800.0), F.col("r")).alias("b"))
    assert {r["r"]: tuple(r["b"]) for r in seen.collect()} == {0: (10, 20, 40, 60), 90: (740, 10, 780, 40), 180: (560, 740, 590, 780), 270: (20, 560, 60, 590)}
    back = seen.select("r", model.view_box(*[F.col(f"b.{c}") for c in ("x0", "y0", "x1", "y1")], F.lit(600.0), F.lit(800.0), F.col("r"), back=True).alias("b"))
    assert {tuple(r["b"]) for r in back.collect()} == {(10.0, 20.0, 40.0, 60.0)}
    angles = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (0.0, -1.0), (-1.0, 0.01), (1.0, 1.0)], "a double, b double")
    assert [(r["p"]["rotate"], round(r["p"]["bake"], 6)) for r in angles.select(model.placement_rotation(F.col("a"), F.col("b")).alias("p")).collect()] == [(0, 0.0), (270, 0.0), (90, 0.0), (180, 0.0), (0, 45.0)]
    boxes = spark.createDataFrame([("[0 0 595 842]",), ("[ 10 20 -5 2.5 ]",), ("[1 2 3]",), ("null",), (None,)], "t string")
    assert [r["b"] and tuple(r["b"]) for r in boxes.select(model.pdf_box("t").alias("b")).collect()] == [(0, 0, 595, 842), (-5, 2.5, 10, 20), None, None, None]


def test_kinds_of_pages(spark, lines, sizes):
    assert got(model.garbled_pages(lines, sizes), "page_no", "as_picture", "reported", "page") == [(0, False, False, 1), (1, True, True, 2), (2, True, False, 3), (3, True, False, 4)]
    images = spark.createDataFrame([(1, 1, 9, 9, 0.0, 0.0, 595.0, 400.0), (1, 2, 9, 9, 0.0, 0.0, 595.0, 300.0)], f"doc_id long, page_no int, pixel_width int, pixel_height int, {BOX}")
    texts = sizes.withColumn("text", F.when(F.col("page_no") == 1, " short ").when(F.col("page_no") == 2, F.repeat(F.lit("long "), 9)))
    assert got(model.scanned_pages(texts, "text", images), "page_no", "is_scanned") == [(0, False), (1, True), (2, False), (3, False)]
    drawings = spark.createDataFrame([(1, 2, 0, 0.0, 0.0, 595.0, 100.0, [0.5, 0.5, 0.5]), (1, 3, 0, 0.0, 0.0, 595.0, 842.0, [1.0, 1.0, 1.0])], f"doc_id long, page_no int, ord long, {BOX}, fill array<double>")
    assert got(model.designed_pages(sizes, lines, images, drawings), "page_no", "is_designed") == [(0, True), (1, True), (2, True), (3, False)]
    labels = [line(0, i, (100 + 5 * i, 100, 130 + 5 * i, 112), span("label"), page=3) for i in range(8)] + [line(1, 0, (72, 700, 500, 714), span("text of its own"), page=3)]
    regions = spark.createDataFrame([(1, 3, 0, 90.0, 90.0, 400.0, 300.0)], f"doc_id long, page_no int, region int, {BOX}")
    df = spark.createDataFrame(labels, LINE)
    assert got(model.diagram_pages(df, regions), "page_no", "is_diagram") == [(3, True)]
    assert got(model.diagram_pages(df.unionByName(df.where("block_no = 1")), regions), "is_diagram") == [(False,)]
    assert got(model.diagram_pages(df.limit(7), regions), "is_diagram") == [(False,)]


def test_numbering_and_headers(spark, lines, sizes):
    found = model.page_number_of(lines, sizes)
    assert [(r["page_no"], tuple(r["label"])) for r in found.orderBy("page_no").collect()] == [(0, ("decimal", 7)), (1, ("lowerRoman", 4))]
    sections = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 1), (1, 3, 2)], "doc_id long, page_no int, section int")
    assert got(model.section_numbering(sections, found), "section", "format", "start") == [(0, "decimal", 7), (1, "lowerRoman", 4)]
    late = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "doc_id long, page_no int, section int")
    assert got(model.section_numbering(late, found.where("page_no = 1")), "format", "start") == [("lowerRoman", 3)]
    heads = spark.createDataFrame([line(0, 0, (500, 20, 560, 30), span(" right ")), line(0, 1, (270, 20, 330, 30), span("Page 3 / 12")), line(0, 2, (40, 10, 90, 18), span("left")), line(0, 3, (40, 10, 90, 18), span(" "))], LINE)
    assert got(model.header_paragraphs(heads, sizes), "ord", "align", "text", "field", "total") == [(0, "left", "left", None, None), (1, "center", "Page 3 / 12", "3", "12"), (2, "right", "right", None, None)]


def test_frames_and_ends(spark, lines, sizes):
    df = spark.createDataFrame([line(0, 0, (590, 840, 700, 850), span("a", 20.0)), line(0, 1, (72, 100, 172, 110), span("b"))], LINE)
    found = got(model.frames(df, sizes), "ord", "x", "y", "width", "height")
    assert [tuple(round(x, 6) for x in f) for f in found] == [(0, 72.0, 100.0, 118.0, 12.6), (1, 585.0, 836.0, 20.0, 21.0)]
    content = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 700.0), (1, 1, 0.0, 0.0, 9.0, 300.0), (1, 1, 0.0, 0.0, 9.0, 200.0)], f"doc_id long, page_no int, {BOX}")
    assert got(model.ends_early(content, sizes, 72.0), "page_no", "bottom", "ends_early") == [(0, 700.0, False), (1, 300.0, True)]


def test_routing(spark, lines):
    furniture = spark.createDataFrame([(1, 0, 0, 0)], "doc_id long, page_no int, block_no int, line_no int")
    regions = spark.createDataFrame([(1, 0, 1, 200.0, 0.0, 400.0, 130.0), (1, 0, 0, 280.0, 100.0, 290.0, 110.0)], f"doc_id long, page_no int, region int, {BOX}")
    cells = spark.createDataFrame([(1, 0, 80.5, 340.0, 82.0, 360.0), (1, 0, 200.0, 0.0, 400.0, 130.0)], f"doc_id long, page_no int, {BOX}")
    found = got(model.route_lines(lines.where("page_no = 0"), furniture, regions, cells), "block_no", "line_no", "place", "region")
    assert found == [(0, 0, "furniture", None), (1, 0, "region", 0), (1, 1, "region", 1), (2, 0, "cell", None)]
    wanted = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 5.0, 5.0), (1, 0, None, 0.0, 0.0, 5.0, 5.0), (1, 0, "b", 0.0, 0.0, 5.0, 5.0)], f"doc_id long, page_no int, name string, {BOX}")
    widgets = spark.createDataFrame([(1, 0, 3, "a", 4.0, 4.0, 9.0, 9.0), (1, 0, 2, "a", 1.0, 1.0, 2.0, 2.0), (1, 0, 0, "a", 5.0, 0.0, 9.0, 9.0), (1, 0, 5, "", 0.0, 0.0, 1.0, 1.0)], f"doc_id long, page_no int, ord int, name string, {BOX}")
    assert got(model.find_widget(wanted, widgets), "name", "widget") == [(None, 5), ("a", 2), ("b", None)]


def test_fonts(spark):
    runs = spark.createDataFrame([("Arial", True, False), ("Arial", False, False), ("Arial", True, True), ("Sarabun", None, None)], "family string, bold boolean, italic boolean")
    assert got(model.used_fonts(runs), "family", "styles") == [("Arial", ["Bold", "BoldItalic", "Regular"]), ("Sarabun", ["Regular"])]
    fonts = spark.createDataFrame([(0, "/f/TH Sarabun New.ttf"), (1, "/f/THSarabunNew-Bold.ttf"), (2, "/f/THSarabunNew Italic.ttf"), (3, "/f/Other-Bold.otf")], "ord int, path string")
    wanted = spark.createDataFrame([("/f/TH Sarabun New.ttf", b, i) for b in (True, False) for i in (True, False)] + [("/f/Lone.ttf", True, False)], "path string, bold boolean, italic boolean")
    assert got(model.font_variants(wanted, fonts), "path", "bold", "italic", "variant") == [("/f/Lone.ttf", True, False, "/f/Lone.ttf"), ("/f/TH Sarabun New.ttf", False, False, "/f/TH Sarabun New.ttf"), ("/f/TH Sarabun New.ttf", False, True, "/f/THSarabunNew Italic.ttf"), ("/f/TH Sarabun New.ttf", True, False, "/f/THSarabunNew-Bold.ttf"), ("/f/TH Sarabun New.ttf", True, True, "/f/THSarabunNew-Bold.ttf")]
    texts = spark.createDataFrame([("abc", ["latin", "", "all", "latin"]), ("กข", ["latin", "all"]), ("กข", ["latin"])], "t string, c array<string>")
    covers = lambda p, t: (p == "all") | (p == "thai") | ((p == "latin") & ~F.regexp_like(t, F.lit("[ก-๙]")))
    assert [r["x"] for r in texts.select(model.font_chain("t", F.col("c"), covers, "thai").alias("x")).collect()] == [["latin", "all", None], ["all", "thai", "latin"], ["thai", "latin"]]
    widths = spark.createDataFrame([("a b c", {"a": 0.5, "b": 0.5, "c": 0.5}, {"a": 0.5, "b": 0.5, "c": 0.6}), ("abc", {"a": 0.5, "b": 0.5, "c": 0.5}, {"a": 0.6, "b": 0.6, "c": 0.6}), ("abc", {"a": 0.5, "b": 0.5}, {"a": 0.5, "b": 0.5})], "t string, x map<string,double>, y map<string,double>")
    assert [r["ok"] for r in widths.select(model.metrics_close("t", F.col("x"), F.col("y")).alias("ok")).collect()] == [True, False, False]


def test_reports(spark):
    files = spark.createDataFrame([(100, 60), (0, 0), (10, 12)], "before long, after long")
    assert got(model.compression_report(files), "before", "saved", "percent", "unchanged") == [(0, 0, 0.0, True), (10, -2, -20.0, True), (100, 40, 40.0, False)]
    results = spark.createDataFrame([(1, 0, "a", "x", "passed"), (1, 2, "c", "y", "failed"), (1, 1, "b", "x", "failed"), (2, 0, "a", "x", "manual")], "doc_id long, ord int, name string, category string, status string")
    assert [(r["doc_id"], r["passed"], r["failed"], r["manual"], [tuple(i) for i in r["issues"]]) for r in model.checks_summary(results).orderBy("doc_id").collect()] == [(1, 1, 2, 0, [("b", "x"), ("c", "y")]), (2, 0, 0, 1, [])]
    have = spark.createDataFrame([("/a/x.pdf",)], "path string")
    new = spark.createDataFrame([(0, "/a/b/../x.pdf"), (1, "/a/y.PDF"), (2, "/a/./y.PDF"), (3, "/a/z.txt"), (4, None)], "ord int, path string")
    assert got(model.add_files(have, new), "ord", "path") == [(1, "/a/y.PDF")]


def test_samples_of_widths(spark):
    rows = [(1, p, i, "sample text" if i % 2 else "no", "Arial", 0, 0.0, 0.0, 50.0, 10.0, None) for p in (0, 11, 12) for i in range(100)]
    df = spark.createDataFrame(rows, f"doc_id long, page_no int, ord int, text string, font string, flags int, {BOX}, size double")
    found = model.width_samples(df)
    assert found.count() == 80 and got(found.where("n = 0"), "family", "size", "width") == [("Arial", 12.0, 50.0)]


def test_untested_of_old(spark):
    """Rules, versions, glyphs, links and pages that no query runs."""
    drawings = spark.createDataFrame([(1, 0, 0, "line", 10.0, 50.0, 200.0, 50.4), (1, 0, 1, "line", 10.0, 50.0, 200.0, 60.0), (1, 0, 2, "rect", 10.0, 80.0, 40.0, 83.0), (1, 0, 3, "rect", 10.0, 80.0, 20.0, 83.0)], f"doc_id long, page_no int, ord int, kind string, {BOX}")
    nothing = spark.createDataFrame([], f"doc_id long, page_no int, {BOX}")
    assert got(relate.rules(drawings, nothing), "ord") == [(0,), (2,)]
    html = spark.createDataFrame([(1, "a", "u")], "page_id long, html string, url string")
    assert search.page_text(html).count() == 1
    toc = spark.createDataFrame([(1, 0, 1, "a", 0), (1, 1, 1, "b", 99)], "page_id long, ord int, level int, title string, page_no int")
    assert got(search.clamp_outline(toc, 5), "page_no") == [(1,), (5,)]
    one = spark.createDataFrame([(1, i, f"t{i}") for i in range(3)], "doc_id long, page_no int, text string")
    joined, marks = pages.combine([one, one], ["first.pdf", "second.pdf"])
    assert joined.count() == 6 and marks.count() == 2


def test_lines_are_repaired_span_by_span(spark):
    """A blank before a mark is stray only within a span; composition is of one span, too; control characters go."""
    cases = {("ก", " ", "า"): "ก า", ("ก า",): "กา", ("하",): "하", ("ᄒ", "ᅡ"): "하", ("a\u0001", "b"): "ab", (): "", (None, "x"): "x", ("é", "́"): "é́"}
    df = spark.createDataFrame([(i, [span(t) for t in c]) for i, c in enumerate(cases)], f"id int, spans array<{SPAN}>")
    assert {r["id"]: r["t"] for r in df.select("id", model.line_text().alias("t")).collect()} == dict(enumerate(cases.values()))


def test_tables_make_no_diagram(spark, sizes):
    """Twelve lines within a ruled table: a diagram only as long as nobody says that it is a table."""
    lines = spark.createDataFrame([line(0, i, (100, 100 + i * 10, 200, 108 + i * 10), span("cell text")) for i in range(12)], LINE)
    drawn = spark.createDataFrame([(1, 0, i, 90.0, 95.0 + i * 10, 300.0, 96.0 + i * 10, [1.0]) for i in range(13)], f"doc_id long, page_no int, ord int, {BOX}, fill array<double>")
    none = drawn.limit(0).select("*", F.lit(1).alias("pixel_width"), F.lit(1).alias("pixel_height"))
    table = spark.createDataFrame([(1, 0, 90.0, 95.0, 300.0, 216.0)], f"doc_id long, page_no int, {BOX}")
    page = sizes.where("page_no = 0")
    assert got(model.designed_pages(page, lines, none, drawn), "is_designed") == [(True,)]
    assert got(model.designed_pages(page, lines, none, drawn, table), "is_designed") == [(False,)]


def test_regions_grow(spark):
    """A label that sticks out takes its region along: the next line lies in what it has become, one before it doesn't; furniture takes nothing."""
    lines = spark.createDataFrame([line(0, 0, (150, 40, 170, 50), span("before")), line(0, 1, (80, 40, 160, 50), span("sticks out")), line(0, 2, (130, 40, 170, 50), span("after")), line(0, 3, (60, 60, 400, 70), span("furniture")), line(0, 4, (300, 60, 320, 70), span("beside"))], LINE)
    regions = spark.createDataFrame([(1, 0, 0, 50.0, 30.0, 130.0, 90.0)], f"doc_id long, page_no int, region int, {BOX}")
    furniture = spark.createDataFrame([(1, 0, 0, 3)], "doc_id long, page_no int, block_no int, line_no int")
    routed = model.route_lines(lines, furniture, regions, regions.limit(0))
    assert got(routed, "line_no", "place", "region") == [(0, "body", None), (1, "region", 0), (2, "region", 0), (3, "furniture", None), (4, "body", None)]
    assert got(model.grown_regions(routed, regions), "x0", "y0", "x1", "y1") == [(50.0, 30.0, 170.0, 90.0)]
    assert got(model.route_lines(lines.limit(0), furniture, regions, regions), "place") == []


def test_frames_of_shown_lines(spark, sizes):
    df = spark.createDataFrame([line(0, 0, (10, 10, 60, 20), span("​"), span("")), line(0, 1, (10, 30, 60, 40)), line(0, 2, (10, 50, 60, 60), span(" "))], LINE)
    assert got(model.frames(df, sizes), "y") == [(50.0,)]


def test_header_runs(spark, sizes):
    """A number in the middle of a text becomes a field that looks like the first run; a total in Thai digits says so; other lines keep their runs, without the blanks at both ends."""
    bold = lambda t: span(t, 9.0, "Arial-BoldMT")
    heads = spark.createDataFrame([line(0, 0, (40, 10, 90, 18), span("  "), bold(" หน้า "), span("๓"), span(" จาก ๑๒ |")), line(0, 1, (40, 20, 90, 28), span(" one "), bold("two ")), line(0, 2, (40, 30, 90, 38), span("ก"))], LINE)
    found = {r["ord"]: r for r in model.header_paragraphs(heads, sizes).collect()}
    assert [(r["kind"], r["text"], r["thai"], r["size"], r["style"]["bold"]) for r in found[0]["runs"]] == [("text", "หน้า ", False, 9.0, True), ("page", "๓", False, 9.0, True), ("text", " จาก ", False, 9.0, True), ("pages", "๑๒", True, 9.0, True), ("text", " |", False, 9.0, True)]
    assert [(r["kind"], r["text"], r["size"]) for r in found[1]["runs"]] == [("text", "one ", 12.0), ("text", "two", 9.0)]
    assert (found[0]["field"], found[0]["total"], found[2]["field"], found[2]["total"], found[1]["field"]) == ("๓", "๑๒", "ก", None, None)


def test_relative_paths(spark):
    files = lambda *paths: spark.createDataFrame(list(enumerate(paths)), "ord int, path string")
    new = files("x.pdf", "/x.pdf", "a/../x.pdf", "../x.pdf", "../a/../x.pdf", "/../y.PDF", "./b//c.pdf", "n.txt", None)
    assert got(model.add_files(files("b/c.pdf"), new), "path") == [("../x.pdf",), ("/../y.PDF",), ("/x.pdf",), ("x.pdf",)]
    assert got(model.add_files(files("/b/c.pdf"), new, folder="/"), "path") == [("/../y.PDF",), ("x.pdf",)]

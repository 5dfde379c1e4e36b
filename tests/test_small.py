"""Small functions and operators on literal cases: those that no query runs."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import edits, flow, pages, relate, search


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_numbers(spark):
    r = one(spark, rgb=T.rgb(F.lit(0xFF8000)), black=T.rgb(F.lit(0)), emu=T.emus(F.lit(1.5)), half=T.half_points(F.lit(12.25)), hidden=T.emus(F.lit(None).cast("double")))
    assert [round(x, 4) for x in r["rgb"]] == [1.0, 0.502, 0.0] and r["black"] == [0.0, 0.0, 0.0]
    assert (r["emu"], r["half"], r["hidden"]) == (19050, 24, None)


def test_font_names(spark):
    names = {"TimesNewRomanPSMT": "Times New Roman", "ABCDEF+OpenSans-Bold": "Open Sans", "HTMLFont_One": "HTML Font One", "MyFontMT,Italic": "My Font", "MT": T.DEFAULT_FONT, "": T.DEFAULT_FONT, "THSarabunNew-BoldItalic": "TH Sarabun New", "arialboldboldboldboldboldbold": "Arial", "Bold": "Bold", "a  b__C": "a b C"}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r["name"]: r["f"] for r in df.select("name", T.font_family("name").alias("f")).collect()} == names
    r = one(spark, key=T.font_key(F.lit("TH Sarabun-New ๙!")), shown=T.display_name(F.lit("TH_Sarabun--New  x ")), none=T.font_key(F.lit(None).cast("string")))
    assert (r["key"], r["shown"], r["none"]) == ("thsarabunnew๙", "TH Sarabun New x", "")
    covers = lambda t: T.font_covers(F.array(F.lit("a"), F.lit("b")), F.lit(t))
    assert tuple(one(spark, yes=covers("a b\n"), no=covers("abc"), empty=covers(""))) == (True, False, True)


def test_pages_as_html_and_addresses(spark):
    df = spark.createDataFrame([(1, 1, "two\nlines"), (1, 0, "a < b & c"), (2, 0, None)], "doc_id long, page_no int, text string")
    found = {r["doc_id"]: r["html"] for r in search.to_html(df).collect()}
    assert found[1].index("a &lt; b &amp; c") < found[1].index("<p>two</p><p>lines</p>") and found[1].count('<div class="page">') == 2
    assert found[2].endswith('<div class="page"><p></p></div></body></html>')
    web = spark.createDataFrame([(1, '<a href="https://a.example/x">https://a.example/x</a> see https://b.example/y and https://b.example/y <script>https://c.example</script>'), (2, None)], "page_id long, html string")
    assert got(search.unlinked_urls(web), "page_id", "uri") == [(1, "https://b.example/y")]


def test_glyphs_that_a_font_knows_otherwise(spark):
    """Four of five signs agree: the font is believed where the other says a blank; a run with which it mostly disagrees keeps its own."""
    glyphs = spark.createDataFrame([(1, i, i, cp) for i, cp in enumerate((65, 66, 67, 68, 0x20))] + [(2, 0, 0, 70), (2, 1, 1, 71), (2, 2, 4, 0x20)], "run int, ord int, gid int, cp int")
    fonts = spark.createDataFrame([("own", 0, i, 65 + i) for i in range(4)] + [("own", 0, 4, 0x0E32), ("own", 0, 4, 0x41), ("other", 1, 0, 1)], "font string, font_ord int, gid int, cp int")
    assert got(relate.glyph_fixes(glyphs, fonts), "run", "ord", "cp", "fixed") == [(1, 4, 0x20, 0x0E32)]


def test_versions(spark):
    key = spark.range(1).select(pages.version_key(F.lit("/a/b.pdf")).alias("k")).first()["k"]
    names = [f"{key}__20240102_030405.pdf", f"{key}__20250102_030405.pdf", f"{key}__20241399_000000.pdf", "other__20240102_030405.pdf"]
    assert [r["name"] for r in pages.list_versions(spark.createDataFrame([(n,) for n in names], "name string"), "/a/b.pdf").collect()] == names[1::-1]


CELL = "doc_id long, para_no int, row_no int, cell_no int, x0 double, x1 double, left double, right double, runs array<struct<key:string,text:string>>"


def paragraph(spark, *rows, no=0):
    """rows: a list of cells (x0, x1, runs) for each row; margins at 100 and 500."""
    cells = [(1, no, r, c, float(x0), float(x1), 100.0, 500.0, runs) for r, row in enumerate(rows) for c, (x0, x1, runs) in enumerate(row)]
    return flow.flowed(spark.createDataFrame(cells, CELL)).first()


def pieces(r):
    return [(x["key"], x["text"]) for x in r["runs"]]


def test_runs_and_tabs(spark):
    r = paragraph(spark, [(100, 200, [("a", " Name "), ("b", "x")]), (250, 300, [("c", "Value")])], [(100, 200, [("d", "next ")])])
    assert pieces(r) == [("a", "Name "), ("b", "x"), ("c", "\t"), ("c", "Value"), ("d", " "), ("d", "next")]
    assert [tuple(t) for t in r["tabs"]] == [(150.0, "left", None)] and r["align"] == "left"
    thai = paragraph(spark, [(100, 500, [("a", "ภาษา")])], [(100, 300, [("b", "ไทย")])])
    assert pieces(thai) == [("a", "ภาษา"), ("b", "ไทย")]
    assert paragraph(spark, [(100, 200, [("a", "  ")])], [(100, 200, [])]) is None


def test_contents_entry(spark):
    """The dots, over two runs, become a tab to the right margin that draws dots."""
    r = paragraph(spark, [(100, 500, [("a", "Chapter 1 ...."), ("b", "..... "), ("c", "12")])])
    assert pieces(r) == [("a", "Chapter 1\t"), ("c", "12")]
    assert [tuple(t) for t in r["tabs"]] == [(400.0, "right", "dot")]


def test_alignment(spark):
    text = [("a", "some text")]
    row = lambda x0, x1, runs=text: [(x0, x1, runs)]
    assert paragraph(spark, row(200, 400), row(220, 380))["align"] == "center"
    assert paragraph(spark, row(400, 498))["align"] == "right"
    assert paragraph(spark, row(120, 500), row(100, 499), row(100, 300))["align"] == "both"
    thai = [("a", "ภาษาไทยทั้งหมด")]
    assert paragraph(spark, row(100, 500, thai), row(100, 499, thai), row(100, 300, thai))["align"] == "thaiDistribute"
    assert paragraph(spark, row(100, 500), row(100, 480), row(100, 300))["align"] == "left"
    first = paragraph(spark, row(140, 500), row(110, 480))
    assert (first["left_indent"], first["first_indent"]) == (10.0, 30.0)
    hanging = paragraph(spark, row(100, 500, [("a", "1."), ("b", "   text")]), row(130, 480))
    assert (hanging["left_indent"], hanging["first_indent"]) == (30.0, -30.0) and pieces(hanging)[:2] == [("a", "1."), ("b", "\ttext")]


BOX = "x0 double, y0 double, x1 double, y1 double"


def test_verified_moves(spark):
    """The span that moved may miss its place by 1.5; another that changed, went or came, or one that isn't where it should be, fails its page only."""
    spans = lambda *rows: spark.createDataFrame([(1, p, o, t, x, 0.0, x + 10, 9.0) for p, o, t, x in rows], f"doc_id long, page_no int, ord int, text string, {BOX}")
    before = spans(*[(p, o, t, 20.0 * o) for p in range(7) for o, t in enumerate(["a", "b", "a"])])
    moves = spark.createDataFrame([(1, p, 0, 5.0, 0.0) for p in range(6)] + [(1, 6, 9, 5.0, 0.0)], "doc_id long, page_no int, ord int, dx double, dy double")
    rest = [(1, "b", 20.0), (2, "a", 40.0)]
    after = {0: [(0, "a", 6.4), *rest], 1: [(0, "a", 6.6), *rest], 2: [(0, "a", 5.0), (1, "b", 20.04), rest[1]], 3: [(0, "a", 5.0), (1, "b", 20.2), rest[1]], 4: [(0, "a", 5.0), rest[1]], 5: [(0, "a", 5.0), *rest, rest[1]], 6: [(0, "a", 0.0), *rest]}
    found = edits.verified_moves(before, spans(*[(p, *s) for p, own in after.items() for s in own]), moves)
    assert got(found, "page_no", "verified") == [(0, True), (1, False), (2, True), (3, False), (4, False), (5, False), (6, False)]


def test_undo_and_redo(spark):
    """Each log with what is left after it: an edit forgets what could be redone; only the last ones can be undone."""
    logs = {"oe": ("2", 1, 0), "oeu": ("1", 0, 1), "oeur": ("2", 1, 0), "oeuer": ("4", 1, 0), "ouru": ("1", 0, 0), "oeeee": ("5", 2, 0), "oeeeeuuuu": ("3", 0, 2), "oeo": ("3", 0, 0), "e": ("1", 0, 0), "u": (None, 0, 0)}
    names = {"o": "open", "e": "edit", "u": "undo", "r": "redo"}
    rows = [(i, n, names[c], str(n)) for i, log in enumerate(logs) for n, c in enumerate(log, 1)]
    found = edits.undone(spark.createDataFrame(rows, "doc_id int, n int, action string, version string").repartition(3), most=2)
    assert {r["doc_id"]: (r["version"], r["can_undo"], r["can_redo"]) for r in found.collect()} == dict(enumerate(logs.values()))


def test_shrink_plan(spark):
    """(pixels, shown width, bytes) and what becomes of them at 150 dpi: the first reason counts; grey ones are made whatever their size."""
    cases = [((1000, 1000, 100.0, 50_000), None), ((200, 200, 100.0, 20_000), "fine"), ((200, 200, 100.0, 30_000), None), ((99, 100, 10.0, 99), "small"), ((3000, 1000, 0.0, 20_000), None), ((1000, 1755, 1.0, 20_000), "fine"), ((1000, 1000, 100.0, 0), "empty")]
    df = spark.createDataFrame([(i, *c, False, False, False, 8) for i, (c, _) in enumerate(cases)] + [(90, 500, 500, 9.0, 99_999, False, True, True, 1), (91, 500, 500, 9.0, 99_999, False, False, True, 1), (92, 500, 500, 9.0, 99_999, True, True, True, 1), (93, 500, 500, 9.0, 99_999, False, False, False, 1)], "id int, px_w int, px_h int, shown_pt double, stored long, soft_mask boolean, mask boolean, stencil boolean, bits int")
    assert {r["id"]: r["skip"] for r in edits.shrink_plan(df, 150, 24 * 1024).collect()} == {i: why for i, (_, why) in enumerate(cases)} | {90: "mask", 91: "stencil", 92: "smask", 93: "bitonal"}
    assert {r["skip"] for r in edits.shrink_plan(df, 150, 24 * 1024, grayscale=True).where("id = 1").collect()} == {None}

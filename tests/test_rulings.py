"""Ruled tables, reachability and components: literal cases, brute force, nulls and empty tables."""

import random

import pytest

from quire.operators import iterate, rulings

DRAWN = "doc_id long, page_no int, kind string, stroked boolean, x0 double, y0 double, x1 double, y1 double"
CELL = "doc_id long, page_no int, table_no int, x0 double, y0 double, x1 double, y1 double"


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def line(x0, y0, x1, y1, page=0):
    return (1, page, "line", True, float(x0), float(y0), float(x1), float(y1))


def fill(x0, y0, x1, y1, page=0, stroked=False):
    return (1, page, "rect", stroked, float(x0), float(y0), float(x1), float(y1))


def boxes(df):
    return [tuple(map(float, r)) for r in got(df, "x0", "y0", "x1", "y1")]


def test_merged_cell_and_snapped_lines(spark):
    """Three rows of two columns, the middle one a cell over both; lines in pieces, off by up to 1.5, one broken by a gap of 2."""
    drawn = [line(0, 0, 50, 0), line(52, 1, 100, 1), line(0, 20.5, 100, 20.5), line(0, 40, 100, 41 - 0.8), line(0, 60, 100, 60), line(0, 0, 0, 60), line(101, 0, 101, 60), line(50, 0, 50, 20), line(50.5, 40, 50.5, 60)]
    found = rulings.tables(spark.createDataFrame(drawn, DRAWN))
    assert len(boxes(found)) == 5 and {r["table_no"] for r in found.collect()} == {0}
    assert (0.0, 20.5, 101.0) in {b[:2] + b[2:3] for b in boxes(found)}  # the merged one
    assert len({r["x0"] for r in found.collect()}) == 2


def test_what_is_no_table(spark):
    """One column, open corners, slanted lines, stubs, nulls and nothing at all."""
    one_column = [line(0, 0, 50, 0), line(0, 20, 50, 20), line(0, 0, 0, 20), line(50, 0, 50, 20)]
    open_corner = [line(0, 0, 90, 0), line(0, 20, 40, 20), line(0, 0, 0, 20), line(90, 0, 90, 20), line(45, 0, 45, 10)]
    odd = [line(0, 0, 50, 30), line(0, 0, 2, 0), (1, 0, "line", None, None, 0.0, 5.0, 0.0), (1, 0, "curve", True, 0.0, 0.0, 9.0, 9.0)]
    for drawn in (one_column, open_corner, odd, []):
        assert boxes(rulings.tables(spark.createDataFrame(drawn, DRAWN))) == []


def test_tables_apart_and_side_by_side(spark):
    """Two tables that share no corner under one long rule, and one on the next page: numbers from the top, then the left."""
    grid = lambda x, y, page=0: [line(x, y, x + 80, y, page), line(x, y + 20, x + 80, y + 20, page), *[line(x + i * 40, y, x + i * 40, y + 20, page) for i in range(3)]]
    drawn = [*grid(0, 100), *grid(200, 100), line(0, 100, 300, 100), *grid(0, 300), *grid(5, 5, page=1)]
    found = rulings.tables(spark.createDataFrame(drawn, DRAWN))
    assert got(found.groupBy("page_no", "table_no").count(), "page_no", "table_no", "count") == [(0, 0, 2), (0, 1, 2), (0, 2, 2), (1, 0, 2)]
    assert {r["table_no"]: r["x0"] for r in found.where("page_no = 0 AND y0 = 100").groupBy("table_no").min("x0").withColumnRenamed("min(x0)", "x0").collect()} == {0: 0.0, 1: 200.0}


def test_strict_and_plain(spark):
    """Filled shapes give edges to the plain strategy only; stroked ones to both."""
    shapes = [fill(0, 0, 40, 20), fill(40, 0, 80, 20)]
    drawn = spark.createDataFrame(shapes, DRAWN)
    assert boxes(rulings.tables(drawn)) == [] and boxes(rulings.tables(drawn, strict=False)) == [(0, 0, 40, 20), (40, 0, 80, 20)]
    assert len(boxes(rulings.tables(spark.createDataFrame([(*s[:3], True, *s[4:]) for s in shapes], DRAWN)))) == 2


def test_plain_tables_take_no_rounds(spark, monkeypatch):
    """Edges of full grids are exchanged once and their cells linked within pages, without rounds; rows of no page give none."""
    monkeypatch.setattr(rulings, "components", lambda pairs: pytest.fail("rounds of components"))
    drawn = [line(0, 20 * i, 150, 20 * i, page) for page in range(3) for i in range(5)] + [line(50 * j, 0, 50 * j, 80, page) for page in range(3) for j in range(4)]
    nowhere = [(None, *r[1:]) for r in drawn]
    found = rulings.tables(spark.createDataFrame(drawn + nowhere, DRAWN))
    assert got(found.groupBy("page_no", "table_no").count(), "page_no", "table_no", "count") == [(page, 0, 12) for page in range(3)]
    edges = rulings.crossings(rulings.ruled(rulings.edges(spark.createDataFrame(drawn, DRAWN))))
    plan = edges._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange ") == 1


def test_cells_linked_by_corners(spark):
    """Random cells, many of which meet at one corner only, and a staircase: as a search over all corners links them."""
    draw = random.Random(11)
    rows = [(1, page, 20.0 * x, 20.0 * y, 20.0 * x + 20, 20.0 * y + 20) for page in range(6) for x in range(12) for y in range(12) if draw.random() < 0.45]
    rows += [(1, 9, 20.0 * i, 20.0 * i, 20.0 * i + 20, 20.0 * i + 20) for i in range(30)]
    corners = lambda r: [(r[1], x, y) for x in (r[2], r[4]) for y in (r[3], r[5])]
    of = {r: (r[3], r[2]) for r in rows}
    while True:
        least = {}
        for r, label in of.items():
            for c in corners(r):
                least[c] = min(label, least.get(c, label))
        if (after := {r: min(least[c] for c in corners(r)) for r in rows}) == of:
            break
        of = after
    found = rulings._joined(spark.createDataFrame(rows, "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double"))
    assert {(*r[:6],): tuple(r["table"]) for r in found.collect()} == of


def test_header_rows(spark):
    """The topmost of two shaded rows above is taken, as the table then begins there; rows below follow one another; a plain table over less than half gives none."""
    strict = [(1, 0, 0, 0.0, 40.0, 50.0, 60.0), (1, 0, 0, 50.0, 40.0, 100.0, 60.0)]
    plain = [(1, 0, 0, x, y, x + 50, y + 20) for y in (0.0, 20.0, 40.0, 60.0, 80.0) for x in (0.0, 50.0)]
    apart = [(1, 0, 1, 300.0, 20.0, 400.0, 40.0), (1, 2, 0, 5.0, 5.0, 9.0, 9.0)]
    found = rulings.with_headers(spark.createDataFrame(strict, CELL), spark.createDataFrame(plain + apart, CELL))
    assert got(found.where("page_no = 0").select("y0", "table_no").distinct(), "y0", "table_no") == [(0.0, 0), (40.0, 0), (60.0, 0), (80.0, 0)]
    assert got(found.where("page_no = 2"), "x0") == [(5.0,)]
    one = rulings.with_headers(spark.createDataFrame(strict, CELL), spark.createDataFrame([p for p in plain if p[4] in (20.0, 40.0)], CELL))
    assert sorted({r["y0"] for r in one.collect()}) == [20.0, 40.0]
    assert rulings.with_headers(spark.createDataFrame([], CELL), spark.createDataFrame(plain, CELL)).count() == 10


def wanted_cells(edges):
    """The least closed rectangle at each crossing, by all pairs of edges: (across, pos, low, high)."""
    across, down = [e for e in edges if e[0]], [e for e in edges if not e[0]]
    at = {(i, j) for i, h in enumerate(across) for j, v in enumerate(down) if h[2] - 3 <= v[1] <= h[3] + 3 and v[2] - 3 <= h[1] <= v[3] + 3}
    out = []
    for i, j in at:
        best = [(across[k][1], down[m][1]) for k, m in at if across[k][1] > across[i][1] and down[m][1] > down[j][1] and (i, m) in at and (k, j) in at]
        if best:
            out.append((down[j][1], across[i][1], min(best)[1], min(best)[0]))
    return sorted(out)


def test_cells_against_all_pairs(spark):
    """Random rules on a coarse raster, with many merged and open cells."""
    draw = random.Random(7)
    rows, wanted = [], []
    for page in range(25):
        edges = []
        for pos in range(0, 200, 20):
            for across in (True, False):
                if draw.random() < 0.9:
                    low = 20.0 * draw.randrange(0, 5)
                    edges.append((across, float(pos), low, low + 20.0 * draw.randrange(1, 9)))
        rows += [(1, page, "line", True, *((lo, p, hi, p) if a else (p, lo, p, hi))) for a, p, lo, hi in edges]
        wanted += [(page, *c) for c in wanted_cells(edges)]
    found = rulings.cells(rulings.crossings(rulings.ruled(rulings.edges(spark.createDataFrame(rows, DRAWN)))))
    assert got(found, "page_no", "x0", "y0", "x1", "y1") == sorted(wanted)


SPAN = "doc_id long, page_no int, ord long, x0 double, y0 double, x1 double, y1 double"


def shrunk(b, dx, dy):
    x0, y0, x1, y1 = b
    return b if x0 + dx >= x1 - dx or y0 + dy >= y1 - dy else (x0 + dx, y0 + dy, x1 - dx, y1 - dy)


def wanted_victims(spans, targets):
    core = {o: shrunk(b, min(0.6, (b[2] - b[0]) * 0.1), (b[3] - b[1]) * 0.18) for o, b in spans.items()}
    risk = {o: shrunk(b, 0.3, (b[3] - b[1]) * 0.05) for o, b in spans.items()}
    meet = lambda a, b: a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]
    out = []
    for t in targets:
        members = {t: 0}
        while new := {o: max(members.values()) + 1 for o in spans if o not in members and any(meet(core[m], risk[o]) for m in members)}:
            members |= new
        out += [(t, o, n) for o, n in members.items()]
    return sorted(out)


def test_victims_of_random_boxes(spark):
    draw = random.Random(3)
    spans = {}
    for o in range(150):
        x, y = draw.uniform(0, 600), draw.uniform(0, 800)
        spans[o] = (x, y, x + draw.uniform(5, 120), y + draw.uniform(4, 40))
    rows = [(1, 0, o, *b) for o, b in spans.items()] + [(1, 1, o, *b) for o, b in spans.items()] + [(1, 0, 999, None, 1.0, 2.0, 3.0)]
    targets = [0, 5, 17, 60]
    found = rulings.victims(spark.createDataFrame(rows, SPAN), spark.createDataFrame([(1, 0, t) for t in [*targets, 999, 12345]], "doc_id long, page_no int, target long"))
    assert got(found, "target", "ord", "hop") == wanted_victims(spans, targets)
    assert {r["page_no"] for r in found.collect()} == {0}


def test_victims_of_a_chain(spark):
    """Fifty boxes, each over the edge of the next: fifty rounds, and nothing before the target, as risk and core are directed."""
    rows = [(1, 0, i, i * 10.0, 0.0, i * 10.0 + 11, 10.0) for i in range(50)] + [(1, 0, 99, 0.0, 500.0, 5.0, 505.0)]
    found = got(rulings.victims(spark.createDataFrame(rows, SPAN), spark.createDataFrame([(1, 0, 0)], "doc_id long, page_no int, target long")), "ord", "hop")
    assert found == [(i, i) for i in range(50)]
    assert rulings.victims(spark.createDataFrame([], SPAN), spark.createDataFrame([(1, 0, 0)], "doc_id long, page_no int, target long")).count() == 0


@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty"])
def test_components(spark, kind):
    draw = random.Random(1)
    pairs = {"random": [(draw.randrange(400), draw.randrange(400)) for _ in range(260)], "chain": [(i + 1, i) for i in range(60)], "star": [(7, i) for i in range(300)] + [(500, 500)], "empty": []}[kind]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got(iterate.components(spark.createDataFrame(pairs, "a long, b long")), "node", "component") == sorted(root.items())

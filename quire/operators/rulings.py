"""Tables from ruling lines, and deletions that harm what lies around: geometry by equi-joins.

Edges of a page are snapped to common positions and joined where they touch. A crossing of a horizontal and a vertical
edge is found through the grid cell in which it lies: a horizontal edge is listed under every cell along it, a vertical
one likewise, and as a crossing has one place, it lies in one cell only. A cell of a table is the smallest rectangle to
the right and below a crossing whose four corners are crossings of the same two horizontal and two vertical edges; cells
that share a corner are one table. Everything is by page, and no step compares all lines or boxes of a page with each other.

Edges are exchanged once, by page; what follows up to the tables sorts and groups within the pages of a partition. Only what
that leaves open, on few pages, is joined and goes into rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.grid import shuffled
from quire.operators.iterate import components, cut, reachable
from quire.operators.model import core_box, risk_box

PAGE = ["doc_id", "page_no"]
#: Fixed values, in points: edges so near are one position, ends so near are joined, edges shorter are none, crossings may miss by.
SNAP, JOIN, SHORTEST, MISS = 3.0, 3.0, 3.0, 3.0
#: Side of a grid cell.
GRID = 64.0


def edges(drawings: DataFrame, strict: bool = True) -> DataFrame:
    """doc_id, page_no, across (a horizontal edge), pos, low, high of drawings (kind line or rect, stroked, box).

    Lines give themselves, rectangles their sides: strict, only those that are stroked; else filled ones too. One that is
    as thin as SNAP is a line. Slanted lines give none.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    across = lambda y: F.struct(F.lit(True).alias("across"), y.alias("pos"), F.col("x0").alias("low"), F.col("x1").alias("high"))
    down = lambda x: F.struct(F.lit(False).alias("across"), x.alias("pos"), F.col("y0").alias("low"), F.col("y1").alias("high"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    line = F.when(h <= 0.5, F.array(across((y0 + y1) / 2))).when(w <= 0.5, F.array(down((x0 + x1) / 2)))
    rect = F.when(h <= SNAP, F.array(across((y0 + y1) / 2))).when(w <= SNAP, F.array(down((x0 + x1) / 2))).otherwise(F.array(across(y0), across(y1), down(x0), down(x1)))
    kept = drawings.where((F.col("kind") == "line") | F.coalesce("stroked", F.lit(False))) if strict else drawings
    found = kept.select(*PAGE, F.explode(F.when(F.col("kind") == "line", line).when(F.col("kind") == "rect", rect)).alias("e")).select(*PAGE, "e.*")
    return found.where(F.col("pos").isNotNull() & F.col("low").isNotNull() & F.col("high").isNotNull())


def ruled(found: DataFrame) -> DataFrame:
    """edges() with pos snapped to the mean of a run of positions, each no more than SNAP from the next, and joined: doc_id, page_no, across, pos, low, high, edge (an id)."""
    line = [*PAGE, "across"]
    by_pos = Window.partitionBy(line).orderBy("pos")
    run = F.sum(F.when(F.col("pos") - F.lag("pos").over(by_pos) > SNAP, 1).otherwise(0)).over(by_pos.rangeBetween(Window.unboundedPreceding, 0))
    snapped = found.repartition(*PAGE).withColumn("_run", F.coalesce(run, F.lit(0)))
    snapped = snapped.withColumn("pos", F.avg("pos").over(Window.partitionBy(*line, "_run")))
    own = Window.partitionBy(*line, "_run").orderBy("low", "high")
    reach = F.max("high").over(own.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("low") - F.col("_reach") > JOIN, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    joined = snapped.withColumn("_reach", reach).withColumn("_part", part)
    joined = joined.groupBy(*line, "_run", "_part").agg(F.first("pos").alias("pos"), F.min("low").alias("low"), F.max("high").alias("high"))
    return joined.where(F.col("high") - F.col("low") >= SHORTEST).select(*line, "pos", "low", "high", F.xxhash64(*line, "_run", "_part").alias("edge"))


def _along(low: Column, high: Column) -> Column:
    """The grid cells that an interval meets."""
    return F.sequence(F.floor(low / GRID), F.floor(high / GRID))


def crossings(rules: DataFrame) -> DataFrame:
    """doc_id, page_no, x, y, h, v: where edges of ruled() cross or miss each other by MISS at most, with the edges' ids.

    The edges of a grid cell are held in two lists: they are few, as their positions and the gaps along one are over SNAP and JOIN apart.
    """
    low, high, across = F.col("low") - MISS, F.col("high") + MISS, F.col("across")
    listed = rules.where(F.col("doc_id").isNotNull() & F.col("page_no").isNotNull()).select(*PAGE, "across", F.struct("pos", low.alias("low"), high.alias("high"), "edge").alias("e"), F.floor(F.col("pos") / GRID).alias("_of"), F.explode(_along(low, high)).alias("_at"))
    listed = listed.select(*PAGE, "across", "e", F.when(across, F.col("_at")).otherwise(F.col("_of")).alias("_cx"), F.when(across, F.col("_of")).otherwise(F.col("_at")).alias("_cy"))
    held = listed.groupBy(*PAGE, "_cx", "_cy").agg(F.collect_list(F.when(across, F.col("e"))).alias("hs"), F.collect_list(F.when(~across, F.col("e"))).alias("vs"))
    met = held.select(*PAGE, F.explode("hs").alias("h"), "vs").select(*PAGE, "h", F.explode("vs").alias("v"))
    met = met.where(F.col("v.pos").between(F.col("h.low"), F.col("h.high")) & F.col("h.pos").between(F.col("v.low"), F.col("v.high")))
    return met.select(*PAGE, F.col("v.pos").alias("x"), F.col("h.pos").alias("y"), F.col("h.edge").alias("h"), F.col("v.edge").alias("v"))


def cells(found: DataFrame) -> DataFrame:
    """doc_id, page_no, x0, y0, x1, y1: the smallest closed rectangle to the right and below each crossing that has one.

    A corner to the right must go on downward, one below must go on to the right. Most cells are closed by the next such
    corners; only where these don't meet in a crossing are the later ones tried, nearest below first, then nearest right.
    """
    by_h, by_v = Window.partitionBy(*PAGE, "h").orderBy("x"), Window.partitionBy(*PAGE, "v").orderBy("y")
    ends = found.withColumn("_right", F.lead("x").over(by_h).isNotNull()).withColumn("_down", F.lead("y").over(by_v).isNotNull())
    next_right = F.first(F.when(F.col("_down"), F.struct("x", "v")), ignorenulls=True).over(by_h.rowsBetween(1, Window.unboundedFollowing))
    next_down = F.first(F.when(F.col("_right"), F.struct("y", "h")), ignorenulls=True).over(by_v.rowsBetween(1, Window.unboundedFollowing))
    ends = ends.withColumn("_r", next_right).withColumn("_d", next_down)
    # each crossing tells that it is there, and one with a next corner both ways asks for the crossing that closes them
    ask = F.struct("x", "y", "h", "v", F.col("_r.x").alias("x1"), F.col("_d.y").alias("y1"))
    asks = F.array(F.struct(F.col("h").alias("_h"), F.col("v").alias("_v"), F.when(F.lit(False), ask).alias("ask")), F.struct(F.col("_d.h").alias("_h"), F.col("_r.v").alias("_v"), F.when(F.col("_right") & F.col("_down") & F.col("_r").isNotNull() & F.col("_d").isNotNull(), ask).alias("ask")))
    told = ends.select(*PAGE, F.posexplode(asks).alias("_asks", "_e")).select(*PAGE, (F.col("_asks") == 1).alias("_asks"), "_e.*").where("NOT _asks OR ask IS NOT NULL")
    told = told.withColumn("_closed", F.max(~F.col("_asks")).over(Window.partitionBy(*PAGE, "_h", "_v")))
    quick = cut(told.where("_asks").select(*PAGE, "_closed", "ask.*"))
    done = quick.where("_closed").select(*PAGE, F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")
    left = quick.where("NOT _closed").select(*PAGE, "x", "y", "h", "v")
    if left.isEmpty():
        return done
    ends = cut(ends.join(shuffled(left.select(*PAGE).distinct()), PAGE, "left_semi").select(*PAGE, "x", "y", "h", "v", "_right", "_down"))
    corner = ends.select(*PAGE, F.col("h").alias("_h"), F.col("v").alias("_v"))
    right = ends.where("_down").select(*PAGE, "h", F.col("v").alias("_v"), F.col("x").alias("x1"))
    below = ends.where("_right").select(*PAGE, "v", F.col("h").alias("_h"), F.col("y").alias("y1"))
    tried = left.join(below, [*PAGE, "v"]).where("y1 > y").join(right, [*PAGE, "h"]).where("x1 > x").join(corner, [*PAGE, "_h", "_v"], "left_semi")
    late = tried.groupBy(*PAGE, "x", "y").agg(F.min(F.struct("y1", "x1")).alias("_m")).select(*PAGE, F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("_m.x1").alias("x1"), F.col("_m.y1").alias("y1"))
    return done.unionByName(late).repartition(*PAGE)


def _linked(found: DataFrame) -> DataFrame:
    """Cells with table, the top left corner of a cell that they are linked to: runs of cells along rows, columns and rows again share the least of theirs."""
    out = found.withColumn("table", F.struct("y0", "x0"))
    for line, low, high in (("y0", "x0", "x1"), ("x0", "y0", "y1"), ("y0", "x0", "x1")):
        along = Window.partitionBy(*PAGE, line).orderBy(low, high)
        run = F.sum(F.when(F.lag(high).over(along) == F.col(low), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("_run", run).withColumn("table", F.min("table").over(Window.partitionBy(*PAGE, line, "_run"))).drop("_run")
    return out


def _joined(found: DataFrame) -> DataFrame:
    """Cells with table, the same for all that corners link, and no others: rounds take what differs at a corner after _linked()."""
    linked = cut(_linked(found))
    corners = linked.select(*PAGE, "table", F.explode(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("x0", "x1") for y in ("y0", "y1")))).alias("_c"))
    least = corners.withColumn("_least", F.min("table").over(Window.partitionBy(*PAGE, "_c")))
    open_ = cut(least.where("table <> _least").select(*PAGE, "table", "_least").distinct())
    if open_.isEmpty():
        return linked
    nodes = open_.select(*PAGE, "table").union(open_.select(*PAGE, F.col("_least").alias("table"))).distinct()
    nodes = cut(nodes.withColumn("_id", F.monotonically_increasing_id()))
    pairs = open_.join(shuffled(nodes.withColumnRenamed("_id", "a")), [*PAGE, "table"]).join(shuffled(nodes.withColumnsRenamed({"table": "_least", "_id": "b"})), [*PAGE, "_least"])
    of = nodes.join(shuffled(components(pairs.select("a", "b")).withColumnRenamed("node", "_id")), "_id")
    of = of.withColumn("_whole", F.min("table").over(Window.partitionBy("component"))).select(*PAGE, "table", "_whole")
    return linked.join(shuffled(of), [*PAGE, "table"], "left").withColumn("table", F.coalesce("_whole", "table")).select(linked.columns).repartition(*PAGE)


def tables(drawings: DataFrame, strict: bool = True) -> DataFrame:
    """doc_id, page_no, table_no (from the top, then the left), x0, y0, x1, y1 of the cells of tables of two columns or more."""
    placed = _joined(cells(crossings(ruled(edges(drawings, strict)))))
    own = Window.partitionBy(*PAGE, "table")
    wide = placed.withColumn("_wide", F.min("x0").over(own) < F.max("x0").over(own)).where("_wide")
    # what follows reads tables more than once
    return cut(wide.withColumn("table_no", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("table")) - 1).select(*PAGE, "table_no", "x0", "y0", "x1", "y1"))


def _boxes(found: DataFrame, by: list[str]) -> DataFrame:
    ends = {"x0": F.min("x0"), "y0": F.min("y0"), "x1": F.max("x1"), "y1": F.max("y1")}
    return found.groupBy(*by).agg(*(f.alias(c) for c, f in ends.items() if c not in by))


def with_headers(strict: DataFrame, plain: DataFrame) -> DataFrame:
    """Cells of tables(): the strict ones, and to each the rows of plain tables over half of it that lie above or below; on pages without strict tables the plain ones.

    A row is taken if it ends at the table's top, or begins at its bottom, within 2 points, where the table has grown by
    the rows taken before: tables in their order, rows from the top.
    """
    rows = _boxes(plain, [*PAGE, "table_no", "y0"])
    table = Window.partitionBy(*PAGE, "table_no")
    rows = rows.withColumn("whole", F.struct(*(f(c).over(table).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1")))))
    offered = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("table_no", "y0", "x0", "x1", "y1", "whole"))).alias("rows"))
    own = _boxes(strict, [*PAGE, "table_no"]).join(offered, PAGE, "left")
    wide = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])

    def shared(a: Column, b: Column) -> Column:
        side = lambda low, high: F.greatest(F.least(a[high], b[high]) - F.greatest(a[low], b[low]), F.lit(0.0))
        return side("x0", "x1") * side("y0", "y1")

    def take(acc: Column, row: Column) -> Column:
        box = acc["box"]
        over = F.when(acc["of"] == row["table_no"], acc["over"]).otherwise(shared(row["whole"], box) >= 0.5 * wide(box))
        taken = over & ((row["y1"] <= box["y0"] + 2) | (row["y0"] >= box["y1"] - 2))
        grown = F.struct(F.least(box["x0"], row["x0"]).alias("x0"), F.least(box["y0"], row["y0"]).alias("y0"), F.greatest(box["x1"], row["x1"]).alias("x1"), F.greatest(box["y1"], row["y1"]).alias("y1"))
        kept = F.when(taken, F.concat(acc["kept"], F.array(F.struct(row["table_no"].alias("of"), row["y0"].alias("y0"))))).otherwise(acc["kept"])
        return F.struct(F.when(taken, grown).otherwise(box).alias("box"), row["table_no"].alias("of"), over.alias("over"), kept.alias("kept"))

    begin = F.struct(F.struct("x0", "y0", "x1", "y1").alias("box"), F.lit(-1).alias("of"), F.lit(False).alias("over"), F.array().cast("array<struct<of:int,y0:double>>").alias("kept"))
    chosen = own.select(*PAGE, "table_no", F.explode(F.aggregate(F.coalesce("rows", F.array().cast(offered.schema["rows"].dataType)), begin, take, lambda a: a["kept"])).alias("k"))
    chosen = chosen.select(*PAGE, F.col("table_no").alias("_own"), F.col("k.of").alias("table_no"), F.col("k.y0").alias("y0"))
    added = plain.join(chosen, [*PAGE, "table_no", "y0"]).withColumn("table_no", F.col("_own")).select(strict.columns)
    alone = plain.join(strict.select(*PAGE).distinct(), PAGE, "left_anti")
    return strict.unionByName(added).unionByName(alone)


# --- deletions


def _listed(df: DataFrame, box: str) -> DataFrame:
    """df under every grid cell that its box meets."""
    side = lambda low, high: _along(F.col(f"{box}.{low}"), F.col(f"{box}.{high}"))
    return df.withColumn("_cx", F.explode(side("x0", "x1"))).withColumn("_cy", F.explode(side("y0", "y1")))


def harmed(spans: DataFrame) -> DataFrame:
    """doc_id, page_no, ord, _to_ord: deleting the core of span `ord` touches the risk box of the other one.

    Each pair is found in one grid cell, that of the upper left corner of what the two boxes share.
    """
    c = [F.col(x) for x in ("x0", "y0", "x1", "y1")]
    a = _listed(spans.select(*PAGE, "ord", core_box(*c).alias("_core")), "_core")
    b = _listed(spans.select(*PAGE, F.col("ord").alias("_to_ord"), risk_box(*c).alias("_risk")), "_risk")
    corner = lambda n: F.greatest(F.col(f"_core.{n}"), F.col(f"_risk.{n}"))
    meet = F.lit(True)
    for low, high in (("x0", "x1"), ("y0", "y1")):
        meet = meet & (corner(low) < F.least(F.col(f"_core.{high}"), F.col(f"_risk.{high}")))
    home = (F.floor(corner("x0") / GRID) == F.col("_cx")) & (F.floor(corner("y0") / GRID) == F.col("_cy"))
    return a.join(shuffled(b), [*PAGE, "_cx", "_cy"]).where((F.col("ord") != F.col("_to_ord")) & meet & home).select(*PAGE, "ord", "_to_ord")


def victims(spans: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, page_no, target, ord, hop: the spans that go when span `target` of targets is deleted, itself with hop 0, and in which round they were met."""
    whole = spans.where(F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull())
    edges_ = cut(harmed(whole).select(*PAGE, "ord", *[F.col(c).alias(f"_to_{c}") for c in PAGE], "_to_ord"))
    start = whole.join(targets.select(*PAGE, F.col("target").alias("ord")), [*PAGE, "ord"], "left_semi").withColumn("target", F.col("ord"))
    return reachable(start, edges_, [*PAGE, "ord"], ["target"])

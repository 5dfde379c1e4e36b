"""Paragraphs as a word processor has them: the runs of their lines joined, tab stops, alignment and indents.

A paragraph is the rows that layout.paragraphs() found, each of one or more cells; a cell has its runs, an array of
(key, text), where the key says how the text looks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import LEADER, LIST_ITEM, is_thai, joiner
from quire.operators.runs import spliced, stripped

PARA = ["doc_id", "para_no"]
#: What a list sign's pattern ends with, after the sign itself.
LIST_ITEM_END = r"\s"


def _text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def flowed(cells: DataFrame, indent: bool = True) -> DataFrame:
    """doc_id, para_no, runs, tabs, align, left_indent, first_indent of cells (doc_id, para_no, row_no, cell_no, x0, x1, left, right, runs).

    Between two cells of a row stands a tab, between rows what their ends ask for, both with the looks of what follows;
    cells without text are left out. tabs: (position from the left margin, kind, leader); the dots of a contents entry become
    a tab to the right margin, which draws dots. Without tabs a paragraph may be centred, right (one row), both, or
    thaiDistribute where over half of its characters are Thai. left_indent is that of the rows after the first, first_indent
    what the first has more (or less: then blanks after its list sign become a tab). A paragraph without text is left out.
    """
    cell = F.struct("row_no", "cell_no", "x0", "x1", F.filter("runs", lambda r: F.coalesce(r["text"], F.lit("")) != "").alias("runs"))
    paras = cells.groupBy(*PARA).agg(F.first("left").alias("left"), F.first("right").alias("right"), F.array_sort(F.collect_list(cell)).alias("_cells"))
    nothing = F.slice(F.flatten(F.transform("_cells", lambda c: c["runs"])), 1, 0)

    def step(acc: Column, c: Column) -> Column:
        own = _text(c["runs"])
        glue = F.when(c["cell_no"] > 0, "\t").when((c["row_no"] > 0) & (acc["text"] != ""), joiner(acc["text"], own)).otherwise("")
        between = F.when(glue != "", F.array(c["runs"][0].withField("text", glue))).otherwise(nothing)
        whole = F.struct(F.concat(acc["text"], glue, own).alias("text"), F.concat(acc["runs"], between, c["runs"]).alias("runs"))
        return F.when(F.size(c["runs"]) > 0, whole).otherwise(acc)

    joined = F.aggregate("_cells", F.struct(F.lit("").alias("text"), nothing.alias("runs")), step, lambda acc: acc["runs"])
    stop = lambda at, kind, leader: F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.lit(leader).cast("string").alias("leader"))
    stops = F.transform(F.filter("_cells", lambda c: (c["cell_no"] > 0) & (F.size(c["runs"]) > 0)), lambda c: stop(F.greatest(F.lit(0.0), c["x0"] - F.col("left")), "left", None))
    df = paras.withColumn("_runs", stripped(joined)).where(F.size("_runs") > 0).withColumns({"_full": _text(F.col("_runs")), "_stops": stops, "_width": F.greatest(F.lit(1.0), F.col("right") - F.col("left"))})

    # the dots of a contents entry, and where they begin
    dots = F.regexp_extract("_full", LEADER, 0)
    begin = F.length(F.split("_full", LEADER, 2)[0])
    entry = dots != ""
    df = df.withColumns({"_entry": entry, "_dots": F.length(dots), "_begin": begin})
    df = df.withColumn("_runs", F.when(F.col("_entry"), spliced(F.col("_runs"), F.col("_begin"), F.col("_begin") + F.col("_dots"), F.lit("\t"))).otherwise(F.col("_runs")))
    df = df.withColumn("tabs", F.when(F.col("_entry"), F.concat("_stops", F.array(stop(F.col("_width"), "right", "dot")))).otherwise(F.col("_stops")))

    first_of = lambda row: F.filter("_cells", lambda c: c["row_no"] == row)
    rows = F.transform(F.array_distinct(F.transform("_cells", lambda c: c["row_no"])), lambda n: F.struct(F.array_min(F.transform(F.filter("_cells", lambda c: c["row_no"] == n), lambda c: F.struct(c["cell_no"], c["x0"])))["x0"].alias("x0"), F.array_max(F.transform(first_of(n), lambda c: F.struct(c["cell_no"], c["x1"])))["x1"].alias("x1")))
    df = df.withColumn("_rows", rows)
    middle, width, right = (F.col("left") + F.col("right")) / 2, F.col("_width"), F.col("right")
    centred = (F.array_min(F.transform("_rows", lambda r: r["x0"])) > F.col("left") + 12) & F.forall("_rows", lambda r: F.abs((r["x0"] + r["x1"]) / 2 - middle) < F.greatest(F.lit(6.0), width * 0.02))
    n = F.size("_rows")
    at_right = (n == 1) & (F.col("_rows")[0]["x1"] > right - 6) & (F.col("_rows")[0]["x0"] > F.col("left") + width * 0.45)
    full = (n >= 3) & F.forall(F.slice("_rows", F.lit(1), F.greatest(n - 1, F.lit(0))), lambda r: r["x1"] > right - F.greatest(F.lit(2.5), width * 0.015))
    thai = F.size(F.filter(F.split("_full", ""), lambda c: is_thai(c))) > F.length("_full") / 2
    align = F.when(F.size("tabs") > 0, "left").when(centred, "center").when(at_right, "right").when(full, F.when(thai, "thaiDistribute").otherwise("both")).otherwise("left")
    after = F.coalesce(F.try_element_at("_rows", F.lit(2))["x0"], F.col("_rows")[0]["x0"])
    step_, indented = F.col("_rows")[0]["x0"] - after, F.lit(indent) & F.col("align").isin("left", "both", "thaiDistribute")
    df = df.withColumn("align", align)
    df = df.withColumns({"left_indent": F.when(indented & (after - F.col("left") > 2), after - F.col("left")), "first_indent": F.when(indented & (F.abs(step_) > 2), step_)})

    # the blanks after a list sign that hangs
    now = _text(F.col("_runs"))
    sign = F.length(F.regexp_extract(now, f"({LIST_ITEM.removesuffix(LIST_ITEM_END)})(?={LIST_ITEM_END})", 1))
    blanks = F.length(F.regexp_extract(F.substring(now, sign + 1, F.length(now)), "^ *", 0))
    hangs = (F.col("first_indent") < -2) & (sign > 0) & (blanks > 0)
    runs = F.when(F.coalesce(hangs, F.lit(False)), spliced(F.col("_runs"), sign, sign + blanks, F.lit("\t"))).otherwise(F.col("_runs"))
    return df.select(*PARA, runs.alias("runs"), "tabs", "align", "left_indent", "first_indent")

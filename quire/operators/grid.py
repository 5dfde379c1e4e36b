"""A grid on pages, so that joins by place compare only what lies in one cell: equal keys, and a filter on what is left.

Boxes are listed under every cell that they meet, points under the one they lie in. A point is thus met by a box once;
two boxes are met once if only the cell of the corner of what they share counts (see home). What has no place has no cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a cell in points: a page of text is some hundred cells.
SIDE = 64.0


def _number(at: Column) -> Column:
    return F.floor(at / SIDE)


def placed(df: DataFrame, x: Column | str, y: Column | str) -> DataFrame:
    """df with the cell of a point."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return df.withColumns({"_cx": _number(x), "_cy": _number(y)})


def centred(df: DataFrame) -> DataFrame:
    """Boxes with the cell of their centre."""
    return placed(df, (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)


def listed(df: DataFrame, slack: float = 0.0) -> DataFrame:
    """Boxes, a row for each cell that they meet with some slack around."""
    side = lambda low, high: F.when(F.col(high) + slack >= F.col(low) - slack, F.sequence(_number(F.col(low) - slack), _number(F.col(high) + slack)))
    return df.withColumn("_cx", F.explode(side("x0", "x1"))).withColumn("_cy", F.explode(side("y0", "y1")))


def shuffled(df: DataFrame) -> DataFrame:
    """df for the side of a join that is never broadcast: what is exploded is far larger than the planner takes it for."""
    return df.hint("merge")


def same_cell(a: str, b: str) -> Column:
    """Equal keys of two aliases: document, page, cell."""
    out = F.lit(True)
    for c in ("doc_id", "page_no", "_cx", "_cy"):
        out = out & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return out


def home(a: str, b: str) -> Column:
    """Whether this is the cell in which a pair of listed boxes counts: that of the upper left corner of what they share."""
    corner = lambda c: _number(F.greatest(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")))
    return (corner("x0") == F.col(f"{a}._cx")) & (corner("y0") == F.col(f"{a}._cy"))

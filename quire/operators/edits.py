"""Checks and logs of edits: whether a move touched only what it should, what undo and redo leave, which images may shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.relate import PAGE

#: States that can be undone, how far a moved text may miss its place, the pixels and longest page side (inches) of an image.
MOST_UNDO, MISS, LEAST_PIXELS, LONG_SIDE = 25, 1.5, 10_000, 11.7
_BOX = ["x0", "y0", "x1", "y1"]


def verified_moves(before: DataFrame, after: DataFrame, moves: DataFrame) -> DataFrame:
    """doc_id, page_no, ord, verified of moves (doc_id, page_no, ord, dx, dy): the span moved, and nothing else changed.

    before and after: spans (doc_id, page_no, ord, text, box) of the pages; boxes count to a tenth of a point. Of the spans
    after it, the first with the text of the moved one within MISS of its new place is taken for it; all others must be
    those before it, each as often. A move of a span that isn't there is not verified. One move of a page is judged.
    """
    rounded = lambda df: df.select(*PAGE, "ord", "text", *[F.bround(c, 1).alias(c) for c in _BOX])
    old, new = rounded(before), rounded(after)
    target = moves.join(old, [*PAGE, "ord"])
    near = F.lit(True)
    for c, d in zip(_BOX, ("dx", "dy", "dx", "dy"), strict=True):
        near = near & (F.abs(F.col(f"n.{c}") - (F.col(f"t.{c}") + F.col(f"t.{d}"))) <= MISS)
    same = (F.col("t.doc_id") == F.col("n.doc_id")) & (F.col("t.page_no") == F.col("n.page_no")) & F.col("t.text").eqNullSafe(F.col("n.text"))
    found = target.alias("t").join(new.alias("n"), same & near).groupBy("t.doc_id", "t.page_no", F.col("t.ord").alias("_move")).agg(F.min_by(F.struct(*[F.col(f"n.{c}") for c in ("text", *_BOX)]), "n.ord").alias("_m"))
    pages = moves.select(*PAGE).distinct()
    print_ = ["text", *_BOX]
    counted = lambda df, n: df.select(*PAGE, *print_, F.lit(n).alias("_n"))
    bag = counted(old.join(pages, PAGE, "left_semi"), 1).union(counted(target, -1)).union(counted(new.join(pages, PAGE, "left_semi"), -1)).union(counted(found.select(*PAGE, "_m.*"), 1))
    # counts are summed before they are shuffled; what is left over of a page is a few rows
    changed = bag.groupBy(*PAGE, *print_).agg(F.sum("_n").alias("_n")).where("_n <> 0").select(*PAGE).distinct().withColumn("_changed", F.lit(True))
    judged = moves.join(found.select(*PAGE, F.col("_move").alias("ord"), F.lit(True).alias("_moved")), [*PAGE, "ord"], "left").join(changed, PAGE, "left")
    return judged.select(*PAGE, "ord", (F.coalesce("_moved", F.lit(False)) & F.col("_changed").isNull()).alias("verified"))


def undone(log: DataFrame, most: int = MOST_UNDO) -> DataFrame:
    """doc_id, version, can_undo, can_redo after a log (doc_id, n, action, version) of open, edit, undo and redo.

    open begins anew with a version; edit makes version the state, keeps the state before it, of which the last `most` can be
    undone, and forgets what could be redone; undo and redo without anything to go to do nothing, as do other actions.
    """
    none = F.array().cast("array<string>")
    begin = F.struct(F.lit(None).cast("string").alias("now"), none.alias("back"), none.alias("on"))
    state = lambda now, back, on: F.struct(now.alias("now"), back.alias("back"), on.alias("on"))
    last, rest = (lambda a: F.try_element_at(a, F.lit(-1))), (lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))
    newest = lambda a: F.slice(a, F.greatest(F.size(a) - most + 1, F.lit(1)), F.lit(most))

    def step(s, x):  # type: ignore[no-untyped-def]
        do = x["action"]
        return (
            F.when(do == "open", state(x["version"], none, none))
            .when(do == "edit", state(x["version"], F.when(s["now"].isNull(), s["back"]).otherwise(newest(F.concat(s["back"], F.array(s["now"])))), none))
            .when((do == "undo") & (F.size(s["back"]) > 0), state(last(s["back"]), rest(s["back"]), F.concat(s["on"], F.array(s["now"]))))
            .when((do == "redo") & (F.size(s["on"]) > 0), state(last(s["on"]), F.concat(s["back"], F.array(s["now"])), rest(s["on"])))
            .otherwise(s)
        )

    own = F.sort_array(F.collect_list(F.struct("n", "action", F.col("version").cast("string").alias("version"))))
    walked = log.groupBy("doc_id").agg(F.aggregate(own, begin, step).alias("s"))
    return walked.select("doc_id", F.col("s.now").alias("version"), F.size("s.back").alias("can_undo"), F.size("s.on").alias("can_redo"))


def shrink_plan(images: DataFrame, dpi: int, floor: int, grayscale: bool = False) -> DataFrame:
    """images (px_w, px_h, shown_pt, stored, soft_mask, mask, stencil, bits) with scale and skip, why one is left alone, else null.

    shown_pt is how wide an image is shown, 1 or less where that isn't known: then its longer side is taken to fill a page.
    stored is its size in bytes: one that needs no fewer pixels is left alone if it is under the floor, unless it is to lose
    its colours.
    """
    known = F.lit(float(dpi)) * F.col("shown_pt") / (F.col("px_w") * 72.0)
    scale = F.least(F.lit(1.0), F.when(F.col("shown_pt") > 1, known).otherwise(F.lit(dpi * LONG_SIDE) / F.greatest("px_w", "px_h")))
    fine = (scale > 0.95) & (F.col("stored") < floor) & F.lit(not grayscale)
    reasons = {"smask": F.col("soft_mask"), "mask": F.col("mask"), "stencil": F.col("stencil"), "bitonal": F.col("bits") == 1, "empty": F.coalesce("stored", F.lit(0)) <= 0, "small": F.col("px_w") * F.col("px_h") < LEAST_PIXELS, "fine": fine}
    skip = F.coalesce(*(F.when(why, name) for name, why in reasons.items()))
    return images.withColumns({"scale": scale, "skip": skip})

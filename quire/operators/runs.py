"""Edits of a line's styled runs, and text broken into lines by the widths of a font.

Runs are an array of (key, text), where the key says how the text looks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """body(value), with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _placed(runs: Column) -> Column:
    """The runs, each with the place in the joined text where it begins, in one walk."""
    item = lambda begin, r: F.struct(begin.alias("begin"), F.coalesce(r["text"], F.lit("")).alias("own"), r.alias("run"))
    none = F.slice(F.transform(runs, lambda r: item(F.lit(0), r)), 1, 0)
    step = lambda a, r: F.struct((a["at"] + F.length(F.coalesce(r["text"], F.lit("")))).alias("at"), F.concat(a["out"], F.array(item(a["at"], r))).alias("out"))
    return F.aggregate(runs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])


def spliced(runs: Column, start: Column, end: Column, text: Column) -> Column:
    """runs with the characters from start to before end of their joined text replaced; the new text looks like the first run it meets.

    A run that is left without text goes. An empty range puts the text in only inside of a run.
    """
    meets = lambda p: ~((p["begin"] + F.length(p["own"]) <= start) | (p["begin"] >= end))

    def changed(placed: Column, first: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            left = F.substring(p["own"], F.lit(1), F.greatest(F.lit(0), start - p["begin"]))
            right = F.when(end < p["begin"] + F.length(p["own"]), F.substring(p["own"], end - p["begin"] + 1, F.length(p["own"]))).otherwise("")
            return F.when(meets(p), p["run"].withField("text", F.concat(left, F.when(i == first, text).otherwise(""), right))).otherwise(p["run"])

        return F.filter(F.transform(placed, piece), lambda r, i: ~meets(placed[i]) | (r["text"] != ""))

    return _let(_placed(F.array_compact(runs)), lambda placed: _let(F.array_position(F.transform(placed, meets), F.lit(True)) - 1, lambda first: changed(placed, first)))


def stripped(runs: Column) -> Column:
    """runs without the blanks at both ends of their joined text, and without the runs that held nothing else there."""
    shown = lambda r: F.trim(r["text"]) != ""
    ended = lambda kept: F.transform(kept, lambda r, i: r.withField("text", F.when(i == F.size(kept) - 1, F.rtrim(r["text"])).otherwise(r["text"])))
    begun = lambda kept: F.transform(kept, lambda r, i: r.withField("text", F.when(i == 0, F.ltrim(r["text"])).otherwise(r["text"])))

    def cut_ends(seen: Column) -> Column:
        first, last = F.array_position(seen, F.lit(True)), F.size(seen) - F.array_position(F.reverse(seen), F.lit(True)) + 1
        return F.when(F.array_contains(seen, True), _let(F.slice(runs, first, last - first + 1), lambda kept: begun(ended(kept)))).otherwise(F.slice(runs, 1, 0))

    return _let(F.transform(runs, lambda r: F.coalesce(shown(r), F.lit(False))), cut_ends)


def _breaks(text: str, units: Mapping[str, int], other: int, most: float) -> list[str]:
    """Lines of one text, none wider than `most` thousandths unless a single character is.

    Widths are whole numbers, so a line's is the difference of two prefix sums, and where it must end is found in them.
    """
    out: list[str] = []
    most = math.floor(most)
    for para in text.split("\n"):
        if not para:
            out.append("")
            continue
        words = para.split(" ")
        ends = np.cumsum([len(w) + 1 for w in words]) - 1  # of each word, in characters
        sums = np.concatenate([[0], np.cumsum([units.get(c, other) for c in para])])
        to_end = sums[ends]
        at, begin = 0, 0  # the word and the character that the line begins with
        while at < len(words):
            if begin == ends[at] and at + 1 < len(words):  # nothing at a line's beginning leaves no blank behind
                at, begin = at + 1, int(ends[at]) + 1
                continue
            fit = int(np.searchsorted(to_end, sums[begin] + most, side="right")) - at
            if fit > 0:  # this many words
                if int(ends[at + fit - 1]) > begin:
                    last = at + fit - 1
                    rest = last + 1 >= len(words)
                    out.append(para[begin : int(ends[last])])
                    at, begin = last + 1, int(ends[last]) + 1
                    if rest:
                        break
                    continue
                break
            # a word that is too wide is cut where it must be, at one character at least
            end = max(begin + 1, int(np.searchsorted(sums, sums[begin] + most, side="right")) - 1)
            if end >= int(ends[at]):
                out.append(para[begin : int(ends[at])])
                at, begin = at + 1, int(ends[at]) + 1
            else:
                out.append(para[begin:end])
                begin = end
    return out


def wrapped(df: DataFrame, units: Mapping[str, int], other: int = 500, text: str = "text", size: str = "size", width: str = "width") -> DataFrame:
    """df with lines: its text broken where the next word would be wider than width, at the size of its font.

    units: the width of each character in thousandths of the size, `other` for all else. A word wider than the line is
    broken between characters; an empty paragraph is an empty line; a null text, size or width gives null.
    """
    shared = df.sparkSession.sparkContext.broadcast(dict(units))  # as large as a font's table

    @F.pandas_udf("array<string>")
    def lines(texts: pd.Series, most: pd.Series) -> pd.Series:
        table = shared.value
        return pd.Series([None if t is None or pd.isna(m) else _breaks(t, table, other, m) for t, m in zip(texts, most, strict=True)], dtype=object)

    return df.withColumn("lines", lines(F.col(text), (F.col(width) * 1000 / F.col(size)).cast("double")))

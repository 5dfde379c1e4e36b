"""Differences of two versions of a document, word by word, and their marks on its pages.

Words that occur once on either side are paired, and of the pairs the longest sequence that ascends on both sides is kept:
these anchors cut both versions into gaps that are independent of each other. Within a gap other words occur once, so
it is cut again, ROUNDS times; what is left is aligned by the shortest edit script of each gap. All between two matches is one
change. Only numbers of words are ever gathered for a group, those of the pairs of a gap, or of the words of one.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.grid import shuffled
from quire.operators.iterate import cut

#: Times that gaps are cut by words that occur once in them; the most words that a gap's shortest script may take out and put in.
ROUNDS, MOST_EDITS = 2, 2000
LIMIT = 500
_MATCH = "doc_id long, a int, b int"


def page_words(pages: DataFrame) -> DataFrame:
    """doc_id, ord (in the document), page_no, word of pages (doc_id, page_no, text): what white space separates."""
    own = pages.select("doc_id", "page_no", F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: w != "").alias("_words"))
    before = F.sum(F.size("_words")).over(Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1))
    return own.withColumn("_before", F.coalesce(before, F.lit(0))).select("doc_id", "page_no", "_before", F.posexplode("_words").alias("_n", "word")).select("doc_id", (F.col("_before") + F.col("_n")).cast("int").alias("ord"), "page_no", "word")


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, of different numbers on either side, that ascends on both."""
    ends: list[int] = []  # the smallest b with which a sequence of that length ends
    last: list[int] = []  # and the pair that it belongs to
    link: list[int] = []
    pairs = sorted(pairs)
    for i, (_, b) in enumerate(pairs):
        n = bisect_left(ends, b)
        if n == len(last):
            ends[n:], last[n:] = [b], [i]
        else:
            ends[n], last[n] = b, i
        link.append(last[n - 1] if n else -1)
    out, at = [], last[-1] if last else -1
    while at >= 0:
        out.append(pairs[at])
        at = link[at]
    return out[::-1]


def _shortest(a: list[str], b: list[str], most: int = MOST_EDITS) -> list[tuple[int, int]]:
    """Matches of a shortest edit script, by the furthest places that each number of edits reaches; none if it takes more than `most`."""
    reach, trail = {1: 0}, []
    for edits in range(min(most, len(a) + len(b)) + 1):
        trail.append(dict(reach))
        for k in range(-edits, edits + 1, 2):
            x = reach[k + 1] if k == -edits or (k != edits and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= len(a) and x - k >= len(b):
                return _walked(trail, len(a), len(b))
    return []


def _walked(trail: list[dict[int, int]], x: int, y: int) -> list[tuple[int, int]]:
    out = []
    for edits in range(len(trail) - 1, -1, -1):
        reach, k = trail[edits], x - y
        before = k + 1 if k == -edits or (k != edits and reach[k - 1] < reach[k + 1]) else k - 1
        x0 = reach[before] if edits else 0
        y0 = x0 - before if edits else 0
        while x > x0 and y > y0:
            x, y = x - 1, y - 1
            out.append((x, y))
        x, y = x0, y0
    return out[::-1]


def _in_gaps(words: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Words that aren't matched, with gap, the number of matches before them in the document."""
    met = matches.select("doc_id", F.col(side).alias("ord"), F.lit(1).alias("_met"))
    marked = words.join(shuffled(met), ["doc_id", "ord"], "left")
    gap = F.sum(F.coalesce("_met", F.lit(0))).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("gap", gap).where("_met IS NULL").drop("_met")


def matches(new: DataFrame, old: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, a (ord in old), b (ord in new) of the words (doc_id, ord, word) that stay, ascending on both sides."""
    found = new.sparkSession.createDataFrame([], _MATCH)

    def once(words: DataFrame) -> DataFrame:
        return words.groupBy("doc_id", "gap", "word").agg(F.min("ord").alias("ord"), F.count("*").alias("_n")).where("_n = 1").drop("_n")

    def matched(rows: list[tuple]) -> pa.RecordBatch:
        doc_ids, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc_id", "a", "b"])

    def anchors(batches):
        for batch in batches:
            groups = zip(batch.column("doc_id").to_pylist(), batch.column("pairs").to_pylist(), strict=True)
            yield matched([(doc_id, *p) for doc_id, pairs in groups for p in _ascending([(r["a"], r["b"]) for r in pairs])])

    def aligned(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                words = [sorted(zip(r[f"{s}_ord"], r[f"{s}_word"], strict=True)) for s in ("a", "b")]
                pairs = _shortest([w for _, w in words[0]], [w for _, w in words[1]])
                out += [(r["doc_id"], words[0][i][0], words[1][j][0]) for i, j in pairs]
            yield matched(out)

    for _ in range(rounds):
        a, b = once(_in_gaps(old, found, "a")), once(_in_gaps(new, found, "b"))
        pairs = a.withColumnRenamed("ord", "a").join(shuffled(b.withColumnRenamed("ord", "b")), ["doc_id", "gap", "word"])
        found = cut(found.unionByName(pairs.groupBy("doc_id", "gap").agg(F.collect_list(F.struct("a", "b")).alias("pairs")).mapInArrow(anchors, _MATCH)))
    listed = lambda words, s: words.groupBy("doc_id", "gap").agg(F.collect_list("ord").alias(f"{s}_ord"), F.collect_list("word").alias(f"{s}_word"))
    # only words that the other side of the gap has too can match
    a, b = _in_gaps(old, found, "a"), _in_gaps(new, found, "b")
    both = listed(a.join(shuffled(b.select("doc_id", "gap", "word").distinct()), ["doc_id", "gap", "word"], "left_semi"), "a").join(shuffled(listed(b.join(shuffled(a.select("doc_id", "gap", "word").distinct()), ["doc_id", "gap", "word"], "left_semi"), "b")), ["doc_id", "gap"])
    return cut(found.unionByName(both.mapInArrow(aligned, _MATCH)))


def changes(new: DataFrame, old: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Changes between the words (doc_id, ord, page_no, word) of two versions: doc_id, ord, kind, old_page, old_text, new_page, new_text, gap, at most `limit` a document.

    kind is replaced, inserted or deleted; texts are words with a blank between them, pages those of the first word.
    """
    return changes_of(new, old, matches(new, old), limit)


def changes_of(new: DataFrame, old: DataFrame, found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """changes() between matches that are known."""

    def side(words: DataFrame, column: str, name: str) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct("ord", "page_no", "word")))
        blocks = _in_gaps(words, found, column).groupBy("doc_id", "gap").agg(ordered.alias("_w"))
        return blocks.select("doc_id", "gap", F.col("_w")[0]["page_no"].alias(f"{name}_page"), F.array_join(F.transform("_w", lambda w: w["word"]), " ").alias(f"{name}_text"))

    both = side(old, "a", "old").join(shuffled(side(new, "b", "new")), ["doc_id", "gap"], "full")
    kind = F.when(F.col("old_text").isNull(), "inserted").when(F.col("new_text").isNull(), "deleted").otherwise("replaced")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("gap")) - 1
    all_ = both.withColumn("kind", kind).withColumn("ord", number.cast("int")).where(F.col("ord") < limit)
    return all_.select("doc_id", "ord", "kind", "old_page", "old_text", "new_page", "new_text", F.col("gap").cast("int").alias("gap"))


def marks(new: DataFrame, old: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Changes as comments on the new version: doc_id, page_no, ord (of the change), type, content, x0, y0, x1, y1.

    Words of the new version have boxes. New words are highlighted, with one box on each page that they are on; words that
    are gone get a caret at the left edge of the word that now follows, or at the right edge of the last one before.
    """
    found = matches(new, old)
    listed = changes_of(new, old, found, limit)
    said = F.when(F.col("kind") == "inserted", F.concat(F.lit("Inserted: "), "new_text")).when(F.col("kind") == "deleted", F.concat(F.lit("Deleted: "), "old_text")).otherwise(F.concat(F.lit("Replaced: "), "old_text", F.lit(" -> "), "new_text"))
    listed = cut(listed.withColumn("content", said))
    here = _in_gaps(new, found, "b").join(shuffled(listed.where("kind <> 'deleted'").select("doc_id", "gap", F.col("ord").alias("change"), "content")), ["doc_id", "gap"])
    ends = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    shown = here.groupBy("doc_id", "page_no", F.col("change").alias("ord"), F.lit("Highlight").alias("type"), "content").agg(*ends)
    # a gap lies after the match of its number, and before the next one
    at = Window.partitionBy("doc_id").orderBy("b")
    places = found.select("doc_id", F.col("b").alias("_b"), F.row_number().over(at).alias("_n"))
    gone = listed.where("kind = 'deleted'").select("doc_id", "gap", F.col("ord").alias("change"), "content")
    word = new.select("doc_id", F.col("ord").alias("_b"), "page_no", "x0", "y0", "x1", "y1")
    beside = lambda n, before: gone.join(shuffled(places.withColumn("gap", F.col("_n") - n)), ["doc_id", "gap"]).join(shuffled(word), ["doc_id", "_b"]).select("doc_id", "change", "content", F.lit(before).alias("_before"), F.struct("page_no", "x0", "y0", "x1", "y1").alias("_w"))
    nearest = beside(1, 0).unionByName(beside(0, 1)).groupBy("doc_id", "change", "content").agg(F.min_by(F.struct("_before", "_w"), "_before").alias("m"))
    edge = F.when(F.col("m._before") == 0, F.col("m._w.x0")).otherwise(F.col("m._w.x1"))
    carets = nearest.select("doc_id", F.col("m._w.page_no").alias("page_no"), F.col("change").alias("ord"), F.lit("Caret").alias("type"), "content", edge.alias("x0"), F.col("m._w.y0").alias("y0"), edge.alias("x1"), F.col("m._w.y1").alias("y1"))
    return shown.unionByName(carets)

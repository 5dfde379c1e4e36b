"""Iterations over tables: each round reads what the last one wrote, and lineage is cut in a folder that all can read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.grid import shuffled


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept by checkpoint(): in spark.checkpoint.dir, or a temporary folder on a local master only."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="quire-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def reachable(start: DataFrame, edges: DataFrame, node: list[str], group: list[str]) -> DataFrame:
    """group and node columns of all that is reached from start along edges (`node` to _to_`node`), start itself with hop 0.

    Semi-naive: only what the last round reached for the first time goes on, so each edge is followed once for a group.
    """
    key = [*group, *node]
    seen = cut(start.select(*key).distinct().withColumn("hop", F.lit(0)))
    front, hop = seen, 0
    while True:
        hop += 1
        following = front.select(*key).join(shuffled(edges), node).select(*group, *[F.col(f"_to_{n}").alias(n) for n in node]).distinct()
        front = cut(following.join(shuffled(seen), key, "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if hop % 8 == 0:
            seen = cut(seen)


def components(pairs: DataFrame) -> DataFrame:
    """node, component (its smallest node) of pairs (a, b) of longs; a node of its own is given as a pair with itself.

    Alternately each node's larger neighbours, then its smaller ones, are linked to the smallest around: the number of
    rounds grows with the logarithm of the size. What is grouped is only ever the smallest of a node's neighbours, which
    is summed before the shuffle, so a node of many pairs is no more work for one task.
    """
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    links = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_of = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    before = print_of(links)
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        after = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        links = cut(after)
        if (now := print_of(links)) == before:
            return nodes.join(links.withColumnsRenamed({"a": "node", "b": "component"}), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        before = now

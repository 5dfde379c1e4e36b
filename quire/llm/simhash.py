"""SimHash near-duplicates by multi-index hashing.

A fingerprint's 64 bits are cut into two segments of 32. Two fingerprints that differ in at most three bits differ in
at most one bit of one of the segments, so a segment's table is probed with the small Hamming ball around the own
value: the value itself, and the values with one more bit set (the partner that lacks the bit probes for the other).
What meets under one segment value is verified by the distance of the whole fingerprints.

Fingerprints are computed once for each row and grouped before anything else, so copies never meet as pairs. What meets
under a segment value isn't turned into pairs either: a search over the group links each fingerprint once to the
component that it belongs to within the group, which keeps every link that matters and a number of edges below the size
of the group. Groups larger than GROUP are dealt out by pairs of chunks, so none is held in one task whole. Components
are found by alternating large and small stars, whose state is cut to the shared folder in each round.

Cases: null and empty texts, and texts of white space, have fingerprint zero and are linked like others; a text of
fewer words than a shingle is one shingle; repeated shingles count each time; rows that repeat a doc_id each get their
own fingerprint, and a null doc_id links nothing by itself: it takes the component of its fingerprint; a component none
of whose rows has a doc_id has a null component_id; an empty table gives an empty result; clashing columns of the input
are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import clashing, cut, let_go, small_batches, written

SEED = 42
DISTANCE = 3
GROUP = 20_000
#: Edges of a task where components are read and written.
EDGES = 100_000
_ALL = (1 << 64) - 1


def fingerprint(text: str, words: int = 3) -> int:
    """The SimHash of a text, of unsigned XXH64 over shingles of lower-cased words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    begins = np.concatenate([[0], ends[:-words]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, len(begins))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bits of a bounded number of hashes at a time
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, words: int = 3) -> DataFrame:
    """df's doc_id and other columns but the text, with fp, the fingerprint as a signed long."""
    small_batches(df.sparkSession)
    narrow = df.drop("text")
    schema = clashing(narrow, ["fp"]).schema.add("fp", "long")
    names = schema.names[:-1]

    def run(batches):
        let_go()
        for b in batches:
            fps = np.fromiter((fingerprint(t or "", words) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(fps.view(np.int64))], names=schema.names)

    return df.select(*names, "text").mapInArrow(run, schema)


def _links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect whatever is connected among fps by links of at most DISTANCE bits: each reached from another once."""
    left, out = fps, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= DISTANCE
            if near.any():
                found = left[near]
                out += [(int(at), int(x)) for x in found]
                front.extend(found)
                left = left[~near]
    return out


def _meet(batches):
    """Edges among the rows (key, fp, own) of each key; rows come in ascending order of the key."""
    let_go()
    rest = None
    for b in batches:
        key, fp, own = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "own"))
        if rest is not None:
            key, fp, own = (np.concatenate([x, y]) for x, y in zip(rest, (key, fp, own), strict=True))
        last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if len(key) and key[0] != key[-1] else 0
        rest = key[last:], fp[last:], own[last:]
        yield from _groups(key[:last], fp[:last], own[:last])
    if rest is not None:
        yield from _groups(*rest)


def _groups(key: np.ndarray, fp: np.ndarray, own: np.ndarray):
    if not len(key):
        return
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    held = np.add.reduceat(own.astype(np.int64), begin) > 0
    a, b = [], []
    u = fp.view(np.uint64) if fp.dtype == np.int64 else fp.astype(np.int64).view(np.uint64)
    two = begin[(size == 2) & held]
    near = two[np.bitwise_count(u[two] ^ u[two + 1]) <= DISTANCE]
    a.append(u[near])
    b.append(u[near + 1])
    for at, n in zip(begin[(size > 2) & held].tolist(), size[(size > 2) & held].tolist(), strict=True):
        if links := _links(np.unique(u[at : at + n])):
            pairs = np.array(links, np.uint64)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
    for i in range(0, len(a), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 10_000]), pa.array(b[i : i + 10_000])], ["a", "b"])


def near_pairs(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links."""
    half = F.lit((1 << 32) - 1)
    entries = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("fp").bitwiseAND(half).alias("v")), F.struct(F.lit(1).alias("s"), F.shiftrightunsigned("fp", 32).alias("v")))).alias("e"))
    entries = entries.select("fp", F.col("e.s").alias("s"), F.col("e.v").alias("v"))
    ball = F.filter(F.transform(F.sequence(F.lit(0), F.lit(32)), lambda i: F.when(i == 32, F.col("v")).otherwise(F.col("v").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))), lambda v: v.isNotNull())
    # bits that are set already give the value itself: array_distinct leaves one of it
    met = entries.select("fp", "s", "v", F.explode(F.array_distinct(ball)).alias("to"))
    met = met.select((F.col("to") * 2 + F.col("s")).alias("key"), "fp", (F.col("to") == F.col("v")).alias("own"))
    # values that more than a group's rows share: by pairs of chunks
    own = entries.groupBy((F.col("v") * 2 + F.col("s")).alias("key")).agg(F.count("*").alias("n"))
    hot = cut(own.where(F.col("n") > group).withColumn("chunks", F.ceil(F.col("n") / group).cast("long")))
    if not hot.isEmpty():
        chunk = F.pmod(F.xxhash64("fp"), F.col("chunks"))
        pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda i: F.struct(F.least(i, F.col("c")).alias("x"), F.greatest(i, F.col("c")).alias("y"))))
        spread = met.join(hot, "key").withColumn("c", chunk).withColumn("p", pair)
        spread = spread.select("key", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "fp", "own")
        met = met.join(hot, "key", "left_anti").select("key", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "fp", "own").unionByName(spread)
        met = met.select(F.xxhash64("key", "x", "y").alias("key"), "fp", "own")  # another group under the same hash only adds candidates
    return met.repartition("key").sortWithinPartitions("key").mapInArrow(_meet, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of all nodes of edges (a, b), by alternating large and small stars.

    Minima are pre-aggregated and joined back, so the neighbours of a node are never held together.
    """
    state = lambda of: tuple(of.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(now)
    while True:
        tasks = 1 + before[0] // EDGES  # a task for each partition costs files in each exchange, however few rows it has
        now = now.coalesce(tasks)
        # large star: neighbours that are larger than a node hang on to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours hang on to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        after = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(after.coalesce(tasks))
        if before == (before := state(now)):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def linked(df: DataFrame, words: int = 3) -> DataFrame:
    """fp and component (the smallest doc_id reachable) of each row of df (doc_id, text), with df's other columns but the text."""
    rows = written(fingerprints(df, words), "simhash")
    nodes = written(rows.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("doc"), F.count("*").alias("n")), "simhash-nodes")
    roots = components(near_pairs(nodes.select("fp")))
    # a component of fingerprints has the smallest doc_id of its fingerprints
    of = nodes.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "doc")
    of = of.unionByName(nodes.join(roots.select(F.col("root").alias("fp")).distinct(), "fp").select("fp", F.col("fp").alias("root"), "doc"))
    least = of.groupBy("root").agg(F.min("doc").alias("component_id"))
    component = of.join(least, "root").select("fp", "component_id")
    # as a table, so that the join below exchanges both of its sides and the rows of a hot fingerprint can be split
    alone = written(nodes.join(component, "fp", "left").select("fp", F.coalesce("component_id", "doc").alias("component_id")), "simhash-components")
    return clashing(rows, ["component_id"]).join(alone, "fp")


def near_groups(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row of df (doc_id, text)."""
    return linked(df.select("doc_id", "text")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(df: DataFrame) -> DataFrame:
    """One row of each component of df, the first by doc_id, with df's columns."""
    numbered = written(clashing(df, ["_row"]).withColumn("_row", F.monotonically_increasing_id()), "simhash-rows")
    found = linked(numbered.select("doc_id", "_row", "text"))
    # a component without any doc_id is known by one of its fingerprints only: each of these rows is its own group
    group = F.when(F.col("component_id").isNull(), F.col("fp")).otherwise(F.col("component_id"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    stays = found.groupBy(F.col("component_id").isNull().alias("none"), group.alias("group")).agg(F.min(rank).alias("first")).select(F.col("first._row").alias("_row"))
    return numbered.join(stays, "_row", "left_semi").select(*df.columns)

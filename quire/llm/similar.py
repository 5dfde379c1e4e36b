"""Near-duplicates by the similarity of shingle sets: MinHash bands propose, the sets themselves decide.

A text's set holds the hashes of its shingles of five lower-cased words; two texts are near-duplicates if the Jaccard
similarity of their sets is at least 0.8. Texts of equal sets are one node. A signature of BANDS bands of ROWS minima
is made of each set, and nodes that share a band are candidates: of pairs at 0.8 all but 1 in 20 000 share one.

First each node is compared with the smallest node of each of its bands, which costs a comparison for each edge of a star.
A band of three nodes or more that are then still in several linked parts is compared in full: every node outside its largest part
with every node of it, in tiles of about ROOM by ROOM nodes, so no task holds a large band whole. Links that pass make the components.

Sets are large, so only those cross the network that sketches do not rule out. A sketch counts a set's hashes by their leading
bits, in about a 25th of the set's bytes. Two sets share no more hashes than the smaller counts add up to, so no pair of the
similarity is ruled out; of those that are not ruled out the sets decide.

simhash_dedup() takes its candidates by op5's method as well: texts that SimHash fingerprints link, by their multi-index, at
three differing bits or fewer, are candidates of one more band. Fingerprints are made where signatures are.

Cases: null and empty texts and texts of white space have equal (empty) sets; a text of fewer words than a shingle is
one shingle; a shingle counts once; of a component the first row by doc_id stays, rows without one rank last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import clashing, let_go, over, small_batches, written
from quire.llm.exact import without
from quire.llm.simhash import components, fingerprint, near_pairs

WORDS = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
ROOM = 128
#: Nodes whose texts are looked up by a broadcast; beyond, by a shuffle of texts.
BROADCAST_ROWS = 250_000
#: Texts that a worker holds with their sets at a time.
FEW = 128
_DRAW = np.random.default_rng(42)
_A, _B = (_DRAW.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_A |= np.uint64(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's shingles, ascending, each once."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    found = {xxhash.xxh64_intdigest(b" ".join(parts[i : i + words])) for i in range(max(1, len(parts) - words + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed key for each band of a set's signature."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at : at + 2048, None] * _A + _B).min(axis=0))
    raw, step = least.tobytes(), 8 * ROWS
    keys = [xxhash.xxh64_intdigest(raw[i * step : (i + 1) * step], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketch(hashes: np.ndarray) -> bytes:
    """How many of a set's hashes have which leading bits, a byte each; nothing if a byte is too small."""
    bits = max(4, (len(hashes) // 2).bit_length() - 1)
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return b"" if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def _coarser(sketches: np.ndarray, n: int) -> np.ndarray:
    """Sketches (rows of the same length) with their counts added up to n each."""
    return sketches if sketches.shape[1] == n else sketches.reshape(len(sketches), n, -1).sum(axis=2, dtype=np.uint32)


def may_be_alike(one: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets may be of the similarity to one, by its sketch and theirs (rows of the same length)."""
    n = min(len(one), others.shape[1])
    if not n:
        return np.ones(len(others), bool)
    both = np.minimum(_coarser(one[None], n), _coarser(others, n)).sum(axis=1, dtype=np.int64)
    return both >= similarity * (int(one.sum(dtype=np.int64)) + others.sum(axis=1, dtype=np.int64) - both) - 1e-9


def _signed(batches):
    let_go()
    for b in batches:
        for part in (b.slice(at, FEW) for at in range(0, b.num_rows, FEW)):
            texts = [t or "" for t in part.column("text").to_pylist()]
            sets = [shingles(t) for t in texts]
            own = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
            fps = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("doc_id"), own, pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.array(fps), pa.array(map(sketch, sets), pa.binary())], ["_row", "doc_id", "set_id", "bands", "fp", "sketch"])


def _sets(batches):
    let_go()
    for b in batches:
        for part in (b.slice(at, FEW) for at in range(0, b.num_rows, FEW)):
            sets = [shingles(t or "").tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "set"])


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _verified(similarity: float):
    def run(batches):
        let_go()
        for b in batches:
            pairs = zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)
            yield b.filter(pa.array([_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in pairs], pa.bool_())).select(["a", "b"])

    return run


def _hoped(similarity: float):
    """The pairs (a, b) that their sketches x and y do not rule out."""

    def run(batches):
        let_go()
        for b in batches:
            pairs = zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)
            found = [bool(may_be_alike(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)[None], similarity)[0]) for x, y in pairs]
            yield b.filter(pa.array(found, pa.bool_())).select(["a", "b"])

    return run


def _open(similarity: float):
    """Of the rows (tile, key, node, part, side, sketch) of each tile those that have a row of another part and side which sketches do not rule out; rows come in order of the tile."""

    def tile(keys: list[int], nodes: list[int], part: list[int], side: list[int], raw: list[bytes]):
        parts, sides, sizes = np.array(part), np.array(side), np.array(list(map(len, raw)))
        found = np.zeros(len(raw), bool)
        others = [(at, np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), n)) for n in np.unique(sizes[sides == 1]).tolist() for at in [np.flatnonzero((sides == 1) & (sizes == n))]]
        for i in np.flatnonzero(sides == 0).tolist():
            one = np.frombuffer(raw[i], np.uint8)
            for at, theirs in others:
                near = at[may_be_alike(one, theirs, similarity) & (parts[at] != parts[i])]
                found[near] = True
                found[i] |= len(near) > 0
        return {(keys[i], nodes[i]) for i in np.flatnonzero(found).tolist()}

    def run(batches):
        let_go()
        now, rows = None, []
        made = lambda pairs: pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int64()), pa.array([n for _, n in pairs], pa.int64())], ["key", "node"])
        for b in batches:
            found = []
            for tile_, *row in zip(*(b.column(c).to_pylist() for c in ("tile", "key", "node", "part", "side", "sketch")), strict=True):
                if tile_ != now:
                    found += tile(*zip(*rows, strict=True)) if rows else []
                    now, rows = tile_, []
                rows.append(row)
            yield made(found)
        yield made(list(tile(*zip(*rows, strict=True))) if rows else [])

    return run


def _tiles(similarity: float):
    """Links (a, b) between linked parts, of the rows (key, part, side, set) of each tile; rows come in order of the key."""

    def tile(part: list[int], side: list[int], raw: list[bytes]):
        sets = [np.frombuffer(s, np.uint64) for s in raw]
        sizes = np.array([len(s) for s in sets])
        number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        parts, sides = np.array(part), np.array(side)
        theirs = sides == 1
        out = set()
        for i in np.flatnonzero(sides == 0).tolist():
            held = np.zeros(int(number.max(initial=-1)) + 1, bool)
            held[number[begin[i] : begin[i + 1]]] = True
            both = np.concatenate([[0], np.cumsum(held[number])])
            both = both[begin[1:]] - both[begin[:-1]]
            near = theirs & (parts != parts[i]) & (both >= similarity * (sizes + sizes[i] - both) - 1e-9)
            out |= {(part[i], int(p)) for p in parts[near]}
        return sorted(out)

    def run(batches):
        let_go()
        now, rows = None, []

        def links():
            return tile(*map(list, zip(*rows, strict=True))) if rows else []

        for b in batches:
            found = []
            for key, *row in zip(*(b.column(c).to_pylist() for c in ("key", "part", "side", "set")), strict=True):
                if key != now:
                    found += links()
                    now, rows = key, []
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
        found = links()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def _sets_of(numbered: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set of the nodes (rows may repeat)."""
    asked = written(nodes.distinct(), "similar-asked")
    nodes = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    sets = written(numbered.select(F.col("_row").alias("node"), "text").join(nodes, "node").mapInArrow(_sets, "node long, set binary"), "similar-sets")
    over(asked)
    return sets


def _dealt(apart: DataFrame, what: str) -> DataFrame:
    """The rows of bands in tiles, in order of the tile: on side 0 those outside a band's largest part, on side 1 all."""
    zero = F.lit(0).cast("long")
    every = lambda n: F.explode(F.sequence(zero, n - 1))
    mine = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n)
    u = apart.where("part <> main").select("key", "node", mine(F.col("us"), 1).alias("i"), every(F.col("vs")).alias("j"), "part", F.lit(0).alias("side"), what)
    v = apart.select("key", "node", every(F.col("us")).alias("i"), mine(F.col("vs"), 2).alias("j"), "part", F.lit(1).alias("side"), what)
    met = u.unionByName(v).select(F.xxhash64("key", "i", "j").alias("tile"), "key", "node", "part", "side", what)
    return met.repartition("tile").sortWithinPartitions("tile")


def links(numbered: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, room: int = ROOM, more: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all candidates of at least the similarity; more: further bands (node, key)."""
    if "sketch" not in nodes.columns:
        nodes = nodes.withColumn("sketch", F.expr("X''"))  # rules nothing out
    entries = nodes.select("node", F.explode("bands").alias("key"))
    entries = entries if more is None else entries.unionByName(more)
    first = entries.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    shared = written(entries.join(first, "key"), "similar-shared")
    star = shared.where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    of = lambda what, node, name: what.select(F.col("node").alias(node), F.col(what.columns[1]).alias(name))
    sketches = nodes.select("node", "sketch")
    star = written(star.join(of(sketches, "a", "x"), "a").join(of(sketches, "b", "y"), "b").mapInArrow(_hoped(similarity), "a long, b long"), "similar-star")
    sets = _sets_of(numbered, star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))))
    linked = written(star.join(of(sets, "a", "x"), "a").join(of(sets, "b", "y"), "b").mapInArrow(_verified(similarity), "a long, b long"), "similar-linked")
    over(star, sets)
    # bands whose nodes are still apart, but for those of two nodes, which the star has compared: by node numbers, then with
    # sketches, then with the sets of what these leave
    parts = components(linked).select("node", F.col("root").alias("part"))
    held = shared.where("n > 2").join(parts, "node", "left").select("key", "node", F.coalesce("part", "node").alias("part"))
    held = written(held, "similar-bands")
    over(shared)
    sizes = held.groupBy("key", "part").agg(F.count("*").alias("n"))
    most = sizes.groupBy("key").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    chunks = lambda n: F.ceil(n / room).cast("long")
    most = most.select("key", F.col("most.part").alias("main"), chunks(F.col("all") - F.col("most.n")).alias("us"), chunks(F.col("all")).alias("vs"))
    apart = written(held.join(most, "key"), "similar-apart")
    left = written(_dealt(apart.join(sketches, "node"), "sketch").mapInArrow(_open(similarity), "key long, node long").distinct(), "similar-open")
    sets = _sets_of(numbered, left.select("node"))
    across = _dealt(apart.join(left, ["key", "node"]).join(sets, "node"), "set").withColumn("key", F.col("tile")).mapInArrow(_tiles(similarity), "a long, b long")
    edges = written(linked.unionByName(across), "similar-edges")
    over(linked, held, apart, left, sets)
    return edges


def fingerprint_bands(held: DataFrame) -> DataFrame:
    """node, key of the nodes of held (node, fp): a key for each component of fingerprints that op5's method links."""
    roots = components(near_pairs(held.select("fp").distinct())).withColumnRenamed("node", "fp")
    return written(held.join(roots, "fp", "left").select("node", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key")).distinct(), "similar-fingerprints")


def simhash_dedup(df: DataFrame, similarity: float = SIMILARITY, room: int = ROOM) -> DataFrame:
    """As similar_dedup(), with the candidates that fingerprints propose too."""
    return similar_dedup(df, similarity, room, by_fingerprint=True)


def similar_dedup(df: DataFrame, similarity: float = SIMILARITY, room: int = ROOM, by_fingerprint: bool = False) -> DataFrame:
    """One row of each component of df's near-duplicates, the first by doc_id, with df's columns."""
    small_batches(df.sparkSession)
    numbered = written(clashing(df, ["_row"]).withColumn("_row", F.monotonically_increasing_id()), "similar-rows")
    rows = numbered.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signed, "_row long, doc_id long, set_id binary, bands array<long>, fp long, sketch binary")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = [F.min("rank").alias("rank"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")]
    signed = written(rows.withColumn("rank", rank), "similar-signed")
    nodes = signed.groupBy("set_id").agg(*first)
    nodes = written(nodes.select(F.col("rank._row").alias("node"), "set_id", "rank", "bands", "sketch"), "similar-nodes")
    held = fingerprint_bands(signed.select("set_id", "fp").distinct().join(nodes.select("set_id", "node"), "set_id").select("node", "fp")) if by_fingerprint else None
    over(signed)
    edges = links(numbered, nodes, similarity, room, held)
    group = components(edges)
    group = group.unionByName(group.select(F.col("root").alias("node"), "root").distinct())
    stays = nodes.select("node", "rank").join(group, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("rank").alias("rank"))
    dropped = written(numbered.select("_row").join(stays.select(F.col("rank._row").alias("_row")), "_row", "left_anti"), "similar-dropped")
    over(nodes, edges)
    return without(numbered, dropped, "_row").select(*df.columns)

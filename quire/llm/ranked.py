"""Ranked lexical search by a two-level quantised index, with exact integer scores.

Documents are indexed in blocks. A block holds its documents' ids and lengths, a dictionary of its terms, and for each term a
list of postings, in the order of the documents. Level two of a posting is its exact count. Level one is a byte: what the
posting adds to a score is the term's weight times an impact of the count and the document's length, and the byte is that
impact over STEP, rounded upward. So the sum of weights times bytes bounds a score from above, and the same sum with bytes
less one from below, and neither needs the counts.

A search runs over the blocks twice. First each task sums the bytes and keeps for each item the k largest lower bounds of
its documents; the k-th of all is the item's threshold. Then every document whose upper bound reaches the threshold is
scored exactly from the counts, and each task sends an item's k best on. No document is left out: one below the threshold
has k others above it. Items go over the blocks in groups, of about GROUP_ITEMS items
or GROUP_TERMS terms at most, chosen by a hash.

Numbers of terms and documents are global, so impacts need two steps: counts are written block by block as texts are read,
and the bytes are added when the totals are known. Weights need document frequencies, which are summed over the blocks'
dictionaries for the terms of the items at hand.

Cases: null and empty texts have no terms, are in no count and are never found; a text is indexed whole, and one of many terms
is a block of its own; rows that repeat a doc_id, or have none, are documents of their own, with null last among equal scores;
items that repeat an item_id, or have none, each get their own ranks; an item without terms that occur gets no rows; empty tables
give an empty result; other columns of either table take no part.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import deleted, once, small_batches, written

#: Impacts are counts of a millionth; a byte stands for 1/255 of the largest, rounded upward.
LARGEST = 1_000_000
STEP = -(-LARGEST // 255)
#: A block is closed when it has so many documents or terms; about so many terms and items are searched at a time.
BLOCK_DOCS, BLOCK_TERMS = 4096, 2_000_000
GROUP_TERMS, GROUP_ITEMS = 100_000, 256

#: Terms are what lies between these bytes, after A to Z have become a to z; bytes of other characters stay.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))

#: A row is a block of several MB. By default Parquet's writer looks at the size of what it holds after 100 rows only; ours looks
#: at every one, and closes a row group at so many bytes, which is also what a reader holds of a file.
ROW_GROUP = 16 << 20
BY_BLOCK = {"parquet.block.size": ROW_GROUP, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}

BLOCK = "block string, doc_ids array<long>, sizes binary, terms array<binary>, starts binary, at binary, counts binary"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class Block:
    """Postings of documents as they come."""

    def __init__(self):
        self.numbers, self.ids, self.sizes, self.parts, self.held = _Numbers(), [], [], [], 0

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        found = np.fromiter(map(self.numbers.__getitem__, terms), np.int64, len(terms))
        self.parts.append(found)
        self.ids.append(doc_id)
        self.sizes.append(len(terms))
        self.held += len(terms)

    def row(self) -> pa.RecordBatch:
        """The block: postings sorted by term, then document."""
        n = len(self.ids)
        pairs, counts = np.unique(np.concatenate(self.parts) * n + np.repeat(np.arange(n), self.sizes), return_counts=True)
        starts = np.searchsorted(pairs // n, np.arange(len(self.numbers) + 1)).astype("<i8")
        columns = [[uuid.uuid4().hex], [self.ids], [np.array(self.sizes, "<i8").tobytes()], [list(self.numbers)], [starts.tobytes()], [(pairs % n).astype("<i4").tobytes()], [counts.astype("<i8" if counts.max() >= 1 << 31 else "<i4").tobytes()]]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "doc_ids", "sizes", "terms", "starts", "at", "counts"])


def counted(docs: DataFrame) -> DataFrame:
    """Level two: blocks of the exact counts of all terms of docs (doc_id, text)."""

    def run(batches):
        block = Block()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                if terms := terms_of(text.as_py()):
                    if block.held and block.held + len(terms) > BLOCK_TERMS:
                        yield block.row()
                        block = Block()
                    block.add(doc_id, terms)
                    if len(block.ids) >= BLOCK_DOCS:
                        yield block.row()
                        block = Block()
        if block.held:
            yield block.row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK)


def exact_counts(raw: bytes, postings: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8" if len(raw) == 8 * postings else "<i4").astype(np.int64)


def impacts(counts: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """What postings add to a score, over their terms' weights: whole numbers."""
    m = 100 - 50 + (50 * size * n) // total
    return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


class Index:
    """Blocks with both levels, and the numbers of documents and of terms of them all."""

    def __init__(self, blocks: DataFrame, n: int, total: int):
        self.blocks, self.n, self.total = blocks, n, total


def build(docs: DataFrame) -> Index:
    """The index of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    level2, path = written(counted(docs), "ranked-counts", with_path=True, options=BY_BLOCK)

    def sums(batches):
        n = total = 0
        for b in batches:
            for raw in b.column("sizes").to_pylist():
                sizes = np.frombuffer(raw, "<i8")
                n, total = n + len(sizes), total + int(sizes.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    of_all = level2.select("sizes").mapInArrow(sums, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, total = of_all["n"] or 0, of_all["total"] or 0

    def quantise(batches):
        for b in batches:
            out = []
            for sizes, at, counts in zip(*(b.column(c).to_pylist() for c in ("sizes", "at", "counts")), strict=True):
                at = np.frombuffer(at, "<i4")
                exact = impacts(exact_counts(counts, len(at)), np.frombuffer(sizes, "<i8")[at], n, total)
                out.append((-(-exact // STEP)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "bytes"])

    both = written(level2.mapInArrow(quantise, f"{BLOCK}, bytes binary"), "ranked-index", options=BY_BLOCK)
    deleted(spark, path)
    return Index(both, n, total)


def frequencies(index: Index, terms: DataFrame) -> DataFrame:
    """term, df of those of terms (term binary, distinct) that occur."""

    def run(batches):
        for b in batches:
            for names, starts in zip(b.column("terms"), b.column("starts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([names.values, pa.array(np.diff(np.frombuffer(starts, "<i8")))], names=["term", "df"])

    return index.blocks.select("terms", "starts").mapInArrow(run, "term binary, df long").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Items:
    """A group of items, and of each term that they name its weight and the items that name it."""

    def __init__(self, items: list[int], named: dict[bytes, tuple[int, list[int]]]):
        self.items, self.named = items, {t: (w, np.array(at)) for t, (w, at) in named.items()}

    def bounds(self, docs: int, terms: list[bytes], starts: np.ndarray, at: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weight times byte, and of weight over bytes that aren't zero: for each item and document of a block."""
        bytes_, weights = np.zeros((len(self.items), docs), np.int64), np.zeros((len(self.items), docs), np.int64)
        for i, term in enumerate(terms):
            if found := self.named.get(term):
                own = slice(starts[i], starts[i + 1])
                place = np.ix_(found[1], at[own])
                bytes_[place] += found[0] * level[own]
                weights[place] += found[0] * (level[own] > 0)
        return bytes_, weights

    def exact(self, places: dict[int, np.ndarray], terms: list[bytes], starts: np.ndarray, at: np.ndarray, impact: np.ndarray) -> dict[int, np.ndarray]:
        """Scores of the documents at places, in ascending order, for items by number."""
        out = {q: np.zeros(len(docs), np.int64) for q, docs in places.items()}
        for i, term in enumerate(terms):
            if found := self.named.get(term):
                own = slice(starts[i], starts[i + 1])
                for q in found[1].tolist():
                    if q in places:
                        place = np.minimum(np.searchsorted(at[own], places[q]), starts[i + 1] - starts[i] - 1)
                        out[q] += np.where(at[own][place] == places[q], found[0] * impact[own][place], 0)
        return out


def _opened(b: pa.RecordBatch):
    """The blocks of a batch: number of documents, terms, starts, places, bytes as numbers."""
    for i in range(b.num_rows):
        raw = {c: b.column(c)[i].as_py() for c in ("terms", "starts", "at", "bytes", "sizes")}
        yield i, len(raw["sizes"]) // 8, raw["terms"], np.frombuffer(raw["starts"], "<i8"), np.frombuffer(raw["at"], "<i4"), np.frombuffer(raw["bytes"], np.uint8).astype(np.int64)


def _best(df: DataFrame, k: int, order: list) -> DataFrame:
    """The k first rows of each item: first of parts of an item, so that no task meets all of its rows."""
    parted = df.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(16)))
    some = parted.withColumn("_n", F.row_number().over(Window.partitionBy("_item", "_part").orderBy(*order))).where(F.col("_n") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*order))).where(F.col("rank") <= k).drop("_part", "_n")


def _group_search(index: Index, group: list, frequency: dict[bytes, int], k: int) -> DataFrame:
    """_item, doc_id, score, rank of a group of items: rows of _item and terms."""
    named: dict[bytes, tuple[int, list[int]]] = {}
    for q, r in enumerate(group):
        for term in map(bytes, r["terms"]):
            if term in frequency:
                named.setdefault(term, (weight(frequency[term], index.n), []))[1].append(q)
    numbers = [r["_item"] for r in group]
    shared = index.blocks.sparkSession.sparkContext.broadcast(Items(numbers, named))

    def lower(batches):
        items = shared.value
        kept = np.zeros((len(items.items), 0), np.int64)
        for b in batches:
            for _, docs, terms, starts, at, level in _opened(b):
                bytes_, weights = items.bounds(docs, terms, starts, at, level)
                # a byte q over STEP is of an impact of more than (q - 1) * STEP
                kept = np.concatenate([kept, STEP * bytes_ - (STEP - 1) * weights], axis=1)
                if kept.shape[1] > k:
                    kept = np.partition(kept, kept.shape[1] - k, axis=1)[:, -k:]
        q, _ = np.nonzero(kept)
        yield pa.RecordBatch.from_pydict({"_item": pa.array(np.array(items.items, np.int64)[q]), "bound": pa.array(kept[kept != 0])})

    level1 = index.blocks.select("sizes", "terms", "starts", "at", "bytes")
    bounds = _best(level1.mapInArrow(lower, "_item long, bound long"), k, [F.desc("bound")])
    threshold = {r["_item"]: r["bound"] for r in bounds.where(F.col("rank") == k).collect()}  # a row for each item of the group
    n, total = index.n, index.total

    def rescore(batches):
        items = shared.value
        floor = np.array([threshold.get(i, 1) for i in items.items], np.int64)
        kept: dict[int, list] = {}
        for b in batches:
            for i, docs, terms, starts, at, level in _opened(b):
                bytes_, _ = items.bounds(docs, terms, starts, at, level)
                q, doc = np.nonzero(STEP * bytes_ >= np.maximum(floor, 1)[:, None])
                if not len(q):
                    continue
                found = np.unique(q)
                ends = np.searchsorted(q, found, side="right")
                places = {int(x): part for x, part in zip(found, np.split(doc, ends[:-1]), strict=True)}
                exact = impacts(exact_counts(b.column("counts")[i].as_py(), len(at)), np.frombuffer(b.column("sizes")[i].as_py(), "<i8")[at], n, total)
                ids = b.column("doc_ids")[i].as_py()
                for x, scores in items.exact(places, terms, starts, at, exact).items():
                    own = [(-s, ids[d] is None, ids[d] or 0) for s, d in zip(scores.tolist(), places[x].tolist(), strict=True) if s > 0]
                    kept[x] = sorted(kept.get(x, []) + own)[:k]
        rows = [(items.items[x], None if none else doc, -s) for x, part in kept.items() for s, none, doc in part]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["_item", "doc_id", "score"])

    return _best(index.blocks.mapInArrow(rescore, "_item long, doc_id long, score long"), k, [F.desc("score"), F.asc_nulls_last("doc_id")])


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each row of items (item_id, text)."""
    spark = items.sparkSession

    def terms(batches):
        for b in batches:
            found = [sorted(set(terms_of(t.as_py()))) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(terms, "item_id long, terms array<binary>")
    asked = written(asked.where(F.size("terms") > 0).withColumn("_item", F.monotonically_increasing_id()), "ranked-items")
    size = asked.agg(F.count("*").alias("items"), F.sum(F.size("terms")).alias("terms")).first()
    groups = max(1, -(-size["items"] // GROUP_ITEMS), -(-(size["terms"] or 0) // GROUP_TERMS))
    asked = asked.withColumn("_group", F.pmod(F.xxhash64("_item"), F.lit(groups)))
    frequency = written(frequencies(index, asked.select(F.explode("terms").alias("term")).distinct()), "ranked-frequencies")
    found = None
    for g in range(groups):
        group = asked.where(F.col("_group") == g)
        rows = group.select("_item", "terms").collect()  # about GROUP_TERMS terms
        if rows:
            known = frequency.join(group.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").collect()
            part = written(_group_search(index, rows, {bytes(r["term"]): r["df"] for r in known}, k), "ranked-found")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found.join(asked.select("_item", "item_id"), "_item").select("item_id", "rank", "doc_id", "score")

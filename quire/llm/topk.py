"""Exact top-k inner products by a bit-sliced index.

Each component of a vector is quantised to an integer; a block of rows keeps, for each attribute and each binary
digit, one bitmap over its rows. A query adds the bitmaps of its attributes, weighted by its own integers, with
carry-save adders (bitwise AND, XOR, OR on 64 rows a word). The sum is again a set of bitmaps, one for each binary
digit of the score, and the best k rows are found from the most significant one downward; rows that tie at the
boundary are resolved exactly by vec_id, and the scores of the chosen rows are read off the digits.

The index of a block of at most BLOCK_ROWS rows and about BLOCK_BYTES bytes is built once and kept in the shared folder.
Queries are cut into blocks too; each pair of blocks is one group, joined on the pair's number, so neither side is ever
broadcast and no task holds more than one pair.

Cases: an empty table gives no rows; a vector that is null or holds a null, NaN or infinite component takes no part;
vectors of other lengths than the query's are no candidates, and empty ones score 0; every row is a candidate of its own,
also of rows that share a vec_id, and a query's own row is the only one that it leaves out; a row without a vec_id is a
candidate, whose vec_id is null and after all others in ties, and never a query; integers are of any size, but one that
is no long, or a score that is none, is an error; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import slots, small_batches, written

BLOCK_ROWS = 65_536
BLOCK_BYTES = 64 << 20
_LONG = 1 << 63


def digits(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q as signed binary digits, of which no two neighbours are set: attribute, power and sign of each."""
    attribute, power, sign = [], [], []
    left = np.abs(q.astype(object)) if len(q) and int(np.abs(q.astype(object)).max()) >= 1 << 62 else np.abs(q)
    turn = np.sign(q).astype(np.int64)
    p = 0
    while len(at := np.flatnonzero(left > 0)):
        odd = at[(left[at] & 1).astype(bool)]
        down = (left[odd] & 3) == 3  # ...11 is ...100 less one
        step = np.where(down, -1, 1)
        attribute.append(odd)
        power.append(np.full(len(odd), p, np.int64))
        sign.append(turn[odd] * step)
        left[odd] = left[odd] - step
        left = left >> 1
        p += 1
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in (attribute, power, sign))  # type: ignore[return-value]


class BitSlices:
    """The index of one block of n rows: bitmaps of each attribute's digits above its smallest value, with complements."""

    def __init__(self, n: int, low: np.ndarray, width: np.ndarray, slices: np.ndarray):
        self.n, self.low, self.width = n, low, width
        self.first = np.cumsum(width) - width
        self.count = len(slices)
        self.words = -(-n // 64)
        self.slices = np.concatenate([slices, ~slices])
        self.all = _bitmaps(np.ones((1, n), bool), self.words)[0]

    @staticmethod
    def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Smallest value and width of each attribute of x (a row each), and its bitmaps."""
        n, d = x.shape
        low = x.min(axis=0) if n else np.zeros(d, np.int64)
        above = x.view(np.uint64) - low.view(np.uint64)  # right whatever the spread
        width = np.array([int(v).bit_length() for v in (above.max(axis=0) if n else low)], np.int64)
        words = -(-n // 64)
        out = [np.zeros((0, words), np.uint64)]
        for j in range(d):
            column = above[:, j]
            out.append(_bitmaps(np.array([(column >> np.uint64(b)) & np.uint64(1) for b in range(width[j])], bool).reshape(-1, n), words))
        return low, width, np.concatenate(out)

    def sums(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the inner products with q, less a constant, the least significant first; and the constant.

        A digit of q adds the attribute's bitmaps from its own power on, or for a negative one their complements, besides
        a constant: all terms are bitmaps of a power of two, which full adders take three by three into one of that power
        and one of the next.
        """
        constant = sum(a * b for a, b in zip(q.tolist(), self.low.tolist(), strict=True))
        attribute, power, sign = digits(q)
        for j, p in zip(attribute[sign < 0].tolist(), power[sign < 0].tolist(), strict=True):
            constant -= ((1 << int(self.width[j])) - 1) << p
        widths = self.width[attribute]
        digit = np.arange(int(widths.sum())) - np.repeat(np.cumsum(widths) - widths, widths)
        slice_ = np.repeat(self.first[attribute] + np.where(sign < 0, self.count, 0), widths) + digit
        at = np.repeat(power, widths) + digit
        order = np.argsort(at, kind="stable")
        slice_, begins = slice_[order], np.concatenate([[0], np.cumsum(np.bincount(at))]).tolist()
        out, carried, p = [], None, 0
        while p < len(begins) - 1 or carried is not None:
            parts = [self.slices[slice_[begins[p] : begins[p + 1]]]] if p < len(begins) - 1 else []
            if carried is not None:
                parts.append(carried)
            here = np.concatenate(parts) if len(parts) > 1 else parts[0]
            if not len(here):
                here = np.zeros((1, self.words), np.uint64)
            following = []
            while len(here) > 1:
                m = len(here) // 3
                if m:
                    a, b, c = here[:m], here[m : 2 * m], here[2 * m : 3 * m]
                    half = a ^ b
                    total = half ^ c
                    half &= c
                    half |= a & b
                    following.append(half)
                    here = total if 3 * m == len(here) else np.concatenate([total, here[3 * m :]])
                else:
                    following.append(here[:1] & here[1:2])
                    here = here[:1] ^ here[1:2]
            out.append(here[0])
            carried = np.concatenate(following) if following else None
            p += 1
        return out, constant

    def top(self, q: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, list[int]]:
        """The k rows of the largest inner product with q, the earlier of equal ones, and their scores; `but` is none of them."""
        open_ = self.all.copy()
        if but is not None:
            open_[but // 64] &= ~(np.uint64(1) << np.uint64(but % 64))
        sure = np.zeros_like(open_)
        wanted = k
        bits, constant = self.sums(q)
        for digit in reversed(bits):
            one = open_ & digit
            n = int(np.bitwise_count(one).sum())
            if n >= wanted:
                open_ = one
            else:
                sure |= one
                wanted -= n
                open_ &= ~digit
        rows = np.concatenate([_rows(sure), _rows(open_)[:wanted]])  # at the boundary all scores are equal
        score = [constant] * len(rows)
        word, shift = rows // 64, (rows % 64).astype(np.uint64)
        for p, digit in enumerate(bits):
            for i in np.flatnonzero(digit[word] >> shift & np.uint64(1)).tolist():
                score[i] += 1 << p
        order = sorted(range(len(rows)), key=lambda i: (-score[i], rows[i]))
        return rows[order], [score[i] for i in order]


def _bitmaps(bits: np.ndarray, words: int) -> np.ndarray:
    """Each row of bits as words of 64."""
    out = np.zeros((len(bits), words * 8), np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def quantised(df: DataFrame, scale: int) -> DataFrame:
    """_row, vec_id, x: floor(scale * component) as integers, of the vectors that take part."""
    component = F.col("embedding")
    usable = F.forall(component, lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    fits = lambda y: F.when(F.abs(y) < float(_LONG), F.floor(y).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for a long")).cast("long"))
    whole = F.transform(component, lambda v: fits(v.cast("double") * scale))
    return df.where(component.isNotNull() & usable).select(F.monotonically_increasing_id().alias("_row"), F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


_PACKED = "dims int, block long, n int, rows binary, ids binary, low binary, width binary, data binary"


def _pack(index: bool):
    """One row of a block, in ascending order of vec_id (none last): numbers and ids of rows, and their bitmaps or integers."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        dims, n = key[0].as_py(), rows.num_rows
        known = np.array([v is not None for v in rows["vec_id"].to_pylist()], bool)
        ids = rows["vec_id"].fill_null(0).to_numpy().astype("<i8")
        order = np.lexsort((ids, ~known))
        x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(n, dims)[order]
        low, width, data = BitSlices.build(x) if index else (np.zeros(0, "<i8"), np.zeros(0, "<i8"), x)
        numbers = np.stack([rows["_row"].to_numpy().astype("<i8")[order], known[order].astype("<i8")])
        cells = [key[0].as_py(), key[1].as_py(), n, numbers.tobytes(), ids[order].tobytes(), low.tobytes(), width.tobytes(), data.tobytes()]
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
        return pa.table([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names=[f.split()[0] for f in _PACKED.split(", ")])

    return pack


def _search(k: int):
    def run(batches):
        held, index = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                get = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                d, n = get["dims"], get["n"]
                longs = lambda c: np.frombuffer(get[c], "<i8")  # noqa: E731, B023
                if held != (own := (d, get["block"])):
                    width = longs("width")
                    index = BitSlices(n, longs("low"), width, np.frombuffer(get["data"], "<u8").reshape(int(width.sum()), -(-n // 64)))
                    held = own
                (numbers, known), ids = longs("rows").reshape(2, n), longs("ids")
                q_numbers, q_ids, q_x = longs("q_rows").reshape(2, -1)[0], longs("q_ids"), longs("q_data").reshape(-1, d) if d else np.zeros((get["q_n"], 0), np.int64)
                place = {r: at for at, r in enumerate(numbers.tolist())}
                for q_row, q_id, x in zip(q_numbers.tolist(), q_ids.tolist(), q_x, strict=True):
                    rows, score = index.top(x, k, place.get(q_row))
                    if score and not (-_LONG <= score[-1] and score[0] < _LONG):
                        raise OverflowError(f"a score of vector {q_id} is too large for a long")
                    yield pa.RecordBatch.from_arrays([pa.array([q_row] * len(rows), pa.int64()), pa.array([q_id] * len(rows), pa.int64()), pa.array(ids[rows], mask=known[rows] == 0), pa.array(score, pa.int64())], ["_q", "query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, k: int = 20, scale: int = 64, query_every: int = 20, block_rows: int = BLOCK_ROWS, block_queries: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each row whose vec_id query_every divides."""
    spark = df.sparkSession
    small_batches(spark)
    rows = written(quantised(df, scale).withColumn("dims", F.size("x")), "topk-rows")
    asks = F.col("vec_id") % query_every == 0
    size = rows.agg(F.count("*").alias("n"), F.count_if(asks).alias("q"), F.coalesce(F.max("dims"), F.lit(1)).alias("dims")).first()
    if not size["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    a_vector = 8 * max(1, size["dims"])
    blocks = -(-size["n"] // max(64, min(block_rows, BLOCK_BYTES // a_vector)))
    # enough groups for all cores; never so many queries that their integers outgrow a task
    per_query_block = block_queries or min(8192, BLOCK_BYTES // a_vector, max(64, -(-size["q"] * blocks // slots(spark))))
    query_blocks = -(-size["q"] // max(1, per_query_block))
    part = lambda n: F.pmod(F.xxhash64("_row"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = written(rows.withColumn("block", part(blocks)).groupBy("dims", "block").applyInArrow(_pack(True), _PACKED), "topk-index")
    queries = written(rows.where(asks).withColumn("block", part(query_blocks)).groupBy("dims", "block").applyInArrow(_pack(False), _PACKED), "topk-queries")
    index = index.withColumn("other", every(query_blocks)).withColumn("cell", F.col("other") * blocks + F.col("block")).drop("other")
    queries = queries.withColumn("other", every(blocks)).select(
        F.col("dims").alias("q_dims"), (F.col("block") * blocks + F.col("other")).alias("q_cell"), F.col("n").alias("q_n"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")
    )
    cells = min(4 * blocks * query_blocks, 2000)  # a number given is kept: merged cells would leave cores idle
    met = index.repartition(cells, "cell", "dims").join(queries.repartition(cells, "q_cell", "q_dims").hint("shuffle_hash"), (F.col("cell") == F.col("q_cell")) & (F.col("dims") == F.col("q_dims")))
    best = met.drop("cell", "q_cell", "q_dims").mapInArrow(_search(k), "_q long, query_id long, vec_id long, score long")
    ranked = Window.partitionBy("_q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

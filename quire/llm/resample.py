"""Importance resampling towards a target: hashed n-grams of a raw and of a target collection, and a draw by score.

A feature is a run of one to three words; its bucket is the CRC-32 of its bytes modulo BUCKETS. The first pass counts: each
partition adds up one vector of BUCKETS sums with np.bincount over Arrow batches, and treeReduce merges the vectors, so
that the driver gets one of 80 kB whatever the number of partitions. From the two vectors comes each bucket's gain, the
logarithm of its share in the target over its share in the raw texts, in thousandths, rounded down. The second pass
gathers the gains of each document's features from the broadcast vector and sums them with bincount weights. To the sum
comes a Gumbel variate that is a hash of seed and doc_id, so that the highest scores are a draw without replacement.

The CRC of a run is not taken from its bytes: that of two strings on end is linear in both, so each distinct word's own CRC
is looked up and runs are put together with one table of 256 entries for each byte of the CRC and length of a word.

The draw is exact at any size: rows are dealt by ranges of score and written, the ranges' sizes are added up, and a rank is
a row's place in its range after the sizes of those before; rows that tie in score and doc_id are dealt by a hash too.

Cases: a null or empty text has no features, weight 0 and is never drawn; long texts are taken in pieces of words; a null
doc_id hashes as `null` and comes after all others among ties, rows that repeat a doc_id are drawn on their own; without any
target text the gains are those of an empty target; an empty table gives an empty result; clashing columns are replaced.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.llm.bpe import Kept
from quire.llm.common import clashing, once, slots, small_batches, written

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Distinct words whose CRC a worker keeps, in two generations; words beyond WORD_BYTES have no table of their own.
KEPT_WORDS, WORD_BYTES = 300_000, 64
#: Words of a text that are held as numbers at a time; rows in a range of scores.
PIECE, RANGE_ROWS = 1 << 20, 500_000
ADDED = ["n_features", "weight", "score", "rank"]

#: Words are what lies between these bytes, after A to Z have become a to z; other bytes stay.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def _shifted(crc: int, size: int) -> int:
    """What a string's CRC contributes to that of the string with `size` bytes after it."""
    return zlib.crc32(bytes(size), crc) ^ zlib.crc32(bytes(size))


class Runs:
    """Buckets of the runs of words of a text."""

    def __init__(self, buckets: int = BUCKETS, longest: int = LONGEST_RUN):
        self.buckets, self.longest = buckets, longest
        self.of_word = Kept(lambda w: (zlib.crc32(b" " + w) << 32 | zlib.crc32(w), len(w)), KEPT_WORDS)
        # [n, i, b]: the contribution of byte i of a CRC, where it is b, with a blank and n bytes after it
        bit = np.array([[_shifted(1 << i, n + 1) for i in range(32)] for n in range(WORD_BYTES + 1)], np.uint32)
        self.table = np.zeros((WORD_BYTES + 1, 4, 256), np.uint32)
        for b in range(1, 256):
            low = (b & -b).bit_length() - 1
            for i in range(4):
                self.table[:, i, b] = self.table[:, i, b & (b - 1)] ^ bit[:, 8 * i + low]

    def _then(self, crc: np.ndarray, size: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The CRC of strings with a blank and a word after each: of `size` bytes, the CRC of both being `after`."""
        short, out = np.minimum(size, WORD_BYTES), after.copy()
        for i in range(4):
            out ^= self.table[short, i, (crc >> np.uint32(8 * i)) & np.uint32(255)]
        for at in np.flatnonzero(size > WORD_BYTES).tolist():
            out[at] = _long_shift(int(crc[at]), int(size[at]) + 1) ^ int(after[at])
        return out

    def of(self, words: list[bytes]):
        """Arrays of buckets, of bounded size each; all of them are the features of the text."""
        for at in range(0, len(words), PIECE):
            part = words[at : at + PIECE + self.longest - 1]
            found = [self.of_word[w] for w in part]
            both = np.fromiter((f[0] for f in found), np.uint64, len(part))
            size = np.fromiter((f[1] for f in found), np.int64, len(part))
            crc, after = both.astype(np.uint32), (both >> np.uint64(32)).astype(np.uint32)
            own = min(len(part), PIECE)  # runs that begin in this piece
            for n in range(self.longest):
                if n:
                    if len(part) <= n:
                        break
                    crc = self._then(crc[: len(part) - n], size[n:], after[n:])
                yield crc[:own] % np.uint32(self.buckets)


def _long_shift(crc: int, size: int) -> int:
    """As _shifted, for words of any length, in pieces of zeros."""
    while size:
        step = min(size, 1 << 20)
        crc, size = _shifted(crc, step), size - step
    return crc


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    small_batches(docs.sparkSession)
    key = uuid.uuid4().hex

    def count(batches):
        runs, total = once(key, lambda: Runs(buckets, longest)), np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column("text"):
                for part in runs.of(words_of(text.as_py())):
                    total += np.bincount(part, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = docs.select("text").mapInArrow(count, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"], np.int64))
    none = docs.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)  # for a table without partitions
    return sums.union(none).treeReduce(np.add)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the raw texts)) of each bucket, with one more count in each."""
    n, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + float(n)) / ((a + 1.0) * (t + float(n))))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(key: str) -> int:
    """A Gumbel variate in thousandths, from the first 32 bits of a hash, as hexadecimal digits."""
    return math.floor(-1000 * math.log(-math.log((int(key, 16) + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST_RUN, seed: int = SEED) -> DataFrame:
    """docs but for text, with n_features, weight, score, and _words, their number."""
    small_batches(docs.sparkSession)
    rest = clashing(docs, [*ADDED, "_words", "_hash", "_split", "_range", "_before"])
    carried = [c for c in rest.columns if c != "text"]
    hashed = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8)
    names = ["n_features", "weight", "score", "_words"]
    schema = StructType([*(f for f in rest.schema.fields if f.name != "text"), *(StructField(n, LongType()) for n in names)])
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)
    key = uuid.uuid4().hex

    def run(batches):
        runs, gain = once(key, lambda: Runs(buckets, longest)), shared.value
        for b in batches:
            texts = b.column("text")
            # bincount sums in doubles, which is exact for sums of gains below 2**53; a text's pieces are added up as integers
            parts, owner = [], []
            sums, many, words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)

            def add():
                if parts:  # noqa: B023
                    row = np.repeat(np.array(owner), [len(p) for p in parts])  # noqa: B023
                    sums[:] += np.bincount(row, weights=gain[np.concatenate(parts)], minlength=len(sums)).astype(np.int64)  # noqa: B023
                    parts.clear(), owner.clear()  # noqa: B023

            held = 0
            for i, text in enumerate(texts):
                found = words_of(text.as_py())
                words[i] = len(found)
                for part in runs.of(found):
                    parts.append(part), owner.append(i)
                    many[i] += len(part)
                    held += len(part)
                    if held > PIECE:
                        add()
                        held = 0
            add()
            drawn = np.fromiter(map(gumbel, b.column("_hash").to_pylist()), np.int64, len(texts))
            added = [pa.array(x, pa.int64()) for x in (many, sums, sums + drawn, words)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *added], names=schema.names)

    return rest.withColumn("_hash", hashed).mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST_RUN, seed: int = SEED) -> DataFrame:
    """docs but for text, with n_features, weight, score and rank; null rank: not drawn. Both tables have a text column."""
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = written(weighted(docs, gain, longest, seed), "resample-scored")
    able = F.col("_words") >= least_words
    n = scored.where(able).count()
    draw = n * percent // 100
    parts = max(slots(docs.sparkSession), -(-n // RANGE_ROWS))
    split = F.xxhash64("weight", "n_features", F.monotonically_increasing_id())
    dealt = scored.where(able).withColumn("_split", split).repartitionByRange(parts, F.desc("score"), F.asc_nulls_last("doc_id"), F.col("_split"))
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "resample-ranges")
    sizes = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # a row for each range
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    starts = docs.sparkSession.createDataFrame(starts, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "_split"))
    first = dealt.join(F.broadcast(starts.where(F.col("_before") < draw)), "_range")  # ranges that the draw reaches
    others = dealt.join(F.broadcast(starts.where(F.col("_before") >= draw)), "_range")
    ranked = first.withColumn("rank", F.col("_before") + place).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    names = [*(c for c in scored.columns if c != "_words"), "rank"]
    none = F.lit(None).cast("long").alias("rank")
    return ranked.select(names).unionByName(others.select(*names[:-1], none)).unionByName(scored.where(~able).select(*names[:-1], none))

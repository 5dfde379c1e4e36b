"""Exact duplicates by a log-structured merge index of digests, with byte verification of hits.

The key of a text is the SHA-256 of its normalised form. A memtable of arriving keys flushes, when full, into a sorted
run with a Bloom filter; runs of one tier compact into the next, where only keys that another run's filter may hold
are merged and the others are copied. Of equal keys compaction keeps the row that stays (most code points, then the
smallest doc_id) and adds up the counts. The index is built twice with the same code: within each input partition, so
that a key leaves it once however many copies it has, and then, after an exchange by key, within each shard of bounded
size. Rows look their key up; those that hit a group of more than one row compare their normalised bytes with those of
the row that stays, and rows that differ in spite of an equal key are grouped anew by their bytes.

Cases: null text counts as empty, and empty texts are equal to each other; a null doc_id ranks after all others; of
rows that repeat doc_id and text one stays; an empty table gives an empty result; columns of the input whose names
clash with the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ASCII_SPACE, clashing, let_go, over, small_batches, text_of, written

FLUSH_ROWS = 65_536
FAN_IN = 4
SHARD_ROWS = 250_000
#: The largest filter that is sent to all tasks.
FILTER_BYTES = 32 << 20
_FIELDS = ("cp", "null", "doc", "row", "n")
_ADDED = ["keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, ASCII_SPACE, "")


class Run:
    """Keys in ascending order, each once, the row that stays for each, and a Bloom filter of the keys."""

    def __init__(self, keys: np.ndarray, values: dict[str, np.ndarray], tier: int):
        self.keys, self.values, self.tier = keys, values, tier
        self.bits = 1 << max(10, int(16 * len(keys)).bit_length())
        self.filter = np.zeros(self.bits // 8, np.uint8)
        for p in self._places(keys):
            np.bitwise_or.at(self.filter, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def _places(self, keys: np.ndarray):
        with np.errstate(over="ignore"):
            for i in range(4):
                yield ((keys[:, i % 4] + np.uint64(i) * keys[:, (i + 1) % 4]) & np.uint64(self.bits - 1)).astype(np.int64)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self._places(keys):
            out &= (self.filter[p >> 3] >> (p & 7) & 1).astype(bool)
        return out


def _combined(keys: np.ndarray, values: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Ascending keys, each with the row that stays and the sum of the counts."""
    order = np.lexsort((values["row"], values["doc"], values["null"], -values["cp"], *(keys[:, i] for i in (3, 2, 1, 0))))
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, np.int64)
    out = {f: values[f][order][first] for f in _FIELDS}
    if len(keys):
        out["n"] = np.add.reduceat(values["n"][order], first)
    return keys[first], out


class LsmIndex:
    def __init__(self, flush_rows: int = FLUSH_ROWS):
        self.flush_rows, self.memtable, self.held, self.runs = flush_rows, [], 0, []

    def put(self, keys: np.ndarray, values: dict[str, np.ndarray]) -> None:
        self.memtable.append((keys, values))
        self.held += len(keys)
        if self.held >= self.flush_rows:
            self.flush()

    def flush(self) -> None:
        if self.held:
            keys = np.concatenate([k for k, _ in self.memtable])
            values = {f: np.concatenate([v[f] for _, v in self.memtable]) for f in _FIELDS}
            self.runs.append(Run(*_combined(keys, values), tier=0))
            self.memtable, self.held = [], 0
            while len(same := [r for r in self.runs if r.tier == self.runs[-1].tier]) >= FAN_IN:
                self.compact(same)

    def compact(self, runs: list[Run]) -> None:
        """One run in place of several."""
        shared = [np.any([o.may_hold(r.keys) for o in runs if o is not r], axis=0) if len(runs) > 1 else np.zeros(len(r.keys), bool) for r in runs]
        hits = _combined(np.concatenate([r.keys[s] for r, s in zip(runs, shared, strict=True)]), {f: np.concatenate([r.values[f][s] for r, s in zip(runs, shared, strict=True)]) for f in _FIELDS})
        keys = np.concatenate([hits[0], *(r.keys[~s] for r, s in zip(runs, shared, strict=True))])
        values = {f: np.concatenate([hits[1][f], *(r.values[f][~s] for r, s in zip(runs, shared, strict=True))]) for f in _FIELDS}
        order = np.lexsort(tuple(keys[:, i] for i in (3, 2, 1, 0)))
        self.runs = [r for r in self.runs if r not in runs]
        self.runs.append(Run(keys[order], {f: v[order] for f, v in values.items()}, max(r.tier for r in runs) + 1))

    def all(self) -> Run | None:
        self.flush()
        if len(self.runs) > 1:
            self.compact(self.runs)
        return self.runs[0] if self.runs else None


_RUN = "key binary, cp long, null long, doc long, row long, n long"


def _indexed(flush_rows: int):
    def build(batches):
        let_go()
        index, width = LsmIndex(flush_rows), 32
        for b in batches:
            if b.num_rows:
                raw = b.column("key").to_pylist()
                width = len(raw[0])
                keys = np.frombuffer(b"".join(k.ljust(32, b"\0") for k in raw), ">u8").reshape(-1, 4).astype(np.uint64)
                index.put(keys, {f: b.column(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in _FIELDS})
        run = index.all()
        if run is not None:
            for at in range(0, len(run.keys), 10_000):
                raw = run.keys[at : at + 10_000].astype(">u8").tobytes()
                keys = pa.array([raw[i : i + width] for i in range(0, len(raw), 32)], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(run.values[f][at : at + 10_000]) for f in _FIELDS)], ["key", *_FIELDS])

    return build


def _numbered(df: DataFrame, digest_bytes: int) -> DataFrame:
    """df in the shared folder, each row with a number that stays, and its key."""
    sha = F.unhex(F.sha2(F.encode(normalised(text_of(df)), "UTF-8"), 256))
    out = clashing(df, ["_row", "_cp", "_sha"]).withColumn("_sha", sha).withColumn("_cp", F.length(text_of(df)).cast("long"))
    return written(out.withColumn("_row", F.monotonically_increasing_id()), "exact").withColumn("_key", F.substring("_sha", 1, digest_bytes))


def _groups(rows: DataFrame, flush_rows: int) -> DataFrame:
    """_key, keep_id, _keep_row, group_size of the keys that more than one row has."""
    entries = rows.select(F.col("_key").alias("key"), F.col("_cp").alias("cp"), F.col("doc_id").isNull().cast("long").alias("null"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.col("_row").alias("row"), F.lit(1).cast("long").alias("n"))
    runs = written(entries.mapInArrow(_indexed(flush_rows), _RUN), "exact-runs")
    shards = max(1, -(-runs.count() // SHARD_ROWS))
    merged = runs.repartition(shards, "key").mapInArrow(_indexed(flush_rows), _RUN)
    keep = F.when(F.col("null") == 0, F.col("doc"))
    out = written(merged.where("n > 1").select(F.col("key").alias("_key"), keep.alias("keep_id"), F.col("row").alias("_keep_row"), F.col("n").alias("group_size")), "exact-groups")
    over(runs)
    return out


def _may_hit(groups: DataFrame, key: str = "_key") -> Column:
    """Whether a Bloom filter of the groups' keys may hold a row's key.

    The filter has 16 bits a key, up to FILTER_BYTES; beyond, it holds back fewer of the rows that hit nothing, and the join
    that follows drops the rest. It reaches the driver as bytes, in parts of at most a megabyte.
    """
    bits = min(8 * FILTER_BYTES, 1 << max(10, int(16 * groups.count()).bit_length()))
    part = min(bits, 1 << 23)
    places = lambda key: F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(4)])

    def packed(key: tuple, at: pa.Table) -> pa.Table:
        held = np.zeros(part, bool)
        held[at["at"].to_numpy()] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "held": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    set_ = groups.select(F.explode(places(F.col(key))).alias("place")).distinct().select(F.floor(F.col("place") / part).alias("part"), (F.col("place") % part).alias("at"))
    held = np.zeros(bits // 8, np.uint8)
    for r in set_.groupBy("part").applyInArrow(packed, "part long, held binary").toLocalIterator():
        held[r["part"] * (part // 8) : (r["part"] + 1) * (part // 8)] = np.frombuffer(r["held"], np.uint8)
    sent = groups.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def may_hold(at):  # type: ignore[no-untyped-def]
        import pandas as pd

        at = np.stack(at.to_numpy()) if len(at) else np.zeros((0, 4), np.int64)
        return pd.Series((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool).all(axis=1))

    return may_hold(places(F.col(key)))


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows whose key is none of dropped's (a table in the shared folder): those that its Bloom filter does not hold stay where they are, and only the others are exchanged."""
    hit = _may_hit(dropped, key)
    return rows.where(~hit).unionByName(rows.where(hit).join(dropped.hint("merge"), key, "left_anti"))


def _assigned(df: DataFrame, flush_rows: int, digest_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The numbered rows, and for each its _row, doc_id, _sha and the added columns."""
    small_batches(df.sparkSession)
    rows = _numbered(df, digest_bytes)
    groups = _groups(rows, flush_rows)
    # merge joins at every size: what is exchanged is in proportion to the input, and a hot key can be split
    looked_up = rows.select("_row", "doc_id", "_sha", "_key").join(groups.hint("merge"), "_key", "left")
    # hits: the bytes decide
    hits = written(rows.select("_row", "_key", normalised(text_of(rows)).alias("_bytes")).where(_may_hit(groups)).join(groups.hint("merge"), "_key"), "exact-hits")
    stays = hits.where(F.col("_row") == F.col("_keep_row")).select("_key", F.col("_bytes").alias("_kept_bytes"))
    others = hits.where(F.col("_row") != F.col("_keep_row")).select("_key", "_bytes")
    # nothing after the join asks for a key's rows to stay together, so a hot key's can be split
    false_hits = written(others.join(stays.hint("merge"), "_key").where("_bytes <> _kept_bytes").select("_key"), "exact-false").distinct()
    over(hits)
    if not false_hits.isEmpty():
        # groups of rows whose keys are equal and whose bytes are not: by their bytes
        wrong = rows.join(false_hits, "_key", "left_semi").select("_key", "_row", "doc_id", "_cp", normalised(text_of(rows)).alias("_bytes"))
        rank = F.struct(-F.col("_cp"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
        by_bytes = wrong.groupBy("_key", "_bytes").agg(F.min(rank).alias("best"), F.count("*").alias("n"))
        fixed = wrong.join(by_bytes, ["_key", "_bytes"]).select("_row", F.struct(F.col("best.doc_id").alias("id"), F.col("best._row").alias("row"), "n").alias("_fixed"))
        looked_up = looked_up.join(fixed, "_row", "left").select(
            "_row", "doc_id", "_sha", *(F.when(F.col("_fixed").isNotNull(), F.col(f"_fixed.{b}")).otherwise(F.col(a)).alias(a) for a, b in (("keep_id", "id"), ("_keep_row", "row"), ("group_size", "n")))
        )
    alone = F.col("_keep_row").isNull()
    return rows, looked_up.select(
        "_row", "doc_id",
        F.when(alone, F.col("doc_id").cast("long")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_keep_row"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def exact_groups(df: DataFrame, flush_rows: int = FLUSH_ROWS, digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of df (doc_id, text)."""
    return _assigned(df.select("doc_id", "text"), flush_rows, digest_bytes)[1].drop("_row")


def exact_dedup(df: DataFrame, flush_rows: int = FLUSH_ROWS, digest_bytes: int = 32) -> DataFrame:
    """The rows of df that stay, with df's columns."""
    rows, assigned = _assigned(df, flush_rows, digest_bytes)
    dropped = written(assigned.where(~F.col("kept")).select("_row"), "exact-dropped")
    return without(rows, dropped, "_row").select(*df.columns)

"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the mixture over its share of the corpus, both in code points (with one for the
end of a document). Each document draws a number in [0, 1) from a hash of its doc_id and the seed, inverts the Poisson
distribution whose mean is its source's rate, and appears that many times; so each copy count is reproducible, needs no
state, and has the rate as its mean. The copies are then dealt to partitions by a hash of (doc_id, copy) and the row's
number, which spreads rows that share a doc_id, and lie in each in the order of that hash: one exchange, for which nothing
needs to be sampled. All of it is DataFrame expressions.

Rates are one row for each source, pre-aggregated before the exchange; they are broadcast only if they have at most
BROADCAST_BYTES, and else joined by (source, salt), so that a source with a third of all rows is spread.

Cases: a null source is a source of its own; null and empty texts have a size of one; rows that repeat a doc_id get the
same number of copies each; a null doc_id is hashed as the word null; sources without a weight, when weights are given
(the null source among them), are left out; an empty table gives an empty result; clashing columns of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import clashing, text_of, written

BROADCAST_BYTES = 4 << 20
SALTS = 64
SEED = 20_240_501


def _hash(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def inverted(rate: Column, u: Column) -> Column:
    """How many k have P(X <= k) <= u for a Poisson distribution of mean `rate`: a term for each of them, none kept.

    Sums of terms stop where what is left is below 2**-53, in logarithms from the start, as exp(-rate) may be 0.
    """
    last = F.ceil(rate + 9 * F.sqrt(rate) + 18).cast("int")
    begin = F.struct((-rate).alias("log"), F.exp(-rate).alias("cdf"), F.when(F.exp(-rate) <= u, 1).otherwise(0).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate) - F.log(k.cast("double"))
        cdf = acc["cdf"] + F.exp(log)
        return F.struct(log.alias("log"), cdf.alias("cdf"), (acc["n"] + F.when(cdf <= u, 1).otherwise(0)).alias("n"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), begin, step, lambda acc: acc["n"])).otherwise(F.lit(0))


def rates(df: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7) -> tuple[DataFrame, int]:
    """_source, _rate of each source that has a weight, and about how many bytes they are."""
    mass = F.sum(F.length(text_of(df)) + 1).cast("double")
    per_source = written(df.groupBy(F.col("source").alias("_source")).agg(mass.alias("mass")), "mixing-mass")
    if weights is None:
        weight = F.pow("mass", F.lit(alpha))
    else:
        given = df.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items() if v is not None] or [(None, 0.0)], "_source string, weight double")
        per_source = per_source.join(given, "_source", "left")
        weight = F.coalesce("weight", F.lit(0.0))
    per_source = per_source.withColumn("weight", weight)
    total = per_source.agg(F.sum("mass").alias("mass"), F.sum("weight").alias("weight"), F.sum(F.coalesce(F.octet_length("_source"), F.lit(0)) + 64).alias("bytes")).first()
    share = F.col("weight") / F.lit(float(total["weight"] or 1.0))
    return per_source.select("_source", (share * F.lit(float(total["mass"] or 0.0)) / F.col("mass")).alias("_rate")), total["bytes"] or 0


def mix(df: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, seed: int = SEED) -> DataFrame:
    """The copies of df's rows in mixed order, with copies (of the document), copy (from 1) and mix_key.

    weights: target share of each source, in any unit; None: its share of the corpus to the power alpha.
    """
    table, size = rates(df, weights, alpha)
    rows = clashing(df, ["copies", "copy", "mix_key", "_source", "_rate", "_salt", "_place"])
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["_source"]))
    else:
        joined = salted(rows, table)
    u = F.conv(F.substring(_hash(seed, F.col("doc_id")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    copied = joined.withColumn("copies", inverted(F.col("_rate"), u)).where("copies > 0").drop("_source", "_rate").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    keyed = copied.withColumn("mix_key", _hash(seed, F.col("doc_id"), F.col("copy")))
    # rows that repeat a doc_id, or have none, share their keys: the number of the row keeps them apart
    placed = keyed.withColumn("_place", F.xxhash64("mix_key", F.monotonically_increasing_id()))
    return placed.repartition("_place").sortWithinPartitions("_place").drop("_place")


def salted(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with their source's rate, without a broadcast: by (source, salt)."""
    table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)))
    return rows.join(table, rows["source"].eqNullSafe(table["_source"]) & (rows["_salt"] == table["_salt"])).drop("_salt")

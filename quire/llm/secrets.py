"""Scans for secrets by a trigram inverted index, in DataFrame functions only.

A rule is a regular expression. From it comes a Boolean query of trigrams (see trigrams.py) that any match satisfies. The
index is a table of postings: trigram, and a hash of the text that holds it, once for each distinct text, sorted by
trigram so that a reader skips what no query names. It holds the trigrams it is asked for, which for a scan are those of
the rules' queries, and all of them if asked for none. A conjunction's postings are intersected by counting: a text that
has as many of its trigrams as it names satisfies it. The texts that any conjunction of a rule leaves are the rule's
candidates, and only there is the expression run; rules without mandatory trigrams run on every text. Texts that share
a hash are candidates together, and the expression decides, so the result doesn't depend on the index.

Candidates go back to their texts by a broadcast where there are BROADCAST_ROWS of them at most, and by a join on the hash
and a salt beyond, so that a text that is repeated often isn't one task's.

Places of matches are counted in code points: the pieces between matches come from split, the matches from
regexp_extract_all, and the running sums of both lengths are taken in chunks, so that the work is not quadratic in them.

Cases: null and empty texts have no spans; a text is scanned whole; rows that repeat a doc_id or a text each get their own row;
a null doc_id stays; matches of one rule don't overlap, those of several may, and are ordered by start, then by rule; an empty
table gives an empty result; clashing columns of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import trigrams
from quire.llm.common import clashing, text_of, written

BROADCAST_ROWS = 250_000
SALTS = 16
#: Matches whose places are summed together.
CHUNK = 128
SPAN = "array<struct<start:int,kind:int,end:int>>"
ADDED = ["found", "_key", "_salt", "_rules"]


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost first and without overlap, of which those stay whose group has `least` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The kinds that every scan must report. Runs are matched whole, so that their least lengths may stand in the patterns.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Formats of keys that providers publish.
RULES = (
    *BASE,
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{1,16} ){0,3}PRIVATE KEY-----"),
)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often, and in whatever loop, body names it."""
    return F.transform(F.array(value), body)[0]


def _running(steps: Column) -> Column:
    """Running sums of an array of whole numbers."""

    def chunk(c):
        return F.aggregate(
            F.slice(steps, c * CHUNK + 1, CHUNK), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, s: F.struct((a["at"] + s).alias("at"), F.concat(a["out"], F.array(a["at"] + s)).alias("out")),
        )

    def joined(chunks):
        before = F.aggregate(
            chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, c: F.struct((a["at"] + c["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        )["out"]
        return F.flatten(F.zip_with(chunks, before, lambda c, b: F.transform(c["out"], lambda x: x + b)))

    return _let(F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), chunk), joined)


def places(text: Column, rule: Rule, number: int) -> Column:
    """The spans of a rule in a text."""
    pattern = F.lit(rule.pattern)

    def measured(matches):
        sizes = F.transform(matches, F.length)
        held = F.transform(matches, lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group))) if rule.group else sizes
        between = F.slice(F.transform(F.split(text, rule.pattern, -1), F.length), 1, F.size(matches))
        ends = _let(F.zip_with(between, sizes, lambda b, s: b + s), _running)
        spans = F.zip_with(
            F.arrays_zip(ends.alias("end"), sizes.alias("size")), held,
            lambda e, h: F.when(h >= rule.least, F.struct((e["end"] - e["size"]).alias("start"), F.lit(number).alias("kind"), e["end"].alias("end"))),
        )
        return F.when(F.size(matches) > 0, F.filter(spans, lambda s: s.isNotNull())).otherwise(F.array().cast(SPAN))

    return _let(F.regexp_extract_all(text, pattern, 0), measured)


def postings(docs: DataFrame, grams: Sequence[str] | None = None) -> DataFrame:
    """gram, key of each distinct text of docs: for the trigrams named, or all; letters A to Z count as a to z."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(trigrams.places(grams)), 1))
    held = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("key"), F.explode(found).alias("gram"))
    folded = F.translate("gram", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return held.select(folded.alias("gram"), "key").distinct()


def index(docs: DataFrame, grams: Sequence[str] | None = None) -> DataFrame:
    """postings(), written by trigram."""
    return written(postings(docs, grams).sortWithinPartitions("gram", "key"), "secrets-index")


def candidates(indexed: DataFrame, queries: dict[int, frozenset]) -> DataFrame:
    """key, rules: the texts that satisfy the queries of rules, by the rules' numbers."""
    rows = [(n, c, gram, len(conjunction)) for n, query in queries.items() for c, conjunction in enumerate(query) for gram in conjunction]
    asked = indexed.sparkSession.createDataFrame(rows, "rule int, conjunction int, gram string, named int")  # as large as the rules
    named = sorted({r[2] for r in rows})
    met = indexed.where(F.col("gram").isin(named)).join(F.broadcast(asked), "gram").groupBy("key", "rule", "conjunction", "named").agg(F.count("*").alias("n"))
    return met.where(F.col("n") == F.col("named")).groupBy("key").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with found: start, kind (number of the rule) and end of each span, by start, then kind."""
    docs = clashing(docs, ADDED)
    queries = {n: q for n, q in ((n, trigrams.query(r.pattern)) for n, r in enumerate(rules)) if q != trigrams.NOTHING}
    keyed = docs
    if queries:
        indexed = index(docs, sorted({g for q in queries.values() for c in q for g in c}))
        left = written(candidates(indexed, queries), "secrets-candidates").withColumnsRenamed({"key": "_key", "rules": "_rules"})
        keyed = docs.withColumn("_key", F.xxhash64("text"))
        if left.count() <= broadcast_rows:
            keyed = keyed.join(F.broadcast(left), "_key", "left")
        else:
            salted = left.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            keyed = keyed.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["_key", "_salt"], "left")
    parts = [
        F.when(F.array_contains("_rules", n), places(text_of(docs), r, n)).otherwise(F.array().cast(SPAN)) if n in queries else places(text_of(docs), r, n)
        for n, r in enumerate(rules)
    ]
    return keyed.withColumn("found", F.sort_array(F.concat(*parts))).select(*docs.columns, "found")


def written_out(spans: Column, rules: Sequence[Rule]) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: Sequence[Rule] = RULES, base: int = len(BASE)) -> DataFrame:
    """docs but for text: the number of spans of each of the first `base` rules, a digest of these, and all spans."""
    names = [*(f"n_{r.kind}" for r in rules[:base]), "base_sha256", "spans"]
    found = scan(clashing(docs, names), rules)
    of_kind = F.transform("found", lambda s: s["kind"])
    counts = [F.size(F.filter(of_kind, F.lit(n).__eq__)).cast("long").alias(f"n_{r.kind}") for n, r in enumerate(rules[:base])]
    own = written_out(F.filter("found", lambda s: s["kind"] < base), rules)
    return found.select(*(c for c in found.columns if c not in ("text", "found")), *counts, F.sha2(own, 256).alias("base_sha256"), written_out(F.col("found"), rules).alias("spans"))

"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

Voters are lexicon entries and patterns. Entries are a short list of insults, which a caller may replace, and what is
learned: words, and beginnings of words of four to six letters (for languages that inflect), that labelled toxic texts
hold far more often than clean ones. Each entry votes toxic where it occurs and abstains elsewhere. Patterns are letters
with signs or digits between them, letters drawn out, repeated exclamation, words in capitals, an entry next to a word
that addresses somebody, and many entries; each votes toxic where it is found, and three more voters vote clean where no
entry of a kind occurs. The label model, which sees votes only and no labels, puts voters that fire on the same texts
beyond what the classes explain into blocks, which vote as one, and estimates the rates of each block's votes in either
class by expectation maximisation. A logistic regression on the presence of lexicon entries and of
the commonest other words is then trained on the posteriors, and scores every text.

Learning takes at most SAMPLE labelled documents, chosen by a hash of doc_id, of those not held out (crc32 of doc_id as
text modulo 4 is 2); the bound is a parameter. What is counted comes from the executors as sums for each feature, and
what the fit sees is a list of features for each document of the sample.

Cases: null and empty texts get the score of no evidence; a null doc_id isn't held out and isn't learned from; of rows
that repeat a doc_id the smallest text is learned from; rows whose label is null aren't learned from; without labelled
rows of both kinds all scores are 0; an empty table gives an empty result; clashing columns of the input are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quire.llm.bpe import Kept
from quire.llm.common import clashing, once, small_batches, written
from quire.llm.langid import held_out

SAMPLE = 16_000
LEXICON = 400
FEATURES = 1000
KEPT_WORDS = 200_000
THRESHOLD = 0.3
#: Insults in the languages of the corpus; a parameter.
INSULTS = (
    "idiot", "moron", "stupid", "dumb", "fool", "loser", "scum", "trash", "garbage", "pathetic", "clown", "jerk", "disgusting", "worthless", "idiota", "imbécil", "estúpido", "estúpida", "tonto", "basura", "escoria", "patético", "payaso",
    "imbécile", "stupide", "crétin", "ordure", "pathétique", "débile", "trottel", "dumm", "dummkopf", "abschaum", "versager", "erbärmlich", "blödmann",
)
#: Words that address somebody.
ADDRESS = frozenset("you your you're ur du dich dir dein deine ihr euch tu te toi vous votre ton tú ti usted ustedes vosotros eres".split())
#: Patterns that vote toxic; two more are of places of entries.
PATTERNS = (
    re.compile(r"[^\W\d_][@$*#0-9]+[^\W\d_]"),
    re.compile(r"([^\W\d_])\1{3}"),
    re.compile(r"[!?]{3}"),
    re.compile(r"\b[A-Z]{4,}\W+[A-Z]{4,}\b"),
)
MANY = 3
_EDGES = ".,;:!?\"'()[]{}<>«»„“”…-–—*_#"


def features(piece: str) -> tuple[str, ...]:
    """The word of a piece of text, and its beginnings; a word stands as it is, a beginning with a sign after it."""
    word = piece.lower().strip(_EDGES)
    if not word or not word[0].isalpha():
        return ()
    return (word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) > n))


def _present(text: str, of_piece: Kept) -> set[str]:
    out: set[str] = set()
    for found in map(of_piece.__getitem__, set(text.split())):
        out.update(found)
    return out


class LabelModel:
    """Two classes behind votes (1 toxic, -1 clean, 0 abstains), from the votes alone.

    Voters for one class that fire together beyond what the classes explain are one block, whose value is the pattern of
    its votes; patterns of few rows count by their sum. Blocks are independent within a class, and their rates and the
    posterior come from expectation maximisation, which ends when the likelihood has stopped rising. A voter for clean
    whose vote is a function of the votes for toxic says nothing new, and has no part in the likelihood. Three blocks at
    least are needed to tell two classes apart; with fewer, any vote for toxic decides.
    """

    LINK, RARE, GAIN = 0.7, 8, 1e-7

    def __init__(self, prior: float, rounds: int = 200):
        self.prior, self.rounds = prior, rounds

    def fit(self, votes: np.ndarray) -> np.ndarray:
        """The posterior of class 1 for each row."""
        rows, back, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
        fires, toxic = (rows != 0).astype(float), rows.sum(axis=0) >= 0
        posterior = np.where((rows > 0).any(axis=1), 0.9, 0.05)
        self._rates(fires, n, posterior)
        rest = fires - posterior[:, None] * self.rate1 - (1 - posterior)[:, None] * self.rate0
        spread = np.sqrt(n @ rest**2) + 1e-9
        correlation = (rest * n[:, None]).T @ rest / np.outer(spread, spread)
        block = self._linked((correlation > self.LINK) & (toxic[:, None] == toxic))
        patterns = len(np.unique(fires[:, toxic], axis=0))
        told = [not t and len(np.unique(fires[:, toxic | (np.arange(len(toxic)) == v)], axis=0)) == patterns for v, t in enumerate(toxic)]
        self.weight = np.where(told, 0, 1 / np.bincount(block)[block])
        values = [(self._patterns(rows[:, block == b], n), bool(self.weight[block == b].any())) for b in range(block.max() + 1)]
        values = [v for v, counts in values if counts and v.max() > 0]
        self.blocks = len(values)
        if self.blocks >= 3:
            posterior = self._maximised(values, n, posterior)
            self._rates(fires, n, posterior)
        return posterior[back.ravel()]

    def _rates(self, fires: np.ndarray, n: np.ndarray, posterior: np.ndarray) -> None:
        """How often each voter fires in either class."""
        one, zero = n * posterior, n * (1 - posterior)
        self.rate1, self.rate0 = (one @ fires + 0.5) / (one.sum() + 1), (zero @ fires + 0.5) / (zero.sum() + 1)

    @staticmethod
    def _linked(near: np.ndarray) -> np.ndarray:
        """Numbers of the components of a symmetric relation."""
        label = np.arange(len(near))
        while True:
            least = np.minimum(label, np.where(near, label, len(near)).min(axis=1))
            if (least == label).all():
                return np.unique(label, return_inverse=True)[1]
            label = least

    def _patterns(self, votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The number of each row's pattern of votes."""
        found, code = np.unique(votes, axis=0, return_inverse=True)
        few = np.bincount(code.ravel(), weights=n) < self.RARE
        name = np.where(few, len(found) + 3 + np.clip(found.sum(axis=1), -3, 3), np.arange(len(found)))
        return np.unique(name[code.ravel()], return_inverse=True)[1]

    def _maximised(self, values: list[np.ndarray], n: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        best = -np.inf
        for _ in range(self.rounds):
            log1, log0 = np.log(self.prior), np.log1p(-self.prior)
            for value in values:
                many = int(value.max()) + 1
                one, zero = (np.bincount(value, weights=n * p, minlength=many) + 0.5 / many for p in (posterior, 1 - posterior))
                log1, log0 = log1 + np.log(one / one.sum())[value], log0 + np.log(zero / zero.sum())[value]
            posterior = 1 / (1 + np.exp(np.clip(log0 - log1, -60, 60)))
            likelihood = float(n @ np.logaddexp(log1, log0))
            if likelihood <= best + self.GAIN * n.sum():
                break
            best = likelihood
        return posterior


class Sparse:
    """A matrix of zeros and ones: the columns that are set, row by row."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.width, self.sizes = width, np.fromiter(map(len, rows), np.int64, len(rows))
        self.columns = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.columns], minlength=len(self.sizes))

    def back(self, v: np.ndarray) -> np.ndarray:
        """The transpose times v."""
        return np.bincount(self.columns, weights=v[self.row], minlength=self.width)


def logistic(x: Sparse, target: np.ndarray, l2: float = 2.0, rounds: int = 300, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets, by Adam over all rows."""
    n = len(target)
    w, b = np.zeros(x.width), float(np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6)))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        error = 1 / (1 + np.exp(-np.clip(x.dot(w) + b, -60, 60))) - target
        gradient = np.append((x.back(error) + l2 * w) / n, error.mean())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = rate / np.sqrt(t) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


class Classifier:
    def __init__(self, vocabulary: list[str], weights: np.ndarray, bias: float):
        self.weights, self.bias = dict(zip(vocabulary, weights.tolist(), strict=True)), bias
        known = self.weights
        self.of_piece = Kept(lambda piece: tuple(f for f in features(piece) if f in known), KEPT_WORDS)

    def score(self, text: str) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, sorted(_present(text, self.of_piece))))
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -60, 60))))


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic of at most about `sample` labelled documents that are not held out."""
    key = F.col("doc_id")
    own = labels.where(key.isNotNull() & F.col("toxic").isNotNull() & ~held_out(key)).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    n = own.count()
    chosen = own.where(F.pmod(F.xxhash64(key, F.lit(8)), F.lit(1 << 20)) < min(1.0, sample / max(1, n)) * (1 << 20)).limit(2 * sample)  # the bound, should hashes fall badly
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_toxic").alias("toxic"))
    return written(rows.select("text", "toxic"), "toxicity-sample")


def patterns(text: str, entries: set[str]) -> list[int]:
    """The numbers of the patterns that a text has."""
    found = [i for i, p in enumerate(PATTERNS) if p.search(text)]
    words = [w.lower().strip(_EDGES) for w in text.split()]
    at = [i for i, w in enumerate(words) if w in entries or any(w[:n] + "*" in entries for n in (4, 5, 6))]
    if any(not ADDRESS.isdisjoint(words[max(0, i - 3) : i + 4]) for i in at):
        found.append(len(PATTERNS))
    if len(at) >= MANY:
        found.append(len(PATTERNS) + 1)
    return found


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, insults: tuple[str, ...] = INSULTS) -> Classifier:
    small_batches(docs.sparkSession)
    rows = sampled(docs, labels, sample)
    kinds = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = kinds.get(1, 0), sum(n for k, n in kinds.items() if k != 1)
    if not toxic or not clean:
        return Classifier([], np.zeros(0), -60.0)

    def count(batches):
        of_piece = Kept(features, KEPT_WORDS)
        found = {1: Counter(), 0: Counter()}
        for b in batches:
            for text, kind in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                found[int(kind == 1)].update(_present(text, of_piece))
        names = list(found[1].keys() | found[0].keys())  # all of them: what is rare here may be common over the partitions
        for at in range(0, len(names), 10_000):
            part = names[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([found[k][f] for f in part], pa.int64()) for k in (1, 0))], names=["feature", "toxic", "clean"])

    counts = rows.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = written(counts, "toxicity-counts")
    # how far an entry's share of the toxic texts exceeds its share of all, as a log-likelihood ratio; what many features show by chance is no evidence
    both = F.col("toxic") + F.col("clean")
    excess = 2 * (F.col("toxic") * F.log(F.col("toxic") / both * ((toxic + clean) / toxic)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / both * ((toxic + clean) / clean))).otherwise(0.0))
    often = counts.where((F.col("toxic") >= 2) & ((F.col("toxic") + 0.5) / (toxic + 1) >= 6 * (F.col("clean") + 0.5) / (clean + 1)))
    chance = 2 * float(np.log(max(2, often.count())))
    lexicon = [r["feature"] for r in often.withColumn("excess", excess).where(F.col("excess") >= chance).orderBy(F.desc("excess"), "feature").limit(LEXICON).collect()]
    common = [r["feature"] for r in counts.where(~F.col("feature").endswith("*")).orderBy(F.desc(F.col("toxic") + F.col("clean")), "feature").limit(FEATURES - LEXICON).collect()]
    listed = [r["feature"] for r in counts.where(F.col("feature").isin(*insults) if insults else F.lit(False)).select("feature").collect()]
    lexicon += sorted(set(listed) - set(lexicon))
    vocabulary = lexicon + [f for f in common if f not in set(lexicon)]
    if not lexicon:
        return Classifier([], np.zeros(0), -60.0)
    place, entries = {f: i for i, f in enumerate(vocabulary)}, set(lexicon)

    def encode(batches):
        of_piece = Kept(lambda p: tuple(place[f] for f in features(p) if f in place), KEPT_WORDS)
        pack = lambda places: np.array(places, "<i2").tobytes()
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([pack(sorted(_present(t, of_piece))) for t in texts], pa.binary()), pa.array([pack(patterns(t, entries)) for t in texts], pa.binary())], names=["f", "p"])

    encoded = [(np.frombuffer(r["f"], "<i2"), np.frombuffer(r["p"], "<i2")) for r in rows.mapInArrow(encode, "f binary, p binary").toLocalIterator()]
    votes = np.zeros((len(encoded), len(lexicon) + len(PATTERNS) + 2 + 3), np.float32)
    words = np.array([not f.endswith("*") for f in lexicon])
    for i, (f, p) in enumerate(encoded):
        own = f[f < len(lexicon)]
        votes[i, own] = 1
        votes[i, len(lexicon) + p] = 1
        votes[i, -3:] = [-float(none) for none in (not len(own), not words[own].any(), words[own].all())]
    posterior = LabelModel(prior=toxic / (toxic + clean)).fit(votes)
    return Classifier(vocabulary, *logistic(Sparse([f for f, _ in encoded], len(vocabulary)), posterior))


def score(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted."""
    small_batches(docs.sparkSession)
    rest = clashing(docs, ["held_out", "score", "predicted"])
    schema, names = StructType([*rest.schema.fields, StructField("score", DoubleType())]), rest.columns
    vocabulary, weights, bias = list(model.weights), np.array(list(model.weights.values())), model.bias

    key = uuid.uuid4().hex

    def run(batches):
        classifier = once(key, lambda: Classifier(vocabulary, weights, bias))
        for b in batches:
            scores = [classifier.score(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(scores, pa.float64())], names=schema.names)

    scored = rest.mapInArrow(run, schema)
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text and others) with held_out, score and predicted, by a model learned from labels (doc_id, toxic)."""
    return score(docs, learn(docs, labels, sample))

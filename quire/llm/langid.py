"""Language identification by spans: script ranges, per-word scores and Viterbi with a switching penalty.

Each language has the scripts that its training texts use and the frequencies of letter trigrams (word ends included).
A word's script narrows the candidates; its score in a candidate is the sum of its trigrams' log probabilities, and the
other languages lose DEFEAT. The most probable sequence of languages, in which each change costs SWITCH, labels every
word, so a text of several languages falls into spans. A text's language is the one of most letters.

The Viterbi search is left out only where its result is known: if no stretch of words favours any other language over
the best single one by more than a change costs, nor a beginning and an end of the text together, that one labels all
words. The search takes stretches of many texts in lockstep. New words are scored together, and their scores kept in a
table of bounded size (or of one long text's words).

Learning takes at most SAMPLE documents of each language, chosen by a hash of doc_id, of those with a lang and not held
out (crc32 of doc_id as text modulo 4 is 2), and at most LANGUAGES languages; both bounds are parameters. Counts are added
up on the executors.

Cases: null texts and texts without letters are `und` with score 0; words without letters belong to the span around
them; a null doc_id isn't held out and isn't learned from; without any training text all is `und`; an empty table gives
an empty result; clashing columns of the input are replaced.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from quire.llm.common import clashing, once, small_batches

SAMPLE = 3000
SWITCH = 12.0
DEFEAT = 20.0
BUCKETS = 1 << 16
#: Languages that are learned, the commonest first; a model has BUCKETS numbers of four bytes for each.
LANGUAGES = 256
KEPT_WORDS = 300_000
#: Texts are labelled together up to so many characters times languages (four at least); a longer one alone.
GROUP_CHARACTERS = 1 << 24
#: Words of a stretch in the search.
_STEPS = 128
#: The first code points of ranges of scripts; what lies before the next one belongs to the script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF21, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
)
#: Names of scripts in order, so that of equal counts the smaller number is the smaller name.
NAMES = sorted({name for _, name in SCRIPTS})
_BEGIN, _END = ord("^"), ord("$")
#: Letters whose trigrams are looked up at once.
_LETTERS = 1 << 18


@functools.cache
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point, whether it is a letter, and the number of its script."""
    starts = [s for s, _ in SCRIPTS]
    numbers = np.array([NAMES.index(name) for _, name in SCRIPTS], np.int8)
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return letter, np.repeat(numbers, np.diff([*starts, 0x110000]))


class Words:
    """Words taken apart: the letters of each, its script (-1 without letters), and the buckets of its letters' trigrams.

    A letter's trigram is the letter, in lower case, between its neighbours or the word's ends. `of` is the word of each
    letter; words follow each other.
    """

    def __init__(self, words: list[str]):
        is_letter, script_of = _code_points()
        lower = [w.lower() for w in words]
        codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
        of = np.repeat(np.arange(len(words), dtype=np.int64), np.fromiter(map(len, lower), np.int64, len(lower)))
        there = is_letter[codes]
        codes, self.of = codes[there], of[there]
        self.letters = np.bincount(self.of, minlength=len(words))
        at = np.arange(len(codes)) + 2 * self.of + 1  # with two places more for each word before, and its own begin
        padded = np.full(len(codes) + 2 * len(words) + 2, _END, np.uint64)
        padded[np.cumsum(self.letters + 2) - self.letters - 2] = _BEGIN
        padded[at] = codes
        mixed = padded[at - 1] * np.uint64(0x9E3779B97F4A7C15) + padded[at] * np.uint64(0xC2B2AE3D27D4EB4F) + padded[at + 1] * np.uint64(0x165667B19E3779F9)
        self.buckets = ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 16)).astype(np.int64) % BUCKETS
        # the script of most letters
        self.script = np.full(len(words), -1, np.int64)
        if len(codes):
            own = script_of[codes].astype(np.int64)
            begin = np.flatnonzero(np.diff(self.of, prepend=-1))
            known = self.of[begin]
            low, high = np.minimum.reduceat(own, begin), np.maximum.reduceat(own, begin)
            self.script[known] = low
            several = np.zeros(len(words), bool)
            several[known[low != high]] = True
            if several.any():
                some = several[self.of]
                numbers = np.cumsum(several) - 1
                counts = np.bincount(numbers[self.of[some]] * len(NAMES) + own[some], minlength=int(several.sum()) * len(NAMES))
                self.script[several] = counts.reshape(-1, len(NAMES)).argmax(axis=1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Model:
    """Log probabilities of trigrams (a row each, a column for each language) and the languages of each script."""

    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray):
        """grams: counts by language and bucket; scripts: counts by language and number of the script."""
        self.languages = languages
        table = grams.T.astype(float)
        # in steps of 1 / 1024, so that sums are exact and don't depend on what is added up together
        self.log = np.ascontiguousarray(np.round((np.log(table + 0.1) - np.log(table.sum(axis=0) + 0.1 * BUCKETS)) * 1024) / 1024, np.float32)
        uses = (scripts.T > 0) & (scripts.T >= 0.01 * scripts.sum(axis=1))
        self.uses = uses | ~uses.any(axis=1, keepdims=True)  # a script that none uses narrows nothing

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words in each language, relative to the best, and their letters; zeros without letters."""
        found = Words(words)
        scores = np.zeros((len(words), len(self.languages)))
        for at in range(0, len(found.of), _LETTERS):
            of = found.of[at : at + _LETTERS]
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            scores[of[begin]] += np.add.reduceat(self.log[found.buckets[at : at + _LETTERS]], begin, axis=0, dtype=np.float64)
        uses = self.uses[found.script]
        best = np.where(uses, scores, -np.inf).max(axis=1, keepdims=True)
        scores = np.where(uses, scores, best - DEFEAT)
        scores = np.maximum(scores - scores.max(axis=1, keepdims=True), -DEFEAT)
        scores[found.letters == 0] = 0.0
        return scores, found.letters


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best sequence of columns of scores (a row for each word), each change of which costs `switch`."""
    return paths(scores, [0, len(scores)], switch)


def paths(scores: np.ndarray, edges: list[int], switch: float = SWITCH) -> np.ndarray:
    """viterbi() of each of the texts whose words are scores[edges[i] : edges[i + 1]]."""
    out, unsure = np.empty(len(scores), np.int64), []
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            best = _only(scores[a:b], switch)
            out[a:b] = best
            if best < 0:
                unsure.append((a, b))
    if unsure:
        cost = np.full(sum(b - a for a, b in unsure), switch)
        cost[np.cumsum([0, *(b - a for a, b in unsure[:-1])])] = 0.0  # any language may begin a text
        found = _search(np.concatenate([scores[a:b] for a, b in unsure]), cost)
        out[out < 0] = found
    return out


def _only(scores: np.ndarray, switch: float) -> int:
    """The best single language, if no path with changes can be better, else -1."""
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    before = np.concatenate([np.zeros((1, scores.shape[1])), gain[:-1]])
    lowest = np.minimum(np.minimum.accumulate(before, axis=0), 0)
    # r stretches next to each other in other languages cost r + 1 changes inside a text and r at an end, so they don't pay
    # if none gains more than a change; without any word in the best language they cost r - 1, of which the first and the
    # last stretch, which begin and end with the text, must not gain more than one together
    sure = (gain - lowest).max() <= switch and max(0.0, gain.max()) + max(0.0, (gain[-1] - before).max()) <= switch
    return best if sure else -1


def _search(scores: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The best sequence where changing before word t costs cost[t].

    Stretches of _STEPS words are taken in lockstep: first what each gives from every language before it to every one at
    its end, which chained give the values that each begins with; then each by itself, with the way back.
    """
    n, k = scores.shape
    m = -(-n // _STEPS)
    scores = np.concatenate([scores, np.zeros((m * _STEPS - n, k))]).reshape(m, _STEPS, k)
    cost = np.concatenate([cost, np.full(m * _STEPS - n, SWITCH)]).reshape(m, _STEPS)
    begins = np.zeros((m, k))
    room = max(1, (1 << 21) // (k * k))
    for at in range(0, m, room):
        part, costs = scores[at : at + room], cost[at : at + room]
        gives = np.where(np.eye(k, dtype=bool), 0.0, -np.inf) + np.zeros((len(part), 1, 1))
        for t in range(_STEPS):
            gives = np.maximum(gives, gives.max(axis=2, keepdims=True) - costs[:, t, None, None]) + part[:, t, None, :]
        for i in range(at, min(at + room, m - 1)):
            begins[i + 1] = (begins[i][:, None] + gives[i - at]).max(axis=0)
    value, all_ = begins, np.arange(k)
    back = np.empty((_STEPS, m, k), np.int16)
    for t in range(_STEPS):
        floor = value.max(axis=1, keepdims=True) - cost[:, t, None]
        back[t] = np.where(value >= floor, all_, value.argmax(axis=1)[:, None])
        value = np.maximum(value, floor) + scores[:, t]
    # the language before each stretch for each at its end, and so the one at its end
    of = np.broadcast_to(all_, (m, k))
    for t in reversed(range(_STEPS)):
        of = np.take_along_axis(back[t], of, axis=1)
    at = int(value[-1].argmax())
    ends = np.empty(m, np.int64)
    for i in reversed(range(m)):
        ends[i] = at
        at = int(of[i, at])
    path = np.empty((m, _STEPS), np.int64)
    rows = np.arange(m)
    for t in reversed(range(_STEPS)):
        path[:, t] = ends
        ends = back[t][rows, ends].astype(np.int64)
    return path.ravel()[:n]


def learn(df: DataFrame, sample: int = SAMPLE, most: int = LANGUAGES) -> Model:
    """A model of df (doc_id, text, lang), of rows that have a lang and aren't held out."""
    small_batches(df.sparkSession)
    rows = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    there = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not there:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(NAMES))))
    share = F.create_map(*[x for lang, n in there.items() for x in (F.lit(lang), F.lit(min(1.0, sample / n)))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("text", "lang")

    def count(batches):
        # of a language: counts of trigrams, and behind them of scripts
        found: dict[str, np.ndarray] = {}
        for b in batches:
            held: dict[str, Counter] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(text.split())
            for lang, counted in held.items():
                own = Words(list(counted))
                n = np.fromiter(counted.values(), np.int64, len(counted))
                sums = found.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                sums[:BUCKETS] += np.bincount(own.buckets, weights=n[own.of], minlength=BUCKETS).astype(np.int64)
                known = own.script >= 0
                sums[BUCKETS:] += np.bincount(own.script[known], weights=n[known], minlength=len(NAMES)).astype(np.int64)
        for lang, sums in found.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["lang", "place", "n"])

    counted = chosen.mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    sums = {lang: np.zeros(BUCKETS + len(NAMES)) for lang in sorted(there)}
    for r in counted.toLocalIterator():  # at most a row for each bucket and script, of `most` languages
        sums[r["lang"]][r["place"]] = r["n"]
    languages = [lang for lang, own in sums.items() if own[BUCKETS:].any()]
    table = np.array([sums[lang] for lang in languages]).reshape(-1, BUCKETS + len(NAMES))
    return Model(languages, table[:, :BUCKETS], table[:, BUCKETS:])


_SPAN = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType()), StructField("lang", StringType())])
_ADDED = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", ArrayType(_SPAN))]


class Labeller:
    """Labels texts by a model; scores of words are kept in a table of about KEPT_WORDS rows."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.scores = np.zeros((1024, max(1, len(self.model.languages))))
        self.letters = np.zeros(1024, np.int64)
        self.index: dict[str, int] = {}

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The rows of words (each once) in the table."""
        found = np.fromiter((self.index.get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(self.index) + len(missing) > KEPT_WORDS and self.index:
            self._forget()
            missing = np.arange(len(words))
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            at, end = len(self.index), len(self.index) + len(new)
            if end > len(self.scores):
                more = max(end, 2 * len(self.scores)) - len(self.scores)
                self.scores = np.concatenate([self.scores, np.zeros((more, self.scores.shape[1]))])
                self.letters = np.concatenate([self.letters, np.zeros(more, np.int64)])
            self.scores[at:end], self.letters[at:end] = self.model.words(new)
            self.index.update(zip(new, range(at, end), strict=True))
            found[missing] = np.arange(at, end)
        return found

    def texts(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score, and spans of words (begin, end without it, language) of each text."""
        if not self.model.languages:
            return [("und", 0.0, [])] * len(texts)
        out, at = [], 0
        room = GROUP_CHARACTERS // max(4, len(self.model.languages))
        while at < len(texts):  # texts that are short enough together
            end, held = at + 1, len(texts[at])
            while end < len(texts) and held + len(texts[end]) <= room:
                held += len(texts[end])
                end += 1
            out += self._group(texts[at:end])
            at = end
        return out

    def _group(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        words = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        flat, edges = words.flatten(), words.offsets.to_numpy()
        there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at an end of a text gives an empty word
        if not there.all():
            flat, edges = flat.filter(pa.array(there)), np.concatenate([[0], np.cumsum(there)])[edges]
        coded = flat.dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        scores, letters, edges = self.scores[numbers], self.letters[numbers], edges.tolist()
        path = paths(scores, edges)
        return [self._labelled(scores[a:b], letters[a:b], path[a:b]) for a, b in zip(edges, edges[1:], strict=False)]

    def text(self, text: str) -> tuple[str, float, list[tuple[int, int, str]]]:
        return self.texts([text])[0]

    def _labelled(self, scores: np.ndarray, letters: np.ndarray, path: np.ndarray) -> tuple[str, float, list[tuple[int, int, str]]]:
        if not letters.any():
            return "und", 0.0, []
        by_language = np.bincount(path, weights=letters, minlength=len(self.model.languages))
        best = int(by_language.argmax())
        total = scores.sum(axis=0)
        other = np.delete(total, best)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]]).tolist()
        sure = 1.0 / (1.0 + float(np.exp(np.clip(other - total[best], -50, 50)).sum())) if len(cuts) == 2 else 1.0
        spans = [(a, b, self.model.languages[path[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return self.model.languages[best], float(by_language[best] / letters.sum() * sure), spans


def label(df: DataFrame, model: Model) -> DataFrame:
    """df with lang_pred, score and spans of its text."""
    small_batches(df.sparkSession)
    kept = clashing(df, [f.name for f in _ADDED])
    schema = StructType([*kept.schema.fields, *_ADDED])
    names = kept.columns
    sent = df.sparkSession.sparkContext.broadcast(model)  # its size is BUCKETS rows of a number for each language

    key = uuid.uuid4().hex

    def run(batches):
        labeller = once(key, lambda: Labeller(sent.value))
        for b in batches:
            found = labeller.texts([t or "" for t in b.column("text").to_pylist()])
            spans = pa.array([[dict(zip(("begin", "end", "lang"), s, strict=True)) for s in f[2]] for f in found], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans], names=schema.names)

    return kept.mapInArrow(run, schema)


def identify(df: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """df (doc_id, text, lang and others) with held_out, lang_pred, score and spans, by a model learned from df."""
    model = learn(df, sample)
    return label(clashing(df, ["held_out"]), model).withColumn("held_out", held_out(F.col("doc_id")))


def keep_identified(df: DataFrame, least: float = 0.0, sample: int = SAMPLE) -> DataFrame:
    """The rows of df whose language is known, of several languages too, with df's columns; those below a score of `least` go."""
    # under names of its own, so that columns of df that are called so stay
    text = df.select("doc_id", "text", "lang")
    model = learn(text, sample)
    sent = df.sparkSession.sparkContext.broadcast(model)

    key = uuid.uuid4().hex

    def run(batches):
        labeller = once(key, lambda: Labeller(sent.value))
        for b in batches:
            found = labeller.texts([t or "" for t in b.column("text").to_pylist()])
            yield b.filter(pa.array([lang != "und" and score >= least for lang, score, _ in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)

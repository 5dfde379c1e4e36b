"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

The exact merges of a word are the one sequence of tokens in which every two neighbours are compatible: merging the
text of both gives just them again. So a word is encoded from left to right with the longest token that matches (an
Aho-Corasick automaton finds them all), and where that isn't compatible with the token before, with the next shorter
one; when none is left the last token is taken back. Positions from which there is no way on are marked, so each is
left once at most and the time is linear in the word. Compatibility is looked up in a table that fills as pairs occur.

The file of the vocabulary names the steps before the merges (a normaliser and a splitting pattern); those of a word
tokenizer (NFC, white space, lower case; words with an end mark) are done here. As no word spans white space, texts are
cut there and the ids of a piece are kept in a table of bounded size. Decoding gathers the bytes of all tokens of a text
at once, from one buffer and the offset of each token in it.

Cases: a null text is the empty text, of no ids and an empty decoded text; a text is encoded whole, however long; the
strings of special tokens in a text give their ids, as in the library; other columns stay as they are, and those whose
names clash with added ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from quire.llm.common import clashing, once, small_batches

#: Pieces and words whose ids a worker keeps (two generations each).
KEPT_PIECES = 250_000
_END = "</w>"
_LAST = 256  # added to the symbol of a word's last byte
#: What the pattern engine of the library takes for white space.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = re.compile(f"[{_SPACES}]+")
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space to str.split, but not to that engine


def byte_of_char() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: printable bytes stand for themselves, others for code points from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Kept(dict):
    """A table of bounded size: entries that were not asked for while it filled twice are forgotten."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordBpe:
    def __init__(self, path: str, kept: int = KEPT_PIECES):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.alphabet = spec["model"], byte_of_char()
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]] if spec["normalizer"] else []
        if model.get("end_of_word_suffix") != _END or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError(f"{path} is not a lower-casing vocabulary with word ends")
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        def symbols(token: str) -> str:
            last = token.endswith(_END) and len(token) > len(_END)
            raw = [self.alphabet[c] for c in (token.removesuffix(_END) if last else token)]
            return "".join(map(chr, raw[:-1])) + chr(raw[-1] + _LAST * last)

        ids = {symbols(t): i for t, i in model["vocab"].items()}
        self.many = max(ids.values()) + 1
        self.rank: dict[int, int] = {}  # of the pair a, b: at a * many + b
        parts: dict[int, tuple[int, int, int]] = {}  # of a token, and the rank of their merge
        for n, pair in enumerate(model["merges"]):
            a, b = map(symbols, pair if isinstance(pair, list) else pair.split(" "))
            self.rank[ids[a] * self.many + ids[b]] = n
            parts.setdefault(ids[a + b], (ids[a], ids[b], n))
        # what a token was merged from along an edge: each with the rank that made it (-1: none) and the one that used it up
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        for side in (0, 1):
            for token in ids.values():
                edge, used = [], self.many
                while token in parts:
                    edge.append((token, parts[token][2], used))
                    used, token = parts[token][2], parts[token][side]
                edge.append((token, -1, used))
                self.edges[side][edge[0][0]] = edge
        whole = {t: t not in parts for t in ids.values()}  # tokens that the merges of their own bytes give
        for t, (a, b, n) in parts.items():  # in the order of the ranks
            whole[t] = whole[a] and whole[b] and self._compatible(a * self.many + b, n)
        usable = {s: t for s, t in ids.items() if whole[t]}
        self.size = {t: len(s) for s, t in usable.items()}
        self.shorter = {t: next((usable[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in usable), None) for s, t in usable.items()}
        self.automaton = ahocorasick.Automaton()
        for s, t in usable.items():
            self.automaton.add_word(s, (len(s), t))
        self.automaton.make_automaton()
        self.packed = [i.to_bytes(4, "little") for i in range(self.many)]
        self.pairs: Kept = Kept(self._compatible, kept)
        self.words: Kept = Kept(self._word, kept)
        self.pieces: Kept = Kept(self._piece, kept)
        # decoding: tokens are joined by a blank
        names = {**{i: t for t, i in model["vocab"].items()}, **{i: t for t, i in self.special.items()}}
        spelt = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.buffer = np.frombuffer(b"".join(spelt), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(s) for s in spelt])])

    # --- encoding

    def _compatible(self, pair: int, limit: int | None = None) -> bool:
        """Whether no merge across the boundary of a token pair comes before the merges on either side (or the rank limit).

        Backwards in time: of the two symbols at the boundary the one made last is undone. Of equal ranks the left merge
        comes first.
        """
        limit, rank = self.many if limit is None else limit, self.rank
        left, right = self.edges[1][pair // self.many], self.edges[0][pair % self.many]
        i = j = 0
        (x, x_made, x_used), (y, y_made, y_used) = left[0], right[0]
        while True:
            r = rank.get(x * self.many + y)
            if r is not None and r < x_used and r <= y_used and r < limit:
                return False
            if x_made > y_made:
                i += 1
                x, x_made, x_used = left[i]
            elif y_made >= 0:
                j += 1
                y, y_made, y_used = right[j]
            else:
                return True

    def tokens(self, word: str) -> list[int]:
        """The merges of a word of symbols."""
        n = len(word)
        longest: list[tuple[int, int]] = [(0, -1)] * n
        for end, match in self.automaton.iter(word):
            start = end + 1 - match[0]
            if match > longest[start]:
                longest[start] = match
        open_ = [True] * (n + 1)
        out: list[int] = []
        at, token, many, size, shorter, pairs = 0, longest[0][1] if n else None, self.many, self.size, self.shorter, self.pairs
        while at < n:
            before = out[-1] * many if out else -1
            while token is not None and not (open_[at + size[token]] and (before < 0 or pairs[before + token])):
                token = shorter[token]
            if token is not None:
                out.append(token)
                at += size[token]
                token = longest[at][1] if at < n else None
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                open_[at] = False
                token = out.pop()
                at -= size[token]
                token = shorter[token]
        return out

    def _word(self, raw: str) -> bytes:
        """raw: the bytes of a word, each as the character of its number."""
        return b"".join([self.packed[t] for t in self.tokens(raw[:-1] + chr(ord(raw[-1]) + _LAST))])

    def _piece(self, piece: str) -> bytes:
        if self.special_pattern is not None and "<|" in piece:
            parts = self.special_pattern.split(piece)
            return b"".join([self.special[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in enumerate(parts)])
        return self._plain(piece)

    def _plain(self, piece: str) -> bytes:
        if piece.isascii():
            piece = piece.lower()
            found = (piece,) if piece.isalpha() else self.word.findall(piece)
        elif max(piece) < "\u0250":
            piece = unicodedata.normalize("NFC", piece).lower()
            found = [w.encode().decode("latin-1") for w in ((piece,) if piece.isalpha() else self.word.findall(piece))]
        else:  # the library's own steps, as versions of Unicode differ
            words = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(piece))
            found = [bytes(map(self.alphabet.__getitem__, w)).decode("latin-1") for w, _ in words]
        return b"".join([self.words[w] for w in found])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        pieces = _SPLIT.split(text) if any(s in text for s in _SEPARATORS) else text.split()
        return b"".join(map(self.pieces.__getitem__, pieces))

    # --- decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8."""
        if not len(ids):
            return b""
        begin = self.offset[ids]
        size = self.offset[ids.astype(np.int64) + 1] - begin
        end = np.cumsum(size)
        at = np.repeat(begin - end + size, size) + np.arange(end[-1])
        return self.buffer[at][:-1].tobytes()


def loaded(path: str) -> WordBpe:
    return once(f"word-bpe {path}", lambda: WordBpe(path))


def _with(df: DataFrame, columns: dict, make) -> DataFrame:
    """df with columns that make(batch) computes; made on the executors from whole texts."""
    small_batches(df.sparkSession)
    rest = clashing(df, list(columns))
    schema = StructType([*rest.schema.fields, *[StructField(n, t) for n, t in columns.items()]])
    names = rest.columns

    def run(batches):
        for b in batches:
            added = make(b)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *added], names=[*names, *schema.names[len(names) :]])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str) -> DataFrame:
    """df with ids, the token ids of its text, and n_tokens."""

    def make(batch):
        bpe = loaded(path)
        packed = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
        sizes = np.cumsum([0] + [len(p) // 4 for p in packed])
        ids = pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())
        return [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), ids), pa.array(np.diff(sizes), pa.int64())]

    return _with(df, {"ids": ArrayType(IntegerType()), "n_tokens": LongType()}, make)


def decode(df: DataFrame, path: str) -> DataFrame:
    """df with decoded, the text of its ids."""

    def make(batch):
        bpe = loaded(path)
        return [pa.array([bpe.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()], pa.string())]

    return _with(df, {"decoded": StringType()}, make)


def tokenized(df: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """df with ids (unless left out), n_tokens and the SHA-256 of ids and of the text they decode to, which is not moved."""

    def make(batch):
        bpe, all_ids, sizes, of_ids, of_text = loaded(path), [], [0], [], []
        for text in batch.column("text").to_pylist():
            packed = bpe.encode(text or "")
            sizes.append(len(packed) // 4)
            of_ids.append(hashlib.sha256(packed).hexdigest())
            of_text.append(hashlib.sha256(bpe.decode(np.frombuffer(packed, "<u4"))).hexdigest())
            if with_ids:
                all_ids.append(packed)
        out = [pa.array(sizes[1:], pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
        if with_ids:
            ids = pa.array(np.frombuffer(b"".join(all_ids), "<i4"), pa.int32())
            out.insert(0, pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), ids))
        return out

    ids = {"ids": ArrayType(IntegerType())} if with_ids else {}
    return _with(df, ids | {"n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType()}, make)


def digests(df: DataFrame, path: str) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256: encode() and decode() without moving either."""
    return tokenized(df, path, with_ids=False)

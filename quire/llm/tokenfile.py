"""Token ids in files: an adaptive range coder that mixes predictions of order 0 to 2, in independent blocks.

A block holds up to BLOCK ids, cut into lanes of consecutive ids that are coded in lockstep, one id of each lane at a
time, so that each step is a few array operations. All lanes share the block's model, which learns after each step:
order 2 and order 1 predict the id that followed the last two ids, or the last one, when they were seen before, each
with a confidence of 0 to 3, and order 0 counts ids. For each pair of confidences the model counts how often order 2,
order 1 or neither was right, and mixes the three by these shares into one distribution, with which a range coder of
64 bits codes the id. Every block begins with an empty model and carries a CRC-32 of its ids.

A file is a header, blocks, and an index with the doc_id and number of ids of each document; documents lie in ascending
order of doc_id and may span blocks. Files are written to the shared folder under a name of the task's own; the list of
files that the tasks return says which of them count.

Texts are encoded by the tokenizers library. Its splitting pattern never looks back past a blank that follows something
else, nor past a line feed or a sign that follows a letter, so texts are cut there; the distinct pieces of many texts go to the library
together, and the ids of those that come again are kept in a table of bounded size.

Cases: null text counts as empty, and a document of no ids still has its end id; a null doc_id sorts first; rows that
repeat a doc_id follow each other in the order of their texts; an empty table gives no files and an empty result; other
columns are ignored; a block whose ids don't give its checksum, or a file that ends early, is an error.
"""

from __future__ import annotations

import functools
import io
import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import new_path, small_batches, written

BLOCK = 1 << 19
STEPS = 256  # of a lane, at most
#: Pieces kept at a time; beyond it only those are kept on that came again, if they are at most half as many.
KEPT_PIECES = 1_000_000
#: Texts are encoded together up to so many characters; a longer one alone.
GROUP_CHARACTERS = 1 << 22
_BLANK, _LINE = "\u0120", "\u010a"  # stand for a blank and a line feed in byte-level vocabularies
_MAGIC = b"QTOKENS1"
_BASE = 18  # bits of the order-0 distribution
_MIX = 6  # bits of the mixture
_SLOTS = 1 << 18  # of order 2


class DamagedFile(ValueError):
    pass


class Mixture:
    """The model of one block, for ids below `size`. Encoder and decoder take the same steps."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size, np.int64)
        self.recent: list[np.ndarray] = []
        self.steps, self.rebuild_at = 0, 1
        # predicted id * 4 + confidence
        self.one, self.two = np.zeros(size, np.int64), np.zeros(_SLOTS, np.int64)
        self.right = np.tile(np.array([1.0, 1.0, 6.0]), (16, 1))
        self.outcomes: list[np.ndarray] = []
        self._base()
        self._shares()

    def _base(self) -> None:
        total = int(self.counts.sum())
        room = (1 << _BASE) - self.size
        self.freq = 1 + (self.counts * room // max(1, total))
        self.freq[0] += (1 << _BASE) - int(self.freq.sum())
        self.begin = np.cumsum(self.freq) - self.freq
        self.of_place: np.ndarray | None = None

    def at(self, place: np.ndarray) -> np.ndarray:
        """The ids whose intervals of the order-0 distribution hold these places."""
        if self.of_place is None:
            self.of_place = np.repeat(np.arange(self.size, dtype=np.int32), self.freq)
        return self.of_place.take(place)

    def _shares(self) -> None:
        """For each pair of confidences: where order 1 begins, where order 0 begins, and the share of order 0."""
        units = (1 << _MIX) - 3
        share = np.floor(self.right / self.right.sum(axis=1, keepdims=True) * units).astype(np.int64)
        self.edges1 = 1 + share[:, 0] << _BASE
        self.edges0 = self.edges1 + (1 + share[:, 1] << _BASE)
        self.shares0 = (1 << _MIX) - (self.edges0 >> _BASE)

    def predict(self, before: np.ndarray, last: np.ndarray) -> None:
        """What is predicted after `before`, `last` of each lane."""
        self.last, self.slot = last, (before * 0x9E3779B1 + last * 0x85EBCA6B >> 7) & (_SLOTS - 1)
        self.was2, self.was1 = self.two.take(self.slot), self.one.take(last)
        self.id2, self.sure2, self.id1, self.sure1 = self.was2 >> 2, self.was2 & 3, self.was1 >> 2, self.was1 & 3
        self.context = self.sure2 << 2 | self.sure1
        self.edge1, self.edge0, self.w0 = self.edges1.take(self.context), self.edges0.take(self.context), self.shares0.take(self.context)

    def interval(self, ids: np.ndarray, by2: np.ndarray, by1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of each id's interval, of 2 ** (_BASE + _MIX); by2, by1: predicted by order 2, only by order 1."""
        begin, size = self.begin.take(ids), self.freq.take(ids)
        begin *= self.w0
        begin += self.edge0
        size *= self.w0
        begin = np.where(by2, 0, np.where(by1, self.edge1, begin))
        return begin, np.where(by2, self.edge1, np.where(by1, self.edge0 - self.edge1, size))

    def learn(self, ids: np.ndarray, by2: np.ndarray, by1: np.ndarray) -> None:
        fresh = ids << 2
        self.two[self.slot] = self._followed(self.was2, self.sure2, by2, fresh)
        self.one[self.last] = self._followed(self.was1, self.sure1, self.id1 == ids, fresh)
        self.outcomes.append(self.context * 3 + (2 - by1.view(np.int8) - 2 * by2.view(np.int8)))
        self.recent.append(ids)
        self.steps += 1
        if self.steps == self.rebuild_at:
            self.counts += np.bincount(np.concatenate(self.recent), minlength=self.size)
            self.right += np.bincount(np.concatenate(self.outcomes), minlength=48).reshape(16, 3)
            self.recent, self.outcomes = [], []
            self.rebuild_at = self.steps + min(32, self.steps)
            self._base()
            self._shares()

    @staticmethod
    def _followed(was, sure, hit, fresh):  # type: ignore[no-untyped-def]
        """A prediction that held is surer by one, up to 3; one that didn't is less sure, or gives way."""
        missed = np.where(sure > 0, was - 1, fresh)
        np.copyto(missed, was + (sure < 3), where=hit)
        return missed


_TOTAL = np.uint64(_BASE + _MIX)
_WORD, _LEAST = np.uint64(32), np.uint64(1 << 32)


def _lanes(n: int) -> tuple[int, int, int]:
    """Lanes of a block of n ids, the ids of each, and those of the last one."""
    lanes = max(1, -(-n // STEPS))
    steps = max(1, -(-n // lanes))
    lanes = max(1, -(-n // steps))
    return lanes, steps, n - (lanes - 1) * steps


def encode_block(ids: np.ndarray, size: int) -> bytes:
    """Ids, all below size, as bytes."""
    n = len(ids)
    if not n:
        return struct.pack("<III", 0, 0, 0)
    lanes, steps, short = _lanes(n)
    table = np.zeros(lanes * steps, np.int64)
    table[:n] = ids
    table = table.reshape(lanes, steps).T.copy()
    model = Mixture(size)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    words, used = np.zeros((lanes, steps + 3), np.uint64), np.zeros(lanes, np.int64)
    before = last = np.zeros(lanes, np.int64)
    for t in range(steps):
        there = lanes if t < short else lanes - 1
        x = table[t, :there]
        model.predict(before[:there], last[:there])
        by2 = model.id2 == x
        by1 = (model.id1 == x) & ~by2
        begin, part = model.interval(x, by2, by1)
        unit = span[:there] >> _TOTAL
        old = low[:there]
        new = old + begin.view(np.uint64) * unit
        if (past := new < old).any():
            over = np.flatnonzero(past)
            words[over, used[over] - 1] += np.uint64(1)
        low[:there], span[:there] = new, part.view(np.uint64) * unit
        out = np.flatnonzero(span[:there] < _LEAST)
        words[out, used[out]] = low[out] >> _WORD
        used[out] += 1
        low[out] <<= _WORD
        span[out] <<= _WORD
        model.learn(x, by2, by1)
        before, last = last, x
    all_ = np.arange(lanes)
    for _ in range(2):
        words[all_, used] = low >> _WORD
        used += 1
        low <<= _WORD
    while (over := words >> _WORD).any():  # additions that went past a word
        words &= _LEAST - np.uint64(1)
        words[:, :-1] += over[:, 1:]
    kept = words[np.arange(words.shape[1]) < used[:, None]].astype("<u4")
    return struct.pack("<III", n, lanes, zlib.crc32(ids.astype("<u4").tobytes())) + used.astype("<u2").tobytes() + kept.tobytes()


def decode_block(data: bytes, size: int) -> np.ndarray:
    n, lanes, checksum = struct.unpack_from("<III", data)
    if not n:
        return np.zeros(0, np.int64)
    used = np.frombuffer(data, "<u2", lanes, 12).astype(np.int64)
    kept = np.frombuffer(data, "<u4", int(used.sum()), 12 + 2 * lanes)
    words = np.zeros((lanes, int(used.max()) + 2), np.uint64)
    words[np.arange(words.shape[1]) < used[:, None]] = kept
    _, steps, short = _lanes(n)
    table = np.zeros((steps, lanes), np.int64)
    model = Mixture(size)
    code, span = words[:, 0] << _WORD | words[:, 1], np.full(lanes, ~np.uint64(0))
    at = np.full(lanes, 2)
    before = last = np.zeros(lanes, np.int64)
    top = (1 << (_BASE + _MIX)) - 1
    for t in range(steps):
        there = lanes if t < short else lanes - 1
        model.predict(before[:there], last[:there])
        unit = span[:there] >> _TOTAL
        v = np.minimum((code[:there] // unit).astype(np.int64), top)
        by2 = v < model.edge1
        by1 = (v < model.edge0) & ~by2
        x = np.where(by2, model.id2, model.id1)
        rest = np.flatnonzero(v >= model.edge0)
        x[rest] = model.at((v[rest] - model.edge0[rest]) // model.w0[rest])
        begin, part = model.interval(x, by2, by1)
        code[:there] -= begin.view(np.uint64) * unit
        span[:there] = part.view(np.uint64) * unit
        more = np.flatnonzero(span[:there] < _LEAST)
        code[more] = code[more] << _WORD | words[more, at[more]]
        at[more] += 1
        span[more] <<= _WORD
        table[t, :there] = x
        model.learn(x, by2, by1)
        before, last = last, x
    ids = table.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != checksum:
        raise DamagedFile("the checksum of a block does not match its ids")
    return ids


# --- files


class Writer:
    """Writes documents, in the order they come, to a binary stream."""

    def __init__(self, stream, size: int, block: int = BLOCK):
        self.stream, self.size, self.block = stream, size, block
        self.held, self.n, self.docs, self.ids, self.bytes = [], 0, [], 0, 12
        stream.write(_MAGIC + struct.pack("<I", size))

    def add(self, doc_id: int | None, *parts: np.ndarray) -> None:
        """A document, of the ids of all parts."""
        n = sum(map(len, parts))
        self.docs.append((doc_id is not None, doc_id or 0, n))
        self.held += parts
        self.n += n
        self.ids += n
        if self.n >= self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) - len(ids) % self.block
            for at in range(0, whole, self.block):
                self._put(ids[at : at + self.block])
            self.held, self.n = [ids[whole:]], len(ids) - whole

    def _put(self, ids: np.ndarray) -> None:
        data = encode_block(ids, self.size)
        self.stream.write(struct.pack("<I", len(data)) + data)
        self.bytes += 4 + len(data)

    def close(self) -> None:
        if self.n:
            self._put(np.concatenate(self.held))
        known, ids, sizes = zip(*self.docs, strict=True) if self.docs else ((), (), ())
        index = zlib.compress(np.array(known, "<u1").tobytes() + np.array(ids, "<i8").tobytes() + np.array(sizes, "<u4").tobytes())
        self.stream.write(struct.pack("<I", 0) + index + struct.pack("<IIIQ", zlib.crc32(index), len(index), len(self.docs), self.bytes + 4))
        self.stream.close()


def read_documents(source) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
    """doc_id and ids, in parts, of each document of a seekable stream, in order; parts must be used up before going on."""
    source.seek(0, io.SEEK_END)
    source.seek(source.tell() - 20)
    crc, length, n, begin = struct.unpack("<IIIQ", source.read(20))
    source.seek(begin)
    index = source.read(length)
    if zlib.crc32(index) != crc:
        raise DamagedFile("the checksum of the index does not match")
    raw = zlib.decompress(index)
    known, ids, sizes = np.frombuffer(raw, "<u1", n), np.frombuffer(raw, "<i8", n, n), np.frombuffer(raw, "<u4", n, 9 * n)
    source.seek(0)
    head = source.read(12)
    if head[:8] != _MAGIC:
        raise DamagedFile("not a token file")
    (size,) = struct.unpack("<I", head[8:])
    rest = np.zeros(0, np.int64)

    def parts(wanted: int) -> Iterator[np.ndarray]:
        nonlocal rest
        while wanted:
            if not len(rest):
                (length,) = struct.unpack("<I", source.read(4))
                if not length:
                    raise DamagedFile("blocks end before documents do")
                rest = decode_block(source.read(length), size)
            part, rest = rest[:wanted], rest[wanted:]
            wanted -= len(part)
            yield part

    for i in range(n):
        yield (int(ids[i]) if known[i] else None), parts(int(sizes[i]))


# --- encoding


class Encoder:
    """Ids of texts by the tokenizers library, with those of words that come again kept."""

    #: White space that follows white space; four signs that are white space to one pattern engine, not to the other; and
    #: where to cut a text that has white space after white space.
    _UNSAFE, _ODD, _CUT = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]{2}", r"[\x1c-\x1f]", re.compile(r"(?<=\S)(?= )")
    #: Signs that end a word: where one follows a letter or digit (of those that all versions of Unicode know) the
    #: splitting pattern cuts too.
    _SIGNS, _KNOWN_END = ".,;:!?#%*", "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        names = self.library.get_vocab(with_added_tokens=True)
        self.size = max(names.values()) + 1
        begins = lambda sign: np.bincount([i for name, i in names.items() if name.startswith(sign)], minlength=self.size) > 0
        self.blank, self.line = begins(_BLANK), begins(_LINE)  # tokens that begin with a blank, or a line feed
        special = "".join(t.content for t in self.library.get_added_tokens_decoder().values())
        self.signs = "".join(c for c in self._SIGNS if c not in special)
        self._forget()

    def _forget(self) -> None:
        # the numbers of words after a blank (or a line feed, which they show), and of pieces as they are; the ids of one are self.ids[begin : begin + length]
        self.word: dict[str, int] = {}
        self.piece: dict[str, int] = {}
        self.begin, self.length, self.many = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.again = np.zeros(1024, bool)  # was asked for after it was numbered
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0

    def _shrink(self) -> None:
        """Forgets pieces that did not come again since they were numbered, or since the last time."""
        kept = [[(p, i) for p, i in known.items() if self.again[i]] for known in (self.word, self.piece)]
        begin, length, ids = self.begin, self.length, self.ids
        self._forget()
        if 2 * sum(map(len, kept)) <= KEPT_PIECES:
            for known, pairs in zip((self.word, self.piece), kept, strict=True):
                at = np.fromiter((i for _, i in pairs), np.int64, len(pairs))
                known.update(zip((p for p, _ in pairs), self._keep(ids[_spread(begin[at], length[at])], length[at]), strict=True))

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """New numbers for pieces of the given sizes; ids holds theirs, one after the other."""
        at, n = self.many, len(sizes)
        self.begin, self.length, self.ids = _room(self.begin, at + n), _room(self.length, at + n), _room(self.ids, self.used + len(ids))
        self.again = _room(self.again, at + n)
        self.length[at : at + n] = sizes
        self.begin[at : at + n] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.many += n
        return range(at, at + n)

    def _alone(self, pieces: list[str]) -> range:
        found = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        return self._keep(np.array([i for own in found for i in own], np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def _pieces(self, pieces: list[str]) -> list[int]:
        """The numbers of pieces, encoded as they are."""
        at = self.many
        if new := [p for p in dict.fromkeys(pieces) if p not in self.piece]:
            self.piece.update(zip(new, self._alone(new), strict=True))
        numbers = list(map(self.piece.__getitem__, pieces))
        if len(new) < len(pieces):
            came = np.array(numbers)
            self.again[came[came < at]] = True
        return numbers

    def _new_words(self, words: pa.Array) -> np.ndarray:
        """The numbers that words (each once, none of them numbered) get, each with what is before it, by the library."""
        # words without white space at an end are encoded as one text, in which each begins where what is before it does
        lines = pc.starts_with(words, "\n")
        bare = pc.if_else(lines, pc.utf8_slice_codeunits(words, 1), words)
        joins = pc.and_(pc.not_equal(bare, ""), pc.equal(bare, pc.utf8_trim_whitespace(bare)))
        places = lambda mask: np.flatnonzero(mask.to_numpy(zero_copy_only=False))
        listed = lambda at: words.take(pa.array(at)).to_numpy(zero_copy_only=False).tolist()
        out = np.empty(len(words), np.int64)

        def numbered(part: list[str], at: np.ndarray, numbers: range) -> None:
            self.word.update(zip(part, numbers, strict=True))
            out[at] = np.arange(numbers.start, numbers.stop)

        alone = [places(pc.invert(joins))]
        for where, begins_word, before in ((places(pc.and_(joins, pc.invert(lines))), self.blank, " "), (places(pc.and_(joins, lines)), self.line, "")):
            all_ = listed(where)
            for i in range(0, len(all_), 10_000):
                part, at = all_[i : i + 10_000], where[i : i + 10_000]
                # many short texts cost the library less than a long one
                texts = [before + before.join(part[j : j + 100]) for j in range(0, len(part), 100)]
                found = self.library.encode_batch_fast(texts, add_special_tokens=False)
                ids = np.array([t for e in found for t in e.ids], np.uint32)
                begins = np.flatnonzero(begins_word[ids])
                if len(begins) == len(part) and begins[0] == 0:
                    numbered(part, at, self._keep(ids, np.diff(begins, append=len(ids))))
                else:
                    alone.append(at)
        where = np.concatenate(alone)
        all_ = listed(where)
        for i in range(0, len(all_), 10_000):
            part = all_[i : i + 10_000]
            numbered(part, where[i : i + 10_000], self._alone([w if w[:1] == "\n" else " " + w for w in part]))
        return out

    def _words(self, words: pa.Array) -> np.ndarray:
        """The numbers of words (each once), each with a blank before it."""
        names = words.to_numpy(zero_copy_only=False).tolist()
        found = self._numbered(names)
        self.again[found[found >= 0]] = True
        missing = np.flatnonzero(found < 0)
        if len(missing):
            words = words.take(pa.array(missing))
            stems = pc.utf8_rtrim(words, characters=self.signs)
            cut = pc.and_(pc.not_equal(pc.binary_length(stems), pc.binary_length(words)), pc.match_substring_regex(stems, self._KNOWN_END))
            stems = pc.if_else(cut, stems, words).dictionary_encode()
            is_cut, indices = cut.to_numpy(zero_copy_only=False), stems.indices.to_numpy()
            # only stems of words that were cut may have a number: what stands whole was missing
            numbers = np.full(len(stems.dictionary), -1, np.int64)
            whole = np.zeros(len(numbers), bool)
            whole[indices[~is_cut]] = True
            ask = np.flatnonzero(~whole)
            numbers[ask] = self._numbered(stems.dictionary.take(pa.array(ask)).to_numpy(zero_copy_only=False).tolist())
            new = numbers < 0
            numbers[new] = self._new_words(stems.dictionary.filter(pa.array(new)))
            found[missing] = numbers[indices]
            if len(at := missing[is_cut]):
                sizes = pc.utf8_length(stems.cast(words.type).filter(cut)).to_numpy().tolist()
                whole = [names[i] for i in at.tolist()]
                ends = np.array(self._pieces([w[n:] for w, n in zip(whole, sizes, strict=True)]))
                parts = np.stack([found[at], ends], axis=1)
                ids = self.ids.take(_spread(self.begin.take(parts).ravel(), self.length.take(parts).ravel()))
                numbers = self._keep(ids, self.length[parts].sum(axis=1))
                self.word.update(zip(whole, numbers, strict=True))
                found[at] = numbers
        return found

    def _numbered(self, names: list[str]) -> np.ndarray:
        return np.fromiter(map(self.word.get, names, itertools.repeat(-1)), np.int64, len(names))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text, none of them null, its ids as unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        texts = texts.cast(pa.large_string())
        ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        at = held = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, held + GROUP_CHARACTERS, side="right")))
            out += self._group(texts.slice(at, end - at))
            at, held = end, int(ends[end - 1])
        return out

    def _group(self, texts: pa.Array) -> list[np.ndarray]:
        if self.many > KEPT_PIECES:
            self._shrink()
        # texts that can be cut at every blank and line feed
        odd = pc.match_substring_regex(texts, self._ODD)
        plain = pc.invert(pc.or_(odd, pc.match_substring_regex(texts, self._UNSAFE)))
        split = pc.split_pattern(pc.if_else(plain, pc.replace_substring(texts, "\n", " \n"), ""), " ")
        coded, edges = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        indices = coded.indices.to_numpy()
        numbers = self._words(coded.dictionary).take(indices)
        # what begins a text has no blank before it; texts that aren't plain have one piece here, which isn't theirs
        numbers[edges[:-1]] = self._pieces(coded.dictionary.take(pa.array(indices[edges[:-1]])).to_pylist())
        sizes = self.length.take(numbers)
        ids = self.ids.take(_spread(self.begin.take(numbers), sizes))
        ends = np.concatenate([[0], np.cumsum(sizes)])[edges].tolist()
        out = [ids[a:b] for a, b in itertools.pairwise(ends)]
        for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist():
            text = texts[i].as_py()
            out[i] = self._apart([text] if odd[i].as_py() else self._CUT.split(text))
        return out

    def _apart(self, pieces: list[str]) -> np.ndarray:
        at = np.array(self._pieces(pieces), np.int64)
        return self.ids[_spread(self.begin[at], self.length[at])]


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """array, grown so that n entries fit."""
    return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each of the given sizes."""
    end = np.cumsum(size)
    out = np.repeat(begin - end + size, size)
    out += np.arange(len(out))
    return out


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- Spark


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


_FILES = "path string, first long, n_docs long, n_ids long"


def write_tokens(df: DataFrame, path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Token files of df (doc_id, text) in `folder`, each document followed by end_id: path, first doc_id, documents and ids of each."""
    small_batches(df.sparkSession)

    def write(batches):
        store, base = _store(folder)
        writer, name, first = None, "", None
        end = np.array([end_id], np.uint32)
        for b in batches:
            found = encoder(path).encode(pc.fill_null(b.column("text"), ""))
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), found, strict=True):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    name, first = f"{base}/{uuid.uuid4().hex}.tokens", doc_id
                    writer = Writer(store.open_output_stream(name, compression=None), encoder(path).size)
                writer.add(doc_id, ids, end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([len(writer.docs)]), pa.array([writer.ids])], names=["path", "first", "n_docs", "n_ids"])

    ordered = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(write, _FILES), "token-files")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of the documents of token files."""
    order = files.orderBy(F.col("first").asc_nulls_first()).collect()  # a row for each file
    starts, total = [], 0
    for r in order:
        starts.append((r["path"], total))
        total += r["n_ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    spark = files.sparkSession
    if not starts:
        return spark.createDataFrame([], schema)

    def read(batches):
        store, _ = _store(folder)
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                rows = []
                with store.open_input_file(path) as source:
                    for doc_id, parts in read_documents(source):
                        n = crc = 0
                        for part in parts:
                            n += len(part)
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        rows.append((doc_id, start, n, crc))
                        start += n
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(starts, "path string, start long").repartition(len(starts))
    return listed.mapInArrow(read, schema)


def token_table(df: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """df (doc_id, text) through token files and back."""
    folder = new_path(df.sparkSession, "tokens")
    return read_tokens(write_tokens(df, path, folder, end_id), folder)

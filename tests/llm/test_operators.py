"""Operators that SQL can't express, held against brute force; and cases that any of them may meet."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from quire.llm import bpe, exact, langid, mixing, queries, shards, simhash, similar, tokenfile, topk, toxicity, warc  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SPACE = re.compile(r"[\x20\x09-\x0D]")
FIRST = "the quick brown fox jumps over the lazy dog near the old mill by the river at dawn while birds sing"
#: doc_id, text, lang, source, n_chars: null in each column, empty and white texts, copies, near copies, a repeated row, a long text.
MESS = [
    (1, FIRST, "en", "web", 1), (2, FIRST.upper(), "en", "web", 1), (3, FIRST.replace(" ", "  "), "en", None, 1), (4, FIRST + " again", None, "web", None), (5, None, "en", "web", 0),
    (6, "", "en", "book", 0), (7, " \t\n", "en", "book", 3), (8, " ", None, "book", 1), (9, "12 34 !!", "en", "web", 8), (9, "12 34 !!", "en", "web", 8),
    (10, "ein ganz anderer Text über Züge und Bäume", "de", "book", 40), (11, "\U0001f600 日本語 <|endoftext|> café", "ja", "web", 9), (12, "word " * 60_000, "en", "web", 300_000), (13, "word", "en", "web", 4), (None, FIRST, "en", "web", 1), (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators add, or use inside.
EXTRA = ["fp", "component_id", "keep_id", "kept", "group_size", "_row", "_key", "copies", "copy", "ids", "n_tokens", "size", "shard", "slot", "held_out", "score", "key", "spans"]


@pytest.fixture(scope="module")
def mess(spark):
    return spark.createDataFrame(MESS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def listed(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


# --- exact duplicates


def wanted_exact(texts):
    groups = defaultdict(list)
    for doc, text in texts:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), doc is None, doc or 0))
    return sorted(
        (doc is not None, doc, (lambda s: None if s[1] else s[2])(min(g)), len(g), hashlib.sha256(n.encode()).hexdigest())
        for n, g in groups.items() for doc in [None if m[1] else m[2] for m in g]
    )


@pytest.mark.parametrize("digest_bytes", [32, 1])
@pytest.mark.parametrize("which", ["mess", "docs"])
def test_exact_groups(which, digest_bytes, request):
    """Also with keys of one byte, where most hits are false and bytes must decide, and with memtables of seven rows."""
    df = request.getfixturevalue(which).where("doc_id IS NOT NULL")
    found = exact.exact_groups(df, flush_rows=7, digest_bytes=digest_bytes).collect()
    assert sorted((True, r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == wanted_exact(listed(df))
    assert sum(r["kept"] for r in found) == len({SPACE.sub("", t or "") for _, t in listed(df)})


def test_exact_with_a_full_filter(spark, mess, monkeypatch):
    """A filter too small for its keys lets more rows through, and changes nothing; rows without a doc_id rank last."""
    df = mess.unionByName(spark.createDataFrame([(i, f"text {i // 2}", "en", "s", 1) for i in range(2000, 6000)], SCHEMA))
    monkeypatch.setattr(exact, "FILTER_BYTES", 128)
    found = exact.exact_groups(df).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["text_sha256"]) for r in found) == sorted((d[0], d[1] or 0, d[2] or 0, *d[3:]) for d in wanted_exact_all(listed(df)))
    assert sum(r["kept"] for r in found) == len({SPACE.sub("", t or "") for _, t in listed(df)})


def wanted_exact_all(texts):
    """As wanted_exact(), rows without a doc_id too."""
    groups = defaultdict(list)
    for doc, text in texts:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), doc is None, doc or 0))
    for norm, own in groups.items():
        least = min(own)
        for _, none, doc in own:
            yield (not none, None if none else doc, None if least[1] else least[2], len(own), hashlib.sha256(norm.encode()).hexdigest())


# --- near duplicates


def wanted_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    """The smallest doc_id reachable of each (doc_id, fingerprint), by all pairs."""
    distinct = sorted({f for _, f in fps})
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(b)] = root(a)
    least = {}
    for doc, f in fps:
        if doc is not None:
            least[root(f)] = min(doc, least.get(root(f), doc))
    return [(doc, f"{f:016x}", least.get(root(f))) for doc, f in fps]


@pytest.mark.parametrize("which", ["mess", "docs"])
def test_near_groups(which, request):
    df = request.getfixturevalue(which)
    wanted = classes([(d, wanted_fingerprint(t)) for d, t in listed(df)])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(rows(simhash.near_groups(df), "doc_id", "fingerprint", "component_id"), key=key) == sorted(wanted, key=key)
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({c for _, _, c in wanted if c is not None})


@pytest.mark.parametrize("group", [20_000, 5])
def test_links_of_close_fingerprints(spark, group):
    """Chains of flipped bits around a few centres; with groups of five, they are dealt out by chunks."""
    draw = np.random.default_rng(1)
    fps = set()
    for _ in range(6):
        at = int(draw.integers(1 << 63)) << 1
        for _ in range(40):
            fps.add(at)
            at ^= sum({1 << int(b) for b in draw.integers(64, size=int(draw.integers(1, 6)))})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = simhash.components(simhash.near_pairs(spark.createDataFrame(signed, "fp long"), group))
    got = defaultdict(set)
    for r in found.collect():
        got[r["root"]] |= {r["node"] % (1 << 64), r["root"] % (1 << 64)}
    wanted = defaultdict(set)
    numbered = {f: i for i, f in enumerate(sorted(fps))}
    for (_, _, c), f in zip(classes([(numbered[f], f) for f in sorted(fps)]), sorted(fps), strict=True):
        wanted[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(w) for w in wanted.values() if len(w) > 1)


def sets_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_of_the_pipeline(spark):
    """By all pairs of sets; copies of 100 to 300 words with edits, around 0.8 on both sides, and a large group in tiles."""
    draw = np.random.default_rng(3)
    texts = []
    for n in [100, 200, 300] * 12 + [120]:
        base = [f"w{x}" for x in draw.integers(5000, size=n)]
        texts.append(" ".join(base))
        for edits in ([1, 2, 3, 4, 6, 9] if n != 120 else [3] * 60):
            copy = list(base)
            for at in draw.integers(n, size=edits):
                copy[at] = f"x{draw.integers(5000)}"
            texts.append(" ".join(copy))
    texts += ["", None, " ", "one two", "ONE  two"]
    order = draw.permutation(len(texts)).tolist()
    df = spark.createDataFrame([(i, texts[at], "en", "s", 1) for i, at in enumerate(order)], SCHEMA).repartition(3)
    sets = [sets_of(texts[at]) for at in order]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r["doc_id"] for r in stage(spark, df, "").collect()) == sorted(set(root))
    assert sorted(r["doc_id"] for r in similar.similar_dedup(df, room=7).collect()) == sorted(set(root))
    assert similar.similar_dedup(df.limit(0)).count() == 0


# --- tokens


def test_bpe_digests(mess):
    library = Tokenizer.from_file(WORDS)
    for r in bpe.digests(mess.select("doc_id", "text"), WORDS).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_files(mess, docs):
    library = Tokenizer.from_file(BYTES)
    for df in (mess, docs):
        texts = sorted(((d is not None, d, t) for d, t in listed(df) if d is not None), key=lambda r: (r[1], r[2] or ""))
        start, wanted = 0, []
        for _, d, t in texts:
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            wanted.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert rows(tokenfile.token_table(df.where("doc_id IS NOT NULL"), BYTES), "doc_id", "start", "n_tokens", "ids_crc32") == wanted


@pytest.mark.parametrize("kept", [20, 2000, 1_000_000])
def test_encoder_is_the_library(kept, monkeypatch):
    """Odd white space, signs and letters, with tables of words that are full at once, often, or never."""
    monkeypatch.setattr(tokenfile, "KEPT_PIECES", kept)
    draw = random.Random(5)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\r", "\x00", ".", ",", "!?", "_", "<|endoftext|>"]
    parts += ["a", "dog's", "'ll", "12", "\u00e9", "\u0436", "\u0e44\u0e17\u0e22", "\u4e2d", "\U0001f600", "A\u0301"] + [" "] * 12 + ["\n"] * 2
    words = ["".join(draw.choices("abcde\u00e4", k=draw.randrange(1, 5))) for _ in range(300)]
    texts = ["".join(draw.choices(parts + words[:40] + draw.sample(words, 10), k=draw.randrange(60))) for _ in range(2000)]
    library, encoder = Tokenizer.from_file(BYTES), tokenfile.Encoder(BYTES)
    for at in range(0, len(texts), 250):
        some = texts[at : at + 250]
        wanted = [library.encode(t, add_special_tokens=False).ids for t in some]
        assert [ids.tolist() for ids in encoder.encode(pa.array(some))] == wanted


def test_bits_of_an_id():
    """Ids that follow each other often take far fewer bits than their own entropy; ids at random hardly more than it."""
    draw = np.random.default_rng(7)
    chance = draw.integers(0, 4096, 200_000)
    assert len(tokenfile.encode_block(chance, 50_257)) * 8 / len(chance) < 13.5
    phrases = draw.integers(0, 4096, (50, 40))
    told = phrases[draw.integers(0, 50, 5000)].ravel()
    data = tokenfile.encode_block(told, 50_257)
    assert len(data) * 8 / len(told) < 3
    assert (tokenfile.decode_block(data, 50_257) == told).all()


def test_damaged_block():
    data = tokenfile.encode_block(np.arange(5000, dtype=np.uint32) % 97, 50_257)
    assert tokenfile.decode_block(data, 50_257).tolist() == [i % 97 for i in range(5000)]
    damaged = bytearray(data)
    damaged[len(data) // 2] ^= 0x10
    with pytest.raises((tokenfile.DamagedFile, ValueError, IndexError)):
        tokenfile.decode_block(bytes(damaged), 50_257)


# --- archives


def test_mixing_spreads_a_hot_id(spark):
    """Rows without a doc_id go to every partition, and lie mixed with others there."""
    df = spark.createDataFrame([(None, f"t{i}", "en", "a", 1) for i in range(400)] + [(i, f"u{i}", "en", "a" if i < 400 else "b", 1) for i in range(2000)], SCHEMA)
    found = mixing.mix(df, weights={"a": 9.0, "b": 1.0}).withColumn("part", F.spark_partition_id()).collect()
    parts = defaultdict(list)
    for r in found:
        parts[r["part"]].append(r["doc_id"] is None)
    assert sum(map(sum, parts.values())) >= 400
    assert all(0.2 < sum(p) / len(p) < 0.8 for p in parts.values())
    assert max(len(list(g)) for p in parts.values() for none, g in itertools.groupby(p) if none) < 40


def test_pages_through_archives(spark):
    pages = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", ""), (4, "http://d", None), (5, "http://e", "é" * 90_000), (7, "http://f", "WARC/1.1\r\n\r\nHTTP/1.1 200\r\n\r\n"), (8, "http://g", "é" * 90_000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_type string")
    first, wanted = {}, []
    for page, _, html in pages:
        body = (html or "").encode()
        of = first.setdefault(body, page)
        wanted.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if of == page else "revisit", None if of == page else of))
    assert rows(warc.archive_pages(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == wanted
    assert {r["record_type"] for r in warc.archive_pages(df, min_bytes=1_000_000).collect()} == {"response"}


def test_revisits_have_their_own_payload(spark):
    """Rows that share a page_id, or have none: only those whose payload another page has are revisits, of that page."""
    pages = [(1, "http://a", "x"), (2, "http://b", "x"), (2, "http://c", "y"), (3, "http://d", "z"), (None, "http://e", "x"), (None, "http://f", "w")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_type string")
    digest = lambda body: base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
    wanted = [(page, digest(html), "revisit" if html == "x" and page != 1 else "response", 1 if html == "x" and page != 1 else None) for page, _, html in pages]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(rows(warc.archive_pages(df), "page_id", "payload_digest", "record_type", "refers_to"), key=key) == sorted(wanted, key=key)


def test_pages_that_share_an_id(spark):
    """Against brute force: repeated and missing page_ids, and no payload of any row missing from the archives."""
    pages = [(2, "http://a", "same"), (2, "http://b", "a unique payload"), (1, "http://c", "same"), (None, "http://d", "same"), (None, "http://e", None), (None, "http://f", ""), (7, None, "z"), (7, None, "z"), (9, "http://g", "of no page"), (None, "x y", "w")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, refers_to string").repartition(3)
    of = defaultdict(list)
    for page, _, html in pages:
        of[html or ""].append((page is None, page or 0))
    wanted = Counter()
    for html, own in of.items():
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        least = min(own)
        least_id = None if least[0] else least[1]
        wanted[(least_id, digest, "response", None)] += 1
        for none, page in sorted(own)[1:]:
            wanted[(None if none else page, digest, "revisit", least_id)] += 1
    found = warc.archive_pages(df)
    assert Counter((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect()) == wanted
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_archives_that_others_made(spark, tmp_path):
    """ARC files without any header of ours, packed and not: duplicates are found by payload, the earliest is the response."""
    head = b"HTTP/1.0 200 OK\r\n\r\n"
    record = lambda url, date, payload: warc.ArcRecord(url, "1.2.3.4", date, "text/html", 200, head + payload)
    first = warc.write_arc([record("http://a", "2003", b"x" * 3000), record("http://b", "2001", b"one")], 1)
    second = warc.write_arc([record("http://c", "2002", b"x" * 3000), record("http://c", "2002", b"x" * 3000), record("http://d", "2004", b"")], 2)
    (tmp_path / "a.arc").write_bytes(first)
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(second))
    folder = f"file://{tmp_path}"
    archives = spark.createDataFrame([(f"{tmp_path}/a.arc",), (f"{tmp_path}/b.arc.gz",)], "path string")
    found = warc.read_back(warc.convert(archives, folder), folder).collect()
    assert Counter((r["url"], r["date"][:4], r["record_type"], r["payload_bytes"]) for r in found if r["record_type"] == "response") == {("http://c", "2002", "response", 3000): 1, ("http://b", "2001", "response", 3): 1, ("http://d", "2004", "response", 0): 1}
    target = next(r["record_id"] for r in found if r["url"] == "http://c" and r["record_type"] == "response")
    assert sorted((r["url"], r["refers_to_id"] == target) for r in found if r["record_type"] == "revisit") == [("http://a", True), ("http://c", True)]
    # heads without a Content-Length, and revisits without a payload: the size is that of the response
    whole = warc.resolved(spark.createDataFrame(found, warc._READ))
    assert rows(whole, "url", "record_type", "payload_bytes") == [("http://a", "revisit", 3000), ("http://b", "response", 3), ("http://c", "response", 3000), ("http://c", "revisit", 3000), ("http://d", "response", 0)]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    made = [warc.ArcRecord("http://a", "1.2.3.4", "20200102030405", "text/html", 200, b"line\nother\n"), warc.ArcRecord("http://b", "1.2.3.4", "2020", "text/plain", 200, b"")]
    data = warc.write_arc(made, version)
    assert [(r.url, r.date, r.block) for r in warc.read_arc(data)] == [(r.url, r.date, r.block) for r in made]
    with pytest.raises(warc.MalformedArchive):
        list(warc.read_arc(data.replace(b" 11\n", b" 9999\n")))
    assert warc.timestamp("2020") == "2020-01-01T00:00:00Z"


# --- search


def wanted_top(vectors, k=20):
    """query_id, rank, vec_id, score by all pairs of rows."""
    out = []
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for at, (q, v) in enumerate(whole):
        if q is not None and q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0) for n, (i, w) in enumerate(whole) if n != at and len(w) == len(v))[:k]
            out += [(q, n, None if none else i, -s) for n, (s, none, i) in enumerate(best, 1)]
    return sorted(out, key=lambda r: (*r[:2], -r[3], r[2] is None, r[2] or 0))


def found_top(df, **how):
    return sorted(rows(topk.top_k(df, **how), "query_id", "rank", "vec_id", "score"), key=lambda r: (*r[:2], -r[3], r[2] is None, r[2] or 0))


@pytest.mark.parametrize("block_rows", [64, 65_536])
def test_top_k(spark, block_rows):
    """Ties, repeated and missing vec_ids, vectors that take no part, several lengths, and very large components."""
    draw = np.random.default_rng(2)
    data = [(i, [float(x) for x in draw.integers(-3, 4, 5) / 64]) for i in range(300)]
    data += [(20, [1.0] * 5), (20, [0.0] * 5), (1, [3.0] * 5), (1, [2.0] * 5), (None, [3.0] * 5), (None, [-1.0] * 5), (-40, [0.5] * 5)]
    data += [(500, [300_000.0, -1e7, 1.0]), (501, [-1e7, 1e7, 0.25]), (502, [0.5, -0.5, 1e9]), (520, []), (521, [])]
    bad = [(400, None), (420, [float("nan")] * 5), (440, [None] * 5), (460, [float("inf")] * 5)]
    schema = "vec_id long, embedding array<double>, score string, rank string, dims string"
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in data + bad], schema).repartition(3)
    assert found_top(df, block_rows=block_rows) == wanted_top(data)
    assert found_top(df, block_rows=block_rows, block_queries=3) == wanted_top(data)
    assert topk.top_k(df.limit(0)).collect() == []
    assert topk.top_k(df.where("vec_id = 1")).collect() == []


def test_top_k_says_what_no_long_holds(spark):
    for v, error in (([1e300], "too large for a long"), ([1e15], "too large for a long")):
        df = spark.createDataFrame([(20, v), (21, v)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match=error):
            topk.top_k(df).collect()


def test_signed_digits():
    draw = np.random.default_rng(7)
    q = np.array([0, 1, -1, 7, -7, (1 << 63) - 1, -(1 << 63), *draw.integers(-(1 << 40), 1 << 40, 50)], np.int64)
    attribute, power, sign = topk.digits(q)
    for j, x in enumerate(q.tolist()):
        own = attribute == j
        assert sum(int(s) << int(p) for p, s in zip(power[own], sign[own], strict=True)) == x
        assert (np.diff(np.sort(power[own])) > 1).all()


# --- shards


@pytest.mark.parametrize("which", ["mess", "docs"])
def test_shards(which, request):
    df = request.getfixturevalue(which).select("doc_id", "text")
    found = shards.shard(df).collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(listed(df))
    held, slots = Counter(), defaultdict(list)
    for r in found:
        assert r["size"] == len((r["text"] or "").encode()) + 1 and 0 <= r["shard"] < 16
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(held.values()), max(r["size"] for r in found)
    assert all(abs(held[s] - total / 16) <= 2 * largest + 0.002 * total / 16 for s in range(16))


@pytest.mark.parametrize("parts", [2, 16, 64, 300])
def test_splitters_against_brute_force(spark, parts):
    """Random sizes, a text that a third of all rows share, repeated rows and null doc_ids: each boundary as near as any key is."""
    draw = np.random.default_rng(parts)
    n = 3000
    text = [0 if i % 3 == 0 else int(x) for i, x in enumerate(draw.integers(1, 700, n))]
    data = [(t * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63), -(1 << 63) if i % 50 == 0 else i // 2, i, int(s)) for i, (t, s) in enumerate(zip(text, draw.integers(1, 90, n), strict=True))]
    keys = spark.createDataFrame(data, "_h long, _d long, _row long, size long").repartition(5)
    total = sum(r[3] for r in data)
    data.sort()
    below = np.cumsum([0, *(r[3] for r in data)])
    for tolerance in (0.0, 0.2):
        found = shards.splitters(keys, (total, n), parts, tolerance)
        for i, (key, rows_below) in enumerate(found, 1):
            target = total * i // parts
            assert rows_below == sum(r[:3] < key for r in data)
            near = np.abs(below - target).min()
            assert abs(below[rows_below] - target) <= max(near, tolerance * total / parts)


def test_shards_of_equal_texts(mess):
    """Equal texts lie side by side in slots, cut by doc_id only where a boundary falls; the rest of the query's columns."""
    found = [(r["shard"], r["slot"], r["text"] or "", r["doc_id"]) for r in shards.shard(mess.select("doc_id", "text"), shards=2).collect()]
    order = [r[2] for r in sorted(found)]
    assert len([t for t, _ in itertools.groupby(order)]) == len(set(order))
    for _, own in itertools.groupby(sorted(found, key=lambda r: r[:2]), key=lambda r: r[2]):
        ids = [(d is not None, d or 0) for *_, d in own]
        assert ids == sorted(ids)


def test_shard_query(spark):
    found = queries.QUERIES["op9_histogram_shards"](spark, "/root/testdata/sf0.001")
    texts = dict(listed(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    assert found.count() == len(texts)
    for r in found.collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    empty = shards.shard(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "size", "slot", "shard"]


# --- mixing


def test_mixing_takes_whole_rows_by_rate(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'abc' AS text", "'en' AS lang", "if(id % 4 = 0, 'a', 'b') AS source", "3L AS n_chars")
    found = mixing.mix(df, weights={"a": 1.0, "b": 1.0})
    by = Counter(r["source"] for r in found.collect())
    assert abs(by["a"] - 2000) < 5 * 2000**0.5 and abs(by["b"] - 2000) < 5 * 2000**0.5
    again = mixing.mix(df.repartition(7), weights={"a": 1.0, "b": 1.0})
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, again.collect()))


def copies_of(doc, rate):
    """By the definition: how many k have P(X <= k) <= u, with exact terms."""
    u = int(hashlib.md5(f"{mixing.SEED}:{'null' if doc is None else doc}".encode()).hexdigest()[:13], 16) / 2**52
    k, cdf = 0, math.exp(-rate)
    while cdf <= u:
        k += 1
        cdf += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def test_mixing_against_brute_force(spark, mess):
    """Null sources, null doc_ids, empty texts, weights that are missing or none; and the join for many sources."""
    for weights in (None, {"web": 3.0, "book": 1.0, "absent": 2.0}, {}):
        mass = Counter()
        for _, text, _, source, _ in MESS:
            mass[source] += len(text or "") + 1
        weight = {s: (m**0.7 if weights is None else weights.get(s, 0.0)) for s, m in mass.items()}
        total = sum(weight.values()) or 1.0
        wanted = Counter()
        for doc, text, _, source, _ in MESS:
            n = copies_of(doc, weight[source] / total * sum(mass.values()) / mass[source]) if weight[source] else 0
            for copy in range(1, n + 1):
                wanted[(doc, text, n, copy)] += 1
        found = mixing.mix(mess, weights)
        assert Counter((r["doc_id"], r["text"], r["copies"], r["copy"]) for r in found.collect()) == wanted
    table, _ = mixing.rates(mess)
    found = mixing.salted(mess, table)
    assert Counter((r["source"], r["doc_id"]) for r in found.collect()) == Counter((r[3], r[0]) for r in MESS)


def test_copies_of_high_rates(spark):
    df = spark.range(200).selectExpr("id AS doc_id")
    for rate in (0.0, 1e-9, 0.3, 1.0, 40.0, 700.0):
        u = mixing._hash(mixing.SEED, df["doc_id"])
        u = F.conv(F.substring(u, 1, 13), 16, 10).cast("double") / float(1 << 52)
        found = df.select("doc_id", mixing.inverted(F.lit(rate), u).alias("n")).collect()
        assert all(r["n"] == (copies_of(r["doc_id"], rate) if rate else 0) for r in found)


# --- models


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").select("lang", "lang_pred").collect()
    assert sum(r[0] == r[1] for r in found) > 0.95 * len(found)


def test_toxicity_of_held_out_rows(spark):
    """On sf0.1: a tenth of it has 14 toxic rows held out and 37 to learn from, too few to measure either."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").collect()
    yes = [r["score"] for r in scored if r["toxic"] == 1]
    no = [r["score"] for r in scored if r["toxic"] == 0]
    assert sum((a > b) + (a == b) / 2 for a in yes for b in no) > 0.95 * len(yes) * len(no)
    assert all((r["predicted"] == 1) == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in scored)


def test_toxicity_lexicon_is_of_whole_counts(spark):
    """Words counted over many small partitions, in each of which a clean one hardly occurs twice."""
    texts = [(i, f"vile word{i % 7} " + ("ananas" if i < 12 else "plain"), 1) for i in range(40)]
    texts += [(i, f"calm word{i % 7} " + ("ananas" if i < 226 else "plain"), 0) for i in range(200, 600)]
    df = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in texts], "doc_id long, toxic int")
    found = {1: Counter(), 0: Counter()}
    kinds = Counter()
    for i, text, kind in texts:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            kinds[kind] += 1
            found[kind].update({f for p in text.split() for f in toxicity.features(p)})
    wanted = {f for f, n in found[1].items() if n >= 2 and (n + 0.5) / (kinds[1] + 1) >= 6 * (found[0][f] + 0.5) / (kinds[0] + 1)}
    common = {f for k in found for f in found[k] if not f.endswith("*")}
    assert "vile" in wanted and "anan*" not in wanted and found[0]["anan*"] > 15
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # each file of the sample is a partition
    try:
        model = toxicity.learn(df.repartition(40), labels)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(model.weights) == wanted | common


def test_label_model_finds_rates():
    """Votes drawn by known rates, one voter copied four times: the posterior's error is near that of the true model."""
    draw = np.random.default_rng(8)
    n, one, zero = 6000, np.array([0.7, 0.5, 0.6, 0.4, 0.3]), np.array([0.02, 0.01, 0.05, 0.02, 0.01])
    truth = draw.random(n) < 0.2
    fires = draw.random((n, 5)) < np.where(truth[:, None], one, zero)
    votes = np.concatenate([fires, *[fires[:, :1]] * 4, -(~fires.any(axis=1, keepdims=True)).astype(float)], axis=1).astype(np.float32)
    model = toxicity.LabelModel(prior=0.2)
    posterior = model.fit(votes)
    assert (posterior > 0.5).astype(bool)[truth].mean() > 0.85 and (posterior > 0.5).astype(bool)[~truth].mean() < 0.06
    assert np.abs(model.rate1[:5] - one).max() < 0.12 and np.abs(model.rate0[:5] - zero).max() < 0.04
    assert model.weight[0] < 0.3 < 0.6 < model.weight[1]


def _drawn(n, one, zero, seed):
    draw = np.random.default_rng(seed)
    truth = draw.random(n) < 0.2
    return truth, draw.random((n, len(one))) < np.where(truth[:, None], one, zero)


def test_label_model_with_correlated_voters():
    """Twenty voters that all say the same, alone: the classes can't be told apart by rates, and any vote decides."""
    truth, fires = _drawn(500, np.array([0.9]), np.array([0.01]), 3)
    votes = np.concatenate([*[fires] * 20, *[-(~fires).astype(float)] * 3], axis=1).astype(np.float32)
    model = toxicity.LabelModel(prior=0.2)
    posterior = model.fit(votes)
    assert model.blocks == 1 and (posterior[fires[:, 0]] == 0.9).all() and (posterior[~fires[:, 0]] == 0.05).all()


def test_label_model_with_two_blocks_and_with_three():
    truth, fires = _drawn(4000, np.array([0.8, 0.6, 0.7]), np.array([0.02, 0.03, 0.01]), 4)
    copied = lambda k: np.repeat(fires[:, :k], 6, axis=1).astype(np.float32)
    two, three = toxicity.LabelModel(prior=0.2), toxicity.LabelModel(prior=0.2)
    start, posterior = two.fit(copied(2)), three.fit(copied(3))
    assert two.blocks == 2 and set(np.round(start, 6)) == {0.9, 0.05}
    assert three.blocks == 3 and np.allclose(three.weight, 1 / 6)
    assert np.abs(three.rate1[::6] - [0.8, 0.6, 0.7]).max() < 0.08 and np.abs(three.rate0[::6] - [0.02, 0.03, 0.01]).max() < 0.03
    likely = np.log([[0.2], [0.8]]) + np.array([np.where(fires, np.log(r), np.log1p(-np.array(r))).sum(axis=1) for r in ([0.8, 0.6, 0.7], [0.02, 0.03, 0.01])])
    assert ((posterior > 0.5) == truth).mean() > ((likely[0] > likely[1]) == truth).mean() - 0.005  # the true model's share


def test_logistic_against_a_dense_fit():
    draw = np.random.default_rng(9)
    dense = (draw.random((400, 12)) < 0.3).astype(float)
    target = 1 / (1 + np.exp(-(dense @ draw.normal(0, 2, 12) - 1)))
    x = toxicity.Sparse([np.flatnonzero(r) for r in dense], 12)
    assert np.allclose(x.dot(np.arange(12.0)), dense @ np.arange(12.0)) and np.allclose(x.back(target), dense.T @ target)
    w, b = toxicity.logistic(x, target, l2=1.0)
    error = 1 / (1 + np.exp(-(dense @ w + b))) - target
    assert np.abs((dense.T @ error + w) / 400).max() < 2e-3 and abs(error.mean()) < 2e-3


def test_toxicity_patterns():
    entries = {"idiot", "clow*"}
    wanted = {"you are an id10t": [0], "sooooo nice": [1], "what?!! no": [2], "GO AWAY NOW": [], "STOP THIS NOISE": [3], "you absolute idiot.": [4], "clowns, clowns and an idiot": [5], "you utter clown you idiot idiot": [4, 5], "": [], "a calm text of 2024": []}
    assert {t: toxicity.patterns(t, entries) for t in wanted} == wanted


def test_toxicity_of_odd_texts(spark):
    """Null and empty texts get the bias only; a repeated doc_id is learned from once; brute-force scores of all others."""
    texts = [(i, "you stupid idiot " + "plain " * (i % 3), 1) for i in range(60)] + [(i, "calm plain words here", 0) for i in range(100, 260)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(3, "zzz")] * 50 + [(500, None), (501, ""), (None, "idiot"), (502, "idiot " * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in texts] + [(3, 1), (700, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    none = 1 / (1 + math.exp(-model.bias))
    for r in toxicity.score(docs, model).collect():
        present = {f for piece in (r["text"] or "").split() for f in toxicity.features(piece)}
        wanted = 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in present))))
        assert abs(r["score"] - wanted) < 1e-9 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not r["text"]:
            assert abs(r["score"] - none) < 1e-12 and r["predicted"] == 0
        if r["text"] and "idiot" in r["text"]:
            assert r["predicted"] == 1
    nothing = toxicity.learn(docs, labels.where("toxic = 1"))
    assert {round(r["score"], 9) for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_viterbi_against_all_paths():
    """Where two changes' gains share one cost, too; scores are whole numbers, so totals compare exactly."""
    draw = np.random.default_rng(4)
    cases = [np.array([[-5, 0, -20]] * 2 + [[-5, -20, 0]] * 2, float)]
    cases += [-draw.integers(0, 13, (int(draw.integers(1, 7)), 3)).astype(float) for _ in range(300)]
    for scores in cases:
        value = lambda path: sum(scores[i, j] for i, j in enumerate(path)) - 12 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        assert value(langid.viterbi(scores, 12.0).tolist()) == max(map(value, itertools.product(range(3), repeat=len(scores))))


def test_long_paths_against_exact_viterbi():
    """Many texts at once, of 0 to 700 words in changing languages: the best totals, by one word after the other."""
    draw = np.random.default_rng(6)
    for k in (1, 2, 5):
        sizes = draw.integers(0, 700, 60).tolist() + [0, 1, 128, 129, 256]
        edges = np.cumsum([0, *sizes]).tolist()
        scores = -draw.integers(0, 6, (edges[-1], k)).astype(float)
        favoured = np.repeat(draw.integers(0, k, edges[-1] // 20 + 1), 20)[: edges[-1]]
        scores[np.arange(edges[-1]), favoured] += draw.integers(0, 5, edges[-1])
        path = langid.paths(scores, edges, 12.0)
        for a, b in itertools.pairwise(edges):
            if a < b:
                best = scores[a]
                for row in scores[a + 1 : b]:
                    best = row + np.maximum(best, best.max() - 12)
                assert scores[np.arange(a, b), path[a:b]].sum() - 12 * (np.diff(path[a:b]) != 0).sum() == best.max()


def test_words_are_scored_as_one_by_one():
    """New words of a batch together, against a score of each word by itself, written from the definition."""
    draw = np.random.default_rng(5)
    grams = draw.integers(0, 4, (3, langid.BUCKETS))
    scripts = np.zeros((3, len(langid.NAMES)), int)
    for own, names in zip(scripts, (["latin"], ["latin", "cyrillic"], ["greek"]), strict=True):
        own[[langid.NAMES.index(n) for n in names]] = 50
    model = langid.Model(["a", "b", "c"], grams, scripts)
    alphabet = "abcÄßéжΩяйλ日1-.'İ"
    words = ["", "12", "Ελλάς", "x" * 400_000, *("".join(draw.choice(list(alphabet), int(n))) for n in draw.integers(1, 9, 400))]

    def alone(word):
        letters = [c for c in word.lower() if c.isalpha()]
        if not letters:
            return [0.0] * 3, 0
        buckets = langid.Words([word]).buckets
        assert len(buckets) == len(letters)
        score = [sum(float(model.log[b, i]) for b in buckets) for i in range(3)]
        of = Counter(next(n for at, n in reversed(langid.SCRIPTS) if at <= ord(c)) for c in letters)
        most = min(of, key=lambda n: (-of[n], n))
        uses = [scripts[i][langid.NAMES.index(most)] > 0 for i in range(3)]
        if any(uses):
            top = max(s for s, u in zip(score, uses, strict=True) if u)
            score = [s if u else top - langid.DEFEAT for s, u in zip(score, uses, strict=True)]
        return [max(s - max(score), -langid.DEFEAT) for s in score], len(letters)

    scores, letters = model.words(words)
    for word, score, n in zip(words, scores.tolist(), letters.tolist(), strict=True):
        wanted = alone(word)
        assert n == wanted[1] and np.allclose(score, wanted[0], atol=1e-2 if len(word) > 1000 else 1e-3)
    once = langid.Labeller(model)
    texts = [" ".join(draw.choice(words[4:], int(n))) for n in draw.integers(0, 30, 50)]
    assert once.texts(texts) == [langid.Labeller(model).text(t) for t in texts]


def test_language_of_odd_texts(spark):
    train = [(i, t, l, "s", 1) for i in range(60) for t, l in (("the cat sat on the mat", "en"), ("это простой текст", "ru"))]
    odd = [(100, None, "en", "s", 1), (101, "", "en", "s", 1), (102, "12 !!", "en", "s", 1), (103, "the cat " * 400_000, None, "s", 1), (None, "простой текст", "ru", None, None)]
    found = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(train + odd, SCHEMA)).where("doc_id IS NULL OR doc_id >= 100").collect()}
    for doc in (100, 101, 102):
        assert (found[doc]["lang_pred"], found[doc]["score"]) == ("und", 0.0)
    assert found[103]["lang_pred"] == "en" and found[103]["score"] > 0.99 and len(found[103]["spans"]) == 1
    assert found[None]["lang_pred"] == "ru" and found[None]["held_out"] is False


def test_mixed_documents_stay(spark):
    """A text of three languages, none of which has half of its letters; only texts without letters go."""
    of = {"en": "the cat sat on the mat with those things", "ru": "это простой текст на языке", "el": "αυτό είναι ένα απλό κείμενο"}
    docs = [(3 * i + n, t, lang, "s", 1) for i in range(60) for n, (lang, t) in enumerate(of.items())]
    odd = [(1000, " ".join(t for t in of.values() for _ in range(4)), None, "s", 1), (1001, "12 !!", None, "s", 1), (1002, "a", None, "s", 1)]
    df = spark.createDataFrame(docs + odd, SCHEMA)
    score = {r["doc_id"]: r["score"] for r in langid.identify(df).where("doc_id >= 1000").collect()}
    assert 0 < score[1000] < 0.5
    assert sorted(r["doc_id"] for r in langid.keep_identified(df).collect()) == [*range(180), 1000, 1002]


def test_spans_of_mixed_text(spark):
    train = [(i, t, l, "s", 1) for i in range(60) for t, l in (("the cat sat on the mat with those things", "en"), ("это простой текст на языке", "ru"))]
    model = langid.learn(spark.createDataFrame(train, SCHEMA))
    text = "the cat sat with those things " * 3 + "это текст на языке " * 4
    assert langid.Labeller(model).text(text)[2] == [(0, 18, "en"), (18, 34, "ru")]


# --- the pipeline


PIPELINE = [(i, f"{t} {n}", lang, src, 1) for i, (t, n, lang, src) in enumerate(
    [("the cat sat on the mat with those things and then it slept", n, "en", "web") for n in range(30)] + [("это простой текст на русском языке и ничего больше", n, "ru", "book") for n in range(30)]
)]


def wanted_pipeline(docs):
    """doc_id -> rows and digests, each stage by brute force: its rows, its groups, its copies, the library's ids."""
    letters = [d for d in docs if any(c.isalpha() for c in d[1] or "")]
    exact_ = defaultdict(list)
    for d in letters:
        exact_[SPACE.sub("", d[1])].append((-len(d[1]), d[0] is None, d[0] or 0, d))
    kept = [min(g, key=lambda x: x[:3])[3] for g in exact_.values()]
    sets, root = [sets_of(d[1]) for d in kept], list(range(len(kept)))
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [x if r == y else r for r in root]
    groups = defaultdict(list)
    for d, r in zip(kept, root, strict=True):
        groups[r].append((d[0] is None, d[0] or 0, d))
    kept = [min(g, key=lambda x: x[:2])[2] for g in groups.values()]
    mass = Counter()
    for d in kept:
        mass[d[3]] += len(d[1]) + 1
    weight = {s: m**0.7 for s, m in mass.items()}
    library, out = Tokenizer.from_file(WORDS), Counter()
    for d in kept:
        ids = library.encode(d[1], add_special_tokens=False).ids
        rate = weight[d[3]] / sum(weight.values()) * sum(mass.values()) / mass[d[3]]
        key = (d[0], d[3], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        if n := copies_of(d[0], rate):
            out[key] += n
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    """The whole chain over odd rows, with a column more and one whose name an operator uses: stages, order, rows, digests."""
    base = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    near = [(200, base, "en", "web", 1), (201, base.replace("wordka", "other"), "en", "book", 1), (202, base + " tail", "en", "web", 1), (203, base.upper(), "en", "book", 1)]
    odd = [(r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in MESS]
    docs = PIPELINE + near + odd
    path = tmp_path / "documents.parquet"
    spark.createDataFrame([(*d, "x", 1.5) for d in docs], SCHEMA + ", keep_id string, _row double").repartition(3).write.parquet(str(path))
    found = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_duplicates", "near_duplicates", "mixture", "tokens"]
    assert Counter((r["doc_id"], r["source"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == wanted_pipeline(docs)
    stages, now = dict(corpus_pipeline.STAGES), spark.read.parquet(f"file://{path}")
    for name in list(stages)[:-1]:
        assert stages[name](spark, now, "").columns == now.columns
        assert stages[name](spark, now.limit(0), "").collect() == []


def test_near_copies_that_the_pipeline_catches(spark):
    """Recall on planted copies of 60 to 400 words with one to many words changed, whose similarity is 0.8 or more: all."""
    draw = np.random.default_rng(11)
    rows_, originals = [], []
    for i in range(300):
        n = int(draw.integers(60, 400))
        base = [f"w{x}" for x in draw.integers(20_000, size=n)]
        copy = list(base)
        while True:
            changed = list(copy)
            changed[int(draw.integers(n))] = f"x{draw.integers(20_000)}"
            a, b = sets_of(" ".join(base)), sets_of(" ".join(changed))
            if len(a & b) < 0.8 * len(a | b):
                break
            copy = changed
            if draw.random() < 0.2:
                break
        rows_ += [(2 * i, " ".join(base), "en", "s", 1), (2 * i + 1, " ".join(copy), "en", "s", 1)]
        originals.append(2 * i)
    kept = {r["doc_id"] for r in similar.similar_dedup(spark.createDataFrame(rows_, SCHEMA).repartition(4)).collect()}
    assert set(originals) <= kept
    assert len(kept) - len(originals) <= 0.01 * len(originals)


# --- any operator


def _labels(df):
    return df.sparkSession.createDataFrame([(1, 0), (3, 1), (None, 1), (6, None)], "doc_id long, toxic int")


OPERATORS = {
    "exact": exact.exact_dedup, "exact_groups": exact.exact_groups, "near": simhash.near_dedup, "near_groups": simhash.near_groups, "mix": mixing.mix, "tokens": lambda df: bpe.tokenized(df, WORDS), "files": lambda df: tokenfile.token_table(df, BYTES),
    "top_k": lambda df: topk.top_k(df.selectExpr("doc_id AS vec_id", "array(1.0D * n_chars, 2.0D) AS embedding"), query_every=1), "archives": lambda df: warc.archive_pages(df.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "'x' AS payload_bytes")), "shards": shards.shard, "language": langid.identify, "identified": langid.keep_identified, "toxicity": lambda df: toxicity.toxicity(df, _labels(df)),
}
WHOLE = {"archives", "exact_groups", "near_groups", "tokens", "files", "shards", "language", "toxicity"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(name, mess):
    run = OPERATORS[name]
    assert run(mess.limit(0)).count() == 0
    n = run(mess).count()
    assert n == len(MESS) if name in WHOLE else n > 0
    wide = mess.selectExpr("*", *[f"'x' AS `{c}`" for c in EXTRA])
    assert run(wide).count() == n


def test_fingerprints_propose_near_duplicates(spark, monkeypatch):
    """What op5's method links meets without any band in common, and the sets decide."""
    base = [f"w{i}" for i in range(400)]
    texts = {1: " ".join(base), 2: " ".join([*base[:-1], "x"]), 3: " ".join(base[::-1])}
    assert (simhash.fingerprint(texts[1]) ^ simhash.fingerprint(texts[2])).bit_count() <= simhash.DISTANCE
    numbered = spark.createDataFrame(list(texts.items()), "_row long, text string")
    nodes = numbered.select(F.col("_row").alias("node"), F.array().cast("array<long>").alias("bands"))
    fps = [(i, int(np.uint64(simhash.fingerprint(t)).view(np.int64))) for i, t in texts.items()]
    more = similar.fingerprint_bands(spark.createDataFrame(fps, "node long, fp long"))
    assert [sorted(r) for r in similar.links(numbered, nodes, more=more).distinct().collect()] == [[1, 2]]
    asked = []
    monkeypatch.setattr(similar, "fingerprint_bands", lambda held: asked.append(held) or more.limit(0))
    dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame([(1, "a b", "en", "s", 1)], SCHEMA), "")
    assert len(asked) == 1


@pytest.mark.parametrize("name, remain", [("exact_duplicates", {"exact", "exact-groups", "exact-false", "exact-dropped"}), ("near_duplicates", {"similar-rows", "similar-fingerprints", "similar-dropped"})])
def test_disk_of_the_pipeline(spark, tmp_path, monkeypatch, name, remain):
    """Texts that stay are not exchanged, and of the tables that a stage makes only those remain that its result is read from."""
    draw = np.random.default_rng(5)
    texts = [" ".join(f"{x:08x}" for x in draw.integers(1 << 32, size=2000)) for _ in range(150)]
    texts += [texts[0], f"{texts[1]} end"]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3).write.parquet(f"file://{tmp_path}/in")
    context = spark.sparkContext._jsc.sc()
    monkeypatch.setattr("quire.llm.common.shared_dir", lambda _: f"file://{tmp_path}/shared")

    def shuffled():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorList(True).head().totalShuffleWrite()

    had = shuffled()
    kept = [r["doc_id"] for r in dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"file://{tmp_path}/in"), "").select("doc_id", "text").collect()]
    had = shuffled() - had
    assert sorted(kept) == list(range(150)) + ([151] if name == "exact_duplicates" else [])
    assert had < 0.5 * sum(map(len, texts))
    assert {re.sub("-[0-9a-f]{32}$", "", p.name) for p in (tmp_path / "shared").iterdir() if re.search("-[0-9a-f]{32}$", p.name)} == remain


def test_workers_keep_nothing_of_earlier_steps():
    """A worker goes on from step to step: a tokenizer goes when a model comes, and either when near-duplicates or exact ones are sought."""
    import gc
    import weakref

    import pyarrow as pa

    from quire.llm import common

    path = queries.tokenizer_file("word_bpe_49k.json")
    held = weakref.ref(bpe.loaded(path))
    assert bpe.loaded(path) is held()
    common.once("a model", dict)
    assert held() is None
    texts = pa.RecordBatch.from_pydict({"_row": [1], "doc_id": [1], "text": ["a b c"]})
    for step in (similar._signed, similar._verified(0.8), similar._tiles(0.8), similar._sets, simhash._meet, exact._indexed(9)):
        common.once("a model", dict)
        list(step([texts] if step is similar._signed else []))
        gc.collect()
        assert not common._MADE


def test_sketches_rule_out_no_pair():
    """Sets of the similarity or more always pass, whatever their sizes; most others of some size don't."""
    draw = np.random.default_rng(5)
    passed = []
    for n in (0, 1, 2, 9, 40, 333, 334, 2000, 40_000):
        base = draw.integers(1 << 64, size=n, dtype=np.uint64)
        for kept in (0.5, 0.8, 0.89, 0.9, 1.0):
            other = np.unique(np.concatenate([base[: round(n * kept)], draw.integers(1 << 64, size=draw.integers(n - round(n * kept) + 1), dtype=np.uint64)]))
            one = np.unique(base)
            both = len(np.intersect1d(one, other))
            alike = both >= 0.8 * (len(one) + len(other) - both) - 1e-9
            x, y = (np.frombuffer(similar.sketch(s), np.uint8) for s in (one, other))
            may = [bool(similar.may_be_alike(a, b[None], 0.8)[0]) for a, b in ((x, y), (y, x))]
            assert may[0] == may[1] >= alike
            if n > 300 and kept == 0.5:
                passed.append(may[0])
    assert not any(passed)
    crowded = np.arange(5000, dtype=np.uint64)  # all have the same leading bits
    assert similar.sketch(crowded) == b"" and similar.may_be_alike(np.zeros(0, np.uint8), np.zeros((1, 16), np.uint8), 0.8).all()


def test_sets_cross_only_where_sketches_leave_a_pair(spark, monkeypatch):
    """Texts that share a band but too little else are settled without their sets, in a band of two and in larger ones."""
    base = [f"w{i}" for i in range(400)]
    far = [" ".join([*base[: 300], *(f"{k}x{i}" for i in range(100))]) for k in range(4)]
    near = [" ".join([*base, "end"]), " ".join([*base, "tail"])]
    texts = dict(enumerate([" ".join(base), *far, *near], 1))
    numbered = spark.createDataFrame(list(texts.items()), "_row long, text string")
    shared = {1: [1, 2, 3], 2: [1, 2], 3: [2], 4: [2], 5: [2], 6: [3], 7: [3]}
    held = [(i, shared[i], similar.sketch(similar.shingles(t))) for i, t in texts.items()]
    nodes = spark.createDataFrame(held, "node long, bands array<long>, sketch binary")
    asked, made = [], similar._sets_of
    monkeypatch.setattr(similar, "_sets_of", lambda n, which: asked.append(sorted({r["node"] for r in which.collect()})) or made(n, which))
    assert rows(similar.links(numbered, nodes).distinct(), "a", "b") == [(6, 1), (7, 1)]
    assert asked == [[1, 6, 7], []]
    plain = similar.links(numbered, nodes.drop("sketch")).distinct()
    assert rows(plain, "a", "b") == [(6, 1), (7, 1)]


def test_encoder_looks_words_up_once(monkeypatch):
    """Of a text's words each is looked up once, and of words that end in signs their stems once more; ids are the library's."""
    own, asked = tokenfile.Encoder(BYTES), []
    look_up = own._numbered
    monkeypatch.setattr(own, "_numbered", lambda names: asked.extend(names) or look_up(names))
    texts = ["one two three, four! five\nsix seven. eight, two", "two, nine"]
    for found, text in zip(own.encode(pa.array(texts)), texts, strict=True):
        assert found.tolist() == own.library.encode(text, add_special_tokens=False).ids
    words = {w for t in texts for w in t.replace("\n", " \n").split(" ")}
    assert Counter(asked) == Counter(words) + Counter({"three", "four", "seven", "eight"})

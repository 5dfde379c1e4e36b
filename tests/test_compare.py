"""Comparison of versions: shortest scripts by brute force, anchors, gaps and marks on literal cases."""

import itertools
import random

from quire.operators import compare

WORD = "doc_id long, ord int, page_no int, word string"


def common(a, b):
    """The length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_shortest_scripts():
    draw = random.Random(2)
    for _ in range(3000):
        a, b = (draw.choices("abcd", k=draw.randrange(0, 9)) for _ in range(2))
        found = compare._shortest(a, b)
        assert len(found) == common(a, b) and all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(found))
    assert compare._shortest(["a"] * 5, ["b"] * 5, most=9) == [] and compare._shortest([], []) == []


def test_longest_ascending():
    draw = random.Random(3)
    for _ in range(1000):
        n = draw.randrange(0, 9)
        pairs = list(zip(draw.sample(range(20), n), draw.sample(range(20), n), strict=True))
        best = max(k for k in range(n + 1) for c in itertools.combinations(sorted(pairs), k) if all(x[1] < y[1] for x, y in itertools.pairwise(c)))
        found = compare._ascending(pairs)
        assert len(found) == best and set(found) <= set(pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(found))


def rows(texts):
    return [(d, i, 0, w) for d, t in texts.items() for i, w in enumerate(t)]


def test_matches(spark):
    """Matches ascend and are equal words; between two of them no more could be matched; words that stay in place and occur once are anchors."""
    draw = random.Random(6)
    old = {d: draw.choices(["the", "of", *[f"w{i}" for i in range(30)]], weights=[9, 9, *[1] * 30], k=draw.randrange(0, 60)) for d in range(40)}
    new = {}
    for d, words in old.items():
        out = []
        for w in words:
            out += [] if (u := draw.random()) < 0.1 else ["new"] if u < 0.15 else [w, draw.choice(["the", "x"])] if u < 0.25 else [w]
        new[d] = out
    old[90], new[91], old[92], new[92] = ["only", "old"], ["only", "new"], ["a", "a", "b"], ["a", "b", "a"]
    found = {}
    for r in compare.matches(spark.createDataFrame(rows(new), WORD), spark.createDataFrame(rows(old), WORD)).collect():
        found.setdefault(r["doc_id"], []).append((r["a"], r["b"]))
    for d in old.keys() | new.keys():
        a, b, met = old.get(d, []), new.get(d, []), sorted(found.get(d, []))
        assert all(a[i] == b[j] for i, j in met) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(met))
        for (i, j), (k, m) in itertools.pairwise([(-1, -1), *met, (len(a), len(b))]):
            assert common(a[i + 1 : k], b[j + 1 : m]) == 0
    assert len(found[92]) == 2 and 90 not in found and 91 not in found


def test_unchanged_and_empty(spark):
    same = spark.createDataFrame(rows({1: list("abcab"), 2: []}), WORD)
    assert compare.changes(same, same).count() == 0
    none = same.limit(0)
    assert [(r["kind"], r["old_text"]) for r in compare.changes(none, same).collect()] == [("deleted", "a b c a b")]
    assert [(r["kind"], r["new_text"]) for r in compare.changes(same, none).collect()] == [("inserted", "a b c a b")]
    assert compare.changes(none, none).count() == 0


def test_limit_and_pages(spark):
    pages = spark.createDataFrame([(1, 0, "a b  c"), (1, 1, "d\ne"), (1, 2, None), (1, 3, "f")], "doc_id long, page_no int, text string")
    words = compare.page_words(pages)
    assert sorted((r["ord"], r["page_no"], r["word"]) for r in words.collect()) == [(0, 0, "a"), (1, 0, "b"), (2, 0, "c"), (3, 1, "d"), (4, 1, "e"), (5, 3, "f")]
    new = compare.page_words(spark.createDataFrame([(1, 0, "X b"), (1, 1, "Y d e"), (1, 2, "Z")], "doc_id long, page_no int, text string"))
    found = [(r["ord"], r["kind"], r["old_page"], r["old_text"], r["new_page"], r["new_text"]) for r in compare.changes(new, words).orderBy("ord").collect()]
    assert found == [(0, "replaced", 0, "a", 0, "X"), (1, "replaced", 0, "c", 1, "Y"), (2, "replaced", 3, "f", 2, "Z")]
    assert compare.changes(new, words, limit=2).count() == 2


def test_marks(spark):
    """An insertion over two pages has a box on each; a deletion in the middle a caret before the next word, at the end one after the last."""
    old = spark.createDataFrame(rows({1: "a b c d e f".split(), 2: ["gone"]}), WORD)
    box = lambda i: (i * 10.0, 0.0, i * 10.0 + 8, 9.0)
    new = spark.createDataFrame([(1, i, p, w, *box(i)) for i, (w, p) in enumerate([("a", 0), ("x", 0), ("y", 1), ("b", 1), ("d", 1), ("e", 1)])], f"{WORD}, x0 double, y0 double, x1 double, y1 double")
    found = sorted((r["ord"], r["page_no"], r["type"], r["content"], r["x0"], r["x1"]) for r in compare.marks(new, old).collect())
    assert found == [(0, 0, "Highlight", "Inserted: x y", 10.0, 18.0), (0, 1, "Highlight", "Inserted: x y", 20.0, 28.0), (1, 1, "Caret", "Deleted: c", 40.0, 40.0), (2, 1, "Caret", "Deleted: f", 58.0, 58.0)]

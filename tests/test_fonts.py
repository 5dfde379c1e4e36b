"""Bundled fonts, widths, character maps, runs and wrapping: literal cases and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import fonts, runs


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_bundled_fonts(spark):
    paths = ["f/Sarabun-Regular.ttf", "f/Sarabun-Bold.ttf", "f/Sarabun-Medium.ttf", "f/SarabunNew-Bold.ttf", "f/Lato-Light.ttf", "f/Lato-LightItalic.ttf", "f/NotoSansThai-Regular.ttf", "f/-.", "f/Lato-Regular.ttf"]
    bundled = spark.createDataFrame([(p, i) for i, p in enumerate(paths)] + [(None, 99)], "path string, ord int")
    wanted = {
        "ABCDEF+Sarabun": paths[0], "Sarabun-Bold": paths[1], "Sarabun-Medium": paths[2], "SarabunNew-Bold": paths[3], "Sarabun-BoldItalic": paths[1], "Lato-Black": paths[8], "Lato Light Oblique": paths[5], "NotoSansThai (Google)": paths[6], "NotoSans": paths[6], "NotoSansThaiLooped": None,
    }
    found = {r["font"]: r["path"] for r in fonts.matched(spark.createDataFrame([(n,) for n in [*wanted, *wanted, "", None]], "font string"), bundled).collect()}
    # a bundled family ends in ttf, so that one that is longer than the name without it isn't its beginning
    assert found == {n: p for n, p in wanted.items() if p}
    assert fonts.matched(spark.createDataFrame([], "font string"), bundled).count() == 0


def test_fitted_fonts(spark):
    """Own font that fits: left alone. Own that doesn't: rejected, renamed to the nearest. Ties go to the first key; none near: nothing. System families are left out."""
    table = spark.createDataFrame([("alpha", "Alpha", "Regular", "a"), ("beta", "Beta", "Regular", "b"), ("beta", "Beta", "Bold", "bb"), ("gamma", "Gamma", "Regular", "c"), ("wide", "Wide", "Regular", "w")], "key string, name string, style string, file string")
    widths = {"a": 500, "b": 600, "bb": 700, "c": 600, "w": 2000}
    advances = spark.createDataFrame([(f, cp, n) for f, n in widths.items() for cp in (97, 98)] + [("a", 0, 500)], "file string, cp int, advance int")
    row = lambda family, per_letter, text="ababab", bold=False: (1, family, bold, False, 10.0, text, len(text) * per_letter / 100)
    samples = [row("Alpha", 505), *[row("Alpha", 9000)], row("Alpha", 495), row("Beta", 500), row("Foo", 600), row("Foo", 700, bold=True), row("Bar", 1000), row("Arial", 600), row("Odd", 500, "ab日ab日"), row("Zero", 0)]
    found = fonts.fitted(spark.createDataFrame(samples, "doc_id long, family string, bold boolean, italic boolean, size double, text string, width double"), table, advances)
    assert got(found, "family", "rename", "reject") == [("Beta", "Alpha", True), ("Foo", "Beta", False), ("Odd", "Alpha", False)]
    # the upper median of three counts: without the middle one the own font is off
    off = fonts.fitted(spark.createDataFrame([row("Alpha", 505), row("Alpha", 9000)], "doc_id long, family string, bold boolean, italic boolean, size double, text string, width double"), table, advances)
    assert got(off, "family", "rename", "reject") == [("Alpha", None, True)]


def wanted_map(text):
    """The map as a reader builds it up, entry by entry."""
    lists, row = {}, {}
    unit = lambda h: int(h[:4], 16)
    for body in re.findall("beginbfchar(.*?)endbfchar", text, re.S):
        for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", body):
            if 0 < unit(b) < 0x110000:
                lists[int(a, 16)] = unit(b)
    for body in re.findall("beginbfrange(.*?)endbfrange", text, re.S):
        for a, z, inner in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*\[(.*?)\]", body, re.S):
            for i, b in enumerate(re.findall("<([0-9A-Fa-f]+)>", inner)):
                if int(a, 16) + i <= int(z, 16) and unit(b):
                    lists[int(a, 16) + i] = unit(b)
        for a, z, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", body):
            for i in range(min(int(z, 16) - int(a, 16) + 1, 80_000)):
                if 0 < unit(b) + i < 0x110000:
                    row.setdefault(int(a, 16) + i, unit(b) + i)
    return row | lists


def test_character_maps(spark):
    draw = random.Random(4)
    hexed = lambda: f"<{draw.randrange(0, 40):0{draw.choice([1, 2, 4, 4])}x}>"
    target = lambda: draw.choice([f"<{draw.randrange(0, 0x3000):04X}>", "<0041030A>", "<7>", "<0000>", "<zz>", "<>"])
    texts = {0: "", 1: "beginbfrange <0000> <ffff> <0000> endbfrange", 2: "beginbfrange <10> <5> <0041> <0001> <0002> [<0041> <0042> <0043>] endbfrange", 3: "beginbfchar <0001> <0041>", 4: "beginbfrange\n<0000>\n<FFFF> <0001>\nendbfrange beginbfchar <fff0> <0E01> endbfchar"}
    for f in range(5, 60):
        body = lambda: " ".join(draw.choice([f"{hexed()} {target()}", f"{hexed()}\n{hexed()} [{' '.join(target() for _ in range(draw.randrange(0, 4)))}]", f"{hexed()} {hexed()} {target()}"]) for _ in range(draw.randrange(0, 6)))  # noqa: B023, E731
        texts[f] = " ".join(draw.choice([f"1 beginbfchar {body()} endbfchar", f"2 beginbfrange {body()} endbfrange"]) for _ in range(draw.randrange(0, 5)))
    maps = fonts.character_maps(spark.createDataFrame([*texts.items(), (99, None)], "font int, text string"))
    codes = [(f, c) for f in texts for c in [*range(45), 0xFFF0, 0xFFFF, 0x1234, 70_000]] + [(99, 1), (77, 1)]
    found = {(r["font"], r["cid"]): r["cp"] for r in fonts.decoded(spark.createDataFrame(codes, "font int, cid long"), maps).collect()}
    for f, text in texts.items():
        wanted = wanted_map(text)
        assert {c: found[f, c] for ff, c in codes if ff == f} == {c: wanted.get(c) for ff, c in codes if ff == f}, (f, text)
    assert found[99, 1] is None and found[77, 1] is None


def test_glyphs_and_resources(spark):
    own = fonts.glyph_characters(spark.createDataFrame([(1, 66, 5), (1, 65, 5), (1, 65, 5), (1, 67, None), (2, 65, 5)], "font int, cp int, gid int"))
    assert got(own, "font", "gid", "cps") == [(1, 5, [65, 66]), (2, 5, [65])]
    named = fonts.font_resources(spark.createDataFrame([(1, 0, 0, 9, "F1"), (1, 0, 1, 8, "F1"), (1, 0, 2, 7, None), (1, 0, 3, 6, ""), (1, 1, 0, 9, "F1")], "doc_id int, page_no int, ord int, font int, resource string"))
    assert got(named, "page_no", "resource", "font") == [(0, "F1", 8), (1, "F1", 9)]


RUNS = "id int, runs array<struct<key:string,text:string>>, start int, end int"


@pytest.mark.parametrize(("start", "end", "wanted"), [
    (3, 7, [("a", "one"), ("b", "X"), ("c", "hree")]), (2, 8, [("a", "onX"), ("c", "ree")]),  # over three runs: the middle one goes, the others keep their looks
    (0, 3, [("a", "X"), ("b", "two"), ("c", "three")]), (3, 6, [("a", "one"), ("b", "X"), ("c", "three")]), (1, 1, [("a", "oXne"), ("b", "two"), ("c", "three")]), (3, 3, [("a", "one"), ("b", "two"), ("c", "three")]), (0, 99, [("a", "X")]), (50, 60, [("a", "one"), ("b", "two"), ("c", "three")]),
])
def test_spliced(spark, start, end, wanted):
    df = spark.createDataFrame([(1, [("a", "one"), ("b", "two"), ("c", "three")], start, end)], RUNS)
    assert [tuple(r) for r in df.select(runs.spliced(F.col("runs"), F.col("start"), F.col("end"), F.lit("X"))).first()[0]] == wanted


def test_spliced_against_characters(spark):
    """Each character with its run's key: those outside stay, the text takes the first run that the range meets."""
    draw = random.Random(5)
    rows, wanted = [], {}
    for i in range(300):
        own = [(str(n), draw.choice(["", "a", "bc", "def", "日本語", "x y"])) for n in range(draw.randrange(0, 6))]
        start = draw.randrange(0, 12)
        end = start + draw.randrange(0, 6)
        rows.append((i, own, start, end))
        out, at, put = [], 0, False
        for key, text in own:
            a, b, at = at, at + len(text), at + len(text)
            if b <= start or a >= end:
                out.append((key, text))
            else:
                kept = "".join(c for n, c in enumerate(text, a) if n < start) + ("" if put else "NEW") + "".join(c for n, c in enumerate(text, a) if n >= end)
                put = True
                out += [(key, kept)] if kept else []
        wanted[i] = out
    found = spark.createDataFrame(rows, RUNS).select("id", runs.spliced(F.col("runs"), F.col("start"), F.col("end"), F.lit("NEW")).alias("r")).collect()
    assert {r["id"]: [tuple(x) for x in r["r"]] for r in found} == wanted


def test_stripped(spark):
    cases = [([("a", "  "), ("b", " x "), ("c", " ")], [("b", "x")]), ([("a", " one"), ("b", "two ")], [("a", "one"), ("b", "two")]), ([("a", " "), ("b", "")], []), ([], []), ([("a", "\tx"), ("b", " "), ("c", "y ")], [("a", "\tx"), ("b", " "), ("c", "y")])]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, runs array<struct<key:string,text:string>>")
    assert {r["id"]: [tuple(x) for x in r["r"]] for r in df.select("id", runs.stripped(F.col("runs")).alias("r")).collect()} == {i: c[1] for i, c in enumerate(cases)}


def wanted_lines(text, units, most):
    """Words one after the other, characters one after the other where a word is too wide."""
    wide, out = (lambda s: sum(units.get(c, 500) for c in s)), []
    for para in text.split("\n"):
        line = ""
        for word in para.split(" "):
            if wide(f"{line} {word}" if line else word) <= most:
                line = f"{line} {word}" if line else word
                continue
            out += [line] if line else []
            line = word
            while wide(line) > most:
                n = max([k for k in range(1, len(line) + 1) if wide(line[:k]) <= most], default=1)
                if n == len(line):
                    break
                out.append(line[:n])
                line = line[n:]
        out += [line] if line or not para else []
    return out


def test_wrapped(spark):
    draw = random.Random(8)
    units = {"a": 300, "b": 500, "c": 900, " ": 250}
    rows = [("".join(draw.choices("abc  \n日", k=draw.randrange(0, 40))), float(draw.choice([0, 100, 300, 600, 999.5, 1500, 2500]))) for _ in range(600)]
    df = spark.createDataFrame([(i, t, 1000.0, w) for i, (t, w) in enumerate(rows)] + [(-1, None, 1.0, 1.0), (-2, "a", None, 1.0), (-3, "ab " * 20_000, 10.0, 12.0)], "id int, text string, size double, width double")
    found = {r["id"]: r["lines"] for r in runs.wrapped(df, units).collect()}
    assert found.pop(-1) is None and found.pop(-2) is None
    assert found.pop(-3) == [*["ab"] * 19_999, "ab "]  # the blank at the end fits
    assert found == {i: wanted_lines(t, units, w) for i, (t, w) in enumerate(rows)}

"""Boolean queries of trigrams that any match of a regular expression must satisfy.

A pattern is read by the regular expression library's own parser. Bottom up, each part of it gets the finite set of strings
that it matches, if there is one and it is small, and a query: the trigrams that a match is sure to hold. A query is a set
of conjunctions of trigrams, any of which will do; the empty conjunction asks for nothing, and a pattern with it has no
mandatory trigrams. Strings are compared without the case of letters A to Z, as the index does.
"""

from __future__ import annotations

import re
from itertools import groupby
from re import _constants as kind
from re import _parser as parser

#: Strings, and conjunctions, of a part that are kept apart; beyond, less is asked for.
MOST_STRINGS, MOST_CONJUNCTIONS = 64, 64
NOTHING = frozenset([frozenset()])


def _lower(code: int) -> str:
    return chr(code + 32 if 65 <= code <= 90 else code)


def grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _simple(query: frozenset) -> frozenset:
    """Without conjunctions that ask for more than another does; nothing at all if too many are left."""
    least = frozenset(c for c in query if not any(o < c for o in query))
    return least if len(least) <= MOST_CONJUNCTIONS else NOTHING


def _both(a: frozenset, b: frozenset) -> frozenset:
    return _simple(frozenset(x | y for x in a for y in b))


def _of(strings: frozenset[str]) -> frozenset:
    return _simple(frozenset(map(grams, strings)))


def _class(items: list) -> frozenset[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is kind.LITERAL:
            out.add(_lower(value))
        elif op is kind.RANGE and value[1] - value[0] < MOST_STRINGS:
            out.update(_lower(c) for c in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(out)


def _sequence(tokens) -> tuple[frozenset[str] | None, frozenset]:
    """(the strings or None, the query) of parts one after the other: runs of parts with known strings are put together."""
    known: frozenset[str] | None = frozenset([""])
    query, whole = NOTHING, True
    for op, value in tokens:
        strings, own = _part(op, value)
        if strings is not None and len(strings) * len(known) <= MOST_STRINGS:
            known = frozenset(a + b for a in known for b in strings)
            continue
        query, whole = _both(query, _of(known)), False
        known = strings if strings is not None and len(strings) <= MOST_STRINGS else frozenset([""])
        query = _both(query, own)
    query = _both(query, _of(known))
    return (known if whole else None), query


def _part(op, value) -> tuple[frozenset[str] | None, frozenset]:
    if op is kind.LITERAL:
        return frozenset([_lower(value)]), NOTHING
    if op is kind.IN:
        return _class(value), NOTHING
    if op is kind.SUBPATTERN:
        return _sequence(value[-1])
    if op is kind.BRANCH:
        parts = [_sequence(b) for b in value[1]]
        strings = frozenset().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
        return strings, _simple(frozenset().union(*(q for _, q in parts)))
    if op in (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if strings is not None and low == 0 and high == 1:
            return strings | {""}, NOTHING
        if strings is not None and low == high and len(strings) ** low <= MOST_STRINGS and low < MOST_STRINGS:
            out = frozenset([""])
            for _ in range(low):
                out = frozenset(a + b for a in out for b in strings)
            return out, _of(out)
        return None, query if low else NOTHING
    if op is kind.AT or op in (kind.ASSERT, kind.ASSERT_NOT):
        return frozenset([""]), NOTHING
    return None, NOTHING


def query(pattern: str) -> frozenset[frozenset[str]]:
    """The conjunctions of trigrams; NOTHING if a match need not hold any."""
    found = _sequence(parser.parse(pattern))[1]
    return NOTHING if frozenset() in found else found


def _either(chars) -> str:
    """A class of characters, of letters A to Z in either case."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for x in chars for c in (x + x.upper() if "a" <= x <= "z" else x)) + "]"


def places(grams_: list[str] | None) -> str:
    """A pattern, for Java, that finds every place where one of some trigrams begins (or any), with the trigram as group 1."""
    if grams_ is None:
        return r"(?s)(?=([^\x{DC00}-\x{DFFF}]..))"  # not in the middle of a character of two code units
    tree = []
    for first, rest in groupby(sorted(grams_), lambda g: g[0]):
        below = [_either(second) + _either(g[2] for g in found) for second, found in groupby(rest, lambda g: g[1])]
        tree.append(f"{_either(first)}(?:{'|'.join(below)})")
    return f"(?={_either(sorted({g[0] for g in grams_}))})(?=({'|'.join(tree)}))"


def matches(found: frozenset, text: str) -> bool:
    """Whether a text satisfies a query; for tests."""
    own = grams(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return any(c <= own for c in found)

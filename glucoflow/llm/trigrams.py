"""Boolean trigram queries derived from regular expressions, and postings of a chunk.

A query is ``None`` (no mandatory trigram), a trigram of lower-case ASCII
bytes, or ``("and" | "or", [queries])``.  The derivation keeps, along a
concatenation, the small set of strings that the part read so far can match;
when a part is not such a set, the strings turn into a condition and the set
starts anew.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser

import numpy as np

#: more strings than this end the exact set
MAX_STRINGS = 48
#: a character class of more letters is no exact set
MAX_CLASS = 8
#: stands between documents; no byte of UTF-8
BORDER = b"\xff"


def trigram_query(pattern: str):
    """The condition that every match of pattern fulfils, on lower-cased text."""
    exact, query = _sequence(_parser.parse(pattern))
    return _all_of([query, _strings(exact)])


def _strings(exact: frozenset[str] | None):
    if exact is None or any(len(s) < 3 for s in exact):
        return None
    return _any_of([_all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(exact)])


def _all_of(parts: list):
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any_of(parts: list):
    return None if any(p is None for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _sequence(nodes) -> tuple[frozenset[str] | None, object]:
    """(exact strings of the whole sequence or None, condition)."""
    strings, conditions, whole = frozenset([""]), [], True
    for op, arg in nodes:
        exact, query = _node(op, arg)
        if query is not None:
            conditions.append(query)
        longer = None if exact is None else frozenset(a + b for a in strings for b in exact)
        if longer is None or len(longer) > MAX_STRINGS:
            conditions.append(_strings(strings))
            whole, strings = False, exact if exact is not None and len(exact) <= MAX_STRINGS else frozenset([""])
        else:
            strings = longer
    if whole:
        return strings, _all_of(conditions)
    return None, _all_of([*conditions, _strings(strings)])


def _node(op, arg) -> tuple[frozenset[str] | None, object]:
    if op is sre.LITERAL:
        return frozenset([chr(arg).lower()]), None
    if op is sre.IN:
        letters: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                letters.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < MAX_CLASS:
                letters |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, None
        return (frozenset(letters) if len(letters) <= MAX_CLASS else None), None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        exact, query = _sequence(inner)
        if low == 0:
            return (exact | {""} if high == 1 and exact is not None else None), None
        if low == high == 1:
            return exact, query
        return None, _all_of([query, _strings(exact)])
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in found):
            return frozenset().union(*(e for e, _ in found)), _any_of([q for _, q in found])
        return None, _any_of([_all_of([q, _strings(e)]) for e, q in found])
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return frozenset([""]), None
    return None, None


def trigrams_in(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1]))


class Postings:
    """The inverted index of a chunk of texts over the trigrams that queries name."""

    def __init__(self, queries: list):
        self.names = sorted(set().union(*map(trigrams_in, queries)))
        self.number = {t: k for k, t in enumerate(self.names)}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, k in self.number.items():
            a, b, c = t.encode("ascii")
            self.table[a << 16 | b << 8 | c] = k + 1

    def index(self, texts: list[bytes]) -> np.ndarray:
        """Matrix (trigram, text) of booleans: row t is the posting list of trigram t."""
        found = np.zeros((len(self.names), len(texts)), bool)
        raw = np.frombuffer(BORDER.join(texts).lower(), np.uint8)
        if len(raw) >= 3 and self.names:
            code = raw[:-2].astype(np.uint32)
            code <<= 8
            code |= raw[1:-1]
            code <<= 8
            code |= raw[2:]
            hit = self.table[code]
            at = np.flatnonzero(hit)
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
            found[hit[at].astype(np.int64) - 1, np.searchsorted(starts, at, side="right") - 1] = True
        return found

    def candidates(self, query, found: np.ndarray) -> np.ndarray:
        """Texts that fulfil query: posting lists intersected and united."""
        if query is None:
            return np.ones(found.shape[1], bool)
        if isinstance(query, str):
            return found[self.number[query]]
        parts = [self.candidates(q, found) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


def compile_ascii(pattern: str) -> re.Pattern:
    """Case folding, where a pattern asks for it, is of A-Z only."""
    return re.compile(pattern, re.ASCII)

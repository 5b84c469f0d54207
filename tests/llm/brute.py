"""Plain versions of the operators, for tables small enough to hold."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

from glucoflow.llm import linededup


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def in_order(rows: list[tuple]) -> list[tuple]:
    """(doc_id, text) ascending, null ids last, equal ids by text."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))


def substring(rows: list[tuple], length: int = 20) -> list[tuple]:
    seen, out = set(), []
    for doc_id, text in in_order(rows):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            window = tuple(w[k : k + length])
            if window in seen:
                gone[k : k + length] = [True] * length
            seen.add(window)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def suffix(rows: list[tuple], length: int = 50) -> list[tuple]:
    first: dict[bytes, float] = {}
    rank = lambda doc_id: float("inf") if doc_id is None else doc_id
    for doc_id, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            first[s] = min(first.get(s, float("inf")), rank(doc_id))
    out = []
    for doc_id, text in in_order(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < rank(doc_id):
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text: str | None, width: int) -> set[tuple]:
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


class Union:
    def __init__(self):
        self.of: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.of.setdefault(x, x) != x:
            x = self.of[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def near(rows: list[tuple], width: int, num: int, den: int) -> dict[int, int]:
    """Component of every id."""
    sets = [(d, shingle_set(t, width)) for d, t in rows if d is not None]
    union = Union()
    for k, (a, x) in enumerate(sets):
        union.find(a)
        for b, y in sets[:k]:
            if x and y and den * len(x & y) >= num * len(x | y):
                union.link(a, b)
    return {d: union.find(d) for d, _ in sets}


def edit_distance_within(item: list[bytes], text: list[bytes]) -> int:
    """Least edit distance of item to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        before, row = row, [i] + [0] * len(text)
        for j, y in enumerate(text, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return min(row)


def lines(rows: list[tuple]) -> dict[int, list[int]]:
    """Numbers of the lines that line dedup deletes, by id (ids are unique here)."""
    made = {d: linededup.line_keys(t) for d, t in rows if d is not None and t is not None}
    holders = defaultdict(set)
    for d, (keys, n) in made.items():
        for key, size in zip(keys, n, strict=True):
            if size >= linededup.LINE_WORDS:
                holders[key].add(d)
    pairs = set()
    for held in holders.values():
        low = min(held)
        pairs |= {(low, d) for d in held if d != low}
        if len(held) <= linededup.RARE_DOCS:
            pairs |= {(a, b) for a in held for b in held if a < b}
    gone = defaultdict(set)
    for a, b in pairs:
        gone[b] |= set(linededup.common_blocks(made[a][0], made[b][0], made[b][1]))
    return {d: sorted(x) for d, x in gone.items() if x}


def counters(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(5)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)

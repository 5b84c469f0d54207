"""Benchmark decontamination through CGK embedding and bit-sampling LSH (operator 4).

A random walk embeds a run of words: at step j it emits the word it stands on
and moves on, or not, by a random bit of (j, word).  Two runs a few edits apart
walk in step again after each edit, so their embeddings differ in few places:
edit distance becomes Hamming distance.  Sampling ``SAMPLED`` steps of the walk
and hashing the words emitted there gives one LSH key; ``REPEATS`` independent
walks and samples bring the recall (measured in the tests) over the target.

Windows have ``WINDOW`` words: items are entered at each of their word offsets,
so one walk from each document word serves items of all lengths, and an item is
found when any of its windows is.  Items of at most ``EXACT_WORDS`` words have
too few windows for that.  They are cut into one piece more than they may have
edits; one of the pieces stands unedited wherever the item is contained, so
looking up the pieces' hashes finds every place, also at a text's ends.

Every candidate (document, item, place) is verified exactly by a bit-parallel
edit distance between the item and all substrings around the place.  An item
is contained when its distance in words is at most ``1 - SIMILARITY`` of its
length.

Documents are scanned where they are; nothing of them is shuffled.  Items are a
query set: they are taken in blocks of at most ``ITEM_BLOCK_BYTES``, each sent to all
tasks, each against all rows.

Defined results: words are ASCII-lower-cased; null or empty texts contain
nothing and are clean; items without words or with a null text match nothing;
repeated rows are judged each; columns of other names are passed through.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoflow.llm.common import encode, in_batches, slices
from glucoflow.llm.hashing import joined_word_hashes, mix, window_hashes, word_hashes

WINDOW = 12
REPEATS = 7
SAMPLED = 5
EXACT_WORDS = 19
SIMILARITY = 0.8
ITEM_BLOCK_BYTES = 4 << 20
SEGMENT_BYTES = 1 << 20
_WALK_KEYS = mix(np.arange(1, REPEATS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def sampled_steps(repeat: int, size: int) -> list[int]:
    """One random step out of each of SAMPLED strata of a walk of ``size`` steps."""
    random = np.random.default_rng(1000 * size + repeat)
    cut = np.linspace(0, size, min(SAMPLED, size) + 1).astype(int)
    return [int(random.integers(a, b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def walk_keys(words: np.ndarray, starts: np.ndarray, size: int, repeat: int) -> np.ndarray:
    """LSH keys of the windows of ``size`` words at starts (all inside words).

    A walk of ``size`` steps never leaves its window.
    """
    symbols = mix(words ^ _WALK_KEYS[repeat])
    index = np.arange(len(words))
    sampled = set(sampled_steps(repeat, size))
    key = np.full(len(starts), size, np.uint64)
    at = starts
    last = max(sampled)
    for j in range(last + 1):
        if j in sampled:
            key *= np.uint64(0x9FB21C651E98DF25)
            key += symbols[at]
        if j < last:
            move = (symbols >> np.uint64(j)).astype(np.int64)
            move &= 1
            move += index
            at = move[at]
    return mix(key)


class Items:
    """A block of benchmark items: their words, and their windows by LSH key."""

    def __init__(self, rows: list[tuple]):
        self.ids, self.words, self.budget, self.masks = [], [], [], []
        for item_id, text in rows:
            words = encode(text).lower().split()
            if words:
                self.ids.append(item_id)
                self.words.append(words)
                self.budget.append(math.floor((1 - SIMILARITY) * len(words) + 1e-9))
                self.masks.append(self._mask(words))
        bits = min(26, max(20, (8 * sum(map(len, self.words))).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.tables: dict[int, tuple] = {}
        self.pieces: dict[int, tuple] = {}
        hashes = [word_hashes(b" ".join(w)) for w in self.words]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.keys = mix(np.arange(1, len(self.words) + 1, dtype=np.uint64) * np.uint64(0x589965CC75374CC3))
        self.vocabulary = np.zeros(1 << bits, bool)
        for key, h in zip(self.keys, hashes, strict=True):
            self.vocabulary[mix(h ^ key) >> self.shift] = True
        own = [k for k, w in enumerate(self.words) if len(w) > EXACT_WORDS]
        if own:
            offsets = [np.arange(len(self.words[k]) - WINDOW + 1) for k in own]
            item = np.repeat(own, [len(o) for o in offsets])
            for r in range(REPEATS):
                keys = np.concatenate([walk_keys(hashes[k], o, WINDOW, r) for k, o in zip(own, offsets, strict=True)])
                self.tables[r] = self._table(keys, item, np.concatenate(offsets), bits)
        pieces: dict[int, list[tuple]] = defaultdict(list)
        for k, w in enumerate(self.words):
            if len(w) <= EXACT_WORDS:
                cut = np.linspace(0, len(w), self.budget[k] + 2).astype(int).tolist()
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    pieces[b - a].append((window_hashes(hashes[k][a:b], b - a)[0], k, a))
        for size, found in sorted(pieces.items()):
            keys, item, offset = zip(*found, strict=True)
            self.pieces[size] = self._table(np.array(keys, np.uint64), np.array(item), np.array(offset), bits)

    def _table(self, keys: np.ndarray, item: np.ndarray, offset: np.ndarray, bits: int) -> tuple:
        order = np.argsort(keys, kind="stable")
        present = np.zeros(1 << bits, bool)
        present[keys >> self.shift] = True
        return present, keys[order], item[order], offset[order]

    @staticmethod
    def _mask(words: list[bytes]) -> dict[bytes, int]:
        mask: dict[bytes, int] = defaultdict(int)
        for k, w in enumerate(words):
            mask[w] |= 1 << k
        return dict(mask)

    def places(self, words: np.ndarray, room: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates (document, item, place of the item's first word), distinct.

        room: words left in the document from each word on; first: the first
        word of each document.  A place may lie outside the document.
        """
        items, places, windows = [], [], []

        def look_up(table: tuple, key: np.ndarray, starts: np.ndarray) -> None:
            present, keys, item, offset = table
            near = np.flatnonzero(present[key >> self.shift])
            lo = np.searchsorted(keys, key[near], side="left")
            n = np.searchsorted(keys, key[near], side="right") - lo
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            items.append(item[which])
            windows.append(np.repeat(starts[near], n))
            places.append(windows[-1] - offset[which])

        starts = np.flatnonzero(room >= WINDOW)
        for r, table in self.tables.items() if len(starts) else ():
            look_up(table, walk_keys(words, starts, WINDOW, r), starts)
        for size, table in self.pieces.items():
            starts = np.flatnonzero(room >= size)
            if len(starts):
                look_up(table, window_hashes(words, size)[starts], starts)
        if not items:
            return (np.zeros(0, np.int64),) * 3
        doc = np.searchsorted(first, np.concatenate(windows), side="right") - 1
        span = 2 * (len(words) + int(self.lengths.max()) + 1)
        packed = np.unique((doc * len(self.ids) + np.concatenate(items)) * span + np.concatenate(places) + span // 2)
        doc, item, place = packed // span // len(self.ids), packed // span % len(self.ids), packed % span - span // 2
        able = self._able(words, item, place)
        return doc[able], item[able], place[able]

    def _able(self, words: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Candidates around which enough words of the item stand to stay in its budget.

        The filter of (item, word) only errs towards keeping a candidate.
        """
        budget = np.array(self.budget, np.int64)[item]
        n = self.lengths[item] + 4 * budget
        cut = np.cumsum(n) - n
        at = np.repeat(place - 2 * budget - cut, n) + np.arange(n.sum())
        known = self.vocabulary[mix(words[np.clip(at, 0, len(words) - 1)] ^ np.repeat(self.keys[item], n)) >> self.shift]
        return np.add.reduceat(known, cut, dtype=np.int64) >= self.lengths[item] - budget if len(item) else np.zeros(0, bool)

    def verify(self, item: int, words: list[bytes]) -> tuple[int, int]:
        """Least distance of the item to a substring of words, and where that ends (exclusive)."""
        mask, m = self.masks[item], len(self.words[item])
        return _search(mask, m, words)

    def start(self, item: int, words: list[bytes], end: int) -> int:
        """Start of the best substring that ends at ``end``."""
        back = self._mask(self.words[item][::-1])
        m = len(self.words[item])
        return end - _search(back, m, words[:end][::-1], anchored=True)[1]


def _search(mask: dict[bytes, int], m: int, words: list[bytes], anchored: bool = False) -> tuple[int, int]:
    """Bit-parallel edit distance of a pattern of m words to the best substring.

    anchored: the substring has to start at the first word.  Returns the
    distance and the substring's end.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, where = m, 0
    for k, w in enumerate(words, 1):
        eq = mask.get(w, 0)
        x = eq | minus
        d0 = ((((eq & plus) + plus) ^ plus) | x) & full
        hp = (minus | ~(d0 | plus)) & full
        hn = plus & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) | (1 if anchored else 0)
        hn <<= 1
        plus = (hn | ~(d0 | hp)) & full
        minus = hp & d0 & full
        if score < best:
            best, where = score, k
    return best, where


def matches(items: Items, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """Per text the verified (item number, start word, end word, edits)."""
    raws = [encode(t).lower() for t in texts]
    words, sizes = joined_word_hashes(raws)
    starts = np.cumsum(sizes) - sizes
    room = np.repeat(starts + sizes, sizes) - np.arange(len(words))
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if not len(words) or not items.words:
        return found
    near: dict[tuple[int, int], list[int]] = defaultdict(list)
    for d, k, p in zip(*(x.tolist() for x in items.places(words, room, starts)), strict=True):
        near[d, k].append(p)
    split: dict[int, list[bytes]] = {}
    for (d, k), at in sorted(near.items()):
        own = split.setdefault(d, raws[d].split())
        m, budget = len(items.words[k]), items.budget[k]
        best: tuple[int, int, int] | None = None
        for a, b in _regions(sorted(set(at)), m, budget, int(starts[d]), len(own)):
            if len(items.masks[k].keys() - set(own[a:b])) > budget:
                continue  # every word that isn't there at all costs an edit
            edits, end = items.verify(k, own[a:b])
            if edits <= budget and (best is None or edits < best[0]):
                best = edits, a + items.start(k, own[a:b], end), a + end
        if best is not None:
            found[d].append((k, best[1], best[2], best[0]))
    return found


def _regions(places: list[int], m: int, budget: int, start: int, n: int) -> Iterator[tuple[int, int]]:
    """Word ranges of a document that hold every substring near one of the places."""
    lo = hi = None
    for p in places:
        a, b = max(0, p - start - 2 * budget), min(n, p - start + m + 2 * budget)
        if a >= b:
            continue
        if hi is not None and a <= hi:
            hi = max(hi, b)
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = a, b
    if hi is not None:
        yield lo, hi


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of Arrow batches with about SEGMENT_BYTES of text, and their texts."""
    for batch in slices(batches, 2048):
        texts = batch.column("text").to_pylist()
        first = size = 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size >= SEGMENT_BYTES or k == len(texts) - 1:
                yield batch.slice(first, k + 1 - first), texts[first : k + 1]
                first, size = k + 1, 0


def item_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items in blocks of a bounded size."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(size / ITEM_BLOCK_BYTES))
    return [rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


_PAIR = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item_words", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64())])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item_words, start_word, end_word, edits) of every contained item."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def block(wanted: list[tuple]) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(wanted)

            def pairs() -> Iterator[tuple]:
                for part, texts in _chunks(batches):
                    for doc_id, found in zip(part.column("doc_id").to_pylist(), matches(items, texts), strict=True):
                        for k, a, b, edits in found:
                            yield doc_id, items.ids[k], len(items.words[k]), a, b, edits

            return in_batches(pairs(), _PAIR)

        return rows.mapInArrow(scan, "doc_id long, item_id long, n_item_words long, start_word long, end_word long, edits long")

    return reduce(DataFrame.unionByName, [block([tuple(r) for r in b.collect()]) for b in item_blocks(benchmark)])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that contain no item; docs has a string column ``text``."""
    out = docs
    for b in item_blocks(benchmark):
        out = _without(out, [tuple(r) for r in b.collect()])
    return out


def _without(docs: DataFrame, wanted: list[tuple]) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(wanted)
        for part, texts in _chunks(batches):
            yield part.filter(pa.array([not found for found in matches(items, texts)], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)

"""Line dedup by pairwise patience alignment (operator 1).

The result is that of aligning every document with every earlier one.  Each
pair's line hashes are aligned by patience diff: lines unique in both are
matched in the longest increasing order, and matches are extended over equal
neighbours; a stretch without such lines is aligned by a longest common
subsequence, of these by one in the fewest blocks.  Aligned common blocks of ``BLOCK_WORDS`` words or more are deleted
from the later document (larger id).  A deleted line always remains in an
earlier document: the earliest holder of a run has nothing to align it with.

Pairs are found by runs: the shortest runs of adjacent lines, from each line
on and up to each line, that have ``BLOCK_WORDS`` words.  Every line of a block
lies in such a run within the block, so a pair without a common run has no
block.  Each holder of a run is aligned with the run's earliest holder.  Where
lines of a run are left in a document (they stand in another order, or more
than once), it is aligned with the run's next earlier holders, in growing
numbers (``RARE_DOCS`` first), until they are deleted or no holder is left.

Only line and run hashes (64 bits) are shuffled for pairing and alignment;
texts move once, to have their lines taken out.

Defined results: lines are split at \\n; null text has no lines and
stays null; a null id is never paired and keeps its text; of rows that repeat
an id the smallest text is aligned, and all of them lose the lines deleted
from it only if their text is the same; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glucoflow.llm.common import encode, in_batches, materialize, rows_of, slices
from glucoflow.llm.hashing import prefix_sums, spans_hash

LINE_WORDS = 3  # of the plain version in tests/llm, which pairs by lines
BLOCK_WORDS = 8
RARE_DOCS = 6
#: next holders of a run in one round at most; rounds go on until none is left
ROUND_DOCS = 768

_LINES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("keys", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32()))])
_RUN = pa.schema([("doc_id", pa.int64()), ("run", pa.int64())])
_OPEN = pa.schema([("run", pa.int64()), ("b", pa.int64()), ("last", pa.int64())])
_GONE = pa.schema([("b", pa.int64()), ("gone", pa.list_(pa.int32()))])
_TEXT = pa.schema([("kept_text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64())])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def line_keys(text: str | None) -> tuple[list[int], list[int]]:
    """Hash and number of words of every line; white space at a line's ends doesn't count."""
    lines = [] if text is None else encode(text).split(b"\n")
    return [_signed(xxhash.xxh3_64_intdigest(x.strip())) for x in lines], [len(x.split()) for x in lines]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b) of equal lines, ascending in both."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        common = [(i, at_b[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at_b]
        if not common:
            matched += [(a0 + i, b0 + j) for i, j in longest_common(a[a0:a1], b[b0:b1])]
            continue
        i0, j0 = a0, b0
        for i, j in [*_increasing(common), (a1, b1)]:
            todo.append((i0, i, j0, j))
            i0, j0 = i, j
    return sorted(matched)


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence of a and b, as positions, in as few blocks as one can be.

    A score counts every match as more than all blocks together and takes one
    off for each block.  Rows of scores are computed over all of b; every
    ``step``-th is kept, and the rows between are computed again on the way back.
    """
    in_a, in_b = set(a), set(b)
    rows = [i for i, x in enumerate(a) if x in in_b]
    if not rows:
        return []
    columns = np.array([j for j, x in enumerate(b) if x in in_a])
    own = np.array(b, np.int64)[columns]
    places = {x: np.flatnonzero(own == x) for x in {a[i] for i in rows}}
    follows = np.diff(columns, prepend=-2) == 1  # the column before is the line before
    match = min(len(rows), len(columns)) + 1
    step = max(1, math.isqrt(len(rows)))

    def row(k: int, ends: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores that end in a match of row k at each column (0: none), and the best up to each column."""
        at = places[a[rows[k]]]
        new = np.zeros_like(ends)
        score = np.where(at > 0, best[at - 1], 0) + match - 1
        if k and rows[k] == rows[k - 1] + 1:
            before = np.where((at > 0) & follows[at], ends[at - 1], 0)
            score = np.maximum(score, np.where(before > 0, before + match, 0))
        new[at] = score
        return new, np.maximum(best, np.maximum.accumulate(new))

    state = np.zeros(len(columns), np.int64), np.zeros(len(columns), np.int64)
    kept = []
    for k in range(len(rows)):
        if k % step == 0:
            kept.append(state)
        state = row(k, *state)
    out: list[tuple[int, int]] = []
    j, goal, inside = len(columns) - 1, int(state[1][-1]), False
    for section in range(len(kept) - 1, -1, -1):
        states = [kept[section]]
        for k in range(section * step, min(len(rows), (section + 1) * step)):
            states.append(row(k, *states[-1]))
        for k in range(section * step + len(states) - 2, section * step - 1, -1):
            (ends, best), (own_ends, _) = states[k - section * step], states[k - section * step + 1]
            if j < 0 or goal <= 0:
                break
            if not inside:
                if best[j] == goal:
                    continue  # reached without this row
                j = int(np.flatnonzero(own_ends[: j + 1] == goal)[0])
            out.append((rows[k], int(columns[j])))
            inside = bool(k and j and rows[k] == rows[k - 1] + 1 and follows[j] and ends[j - 1] > 0 and ends[j - 1] + match == goal)
            goal -= match if inside else match - 1
            j -= 1
    return out[::-1]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs (ascending in the first) that ascends in the second."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before.append(last[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[at], last[at] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def common_blocks(a: list[int], b: list[int], words: list[int]) -> list[int]:
    """Lines of b in aligned blocks with BLOCK_WORDS words or more; words: of b's lines."""
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if sum(words[k] for k in block) >= BLOCK_WORDS:
                out += block
            block = []
        block.append(j)
        before = i, j
    return out


def lines(docs: DataFrame) -> DataFrame:
    """Per document id: a key of its text, and hash and word count of each line."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((d, _signed(xxhash.xxh3_64_intdigest(encode(t))), *line_keys(t)) for d, t in rows_of(batches, "doc_id", "text"))
        return in_batches(made, _LINES, 1024)

    known = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    return known.mapInArrow(rows, "doc_id long, text_key long, keys array<long>, n_words array<int>")


def runs(keys: list[int], n_words: list[int]) -> dict[int, list[tuple[int, int]]]:
    """By hash, the places (from, to) of the shortest runs of lines that have BLOCK_WORDS words."""
    upto = np.concatenate([[0], np.cumsum(n_words, dtype=np.int64)])
    start = np.flatnonzero(upto[-1] - upto[:-1] >= BLOCK_WORDS)
    end = np.flatnonzero(upto >= BLOCK_WORDS)
    start, end = (
        np.concatenate([start, np.searchsorted(upto, upto[end] - BLOCK_WORDS, side="right") - 1]),
        np.concatenate([np.searchsorted(upto, upto[start] + BLOCK_WORDS), end]),
    )
    sums = prefix_sums(np.array(keys, np.int64).view(np.uint64))
    out: dict[int, list[tuple[int, int]]] = {}
    for h, i, j in zip(spans_hash(sums, start, end).view(np.int64).tolist(), start.tolist(), end.tolist(), strict=True):
        out.setdefault(h, []).append((i, j))
    return out


def shared_runs(table: DataFrame) -> DataFrame:
    """(run, doc_id, first_id, n): holders of the runs that several documents hold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((d, run) for d, keys, n in rows_of(batches, "doc_id", "keys", "n_words") for run in runs(keys, n))
        return in_batches(made, _RUN)

    holders = table.select("doc_id", "keys", "n_words").mapInArrow(rows, "doc_id long, run long")
    shared = holders.groupBy("run").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return holders.join(shared, "run")


def aligned(pairs: DataFrame, single: DataFrame) -> DataFrame:
    """(b, gone): lines of b in common blocks with a, for pairs (a, b)."""
    left = single.select(F.col("doc_id").alias("a"), F.col("keys").alias("of_a"))
    right = single.select(F.col("doc_id").alias("b"), F.col("keys").alias("of_b"), "n_words")
    joined = pairs.join(right, "b").join(left, "a").select("b", "of_a", "of_b", "n_words")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((b, common_blocks(x, y, n)) for b, x, y, n in rows_of(batches, "b", "of_a", "of_b", "n_words"))
        return in_batches(((b, gone) for b, gone in made if gone), _GONE, 1024)

    found = joined.mapInArrow(rows, "b long, gone array<int>")
    return _joined(found)


def _joined(found: DataFrame) -> DataFrame:
    # at most one array per partner, each no longer than the document
    return found.groupBy("b").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("gone")))).alias("gone"))


def still_open(wanted: DataFrame, gone: DataFrame, single: DataFrame) -> DataFrame:
    """Rows (run, b, last) of wanted whose run has a line in b that isn't deleted yet."""
    of = wanted.groupBy("b").agg(F.collect_list(F.struct("run", "last")).alias("of"))
    lines_of = single.select(F.col("doc_id").alias("b"), "keys", "n_words")
    joined = of.join(gone, "b", "left").join(lines_of, "b").select("b", "of", "gone", "keys", "n_words")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for b, of, out, keys, n in rows_of(batches, "b", "of", "gone", "keys", "n_words"):
                left = np.ones(len(keys) + 1, np.int64)
                left[0] = 0
                left[np.array(out or [], np.int64) + 1] = 0
                left = np.cumsum(left)
                places = runs(keys, n)
                for r in of:
                    if any(left[j] > left[i] for i, j in places[r["run"]]):
                        yield r["run"], b, r["last"]

        return in_batches(made(), _OPEN)

    return joined.mapInArrow(rows, "run long, b long, last long")


def deletions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, gone): numbers of the lines to delete, one row per document that has any."""
    each = lines(docs).groupBy("doc_id").agg(F.min(F.struct("text_key", "keys", "n_words")).alias("s")).select("doc_id", "s.*")
    single = materialize(each, "lines")
    held = materialize(shared_runs(single), "runs")
    first = held.filter("doc_id > first_id")
    gone = materialize(aligned(first.select(F.col("first_id").alias("a"), F.col("doc_id").alias("b")).distinct(), single), "gone")
    wanted = first.filter("n > 2").select("run", F.col("doc_id").alias("b"), F.col("first_id").alias("last"))
    size = RARE_DOCS
    while True:
        open_runs = materialize(still_open(wanted, gone, single), "open")
        active = open_runs.groupBy("run").agg(F.first("last").alias("last"), F.max("b").alias("top"))
        following = held.join(active, "run").filter("doc_id > last and doc_id < top").select("run", F.col("doc_id").alias("a"))
        place = F.row_number().over(Window.partitionBy("run").orderBy("a"))
        partners = materialize(following.withColumn("place", place).filter(F.col("place") <= size).drop("place"), "partners")
        if partners.isEmpty():
            break
        found = aligned(open_runs.join(partners, "run").filter("a < b").select("a", "b").distinct(), single)
        gone = materialize(_joined(gone.unionByName(found)), "gone")
        reached = partners.groupBy("run").agg(F.max("a").alias("last"))
        wanted = open_runs.drop("last").join(reached, "run").filter("b > last").select("run", "b", "last")
        size = min(2 * size, ROUND_DOCS)
    return gone.withColumnRenamed("b", "doc_id").join(single.select("doc_id", "text_key"), "doc_id")


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with columns kept_text, n_lines, n_removed in addition; other columns stay.

    Columns of these names in docs are replaced.

    docs has a long ``doc_id`` and a string ``text``.
    """
    docs = docs.drop(*_TEXT.names, "_gone_id", "_gone_key", "_gone")
    gone = deletions(docs).select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key"), F.col("gone").alias("_gone"))
    joined = docs.join(gone, F.col("doc_id") == F.col("_gone_id"), "left")
    schema = docs.schema.add("kept_text", "string").add("n_lines", "long").add("n_removed", "long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [_without(*r) for r in zip(*(batch.column(n).to_pylist() for n in ("text", "_gone_key", "_gone")), strict=True)]
            extra = [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _TEXT, strict=True)] if made else [pa.array([], f.type) for f in _TEXT]
            own = batch.schema.names[:-3]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(own))), *extra], names=[*own, *_TEXT.names])

    return joined.mapInArrow(rows, schema)


def _without(text: str | None, key: int | None, gone: list[int] | None) -> tuple[str | None, int, int]:
    if text is None:
        return None, 0, 0
    found = text.split("\n")
    if gone is None or _signed(xxhash.xxh3_64_intdigest(encode(text))) != key:
        return text, len(found), 0
    out = set(gone)
    return "\n".join(x for k, x in enumerate(found) if k not in out), len(found), len(out)

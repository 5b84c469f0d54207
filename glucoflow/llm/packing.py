"""Best-fit packing by sums of squares (operator 5).

Documents become token ids; those longer than a sequence are cut into pieces,
the first of which takes the remainder.  Full pieces are sequences of their
own.  Every other piece goes where the sum over all gaps of the squared number
of open bins with that gap becomes smallest (sum-of-squares rule): either into
an open bin or into a new one.

Only lengths matter for that.  Each task packs its share, long pieces first.
Full bins are done; bins that stay open are taken apart, and their pieces are
packed again together with those of other tasks, in ever fewer tasks, until one
task's worth is left.  There, what still lies in open bins is packed by best
fit at last.  Each round is written to the shared folder.

Defined results: null text is an empty document of the end id only; a null id
is packed like any other; rows that repeat an id are packed each; an empty
table gives an empty one.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoflow.llm.common import in_batches, materialize, rows_of
from glucoflow.llm.tokens import task_encoder

CAPACITY = 1024
#: texts that are encoded together: so many, or so many characters
BATCH_TEXTS = 1024
BATCH_CHARS = 2 << 20
#: pieces that a task packs together
ROUND_PIECES = 50_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the remainder first, then full ones."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document row with a checksum of their ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = task_encoder(tokenizer)

        def made() -> Iterator[tuple]:
            for some in _groups(rows_of(batches, "doc_id", "text")):
                for (doc_id, _), ids in zip(some, encoder.encode([t for _, t in some]), strict=True):
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        yield doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())

        return in_batches(made(), _PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, _PIECES_DDL)


def _groups(rows: Iterator[tuple], texts: int = BATCH_TEXTS, chars: int = BATCH_CHARS) -> Iterator[list[tuple]]:
    """Rows (id, text) in groups of a bounded size."""
    some: list[tuple] = []
    size = 0
    for r in rows:
        some.append(r)
        size += len(r[1] or "")
        if len(some) == texts or size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


class SumOfSquares:
    """Open bins by their gap; places one length at a time."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)
        self.fill: list[int] = []

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of that length.

        Taking a bin of gap g leaves gap g - length: the sum of squares changes
        by (1 - 2 count[g]) for the one that goes and, unless the bin is full,
        1 + 2 count[g - length] for the one that comes.
        """
        c, n = self.count, self.capacity
        gaps = np.arange(length, n)
        change = 1 - 2 * c[length:n] + np.where(gaps > length, 1 + 2 * c[: n - length], 0)
        change[c[length:n] == 0] = np.iinfo(np.int64).max
        new = 1 + 2 * c[n - length] if length < n else 0
        best = int(np.argmin(change)) if len(change) else -1
        if best >= 0 and change[best] <= new:
            gap = length + best
            number = self.open[gap].pop()
            c[gap] -= 1
        else:
            gap, number = n, len(self.fill)
            self.fill.append(0)
        offset = self.fill[number]
        self.fill[number] += length
        if gap > length:
            c[gap - length] += 1
            self.open[gap - length].append(number)
        return number, offset


_PLACED = pa.schema([("item", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])
_PLACED_DDL = "item long, length long, sequence_id long, offset long, fill long"


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, in the given order."""
    bins = SumOfSquares(capacity)
    at = np.array([bins.place(int(n)) for n in lengths], np.int64).reshape(-1, 2)
    return at[:, 0], at[:, 1]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: the open bin with the least gap that holds it, else a new one."""
    gaps: list[int] = []
    open_: dict[int, list[int]] = defaultdict(list)
    out, made = [], 0
    for n in map(int, lengths):
        k = bisect_left(gaps, n)
        if k < len(gaps):
            gap = gaps[k]
            number = open_[gap].pop()
            if not open_[gap]:
                del gaps[k]
        else:
            gap, number, made = capacity, made, made + 1
        out.append((number, capacity - gap))
        if gap > n:
            if not open_[gap - n]:
                insort(gaps, gap - n)
            open_[gap - n].append(number)
    at = np.array(out, np.int64).reshape(-1, 2)
    return at[:, 0], at[:, 1]


def place(lengths: np.ndarray, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, fill of the bin) of pieces in descending order of length.

    last: pieces of bins that stay open are taken out again and packed by best
    fit, where that needs fewer bins.
    """
    number, offset = sum_of_squares(lengths, capacity)
    fill = np.bincount(number, weights=lengths).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    left = np.flatnonzero(fill[number] < capacity) if len(lengths) else number
    if last and len(left):
        other, at = best_fit(lengths[left], capacity)
        if other.max() + 1 < np.count_nonzero(fill < capacity):
            number[left], offset[left] = other + len(fill), at
            fill = np.bincount(number, weights=lengths).astype(np.int64)
    return number, offset, fill[number]


def pack_once(items: DataFrame, capacity: int, level: int, last: bool) -> DataFrame:
    """Pack items(item, length, part) part by part."""

    def group(table: pa.Table) -> pa.Table:
        item, length = table.column("item").to_numpy(), table.column("length").to_numpy()
        order = np.lexsort((item, -length))
        number, offset, fill = place(length[order], capacity, last)
        tag = (level << 56) + (table.column("part")[0].as_py() << 32)
        return pa.table([item[order], length[order], number + tag, offset, fill], schema=_PLACED)

    return items.groupBy("part").applyInArrow(group, _PLACED_DDL)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    # a piece's number is written with it, so it is the same in every round
    numbered = materialize(pieces(docs, tokenizer, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = numbered.filter(F.col("length") == capacity).select(*_PIECES.names, (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = numbered.filter(F.col("length") < capacity)

    placed: list[DataFrame] = []
    todo = rest.select("item", "length")
    n = before = todo.count()
    while n:
        parts = math.ceil(n / ROUND_PIECES)
        last = parts == 1 or (bool(placed) and n > 0.9 * before)
        part = F.pmod(F.xxhash64("item"), F.lit(parts))
        done = materialize(pack_once(todo.withColumn("part", part), capacity, len(placed), last), "placed")
        placed.append(done if last else done.filter(F.col("fill") == capacity))
        if last:
            break
        todo = done.filter(F.col("fill") < capacity).select("item", "length")
        before, n = n, todo.count()
    if not placed:
        return full
    where = reduce(DataFrame.unionByName, placed).select("item", "sequence_id", "offset")
    return full.unionByName(rest.join(where, "item").select(*_PIECES.names, "sequence_id", "offset"))

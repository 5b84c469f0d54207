"""Repeated windows of a corpus, found through difference-cover anchors.

A window is ``length`` consecutive units (words or bytes) of one document.
Units at positions in a difference cover modulo ``period`` start an anchor of
``length - period + 1`` units.  Two equal windows always hold an equal anchor
at the same offset, because any two positions have a common shift below the
period that puts both into the cover.  So only cover positions are hashed
first, a quarter of all for a period of 21, and only windows around a repeated
anchor are looked at again.

Documents are cut into blocks of ascending ids and moved once, by block.  Two
rounds follow, both over the same exchange:

* a block sends the sorted, distinct fingerprints of its anchors, packed as
  differences, one row per block and fingerprint range ("bucket");
* a bucket sorts what all blocks sent, compares neighbours, and answers one
  bit per fingerprint: does another block have it;
* the block sends the fingerprints (64 bits) of all windows around such
  anchors, and learns for each whether an *earlier* block has it.

A fingerprint that a third of the documents hold is one row per block, never a
group of all its occurrences, and nothing but bits comes back.  Within a block
the order of occurrences is known.  A block's and a bucket's memory is bounded;
their numbers grow with the input.

An anchor's fingerprint is cut to ``log2(n) + SPARE_BITS`` bits: an accidental
match only costs a second look.  The windows' fingerprints decide; an
accidental match of two of n windows has a probability of n**2 / 2**65.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucoflow.llm.common import encode, in_batches, rows_of
from glucoflow.llm.hashing import BYTE_VALUES, prefix_sums, spans_hash, word_hashes

#: perfect difference sets: every difference modulo the period occurs once
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
BLOCK_BYTES = 2 << 20
MOST_BLOCK_BYTES = 32 << 20
#: a block is worked through in segments of so many bytes
SEGMENT_BYTES = 1 << 20
#: fingerprints per bucket, on average
BUCKET_ITEMS = 1 << 20
SPARE_BITS = 10
#: bounds of blocks that the driver holds; blocks beyond that divide an interval evenly
MOST_BOUNDS = 256


@dataclass(frozen=True)
class Windows:
    """What a window is: units, length, period of the anchors, and the sizes of an exchange."""

    unit: str
    length: int
    period: int
    #: an earlier occurrence within the same document counts
    within: bool
    bits: int = 64
    anchor_buckets: int = 1
    window_buckets: int = 1

    @property
    def anchor(self) -> int:
        return self.length - self.period + 1

    def sized(self, units: int) -> Windows:
        """With buckets and fingerprint width for a corpus of so many units."""
        anchors = max(1, units * len(COVERS[self.period]) // self.period)
        return replace(
            self,
            bits=min(64, math.ceil(math.log2(anchors + 1)) + SPARE_BITS),
            anchor_buckets=math.ceil(anchors / BUCKET_ITEMS),
            window_buckets=math.ceil(units / (4 * BUCKET_ITEMS)),
        )


# --- one block -----------------------------------------------------------------


class Segment:
    """Some documents of a block, their units one after the other."""

    def __init__(self, first: int, raws: list[bytes], w: Windows):
        self.first, self.w = first, w
        units = [word_hashes(r) if w.unit == "words" else BYTE_VALUES[np.frombuffer(r, np.uint8)] for r in raws]
        self.sizes = np.array([len(u) for u in units], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        values = np.concatenate(units) if units else np.zeros(0, np.uint64)
        self.sums = prefix_sums(values)
        self.position = (np.arange(len(values)) - np.repeat(self.starts, self.sizes)).astype(np.int32)
        self.room = (np.repeat(self.sizes, self.sizes) - self.position).astype(np.int32)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors and their 64-bit hashes."""
        cover = np.zeros(self.w.period, bool)
        cover[list(COVERS[self.w.period])] = True
        at = np.flatnonzero(cover[self.position % self.w.period] & (self.room >= self.w.anchor))
        return at, spans_hash(self.sums, at, at + self.w.anchor)

    def windows(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows that hold one of the repeated anchors (places)."""
        mark = np.zeros(len(self.position) + 1, np.int32)
        mark[repeated + 1] = 1
        upto = np.cumsum(mark, dtype=np.int32)
        fits = np.flatnonzero(self.room >= self.w.length)
        at = fits[upto[fits + self.w.period] > upto[fits]]
        return at, spans_hash(self.sums, at, at + self.w.length)

    def documents(self, at: np.ndarray) -> np.ndarray:
        """Number within the block of the document at each place."""
        # empty documents share their start with the next one, which is the one that holds the place
        return self.first + np.searchsorted(self.starts, at, side="right") - 1


def segments(raws: list[bytes], w: Windows) -> Iterator[Segment]:
    first, size = 0, 0
    for k, raw in enumerate(raws):
        size += len(raw)
        if size >= SEGMENT_BYTES or k == len(raws) - 1:
            yield Segment(first, raws[first : k + 1], w)
            first, size = k + 1, 0


def pack(values: np.ndarray, edge: int) -> bytes:
    """Ascending 64-bit values from edge on, as compressed byte planes of their differences."""
    d = np.diff(values, prepend=np.uint64(edge))
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    planes = d.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + len(d).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, edge: int) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:5], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:], max_output_size=max(1, n * width)), np.uint8)
    d = np.zeros((n, 8), np.uint8)
    d[:, :width] = planes.reshape(width, n).T
    return np.cumsum(d.reshape(-1).view(np.uint64), dtype=np.uint64) + np.uint64(edge)


def edges(bits: int, buckets: int) -> list[int]:
    """Least fingerprint of each bucket."""
    return [(b << bits) // buckets + (1 if ((b << bits) % buckets) else 0) for b in range(buckets)]


@dataclass
class Sent:
    """The distinct fingerprints a block sends in a round, in ascending order."""

    values: np.ndarray
    inverse: np.ndarray
    counts: np.ndarray
    bits: int
    buckets: int

    @staticmethod
    def of(hashes: np.ndarray, bits: int, buckets: int) -> Sent:
        values, inverse, counts = np.unique(hashes >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        return Sent(values, inverse, counts, bits, buckets)

    def slices(self) -> Iterator[tuple[int, int, int, int]]:
        """(bucket, its edge, from, to) of every bucket with values."""
        all_edges = edges(self.bits, self.buckets)
        cut = [*np.searchsorted(self.values, np.array(all_edges, np.uint64)), len(self.values)]
        for b, edge in enumerate(all_edges):
            if cut[b + 1] > cut[b]:
                yield b, edge, int(cut[b]), int(cut[b + 1])

    def rows(self) -> Iterator[tuple[int, bytes]]:
        for b, edge, lo, hi in self.slices():
            yield b, pack(self.values[lo:hi], edge)

    def answers(self, bits_of: dict[int, bytes]) -> np.ndarray:
        """The bucket's bit for every value."""
        out = np.zeros(len(self.values), bool)
        for b, _, lo, hi in self.slices():
            out[lo:hi] = np.unpackbits(np.frombuffer(bits_of[b], np.uint8), count=hi - lo).astype(bool)
        return out


class Block:
    """The documents of a block in ascending order, with what the rounds say about them."""

    def __init__(self, table: pa.Table, w: Windows):
        expand = zstandard.ZstdDecompressor().decompress
        ids, packed = table.column("doc_id").to_pylist(), table.column("packed").to_pylist()
        texts = [None if p is None else expand(p) for p in packed]
        rows = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or b""))
        self.ids = [r[0] for r in rows]
        self.raws = [r[1] or b"" for r in rows]
        self.w = w

    def working(self, skip: set) -> list[bytes]:
        """Texts that take part; whole copies, known already, don't."""
        return [b"" if i in skip else r for i, r in zip(self.ids, self.raws, strict=True)] if skip else self.raws

    def anchor_values(self, skip: set) -> tuple[list[np.ndarray], Sent]:
        places, hashes = [], []
        for s in segments(self.working(skip), self.w):
            at, h = s.anchors()
            places.append(at)
            hashes.append(h)
        return places, Sent.of(_joined(hashes), self.w.bits, self.w.anchor_buckets)

    def window_values(self, skip: set, anchor_bits: dict[int, bytes]) -> tuple[list[np.ndarray], np.ndarray, Sent]:
        """Places by segment, document numbers, and fingerprints of the windows in question."""
        places, sent = self.anchor_values(skip)
        repeated = (sent.answers(anchor_bits) | (sent.counts > 1))[sent.inverse]
        found, documents, hashes, done = [], [], [], 0
        for s, at in zip(segments(self.working(skip), self.w), places, strict=True):
            where, h = s.windows(at[repeated[done : done + len(at)]])
            done += len(at)
            found.append(where)
            documents.append(s.documents(where))
            hashes.append(h)
        return found, _joined(documents).astype(np.int64), Sent.of(_joined(hashes), 64, self.w.window_buckets)

    def removals(self, skip: set, anchor_bits: dict[int, bytes], window_bits: dict[int, bytes]) -> Iterator[np.ndarray]:
        """Per document the mask of its units that an earlier occurrence covers.

        The mask of a skipped document is left empty.
        """
        found, documents, sent = self.window_values(skip, anchor_bits)
        earlier = sent.answers(window_bits)[sent.inverse]
        if self.w.within:
            first = np.full(len(sent.values), len(sent.inverse), np.int64)
            np.minimum.at(first, sent.inverse, np.arange(len(sent.inverse)))
            earlier |= first[sent.inverse] < np.arange(len(sent.inverse))
        else:
            # the least id of the block's documents that hold the value; equal ids are no earlier ones
            rank = np.unique(np.array([np.iinfo(np.int64).max if i is None else i for i in self.ids]), return_inverse=True)[1]
            own = rank[documents] if len(documents) else documents
            first = np.full(len(sent.values), len(self.ids), np.int64)
            np.minimum.at(first, sent.inverse, own)
            earlier |= first[sent.inverse] < own
        done = 0
        for s, where in zip(segments(self.working(skip), self.w), found, strict=True):
            hit = where[earlier[done : done + len(where)]]
            done += len(where)
            step = np.zeros(len(s.position) + 1, np.int32)
            np.add.at(step, hit, 1)
            np.add.at(step, hit + self.w.length, -1)
            covered = np.cumsum(step)[:-1] > 0
            for start, size in zip(s.starts, s.sizes, strict=True):
                yield covered[start : start + size]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


# --- the exchange ----------------------------------------------------------------

_SENT = pa.schema([("round", pa.string()), ("bucket", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
_SENT_DDL = "round string, bucket int, block long, payload binary"


def blocked(docs: DataFrame, total_bytes: int) -> DataFrame:
    """docs(doc_id, text) with ``block``: ascending with the id, a bounded number of bytes on average."""
    size = min(MOST_BLOCK_BYTES, BLOCK_BYTES * max(1.0, math.sqrt(total_bytes / 2**30)))
    blocks = max(1, math.ceil(total_bytes / size))
    bounds = min(blocks, MOST_BOUNDS)
    shares = [k / bounds for k in range(bounds + 1)]
    cut = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 100_000)).first()[0]
    return docs.withColumn("block", block_number(F.col("doc_id"), sorted(set(cut or [0])), max(1, blocks // bounds)))


def block_number(doc_id: Column, bounds: list[int], parts: int) -> Column:
    """Interval of the id among bounds, each cut into so many even parts; null ids come last."""
    array = F.array(*(F.lit(int(b)).cast("long") for b in bounds))
    k = F.greatest(F.lit(1), F.size(F.filter(array, lambda b: b <= doc_id))).cast("long")
    low = F.element_at(array, k.cast("int")).cast("decimal(38,0)")
    high = F.coalesce(F.get(array, k.cast("int")).cast("decimal(38,0)"), low + 1)
    part = F.floor((doc_id.cast("decimal(38,0)") - low) * parts / F.greatest(high - low, F.lit(1))).cast("long")
    return F.when(doc_id.isNull(), F.lit(len(bounds) * parts)).otherwise((k - 1) * parts + F.greatest(F.lit(0).cast("long"), F.least(part, F.lit(parts - 1).cast("long"))))


_PACKED = pa.schema([("doc_id", pa.int64()), ("packed", pa.binary()), ("block", pa.int64())])


def packed_texts(docs: DataFrame) -> DataFrame:
    """docs with the text as compressed UTF-8: it is moved once and kept on disk while the rounds run."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        made = ((d, None if t is None else compress(encode(t)), b) for d, t, b in rows_of(batches, "doc_id", "text", "block"))
        return in_batches(made, _PACKED, 512)

    return docs.select("doc_id", "text", "block").mapInArrow(rows, "doc_id long, packed binary, block long")


def _bits(table: pa.Table, name: str) -> dict[int, bytes]:
    return {b: p for r, b, p in zip(table.column("round").to_pylist(), table.column("bucket").to_pylist(), table.column("payload").to_pylist(), strict=True) if r == name}


def _skipped(table: pa.Table) -> set:
    return {int.from_bytes(p, "big", signed=True) for r, p in zip(table.column("round").to_pylist(), table.column("payload").to_pylist(), strict=True) if r == "copy"}


def _sent_table(name: str, block: int, sent: Sent) -> pa.Table:
    rows = list(sent.rows())
    return pa.table([pa.array([name] * len(rows), pa.string()), pa.array([b for b, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([p for _, p in rows], pa.binary())], schema=_SENT)


def _answer(name: str, bits: int, buckets: int, earlier_only: bool) -> Callable[[pa.Table], pa.Table]:
    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        bucket = table.column("bucket")[0].as_py()
        edge = edges(bits, buckets)[bucket]
        parts = [unpack(p.as_py(), edge) for p in table.column("payload")]
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        same = ranked[1:] == ranked[:-1]
        hit = np.zeros(len(values), bool)
        hit[1:] = same
        if not earlier_only:
            hit[:-1] |= same
        out = np.zeros(len(values), bool)
        out[order] = hit
        cut = np.cumsum([0] + [len(p) for p in parts])
        replies = [np.packbits(out[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        n = len(replies)
        return pa.table([pa.array([name] * n, pa.string()), pa.array([bucket] * n, pa.int32()), table.column("block").combine_chunks(), pa.array(replies, pa.binary())], schema=_SENT)

    return answer


def repeated_windows(docs: DataFrame, w: Windows, finish: Callable[[Block, Iterator[np.ndarray], set], pa.Table], ddl: str, total_bytes: int, copies: DataFrame | None = None) -> DataFrame:
    """finish(block, masks of the units to remove, skipped ids) for every block.

    docs: (doc_id, text, block).  copies: (block, doc_id) of documents known to
    be whole copies of an earlier one; they take no part.
    """
    docs = packed_texts(docs)
    w = w.sized(total_bytes if w.unit == "bytes" else max(1, total_bytes // 5))
    skip = None
    if copies is not None:
        as_bytes = F.unhex(F.lpad(F.hex("doc_id"), 16, "0"))
        skip = copies.select(F.lit("copy").alias("round"), F.lit(-1).alias("bucket"), (F.col("block") + 0).alias("block"), as_bytes.alias("payload"))

    def send_anchors(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        return _sent_table("anchor", key[0].as_py(), Block(texts, w).anchor_values(_skipped(known))[1])

    def send_windows(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        return _sent_table("window", key[0].as_py(), Block(texts, w).window_values(_skipped(known), _bits(known, "anchor"))[2])

    def remove(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        block, skipped = Block(texts, w), _skipped(known)
        return finish(block, block.removals(skipped, _bits(known, "anchor"), _bits(known, "window")), skipped)

    def with_known(known: DataFrame | None, function: Callable, schema: str) -> DataFrame:
        known = docs.sparkSession.createDataFrame([], _SENT_DDL) if known is None else known
        return docs.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(function, schema)

    sent = with_known(skip, send_anchors, _SENT_DDL)
    anchors = sent.groupBy("bucket").applyInArrow(_answer("anchor", w.bits, w.anchor_buckets, False), _SENT_DDL)
    known = anchors if skip is None else anchors.unionByName(skip)
    sent = with_known(known, send_windows, _SENT_DDL)
    windows = sent.groupBy("bucket").applyInArrow(_answer("window", 64, w.window_buckets, True), _SENT_DDL)
    return with_known(known.unionByName(windows), remove, ddl)

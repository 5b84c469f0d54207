"""Byte-level dedup of repeated 50-byte windows (operator 10).

A byte is removed when a 50-byte string covers it that also starts in a
document of a smaller id.

This is the method of op3 (``anchors.py``) with bytes for words, length 50 and
period 21: blocks of documents exchange fingerprints of anchors at positions in
a difference cover, then of the windows around repeated anchors.  No suffix
array is built: no sort of tuples over the corpus, no names, no recursion and
no merge.  The windows' 64-bit fingerprints decide; their bytes aren't compared.

Documents that are whole copies of an earlier one are found by a digest first;
all their bytes go, and they take no part in the exchange.

Defined results: null text is empty; texts of fewer than 50 bytes keep
everything; rows that repeat an id are not earlier than each other; null ids
come last; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoflow.llm.anchors import Block, Windows, blocked, repeated_windows
from glucoflow.llm.common import total_bytes

LENGTH = 50
SUFFIXES = Windows(unit="bytes", length=LENGTH, period=21, within=False)

_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _kept(block: Block, masks: Iterator[np.ndarray], copies: set) -> pa.Table:
    rows = []
    for doc_id, raw, mask in zip(block.ids, block.raws, masks, strict=True):
        if doc_id in copies:
            rows.append((doc_id, len(raw), len(raw), 1, b""))
        elif mask.any():
            spans = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(mask[0])
            rows.append((doc_id, len(raw), int(np.count_nonzero(mask)), spans, np.frombuffer(raw, np.uint8)[~mask].tobytes()))
        else:
            rows.append((doc_id, len(raw), 0, 0, raw))
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _KEPT, strict=True)], schema=_KEPT)] if rows else [], schema=_KEPT)


def whole_copies(docs: DataFrame) -> DataFrame:
    """(block, doc_id) of documents of LENGTH bytes or more that equal one of a smaller id.

    Digests are summed up per text before the shuffle; an id that has other
    texts too is left to the sorts.
    """
    known = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).select("doc_id", "block", F.sha2("text", 256).alias("digest"))
    first = known.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    later = known.join(first, "digest").filter("doc_id > first_id").select("block", "doc_id")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    return later.join(repeated, "doc_id", "left_anti").select("block", "doc_id").distinct()


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every document row; kept is binary."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = total_bytes(rows)
    parted = blocked(rows, size)
    return repeated_windows(parted, SUFFIXES, _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", size, whole_copies(parted))

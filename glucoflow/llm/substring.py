"""Substring dedup over words through difference-cover anchors (operator 3).

A window is 20 consecutive words of one document.  Every word covered by a
window whose word sequence starts earlier too (in a document of a smaller id,
or earlier in the same one) is removed; windows are judged on the input.
Hashes are taken at cover positions modulo 13 first (4 of 13 positions, 8
words each); any two equal windows share an aligned one; windows around
repeated anchors are then compared at full length (see ``anchors``).

Defined results: null or empty text has no words; rows that repeat an id are
one document after the other, in the order of their texts; null ids come last;
other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoflow.llm.anchors import Block, Windows, blocked, repeated_windows
from glucoflow.llm.common import total_bytes

WORDS = Windows(unit="words", length=20, period=13, within=True)

_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _kept(block: Block, masks: Iterator[np.ndarray], _: set) -> pa.Table:
    rows = []
    for doc_id, raw, mask in zip(block.ids, block.raws, masks, strict=True):
        words = raw.split()
        if mask.any():
            kept = [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone]
        else:
            kept = words
        rows.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept)))
    ids, n, gone, texts = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], schema=_KEPT)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every document row; kept words joined by a space."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = total_bytes(rows)
    return repeated_windows(blocked(rows, size), WORDS, _kept, "doc_id long, n_words long, n_removed long, kept_text string", size)

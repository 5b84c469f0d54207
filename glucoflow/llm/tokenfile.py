"""Token-id files: documents as coded blocks of ids, and their way back (operator 6).

Documents are sorted by id into shards.  A shard's ids, one document after the
other, each with its end id, are cut into blocks of ``coder.BLOCK_IDS`` ids,
coded independently (see ``coder``).  A file set is a Parquet folder with a row
per block (shard, number in the shard, coded bytes) and a row per document
(shard, place and number of its ids in the shard); Spark writes and reads it,
so any storage that Spark reaches will do, and a task that is tried again
writes the same rows.

Reading decodes a shard's blocks together and checks every checksum.

Defined results: null text is empty (the end id only); null ids come first;
rows that repeat an id follow each other in the order of their texts; an empty
table gives an empty file set.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glucoflow.llm import coder
from glucoflow.llm.common import in_batches, rows_of, total_bytes
from glucoflow.llm.packing import _groups
from glucoflow.llm.tokens import task_encoder

SHARD_BYTES = 12 << 20
#: texts that are encoded together: so many, or so many characters
BATCH_TEXTS = 8192
BATCH_CHARS = 6 << 20

_ROW = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("number", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
_ROW_DDL = "shard int, kind string, number long, doc_id long, place long, n_ids long, payload binary"
_READ = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def write_ids(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Write the ids of all documents, ascending by doc_id, as a file set at path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = max(1, math.ceil(total_bytes(rows) / SHARD_BYTES))
    ordered = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = task_encoder(tokenizer)

        def made() -> Iterator[tuple]:
            waiting: list[np.ndarray] = []
            size = place = number = block = 0
            full = coder.LANES * coder.BLOCK_IDS
            for some in _groups(rows_of(batches, "doc_id", "text"), BATCH_TEXTS, BATCH_CHARS):
                for (doc_id, _), ids in zip(some, encoder.encode([t for _, t in some]), strict=True):
                    yield shard, "document", number, doc_id, place, len(ids), None
                    number, place, size = number + 1, place + len(ids), size + len(ids)
                    waiting.append(ids)
                if size >= full:
                    joined = np.concatenate(waiting)
                    keep = len(joined) // coder.BLOCK_IDS * coder.BLOCK_IDS
                    for row in _blocks(shard, block, joined[:keep]):
                        yield row
                    block += keep // coder.BLOCK_IDS
                    waiting, size = [joined[keep:]], len(joined) - keep
            yield from _blocks(shard, block, np.concatenate(waiting) if waiting else np.zeros(0, "<u4"))

        return in_batches(made(), _ROW)

    ordered.mapInArrow(encode, _ROW_DDL).write.parquet(path)


def _blocks(shard: int, first: int, ids: np.ndarray) -> Iterator[tuple]:
    parts = [ids[k : k + coder.BLOCK_IDS] for k in range(0, len(ids), coder.BLOCK_IDS)]
    for k, (part, data) in enumerate(zip(parts, coder.encode_blocks(parts), strict=True)):
        yield shard, "block", first + k, None, (first + k) * coder.BLOCK_IDS, len(part), data


def _shard_documents(table: pa.Table) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
    """(doc_id, shard, place, ids) of a shard's rows, its blocks decoded."""
    rows = table.sort_by("number").to_pylist()
    blocks = [r for r in rows if r["kind"] == "block"]
    ids = np.concatenate([np.zeros(0, "<u4"), *coder.decode_blocks([r["payload"] for r in blocks])])
    for r in rows:
        if r["kind"] == "document":
            yield r["doc_id"], r["shard"], r["place"], ids[r["place"] : r["place"] + r["n_ids"]]


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, place, n_tokens, ids) of every document in the files at path."""

    def decode(table: pa.Table) -> pa.Table:
        rows = [(d, s, p, len(ids), ids.astype(np.int32)) for d, s, p, ids in _shard_documents(table)]
        return pa.Table.from_batches(list(in_batches(iter(rows), _READ)), schema=_READ)

    return spark.read.schema(_ROW_DDL).parquet(path).groupBy("shard").applyInArrow(decode, "doc_id long, shard int, place long, n_tokens long, ids array<int>")


_SUMS = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files at path.

    start counts the ids of all documents before; a window over one row per
    shard gives each shard's own.
    """

    def decode(table: pa.Table) -> pa.Table:
        rows = [(d, s, p, len(ids), zlib.crc32(ids.tobytes())) for d, s, p, ids in _shard_documents(table)]
        return pa.Table.from_batches(list(in_batches(iter(rows), _SUMS)), schema=_SUMS)

    files = spark.read.schema(_ROW_DDL).parquet(path)
    found = files.groupBy("shard").applyInArrow(decode, "doc_id long, shard int, place long, n_tokens long, ids_crc32 long")
    sizes = files.filter("kind = 'document'").groupBy("shard").agg(F.sum("n_ids").alias("in_shard"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("in_shard").over(before), F.lit(0)).alias("base"))
    return found.join(bases, "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")

"""Helpers shared by the operators: word splitting, shared scratch tables, sizes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators of a word, and bytes.split()'s own set
SPACE = b" \t\n\r\x0b\x0c"
#: rows of texts that Spark and a Python worker hold at a time, each on both sides of the pipe
BATCH_ROWS = 1000


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes; null has none."""
    return encode(text).split()


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests), a folder beside the warehouse is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the driver's place, and hand them few texts at a time.

    On a cluster without that folder, ship the package with --py-files.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= BATCH_ROWS:
        spark.conf.set(batch, str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The result has no lineage, so a lost executor costs one re-read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts (one aggregate, one row to the driver)."""
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def null_key(c: str) -> Column:
    """A grouping key that keeps null apart from every text."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))


def slices(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of at most ``size`` rows: few texts are Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            yield batch.slice(k, size)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of Arrow batches, row by row."""
    for batch in slices(batches):
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows (tuples in schema order) as Arrow batches of at most ``size`` rows."""
    buffer: list[tuple] = []
    for row in rows:
        buffer.append(row)
        if len(buffer) >= size:
            yield to_batch(buffer, schema)
            buffer = []
    if buffer:
        yield to_batch(buffer, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

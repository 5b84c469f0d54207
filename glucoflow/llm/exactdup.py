"""Exact dedup (operator 13): stateful streaming with byte checks, DataFrame functions only.

A stream reads a folder of Parquet files and keeps one row of state per digest:
the number of rows seen, the stable identifier of the row that stays (largest
doc_id) and the locator of its content (file and row).  The state is on disk
(RocksDB, checkpointed in the shared folder) and never expires, so a later run
with the same checkpoint reads only files that are new.  Digests seen more than
once are hits: their texts are read again and grouped by their full bytes
within each task before anything is shuffled.  A digest that two texts share is
split by these groups, so a collision never removes a row.

* null texts count as empty; empty texts equal each other;
* a row with a null id stays only if its group has no other id; of rows that
  repeat id and text exactly one stays (the later file key and row);
* extra columns, whatever their names, are not read;
* an empty table gives an empty result.

Skew: equal rows of a task are summed up before the shuffle, both for the state
and for the byte check.  Digests with more than 1 / HOT of all rows, at most
HOT of them, are broadcast; all others are joined by digest.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glucoflow.llm.common import materialize, scratch_path

#: bytes of the SHA-256 digest that key the state
KEY_BYTES = 32
#: a micro-batch takes about so many bytes of files
BATCH_BYTES = 1 << 40
#: a digest is hot with more than this share of the rows (1 / HOT); so there are at most HOT such digests
HOT = 10_000
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a store is in memory while its task runs
}
OUT = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"


@contextmanager
def _state_on_disk(spark: SparkSession):
    """Queries started and state read inside follow these settings; the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _as_pattern(path: str) -> str:
    """A pattern that matches the path alone: a stream also reads a single file by it."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def located(docs: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """doc_id, text (null as empty), sha256, digest, and where the row is: file_key, row_index."""
    place = docs.metadataColumn("_metadata")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.xxhash64(place["file_path"]).alias("file_key"),
        place["row_index"].alias("row_index"),
    )
    sha = F.unhex(F.sha2("text", 256))
    return rows.select("*", sha.alias("sha256"), F.substring(sha, 1, key_bytes).alias("digest"))


def learn(spark: SparkSession, path: str, checkpoint: str, schema: StructType, key_bytes: int = KEY_BYTES, batch_bytes: int = BATCH_BYTES) -> None:
    """Take all files of path that the checkpoint has not seen into its state.

    The number of state partitions is ``spark.sql.shuffle.partitions`` of the
    first run; a run that stops half-way goes on from its last batch.
    """
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(_as_pattern(path))
    seen = (
        located(stream, key_bytes)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "file_key", "row_index")).alias("keep"))
    )
    with _state_on_disk(spark):
        query = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state, one row per digest: digest, n, keep (doc_id, file_key, row_index)."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key.digest").alias("digest"), F.col("value.count").alias("n"), F.col("value.max").alias("keep"))


def parted(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State of hot digests, at most HOT rows, and of all others."""
    rows = state.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(rows // HOT, 1)
    return state.filter(hot), state.filter(~hot)


def equal_texts(docs: DataFrame, hot: DataFrame, cold: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """Rows of hits grouped by their bytes: digest, text, n, keep; usually one group per digest.

    Grouping compares whole texts; equal ones of a task meet before the shuffle.
    Texts meet cold hits by a sort-merge join at every size, so that what is
    moved grows evenly: at most all texts once.
    """
    rows = located(docs, key_bytes)
    often = F.broadcast(hot.select("digest"))
    hits = cold.filter("n > 1").select("digest").hint("merge")
    seen = rows.join(often, "digest").unionByName(rows.join(often, "digest", "left_anti").join(hits, "digest"))
    return seen.groupBy("digest", "text").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "file_key", "row_index")).alias("keep"))


def with_state(rows: DataFrame, hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Rows with n and keep of their digest; rows of hot digests go anywhere in the shuffle."""
    named = lambda side, tag: side.select(F.col("digest").alias(f"{tag}_digest"), F.col("n").alias(f"{tag}_n"), F.col("keep").alias(f"{tag}_keep"))
    found = rows.join(F.broadcast(named(hot, "hot")), F.col("digest") == F.col("hot_digest"), "left")
    anywhere = F.concat(F.col("digest"), F.encode(F.hex("file_key"), "utf-8"), F.encode(F.hex("row_index"), "utf-8"))  # longer than a digest
    found = found.withColumn("key", F.when(F.col("hot_n").isNull(), F.col("digest")).otherwise(anywhere))
    found = found.join(named(cold, "cold"), F.col("key") == F.col("cold_digest"), "left")
    return found.select(*rows.columns, F.coalesce("hot_n", "cold_n").alias("n"), F.coalesce("hot_keep", "cold_keep").alias("keep"))


def exact_dedup(spark: SparkSession, path: str, checkpoint: str | None = None, key_bytes: int = KEY_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per document of path, the dropped ones too (see OUT).

    With a checkpoint of one's own, a later call reads only new files into the
    state; files that arrive during a call are judged by the next one.
    """
    docs = spark.read.parquet(path)
    if docs.isEmpty():
        return spark.createDataFrame([], OUT)
    checkpoint = checkpoint or scratch_path(spark, "exact-state")
    learn(spark, path, checkpoint, docs.schema, key_bytes, batch_bytes)
    with _state_on_disk(spark):
        state = materialize(held(spark, checkpoint), "exact-held")

    hot, cold = parted(state)
    groups = equal_texts(docs, hot, cold, key_bytes)
    shared = groups.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest")
    shared = materialize(shared, "exact-collisions")

    rows = located(docs, key_bytes).drop("text")
    judged = with_state(rows, hot, cold)
    if not shared.isEmpty():  # a digest of several texts: these rows follow the groups of equal bytes
        apart = groups.join(shared, "digest").select("digest", F.unhex(F.sha2("text", 256)).alias("sha256"), F.col("n").alias("own_n"), F.col("keep").alias("own_keep"))
        judged = judged.join(apart, ["digest", "sha256"], "left").withColumn("n", F.coalesce("own_n", "n")).withColumn("keep", F.coalesce("own_keep", "keep"))
    stays = (F.col("keep.file_key") == F.col("file_key")) & (F.col("keep.row_index") == F.col("row_index"))
    return judged.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        stays.alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )

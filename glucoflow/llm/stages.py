"""Stages of the corpus pipeline: documents in, documents out.

Each takes (spark, docs, sf_dir) and, but for the last, returns the columns of
``documents`` in their order.  Extra columns of docs are left out.  Null ids
are kept as rows of their own; rows that repeat an id are one document from
the near-duplicate stage on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glucoflow.llm import decontaminate, langid, linededup, neardup, packing
from glucoflow.llm.common import importable, materialize
from glucoflow.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def columns_of(docs: DataFrame) -> DataFrame:
    """The columns of documents with their types."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    return docs.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def _row_key() -> Column:
    """Tells rows apart by their content, whatever is null or repeated."""
    return F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "text", "lang", "source")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go."""
    importable(spark)
    docs = columns_of(docs)
    evidence = langid.of_documents(docs.withColumn("_key", _row_key()).drop("doc_id").withColumnRenamed("_key", "doc_id"))
    rejected = materialize(langid.identify(evidence).filter(~F.col("accepted")).select("row_key").distinct(), "rejected")
    return docs.withColumn("row_key", _row_key()).join(rejected, "row_key", "left_anti").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks that an earlier one holds; wholly copied ones go."""
    importable(spark)
    kept = linededup.line_dedup(columns_of(docs))
    emptied = (F.col("n_removed") > 0) & (F.trim("kept_text") == "")
    return kept.filter(~F.coalesce(emptied, F.lit(False))).select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars")
    )


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each near-duplicate group."""
    importable(spark)
    docs = columns_of(docs)
    judged = neardup.near_duplicates(docs)
    gone = materialize(judged.filter(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    again = materialize(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated-ids")
    single = left.join(again, "doc_id", "left_anti")
    return single.unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    importable(spark)
    return decontaminate.clean(columns_of(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces placed in sequences of at most 1024 ids."""
    importable(spark)
    return packing.pack(columns_of(docs), tokenizer())

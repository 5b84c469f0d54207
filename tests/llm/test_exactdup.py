"""Exact dedup against a plain version: texts compared, the largest id stays."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glucoflow.llm import exactdup
from glucoflow.llm.common import scratch_path


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        stays = ids.index(keep)
        out += [(d, keep, len(ids), k == stays, sha) for k, d in enumerate(ids)]
    return Counter(out)


def result(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def save(spark, rows, path, files=3):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(files).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def stored(docs, spark):
    path = scratch_path(spark, "exact-docs")
    docs.write.parquet(path)  # with columns named like those used inside
    return path


@pytest.mark.parametrize("key_bytes", [32, 1])
def test_against_plain(spark, rows, stored, key_bytes):
    got = exactdup.exact_dedup(spark, stored, key_bytes=key_bytes)
    assert ", ".join(f"{c} {t.replace('bigint', 'long')}" for c, t in got.dtypes) == exactdup.OUT
    assert result(got) == plain([(r[0], r[1]) for r in rows])


def test_digest_of_one_byte_collides(spark, rows, stored):
    """With keys of one byte most digests hold several texts; none of them may be dropped."""
    kept = exactdup.exact_dedup(spark, stored, key_bytes=1).filter("kept")
    assert kept.select("text_sha256").distinct().count() == kept.count() == len({r[1] or "" for r in rows})


def test_new_files_meet_the_state(spark):
    """A second run reads only the new file, and an earlier row loses to a larger id."""
    first = [(1, "a", None, None, 1), (2, "b", None, None, 1), (5, None, None, None, None)]
    later = [(3, "a", None, None, 1), (4, "c", None, None, 1), (0, "", None, None, 0)]
    path, checkpoint = scratch_path(spark, "exact-in"), scratch_path(spark, "exact-ck")
    save(spark, first, path, 1)
    assert result(exactdup.exact_dedup(spark, path, checkpoint)) == plain([r[:2] for r in first])
    save(spark, later, path, 1)
    assert result(exactdup.exact_dedup(spark, path, checkpoint)) == plain([r[:2] for r in first + later])
    sums = exactdup.held(spark, checkpoint).agg({"n": "sum"}).first()[0]
    assert sums == 6  # no row counted twice


def test_batches_of_one_file(spark):
    rng = random.Random(5)
    rows = [(k, "hot" if rng.random() < 0.4 else str(rng.randrange(60)) * 50, None, None, None) for k in range(400)]
    path = save(spark, rows, scratch_path(spark, "exact-many"), 6)
    assert result(exactdup.exact_dedup(spark, path, batch_bytes=1)) == plain([r[:2] for r in rows])


def test_empty_table_and_single_file(spark, empty):
    path = scratch_path(spark, "exact-empty")
    empty.write.parquet(path)
    assert exactdup.exact_dedup(spark, path).collect() == []
    one = spark.read.parquet(save(spark, [(1, "x", None, None, 1), (2, "x", None, None, 1)], scratch_path(spark, "exact-one"), 1)).inputFiles()[0]
    assert result(exactdup.exact_dedup(spark, one)) == plain([(1, "x"), (2, "x")])


def test_hot_digests(spark, monkeypatch):
    """With a bound of 3 hot digests the large groups are broadcast, the others joined."""
    monkeypatch.setattr(exactdup, "HOT", 3)
    rows = [(k, "hot" if k % 3 else f"text {k % 30}", None, None, None) for k in range(300)]
    assert result(exactdup.exact_dedup(spark, save(spark, rows, scratch_path(spark, "exact-hot"), 4))) == plain([r[:2] for r in rows])


def test_session_settings_stay(spark):
    before = {k: spark.conf.get(k, None) for k in exactdup.STATE_CONF}
    with exactdup._state_on_disk(spark):
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
    assert {k: spark.conf.get(k, None) for k in exactdup.STATE_CONF} == before


def test_no_python_in_plans(spark, stored):
    docs = spark.read.parquet(stored)
    state = exactdup.located(docs).groupBy("digest").agg({"doc_id": "count"}).selectExpr("digest", "`count(doc_id)` as n", "named_struct('doc_id', 1L, 'file_key', 1L, 'row_index', 1L) as keep")
    plan = exactdup.with_state(exactdup.equal_texts(docs, state, state).withColumn("file_key", F.lit(1)).withColumn("row_index", F.lit(1)), state, state)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))

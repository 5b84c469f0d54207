"""What the near-duplicate operator moves and compares; its results are in test_operators."""

import random

from conftest import prose
from pyspark.sql import functions as F

from glucoflow.llm import neardup
from glucoflow.llm.common import importable, materialize


def steps_of(monkeypatch, spark, rows, width=3, num=85):
    """The result for rows, the tables written on the way and the plans that made them."""
    made, plans = {}, {}

    def recorded(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        made.setdefault(name, materialize(df, name))
        return made[name] if name != "links" else materialize(df, name)

    monkeypatch.setattr(neardup, "materialize", recorded)
    got = neardup.near_duplicates(importable(spark).createDataFrame(rows, "doc_id long, text string"), width, num, 100)
    return {r["doc_id"]: r["component_id"] for r in got.collect()}, made, plans


def altered(text, rng, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{k}"
    return " ".join(words)


def test_texts_stay_and_buckets_move_once(spark, monkeypatch):
    """Neither texts nor the buckets of all sets are moved to be joined, however small a table must be to be broadcast."""
    rng = random.Random(5)
    text = prose(rng, 200)
    rows = [(k, prose(rng, 200)) for k in range(20)] + [(30, text), (31, altered(text, rng, 2))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, _, plans = steps_of(monkeypatch, spark, rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {k: k for k in range(20)} | {30: 30, 31: 30}
    assert "Exchange hashpartitioning(set_key" in plans["elements"]
    assert "Exchange hashpartitioning(doc_id" not in plans["elements"]
    assert plans["classes"].count("Exchange hashpartitioning") == 1


def test_a_refuted_pair_is_not_open(spark, monkeypatch):
    """The only two members of a bucket are compared once; they are no members of an open bucket."""
    rng = random.Random(6)
    text = prose(rng, 300)
    got, made, _ = steps_of(monkeypatch, spark, [(1, text), (2, altered(text, rng, 25))])
    assert got == {1: 1, 2: 2}
    assert made["buckets"].count() > 0
    assert made["open"].count() == 0


def test_links_beside_the_pivot_are_found(spark, monkeypatch):
    """Of three sets that share buckets, two are linked with each other and none with the third."""
    for seed in range(3):
        rng = random.Random(seed)
        text = prose(rng, 300)
        other = altered(text, rng, 18)
        rows = [(1, text), (2, other), (3, altered(other, rng, 3))]
        got, _, _ = steps_of(monkeypatch, spark, rows)
        assert got == {1: 1, 2: 2, 3: 2}


def test_filter_keeps_every_wanted_key(spark, monkeypatch):
    """The filter loses no wanted key, at a few bits either."""
    rows = spark.range(-500, 500).withColumnRenamed("id", "key")
    wanted = rows.filter(F.col("key") % 10 == 0)
    assert neardup._likely(rows, wanted, "key").count() < 150
    monkeypatch.setattr(neardup, "BITS", 128)
    few = neardup._likely(rows, wanted, "key")
    assert few.columns == ["key"]
    assert few.join(wanted, "key", "left_semi").count() == 100
    assert few.count() <= 1000

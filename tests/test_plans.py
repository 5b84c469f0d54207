"""Plan shape checks: what must hold at scale, read from the physical plan."""

import re

from glucoflow.operators import clean as C
from glucoflow.plans import devices as D

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_window_over_a_whole_person(spark):
    df = C.cgm(D.device_events(spark.read.parquet(f"{SF}/events.parquet"))).frame
    plan = _plan(df)
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[([^\]]*)\]", plan)
    assert windows, plan
    for part, order in windows:
        keys = [k.split("#")[0].strip() for k in part.split(",") if k.strip()]
        if "_block" not in keys:
            # only the small per-block summary is scanned per person
            assert keys == ["series_id"] and "_block" in order, (part, order)


def test_device_branch_pushes_filter_and_prunes(spark):
    df = C.bgm(D.device_events(spark.read.parquet(f"{SF}/events.parquet")), [("bgm_primary", "mmol/L")]).frame
    plan = _plan(df)
    scans = [l for l in plan.splitlines() if "FileScan parquet" in l]
    assert len(scans) == 1
    assert "EqualTo(event_type,click)" in scans[0]
    assert "props" not in scans[0].split("ReadSchema")[1]


def test_alignment_aggregates_once(spark):
    from glucoflow.operators import align as A
    from glucoflow.plans.queries import _processed

    al = A.align(_processed(spark, SF)).frame
    plan = _plan(al)
    # the other types meet in one union and one aggregation, then join the CGM
    # rows in another; the block summary reads the same exchange again
    assert plan.count("Union") == 4, plan


def test_time_rules_are_summed_up_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    from glucoflow.functions import timestamps as TS

    ev = spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("user_id").cast("string").alias("s"), "event_id", F.col("ts").cast("string").alias("t")
    )
    plan = _plan(TS.detect(ev, ["s"], "t", "event_id"))
    # all rules are partial aggregates: a hot person sends one row per map task
    assert "Window" not in plan and re.search(r"HashAggregate\(keys=\[s#\d+\], functions=\[partial_", plan), plan


def test_grid_is_emitted_once_and_never_exchanged(spark):
    from glucoflow.operators import align as A
    from glucoflow.plans.queries import _processed

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(A.align(_processed(spark, SF)).frame)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    above = plan[: plan.index("sequence(_from")]
    assert "Exchange" not in above and "Join" not in above, plan


def test_a_gap_of_fifty_years_is_emitted_in_stretches(spark):
    from glucoflow.operators.fill import wide_grid

    obs = spark.createDataFrame([("s", 0, 1.0), ("s", 5_259_600, 2.0)], "series_id string, slot long, v double")
    grid = wide_grid(obs, ["v"])
    assert grid.count() == 5_259_601 and grid.where("v is not null").count() == 2

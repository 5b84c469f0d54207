import datetime as dt

import pytest
from pyspark.sql import functions as F

from glucoflow.functions.timeslots import freq_to_micros, round_half_even, slot_of, slot_to_ts


def test_freq_parsing():
    assert freq_to_micros("5min") == 300_000_000
    assert freq_to_micros("15min") == 900_000_000
    assert freq_to_micros("1h") == 3_600_000_000
    assert freq_to_micros("1D") == 86_400_000_000
    with pytest.raises(ValueError):
        freq_to_micros("7min")  # does not divide a day
    with pytest.raises(ValueError):
        freq_to_micros("soon")


def test_round_half_to_even(spark):
    times = ["00:02:30", "00:07:30", "00:12:30", "00:02:29", "00:02:31", "23:57:30"]
    rows = [(dt.datetime(2024, 1, 1, *map(int, x.split(":"))),) for x in times]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    out = df.select(slot_to_ts(slot_of("ts", 300_000_000), 300_000_000).alias("s")).collect()
    got = [r["s"].strftime("%H:%M") for r in out]
    assert got == ["00:00", "00:10", "00:10", "00:00", "00:05", "00:00"]


def test_round_before_epoch(spark):
    df = spark.createDataFrame([(-450_000_000,), (-150_000_000,), (-149_999_999,)], "us bigint")
    out = [r[0] for r in df.select(round_half_even(F.col("us"), 300_000_000)).collect()]
    # -7:30 min -> -2 slots (even), -2:30 -> 0 (even), just after -> 0
    assert out == [-2, 0, 0]


def test_rounding_matches_pandas_on_random_instants(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    step_us = {"5min": 300_000_000, "15min": 900_000_000, "1h": 3_600_000_000}
    base = rng.integers(-10**15, 2 * 10**15, size=400)
    for freq, step in step_us.items():
        ties = (base // step) * step + step // 2  # exact halves
        us = np.concatenate([base, ties, ties + 1, ties - 1])
        df = spark.createDataFrame([(int(x),) for x in us], "us bigint")
        got = [r[0] for r in df.select(round_half_even(F.col("us"), step) * F.lit(step)).collect()]
        exp = (pd.to_datetime(us, unit="us").round(freq).asi8 // 1000).tolist()
        assert got == exp, freq

"""Small in-code fixtures (see FIXTURES.md)."""

from __future__ import annotations

import datetime as dt

from glucoflow.operators.clean import Processed


def t(hhmm: str, day: str = "2024-01-01") -> dt.datetime:
    parts = [int(x) for x in hhmm.split(":")]
    h, m = parts[0], parts[1]
    s = parts[2] if len(parts) > 2 else 0
    y, mo, d = (int(x) for x in day.split("-"))
    return dt.datetime(y, mo, d, h, m, s)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def cgm_reference(spark, series="p1", values=None, start="00:00", n=13):
    values = values or [100, 110, 105, 115, 120, 110, 105, 115, 120, 110, 105, 115, 120]
    base = t(start)
    rows = [
        (series, base + dt.timedelta(minutes=5 * i), float(v), float(v) * 0.0555, False)
        for i, v in enumerate(values[:n])
    ]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, cgm_primary double, cgm_primary_mmol double, missing boolean")
    return Processed("CGM", df, {"cgm_primary": "mg/dL", "cgm_primary_mmol": "mmol/L"}, [], ["cgm_primary"])


def bgm(spark, items, series="p1"):
    rows = [(series, t(h), float(v), bool(c), float(m)) for h, v, c, m in items]
    df = spark.createDataFrame(
        rows, "series_id string, ts timestamp_ntz, bgm_primary double, bgm_primary_clipped boolean, bgm_primary_mmol double"
    )
    return Processed("BGM", df, {}, [], ["bgm_primary"])


def insulin(spark, items, series="p1"):
    rows = [(series, t(h), float(d), bool(b), bool(s), ty) for h, d, b, s, ty in items]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, dose double, is_bolus boolean, is_basal boolean, type string")
    return Processed("INSULIN", df, {"dose": "U"}, [], ["dose"])


def carbs(spark, items, series="p1"):
    rows = [(series, t(h), float(v)) for h, v in items]
    return Processed("CARBS", spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, carbs_primary double"), {}, [], ["carbs_primary"])


def notes(spark, items, series="p1"):
    rows = [(series, t(h), n, i) for i, (h, n) in enumerate(items)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, notes_primary string, _seq bigint")
    return Processed("NOTES", df, {}, [], ["notes_primary"])


def long_events(spark, rows):
    """rows: (series, ts, seq, data_type, column_name, is_primary, unit, value, text)"""
    return spark.createDataFrame(
        [(*r, "t") for r in rows],
        "series_id string, ts timestamp_ntz, _seq bigint, data_type string, column_name string, is_primary boolean, "
        "unit string, value double, text string, source_table string",
    )


def by_time(df, col, series="p1"):
    return {r["ts"]: r[col] for r in df.where(f"series_id = '{series}'").select("ts", col).collect()}

import datetime as dt

import pytest

from glucoflow.operators import clean as C
from helpers import long_events

T0 = dt.datetime(2024, 1, 1)


def at(m):
    return T0 + dt.timedelta(minutes=m)


def test_bgm_filter_convert_clip_last(spark):
    rows = [
        ("p", at(0), 0, "BGM", "bgm_primary", True, "mmol/L", 5.0, None),
        ("p", at(0), 1, "BGM", "bgm_primary", True, "mmol/L", 30.0, None),  # last at this time wins
        ("p", at(5), 2, "BGM", "bgm_primary", True, "mmol/L", 0.0, None),  # removed
        ("p", at(9), 3, "BGM", "bgm_primary", True, "mmol/L", 1.0, None),  # clipped low
        ("p", at(9), 4, "BGM", "bgm_primary", True, "mmol/L", None, None),
    ]
    out = C.bgm(long_events(spark, rows), [("bgm_primary", "mmol/L")]).frame.orderBy("ts").toPandas()
    assert len(out) == 2
    assert out.bgm_primary[0] == 360.36 and bool(out.bgm_primary_clipped[0])
    assert out.bgm_primary[1] == 39.64 and bool(out.bgm_primary_clipped[1])
    assert out.bgm_primary_mmol[1] == pytest.approx(39.64 * 0.0555)


def test_bgm_stats_single_reading_rate_null(spark):
    rows = [("p", at(0), 0, "BGM", "bgm_primary", True, "mg/dL", 100.0, None)]
    s = C.bgm_stats(long_events(spark, rows)).collect()[0]
    assert s["readings"] == 1 and s["readings_per_day"] is None


def test_insulin_size_classes_and_metadata(spark):
    rows = [
        ("p", at(0), 0, "INSULIN", "dose", True, "U", 5.0, None),
        ("p", at(5), 1, "INSULIN", "dose", True, "U", 10.0, None),
        ("p", at(10), 2, "INSULIN", "dose", True, "U", 20.0, None),  # above max: both false, kept
        ("p", at(15), 3, "INSULIN", "dose", True, "U", -1.0, None),  # dropped
        ("p", at(20), 4, "INSULIN", "dose", True, "U", 12.0, None),
        ("p", at(20), 5, "INSULIN_META", "m", True, None, None, '[{"insulin": "NovoRapid"}]'),
        ("p", at(0), 6, "INSULIN_META", "m", True, None, None, '[{"insulin": "Levemir 100"}]'),
        ("p", at(0), 7, "INSULIN_META", "m", True, None, None, "not json"),
        ("p", at(5), 8, "INSULIN_META", "m", True, None, None, None),  # null metadata: no update
        ("p", at(10), 9, "INSULIN_META", "m", True, None, None, '{"insulin": "novorapid"}'),  # not a list
    ]
    out = C.insulin(long_events(spark, rows)).frame.orderBy("ts").toPandas()
    assert list(out.dose) == [5.0, 10.0, 20.0, 12.0]
    assert list(out.is_bolus) == [False, False, False, True]
    assert list(out.is_basal) == [True, True, False, False]
    assert list(out.type) == ["levemir", "", "", "novorapid"]
    st = C.insulin_stats(long_events(spark, rows)).collect()[0]
    # classes by size, before metadata moved two of the doses
    assert (st["doses"], st["bolus"], st["basal"]) == (4, 1, 2)
    assert st["count_over_max"] == 1 and st["meta_updates"] == 2


def test_carbs_threshold_first_per_time(spark):
    rows = [
        ("p", at(0), 0, "CARBS", "carbs_primary", True, "g", 0.5, None),
        ("p", at(0), 1, "CARBS", "carbs_primary", True, "g", 30.0, None),
        ("p", at(0), 2, "CARBS", "carbs_primary", True, "g", 40.0, None),
        ("p", at(5), 3, "CARBS", "carbs_primary", True, "g", 1.0, None),
        ("p", at(9), 4, "CARBS", "carbs_primary", True, "g", None, None),
    ]
    out = C.carbs(long_events(spark, rows)).frame.orderBy("ts").toPandas()
    assert list(out.carbs_primary) == [30.0, 1.0]


def test_notes_strip_and_drop_empty(spark):
    rows = [
        ("p", at(0), 0, "NOTES", "notes_primary", True, None, None, "\t breakfast \n"),
        ("p", at(1), 1, "NOTES", "notes_primary", True, None, None, "   "),
        ("p", at(2), 2, "NOTES", "notes_primary", True, None, None, " feeling low　"),
        ("p", at(2), 3, "NOTES", "notes_primary", True, None, None, "again"),
    ]
    out = C.notes(long_events(spark, rows)).frame.orderBy("_seq").toPandas()
    assert list(out.notes_primary) == ["breakfast", "feeling low", "again"]


def test_data_notes_text(spark):
    from glucoflow.operators.quality import data_notes

    rows = [
        ("p", at(0), 0, "CGM", "cgm_primary", True, "mg/dL", 100.0, None),
        ("p", at(10), 1, "CGM", "cgm_primary", True, "mg/dL", 120.0, None),
        ("p", at(0), 2, "INSULIN", "dose", True, "U", 5.0, None),
        ("p", at(5), 3, "INSULIN", "dose", True, "U", 20.0, None),
        ("p", at(0), 4, "CARBS", "carbs_primary", True, "g", 0.5, None),
        ("p", at(5), 5, "CARBS", "carbs_primary", True, "g", 30.0, None),
    ]
    ev = long_events(spark, rows)
    p = {"CGM": C.cgm(ev), "INSULIN": C.insulin(ev), "CARBS": C.carbs(ev)}
    notes = {r["data_type"]: r["notes"] for r in data_notes(ev, p).collect()}
    assert notes["CGM"][0] == "Processed 3 total CGM readings"
    assert notes["CGM"][1] == "Found 1 missing or interpolated values in primary data"
    assert notes["CGM"][3] == "Initial CGM dataset completeness: 66.67%"
    assert notes["INSULIN"][1] == "- 1 doses classified as bolus (≤8.0U)"
    assert notes["INSULIN"][3] == "- Dropped 1 doses exceeding 15.0U"
    assert notes["CARBS"][0] == "Column carbs_primary: Kept 1 entries ≥1g (50.0%)"

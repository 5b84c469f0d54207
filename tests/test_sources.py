import datetime as dt
import os
import sqlite3

import pytest

from glucoflow.functions import timestamps as TS
from glucoflow.sources import catalog as K
from glucoflow.sources import readers as R


def test_detect_formats(spark):
    rows = []
    samples = {
        "sec": ["1704067207", "1704067500"],
        "ms": ["1704067207123", "1704067500000"],
        "iso": ["2024-01-01T00:00:07Z", "2024-01-01T00:05:00Z"],
        "dayfirst": ["30-05-2023 14:12", "01-06-2023 09:05"],
        "us": ["05/30/2023 14:12", "06/01/2023 09:05"],
        "ampm": ["30-05-2023 02:12 PM", "01-06-2023 09:05 AM"],
        "junk": ["hello", "world"],
    }
    for k, vals in samples.items():
        for i, v in enumerate(vals):
            rows.append((k, i, v))
    df = spark.createDataFrame(rows, "k string, seq bigint, v string")
    det = {r["k"]: (r["ts_type"], r["pattern"]) for r in TS.detect(df, ["k"], "v", "seq").collect()}
    assert det["sec"][0] == "unix_seconds"
    assert det["ms"][0] == "unix_milliseconds"
    assert det["iso"][0] == "iso8601"
    assert det["dayfirst"] == ("iso8601", "d-M-yyyy H:m")
    assert det["us"] == ("iso8601", "M/d/yyyy H:m")
    assert det["junk"][0] == "unknown"
    conv = {(r["k"], r["seq"]): r["ts"] for r in TS.convert(df, TS.detect(df, ["k"], "v", "seq"), ["k"], "v").collect()}
    assert conv[("sec", 0)] == dt.datetime(2024, 1, 1, 0, 0, 7)
    assert conv[("ms", 0)] == dt.datetime(2024, 1, 1, 0, 0, 7, 123000)
    assert conv[("iso", 1)] == dt.datetime(2024, 1, 1, 0, 5)
    assert conv[("dayfirst", 0)] == dt.datetime(2023, 5, 30, 14, 12)
    assert conv[("us", 1)] == dt.datetime(2023, 6, 1, 9, 5)
    assert conv[("ampm", 0)] == dt.datetime(2023, 5, 30, 14, 12)
    assert conv[("junk", 0)] is None


def _write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_csv_header_row_column_order_and_optional(spark, tmp_path):
    table = K.Table(
        "",
        "Time",
        (
            K.Column("Glucose", "CGM", "mg/dL"),
            K.Column("Note", "NOTES", None, K.OPTIONAL),
        ),
        header_row=None,  # search the first rows
    )
    _write(tmp_path / "a.csv", 'Export,x\nTime,Glucose,Note\n2024-01-01 00:00,100,"hi, there"\n2024-01-01 00:05,110,\n')
    _write(tmp_path / "b.csv", ' glucose ,TIME\n120,2024-01-01 00:10\n')  # other order, no Note, other case
    df = R.read_csv_table(spark, [str(tmp_path / "*.csv")], table)
    conv = R.convert_times(df, table).orderBy("series_id", "_seq").select("series_id", "ts", "Glucose", "Note").collect()
    assert [(r["series_id"], r["Glucose"], r["Note"]) for r in conv] == [("a", "100", "hi, there"), ("a", "110", None), ("b", "120", None)]
    assert conv[2]["ts"] == dt.datetime(2024, 1, 1, 0, 10)


def test_sqlite_missing_column_is_null(spark, tmp_path):
    p = str(tmp_path / "x.sqlite")
    con = sqlite3.connect(p)
    con.execute("CREATE TABLE BgReadings (timestamp INTEGER, calculated_value REAL)")
    con.executemany("INSERT INTO BgReadings VALUES (?, ?)", [(1704067200000, 100.0), (1704067500000, 110.0)])
    con.commit()
    con.close()
    tb = K.TWO_TABLE_SQLITE.files[0].tables[0]
    rows = R.read_sqlite_table(spark, [p], tb).orderBy("_seq").collect()
    assert [r["calculated_value"] for r in rows] == ["100.0", "110.0"]
    assert all(r["raw_data"] is None for r in rows)  # never the column name as text
    with pytest.raises(Exception):
        bad = K.Table("Bg;Drop", "timestamp", (K.Column("a", "CGM", "mg/dL"),))
        R.read_sqlite_table(spark, [p], bad).collect()


def test_events_from_wide_csv_layout(spark, tmp_path):
    header = ["Device", "Serial Number", "Device Timestamp", "Historic Glucose mmol/L", "Scan Glucose mmol/L",
              "Strip Glucose mmol/L", "Rapid-Acting Insulin (units)", "Long-Acting Insulin Value (units)",
              "Carbohydrates (grams)", "Notes"]
    lines = ["Glucose Data,Generated on,01-01-2024", ",".join(header),
             "L,1,01-01-2024 00:00,5.0,,,,,,",
             "L,1,01-01-2024 00:05,,6.0,,2,,,",
             "L,1,01-01-2024 00:10,,,7.0,,12,30,lunch"]
    _write(tmp_path / "person.csv", "\n".join(lines) + "\n")
    specs = R.layout_specs(K.WIDE_CSV)
    (tb, df), = R.read_tables(spark, K.WIDE_CSV, [str(tmp_path / "person.csv")]).values()
    long, bad = R.to_events(df, tb, specs)
    got = {(r["column_name"], r["ts"].minute): (r["value"], r["text"]) for r in long.collect()}
    assert got[("cgm_primary", 0)][0] == 5.0
    assert got[("cgm_2", 5)][0] == 6.0
    assert ("cgm_primary", 10) in got and got[("cgm_primary", 10)][0] is None  # span row kept
    assert got[("bgm_primary", 10)][0] == 7.0
    assert got[("insulin_primary", 5)][0] == 2.0
    assert got[("insulin_2", 10)][0] == 12.0
    assert got[("notes_primary", 10)][1] == "lunch"
    assert bad.count() == 0


def test_conformance_classifies_folder(spark, tmp_path):
    from glucoflow.sources import conform

    header = "Device,Serial Number,Device Timestamp,Historic Glucose mmol/L,Scan Glucose mmol/L,Strip Glucose mmol/L,Rapid-Acting Insulin (units),Long-Acting Insulin Value (units),Carbohydrates (grams),Notes"
    _write(tmp_path / "ok.csv", "pre\n" + header + "\nL,1,01-01-2024 00:00,5,,,,,,\n")
    _write(tmp_path / "bad.csv", "pre\nDevice,Device Timestamp\nL,01-01-2024 00:00\n")
    con = sqlite3.connect(str(tmp_path / "x.sqlite"))
    con.execute("CREATE TABLE BgReadings (timestamp, calculated_value, raw_data)")
    con.commit()
    con.close()
    res = {os.path.basename(r["path"]): r for r in conform.classify(spark, str(tmp_path)).collect()}
    assert res["ok.csv"]["layout"] == "libreview_csv"
    assert res["bad.csv"]["layout"] is None
    assert "Missing required columns" in res["bad.csv"]["failed_candidates"][0]
    assert res["x.sqlite"]["layout"] is None
    assert "Missing tables: Treatments" in res["x.sqlite"]["failed_candidates"][0]


def test_multi_file_layout_folder_verdict(spark, tmp_path):
    from glucoflow.sources import conform

    two = K.Layout(
        "two_files",
        (
            K.FileConfig("glucose.csv", "csv", (K.Table("", "Time", (K.Column("Glucose", "CGM", "mg/dL"),)),)),
            K.FileConfig("insulin.csv", "csv", (K.Table("", "Time", (K.Column("Dose", "INSULIN", "U"), K.Column("Type", None, None, K.OPTIONAL))),)),
        ),
    )
    cat = K.Catalog()
    cat.register(two)
    full, half = tmp_path / "full", tmp_path / "half"
    full.mkdir()
    half.mkdir()
    _write(full / "glucose.csv", "Time,Glucose\n2024-01-01 00:00,100\n")
    _write(full / "insulin.csv", "Time,Dose,Type\n2024-01-01 00:00,4,rapid\n")
    _write(half / "glucose.csv", "Time,Glucose\n2024-01-01 00:00,100\n")
    res = conform.classify(spark, str(tmp_path), cat)
    assert res.where("layout = 'two_files'").count() == 3  # each file matches its own config
    v = {os.path.basename(r["folder"]): r["complete"] for r in conform.folder_verdicts(res, cat).collect()}
    assert v == {"full": True, "half": False}


def test_csv_split_file_keeps_header(spark, tmp_path):
    table = K.Table("", "Time", (K.Column("Glucose", "CGM", "mg/dL"),), header_row=1, quoted_newlines=False)
    lines = ["Export of glucose", "Time,Glucose"] + [f"2024-01-01 {i // 60:02d}:{i % 60:02d},{100 + i % 50}" for i in range(1200)]
    _write(tmp_path / "big.csv", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        # the file really is read as several splits
        assert spark.read.option("multiLine", False).csv(str(tmp_path / "big.csv")).rdd.getNumPartitions() > 1
        df = R.read_csv_table(spark, [str(tmp_path / "big.csv")], table)
        rows = df.orderBy("_seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 1200
    assert rows[0]["Time"] == "2024-01-01 00:00" and rows[-1]["Glucose"] == str(100 + 1199 % 50)


def test_json_and_xml_structure_checks(spark, tmp_path):
    from glucoflow.sources import conform

    cat = K.Catalog()
    cat.register(K.EXAMPLE_JSON)
    cat.register(K.EXAMPLE_XML)
    _write(tmp_path / "a.json", '{"readings": [{"time": "2024-01-01T00:00:00Z", "glucose": 100, "meter": null, "dose": 1, "carbs": 2}]}')
    _write(tmp_path / "b.json", '[{"time": "2024-01-01T00:00:00Z", "glucose": 100}]')  # list: misses fields
    _write(tmp_path / "e.json", '[{"Time": "2024-01-01T00:00:00Z", "glucose": 1, "meter": 2, "dose": 3, "carbs": 4}]')
    _write(tmp_path / "c.xml", '<export><reading time="2024-01-01T00:00:00Z"><glucose>100</glucose><meter></meter></reading></export>')
    _write(tmp_path / "d.xml", '<export><reading time="2024-01-01T00:00:00Z"><glucose>100</glucose></reading></export>')
    res = {os.path.basename(r["path"]): r for r in conform.classify(spark, str(tmp_path), cat).collect()}
    assert res["a.json"]["layout"] == "example_json"
    assert res["b.json"]["layout"] is None
    assert "Missing required columns in readings: carbs, dose, meter" in res["b.json"]["failed_candidates"][0]
    assert res["e.json"]["layout"] == "example_json"  # a list serves the table; keys compared lower-cased
    assert res["c.xml"]["layout"] == "example_xml"
    assert res["d.xml"]["layout"] is None and "meter" in res["d.xml"]["failed_candidates"][0]


def test_csv_shorter_than_declared_header_row_fails(spark, tmp_path):
    from glucoflow.sources import conform

    header = "Device,Serial Number,Device Timestamp,Historic Glucose mmol/L,Scan Glucose mmol/L,Strip Glucose mmol/L,Rapid-Acting Insulin (units),Long-Acting Insulin Value (units),Carbohydrates (grams),Notes"
    _write(tmp_path / "short.csv", header + "\n")  # header on row 0, layout declares row 1
    res = conform.classify(spark, str(tmp_path)).collect()
    assert res[0]["layout"] is None


def test_sqlite_large_file_split_by_rowid(spark, tmp_path):
    p = str(tmp_path / "big.sqlite")
    con = sqlite3.connect(p)
    con.execute("CREATE TABLE BgReadings (timestamp INTEGER, calculated_value REAL, raw_data REAL)")
    con.executemany("INSERT INTO BgReadings VALUES (?, ?, ?)", [(1704067200000 + i * 300000, 100.0 + i % 7, i) for i in range(2500)])
    con.commit()
    con.close()
    tb = K.TWO_TABLE_SQLITE.files[0].tables[0]
    df = R.read_sqlite_table(spark, [p], tb, partition_bytes=-(-os.path.getsize(p) // 7))
    assert df.rdd.getNumPartitions() == 7
    rows = df.orderBy("_seq").collect()
    assert len(rows) == 2500 and [r["_seq"] for r in rows] == list(range(1, 2501))
    assert rows[-1]["raw_data"] == "2499.0"

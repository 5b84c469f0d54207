"""Inputs that used to lose or invent data without a word."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from glucoflow.functions import numbers as N
from glucoflow.functions import timestamps as TS
from glucoflow.operators.clean import bgm
from glucoflow.sources import catalog as K
from glucoflow.sources import conform
from glucoflow.sources import readers as R

TABLE = K.Table("", "Time", (K.Column("Glucose", "CGM", "mg/dL"), K.Column("Note", "NOTES", None, K.OPTIONAL)))


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("header_row", [None, 0])
def test_csv_of_many_columns(spark, tmp_path, header_row):
    names = [f"x{i}" for i in range(200)] + ["Time", "Glucose"]
    write(tmp_path / "a.csv", ",".join(names) + "\n" + ",".join(["1"] * 200) + ",2024-01-01 00:00,100\n")
    table = K.Table("", "Time", TABLE.columns, header_row=header_row)
    got = R.read_csv_table(spark, [str(tmp_path)], table).collect()
    assert [(r["Time"], r["Glucose"], r["Note"]) for r in got] == [("2024-01-01 00:00", "100", None)]


def test_csv_without_its_header_is_listed(spark, tmp_path):
    write(tmp_path / "late.csv", "a\nb\nc\nd\ne\nTime,Glucose\n2024-01-01 00:00,1\n")
    write(tmp_path / "none.csv", "When,Value\n2024-01-01 00:00,1\n")
    write(tmp_path / "good.csv", "Time,Glucose,Note\n2024-01-01 00:00,1,N/A\n")
    got = R.read_csv_table(spark, [str(tmp_path)], TABLE).collect()
    assert [(r["Glucose"], r["Note"]) for r in got] == [("1", None)]
    bad = {r["_file"].rsplit("/", 1)[1]: r["reason"] for r in R.rejected_csv_files(spark, [str(tmp_path)], TABLE).collect()}
    assert set(bad) == {"late.csv", "none.csv"} and "row 5" in bad["late.csv"]
    assert R.read_csv_table(spark, [str(tmp_path)], TABLE, search_rows=10).count() == 2


def test_csv_reads_its_body_in_one_scan_and_one_join(spark, tmp_path):
    write(tmp_path / "a.csv", "Time,Glucose\n2024-01-01 00:00,1\n")
    plan = R.read_csv_table(spark, [str(tmp_path)], TABLE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Relation [") == 2


def test_numbers(spark):
    words = ["NaN", "nan", "inf", "-Infinity", "1d", "N/A", "", None, " 4.50 ", "-1e3", ".5", "7."]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = [r[0] for r in df.orderBy("i").select(N.to_number(F.col("w"))).collect()]
    assert got == [None] * 8 + [4.5, -1000.0, 0.5, 7.0]


def test_nan_is_no_meter_reading(spark):
    rows = [("s", 1, float("nan")), ("s", 2, float("inf")), ("s", 3, 100.0)]
    events = spark.createDataFrame(rows, "series_id string, _seq long, value double").selectExpr(
        "series_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(_seq as int)) as ts", "_seq", "'BGM' as data_type", "'bgm_primary' as column_name", "'mg/dL' as unit", "value"
    )
    assert [r["bgm_primary"] for r in bgm(events).frame.collect()] == [100.0]


@pytest.mark.parametrize("sample", [None, 50])
def test_mixed_formats_and_offsets(spark, sample):
    rows = [("mixed", i, f"{i % 27 + 1:02d}-01-2024 10:00" if i < 50 else f"2024-01-{i % 27 + 1:02d} 10:00:00") for i in range(100)]
    rows += [("offset", i, f"2024-01-01T0{i}:00:00+0000") for i in range(5)]
    rows += [("fraction", i, f"2024-01-01T0{i}:00:00.5Z") for i in range(5)]
    df = spark.createDataFrame(rows, "k string, seq long, v string")
    conv = TS.convert(df, TS.detect(df, ["k"], "v", "seq", sample), ["k"], "v")
    left = {r["k"]: r["n"] for r in conv.groupBy("k").agg(F.count_if(F.col("ts").isNull()).alias("n")).collect()}
    assert left == {"mixed": 0, "offset": 0, "fraction": 0}


@pytest.mark.parametrize("partition_bytes", [2000, 64 << 20])
def test_sqlite_splits(spark, tmp_path, partition_bytes):
    table = K.Table("Readings", "t", (K.Column("v", "CGM", "mg/dL"),))
    for name, ddl in (("sparse", "CREATE TABLE Readings (t, v)"), ("norowid", "CREATE TABLE Readings (t PRIMARY KEY, v) WITHOUT ROWID"), ("other", "CREATE TABLE Other (t, v)")):
        con = sqlite3.connect(tmp_path / f"{name}.sqlite")
        con.execute(ddl)
        if name == "sparse":
            con.executemany("INSERT INTO Readings (rowid, t, v) VALUES (?, ?, ?)", [(1, 1, 5), (2, 2, 6), (2**40, 3, 7)])
        elif name == "norowid":
            con.executemany("INSERT INTO Readings VALUES (?, ?)", [(1, 8), (2, 9)])
        con.commit()
        con.close()
    paths = sorted(str(p) for p in tmp_path.glob("*.sqlite"))
    df = R.read_sqlite_table(spark, paths, table, partition_bytes=partition_bytes)
    assert sorted(r["v"] for r in df.collect()) == ["5", "6", "7", "8", "9"]
    assert df.rdd.getNumPartitions() == (1 if partition_bytes > 2000 else sum(-(-p.stat().st_size // 2000) for p in tmp_path.glob('*.sqlite')))


def test_json_with_a_single_record(spark, tmp_path):
    table = K.EXAMPLE_JSON.files[0].tables[0]
    path = write(tmp_path / "a.json", '{"readings": {"time": "2024-01-01T00:00:00Z", "glucose": 5}}')
    assert [r["glucose"] for r in R.read_json_table(spark, [path], table).collect()] == ["5"]


def test_every_file_has_a_verdict(spark, tmp_path):
    (tmp_path / "broken.sqlite").write_bytes(b"SQLite format 3\0" + b"x" * 200)
    write(tmp_path / "broken.xml", "<a><reading time='1'>")
    write(tmp_path / "broken.json", "{")
    write(tmp_path / "readme.txt", "hello")
    cols = [c.source_name for c in K.WIDE_CSV.files[0].tables[0].columns]
    write(tmp_path / "good.csv", "preamble\n" + ",".join(["Device Timestamp", *cols]) + "\n")
    catalog = K.default_catalog()
    catalog.register(K.EXAMPLE_JSON)
    catalog.register(K.EXAMPLE_XML)
    got = {r["path"].rsplit("/", 1)[1]: (r["layout"], " ".join(r["failed_candidates"])) for r in conform.classify(spark, str(tmp_path), catalog).collect()}
    assert got["good.csv"][0] == "libreview_csv"
    assert all(got[f"broken.{x}"][0] is None and "can't be read" in got[f"broken.{x}"][1] for x in ("sqlite", "xml", "json"))
    assert got["readme.txt"] == (None, "no layout describes such a file")
    with pytest.raises(conform.ConformanceError):
        conform.detect_layout(spark, [str(tmp_path)], catalog)


def test_people_of_the_same_file_name(spark, tmp_path):
    for p in ("p1", "p2"):
        (tmp_path / p).mkdir()
        write(tmp_path / p / "export.csv", "Time,Glucose\n2024-01-01 00:00,1\n")
    df = R.read_csv_table(spark, [str(tmp_path / p) for p in ("p1", "p2")], TABLE)
    keyed = df.select(R.series_from_path(F.col("_file")).alias("k"))
    assert sorted(r["k"] for r in keyed.collect()) == ["p1/export", "p2/export"]

"""Files of the same table in different shapes: CSV headers with line breaks, JSON documents, XML elements."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from glucoflow.sources import readers as R
from glucoflow.sources.catalog import OPTIONAL, REQUIRED_NULLABLE, Column, Table

LONG = Table("csv", "time", (Column("glucose", "CGM", "mg/dL"), Column("note\nlong", "NOTES", requirement=REQUIRED_NULLABLE), Column("a,b", "CARBS", "g", requirement=OPTIONAL)))
TABLE = Table("readings", "time", (Column("glucose", "CGM", "mg/dL"), Column("note", "NOTES", requirement=REQUIRED_NULLABLE)))


def name_of(row):
    return row["_file"].rsplit("/", 1)[1]


def put(folder, files):
    for name, text in files.items():
        (folder / name).write_bytes(text.encode())
    return [str(folder)]


CSV = {
    "alone.csv": 'time,"note\nlong",glucose\n1,"x\ny",5\n2,,6\n',
    "behind.csv": 'Glucose Data,x\n"A,B",Time,"Note\nLong", GLUCOSE \n7,1,"say ""hi"", you",5\n',
    "wide.csv": ",".join(f"f{k}" for k in range(300)) + ',"q""q",time,glucose,"note\nlong"\n' + "," * 300 + ",9,8,7\n",
    "dos.csv": 'glucose,"Note\nlong",time\r\n5,"p\r\nq",6\r\n7,,8\r\n',
    "only_text.csv": "time,note long,glucose\n1,2,3\n",
    "comment.csv": 'this file has time glucose "note\nlong"\nglucose,time,"note\nlong"\n4,3,\n',
}


def test_header_with_a_quoted_line_break(spark, tmp_path):
    """Alone, behind a preamble, at field 300, and below a record that only mentions the names."""
    paths = put(tmp_path, CSV)
    got = {(name_of(r), r["time"], r["note\nlong"], r["glucose"], r["a,b"]) for r in R.read_csv_table(spark, paths, LONG).collect()}
    assert got == {
        ("alone.csv", "1", "x\ny", "5", None), ("alone.csv", "2", None, "6", None),
        ("behind.csv", "1", 'say "hi", you', "5", "7"), ("wide.csv", "9", "7", "8", None), ("comment.csv", "3", None, "4", None),
        ("dos.csv", "6", "p\r\nq", "5", None), ("dos.csv", "8", None, "7", None),
    }
    bad = {name_of(r): r["reason"] for r in R.rejected_csv_files(spark, paths, LONG).collect()}
    assert bad == {"only_text.csv": "no row names all required columns"}


def test_one_scan_of_the_rows_without_a_shuffle(spark, tmp_path):
    """Only fields that a header asks for are parsed, and the rows stay where they were read."""
    df = R.read_csv_table(spark, put(tmp_path, CSV), LONG)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "BroadcastHashJoin" in plan
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    fields = plan.split("ReadSchema: ")[1].split(">")[0]
    assert fields.count("_c") == 7  # of 304


def test_many_files_are_joined_without_a_broadcast_of_ours(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_FILES", 2)
    monkeypatch.setattr(R, "FEW_POSITIONS", 1)
    assert R.read_csv_table(spark, put(tmp_path, CSV), LONG).count() == 7


def test_fields_of_a_record(spark):
    records = ["a,b", '"a,b",c', ' "x""y" ,', "", '""', '"p\nq", r ', '"a"",""b"']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in records], "r string").select(R.fields_of(F.col("r"))).collect()]
    assert got == [["a", "b"], ["a,b", "c"], ['x"y', ""], [""], [""], ["p\nq", "r"], ['a","b']]


JSON = {
    "object.json": '{"Readings": [{"time": 1, "glucose": 1.50}, {"TIME": "2", "glucose": null, "more": {"x": [1]}}], "meta": 3}',
    "single.json": '{"readings": {"time": 3, "glucose": 4, "note": "007"}}',
    "list.json": '[{"time": 5, "glucose": true}, {"glucose": 6, "time": 6}]',
    "record.json": '{\n  "time": 7,\n  "glucose": 8\n}\n',
    "lines.json": '{"time": 9, "glucose": 10}\r\n\n{"time": 11, "glucose": 12, "note": "a\\nb"}\n',
    "none.json": '{"readings": []}',
    "null.json": '{"readings": null}',
    "blank.json": " \n\t\n",
    "cut.json": '{"readings": [{"time": 1',
    "other.json": '{"other": [{"time": 1}]}',
    "badline.json": '{"time": 1}\n{"time": \n',
}


def test_json_of_all_shapes_in_one_folder(spark, tmp_path):
    paths = put(tmp_path, JSON)
    df = R.read_json_table(spark, paths, TABLE)
    got = {(name_of(r), r["_seq"], r["time"], r["glucose"], r["note"]) for r in df.collect() if name_of(r) != "other.json"}
    assert got == {
        ("object.json", 0, "1", "1.5", None), ("object.json", 1, "2", None, None), ("single.json", 0, "3", "4", "007"),
        ("list.json", 0, "5", "true", None), ("list.json", 1, "6", "6", None), ("record.json", 0, "7", "8", None),
        ("lines.json", 0, "9", "10", None), ("lines.json", 1, "11", "12", "a\nb"),
    }
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    bad = {name_of(r): r["reason"] for r in R.rejected_json_files(spark, paths, TABLE).collect()}
    assert bad == {"blank.json": "the file is empty", "cut.json": "the file isn't JSON", "badline.json": "the file isn't JSON", "other.json": "no record has time"}


def test_large_json_takes_time_in_proportion(spark, tmp_path):
    """A file of 150,000 records: the records are not copied with each of them."""
    n = 150_000
    (tmp_path / "big.json").write_text(json.dumps({"readings": [{"time": k, "glucose": k % 400, "note": "x" * 20} for k in range(n)]}))
    start = time.time()
    row = R.read_json_table(spark, [str(tmp_path)], TABLE).agg(F.count("*"), F.sum(F.col("time").cast("long"))).first()
    assert tuple(row) == (n, n * (n - 1) // 2) and time.time() - start < 60


XML = {
    "attributes.xml": '<r><readings time="1" glucose="5"/><readings time="2" glucose=" " note="n"/></r>',
    "children.xml": '<r x="1"><readings><time>3</time><glucose unit="mg/dL">6</glucose><more><time>0</time></more></readings></r>',
    "both.xml": '<r>\n<readings time="4"><time>9</time><glucose/><note>a &amp; b</note></readings>\n<other time="0"/></r>',
    "none.xml": "<r/>",
}


def test_xml_by_the_columns_of_the_layout(spark, tmp_path):
    df = R.read_xml_table(spark, put(tmp_path, XML), TABLE)
    got = {(name_of(r), r["time"], r["glucose"], r["note"]) for r in df.collect()}
    assert got == {("attributes.xml", "1", "5", None), ("attributes.xml", "2", None, "n"), ("children.xml", "3", "6", None), ("both.xml", "4", None, "a & b")}


@pytest.mark.parametrize("reader", [R.read_xml_table, R.read_json_table])
def test_no_job_runs_before_the_read(spark, tmp_path, reader):
    """Nothing is inferred: the plan is made without a pass over the files."""
    (tmp_path / "x.json").write_text("not looked at")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    spark.sparkContext.setJobGroup("reading", "no job expected")
    try:
        reader(spark, [str(tmp_path)], TABLE)
        assert not tracker.getJobIdsForGroup("reading")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert before >= 0 and os.listdir(tmp_path) == ["x.json"]


def test_reader_of_ones_own(spark, tmp_path, monkeypatch):
    """A registered function reads its file type; an unknown type says what there is."""
    monkeypatch.setattr(R, "READERS", dict(R.READERS))

    @R.register_reader("tab")
    def read(spark, paths, table):
        return R.read_json_table(spark, paths, table)

    assert R.reader_of("tab") is read
    with pytest.raises(ValueError, match="No reader for 'xls' files; there are csv, json, sqlite, tab, xml"):
        R.reader_of("xls")


def test_structure_of_a_large_xml_file(tmp_path):
    """Finished elements leave memory: 200,000 records take a few MB."""
    import tracemalloc

    from glucoflow.sources import conform

    path = tmp_path / "large.xml"
    with open(path, "w") as fh:
        fh.write('<r v="1"><meta><a/></meta>')
        for k in range(200_000):
            fh.write(f'<reading time="{k}"><glucose>1</glucose><note>n</note></reading>')
        fh.write("</r>")
    tracemalloc.start()
    rows = conform._structure_of(str(path))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {r[2]: r[4] for r in rows} == {"meta": ["a"], "reading": ["time", "glucose", "note"], "r": ["v", "meta", "reading"]}
    assert peak < 5_000_000


def test_json_is_parsed_once(spark, tmp_path):
    """No filter repeats the parse before the records are emitted, and no step parses a text again."""
    plan = R.read_json_table(spark, put(tmp_path, JSON), TABLE)._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    # the first of several lines, each line, and a single record and a list of records at two depths
    assert plan.count("from_json(") == 6


def test_times_read_the_files_once(spark, tmp_path):
    """Detecting and converting the times share what was read, under columns of any name."""
    for reader, table, files in ((R.read_csv_table, LONG, CSV), (R.read_json_table, TABLE, JSON)):
        folder = tmp_path / table.name
        folder.mkdir()
        rows = reader(spark, put(folder, files), table)
        done = R.convert_times(rows, table)
        assert {*done.columns} == {*rows.columns, "series_id", "ts_type", "pattern", "ts"} and done.count() == rows.count()
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert "FileScan csv" not in plan and "FileScan text" not in plan

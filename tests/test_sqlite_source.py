"""The SQLite source: time ranges, files packed by bytes, Arrow batches."""

import os
import sqlite3

import pytest

from glucoflow.sources import readers as R
from glucoflow.sources.catalog import Column, Table
from glucoflow.sources.sqlite_source import OPEN_COST, Part, SQLiteTableSource, _SQLiteReader, packed

TABLE = Table("Readings", "t", (Column("v", "CGM", "mg/dL"), Column("note", "NOTES", requirement="REQUIRED_NULLABLE")))
ROWS = [(k * 1000, None if k % 5 == 0 else k / 4, None if k % 3 else ["", "a", "\u00e4 b", "Z"][k % 4]) for k in range(200)] + [("2024-01-01", 7, "text time"), (None, 8, "no time"), (5.5, 9, "real")]


def database(path, rows=ROWS, ddl="CREATE TABLE Readings (t, v, note)"):
    con = sqlite3.connect(path)
    con.execute(ddl)
    con.executemany(f"INSERT INTO Readings VALUES ({', '.join('?' * len(rows[0]))})", rows)
    con.commit()
    con.close()
    return str(path)


@pytest.fixture
def files(tmp_path):
    database(tmp_path / "a.sqlite")
    database(tmp_path / "b.sqlite", [(1000, "x")], "CREATE TABLE Readings (t TEXT, v)")
    con = sqlite3.connect(tmp_path / "view.sqlite")
    con.execute("CREATE TABLE Raw (t, v, note)")
    con.executemany("INSERT INTO Raw VALUES (?, ?, ?)", ROWS[:20])
    con.execute("CREATE VIEW Readings AS SELECT t, v, note FROM Raw ORDER BY t DESC")
    con.commit()
    con.close()
    return f"{tmp_path}/*.sqlite"


CONDITIONS = ["v > '10'", "v is null", "note = ''", "note like 'a%'", "_seq between 3 and 5", "t = '1000'"]


def test_one_frame_used_many_times(spark, files):
    """Filters of one use of a frame are not seen by another, in one query or in several."""
    df = R.read_sqlite_table(spark, [files], TABLE)
    every = df.collect()
    frames = [df.where(c) for c in CONDITIONS]
    counts = [f.count() for f in frames]
    assert all(counts) and df.count() == len(every) == len(ROWS) + 21
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    assert union.count() == sum(counts)


def test_time_range_is_run_by_sqlite(spark, files):
    """Texts and missing times are in no range; a view keeps the numbers of its rows."""
    df = R.read_sqlite_table(spark, [files], TABLE, since=1000, until=4000)
    assert sorted((r["_file"].rsplit("/", 1)[1], r["t"]) for r in df.collect()) == [(f, t) for f in ("a.sqlite", "view.sqlite") for t in ("1000", "2000", "3000")]
    assert R.read_sqlite_table(spark, [files], TABLE, until=1).count() == 2  # 0 of both
    numbers = {r["t"]: r["_seq"] for r in R.read_sqlite_table(spark, [files], TABLE).where("_file like '%view%'").collect()}
    assert all(r["_seq"] == numbers[r["t"]] for r in df.where("_file like '%view%'").collect())


def test_the_index_on_time_is_used(tmp_path):
    path = database(tmp_path / "x.sqlite")
    con = sqlite3.connect(path)
    con.execute("CREATE INDEX by_time ON Readings (t)")
    reader = _SQLiteReader({"files": "[]", "table": "Readings", "timeColumn": "t", "since": "5000.0", "until": "9000.0"}, ["t", "v"])
    sql, args = reader._select(con, Part(path))
    assert "USING INDEX by_time" in str(con.execute(f"EXPLAIN QUERY PLAN {sql}", args).fetchall())
    assert len(con.execute(sql, args).fetchall()) == 4
    con.close()


def test_a_broken_file_does_not_look_empty(spark, tmp_path):
    database(tmp_path / "good.sqlite")
    (tmp_path / "broken.sqlite").write_bytes(b"SQLite format 3\0" + b"x" * 200)
    with pytest.raises(Exception, match="not a database"):
        R.read_sqlite_table(spark, [str(tmp_path)], TABLE).collect()


def test_partitions_follow_bytes(spark, tmp_path):
    """Forty small files share partitions, one large file has several; no row is lost or read twice."""
    for k in range(40):
        database(tmp_path / f"s{k:02d}.sqlite", [(k, k, None)])
    large = database(tmp_path / "large.sqlite", [(k, k, "x" * 300) for k in range(20_000)])
    third = os.path.getsize(large) // 3 + 1
    df = R.read_sqlite_table(spark, [str(tmp_path)], TABLE, partition_bytes=third)
    assert df.rdd.getNumPartitions() == 3 + -(-40 // (third // (OPEN_COST + 8192))) < 10
    assert df.groupBy("_file").count().where("count > 1").count() == 1
    assert df.count() == 20_040 and df.select("_file", "_seq").distinct().count() == 20_040


def test_packing():
    mb = 1 << 20
    groups = packed([("a", 10 * mb), ("b", 10 * mb), ("c", 200 * mb), ("d", 0)], 64 * mb)
    assert groups == [[Part("a"), Part("b")], *[[Part("c", k, 4)] for k in range(3)], [Part("c", 3, 4), Part("d")]]
    assert packed([], mb) == []


def test_batches(tmp_path):
    path = database(tmp_path / "x.sqlite")
    reader = SQLiteTableSource({"files": f'[["{path}", 1]]', "table": "Readings", "columns": "v", "rowsPerBatch": "64"}).reader(None)
    sizes = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    assert sum(sizes) == len(ROWS) and max(sizes) == 64

import csv
import json
import os
import pickle
import sqlite3

import pandas as pd
import pytest

from glucoflow.sinks import device_files as DF
from glucoflow.sources.sqlite_source import SQLiteTableSource

WRITERS = {
    "csv": lambda d: DF._csv_writer(d, ["a", "b"], ["preamble"]),
    "json": lambda d: DF._json_writer(d, ["a", "b"], "readings", False),
    "xml": lambda d: DF._xml_writer(d, "reading", ["a"], ["b"]),
    "sqlite": lambda d: DF._sqlite_writer(d, {"t": ["a", "b"], "u": ["b"]}),
}


def batches(persons, seen):
    """Two rows a person, in batches of three rows, so that every other person's rows lie in two of them."""
    rows = [(f"p{k // 2:03d}", "tu"[k % 2], float(k) if k % 3 else None, f'x "{k}"' if k % 4 else None) for k in range(2 * persons)]
    rows.insert(0, (None, "t", 1.0, "nobody's"))
    for k in range(0, len(rows), 3):
        yield pd.DataFrame(rows[k : k + 3], columns=["series_id", "_table", "a", "b"])
        seen.append(len(os.listdir("/proc/self/fd")))


@pytest.mark.parametrize("kind", sorted(WRITERS))
def test_a_task_holds_one_open_file(tmp_path, kind):
    seen: list[int] = []
    found = pd.concat([*WRITERS[kind](str(tmp_path))(batches(60, seen))])
    assert max(seen) <= seen[0] + 2
    assert sorted(found["path"]) == sorted(f"{tmp_path}/p{k:03d}.{kind}" for k in range(60)) and found["rows"].tolist() == [2] * 60
    assert sorted(os.listdir(tmp_path)) == [f"p{k:03d}.{kind}" for k in range(60)]


def test_contents_of_a_person_in_two_batches(tmp_path):
    for kind, made in WRITERS.items():
        [*made(str(tmp_path))(batches(4, []))]
    with open(f"{tmp_path}/p001.csv", newline="") as f:
        assert [*csv.reader(f)] == [["preamble"], ["a", "b"], ["2.0", 'x "2"'], ["", 'x "3"']]
    with open(f"{tmp_path}/p002.json") as f:
        assert json.load(f) == {"readings": [{"a": 4.0, "b": None}, {"a": 5.0, "b": 'x "5"'}]}
    with open(f"{tmp_path}/p001.xml") as f:
        assert f.read().split("\n")[2:4] == ['  <reading a="2.0"><b>x "2"</b></reading>', '  <reading a=""><b>x "3"</b></reading>']
    con = sqlite3.connect(f"{tmp_path}/p002.sqlite")
    assert con.execute("SELECT * FROM t").fetchall() == [(4.0, None)] and con.execute("SELECT * FROM u").fetchall() == [('x "5"',)]
    con.close()


def test_list_of_sqlite_files_stays_on_the_driver():
    files = json.dumps([[f"/exports/p{k:05d}.sqlite", 100] for k in range(5000)])
    source = SQLiteTableSource({"files": files, "table": "t", "columns": "a", "partitionBytes": "100000000"})
    reader = source.reader(None)
    assert len(reader.partitions()) > 1
    assert len(pickle.dumps((source, reader))) < 2000

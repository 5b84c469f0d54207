"""Write per-person device export files (CSV / SQLite / JSON / XML).

Used to turn the shared tables into realistic export folders that the
readers then parse back (round-trip checks, conformance runs).  Rows are
hash-partitioned by person and sorted inside partitions; each task streams
its Arrow batches into the files of its persons, so no person's data is
gathered in one place.  A person's file is closed when the next person's rows
begin, so a task holds one batch and one open file however many persons it has.
"""

from __future__ import annotations

import csv
import json
import os
import re
import sqlite3
import uuid
from collections.abc import Callable, Iterator
from xml.sax.saxutils import quoteattr

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from glucoflow.session import checkpoint_dir

WRITTEN_SCHEMA = "path string, rows bigint"


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = re.sub("^file:(//)?", "", checkpoint_dir(spark))  # these writers open plain paths
    path = f"{base.rstrip('/')}/glucoflow-{tag}-{uuid.uuid4().hex[:12]}"
    return path


def _fmt(v) -> str:
    if v is None or (isinstance(v, float) and pd.isna(v)):
        return ""
    if isinstance(v, float):
        return repr(v)
    return str(v)


def _texts(values: pd.Series) -> list[str]:
    return [_fmt(v) for v in values.tolist()]


def _cells(values: pd.Series) -> list:
    """Plain values; a missing one is None."""
    return [None if v is None or v != v else v for v in values.tolist()]


def _persons(pdf: pd.DataFrame) -> Iterator[tuple[str, int, int]]:
    """(person, first row, row after the last) of each run of rows; rows without a person are left out."""
    ids = pdf["series_id"].to_numpy(dtype=object)
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, int)
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=False):
        if ids[lo] is not None:
            yield ids[lo], lo, hi


class _File:
    """The export file of one person, written run by run."""

    def __init__(self, path: str):
        self.path, self.rows = path, 0
        self.open()

    def open(self) -> None:
        raise NotImplementedError

    def write(self, columns: list[list], lo: int, hi: int) -> None:
        raise NotImplementedError

    def close(self) -> None:
        raise NotImplementedError


def _written(out_dir: str, extension: str, file_of: Callable[[str], _File], columns_of: Callable[[pd.DataFrame], list[list]]):
    """Rows in the order of persons -> a file per person; the next person closes the file before."""

    def run(batches):
        now: _File | None = None
        try:
            for pdf in batches:
                done: list[_File] = []
                columns = columns_of(pdf)
                for sid, lo, hi in _persons(pdf):
                    path = f"{out_dir}/{sid}.{extension}"
                    if now is None or now.path != path:
                        if now is not None:
                            now.close()
                            done.append(now)
                        now = None
                        now = file_of(path)
                    now.write(columns, lo, hi)
                    now.rows += hi - lo
                if done:
                    yield pd.DataFrame({"path": [f.path for f in done], "rows": [f.rows for f in done]})
        finally:
            if now is not None:
                now.close()
        yield pd.DataFrame({"path": [now.path] if now else [], "rows": [now.rows] if now else []})

    return run


def _by_person(df: DataFrame) -> DataFrame:
    return df.repartition("series_id").sortWithinPartitions("series_id", "_seq")


def _csv_writer(out_dir: str, columns: list[str], preamble: list[str] | None):
    class CsvFile(_File):
        def open(self):
            self.handle = open(self.path, "w", encoding="utf-8", newline="")
            self.writer = csv.writer(self.handle)
            if preamble is not None:
                self.writer.writerow(preamble)
            self.writer.writerow(columns)

        def write(self, texts, lo, hi):
            self.writer.writerows(zip(*(c[lo:hi] for c in texts), strict=True))

        def close(self):
            self.handle.close()

    return _written(out_dir, "csv", CsvFile, lambda pdf: [_texts(pdf[c]) for c in columns])


def write_csv_files(df: DataFrame, out_dir: str, columns: list[str], preamble: list[str] | None = None) -> DataFrame:
    """One ``<series_id>.csv`` per person: optional preamble row, header, rows."""
    os.makedirs(out_dir, exist_ok=True)
    return _by_person(df).mapInPandas(_csv_writer(out_dir, columns, preamble), WRITTEN_SCHEMA)


def _sqlite_writer(out_dir: str, tables: dict[str, list[str]]):
    every = [*dict.fromkeys(c for cols in tables.values() for c in cols)]
    places = {t: [every.index(c) + 1 for c in cols] for t, cols in tables.items()}

    class SqliteFile(_File):
        def open(self):
            self.con = sqlite3.connect(self.path)
            self.con.execute("PRAGMA journal_mode = OFF")  # a failed task writes its files anew
            self.con.execute("PRAGMA synchronous = OFF")
            for t, cols in tables.items():
                self.con.execute(f'DROP TABLE IF EXISTS "{t}"')  # of an earlier try
                self.con.execute(f'CREATE TABLE "{t}" (' + ", ".join(f'"{c}"' for c in cols) + ")")

        def write(self, cells, lo, hi):
            for t, at in places.items():
                mine = [k for k in range(lo, hi) if cells[0][k] == t]
                if mine:
                    self.con.executemany(f'INSERT INTO "{t}" VALUES (' + ", ".join("?" for _ in at) + ")", [tuple(cells[c][k] for c in at) for k in mine])

        def close(self):
            self.con.commit()
            self.con.close()

    return _written(out_dir, "sqlite", SqliteFile, lambda pdf: [_cells(pdf[c]) for c in ["_table", *every]])


def write_sqlite_files(df: DataFrame, out_dir: str, tables: dict[str, list[str]]) -> DataFrame:
    """One ``<series_id>.sqlite`` per person; ``_table`` routes each row."""
    os.makedirs(out_dir, exist_ok=True)
    return _by_person(df).mapInPandas(_sqlite_writer(out_dir, tables), WRITTEN_SCHEMA)


def _json_writer(out_dir: str, columns: list[str], key: str | None, lines: bool):
    start, between, end = ("", "\n", "\n") if lines else ("{" + json.dumps(key) + ": [", ",", "]}") if key else ("[", ",", "]")

    class JsonFile(_File):
        def open(self):
            self.handle = open(self.path, "w", encoding="utf-8")
            self.handle.write(start)

        def write(self, cells, lo, hi):
            records = (json.dumps(dict(zip(columns, rec, strict=True)), ensure_ascii=False) for rec in zip(*(c[lo:hi] for c in cells), strict=True))
            self.handle.write((between if self.rows else "") + between.join(records))

        def close(self):
            self.handle.write(end)
            self.handle.close()

    return _written(out_dir, "json", JsonFile, lambda pdf: [_cells(pdf[c]) for c in columns])


def write_json_files(df: DataFrame, out_dir: str, columns: list[str], key: str | None = None, lines: bool = False) -> DataFrame:
    """One ``<series_id>.json`` per person: a list of records, ``{key: [records]}``
    when ``key`` is given, or a line for each record."""
    os.makedirs(out_dir, exist_ok=True)
    return _by_person(df).mapInPandas(_json_writer(out_dir, columns, key, lines), WRITTEN_SCHEMA)


def _xml_writer(out_dir: str, tag: str, attrs: list[str], children: list[str]):
    class XmlFile(_File):
        def open(self):
            self.handle = open(self.path, "w", encoding="utf-8")
            self.handle.write("<?xml version='1.0' encoding='utf-8'?>\n<export>\n")

        def write(self, texts, lo, hi):
            for rec in zip(*(c[lo:hi] for c in texts), strict=True):
                a = " ".join(f"{k}={quoteattr(v)}" for k, v in zip(attrs, rec))
                kids = "".join(f"<{k}>{v.replace('&', '&amp;').replace('<', '&lt;')}</{k}>" for k, v in zip(children, rec[len(attrs) :], strict=True))
                self.handle.write(f"  <{tag} {a}>{kids}</{tag}>\n")

        def close(self):
            self.handle.write("</export>\n")
            self.handle.close()

    return _written(out_dir, "xml", XmlFile, lambda pdf: [_texts(pdf[c]) for c in attrs + children])


def write_xml_files(df: DataFrame, out_dir: str, tag: str, attrs: list[str], children: list[str]) -> DataFrame:
    """One ``<series_id>.xml`` per person with one ``<tag>`` element per row;
    ``attrs`` become attributes, ``children`` child elements."""
    os.makedirs(out_dir, exist_ok=True)
    return _by_person(df).mapInPandas(_xml_writer(out_dir, tag, attrs, children), WRITTEN_SCHEMA)

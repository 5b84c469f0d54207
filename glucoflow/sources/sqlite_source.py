"""SQLite exports as a Spark data source (Python Data Source API).

No SQLite JDBC driver is assumed on the cluster, so the source reads with the
standard ``sqlite3`` module inside the tasks, in Arrow batches.  Input partitions
follow bytes: small files share one, a large file is cut into as many rowid
ranges as its size asks for; a task finds the bounds of its range itself, so
the driver opens no file.  ``rowid`` is the row order (``_seq``).

A time range is an option, run by SQLite as a condition on the stored number (an
index on it is used).  It is no pushed filter: Spark 4.1 keeps the filters pushed
into a Python source with the source and not with the scan, so two uses of one
DataFrame with different filters would see each other's.

Options: ``files`` (JSON list of [path, bytes]), ``table``, ``columns`` (comma
separated, the wanted list), ``timeColumn``, ``since``, ``until`` (rows whose time
is a number from since to before until), ``partitionBytes`` (default 64 MiB),
``rowsPerBatch``.
Columns missing from a file come back as nulls; identifiers must be
alphanumeric, ``_`` or ``.``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: bytes that opening a file counts for when files are packed into partitions
OPEN_COST = 256 << 10


def valid_identifier(name: str) -> bool:
    return bool(name) and all(c.isalnum() or c in "_." for c in name)


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _local(path: str) -> str:
    """A path as sqlite3 opens it."""
    return path[5:] if path.startswith("file:") else path


@dataclass(frozen=True)
class Part:
    """One of ``of`` rowid ranges of a file."""

    path: str
    part: int = 0
    of: int = 1


class _Parts(InputPartition):
    def __init__(self, parts: list[Part]):
        self.parts = parts


def packed(files: list[tuple[str, int]], partition_bytes: int) -> list[list[Part]]:
    """Files and ranges of files in groups of about ``partition_bytes``, in the order of the files."""
    groups: list[list[Part]] = []
    held = partition_bytes
    for path, size in files:
        n = max(1, -(-size // partition_bytes))
        for k in range(n):
            cost = size // n + OPEN_COST
            if held + cost > partition_bytes:
                groups.append([])
                held = 0
            groups[-1].append(Part(path, k, n))
            held += cost
    return groups


class SQLiteTableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "glucoflow_sqlite"

    def _columns(self) -> list[str]:
        return [c for c in self.options.get("columns", "").split(",") if c]

    def schema(self) -> str:
        return ", ".join(["_file string", "_seq bigint", *(f"`{c}` string" for c in self._columns())])

    def reader(self, schema):
        made = _SQLiteReader(self.options, self._columns())
        # source and reader go to every task, which reads the files of its own partition only
        self.options = {k: v for k, v in self.options.items() if k != "files"}
        return made


class _SQLiteReader(DataSourceReader):
    def __init__(self, options, columns):
        self.files = [(p, int(n)) for p, n in json.loads(options.get("files", "[]"))]
        self.table = options.get("table", "")
        self.columns = columns
        self.time = options.get("timeColumn") or None
        self.partition_bytes = int(options.get("partitionBytes", 64 << 20))
        self.rows_per_batch = int(options.get("rowsPerBatch", 10_000))
        self.range = [(sign, float(options[k])) for k, sign in (("since", ">="), ("until", "<")) if options.get(k)]
        for ident in [self.table, *columns, *([self.time] if self.time else [])]:
            if not valid_identifier(ident):
                raise ValueError(f"unsafe SQLite identifier: {ident!r}")

    def __getstate__(self):
        return {**self.__dict__, "files": []}

    def partitions(self):
        return [_Parts(g) for g in packed(self.files, self.partition_bytes)] or [_Parts([])]

    def _splittable(self, con) -> bool:
        """Whether the file has the table, with rowids (a view or a table without has none)."""
        found = con.execute("SELECT type, sql FROM sqlite_master WHERE name = ? COLLATE NOCASE", (self.table,)).fetchone()
        return found is not None and found[0] == "table" and "WITHOUT ROWID" not in (found[1] or "").upper()

    def _select(self, con, part: Part) -> tuple[str, tuple] | None:
        """The query of a part, or None where the file has nothing for it."""
        table = _quote(self.table)
        con.execute("SELECT name FROM sqlite_master").fetchall()  # a file that is no database must not look empty
        present = {r[1] for r in con.execute(f"PRAGMA table_info({table})")}
        if not present:
            return None
        splittable = self._splittable(con)
        if not splittable:  # without rowids the rows are numbered in the order they come, before any condition
            table = f"(SELECT row_number() OVER () - 1 AS _seq, * FROM {table})"
        columns = ["rowid AS _seq" if splittable else "_seq"]
        # missing columns become NULL (never a quoted-name constant)
        columns += [f"CAST({_quote(c)} AS TEXT)" if c in present else "NULL" for c in self.columns]
        where: list[str] = []
        args: list = []
        if part.of > 1:
            if not splittable:
                if part.part:
                    return None  # the first part reads it all
            else:
                lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
                if lo is None:
                    return None
                step = -(-(hi - lo + 1) // part.of)
                first = lo + part.part * step
                if first > hi:
                    return None
                where.append("rowid BETWEEN ? AND ?")
                args += [first, min(first + step - 1, hi)]
        if self.range:
            if self.time not in present:
                return None
            # the plain column, so that its index counts; a text sorts above every number
            where.append(f"typeof({_quote(self.time)}) IN ('integer', 'real')")
            for sign, bound in self.range:
                where.append(f"{_quote(self.time)} {sign} ?")
                args.append(bound)
        return f"SELECT {', '.join(columns)} FROM {table}" + (" WHERE " + " AND ".join(where) if where else ""), tuple(args)

    def read(self, partition):
        import sqlite3

        import pyarrow as pa

        kinds = [("_seq", pa.int64()), *((c, pa.string()) for c in self.columns)]
        schema = pa.schema([("_file", pa.string()), *kinds])
        for part in partition.parts:
            con = sqlite3.connect(f"file:{_local(part.path)}?mode=ro", uri=True)
            try:
                query = self._select(con, part)
                if query is None:
                    continue
                found = con.execute(*query)
                while rows := found.fetchmany(self.rows_per_batch):
                    columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(rows)), *columns], schema=schema)
            finally:
                con.close()


def table_structure(path: str) -> dict[str, list[str]]:
    """Tables and their columns of one SQLite file (used by conformance)."""
    import sqlite3

    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        tables = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type='table'")]
        return {t: [r[1] for r in con.execute(f"PRAGMA table_info({_quote(t)})")] for t in tables}
    finally:
        con.close()

"""Readers: one layout table from many export files -> DataFrame -> events.

Every reader returns ``_file, _seq, <wanted source columns as text>`` where
``_seq`` is the row order inside the file (assigned at the scan, before any
shuffle).  ``to_events`` then detects the time format per series, converts
times to UTC and unpivots the mapped columns into ``events_long``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from glucoflow.functions import timestamps as TS
from glucoflow.functions.numbers import null_words
from glucoflow.operators.events import ColumnSpec, name_columns, to_long
from glucoflow.session import checkpoint_dir
from glucoflow.sources.catalog import CONFIRMATION_ONLY, OPTIONAL, Layout, Table
from glucoflow.sources.sqlite_source import SQLiteTableSource

#: rows that are searched for an undeclared header
HEADER_SEARCH_ROWS = 4
#: header rows of so many files (a path and a few numbers each) may be sent to every task
BROADCAST_FILES = 100_000
#: so many positions of a column are told apart by conditions, more by a list
FEW_POSITIONS = 24


def _norm(c: SparkColumn) -> SparkColumn:
    return F.lower(F.trim(c))


def series_from_file(file_col: SparkColumn) -> SparkColumn:
    """Default person key: the export file name without folder and extension."""
    return F.regexp_extract(file_col, r"([^/]+?)(\.[^./]*)?$", 1)


def series_from_path(file_col: SparkColumn) -> SparkColumn:
    """Person key from the last folder and the file's name: ``p1/export.csv`` -> ``p1/export``."""
    return F.regexp_extract(file_col, r"([^/]+/[^/]+?)(\.[^./]*)?$", 1)


# ------------------------------------------------------------------- CSV
def _required(table: Table) -> list[str]:
    return [c.source_name.strip().lower() for c in table.columns if c.requirement != OPTIONAL]


def _csv_reader(spark: SparkSession, table: Table):
    return (
        spark.read.option("header", False)
        .option("multiLine", table.quoted_newlines)
        .option("mode", "PERMISSIVE")
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')  # RFC 4180: a quote inside quotes is doubled
    )


def _uncarried(c: SparkColumn) -> SparkColumn:
    """Without the carriage return that stays when a file ends its lines by CR LF but quotes a plain LF before the first of them."""
    return F.rtrim(c, F.lit("\r"))


def fields_of(record: SparkColumn) -> SparkColumn:
    """The fields of a raw CSV record, unquoted: any number of them, by its own quotes.

    Pieces between quotes are outside and inside by turns; commas inside are
    hidden while the record is split.
    """
    hidden = "\x01"
    pieces = F.transform(F.split(_uncarried(record), '"', -1), lambda piece, k: F.when(k % 2 == 1, F.translate(piece, ",", hidden)).otherwise(piece))
    fields = F.split(F.array_join(pieces, '"'), ",", -1)

    def plain(f: SparkColumn) -> SparkColumn:
        f = F.translate(F.trim(f), hidden, ",")
        quoted = f.startswith('"') & f.endswith('"') & (F.length(f) > 1)
        return F.when(quoted, F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)

    return F.transform(fields, plain)


def csv_headers(spark: SparkSession, paths: list[str], table: Table) -> DataFrame:
    """One row per file with records: ``_file, _hseq, _hpos, _pos``.

    The header is the file's first record that names all required columns:
    ``_hseq`` and ``_hpos`` are its place in the scan and in the file (null: no
    such record), ``_pos`` the position of every wanted column, -1 where the file
    has none.  Records are read as one field and their own text, so a header
    may have any width and hold quoted line breaks; only records in which all
    names occur are taken apart.  Summed up per task before the shuffle,
    written to the shared folder and read back.

    Splits of one file are packed into partitions in offset order and ids grow
    with the partition, so a file's first records get its first positions even
    when it is split.
    """
    records = (
        _csv_reader(spark, table)
        .schema("_c0 string, _raw string")
        .option("columnNameOfCorruptRecord", "_raw")  # set for every record of two fields or more
        .option("columnPruning", "false")
        .csv(paths)
        .select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_seq"), F.coalesce("_raw", "_c0").alias("_raw"))
    )
    required = _required(table)
    lower = F.lower(F.col("_raw"))
    maybe = F.lit(True)
    for name in required:
        maybe = maybe & lower.contains(name.replace('"', '""'))
    names = F.when(maybe, F.transform(fields_of(F.col("_raw")), _norm))
    records = records.select("_file", "_seq", names.alias("_names"))
    names_all = F.size(F.array_except(F.array(*[F.lit(r) for r in required]), F.col("_names"))) == 0
    at = F.when(F.col("_names").isNotNull() & names_all, F.col("_seq"))
    found = records.groupBy("_file").agg(F.min("_seq").alias("_first"), F.min(at).alias("_hseq"), F.min_by("_names", at).alias("_names"))
    wanted = [F.coalesce(F.array_position("_names", n.strip().lower()).cast("int"), F.lit(0)) - 1 for n in table.wanted()]
    headers = found.select("_file", "_hseq", (F.col("_hseq") - F.col("_first")).alias("_hpos"), F.array(*wanted).alias("_pos"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv-headers-{uuid.uuid4().hex}"
    headers.write.parquet(path)
    return spark.read.schema(headers.schema).parquet(path)


def _header_ok(table: Table, search_rows: int) -> SparkColumn:
    if table.header_row is not None:
        return F.coalesce(F.col("_hpos") == table.header_row, F.lit(False))
    return F.coalesce(F.col("_hpos") < search_rows, F.lit(False))


def _at(position: SparkColumn, positions: list[int]) -> SparkColumn:
    """The field at a position that is one of a few known ones; only these are read from the file."""
    if len(positions) > FEW_POSITIONS:
        place = F.array_position(F.array(*[F.lit(p) for p in positions]), position).cast("int")
        return F.when(place > 0, F.element_at(F.array(*[F.col(f"_c{p}") for p in positions]), place))
    value = F.lit(None).cast("string")
    for p in positions:
        value = F.when(position == p, F.col(f"_c{p}")).otherwise(value)
    return value


def read_csv_table(spark: SparkSession, paths: list[str], table: Table, search_rows: int = HEADER_SEARCH_ROWS, headers: DataFrame | None = None) -> DataFrame:
    """Read one CSV table from many files with per-file header resolution.

    The header of each file is its declared ``header_row`` or, when undeclared,
    the first of the first ``search_rows`` records holding every required name.
    Columns are then picked by position of their (case-insensitive, stripped)
    name in that file's header, so files with different column orders mix
    freely and optional columns missing from a file are null.  Files without
    such a header are left out here and listed by ``rejected_csv_files``.

    Two scans: one for the headers (``csv_headers``, may be given), one for the
    rows, which parses only the fields that some file's header asks for.
    """
    headers = headers if headers is not None else csv_headers(spark, paths, table)
    used = headers.where(_header_ok(table, search_rows))
    # wanted columns times positions, few numbers however many files there are
    places = used.select(F.posexplode("_pos").alias("k", "p")).where("p >= 0").distinct().collect()
    by_column: dict[int, list[int]] = {}
    for r in places:
        by_column.setdefault(r["k"], []).append(r["p"])
    width = max([r["p"] for r in places], default=0) + 1
    rows = _csv_reader(spark, table).schema(", ".join(f"_c{i} string" for i in range(width))).csv(paths)
    parsed = sorted({r["p"] for r in places})
    body = rows.select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_seq"), *[F.col(f"_c{p}") for p in parsed])
    # a row per file: sent to all tasks up to a known number of files, else joined as Spark sees fit
    small = F.broadcast(used) if used.count() <= BROADCAST_FILES else used
    body = body.join(small, "_file").where(F.col("_seq") > F.col("_hseq"))
    wanted = [null_words(_uncarried(_at(F.col("_pos")[k], sorted(by_column.get(k, []))))).alias(n) for k, n in enumerate(table.wanted())]
    return body.select("_file", "_seq", *wanted)


def rejected_csv_files(spark: SparkSession, paths: list[str], table: Table, search_rows: int = HEADER_SEARCH_ROWS, headers: DataFrame | None = None) -> DataFrame:
    """``_file, reason`` of CSV files with rows but without the header that the layout asks for."""
    headers = headers if headers is not None else csv_headers(spark, paths, table)
    where = F.lit(f"row {table.header_row}" if table.header_row is not None else f"the first {search_rows} rows")
    reason = F.when(F.col("_hpos").isNull(), F.lit("no row names all required columns")).otherwise(
        F.concat(F.lit("the header is in row "), F.col("_hpos").cast("string"), F.lit(", expected in "), where)
    )
    return headers.where(~_header_ok(table, search_rows)).select("_file", reason.alias("reason"))


# ------------------------------------------------------------------ JSON
_RECORD = "map<string,string>"


def _key(m: SparkColumn, name: str) -> SparkColumn:
    """Value of the first key of a map that equals name but for case (null: none)."""
    return F.get(F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == name.lower()), F.lit(0))["value"]


def _with_records(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the records of a JSON text that is a list of them or a single one (null: neither).

    The parsed text is a column of its own, so it is parsed once however often it is asked for.
    """
    starts = F.ltrim(text).startswith("{")
    parsed = df.withColumn("_single", F.when(starts, F.from_json(text, _RECORD)))
    many = F.when(~starts, F.from_json(text, f"array<{_RECORD}>"))
    return parsed.withColumn(out, F.when(F.col("_single").isNotNull(), F.array("_single")).otherwise(many)).drop("_single")


def json_documents(spark: SparkSession, paths: list[str], table: Table) -> DataFrame:
    """One row per JSON file: ``_file, _blank, _records`` (null: not JSON).

    Nothing is inferred, so files of different shapes read together: a list of
    records, a single record, lines of one record each, or an object whose
    keys are tables that hold a list or a single record.  A record is a map of
    its fields, each the text it has in the file; its values may be of any type.

    Each step is a projection of its own: Spark keeps apart what is used more
    than once, so a text is split and parsed once.
    """
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.col("value"))
    lines = files.withColumn("_lines", F.filter(F.split("value", "\r?\n"), lambda x: x.rlike("\\S")))
    # a record that ends in its line, and more lines: each is a document
    by_line = F.when(F.size("_lines") > 1, F.from_json(F.col("_lines")[0], _RECORD)).isNotNull()
    kinds = lines.select("_file", (F.size("_lines") == 0).alias("_blank"), "value", "_lines", by_line.alias("_by_line"))
    each = F.when(F.col("_by_line"), F.transform("_lines", lambda x: F.from_json(x, _RECORD)))
    whole = F.when(~F.col("_by_line"), F.col("value"))
    split = kinds.select("_file", "_blank", "_by_line", each.alias("_each"), whole.alias("_text"))
    every = F.when(F.forall("_each", lambda r: r.isNotNull()), F.col("_each"))
    found = _with_records(split, "_text", "_whole").select("_file", "_blank", F.when(F.col("_by_line"), every).otherwise(F.col("_whole")).alias("_root"))
    if not table.name:
        return found.withColumnRenamed("_root", "_records")
    is_table = (F.size("_root") == 1) & F.exists(F.map_keys(F.get("_root", F.lit(0))), lambda k: F.lower(k) == table.name.lower())
    told = found.withColumn("_is_table", is_table)
    named = told.withColumn("_text", F.when(F.col("_is_table"), _key(F.get("_root", F.lit(0)), table.name)))
    inner = F.coalesce(F.col("_inner"), F.array().cast(f"array<{_RECORD}>"))
    return _with_records(named, "_text", "_inner").select("_file", "_blank", F.when(F.col("_is_table"), inner).otherwise(F.col("_root")).alias("_records"))


def read_json_table(spark: SparkSession, paths: list[str], table: Table) -> DataFrame:
    """The records of a table in JSON exports, whatever their shape (see json_documents), in one scan."""
    # of a bare column Spark would filter by its size first, with the whole parse repeated in that filter
    records = F.coalesce(F.col("_records"), F.array().cast(f"array<{_RECORD}>"))
    rows = json_documents(spark, paths, table).select("_file", F.posexplode(records).alias("_seq", "_r"))
    fields = rows.select("_file", "_seq", F.transform(F.map_keys("_r"), F.lower).alias("_names"), F.map_values("_r").alias("_values"))
    # the first key that equals the name but for case; get() of place -1 is null
    value = lambda n: F.get("_values", (F.array_position("_names", n.lower()) - 1).cast("int"))
    return fields.select("_file", F.col("_seq").cast("bigint").alias("_seq"), *[value(n).alias(n) for n in table.wanted()])


def rejected_json_files(spark: SparkSession, paths: list[str], table: Table) -> DataFrame:
    """``_file, reason`` of files that are no JSON, and of those without a record that has the time."""
    docs = json_documents(spark, paths, table)
    timed = F.exists("_records", lambda r: F.exists(F.map_keys(r), lambda k: F.lower(k) == table.timestamp_column.lower()))
    reason = (
        F.when(F.col("_blank"), "the file is empty")
        .when(F.col("_records").isNull(), "the file isn't JSON")
        .when((F.size("_records") > 0) & ~F.coalesce(timed, F.lit(False)), f"no record has {table.timestamp_column}")
    )
    return docs.select("_file", reason.alias("reason")).where("reason is not null")


# ------------------------------------------------------------------- XML
def read_xml_table(spark: SparkSession, paths: list[str], table: Table) -> DataFrame:
    """One row per ``<table>`` element; a field is the attribute of that name,
    else the child element's text; empty text is null.

    The schema is made from the layout's columns, so the files are read once and
    fields that no column asks for are skipped.
    """
    wanted = table.wanted()
    schema = StructType([StructField(k, StringType()) for n in wanted for k in (f"_attr_{n}", n)])
    df = (
        spark.read.format("xml")
        .schema(schema)
        .option("rowTag", table.name)
        .option("attributePrefix", "_attr_")
        .load(paths)
        .select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_seq"), "*")
    )
    out = []
    for n in wanted:
        v = F.coalesce(F.col(f"`_attr_{n}`"), F.col(f"`{n}`"))
        out.append(F.when(F.trim(v) != "", v).alias(n))
    return df.select("_file", "_seq", *out)


# ---------------------------------------------------------------- SQLite
def read_sqlite_table(spark: SparkSession, paths: list[str], table: Table, partition_bytes: int = 64 << 20, since: float | None = None, until: float | None = None) -> DataFrame:
    """One SQLite table from many files, which share partitions or are cut by rowid, by their bytes.

    ``since`` and ``until`` (first moment and the one after the last, as numbers
    in the unit of the file) are run by SQLite itself; rows whose time is a text
    are in no range.
    """
    spark.dataSource.register(SQLiteTableSource)
    files = spark.read.format("binaryFile").load(paths).select("path", "length").orderBy("path").collect()  # a name and a size per file
    df = (
        spark.read.format(SQLiteTableSource.name())
        .option("files", json.dumps([list(f) for f in files]))
        .option("table", table.name)
        .option("columns", ",".join(table.wanted()))
        .option("timeColumn", table.timestamp_column)
        .option("partitionBytes", str(partition_bytes))
    )
    for name, bound in (("since", since), ("until", until)):
        if bound is not None:
            df = df.option(name, repr(float(bound)))
    return df.load()


#: A reader per file type, called with (spark, paths, table); register more with ``register_reader``
READERS: dict[str, Callable[..., DataFrame]] = {}


def register_reader(file_type: str):
    """Decorator: the function reads tables of this file type from now on."""

    def deco(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        READERS[file_type] = fn
        return fn

    return deco


for _type, _reader in (("csv", read_csv_table), ("json", read_json_table), ("xml", read_xml_table), ("sqlite", read_sqlite_table)):
    register_reader(_type)(_reader)


def reader_of(file_type: str) -> Callable[..., DataFrame]:
    if file_type not in READERS:
        raise ValueError(f"No reader for {file_type!r} files; there are {', '.join(sorted(READERS))}")
    return READERS[file_type]


def layout_headers(spark: SparkSession, layout: Layout, paths: list[str]) -> dict[str, DataFrame]:
    """The headers of every CSV table of a layout, read once for rows and rejected files."""
    mine = {tb.name: (tb, [p for p in paths if fc.matches(p)]) for fc in layout.files if fc.file_type == "csv" for tb in fc.tables}
    return {name: csv_headers(spark, own, tb) for name, (tb, own) in mine.items() if own}


def read_tables(spark: SparkSession, layout: Layout, paths: list[str], headers: dict[str, DataFrame] | None = None) -> dict[str, tuple[Table, DataFrame]]:
    """Every table of a layout as a lazy DataFrame.

    Each file config reads the paths its glob matches.
    """
    out: dict[str, tuple[Table, DataFrame]] = {}
    for fc in layout.files:
        mine = [p for p in paths if fc.matches(p)]
        if not mine:
            continue
        for tb in fc.tables:
            known = {"headers": headers[tb.name]} if headers and tb.name in headers else {}
            out[tb.name] = (tb, reader_of(fc.file_type)(spark, mine, tb, **known))
    return out


def rejected_files(spark: SparkSession, layout: Layout, paths: list[str], headers: dict[str, DataFrame] | None = None) -> DataFrame:
    """``_file, reason`` of the CSV files of a layout whose header can't be found, and of JSON files that hold no record."""
    out = spark.createDataFrame([], "_file string, reason string")
    for fc in layout.files:
        mine = [p for p in paths if fc.matches(p)]
        if fc.file_type == "json" and mine:
            for tb in fc.tables:
                out = out.unionByName(rejected_json_files(spark, mine, tb))
        if fc.file_type == "csv" and mine:
            out = out.unionByName(rejected_csv_files(spark, mine, fc.tables[0], headers=(headers or {}).get(fc.tables[0].name)))
    return out


def layout_specs(layout: Layout) -> dict[tuple[str, str], ColumnSpec]:
    """Standard output names for every mapped column of a layout.

    Metadata goes with insulin (P2); within a type the primary comes first;
    a second primary of one type (from another table) becomes a secondary.
    """
    raw = []
    keys = []
    for fc in layout.files:
        for tb in fc.tables:
            for c in tb.columns:
                if c.data_type and c.requirement != CONFIRMATION_ONLY:
                    raw.append((c.source_name, c.data_type, c.is_primary, c.unit))
                    keys.append((tb.name, c.source_name))
    named = name_columns(raw)
    by_src = {}
    for spec in named:
        by_src.setdefault((spec.source, spec.data_type), []).append(spec)
    out = {}
    for (tname, src), (s, dt, _, _) in zip(keys, raw):
        out[(tname, src)] = by_src[(s, dt)].pop(0)
    return out


def _read_once(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder; the names of its columns may be of any characters."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/source-rows-{uuid.uuid4().hex}"
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    plain.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def convert_times(df: DataFrame, table: Table, series: SparkColumn | None = None) -> DataFrame:
    """Add ``series_id`` and ``ts`` (UTC) to source rows: the time format is
    detected per series over all its values, then every row converted.

    Both need the rows, so files are read once: what was read is written to the
    shared folder and read back."""
    s = series if series is not None else series_from_file(F.col("_file"))
    keyed = _read_once(df.withColumn("series_id", s))
    tcol = table.timestamp_column
    detected = TS.detect(keyed, ["series_id"], tcol, "_seq")
    return TS.convert(keyed, detected, ["series_id"], tcol)


def to_events(
    df: DataFrame,
    table: Table,
    specs: dict[tuple[str, str], ColumnSpec],
    series: SparkColumn | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Source rows -> ``events_long`` plus a quarantine frame of rows whose
    time is missing or did not parse (kept out of the results, counted by the
    caller)."""
    tcol = table.timestamp_column
    conv = convert_times(df, table, series)
    bad = conv.where(F.col("ts").isNull()).select(
        "series_id", "_file", "_seq", F.col(f"`{tcol}`").alias("raw_time"), "ts_type"
    )
    good = conv.where(F.col("ts").isNotNull())
    cols = [specs[(table.name, c.source_name)] for c in table.columns if (table.name, c.source_name) in specs]
    long = to_long(good, cols, "series_id", "ts", "_seq", source_table=table.name)
    return long, bad

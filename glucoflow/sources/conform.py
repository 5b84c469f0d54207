"""Conformance: which catalogue layout does each export file follow?

A folder of exports is classified in one Spark job:

1. list files (``binaryFile`` without its content column: names and sizes);
2. extract each file's structure on the executors (``mapInPandas``): the
   first four CSV rows, SQLite tables and columns, the first JSON record's
   keys, the first XML element of each tag;
3. join with the catalogue (a few dozen fixed rows, broadcast) and compute
   missing tables / columns with ``array_except``;
4. per file, the first layout (catalogue order) whose tables all validate
   wins; otherwise the missing report of every candidate is kept.
"""

from __future__ import annotations

import csv
import fnmatch
import json
import sqlite3

import pandas as pd
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glucoflow.sources.catalog import EXTENSIONS, OPTIONAL, Catalog, Layout, catalog_frame, default_catalog

#: table name under which an unreadable file's message stands
ERROR = "__error__"
STRUCT_SCHEMA = "path string, file_type string, table_name string, pos int, names array<string>"
HEADER_SEARCH_ROWS = 4


class ConformanceError(Exception):
    """No layout matches, or the files do not hold what the layout needs."""


def file_type_of(path: str) -> str | None:
    ext = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    for t, exts in EXTENSIONS.items():
        if ext in exts:
            return t
    return None


def _local(path: str) -> str:
    return path[5:] if path.startswith("file:") else path


def _structure_of(path: str) -> list[tuple]:
    """Structure rows of one file (runs inside a task)."""
    ft = file_type_of(path)
    p = _local(path)
    rows: list[tuple] = []
    try:
        if ft == "csv":
            with open(p, encoding="utf-8", newline="") as fh:
                reader = csv.reader(fh)
                for i, rec in enumerate(reader):
                    if i >= HEADER_SEARCH_ROWS:
                        break
                    rows.append((path, ft, "", i, rec))
        elif ft == "sqlite":
            from glucoflow.sources.sqlite_source import table_structure

            for t, cols in table_structure(p).items():
                rows.append((path, ft, t, 0, cols))
        elif ft == "json":
            with open(p, encoding="utf-8") as fh:
                data = json.load(fh)
            if isinstance(data, list):
                # a top-level list serves every table of the layout ("*")
                if data and isinstance(data[0], dict):
                    rows.append((path, ft, "*", 0, list(data[0])))
            elif isinstance(data, dict):
                for k, v in data.items():
                    first = v[0] if isinstance(v, list) and v else v
                    if isinstance(first, dict):
                        rows.append((path, ft, k, 0, list(first)))
        elif ft == "xml":
            import xml.etree.ElementTree as ET

            seen: set[str] = set()
            above: list[ET.Element] = []
            fields: list[list[str]] = []  # child tags of the open elements
            for event, el in ET.iterparse(p, events=("start", "end")):
                if event == "start":
                    above.append(el)
                    fields.append([])
                    continue
                above.pop()
                own = [*el.attrib, *fields.pop()]
                if el.tag not in seen and own:
                    seen.add(el.tag)
                    rows.append((path, ft, el.tag, 0, own))
                if above:  # a finished element leaves its parent: memory stays at the open ones
                    if el.tag not in fields[-1]:
                        fields[-1].append(el.tag)
                    above[-1].remove(el)
    except (OSError, ValueError, UnicodeDecodeError, IndexError, csv.Error, sqlite3.Error, SyntaxError) as e:
        # this file can't be read: its verdict says so, the others go on (an XML ParseError is a SyntaxError)
        return [(path, ft or "", ERROR, 0, [f"{type(e).__name__}: {e}"])]
    return rows


def _extract(batches):
    for pdf in batches:
        out = [r for path in pdf["path"] for r in _structure_of(path)]
        yield pd.DataFrame(out, columns=["path", "file_type", "table_name", "pos", "names"])


def list_files(spark: SparkSession, paths: list[str] | str, recursive: bool = True) -> DataFrame:
    """Paths of candidate export files (content is never read here)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    df = reader.load(paths if isinstance(paths, str) else list(paths)).select("path", "length")
    return df


def structures(spark: SparkSession, files: DataFrame) -> DataFrame:
    return files.select("path").mapInPandas(_extract, STRUCT_SCHEMA)


def _type_of(ext: SparkColumn) -> SparkColumn:
    """File type by extension, null for others."""
    ftype = F.lit(None).cast("string")
    for t, exts in EXTENSIONS.items():
        ftype = F.when(ext.isin(*[e[1:] for e in exts]), F.lit(t)).otherwise(ftype)
    return ftype


def validate(spark: SparkSession, files: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """One row per (file, candidate layout): ``valid``, ``missing_tables``,
    ``missing_columns`` (map table -> names) and the report text (F8)."""
    catalog = catalog or default_catalog()
    cat = catalog_frame(spark, catalog)
    req = (
        cat.where(F.col("requirement") != OPTIONAL)
        .groupBy("layout", "layout_pos", "file_type", "file_pattern", "table_name", "header_row")
        .agg(F.collect_list("source_col").alias("required"))
    )
    # glob of each file config, as a case-insensitive regex on the file name
    globs = {fc.name_pattern: "(?i)" + fnmatch.translate(fc.name_pattern) for lay in catalog.formats for fc in lay.files}
    glob_re = F.create_map(*[x for kv in globs.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    req = req.withColumn("_glob", glob_re[F.col("file_pattern")])
    st = F.broadcast(req)  # fixed catalogue: a few rows per layout
    s = structures(spark, files)
    ext = F.lower(F.regexp_extract(F.col("path"), r"\.([^./]+)$", 1))
    fl = files.select("path", _type_of(ext).alias("file_type"), F.regexp_extract("path", r"([^/]+)$", 1).alias("_name"))
    cand = fl.join(st, "file_type").where(F.expr("_name rlike _glob")).drop("_name", "_glob")
    case_sensitive = F.col("file_type") == "sqlite"
    lower_all = lambda a: F.transform(a, lambda x: F.lower(F.trim(x)))
    errors = s.where(F.col("table_name") == ERROR).select("path", F.col("names")[0].alias("error"))
    s = s.where(F.col("table_name") != ERROR)
    st_rows = s.select(F.col("path").alias("_p"), F.col("table_name").alias("_t"), "pos", "names")
    match = (F.col("path") == F.col("_p")) & ((F.col("table_name") == F.col("_t")) | (F.col("_t") == "*"))
    joined = cand.join(st_rows, match, "left").drop("_p", "_t")
    actual = F.when(case_sensitive, F.col("names")).otherwise(lower_all(F.col("names")))
    wanted = F.when(case_sensitive, F.col("required")).otherwise(lower_all(F.col("required")))
    joined = joined.withColumn("missing", F.when(F.col("names").isNull(), wanted).otherwise(F.array_except(wanted, actual)))
    # CSV: declared header row, or the first of the first four rows that holds
    # everything; any other row counts as "everything missing", so a file
    # shorter than the declared header row fails
    pos_ok = F.col("header_row").isNull() | (F.col("pos") == F.col("header_row")) | F.col("pos").isNull()
    joined = joined.withColumn("missing", F.when(pos_ok, F.col("missing")).otherwise(wanted))
    per_table = (
        joined.groupBy("path", "layout", "layout_pos", "file_type", "file_pattern", "table_name")
        .agg(
            F.min_by(F.col("missing"), F.struct(F.size("missing"), F.col("pos"))).alias("missing"),
            F.bool_or(F.col("names").isNotNull()).alias("present"),
        )
    )
    per_layout = per_table.groupBy("path", "layout", "layout_pos", "file_type", "file_pattern").agg(
        F.sort_array(F.collect_list(F.when(~F.col("present"), F.col("table_name")))).alias("missing_tables"),
        F.map_from_entries(
            F.collect_list(
                F.when(F.col("present") & (F.size("missing") > 0), F.struct("table_name", F.sort_array("missing")))
            )
        ).alias("missing_columns"),
    )
    report = F.concat_ws(
        "; ",
        F.when(F.size("missing_tables") > 0, F.concat(F.lit("Missing tables: "), F.array_join("missing_tables", ", "))),
        F.array_join(
            F.transform(
                F.map_entries("missing_columns"),
                lambda e: F.concat(F.lit("Missing required columns in "), e["key"], F.lit(": "), F.array_join(e["value"], ", ")),
            ),
            "; ",
        ),
    )
    per_layout = per_layout.join(errors, "path", "left")
    report = F.when(F.col("error").isNotNull(), F.concat(F.lit("can't be read: "), F.col("error"))).otherwise(report)
    return per_layout.select(
        "path",
        "file_type",
        "file_pattern",
        "layout",
        "layout_pos",
        ((F.size("missing_tables") == 0) & (F.size(F.map_keys("missing_columns")) == 0)).alias("valid"),
        "missing_tables",
        "missing_columns",
        report.alias("report"),
    )


def classify(spark: SparkSession, paths: list[str] | str, catalog: Catalog | None = None) -> DataFrame:
    """Per file: detected layout (first valid in catalogue order) or null,
    plus the reports of the failed candidates (F1).  Every file has a row: one
    that no layout's pattern and type fits says so."""
    files = list_files(spark, paths)
    v = validate(spark, files, catalog)
    w = Window.partitionBy("path").orderBy(F.col("valid").desc(), "layout_pos")
    judged = (
        v.withColumn("_rn", F.row_number().over(w))
        .groupBy("path", "file_type")
        .agg(
            F.max(F.when((F.col("_rn") == 1) & F.col("valid"), F.col("layout"))).alias("layout"),
            F.max(F.when((F.col("_rn") == 1) & F.col("valid"), F.col("file_pattern"))).alias("file_pattern"),
            F.sort_array(F.collect_list(F.when(~F.col("valid"), F.concat_ws(": ", "layout", "report")))).alias(
                "failed_candidates"
            ),
        )
    )
    ext = F.lower(F.regexp_extract(F.col("path"), r"\.([^./]+)$", 1))
    none = files.join(judged, "path", "left_anti").select(
        "path",
        _type_of(ext).alias("file_type"),
        F.lit(None).cast("string").alias("layout"),
        F.lit(None).cast("string").alias("file_pattern"),
        F.array(F.lit("no layout describes such a file")).alias("failed_candidates"),
    )
    return judged.unionByName(none)


def detect_layout(spark: SparkSession, paths: list[str], catalog: Catalog | None = None) -> Layout:
    """The single layout all given files follow (driver decision)."""
    catalog = catalog or default_catalog()
    res = classify(spark, paths, catalog).groupBy("layout").agg(F.count(F.lit(1)).alias("n")).collect()
    names = [r["layout"] for r in res]
    if None in names:
        raise ConformanceError("Some files match no known layout")
    if len(names) != 1:
        raise ConformanceError(f"Files follow different layouts: {sorted(names)}")
    return catalog.get_format(names[0])


def required_data_check(df: DataFrame, table, keys: list[str] | None = None) -> DataFrame:
    """Per key group: REQUIRED_WITH_DATA columns that hold no value at all."""
    from glucoflow.sources.catalog import REQUIRED_WITH_DATA

    keys = keys or ["_file"]
    cols = [c.source_name for c in table.columns if c.requirement == REQUIRED_WITH_DATA and c.source_name in df.columns]
    agg = df.groupBy(*keys).agg(*[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(cols)])
    empty = F.array(*[F.when(F.col(f"_n{i}") == 0, F.lit(c)) for i, c in enumerate(cols)]) if cols else F.array()
    return agg.select(*keys, F.filter(empty, lambda x: x.isNotNull()).alias("missing_required_data"))


def folder_verdicts(classified: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Per folder and layout: every file config of the layout has a valid
    file in that folder (multi-file layouts; F2)."""
    catalog = catalog or default_catalog()
    need = {lay.name: len(lay.files) for lay in catalog.formats}
    spark = classified.sparkSession
    needs = spark.createDataFrame(list(need.items()), "layout string, configs int")
    folder = F.regexp_extract(F.col("path"), r"^(.*)/[^/]*$", 1)
    got = (
        classified.where(F.col("layout").isNotNull())
        .groupBy(folder.alias("folder"), "layout")
        .agg(F.count(F.lit(1)).alias("files"), F.count_distinct("file_pattern").alias("configs_found"))
    )
    return got.join(F.broadcast(needs), "layout").select(
        "folder", "layout", "files", (F.col("configs_found") >= F.col("configs")).alias("complete")
    )

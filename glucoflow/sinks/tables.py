"""Exported tables: bounded files in (person, time) order, found through an index.

A table of a run is cut into ranges of (person, time), not into a folder per
person: files follow the bytes of the data, a person with few rows shares a file
with its neighbours, and one with many rows has several.  ``index_of`` says
which file holds which range, so one person's rows are read from few files.

How a table is stored is an :class:`Exporter`; register more with
:func:`register_exporter` (U4).  Spark's own writers do the work, so the folder
may be in any store that Spark can write.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from glucoflow.functions.timeslots import DAY_US

#: a file holds at most so many rows, however large its range
ROWS_PER_FILE = 4_000_000
#: so many partition values (months) of a task have a file open at a time; further ones are sorted
PARTITIONS_AT_ONCE = 48
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
PERSON, TIME, MONTH = "series_id", "ts", "month"

_TIMES = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
#: files are compressed, as a dense grid's text is mostly repeats (read whole by one task anyway: a field may hold line breaks);
#: every text survives: blanks at its ends, quotes, backslashes, line breaks; null differs from empty
_CSV = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", **_TIMES}
#: a day of more slots has its times formatted one by one
_MOST_TIMES = 1440
#: what the CSV reader puts for a quoted empty text
_EMPTY = "\x01"


@dataclass(frozen=True)
class Exporter:
    """A storage format: a Spark data source with the options that make it lossless.

    Subclass it and replace ``save`` and ``load`` for a format of another kind.
    """

    name: str
    source: str
    write_options: dict[str, str] = field(default_factory=dict)
    read_options: dict[str, str] = field(default_factory=dict)

    def save(self, df: DataFrame, path: str, partition_by: Sequence[str] = (), replace_partitions: bool = False) -> None:
        """Write df; with replace_partitions only the partitions that df has are replaced.

        A task keeps a file open for each of a few partition values, instead of
        sorting its rows by them.
        """
        w = df.write.format(self.source).options(**self.write_options).option("maxRecordsPerFile", ROWS_PER_FILE)
        if replace_partitions:
            w = w.option("partitionOverwriteMode", "dynamic")
        if partition_by:
            w = w.partitionBy(*partition_by)
        conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_OPEN_FILES)
        conf.set(_OPEN_FILES, str(PARTITIONS_AT_ONCE))
        try:
            w.mode("overwrite").save(path)
        finally:
            conf.set(_OPEN_FILES, before)

    def load(self, spark: SparkSession, paths: str | list[str], schema: StructType, base: str | None = None) -> DataFrame:
        """What save wrote, or some files of it (base: the table's folder)."""
        r = spark.read.format(self.source).options(**self.read_options).schema(schema)
        if base:
            r = r.option("basePath", base)
        return r.load(paths)

    def times(self, step: int) -> Column | None:
        """The texts of a day's slots, as ``save`` would write them, if it can take a day and such a text for a time (None: times as they are)."""
        return None

    def line_options(self) -> dict[str, str] | None:
        """Options with which Spark writes a column of ready lines as they are, if the format has such (None: it has not)."""
        return None


class CsvExporter(Exporter):
    """CSV where null is nothing and an empty text is ``""``; Spark's reader takes both for null.

    Times are formatted and parsed outside of Spark's CSV writer and reader, which
    take a pattern apart for each.
    """

    def times(self, step: int) -> Column | None:
        if DAY_US // step > _MOST_TIMES or self.write_options.get("timestampNTZFormat") != _TIMES["timestampNTZFormat"]:
            return None
        seconds = [divmod(k * step, 1_000_000) for k in range(DAY_US // step)]
        return F.split(F.lit(",".join(f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}.{us:06d}" for s, us in seconds)), ",")

    def line_options(self) -> dict[str, str] | None:
        other = {k: v for k, v in self.write_options.items() if k not in _CSV}
        if type(self) is not CsvExporter or self.source != "csv" or not _CSV.items() <= self.write_options.items() or set(other) - {"compression"}:
            return None
        # no text has a control character: nothing is ever quoted, taken for a comment or parted
        return {**self.write_options, "quote": "", "escape": "\x03", "comment": "\x02", "sep": "\x01"}

    def load(self, spark: SparkSession, paths: str | list[str], schema: StructType, base: str | None = None) -> DataFrame:
        plain = self.read_options.get("timestampNTZFormat") == _TIMES["timestampNTZFormat"]
        times = {f.name for f in schema.fields if plain and f.dataType.typeName() == "timestamp_ntz"}
        rows = super().load(spark, paths, StructType([StructField(f.name, StringType() if f.name in times else f.dataType) for f in schema.fields]), base)
        rows = rows.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in times}) if times else rows
        texts = {f.name for f in schema.fields if f.dataType.typeName() == "string"}
        return rows.withColumns({c: F.when(F.col(c) != _EMPTY, F.col(c)).when(F.col(c).isNotNull(), "") for c in texts}) if texts else rows


EXPORTERS: dict[str, Exporter] = {}


def register_exporter(exporter: Exporter) -> Exporter:
    EXPORTERS[exporter.name] = exporter
    return exporter


register_exporter(CsvExporter("csv", "csv", {**_CSV, "compression": "gzip"}, {**_CSV, "multiLine": "true", "emptyValue": _EMPTY}))
register_exporter(CsvExporter("plain_csv", "csv", _CSV, {**_CSV, "multiLine": "true", "emptyValue": _EMPTY}))
register_exporter(Exporter("json", "json", {"ignoreNullFields": "false", **_TIMES}, _TIMES))
register_exporter(Exporter("parquet", "parquet"))
register_exporter(Exporter("orc", "orc"))


def exporter_of(fmt: str | Exporter) -> Exporter:
    if isinstance(fmt, Exporter):
        return fmt
    if fmt not in EXPORTERS:
        raise ValueError(f"No exporter named {fmt!r}; there are {', '.join(sorted(EXPORTERS))}")
    return EXPORTERS[fmt]


def clustered(df: DataFrame, *first: str) -> DataFrame:
    """df in ranges of (first, person, time), sorted; AQE joins small ranges up to its target size."""
    keys = [*first, PERSON, TIME]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def index_of(cells: DataFrame) -> DataFrame:
    """Range of persons and times, and rows, of every file; cells are counts by (file, person, month)."""
    return cells.groupBy("file").agg(
        F.min(PERSON).alias("first_series"),
        F.max(PERSON).alias("last_series"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("record_count").alias("record_count"),
    )


def person_files(index: DataFrame, persons: Sequence[str]) -> list[str]:
    """The files whose ranges hold any of the given persons."""
    hit = F.lit(False)
    for p in persons:
        hit = hit | F.lit(p).between(F.col("first_series"), F.col("last_series"))
    return [r["file"] for r in index.where(hit).select("file").orderBy("file").collect()]


# ------------------------------------------------------------------ folders
def _folder(spark: SparkSession, path: str):
    """Hadoop file system and path object of a folder, whatever the store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this run has made."""
    fs, p = _folder(spark, path)
    fs.delete(p, True)

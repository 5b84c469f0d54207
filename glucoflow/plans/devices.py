"""Device streams derived from the shared ``events`` table.

The driver's test tables hold generic events; these rules turn them into
diabetes-device readings so every query reads the given tables and its work
grows with them.  ``series_id`` is the person (``user_id``).

=============  ==============================================  ========
data type      rule                                            unit
=============  ==============================================  ========
CGM            ``view`` events, ``40 + 3 * value``             mg/dL
BGM            ``click`` events, ``value / 5``                 mmol/L
INSULIN        ``purchase`` events, ``value / 10``             U
INSULIN_META   ``purchase``: JSON list naming an insulin,      -
               chosen by ``props.k % 3``
CARBS          ``signup`` events, ``value - 5``                g
NOTES          ``error`` events, text from ``props`` padded    -
               with blanks/tabs; every tenth one blank
=============  ==============================================  ========

The sensor variant (``sensor_events``) treats each event type as one dense
glucose sensor; it exercises interpolation, where per-person streams are too
sparse to have short gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glucoflow.operators.events import EVENTS_LONG_COLUMNS

# insulin names written into the metadata JSON, indexed by props.k % 3
META_NAMES = ["NovoRapid FlexPen", "Levemir", "Humalog"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def _long(
    df: DataFrame,
    series: Column,
    data_type: str,
    column_name: str,
    unit: str | None,
    value: Column | None = None,
    text: Column | None = None,
) -> DataFrame:
    return df.select(
        series.cast("string").alias("series_id"),
        F.col("ts"),
        F.col("event_id").alias("_seq"),
        F.lit(data_type).alias("data_type"),
        F.lit(column_name).alias("column_name"),
        F.lit(column_name.endswith("_primary")).alias("is_primary"),
        F.lit(unit).cast("string").alias("unit"),
        (value if value is not None else F.lit(None)).cast("double").alias("value"),
        (text if text is not None else F.lit(None)).cast("string").alias("text"),
        F.lit("events").alias("source_table"),
    )


def meta_json(props: Column) -> Column:
    """``[{"insulin": "<name>"}]`` with the name picked by ``props.k % 3``."""
    names = F.array(*[F.lit(n) for n in META_NAMES])
    name = F.element_at(names, (F.pmod(_k(props), F.lit(3)) + 1).cast("int"))
    return F.to_json(F.array(F.struct(name.alias("insulin"))))


def note_text(props: Column) -> Column:
    """Note text with surrounding blanks and tabs; every tenth one is blank."""
    k = _k(props)
    return F.when(F.pmod(k, F.lit(10)) == 0, F.lit(" \t ")).otherwise(
        F.concat(F.lit("\t "), F.lit("note "), k.cast("string"), F.lit("  "))
    )


def device_events(events: DataFrame, series: Column | None = None) -> DataFrame:
    """``events_long`` rows for all five data types plus insulin metadata.

    A union of one projection per type: a consumer that filters on
    ``data_type`` keeps only its branch, so its scan reads only the columns
    it needs with ``event_type`` pushed into the Parquet reader.
    """
    s = series if series is not None else F.col("user_id")
    et = F.col("event_type")
    v = F.col("value")
    parts = [
        _long(events.where(et == "view"), s, "CGM", "cgm_primary", "mg/dL", F.lit(40.0) + v * 3),
        _long(events.where(et == "click"), s, "BGM", "bgm_primary", "mmol/L", v / 5),
        _long(events.where(et == "purchase"), s, "INSULIN", "dose", "U", v / 10),
        _long(events.where(et == "purchase"), s, "INSULIN_META", "insulin_meta", None, text=meta_json(F.col("props"))),
        _long(events.where(et == "signup"), s, "CARBS", "carbs_primary", "g", v - 5),
        _long(events.where(et == "error"), s, "NOTES", "notes_primary", None, text=note_text(F.col("props"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*EVENTS_LONG_COLUMNS)


def sensor_events(events: DataFrame) -> DataFrame:
    """Every event as a CGM reading of the sensor named by its event type."""
    return _long(events, F.col("event_type"), "CGM", "cgm_primary", "mg/dL", F.lit(40.0) + F.col("value") * 3)


def two_column_cgm(events: DataFrame) -> DataFrame:
    """CGM with a secondary column: ``view`` in mg/dL, ``click`` as mmol/L."""
    et = F.col("event_type")
    s = F.col("user_id")
    return _long(events.where(et == "view"), s, "CGM", "cgm_primary", "mg/dL", F.lit(40.0) + F.col("value") * 3).unionByName(
        _long(events.where(et == "click"), s, "CGM", "cgm_2", "mmol/L", F.col("value") / 5)
    )

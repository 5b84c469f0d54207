"""The canonical long event table and conversions from wide source tables.

``events_long`` holds one row per (reading, source column)::

    series_id string, ts timestamp_ntz, _seq bigint, data_type string,
    column_name string, is_primary boolean, unit string, value double,
    text string, source_table string

Wide per-type tables come back out of it with conditional aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from glucoflow.functions.numbers import finite, to_number

TEXT_TYPES = ("NOTES", "INSULIN_META")

EVENTS_LONG_COLUMNS = [
    "series_id",
    "ts",
    "_seq",
    "data_type",
    "column_name",
    "is_primary",
    "unit",
    "value",
    "text",
    "source_table",
]


@dataclass(frozen=True)
class ColumnSpec:
    """One source column routed into the long table."""

    source: str
    data_type: str
    column_name: str
    is_primary: bool
    unit: str | None


def standard_column_name(data_type: str, is_primary: bool, index: int) -> str:
    """``<type>_primary`` for the primary, ``<type>_<index + 1>`` otherwise.

    ``index`` is the position in a primary-first order, so the first
    secondary column is ``<type>_2``.
    """
    base = data_type.lower()
    return f"{base}_primary" if is_primary else f"{base}_{index + 1}"


def name_columns(specs: list[tuple[str, str, bool, str | None]]) -> list[ColumnSpec]:
    """Give standard names to ``(source, data_type, is_primary, unit)`` tuples.

    Metadata columns are grouped with insulin.  Within a type the primary
    comes first and the rest keep their order.  A second primary of the same
    type (from another table) is demoted to a secondary.
    """
    out: list[ColumnSpec] = []
    by_type: dict[str, list[tuple[str, str, bool, str | None]]] = {}
    for spec in specs:
        by_type.setdefault(spec[1], []).append(spec)
    for data_type, cols in by_type.items():
        ordered = sorted(cols, key=lambda c: not c[2])  # stable: primary first
        seen_primary = False
        for i, (src, dt, prim, unit) in enumerate(ordered):
            prim = prim and not seen_primary
            seen_primary = seen_primary or prim
            out.append(ColumnSpec(src, dt, standard_column_name(dt, prim, i), prim, unit))
    return out


def to_long(
    wide: DataFrame,
    columns: list[ColumnSpec],
    series: Column | str,
    ts: Column | str,
    seq: Column | str,
    source_table: str = "",
) -> DataFrame:
    """Unpivot a wide source table into ``events_long`` rows.

    One ``explode`` of an array of structs: a single pass, no shuffle.  Text
    becomes a number by ``to_number``; NaN and infinities are null everywhere.
    Rows whose value and text are both null are dropped, except for CGM:
    every row of a table with a CGM column widens the CGM grid span, as in the
    original pipeline, so those rows are kept with a null value.
    """
    sc = F.col(series) if isinstance(series, str) else series
    tc = F.col(ts) if isinstance(ts, str) else ts
    qc = F.col(seq) if isinstance(seq, str) else seq
    kinds = dict(wide.dtypes)
    items = []
    for c in columns:
        src = F.col(f"`{c.source}`")
        if c.data_type in TEXT_TYPES:
            value, text = F.lit(None).cast("double"), src.cast("string")
        else:
            value, text = (to_number(src) if kinds[c.source] == "string" else finite(src.cast("double"))), F.lit(None).cast("string")
        items.append(
            F.struct(
                F.lit(c.data_type).alias("data_type"),
                F.lit(c.column_name).alias("column_name"),
                F.lit(c.is_primary).alias("is_primary"),
                F.lit(c.unit).cast("string").alias("unit"),
                value.alias("value"),
                text.alias("text"),
            )
        )
    return (
        wide.select(
            sc.cast("string").alias("series_id"),
            tc.cast(TimestampNTZType()).alias("ts"),
            qc.cast("bigint").alias("_seq"),
            F.explode(F.array(*items)).alias("_e"),
        )
        .select("series_id", "ts", "_seq", "_e.*", F.lit(source_table).alias("source_table"))
        .where(
            F.col("value").isNotNull()
            | F.col("text").isNotNull()
            | (F.col("data_type") == F.lit("CGM"))
        )
    )

"""End-to-end: export files -> layout -> events -> cleaned types -> aligned -> sinks.

``process`` routes the long event table to the five cleaners (M2): a type
whose plan cannot be built (no primary column, bad parameters) is noted
and skipped; data problems never abort the run, they become metrics.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glucoflow.functions import glucose as G
from glucoflow.operators import align as A
from glucoflow.operators import clean as C
from glucoflow.sources import conform
from glucoflow.sources.catalog import Catalog, Layout, default_catalog
from glucoflow.sources.readers import layout_headers, layout_specs, read_tables, rejected_files, to_events

# Processors per data type; register more with ``register_processor``
PROCESSORS: dict[str, object] = {}


def register_processor(data_type: str):
    def deco(fn):
        PROCESSORS[data_type] = fn
        return fn

    return deco


@register_processor("CGM")
def _cgm(events, cols, p):
    return C.cgm(events, cols.get("CGM"), interpolation_limit=p["interpolation_limit"], fill_tail=p["fill_tail"])


@register_processor("BGM")
def _bgm(events, cols, p):
    return C.bgm(events, cols.get("BGM"))


@register_processor("INSULIN")
def _insulin(events, cols, p):
    has_primary = any(n == "dose" or prim for n, prim in cols.get("INSULIN_PRIMARY", [("dose", True)]))
    return C.insulin(events, p["bolus_limit"], p["max_dose"], has_primary=has_primary)


@register_processor("CARBS")
def _carbs(events, cols, p):
    return C.carbs(events, [n for n, _ in cols.get("CARBS", [("carbs_primary", G.GRAMS)])])


@register_processor("NOTES")
def _notes(events, cols, p):
    return C.notes(events, [n for n, _ in cols.get("NOTES", [("notes_primary", None)])])


@dataclass
class Run:
    events: DataFrame
    processed: dict[str, C.Processed]
    notes: list[str] = field(default_factory=list)
    quarantine: DataFrame | None = None
    rejected: DataFrame | None = None
    #: required columns without a single value, by file
    missing: DataFrame | None = None


def columns_of(layout: Layout) -> dict[str, list[tuple[str, str | None]]]:
    """Output column names (primary first) and source units per data type."""
    cols: dict[str, list[tuple[str, str | None]]] = {}
    for spec in layout_specs(layout).values():
        dt = "INSULIN" if spec.data_type == "INSULIN_META" else spec.data_type
        if spec.data_type == "INSULIN":
            # every dose column feeds the one ``dose`` column (no overwrite)
            cols.setdefault("INSULIN_PRIMARY", []).append((spec.column_name, spec.is_primary))
            cols["INSULIN"] = [("dose", spec.unit)]
            continue
        if spec.data_type == "INSULIN_META":
            continue
        cols.setdefault(dt, []).append((spec.column_name, spec.unit))
    for k in cols:
        cols[k].sort(key=lambda x: not str(x[0]).endswith("_primary"))
    return cols


def process(
    events: DataFrame,
    columns: dict[str, list] | None = None,
    types: list[str] | None = None,
    interpolation_limit: int = G.DEFAULT_INTERPOLATION_LIMIT,
    bolus_limit: float = G.DEFAULT_BOLUS_LIMIT,
    max_dose: float = G.DEFAULT_MAX_DOSE,
    fill_tail: bool = True,
) -> tuple[dict[str, C.Processed], list[str]]:
    """Run every available cleaner over ``events_long``."""
    columns = columns or {}
    params = dict(interpolation_limit=interpolation_limit, bolus_limit=bolus_limit, max_dose=max_dose, fill_tail=fill_tail)
    out: dict[str, C.Processed] = {}
    notes: list[str] = []
    for t in types or [t for t in ("CGM", "BGM", "INSULIN", "CARBS", "NOTES") if t in columns or not columns]:
        try:
            out[t] = PROCESSORS[t](events, columns, params)
        except C.ProcessingError as e:
            notes.append(f"Error processing {t}: {e}")
    return out, notes


def process_path(
    spark: SparkSession,
    paths: list[str],
    layout: Layout | str | None = None,
    catalog: Catalog | None = None,
    persist: bool = True,
    series=None,
    **params,
) -> Run:
    """Detect (unless given), read, convert and clean a set of export files.

    ``series``: person key of a row, by default the file's name; files of the
    same name in several folders need a key made from the path (column
    ``_file``), see ``readers.series_from_path``.
    """
    catalog = catalog or default_catalog()
    if isinstance(layout, str):
        layout = catalog.get_format(layout)
    if layout is None:
        layout = conform.detect_layout(spark, paths, catalog)
    specs = layout_specs(layout)
    longs, bads, missing = [], [], []
    headers = layout_headers(spark, layout, paths)
    for _, (tb, df) in read_tables(spark, layout, paths, headers).items():
        long, bad = to_events(df, tb, specs, series)
        longs.append(long)
        bads.append(bad)
        check = conform.required_data_check(df, tb).where(F.size("missing_required_data") > 0)
        missing.append(check.select(F.lit(tb.name).alias("table_name"), "_file", "missing_required_data"))
    if not longs:
        raise conform.ConformanceError(f"No readable tables of layout {layout.name} in the given paths")
    events = longs[0]
    for x in longs[1:]:
        events = events.unionByName(x)
    quarantine = bads[0]
    for x in bads[1:]:
        quarantine = quarantine.unionByName(x)
    if persist:
        # five cleaners read the same long table; keep it instead of re-parsing
        events = events.persist(StorageLevel.MEMORY_AND_DISK)
    processed, notes = process(events, columns_of(layout), **params)
    # Units that are not legal for their data type are reported
    notes = [*layout.unit_problems(), *notes]
    return Run(events, processed, notes, quarantine, rejected_files(spark, layout, paths, headers), reduce(DataFrame.unionByName, missing))


def run(spark: SparkSession, paths: list[str], out_dir: str, layout=None, freq: str = "5min", fmt: str = "plain_csv", **params):
    """Command-line equivalent: process, align (if CGM present), write (by default as CSV files that any program opens)."""
    from glucoflow.sinks import export

    r = process_path(spark, paths, layout, **params)
    aligned = None
    if "CGM" in r.processed:
        try:
            aligned = A.align(r.processed, freq=freq)
            aligned.notes.extend(A.collect_notes(r.processed))
        except A.AlignmentError as e:
            r.notes.append(f"Alignment failed: {e}")
    from glucoflow.operators.quality import data_notes

    notes = data_notes(r.events, r.processed, params.get("bolus_limit", G.DEFAULT_BOLUS_LIMIT), params.get("max_dose", G.DEFAULT_MAX_DOSE))
    written = export.write(spark, r.processed, aligned, out_dir, fmt=fmt, data_notes=notes)
    # what did not make it into the results is written beside them
    rejects = aligned.rejects if aligned is not None else None
    for name, left in (("quarantine", r.quarantine), ("rejected_files", r.rejected), ("missing_required_data", r.missing), ("rejected_timelines", rejects)):
        if left is not None:
            written[name] = f"{written.get('base', out_dir)}/{name}"
            left.write.mode("overwrite").json(written[name])
    if r.events.is_cached:
        r.events.unpersist()
    return r, aligned, written

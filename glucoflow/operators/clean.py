"""Per-type cleaning: CGM, BGM, insulin, carbohydrates and notes.

Each cleaner takes the long event table (``events_long``) and returns a
:class:`Processed` with a wide DataFrame keyed by ``series_id``.  Column
lists (``cgm_primary``, ``cgm_2`` ...) are plan-time facts that come from the
catalogue, never from the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoflow.functions import glucose as G
from glucoflow.functions.numbers import finite
from glucoflow.functions.text import INSULIN_NAMES, clean_note, insulin_name_from_json
from glucoflow.functions.timeslots import DAY_US, freq_to_micros, slot_of, slot_to_ts
from glucoflow.operators.fill import DEFAULT_BLOCK_SLOTS, wide_grid


class ProcessingError(Exception):
    """A data type cannot be processed (plan-time problem)."""


@dataclass
class Processed:
    """Result of one cleaner: wide frame, units of its columns, run notes."""

    data_type: str
    frame: DataFrame
    units: dict[str, str] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    value_columns: list[str] = field(default_factory=list)
    # CGM: emits the grid with the per-slot columns of other types on it
    with_columns: Callable[..., DataFrame] | None = None
    step: int | None = None
    # CGM: the same rows as frame, in ranges of (person, time), for sinks
    in_ranges: Callable[[], DataFrame] | None = None
    # CGM: those ranges with equal rows in a row as one; ``_slots`` counts them, ``ts`` is the first, none passes a day
    runs: Callable[[], DataFrame] | None = None


def _of_type(events: DataFrame, *types: str) -> DataFrame:
    """Rows of the types; a NaN or infinite value counts as missing (it would sort above every reading)."""
    return events.where(F.col("data_type").isin(*types)).withColumn("value", finite(F.col("value")))


def _require_primary(columns: list[tuple[str, str]], label: str) -> None:
    if not any(name.endswith("_primary") for name, _ in columns):
        raise ProcessingError(f"{label}: none of the columns is the primary one")


# --------------------------------------------------------------------- CGM
def cgm_slots(events: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """Slot means per column (T9 + A1) and the grid span of each series."""
    r = _of_type(events, "CGM").select(
        "series_id",
        "column_name",
        slot_of("ts", step).alias("slot"),
        G.to_mgdl(F.col("value"), F.col("unit")).alias("v"),
    )
    # every CGM row counts for the span, even with a null value
    span = r.groupBy("series_id").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    obs = r.where(F.col("v").isNotNull()).groupBy("series_id", "column_name", "slot").agg(F.avg("v").alias("v"))
    return obs, span


def cgm_slot_means(events: DataFrame, step: int, names: list[str]) -> DataFrame:
    """One row per observed slot, the mean of every column in it (A1).

    A single aggregation (partial per map task, then one shuffle); a column
    without readings in the slot is null.
    """
    # rows without a value still widen the grid: they stay as all-null slots
    r = _of_type(events, "CGM").select(
        "series_id",
        "column_name",
        slot_of("ts", step).alias("slot"),
        G.to_mgdl(F.col("value"), F.col("unit")).alias("v"),
    )
    return r.groupBy("series_id", "slot").agg(
        *[F.avg(F.when(F.col("column_name") == n, F.col("v"))).alias(n) for n in names]
    )


def cgm(
    events: DataFrame,
    columns: list[tuple[str, str]] | None = None,
    interpolation_limit: int = G.DEFAULT_INTERPOLATION_LIMIT,
    freq: str = "5min",
    fill_tail: bool = True,
    block_slots: int = DEFAULT_BLOCK_SLOTS,
    keep_slot: bool = False,
) -> Processed:
    """CGM pipeline: mg/dL, slot means, regular grid, limited fill, clip, mmol.

    ``columns``: ``[(column_name, source_unit)]`` primary first.
    Output: ``series_id, ts, cgm_primary, cgm_2.., cgm_primary_mmol, ..,
    missing`` - one row per grid slot of each series.
    """
    columns = columns or [("cgm_primary", G.MGDL)]
    _require_primary(columns, "CGM")
    if interpolation_limit is None or interpolation_limit < 0:
        raise ProcessingError("interpolation limit must be >= 0")
    step = freq_to_micros(freq)
    names = [c for c, _ in columns]
    primary = names[0]
    obs_wide = cgm_slot_means(events, step, names)

    def finished(grid: DataFrame, more: list[str]) -> DataFrame:
        wide = grid.select("series_id", "slot", *names, (~F.col(f"{primary}__obs")).alias("missing"), *more)
        return wide.select(
            "series_id",
            "slot",
            slot_to_ts("slot", step).alias("ts"),
            *[G.clip_glucose(F.col(n)).alias(n) for n in names],
            "missing",
            *more,
        ).select(
            "series_id",
            "slot",
            "ts",
            *names,
            *[G.to_mmol(F.col(n)).alias(f"{n}_mmol") for n in names],
            "missing",
            *more,
        )

    def with_columns(per_slot: DataFrame, carried: list[str], spans: dict[str, str], in_ranges: bool = False, runs: bool = False) -> DataFrame:
        """The grid with columns of ``per_slot(series_id, slot, ..)`` on their
        slots: both meet as sparse rows, so the grid is emitted once, complete.
        """
        both = obs_wide.withColumn("_grid", F.lit(True)).unionByName(per_slot.withColumn("_grid", F.lit(False)), allowMissingColumns=True)
        own, other = [*names], [c for c in per_slot.columns if c not in ("series_id", "slot")]
        # at most one row of each kind per slot
        one = both.groupBy("series_id", "slot").agg(
            *[F.max(F.when(F.col("_grid"), F.col(c))).alias(c) for c in own],
            *[F.max(F.when(~F.col("_grid"), F.col(c))).alias(c) for c in other],
            F.bool_or("_grid").alias("_grid"),
        )
        grid = wide_grid(one, names, interpolation_limit, fill_tail, block_slots, carried, spans, in_ranges, DAY_US // step if runs else None)
        return finished(grid, [*carried, *spans, *(["_slots"] if runs else [])])

    def grid(in_ranges: bool, runs: bool = False) -> DataFrame:
        dense = wide_grid(obs_wide, names, interpolation_limit, fill_tail, block_slots, in_ranges=in_ranges, runs_of=DAY_US // step if runs else None)
        out = finished(dense, ["_slots"] if runs else [])
        return out if keep_slot else out.drop("slot")

    units = {}
    for n, _ in columns:
        units[n] = G.MGDL
        units[f"{n}_mmol"] = G.MMOL
    notes = [f"CGM column {i + 1}: {G.MMOL} times {G.MMOL_TO_MGDL} is {G.MGDL}" for i, (_, u) in enumerate(columns) if u == G.MMOL]
    return Processed("CGM", grid(False), units, notes, names, with_columns, step, lambda: grid(True), None if keep_slot else lambda: grid(True, True))


def cgm_completeness(cgm_frame: DataFrame) -> DataFrame:
    """Per series: grid slots, missing before and after fill, percentages."""
    return cgm_frame.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("total_readings"),
        F.count_if(F.col("missing")).alias("missing_primary"),
        F.count_if(F.col("cgm_primary").isNull()).alias("missing_after_fill"),
        F.round(100 * F.count_if(~F.col("missing")) / F.count(F.lit(1)), 2).alias("initial_completeness_pct"),
        F.round(100 * F.count("cgm_primary") / F.count(F.lit(1)), 2).alias("completeness_after_fill_pct"),
    )


# --------------------------------------------------------------------- BGM
def bgm(events: DataFrame, columns: list[tuple[str, str]] | None = None) -> Processed:
    """BGM pipeline: drop values <= 0, mg/dL, clip flag, clip, last per time, mmol.

    Output: ``series_id, ts, bgm_primary, bgm_primary_clipped, bgm_2, ..,
    bgm_primary_mmol, ..`` - one row per distinct reading time.
    """
    columns = columns or [("bgm_primary", G.MGDL)]
    _require_primary(columns, "BGM")
    names = [c for c, _ in columns]
    r = _of_type(events, "BGM").where(F.col("value") > 0).withColumn(
        "v", G.to_mgdl(F.col("value"), F.col("unit"))
    )
    r = r.select(
        "series_id",
        "ts",
        "_seq",
        "column_name",
        G.clip_glucose(F.col("v")).alias("v"),
        G.out_of_range(F.col("v")).alias("clipped"),
    )
    if len(names) == 1:
        # keep the last valid reading per exact time
        # primitive max_by per field (same row: _seq is unique) keeps hash aggregation
        wide = r.groupBy("series_id", "ts").agg(
            F.max_by("v", "_seq").alias(names[0]),
            F.max_by("clipped", "_seq").alias(f"{names[0]}_clipped"),
        )
    else:
        per_col = r.groupBy("series_id", "ts", "column_name").agg(
            F.max_by("v", "_seq").alias("v"), F.max_by("clipped", "_seq").alias("clipped")
        )
        aggs = []
        for n in names:
            aggs.append(F.max(F.when(F.col("column_name") == n, F.col("v"))).alias(n))
            aggs.append(F.max(F.when(F.col("column_name") == n, F.col("clipped"))).alias(f"{n}_clipped"))
        wide = per_col.groupBy("series_id", "ts").agg(*aggs)
    out = wide.select(
        "series_id",
        "ts",
        *[c for n in names for c in (n, f"{n}_clipped")],
        *[G.to_mmol(F.col(n)).alias(f"{n}_mmol") for n in names],
    )
    units = {n: G.MGDL for n in names} | {f"{n}_mmol": G.MMOL for n in names}
    return Processed("BGM", out, units, [], names)


def bgm_stats(events: DataFrame) -> DataFrame:
    """Per series: removed, clipped below/above, kept readings and daily rate."""
    r = _of_type(events, "BGM").withColumn("v", G.to_mgdl(F.col("value"), F.col("unit")))
    valid = F.col("value") > 0
    kept = r.where(valid).groupBy("series_id", "ts").agg(F.lit(1).alias("one"))
    per_time = kept.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("readings"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    span_days = (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / F.lit(86_400e6)
    counts = r.groupBy("series_id").agg(
        F.count_if(~F.coalesce(valid, F.lit(False))).alias("removed_invalid"),
        F.count_if(valid & (F.col("v") < F.lit(G.GLUCOSE_MIN_MGDL))).alias("clipped_below"),
        F.count_if(valid & (F.col("v") > F.lit(G.GLUCOSE_MAX_MGDL))).alias("clipped_above"),
    )
    return counts.join(per_time, "series_id", "left").select(
        "series_id",
        "removed_invalid",
        "clipped_below",
        "clipped_above",
        (F.col("clipped_below") + F.col("clipped_above")).alias("clipped_total"),
        F.coalesce(F.col("readings"), F.lit(0)).alias("readings"),
        # a single reading spans zero days: rate undefined (null), not an error
        F.round(F.col("readings") / F.when(span_days > 0, span_days), 6).alias("readings_per_day"),
    )


# ----------------------------------------------------------------- insulin
def insulin(
    events: DataFrame,
    bolus_limit: float = G.DEFAULT_BOLUS_LIMIT,
    max_dose: float = G.DEFAULT_MAX_DOSE,
    has_primary: bool = True,
    use_metadata: bool = True,
) -> Processed:
    """Insulin pipeline: positive doses, class by size, then metadata overrides.

    Every positive dose of every dose column is a row (no column overwrites
    another).  Metadata rows at the same ``(series_id, ts)`` as doses set the
    class and ``type`` of all those doses; the last recognised one wins.
    Doses above ``max_dose`` stay with both flags false.

    Output: ``series_id, ts, dose, is_bolus, is_basal, type``.
    """
    if not has_primary:
        raise ProcessingError("INSULIN: none of the dose columns is the primary one")
    doses = (
        _of_type(events, "INSULIN")
        .where(F.col("value") > 0)
        .select(
            "series_id",
            "ts",
            "_seq",
            F.col("value").alias("dose"),
            G.is_bolus(F.col("value"), bolus_limit).alias("is_bolus"),
            G.is_basal(F.col("value"), bolus_limit, max_dose).alias("is_basal"),
        )
    )
    if not use_metadata:
        out = doses.select("series_id", "ts", "dose", "is_bolus", "is_basal", F.lit("").alias("type"))
        return Processed("INSULIN", out, {"dose": G.UNITS}, [], ["dose"])
    # the last recognised row per time wins
    meta = _recognised(events).groupBy("series_id", "ts").agg(F.max_by(F.col("code"), F.col("_seq")).alias("code"))
    joined = doses.join(meta, ["series_id", "ts"], "left")

    def pick(field: int, default):
        out = default
        for i, entry in enumerate(INSULIN_NAMES):
            out = F.when(F.col("code") == i, F.lit(entry[field])).otherwise(out)
        return out

    out = joined.select(
        "series_id",
        "ts",
        "dose",
        pick(1, F.col("is_bolus")).alias("is_bolus"),
        pick(2, F.col("is_basal")).alias("is_basal"),
        pick(0, F.lit("")).alias("type"),
    )
    return Processed("INSULIN", out, {"dose": G.UNITS}, [], ["dose"])


def _recognised(events: DataFrame) -> DataFrame:
    """Metadata rows that name a known insulin: ``series_id, ts, _seq, code``.

    The code is the name's position in the lookup (an int keeps aggregations
    hash based).
    """
    name = insulin_name_from_json(F.col("text"))
    code = F.lit(None).cast("int")
    for i, (key, _, _) in reversed(list(enumerate(INSULIN_NAMES))):
        code = F.when(name.contains(key), F.lit(i)).otherwise(code)
    return _of_type(events, "INSULIN_META").select("series_id", "ts", "_seq", code.alias("code")).where(F.col("code").isNotNull())


def insulin_stats(events: DataFrame, bolus_limit: float = G.DEFAULT_BOLUS_LIMIT, max_dose: float = G.DEFAULT_MAX_DOSE) -> DataFrame:
    """Per series: doses, bolus and basal by size (before metadata), over the
    maximum, and the recognised metadata rows at the time of a dose."""
    dose = F.col("value")
    doses = _of_type(events, "INSULIN").where(dose > 0)
    counts = doses.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("doses"),
        F.count_if(G.is_bolus(dose, bolus_limit)).alias("bolus"),
        F.count_if(G.is_basal(dose, bolus_limit, max_dose)).alias("basal"),
        F.count_if(dose > F.lit(max_dose)).alias("count_over_max"),
    )
    updates = _recognised(events).join(doses.select("series_id", "ts"), ["series_id", "ts"], "left_semi")
    updates = updates.groupBy("series_id").agg(F.count(F.lit(1)).alias("meta_updates"))
    return counts.join(updates, "series_id", "left").withColumn("meta_updates", F.coalesce("meta_updates", F.lit(0).cast("bigint")))


# ------------------------------------------------------------------- carbs
def carbs(events: DataFrame, columns: list[str] | None = None) -> Processed:
    """Carbs pipeline: entries below 1 g become null, empty rows go, first per time.

    Output: ``series_id, ts, carbs_primary, carbs_2..``.
    """
    names = columns or ["carbs_primary"]
    if not any(n.endswith("_primary") for n in names):
        raise ProcessingError("CARBS: none of the columns is the primary one")
    r = (
        _of_type(events, "CARBS")
        .select("series_id", "ts", "_seq", "column_name", G.carbs_kept(F.col("value")).alias("v"))
        .where(F.col("v").isNotNull())
    )
    if len(names) == 1:
        first = r.groupBy("series_id", "ts").agg(F.min_by(F.col("v"), F.col("_seq")).alias(names[0]))
        out = first
    else:
        rows = r.groupBy("series_id", "ts", "_seq").agg(
            *[F.max(F.when(F.col("column_name") == n, F.col("v"))).alias(n) for n in names]
        )
        out = rows.groupBy("series_id", "ts").agg(
            F.min_by(F.struct(*names), F.col("_seq")).alias("x")
        ).select("series_id", "ts", *[F.col(f"x.{n}").alias(n) for n in names])
    return Processed("CARBS", out.select("series_id", "ts", *names), {n: G.GRAMS for n in names}, [], names)


def carbs_stats(events: DataFrame) -> DataFrame:
    """Per series: original entries, kept (>= 1 g), duplicate times removed, final."""
    r = _of_type(events, "CARBS").withColumn("v", G.carbs_kept(F.col("value")))
    kept = r.where(F.col("v").isNotNull())
    times = kept.groupBy("series_id").agg(F.count_distinct("ts").alias("final_entries"))
    base = r.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("original_entries"),
        F.count("v").alias("kept_entries"),
    )
    return base.join(times, "series_id", "left").select(
        "series_id",
        "original_entries",
        "kept_entries",
        F.round(100 * F.col("kept_entries") / F.col("original_entries"), 1).alias("kept_pct"),
        (F.col("kept_entries") - F.coalesce(F.col("final_entries"), F.lit(0))).alias("duplicates_removed"),
        F.coalesce(F.col("final_entries"), F.lit(0)).alias("final_entries"),
    )


# ------------------------------------------------------------------- notes
def notes(events: DataFrame, columns: list[str] | None = None) -> Processed:
    """Notes pipeline: strip, empty to null, drop empty rows; duplicates stay.

    Output: ``series_id, ts, notes_primary, notes_2..`` plus ``_seq``.
    """
    names = columns or ["notes_primary"]
    if not any(n.endswith("_primary") for n in names):
        raise ProcessingError("NOTES: none of the columns is the primary one")
    r = (
        _of_type(events, "NOTES")
        .select("series_id", "ts", "_seq", "column_name", clean_note(F.col("text")).alias("note"))
        .where(F.col("note").isNotNull())
    )
    if len(names) == 1:
        out = r.select("series_id", "ts", F.col("note").alias(names[0]), "_seq")
    else:
        out = r.groupBy("series_id", "ts", "_seq").agg(
            *[F.max(F.when(F.col("column_name") == n, F.col("note"))).alias(n) for n in names]
        ).select("series_id", "ts", *names, "_seq")
    return Processed("NOTES", out, {}, [], names)

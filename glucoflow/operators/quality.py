"""Quality metrics over processed and aligned frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_completeness(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Per key group and column: ``round(100 * non-null / rows, 2)`` (A10).

    Aggregates first (one row per group), then unpivots the small result.
    """
    keys = keys or ["series_id"]
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(f"_n_{c}") for c in columns]
    )
    items = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"_n_{c}").alias("n")) for c in columns]
    )
    return agg.select(*keys, "_rows", F.explode(items).alias("_c")).select(
        *keys,
        F.col("_c.column_name").alias("column_name"),
        F.round(100.0 * F.col("_c.n") / F.col("_rows"), 2).alias("completeness_pct"),
    )


def period_stats(aligned: DataFrame, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Per person and calendar month, the statistics of the monthly notes
    (A9, A13-A15) computed on the aligned frame:

    CGM slots, missing and completeness before / after fill; BGM readings,
    clipped count and share; basal / bolus / total doses (slots with a dose
    > 0); carb entries (> 0); notes.
    """
    keys = keys or ["series_id"]
    cols = set(aligned.columns)
    total = F.count(F.lit(1))
    aggs = [total.alias("records")]
    if "cgm_primary" in cols:
        miss = F.count_if(F.col("missing_cgm")) if "missing_cgm" in cols else F.lit(0)
        aggs += [
            miss.alias("cgm_missing"),
            F.round(100.0 * (total - miss) / total, 2).alias("cgm_initial_pct"),
            F.round(100.0 * F.count("cgm_primary") / total, 2).alias("cgm_after_fill_pct"),
        ]
    if "bgm_primary" in cols:
        n = F.count("bgm_primary")
        clipped = F.count_if(F.col("bgm_primary_clipped"))
        aggs += [
            n.alias("bgm_readings"),
            clipped.alias("bgm_clipped"),
            F.when(n > 0, F.round(100.0 * clipped / n, 1)).otherwise(F.lit(0.0)).alias("bgm_clipped_pct"),
        ]
    if "basal_dose" in cols:
        basal = F.count_if(F.col("basal_dose") > 0)
        bolus = F.count_if(F.col("bolus_dose") > 0)
        aggs += [(basal + bolus).alias("insulin_doses"), basal.alias("basal_doses"), bolus.alias("bolus_doses")]
    if "carbs_primary" in cols:
        aggs.append(F.count_if(F.col("carbs_primary") > 0).alias("carb_entries"))
    if "notes_primary" in cols:
        aggs.append(F.count("notes_primary").alias("notes"))
    return aligned.groupBy(*keys, F.date_format(ts, "yyyy-MM").alias("month")).agg(*aggs)


# The text of the per-type processing notes, as in the original
# run notes (placeholders filled per person by Spark's format_string).
NOTE_FORMATS = {
    "CGM": [
        "Processed %d total CGM readings",
        "Found %d missing or interpolated values in primary data",
        "Found %d missing values after interpolation",
        "Initial CGM dataset completeness: %.2f%%",
        "CGM completeness after interpolation: %.2f%%",
    ],
    "BGM": [
        "Removed %d invalid/zero values from column 1",
        "Clipped %d values in column bgm_primary (%d below range, %d above range)",
        "Processed %d total BGM readings",
        "Average of %.1f readings per day",
        "Date range: %s to %s",
    ],
    "INSULIN": [
        "Found %d positive doses",
        "- %d doses classified as bolus (≤%sU)",
        "- %d doses classified as basal (>%sU)",
        "- Dropped %d doses exceeding %sU",
        "Updated %d classifications using metadata",
        "Final dataset contains %d insulin records",
    ],
    "CARBS": [
        "Column carbs_primary: Kept %d entries ≥1g (%.1f%%)",
        "Removed %d duplicate timestamps",
        "Final dataset contains %d entries from %d original records",
    ],
    "NOTES": [
        "Column notes_primary: found %d valid notes",
        "Final dataset contains %d notes entries",
    ],
}


def data_notes(events: DataFrame, processed: dict, bolus_limit: float = 8.0, max_dose: float = 15.0) -> DataFrame:
    """Per person and data type, the processing notes with that person's
    numbers (``series_id, data_type, notes array<string>``).  All counts are
    aggregates; nothing is collected."""
    from glucoflow.operators import clean as C

    fs = F.format_string
    out = []
    if "CGM" in processed:
        m = C.cgm_completeness(processed["CGM"].frame)
        f = NOTE_FORMATS["CGM"]
        out.append(m.select("series_id", F.lit("CGM").alias("data_type"), F.array(
            fs(f[0], "total_readings"), fs(f[1], "missing_primary"), fs(f[2], "missing_after_fill"),
            fs(f[3], "initial_completeness_pct"), fs(f[4], "completeness_after_fill_pct"),
        ).alias("notes")))
    if "BGM" in processed:
        m = C.bgm_stats(events).join(
            processed["BGM"].frame.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")), "series_id", "left"
        )
        f = NOTE_FORMATS["BGM"]
        out.append(m.select("series_id", F.lit("BGM").alias("data_type"), F.array(
            fs(f[0], "removed_invalid"), fs(f[1], "clipped_total", "clipped_below", "clipped_above"),
            fs(f[2], "readings"), fs(f[3], F.coalesce(F.col("readings_per_day"), F.lit(0.0))),
            fs(f[4], F.date_format("a", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.date_format("b", "yyyy-MM-dd HH:mm:ss.SSSSSS")),
        ).alias("notes")))
    if "INSULIN" in processed:
        m = C.insulin_stats(events, bolus_limit, max_dose)
        f = NOTE_FORMATS["INSULIN"]
        out.append(m.select("series_id", F.lit("INSULIN").alias("data_type"), F.array(
            fs(f[0], "doses"), fs(f[1], "bolus", F.lit(str(bolus_limit))), fs(f[2], "basal", F.lit(str(bolus_limit))),
            fs(f[3], "count_over_max", F.lit(str(max_dose))), fs(f[4], "meta_updates"), fs(f[5], "doses"),
        ).alias("notes")))
    if "CARBS" in processed:
        m = C.carbs_stats(events)
        f = NOTE_FORMATS["CARBS"]
        out.append(m.select("series_id", F.lit("CARBS").alias("data_type"), F.array(
            fs(f[0], "kept_entries", "kept_pct"), fs(f[1], "duplicates_removed"),
            fs(f[2], "final_entries", "original_entries"),
        ).alias("notes")))
    if "NOTES" in processed:
        m = processed["NOTES"].frame.groupBy("series_id").agg(F.count("notes_primary").alias("n"))
        f = NOTE_FORMATS["NOTES"]
        out.append(m.select("series_id", F.lit("NOTES").alias("data_type"), F.array(fs(f[0], "n"), fs(f[1], "n")).alias("notes")))
    res = out[0]
    for x in out[1:]:
        res = res.unionByName(x)
    return res

"""Unit conversion, clipping and dose rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the original pipeline's for identical results.
# mmol/L -> mg/dL factor, mg/dL -> mmol/L factor (not the inverse of the first),
# valid glucose range in mg/dL, default interpolation limit in slots,
# bolus limit and maximum dose in units, minimum carbohydrate entry in grams.
MMOL_TO_MGDL = 18.0182
MGDL_TO_MMOL = 0.0555
GLUCOSE_MIN_MGDL = 39.64
GLUCOSE_MAX_MGDL = 360.36
DEFAULT_INTERPOLATION_LIMIT = 4
DEFAULT_BOLUS_LIMIT = 8.0
DEFAULT_MAX_DOSE = 15.0
CARBS_MIN_GRAMS = 1.0

MGDL = "mg/dL"
MMOL = "mmol/L"
UNITS = "U"
GRAMS = "g"

# legal units per data type (checked against the catalogue)
VALID_UNITS = {
    "CGM": (MGDL, MMOL),
    "BGM": (MGDL, MMOL),
    "INSULIN": (UNITS,),
    "CARBS": (GRAMS,),
}


def to_mgdl(value: Column, unit: Column) -> Column:
    """Glucose value in mg/dL; mmol/L values are multiplied by 18.0182."""
    return F.when(unit == F.lit(MMOL), value * F.lit(MMOL_TO_MGDL)).otherwise(value)


def clip_glucose(v: Column) -> Column:
    """Clip to the valid range; null stays null (greatest/least would not)."""
    return (
        F.when(v < F.lit(GLUCOSE_MIN_MGDL), F.lit(GLUCOSE_MIN_MGDL))
        .when(v > F.lit(GLUCOSE_MAX_MGDL), F.lit(GLUCOSE_MAX_MGDL))
        .otherwise(v)
    )


def out_of_range(v: Column) -> Column:
    """True when a reading lies outside the valid range (before clipping)."""
    return (v < F.lit(GLUCOSE_MIN_MGDL)) | (v > F.lit(GLUCOSE_MAX_MGDL))


def to_mmol(v: Column) -> Column:
    return v * F.lit(MGDL_TO_MMOL)


def is_bolus(dose: Column, bolus_limit: float) -> Column:
    return dose <= F.lit(bolus_limit)


def is_basal(dose: Column, bolus_limit: float, max_dose: float) -> Column:
    return (dose > F.lit(bolus_limit)) & (dose <= F.lit(max_dose))


def carbs_kept(v: Column) -> Column:
    """Carbohydrate entries below 1 g (or null) become null."""
    return F.when(v >= F.lit(CARBS_MIN_GRAMS), v)

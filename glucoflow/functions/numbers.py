"""Text to numbers and nulls, one rule for every source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that the original pipeline's CSV library reads as
# missing.
NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def finite(c: Column) -> Column:
    """Null for NaN and the infinities: Spark would order them above every reading."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def to_number(c: Column) -> Column:
    """Decimal text as double; anything else, NaN and infinity words too, is null."""
    text = c.cast("string")
    return finite(F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double")))


def null_words(c: Column) -> Column:
    """Null for the words that mean a missing value."""
    return F.when(~F.trim(c).isin(*NULL_WORDS), c)

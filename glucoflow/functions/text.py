"""Text rules: note cleaning and insulin metadata classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every Unicode whitespace character; Spark's
# trim() only removes spaces.  The set is derived by rule, once.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def clean_note(c: Column) -> Column:
    """Strip surrounding whitespace; empty text becomes null (no regex)."""
    stripped = F.btrim(c, F.lit(WHITESPACE))
    return F.when(stripped != F.lit(""), stripped)


# Insulin names recognised in metadata, checked in this order,
# with the class each one implies (name, is_bolus, is_basal).
INSULIN_NAMES = [
    ("novorapid", True, False),
    ("levemir", False, True),
]


def insulin_name_from_json(meta: Column) -> Column:
    """The ``insulin`` text of the first element of a JSON list, lower-cased.

    Objects at the top level, scalar list items and bad JSON give null.
    """
    return F.lower(F.get_json_object(meta, "$[0].insulin"))

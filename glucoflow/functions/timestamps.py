"""Timestamp format detection and conversion to UTC.

Detection follows the original rule set, evaluated per series with Spark
aggregates over all non-null values, or over the first 50 (parity option):

1. numeric values, all within (1e8, 1e12) -> epoch seconds; else all within
   (1e11, 1e15) -> epoch milliseconds;
2. the values (the first 10 of a sample) contain ``T`` and (``Z`` or ``+``) -> ISO 8601;
3. a leading ``d[-/]d[-/]d`` date whose first number is above 12 marks the
   sample as day-first: the day-first formats are tried first;
4. explicit formats in a fixed order, accepted when >= 95 % of the
   normalised values parses;
5. fallback: a documented list of extra patterns accepted at >= 90 %
   (Spark cannot guess per element like dateutil; see README);
6. a choice that parses under 90 % of all values is given up: every value is
   then parsed by the first pattern that fits it.

Conversion: epoch units directly, formats with ``try_to_timestamp``; naive
times are taken as UTC.  Values that do not parse are counted and returned
in a quarantine frame instead of becoming silent nulls.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

# Sample of the parity option, values looked at for the ISO
# mark, shares of a sample that accept a format, ranges of epoch numbers, and
# the shapes of a date whose first number may be a day.
SAMPLE_SIZE = 50
ISO_VALUES = 10
EXPLICIT_ACCEPT = 0.95
INFERRED_ACCEPT = 0.90
EPOCH_SECONDS = (1e8, 1e12)
EPOCH_MILLIS = (1e11, 1e15)
SEPARATED_DATE = r"^\s*\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
DAY_FIRST_DATE = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})"

#: copies of the format table for the salted join
JOIN_SALTS = 16

# The explicit format list, in trial order, as strptime
# patterns, and the day-first subset tried first when the sample shows a day
# above 12.  Each maps to a lenient Spark datetime pattern.
EXPLICIT_FORMATS = [
    ("%d-%m-%Y %H:%M", "d-M-yyyy H:m"),
    ("%d/%m/%Y %H:%M", "d/M/yyyy H:m"),
    ("%Y-%m-%d %H:%M:%S", "yyyy-M-d H:m:s"),
    ("%Y-%m-%d %H:%M", "yyyy-M-d H:m"),
    ("%d-%m-%Y %H:%M:%S", "d-M-yyyy H:m:s"),
    ("%m/%d/%Y %H:%M", "M/d/yyyy H:m"),
    ("%Y-%m-%dT%H:%M:%S%z", "yyyy-M-d'T'H:m:sXXX"),
    ("%Y-%m-%dT%H:%M:%SZ", "yyyy-M-d'T'H:m:s'Z'"),
    ("%d-%m-%Y %I:%M %p", "d-M-yyyy h:m a"),
]
DAYFIRST_FORMATS = ["%d-%m-%Y %H:%M", "%d/%m/%Y %H:%M", "%d-%m-%Y %H:%M:%S"]

# fallback patterns (own list) for values no explicit format covers
INFERRED_PATTERNS = [
    "yyyy-M-d'T'H:m:s.SSSSSSSSSXXX",
    "yyyy-M-d'T'H:m:sXXX",
    "yyyy-M-d'T'H:m:s.SSSSSSSSS",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d H:m:s.SSSSSSSSSXXX",
    "yyyy-M-d H:m:sXXX",
    "yyyy-M-d H:m:s.SSSSSSSSS",
    "yyyy-M-d H:m:s",
    "yyyy-M-d",
    "d/M/yyyy H:m:s",
    "d/M/yyyy",
    "d-M-yyyy",
]
DAYFIRST_INFERRED = ["d/M/yyyy H:m", "d-M-yyyy H:m", "d/M/yyyy H:m:s", "d-M-yyyy H:m:s", "d/M/yyyy", "d-M-yyyy"]

_SPARK = dict(EXPLICIT_FORMATS)


def normalise(c: Column) -> Column:
    """Trailing ``UTC``/``GMT`` removed, runs of whitespace collapsed."""
    c = F.regexp_replace(F.trim(c), r"\s+(UTC|GMT)$", "")
    return F.regexp_replace(c, r"\s+", " ")


_TOKENS = [
    ("yyyy", r"\d{4}"),
    ("SSSSSSSSS", r"\d{1,9}"),
    ("XXX", r"(Z|[+-]\d{2}:?\d{2})"),
    ("M", r"\d{1,2}"),
    ("d", r"\d{1,2}"),
    ("H", r"\d{1,2}"),
    ("h", r"\d{1,2}"),
    ("m", r"\d{1,2}"),
    ("s", r"\d{1,2}"),
    ("a", r"(AM|PM|am|pm)"),
]


def pattern_regex(pattern: str) -> str:
    """Shape of the text a lenient datetime pattern accepts, as a regex."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "'":
            j = pattern.index("'", i + 1)
            out.append(re.escape(pattern[i + 1 : j]))
            i = j + 1
            continue
        for tok, rx in _TOKENS:
            if pattern.startswith(tok, i):
                out.append(rx)
                i += len(tok)
                break
        else:
            out.append(re.escape(pattern[i]))
            i += 1
    return "^" + "".join(out) + "$"


def parse_with(c: Column, pattern: str) -> Column:
    """``try_to_timestamp`` to an instant; offsets honoured, naive = UTC.

    A regex on the text's shape runs first: values that cannot match are
    skipped without a parse attempt (failed parses are the expensive path).
    """
    shaped = c.rlike(pattern_regex(pattern))
    if pattern.endswith("XXX"):
        c = F.regexp_replace(c, r"([+-]\d{2})(\d{2})$", "$1:$2")  # +0200 like +02:00
    return F.when(shaped, F.try_to_timestamp(c, F.lit(pattern)))


def sampled(df: DataFrame, keys: list[str], value: str, order: str, n: int | None) -> DataFrame:
    """Non-null values as stripped text, with ``rn`` (place in its group) and
    ``used``: whether the value is one of the first ``n`` (T1); all are if n is None."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, order, F.trim(F.col(value).cast("string")).alias("v"))
    if n is None:
        return rows.withColumns({"rn": F.lit(0), "used": F.lit(True)})
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("rn", F.row_number().over(w)).withColumn("used", F.col("rn") <= n)


def detect(df: DataFrame, keys: list[str], value: str, order: str, sample_size: int | None = None) -> DataFrame:
    """Per key group: ``ts_type`` (unix_seconds, unix_milliseconds, iso8601,
    unknown) and the chosen Spark ``pattern`` (null for epochs / unknown).

    By default the rules are evaluated over all values of the group, as
    partial aggregates before the shuffle.  ``sample_size=50`` is the parity
    option: the first 50 values choose, as in the original.  In both modes a
    choice that parses under 90 % of all values is given up for parsing value
    by value (T7).
    """
    nv = normalise(F.col("v"))
    fits_any = lambda c, patterns: F.coalesce(*[parse_with(c, p) for p in patterns]).isNotNull()
    tried = {f"p{i}": parse_with(nv, pat).isNotNull() for i, (_, pat) in enumerate(EXPLICIT_FORMATS)}
    tried |= {"inf": fits_any(F.col("v"), INFERRED_PATTERNS), "dinf": fits_any(F.col("v"), DAYFIRST_INFERRED)}
    s = sampled(df, keys, value, order, sample_size).withColumns(tried)
    used = F.col("used")
    among = lambda c: F.avg(F.when(used, F.col(c).cast("double")))
    share = lambda c: F.avg(c.cast("double"))
    num = F.expr("try_cast(v as double)")
    day_m = F.regexp_extract(F.col("v"), DAY_FIRST_DATE, 1)
    first = used if sample_size is None else F.col("rn") <= ISO_VALUES
    upper = F.upper(F.col("v"))
    aggs = [
        F.count_if(used).alias("n"),
        F.count(F.when(used, num)).alias("n_num"),
        F.count_if(used & (num > EPOCH_SECONDS[0]) & (num < EPOCH_SECONDS[1])).alias("n_sec"),
        F.count_if(used & (num > EPOCH_MILLIS[0]) & (num < EPOCH_MILLIS[1])).alias("n_ms"),
        F.bool_or(first & upper.contains("T")).alias("has_t"),
        F.bool_or(first & (upper.contains("Z") | upper.contains("+"))).alias("has_zone"),
        F.bool_or(used & F.col("v").rlike(SEPARATED_DATE)).alias("sep_match"),
        F.bool_or(used & F.when(day_m != "", day_m.cast("int") > 12)).alias("dayfirst"),
    ]
    explicit = [f"p{i}" for i in range(len(EXPLICIT_FORMATS))]
    for i, c in enumerate(explicit):
        aggs += [among(c).alias(f"_e{i}"), share(F.col(c)).alias(f"_f{i}")]
    anything = F.array_contains(F.array(*explicit, "inf", "dinf"), True)
    aggs += [among("inf").alias("_inf"), among("dinf").alias("_dinf"), share(anything).alias("_any")]
    stats = s.groupBy(*keys).agg(*aggs)

    # a format is a candidate by the sample and by all values
    fits = lambda i: (F.col(f"_e{i}") >= EXPLICIT_ACCEPT) & (F.col(f"_f{i}") >= INFERRED_ACCEPT)
    explicit_pick = F.lit(None).cast("string")
    for i, (_, pat) in reversed(list(enumerate(EXPLICIT_FORMATS))):
        explicit_pick = F.when(fits(i), F.lit(pat)).otherwise(explicit_pick)
    dayfirst_pick = F.lit(None).cast("string")
    for fmt in reversed(DAYFIRST_FORMATS):
        i = [f for f, _ in EXPLICIT_FORMATS].index(fmt)
        dayfirst_pick = F.when(fits(i), F.lit(_SPARK[fmt])).otherwise(dayfirst_pick)

    is_sec = (F.col("n_num") > 0) & (F.col("n_sec") == F.col("n_num"))
    is_ms = (F.col("n_num") > 0) & (F.col("n_ms") == F.col("n_num"))
    iso = F.coalesce(F.col("has_t") & F.col("has_zone"), F.lit(False))
    day_first = F.coalesce(F.col("dayfirst"), F.lit(False))
    chosen = F.when(day_first, F.coalesce(dayfirst_pick, explicit_pick)).otherwise(explicit_pick)
    by_value = F.when(day_first, F.lit("dayfirst")).otherwise(F.lit("inferred"))
    fallback = (
        F.when(F.col("sep_match") & ~day_first & (F.col("_dinf") >= INFERRED_ACCEPT), F.lit("dayfirst"))
        .when(F.col("_inf") >= INFERRED_ACCEPT, F.lit("inferred"))
        .when(F.col("_any") >= INFERRED_ACCEPT, by_value)
    )
    return stats.select(
        *keys,
        F.when(F.col("n") == 0, F.lit("unknown"))
        .when(is_sec, F.lit("unix_seconds"))
        .when(is_ms, F.lit("unix_milliseconds"))
        .when(iso, F.lit("iso8601"))
        .when(chosen.isNotNull() | fallback.isNotNull(), F.lit("iso8601"))
        .otherwise(F.lit("unknown"))
        .alias("ts_type"),
        F.when(is_sec | is_ms, F.lit(None).cast("string"))
        .when(iso & chosen.isNull(), F.coalesce(fallback, F.lit("inferred")))
        .otherwise(F.coalesce(chosen, fallback))
        .alias("pattern"),
    )


def convert(df: DataFrame, detected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``ts`` (timestamp_ntz, UTC) using the detected type and pattern.

    ``detected`` has one row per key group.  One person may hold a large share
    of all rows, so the join is salted: the rows by their time text, the
    formats repeated for every salt.
    """
    v = F.trim(F.col(value).cast("string"))
    nv = normalise(v)
    num = F.expr(f"try_cast(trim(cast(`{value}` as string)) as double)")
    # value by value: day-first patterns if chosen, then the inferred, then the explicit ones
    day_first = F.col("pattern") == "dayfirst"
    by_value = day_first | (F.col("pattern") == "inferred")
    tries = [F.when(day_first, parse_with(v, p)) for p in DAYFIRST_INFERRED]
    tries += [F.when(by_value, parse_with(v, p)) for p in INFERRED_PATTERNS]
    tries += [F.when(by_value | (F.col("pattern") == p), parse_with(nv, p)) for _, p in EXPLICIT_FORMATS]
    parsed = (
        F.when(F.col("ts_type") == "unix_seconds", F.timestamp_micros((num * 1e6).cast("bigint")))
        .when(F.col("ts_type") == "unix_milliseconds", F.timestamp_micros((num * 1e3).cast("bigint")))
        .otherwise(F.coalesce(*tries))
    )
    salted = detected.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(JOIN_SALTS)).cast("int"))
    return rows.join(salted, [*keys, "_salt"], "left").withColumn("ts", parsed.cast(TimestampNTZType())).drop("_salt")

"""Quality rules with adaptive thresholds (operator 2).

Every document gets a few counters in one pass over its text.  Per (language,
source) the ratios made of them are summed up in a mergeable quantile sketch:
logarithmic buckets with a relative error of ``ACCURACY``, one row per bucket.
Merging sketches is adding counts, so Spark's partial aggregation builds them,
and a group with few documents takes the merged sketch of its language, then
of the corpus.  The thresholds are quartile fences read off the sketches; they
are joined back to the counters, salted, because one source may hold a third
of all rows.

Defined results: null or empty text has no words and fails the base rule;
null language or source is a group of its own; repeated rows are judged each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucoflow.llm.common import SPACE, encode, in_batches, materialize, null_key, rows_of

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())

#: relative error of a sketch bucket
ACCURACY = 0.02
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: a group with fewer documents uses the merged sketch one level up
MIN_GROUP = 200
#: fence: quartile + FENCE * interquartile range
FENCE = 3.0
#: below so many words a ratio's spread grows with the root of the shortfall, and so does the room
FULL_LENGTH = 50.0
SALTS = 64


@dataclass(frozen=True)
class Metric:
    """One ratio: counter over counter; the fence is at least ``slack`` off the quartile."""

    name: str
    over: str
    under: str
    slack: float
    low: bool = False


METRICS = (
    Metric("mean_word", "word_chars", "n_words", 2.0, low=True),
    Metric("symbol_share", "n_symbols", "word_chars", 0.04),
    Metric("punct_share", "n_punct", "word_chars", 0.10),
    Metric("upper_share", "n_upper", "word_chars", 0.20),
    Metric("dup_line_share", "n_dup_lines", "n_lines", 0.50),
)

_COUNTS = pa.schema(
    [pa.field("doc_id", pa.int64()), pa.field("lang_key", pa.string()), pa.field("source_key", pa.string())]
    + [
        pa.field(n, pa.int64())
        for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct")
    ]
)


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counters of one text, in the order of the counter columns."""
    raw = encode(text)
    words = raw.split()
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text or "") - without(SPACE),
        without(SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        without(UPPER),
        without(PUNCTUATION),
    )


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words covered by a window of ``width`` words that the text has twice or more."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    total = end = 0
    for start, window in enumerate(windows):
        if found[window] > 1:
            total += start + width - max(start, end)
            end = start + width
    return total


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = rows_of(batches, "doc_id", "lang_key", "source_key", "text")
    return in_batches(((d, lang, source, *text_counts(t)) for d, lang, source, t in rows), _COUNTS)


def counters(docs: DataFrame) -> DataFrame:
    """One row of counters per document row."""
    fields = ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'long'}" for f in _COUNTS)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        null_key("lang").alias("lang_key"),
        null_key("source").alias("source_key"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(_count_rows, fields)


def _ratio(m: Metric) -> Column:
    return F.when(F.col(m.under) > 0, F.col(m.over) / F.col(m.under)).otherwise(F.lit(0.0))


def sketches(counts: DataFrame) -> DataFrame:
    """Mergeable sketches: (lang_key, source_key, metric, bucket, n).

    Bucket -10000 holds zeros.  Documents that fail the base rule are left out,
    so that junk of one group doesn't move its thresholds.
    """
    bucket = lambda m: F.when(_ratio(m) > 0, F.floor(F.log(_ratio(m)) / math.log(GAMMA)).cast("int")).otherwise(F.lit(-10000))
    return (
        counts.filter(~base_failed())
        .select("lang_key", "source_key", F.explode(F.array(*(F.struct(F.lit(m.name).alias("metric"), bucket(m).alias("bucket")) for m in METRICS))).alias("s"))
        .groupBy("lang_key", "source_key", "s.metric", "s.bucket")
        .agg(F.count("*").alias("n"))
    )


def merged(sketch: DataFrame) -> DataFrame:
    """Sketches of the three levels: group, language (source null), corpus (both null)."""
    keys = [("lang_key", "source_key"), ("lang_key", None), (None, None)]
    level = lambda a, b: F.struct(F.lit(None).cast("string").alias("lang_key") if a is None else F.col(a).alias("lang_key"), F.lit(None).cast("string").alias("source_key") if b is None else F.col(b).alias("source_key"))
    return (
        sketch.select(F.explode(F.array(*(level(*k) for k in keys))).alias("g"), "metric", "bucket", "n")
        .groupBy("g.lang_key", "g.source_key", "metric", "bucket")
        .agg(F.sum("n").alias("n"))
    )


def fences(sketch: DataFrame) -> DataFrame:
    """Per group and metric: number of documents, quartiles and room beyond them.

    A window holds the buckets of one group and metric: a bounded number, set
    by the accuracy, not by the rows.
    """
    w = Window.partitionBy("lang_key", "source_key", "metric")
    value = F.when(F.col("bucket") == -10000, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") + 0.5))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("value")))
    quartiles = (
        merged(sketch)
        .withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("n").over(w))
        .withColumn("value", value)
        .groupBy("lang_key", "source_key", "metric")
        .agg(F.max("total").alias("group_rows"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    )
    of = lambda get: F.element_at(F.create_map(*(x for m in METRICS for x in (F.lit(m.name), F.lit(get(m))))), F.col("metric"))
    room = F.greatest(FENCE * (F.col("q3") - F.col("q1")), of(lambda m: m.slack))
    return quartiles.select(
        "lang_key", "source_key", "metric", "group_rows",
        "q1", "q3", room.alias("room"),
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang_key, source_key) with the fences of all metrics.

    A group of fewer than MIN_GROUP documents has its language's fences, a
    small language the corpus's.
    """
    wide = fences(sketch).groupBy("lang_key", "source_key").agg(
        F.max("group_rows").alias("group_rows"),
        F.map_from_entries(F.collect_list(F.struct("metric", F.struct("q1", "q3", "room")))).alias("bounds"),
    )
    groups = wide.filter("lang_key is not null and source_key is not null")
    langs = wide.filter("lang_key is not null and source_key is null").select("lang_key", F.col("group_rows").alias("lang_rows"), F.col("bounds").alias("lang_bounds"))
    corpus = wide.filter("lang_key is null").select(F.lit(1).alias("one"), F.col("bounds").alias("all_bounds"))
    return (
        groups.withColumn("one", F.lit(1))
        .join(langs, "lang_key")
        .join(corpus, "one")
        .select(
            "lang_key", "source_key",
            F.when(F.col("group_rows") >= MIN_GROUP, F.col("bounds")).when(F.col("lang_rows") >= MIN_GROUP, F.col("lang_bounds")).otherwise(F.col("all_bounds")).alias("bounds"),
        )
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame) -> DataFrame:
    """Counters, base rule and adaptive verdict of every document row.

    The counters are written once and read twice (sketches, verdict); the
    thresholds come back by a join salted with the document id.
    """
    counts = materialize(counters(docs), "quality-counts")
    salted = thresholds(sketches(counts)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = counts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    inside = F.lit(True)
    short = F.greatest(F.lit(1.0), F.sqrt(FULL_LENGTH / F.greatest("n_words", F.lit(1))))
    for m in METRICS:
        bound = F.element_at("bounds", m.name)
        low = bound["q1"] - bound["room"] * short if m.low else F.lit(-1.0)
        inside = inside & F.coalesce(_ratio(m).between(low, bound["q3"] + bound["room"] * short), F.lit(True))
    return rows.join(salted, ["lang_key", "source_key", "salt"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & inside).alias("kept"),
        *(_ratio(m).alias(m.name) for m in METRICS),
    )

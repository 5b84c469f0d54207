"""Registered queries over the driver's tables, each with a DuckDB oracle.

Every query reads the given tables (or data Spark derives from them), runs
over whole tables, and rounds doubles to 6 places in its final projection
only, so the oracle comparison is insensitive to summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glucoflow.functions import glucose as G
from glucoflow.functions.numbers import to_number
from glucoflow.functions.timeslots import micros, slot_of, slot_to_ts
from glucoflow.operators import align as A
from glucoflow.operators import clean as C
from glucoflow.plans import devices as D
from glucoflow.plans.sqlparts import DEVICE_CTE, TYPE_CTES, align_select, cgm_fill_ctes, clip_sql, r6_sql, slot_sql, ts_sql
from glucoflow.session import ensure_session_defaults

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_session_defaults(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return deco


def r6(c: Column | str) -> Column:
    """Round to 6 places with plain double arithmetic.

    ``floor(x * 1e6 + 0.5) / 1e6`` gives bit-identical results in Spark and
    DuckDB for identical inputs (their ``round`` functions treat exact
    decimal ties differently).
    """
    col = F.col(c) if isinstance(c, str) else c
    return F.floor(col * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read_table(spark, sf_dir, "events")


def _devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.device_events(_events(spark, sf_dir))


# =================================================================== CGM
@query(
    "cgm_gap_fill",
    f"""WITH sensor AS (SELECT event_type AS series_id, ts, 40.0 + value * 3 AS v FROM events),
{cgm_fill_ctes('sensor')}
SELECT series_id, {ts_sql('slot')} AS ts, {r6_sql('cgm_primary')} AS cgm_primary,
       {r6_sql('cgm_primary * 0.0555')} AS cgm_primary_mmol, missing
FROM cgm_out""",
)
def cgm_gap_fill(spark, sf_dir):
    """Flagship: every event type as one dense sensor -> 5-minute grid,
    slot means, limited linear fill (4 slots), clip, mmol, missing flag."""
    p = C.cgm(D.sensor_events(_events(spark, sf_dir)))
    f = p.frame
    return f.select("series_id", "ts", r6("cgm_primary").alias("cgm_primary"), r6("cgm_primary_mmol").alias("cgm_primary_mmol"), "missing")


def _round_all(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``r6`` to every double column (final projection only)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double" and f.name not in skip:
            out.append(r6(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _user_cgm(spark, sf_dir, **kw):
    return C.cgm(_devices(spark, sf_dir), **kw)


_USER = f"WITH {DEVICE_CTE},"


@query(
    "slot_round_half_even",
    f"""SELECT event_id,
  {ts_sql(slot_sql('epoch_us(ts)'))} AS slot_ts,
  {ts_sql(slot_sql('epoch_us(ts) - (epoch_us(ts) % 150000000)'))} AS tie_slot_ts
FROM events""",
)
def slot_round_half_even(spark, sf_dir):
    """Nearest 5-minute slot, exact halves to the even slot.  Every event
    time also yields an exact 2.5-minute multiple, half of them true ties."""
    step = 300_000_000
    us = micros("ts")
    tie = us - F.pmod(us, F.lit(150_000_000))
    from glucoflow.functions.timeslots import round_half_even

    return _events(spark, sf_dir).select(
        "event_id",
        slot_to_ts(round_half_even(us, step), step).alias("slot_ts"),
        slot_to_ts(round_half_even(tie, step), step).alias("tie_slot_ts"),
    )


@query(
    "slot_mean",
    f"""{_USER}
b AS (SELECT series_id, {slot_sql('epoch_us(ts)')} AS slot, v FROM cgm_raw)
SELECT series_id, {ts_sql('slot')} AS ts, {r6_sql('avg(v)')} AS cgm_mean, count(*) AS readings
FROM b GROUP BY series_id, slot""",
)
def slot_mean(spark, sf_dir):
    """T9 + A1: CGM readings per person averaged per 5-minute slot."""
    ev = _devices(spark, sf_dir).where(F.col("data_type") == "CGM")
    counts = ev.groupBy("series_id", slot_of("ts", 300_000_000).alias("slot")).agg(
        F.avg("value").alias("cgm_mean"), F.count(F.lit(1)).alias("readings")
    )
    return counts.select("series_id", slot_to_ts("slot", 300_000_000).alias("ts"), r6("cgm_mean").alias("cgm_mean"), "readings")


@query(
    "grid_densify",
    f"""{_USER}
{cgm_fill_ctes('cgm_raw', limit=0)}
SELECT series_id, {ts_sql('slot')} AS ts, {r6_sql('cgm_primary')} AS cgm_primary, NOT missing AS observed FROM cgm_out""",
)
def grid_densify(spark, sf_dir):
    """W1 + J2: every 5-minute slot of each person's CGM span, no filling."""
    p = _user_cgm(spark, sf_dir, interpolation_limit=0)
    return p.frame.select("series_id", "ts", r6("cgm_primary").alias("cgm_primary"), (~F.col("missing")).alias("observed"))


@query(
    "gap_runs",
    f"""{_USER}
b AS (SELECT DISTINCT series_id, {slot_sql('epoch_us(ts)')} AS slot FROM cgm_raw),
n AS (SELECT series_id, slot, lead(slot) OVER (PARTITION BY series_id ORDER BY slot) AS nb FROM b)
SELECT series_id, {ts_sql('slot + 1')} AS gap_start, {ts_sql('nb - 1')} AS gap_end, nb - slot - 1 AS gap_slots
FROM n WHERE nb IS NOT NULL AND nb - slot > 1""",
)
def gap_runs(spark, sf_dir):
    """W2 + W3: every run of empty slots between two CGM readings of a person."""
    from glucoflow.operators.fill import next_observation

    obs, _ = C.cgm_slots(_devices(spark, sf_dir), 300_000_000)
    nxt = next_observation(obs.where(F.col("column_name") == "cgm_primary"), ["series_id", "column_name"])
    step = 300_000_000
    return nxt.where(F.col("next_slot") - F.col("slot") > 1).select(
        "series_id",
        slot_to_ts(F.col("slot") + 1, step).alias("gap_start"),
        slot_to_ts(F.col("next_slot") - 1, step).alias("gap_end"),
        (F.col("next_slot") - F.col("slot") - 1).alias("gap_slots"),
    )


@query(
    "cgm_person_fill",
    f"""{_USER}
{cgm_fill_ctes('cgm_raw')}
SELECT series_id, {ts_sql('slot')} AS ts, {r6_sql('cgm_primary')} AS cgm_primary,
       {r6_sql('cgm_primary * 0.0555')} AS cgm_primary_mmol, missing FROM cgm_out""",
)
def cgm_person_fill(spark, sf_dir):
    """M3 per person: the full CGM pipeline keyed by user."""
    return _round_all(_user_cgm(spark, sf_dir).frame)


@query(
    "cgm_completeness",
    f"""{_USER}
{cgm_fill_ctes('cgm_raw')}
SELECT series_id, count(*) AS total_readings, count_if(missing) AS missing_primary,
  count_if(cgm_primary IS NULL) AS missing_after_fill,
  round(100.0 * count_if(NOT missing) / count(*), 2) AS initial_completeness_pct,
  round(100.0 * count(cgm_primary) / count(*), 2) AS completeness_after_fill_pct
FROM cgm_out GROUP BY series_id""",
)
def cgm_completeness(spark, sf_dir):
    """Per person grid size, missing before/after fill and percentages."""
    return C.cgm_completeness(_user_cgm(spark, sf_dir).frame)


@query(
    "cgm_multi_column",
    f"""{_USER}
two AS (
  SELECT series_id, ts, 'cgm_primary' AS col, 40.0 + value * 3 AS v FROM ev WHERE event_type = 'view'
  UNION ALL SELECT series_id, ts, 'cgm_2', (value / 5) * 18.0182 FROM ev WHERE event_type = 'click'
),
b AS (SELECT series_id, col, {slot_sql('epoch_us(ts)')} AS slot, v FROM two),
sp AS (SELECT series_id, min(slot) lo, max(slot) hi FROM b GROUP BY 1),
o AS (SELECT series_id, col, slot, avg(v) v FROM b GROUP BY 1, 2, 3),
g AS (SELECT s.series_id, c.col, unnest(range(lo, hi + 1)) AS slot FROM sp s CROSS JOIN (VALUES ('cgm_primary'), ('cgm_2')) c(col)),
f AS (SELECT g.series_id, g.col, g.slot, o.v FROM g LEFT JOIN o USING (series_id, col, slot)),
w AS (
  SELECT series_id, col, slot, v,
    last_value(CASE WHEN v IS NOT NULL THEN slot END IGNORE NULLS) OVER (PARTITION BY series_id, col ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pb,
    last_value(v IGNORE NULLS) OVER (PARTITION BY series_id, col ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
    first_value(CASE WHEN v IS NOT NULL THEN slot END IGNORE NULLS) OVER (PARTITION BY series_id, col ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nb,
    first_value(v IGNORE NULLS) OVER (PARTITION BY series_id, col ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
  FROM f
),
z AS (SELECT *, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, col, pb) AS gap FROM w),
fl AS (
  SELECT series_id, col, slot, v IS NULL AS miss,
    {clip_sql("CASE WHEN v IS NOT NULL THEN v WHEN pb IS NULL OR gap > 4 THEN NULL WHEN nb IS NULL THEN pv ELSE pv + (nv - pv) / (nb - pb) * (slot - pb) END")} AS iv
  FROM z
)
SELECT series_id, {ts_sql('slot')} AS ts,
  {r6_sql("max(CASE WHEN col = 'cgm_primary' THEN iv END)")} AS cgm_primary,
  {r6_sql("max(CASE WHEN col = 'cgm_2' THEN iv END)")} AS cgm_2,
  {r6_sql("max(CASE WHEN col = 'cgm_primary' THEN iv END) * 0.0555")} AS cgm_primary_mmol,
  {r6_sql("max(CASE WHEN col = 'cgm_2' THEN iv END) * 0.0555")} AS cgm_2_mmol,
  bool_or(CASE WHEN col = 'cgm_primary' THEN miss END) AS missing
FROM fl GROUP BY series_id, slot""",
)
def cgm_multi_column(spark, sf_dir):
    """J1 + O2 + P11: two CGM columns (mg/dL primary, mmol/L secondary) on one
    grid; each column filled on its own, ``missing`` from the primary."""
    ev = D.two_column_cgm(_events(spark, sf_dir))
    p = C.cgm(ev, columns=[("cgm_primary", G.MGDL), ("cgm_2", G.MMOL)])
    return _round_all(p.frame)


# =================================================================== BGM
@query(
    "bgm_clean",
    f"""{_USER}{TYPE_CTES}
SELECT series_id, ts, {r6_sql('bgm_primary')} AS bgm_primary, bgm_primary_clipped, {r6_sql('bgm_primary_mmol')} AS bgm_primary_mmol FROM bgm_out""",
)
def bgm_clean(spark, sf_dir):
    """M4: meter readings > 0, mmol/L -> mg/dL, clipped flag, clip, last per time, mmol."""
    return _round_all(C.bgm(_devices(spark, sf_dir), columns=[("bgm_primary", G.MMOL)]).frame)


@query(
    "bgm_stats",
    f"""{_USER}
v AS (SELECT series_id, ts, value, value * 18.0182 AS mg FROM bgm_raw),
k AS (SELECT series_id, count(DISTINCT ts) AS readings, min(ts) AS a, max(ts) AS b FROM v WHERE value > 0 GROUP BY 1),
c AS (SELECT series_id,
        count_if(NOT coalesce(value > 0, false)) AS removed_invalid,
        count_if(value > 0 AND mg < 39.64) AS clipped_below,
        count_if(value > 0 AND mg > 360.36) AS clipped_above
      FROM v GROUP BY 1)
SELECT c.series_id, removed_invalid, clipped_below, clipped_above, clipped_below + clipped_above AS clipped_total,
  coalesce(readings, 0) AS readings,
  {r6_sql("readings / CASE WHEN epoch_us(b) - epoch_us(a) > 0 THEN (epoch_us(b) - epoch_us(a)) / 86400e6 END")} AS readings_per_day
FROM c LEFT JOIN k USING (series_id)""",
)
def bgm_stats(spark, sf_dir):
    """Removed, clipped below/above, readings, readings per day."""
    return _round_all(C.bgm_stats(_devices(spark, sf_dir)))


# =============================================================== insulin
@query(
    "insulin_classify",
    f"""{_USER}
i AS (SELECT series_id, ts, value AS dose FROM ins_raw WHERE value > 0)
SELECT series_id, ts, {r6_sql('dose')} AS dose, dose <= 8.0 AS is_bolus, dose > 8.0 AND dose <= 15.0 AS is_basal, '' AS type FROM i""",
)
def insulin_classify(spark, sf_dir):
    """P6 + P14: positive doses classed by size (bolus <= 8 U < basal <= 15 U)."""
    return _round_all(C.insulin(_devices(spark, sf_dir), use_metadata=False).frame)


@query(
    "insulin_metadata",
    f"""{_USER}{TYPE_CTES}
SELECT series_id, ts, {r6_sql('dose')} AS dose, is_bolus, is_basal, type FROM ins_out""",
)
def insulin_metadata(spark, sf_dir):
    """M5 + J5: size classes overridden by metadata at the same time."""
    return _round_all(C.insulin(_devices(spark, sf_dir)).frame)


@query(
    "insulin_stats",
    f"""{_USER}{TYPE_CTES}
SELECT p.series_id, count(*) AS doses, count_if(dose <= 8.0) AS bolus, count_if(dose > 8.0 AND dose <= 15.0) AS basal,
  count_if(dose > 15.0) AS count_over_max,
  (SELECT count(*) FROM ins_meta m WHERE m.t IS NOT NULL AND m.series_id = p.series_id
     AND EXISTS (SELECT 1 FROM ins_pos d WHERE d.series_id = m.series_id AND d.ts = m.ts)) AS meta_updates
FROM ins_pos p GROUP BY p.series_id""",
)
def insulin_stats(spark, sf_dir):
    """A16 + A18: dose classes by size per person, over-maximum doses, recognised
    metadata rows at a dose."""
    return C.insulin_stats(_devices(spark, sf_dir))


# ================================================================= carbs
@query(
    "carbs_clean",
    f"""{_USER}{TYPE_CTES}
SELECT series_id, ts, {r6_sql('carbs_primary')} AS carbs_primary FROM carb_out""",
)
def carbs_clean(spark, sf_dir):
    """M6: entries below 1 g dropped, first entry per time kept."""
    return _round_all(C.carbs(_devices(spark, sf_dir)).frame)


@query(
    "carbs_stats",
    f"""{_USER}
c AS (SELECT series_id, ts, CASE WHEN value >= 1.0 THEN value END AS v FROM carb_raw),
t AS (SELECT series_id, count(DISTINCT ts) AS final_entries FROM c WHERE v IS NOT NULL GROUP BY 1),
b AS (SELECT series_id, count(*) AS original_entries, count(v) AS kept_entries FROM c GROUP BY 1)
SELECT series_id, original_entries, kept_entries,
  round(100.0 * kept_entries / original_entries, 1) AS kept_pct,
  kept_entries - coalesce(final_entries, 0) AS duplicates_removed, coalesce(final_entries, 0) AS final_entries
FROM b LEFT JOIN t USING (series_id)""",
)
def carbs_stats(spark, sf_dir):
    """Carb entries kept per person, duplicates removed, final count."""
    return C.carbs_stats(_devices(spark, sf_dir))


# ================================================================= notes
@query(
    "notes_clean",
    f"""{_USER}{TYPE_CTES}
SELECT series_id, ts, notes_primary FROM note_out""",
)
def notes_clean(spark, sf_dir):
    """M7: notes stripped of surrounding whitespace; blank notes dropped."""
    return C.notes(_devices(spark, sf_dir)).frame.drop("_seq")


# ================================================================= align
def _processed(spark, sf_dir, types=("CGM", "BGM", "INSULIN", "CARBS", "NOTES")):
    ev = _devices(spark, sf_dir)
    out = {}
    if "CGM" in types:
        out["CGM"] = C.cgm(ev)
    if "BGM" in types:
        out["BGM"] = C.bgm(ev, columns=[("bgm_primary", G.MMOL)])
    if "INSULIN" in types:
        out["INSULIN"] = C.insulin(ev)
    if "CARBS" in types:
        out["CARBS"] = C.carbs(ev)
    if "NOTES" in types:
        out["NOTES"] = C.notes(ev)
    return out


def _align_query(types):
    ctes, select = align_select(types=types)

    def run(spark, sf_dir):
        res = A.align(_processed(spark, sf_dir, ("CGM", *types)))
        return _round_all(res.frame)

    sql = f"""{_USER}{TYPE_CTES},
{cgm_fill_ctes('cgm_raw')},
{ctes}
{select}"""
    return run, sql


for _name, _types in [
    ("align_all", ("BGM", "INSULIN", "CARBS", "NOTES")),
    ("align_bgm", ("BGM",)),
    ("align_insulin", ("INSULIN",)),
    ("align_carbs", ("CARBS",)),
    ("align_notes", ("NOTES",)),
]:
    _run, _sql = _align_query(_types)
    _run.__doc__ = f"M8/M9 + J3/J4: {', '.join(_types)} aligned onto each person's CGM grid."
    query(_name, _sql)(_run)


# ============================================================== timeline
def _timeline_sql(table: str, series: str, ts: str, seq: str, step: int) -> str:
    return f"""WITH b AS (SELECT CAST({series} AS VARCHAR) AS series_id, epoch_us({ts}) AS us, {seq} AS s FROM {table}),
d AS (SELECT series_id, lead(us) OVER (PARTITION BY series_id ORDER BY us) - us AS diff FROM b),
o AS (SELECT series_id, us, lead(us) OVER (PARTITION BY series_id ORDER BY s) AS nus FROM b),
m AS (SELECT series_id, diff, count(*) AS n FROM d WHERE diff IS NOT NULL GROUP BY 1, 2),
mm AS (SELECT series_id, arg_min(diff, {{'a': -n, 'b': diff}}) AS modal_step_us FROM m GROUP BY 1),
c AS (SELECT series_id, count(*) AS rows FROM b GROUP BY 1),
v AS (SELECT series_id, count_if(nus < us) AS order_violations FROM o GROUP BY 1)
SELECT c.series_id, rows, coalesce(order_violations, 0) AS order_violations, modal_step_us,
  rows > 0 AND coalesce(order_violations, 0) = 0 AND coalesce(modal_step_us = {step}, false) AS ok
FROM c LEFT JOIN v USING (series_id) LEFT JOIN mm USING (series_id)"""


@query("timeline_check", _timeline_sql("events", "user_id", "ts", "event_id", 300_000_000))
def timeline_check(spark, sf_dir):
    """W7 + A8 + W8: per person event timeline - order violations in stored
    (event id) order, modal step (smallest on a tie), and the 5-minute check."""
    ev = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("series_id"), "ts", F.col("event_id").alias("_seq"))
    return A.timeline_check(ev, "5min")


@query("modal_interval", _timeline_sql("orders", "o_custkey", "o_orderdate", "o_orderkey", 86_400_000_000))
def modal_interval(spark, sf_dir):
    """A8 + W8 on a daily timeline: per customer, modal gap between order
    dates and order violations in order-key order."""
    o = D.read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("series_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("_seq")
    )
    return A.timeline_check(o, "1D")


# ============================================================ resampling
_DAY = 86_400_000_000

_DAILY_SQL = f"""WITH li AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, {slot_sql('epoch_us(l_shipdate)', _DAY)} AS slot, l_quantity FROM lineitem),
sp AS (SELECT series_id, min(slot) AS lo, max(slot) AS hi FROM li GROUP BY 1),
g AS (SELECT series_id, unnest(range(lo, hi + 1)) AS slot FROM sp),
a AS (SELECT series_id, slot, sum(l_quantity) AS q, count(*) AS n FROM li GROUP BY 1, 2),
daily AS (SELECT g.series_id, g.slot, coalesce(a.q, 0.0) AS quantity, coalesce(a.n, 0) AS lines
          FROM g LEFT JOIN a ON g.series_id = a.series_id AND g.slot = a.slot)"""


def _daily(spark, sf_dir) -> DataFrame:
    from glucoflow.operators.resample import fill_between_observed

    li = D.read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("series_id"), F.col("l_shipdate").alias("ts"), "l_quantity"
    )
    # sums per day, then the supplier's calendar emitted from its own days
    # (the timeline is the span of the data: no calendar join)
    per_day = li.groupBy("series_id", slot_of("ts", _DAY).alias("slot")).agg(
        F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines")
    )
    return fill_between_observed(per_day, ["series_id"], {"quantity": 0.0, "lines": 0}, _DAY)


@query(
    "resample_daily_sum",
    f"""{_DAILY_SQL}
SELECT series_id, {ts_sql('slot', _DAY)} AS ts, {r6_sql('quantity')} AS quantity, lines FROM daily""",
)
def resample_daily_sum(spark, sf_dir):
    """A6 + W1 + J3 at a daily step: per supplier, shipped quantity summed per
    day onto the supplier's full daily calendar, 0 for empty days."""
    d = _daily(spark, sf_dir)
    return d.select("series_id", "ts", r6("quantity").alias("quantity"), F.col("lines").cast("bigint").alias("lines"))


@query(
    "month_nonempty",
    f"""{_DAILY_SQL}
SELECT series_id, strftime({ts_sql('slot', _DAY)}, '%Y-%m') AS month, count(*) AS days,
  count_if(quantity <> 0 OR lines <> 0) AS nonzero_days, bool_or(quantity <> 0 OR lines <> 0) AS exported
FROM daily GROUP BY 1, 2""",
)
def month_nonempty(spark, sf_dir):
    """A20 + P20: calendar months of each supplier's daily series; a month is
    exported only if some cell is neither null nor zero."""
    from glucoflow.sinks.export import month_activity

    return month_activity(_daily(spark, sf_dir), ["quantity", "lines"])


@query(
    "month_stats",
    f"""WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS series_id, strftime(o_orderdate, '%Y-%m') AS month,
                   o_totalprice / 20000.0 AS dose FROM orders)
SELECT series_id, month, count(*) AS records, count_if(dose > 0) AS doses,
  count_if(dose > 0 AND dose <= 8.0) AS bolus, count_if(dose > 8.0 AND dose <= 15.0) AS basal,
  count_if(dose > 15.0) AS over_max, {r6_sql('sum(dose)')} AS total_dose
FROM o GROUP BY 1, 2""",
)
def month_stats(spark, sf_dir):
    """A14 + A20 + A21: per customer and calendar month, doses derived from
    order totals (total / 20000 U) counted by class."""
    from glucoflow.operators.resample import month_of

    o = D.read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("series_id"),
        month_of("o_orderdate").alias("month"),
        (F.col("o_totalprice") / 20000.0).alias("dose"),
    )
    d = F.col("dose")
    return o.groupBy("series_id", "month").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(d > 0).alias("doses"),
        F.count_if((d > 0) & G.is_bolus(d, G.DEFAULT_BOLUS_LIMIT)).alias("bolus"),
        F.count_if(G.is_basal(d, G.DEFAULT_BOLUS_LIMIT, G.DEFAULT_MAX_DOSE)).alias("basal"),
        F.count_if(d > G.DEFAULT_MAX_DOSE).alias("over_max"),
        r6(F.sum(d)).alias("total_dose"),
    )


_ALIGNED_COLS = [
    "cgm_primary",
    "cgm_primary_mmol",
    "missing_cgm",
    "bgm_primary",
    "bgm_primary_clipped",
    "bgm_primary_mmol",
    "basal_dose",
    "bolus_dose",
    "carbs_primary",
    "notes_primary",
]


def _completeness_sql() -> str:
    ctes, select = align_select()
    per_col = "\nUNION ALL ".join(
        f"SELECT series_id, '{c}' AS column_name, round(100.0 * count({c}) / count(*), 2) AS completeness_pct FROM al GROUP BY 1"
        for c in _ALIGNED_COLS
    )
    return f"""{_USER}{TYPE_CTES},
{cgm_fill_ctes('cgm_raw')},
{ctes},
al AS ({select})
{per_col}"""


@query("column_completeness", _completeness_sql())
def column_completeness(spark, sf_dir):
    """A10: per person, share of non-null cells of every aligned column."""
    from glucoflow.operators.quality import column_completeness as cc

    return cc(A.align(_processed(spark, sf_dir)).frame, _ALIGNED_COLS)


# ============================================================ timestamps
_FMT_SQL = """CASE user_id % 4
    WHEN 0 THEN 'unix_seconds' WHEN 1 THEN 'unix_milliseconds' ELSE 'iso8601' END"""


def _ts_text(spark, sf_dir) -> DataFrame:
    """Every event time as text, in one of four layouts chosen per person."""
    ev = _events(spark, sf_dir)
    us = micros("ts")
    kind = F.pmod(F.col("user_id"), F.lit(4))
    text = (
        F.when(kind == 0, F.floor(us / 1e6).cast("string"))
        .when(kind == 1, F.floor(us / 1e3).cast("string"))
        .when(kind == 2, F.date_format("ts", "dd-MM-yyyy HH:mm"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return ev.select("event_id", F.col("user_id").cast("string").alias("series_id"), text.alias("ts_text"))


@query(
    "ts_detect",
    f"""SELECT DISTINCT CAST(user_id AS VARCHAR) AS series_id, {_FMT_SQL} AS ts_type,
  CASE user_id % 4 WHEN 2 THEN 'd-M-yyyy H:m' WHEN 3 THEN 'yyyy-M-d''T''H:m:sXXX' END AS pattern
FROM events""",
)
def ts_detect(spark, sf_dir):
    """The time layout of each person's text times, detected from the
    first 50 values (epoch seconds / milliseconds, day-first, ISO with Z)."""
    from glucoflow.functions import timestamps as TS

    return TS.detect(_ts_text(spark, sf_dir), ["series_id"], "ts_text", "event_id", sample_size=TS.SAMPLE_SIZE)


@query(
    "ts_convert",
    f"""SELECT event_id, CAST(user_id AS VARCHAR) AS series_id, {_FMT_SQL} AS ts_type,
  make_timestamp(CASE user_id % 4
    WHEN 0 THEN (epoch_us(ts) // 1000000) * 1000000
    WHEN 1 THEN (epoch_us(ts) // 1000) * 1000
    WHEN 2 THEN (epoch_us(ts) // 60000000) * 60000000
    ELSE (epoch_us(ts) // 1000000) * 1000000 END) AS ts
FROM events""",
)
def ts_convert(spark, sf_dir):
    """Each person's times exported as text in one of four layouts
    (epoch s, epoch ms, ``dd-MM-yyyy HH:mm``, ISO ``...Z``); the format is
    detected per person over all values and every value converted."""
    from glucoflow.functions import timestamps as TS

    raw = _ts_text(spark, sf_dir)
    detected = TS.detect(raw, ["series_id"], "ts_text", "event_id")
    return TS.convert(raw, detected, ["series_id"], "ts_text").select("event_id", "series_id", "ts_type", "ts")


# layout of person k % 12: Spark pattern, shift of the written time in hours, kept precision in us
_LAYOUTS = [
    ("dd-MM-yyyy HH:mm", 0, 60_000_000),
    ("dd/MM/yyyy HH:mm", 0, 60_000_000),
    ("yyyy-MM-dd HH:mm:ss", 0, 1_000_000),
    ("yyyy-MM-dd HH:mm", 0, 60_000_000),
    ("dd-MM-yyyy HH:mm:ss", 0, 1_000_000),
    ("MM/dd/yyyy HH:mm", 0, 60_000_000),
    ("yyyy-MM-dd'T'HH:mm:ss'+0000'", 0, 1_000_000),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", 0, 1_000_000),
    ("dd-MM-yyyy hh:mm a", 0, 60_000_000),
    ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", 2, 1_000_000),
    ("yyyy-MM-dd'T'HH:mm:ss.S'Z'", 0, 100_000),
]
_MIXED = len(_LAYOUTS)


@query(
    "ts_all_formats",
    f"""SELECT event_id, CAST(user_id AS VARCHAR) AS series_id, make_timestamp(epoch_us(ts) // p * p) AS ts
FROM (SELECT *, CASE user_id % {_MIXED + 1} {' '.join(f'WHEN {k} THEN {p}' for k, (_, _, p) in enumerate(_LAYOUTS))}
  ELSE CASE WHEN event_id % 2 = 0 THEN 60000000 ELSE 1000000 END END AS p FROM events)""",
)
def ts_all_formats(spark, sf_dir):
    """Every explicit format, offsets with and without a colon, short
    fractions, and people whose export mixes two formats, half and half (no
    format reaches 90 %, so each value is parsed by the one that fits)."""
    from glucoflow.functions import timestamps as TS

    ev = _events(spark, sf_dir)
    kind = F.pmod(F.col("user_id"), F.lit(_MIXED + 1))
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", _LAYOUTS[0][0])).otherwise(F.date_format("ts", _LAYOUTS[2][0]))
    for k, (pattern, hours, _) in enumerate(_LAYOUTS):
        text = F.when(kind == k, F.date_format(F.col("ts") + F.expr(f"interval {hours} hours"), pattern)).otherwise(text)
    raw = ev.select("event_id", F.col("user_id").cast("string").alias("series_id"), text.alias("ts_text"))
    detected = TS.detect(raw, ["series_id"], "ts_text", "event_id")
    return TS.convert(raw, detected, ["series_id"], "ts_text").select("event_id", "series_id", "ts")


_WORDS = ["NaN", "inf", "-Infinity", "N/A", "", "1d", " 12.50 ", "abc"]


@query(
    "number_null_words",
    f"""WITH t AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 16 < 8 THEN CASE event_id % 16 WHEN 6 THEN 12.5 END ELSE value END AS v
  FROM events WHERE event_type = 'click')
SELECT CAST(user_id AS VARCHAR) AS series_id, ts, {r6_sql('greatest(least(v, 360.36), 39.64)')} AS bgm_primary, v < 39.64 OR v > 360.36 AS bgm_primary_clipped
FROM t WHERE v > 0""",
)
def number_null_words(spark, sf_dir):
    """P1, P5, P9 on text exports: words for a missing value, NaN and infinity
    become null, never a reading."""
    from glucoflow.operators.events import ColumnSpec, to_long

    ev = _events(spark, sf_dir).where(F.col("event_type") == "click")
    words = F.array(*map(F.lit, _WORDS))
    k = F.pmod(F.col("event_id"), F.lit(16)).cast("int")
    text = F.when(k < 8, F.get(words, k)).otherwise(F.col("value").cast("string"))
    wide = ev.select(F.col("user_id").cast("string").alias("series_id"), "ts", F.col("event_id").alias("_seq"), text.alias("meter"))
    long = to_long(wide, [ColumnSpec("meter", "BGM", "bgm_primary", True, "mg/dL")], "series_id", "ts", "_seq")
    out = C.bgm(long).frame
    return out.select("series_id", "ts", r6("bgm_primary").alias("bgm_primary"), "bgm_primary_clipped")


# =============================================================== sources
from glucoflow.sinks import device_files as DF  # noqa: E402
from glucoflow.sources import catalog as CAT  # noqa: E402
from glucoflow.sources import readers as R  # noqa: E402

_SRC_EV = """ev AS (SELECT CAST(user_id AS VARCHAR) AS series_id, ts, event_id, event_type, value,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""

_WIDE_COLS = {
    "Historic Glucose mmol/L": "historic_glucose",
    "Scan Glucose mmol/L": "scan_glucose",
    "Strip Glucose mmol/L": "strip_glucose",
    "Rapid-Acting Insulin (units)": "rapid_insulin",
    "Long-Acting Insulin Value (units)": "long_insulin",
    "Carbohydrates (grams)": "carbohydrates",
}


def _wide_csv_rows(ev: DataFrame) -> DataFrame:
    et, v = F.col("event_type"), F.col("value")
    k = F.get_json_object("props", "$.k")
    return ev.select(
        F.col("user_id").cast("string").alias("series_id"),
        F.col("event_id").alias("_seq"),
        F.lit("FreeStyle LibreLink").alias("Device"),
        F.concat(F.lit("SN-"), F.col("user_id").cast("string")).alias("Serial Number"),
        F.date_format("ts", "dd-MM-yyyy HH:mm").alias("Device Timestamp"),
        F.when(et == "view", (F.lit(40.0) + v * 3) / 18.0).alias("Historic Glucose mmol/L"),
        F.lit(None).cast("double").alias("Scan Glucose mmol/L"),
        F.when(et == "click", v / 5).alias("Strip Glucose mmol/L"),
        F.when(et == "purchase", v / 10).alias("Rapid-Acting Insulin (units)"),
        F.lit(None).cast("double").alias("Long-Acting Insulin Value (units)"),
        F.when(et == "signup", v - 5).alias("Carbohydrates (grams)"),
        F.when(et == "error", F.concat(F.lit('note, "'), k, F.lit('"'))).alias("Notes"),
    )


_CSV_SQL = f"""WITH {_SRC_EV}
SELECT series_id, make_timestamp((epoch_us(ts) // 60000000) * 60000000) AS ts,
  {r6_sql("CASE WHEN event_type = 'view' THEN (40.0 + value * 3) / 18.0 END")} AS historic_glucose,
  CAST(NULL AS DOUBLE) AS scan_glucose,
  {r6_sql("CASE WHEN event_type = 'click' THEN value / 5 END")} AS strip_glucose,
  {r6_sql("CASE WHEN event_type = 'purchase' THEN value / 10 END")} AS rapid_insulin,
  CAST(NULL AS DOUBLE) AS long_insulin,
  {r6_sql("CASE WHEN event_type = 'signup' THEN value - 5 END")} AS carbohydrates,
  CASE WHEN event_type = 'error' THEN 'note, "' || CAST(k AS VARCHAR) || '"' END AS notes
FROM ev"""


def _csv_columns() -> list[str]:
    cols = [c.source_name for c in CAT.WIDE_CSV.files[0].tables[0].columns]
    cols.insert(2, "Device Timestamp")
    return cols


def _csv_values(conv: DataFrame) -> DataFrame:
    return conv.select(
        "series_id",
        "ts",
        *[r6(to_number(F.col(f"`{src}`"))).alias(dst) for src, dst in _WIDE_COLS.items()],
        F.col("Notes").alias("notes"),
    )


@query("csv_source", _CSV_SQL)
def csv_source(spark, sf_dir):
    """Every person's events written as a wide CSV export
    (preamble row, header on row 1, day-first minute times, quoted notes),
    then read back through the layout catalogue."""
    rows = _wide_csv_rows(_events(spark, sf_dir))
    out = DF.scratch_dir(spark, "csv")
    DF.write_csv_files(rows, out, _csv_columns(), preamble=["Glucose Data", "Generated on", "export"]).agg(F.sum("rows")).collect()
    table = CAT.WIDE_CSV.files[0].tables[0]
    return _csv_values(R.convert_times(R.read_csv_table(spark, [out], table), table))


@query("csv_wide_columns", _CSV_SQL)
def csv_wide_columns(spark, sf_dir):
    """S1, S2 on exports of over 80 columns: the wanted ones stand behind 70
    others, in another order than the layout names them."""
    filler = [f"Extra {i}" for i in range(70)]
    rows = _wide_csv_rows(_events(spark, sf_dir)).withColumns({c: F.lit(i) for i, c in enumerate(filler)})
    out = DF.scratch_dir(spark, "csv-wide")
    DF.write_csv_files(rows, out, [*filler, *reversed(_csv_columns())], preamble=["Glucose Data"]).agg(F.sum("rows")).collect()
    table = CAT.WIDE_CSV.files[0].tables[0]
    return _csv_values(R.convert_times(R.read_csv_table(spark, [out], table), table))


@query("csv_header_search", _CSV_SQL)
def csv_header_search(spark, sf_dir):
    """the layout declares no header row; each file's header is found among
    its first rows (half of the exports have a preamble row, half have none)."""
    from dataclasses import replace

    rows = _wide_csv_rows(_events(spark, sf_dir))
    odd = F.pmod(F.col("series_id").cast("bigint"), F.lit(2)) == 1
    out = DF.scratch_dir(spark, "csv-search")
    DF.write_csv_files(rows.where(odd), out, _csv_columns(), preamble=["Glucose Data"]).agg(F.sum("rows")).collect()
    DF.write_csv_files(rows.where(~odd), out, _csv_columns()).agg(F.sum("rows")).collect()
    table = replace(CAT.WIDE_CSV.files[0].tables[0], header_row=None)
    return _csv_values(R.convert_times(R.read_csv_table(spark, [out], table), table))


@query("csv_quoted_header", _CSV_SQL)
def csv_quoted_header(spark, sf_dir):
    """Exports whose header has a quoted line break and whose column
    order differs (odd people write it reversed, behind a preamble)."""
    from dataclasses import replace

    notes = "Notes\n(free text)"
    rows = _wide_csv_rows(_events(spark, sf_dir)).withColumnRenamed("Notes", notes)
    columns = [notes if c == "Notes" else c for c in _csv_columns()]
    odd = F.pmod(F.col("series_id").cast("bigint"), F.lit(2)) == 1
    out = DF.scratch_dir(spark, "csv-quoted")
    DF.write_csv_files(rows.where(odd), out, columns[::-1], preamble=["Glucose Data"]).agg(F.sum("rows")).collect()
    DF.write_csv_files(rows.where(~odd), out, columns).agg(F.sum("rows")).collect()
    wide = CAT.WIDE_CSV.files[0].tables[0]
    table = replace(wide, header_row=None, columns=tuple(replace(c, source_name=notes) if c.source_name == "Notes" else c for c in wide.columns))
    read = R.read_csv_table(spark, [out], table).withColumnRenamed(notes, "Notes")
    return _csv_values(R.convert_times(read, wide))


@query(
    "quarantine_counts",
    """SELECT CAST(user_id AS VARCHAR) AS series_id, count(*) AS rows, count_if(event_id % 25 = 0) AS quarantined
FROM events GROUP BY 1""",
)
def quarantine_counts(spark, sf_dir):
    """Rows whose time is missing or does not parse (one in 25 here) are
    kept apart and counted per person, never silently dropped."""
    rows = _wide_csv_rows(_events(spark, sf_dir))
    stamp = F.when(F.col("_seq") % 50 == 0, F.lit("n/a")).when(F.col("_seq") % 50 != 25, F.col("`Device Timestamp`"))
    out = DF.scratch_dir(spark, "csv-quarantine")
    DF.write_csv_files(rows.withColumn("Device Timestamp", stamp), out, _csv_columns(), preamble=["Glucose Data"]).agg(F.sum("rows")).collect()
    table = CAT.WIDE_CSV.files[0].tables[0]
    conv = R.convert_times(R.read_csv_table(spark, [out], table), table)
    return conv.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ts").isNull()).alias("quarantined"))


_XDRIP_TABLES = {
    "BgReadings": ["timestamp", "calculated_value", "raw_data"],
    "Treatments": ["timestamp", "insulin", "insulinJSON", "carbs", "notes"],
}


@query(
    "sqlite_source",
    f"""WITH {_SRC_EV},
t AS (SELECT series_id, make_timestamp((epoch_us(ts) // 1000) * 1000) AS ts, event_type, value, k FROM ev)
SELECT series_id, ts, 'CGM' AS data_type, 'cgm_primary' AS column_name, {r6_sql('40.0 + value * 3')} AS value, CAST(NULL AS VARCHAR) AS text FROM t WHERE event_type = 'view'
UNION ALL SELECT series_id, ts, 'CGM', 'cgm_2', {r6_sql('value * 1000')}, NULL FROM t WHERE event_type = 'view'
UNION ALL SELECT series_id, ts, 'INSULIN', 'insulin_primary', {r6_sql("CASE WHEN event_type = 'purchase' THEN value / 10 ELSE 0.0 END")}, NULL FROM t WHERE event_type IN ('purchase', 'signup', 'error')
UNION ALL SELECT series_id, ts, 'INSULIN_META', 'insulin_meta_primary', NULL,
  '[{{"insulin":"' || CASE k % 3 WHEN 0 THEN 'NovoRapid FlexPen' WHEN 1 THEN 'Levemir' ELSE 'Humalog' END || '"}}]' FROM t WHERE event_type = 'purchase'
UNION ALL SELECT series_id, ts, 'CARBS', 'carbs_primary', {r6_sql("CASE WHEN event_type = 'signup' THEN value - 5 ELSE 0.0 END")}, NULL FROM t WHERE event_type IN ('purchase', 'signup', 'error')
UNION ALL SELECT series_id, ts, 'NOTES', 'notes_primary', NULL, 'note ' || CAST(k AS VARCHAR) FROM t WHERE event_type = 'error'""",
)
def sqlite_source(spark, sf_dir):
    """Every person's events written as a two-table SQLite
    export (epoch-millisecond times), read back with the SQLite data source
    and unpivoted into the long event table."""
    ev = _events(spark, sf_dir)
    et, v = F.col("event_type"), F.col("value")
    rows = ev.where(et.isin("view", "purchase", "signup", "error")).select(
        F.col("user_id").cast("string").alias("series_id"),
        F.col("event_id").alias("_seq"),
        F.when(et == "view", F.lit("BgReadings")).otherwise(F.lit("Treatments")).alias("_table"),
        F.floor(micros("ts") / 1000).alias("timestamp"),
        F.when(et == "view", F.lit(40.0) + v * 3).alias("calculated_value"),
        F.when(et == "view", v * 1000).alias("raw_data"),
        F.when(et == "purchase", v / 10).otherwise(F.lit(0.0)).alias("insulin"),
        F.when(et == "purchase", D.meta_json(F.col("props"))).alias("insulinJSON"),
        F.when(et == "signup", v - 5).otherwise(F.lit(0.0)).alias("carbs"),
        F.when(et == "error", F.concat(F.lit("note "), F.get_json_object("props", "$.k"))).alias("notes"),
    )
    out = DF.scratch_dir(spark, "sqlite")
    DF.write_sqlite_files(rows, out, _XDRIP_TABLES).agg(F.sum("rows")).collect()
    specs = R.layout_specs(CAT.TWO_TABLE_SQLITE)
    one, two = (R.to_events(R.read_sqlite_table(spark, [out], tb), tb, specs)[0] for tb in CAT.TWO_TABLE_SQLITE.files[0].tables)
    long = one.unionByName(two)
    return long.select("series_id", "ts", "data_type", "column_name", r6("value").alias("value"), "text")


def _simple_rows(ev: DataFrame) -> DataFrame:
    et, v = F.col("event_type"), F.col("value")
    return ev.select(
        F.col("user_id").cast("string").alias("series_id"),
        F.col("event_id").alias("_seq"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"),
        F.when(et == "view", F.lit(40.0) + v * 3).alias("glucose"),
        F.when(et == "click", v * 2).alias("meter"),
        F.when(et == "purchase", v / 10).alias("dose"),
        F.when(et == "signup", v - 5).alias("carbs"),
        F.when(et == "error", F.concat(F.lit("note <"), F.get_json_object("props", "$.k"), F.lit("> & more"))).alias("note"),
    )


_SIMPLE_SQL = f"""WITH {_SRC_EV}
SELECT series_id, ts,
  {r6_sql("CASE WHEN event_type = 'view' THEN 40.0 + value * 3 END")} AS glucose,
  {r6_sql("CASE WHEN event_type = 'click' THEN value * 2 END")} AS meter,
  {{extra}}
  CASE WHEN event_type = 'error' THEN 'note <' || CAST(k AS VARCHAR) || '> & more' END AS note
FROM ev"""


@query(
    "json_source",
    _SIMPLE_SQL.format(
        extra=f"""{r6_sql("CASE WHEN event_type = 'purchase' THEN value / 10 END")} AS dose,
  {r6_sql("CASE WHEN event_type = 'signup' THEN value - 5 END")} AS carbs,"""
    ),
)
def json_source(spark, sf_dir):
    """S6 + T3: every person's events as a JSON export (``{"readings": [..]}``,
    ISO times with microseconds), read back with the JSON reader."""
    rows = _simple_rows(_events(spark, sf_dir))
    out = DF.scratch_dir(spark, "json")
    table = CAT.EXAMPLE_JSON.files[0].tables[0]
    DF.write_json_files(rows, out, ["time", "glucose", "meter", "dose", "carbs", "note"], key="readings").agg(F.sum("rows")).collect()
    conv = R.convert_times(R.read_json_table(spark, [out], table), table)
    return conv.select(
        "series_id",
        "ts",
        *[r6(F.expr(f"try_cast({c} as double)")).alias(c) for c in ("glucose", "meter", "dose", "carbs")],
        "note",
    )


@query(
    "json_mixed_folder",
    _SIMPLE_SQL.format(
        extra=f"""{r6_sql("CASE WHEN event_type = 'purchase' THEN value / 10 END")} AS dose,
  {r6_sql("CASE WHEN event_type = 'signup' THEN value - 5 END")} AS carbs,"""
    ),
)
def json_mixed_folder(spark, sf_dir):
    """One read of exports in three shapes: an object that holds a list, a
    plain list, and lines of one record each, by person."""
    rows = _simple_rows(_events(spark, sf_dir))
    out = DF.scratch_dir(spark, "json-mixed")
    table = CAT.EXAMPLE_JSON.files[0].tables[0]
    fields = ["time", "glucose", "meter", "dose", "carbs", "note"]
    kind = F.pmod(F.col("series_id").cast("bigint"), F.lit(3))
    DF.write_json_files(rows.where(kind == 0), out, fields, key="Readings").agg(F.sum("rows")).collect()
    DF.write_json_files(rows.where(kind == 1), out, fields).agg(F.sum("rows")).collect()
    DF.write_json_files(rows.where(kind == 2), out, fields, lines=True).agg(F.sum("rows")).collect()
    conv = R.convert_times(R.read_json_table(spark, [out], table), table)
    return conv.select("series_id", "ts", *[r6(F.expr(f"try_cast({c} as double)")).alias(c) for c in ("glucose", "meter", "dose", "carbs")], "note")


@query("xml_source", _SIMPLE_SQL.format(extra=""))
def xml_source(spark, sf_dir):
    """S4 + S5: every person's events as an XML export (time as attribute,
    values as child elements; empty elements are null), read back."""
    rows = _simple_rows(_events(spark, sf_dir))
    out = DF.scratch_dir(spark, "xml")
    table = CAT.EXAMPLE_XML.files[0].tables[0]
    DF.write_xml_files(rows, out, "reading", ["time"], ["glucose", "meter", "note"]).agg(F.sum("rows")).collect()
    conv = R.convert_times(R.read_xml_table(spark, [out], table), table)
    return conv.select(
        "series_id",
        "ts",
        *[r6(F.expr(f"try_cast({c} as double)")).alias(c) for c in ("glucose", "meter")],
        "note",
    )


@query(
    "conformance_report",
    """WITH u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS series_id, user_id % 3 AS kind FROM events)
SELECT series_id,
  CASE kind WHEN 1 THEN 'sqlite' ELSE 'csv' END AS file_type,
  CASE kind WHEN 0 THEN 'libreview_csv' WHEN 1 THEN 'xdrip_sqlite' END AS layout,
  CASE kind WHEN 2 THEN 'libreview_csv: Missing required columns in : notes' ELSE '' END AS failed_candidates
FROM u""",
)
def conformance_report(spark, sf_dir):
    """F1-F8: a folder of mixed exports made from the events (people split in
    three groups: wide CSV, SQLite, CSV lacking the Notes column) classified
    against the catalogue; one verdict per file."""
    from glucoflow.sources import conform

    ev = _events(spark, sf_dir)
    out = DF.scratch_dir(spark, "conform")
    kind = F.pmod(F.col("user_id"), F.lit(3))
    wide = _wide_csv_rows(ev.where(kind != 1))
    cols = [c.source_name for c in CAT.WIDE_CSV.files[0].tables[0].columns]
    cols.insert(2, "Device Timestamp")
    good, bad = wide.where(F.pmod(F.col("series_id").cast("bigint"), F.lit(3)) == 0), wide.where(
        F.pmod(F.col("series_id").cast("bigint"), F.lit(3)) == 2
    )
    DF.write_csv_files(good, out, cols, preamble=["Glucose Data"]).agg(F.sum("rows")).collect()
    DF.write_csv_files(bad, out, [c for c in cols if c != "Notes"], preamble=["Glucose Data"]).agg(F.sum("rows")).collect()
    et, v = F.col("event_type"), F.col("value")
    sq = ev.where(kind == 1).select(
        F.col("user_id").cast("string").alias("series_id"),
        F.col("event_id").alias("_seq"),
        F.when(et == "view", F.lit("BgReadings")).otherwise(F.lit("Treatments")).alias("_table"),
        F.floor(micros("ts") / 1000).alias("timestamp"),
        F.when(et == "view", F.lit(40.0) + v * 3).alias("calculated_value"),
        F.when(et == "view", v).alias("raw_data"),
        F.when(et == "purchase", v / 10).otherwise(F.lit(0.0)).alias("insulin"),
        F.lit(None).cast("string").alias("insulinJSON"),
        F.when(et == "signup", v - 5).otherwise(F.lit(0.0)).alias("carbs"),
        F.lit(None).cast("string").alias("notes"),
    )
    DF.write_sqlite_files(sq, out, _XDRIP_TABLES).agg(F.sum("rows")).collect()
    res = conform.classify(spark, out)
    return res.select(
        R.series_from_file(F.col("path")).alias("series_id"),
        "file_type",
        "layout",
        F.array_join("failed_candidates", " | ").alias("failed_candidates"),
    )


@query(
    "required_data_check",
    f"""WITH {_SRC_EV}
SELECT series_id,
  array_to_string(list_filter([
     CASE WHEN count_if(event_type = 'view') = 0 THEN 'Historic Glucose mmol/L' END,
     'Scan Glucose mmol/L'], lambda x: x IS NOT NULL), '|') AS missing_required_data
FROM ev GROUP BY series_id""",
)
def required_data_check(spark, sf_dir):
    """per export file, REQUIRED_WITH_DATA columns without a single value
    (the wide CSV exports from the events never fill the scan column)."""
    from glucoflow.sources import conform

    rows = _wide_csv_rows(_events(spark, sf_dir))
    out = DF.scratch_dir(spark, "f10")
    cols = [c.source_name for c in CAT.WIDE_CSV.files[0].tables[0].columns]
    cols.insert(2, "Device Timestamp")
    DF.write_csv_files(rows, out, cols, preamble=["Glucose Data"]).agg(F.sum("rows")).collect()
    table = CAT.WIDE_CSV.files[0].tables[0]
    df = R.read_csv_table(spark, [out], table).withColumn("series_id", R.series_from_file(F.col("_file")))
    chk = conform.required_data_check(df, table, ["series_id"])
    return chk.select("series_id", F.array_join("missing_required_data", "|").alias("missing_required_data"))


# ================================================================= sinks
def _export_types(spark, sf_dir, types=("INSULIN", "CARBS"), align=False, fmt="csv", **kw):
    from glucoflow.sinks import export as EX

    p = _processed(spark, sf_dir, types)
    out = DF.scratch_dir(spark, "export")
    return EX.write(spark, p, A.align(p) if align else None, out, fmt=fmt, **kw)


@query(
    "export_months",
    f"""{_USER}{TYPE_CTES}
SELECT series_id, strftime(ts, '%Y-%m') AS month, ts, {r6_sql('dose')} AS dose, is_bolus, is_basal, type FROM ins_out""",
)
def export_months(spark, sf_dir):
    """K1, K3, K6, K7, P20: insulin and carbs exported in (person, time) ranges
    with the calendar-month split, then the monthly insulin files read back."""
    from glucoflow.sinks.export import read_table

    back = read_table(spark, _export_types(spark, sf_dir)["base"], "monthly/insulin")
    return _round_all(back.select("series_id", "month", "ts", "dose", "is_bolus", "is_basal", "type"))


@query(
    "run_notes",
    f"""{_USER}{TYPE_CTES}
SELECT 'insulin' AS data_type, series_id, strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') AS date_range,
  count(*) AS record_count FROM ins_out GROUP BY series_id
UNION ALL
SELECT 'carbs', series_id, strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d'), count(*) FROM carb_out GROUP BY series_id""",
)
def run_notes(spark, sf_dir):
    """K5 + A19: run notes (date range, record count, columns, units) written
    as JSON per type and person, read back."""
    from glucoflow.sinks.export import NOTES_SCHEMA

    back = spark.read.schema(NOTES_SCHEMA).json(_export_types(spark, sf_dir)["processing_notes"])
    return back.where("scope = 'person'").select("data_type", "series_id", "date_range", "record_count")


def _aligned_ctes() -> str:
    ctes, select = align_select()
    return f"""{_USER}{TYPE_CTES},
{cgm_fill_ctes('cgm_raw')},
{ctes},
al AS ({select})"""


@query("export_aligned", f"{_aligned_ctes()} SELECT * FROM al")
def export_aligned(spark, sf_dir):
    """K2, K7: the aligned frame of a run as CSV, read back whole."""
    from glucoflow.sinks.export import read_table

    written = _export_types(spark, sf_dir, ("CGM", "BGM", "INSULIN", "CARBS", "NOTES"), align=True, split_by_month=False)
    return _round_all(read_table(spark, written["base"], "aligned"))


@query(
    "export_aligned_months",
    f"""{_aligned_ctes()},
am AS (SELECT *, strftime(ts, '%Y-%m') AS month FROM al)
SELECT * FROM am WHERE (series_id, month) IN (
  SELECT (series_id, month) FROM am GROUP BY series_id, month
  HAVING bool_or(coalesce(cgm_primary <> 0 OR cgm_primary_mmol <> 0, false) OR missing_cgm OR coalesce(bgm_primary <> 0 OR bgm_primary_mmol <> 0, false)
    OR coalesce(bgm_primary_clipped, false) OR basal_dose <> 0 OR bolus_dose <> 0 OR carbs_primary <> 0 OR notes_primary IS NOT NULL))""",
)
def export_aligned_months(spark, sf_dir):
    """K4, P20: the month split of the aligned frame, through the Parquet
    exporter into a folder that runs share, read back."""
    from glucoflow.sinks import export as EX

    aligned = A.align(_processed(spark, sf_dir))
    written = EX.write(spark, {}, aligned, DF.scratch_dir(spark, "export"), fmt="parquet", months_dir=DF.scratch_dir(spark, "months"))
    return _round_all(spark.read.schema(EX.with_month(aligned.frame.schema)).parquet(written["monthly/aligned"]))


def _month_notes_sql() -> str:
    """Month notes of every type and of the aligned frame, as text per field."""
    pct = lambda k, n, d: f"printf('%.{d}f%%', CASE WHEN {n} > 0 THEN round_even(100.0 * {k} / {n}, {d}) ELSE 0.0 END)"
    lines = {
        "cgm": [
            "'CGM Processing Notes:'", "'  Processed ' || count(*) || ' total CGM readings'",
            "'  Found ' || count_if({missing}) || ' missing or interpolated values'",
            f"'  Initial CGM completeness: ' || {pct('(count(*) - count_if({missing}))', 'count(*)', 2)}",
            f"'  CGM completeness after interpolation: ' || {pct('count(cgm_primary)', 'count(*)', 2)}",
        ],
        "bgm": [
            "'BGM Processing Notes (bgm_primary):'", "'Processed ' || count(bgm_primary) || ' total BGM readings'",
            f"'Found ' || count_if(bgm_primary_clipped) || ' clipped values (' || {pct('count_if(bgm_primary_clipped)', 'count(bgm_primary)', 1)} || ')'",
        ],
        "insulin": ["'INSULIN Processing Notes:'", "'Found ' || ({basal} + {bolus}) || ' total doses'", "{basal} || ' basal doses'", "{bolus} || ' bolus doses'"],
        "carbs": ["'CARBS Processing Notes:'", "'  Found ' || count_if(carbs_primary > 0) || ' carb entries'"],
        "notes": ["'NOTES Processing Notes:'", "'  Found ' || count(notes_primary) || ' notes entries'"],
    }
    tables = {
        "cgm": ("cgm_f", ["cgm_primary", "cgm_primary_mmol", "missing"], {"cgm_primary": "mg/dL", "cgm_primary_mmol": "mmol/L"}),
        "bgm": ("bgm_out", ["bgm_primary", "bgm_primary_clipped", "bgm_primary_mmol"], {"bgm_primary": "mg/dL", "bgm_primary_mmol": "mmol/L"}),
        "insulin": ("ins_out", ["dose", "is_bolus", "is_basal", "type"], {"dose": "U"}),
        "carbs": ("carb_out", ["carbs_primary"], {"carbs_primary": "g"}),
        "notes": ("note_out", ["notes_primary"], {}),
        "aligned": (
            "al",
            ["cgm_primary", "cgm_primary_mmol", "missing_cgm", "bgm_primary", "bgm_primary_clipped", "bgm_primary_mmol", "basal_dose", "bolus_dose", "carbs_primary", "notes_primary"],
            {"cgm_primary": "mg/dL", "cgm_primary_mmol": "mmol/L", "bgm_primary": "mg/dL", "bgm_primary_mmol": "mmol/L", "dose": "U", "carbs_primary": "g"},
        ),
    }
    parts = []
    for name, (table, columns, units) in tables.items():
        own = [x for v in lines.values() for x in v] if name == "aligned" else lines[name]
        doses = {"basal": "count_if(basal_dose > 0)", "bolus": "count_if(bolus_dose > 0)"} if name == "aligned" else {"basal": "count_if(is_basal)", "bolus": "count_if(is_bolus)"}
        fill = {"missing": "missing_cgm" if name == "aligned" else "missing", **doses}
        texts = [x.format(**fill) for x in own]
        if name == "insulin":  # every row is a dose, whatever its class
            texts[1] = "'Found ' || count(*) || ' total doses'"
        text = " || chr(10) || ".join(["'Period: ' || strftime(ts, '%Y-%m')", "'Records: ' || count(*)", *texts])
        share = " || ',' || ".join(f"'{c}=' || {pct(f'count({c})', 'count(*)', 2)}" for c in columns) if name == "aligned" else "''"
        parts.append(f"""SELECT '{name}' AS data_type, series_id, strftime(ts, '%Y-%m') AS month,
  strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') AS date_range, count(*) AS record_count,
  '{','.join(columns)}' AS columns_present, {text} AS notes, '{','.join(f'{k}={v}' for k, v in units.items())}' AS source_units,
  {"'5min'" if name == "aligned" else "NULL"} AS frequency, {share} AS completeness, '2024-02-01' AS export_date
FROM {table} GROUP BY series_id, strftime(ts, '%Y-%m')""")
    return f"""{_aligned_ctes()},
cgm_f AS (SELECT series_id, {ts_sql('slot')} AS ts, cgm_primary, cgm_primary * 0.0555 AS cgm_primary_mmol, missing FROM cgm_out)
{' UNION ALL '.join(parts)}"""


@query("export_month_notes", _month_notes_sql())
def export_month_notes(spark, sf_dir):
    """The notes of every exported month, per type and for the
    aligned frame, with all their fields."""
    from glucoflow.sinks.export import NOTES_SCHEMA

    written = _export_types(spark, sf_dir, ("CGM", "BGM", "INSULIN", "CARBS", "NOTES"), align=True, fmt="parquet", export_date="2024-02-01")
    back = spark.read.schema(NOTES_SCHEMA).json(written["processing_notes"]).where("scope = 'month'")
    pairs = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return back.select(
        "data_type", "series_id", "month", "date_range", "record_count",
        F.array_join("columns_present", ",").alias("columns_present"),
        F.array_join("notes", "\n").alias("notes"),
        pairs("source_units").alias("source_units"),
        "frequency",
        pairs("completeness").alias("completeness"),
        "export_date",
    )


_S15 = 900_000_000


def _align15_sql(_S15: int = _S15) -> str:
    sl = lambda c: slot_sql(f"epoch_us({c})", _S15)
    return f"""{_USER}{TYPE_CTES},
{cgm_fill_ctes('cgm_raw')},
ref AS (SELECT series_id, slot * 300000000 AS us FROM cgm_out WHERE slot % {_S15 // 300_000_000} = 0),
c15 AS (SELECT series_id, {slot_sql('slot * 300000000', _S15)} AS s, avg(cgm_primary) AS cgm_primary,
        avg(cgm_primary * 0.0555) AS cgm_primary_mmol FROM cgm_out GROUP BY 1, 2),
b15 AS (SELECT series_id, {sl('ts')} AS s, avg(bgm_primary) AS bgm_primary, bool_or(bgm_primary_clipped) AS bgm_primary_clipped,
        avg(bgm_primary_mmol) AS bgm_primary_mmol FROM bgm_out GROUP BY 1, 2),
bsp AS (SELECT series_id, min({sl('ts')}) AS lo, max({sl('ts')}) AS hi FROM bgm_out GROUP BY 1),
i15 AS (SELECT series_id, {sl('ts')} AS s, sum(CASE WHEN is_basal THEN dose ELSE 0.0 END) AS basal_dose,
        sum(CASE WHEN is_bolus THEN dose ELSE 0.0 END) AS bolus_dose FROM ins_out GROUP BY 1, 2),
k15 AS (SELECT series_id, {sl('ts')} AS s, sum(carbs_primary) AS carbs_primary FROM carb_out GROUP BY 1, 2),
n15 AS (SELECT series_id, {sl('ts')} AS s, arg_max(notes_primary, {{'t': ts, 's': _seq}}) AS notes_primary FROM note_out GROUP BY 1, 2)
SELECT r.series_id, make_timestamp(r.us) AS ts,
  {r6_sql('c.cgm_primary')} AS cgm_primary, {r6_sql('c.cgm_primary_mmol')} AS cgm_primary_mmol,
  {r6_sql('b.bgm_primary')} AS bgm_primary,
  coalesce(b.bgm_primary_clipped, CASE WHEN r.us >= bs.lo * {_S15} AND r.us <= bs.hi * {_S15} THEN false END) AS bgm_primary_clipped,
  {r6_sql('b.bgm_primary_mmol')} AS bgm_primary_mmol,
  {r6_sql('coalesce(i.basal_dose, 0.0)')} AS basal_dose, {r6_sql('coalesce(i.bolus_dose, 0.0)')} AS bolus_dose,
  {r6_sql('coalesce(k.carbs_primary, 0.0)')} AS carbs_primary, n.notes_primary AS notes_primary
FROM ref r
LEFT JOIN c15 c ON c.series_id = r.series_id AND c.s * {_S15} = r.us
LEFT JOIN b15 b ON b.series_id = r.series_id AND b.s * {_S15} = r.us
LEFT JOIN bsp bs ON bs.series_id = r.series_id
LEFT JOIN i15 i ON i.series_id = r.series_id AND i.s * {_S15} = r.us
LEFT JOIN k15 k ON k.series_id = r.series_id AND k.s * {_S15} = r.us
LEFT JOIN n15 n ON n.series_id = r.series_id AND n.s * {_S15} = r.us"""


def _align_on_step(spark, sf_dir, step: int, freq: str) -> DataFrame:
    p = _processed(spark, sf_dir)
    ref = p["CGM"].frame.where(F.pmod(micros("ts"), F.lit(step)) == 0).select("series_id", "ts")
    return _round_all(A.align(p, reference=ref, freq=freq).frame)


@query("align_15min", _align15_sql())
def align_15min(spark, sf_dir):
    """M8 with a caller's timeline and another step: each person's 15-minute
    timeline (the quarter-hour points of the CGM grid); CGM is averaged per
    15-minute slot, the other types resampled at 15 minutes."""
    return _align_on_step(spark, sf_dir, _S15, "15min")


@query("align_1h", _align15_sql(3_600_000_000))
def align_1h(spark, sf_dir):
    """M8 with an hourly caller timeline (the full hours of the CGM grid);
    every type resampled at one hour."""
    return _align_on_step(spark, sf_dir, 3_600_000_000, "1h")


@query(
    "align_rejects",
    f"""{_USER}{TYPE_CTES},
{cgm_fill_ctes('cgm_raw')}
SELECT series_id, count(*) AS rows, 0 AS order_violations, 600000000 AS modal_step_us
FROM cgm_out WHERE CAST(series_id AS BIGINT) % 2 = 1 AND slot % 2 = 0 GROUP BY series_id HAVING count(*) > 1""",
)
def align_rejects(spark, sf_dir):
    """W8 in alignment: people with odd ids bring a 10-minute timeline to a
    5-minute alignment; their verdicts come with the result."""
    p = _processed(spark, sf_dir)
    odd = F.pmod(F.col("series_id").cast("bigint"), F.lit(2)) == 1
    ref = p["CGM"].frame.where(~odd | (F.pmod(micros("ts"), F.lit(600_000_000)) == 0)).select("series_id", "ts")
    return A.align(p, reference=ref).rejects.select("series_id", "rows", "order_violations", "modal_step_us").where("rows > 1")


@query(
    "export_complete",
    f"""{_USER}{TYPE_CTES}
SELECT series_id, ts, {r6_sql('carbs_primary')} AS carbs_primary FROM carb_out""",
)
def export_complete(spark, sf_dir):
    """K1, K7: the complete carbs dataset of a run, read back."""
    from glucoflow.sinks.export import read_table

    return _round_all(read_table(spark, _export_types(spark, sf_dir)["base"], "carbs"))


def _period_sql() -> str:
    ctes, select = align_select()
    return f"""{_USER}{TYPE_CTES},
{cgm_fill_ctes('cgm_raw')},
{ctes},
al AS ({select})
SELECT series_id, strftime(ts, '%Y-%m') AS month, count(*) AS records,
  count_if(missing_cgm) AS cgm_missing,
  round(100.0 * (count(*) - count_if(missing_cgm)) / count(*), 2) AS cgm_initial_pct,
  round(100.0 * count(cgm_primary) / count(*), 2) AS cgm_after_fill_pct,
  count(bgm_primary) AS bgm_readings, count_if(bgm_primary_clipped) AS bgm_clipped,
  CASE WHEN count(bgm_primary) > 0 THEN round(100.0 * count_if(bgm_primary_clipped) / count(bgm_primary), 1) ELSE 0.0 END AS bgm_clipped_pct,
  count_if(basal_dose > 0) + count_if(bolus_dose > 0) AS insulin_doses,
  count_if(basal_dose > 0) AS basal_doses, count_if(bolus_dose > 0) AS bolus_doses,
  count_if(carbs_primary > 0) AS carb_entries, count(notes_primary) AS notes
FROM al GROUP BY 1, 2"""


@query("period_stats", _period_sql())
def period_stats(spark, sf_dir):
    """A9 + A13-A15 + A20: monthly statistics of the aligned frame per person
    (CGM completeness, BGM clipping, dose counts, carb entries, notes)."""
    from glucoflow.operators.quality import period_stats as ps

    return ps(A.align(_processed(spark, sf_dir)).frame)


@query(
    "cgm_no_tail_fill",
    f"""WITH sensor AS (SELECT event_type AS series_id, ts, 40.0 + value * 3 AS v FROM events),
{cgm_fill_ctes('sensor', fill_tail=False)}
SELECT series_id, {ts_sql('slot')} AS ts, {r6_sql('cgm_primary')} AS cgm_primary, missing FROM cgm_out""",
)
def cgm_no_tail_fill(spark, sf_dir):
    """W6 option (Q6): the dense sensors again, with trailing gaps left empty
    instead of repeating the last reading."""
    p = C.cgm(D.sensor_events(_events(spark, sf_dir)), fill_tail=False)
    return p.frame.select("series_id", "ts", r6("cgm_primary").alias("cgm_primary"), "missing")


@query(
    "insulin_union_doses",
    f"""{_USER}{TYPE_CTES},
two AS (
  SELECT series_id, ts, dose FROM ins_pos
  UNION ALL SELECT series_id, ts, value / 20 FROM ev WHERE event_type = 'error' AND value / 20 > 0
)
SELECT t.series_id, t.ts, {r6_sql('t.dose')} AS dose,
  CASE WHEN m.t = 'novorapid' THEN true WHEN m.t = 'levemir' THEN false ELSE t.dose <= 8.0 END AS is_bolus,
  CASE WHEN m.t = 'novorapid' THEN false WHEN m.t = 'levemir' THEN true ELSE t.dose > 8.0 AND t.dose <= 15.0 END AS is_basal,
  coalesce(m.t, '') AS type
FROM two t LEFT JOIN ins_mt m ON t.series_id = m.series_id AND t.ts = m.ts""",
)
def insulin_union_doses(spark, sf_dir):
    """M5 with two dose columns (Q2 fix): rapid doses from purchases and a
    second, long-acting column from error events (value / 20); every
    positive dose of either column is a row, none overwrites another."""
    ev = _events(spark, sf_dir)
    second = D._long(ev.where(F.col("event_type") == "error"), F.col("user_id"), "INSULIN", "insulin_2", "U", F.col("value") / 20)
    return _round_all(C.insulin(D.device_events(ev).unionByName(second)).frame)


def _notes_sql() -> str:
    return f"""{_USER}{TYPE_CTES},
{cgm_fill_ctes('cgm_raw')},
c AS (SELECT series_id, count(*) AS n, count_if(missing) AS miss, count_if(cgm_primary IS NULL) AS na,
        round(100.0 * count_if(NOT missing) / count(*), 2) AS p1, round(100.0 * count(cgm_primary) / count(*), 2) AS p2
      FROM cgm_out GROUP BY 1),
bv AS (SELECT series_id, ts, value, value * 18.0182 AS mg FROM bgm_raw),
bk AS (SELECT series_id, count(DISTINCT ts) AS readings, min(ts) AS a, max(ts) AS b FROM bv WHERE value > 0 GROUP BY 1),
bc AS (SELECT series_id, count_if(NOT coalesce(value > 0, false)) AS removed,
        count_if(value > 0 AND mg < 39.64) AS lo, count_if(value > 0 AND mg > 360.36) AS hi FROM bv GROUP BY 1),
bo AS (SELECT series_id, min(ts) AS a, max(ts) AS b FROM bgm_out GROUP BY 1),
b AS (SELECT bc.series_id, removed, lo, hi, coalesce(readings, 0) AS readings,
        {r6_sql("readings / CASE WHEN epoch_us(bk.b) - epoch_us(bk.a) > 0 THEN (epoch_us(bk.b) - epoch_us(bk.a)) / 86400e6 END")} AS rate,
        bo.a AS a, bo.b AS b
      FROM bc LEFT JOIN bk USING (series_id) LEFT JOIN bo USING (series_id)),
i AS (SELECT p.series_id, count(*) AS n, count_if(dose <= 8.0) AS bol, count_if(dose > 8.0 AND dose <= 15.0) AS bas,
        count_if(dose > 15.0) AS over,
        (SELECT count(*) FROM ins_meta m WHERE m.t IS NOT NULL AND m.series_id = p.series_id
           AND EXISTS (SELECT 1 FROM ins_pos d WHERE d.series_id = m.series_id AND d.ts = m.ts)) AS upd
      FROM ins_pos p GROUP BY 1),
kc AS (SELECT series_id, ts, CASE WHEN value >= 1.0 THEN value END AS v FROM carb_raw),
k AS (SELECT series_id, count(*) AS orig, count(v) AS kept, round(100.0 * count(v) / count(*), 1) AS pct,
        count(DISTINCT CASE WHEN v IS NOT NULL THEN ts END) AS fin FROM kc GROUP BY 1),
n AS (SELECT series_id, count(*) AS n FROM note_out GROUP BY 1)
SELECT series_id, 'CGM' AS data_type, concat_ws(' | ',
  printf('Processed %d total CGM readings', n), printf('Found %d missing or interpolated values in primary data', miss),
  printf('Found %d missing values after interpolation', na), printf('Initial CGM dataset completeness: %.2f%%', round(p1, 2)),
  printf('CGM completeness after interpolation: %.2f%%', round(p2, 2))) AS notes FROM c
UNION ALL
SELECT series_id, 'BGM', concat_ws(' | ',
  printf('Removed %d invalid/zero values from column 1', removed),
  printf('Clipped %d values in column bgm_primary (%d below range, %d above range)', lo + hi, lo, hi),
  printf('Processed %d total BGM readings', readings), printf('Average of %.1f readings per day', round(coalesce(rate, 0.0), 1)),
  'Date range: ' || strftime(a, '%Y-%m-%d %H:%M:%S.%f') || ' to ' || strftime(b, '%Y-%m-%d %H:%M:%S.%f')) FROM b
UNION ALL
SELECT series_id, 'INSULIN', concat_ws(' | ',
  printf('Found %d positive doses', n), printf('- %d doses classified as bolus (≤8.0U)', bol),
  printf('- %d doses classified as basal (>8.0U)', bas), printf('- Dropped %d doses exceeding 15.0U', over),
  printf('Updated %d classifications using metadata', upd), printf('Final dataset contains %d insulin records', n)) FROM i
UNION ALL
SELECT series_id, 'CARBS', concat_ws(' | ',
  printf('Column carbs_primary: Kept %d entries ≥1g (%.1f%%)', kept, round(pct, 1)),
  printf('Removed %d duplicate timestamps', kept - coalesce(fin, 0)),
  printf('Final dataset contains %d entries from %d original records', coalesce(fin, 0), orig)) FROM k
UNION ALL
SELECT series_id, 'NOTES', concat_ws(' | ',
  printf('Column notes_primary: found %d valid notes', n), printf('Final dataset contains %d notes entries', n)) FROM n"""


@query("processing_notes", _notes_sql())
def processing_notes(spark, sf_dir):
    """M10 + K5 + A9, A11-A18: each person's processing notes per data type
    (the original notes text with that person's numbers)."""
    from glucoflow.operators.quality import data_notes

    p = _processed(spark, sf_dir)
    n = data_notes(_devices(spark, sf_dir), p)
    return n.select("series_id", "data_type", F.array_join("notes", " | ").alias("notes"))

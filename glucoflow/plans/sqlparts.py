"""DuckDB SQL fragments for the oracle queries (independent restatements).

The oracles restate each operator in plain SQL over the driver's tables so
the Spark plans can be checked value by value.  They use the dense form of
the fill (calendar grid + ``ignore nulls`` windows), not the Spark code's
block-wise sparse form.
"""

from __future__ import annotations

STEP_5MIN = 300_000_000


def slot_sql(us: str, step: int = STEP_5MIN) -> str:
    """Half-to-even rounding of ``us`` micros to a slot number (SQL text)."""
    half = step // 2
    r = f"((({us}) % {step}) + {step}) % {step}"
    q = f"((({us}) - {r}) // {step})"
    return f"({q} + CASE WHEN {r} > {half} OR ({r} = {half} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"


def ts_sql(slot: str, step: int = STEP_5MIN) -> str:
    return f"make_timestamp(({slot}) * {step})"


def r6_sql(x: str) -> str:
    """Same rounding as ``queries.r6`` (plain double arithmetic)."""
    return f"(floor(({x}) * 1000000.0 + 0.5) / 1000000.0)"


def clip_sql(v: str) -> str:
    return f"CASE WHEN {v} < 39.64 THEN 39.64 WHEN {v} > 360.36 THEN 360.36 ELSE {v} END"


# device stream mapping, restated
DEVICE_CTE = f"""
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS series_id, ts, event_id AS _seq, event_type, value, props,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
),
cgm_raw AS (SELECT series_id, ts, _seq, 40.0 + value * 3 AS v FROM ev WHERE event_type = 'view'),
bgm_raw AS (SELECT series_id, ts, _seq, value / 5 AS value FROM ev WHERE event_type = 'click'),
ins_raw AS (SELECT series_id, ts, _seq, value / 10 AS value, k FROM ev WHERE event_type = 'purchase'),
carb_raw AS (SELECT series_id, ts, _seq, value - 5 AS value FROM ev WHERE event_type = 'signup'),
note_raw AS (
  SELECT series_id, ts, _seq,
         CASE WHEN k % 10 = 0 THEN NULL ELSE 'note ' || CAST(k AS VARCHAR) END AS note
  FROM ev WHERE event_type = 'error'
)"""


def cgm_fill_ctes(raw: str, limit: int = 4, step: int = STEP_5MIN, fill_tail: bool = True) -> str:
    """CTEs ending in ``cgm_out(series_id, slot, cgm_primary, missing)``.

    ``raw`` is a relation with ``series_id, ts, v`` (mg/dL).
    """
    tail = "pv" if fill_tail else "NULL"
    return f"""
cb AS (SELECT series_id, {slot_sql('epoch_us(ts)', step)} AS slot, v FROM {raw}),
cspan AS (SELECT series_id, min(slot) AS lo, max(slot) AS hi FROM cb GROUP BY series_id),
cobs AS (SELECT series_id, slot, avg(v) AS v FROM cb WHERE v IS NOT NULL GROUP BY series_id, slot),
cgrid AS (SELECT series_id, unnest(range(lo, hi + 1)) AS slot FROM cspan),
cf AS (SELECT g.series_id, g.slot, o.v FROM cgrid g LEFT JOIN cobs o ON g.series_id = o.series_id AND g.slot = o.slot),
cw AS (
  SELECT series_id, slot, v,
    last_value(CASE WHEN v IS NOT NULL THEN slot END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pb,
    last_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
    first_value(CASE WHEN v IS NOT NULL THEN slot END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nb,
    first_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
  FROM cf
),
cz AS (SELECT *, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, pb) AS gap FROM cw),
cfill AS (
  SELECT series_id, slot, v IS NULL AS missing,
    CASE WHEN v IS NOT NULL THEN v
         WHEN pb IS NULL OR gap > {limit} THEN NULL
         WHEN nb IS NULL THEN {tail}
         ELSE pv + (nv - pv) / (nb - pb) * (slot - pb) END AS iv
  FROM cz
),
cgm_out AS (SELECT series_id, slot, {clip_sql('iv')} AS cgm_primary, missing FROM cfill)"""


# per-type cleaners, restated over DEVICE_CTE
TYPE_CTES = f"""
bgm_v AS (SELECT series_id, ts, _seq, value * 18.0182 AS v FROM bgm_raw WHERE value > 0),
bgm_last AS (SELECT series_id, ts, arg_max(v, _seq) AS v FROM bgm_v GROUP BY series_id, ts),
bgm_out AS (
  SELECT series_id, ts, {clip_sql('v')} AS bgm_primary, (v < 39.64 OR v > 360.36) AS bgm_primary_clipped,
         {clip_sql('v')} * 0.0555 AS bgm_primary_mmol
  FROM bgm_last
),
ins_pos AS (SELECT series_id, ts, _seq, value AS dose FROM ins_raw WHERE value > 0),
ins_meta AS (
  SELECT series_id, ts, _seq,
         CASE WHEN nm LIKE '%novorapid%' THEN 'novorapid' WHEN nm LIKE '%levemir%' THEN 'levemir' END AS t
  FROM (SELECT series_id, ts, _seq,
               CASE k % 3 WHEN 0 THEN 'novorapid flexpen' WHEN 1 THEN 'levemir' ELSE 'humalog' END AS nm
        FROM ins_raw)
),
ins_mt AS (SELECT series_id, ts, arg_max(t, _seq) AS t FROM ins_meta WHERE t IS NOT NULL GROUP BY series_id, ts),
ins_out AS (
  SELECT i.series_id, i.ts, i.dose,
    CASE WHEN m.t = 'novorapid' THEN true WHEN m.t = 'levemir' THEN false ELSE i.dose <= 8.0 END AS is_bolus,
    CASE WHEN m.t = 'novorapid' THEN false WHEN m.t = 'levemir' THEN true ELSE i.dose > 8.0 AND i.dose <= 15.0 END AS is_basal,
    coalesce(m.t, '') AS type
  FROM ins_pos i LEFT JOIN ins_mt m ON i.series_id = m.series_id AND i.ts = m.ts
),
carb_out AS (
  SELECT series_id, ts, arg_min(value, _seq) AS carbs_primary
  FROM carb_raw WHERE value >= 1.0 GROUP BY series_id, ts
),
note_txt AS (
  SELECT series_id, ts, _seq,
         CASE WHEN k % 10 = 0 THEN ' ' || chr(9) || ' ' ELSE chr(9) || ' note ' || CAST(k AS VARCHAR) || '  ' END AS raw
  FROM ev WHERE event_type = 'error'
),
note_out AS (
  SELECT series_id, ts, _seq, notes_primary FROM (
    SELECT series_id, ts, _seq, nullif(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '') AS notes_primary FROM note_txt
  ) WHERE notes_primary IS NOT NULL
)"""


def align_select(step: int = STEP_5MIN, types=("BGM", "INSULIN", "CARBS", "NOTES")) -> str:
    """CTEs + final SELECT of the aligned frame over ``cgm_out`` (per user)."""
    sl = lambda c: slot_sql(f"epoch_us({c})", step)
    parts, joins, cols = [], [], []
    if "BGM" in types:
        parts.append(f"""a_bgm AS (SELECT series_id, {sl('ts')} AS slot, avg(bgm_primary) AS bgm_primary,
              bool_or(bgm_primary_clipped) AS bgm_primary_clipped, avg(bgm_primary_mmol) AS bgm_primary_mmol
              FROM bgm_out GROUP BY 1, 2),
a_bspan AS (SELECT series_id, min({sl('ts')}) AS lo, max({sl('ts')}) AS hi FROM bgm_out GROUP BY 1)""")
        joins.append("LEFT JOIN a_bgm b ON b.series_id = c.series_id AND b.slot = c.slot LEFT JOIN a_bspan bs ON bs.series_id = c.series_id")
        cols += [f"{r6_sql('b.bgm_primary')} AS bgm_primary",
                 "coalesce(b.bgm_primary_clipped, CASE WHEN c.slot BETWEEN bs.lo AND bs.hi THEN false END) AS bgm_primary_clipped",
                 f"{r6_sql('b.bgm_primary_mmol')} AS bgm_primary_mmol"]
    if "INSULIN" in types:
        parts.append(f"""a_ins AS (SELECT series_id, {sl('ts')} AS slot,
              sum(CASE WHEN is_basal THEN dose ELSE 0.0 END) AS basal_dose,
              sum(CASE WHEN is_bolus THEN dose ELSE 0.0 END) AS bolus_dose FROM ins_out GROUP BY 1, 2)""")
        joins.append("LEFT JOIN a_ins i ON i.series_id = c.series_id AND i.slot = c.slot")
        cols += [f"{r6_sql('coalesce(i.basal_dose, 0.0)')} AS basal_dose", f"{r6_sql('coalesce(i.bolus_dose, 0.0)')} AS bolus_dose"]
    if "CARBS" in types:
        parts.append(f"a_carb AS (SELECT series_id, {sl('ts')} AS slot, sum(carbs_primary) AS carbs_primary FROM carb_out GROUP BY 1, 2)")
        joins.append("LEFT JOIN a_carb k ON k.series_id = c.series_id AND k.slot = c.slot")
        cols += [f"{r6_sql('coalesce(k.carbs_primary, 0.0)')} AS carbs_primary"]
    if "NOTES" in types:
        parts.append(f"""a_note AS (SELECT series_id, {sl('ts')} AS slot,
              arg_max(notes_primary, {{'t': ts, 's': _seq}}) AS notes_primary FROM note_out GROUP BY 1, 2)""")
        joins.append("LEFT JOIN a_note n ON n.series_id = c.series_id AND n.slot = c.slot")
        cols += ["n.notes_primary AS notes_primary"]
    ctes = ",\n".join(parts)
    select = f"""SELECT c.series_id, {ts_sql('c.slot', step)} AS ts, {r6_sql('c.cgm_primary')} AS cgm_primary,
  {r6_sql('c.cgm_primary * 0.0555')} AS cgm_primary_mmol, c.missing AS missing_cgm{''.join(', ' + x for x in cols)}
FROM cgm_out c {' '.join(joins)}"""
    return ctes, select

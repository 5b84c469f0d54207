"""Regular grid with limited linear gap filling, and block-wise "next row".

The grid is built from the observed slots themselves: every observed slot
emits the slots up to the next observed slot (``explode(sequence(..))``), so
grid, gap lengths and interpolation need no join with a dense calendar.

Skew: one person (series) may hold a large share of all readings, so no
window is partitioned by the series alone.  Windows run per
``(series, block)`` where a block is a fixed number of slots (one day by
default), which bounds a window partition at ``block_slots`` slot rows after
the slot aggregation, whatever the raw reading rate.  What crosses a block
boundary comes from the small table of per-block summaries (a few rows per
series-day): carried into the previous block as a sentinel row
(``with_next``) or scanned per series and joined back on
``(series, block)`` (``wide_grid``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK_SLOTS = 288  # one day of 5-minute slots


def with_next(
    df: DataFrame,
    keys: list[str],
    order: str,
    carry: list[str],
    block_width: int,
) -> DataFrame:
    """Add ``next_<order>`` and ``next_<c>`` for ``c`` in ``carry``: the values
    of the following row in ``order`` within each ``keys`` group.

    Windows are partitioned by ``keys + block`` with ``block = order div
    block_width``; the first row of the next non-empty block is carried into
    the previous block as a sentinel row, so a hot key is spread over many
    tasks and no join is needed.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(block_width)))
    # first row of each non-empty block; small (one row per block)
    heads = blocked.groupBy(*keys, "_block").agg(
        F.min_by(F.struct(order, *carry), F.col(order)).alias("_head")
    )
    w_heads = Window.partitionBy(*keys).orderBy("_block")
    carried = (
        heads.withColumn("_prev_block", F.lag("_block").over(w_heads))
        .where(F.col("_prev_block").isNotNull())
        .select(
            *keys,
            F.col("_prev_block").alias("_block"),
            *[F.col(f"_head.{c}").alias(c) for c in [order, *carry]],
            F.lit(True).alias("_sentinel"),
        )
    )
    # other columns ride along on the real rows (null on sentinels)
    extra = [c for c in df.columns if c not in {*keys, order, *carry}]
    rows = blocked.select(*keys, "_block", order, *carry, *extra, F.lit(False).alias("_sentinel"))
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    out = rows.unionByName(carried, allowMissingColumns=True)
    for c in [order, *carry]:
        out = out.withColumn(f"next_{c}", F.lead(c).over(w))
    return out.where(~F.col("_sentinel")).drop("_sentinel", "_block")


def next_observation(obs: DataFrame, keys: list[str], block_slots: int = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """Add ``next_slot`` / ``next_v`` (the following observation) to ``obs``.

    ``obs`` has ``keys + [slot, v]``, one row per observed slot.
    """
    return with_next(obs, keys, "slot", ["v"], block_slots)


def wide_grid(
    obs: DataFrame,
    columns: list[str],
    limit: int = 4,
    fill_tail: bool = True,
    block_slots: int = DEFAULT_BLOCK_SLOTS,
    carried: list[str] | None = None,
    spans: dict[str, str] | None = None,
    in_ranges: bool = False,
    runs_of: int | None = None,
) -> DataFrame:
    """Regular grid with every column filled, emitted directly in wide form.

    ``carried``: further columns of ``obs`` that belong to their own slot only
    (null on the slots a row fills).  With them ``obs`` has a boolean ``_grid``:
    rows that aren't of the type itself don't widen its grid, and those outside
    it are left out.  ``spans``: name -> boolean column of ``obs``; the result
    tells by ``name`` whether a slot lies between the first and the last row of
    its series where that column is true (null: there is none).

    ``obs``: ``series_id, slot, <columns>`` - one row per slot that has any
    reading row of the type (a column is null where it has no value; a row
    may be null in every column and still widens the grid, as in the
    original pipeline).  The grid of a series runs from its first to its
    last such slot.

    ``in_ranges``: the partitions of the result are ranges of (series, slot), in
    that order, so a sink needs no shuffle and no sort of the dense rows.

    Rules per column: a gap of more than ``limit`` slots stays entirely
    null; shorter inner gaps get a straight line between the neighbours; a
    trailing gap up to ``limit`` repeats the last value (off with
    ``fill_tail=False``); slots before the column's first reading stay null.

    Previous / next
    readings of every column come from windows per ``(series, block)``
    (growing frames only, one ascending and one descending); readings in
    other blocks come from a block summary (first / last reading per column
    per block) computed on the already partitioned rows, scanned per series
    with ``ignore nulls`` windows (a few rows per series-day) and joined back
    on ``(series, block)``.  Each row then emits its own slots up to the next
    row, so the dense grid is produced once, in place, and never shuffled.

    Returns ``series_id, slot, <columns>, <c>__obs`` (``<c>__obs``: the
    column had a reading in that slot).
    """
    carried, spans = carried or [], spans or {}
    own = F.col("_grid") if carried else F.lit(True)
    bounds = {"grid": own} | {name: F.coalesce(F.col(c), F.lit(False)) for name, c in spans.items()}
    keys = ["series_id", "_block"]
    b = obs.withColumn("_block", F.floor(F.col("slot") / F.lit(block_slots)))
    at = {c: F.when(F.col(c).isNotNull(), F.col("slot")) for c in columns}
    w = Window.partitionBy(*keys).orderBy("slot")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    wd = Window.partitionBy(*keys).orderBy(F.col("slot").desc())
    later = wd.rowsBetween(Window.unboundedPreceding, -1)  # rows after, nearest first
    rows = b.select(
        *keys,
        "slot",
        *columns,
        *carried,
        *[F.when(is_in, F.col("slot")).alias(f"_in_{name}") for name, is_in in bounds.items()],
        F.lead("slot").over(w).alias("_next_any"),
        *[F.last(at[c], ignorenulls=True).over(upto).alias(f"_ps_{c}") for c in columns],
        *[F.last(c, ignorenulls=True).over(upto).alias(f"_pv_{c}") for c in columns],
        *[F.last(at[c], ignorenulls=True).over(later).alias(f"_ns_{c}") for c in columns],
        *[F.last(c, ignorenulls=True).over(later).alias(f"_nv_{c}") for c in columns],
    )
    # block summary on the rows as partitioned by the window (no exchange)
    summ = rows.groupBy(*keys).agg(
        F.min("slot").alias("_bfirst"),
        *[e for name in bounds for e in (F.min(f"_in_{name}").alias(f"_lo_{name}"), F.max(f"_in_{name}").alias(f"_hi_{name}"))],
        *[F.min(at[c]).alias(f"_fs_{c}") for c in columns],
        *[F.min_by(F.col(c), at[c]).alias(f"_fv_{c}") for c in columns],
        *[F.max(at[c]).alias(f"_ls_{c}") for c in columns],
        *[F.max_by(F.col(c), at[c]).alias(f"_lv_{c}") for c in columns],
    )
    wb = Window.partitionBy("series_id").orderBy("_block")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    wbd = Window.partitionBy("series_id").orderBy(F.col("_block").desc())
    after = wbd.rowsBetween(Window.unboundedPreceding, -1)
    ws = Window.partitionBy("series_id")
    carry = summ.select(
        *keys,
        F.lead("_bfirst").over(wb).alias("_next_any_blk"),
        *[
            e
            for name in bounds
            for e in (F.min(f"_lo_{name}").over(ws).alias(f"_lo_{name}"), F.max(f"_hi_{name}").over(ws).alias(f"_hi_{name}"))
        ],
        *[F.last(f"_ls_{c}", ignorenulls=True).over(before).alias(f"_bps_{c}") for c in columns],
        *[F.last(f"_lv_{c}", ignorenulls=True).over(before).alias(f"_bpv_{c}") for c in columns],
        *[F.last(f"_fs_{c}", ignorenulls=True).over(after).alias(f"_bns_{c}") for c in columns],
        *[F.last(f"_fv_{c}", ignorenulls=True).over(after).alias(f"_bnv_{c}") for c in columns],
    )
    joined = rows.join(carry, keys, "left")

    # per row: the scalars each emitted slot needs (computed once per row)
    following = F.coalesce(F.col("_next_any"), F.col("_next_any_blk")) - 1
    pre = [
        "series_id",
        "slot",
        F.least(F.coalesce(following, F.col("slot")), F.col("_hi_grid")).alias("_end"),
        *carried,
        *[x for name in spans for x in (f"_lo_{name}", f"_hi_{name}")],
    ]
    joined = joined.where((F.col("slot") >= F.col("_lo_grid")) & (F.col("slot") <= F.col("_hi_grid")))
    for c in columns:
        ps = F.coalesce(F.col(f"_ps_{c}"), F.col(f"_bps_{c}"))
        pv = F.when(F.col(f"_ps_{c}").isNotNull(), F.col(f"_pv_{c}")).otherwise(F.col(f"_bpv_{c}"))
        ns = F.coalesce(F.col(f"_ns_{c}"), F.col(f"_bns_{c}"))
        nv = F.when(F.col(f"_ns_{c}").isNotNull(), F.col(f"_nv_{c}")).otherwise(F.col(f"_bnv_{c}"))
        gap = F.when(ns.isNotNull(), ns - ps - 1).otherwise(F.col("_hi_grid") - ps)
        pre += [
            ps.alias(f"_PS_{c}"),
            pv.alias(f"_PV_{c}"),
            ns.alias(f"_NS_{c}"),
            nv.alias(f"_NV_{c}"),
            gap.alias(f"_GAP_{c}"),
            F.col(c).isNotNull().alias(f"_HERE_{c}"),
        ]
    if runs_of:
        joined = joined.select(*pre)
        # a line between two readings differs by slot; all else that a row fills is the same
        line = F.lit(False)
        for c in columns:
            line = line | (F.col(f"_PS_{c}").isNotNull() & F.col(f"_NS_{c}").isNotNull() & (F.col(f"_GAP_{c}") <= F.lit(limit)))
        gap, day = F.col("slot") + 1, F.lit(runs_of).cast("bigint")
        cut = (F.floor(gap / day) + 1) * day  # the first multiple after the gap's first slot
        none = F.array().cast("array<bigint>")
        starts = F.when(F.col("_end") < gap, none).when(F.col("_line"), F.sequence(gap, F.col("_end")))
        starts = starts.otherwise(F.concat(F.array(gap), F.when(cut <= F.col("_end"), F.sequence(cut, F.col("_end"), day)).otherwise(none)))
        runs = joined.withColumn("_line", line).withColumn("g_slot", F.explode(F.concat(F.array("slot"), starts)))
        last = F.when(F.col("_line") | (F.col("g_slot") == F.col("slot")), F.col("g_slot"))
        last = last.otherwise(F.least(F.col("_end"), (F.floor(F.col("g_slot") / day) + 1) * day - 1))
    s = F.col("g_slot")
    out_cols = []
    for c in columns:
        ps, pv, ns, nv, gap = (F.col(f"_{k}_{c}") for k in ("PS", "PV", "NS", "NV", "GAP"))
        tail = pv if fill_tail else F.lit(None).cast("double")
        val = (
            F.when(ps.isNull(), F.lit(None).cast("double"))
            .when(s == ps, pv)
            .when(gap > F.lit(limit), F.lit(None).cast("double"))
            .when(ns.isNull(), tail)
            .otherwise(pv + (nv - pv) / (ns - ps) * (s - ps))
        )
        out_cols += [val.alias(c), ((s == F.col("slot")) & F.col(f"_HERE_{c}")).alias(f"{c}__obs")]
    out_cols += [F.when(s == F.col("slot"), F.col(c)).alias(c) for c in carried]
    out_cols += [s.between(F.col(f"_lo_{name}"), F.col(f"_hi_{name}")).alias(name) for name in spans]
    # a row emits its gap in two steps: first the starts of stretches of at
    # most block_slots slots, which are spread over the full partition count
    # (an explicit count is kept by AQE), then each stretch's slots.  So no
    # array grows with a gap's length, and a long gap is emitted by many tasks
    from glucoflow.session import target_partitions

    n = target_partitions(obs.sparkSession)
    if runs_of:
        out = runs.select("series_id", s.alias("slot"), (last - s + 1).alias("_slots"), *out_cols)
        return out.repartitionByRange(n, "series_id", "slot").sortWithinPartitions("series_id", "slot")
    stretches = joined.select(*pre).withColumn("_from", F.explode(F.sequence(F.col("slot"), F.col("_end"), F.lit(block_slots))))
    if in_ranges:
        # stretches don't overlap, so their order is that of the slots they emit
        spread = stretches.repartitionByRange(n, "series_id", "_from").sortWithinPartitions("series_id", "_from")
    else:
        spread = stretches.repartition(n, "series_id", "_from")
    return (
        spread.withColumn("g_slot", F.explode(F.sequence(F.col("_from"), F.least(F.col("_end"), F.col("_from") + (block_slots - 1)))))
        .select("series_id", F.col("g_slot").alias("slot"), *out_cols)
    )

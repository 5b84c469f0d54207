"""Grid + limited fill against an independent pandas restatement."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from glucoflow.operators import clean as C
from helpers import long_events

EPOCH = dt.datetime(2024, 1, 1)


def pandas_fill(times, values, limit, fill_tail=True):
    """Own restatement of the rules: slot means, full grid, straight line over
    gaps of at most ``limit`` slots (tail: flat), longer gaps stay empty."""
    s = pd.Series(values, index=pd.DatetimeIndex(times)).sort_index()
    s.index = s.index.round("5min")
    s = s.groupby(level=0).mean()
    idx = pd.date_range(s.index.min(), s.index.max(), freq="5min")
    s = s.reindex(idx)
    missing = s.isna()
    out = s.copy()
    vals = s.to_numpy()
    n = len(vals)
    obs = np.flatnonzero(~np.isnan(vals))
    for a, b in zip(obs[:-1], obs[1:]):
        gap = b - a - 1
        if 0 < gap <= limit:
            for k in range(a + 1, b):
                out.iloc[k] = vals[a] + (vals[b] - vals[a]) / (b - a) * (k - a)
    if len(obs):
        last = obs[-1]
        tail = n - 1 - last
        if fill_tail and 0 < tail <= limit:
            out.iloc[last + 1:] = vals[last]
    out = out.clip(39.64, 360.36)
    return pd.DataFrame({"ts": idx, "v": out.to_numpy(), "missing": missing.to_numpy()})


def make_series(rng, n):
    slots = np.sort(rng.choice(np.arange(0, 400), size=n, replace=False))
    # jitter inside a slot, including exact half-slot ties and duplicates
    secs = slots * 300 + rng.choice([-150, -90, 0, 60, 149, 150], size=n)
    secs = np.concatenate([secs, secs[: n // 5] + 10])
    vals = rng.uniform(20, 400, size=len(secs)).round(2)
    times = [EPOCH + dt.timedelta(seconds=int(x)) for x in secs]
    return times, vals


@pytest.mark.parametrize("limit,block,tail", [(4, 288, True), (4, 5, True), (0, 7, True), (2, 3, False), (6, 1, True)])
def test_fill_matches_pandas(spark, limit, block, tail):
    rng = np.random.default_rng(limit * 100 + block)
    rows, expected = [], {}
    seq = 0
    for sid, n in [("a", 60), ("b", 150), ("c", 1), ("d", 12)]:
        times, vals = make_series(rng, n)
        for ts, v in zip(times, vals):
            rows.append((sid, ts, seq, "CGM", "cgm_primary", True, "mg/dL", float(v), None))
            seq += 1
        expected[sid] = pandas_fill(times, vals, limit, tail)
    ev = long_events(spark, rows)
    got = C.cgm(ev, interpolation_limit=limit, block_slots=block, fill_tail=tail).frame.toPandas()
    for sid, exp in expected.items():
        g = got[got.series_id == sid].sort_values("ts").reset_index(drop=True)
        assert len(g) == len(exp), sid
        assert (pd.to_datetime(g.ts).to_numpy() == exp.ts.to_numpy()).all()
        np.testing.assert_allclose(g.cgm_primary.to_numpy(dtype=float), exp.v.to_numpy(dtype=float), rtol=0, atol=1e-9, equal_nan=True)
        assert (g.missing.to_numpy() == exp.missing.to_numpy()).all()
        np.testing.assert_allclose(g.cgm_primary_mmol.to_numpy(dtype=float), exp.v.to_numpy(dtype=float) * 0.0555, atol=1e-9, equal_nan=True)


def test_span_includes_null_rows_and_leading_gap(spark):
    # a null CGM row widens the grid; the leading slots stay empty
    rows = [
        ("p", EPOCH, 0, "CGM", "cgm_primary", True, "mg/dL", None, None),
        ("p", EPOCH + dt.timedelta(minutes=10), 1, "CGM", "cgm_primary", True, "mg/dL", 100.0, None),
        ("p", EPOCH + dt.timedelta(minutes=20), 2, "CGM", "cgm_primary", True, "mg/dL", 120.0, None),
    ]
    out = C.cgm(long_events(spark, rows)).frame.orderBy("ts").toPandas()
    assert len(out) == 5
    assert pd.isna(out.cgm_primary[0]) and pd.isna(out.cgm_primary[1])
    assert out.cgm_primary[3] == pytest.approx(110.0)
    assert list(out.missing) == [True, True, False, True, False]


def test_mmol_column_converted_and_two_columns(spark):
    rows = [
        ("p", EPOCH, 0, "CGM", "cgm_primary", True, "mmol/L", 5.0, None),
        ("p", EPOCH + dt.timedelta(minutes=5), 1, "CGM", "cgm_2", False, "mg/dL", 100.0, None),
    ]
    p = C.cgm(long_events(spark, rows), columns=[("cgm_primary", "mmol/L"), ("cgm_2", "mg/dL")])
    out = p.frame.orderBy("ts").toPandas()
    assert out.cgm_primary[0] == pytest.approx(5.0 * 18.0182)
    assert out.cgm_2[1] == 100.0
    assert list(out.missing) == [False, True]
    assert list(out.columns) == ["series_id", "ts", "cgm_primary", "cgm_2", "cgm_primary_mmol", "cgm_2_mmol", "missing"]


def test_no_primary_raises(spark):
    with pytest.raises(C.ProcessingError):
        C.cgm(long_events(spark, []), columns=[("cgm_2", "mg/dL")])

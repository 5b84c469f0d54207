"""Embedding whitening against exact arithmetic, and its eigenvectors against known ones."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from glucoflow.llm import whitening
from glucoflow.llm.eigen import WIDE, refined_eigen

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int"


def made(n=300, d=12, seed=4):
    rng = random.Random(seed)
    turn = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(d)]
    rows = []
    for k in range(n):
        z = [rng.gauss(0, 1 / (1 + j)) for j in range(d)]
        rows.append((k, [float(np.float32(sum(a * b for a, b in zip(t, z, strict=True)) / 4)) for t in turn], 0, 7, 8))
    rows += [(n, None, 0, 1, 1), (n + 1, [], 0, 1, 1), (n + 2, [0.1] * (d - 1) + [None], 0, 1, 1), (n + 3, [0.1] * (d - 1) + [math.inf], 0, 1, 1), (n + 4, [math.nan] + [0.1] * (d - 1), 0, 1, 1)]
    rows += [rows[3], rows[3], (5, rows[8][1], 0, 0, 0), (None, rows[9][1], 0, 0, 0)]
    rows += [(n + 5, [3e38] * d, 0, 1, 1)]
    return rows


def plain(rows, d):
    """n, x and deviations in Python integers, covariance as fractions."""
    valid = [(i, v) for i, v, *_ in rows if v and len(v) == d and all(c is not None and math.isfinite(c) and abs(c) < 1e12 for c in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in valid]
    n = len(x)
    sums = [sum(r[j] for r in x) for j in range(d)]
    away = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in away), n**3) for j in range(d)] for i in range(d)]
    return [i for i, _ in valid], n, [sum(a * a for a in r) for r in away], away, cov


@pytest.mark.parametrize("parts", [1, 6])
def test_against_exact(spark, parts):
    rows = made()
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert ", ".join(f"{c} {t.replace('bigint', 'long')}" for c, t in got.dtypes) == whitening.OUT
    got = got.collect()
    ids, n, deviation, away, cov = plain(rows, 12)
    exact = np.array([[float(c) for c in r] for r in cov])
    values, vectors = np.linalg.eigh(exact)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = {}
    for row, (i, dev) in enumerate(zip(ids, deviation, strict=True)):
        w = np.array(away[row], float) / n @ vectors[:, :8] / np.sqrt(values[:8])
        want.setdefault(i, []).append((dev, w))
    assert len(got) == 8 * len(ids)
    signs = {}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for (i, c), found in by.items():
        assert sorted(int(r["deviation"]) for r in found) == sorted(dev for dev, _ in want[i])
        for r in found:
            assert r["n"] == n and r["identity_error"] < 1e-9
            assert abs(r["explained"] / (values[c - 1] / values.sum()) - 1) < 1e-10
            close = [w[c - 1] for dev, w in want[i] if dev == int(r["deviation"])]
            sign = signs.setdefault(c, 1 if abs(close[0] - r["whitened"]) < abs(close[0] + r["whitened"]) else -1)
            assert min(abs(sign * r["whitened"] - w) for w in close) < 1e-8


def test_partitions_change_nothing(spark):
    rows = [r for r in made() if r[0] is not None and r[0] not in (3, 5)]
    one, many = ({(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(k)).collect()} for k in (1, 5))
    assert one.keys() == many.keys()
    for key, r in one.items():
        assert r["deviation"] == many[key]["deviation"] and r["explained"] == many[key]["explained"]
        assert abs(r["whitened"] - many[key]["whitened"]) < 1e-13


def test_lengths_apart_and_rank(spark):
    """Two lengths; three rows have rank 2, equal rows rank 0."""
    rows = [(k, [float(k), float(k * k), 1.0], 0, 0, 0) for k in range(3)] + [(10 + k, [0.5, 0.25], 0, 0, 0) for k in range(4)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["vec_id"], r["component"]) for r in got} == {(i, c) for i in range(3) for c in (1, 2)}
    assert all(r["n"] == 3 and r["identity_error"] < 1e-12 for r in got)


def test_empty_and_unusable(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 0, 0, 0), (2, [math.nan], 0, 0, 0)], SCHEMA)).collect() == []


def test_large_numbers_stay_exact(spark):
    rows = [(k, [1e9 * (k % 7), -2e9 * (k % 3), 0.001 * k], 0, 0, 0) for k in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n long, component int"))
    ids, _, deviation, _, _ = plain(rows, 3)
    assert {(r["vec_id"], int(r["deviation"])) for r in got.collect()} == set(zip(ids, deviation, strict=True))


def turned(values, seed=1):
    """A symmetric matrix with the given eigenvalues, and its eigenvectors."""
    values = np.sort(np.array(values, WIDE))[::-1]
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0].astype(WIDE)
    for _ in range(3):
        q = q @ (1.5 * np.eye(d, dtype=WIDE) - 0.5 * (q.T @ q))
    a = (q * values) @ q.T
    return (a + a.T) / 2, values, q


SPREAD = np.random.default_rng(3).uniform(1, 10, 24)
CASES = {
    "apart": (SPREAD, 1e-15),
    "steep": (10.0 ** np.linspace(-9, 4, 24), 1e-15),
    "close": ([50 + k * 1e-7 for k in range(5)] + list(SPREAD), 1e-9),
    "nested": ([50, 50 + 1e-5, 50 + 1e-5 + 1e-8, 50 + 1e-2, 50 + 2e-9] + list(SPREAD), 1e-8),
    "single precision can't tell": (1 + np.arange(24) * 1e-8, 1e-9),
    "equal": ([50] * 4 + list(SPREAD), None),
    "all equal": ([3] * 24, None),
    "singular": (list(SPREAD[:5]) + [0] * 19, None),
}


@pytest.mark.parametrize("case", CASES)
def test_eigenvectors(case):
    given, within = CASES[case]
    a, values, q = turned(given)
    found, x, rounds = refined_eigen(a)
    scale = float(values[0])
    assert float(np.abs(found - values).max()) < 1e-16 * scale
    assert float(np.abs(a @ x - x * found).max()) < 1e-16 * scale
    assert float(np.abs(x.T @ x - np.eye(len(x))).max()) < 1e-16
    assert rounds < 12
    if within:  # the leading ones: a vector is as exact as its gap is wide beside the largest eigenvalue
        signs = np.sign((q * x).sum(axis=0))
        assert float(np.abs(q * signs - x)[:, :8].max()) < within


def test_better_than_one_precision():
    a, values, q = turned(SPREAD)
    plain_error = np.abs(np.abs((np.linalg.eigh(a.astype(np.float32))[1][:, ::-1] * q).sum(axis=0)) - 1).max()
    assert plain_error > 1e-9 > float(np.abs(np.abs((refined_eigen(a)[1] * q).sum(axis=0)) - 1).max())


def test_no_matrix():
    assert refined_eigen(np.zeros((0, 0)))[1].shape == (0, 0)
    assert refined_eigen(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]

"""Embedding whitening (operator 11): exact covariance, mixed-precision eigenvectors.

Entries become integers x = floor(1024 * c) + 100000, so that sums and products
are exact: tasks send the sums of their rows, then their products centred on the
integer part of the mean, and the covariance is one exact division at the end,
whatever the number or order of tasks.  Its eigenvectors come from
:mod:`glucoflow.llm.eigen`.  The driver holds a matrix of dimension squared,
never rows; a task holds one slice of rows and such a matrix.

* rows whose vector is null or empty, or holds a null, NaN, infinity or a number
  beyond 2**53 / 1024 are left out of everything;
* vectors of several lengths are whitened apart, each length by its own fit list;
* repeated rows and ids count as often as they come;
* components with an eigenvalue of 0 (to double precision) don't exist: a
  table of equal vectors has no rows, one of rank r at most r components;
* an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoflow.llm.common import slices
from glucoflow.llm.eigen import WIDE, refined_eigen

#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 1024, 100_000
#: numbers with a larger x can't be exact
LARGEST = 1 << 53
COMPONENTS = 8

OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
_EXACT = pa.decimal128(38, 0)


def vectors_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, x as a matrix of 64-bit integers) of the valid rows of a batch, for each length."""
    lists = batch.column("embedding")
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.values.slice(lists.offsets[0].as_py(), int(size.sum()))
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(SCALE * flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64))
        bad = ~(np.abs(x) < LARGEST)
    start = np.cumsum(size) - size
    wrong = np.concatenate([[0], np.cumsum(bad)])
    valid = (size > 0) & (wrong[start + size] == wrong[start]) & lists.is_valid().to_numpy(zero_copy_only=False)
    for length in np.unique(size[valid]):
        rows = np.flatnonzero(valid & (size == length))
        at = start[rows][:, None] + np.arange(length)
        yield batch.column("vec_id").take(pa.array(rows)), x[at].astype(np.int64) + SHIFT


def products(y: np.ndarray) -> np.ndarray:
    """y.T @ y, exact: by floating point while no sum can pass 2**53, else by Python integers."""
    largest = int(np.abs(y).max(initial=0))
    if largest * largest * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if largest * largest * len(y) < 1 << 62:
        return (y.T @ y).astype(object)
    return y.T.astype(object) @ y.astype(object)


def _exact(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], _EXACT)


def _totals(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Length -> (number of vectors, sums of each dimension)."""
    schema = pa.schema([("length", pa.int32()), ("n", pa.int64()), ("i", pa.int32()), ("total", _EXACT)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices([batch], 4096):
                for ids, x in vectors_of(part):
                    d = x.shape[1]
                    n[d] = n.get(d, 0) + len(ids)
                    sums[d] = sums.get(d, 0) + x.sum(axis=0).astype(object)
        for d, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array([n[d]] * d, pa.int64()), pa.array(range(d), pa.int32()), _exact(total)], schema=schema)

    parts = rows.mapInArrow(scan, "length int, n long, i int, total decimal(38,0)")
    found: dict[int, tuple[int, list[int]]] = {}
    for length, _, n, total in parts.groupBy("length", "i").agg(F.sum("n"), F.sum("total")).orderBy("length", "i").collect():
        found.setdefault(length, (n, []))[1].append(int(total))
    return found


def _covariances(rows: DataFrame, totals: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Length -> covariance of x, centred, divisor n, every entry rounded once."""
    centre = {d: np.array([s // n for s in sums], np.int64) for d, (n, sums) in totals.items()}
    schema = pa.schema([("length", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("total", _EXACT)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices([batch], 4096):
                for _, x in vectors_of(part):
                    d = x.shape[1]
                    sums[d] = sums.get(d, 0) + products(x - centre[d])
        for d, total in sums.items():
            for i in range(d):  # the matrix is symmetric: half of it is sent
                yield pa.RecordBatch.from_arrays([pa.array([k] * (d - i), pa.int32()) for k in (d, i)] + [pa.array(range(i, d), pa.int32()), _exact(total[i, i:])], schema=schema)

    parts = rows.mapInArrow(scan, "length int, i int, j int, total decimal(38,0)")
    out = {d: np.zeros((d, d), WIDE) for d in totals}
    for d, i, j, total in parts.groupBy("length", "i", "j").agg(F.sum("total")).toLocalIterator():
        n, sums = totals[d]
        left = [sums[k] - n * int(centre[d][k]) for k in (i, j)]
        exact = n * int(total) - left[0] * left[1]  # covariance times n squared, an integer
        whole, rest = divmod(exact, n * n)
        out[d][i, j] = out[d][j, i] = _wide(whole) + _wide(rest) / _wide(n * n)
    return out


def _wide(value: int) -> np.longdouble:
    """An integer in extended precision, from halves that doubles hold exactly or nearly."""
    sign, value = (-1, -value) if value < 0 else (1, value)
    out = WIDE(0)
    while value:
        cut = max(value.bit_length() - 53, 0)
        out += WIDE(float(value >> cut)) * WIDE(2.0) ** cut
        value &= (1 << cut) - 1
    return sign * out


class Fit:
    """What a task needs for the vectors of one length."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        values, x, self.rounds = refined_eigen(covariance)
        trace = np.trace(covariance)
        real = values > np.finfo(np.float64).eps * len(values) * max(trace, 0)
        k = min(components, int(real.sum()))
        self.n, self.sums = n, sums
        self.turn = (x[:, :k] / np.sqrt(values[:k])).astype(np.float64)
        self.vectors = x[:, :k].astype(np.float64)
        self.values = values[:k].astype(np.float64)
        self.explained = (values[:k] / trace).astype(np.float64) if k else np.zeros(0)

    def away(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if self.n * (int(np.abs(x).max(initial=0)) + 1) * 2 < 1 << 63:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviations(self, away: np.ndarray) -> np.ndarray:
        """Sum of squares of each row, exact."""
        largest = int(np.abs(away).max(initial=0))
        if largest * largest * away.shape[1] >= 1 << 63:
            away = away.astype(object)
        return (away * away).sum(axis=1)

    def whitened(self, away: np.ndarray) -> np.ndarray:
        return (away.astype(np.float64) / self.n) @ self.turn


def _identity_errors(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Length -> largest entry of the measured covariance of the whitened rows minus the identity."""
    schema = pa.schema([("length", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices([batch], 4096):
                for _, x in vectors_of(part):
                    w = fits[x.shape[1]].whitened(fits[x.shape[1]].away(x))
                    w = np.hstack([w, np.ones((len(w), 1))])  # the last row holds the sums
                    sums[x.shape[1]] = sums.get(x.shape[1], 0) + w.T @ w
        for d, total in sums.items():
            k = len(total)
            yield pa.RecordBatch.from_arrays([pa.array([d] * k * k, pa.int32()), pa.array(np.repeat(np.arange(k, dtype=np.int32), k)), pa.array(np.tile(np.arange(k, dtype=np.int32), k)), pa.array(total.ravel())], schema=schema)

    found: dict[int, np.ndarray] = {d: np.zeros((len(f.values) + 1,) * 2) for d, f in fits.items()}
    parts = rows.mapInArrow(scan, "length int, i int, j int, total double")
    for d, i, j, total in parts.groupBy("length", "i", "j").agg(F.sum("total")).collect():
        found[d][i, j] = total
    out = {}
    for d, total in found.items():
        n = fits[d].n
        mean = total[-1, :-1] / n  # a rounding error away from 0: the rows are centred before
        out[d] = float(np.abs(total[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0))
    return out


def fit(embeddings: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, dict[int, Fit], dict[int, float]]:
    """The rows that are read, and for each vector length its fit and identity error."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    totals = _totals(rows)
    covariances = _covariances(rows, totals)
    fits = {d: Fit(n, sums, covariances.pop(d), components) for d, (n, sums) in totals.items()}
    fits = {d: f for d, f in fits.items() if len(f.values)}
    return rows, fits, _identity_errors(rows.filter(F.size("embedding").isin(*fits)), fits) if fits else {}


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per valid vector and component (see OUT)."""
    rows, fits, errors = fit(embeddings, components)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", _EXACT), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for ids, x in vectors_of(part):
                if (f := fits.get(x.shape[1])) is None:
                    continue
                away, k = f.away(x), len(f.values)
                deviation = _exact(f.deviations(away))
                each = pa.array(np.repeat(np.arange(len(ids)), k))
                columns = [ids.take(each), np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids)), [f.n] * len(each), deviation.take(each), f.whitened(away).ravel(), np.tile(f.explained, len(ids)), [errors[x.shape[1]]] * len(each)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(scan, OUT)

"""Eigenvectors of a symmetric matrix by mixed-precision refinement.

A float32 eigendecomposition starts; Ogita and Aishima's iteration (matrix
products only, quadratic convergence) corrects all vectors at once in extended
precision.  Eigenvalues closer than the iteration can tell apart form clusters:
each is resolved by a sub-solve, the eigendecomposition of the small matrix that
the residual leaves on the cluster's subspace, whose spread is tiny beside its
eigenvalues, so that it is worked out with the common part taken off.
"""

from __future__ import annotations

import numpy as np

#: working precision of residuals and corrections
WIDE = np.longdouble
#: the iteration ends when no entry of the correction is larger or they no longer shrink, or after so many rounds
ENOUGH, ROUNDS = 1e-17, 60


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of at least two ascending values whose neighbours differ by at most gap."""
    cuts = np.flatnonzero(np.diff(values) > gap) + 1
    return [run for run in np.split(np.arange(len(values)), cuts) if len(run) > 1]


def _resolve(a: np.ndarray, x: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The basis of a cluster's subspace that makes the matrix diagonal on it."""
    basis, _ = np.linalg.qr(x[:, run].astype(np.float64))
    basis = basis.astype(WIDE)
    basis += basis @ (np.eye(len(run), dtype=WIDE) - basis.T @ basis) / 2
    inner = basis.T @ a @ basis
    common = np.trace(inner) / len(run)
    inner = (inner + inner.T) / 2 - common * np.eye(len(run), dtype=WIDE)
    scale = np.abs(inner).max()
    if scale == 0:
        return basis
    _, turn = np.linalg.eigh((inner / scale).astype(np.float64))
    return basis @ turn.astype(WIDE)


def refined_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues (falling), unit eigenvectors (columns, largest entry positive), rounds taken.

    ``matrix`` is symmetric, in any float type; results are extended-precision.
    """
    a = np.asarray(matrix, WIDE)
    d = len(a)
    scale = np.abs(a).max(initial=0)
    if scale == 0:
        return np.zeros(d, WIDE), np.eye(d, dtype=WIDE), 0
    a = (a / scale + (a / scale).T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    eye = np.eye(d, dtype=WIDE)
    size = np.abs(a).sum(axis=1).max()
    least = np.finfo(WIDE).eps * size * d
    values, last = np.zeros(d, WIDE), np.inf
    for rounds in range(1, ROUNDS + 1):
        r = eye - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = s - np.diag(values)
        error = float(np.abs(off).sum(axis=1).max() + size * np.abs(r).sum(axis=1).max())
        gap = max(2 * error, float(least))
        runs = _clusters(values, gap)
        for run in runs:
            x[:, run] = _resolve(a, x, run)
        if runs:
            r = eye - x.T @ x
            s = x.T @ a @ x
            values = np.diag(s) / (1 - np.diag(r))
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= gap
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
        x = x + x @ e
        change = float(np.abs(e).max())
        if change <= ENOUGH or rounds > 4 and change > last / 2:  # as exact as the precision allows
            break
        last = change
    for _ in range(2):
        x = x + x @ (eye - x.T @ x) / 2
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    x /= np.sqrt((x * x).sum(axis=0))
    x *= np.where(x[np.abs(x).argmax(axis=0), np.arange(d)] < 0, -1, 1)
    return values * scale, x, rounds

"""Minimum variance without short positions: the critical line algorithm (PTF-05).

The long-only portfolios of least variance for every expected return form a chain of
straight pieces between corner portfolios.  On a piece the held assets stay the same
and the weights are a line in one multiplier; a piece ends where a held weight falls
to zero or an asset left out would gain from being held.  The walk starts at the asset
of highest mean and goes down to the portfolio of least variance; targets below that
one lie on the walk of the mirrored problem.  The number of corners ends the walk:
there is no limit of rounds.
"""

from __future__ import annotations

import numpy as np


def _piece(mu: np.ndarray, cov: np.ndarray, held: list[int]):
    """(p, q, g, s): held weights p + q * lam and the budget's multiplier g + s * lam on a piece."""
    inner = cov[np.ix_(held, held)]
    a, b = np.linalg.solve(inner, np.column_stack([mu[held], np.ones(len(held))])).T
    total = b.sum()
    share = a.sum() / total
    return b / total, a - share * b, 1 / total, -share


def corners(mu: np.ndarray, cov: np.ndarray):
    """Pieces of the chain from the highest mean down to the least variance, as
    (multiplier at the start, at the end, held assets, p, q)."""
    n = len(mu)
    held, lam = [int(np.argmax(mu))], np.inf
    seen: set[frozenset[int]] = set()
    while True:
        if frozenset(held) in seen:
            raise np.linalg.LinAlgError("the walk came back to the same assets: equal means or a singular matrix")
        seen.add(frozenset(held))
        p, q, g, s = _piece(mu, cov, held)
        out = np.setdiff1d(np.arange(n), held)
        best, who, leaves = 0.0, -1, False
        if len(held) > 1:
            falls = np.flatnonzero(q > 0)                 # weights that shrink as the multiplier falls
            if len(falls):
                at = -p[falls] / q[falls]
                k = int(np.argmax(at))
                if at[k] > best:
                    best, who, leaves = float(at[k]), held[falls[k]], True
        if len(out):
            # marginal variance of an asset left out, less what its mean and the budget are worth
            rows = cov[np.ix_(out, held)]
            at0, slope = rows @ p - g, rows @ q - mu[out] - s
            enters = np.flatnonzero(slope > 0)
            if len(enters):
                at = -at0[enters] / slope[enters]
                k = int(np.argmax(at))
                if at[k] > best:
                    best, who, leaves = float(at[k]), int(out[enters[k]]), False
        best = min(best, lam)
        yield lam, best, held, p, q
        if who < 0:
            return
        held = [h for h in held if h != who] if leaves else [*held, who]
        lam = best


def _apart(mu: np.ndarray) -> np.ndarray:
    """Means moved apart by a hair where some are equal, so that every corner has one way on."""
    if len(np.unique(mu)) == len(mu):
        return mu
    return mu + 1e-12 * max(float(np.abs(mu).max()), 1e-300) * np.arange(len(mu)) / len(mu)


def _walk(mu: np.ndarray, cov: np.ndarray, target: float | None) -> tuple[np.ndarray | None, float]:
    """(weights at the target or None if it lies below the chain, lowest mean of the chain)."""
    low = np.inf
    for start, end, held, p, q in corners(mu, cov):
        high = p @ mu[held] + q @ mu[held] * start if np.isfinite(start) else float(mu[held] @ p)
        low = float(mu[held] @ (p + q * end))
        if target is not None and target >= low:
            rate = float(q @ mu[held])
            lam = end if rate <= 0 else min(max((target - float(p @ mu[held])) / rate, end), start)
            w = np.zeros(len(mu))
            w[held] = p + q * lam if np.isfinite(lam) else p
            return w, high
    w = None
    if target is None:
        w = np.zeros(len(mu))
        w[held] = p
    return w, low


def long_only(mu: np.ndarray, cov: np.ndarray, target: float | None) -> tuple[np.ndarray | None, str]:
    """Weights >= 0 of least variance with sum one and mean ``target`` (``None``: any mean).

    Infeasible where the target lies outside the assets' means (an end is met to 1e-12 of
    the largest); singular where held assets have a singular covariance.
    """
    mu, cov = np.asarray(mu, dtype=float), np.atleast_2d(np.asarray(cov, dtype=float))
    if not (np.isfinite(mu).all() and np.isfinite(cov).all()):
        return None, "singular"
    slack = 1e-12 * float(np.abs(mu).max())
    if target is not None:
        if target < mu.min() - slack or target > mu.max() + slack:
            return None, "infeasible"
        for end in (mu.min(), mu.max()):
            # at an end only the assets with that mean can be held
            held = np.flatnonzero(np.abs(mu - end) <= slack)
            if abs(target - end) <= slack and len(held) < len(mu):
                w, status = long_only(mu[held], cov[np.ix_(held, held)], None)
                if w is None:
                    return None, status
                out = np.zeros(len(mu))
                out[held] = w
                return out, status
        target = min(max(target, float(mu.min())), float(mu.max()))
    scale = float(np.mean(np.diag(cov))) or 1.0
    size = float(np.abs(mu).max()) or 1.0
    m, c, t = _apart(mu / size), cov / scale, None if target is None else target / size
    try:
        w, _ = _walk(m, c, t)
        if w is None:                                     # below the least variance: the mirrored chain
            w, _ = _walk(-m, c, -t)
    except np.linalg.LinAlgError:
        return None, "singular"
    if w is None or not np.isfinite(w).all():
        return None, "singular"
    w[w < 1e-13] = 0.0
    return w / w.sum(), "optimal"

"""A small dense quadratic solver with linear bounds."""

from __future__ import annotations

import numpy as np


def quadratic_program(p: np.ndarray, q: np.ndarray, g: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 60, tolerance: float = 1e-9) -> tuple[np.ndarray, bool]:
    """(x, solved): minimises x'Px / 2 + q'x with Gx <= h and Ax = b, by a predictor-corrector interior-point method.

    ``solved`` is false if the residuals do not vanish, as for bounds that contradict one another.
    """
    n, m, k = len(q), len(h), len(b)
    x, y, s, z = np.zeros(n), np.zeros(k), np.maximum(h, 1.0), np.ones(m)
    fine, even, slim = (tolerance * (1 + np.abs(v).max(initial=0)) for v in (q, b, h))
    for _ in range(rounds):
        dual, equal, slack, mu = p @ x + q + g.T @ z + a.T @ y, a @ x - b, g @ x + s - h, float(s @ z) / max(m, 1)
        if max(np.abs(dual).max(initial=0), mu) < fine and np.abs(equal).max(initial=0) < even and np.abs(slack).max(initial=0) < slim:
            return x, True
        w = z / s
        left = np.block([[p + g.T @ (w[:, None] * g) + 1e-13 * np.eye(n), a.T], [a, -1e-13 * np.eye(k)]])

        def step(target: np.ndarray, left=left, w=w, dual=dual, equal=equal, slack=slack, s=s, z=z):
            # eliminates slacks and their multipliers: s z = target
            inner = (target - s * z) / s
            right = np.concatenate([-dual - g.T @ (inner + w * slack), -equal])
            try:
                d = np.linalg.solve(left, right)
            except np.linalg.LinAlgError:
                d = np.linalg.lstsq(left, right, rcond=None)[0]
            ds = -slack - g @ d[:n]
            return d[:n], d[n:], ds, inner - w * ds

        def reach(ds: np.ndarray, dz: np.ndarray, s=s, z=z) -> float:
            steps = [(-v[d < 0] / d[d < 0]).min(initial=1.0) for v, d in ((s, ds), (z, dz))]
            return min(1.0, *steps)

        _, _, ds, dz = step(np.zeros(m))
        t = reach(ds, dz)
        ahead = float((s + t * ds) @ (z + t * dz)) / max(m, 1)
        dx, dy, ds, dz = step((ahead / mu) ** 3 * mu - ds * dz if mu > 0 else np.zeros(m))
        t = 0.99 * reach(ds, dz)
        x, y, s, z = x + t * dx, y + t * dy, s + t * ds, z + t * dz
        if not np.isfinite(x).all() or np.abs(z).max(initial=0) > 1e14:
            return x, False
    return x, False

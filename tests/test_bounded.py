"""The quadratic solver against enumeration, and bounded allocations."""

from __future__ import annotations

import itertools
from datetime import date

import numpy as np
import pytest

from stratapanel.operators import bounded
from stratapanel.operators.bounded import Bounds

SECTORS = np.array(["x", "x", "y", "y"])
CASES = [Bounds(), Bounds(most=0.4), Bounds(total=0.0, least=-1.0, leverage=1.0), Bounds(sector=0.55, most=0.45), Bounds(turnover=0.3), Bounds(total=0.0, least=-0.5, most=0.5, leverage=1.2, sector=0.1), Bounds(total=None, least=-1.0, leverage=0.8)]


def _case(seed):
    random = np.random.default_rng(seed)
    x = random.normal(size=(60, 4)) * [0.01, 0.02, 0.015, 0.03]
    return random.normal(size=4) * 0.1, np.cov(x.T) * 252 + 1e-6 * np.eye(4), np.array([0.25, 0.25, 0.3, 0.2])


@pytest.mark.parametrize("bounds", CASES)
@pytest.mark.parametrize("seed", [1, 2])
def test_solution_keeps_bounds_and_beats_enumeration(bounds, seed):
    mu, sigma, held = _case(seed)
    w, solved = bounded.bounded_solution(mu, sigma, 1.0, bounds, SECTORS, held)
    assert solved and bounded.breach(w, bounds, SECTORS, held) < 1e-6
    gain = lambda v: mu @ v - v @ sigma @ v
    grid = np.linspace(bounds.least, bounds.most, 31)
    best = -np.inf
    for v in itertools.product(grid, repeat=3):
        for last in [bounds.total - sum(v)] if bounds.total is not None else grid[::3]:
            v4 = np.array([*v, last])
            if bounded.breach(v4, bounds, SECTORS, held) < 1e-9:
                best = max(best, gain(v4))
    assert gain(w) >= best - 1e-7 and gain(w) <= best + 0.02


def test_many_names():
    random = np.random.default_rng(5)
    n = 50
    sigma = np.cov(random.normal(size=(252, n)).T) * 0.04
    mu, held, sectors = random.normal(size=n) * 0.1, np.full(n, 1 / n), np.arange(n) % 6
    bounds = Bounds(most=0.1, sector=0.25, turnover=0.8)
    w, solved = bounded.bounded_solution(mu, sigma, 2.0, bounds, sectors, held)
    assert solved and bounded.breach(w, bounds, sectors, held) < 1e-6


def test_contradicting_bounds_are_named():
    mu, sigma, held = _case(1)
    for bounds in (Bounds(most=0.2), Bounds(turnover=0.1, most=0.25, sector=0.4), Bounds(total=0.0, least=0.1)):
        assert not bounded.bounded_solution(mu, sigma, 1.0, bounds, SECTORS, held)[1]


def test_days(spark):
    random = np.random.default_rng(3)
    rows = [(date(2024, 1, d), t, s, float(random.random()), [float(x) for x in random.normal(0, 0.02, 30)], h) for d in (1, 2) for t, s, h in ((1, "x", 0.5), (2, "x", 0.5), (3, None, None), (4, "y", None))]
    rows += [(date(2024, 1, 3), 1, "x", 0.9, [0.1, None], 1.0), (date(2024, 1, 4), 1, "x", 0.9, [0.1, 0.2, 0.0], 1.0), (date(2024, 1, 4), 2, "x", None, [0.1, 0.2, 0.0], 0.0)]
    df = spark.createDataFrame(rows, "date date, ticker long, sector string, score double, returns array<double>, held double")
    got = bounded.allocate_bounded(df, Bounds(sector=0.6, turnover=1.0)).toPandas()
    assert set(got["date"].map(lambda x: x.day)) == {1, 2, 4}
    assert set(got[got["date"].map(lambda x: x.day) < 3]["status"]) == {"optimal"} and got[got["status"] == "optimal"]["breach"].max() < 1e-6
    alone = got[got["date"].map(lambda x: x.day) == 4].iloc[0]
    assert alone["status"] == "infeasible" and alone["weight"] == 1.0 and alone["breach"] > 0.3


@pytest.mark.parametrize("n", [1, 2, 5, 25])
def test_residuals_vanish_for_solutions_only(n):
    """Solvers against the conditions of a solution, and these conditions against weights that solve nothing."""
    from stratapanel.operators import optimality
    from stratapanel.operators import portfolio as pf

    random = np.random.default_rng(n)
    x = random.normal(size=(252, n)) * random.uniform(0.01, 0.05, n)
    sigma = pf.shrunk_covariance(x) * 252 if n > 1 else np.array([[0.04]])
    mu, even = (random.uniform(0.4, 1, n) - 0.5) * 0.6, np.full(n, 1.0 / n)
    deviation = np.sqrt(np.diag(sigma))
    solved = {
        "mean_variance": pf.quadratic_weights(mu, sigma, 1.0, 0.4), "max_sharpe": pf.max_sharpe_weights(mu, sigma, cap=0.4), "risk_parity": pf.risk_parity_weights(sigma), "kelly": pf.kelly_weights(mu, sigma),
        "black_litterman": pf.quadratic_weights(pf.black_litterman_returns(sigma, np.ones(n), mu), sigma, 2.5, 0.4), "inverse_vol": (1 / deviation) / (1 / deviation).sum(), "top_n": even,
    }
    for method, w in solved.items():
        assert optimality.residual(method, w, mu, sigma, np.ones(n), cap=0.4) < 2e-3, method
        if n == 5 and method != "top_n":
            wrong = np.array([0.9, 0.025, 0.025, 0.025, 0.025])
            assert optimality.residual(method, wrong, mu, sigma, np.ones(n), cap=0.95) > 1e-2, method

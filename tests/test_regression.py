"""P-values against integration, regressions and the unit-root test against dense solves."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapanel.operators import regression


def t_tail(t: float, v: float) -> float:
    """Two-sided p-value by integration of the density over the angle."""
    grid = np.linspace(math.atan(abs(t) / math.sqrt(v)), math.pi / 2, 20_001)
    density = np.cos(grid) ** (v - 1)
    whole = np.cos(np.linspace(0, math.pi / 2, 20_001)) ** (v - 1)
    return float(np.trapezoid(density, grid) / np.trapezoid(whole, dx=math.pi / 2 / 20_000))


def test_p_values(spark):
    cases = [(t, v) for t in (0.0, 0.3, -1.0, 2.0, -4.5, 12.0) for v in (1.0, 2.0, 5.0, 30.0, 1000.0)]
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t double, v double").select("i", regression.t_p_value(F.col("t"), F.col("v")).alias("p")).collect()
    for r in got:
        assert abs(r["p"] - t_tail(*cases[r["i"]])) < 1e-6, cases[r["i"]]
    assert spark.range(1).select(regression.t_p_value(F.lit(1.0), F.lit(0.0)).alias("p")).first()["p"] is None


def test_lines(spark):
    random = np.random.default_rng(1)
    x = random.normal(size=60)
    y = 0.4 * x + random.normal(size=60)
    rows = [("a", float(u), float(v)) for u, v in zip(x, y, strict=True)] + [("a", None, 1.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", 3.0, 6.0), ("c", 1.0, 5.0), ("c", 1.0, 6.0), ("d", 1.0, 1.0), ("e", 1.0, 3.0), ("e", 2.0, 3.0), ("e", 4.0, 3.0)]
    got = {r["k"]: r for r in regression.line(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", ["k"]).collect()}
    design = np.column_stack([x, np.ones(60)])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    rest = y - design @ beta
    error = math.sqrt(rest @ rest / 58 / ((x - x.mean()) ** 2).sum())
    a = got["a"]
    assert np.allclose([a["slope"], a["intercept"], a["std_err"]], [*beta, error]) and abs(a["p_value"] - t_tail(beta[0] / error, 58)) < 1e-6
    assert got["b"]["slope"] == 2.0 and got["b"]["p_value"] < 1e-12 and got["c"]["slope"] is None and got["c"]["p_value"] is None
    assert "d" not in got and got["e"]["slope"] == 0.0 and got["e"]["p_value"] == 1.0


def dense(y: np.ndarray, lags: int, most: int) -> tuple[float, float]:
    d = np.diff(y)
    at = np.arange(most, len(d))
    x = np.column_stack([np.ones(len(at)), y[at], *(d[at - i] for i in range(1, lags + 1))])
    beta, *_ = np.linalg.lstsq(x, d[at], rcond=None)
    rest = d[at] - x @ beta
    s = rest @ rest
    return len(at) * math.log(s / len(at)) + 2 * x.shape[1], beta[1] / math.sqrt(s / (len(at) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])


@pytest.mark.parametrize("most", [0, 1, 4])
def test_unit_root_equals_a_dense_solve(spark, most):
    random = np.random.default_rng(2)
    walk = 1000 + np.cumsum(random.normal(size=300))
    back = np.zeros(300)
    for i in range(3, 300):
        back[i] = 0.3 * back[i - 1] + 0.4 * back[i - 3] + random.normal()
    series = {"walk": walk, "back": back, "short": back[:20], "flat": np.ones(100)}
    rows = [(k, date(2020, 1, 1) + timedelta(i), float(v)) for k, s in series.items() for i, v in enumerate(s)] + [("walk", date(2030, 1, 1), None)]
    got = {r["ticker"]: r for r in regression.unit_root(spark.createDataFrame(rows, "ticker string, date date, x double"), "x", most_lags=most).collect()}
    for k in ("walk", "back"):
        tried = [dense(series[k], p, most) for p in range(most + 1)]
        best = min(range(most + 1), key=lambda p: tried[p][0])
        assert got[k]["lags"] == best and abs(got[k]["statistic"] - tried[best][1]) < 1e-6
    assert not got["walk"]["stationary"] and got["back"]["stationary"]
    assert got["short"]["statistic"] is None and got["flat"]["statistic"] is None and got["short"]["stationary"] is None

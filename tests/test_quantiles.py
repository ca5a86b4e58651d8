"""Quantiles of a whole column without the column in one task."""

from __future__ import annotations

import numpy as np
import pytest

from stratapanel.operators import quantiles as q


@pytest.mark.parametrize("bins, rows", [(4, 3), (4096, 10_000), (3, 0)])
def test_quantiles_are_exact(spark, monkeypatch, bins, rows):
    monkeypatch.setattr(q, "BINS", bins)
    monkeypatch.setattr(q, "SORTED_ROWS", rows)
    rnd = np.random.default_rng(3)
    x = np.r_[rnd.normal(size=200), np.full(50, 0.5), 1e9 * rnd.random(5), [-0.0, 0.0]]
    shares = [0.0, 0.01, 0.25, 0.5, 0.731, 0.99, 1.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    assert q.quantiles(df, "x", shares) == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12)
    odd = spark.createDataFrame([(v,) for v in (float("-inf"), -1e308, 1.0, 1e308, float("inf"), float("nan"))], "x double")
    assert q.quantiles(odd, "x", [0.0, 0.2, 0.4, 0.6, 0.8]) == [float("-inf"), -1e308, 1.0, 1e308, float("inf")]
    assert np.isnan(q.quantiles(odd, "x", [1.0])[0])
    assert q.quantiles(df.where("false"), "x", [0.5]) == [None] and q.quantiles(df.where("x = 0.5"), "x", [0.3]) == [0.5]


def test_whole_table_quantiles_of_queries_are_no_percentile_of_one_task(spark, tables):
    import __spark_entry__

    for name in ("target_damped", "sector_composite"):
        plan = __spark_entry__.queries()[name](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan

"""Trailing figures of the grouped pass against window expressions."""

from __future__ import annotations

from datetime import date, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratapanel.functions import expr
from stratapanel.operators import rolling
from stratapanel.plans import factors
from stratapanel.sources.tables import panel


def test_grouped_figures_equal_windows(spark, monkeypatch):
    """Gaps, constant stretches and series shorter than the frame; blocks shorter than a series change nothing."""
    monkeypatch.setattr(expr, "LONG", 5)
    rnd = np.random.default_rng(1)
    rows = []
    for k, n in (("a", 90), ("b", 3), ("c", 40)):
        for i in range(n):
            x = None if rnd.random() < 0.1 else 0.1 if 30 < i < 60 else float(rnd.integers(0, 9)) / 7 + 1e5
            rows.append((k, date(2020, 1, 1) + timedelta(i), x, None if rnd.random() < 0.1 else float(rnd.normal())))
    df = spark.createDataFrame(rows, "ticker string, date date, x double, y double")
    made = {
        "mean": lambda: expr.mean("x", 10, 3), "full": lambda: expr.mean("x", 7), "std": lambda: expr.std("x", 10, 2), "one": lambda: expr.std("x", 5, 1), "sum": lambda: expr.roll(F.sum, "y", 10, 1), "low": lambda: expr.roll(F.min, "y", 6, 2),
        "high": lambda: expr.roll(F.max, "y", 6, 2), "skew": lambda: expr.adjusted_skew("y", 8), "kurt": lambda: expr.adjusted_kurtosis("y", 8), "z": lambda: expr.zscore("x", 10, 4), "corr": lambda: expr.rolling_corr("x", "y", 10, 4),
        "mad": lambda: expr.mean_deviation("y", 6), "median": lambda: expr.median("y", 6), "rank": lambda: expr.trailing_rank("x", 6),
    }
    want = df.select("ticker", "date", *(f().alias(n) for n, f in made.items())).orderBy("ticker", "date").toPandas()
    for block in (4096, 16):
        monkeypatch.setattr(rolling, "BLOCK_ROWS", block)
        with expr.grouped() as asked:
            columns = [f().alias(n) for n, f in made.items()]
        assert len(asked) >= len(made)
        got = rolling.add_trailing(df, list(asked.values())).select("ticker", "date", *columns).orderBy("ticker", "date").toPandas()
        for name in made:
            a, b = want[name].astype(float), got[name].astype(float)
            assert (a.isna() == b.isna()).all(), name
            assert np.allclose(a.dropna(), b.dropna(), rtol=1e-7, atol=1e-7), name  # window expressions round constant frames by 1e-17, over a spread of 1e-9
            assert 0 < a.notna().sum()
        for name in ("mean", "full", "sum"):  # these round as a window expression does: a mean may stand at a limit
            assert want[name].dropna().tolist() == got[name].dropna().tolist()


@pytest.mark.parametrize("family", ["mean_reversion", "volatility", "volume", "alternative", "composite"])
def test_families_leave_long_frames_to_one_pass(spark, tables, monkeypatch, family):
    names = factors.list_factors(family)
    got = factors.compute(panel(spark, tables), names)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "-62, currentrow" not in plan and "-251, currentrow" not in plan and plan.count("FlatMapGroupsInArrow") == 1
    monkeypatch.setattr(expr, "LONG", 1 << 30)
    some = F.col("ticker") % 10 == 0
    want = factors.compute(panel(spark, tables), names).where(some).orderBy("ticker", "date").toPandas()
    pd.testing.assert_frame_equal(got.where(some).orderBy("ticker", "date").toPandas(), want, rtol=1e-7, atol=1e-7)


def test_regime_and_beta_have_no_long_frames(spark, tables):
    from stratapanel.plans.panel_queries import QUERIES

    for name in ("regime_trend_vol", "rolling_beta"):
        plan = QUERIES[name](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "collect_list" not in plan and "-59, currentrow" not in plan and "-199, currentrow" not in plan


def test_all_factors_carry_no_family_through_the_ranks_of_a_day(spark, tables):
    from stratapanel.plans.factor_queries import all_factors

    df = all_factors(spark, tables)
    assert df.columns == ["date", "ticker", *factors.list_factors()]
    for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
        if "rank(" in line and "windowspecdefinition(date" in line:
            break
    else:
        raise AssertionError("no rank of a day")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") >= 2


def test_halves_round_as_sql_does(spark):
    """Values whose decimal text and whose scaled value lie on different sides of a half."""
    values = [46.2868125, 64.5338125, 0.1478125, 51.2258125, -46.2868125, 0.1478125 - 2**-55, 1.0000005, -2.5e-7, 4e303, None] + [k + (2 * k + 1) / 2e6 for k in range(400)]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(expr.rounded("x", 6)).collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [values]).fetchall()]

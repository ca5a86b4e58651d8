"""Monitoring, fills, ledgers, statistics and the calendar on known answers."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapanel.functions import calendar
from stratapanel.operators import execution, monitoring, statistics


def test_integrity_and_drift(spark):
    good = spark.createDataFrame([("a", date(2024, 1, 1), 1.0, 5.0)], "ticker string, date date, close double, volume double")
    assert monitoring.incoming(good) == ("PASS", [])
    assert monitoring.incoming(good.withColumn("close", F.lit(None).cast("double"))) == ("FAIL", ["null close"])
    assert monitoring.incoming(good.withColumn("volume", F.lit(-1.0))) == ("FAIL", ["negative volume"])
    assert monitoring.incoming(good.where("false"))[0] == "FAIL" and monitoring.incoming(good.drop("volume")) == ("FAIL", ["missing column volume"])
    old = spark.range(500).select(F.lit("a").alias("ticker"), F.lit(date(2024, 1, 1)).alias("date"), (F.col("id") % 50).cast("double").alias("close"), F.lit(1.0).alias("volume"))
    assert monitoring.incoming(old, old, ["close"])[0] == "PASS"
    assert monitoring.incoming(old.withColumn("close", F.col("close") + 30), old, ["close"])[0] == "WARNING"


def test_signal_health(spark):
    day = spark.range(150).select(F.col("id").alias("ticker"), (F.col("id") / 150.0).alias("prediction"))
    fine = monitoring.signal_health(day, day, day).first()
    assert not any(fine[c] for c in ("drifted", "collapsed", "shrunk", "unstable")) and fine["stability"] == pytest.approx(1)
    bad = monitoring.signal_health(day.limit(20).withColumn("prediction", F.lit(0.5)), day, day).first()
    assert bad["drifted"] and bad["collapsed"] and bad["shrunk"]


def test_performance_status(spark):
    rows = [(date(2024, 1, 1) + timedelta(i), 0.05, 0.01 if i < 50 else -0.05, 0.005) for i in range(60)]
    got = monitoring.performance_status(spark.createDataFrame(rows, "date date, ic double, portfolio_return double, benchmark_return double")).orderBy("date").collect()
    assert got[10]["status"] == "HEALTHY" and got[-1]["status"] == "CRITICAL"
    assert got[-1]["drawdown"] == pytest.approx(1 - 0.95**10)


def test_fills(spark):
    orders = spark.createDataFrame([("d", "a", 10.7, "buy", 0.0), ("d", "b", 5.0, "sell", 0.0), ("d", "c", 0.0, "buy", 0.0), ("d", "z", 1.0, "buy", 0.0)], "date string, ticker string, shares double, side string, impact_rate double")
    prices = spark.createDataFrame([("d", "a", 100.0, 1e6, 0.0), ("d", "b", 50.0, 0.0, 0.0), ("d", "c", 10.0, 1e6, 0.0)], "date string, ticker string, close double, volume double, volatility double")
    got = {r["ticker"]: r for r in execution.fills(orders, prices).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"]["failure_reason"] == "ZERO_VOLUME" and got["c"]["failure_reason"] == "INVALID_INPUTS"
    assert got["a"]["success"] and got["a"]["shares"] == 10 and got["a"]["fill_price"] == pytest.approx(100 * 1.0007) and got["a"]["cost_bps"] == pytest.approx(17)
    assert {r["failure_reason"] for r in execution.fills(orders, prices, fill=0.0).collect()} == {"ZERO_VOLUME", "PROBABILITY"}


def test_ledger(spark):
    rows = [("p", 1, "buy", "a", 10.0, 10.0), ("p", 2, "buy", "a", 10.0, 20.0), ("p", 3, "dividend", "a", 0.0, 1.0), ("p", 4, "sell", "a", 5.0, 30.0), ("p", 5, "sell", "a", 99.0, 30.0), ("p", 6, "buy", "a", 1e9, 30.0)]
    got = execution.ledger(spark.createDataFrame(rows, "portfolio string, seq long, type string, ticker string, shares double, price double"), 1000.0, 0.0, 0.0).orderBy("seq").collect()
    assert [r["accepted"] for r in got] == [True, True, True, True, False, False]
    assert [r["cash"] for r in got] == [900.0, 700.0, 720.0, 870.0, 870.0, 870.0] and got[3]["pnl"] == 75.0


def test_kill_switch(spark):
    rets = [-0.25] + [0.0] * 25 + [0.2] * 3
    df = spark.createDataFrame([("s", date(2024, 1, 1) + timedelta(i), r) for i, r in enumerate(rets)], "strategy string, date date, ret double")
    got = [r["exposure"] for r in execution.kill_switch(df).orderBy("date").collect()]
    assert got[0] == 1.0 and set(got[1:22]) == {0.0}


def test_trade_figures(spark):
    df = spark.createDataFrame([(10.0, "long"), (-5.0, "short"), (None, "long"), (2.0, "buy")], "pnl double, side string")
    assert tuple(execution.trade_figures(df).first()) == (0.6667, 1.2, 12.0, -5.0, 7.0, 3)
    assert tuple(execution.trade_figures(df.where("false")).first()) == (0.0, 0.0, 0.0, 0.0, 0.0, 0)


def test_statistics(spark):
    assert statistics.t_probability(2.228, 10) == pytest.approx(0.05, abs=1e-4) and statistics.t_probability(0.0, 5) == pytest.approx(1.0)
    assert statistics.false_discovery([0.01, 0.04, 0.03, 0.5]) == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])
    rnd = np.random.default_rng(0)
    noise = [(date(2020, 1, 1) + timedelta(i), float(x), float(w)) for i, (x, w) in enumerate(zip(rnd.normal(0.5, 1, 300), np.cumsum(rnd.normal(size=300)), strict=True))]
    df = spark.createDataFrame(noise, "date date, x double, w double")
    assert statistics.t_test(df, "x")["significant"] and statistics.dickey_fuller(df, "x")["stationary"] and not statistics.dickey_fuller(df, "w")["stationary"]
    groups = statistics.cluster(["a", "b", "c"], {("a", "b"): 0.95, ("a", "c"): 0.1, ("b", "c"): -0.05})
    assert groups["a"] == groups["b"] != groups["c"]
    decay = spark.createDataFrame([(1, 0.1), (2, -0.08), (5, 0.04)], "lag int, ic double")
    assert statistics.half_life(decay) == 5 and statistics.half_life(decay.where("false")) is None


def test_two_regimes(spark):
    rnd = np.random.default_rng(2)
    x = np.r_[rnd.normal(0, 0.01, 150), rnd.normal(0, 0.08, 150)]
    df = spark.createDataFrame([("k", date(2020, 1, 1) + timedelta(i), float(v)) for i, v in enumerate(x)], "ticker string, date date, r double")
    got = [r["state"] for r in statistics.two_regimes(df, "r").orderBy("date").collect()]
    assert np.mean(got[:150]) < 0.1 and np.mean(got[150:]) > 0.9


def _one_chain(x: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The chain of one series, row by row."""
    if len(x) < 10 or x.std() == 0:
        return np.zeros(len(x), int)
    mean, var = np.full(2, x.mean()), x.var() * np.array([0.5, 2.0])
    step, start = np.array([[0.95, 0.05], [0.05, 0.95]]), np.full(2, 0.5)
    for _ in range(rounds):
        like = np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(var) + 1e-300
        ahead, scale = np.empty_like(like), np.empty(len(x))
        for t in range(len(x)):
            ahead[t] = (start if not t else ahead[t - 1] @ step) * like[t]
            scale[t] = ahead[t].sum()
            ahead[t] /= scale[t]
        behind = np.ones_like(like)
        for t in range(len(x) - 2, -1, -1):
            behind[t] = step @ (like[t + 1] * behind[t + 1]) / scale[t + 1]
        each = ahead * behind
        each /= each.sum(1, keepdims=True)
        moves = step * (ahead[:-1].T @ (like[1:] * behind[1:] / scale[1:, None]))
        step, start = moves / moves.sum(1, keepdims=True), each[0]
        mean = (each * x[:, None]).sum(0) / each.sum(0)
        var = np.maximum((each * (x[:, None] - mean) ** 2).sum(0) / each.sum(0), 1e-12)
    cost, came = np.log(start + 1e-300) + np.log(like[0]), np.zeros((len(x), 2), int)
    for t in range(1, len(x)):
        way = cost[:, None] + np.log(step + 1e-300)
        came[t], cost = way.argmax(0), way.max(0) + np.log(like[t])
    path = np.full(len(x), cost.argmax())
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path if var[1] >= var[0] else 1 - path


def test_two_regimes_of_many_keys(spark, monkeypatch):
    """Series of any length are fitted side by side, and each gets the states it gets alone; keys go over batches."""
    rnd = np.random.default_rng(5)
    series = {k: np.r_[rnd.normal(0, 0.02, n), rnd.normal(0.01, 0.2, n // 2), rnd.normal(0, 0.02, n // 3)] for k, n in enumerate([4, 9, 40, 41, 75, 120, 12, 300, 10])}
    series |= {20: np.full(30, 0.25), 21: np.array([0.5])}
    sizes = np.array([len(x) for x in series.values()])
    alone = np.concatenate([_one_chain(x) for x in series.values()])
    monkeypatch.setattr(statistics, "REGIME_CELLS", 500)
    assert statistics.regime_states(np.concatenate(list(series.values())), sizes).tolist() == alone.tolist() and 0 < alone.mean() < 1
    rows = [(k, date(2020, 1, 1) + timedelta(i), float(v)) for k, x in series.items() for i, v in enumerate(x)] + [(None, date(2020, 1, 1), 0.1), (2, date(2030, 1, 1), None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = statistics.two_regimes(spark.createDataFrame(rows, "ticker long, date date, r double"), "r").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sizes.sum() + 1
    assert [r["state"] for r in sorted((r for r in got if r["ticker"] is not None), key=lambda r: (r["ticker"], r["date"]))] == alone.tolist()


def test_calendar(spark):
    assert calendar.easter(2024) == date(2024, 3, 31)
    closed = {date(2024, 1, 1), date(2024, 1, 15), date(2024, 2, 19), date(2024, 3, 29), date(2024, 5, 27), date(2024, 6, 19), date(2024, 7, 4), date(2024, 9, 2), date(2024, 11, 28), date(2024, 12, 25)}
    assert calendar.holidays(2024) == closed
    assert calendar.trading_days(spark, date(2024, 1, 1), date(2024, 12, 31)).count() == 252
    assert calendar.previous_trading_day(date(2024, 4, 1)) == date(2024, 3, 28) and calendar.next_trading_day(date(2024, 3, 28)) == date(2024, 4, 1)
    old = spark.createDataFrame([(date(2024, 3, 28), date(2024, 4, 1)), (date(2024, 3, 30), date(2024, 4, 1)), (date(2024, 4, 1), date(2024, 4, 1))], "d date, today date")
    assert [r[0] for r in old.select(calendar.business_days_old("d")).collect()] == [2, 1, 0]

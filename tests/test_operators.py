"""Panel operators on small fixtures whose answers are known."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratapanel.functions.aliases import resolve
from stratapanel.operators import cross_section as xs
from stratapanel.operators import portfolio as pf
from stratapanel.operators import research, shaping
from stratapanel.operators.asof import asof_join
from stratapanel.operators.ewm import Ewm, add_ewm, ewm_values
from stratapanel.plans import factors


def _days(n: int, start: date = date(2023, 1, 2)) -> list[date]:
    return [start + timedelta(i) for i in range(n)]


@pytest.fixture
def market(spark):
    """Two tickers, random walks, with all columns that a factor may need."""
    rnd, rows = np.random.default_rng(5), []
    for t in ("A", "B"):
        close = 100 + np.cumsum(rnd.normal(size=150))
        for i, d in enumerate(_days(150)):
            rows.append((d, t, "s", float(close[i - 1] if i else close[0]), float(close[i] * 1.01), float(close[i] * 0.99), float(close[i]), float(rnd.integers(100, 1000))))
    return spark.createDataFrame(rows, "date date, ticker string, sector string, open double, high double, low double, close double, volume double")


def test_technical_factors_equal_pandas(market):
    names = ["return_5d", "zscore_21d", "volatility_21d", "rsi_14d", "macd_12_26", "tsi", "skew_21d", "cci_20"]
    got = factors.compute(market, names).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    pdf = market.toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    close = pdf.groupby("ticker")["close"]
    delta = close.diff()
    gain, loss = delta.clip(lower=0).fillna(0), (-delta).clip(lower=0).fillna(0)
    smooth = lambda x: x.groupby(pdf["ticker"]).transform(lambda v: v.ewm(com=13, min_periods=14).mean())
    want = {
        "return_5d": close.pct_change(5), "zscore_21d": close.transform(lambda x: (x - x.rolling(21).mean()) / (x.rolling(21).std() + 1e-9)), "volatility_21d": close.transform(lambda x: x.pct_change().rolling(21).std() * 252**0.5),
        "rsi_14d": 100 - 100 / (1 + smooth(gain) / (smooth(loss) + 1e-9)), "macd_12_26": close.transform(lambda x: x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean()),
        "skew_21d": close.transform(lambda x: x.pct_change().rolling(21).skew()),
    }
    for name, x in want.items():
        assert np.allclose(got[name], x.fillna(0), atol=1e-8), name


def test_no_look_ahead(market):
    last = market.agg(F.max("date")).first()[0]
    changed = market.withColumn("close", F.when((F.col("ticker") == "A") & (F.col("date") == last), F.col("close") * 2).otherwise(F.col("close")))
    names = [n for f in ("momentum", "mean_reversion", "volatility") for n in factors.list_factors(f)]
    before, after = (factors.compute(m, names).where(F.col("date") < last).toPandas().sort_values(["ticker", "date"]) for m in (market, changed))
    assert np.allclose(before[names].to_numpy(float), after[names].to_numpy(float))


def test_registry_is_complete():
    assert len(factors.FACTORS) == 120
    assert [len(factors.list_factors(f)) for f in ("fundamental", "earnings", "alternative", "composite")] == [34, 13, 12, 15]


def test_missing_columns_give_nulls(market):
    got = factors.compute(market, list(factors.FUNDAMENTAL)).first().asDict()
    assert got["qual_roe"] is None and got["val_dividend_yield"] == 0.0
    assert resolve(["TrailingPE", "x"], "pe_ratio") == "TrailingPE" and resolve(["x"], "pe_ratio") is None


def test_short_and_empty_history(market):
    names = factors.list_factors("momentum") + factors.list_factors("ewm")
    one = factors.compute(market.where("date = date'2023-01-02'"), names).first()
    assert one["return_5d"] == 0.0 and one["stoch_k"] == 50.0 and one["williams_r"] == -50.0
    assert factors.compute(market.where("false"), names).count() == 0


@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_equals_the_weighted_sum(adjust):
    x = np.array([np.nan, 1.0, 2.0, np.nan, np.nan, 5.0, 4.0])
    want = [np.nan] * len(x)
    for i in range(len(x)):
        known = [j for j in range(i + 1) if not np.isnan(x[j])]
        if len(known) >= 2:
            mean = x[known[0]]
            for before, j in zip(known, known[1:], strict=False):
                old = 0.7 ** (j - before) * (1.0 if not adjust else sum(0.7 ** (before - k) for k in known if k <= before))
                new = 1.0 if adjust else 0.3
                mean = (old * mean + new * x[j]) / (old + new)
            want[i] = mean
    assert np.allclose(ewm_values(x, 0.3, adjust, 2), want, equal_nan=True)


def test_ewm_columns_keep_rows(market):
    out = add_ewm(market, [Ewm("m", "close", 0.5), Ewm("mm", "m", 0.5)])
    assert out.count() == market.count() and out.columns == [*market.columns, "m", "mm"]


def test_asof_join(spark):
    left = spark.createDataFrame([("a", date(2024, 1, d), d) for d in (1, 5, 9)] + [("b", date(2024, 1, 5), 0), (None, date(2024, 1, 5), 1)], "k string, date date, v int")
    right = spark.createDataFrame([("a", date(2024, 1, 5), 50, None), ("a", date(2024, 1, 2), 20, 1), ("a", date(2024, 1, 5), 55, None), (None, date(2024, 1, 1), 7, 7)], "k string, date date, x int, y int")
    got = {(r["k"], r["v"]): (r["x"], r["y"], r["at"]) for r in asof_join(left, right, "k", "date", ["x", "y"], matched_on="at").collect()}
    assert got[("a", 1)] == (None, None, None) and got[("a", 5)] == (55, None, date(2024, 1, 5)) and got[("a", 9)][0] == 55 and got[("b", 0)][0] is None
    strict = {(r["k"], r["v"]): r["x"] for r in asof_join(left, right, "k", "date", ["x"], tolerance_days=3, exact=False).collect()}
    assert strict[("a", 5)] == 20 and strict[("a", 9)] is None


def test_cross_section(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), t, "s" if t < "c" else "u", x) for t, x in (("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 9.0), ("e", None))], "date date, ticker string, sector string, x double")
    assert {r["ticker"]: r["x"] for r in xs.rank_day(df, ["x"]).collect()} == {"a": 0.25, "b": 0.625, "c": 0.625, "d": 1.0, "e": 0.5}
    assert [r["ticker"] for r in xs.top_n(df, "x", 2).orderBy("place").collect()] == ["d", "b"]
    assert max(r["x"] or 0 for r in xs.winsorize(df, ["x"], 0.0, 0.5).collect()) == 2.0
    assert abs(sum(r["x"] for r in xs.zscore_day(df, ["x"]).collect())) < 1e-9
    buckets = {r["ticker"]: r["q"] for r in df.select("ticker", xs.quantile_bucket("x", 2).alias("q")).collect()}
    assert buckets == {"a": 1, "b": 1, "c": 1, "d": 2, "e": None}


def test_walk_forward_has_an_embargo():
    days = _days(100)
    for _, end, start, _ in shaping.walk_forward(days, 40, 10, embargo=5):
        assert (start - end).days == 6
    assert shaping.walk_forward(days, 40, 10, embargo=5, window=20)[0][0] == days[20]
    for a, b, c, d in shaping.calendar_splits(date(2020, 1, 15), date(2022, 1, 1), 6, 3):
        assert a < b < c <= d and (c - b).days == 31


def test_upsert_and_keep_one(spark):
    old = spark.createDataFrame([(date(2024, 1, 1), 1.0), (date(2024, 1, 2), 2.0)], "date date, close double")
    new = spark.createDataFrame([(date(2024, 1, 2), 5.0), (date(2024, 1, 3), 3.0)], "date date, close double")
    assert {r[0].day: r[1] for r in shaping.upsert(old, new, ["date"]).collect()} == {1: 1.0, 2: 5.0, 3: 3.0}


class TestSolvers:
    sigma = np.array([[0.04, 0.018, 0.0], [0.018, 0.09, 0.0], [0.0, 0.0, 0.01]])
    mu = np.array([0.15, 0.02, 0.08])

    def test_mean_variance_is_optimal(self):
        w = pf.quadratic_weights(self.mu, self.sigma, 1.0)
        slope = self.mu - 2 * self.sigma @ w
        assert np.isclose(w.sum(), 1) and (w >= -1e-12).all()
        assert np.allclose(slope[w > 1e-6], slope[w > 1e-6][0], atol=1e-5) and (slope[w <= 1e-6] <= slope.max() + 1e-6).all()
        assert pf.quadratic_weights(self.mu, self.sigma, 1.0, 0.4).max() <= 0.4 + 1e-9

    def test_risk_contributions_are_equal(self):
        w = pf.risk_parity_weights(self.sigma)
        share = w * (self.sigma @ w)
        assert np.allclose(share, share.mean(), rtol=1e-6)

    def test_views_move_the_posterior(self):
        caps, none = np.array([3.0, 2.0, 1.0]), np.full(3, np.nan)
        implied = pf.black_litterman_returns(self.sigma, caps, none)
        assert np.allclose(implied, 2.5 * self.sigma @ (caps / 6))
        assert pf.black_litterman_returns(self.sigma, caps, np.array([0.5, np.nan, np.nan]), 0.9)[0] > implied[0]

    def test_kelly_and_shrinkage(self):
        assert np.isclose(pf.kelly_weights(self.mu, self.sigma).sum(), 1)
        assert np.allclose(pf.kelly_weights(np.zeros(3), self.sigma), 1 / 3)
        x = np.random.default_rng(1).normal(size=(50, 10))
        assert np.linalg.eigvalsh(pf.shrunk_covariance(x))[0] > np.linalg.eigvalsh(np.cov(x.T))[0]


def test_backtest_in_a_rising_market_and_its_books(spark):
    days = _days(20)
    bars = spark.createDataFrame([(d, t, 100.0 + 2 * i, 102.0 + 2 * i, 1e6) for i, d in enumerate(days) for t in ("A", "B")], "date date, ticker string, open double, close double, volume double")
    weights = bars.select(F.lit("up").alias("strategy"), "date", "ticker", F.lit(0.5).alias("weight"))
    curve = pf.backtest(pf.signal_days(bars, weights)).toPandas().sort_values("date")
    assert len(curve) == 20 and curve["total_value"].iloc[-1] > curve["total_value"].iloc[0]
    assert np.allclose(curve["total_value"], curve["invested_value"] + curve["cash"], atol=1e-3)
    first = curve["invested_value"].iloc[0] / 1e6
    assert first <= 0.2 * 1.03


def test_trailing_stop_sells(spark):
    prices = [100.0, 120.0, 100.0, 100.0]
    bars = spark.createDataFrame([(d, "A", p, p, 1e6) for d, p in zip(_days(4), prices, strict=True)], "date date, ticker string, open double, close double, volume double")
    weights = bars.limit(1).select(F.lit("s").alias("strategy"), "date", "ticker", F.lit(1.0).alias("weight"))
    curve = pf.backtest(pf.signal_days(bars, weights), max_turnover=1.0).toPandas().sort_values("date")
    assert curve["invested_value"].tolist()[2:] == [0.0, 0.0] and curve["n_trades"].tolist() == [1, 0, 1, 0]


def test_psi_of_equal_samples_is_zero(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"))
    assert research.psi(df, df, "x").first()[0] == pytest.approx(0.0, abs=1e-12)
    assert research.psi(df, df.select((F.col("x") + 40).alias("x")), "x", kind="bins").first()[0] > 0.25


def test_stages_put_all_ranks_of_a_day_together():
    plan = factors.stages(factors.list_factors("composite"))
    daily = [i for i, stage in enumerate(plan) if any(s.daily for s in stage)]
    assert len(daily) == 1 and all(s.daily for s in plan[daily[0]])
    seen = set()
    for stage in plan:
        assert all(n in seen for s in stage for n in s.needs)
        seen |= {s.name for s in stage}


def test_flags_columns_and_hash(spark):
    from stratapanel.operators import checks

    day = lambda d: date(2024, 1, d)
    w = spark.createDataFrame([(day(1), "a", "s", 0.5), (day(1), "b", "t", -0.5), (day(2), "a", "s", 0.2), (day(2), "c", "s", 0.8)], "date date, ticker string, sector string, weight double")
    got = {r["date"].day: r for r in checks.weight_flags(w).collect()}
    assert got[1]["dollar_neutral"] and not got[1]["long_only"] and got[1]["turnover"] is None and got[1]["turnover_within"]
    assert got[2]["fully_invested"] and not got[2]["sectors_within"] and abs(got[2]["turnover"] - 1.6) < 1e-9 and not got[2]["turnover_within"]
    frame = spark.createDataFrame([(day(1), "a", 1.0, 2, "x", 0.1)], "date date, ticker string, close double, rsi int, note string, raw_ret_5d double").withColumn("_part", F.lit(1))
    assert checks.factor_columns(frame) == ["rsi", "raw_ret_5d"] and checks.forward_return_columns(frame) == ["raw_ret_5d"]
    one, two = (checks.table_hash(x).first() for x in (w, w.repartition(3).orderBy("weight")))
    assert one == two and checks.table_hash(w.where("weight > 0")).first() != one


def test_trades_close_at_a_gain_and_positions_are_valued(spark):
    prices = {1: 10.0, 2: 10.0, 3: 20.0, 4: 20.0}
    names = lambda d, w: [{"ticker": "a", "open": prices[d], "close": prices[d], "volume": 1e9, "weight": w}, {"ticker": "b", "open": 5.0, "close": 5.0, "volume": 1e9, "weight": 1.0 - w if w is not None else None}]
    rows = [("s", date(2024, 1, d), d != 2, names(d, w)) for d, w in ((1, 0.5), (2, None), (3, 0.0), (4, 0.0))]
    days = spark.createDataFrame(rows, "strategy string, date date, is_rebalance boolean, names array<struct<ticker:string,open:double,close:double,volume:double,weight:double>>")
    events = pf.backtest_events(days, capital=1000.0, commission=0.0, spread=0.0, slippage=0.0, stop=0.0, max_turnover=10.0)
    trades = {(r["date"].day, r["ticker"]): r for r in pf.backtest_trades(events).collect()}
    assert trades[1, "a"]["side"] == "BUY" and trades[1, "a"]["shares"] == 50 and trades[1, "a"]["pnl"] == 0
    assert trades[3, "a"]["side"] == "SELL" and trades[3, "a"]["pnl"] == 500 and trades[3, "a"]["reason"] == "REBALANCE"
    positions = {r["ticker"]: (r["shares"], r["value"]) for r in pf.backtest_positions(events).collect()}
    assert positions == {"b": (300.0, 1500.0)}
    assert [r["total_value"] for r in pf.backtest(days, capital=1000.0, commission=0.0, spread=0.0, slippage=0.0, stop=0.0, max_turnover=10.0).orderBy("date").collect()] == [1000.0, 1000.0, 1500.0, 1500.0]
    capped = pf.backtest_trades(pf.backtest_events(days.where("date < date'2024-01-02'"), capital=1000.0, commission=0.0, spread=0.0, slippage=0.0, max_turnover=10.0, position_cap=0.3))
    assert {r["ticker"]: r["value"] for r in capped.collect()} == {"a": 500.0, "b": 500.0}


def test_stop_and_short_cost_basis(spark):
    row = lambda d, price, w, again: ("s", date(2024, 1, d), again, [{"ticker": "a", "open": price, "close": price, "volume": 1e9, "weight": w}])
    kind = "strategy string, date date, is_rebalance boolean, names array<struct<ticker:string,open:double,close:double,volume:double,weight:double>>"
    plain = {"capital": 1000.0, "commission": 0.0, "spread": 0.0, "slippage": 0.0, "max_turnover": 10.0}
    fall = pf.backtest_trades(pf.backtest_events(spark.createDataFrame([row(1, 10.0, 1.0, True), row(2, 8.0, None, False)], kind), **plain)).orderBy("date").collect()
    assert [(r["reason"], r["pnl"]) for r in fall] == [("REBALANCE", 0.0), ("STOP", -200.0)]
    short = pf.backtest_trades(pf.backtest_events(spark.createDataFrame([row(1, 10.0, -1.0, True), row(2, 5.0, 0.0, True)], kind), stop=0.0, **plain)).orderBy("date").collect()
    assert [(r["side"], r["pnl"]) for r in short] == [("SELL", 0.0), ("BUY", 500.0)]


def test_allocation_options_and_fallbacks(spark):
    rnd = np.random.default_rng(2)
    rows = [(date(2024, 1, 1), t, s, 1.0, [float(x) for x in rnd.normal(0, v, 60)], b) for t, s, v, b in (("a", 0.9, 0.01, 0.7), ("b", 0.6, 0.02, 0.2), ("c", 0.4, 0.03, 0.1))]
    rows += [(date(2024, 1, 1), "d", None, 1.0, rows[0][4], 0.1), (date(2024, 1, 1), "e", 0.5, 1.0, [*rows[0][4][:-1], float("nan")], 0.1), (date(2024, 1, 1), "f", 0.5, 1.0, [0.1], 0.1), (date(2024, 1, 2), "a", 0.5, 1.0, [0.0] * 60, 0.5), (date(2024, 1, 2), "b", 0.5, 1.0, [0.0] * 60, 0.5), (date(2024, 1, 3), "a", None, 1.0, None, 0.5)]
    day = spark.createDataFrame(rows, "date date, ticker string, score double, market_cap double, returns array<double>, budget double")
    for method in pf.METHODS:
        got = pf.allocate(day, method).toPandas()
        one = got[got["date"] == date(2024, 1, 1)]
        assert set(one["ticker"]) <= {"a", "b", "c"} and abs(one["weight"].sum() - 1) < 1e-9
        assert got[got["date"] == date(2024, 1, 2)]["weight"].tolist() == pytest.approx([0.5, 0.5]) and not (got["date"] == date(2024, 1, 3)).any()
    weights = lambda **o: {r["ticker"]: r["weight"] for r in pf.allocate(day.where("date = date'2024-01-01'"), **o).collect()}
    assert weights(method="mean_variance", risk=200.0).get("b", 0) > weights(method="mean_variance", risk=1.0).get("b", 0)
    even, tilted = weights(method="risk_parity"), weights(method="risk_parity", budget="budget")
    assert tilted["a"] > even["a"] and weights(method="black_litterman", confidence=0.0, cap=0.6) != weights(method="black_litterman", confidence=0.9, cap=0.6)


def test_backtest_keeps_the_type_of_tickers(spark):
    """Integer tickers on days, trades and positions; names reach a strategy from the day on when it first wants them."""
    bars = spark.createDataFrame([(date(2024, 1, d), t, 10.0 + t, 10.0 + t, 1e9) for d in range(1, 6) for t in (1, 2, 3)], "date date, ticker long, open double, close double, volume double")
    weights = spark.createDataFrame([("s", date(2024, 1, 2), 2, 1.0), ("s", date(2024, 1, 4), 3, 1.0)], "strategy string, date date, ticker long, weight double")
    days = pf.signal_days(bars, weights, "daily")
    assert [[n["ticker"] for n in r["names"]] for r in days.orderBy("date").collect()] == [[], [2], [2], [2, 3], [2, 3]]
    events = pf.backtest_events(days, max_turnover=10.0)
    assert pf.backtest_trades(events).schema["ticker"].dataType.simpleString() == "bigint"
    assert {(r["ticker"], r["side"]) for r in pf.backtest_trades(events).collect()} == {(2, "BUY"), (2, "SELL"), (3, "BUY")}
    assert [r["ticker"] for r in pf.backtest_positions(events).collect()] == [3]
    assert pf.backtest(days).count() == 5


def test_ledgers_pass_in_small_batches(spark):
    """Names reach a ledger as rows, in batches of any size, and strategies that share a task keep apart."""
    days = [date(2024, 1, 1 + k) for k in range(12)]
    names = "array<struct<ticker:bigint,open:double,close:double,volume:double,weight:double>>"
    rows = [(s, day, k % 5 == 0, [(t, 10.0 + t + k, 10.0 + t + k * (1 if s == "a" else -0.5), 1e4, 0.5 if k % 5 == 0 and (t + k) % 3 else None) for t in range(1, 5)] if k != 7 else []) for s in ("a", "b") for k, day in enumerate(days)]
    df = spark.createDataFrame(rows, f"strategy string, date date, is_rebalance boolean, names {names}").repartition(3)
    events = pf.backtest_events(df)
    assert "MapInArrow" in events._jdf.queryExecution().toString()
    whole = sorted(events.collect(), key=str)
    assert {r["strategy"]: r["n"] for r in events.where("kind = 'day'").groupBy("strategy").count().withColumnRenamed("count", "n").collect()} == {"a": 12, "b": 12}
    alone = [r for s in ("a", "b") for r in pf.backtest_events(df.where(F.col("strategy") == s)).collect()]
    assert sorted(alone, key=str) == whole
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(pf.backtest_events(df).collect(), key=str) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stored_rows_keep_line_items_from_being_read_again(spark, tables):
    """Line items in the plan: of candidates only chosen names' history and statements, of the books none."""
    from stratapanel.plans import panel_queries, report_queries

    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("/lineitem.parquet")
    assert scans(panel_queries._candidates(spark, tables)) == 2 and scans(panel_queries._books(spark, tables)) == 0
    assert scans(report_queries.bootstrap_ic(spark, tables)) == 0


def test_exponential_means_pass_other_columns_unchanged(spark):
    """A whole number beyond 2**53 beside a missing one stays what it is."""
    big = 2**53 + 1
    rows = [(1, date(2024, 1, d), float(d) if d != 2 else None, big if d == 1 else None) for d in (3, 1, 2)]
    got = add_ewm(spark.createDataFrame(rows, "ticker int, date date, x double, id bigint"), [Ewm("m", "x", 0.5)]).orderBy("date").collect()
    assert [(r["x"], r["id"]) for r in got] == [(1.0, big), (None, None), (3.0, None)] and got[1]["m"] == 1.0

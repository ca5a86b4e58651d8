"""Report figures, bounded weights, samples, saved models and table upserts on known answers."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratapanel.operators import portfolio as pf
from stratapanel.operators import reports, research, statistics
from stratapanel.plans import models, training
from stratapanel.streaming import events

DAY = date(2024, 1, 1)


def _weights(spark, values: dict[str, float], sector: dict[str, str] | None = None):
    return spark.createDataFrame([(DAY, k, (sector or {}).get(k, "x"), v) for k, v in values.items()], "date date, ticker string, sector string, weight double")


def test_caps_by_name(spark):
    got = {x["ticker"]: x["weight"] for x in pf.bounded_weights(_weights(spark, {"a": 0.60, "b": 0.25, "c": 0.145, "d": 0.005}), 0.01, 0.4).collect()}
    assert got == pytest.approx({"a": 0.4, "b": 0.6 * 0.25 / 0.395, "c": 0.6 * 0.145 / 0.395})
    tight = pf.bounded_weights(_weights(spark, {"a": 0.7, "b": 0.2, "c": 0.1}), 0.01, 0.2).collect()
    assert [x["weight"] for x in tight] == pytest.approx([1 / 3] * 3)
    alone = pf.bounded_weights(_weights(spark, {"a": 0.004, "b": 0.003}), 0.01, 1.0).collect()
    assert [(x["ticker"], x["weight"]) for x in alone] == [("a", 1.0)]


def test_caps_by_sector(spark):
    got = {x["ticker"]: x["weight"] for x in pf.bounded_weights(_weights(spark, {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, {"a": "s", "b": "s", "c": "t", "d": "u"}), 0.0, 1.0, 0.5).collect()}
    assert got["a"] + got["b"] == pytest.approx(0.5) and got["a"] / got["b"] == pytest.approx(4 / 3) and got["c"] == pytest.approx(2 * got["d"])


def test_highest_sharpe_is_the_tangency_point():
    mu, sigma = np.array([0.10, 0.12, 0.15]), np.array([[0.04, 0.01, 0.0], [0.01, 0.05, 0.01], [0.0, 0.01, 0.09]])
    want = np.linalg.solve(sigma, mu - 0.04)
    assert pf.max_sharpe_weights(mu, sigma) == pytest.approx(want / want.sum(), abs=2e-3)
    assert pf.max_sharpe_weights(mu, sigma, rate=0.2) == pytest.approx([1 / 3] * 3)


def test_tracker_costs_turnover_and_holds_between(spark):
    rows = [(DAY + timedelta(i), t, float(s if i < 5 else -s), 0.01 * s) for i in range(7) for s, t in enumerate("abcd")]
    got = reports.tracker(spark.createDataFrame(rows, "date date, ticker string, score double, pnl_return double"), top=2).orderBy("date").collect()
    assert [x["raw_return"] for x in got] == pytest.approx([0.025] * 5 + [0.005] * 2)
    assert [x["cost"] for x in got] == pytest.approx([0.0] * 5 + [0.002, 0.0]) and {x["leverage"] for x in got} == {1.0}


def test_open_drawdown_has_no_recovery(spark):
    curve = spark.createDataFrame([("a", DAY + timedelta(i), v) for i, v in enumerate((10.0, 9.0, 8.0, 10.0, 9.5))], "ticker string, date date, close double")
    first, second = reports.top_drawdowns(curve).orderBy("place").collect()
    assert (first["depth"], first["valley"], first["recovery"], first["days"]) == (pytest.approx(-0.2), DAY + timedelta(2), DAY + timedelta(3), 2)
    assert second["recovery"] is None and second["days"] == 0


def test_figures_of_a_flat_and_a_rising_curve(spark):
    rows = [("flat", DAY + timedelta(i), 5.0) for i in range(4)] + [("up", DAY + timedelta(i), 5.0 * (1.01 + 0.001 * i) ** i) for i in range(4)]
    got = {x["ticker"]: x for x in reports.return_figures(spark.createDataFrame(rows, "ticker string, date date, close double")).collect()}
    assert got["flat"]["sharpe"] == 0 and got["up"]["sortino"] == float("inf") and got["up"]["report_sortino"] == 0 and got["up"]["sharpe"] > 0


def test_sample_correlation_equals_pandas_when_all_rows_fit(spark):
    random = np.random.default_rng(3)
    frame = pd.DataFrame({"date": [DAY + timedelta(i) for i in range(120)], "ticker": "a", "x": random.normal(size=120), "t": random.normal(size=120)})
    frame["x"] = frame["x"].where(frame.index % 7 > 0).round(1)
    rows = spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in x) for x in frame.itertuples(index=False)], "date date, ticker string, x double, t double")
    want = abs(frame["x"].fillna(frame["x"].mean()).rank().corr(frame["t"].rank())) * 120 / 119
    got = research.bootstrap_ic(rows, ["x"], "t", replicates=2).collect()
    assert [x["ic"] for x in got] == pytest.approx([want] * 2, abs=1e-9)
    few = research.bootstrap_ic(rows, ["x"], "t", replicates=3, sample=60).collect()
    assert len({round(x["ic"], 9) for x in few}) == 3 and not research.bootstrap_ic(rows.limit(10), ["x"], "t", 1).count()


def test_significance_of_a_real_factor_survives_correction(spark):
    random = np.random.default_rng(5)
    rows = [(DAY + timedelta(d), "s" if i % 2 else "u", str(i), float(x), float(random.normal()), float(x + random.normal())) for d in range(40) for i, x in enumerate(random.normal(size=20))]
    df = spark.createDataFrame(rows, "date date, sector string, ticker string, good double, noise double, t double")
    got = {x["factor"]: x for x in research.ic_significance(df, ["good", "noise"], "t").collect()}
    p = statistics.false_discovery([statistics.t_probability(got[f]["t_stat"], got[f]["n_dates"] - 2) for f in ("good", "noise")])
    assert p[0] < 1e-6 < p[1] and got["good"]["sn_icir"] > 1 > abs(got["noise"]["sn_icir"])
    assert research.lookahead(df.withColumns({"open": F.lit(1.0), "close": 1 + F.col("t") / 10}), "t").first()["leaks"]
    assert [x["reason"] for x in research.prefilter(df.withColumns({"c": F.lit(1.0), "m": F.lit(None).cast("double")}), ["good", "c", "m"]).collect()] == [None, "constant", "missing"]


def test_day_bounds_and_formats(spark):
    days = spark.createDataFrame([(DAY + timedelta(i),) for i in range(5)], "date date")
    assert reports.on_last_day(days).collect()[0][0] == DAY + timedelta(4) and reports.on_last_day(days.where("false")).count() == 0
    assert (reports.in_days(days, on="2024-01-02").count(), reports.in_days(days, last=2).count(), reports.in_days(days, since="2024-01-02").count()) == (1, 2, 3)
    x = spark.createDataFrame([(1234567.4,), (None,)], "x double")
    assert [tuple(v) for v in x.select(reports.dollars(F.col("x")), reports.percent(F.col("x") / 1e8)).collect()] == [("$1,234,567", "+1.23%"), ("-", "-")]


def test_models_are_saved_checked_and_pruned(spark, tmp_path):
    rows = spark.range(200).select(F.randn(1).alias("a"), F.randn(2).alias("b")).withColumn("t", F.col("a") * 2)
    fitted = training.model(["a", "b"], "t", trees=2, depth=2).fit(rows)
    folder = str(tmp_path / "models")
    assert models.versions(folder) == [] and models.newest(folder) is None
    for version in ("2024-01", "2024-02", "2024-03"):
        models.save(fitted, folder, version)
    assert models.serves(models.newest(folder), spark, ["a", "b"])
    flat = training.model(["a", "b"], "t", trees=1, depth=1).fit(rows.withColumn("t", F.lit(1.0)))
    assert not models.serves(flat, spark, ["a", "b"])
    assert models.prune(folder, 2, dry_run=True) == ["2024-01"] and len(models.versions(folder)) == 3
    assert models.prune(folder, 2) == ["2024-01"] and models.versions(folder) == ["2024-02", "2024-03"]


def test_stream_of_bars_updates_a_table(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "ticker string, date date, close double"
    for n, rows in enumerate(([("a", DAY, 1.0), ("b", DAY, 2.0)], [("a", DAY, 1.5), ("a", DAY + timedelta(1), 3.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        events.upsert_stream(spark.readStream.schema(schema).parquet(folder), "streamed_bars", ["ticker", "date"], str(tmp_path / "checkpoint"))
    assert sorted((r["ticker"], r["close"]) for r in spark.table("streamed_bars").collect()) == [("a", 1.5), ("a", 3.0), ("b", 2.0)]
    spark.sql("DROP TABLE streamed_bars")

"""Landing files, point-in-time fundamentals, fold scaling, training and streams."""

from __future__ import annotations

from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from stratapanel.operators.shaping import walk_forward
from stratapanel.plans import panel_queries, preprocessing, stream_queries, training
from stratapanel.sources import files
from stratapanel.streaming import events


def test_landing_files(spark, tmp_path):
    (tmp_path / "prices").mkdir()
    (tmp_path / "prices" / "abc.csv").write_text("date,open,high,low,close,volume\n2024-01-02,1,2,0.5,1.5,10\n2024-01-03,,,,,\n2024-01-04,1,1,1,0,5\n")
    got = files.read_prices(spark, str(tmp_path / "prices")).collect()
    assert [(r["ticker"], r["date"], r["close"]) for r in got] == [("ABC", date(2024, 1, 2), 1.5)]
    (tmp_path / "members.csv").write_text('date,tickers\n2024-01-02,"AAA-200101, BBB,,"\n')
    assert {r["ticker"] for r in files.read_membership(spark, str(tmp_path / "members.csv")).collect()} == {"AAA", "BBB"}
    (tmp_path / "universe.txt").write_text("aaa\n\n bbb \naaa\n")
    assert files.read_universe(spark, str(tmp_path / "universe.txt")).count() == 2
    (tmp_path / "vix.csv").write_text("date,close,volume\n2024-01-02,15,0\n")
    assert files.read_macro(spark, str(tmp_path / "vix.csv"), "vix").columns == ["date", "vix_close", "vix_volume"]
    assert files.load_parquet(spark, str(tmp_path / "none"), schema="a int").count() == 0


def test_statements_become_point_in_time_ratios(spark, tmp_path):
    (tmp_path / "fin.csv").write_text("item,2023-12-31,2022-12-31\nTotal Revenue,200,100\nNet Income,20,bad\nStockholders Equity,50,40\nGross Profit,80,30\nIgnored,1,2\n")
    long = files.read_statement(spark, str(tmp_path / "fin.csv")).withColumn("ticker", F.lit("A"))
    info = spark.createDataFrame([("A", 10.0, 1000.0, 20.0, 15.0, 5.0, 1.0, 1.5)], "ticker string, info_price double, info_market_cap double, info_pe double, info_forward_pe double, info_book double, info_eps double, info_forward_eps double")
    got = {r["date"]: r for r in preprocessing.fundamentals(long, info).collect()}
    row = got[date(2024, 3, 30)]
    assert row["qual_roe"] == 0.4 and row["qual_gross_margin"] == 0.4 and row["growth_rev_growth"] == 1.0 and row["val_ps_ratio"] == 0.2
    assert got[date(2023, 3, 31)]["growth_rev_growth"] is None and row["growth_earnings_growth"] is None
    tiers = {r["column"]: r["status"] for r in preprocessing.coverage_tiers(spark.createDataFrame([(1, None), (2, 3)], "a int, b int"), ["a", "b"]).collect()}
    assert tiers == {"a": "OK", "b": "WARNING"}


def test_upsert_table_and_rebuild_flag(spark):
    old = spark.createDataFrame([("A", date(2024, 1, 1), 1.0), ("A", date(2024, 1, 2), 2.0)], "ticker string, date date, close double")
    new = spark.createDataFrame([("A", date(2024, 1, 2), 4.0)], "ticker string, date date, close double")
    files.upsert_table(spark, "px", old, ["ticker", "date"])
    files.upsert_table(spark, "px", new, ["ticker", "date"])
    assert {r["date"].day: r["close"] for r in spark.table("px").collect()} == {1: 1.0, 2: 4.0}
    assert files.adjusted_history(old, new).first()["rebuild"] is True
    spark.sql("DROP TABLE px")


def test_scaler_is_fitted_on_training_days_only(spark, tables):
    s = panel_queries.signals(spark, tables).where("return_21d is not null")
    scaler = preprocessing.FoldScaler(["return_21d"]).fit(s.where("date < date'1998-01-01'"))
    test = s.where("date >= date'1998-01-01'")
    changed = test.withColumn("return_21d", F.when(F.col("date") == F.lit(date(2001, 5, 1)), F.col("return_21d") * 100).otherwise(F.col("return_21d")))
    a, b = (scaler.transform(x).where("date < date'2001-01-01'").agg(F.sum("return_21d")).first()[0] for x in (test, changed))
    assert a == pytest.approx(b)
    with pytest.raises(ValueError):
        preprocessing.FoldScaler(["return_21d"]).transform(test)


def test_walk_forward_training(spark, tables):
    s = panel_queries.signals(spark, tables)
    days = [r[0] for r in s.select("date").distinct().orderBy("date").collect()]
    folds = walk_forward(days, len(days) // 2, len(days) // 3)
    out = training.walk_forward_predictions(s, folds, list(panel_queries.SIGNALS), "raw_ret_5d")
    assert out.count() > 500 and out.groupBy("date", "ticker").count().where("count > 1").count() == 0
    assert out.agg(F.min("date")).first()[0] >= folds[0][2]
    figures = training.gate(training.out_of_sample(out, "raw_ret_5d", least=2)).first()
    assert figures["tier"] in ("PROD", "ENSEMBLE", "GATED") and -1 <= figures["ic_mean"] <= 1


def test_gates(spark):
    rows = spark.createDataFrame([(0.02, 0.05, 100), (0.006, 0.03, 100), (-0.01, 0.05, 100)], "ic_mean double, ic_std double, n_dates long")
    assert [r["tier"] for r in training.gate(rows).collect()] == ["PROD", "ENSEMBLE", "GATED"]


def test_features_are_orthogonal(spark, tables):
    s = panel_queries.signals(spark, tables).withColumn("twin", F.col("return_21d") * 2)
    kept = training.orthogonal_features(s, ["return_21d", "twin", "volatility_21d"], {"return_21d": 0.3, "twin": 0.2, "volatility_21d": 0.1})
    assert kept[0] == "return_21d" and "twin" not in kept


@pytest.mark.parametrize("name", sorted(stream_queries.QUERIES))
def test_streams_equal_sql(spark, tables, name):
    got = sorted(str(tuple(r)) for r in stream_queries.QUERIES[name](spark, tables).collect())
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet'")
    assert got == sorted(str(r) for r in duck.sql(stream_queries.ORACLES[name]).fetchall())


def test_state_lasts_over_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, 1, 2.0 + i), (10 + i, 2, 1.0)], "event_id long, user_id long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"))
    events.drain(events.running_totals(stream), str(tmp_path / "out"), str(tmp_path / "state"), mode="update")
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("user_id").agg(F.max("n").alias("n"), F.max("total").alias("total"), F.max("high").alias("high"))
    assert {r["user_id"]: (r["n"], r["total"], r["high"]) for r in last.collect()} == {1: (3, 9.0, 4.0), 2: (3, 3.0, 1.0)}

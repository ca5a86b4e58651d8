"""Checks of incoming data, of signals and of live performance, each one aggregation or one ordered window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.functions.expr import div
from stratapanel.operators.research import psi, safe_corr

REQUIRED = ("ticker", "date", "close")
PRICES = ("close", "open", "high", "low", "volume")


def integrity(df: DataFrame) -> DataFrame:
    """(issue, n_rows) of a price table; no row if all is well. Missing columns are found when the plan is built."""
    spark = df.sparkSession
    missing = [f"missing column {c}" for c in (*REQUIRED, "volume") if c not in df.columns]
    if missing:
        return spark.createDataFrame([(m, 0) for m in missing], "issue string, n_rows long")
    checks = {"no rows": F.when(F.count(F.lit(1)) == 0, 1).otherwise(0), "null close": F.count_if(F.col("close").isNull())} | {f"negative {c}": F.count_if(F.col(c) < 0) for c in PRICES if c in df.columns}
    one = df.agg(*(x.cast("long").alias(k) for k, x in checks.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("issue"), F.col(f"`{k}`").alias("n_rows")) for k in checks)))
    return one.select(rows.alias("x")).select("x.*").where("n_rows > 0")


def feature_drift(reference: DataFrame, current: DataFrame, columns: list[str], limit: float = 0.25) -> DataFrame:
    """(feature, psi, drifted) of each column, by quantiles of the reference."""
    each = [psi(reference, current, c, eps=1e-5).select(F.lit(c).alias("feature"), "psi") for c in columns]
    return reduce(DataFrame.union, each).withColumn("drifted", F.col("psi") > limit)


def incoming(df: DataFrame, reference: DataFrame | None = None, columns: list[str] | None = None) -> tuple[str, list[str]]:
    """Status (PASS, WARNING or FAIL) and issues, at most one a check and column."""
    broken = [r["issue"] for r in integrity(df).collect()]
    if broken:
        return "FAIL", broken
    if reference is not None and columns:
        moved = [f"drift in {r['feature']}: {r['psi']:.2f}" for r in feature_drift(reference, df, columns).where("drifted").collect()]
        if moved:
            return "WARNING", moved
    return "PASS", []


def signal_health(latest: DataFrame, before: DataFrame, past: DataFrame, score: str = "prediction", psi_limit: float = 0.15, least_std: float = 0.005, least_tickers: int = 100, least_corr: float = 0.5) -> DataFrame:
    """One row: psi against the past, spread, tickers, correlation with the day before, and a flag for each limit."""
    drift = psi(past, latest, score)
    spread = latest.agg(F.stddev_samp(score).alias("std"), F.count_distinct("ticker").alias("n_tickers"))
    both = latest.select("ticker", F.col(score).alias("a")).join(before.select("ticker", F.col(score).alias("b")), "ticker").agg(safe_corr("a", "b").alias("stability"))
    row = drift.crossJoin(spread).crossJoin(both)
    return row.withColumns({"drifted": F.col("psi") > psi_limit, "collapsed": F.coalesce(F.col("std") < least_std, F.lit(True)), "shrunk": F.col("n_tickers") < least_tickers, "unstable": F.coalesce(F.col("stability") < least_corr, F.lit(False))})


def performance_status(daily: DataFrame, window: int = 60, history: int = 252, ic: tuple[float, float] = (0.02, 0.01), dd: tuple[float, float] = (0.1, 0.15), rate: float = 0.04) -> DataFrame:
    """A row a day of (date, ic, portfolio_return, benchmark_return): rolling figures over the kept history, and a status.

    Days are one ordered series, so this is one window of a row a day.
    """
    order = Window.orderBy("date")
    recent, kept = order.rowsBetween(1 - window, 0), order.rowsBetween(1 - history, 0)
    rows = daily.withColumn("g", F.ln(1 + F.col("portfolio_return"))).withColumn("level", F.sum("g").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({
        "ic_rolling": F.avg("ic").over(recent), "ex": F.avg("portfolio_return").over(recent) - rate / 252, "sd": F.stddev_samp("portfolio_return").over(recent), "mb": F.avg("benchmark_return").over(recent) - rate / 252,
        "cov": F.covar_pop("portfolio_return", "benchmark_return").over(recent), "var": F.var_pop("benchmark_return").over(recent), "high": F.max("level").over(kept), "active": F.avg(F.col("portfolio_return") - F.col("benchmark_return")).over(recent) * 252,
    })
    beta = F.coalesce(div("cov", F.when(F.col("var") > 1e-16, F.col("var"))), F.lit(0.0))
    fall = 1 - F.exp(F.col("level") - F.col("high"))
    status = F.when((F.col("ic_rolling") < ic[1]) | (fall > dd[1]), "CRITICAL").when((F.col("ic_rolling") < ic[0]) | (fall > dd[0]), "WARNING").otherwise("HEALTHY")
    return rows.select("date", "ic_rolling", F.coalesce(div("ex", F.when(F.col("sd") > 1e-9, F.col("sd"))) * 252**0.5, F.lit(0.0)).alias("sharpe"), beta.alias("beta"), ((F.col("ex") - beta * F.col("mb")) * 252).alias("alpha"), F.col("active").alias("active_return"), fall.alias("drawdown"), status.alias("status"))

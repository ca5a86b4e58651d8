"""Panel features outside the registry: the market's own series, and announcement series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.functions.expr import by_ticker, diff, div, lag, mean


def market_features(panel: DataFrame) -> DataFrame:
    """Adds the day's market momentum (5 and 21 days), spread of returns, and whether the mean close is above its trend.

    The market series has a row a day, so one small window and a broadcast join bring it to all tickers.
    """
    daily = panel.withColumn("__r", div("close", lag("close")) - 1).groupBy("date").agg(F.avg("__r").alias("r"), F.stddev_samp("__r").alias("macro_vix_proxy"), F.avg("close").alias("m"))
    order = Window.orderBy("date")
    full = lambda x, n, least: F.when(F.count(x).over(order.rowsBetween(1 - n, 0)) >= least, F.avg(x).over(order.rowsBetween(1 - n, 0)))
    daily = daily.select("date", full("r", 5, 5).alias("macro_mom_5d"), full("r", 21, 21).alias("macro_mom_21d"), "macro_vix_proxy", F.coalesce(F.col("m") > full("m", 200, 100), F.lit(False)).cast("int").alias("macro_trend_200d"))
    return panel.join(daily, "date", "left")


def announcement_features(events: DataFrame) -> DataFrame:
    """(ticker, date, latest surprise, its mean over 3, momentum against the 3 before, beat streak, estimate revision).

    Rows (ticker, date, eps_actual, eps_estimate, surprise_pct); those without reported earnings are left out. A missing
    surprise ends a streak.
    """
    rows = events.where("eps_actual is not null").withColumn("beat", F.coalesce(F.col("surprise_pct") > 0, F.lit(False)))
    rows = rows.withColumn("before", lag("surprise_pct", 3)).withColumn("run", F.sum((~F.col("beat")).cast("int")).over(by_ticker()))
    streak = F.sum(F.col("beat").cast("int")).over(by_ticker().partitionBy("ticker", "run").orderBy("date"))
    revision = div(diff("eps_estimate"), F.abs(lag("eps_estimate"))) * 100
    recent = mean("surprise_pct", 3, 1)
    return rows.select("ticker", "date", F.col("surprise_pct").alias("earnings_latest_surprise"), recent.alias("earnings_3q_avg_surprise"), (recent - mean("before", 3, 1)).alias("earnings_surprise_momentum"), streak.alias("earnings_beat_streak"), revision.alias("earnings_estimate_revision"))


def volatility_scaled(weights: DataFrame, vol: str, target: float = 0.15, most: float = 3.0) -> DataFrame:
    """Weights scaled to a target volatility of the day, at most ``most`` times, then to a gross of 1 at most."""
    day = Window.partitionBy("date")
    scaled = weights.withColumn("weight", F.col("weight") * F.least(F.coalesce(div(F.lit(target), vol), F.lit(1.0)), F.lit(most)))
    gross = F.sum(F.abs("weight")).over(day)
    return scaled.withColumn("weight", F.when(gross > 1, div("weight", gross)).otherwise(F.col("weight")))

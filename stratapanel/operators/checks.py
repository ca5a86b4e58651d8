"""Flags of a weight table, readiness of tables and picks of columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from stratapanel.functions.expr import div
from stratapanel.operators.quantiles import quantiles
from stratapanel.sources.shared import shared_table


def factor_columns(df: DataFrame, meta: Sequence[str] = ("date", "ticker", "sector", "industry", "open", "high", "low", "close", "volume")) -> list[str]:
    """Numeric columns that are neither of the panel itself nor private (a leading underscore)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in meta and not f.name.startswith("_")]


def forward_return_columns(df: DataFrame) -> list[str]:
    """Columns that hold returns of the days ahead, by name."""
    return [c for c in df.columns if re.search(r"(?i)(?:^|_)(?:fwd|forward|pnl|raw)_ret", c)]


def weight_flags(weights: DataFrame, sector_cap: float = 0.3, turnover_cap: float = 0.2, tolerance: float = 1e-6) -> DataFrame:
    """(date, dollar_neutral, fully_invested, long_only, sectors_within, turnover, turnover_within) of weights (date, ticker, sector, weight).

    Turnover is the sum of absolute changes against the day before that has weights; a name without a row weighs 0. The
    first day has no turnover.
    """
    days = weights.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))
    moved = weights.select("date", "ticker", "weight").unionByName(weights.join(days, "date").where("next is not null").select(F.col("next").alias("date"), "ticker", (-F.col("weight")).alias("weight")))
    change = moved.groupBy("date", "ticker").agg(F.sum("weight").alias("d")).groupBy("date").agg(F.sum(F.abs("d")).alias("turnover"))
    first = days.agg(F.min("date").alias("first"))
    sectors = weights.groupBy("date", "sector").agg(F.sum("weight").alias("s")).groupBy("date").agg(F.max(F.abs("s")).alias("most"))
    sums = weights.groupBy("date").agg(F.sum("weight").alias("total"), F.min("weight").alias("least"))
    rows = sums.join(sectors, "date").join(change, "date").crossJoin(F.broadcast(first)).withColumn("turnover", F.when(F.col("date") != F.col("first"), F.col("turnover")))
    return rows.select(
        "date", (F.abs("total") <= tolerance).alias("dollar_neutral"), (F.abs(F.col("total") - 1) <= tolerance).alias("fully_invested"), (F.col("least") >= -tolerance).alias("long_only"), (F.col("most") <= sector_cap + tolerance).alias("sectors_within"),
        "turnover", (F.col("turnover").isNull() | (F.col("turnover") <= turnover_cap + tolerance)).alias("turnover_within"),
    )


def readiness(prices: DataFrame, fundamentals: DataFrame, least: float = 0.9) -> DataFrame:
    """One row: names of both tables and of each alone, first and last day of prices, share of rows with a close, and whether all is well."""
    a, b = prices.select("ticker").distinct(), fundamentals.select("ticker").distinct()
    both = a.withColumn("p", F.lit(1)).join(b.withColumn("f", F.lit(1)), "ticker", "outer").agg(F.count("p").alias("n_prices"), F.count("f").alias("n_fundamentals"), F.count_if(F.col("f").isNull()).alias("only_prices"), F.count_if(F.col("p").isNull()).alias("only_fundamentals"))
    days = prices.agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), div(F.count("close").cast("double"), F.count(F.lit(1))).alias("coverage"))
    share = div((F.col("n_prices") - F.col("only_prices")).cast("double"), "n_prices")
    return both.crossJoin(days).withColumn("go", F.coalesce((share >= least) & (F.col("coverage") >= least), F.lit(False)))


def currency(value: Column) -> Column:
    """$1.5K, $2.00M and $3.00B; smaller amounts with two decimals, a minus before the sign."""
    size = F.abs(value)
    text = (
        F.when(size >= 1e9, F.concat(F.format_number(size / 1e9, 2), F.lit("B"))).when(size >= 1e6, F.concat(F.format_number(size / 1e6, 2), F.lit("M")))
        .when(size >= 1e3, F.concat(F.format_number(size / 1e3, 1), F.lit("K"))).otherwise(F.format_number(size, 2))
    )
    return F.when(value.isNotNull(), F.concat(F.when(value < 0, "-$").otherwise("$"), text))


def damped_target(df: DataFrame, x: str = "raw_ret_5d", n: int = 63, least: int = 21) -> DataFrame:
    """``target``: the return less its sector's mean of the day, over 1 + its trailing deviation; a missing deviation is the median of all."""
    trailing = Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - n, 0)
    spread = F.when(F.count(x).over(trailing) >= least, F.stddev_samp(x).over(trailing))
    rows = shared_table(df.withColumn("__s", spread), "damped-target")
    middle = F.lit(quantiles(rows, "__s", [0.5])[0]).cast("double")
    rows = rows.withColumn("__m", F.avg(x).over(Window.partitionBy("date", "sector")))
    return rows.withColumn("target", (F.col(x) - F.col("__m")) * div(F.lit(1.0), 1 + F.coalesce(F.col("__s"), middle))).drop("__s", "__m")


def sector_composite(df: DataFrame, n: int = 20, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``composite``: close over its trailing mean per trailing deviation of returns, held between quantiles of all rows, as a z-score within a day's sector."""
    frame = Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - n, 0)
    rows = df.withColumn("__r", div("close", F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))) - 1)
    full = lambda x, f: F.when(F.count(x).over(frame) >= n, f(x).over(frame))
    rows = rows.withColumn("__c", div(div("close", full("close", F.avg)) - 1, full("__r", F.stddev_samp)))
    rows = shared_table(rows.drop("__r"), "sector-composite")
    lowest, highest = (F.lit(q).cast("double") for q in quantiles(rows, "__c", [low, high]))
    rows = rows.withColumn("__c", F.when(F.col("__c").isNotNull(), F.least(F.greatest(F.col("__c"), lowest), highest)))
    group = Window.partitionBy("date", "sector")
    return rows.withColumn("composite", div(F.col("__c") - F.avg("__c").over(group), F.stddev_samp("__c").over(group))).drop("__c")


def macro_for_earnings(macro: DataFrame, n: int = 63) -> DataFrame:
    """(date, index_return, mean_vix, mean_yield): trailing sums and means by day. Macro has a row a day, so one ordered window holds it."""
    order = Window.orderBy("date")
    frame = order.rowsBetween(1 - n, 0)
    rows = macro.withColumn("r", div("sp500_close", F.lag("sp500_close").over(order)) - 1)
    full = lambda x, f: F.when(F.count(x).over(frame) >= n, f(x).over(frame))
    return rows.select("date", full("r", F.sum).alias("index_return"), full("vix_close", F.avg).alias("mean_vix"), full("us_10y_close", F.avg).alias("mean_yield"))


def table_hash(df: DataFrame) -> DataFrame:
    """One row (n, digest) that changes with any row of a table, whatever their order; a key for cached results."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("digest"))


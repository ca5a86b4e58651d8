"""Readers of the stored tables and the panel that the queries run on.

A bar is a supplier's day of line items: first, highest, lowest and last price, and the quantity sold. Orders by day
give five market series, quarters of line items give statements and earnings that count 90 days after quarter end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.operators.asof import asof_join

REPORTING_LAG_DAYS = 90


def read(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, open, high, low, close, volume); prices of 0 or less are left out.

    Line items are dealt by ticker, as windows over bars need it, so bars cost the only shuffle up to the first rank of a day.
    """
    items = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"])
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return (
        items.where("l_extendedprice > 0")
        .withColumns({"ticker": F.col("l_suppkey"), "date": F.to_date("l_shipdate")}).repartition("ticker")
        .groupBy("ticker", "date")
        .agg(F.min_by("l_extendedprice", order).alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.max_by("l_extendedprice", order).alias("close"), F.sum("l_quantity").alias("volume"))
    )


def bar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date): the days that have a bar, from the line items themselves: only days are shuffled."""
    return read(spark, sf_dir, "lineitem", ["l_shipdate", "l_extendedprice"]).where("l_extendedprice > 0").select(F.to_date("l_shipdate").alias("date")).distinct()


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, sector, industry): a supplier's region and nation."""
    supplier, nation, region = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
        .select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"))
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, sp500_close, vix_close, us_10y_close, oil_close, usd_close) by order date."""
    orders = read(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice", "o_orderdate"])
    return orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (F.max("o_totalprice") / 100).alias("sp500_close"),
        (F.lit(10.0) + F.pmod(F.sum("o_orderkey"), F.lit(3000)) / 100).alias("vix_close"),
        (F.lit(0.5) + F.pmod(F.max("o_orderkey"), F.lit(500)) / 100).alias("us_10y_close"),
        (F.lit(20.0) + F.min("o_totalprice") / 1000).alias("oil_close"),
        (F.lit(80.0) + F.count(F.lit(1))).cast("double").alias("usd_close"),
    )


#: Statement fields as sums over a quarter's line items; q, k, p and n are quantity, order, part and line numbers.
STATEMENT_FIELDS = {
    "total_revenue": "100.0 * q", "fcf": "q * 1.0 - 100", "ocf": "q * 1.0 + k % 50", "market_cap": "1000.0 * c + 10000", "total_debt": "10.0 * (n % 40)", "total_cash": "5.0 * (p % 60)",
    "ebitda": "(k % 90) * 1.0 - 10", "pe_ratio": "(p % 400) / 10.0", "forward_pe": "1 + (k % 300) / 10.0", "eps": "(p % 200) / 10.0 - 5.03", "fwd_eps": "(k % 200) / 10.0 - 4", "pb_ratio": "0.5 + (n % 70) / 10.0",
    "ps_ratio": "0.5 + (k % 80) / 10.0", "ev_ebitda": "2 + (p % 90) / 10.0", "roe": "(p % 90) / 100.0 - 0.3", "roa": "(k % 40) / 100.0 - 0.1", "gross_margin": "(n % 80) / 100.0", "op_margin": "(p % 60) / 100.0",
    "ebitda_margin": "(k % 70) / 100.0", "profit_margin": "(p % 50) / 100.0 - 0.1", "debt_to_equity": "(n % 35) / 10.0", "current_ratio": "(k % 45) / 10.0", "quick_ratio": "(p % 35) / 10.0", "beta": "(n % 25) / 10.0",
    "earnings_growth": "(k % 120) / 100.0 - 0.405", "rev_growth": "(p % 110) / 100.0 - 0.3", "dividend": "CASE WHEN k % 3 = 0 THEN NULL ELSE (k % 60) / 1000.0 END", "buyback": "0.0 - (p % 30)", "dividends_paid": "0.0 - (n % 20)",
    "eps_actual": "(p % 1000) / 100.0 - 4", "eps_estimate": "(k % 1000) / 100.0 - 4", "surprise_pct": "CASE WHEN n % 2 = 0 THEN NULL ELSE (p % 300) / 10.0 - 15 END",
}


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, fields...): a quarter's statement on the day it counts from."""
    items = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity", "l_orderkey", "l_partkey", "l_linenumber"])
    quarter = F.trunc(F.to_date("l_shipdate"), "quarter")
    sums = items.groupBy(F.col("l_suppkey").alias("ticker"), quarter.alias("quarter")).agg(
        F.sum("l_quantity").alias("q"), F.sum("l_orderkey").cast("double").alias("k"), F.sum("l_partkey").cast("double").alias("p"), F.sum("l_linenumber").cast("double").alias("n"), F.count(F.lit(1)).cast("double").alias("c")
    )
    counts_from = F.date_add(F.date_add(F.add_months("quarter", 3), -1), REPORTING_LAG_DAYS)
    return sums.select("ticker", counts_from.alias("date"), *(F.expr(f"cast({x} as double)").alias(k) for k, x in STATEMENT_FIELDS.items()))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with sector, market series of the day and the latest statement that counts.

    The market series are a row a calendar day, however many orders there are, so they are broadcast.
    """
    priced = bars(spark, sf_dir).join(sectors(spark, sf_dir), "ticker", "left").join(F.broadcast(macro(spark, sf_dir)), "date", "left")
    return asof_join(priced, statements(spark, sf_dir), "ticker", "date", list(STATEMENT_FIELDS))

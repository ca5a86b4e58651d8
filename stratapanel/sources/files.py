"""Landing-zone readers and writers: delimited files with fixed schemas, statements with dates as columns, tables by version."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from stratapanel.operators.shaping import upsert

PRICES = "date date, open double, high double, low double, close double, volume double"
EARNINGS = "date timestamp, eps_estimate double, eps_actual double, surprise_pct double"


def _ticker():
    """The file's stem, as upper-case ticker."""
    return F.upper(F.regexp_replace(F.col("_metadata.file_name"), r"\.[A-Za-z]+$", ""))


def read_prices(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, date, open, high, low, close, volume) of one file a ticker; rows without any price or with close <= 0 go."""
    rows = spark.read.schema(PRICES).option("header", True).option("enforceSchema", True).csv(folder)
    rows = rows.select(_ticker().alias("ticker"), "*").dropna(how="all", subset=["open", "high", "low", "close"])
    return rows.where("close > 0 and date is not null")


def read_earnings(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, date, eps_estimate, eps_actual, surprise_pct); times lose their zone and become days."""
    return spark.read.schema(EARNINGS).option("header", True).csv(folder).select(_ticker().alias("ticker"), F.to_date("date").alias("date"), "eps_estimate", "eps_actual", "surprise_pct").where("date is not null")


def read_macro(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(date, <name>_close, <name>_volume) of one series."""
    rows = spark.read.schema("date date, close double, volume double").option("header", True).csv(path)
    return rows.select("date", F.col("close").alias(f"{name}_close"), F.col("volume").alias(f"{name}_volume"))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """(ticker): one a line, blanks dropped, upper case."""
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("ticker")).where("ticker <> ''").distinct()


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """(date, ticker) of a file (date, tickers) whose tickers are comma-separated and may carry a suffix after a dash."""
    rows = spark.read.schema("date date, tickers string").option("header", True).csv(path)
    each = rows.select("date", F.explode(F.split("tickers", ",")).alias("t")).select("date", F.trim(F.split_part("t", F.lit("-"), F.lit(1))).alias("ticker"))
    return each.where("date is not null and ticker <> ''").distinct()


def read_statement(spark: SparkSession, path: str) -> DataFrame:
    """(item, fiscal_date, value) of a file whose first column is the line item and whose other columns are dates."""
    raw = spark.read.option("header", True).csv(path)
    item, *dates = raw.columns
    long = raw.unpivot([item], [F.col(f"`{d}`") for d in dates], "fiscal_date", "value") if dates else raw.select(item).withColumn("fiscal_date", F.lit(None)).withColumn("value", F.lit(None))
    return long.select(F.col(f"`{item}`").alias("item"), F.try_to_date("fiscal_date").alias("fiscal_date"), F.expr("try_cast(value as double)").alias("value")).where("fiscal_date is not null")


def load_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str | None = None) -> DataFrame:
    """A table's columns; a missing path is an empty table if ``schema`` is given."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        if schema is None:
            raise
        df = spark.createDataFrame([], schema)
    return df.select(*columns) if columns else df


def save_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def save_report(df: DataFrame, path: str) -> None:
    """A small result as one delimited file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def upsert_table(spark: SparkSession, name: str, new: DataFrame, keys: Sequence[str]) -> None:
    """Adds rows to a saved table; on equal keys the new row stays. The result is written beside the table, then takes its name."""
    if not spark.catalog.tableExists(name):
        new.write.saveAsTable(name)
        return
    upsert(spark.table(name), new, keys).write.mode("overwrite").saveAsTable(f"{name}__next")
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {name}__next RENAME TO {name}")


def adjusted_history(old: DataFrame, new: DataFrame, limit: float = 0.01) -> DataFrame:
    """(ticker, rebuild): whether closes of the days that both have differ by more than a share of their mean."""
    both = old.select("ticker", "date", F.col("close").alias("a")).join(new.select("ticker", "date", F.col("close").alias("b")), ["ticker", "date"])
    gap = F.try_divide(F.max(F.abs(F.col("a") - F.col("b"))), F.avg("a"))
    return both.groupBy("ticker").agg((gap > limit).alias("rebuild"))


def manifest(df: DataFrame, version: str) -> str:
    """Schema and row count of a saved version, as JSON."""
    return json.dumps({"version": version, "rows": df.count(), "schema": json.loads(df.schema.json())}, sort_keys=True)

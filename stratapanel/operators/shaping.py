"""Filters, de-duplication, folds and reshaping of panels."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.functions.expr import by_ticker, median


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in a total order; unlike dropDuplicates it is the same on every run."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", place).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Rows of both; on equal keys the new row stays. ``tie`` orders repeated rows of one side."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return keep_one(both, keys, [F.desc("__new"), *tie]).drop("__new")


def liquid(df: DataFrame, least: float = 1e6, n: int = 21) -> DataFrame:
    """Rows whose trailing median volume times median price reaches a limit."""
    return df.withColumn("__v", median("volume", n, 1) * median("close", n, 1)).where(F.col("__v") >= least).drop("__v")


def without_empty_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drops columns that hold no value; one aggregation decides for all."""
    counts = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    return df.drop(*(c for c in columns if not counts[c]))


def low_variance(df: DataFrame, columns: Sequence[str], least: float = 1e-8) -> list[str]:
    """Columns whose deviation is below a limit, by one aggregation."""
    sd = df.agg(*(F.stddev_samp(c).alias(c) for c in columns)).first()
    return [c for c in columns if sd[c] is None or sd[c] < least]


def stratified_sample(df: DataFrame, per_year: int, key: Sequence[str], least: int = 60) -> DataFrame:
    """Up to ``per_year`` rows of each year that has ``least``, by a hash of the key: the same rows on every run."""
    year = F.year("date")
    rows = df.withColumn("__y", year).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("__y")))
    place = F.row_number().over(Window.partitionBy("__y").orderBy(F.xxhash64(*key), *key))
    return rows.where(F.col("__n") >= least).withColumn("__p", place).where(F.col("__p") <= per_year).drop("__y", "__n", "__p")


def walk_forward(days: Sequence[date], first: int, step: int, embargo: int = 21, window: int | None = None) -> list[tuple[date, date, date, date]]:
    """(train start, train end, test start, test end) over sorted distinct days; expanding, or of ``window`` days."""
    out, at = [], first
    while at + embargo < len(days):
        test = at + embargo
        start = 0 if window is None else max(0, at - window)
        out.append((days[start], days[at - 1], days[test], days[min(test + step, len(days)) - 1]))
        at += step
    return out


def calendar_splits(first: date, last: date, train_months: int, test_months: int, embargo_days: int = 30) -> list[tuple[date, date, date, date]]:
    """(train start, train end, test start, test end) by calendar months, with a gap of days before each test."""
    add = lambda d, m: date(d.year + (d.month - 1 + m) // 12, (d.month - 1 + m) % 12 + 1, 1)
    out, end = [], add(first.replace(day=1), train_months)
    while end + timedelta(embargo_days) < last:
        start = end + timedelta(embargo_days)
        out.append((first, end - timedelta(1), start, min(add(start, test_months) - timedelta(1), last)))
        end = add(end, test_months)
    return out


def episodes(df: DataFrame, flag: str, by: str = "ticker") -> DataFrame:
    """Adds ``run``: a number for each run of equal flags in time order."""
    order = Window.partitionBy(by).orderBy("date")
    turn = F.coalesce((F.col(flag) != F.lag(flag).over(order)).cast("int"), F.lit(1))
    return df.withColumn("__t", turn).withColumn("run", F.sum("__t").over(order)).drop("__t")


def forward_return(n: int, column: str = "open", delay: int = 1):
    """Return of the n rows after a delay, from the price at that row; a price of 0 gives NULL; held to +-50 %."""
    from stratapanel.functions.expr import clip, div

    return clip(div(F.lead(column, n + delay).over(by_ticker()), F.lead(column, delay).over(by_ticker())) - 1, -0.5, 0.5)

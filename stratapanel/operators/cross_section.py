"""Operations on the cross-section of a day, or of a day's sector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.functions.expr import by_day, div, pct_rank


def by_sector():
    return Window.partitionBy("date", "sector")


def winsorize(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Columns held between their quantiles of the day."""
    cuts = {x: F.percentile(x, F.array(F.lit(low), F.lit(high))).over(by_day()) for x in columns}
    df = df.select("*", *(q.alias(f"__{x}") for x, q in cuts.items()))
    held = {x: F.when(F.col(x) < F.col(f"__{x}")[0], F.col(f"__{x}")[0]).when(F.col(x) > F.col(f"__{x}")[1], F.col(f"__{x}")[1]).otherwise(F.col(x)) for x in columns}
    return df.withColumns(held).drop(*(f"__{x}" for x in columns))


def zscore_day(df: DataFrame, columns: list[str]) -> DataFrame:
    """Z-scores of the day; 0 where a day has fewer than 3 values or no spread."""
    def score(x: str) -> Column:
        spread = F.stddev_samp(x).over(by_day())
        enough = (F.count(x).over(by_day()) >= 3) & (spread > 1e-9)
        return F.when(enough, F.coalesce(div(F.col(x) - F.avg(x).over(by_day()), spread), F.lit(0.0))).otherwise(0.0)

    return df.withColumns({x: score(x) for x in columns})


def sector_neutral(df: DataFrame, columns: list[str]) -> DataFrame:
    """Z-scores within a day's sector; a missing or zero spread counts as 1e-8."""
    by = by_sector()

    def score(x: str) -> Column:
        spread = F.coalesce(F.nullif(F.stddev_samp(x).over(by), F.lit(0.0)), F.lit(1e-8))
        return div(F.col(x) - F.avg(x).over(by), spread + 1e-8)

    return df.withColumns({x: score(x) for x in columns})


def rank_day(df: DataFrame, columns: list[str], missing: float | None = 0.5) -> DataFrame:
    """Average-tie percentile ranks of the day; ``missing`` stands for NULL."""
    ranks = {x: pct_rank(x) for x in columns}
    return df.withColumns({x: r if missing is None else F.coalesce(r, F.lit(missing)) for x, r in ranks.items()})


def quantile_bucket(x: str, n: int) -> Column:
    """1-based bucket of a value among the day's quantile edges, right-closed; equal edges count once."""
    edges = F.array_distinct(F.percentile(x, F.array(*(F.lit(i / n) for i in range(n + 1)))).over(by_day()))
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(F.col(x).isNotNull() & (F.size(edges) > 1), F.lit(1) + F.size(F.filter(inner, lambda e: e < F.col(x))))


def top_n(df: DataFrame, score: str, n: int) -> DataFrame:
    """The day's n highest scores; ties by ticker."""
    place = F.row_number().over(by_day().orderBy(F.col(score).desc(), F.col("ticker")))
    return df.where(F.col(score).isNotNull()).withColumn("place", place).where(F.col("place") <= n)


def date_scaler(train: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(date, bounds...) fitted by day: a table to keep and to apply to later days as of their date."""
    return train.groupBy("date").agg(*(F.percentile(x, F.array(F.lit(low), F.lit(high))).alias(f"{x}_bounds") for x in columns))


def apply_date_scaler(df: DataFrame, bounds: DataFrame, columns: list[str]) -> DataFrame:
    """Columns held within the bounds of the latest fitted day; days before the first take the first's.

    The fitted table and the distinct days have a row a day, which bounds what is broadcast.
    """
    from stratapanel.operators.asof import asof_join

    names = [f"{x}_bounds" for x in columns]
    days = asof_join(df.select("date").distinct().withColumn("all", F.lit(1)), bounds.withColumn("all", F.lit(1)), "all", "date", names).drop("all")
    first = bounds.agg(*(F.min_by(n, "date").alias(f"__{n}") for n in names))
    days = days.crossJoin(F.broadcast(first)).select("date", *(F.coalesce(n, f"__{n}").alias(n) for n in names))
    joined = df.join(days, "date", "left")
    held = {x: F.when(F.col(x) < F.col(f"{x}_bounds")[0], F.col(f"{x}_bounds")[0]).when(F.col(x) > F.col(f"{x}_bounds")[1], F.col(f"{x}_bounds")[1]).otherwise(F.col(x)) for x in columns}
    return joined.withColumns(held).drop(*names)


def sector_residual_target(df: DataFrame, x: str = "raw_ret_5d") -> DataFrame:
    """``target``: the return less its sector's mean of the day, halved once the sector's spread exceeds the running maximum of the days' 95 % quantiles."""
    spread = F.stddev_samp(x).over(by_sector())
    df = df.withColumn("sector_mean", F.coalesce(F.avg(x).over(by_sector()), F.lit(0.0))).withColumn("sector_std", spread)
    sectors = df.select("date", "sector", "sector_std").distinct()
    daily = sectors.groupBy("date").agg(F.percentile("sector_std", 0.95).alias("q"))
    running = daily.select("date", F.max("q").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("cap"))
    df = df.join(running, "date", "left")
    residual = F.col(x) - F.col("sector_mean")
    return df.withColumn("target", F.when(F.col("sector_std") > F.col("cap"), residual * 0.5).otherwise(residual))


def blend(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``raw_alpha``: weighted mean of the models' ranks of the day."""
    ranked = df.withColumns({f"rank_{m}": F.coalesce(pct_rank(m), F.lit(0.0)) for m in weights})
    total = sum(weights.values())
    return ranked.withColumn("raw_alpha", sum((F.col(f"rank_{m}") * w for m, w in weights.items()), F.lit(0.0)) / total)




def winsorize_count(df: DataFrame, x: str, low: float = 0.01, high: float = 0.01, by: str = "date") -> DataFrame:
    """Of a group's n values the ``floor(low * n)`` smallest take the next one's value, and alike at the top."""
    group = Window.partitionBy(by)
    n = F.count(x).over(group)
    place = F.row_number().over(group.orderBy(F.col(x).asc_nulls_last(), "ticker"))
    rows = df.withColumns({"__n": n, "__i": place})
    bottom, top = F.floor(F.lit(low) * F.col("__n")), F.floor(F.lit(high) * F.col("__n"))
    floor = F.min(F.when(F.col("__i") > bottom, F.col(x))).over(group)
    ceiling = F.max(F.when(F.col("__i") <= F.col("__n") - top, F.col(x))).over(group)
    return rows.withColumn(x, F.when(F.col(x).isNotNull(), F.least(F.greatest(x, floor), ceiling))).drop("__n", "__i")


def standardize(df: DataFrame, x: str, by: str = "date", eps: float = 1e-8) -> DataFrame:
    """(x - mean) / (deviation + eps) of a group."""
    group = Window.partitionBy(by)
    return df.withColumn(x, div(F.col(x) - F.avg(x).over(group), F.stddev_samp(x).over(group) + eps))

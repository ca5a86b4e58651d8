"""Factor research, drift and performance figures as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.functions.expr import by_ticker, div, mean_rank, pct_rank, std
from stratapanel.operators.execution import draw
from stratapanel.operators.cross_section import quantile_bucket
from stratapanel.operators.rolling import Trailing, add_trailing


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation of a group's rows that have both; NULL where either is constant."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return div(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def unpivoted(df: DataFrame, factors: list[str], keep: list[str]) -> DataFrame:
    """(keep..., factor, value): one row a factor."""
    return df.select(*keep, F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("value")) for f in factors))).alias("x")).select(*keep, "x.factor", "x.value")


def rank_ic(df: DataFrame, factors: list[str], target: str, least: int = 5) -> DataFrame:
    """(factor, date, ic, n): the day's rank correlation of each factor with the target, over rows that have both."""
    long = unpivoted(df.select("date", *factors, F.col(target).alias("target")), factors, ["date", "target"]).where("value is not null and target is not null")
    ranked = long.select("factor", "date", mean_rank("value", ("factor", "date")).alias("a"), mean_rank("target", ("factor", "date")).alias("b"))
    daily = ranked.groupBy("factor", "date").agg(safe_corr("a", "b").alias("ic"), F.count(F.lit(1)).alias("n"))
    return daily.withColumn("ic", F.when(F.col("n") >= least, F.col("ic")))


def ic_summary(daily: DataFrame) -> DataFrame:
    """Mean, deviation, information ratio, t-value and hit ratio of daily coefficients by factor."""
    known = daily.where("ic is not null")
    out = known.groupBy("factor").agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.count(F.lit(1)).alias("n_dates"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_ratio"))
    out = out.withColumn("icir", div("ic_mean", "ic_std"))
    return out.withColumn("t_stat", F.col("icir") * F.sqrt(F.col("n_dates").cast("double")))


def ic_decay(df: DataFrame, factor: str, target: str, lags: list[int]) -> DataFrame:
    """(lag, ic): mean daily rank correlation with the target so many rows later."""
    shifted = df.select("date", "ticker", factor, *(F.lead(target, k).over(by_ticker()).alias(f"t{k}") for k in lags))
    per_lag = [rank_ic(shifted, [factor], f"t{k}").agg(F.avg("ic").alias("ic")).select(F.lit(k).alias("lag"), "ic") for k in lags]
    return reduce(DataFrame.union, per_lag)


def autocorrelation(df: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, autocorr, n_tickers): lag-1 correlation by ticker, averaged over tickers that vary."""
    long = unpivoted(df, factors, ["date", "ticker"])
    lagged = long.withColumn("before", F.lag("value").over(Window.partitionBy("factor", "ticker").orderBy("date")))
    each = lagged.groupBy("factor", "ticker").agg(safe_corr("value", "before").alias("r"), F.stddev_samp("value").alias("sd")).where("sd >= 1e-8 and r is not null")
    return each.groupBy("factor").agg(F.avg("r").alias("autocorr"), F.count(F.lit(1)).alias("n_tickers"))


def quantile_returns(df: DataFrame, factor: str, target: str, n: int = 5) -> DataFrame:
    """(bucket, mean_return, n_rows) over the day's buckets of a factor."""
    rows = df.where(F.col(factor).isNotNull() & F.col(target).isNotNull()).withColumn("bucket", quantile_bucket(factor, n))
    return rows.where("bucket is not null").groupBy("bucket").agg(F.avg(target).alias("mean_return"), F.count(F.lit(1)).alias("n_rows"))


def factor_correlation(df: DataFrame, factors: list[str], least: int = 5) -> DataFrame:
    """(a, b, rho): rank correlation of each factor pair by day, averaged over days.

    One aggregation a day with a column a pair; the pairs of a factor list are known when the plan is built.
    """
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    rows = df.where(reduce(lambda x, y: x & y, (F.col(f).isNotNull() for f in factors)))
    ranked = rows.select("date", *(pct_rank(f).alias(f) for f in factors))
    daily = ranked.groupBy("date").agg(F.count(F.lit(1)).alias("n"), *(safe_corr(a, b).alias(f"{a}|{b}") for a, b in pairs)).where(F.col("n") >= least)
    long = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs)))
    return daily.select(long.alias("x")).groupBy("x.a", "x.b").agg(F.avg("x.r").alias("rho"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(factor, coverage, zero_share, n_null): one pass over all columns."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(x).alias(f"k_{x}") for x in columns), *(F.count_if(F.col(x) == 0).alias(f"z_{x}") for x in columns))
    rows = F.explode(F.array(*(F.struct(F.lit(x).alias("factor"), F.col(f"k_{x}").alias("k"), F.col(f"z_{x}").alias("z")) for x in columns)))
    return one.select("n", rows.alias("x")).select("x.factor", div("x.k", "n").alias("coverage"), div("x.z", "n").alias("zero_share"), (F.col("n") - F.col("x.k")).alias("n_null"))


def psi(expected: DataFrame, actual: DataFrame, x: str, buckets: int = 10, kind: str = "quantiles", eps: float = 1e-4) -> DataFrame:
    """(psi): population stability index of ``actual`` against ``expected``.

    Edges come from the reference's quantiles or from its range in equal steps, and travel as a one-row table.
    """
    a, b = expected.where(F.col(x).isNotNull()), actual.where(F.col(x).isNotNull())
    if kind == "quantiles":
        edges = a.agg(F.array_distinct(F.percentile(x, F.array(*(F.lit(i / buckets) for i in range(buckets + 1))))).alias("edges"))
    else:
        edges = a.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).select(F.transform(F.sequence(F.lit(0), F.lit(buckets)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / buckets).alias("edges"))
    cut = F.size(F.filter(F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0))), lambda e: e <= F.col(x)))
    both = a.select(x, F.lit(1).alias("old")).union(b.select(x, F.lit(0).alias("old"))).crossJoin(F.broadcast(edges))
    counts = both.groupBy(cut.alias("bucket")).agg(F.sum("old").alias("e"), F.sum(1 - F.col("old")).alias("a"))
    every = Window.partitionBy()
    share = lambda v: F.greatest(div(v, F.sum(v).over(every)), F.lit(eps))
    return counts.select(share("e").alias("e"), share("a").alias("a")).agg(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("psi"))


def drift(daily: DataFrame, window: int = 21, z_limit: float = 2.0, mse_factor: float = 1.5) -> DataFrame:
    """Daily (date, pred_mean, mse) with flags: the last window's mean and error against the window before."""
    order = Window.orderBy("date")
    now, old = order.rowsBetween(1 - window, 0), order.rowsBetween(1 - 2 * window, -window)
    rows = daily.withColumns({"now_mean": F.avg("pred_mean").over(now), "old_mean": F.avg("pred_mean").over(old), "old_std": F.stddev_samp("pred_mean").over(old), "now_mse": F.avg("mse").over(now), "old_mse": F.avg("mse").over(old), "n_old": F.count("pred_mean").over(old)})
    ready = F.col("n_old") >= window
    z = F.abs(div(F.col("now_mean") - F.col("old_mean"), F.col("old_std") + 1e-9))
    return rows.where(ready).select("date", z.alias("z"), (z > z_limit).alias("mean_drift"), (F.col("now_mse") > F.col("old_mse") * mse_factor).alias("error_drift"))


def trend_vol_regime(df: DataFrame, trend: int = 200, vol: int = 20, base: int = 252) -> DataFrame:
    """(date, ticker, regime): Bull or Bear by the trend mean, LowVol or HighVol by the median of past volatility."""
    rows = df.withColumn("r", div("close", F.lag("close").over(by_ticker())) - 1)
    rows = rows.withColumn("v", std("r", vol) * (252**0.5))
    rows = add_trailing(rows.select("date", "ticker", "close", "v"), [Trailing("sma", "mean", "close", trend, trend), Trailing("med", "median", "v", base, base)])
    up, loud = F.coalesce(F.col("close") > F.col("sma"), F.lit(False)), F.coalesce(F.col("v") > F.col("med"), F.lit(False))
    name = F.concat(F.when(up, "Bull").otherwise("Bear"), F.lit("_"), F.when(loud, "HighVol").otherwise("LowVol"))
    return rows.select("date", "ticker", name.alias("regime"))


def rolling_beta(df: DataFrame, x: str, market: str, n: int = 60, least: int = 30) -> DataFrame:
    """``df`` with ``beta``: covariance with the market over its variance in a trailing frame, over rows that have both."""
    return add_trailing(df, [Trailing("beta", "beta", x, n, least, market)])


def drawdown(x: str | Column, by=None) -> Column:
    """Fall from the highest value so far, as a negative share."""
    x = F.col(x) if isinstance(x, str) else x
    high = F.max(x).over((by or by_ticker()).rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(div(x - high, high), F.lit(0.0))


def performance(curve: DataFrame, value: str = "total_value", by: str = "ticker", rate: float = 0.035, days: int = 252) -> DataFrame:
    """One row a key of ordered daily values: return, growth a year, volatility, Sharpe, Sortino, drawdown, Calmar, hits."""
    order = Window.partitionBy(by).orderBy("date")
    rows = curve.withColumn("r", div(value, F.lag(value).over(order)) - 1).withColumn("dd", drawdown(value, order))
    excess = F.col("r") - rate / days
    bad = F.when(excess < 0, excess)
    a = rows.groupBy(by).agg(
        F.min_by(value, "date").alias("v0"), F.max_by(value, "date").alias("v1"), F.datediff(F.max("date"), F.min("date")).alias("span"), F.count(F.lit(1)).alias("n_days"), F.stddev_pop("r").alias("sd"),
        F.avg(excess).alias("ex"), F.stddev_pop(bad).alias("bad_sd"), F.count(bad).alias("n_bad"), F.min("dd").alias("dd"), F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))).alias("hit_rate"),
    )
    a = a.where("n_days >= 2").withColumn("total_return", div("v1", "v0") - 1).withColumn("cagr", F.pow(div("v1", "v0"), div(F.lit(1.0), F.greatest(F.col("span") / 365.25, F.lit(1e-6)))) - 1)
    a = a.withColumn("ann_vol", F.col("sd") * days**0.5).withColumn("sharpe", F.when(F.col("sd") > 1e-12, div("ex", "sd") * days**0.5).otherwise(0.0))
    spread = F.col("bad_sd") * days**0.5
    a = a.withColumn("sortino", F.when((F.col("n_bad") > 1) & (spread > 1e-12), div(F.col("ex") * days, spread)).otherwise(0.0)).withColumn("max_drawdown", F.abs("dd"))
    return a.withColumn("calmar", F.when(F.col("max_drawdown") > 1e-12, div("cagr", "max_drawdown")).otherwise(0.0)).select(by, "total_return", "cagr", "ann_vol", "sharpe", "sortino", "max_drawdown", "calmar", "hit_rate", "n_days")


def prefilter(df: DataFrame, factors: list[str], most_missing: float = 0.5, least_std: float = 1e-8) -> DataFrame:
    """(factor, missing, sd, reason): reason is missing, constant or NULL; one pass over all factors."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(f).alias(f"k_{f}") for f in factors), *(F.stddev_samp(f).alias(f"s_{f}") for f in factors))
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f"k_{f}").alias("k"), F.col(f"s_{f}").alias("sd")) for f in factors)))
    out = one.select("n", rows.alias("x")).select("x.factor", (1 - div("x.k", "n")).alias("missing"), "x.sd")
    return out.withColumn("reason", F.when(F.col("missing") > most_missing, "missing").when(F.col("sd").isNull() | (F.col("sd") < least_std), "constant"))


def lookahead(df: DataFrame, target: str, limit: float = 0.3, least: int = 100) -> DataFrame:
    """(rho, n, leaks): a target that moves with the same day's open-to-close return looks ahead."""
    one = df.select((div("close", "open") - 1).alias("x"), F.col(target).alias("y")).where("x is not null and y is not null").agg(safe_corr("x", "y").alias("rho"), F.count(F.lit(1)).alias("n"))
    return one.withColumn("leaks", F.coalesce((F.col("n") >= least) & (F.abs("rho") > limit), F.lit(False)))


def ic_significance(df: DataFrame, factors: list[str], target: str, eps: float = 1e-8) -> DataFrame:
    """(factor, ic_mean, ic_std, icir, t_stat, hit_ratio, n_dates, sn_icir) over rows that have the target.

    Means weigh days by their rows; deviations do not. The target is ranked over all rows of the day, a factor over
    those that have it; a coefficient within rounding of 0 is no hit. ``sn_icir`` is the ratio for values standardised within day and sector. Days without spread
    are left out, and factors with fewer than three days.
    """
    long = unpivoted(df.where(F.col(target).isNotNull()).select("date", "sector", *factors, F.col(target).alias("t")), factors, ["date", "sector", "t"])
    group = Window.partitionBy("factor", "date", "sector")
    neutral = lambda x: div(F.col(x) - F.avg(x).over(group), F.stddev_samp(x).over(group) + eps)
    rows = long.select("factor", "date", neutral("value").alias("fz"), neutral("t").alias("tz"), F.when(F.col("value").isNotNull(), mean_rank("value", ("factor", "date"))).alias("fr"), mean_rank("t", ("factor", "date")).alias("tr"))

    def daily(f: str, t: str) -> Column:
        own = F.when(F.col(f).isNotNull(), F.col(t))
        return div(F.count(f) * F.covar_pop(f, own), F.sqrt(F.count(f) * F.var_pop(f) * F.count(t) * F.var_pop(t)))

    days = rows.groupBy("factor", "date").agg(F.count(F.lit(1)).alias("n"), daily("fr", "tr").alias("ic"), daily("fz", "tz").alias("sn"))
    weighted = lambda x: div(F.sum(F.col(x) * F.col("n")), F.sum(F.when(F.col(x).isNotNull(), F.col("n"))))
    out = days.groupBy("factor").agg(
        weighted("ic").alias("ic_mean"), (F.stddev_samp("ic") + eps).alias("ic_std"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("hit_ratio"), F.count("ic").alias("n_dates"),
        F.when(F.count("sn") >= 3, div(weighted("sn"), F.stddev_samp("sn") + eps)).alias("sn_icir"),
    ).where("n_dates >= 3")
    out = out.withColumn("icir", div("ic_mean", "ic_std"))
    return out.withColumn("t_stat", F.col("icir") * F.sqrt(F.col("n_dates").cast("double")))


def bootstrap_ic(df: DataFrame, factors: list[str], target: str, replicates: int = 5, sample: int = 50_000, least: int = 50) -> DataFrame:
    """(seed, factor, ic): absolute rank correlation with the target in samples without replacement.

    A sample is the ``sample`` rows (date, ticker) with the smallest draw of seed and key, so its size is bounded
    whatever the table's. Missing factor values take the sample's mean.
    """
    picks = [df.select(F.lit(s).alias("seed"), "date", "ticker", *factors, F.col(target).alias("t")).orderBy(draw("date", "ticker", seed=s), "date", "ticker").limit(sample) for s in range(replicates)]
    long = unpivoted(reduce(DataFrame.union, picks).where("t is not null"), factors, ["seed", "t"])
    each = Window.partitionBy("seed", "factor")
    filled = long.withColumn("value", F.coalesce("value", F.avg("value").over(each)))
    ranked = filled.select("seed", "factor", mean_rank("value", ("seed", "factor")).alias("a"), mean_rank("t", ("seed", "factor")).alias("b"))
    found = ranked.groupBy("seed", "factor").agg(F.abs(div(F.covar_samp("a", "b"), (F.stddev_pop("a") + 1e-10) * (F.stddev_pop("b") + 1e-10))).alias("ic"), F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= least).drop("n")

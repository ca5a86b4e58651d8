"""Figures of reports: returns, drawdowns, the tracker of a ranked book, exposure, freshness and what is due for refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.functions.calendar import business_days_old
from stratapanel.functions.expr import div
from stratapanel.operators.shaping import episodes

YEAR = 252


def return_figures(curve: DataFrame, value: str = "close", by: str = "ticker", rate: float = 0.02, report_rate: float = 0.035) -> DataFrame:
    """(by, sharpe, sortino, report_cagr, report_sharpe, report_sortino).

    ``sharpe`` and ``sortino`` are over returns above ``rate``; the downside of the latter is that of losing days only
    (infinite ratio without any). The report's figures use calendar growth, no rate, and the downside over all days.
    """
    order = Window.partitionBy(by).orderBy("date")
    rows = curve.withColumn("r", div(value, F.lag(value).over(order)) - 1)
    excess, above = F.col("r") - rate / YEAR, F.col("r") - report_rate / YEAR
    square = lambda x: x * x
    a = rows.groupBy(by).agg(
        F.stddev_samp("r").alias("sd"), F.avg("r").alias("mean"), F.avg(excess).alias("ex"), F.sqrt(F.avg(F.when(excess < 0, square(excess)))).alias("loss"), F.avg(above).alias("ab"),
        F.sqrt(F.avg(F.when(above < 0, square(above)).when(above.isNotNull(), 0.0))).alias("down"), F.min_by(value, "date").alias("v0"), F.max_by(value, "date").alias("v1"), F.datediff(F.max("date"), F.min("date")).alias("span"),
    )
    root = YEAR**0.5
    steady = F.coalesce(F.col("sd") < 1e-9, F.lit(True))
    return a.select(
        by,
        F.when(steady, 0.0).otherwise(div("ex", "sd") * root).alias("sharpe"),
        F.when(F.coalesce(F.col("loss") * root < 1e-9, F.lit(True)), float("inf")).otherwise(div(F.col("ex") * YEAR, F.col("loss") * root)).alias("sortino"),
        F.when(F.col("span") > 0, F.pow(div("v1", "v0"), 365.0 / F.col("span")) - 1).otherwise(0.0).alias("report_cagr"),
        F.when(steady, 0.0).otherwise(div("mean", "sd") * root).alias("report_sharpe"),
        F.when(F.coalesce(F.col("down") < 1e-9, F.lit(True)), 0.0).otherwise(div("ab", "down") * root).alias("report_sortino"),
    )


def top_drawdowns(curve: DataFrame, n: int = 3, value: str = "close", by: str = "ticker", least: float = 0.001) -> DataFrame:
    """(by, place, depth, start, valley, recovery, days) of the deepest spans below the highest value; an open span has no recovery."""
    order = Window.partitionBy(by).orderBy("date")
    dd = div(value, F.max(value).over(order.rowsBetween(Window.unboundedPreceding, 0))) - 1
    rows = curve.select(by, "date", dd.alias("dd"), F.lead("date").over(order).alias("next")).withColumn("under", F.col("dd") < -least)
    spans = episodes(rows, "under", by).where("under").groupBy(by, "run").agg(
        F.min("dd").alias("depth"), F.min("date").alias("start"), F.min_by("date", F.struct("dd", "date")).alias("valley"), F.max("date").alias("last"), F.max_by("next", "date").alias("recovery")
    )
    place = F.row_number().over(Window.partitionBy(by).orderBy("depth", "start"))
    return spans.withColumn("place", place).where(F.col("place") <= n).select(by, "place", "depth", "start", "valley", "recovery", F.datediff(F.coalesce("recovery", "last"), "start").alias("days"))


def tracker(book: DataFrame, score: str = "score", every: int = 5, top: int = 20, cost_bps: float = 10.0, target_vol: float = 0.15, memory: int = 20) -> DataFrame:
    """(date, raw_return, leverage, cost, managed_return, benchmark_return) of rows (date, ticker, score, pnl_return).

    Every ``every`` days the top names are taken; between, the book is held. Which picks a day holds follows from its
    number, so nothing is sequential but the trailing deviation, a window over one row a day.
    """
    known = book.where(F.col(score).isNotNull() & F.col("pnl_return").isNotNull())
    days = known.groupBy("date").agg(F.avg("pnl_return").alias("benchmark_return"))
    calendar = Window.orderBy("date")
    days = days.withColumn("i", F.row_number().over(calendar) - 1).withColumn("k", F.floor(F.col("i") / every))
    rows = known.join(days.select("date", "i", "k"), "date")
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), "ticker"))
    picks = rows.where(F.col("i") % every == 0).withColumn("place", place).where(F.col("place") <= top).select("k", "ticker")
    held = rows.join(picks, ["k", "ticker"]).groupBy("date").agg(F.avg("pnl_return").alias("raw"))
    size = picks.groupBy(F.expr("k + 1").alias("k")).agg(F.count(F.lit(1)).alias("before"))
    kept = picks.join(picks.select(F.expr("k + 1").alias("k"), "ticker"), ["k", "ticker"]).groupBy("k").agg(F.count(F.lit(1)).alias("kept"))
    moved = size.join(kept, "k", "left").select("k", (1 - div(F.coalesce("kept", F.lit(0)), "before")).alias("turnover"))
    daily = days.join(held, "date", "left").join(moved, "k", "left").withColumn("raw_return", F.coalesce("raw", F.lit(0.0)))
    past = calendar.rowsBetween(-memory, -1)
    vol = F.stddev_pop("raw_return").over(past) * YEAR**0.5
    leverage = F.when((F.count("raw_return").over(past) >= memory) & (vol > 0), F.least(F.lit(1.0), div(F.lit(target_vol), vol))).otherwise(1.0)
    cost = F.when(F.col("i") % every == 0, F.coalesce("turnover", F.lit(0.0))).otherwise(0.0) * (2 * cost_bps / 1e4)
    return daily.withColumns({"leverage": leverage, "cost": cost}).select("date", "raw_return", "leverage", "cost", (F.col("raw_return") * F.col("leverage") - F.col("cost")).alias("managed_return"), "benchmark_return")


def rolling_risk(daily: DataFrame, x: str, market: str, n: int = 126, eps: float = 1e-6) -> DataFrame:
    """(date, vol, sharpe, beta) over full trailing frames of daily returns."""
    frame = Window.orderBy("date").rowsBetween(1 - n, 0)
    full = F.count(F.lit(1)).over(frame) >= n
    vol = F.stddev_samp(x).over(frame) * YEAR**0.5
    rows = daily.where(F.col(x).isNotNull() & F.col(market).isNotNull())
    return rows.select("date", F.when(full, vol).alias("vol"), F.when(full, div(F.avg(x).over(frame) * YEAR, vol + eps)).alias("sharpe"), F.when(full, div(F.covar_samp(x, market).over(frame), F.var_samp(market).over(frame) + eps)).alias("beta"))


def rebased(curve: DataFrame, benchmark: DataFrame, value: str = "close", level: str = "benchmark", by: str = "ticker") -> DataFrame:
    """(by, date, value, rebased): the benchmark in units of each curve's first value, from its first known level on."""
    order = Window.partitionBy(by).orderBy("date")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = curve.join(benchmark, "date", "left")
    start = F.first(level, ignorenulls=True).over(whole)
    return rows.select(by, "date", value, F.when(start > 0, div(level, start) * F.first(value).over(whole)).alias("rebased"))


def exposure(orders: DataFrame, limit: float = 0.10) -> DataFrame:
    """(date, long_value, short_value, gross, net, hhi, concentrated, n) of orders (date, side, value, weight)."""
    of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.abs("value"))), F.lit(0.0))
    w = F.abs("weight")
    a = orders.groupBy("date").agg(of("LONG").alias("long_value"), of("SHORT").alias("short_value"), div(F.sum(w * w), F.sum(w) * F.sum(w)).alias("hhi"), F.count(F.lit(1)).alias("n"))
    return a.select("date", "long_value", "short_value", (F.col("long_value") + F.col("short_value")).alias("gross"), (F.col("long_value") - F.col("short_value")).alias("net"), "hhi", (F.col("hhi") > limit).alias("concentrated"), "n")


def freshness(tables: dict[str, DataFrame], today: str, stale: int = 5) -> DataFrame:
    """(source, last_day, business_days, is_stale) of each table's ``date``; one pruned column a table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.max("date").alias("last_day")).select(F.lit(name).alias("source"), "last_day", F.to_date(F.lit(today)).alias("today"))
        out = one if out is None else out.union(one)
    old = F.greatest(business_days_old("last_day"), F.lit(0))
    return out.select("source", "last_day", old.alias("business_days"), (old > stale).alias("is_stale"))


def refresh_due(statements: DataFrame, today: str, stale_days: int = 90, history_days: int = 3 * 365, earnings_days: int = 365) -> DataFrame:
    """(ticker, age_days, is_stale, is_incomplete, earnings_due) of statement rows (ticker, date, eps_estimate).

    Incomplete: the first statement is not old enough. Earnings are due without a day ahead or a year of history.
    """
    now = F.to_date(F.lit(today))
    past = F.when(F.col("date") <= now, F.col("date"))
    age, first = F.datediff(now, F.max(past)), F.min("date")
    ahead, since = F.max(F.when(F.col("eps_estimate").isNotNull(), F.col("date"))), F.min(F.when(F.col("eps_estimate").isNotNull(), F.col("date")))
    rows = statements.groupBy("ticker").agg(age.alias("age_days"), first.alias("first"), ahead.alias("ahead"), since.alias("since"))
    due = F.coalesce((F.col("ahead") < now) | (F.datediff(now, "since") < earnings_days), F.lit(True))
    return rows.select("ticker", "age_days", F.coalesce(F.col("age_days") >= stale_days, F.lit(True)).alias("is_stale"), (F.col("first") > F.date_sub(now, history_days)).alias("is_incomplete"), due.alias("earnings_due"))


def on_last_day(df: DataFrame, day: str = "date") -> DataFrame:
    """The rows of the last day; on a table partitioned by day only that partition is read."""
    last = df.agg(F.max(day)).first()[0]
    return df.where(F.col(day) == F.lit(last)) if last is not None else df.where("false")


def in_days(df: DataFrame, on: str | None = None, last: int | None = None, since: str | None = None) -> DataFrame:
    """Rows of one day, of the last so many days of the table, or after a day; the bounds reach the scan as predicates."""
    if on:
        return df.where(F.col("date") == F.to_date(F.lit(on)))
    if last:
        days = [r[0] for r in df.select("date").distinct().orderBy(F.desc("date")).limit(last).collect()]
        return df.where(F.col("date") >= F.lit(min(days))) if days else df
    return df.where(F.col("date") > F.to_date(F.lit(since))) if since else df


def held_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """(period, held_return): weights (period, ticker, weight) times the compounded returns (period, ticker, r) of each name; gaps are skipped."""
    grown = returns.where("r is not null").groupBy("period", "ticker").agg((F.product(1 + F.col("r")) - 1).alias("g"))
    return weights.join(grown, ["period", "ticker"]).groupBy("period").agg(F.sum(F.col("weight") * F.col("g")).alias("held_return"))


def signed_error(y: Column, p: Column) -> tuple[Column, Column]:
    """Gradient and curvature of a smooth absolute error in which a wrong sign counts twice."""
    weight, slope = F.when(y * p < 0, 2.0).otherwise(1.0), F.tanh(y - p)
    return -weight * slope, F.greatest(weight * (1 - slope * slope), F.lit(1e-3))


def dollars(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(x, 0)), F.lit("-"))


def percent(x: Column, digits: int = 2) -> Column:
    return F.when(x.isNull(), "-").otherwise(F.format_string(f"%+.{digits}f%%", x * 100))

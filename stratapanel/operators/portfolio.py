"""Weights, limits, costs and impact as column expressions; solvers and the backtest as kernels of one group."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stratapanel.functions.expr import by_day, div
from stratapanel.operators.cross_section import by_sector, top_n
from stratapanel.operators.quadratic import quadratic_program


def equal_weights(df: DataFrame, score: str, n: int, cap: float = 0.1) -> DataFrame:
    """(date, ticker, weight): the day's top n share equally, capped, then scaled to 1."""
    chosen = top_n(df, score, n).withColumn("w", F.least(div(F.lit(1.0), F.count(F.lit(1)).over(by_day())), F.lit(cap)))
    return chosen.select("date", "ticker", div("w", F.sum("w").over(by_day())).alias("weight"))


def inverse_volatility(df: DataFrame, vol: str, floor: float = 1e-4) -> DataFrame:
    """(date, ticker, weight) in proportion to 1 / volatility."""
    rows = df.where(F.col(vol).isNotNull()).withColumn("w", div(F.lit(1.0), F.greatest(F.col(vol), F.lit(floor))))
    return rows.select("date", "ticker", div("w", F.sum("w").over(by_day())).alias("weight"))


def risk_limits(
    df: DataFrame, value: float, cap: float = 0.05, adv_share: float = 0.1, most: int | None = None, sector_cap: float = 0.3, target_vol: float = 0.2, leverage: float = 1.0, least: float = 0.001
) -> DataFrame:
    """(date, ticker, sector, weight) of rows with weight, adv, price, sector and the day's portfolio_vol.

    In this order: position cap, liquidity, number of positions, sector, volatility, leverage, sector again, smallest size.
    """
    liquid = F.col("adv") * F.col("price")
    w = F.least(F.col("weight"), F.lit(cap))
    rows = df.withColumn("w", F.when(liquid > 0, F.least(w, liquid * adv_share / value)).otherwise(0.0))
    if most:
        rows = rows.withColumn("place", F.row_number().over(by_day().orderBy(F.desc("w"), "ticker"))).where(F.col("place") <= most)

    def sectors(rows: DataFrame) -> DataFrame:
        total = F.sum("w").over(by_sector())
        return rows.withColumn("w", F.when(total > sector_cap, F.col("w") * div(F.lit(sector_cap), total)).otherwise(F.col("w")))

    rows = sectors(rows)
    rows = rows.withColumn("w", F.when(F.col("portfolio_vol") > target_vol, F.col("w") * div(F.lit(target_vol), "portfolio_vol")).otherwise(F.col("w")))
    total = F.sum("w").over(by_day())
    rows = sectors(rows.withColumn("w", F.when(total > leverage + 1e-6, F.col("w") * div(F.lit(leverage), total)).otherwise(F.col("w"))))
    return rows.where(F.col("w") >= least).select("date", "ticker", "sector", F.col("w").alias("weight"))


def concentration(df: DataFrame) -> DataFrame:
    """(date, hhi, effective_n) of the day's normalised weights."""
    rows = df.withColumn("s", div("weight", F.sum("weight").over(by_day())))
    return rows.groupBy("date").agg(F.sum(F.col("s") * F.col("s")).alias("hhi")).withColumn("effective_n", F.coalesce(div(F.lit(1.0), "hhi"), F.lit(0.0)))


def market_impact(shares: Column, volume: Column, volatility: Column, sell: Column, eta: float = 0.015, gamma: float = 0.1, alpha: float = 1.0, beta: float = 0.6, vol_ref: float = 0.02) -> Column:
    """Permanent plus temporary impact as a share of price; trades above a tenth of volume are penalised."""
    share = div(F.abs(shares), volume)
    penalty = F.when(share > 0.1, 1 + F.pow(share * 10, F.lit(2.0))).otherwise(1.0)
    scale = volatility / vol_ref
    permanent = gamma * F.pow(share, F.lit(alpha)) * scale * F.when(sell, 1.1).otherwise(1.0)
    return F.when((volume <= 0) | (shares == 0), F.when(shares != 0, 1.0).otherwise(0.0)).otherwise(permanent + eta * F.pow(share, F.lit(beta)) * scale * penalty)


def square_root_impact(shares: Column, volume: Column, k: float = 0.1) -> Column:
    return F.when((volume <= 0) | (shares == 0), 0.0).otherwise(k * F.sqrt(div(F.abs(shares), volume)))


def capacity(max_bps: float, volume: Column, volatility: Column, eta: float = 0.015, beta: float = 0.6, vol_ref: float = 0.02) -> Column:
    """Shares whose temporary impact stays below a limit."""
    share = F.pow(div(F.lit(max_bps / 1e4), eta * volatility / vol_ref), F.lit(1 / beta))
    return F.when(volume <= 0, 0).otherwise(F.floor(volume * F.least(F.coalesce(share, F.lit(1.0)), F.lit(1.0)))).cast("bigint")


def square_root_capacity(max_bps: float, volume: Column, k: float = 0.1) -> Column:
    """Shares whose square-root impact reaches a limit; none without volume."""
    return F.when(volume > 0, F.floor(volume * (max_bps / 1e4 / k) ** 2)).otherwise(0).cast("bigint")


def execution_cost(shares: Column, price: Column, volume: Column, commission: float = 0.001, spread: float = 0.0005, slippage: float = 0.0002, most: float = 0.02) -> Column:
    value = F.abs(shares) * price
    impact = F.when(volume > 1e-6, value * F.least(div(F.abs(shares), volume), F.lit(most)) * slippage).otherwise(0.0)
    return value * (commission + spread) + impact


def capped(df: DataFrame, cap: float, weight: str = "weight", by: str = "date", key: str = "ticker") -> DataFrame:
    """A group's weights scaled to 1, none above ``cap``: the excess goes to the others in proportion.

    Weights that end at the cap are a prefix of the falling order, so two windows find the level. If the cap leaves
    no room (rows * cap <= 1), all are equal.
    """
    group = Window.partitionBy(by)
    order = group.orderBy(F.desc(weight), key)
    rows = df.withColumns({"__before": F.row_number().over(order) - 1, "__rest": F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing)), "__n": F.count(F.lit(1)).over(group)})
    full = F.coalesce(div(F.col(weight) * (1 - F.col("__before") * cap), "__rest") > cap + 1e-9, F.lit(False))
    rows = rows.withColumn("__full", full).withColumn("__m", F.sum(F.col("__full").cast("int")).over(group)).withColumn("__free", F.sum(F.when(~F.col("__full"), F.col(weight))).over(group))
    level = F.when(F.col("__full"), cap).otherwise(F.coalesce(div(F.col(weight) * (1 - F.col("__m") * cap), "__free"), F.lit(0.0)))
    return rows.withColumn(weight, F.when(F.col("__n") * cap <= 1, div(F.lit(1.0), "__n")).otherwise(level)).drop("__before", "__rest", "__n", "__full", "__m", "__free")


def bounded_weights(df: DataFrame, least: float = 0.01, cap: float = 0.25, sector_cap: float | None = None) -> DataFrame:
    """(date, ticker, sector, weight): small weights go (of all small ones the largest stays), then caps by name and by sector."""
    day = by_day()
    rows = df.withColumn("__first", F.row_number().over(day.orderBy(F.desc("weight"), "ticker"))).where((F.col("weight") >= least) | (F.col("__first") == 1))
    rows = rows.withColumn("weight", div("weight", F.sum("weight").over(day)))
    rows = capped(rows.select("date", "ticker", "sector", "weight"), cap)
    if sector_cap is None:
        return rows
    totals = rows.groupBy("date", "sector").agg(F.sum("weight").alias("__old"))
    totals = capped(totals.withColumn("__new", F.col("__old")), sector_cap, "__new", key="sector")
    return rows.join(totals, ["date", "sector"]).select("date", "ticker", "sector", div(F.col("weight") * F.col("__new"), "__old").alias("weight"))


# ---- solvers over one day's expected returns and covariance


def project_capped_simplex(v: np.ndarray, cap: float, total: float = 1.0) -> np.ndarray:
    """The nearest point with entries in [0, cap] that sum to ``total``, by bisection on the shift."""
    low, high = v.min() - cap - total, v.max()
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if np.clip(v - middle, 0, cap).sum() > total else (low, middle)
    return np.clip(v - (low + high) / 2, 0, cap)


def quadratic_weights(mu: np.ndarray, sigma: np.ndarray, risk: float, cap: float = 1.0, rounds: int = 3000) -> np.ndarray:
    """Maximises mu'w - risk * w'Sw over the capped simplex by accelerated projected gradient."""
    n = len(mu)
    cap = max(cap, 1.0 / n)
    step = 1.0 / (2 * risk * max(float(np.linalg.eigvalsh(sigma)[-1]), 1e-12))
    w = z = np.full(n, 1.0 / n)
    t = 1.0
    for _ in range(rounds):
        new = project_capped_simplex(z + step * (mu - 2 * risk * sigma @ z), cap)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z = new + (before - 1) / t * (new - w)
        if np.abs(new - w).max() < 1e-12:
            return new
        w = new
    return w


def risk_parity_weights(sigma: np.ndarray, budget: np.ndarray | None = None, rounds: int = 500) -> np.ndarray:
    """Equal (or budgeted) risk contributions: cyclic descent on the log-barrier problem."""
    n = len(sigma)
    b = np.full(n, 1.0 / n) if budget is None else budget / budget.sum()
    y = 1 / np.sqrt(np.maximum(np.diag(sigma), 1e-12))
    for _ in range(rounds):
        old = y.copy()
        for i in range(n):
            rest = sigma[i] @ y - sigma[i, i] * y[i]
            y[i] = (-rest + np.sqrt(rest * rest + 4 * sigma[i, i] * b[i])) / (2 * sigma[i, i])
        if np.abs(y - old).max() < 1e-12 * max(1.0, np.abs(y).max()):
            break
    return y / y.sum()


def black_litterman_returns(sigma: np.ndarray, caps: np.ndarray, views: np.ndarray, confidence: float = 0.5, tau: float = 0.05, risk: float = 2.5) -> np.ndarray:
    """Posterior mean of returns implied by market caps and absolute views; a NaN view is none."""
    market = caps / caps.sum() if caps.sum() > 0 else np.full(len(caps), 1.0 / len(caps))
    implied, has = risk * sigma @ market, ~np.isnan(views)
    if not has.any():
        return implied
    precision = np.linalg.pinv(tau * sigma)
    sure = 1.0 / ((1.0 - min(max(confidence, 0.0), 1.0)) * 0.1 + 1e-6)
    return np.linalg.pinv(precision + np.diag(has * sure)) @ (precision @ implied + np.where(has, views, 0.0) * sure)


def kelly_weights(mu: np.ndarray, sigma: np.ndarray, rate: float = 0.04, fraction: float = 0.5, leverage: float = 1.0) -> np.ndarray:
    """Fractional Kelly bets on excess returns, long only, scaled to 1; equal weights if no bet is worth it."""
    n, excess = len(mu), mu - rate
    unit = min(leverage, fraction * max(float(excess.max()), 0.0) / float(np.diag(sigma).mean()))  # the size of a bet, in which the problem is solved
    if unit <= 0:
        return np.full(n, 1.0 / n)
    bounds, limits = np.vstack([-np.eye(n), np.ones((1, n))]), np.r_[np.zeros(n), leverage / unit]
    w, _ = quadratic_program(sigma * (unit / fraction), -excess, bounds, limits, np.zeros((0, n)), np.zeros(0))
    w = np.where(w > 1e-7 * w.max(), w, 0.0) * unit
    return w / w.sum() if w.sum() > 1e-6 else np.full(n, 1.0 / n)


def max_sharpe_weights(mu: np.ndarray, sigma: np.ndarray, rate: float = 0.04, cap: float = 1.0) -> np.ndarray:
    """The highest excess return per deviation over the capped simplex; equal weights if no excess is positive.

    The ratio does not change with scale, so the least variance of bets that earn one unit of excess gives it.
    """
    excess, n = mu - rate, len(mu)
    cap = max(cap, 1.0 / n)
    if not (excess > 0).any():
        return np.full(n, 1.0 / n)
    unit = np.abs(excess).max()
    bounds = np.vstack([-np.eye(n), np.eye(n) - cap])  # each bet is the cap's share of all at most
    y, solved = quadratic_program(2 * sigma / np.diag(sigma).mean(), np.zeros(n), bounds, np.zeros(2 * n), excess[None, :] / unit, np.ones(1))
    y = np.where(y > 1e-9, y, 0.0)
    if solved and y.sum() > 0:
        return y / y.sum()
    return quadratic_weights(excess, sigma, 1e-2, cap)  # no capped mix earns an excess: the largest return


def shrunk_covariance(returns: np.ndarray) -> np.ndarray:
    """Ledoit-Wolf shrinkage towards a scaled identity."""
    x = returns - returns.mean(0)
    n, p = x.shape
    sample = x.T @ x / n
    mean = np.trace(sample) / p
    spread = ((sample - mean * np.eye(p)) ** 2).sum() / p
    noise = min((((x**2).T @ (x**2) / n) - sample**2).sum() / (n * p), spread)
    shrink = noise / spread if spread > 0 else 0.0
    return (1 - shrink) * sample + shrink * mean * np.eye(p)


METHODS = ("mean_variance", "max_sharpe", "risk_parity", "kelly", "black_litterman", "inverse_vol", "top_n")


def safe_weights(w: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """Weights without small, negative or undefined ones, scaled to 1; equal weights if nothing is left."""
    w = np.where(np.isfinite(w) & (w > least), w, 0.0)
    total = w.sum()
    return w / total if total > least else np.full(len(w), 1.0 / len(w))


def allocate(history: DataFrame, method: str, cap: float = 1.0, risk: float = 1.0, rate: float = 0.04, fraction: float = 0.5, tau: float = 0.05, confidence: float = 0.5, aversion: float = 2.5, scale: float = 0.30, budget: str | None = None) -> DataFrame:
    """(date, ticker, weight) of rows (date, ticker, score, market_cap, returns): a day's candidates.

    ``returns`` is an array of past daily returns of one length a day; rows without a score, or with a gap in their
    returns, or of another length than most of the day, are left out. ``risk`` is the aversion of mean-variance,
    ``rate`` and ``fraction`` belong to max_sharpe and kelly, ``tau``, ``confidence`` and ``aversion`` to
    black_litterman, and ``budget`` names a column of risk budgets for risk_parity. A solver that fails, or gives
    undefined weights, is answered by equal weights. A day's candidates are few (its top n), so a day is a group of
    bounded size, and days are solved in parallel.
    """
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")

    def solve(day: pd.DataFrame) -> np.ndarray:
        n = len(day)
        if method == "top_n" or n == 1:
            return np.full(n, 1.0 / n)
        sigma = shrunk_covariance(np.array(day["returns"].tolist(), float).T) * 252
        mu = (day["score"].to_numpy(float) - 0.5) * 2 * scale
        if method == "risk_parity":
            return risk_parity_weights(sigma, None if budget is None else day[budget].to_numpy(float))
        if method == "max_sharpe":
            return max_sharpe_weights(mu, sigma, rate, cap)
        if method == "kelly":
            return kelly_weights(mu, sigma, rate, fraction)
        if method == "black_litterman":
            return quadratic_weights(black_litterman_returns(sigma, day["market_cap"].fillna(0).to_numpy(float), mu, confidence, tau, aversion), sigma, aversion, cap)
        if method == "inverse_vol":
            return 1 / np.sqrt(np.maximum(np.diag(sigma), 1e-8))
        return quadratic_weights(mu, sigma, risk, cap)

    def run(day: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values("ticker")
        whole = day["returns"].map(lambda x: x is not None and all(v is not None and np.isfinite(v) for v in x))
        day = day[whole & day["score"].notna()]
        size = day["returns"].map(len)
        day = day[size == size.mode().iloc[0]] if len(day) else day
        if not len(day):
            return pd.DataFrame({"date": [], "ticker": [], "weight": []}, dtype=object)
        try:
            w = solve(day)
        except (np.linalg.LinAlgError, FloatingPointError, ZeroDivisionError):
            w = np.full(len(day), np.nan)
        return pd.DataFrame({"date": day["date"].iloc[0], "ticker": day["ticker"], "weight": safe_weights(w)})[lambda x: x["weight"] > 1e-6]

    kinds = dict(history.dtypes)
    return history.groupBy("date").applyInPandas(run, f"date date, ticker {kinds['ticker']}, weight double")


# ---- the backtest: one ordered pass a strategy


def rebalance_days(days: DataFrame, every: str = "weekly") -> DataFrame:
    """(date): the first day of each ISO week and calendar year, month, or all days."""
    key = {"weekly": F.weekofyear("date") * 10000 + F.year("date"), "monthly": F.trunc("date", "month"), "daily": F.col("date")}[every]
    return days.select("date").distinct().groupBy(key.alias("k")).agg(F.min("date").alias("date")).select("date")


#: Events that a task hands on at once; places of a name's values in its row.
BATCH_EVENTS = 10_000
TICKER, OPEN, CLOSE, VOLUME, WEIGHT = range(3, 8)
_EVENTS = "strategy string, date date, kind string, ticker {ticker}, shares double, price double, value double, cost double, pnl double, reason string, total_value double, invested_value double, cash double, n_trades long"


def _values(x: pa.Array) -> list:
    """A column as Python values, without an object of its own for each row where these repeat; missing numbers of a column of doubles are NaN."""
    if pa.types.is_floating(x.type) or x.null_count == 0 and (pa.types.is_integer(x.type) or pa.types.is_boolean(x.type)):
        return x.to_numpy(zero_copy_only=False).tolist()
    if x.null_count:
        return x.to_pylist()
    coded = x.dictionary_encode()
    named = coded.dictionary.to_pylist()
    return [named[i] for i in coded.indices.to_numpy().tolist()]


def backtest_events(
    signals: DataFrame, capital: float = 1e6, commission: float = 0.001, spread: float = 0.0005, slippage: float = 0.0002, adv_cap: float = 0.02, stop: float = 0.1, max_turnover: float = 0.2, position_cap: float | None = None
) -> DataFrame:
    """All that happens to each strategy's book: rows of kind ``day`` (the book's value), ``trade`` and ``position`` (what is held at the end).

    Rows: (strategy, date, is_rebalance, names): names is an array of (ticker, open, close, volume, weight), weight NULL
    where the strategy wants none. Wanted weights above ``position_cap`` are cut to it and scaled back to their former
    sum. A trade has its reason (REBALANCE or STOP), its cost, and for what it closes the gain against the average
    price that was paid or, of a short position, received. A strategy's state is one ledger, so strategies run in
    parallel. Names pass as rows of their own in order of days, so a task holds a day and the ledger, not a history.
    """

    schema = _EVENTS.format(ticker=signals.schema["names"].dataType.elementType["ticker"].dataType.simpleString())
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(strategy, days: Iterator[tuple], out: list) -> Iterator[None]:
        """Appends the events of a strategy's days (date, whether a rebalance, names by ticker) to ``out``; yields after each day and at the end."""
        cash, held, peak = capital, {}, {}
        paid: dict = {}  # average price of what is held
        last: dict = {}

        def trade(day, t, shares: float, price: float, cost: float, reason: str) -> None:
            nonlocal cash
            before = held.get(t, 0.0)
            closed = -shares if before * shares < 0 and abs(shares) <= abs(before) else -before if before * shares < 0 else 0.0
            pnl = closed * (price - paid.get(t, price)) - (cost if closed else 0.0)
            after = before + shares
            if abs(after) <= 1e-6:
                held.pop(t, None), peak.pop(t, None), paid.pop(t, None)
            else:
                if before * shares >= 0:
                    paid[t] = (before * paid.get(t, price) + shares * price) / after
                elif abs(shares) > abs(before):
                    paid[t] = price
                held[t] = after
            cash -= shares * price + cost
            out.append((strategy, day, "trade", t, shares, price, abs(shares) * price, cost, pnl, reason, None, None, None, None))

        for day, is_rebalance, px in days:
            trades = 0
            nav = cash + sum(s * px[t][CLOSE] for t, s in held.items() if t in px)
            for t in [t for t in held if t in px]:
                close = px[t][CLOSE]
                peak[t] = max(peak.get(t, close), close)
                if stop > 0 and close < peak[t] * (1 - stop):
                    price = px[t][OPEN]
                    trade(day, t, -held[t], price, abs(held[t]) * price * (commission + spread), "STOP")
                    trades += 1
            weights = {t: x[WEIGHT] for t, x in px.items() if x[WEIGHT] is not None and x[WEIGHT] == x[WEIGHT]}
            if position_cap is not None and weights:
                total = sum(weights.values())
                weights = {t: min(w, position_cap) for t, w in weights.items()}
                cut = sum(weights.values())
                weights = {t: w * total / cut for t, w in weights.items()} if cut else weights
            wanted = {t: w * nav for t, w in weights.items()}
            if is_rebalance and wanted:
                delta = {t: wanted.get(t, 0.0) - (held.get(t, 0.0) * px[t][CLOSE] if t in px else 0.0) for t in sorted({*wanted, *held})}
                turnover = sum(map(abs, delta.values()))
                scale = nav * max_turnover / turnover if turnover > nav * max_turnover else 1.0
                for t, d in delta.items():
                    if t not in px or px[t][OPEN] <= 0 or d == 0:
                        continue
                    price, volume = px[t][OPEN], px[t][VOLUME]
                    shares = d * scale / price
                    value = abs(shares) * price
                    cost = value * (commission + spread) + (value * min(abs(shares) / volume, adv_cap) * slippage if volume > 1e-6 else 0.0)
                    trade(day, t, shares, price, cost, "REBALANCE")
                    trades += 1
                    if t in held:
                        peak[t] = max(peak.get(t, price), price)
            invested = sum(s * px[t][CLOSE] for t, s in held.items() if t in px)
            last.update((t, px[t][CLOSE]) for t in held if t in px)
            out.append((strategy, day, "day", None, None, None, None, None, None, None, round(cash + invested, 4), round(invested, 4), round(cash, 4), trades))
            yield
        for t in sorted(held):
            price = last.get(t, paid[t])
            out.append((strategy, day, "position", t, held[t], price, held[t] * price, None, held[t] * (price - paid[t]), None, None, None, None, None))
        yield

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type, from_pandas=True) for x, f in zip(zip(*out), made, strict=True)], schema=made)

    def strategies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*map(_values, b.columns), strict=True))
        out: list = []
        for strategy, own in groupby(rows, itemgetter(0)):
            days = ((day, names[0][2], {x[TICKER]: x for x in names if x[TICKER] is not None}) for day, names in ((k, list(g)) for k, g in groupby(own, itemgetter(1))))
            for _ in run(strategy, days, out):
                if len(out) >= BATCH_EVENTS:
                    yield batch(out)
                    out.clear()
        if out:
            yield batch(out)

    # each strategy's rows in one task, sorted before names become rows, which keep the order
    ordered = signals.select("strategy", "date", "is_rebalance", "names").repartition("strategy").sortWithinPartitions("strategy", "date")
    return ordered.select("strategy", "date", "is_rebalance", F.explode_outer("names").alias("x")).select("strategy", "date", "is_rebalance", "x.ticker", "x.open", "x.close", "x.volume", "x.weight").mapInArrow(strategies, schema)


def backtest(signals: DataFrame, **options) -> DataFrame:
    """(strategy, date, total_value, invested_value, cash, n_trades): the daily curve of ``backtest_events``."""
    return backtest_events(signals, **options).where("kind = 'day'").select("strategy", "date", "total_value", "invested_value", "cash", "n_trades")


def backtest_trades(events: DataFrame) -> DataFrame:
    """(strategy, date, ticker, side, shares, price, value, cost, pnl, reason) of the trades among events; pnl of opening trades is 0."""
    return events.where("kind = 'trade'").select("strategy", "date", "ticker", F.when(F.col("shares") > 0, "BUY").otherwise("SELL").alias("side"), F.abs("shares").alias("shares"), "price", "value", "cost", "pnl", "reason")


def backtest_positions(events: DataFrame) -> DataFrame:
    """(strategy, ticker, shares, price, value, open_pnl) of what is held after the last day."""
    return events.where("kind = 'position'").select("strategy", "ticker", "shares", "price", "value", F.col("pnl").alias("open_pnl"))


def signal_days(bars: DataFrame, weights: DataFrame, every: str = "weekly") -> DataFrame:
    """The rows ``backtest`` takes, from bars (date, ticker, open, close, volume) and weights (strategy, date, ticker, weight).

    A strategy gets a row for each day of the bars, and of a name only the bars from the day on when the strategy first
    wants it. Ids of strategies and tickers keep their types.
    """
    since = weights.groupBy("strategy", "ticker").agg(F.min("date").alias("since"))
    own = bars.join(since, "ticker").where("date >= since").join(weights, ["strategy", "date", "ticker"], "left")
    names = own.groupBy("strategy", "date").agg(F.array_sort(F.collect_list(F.struct("ticker", "open", "close", "volume", "weight"))).alias("names"))
    days = rebalance_days(bars, every).withColumn("is_rebalance", F.lit(True))
    grid = weights.select("strategy").distinct().join(bars.select("date").distinct().join(days, "date", "left"))
    rows = grid.join(names, ["strategy", "date"], "left")
    return rows.select("strategy", "date", F.coalesce("is_rebalance", F.lit(False)).alias("is_rebalance"), F.coalesce("names", F.array().cast(names.schema["names"].dataType)).alias("names"))

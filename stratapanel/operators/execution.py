"""Simulated fills, a cash ledger and the drawdown switch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.functions.expr import div


def uniform(*keys: str, seed: int = 0) -> Column:
    """A number in (0, 1) from 40 bits of the MD5 of the keys' text and the seed, so reruns draw the same, in any engine."""
    return (draw(*keys, seed=seed) + 0.5) / float(1 << 40)


def draw(*keys: str, seed: int = 0) -> Column:
    """A whole number below 2**40 from the keys' text and the seed."""
    text = F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("bigint")


def normal(*keys: str, seed: int = 0) -> Column:
    """A standard normal draw from two uniform ones."""
    return F.sqrt(-2 * F.ln(uniform(*keys, seed=seed))) * F.cos(2 * 3.141592653589793 * uniform(*keys, seed=seed + 1))


def fills(orders: DataFrame, prices: DataFrame, commission: float = 0.001, spread: float = 0.0005, slippage: float = 0.0002, fill: float = 1.0, keys: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """Orders (date, ticker, shares, side, impact_rate) met with prices (date, ticker, close, volume, volatility).

    Orders without a price are dropped. ``failure_reason`` is ZERO_VOLUME, PROBABILITY, INVALID_INPUTS or NULL.
    """
    rows = orders.join(prices, ["date", "ticker"]).withColumn("shares", F.col("shares").cast("bigint"))
    why = F.when(F.col("volume") <= 0, "ZERO_VOLUME").when(uniform(*keys, seed=11) > fill, "PROBABILITY").when((F.col("shares") <= 0) | (F.col("close") <= 0), "INVALID_INPUTS")
    notional = F.col("shares") * F.col("close")
    rate = spread + slippage * F.exp(normal(*keys, seed=21) * F.coalesce("volatility", F.lit(0.02))) + F.coalesce("impact_rate", F.lit(0.0))
    rows = rows.withColumns({"failure_reason": why, "commission_usd": notional * commission, "friction_usd": rate * notional})
    step = div("friction_usd", "shares")
    price = F.greatest(F.when(F.col("side") == "buy", F.col("close") + step).otherwise(F.col("close") - step), F.lit(0.01))
    done = rows.withColumns({"success": F.col("failure_reason").isNull(), "fill_price": price, "cost_bps": div(F.col("commission_usd") + F.col("friction_usd"), notional) * 1e4})
    return done.select("date", "ticker", "side", "shares", "close", "fill_price", "commission_usd", "friction_usd", "cost_bps", "success", "failure_reason")


def ledger(orders: DataFrame, capital: float = 1e6, commission: float = 0.001, slippage: float = 0.0005) -> DataFrame:
    """(portfolio, seq, type, ticker, shares, price, cash, pnl, accepted) of ordered entries (portfolio, seq, type, ticker, shares, price).

    Types are buy, sell and dividend (price is the amount a share). Average cost; an entry that lacks cash or shares is
    not accepted. A portfolio's entries are one ordered group.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cash, held, out = capital, {}, []
        for x in rows.sort_values("seq").itertuples():
            shares, cost = held.get(x.ticker, (0.0, 0.0))
            pnl, fine = 0.0, False
            if x.type == "buy" and x.shares > 0 and x.price > 0:
                raw = x.shares * x.price * (1 + slippage)
                if raw * (1 + commission) <= cash + 1e-9:
                    fine, cash = True, cash - raw * (1 + commission)
                    held[x.ticker] = (shares + x.shares, (shares * cost + raw) / (shares + x.shares))
            elif x.type == "sell" and 0 < x.shares <= shares + 1e-9 and x.price > 0:
                sold = min(x.shares, shares)
                net = sold * x.price * (1 - slippage) * (1 - commission)
                fine, cash, pnl = True, cash + net, net - sold * cost
                held[x.ticker] = (shares - sold, cost)
                if shares - sold < 1e-9:
                    held.pop(x.ticker)
            elif x.type == "dividend" and shares * x.price > 0:
                fine, pnl, cash = True, shares * x.price, cash + shares * x.price
            out.append((x.portfolio, x.seq, x.type, x.ticker, float(x.shares), float(x.price), cash, pnl, fine))
        return pd.DataFrame(out, columns=["portfolio", "seq", "type", "ticker", "shares", "price", "cash", "pnl", "accepted"])

    return orders.groupBy("portfolio").applyInPandas(run, "portfolio string, seq long, type string, ticker string, shares double, price double, cash double, pnl double, accepted boolean")


def kill_switch(daily: DataFrame, out: float = -0.2, back: float = -0.1, cooldown: int = 21) -> DataFrame:
    """(strategy, date, exposure, drawdown) of ordered daily returns (strategy, date, ret).

    Out of the market below ``out`` for ``cooldown`` days, half in until the fall is less than ``back``, half in below 10 %.
    The fall is that of the strategy's own equity, which the exposure feeds; so a strategy is one ordered group.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        equity = peak = 1.0
        wait, hit, made = 0, False, []
        for x in rows.sort_values("date").itertuples():
            fall = equity / peak - 1 if peak > 0 else 0.0
            if wait > 0:
                share = 0.0
            elif hit and fall > back:
                hit, share = False, 1.0
            elif hit and fall > out:
                share = 0.5
            elif hit or fall < out:
                hit, wait, share = True, cooldown, 0.0
            else:
                share = 0.5 if fall < -0.1 else 1.0
            wait = max(wait - 1, 0)
            made.append((x.strategy, x.date, share, fall))
            equity *= 1 + share * x.ret
            peak = max(peak, equity)
        return pd.DataFrame(made, columns=["strategy", "date", "exposure", "drawdown"])

    return daily.groupBy("strategy").applyInPandas(run, "strategy string, date date, exposure double, drawdown double")


def trade_figures(trades: DataFrame, pnl: str = "pnl", side: str = "side") -> DataFrame:
    """One row: hit ratio, win to loss, profit by side, total and number of trades."""
    x, s = F.col(pnl), F.lower(F.col(side))
    total = lambda *names: F.coalesce(F.sum(F.when(s.isin(*names), x)), F.lit(0.0))
    won, lost = F.avg(F.when(x > 0, x)), F.abs(F.avg(F.when(x < 0, x)))
    return trades.where(x.isNotNull()).agg(
        F.round(F.coalesce(F.avg((x > 0).cast("double")), F.lit(0.0)), 4).alias("hit_ratio"), F.round(F.coalesce(div(won, F.coalesce(lost, F.lit(1e-12))), F.lit(0.0)), 4).alias("win_loss_ratio"),
        F.round(total("long", "buy"), 2).alias("long_pnl"), F.round(total("short", "sell"), 2).alias("short_pnl"), F.round(F.coalesce(F.sum(x), F.lit(0.0)), 2).alias("total_pnl"), F.count(F.lit(1)).alias("n_trades"),
    )

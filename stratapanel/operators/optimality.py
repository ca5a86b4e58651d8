"""Whether finished weights solve their day's problem: residuals of the conditions that only a solution fulfils."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.operators.portfolio import black_litterman_returns, shrunk_covariance

#: Weights from which a name counts as held.
HELD = 1e-4


def stationarity(gradient: np.ndarray, w: np.ndarray, cap: float) -> float:
    """How much could be gained, a unit of weight moved, between names that can take more and names that can give some."""
    takes, gives = w < cap - HELD, w > HELD
    return max(0.0, float(gradient[takes].max() - gradient[gives].min())) if takes.any() and gives.any() else 0.0


def residual(method: str, w: np.ndarray, mu: np.ndarray, sigma: np.ndarray, market_caps: np.ndarray, cap: float = 1.0, risk: float = 1.0, rate: float = 0.04, fraction: float = 0.5, tau: float = 0.05, confidence: float = 0.5, aversion: float = 2.5) -> float:
    """The residual of a method's weights, in units of yearly return (shares of risk for risk_parity, weight for the closed forms)."""
    n = len(w)
    if n == 1 or method == "top_n":
        return float(np.abs(w - 1.0 / n).max())
    cap, deviation = max(cap, 1.0 / n), np.sqrt(np.maximum(np.diag(sigma), 1e-8))
    if method == "inverse_vol":
        return float(np.abs(w - (1 / deviation) / (1 / deviation).sum()).max())
    if method == "risk_parity":
        return float(np.abs(w * (sigma @ w) / (w @ sigma @ w) - 1.0 / n).max())
    if method == "mean_variance":
        return stationarity(mu - 2 * risk * sigma @ w, w, cap)
    if method == "black_litterman":
        return stationarity(black_litterman_returns(sigma, market_caps, mu, confidence, tau, aversion) - 2 * aversion * sigma @ w, w, cap)
    excess = mu - rate
    if not (excess > 0).any():
        return float(np.abs(w - 1.0 / n).max())
    if method == "max_sharpe":
        return stationarity(excess - (excess @ w) / max(w @ sigma @ w, 1e-18) * (sigma @ w), w, cap)
    # kelly: weights are scaled to 1; either the bets sum to less than 1 and that sum is fitted, or they sum to 1 and that has a price
    push, held = sigma @ w / fraction, w > HELD
    free = min(1.0, max(0.0, float(push[held] @ excess[held] / (push[held] @ push[held]))))
    ways = ((free, 0.0), (1.0, max(0.0, float((excess - push)[held].mean()))))
    gradients = [excess - scale * push - price for scale, price in ways]
    return min(max(float(np.abs(g[held]).max()), float(g[~held].max(initial=0.0))) for g in gradients)


def residuals(history: DataFrame, weights: DataFrame, scale: float = 0.30, **options) -> DataFrame:
    """(date, method, residual, total) of weights (method, date, ticker, weight) of the candidates that ``allocate`` got."""

    def run(key: tuple, day: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values("ticker")
        sigma = shrunk_covariance(np.array(day["returns"].tolist(), float).T) * 252 if len(day) > 1 else np.eye(1)
        w, mu = day["weight"].to_numpy(float), (day["score"].to_numpy(float) - 0.5) * 2 * scale
        return pd.DataFrame({"date": [key[1]], "method": [key[0]], "residual": [residual(key[0], w, mu, sigma, day["market_cap"].fillna(0).to_numpy(float), **options)], "total": [w.sum()]})

    every = weights.select("method", "date").distinct().join(history.select("date", "ticker", "score", "market_cap", "returns"), "date")
    rows = every.join(weights, ["method", "date", "ticker"], "left").fillna(0.0, "weight")  # names without a weight belong to the problem
    return rows.groupBy(F.col("method"), F.col("date")).applyInPandas(run, "date date, method string, residual double, total double")

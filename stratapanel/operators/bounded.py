"""Weights under linear bounds: one day's few names as a quadratic program, and the allocation of all days.

A day's names are its own top candidates, so a solve is small and days run in parallel. Bounds on sums of absolute
values (turnover, leverage) are written with a rise and a fall of each weight, so all bounds are linear.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from stratapanel.operators.portfolio import shrunk_covariance
from stratapanel.operators.quadratic import quadratic_program


@dataclass(frozen=True)
class Bounds:
    """Bounds of a day's weights: their sum (1: fully invested, 0: dollar neutral, None: free), each weight, the sum of absolute weights,
    the absolute sum of a sector and the sum of absolute changes from the weights held."""

    total: float | None = 1.0
    least: float = 0.0
    most: float = 1.0
    leverage: float | None = None
    sector: float | None = None
    turnover: float | None = None


def bounded_solution(mu: np.ndarray, sigma: np.ndarray, risk: float, bounds: Bounds, sectors: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, bool]:
    """(weights, solved): maximises mu'w - risk * w'Sw under the bounds."""
    n, eye = len(mu), np.eye(len(mu))
    around = [(held, bounds.turnover)] * (bounds.turnover is not None) + [(np.zeros(n), bounds.leverage)] * (bounds.leverage is not None)
    size = n * (1 + 2 * len(around))
    wide = lambda rows, at=0: np.hstack([np.zeros((len(rows), at)), rows, np.zeros((len(rows), size - at - rows.shape[1]))])
    g, h = [wide(eye), wide(-eye)], [np.full(n, bounds.most), np.full(n, -bounds.least)]
    a, b = ([wide(np.ones((1, n)))], [np.array([bounds.total])]) if bounds.total is not None else ([], [])
    if bounds.sector is not None:
        member = np.array([sectors == x for x in np.unique(sectors)], float)
        g += [wide(member), wide(-member)]
        h += [np.full(len(member), bounds.sector)] * 2
    for i, (centre, limit) in enumerate(around):
        at = n * (1 + 2 * i)
        a.append(wide(eye) + wide(np.hstack([-eye, eye]), at))  # w = centre + rise - fall
        b.append(centre)
        g += [wide(-np.eye(2 * n), at), wide(np.ones((1, 2 * n)), at)]
        h += [np.zeros(2 * n), np.array([limit])]
    p, q = np.zeros((size, size)), np.zeros(size)
    p[:n, :n], q[:n] = 2 * risk * sigma, -mu
    x, solved = quadratic_program(p, q, np.vstack(g), np.concatenate(h), np.vstack(a) if a else np.zeros((0, size)), np.concatenate(b) if b else np.zeros(0))
    return x[:n], solved


def breach(w: np.ndarray, bounds: Bounds, sectors: np.ndarray, held: np.ndarray) -> float:
    """By how much weights break the bounds, at most."""
    over = [w.max(initial=bounds.most) - bounds.most, bounds.least - w.min(initial=bounds.least)]
    if bounds.total is not None:
        over.append(abs(w.sum() - bounds.total))
    if bounds.leverage is not None:
        over.append(np.abs(w).sum() - bounds.leverage)
    if bounds.sector is not None:
        over += [abs(w[sectors == x].sum()) - bounds.sector for x in np.unique(sectors)]
    if bounds.turnover is not None:
        over.append(np.abs(w - held).sum() - bounds.turnover)
    return max(0.0, *over)


def allocate_bounded(history: DataFrame, bounds: Bounds, risk: float = 1.0, scale: float = 0.30) -> DataFrame:
    """(date, ticker, weight, status, breach, gain) of rows (date, ticker, sector, score, returns, held): a day's candidates.

    ``held`` is the weight before, ``returns`` an array of past daily returns of one length a day; rows without a score
    or with a gap are left out, a null sector is one of its own, a null ``held`` none. ``status`` is ``optimal``, or
    ``infeasible`` where no weights fulfil the bounds: then the day keeps what it holds, or has equal weights if it
    holds nothing. ``breach`` is by how much the bounds are broken, ``gain`` the objective.
    """
    kinds = dict(history.dtypes)

    def run(day: pd.DataFrame) -> pd.DataFrame:
        whole = day["returns"].map(lambda x: x is not None and len(x) > 1 and all(v is not None and np.isfinite(v) for v in x))
        day = day[whole & day["score"].notna()].sort_values("ticker")
        if len(day):
            size = day["returns"].map(len)
            day = day[size == size.mode().iloc[0]]
        if not len(day):
            return pd.DataFrame({"date": day["date"], "ticker": day["ticker"], "weight": day["score"], "status": day["date"], "breach": day["score"], "gain": day["score"]})
        sigma = shrunk_covariance(np.array(day["returns"].tolist(), float).T) * 252
        mu, held = (day["score"].to_numpy(float) - 0.5) * 2 * scale, day["held"].fillna(0.0).to_numpy(float)
        sectors = day["sector"].astype(object).where(day["sector"].notna(), "").astype(str).to_numpy()
        w, solved = bounded_solution(mu, sigma, risk, bounds, sectors, held)
        if not solved:
            w = held if np.abs(held).sum() > 0 else np.full(len(day), 1.0 / len(day))
        gain = float(mu @ w - risk * w @ sigma @ w)
        return pd.DataFrame({"date": day["date"], "ticker": day["ticker"], "weight": w, "status": "optimal" if solved else "infeasible", "breach": breach(w, bounds, sectors, held), "gain": gain})

    return history.groupBy("date").applyInPandas(run, f"date date, ticker {kinds['ticker']}, weight double, status string, breach double, gain double")

"""Tests and groupings of factors: the sums are Spark's, what is left is a formula over a few numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def t_probability(t: float, df: float) -> float:
    """Two-sided probability of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    value = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d), 1 + k / c
            value *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return 1 - front * value if swap else front * value


def t_test(df: DataFrame, column: str) -> dict[str, float | bool]:
    """Whether a mean differs from 0: one aggregation, then the t distribution."""
    n, mean, sd = df.agg(F.count(column), F.avg(column), F.stddev_samp(column)).first()
    t = mean / (sd / math.sqrt(n)) if n > 1 and sd else float("nan")
    p = t_probability(t, n - 1) if n > 1 and sd else float("nan")
    return {"mean": mean, "t_stat": t, "p_value": p, "significant": p < 0.05, "n": n}


def false_discovery(p: Sequence[float]) -> list[float]:
    """Benjamini-Hochberg corrected probabilities."""
    order = np.argsort(p)[::-1]
    scaled = np.minimum.accumulate(np.asarray(p)[order] * len(p) / (len(p) - np.arange(len(p))))
    out = np.empty(len(p))
    out[order] = np.minimum(scaled, 1)
    return out.tolist()


def dickey_fuller(df: DataFrame, column: str) -> dict[str, float | bool]:
    """The unit-root statistic of a daily series with a constant and no lags; stationary below the 5 % value of -2.86."""
    order = Window.orderBy("date")
    rows = df.where(F.col(column).isNotNull()).select((F.col(column) - F.lag(column).over(order)).alias("d"), F.lag(column).over(order).alias("x")).where("x is not null")
    n, cov, vx, vd = rows.agg(F.count(F.lit(1)), F.covar_pop("d", "x"), F.var_pop("x"), F.var_pop("d")).first()
    slope = cov / vx if vx else float("nan")
    error = math.sqrt(max(vd - slope * cov, 0) * n / (n - 2) / (n * vx)) if n > 2 and vx else float("nan")
    t = slope / error if error else float("nan")
    return {"statistic": t, "stationary": t < -2.86, "n": n}


def cluster(names: Sequence[str], rho: dict[tuple[str, str], float], threshold: float = 0.5) -> dict[str, int]:
    """Ward groups of factors by distance 1 - |rho|, cut at 1 - ``threshold``; a factor list has some hundred names."""
    members = {i: [n] for i, n in enumerate(names)}
    away = {frozenset((i, j)): 1 - abs(rho.get((a, b), rho.get((b, a), 0.0))) for i, a in enumerate(names) for j, b in enumerate(names) if i < j}
    while len(members) > 1:
        pair = min(((k, v) for k, v in away.items() if k <= members.keys()), key=lambda x: (x[1], sorted(x[0])))
        if pair[1] > 1 - threshold:
            break
        i, j = sorted(pair[0])
        for k in members.keys() - {i, j}:
            a, b, c = len(members[i]), len(members[j]), len(members[k])
            squared = ((a + c) * away[frozenset((i, k))] ** 2 + (b + c) * away[frozenset((j, k))] ** 2 - c * pair[1] ** 2) / (a + b + c)
            away[frozenset((i, k))] = math.sqrt(max(squared, 0))
        members[i] += members.pop(j)
    return {n: g for g, group in enumerate(sorted(members.values())) for n in group}


def half_life(decay: DataFrame) -> int | None:
    """The first lag whose coefficient is at most half the first one's, of a table (lag, ic) of a row a lag."""
    first = decay.orderBy("lag").select(F.abs("ic")).first()
    if not first or not first[0]:
        return None
    return decay.where(F.abs("ic") <= first[0] / 2).agg(F.min("lag")).first()[0]


#: Rows that the chains of several keys are fitted on side by side, at least; cells of one array of a block at most.
REGIME_ROWS, REGIME_CELLS = 100_000, 400_000


def _side_by_side(x: np.ndarray, sizes: np.ndarray, rounds: int) -> np.ndarray:
    """States of series that stand one after another in ``x``, of ``sizes`` in falling order; all take each step together.

    Arrays are (time, series); at a time the first ``on[t]`` series still run, cells behind a series' end count nowhere.
    """
    starts, longest, k = np.cumsum(sizes) - sizes, int(sizes[0]), len(sizes)
    own, at = np.repeat(np.arange(k), sizes), np.arange(len(x)) - np.repeat(starts, sizes)
    grid, real = np.zeros((longest, k)), np.zeros((longest, k))
    grid[at, own], real[at, own] = x, 1.0
    on = np.searchsorted(-sizes, -np.arange(longest), side="left")
    series = [x[a : a + n] for a, n in zip(starts, sizes, strict=True)]
    mean = [np.array([s.mean() for s in series])] * 2
    var = [np.array([s.var() for s in series]) * f for f in (0.5, 2.0)]
    step, start = [[np.full(k, 0.95 if i == j else 0.05) for j in (0, 1)] for i in (0, 1)], [np.full(k, 0.5)] * 2
    for _ in range(rounds):
        like = [np.exp(-0.5 * (grid - m) ** 2 / v) / np.sqrt(v) + 1e-300 for m, v in zip(mean, var, strict=True)]
        ahead, behind, scale = [np.zeros_like(grid) for _ in (0, 1)], [np.ones_like(grid) for _ in (0, 1)], np.ones_like(grid)
        for t in range(longest):
            m = on[t]
            now = [(start[j][:m] if not t else ahead[0][t - 1, :m] * step[0][j][:m] + ahead[1][t - 1, :m] * step[1][j][:m]) * like[j][t, :m] for j in (0, 1)]
            scale[t, :m] = now[0] + now[1]
            for j in (0, 1):
                ahead[j][t, :m] = now[j] / scale[t, :m]
        for t in range(longest - 2, -1, -1):
            m = on[t + 1]
            after = [like[j][t + 1, :m] * behind[j][t + 1, :m] for j in (0, 1)]
            for i in (0, 1):
                behind[i][t, :m] = (step[i][0][:m] * after[0] + step[i][1][:m] * after[1]) / scale[t + 1, :m]
        each = [ahead[j] * behind[j] for j in (0, 1)]
        total = np.where(real > 0, each[0] + each[1], 1.0)
        each = [e / total * real for e in each]
        after = [like[j][1:] * behind[j][1:] / scale[1:] * real[1:] for j in (0, 1)]
        moves = [[step[i][j] * (ahead[i][:-1] * after[j]).sum(0) for j in (0, 1)] for i in (0, 1)]
        step, start = [[moves[i][j] / (moves[i][0] + moves[i][1]) for j in (0, 1)] for i in (0, 1)], [e[0] for e in each]
        weight = [e.sum(0) for e in each]
        mean = [(e * grid).sum(0) / w for e, w in zip(each, weight, strict=True)]
        var = [np.maximum((e * (grid - m) ** 2).sum(0) / w, 1e-12) for e, m, w in zip(each, mean, weight, strict=True)]
    cost = [np.log(start[j] + 1e-300) + np.log(like[j][0]) for j in (0, 1)]
    move = [[np.log(step[i][j] + 1e-300) for j in (0, 1)] for i in (0, 1)]
    came = [np.zeros((longest, k), bool) for _ in (0, 1)]
    for t in range(1, longest):
        m = on[t]
        way = [[cost[i][:m] + move[i][j][:m] for i in (0, 1)] for j in (0, 1)]
        for j in (0, 1):
            came[j][t, :m] = way[j][1] > way[j][0]
            cost[j][:m] = np.maximum(*way[j]) + np.log(like[j][t, :m])
    path, state = np.zeros((longest, k), bool), cost[1] > cost[0]
    for t in range(longest - 1, -1, -1):
        m = on[t]
        path[t, :m] = state[:m]
        state[:m] = np.where(state[:m], came[1][t, :m], came[0][t, :m])
    return (path ^ (var[1] < var[0]))[at, own].astype(np.int32)


def regime_states(x: np.ndarray, sizes: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The state of each row of ordered series that stand one after another in ``x``; short or constant series have state 0."""
    out, ends = np.zeros(len(x), np.int32), np.cumsum(sizes)
    fits = [i for i in np.argsort(-sizes, kind="stable") if sizes[i] >= 10 and x[ends[i] - sizes[i] : ends[i]].std() != 0]
    while fits:
        some, fits = fits[: max(1, REGIME_CELLS // int(sizes[fits[0]]))], fits[max(1, REGIME_CELLS // int(sizes[fits[0]])) :]
        rows = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in some])
        out[rows] = _side_by_side(x[rows], sizes[some], rounds)
    return out


def two_regimes(df: DataFrame, column: str, by: str = "ticker", rounds: int = 60) -> DataFrame:
    """(by, date, state): the likeliest path of a two-state Gaussian Markov chain of each key's ordered series.

    State 1 is the one of larger variance. Keys are fitted in parallel, and those of a task in blocks whose series take
    each step together, so a row costs a share of an array operation; a key's series is whole in one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
            states = regime_states(rows[column].to_numpy(), sizes, rounds)
            yield from rows.drop_columns(column).append_column("state", pa.array(states)).to_batches()

        def runs(rows: pa.Table) -> np.ndarray:
            return np.diff(pc.run_end_encode(rows[by].combine_chunks()).run_ends.to_numpy(), prepend=0)

        held, n, most = [], 0, REGIME_ROWS
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= most:
                rows = pa.Table.from_batches(held).combine_chunks()
                sizes = runs(rows)
                if len(sizes) > 1:
                    yield from done(rows.slice(0, n - sizes[-1]), sizes[:-1])
                held, n = rows.slice(n - sizes[-1]).to_batches(), int(sizes[-1])
                most = max(REGIME_ROWS, 2 * n)
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from done(rows, runs(rows))

    known = df.select(by, "date", F.col(column).cast("double").alias(column)).where(F.col(column).isNotNull() & ~F.isnan(column))
    return known.repartition(by).sortWithinPartitions(by, "date").mapInArrow(run, f"{by} {dict(df.dtypes)[by]}, date date, state int")

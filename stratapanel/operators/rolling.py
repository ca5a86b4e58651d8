"""Trailing figures over long windows, all of a panel in one grouped pass.

A window expression of Spark visits every row of a frame for every row; over frames of hundreds of rows that is most of
a factor's cost. Here a ticker's windows are views of one array, so a figure is a few array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows whose windows are worked on at once, so a long series needs no more memory than so many windows.
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Trailing:
    """The figure ``how`` of the last ``n`` rows of ``x``, NULL with fewer than ``least`` values.

    mean, std, sum, min, max, skew, kurt, mad (mean deviation from the mean) or median; rank: percentile among them;
    corr: with ``y``; beta: covariance with ``y`` over its variance. corr and beta use rows that have both.
    """

    name: str
    how: str
    x: str
    n: int
    least: int
    y: str | None = None


def _windows(v: np.ndarray, n: int, fill=0) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, fill, v.dtype), v]), n)


class _Series:
    """A ticker's column, or a pair's rows that have both, with windows centred at their newest value.

    Centring keeps windows of one value free of rounding, so their spread is exactly 0.
    """

    def __init__(self, v: np.ndarray, known: np.ndarray, n: int):
        self.v, self.known = np.where(known, v, 0.0), known
        last = np.maximum.accumulate(np.where(known, np.arange(len(v)), -1))
        self.newest = np.where(last >= 0, self.v[last], 0.0)
        self.inside, self.rows = _windows(known, n, False), _windows(self.v, n)
        self.count = self.inside.sum(1)

    def _masked(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.inside, x, 0.0)

    def summed(self) -> np.ndarray:
        """Sums from the oldest value to the newest, as a window expression adds them, so both round alike."""
        total = np.zeros(len(self.v))
        for j in range(self.rows.shape[1]):
            total += self.rows[:, j]
        return total

    def centred(self) -> np.ndarray:
        """Windows less their mean; 0 where there is no value."""
        if not hasattr(self, "_centred"):
            near = self._masked(self.rows - self.newest[:, None])
            self._centred = self._masked(near - (near.sum(1) / self.count)[:, None])
        return self._centred


def trailing_values(columns: dict[str, tuple[np.ndarray, np.ndarray]], asked: list[Trailing]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(values, whether known) of each figure, for one ordered series of (values, whether known) a column."""
    held: dict[tuple, _Series] = {}
    out = {}

    def series(x: str, n: int, y: str | None = None) -> _Series:
        if (x, n, y) not in held:
            known = columns[x][1] if y is None else columns[x][1] & columns[y][1]
            held[x, n, y] = _Series(columns[x][0], known, n)
        return held[x, n, y]

    for a in sorted(asked, key=lambda a: (a.n, a.x)):
        if a.how in ("median", "rank"):
            window = pd.Series(np.where(columns[a.x][1], columns[a.x][0], np.nan)).rolling(a.n, min_periods=a.least)
            value = (window.median() if a.how == "median" else window.rank(method="average", pct=True)).to_numpy()
            out[a.name] = value, ~np.isnan(value)
            continue
        s = series(a.x, a.n, a.y)
        enough = s.count >= a.least
        if a.how in ("sum", "mean"):
            value = s.summed() / (s.count if a.how == "mean" else 1)
        elif a.how == "min":
            value = np.fmin.reduce(np.where(s.inside, s.rows, np.inf), axis=1)
        elif a.how == "max":
            value = np.where(s.inside, s.rows, -np.inf).max(1)
        else:
            c = s.centred()
            squares = np.einsum("ij,ij->i", c, c)
            if a.how == "std":
                value, enough = np.sqrt(squares / (s.count - 1)), enough & (s.count > 1)
            elif a.how == "mad":
                value = np.abs(c).sum(1) / s.count
            elif a.how == "skew":
                value, enough = np.sqrt(s.count) * np.einsum("ij,ij,ij->i", c, c, c) / np.sqrt(squares**3), enough & (squares != 0)
            elif a.how == "kurt":
                value, enough = s.count * np.einsum("ij,ij,ij,ij->i", c, c, c, c) / squares**2 - 3, enough & (squares != 0)
            else:
                d = series(a.y, a.n, a.x).centred()
                both, other = np.einsum("ij,ij->i", c, d), np.einsum("ij,ij->i", d, d)
                spread = other if a.how == "beta" else np.sqrt(squares / s.count) * np.sqrt(other / s.count) * s.count
                value, enough = both / spread, enough & (spread != 0) & (s.count > (a.how == "beta"))
        out[a.name] = value, enough
        for key in [k for k in held if k[1] < a.n]:
            del held[key]
    return out


def _in_blocks(columns: dict[str, tuple[np.ndarray, np.ndarray]], asked: list[Trailing], n_rows: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    if n_rows <= BLOCK_ROWS:
        return trailing_values(columns, asked)
    before, parts = max(a.n for a in asked) - 1, []
    for start in range(0, n_rows, BLOCK_ROWS):
        from_row = max(0, start - before)
        piece = {k: (v[from_row : start + BLOCK_ROWS], known[from_row : start + BLOCK_ROWS]) for k, (v, known) in columns.items()}
        parts.append({k: (v[start - from_row :], known[start - from_row :]) for k, (v, known) in trailing_values(piece, asked).items()})
    return {a.name: tuple(np.concatenate([p[a.name][i] for p in parts]) for i in (0, 1)) for a in asked}


def add_trailing(df: DataFrame, asked: list[Trailing], by: str = "ticker", on: str = "date") -> DataFrame:
    """``df`` with a column for each figure, ordered by ``on`` within ``by``. Give it narrow rows: all columns pass through."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by(on)
        columns = {x: (rows[x].cast(pa.float64()).to_numpy().astype(float), ~rows[x].is_null().to_numpy()) for x in {c for a in asked for c in (a.x, a.y) if c}}
        with np.errstate(all="ignore"):
            made = _in_blocks(columns, asked, rows.num_rows)
        for a in asked:
            value, known = made[a.name]
            rows = rows.append_column(a.name, pa.array(value, mask=~known))
        return rows

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{a.name}` double" for a in asked])
    return df.groupBy(by).applyInArrow(run, schema)

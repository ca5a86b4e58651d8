"""Column expressions over a ``(date, ticker)`` panel: guarded arithmetic, trailing windows, ranks.

NULL is the only missing value. Trailing windows count rows; an aggregate is NULL until ``least`` non-null values are
in its frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from stratapanel.operators.rolling import Trailing

EPS = 1e-9
#: Frames of so many rows or more are left to one grouped pass where ``grouped`` asks for it.
LONG = 20
_ASKED: ContextVar[dict[tuple, Trailing] | None] = ContextVar("asked", default=None)


@contextmanager
def grouped() -> Iterator[dict[tuple, Trailing]]:
    """Within it, figures over long trailing frames of named columns become columns of ``operators.rolling.add_trailing``, which are gathered in the dictionary it gives."""
    asked: dict[tuple, Trailing] = {}
    token = _ASKED.set(asked)
    try:
        yield asked
    finally:
        _ASKED.reset(token)


def _ask(how: str, x: str | Column, n: int, least: int | None, y: str | Column | None = None) -> Column | None:
    """The column of a figure that the grouped pass makes; None if a window is to make it."""
    asked = _ASKED.get()
    if asked is None or n < LONG or isinstance(x, Column) or isinstance(y, Column):
        return None
    key = (how, x, n, n if least is None else least, y)
    return F.col(asked.setdefault(key, Trailing("__" + "_".join(str(k) for k in key), how, x, n, key[3], y)).name)


def by_ticker():
    """A ticker's rows in time order. Windows need a session, so they are made when a plan is built."""
    return Window.partitionBy("ticker").orderBy("date")


def all_rows():
    return by_ticker().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def so_far():
    return by_ticker().rowsBetween(Window.unboundedPreceding, 0)


def by_day():
    return Window.partitionBy("date")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a), col(b))


def nonzero(x: str | Column) -> Column:
    return F.nullif(col(x), F.lit(0.0))


def clip(x: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """x held between bounds; NULL stays NULL."""
    x = col(x)
    out = x
    if low is not None:
        out = F.when(x < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(x > high, F.lit(float(high))).otherwise(out)
    return out


def rounded(x: str | Column, digits: int) -> Column:
    """``x`` to so many decimals, halves away from 0, by scaling as SQL engines do; too large to be scaled, it stays.

    Spark's own function rounds the shortest decimal text of a value, which takes a half for one that scaling doesn't,
    and the other way round.
    """
    x, scale = col(x), F.lit(10.0**digits)
    made = F.round(x * scale) / scale
    return F.when(F.abs(made) < float("inf"), made).otherwise(x)


def rows(n: int):
    return by_ticker().rowsBetween(1 - n, 0)


_HOW = {"avg": "mean", "stddev_samp": "std", "sum": "sum", "min": "min", "max": "max", "skewness": "skew", "kurtosis": "kurt"}


def roll(agg: Callable[[Column], Column], x: str | Column, n: int, least: int | None = None) -> Column:
    made = _ask(_HOW[agg.__name__], x, n, least) if agg.__name__ in _HOW else None
    if made is not None:
        return made
    x = col(x)
    return F.when(F.count(x).over(rows(n)) >= (n if least is None else least), agg(x).over(rows(n)))


def mean(x, n: int, least: int | None = None) -> Column:
    return roll(F.avg, x, n, least)


def std(x, n: int, least: int | None = None) -> Column:
    return roll(F.stddev_samp, x, n, least)


def median(x, n: int, least: int | None = None) -> Column:
    """Median of a trailing frame: one sorted array a row, which costs less than a percentile a frame."""
    made = _ask("median", x, n, least)
    if made is not None:
        return made
    x = col(x)
    held = F.array_sort(F.collect_list(x).over(rows(n)))
    middle = lambda h: (F.get(h, F.floor((F.size(h) - 1) / 2).cast("int")) + F.get(h, F.floor(F.size(h) / 2).cast("int"))) / 2
    return F.when(F.count(x).over(rows(n)) >= (n if least is None else least), F.transform(F.array(held), middle)[0])


def mean_deviation(x: str, n: int) -> Column:
    """Mean distance of a full trailing frame's values from their mean."""
    made = _ask("mad", x, n, None)
    if made is not None:
        return made
    held, middle = F.collect_list(x).over(rows(n)), F.avg(x).over(rows(n))
    return F.when(F.count(x).over(rows(n)) >= n, F.aggregate(F.transform(held, lambda v: F.abs(v - middle)), F.lit(0.0), lambda s, v: s + v) / n)


def trailing_rank(x: str, n: int) -> Column:
    """Average-tie percentile rank of a row's value in its full trailing frame."""
    made = _ask("rank", x, n, None)
    if made is not None:
        return made
    held = F.collect_list(x).over(rows(n))
    below, same = F.size(F.filter(held, lambda v: v < F.col(x))), F.size(F.filter(held, lambda v: v == F.col(x)))
    return F.when(F.count(x).over(rows(n)) >= n, (below + (same + 1) / 2) / n)


def zscore(x, n: int, least: int | None = None, eps: float = EPS) -> Column:
    if _ask("mean", x, n, least) is not None:
        return div(col(x) - mean(x, n, least), std(x, n, least) + eps)
    x, frame = col(x), rows(n)
    score = div(x - F.avg(x).over(frame), F.stddev_samp(x).over(frame) + eps)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), score)


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(col(x), n).over(by_ticker())


def lead(x: str | Column, n: int = 1) -> Column:
    return F.lead(col(x), n).over(by_ticker())


def diff(x: str | Column, n: int = 1) -> Column:
    return col(x) - lag(x, n)


def change(x: str | Column, n: int) -> Column:
    """Relative change over n rows of a column without gaps."""
    return div(x, lag(x, n)) - 1


def filled(x: str | Column) -> Column:
    """The last value that is not null, in time order."""
    return F.last(col(x), ignorenulls=True).over(so_far())


def mean_rank(x: str | Column, by: tuple[str, ...]) -> Column:
    """Average-tie rank within a group: half of the rank and of the number of values up to this one.

    Both are windows of one partitioning and order, so ties cost no shuffle of their own.
    """
    x = col(x)
    order = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    return (F.rank().over(order) + F.count(x).over(order)) / 2.0


def pct_rank(x: str | Column, by: tuple[str, ...] = ("date",)) -> Column:
    """Average-tie rank in its group divided by the number of values; NULL stays NULL."""
    x = col(x)
    return F.when(x.isNotNull(), mean_rank(x, by) / F.count(x).over(Window.partitionBy(*by)))


def adjusted_skew(x: str | Column, n: int) -> Column:
    """Bias-corrected skewness of a full trailing frame."""
    return roll(F.skewness, x, n) * ((n * (n - 1)) ** 0.5 / (n - 2))


def adjusted_kurtosis(x: str | Column, n: int) -> Column:
    """Bias-corrected excess kurtosis of a full trailing frame."""
    return ((n + 1) * roll(F.kurtosis, x, n) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def rolling_corr(x: str | Column, y: str | Column, n: int, least: int | None = None) -> Column:
    """Correlation of the rows of a trailing frame that have both values; NULL where either is constant."""
    made = _ask("corr", x, n, least, y)
    if made is not None:
        return made
    x, y = col(x), col(y)
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    frame = rows(n)
    spread = F.stddev_pop(a).over(frame) * F.stddev_pop(b).over(frame)
    return F.when(F.count(a).over(frame) >= (least or n), div(F.covar_pop(a, b).over(frame), spread))

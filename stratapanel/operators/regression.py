"""Least squares with many columns for many groups at once, p-values, and the unit-root test with lags.

A group's products are summed up in one aggregation (the Gram matrix), so its rows never meet in a task; solving is a
step over one row a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Large-sample critical values of the unit-root test with a constant.
CRITICAL = {"1%": -3.43, "5%": -2.86, "10%": -2.57}
#: Steps of the continued fraction; it converges in far fewer for the degrees of freedom of daily series.
FRACTION_STEPS = 200


def log_gamma(x: Column) -> Column:
    """Stirling's series of the logarithm of the gamma function, shifted up by seven."""
    y = x + 7
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    shift = sum((F.ln(x + i) for i in range(7)), F.lit(0.0))
    return (y - 0.5) * F.ln(y) - y + 0.5 * F.lit(float(np.log(2 * np.pi))) + series - shift


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function, by its continued fraction, within code generation."""
    a, b, x = (c.cast("double") for c in (a, b, x))

    def fraction(a: Column, b: Column, x: Column) -> Column:
        tiny = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
        d = 1 / tiny(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))

        def step(s: Column, m: Column) -> Column:
            m = m.cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d1, c1 = 1 / tiny(1 + even * s["d"]), tiny(1 + even / s["c"])
            d2, c2 = 1 / tiny(1 + odd * d1), tiny(1 + odd / c1)
            return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), start, step, lambda s: s["h"])

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    below = front * fraction(a, b, x) / a
    above = 1 - front * fraction(b, a, 1 - x) / b
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), below).otherwise(above)


def t_p_value(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of a t-value; NULL without a degree of freedom."""
    return F.when(freedom > 0, incomplete_beta(freedom / 2, F.lit(0.5), freedom / (freedom + t * t)))


def line(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """(by..., n, slope, intercept, r, p_value, std_err) of y on x in each group, in one pass.

    Rows with a gap are left out. The slope is NULL with fewer than two rows or a constant x; with two rows, or a line
    that fits exactly, the p-value is 0 unless the slope is 0 too.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    sums = df.groupBy(*by).agg(F.count(px).alias("n"), F.avg(px).alias("mx"), F.avg(py).alias("my"), F.var_pop(px).alias("vx"), F.var_pop(py).alias("vy"), F.covar_pop(px, py).alias("cxy"))
    slope, r = F.try_divide(F.col("cxy"), F.nullif("vx", F.lit(0.0))), F.try_divide(F.col("cxy"), F.sqrt(F.nullif(F.col("vx") * F.col("vy"), F.lit(0.0))))
    rows = sums.where("n >= 2").select(*by, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("r"), F.try_divide("vy", F.nullif("vx", F.lit(0.0))).alias("ratio"))
    freedom = (F.col("n") - 2).cast("double")
    rest = 1 - F.coalesce(F.col("r"), F.lit(0.0)) ** 2
    std_err = F.when(freedom > 0, F.sqrt(F.try_divide(rest * F.col("ratio"), freedom)))
    p = F.when(F.col("slope").isNull(), F.lit(None)).when(F.col("slope") == 0, F.lit(1.0)).when((rest <= 0) | (freedom <= 0), F.lit(0.0)).otherwise(incomplete_beta(freedom / 2, F.lit(0.5), rest))
    return rows.select(*by, "n", "slope", "intercept", "r", p.alias("p_value"), std_err.alias("std_err"))


def gram(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., rows, products): the sums of products of all pairs of columns (upper triangle, row by row) over rows without a gap."""
    whole = df.dropna(subset=list(columns))
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]]
    return whole.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.array(*products).alias("products"))


def solved(products: Sequence[float], n: int, columns: Sequence[int], rows: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, their standard errors, sum of squared rests) of the last of ``n`` columns on the given ones."""
    full = np.zeros((n, n))
    full[np.triu_indices(n)] = products
    full = full + np.triu(full, 1).T
    xx, xy, yy = full[np.ix_(columns, columns)], full[columns, -1], full[-1, -1]
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    inverse = np.linalg.pinv(xx / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inverse @ xy
    rest = max(float(yy - beta @ xy), 0.0)
    freedom = rows - len(columns)
    return beta, np.sqrt(np.maximum(np.diag(inverse), 0) * rest / freedom) if freedom > 0 else np.full(len(columns), np.nan), rest


def unit_root(df: DataFrame, x: str, by: str = "ticker", order: str = "date", most_lags: int = 4, least: int = 30) -> DataFrame:
    """(by, n, lags, statistic, stationary) of each series: the change on a constant, the last level and up to ``most_lags`` changes.

    All numbers of lags are fitted to the same rows, those with ``most_lags`` changes before; the information criterion
    of Akaike chooses, ties go to fewer. Series with fewer than ``least`` such rows, or without movement, have NULL.
    """
    series = Window.partitionBy(by).orderBy(order)
    rows = df.select(by, order, F.col(x).cast("double").alias("level")).where("level is not null")
    rows = rows.withColumn("before", F.lag("level").over(series)).withColumn("change", F.col("level") - F.col("before"))
    names = [f"change_{i}" for i in range(1, most_lags + 1)]
    rows = rows.select(by, F.lit(1.0).alias("one"), "before", *(F.lag("change", i).over(series).alias(n) for i, n in enumerate(names, 1)), "change")
    # levels are centred by their first value: the test has a constant, so it does not change, and products stay exact
    first = F.first("before", ignorenulls=True).over(Window.partitionBy(by))
    rows = rows.withColumn("before", F.col("before") - first)
    columns = ["one", "before", *names, "change"]
    sums = gram(rows, columns, [by])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, n, products in zip(batch[by], batch["rows"], batch["products"], strict=True):
                best = None
                for lags in range(most_lags + 1) if n >= least else ():
                    beta, error, rest = solved(products, len(columns), list(range(2 + lags)), n)
                    if rest > 0 and error[1] > 0:
                        criterion = n * np.log(rest / n) + 2 * (2 + lags)
                        if best is None or criterion < best[0] - 1e-9:
                            best = (criterion, lags, beta[1] / error[1])
                out.append((key, n, best and best[1], best and float(best[2])))
            yield pd.DataFrame(out, columns=[by, "n", "lags", "statistic"]).astype({"lags": "Int64", "statistic": "float64"})

    kind = dict(df.dtypes)[by]
    return sums.mapInPandas(run, f"{by} {kind}, n long, lags long, statistic double").withColumn("stationary", F.col("statistic") < CRITICAL["5%"])

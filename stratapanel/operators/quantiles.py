"""Exact quantiles of a whole column, without the column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a pass, and rows of a bin that are sorted to look its values up.
BINS, SORTED_ROWS = 4096, 10_000


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """The quantiles of a column's values (NULL left out, NaN the largest), with linear steps between neighbours; None without a value.

    A pass counts values by bin with each bin's extremes; only bins that hold a wanted place are looked at again, finer,
    until they hold one value or few enough rows to sort. So the driver sees a row a bin, and a task never more than its
    own rows. ``df`` is read a few times: give it a stored table.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    finite = values.where(~F.isnan("x") & (F.abs("x") < float("inf")))
    row = values.agg(F.count(F.lit(1)), F.count_if(F.col("x") == float("-inf")), F.count_if(F.col("x") == float("inf"))).first()
    n, low, high = map(int, row)
    if not n:
        return [None] * len(shares)
    bounds = finite.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    places = {q: (math.floor(q * (n - 1)), math.ceil(q * (n - 1))) for q in shares}
    found: dict[int, float] = {}
    wanted = set()
    for k in {k for pair in places.values() for k in pair}:
        if low <= k < low + bounds[0]:
            wanted.add(k - low)
        else:
            found[k] = float("-inf") if k < low else float("inf") if k < low + bounds[0] + high else float("nan")
    found |= {k + low: x for k, x in _at(finite, wanted, bounds[1], bounds[2]).items()} if wanted else {}
    out = []
    for q in shares:
        a, b = places[q]
        part = q * (n - 1) - a
        out.append(found[a] if found[a] == found[b] or not part else found[a] * (1 - part) + found[b] * part)
    return out


def _at(values: DataFrame, places: set[int], least: float, most: float) -> dict[int, float]:
    """The values at places (from 0) of the sorted values, all finite and between ``least`` and ``most``."""
    if least == most:
        return dict.fromkeys(places, least)
    half = 1.0 if math.isfinite(most - least) else 0.5
    share = (F.col("x") * half - least * half) / (most * half - least * half)
    bins = values.groupBy(F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most")).orderBy("bin").collect()
    found, before = {}, 0
    for b in bins:
        here = {k - before for k in places if before <= k < before + b["n"]}
        if here:
            rows = values.where(F.col("x").between(b["least"], b["most"]))
            if b["n"] <= SORTED_ROWS:
                ordered = sorted(r[0] for r in rows.collect())
                inner = {k: ordered[k] for k in here}
            else:
                inner = _at(rows, here, b["least"], b["most"])
            found |= {k + before: x for k, x in inner.items()}
        before += b["n"]
    return found

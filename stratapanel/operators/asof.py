"""As-of joins as one ordered window over the union of both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, fields: list[str], tolerance_days: int | None = None, exact: bool = True, matched_on: str | None = None) -> DataFrame:
    """Each left row with ``fields`` of the latest right row of its key at or before it (before it, if not ``exact``).

    Both sides are unioned, so rows of a key meet by one shuffle and no pair is made; on equal times the right row
    comes first. Fields of one right row stay together, nulls included. Several right rows of one key and time: the
    largest struct of fields wins. ``matched_on`` names a column for the right row's time.
    """
    order = 0 if exact else 2
    mine = left.withColumn("__side", F.lit(1)).withColumn("__right", F.lit(None).cast(_struct(right, on, fields)))
    theirs = right.select(by, on, F.struct(F.col(on).alias("__on"), *fields).alias("__right")).withColumn("__side", F.lit(order))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    latest = Window.partitionBy(by).orderBy(on, "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__right", F.last("__right", ignorenulls=True).over(latest)).where("__side = 1")
    if tolerance_days is not None:
        found = found.withColumn("__right", F.when(F.datediff(F.col(on), F.col("__right.__on")) <= tolerance_days, F.col("__right")))
    more = [F.col("__right.__on").alias(matched_on)] if matched_on else []
    return found.select(*left.columns, *(F.col(f"__right.{f}").alias(f) for f in fields), *more)


def _struct(right: DataFrame, on: str, fields: list[str]) -> str:
    kinds = dict(right.dtypes)
    return "struct<" + ",".join(f"`{n}`:{kinds[c]}" for n, c in (("__on", on), *((f, f) for f in fields))) + ">"

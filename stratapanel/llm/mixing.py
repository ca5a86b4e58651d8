"""Mixing sources to target weights by Pivotal dependent rounding, in DataFrame operations only.

A source's target divided by its size is the copy rate of its rows: the whole part is certain, the fraction is
rounded. Fractions of rows of one source are paired; a random transfer that keeps the words of the pair makes one
of them 0 or 1. Rows are dealt to small groups, each leaves one row with a fraction, and these go to the groups
of the next level, until each source has one left; that one is rounded to the nearer side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.llm.common import materialised

#: Rows that are rounded together, on average.
GROUP = 48
#: Weights of the sources in code point order, repeating; the share of all words that is taken; copies at most.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: The table of targets is broadcast up to so many sources.
BROADCAST_SOURCES = 10_000
_EDGE = 1e-9


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Sources weigh as ``weights`` repeat in code point order, null last. A target above ``most`` times its source
    is cut to that and the excess reshared by weight; the cut sources are those with the least size a weight,
    so one pass over the sources in that order finds the level. Windows here run over one row a source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = by_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(most))
    order = Window.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(share)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", F.when(F.col("limit") / F.col("weight") > level, level))
    level = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(level.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), level * F.col("weight")))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def _draw(a: Column, b: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on two keys."""
    return F.pmod(F.xxhash64(a, b, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _paired(seed: int):
    """One step of rounding: the state's open row against the next row."""

    def step(state: Column, item: Column) -> Column:
        held = state["open"]
        w, v, f, g = held["size"], item["size"], held["part"], item["part"]
        up = F.least((1.0 - f) * w, g * v)
        down = F.least(f * w, (1.0 - g) * v)
        moved = F.when(_draw(held["key"], item["key"], seed) * (up + down) < down, up).otherwise(-down)
        first = F.struct(held["key"].alias("key"), w.alias("size"), _snapped(f + moved / w).alias("part"))
        second = F.struct(item["key"].alias("key"), v.alias("size"), _snapped(g - moved / v).alias("part"))
        is_open = (first["part"] > 0) & (first["part"] < 1)
        paired = F.struct(F.when(is_open, first).otherwise(second).alias("open"), F.concat(state["done"], F.array(F.when(is_open, second).otherwise(first))).alias("done"))
        return F.when(held.isNull(), F.struct(item.alias("open"), state["done"].alias("done"))).otherwise(paired)

    return step


def _snapped(part: Column) -> Column:
    return F.when(part < _EDGE, 0.0).when(part > 1 - _EDGE, 1.0).otherwise(part)


def _rounded(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """(source, key, size, part) with at most one open row a group, of rows (source, key, size, part, group)."""
    item = "struct<key:bigint,size:double,part:double>"
    items = F.transform(F.array_sort(F.collect_list(F.struct("size", "key", "part"))), lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"), x["part"].alias("part")))
    start = F.struct(F.lit(None).cast(item).alias("open"), F.array().cast(f"array<{item}>").alias("done"))
    grouped = rows.groupBy("source", "group").agg(items.alias("items"))
    grouped = grouped.select("source", F.aggregate("items", start, _paired(seed + level)).alias("state"))
    every = F.concat(F.col("state.done"), F.array(F.col("state.open")))
    return grouped.select("source", F.explode(every).alias("x")).select("source", "x.key", "x.size", "x.part")


def mix(rows: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of each row (doc_id, source, size).

    Copies of a row are its source's rate, rounded to either side, at most 2. Rows that are alike in id, source
    and size are rounded as one item and share its copies as evenly as they can be. Rows of size 0 take no part in the
    rounding and get the whole part of the rate, as no words depend on them. Null ids and sources are values
    like any other; an empty table gives an empty result. The draws depend on ids, sizes and the seed only, so
    reruns agree.
    """
    alike = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    small = targets.count() <= BROADCAST_SOURCES
    joined = alike.alias("a").join((F.broadcast(targets) if small else targets).alias("t"), F.col("a.source").eqNullSafe(F.col("t.source")), "left").select("a.*", "t.source_size", "t.target")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(MOST))).otherwise(0.0)
    wanted = joined.withColumn("wanted", rate * F.col("rows"))
    whole = F.floor(F.col("wanted") + _EDGE)
    items = materialised(
        wanted.withColumn("whole", whole).withColumn("part", F.when(F.col("size") > 0, _snapped(F.col("wanted") - whole)).otherwise(0.0)).withColumn("key", F.xxhash64("doc_id", "source", "size", F.lit(seed))).drop("wanted")
    )
    open_rows = items.where("part > 0 and part < 1").select("source", "key", F.col("size").cast("double").alias("size"), "part")
    most = open_rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    taken, level = None, 0
    while most:
        groups = math.ceil(most / GROUP)
        group = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(groups))
        done = materialised(_rounded(open_rows.withColumn("group", group), level, seed))
        closed = done.where("part <= 0 or part >= 1") if groups > 1 else done.withColumn("part", F.round("part"))
        closed = closed.where("part >= 1").select("source", "key", "size")
        taken = closed if taken is None else taken.union(closed)
        open_rows, level = done.where("part > 0 and part < 1"), level + 1
        most = groups if groups > 1 else 0
    if taken is None:
        taken = open_rows.select("source", "key", "size")
    more = taken.groupBy("key").agg(F.count(F.lit(1)).alias("more"))
    copies = items.join(more, "key", "left").withColumn("copies", F.col("whole") + F.coalesce("more", F.lit(0)))
    each = copies.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    base = F.floor(F.col("copies") / F.col("rows"))
    count = base + (F.col("nth") <= F.col("copies") - base * F.col("rows")).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", count.alias("copies"))


def mixed_rows(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The rows of ``docs`` (with doc_id, text and source) repeated by their copies; all columns are kept, whatever their names.

    Rows alike in id, source and size share their copies in the order of a hash of their text.
    """
    own = [c if c in ("doc_id", "text", "source") else f"own{i}" for i, c in enumerate(docs.columns)]
    sized = docs.toDF(*own).withColumn("__size", word_count(F.col("text")))
    rows = sized.select("doc_id", "source", F.col("__size").alias("size"))
    counts = mix(rows, materialised(source_targets(rows)), seed)
    key = F.xxhash64("doc_id", "source", "size")
    lists = materialised(counts.groupBy(key.alias("__key")).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")).where("__copies > 0"))
    joined = sized.withColumn("__key", F.xxhash64("doc_id", "source", "__size")).join(lists, "__key")
    nth = F.lit(1)
    if lists.where("__rows > 1").limit(1).count():
        nth = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64("text")))
    base = F.floor(F.col("__copies") / F.col("__rows"))
    joined = joined.withColumn("__nth", nth)
    times = base + (F.col("__nth") <= F.col("__copies") - base * F.col("__rows")).cast("long")
    return joined.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*own).toDF(*docs.columns)

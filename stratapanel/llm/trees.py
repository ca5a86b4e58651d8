"""Tree ensembles of the built-in learners as plain column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)|Predict: (\S+)")


def tree_column(description: str, features: Column) -> Column:
    """The prediction of one tree, given its ``toDebugString`` and an array column of its features."""
    steps = iter(m.groups() for line in description.splitlines() if (m := _LINE.search(line)))

    def node() -> Column:
        kind, feature, _, limit, leaf = next(steps)
        if kind is None:
            return F.lit(float(leaf))
        below = node()
        next(steps)
        return F.when(features[int(feature)] <= F.lit(float(limit)), below).otherwise(node())

    return node()


def _levels(description: str) -> tuple[list[int], list[float], list[float]]:
    """(feature, limit) of the inner nodes of a tree level by level, and its leaves; a leaf above the lowest level is repeated below."""
    steps = [m.groups() for line in description.splitlines() if (m := _LINE.search(line))]

    def node(at: int) -> tuple[tuple | float, int]:
        kind, feature, _, limit, leaf = steps[at]
        if kind is None:
            return float(leaf), at + 1
        below, at = node(at + 1)
        above, at = node(at + 1)  # after the line of the other side
        return (int(feature), float(limit), below, above), at

    level: list = [node(0)[0]]
    features, limits = [], []
    while any(isinstance(x, tuple) for x in level):
        inner = [x if isinstance(x, tuple) else (0, 1e308, x, x) for x in level]
        features += [x[0] for x in inner]
        limits += [x[1] for x in inner]
        level = [y for x in inner for y in x[2:]]
    return features, limits, level


def boosted_probability(model, features: Column) -> Column:
    """Probability of class 1 from a fitted gradient-boosted classifier.

    The trees are one constant and a row walks down them by level, so plans don't grow with their nodes.
    """
    rows = [dict(zip(("feature", "limit", "leaf"), _levels(t.toDebugString), strict=True)) | {"weight": float(w)} for t, w in zip(model.trees, model.treeWeights, strict=True)]
    trees = F.from_json(F.lit(json.dumps(rows)), "array<struct<feature:array<int>,limit:array<double>,leaf:array<double>,weight:double>>")

    def walked(total: Column, tree: Column) -> Column:
        down = lambda at, _: 2 * at + F.when(F.get(features, F.get(tree["feature"], at)) <= F.get(tree["limit"], at), 1).otherwise(2)
        inner = F.size(tree["feature"])
        steps = F.when(inner > 0, F.sequence(F.lit(1), F.floor(F.log2(inner + 1) + 0.5).cast("int"))).otherwise(F.array().cast("array<int>"))
        return total + tree["weight"] * F.get(tree["leaf"], F.aggregate(steps, F.lit(0), down) - inner)

    return 1.0 / (1.0 + F.exp(-2.0 * F.aggregate(trees, F.lit(0.0), walked)))


def forest_share(model, features: Column) -> Column:
    """Share of a fitted random forest's trees that vote for class 1."""
    votes = F.lit(0.0)
    for tree in model.trees:
        votes = votes + tree_column(tree.toDebugString, features)
    return votes / F.lit(float(len(model.trees)))


def isotonic(rows: list[tuple]) -> list[tuple[float, float]]:
    """(lowest score, probability) of the steps of the rising fit to labelled rows (score, label), by pooling neighbours that fall.

    A row may stand for several: (score, sum of their labels, their number).
    """
    pools: list[list[float]] = []
    for score, label, *n in sorted(rows):
        pools.append([score, label, n[0] if n else 1])
        while len(pools) > 1 and (pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2] or pools[-2][0] == pools[-1][0]):
            _, right, n = pools.pop()
            pools[-1][1] += right
            pools[-1][2] += n
    return [(score, right / n) for score, right, n in pools]


def calibrated_threshold(rows: list[tuple], probability: float, otherwise: float) -> float:
    """The lowest score whose calibrated probability, by the rows of ``isotonic``, is at least ``probability``; else ``otherwise``."""
    return next((score for score, p in isotonic(rows) if p >= probability), otherwise)


def located(text: Column, pattern: str) -> tuple[Column, Column]:
    """The pieces of a text between the matches of a pattern, and the matches, for ``spans``."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spans(pieces: Column, matches: Column, make: Callable[..., Column]) -> Column:
    """An array of make(start, match, piece before, piece after), start in code points.

    A running sum over the lengths of pieces and matches gives the starts. Both columns should be materialised by
    a select before, as they are used several times.
    """
    lengths = F.transform(matches, lambda m, i: F.struct(F.length(pieces[i]).cast("long").alias("gap"), F.length(m).cast("long").alias("own")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate(lengths, start, lambda s, x: F.struct((s["at"] + x["gap"] + x["own"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["gap"])).alias("starts")), lambda s: s["starts"])
    zipped = F.arrays_zip(starts.alias("a"), matches.alias("b"))
    return F.transform(zipped, lambda z, i: make(z["a"], z["b"], pieces[i], pieces[i + 1]))

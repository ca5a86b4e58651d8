"""Fill-in-middle transformation: texts are cut and rearranged as ropes, and rebuilt from their output.

A rope's leaves hold pieces of the text and cache how many units and code points they have; inner nodes hold the sums.
A text is split at two unit ranks, the three subtrees are joined in another order with sentinels between them. The
inverse builds a rope of the output, splits it where the sentinels stand and joins the parts in the old order. Units are
code points or the stretches that begin at each match of a pattern. A document is handled in the row it is in: no
shuffle, and an Arrow batch is bounded by bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import short_batches

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 documents so many are transformed, and of 100 transformed so many have the suffix first.
RATE, SPM_RATE = 90, 20
#: Code points of a leaf at most, unless one unit has more.
LEAF_POINTS = 1024


class Leaf:
    """A piece of text; ``starts`` are where its units begin, None if each code point is one. A sentinel has no unit."""

    __slots__ = ("text", "starts", "units", "points")

    def __init__(self, text: str, starts: list[int] | None = None):
        self.text, self.starts, self.points = text, starts, len(text)
        self.units = self.points if starts is None else len(starts)

    def cut(self, rank: int, by_points: bool) -> tuple[Leaf, Leaf]:
        if self.starts is None:
            return Leaf(self.text[:rank]), Leaf(self.text[rank:])
        at = rank if by_points else self.starts[rank]
        first = bisect_left(self.starts, at)
        return Leaf(self.text[:at], self.starts[:first]), Leaf(self.text[at:], [s - at for s in self.starts[first:]])


class Node:
    """Two ropes, one after the other."""

    __slots__ = ("left", "right", "units", "points")

    def __init__(self, left: Rope, right: Rope):
        self.left, self.right, self.units, self.points = left, right, left.units + right.units, left.points + right.points


Rope = Leaf | Node


def joined(*ropes: Rope) -> Rope:
    """The ropes one after the other, as a balanced tree over them; empty ones are left out."""
    parts = [r for r in ropes if r.points] or [Leaf("", [])]
    while len(parts) > 1:
        parts = [Node(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def rope(text: str, unit: re.Pattern | None = None, leaf_points: int = LEAF_POINTS) -> Rope:
    """A balanced rope of a text. With a pattern a unit goes from one match to the next; what is before the first belongs to the first."""
    if unit is None:
        return joined(*(Leaf(text[i : i + leaf_points]) for i in range(0, len(text), leaf_points)))
    starts = [m.start() for m in unit.finditer(text) if m.end() > m.start()]
    if text:
        starts = [0, *starts[1:]]
    leaves, i = [], 0
    while i < len(starts):
        j = max(i + 1, bisect_left(starts, starts[i] + leaf_points, i))
        end = starts[j] if j < len(starts) else len(text)
        leaves.append(Leaf(text[starts[i] : end], [s - starts[i] for s in starts[i:j]]))
        i = j
    return joined(*leaves)


def split(tree: Rope, rank: int, by_points: bool = False) -> tuple[Rope, Rope]:
    """The rope before and from a unit rank (or a rank of code points): only the nodes on the way down are made anew."""
    size = "points" if by_points else "units"
    left, right = [], []
    while True:
        if rank <= 0 or rank >= getattr(tree, size):
            (right if rank <= 0 else left).append(tree)
            break
        if isinstance(tree, Leaf):
            a, b = tree.cut(rank, by_points)
            left.append(a)
            right.append(b)
            break
        before = getattr(tree.left, size)
        if rank < before:
            right.append(tree.right)
            tree = tree.left
        else:
            left.append(tree.left)
            tree, rank = tree.right, rank - before
    return joined(*left), joined(*reversed(right))


def leaves(tree: Rope) -> Iterator[Leaf]:
    waiting = [tree]
    while waiting:
        tree = waiting.pop()
        if isinstance(tree, Leaf):
            yield tree
        else:
            waiting += [tree.right, tree.left]


def said(tree: Rope) -> str:
    return "".join(leaf.text for leaf in leaves(tree))


@dataclass(frozen=True)
class Rule:
    """How texts are transformed: unit pattern (None: code points), sentinels of prefix, suffix and middle, rates in 100, salt of the hash of ids."""

    unit: str | None = None
    sentinels: tuple[str, str, str] = SENTINELS
    rate: int = RATE
    spm_rate: int = SPM_RATE
    salt: str = "1:"
    leaf_points: int = LEAF_POINTS

    def __post_init__(self):
        for a in self.sentinels:
            for b in self.sentinels:
                if not a or a != b and a in b or any(b.startswith(a[i:]) for i in range(1, len(a))) or self.sentinels.count(a) > 1:
                    raise ValueError("sentinels must be distinct, and none may hold or overlap another or itself")


def arranged(text: str, rule: Rule, cuts: tuple[int, int], form: str, unit: re.Pattern | None = None) -> tuple[str, int, int]:
    """(output, code points of the prefix, of the middle) of a text cut before two unit ranks."""
    head, suffix = split(rope(text, unit, rule.leaf_points), max(cuts))
    prefix, middle = split(head, min(cuts))
    p, s, m = (Leaf(x, []) for x in rule.sentinels)
    parts = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    return said(joined(*parts)), prefix.points, middle.points


def restored(output: str, form: str, rule: Rule) -> str:
    """The text that ``arranged`` made this output of; plain outputs are texts."""
    if form == "plain":
        return output
    p, s, m = rule.sentinels
    order, parts, rest, gone = ((p, s, m) if form == "psm" else (s, p, m)), {}, rope(output, None, rule.leaf_points), 0
    places = [output.index(x) for x in order]
    for x, after in zip(order, [*places[1:], len(output)], strict=True):
        part, rest = split(rest, after - gone, by_points=True)
        gone, parts[x] = after, split(part, len(x), by_points=True)[1]
    return said(joined(parts[p], parts[m], parts[s]))


def _draws(doc_id: Column, rule: Rule) -> list[Column]:
    """The first four groups of eight hexadecimal digits of the id's hash, as unsigned integers. A null id is hashed as an empty one."""
    digest = F.sha2(F.concat(F.lit(rule.salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(doc_id: Column, text: Column, rule: Rule = Rule()) -> Column:
    """A struct (n, form, prefix_chars, middle_chars, output) of each text; a null text is an empty one.

    ``n`` counts units. A text that is empty, holds a sentinel or falls outside the rate stays plain: it is its own
    output and the two lengths (in code points) are null.
    """

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def run(texts: pd.Series, h1: pd.Series, h2: pd.Series, h3: pd.Series, h4: pd.Series) -> pd.DataFrame:
        unit = None if rule.unit is None else re.compile(rule.unit)
        out = []
        for text, a, b, c, d in zip(texts, h1, h2, h3, h4, strict=True):
            n = len(text) if unit is None else rope(text, unit, rule.leaf_points).units
            if not text or c % 100 >= rule.rate or any(s in text for s in rule.sentinels):
                out.append((n, "plain", None, None, text))
                continue
            form = "spm" if d % 100 < rule.spm_rate else "psm"
            output, prefix, middle = arranged(text, rule, (a % (n + 1), b % (n + 1)), form, unit)
            out.append((n, form, prefix, middle, output))
        made = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return made.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return run(F.coalesce(text.cast("string"), F.lit("")), *_draws(doc_id, rule))


def rebuilt(output: Column, form: Column, rule: Rule = Rule()) -> Column:
    """The text of each output, from the output and its form alone; a null output stays null."""

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else restored(o, f, rule) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return run(output, form)


def fill_in_middle(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", name: str = "fim") -> DataFrame:
    """``docs`` with ``name``: the struct of ``transformed``.

    All rows and columns are kept, repeated rows with equal results; a column of that name is replaced. An empty table
    gives an empty one. Texts of any length are whole in one row; a rope's leaf is a kilobyte.
    """
    short_batches(docs.sparkSession)
    return docs.withColumn(name, transformed(F.col(id_col), F.col(text_col), rule))


def round_trip(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row: digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(docs.select(F.col(id_col), F.col(text_col)), rule, id_col, text_col, "__fim")
    again = made.select(id_col, "__fim.*").withColumn("__text", rebuilt(F.col("output"), F.col("form"), rule))
    return again.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("__text", 256).alias("restored_sha256"))

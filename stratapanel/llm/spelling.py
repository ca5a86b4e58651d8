"""Spelling variants: words that are one error apart, found with forward and backward minimal automata.

A word with one error has one half without it. So a word is looked up twice: its first half is matched exactly from the
front in an automaton of words and the rest completed with one error, and its second half exactly from the back in an
automaton of reversed words. Words are dealt by the half that must match, under the halves that words one shorter, as
long and one longer have, so partners meet in one group and each group builds two automata of its own words. A half
that very many words share is narrowed: the window that may hold the error is halved again, level by level, until the
group is small or the window is one code point, which few words can share. A pair is reported only in the window that
holds its leftmost error, so none is counted twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import materialised

# Fixed value: the letters of a run.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One of so many runs loses a code point; words have so many code points and occurrences at least; a form is so many times as frequent.
DROP_ONE_OF, LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 97, 5, 3, 2
#: Rows of a group on average; rows of a half from which it is narrowed; rows that a word has, about.
GROUP_ROWS, NARROW_AT, ROWS_PER_WORD = 16_000, 16_000, 6


class Automaton:
    """Minimal acyclic automaton of words in order. An edge skips as many words as come before those behind it, so the skips of a path sum to the number of its word."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._behind: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]
        last = ""

        def state_of(open_state: list) -> int:
            key = (open_state[0], tuple(open_state[1]))
            if key not in known:
                known[key] = len(self.edges)
                behind, edges = int(open_state[0]), {}
                for letter, to in open_state[1]:
                    edges[letter] = (to, behind)
                    behind += self._behind[to]
                self.edges.append(edges)
                self.final.append(open_state[0])
                self._behind.append(behind)
            return known[key]

        for word in words:
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            while len(path) > shared + 1:
                done = path.pop()
                path[-1][1].append((last[len(path) - 1], state_of(done)))
            path += ([False, []] for _ in range(len(word) - shared))
            path[-1][0] = True
            last = word
        while len(path) > 1:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], state_of(done)))
        self.root = state_of(path[0])

    def number(self, word: str, at: int = 0, state: int | None = None, number: int = 0) -> int:
        """The number of the word whose rest from ``at`` leads on from ``state``; -1 if there is none."""
        edges = self.edges
        state = self.root if state is None else state
        for i in range(at, len(word)):
            step = edges[state].get(word[i])
            if step is None:
                return -1
            state = step[0]
            number += step[1]
        return number if self.final[state] else -1

    def one_error(self, word: str, first: int, last: int) -> Iterator[int]:
        """Numbers of the words that differ from ``word`` by one error, whose leftmost place is from ``first`` to before ``last``; each once."""
        n, state, number = len(word), self.root, 0
        for i in range(min(last, n + 1)):
            edges = self.edges[state]
            own = word[i] if i < n else ""
            if i >= first:
                if own and (i + 1 == n or word[i + 1] != own) and (found := self.number(word, i + 1, state, number)) >= 0:
                    yield found
                for letter, (to, skip) in edges.items():
                    if letter != own:
                        if own and (found := self.number(word, i + 1, to, number + skip)) >= 0:
                            yield found
                        if (found := self.number(word, i, to, number + skip)) >= 0:
                            yield found
            if own not in edges:
                return
            state, skip = edges[own]
            number += skip


def _agreed(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _looked_up(group: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, form_n, form) of each lookup of a group; rows without ``ask`` are only found."""
    out = []
    for forward, rows in group.groupby(group["front"] >= group["back"]):
        turn = (lambda w: w) if forward else (lambda w: w[::-1])
        counts = dict(zip(map(turn, rows["word"]), rows["n"], strict=True))
        words = sorted(counts)
        automaton, n = Automaton(words), [counts[w] for w in words]
        asked = rows[rows["ask"]]
        for word, front, back, before in zip(asked["word"], asked["front"], asked["back"], asked["before"], strict=True):
            first, last = (front, before) if forward else (back, len(word) + 1)
            total, best_n, best = 0, 0, None
            for k in automaton.one_error(turn(word), first, last):
                near = turn(words[k])
                if forward or front <= _agreed(word, near) < before:
                    total += 1
                    if n[k] > best_n or n[k] == best_n and near < best:
                        best_n, best = n[k], near
            if total:
                out.append((word, total, best_n, best))
    return pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"])


def _narrowed(rows: DataFrame) -> DataFrame:
    """Rows by both halves of the window that may hold the error.

    A row has the exact lengths at the front and the back, and, if it asks, the place before which the leftmost error
    lies. A word is found under the windows that words one shorter, as long and one longer have; a window of one code
    point can't be halved, such a row stays and is ``fixed``.
    """
    window = F.length("word") - F.col("front") - F.col("back")

    def halves(w: Column) -> Column:
        ask, half = F.col("ask") & (w == window), F.floor(w / 2).cast("int")
        row = lambda front, back, before, fixed: F.struct(front.alias("front"), back.alias("back"), F.when(ask, before).otherwise(F.lit(0)).alias("before"), ask.alias("ask"), F.lit(fixed).alias("fixed"))
        front, back = F.col("front"), F.col("back")
        return F.when(w >= 2, F.array(row(front + half, back, F.col("before"), False), row(front, back + w - half, front + half, False))).otherwise(F.array(row(front, back, F.col("before"), True)))

    made = F.array_distinct(F.flatten(F.transform(F.array(window - 1, window, window + 1), halves)))
    rows = rows.select("word", "n", F.explode(made).alias("x")).select("word", "n", "x.*")
    key = F.xxhash64("front", "back", F.expr("left(word, front)"), F.expr("right(word, back)"))
    return rows.withColumn("key", key)


def one_error_apart(words: DataFrame, narrow_at: int = NARROW_AT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(word, n_near, form_n, form) of each word that has near words: their number, and the most frequent one (ties: the smallest).

    ``words`` has distinct (word, n); it is read several times, so it should be a written table. Null and empty words
    are left out. A group holds about ``group_rows`` rows and no half of more than ``narrow_at`` rows, unless its words
    differ in one place only.
    """
    words = words.where("word is not null and word <> ''")
    start = words.select("word", F.col("n").cast("long").alias("n"), F.lit(0).alias("front"), F.lit(0).alias("back"), (F.length("word") + 1).alias("before"), F.lit(True).alias("ask"))
    rows = _narrowed(start)
    while True:
        crowded = materialised(rows.where("not fixed").groupBy("key").count().where(F.col("count") > narrow_at).select("key"), narrow=True)
        if crowded.isEmpty():
            break
        finer = _narrowed(rows.join(crowded, "key", "left_semi").where("not fixed").drop("key", "fixed")).distinct()  # windows meet on several ways
        kept = rows.where("fixed").union(rows.where("not fixed").join(crowded, "key", "left_anti").select(rows.columns))
        rows = materialised(kept.union(finer.select(rows.columns)))
    groups = max(1, math.ceil(words.count() * ROWS_PER_WORD / group_rows))
    dealt = rows.select("word", "n", "front", "back", "before", "ask", F.pmod("key", F.lit(groups)).alias("group"))
    found = dealt.repartition(groups, "group").groupBy("group").applyInPandas(_looked_up, "word string, n_near long, form_n long, form string")
    most = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), most.alias("x")).select("word", "n_near", (-F.col("x.less")).alias("form_n"), "x.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each word's chain of forms. Chains double in each round; forms must not run in a circle."""
    at = materialised(forms.select("word", F.col("form").alias("root")), narrow=True)
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialised(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), narrow=True)
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_one_of: int = DROP_ONE_OF) -> DataFrame:
    """(word, n): runs of letters in lower case (A-Z only), of which one in ``drop_one_of`` (by a hash of id and run) loses a code point.

    Null texts have no runs; a null id counts as an empty one. Counts are summed up in each task before the shuffle.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    head = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"))
    runs = docs.select(head.alias("head"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("head", "run").cast("binary")).alias("h"))
    cut = F.pmod(F.col("h"), F.length("run")).cast("int")
    word = F.when(F.col("h") % drop_one_of == 0, F.concat(F.substr("run", F.lit(1), cut), F.substr("run", cut + 2))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def grouped(words: DataFrame, form_times: int = FORM_TIMES, narrow_at: int = NARROW_AT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct (word, n).

    A word's form is its most frequent near word (ties: the smallest), if that is ``form_times`` as frequent; its root
    is where the forms end, itself without one. An empty table gives an empty one.
    """
    words = materialised(words.select("word", "n"), narrow=True)
    near = one_error_apart(words, narrow_at, group_rows)
    is_form = F.col("form_n") >= form_times * F.col("n")
    made = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    made = materialised(made, narrow=True)
    return made.join(roots(made.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))

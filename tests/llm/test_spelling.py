"""Spelling variants: the automaton against sets, grouped words against all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratapanel.llm import spelling

WORDS = st.lists(st.text(alphabet="abcé", max_size=7), max_size=30, unique=True)


def near(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(counts: dict[str, int], times: int = 2) -> dict:
    form, n_near = {}, {}
    for w, n in counts.items():
        others = sorted((-counts[o], o) for o in counts if near(w, o))
        n_near[w] = len(others)
        form[w] = others[0][1] if others and -others[0][0] >= times * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, n_near[w], form[w], counts[form[w]] if form[w] else None, root)
    return out


def as_rows(df) -> dict:
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@settings(max_examples=200, deadline=None)
@given(WORDS)
def test_numbers_are_places_in_order(words):
    words = sorted(words)
    automaton = spelling.Automaton(words)
    assert [automaton.number(w) for w in words] == list(range(len(words)))
    assert all(automaton.number(w + "b") == (words.index(w + "b") if w + "b" in words else -1) for w in words)


def test_automaton_is_minimal():
    words = sorted(a + b + c for a in "abc" for b in "xyz" for c in ("ing", "ed", "s"))
    assert len(spelling.Automaton(words).edges) <= 8


@settings(max_examples=300, deadline=None)
@given(WORDS, st.text(alphabet="abcé", max_size=7))
def test_one_error_finds_each_once(words, word):
    words = sorted(words)
    automaton = spelling.Automaton(words)
    found = [words[i] for i in automaton.one_error(word, 0, len(word) + 1)]
    assert sorted(found) == [w for w in words if near(w, word)]


@pytest.mark.parametrize("narrow_at,group_rows", [(16_000, 16_000), (12, 60), (3, 200)])
def test_grouped_equals_all_pairs(spark, narrow_at, group_rows):
    draw = random.Random(narrow_at)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(1, 7))) for _ in range(300)} | {"aaaaaaaa" + "".join(draw.choice("xyz") for _ in range(4)) for _ in range(60)} | {"".join(draw.choice("xyz") for _ in range(3)) + "endendend" for _ in range(25)} | {"l" * 70, "l" * 71}
    counts = {w: draw.choice([1, 2, 3, 5, 10, 10, 40]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert as_rows(spelling.grouped(df, narrow_at=narrow_at, group_rows=group_rows)) == brute(counts)


def test_groups_stay_small(spark):
    """All words share one half, but for the narrowed rows a group would hold them all."""
    words = [("samesamesame" + chr(97 + i // 676 % 26) + chr(97 + i // 26 % 26) + chr(97 + i % 26) + "zz", 1 + i % 5) for i in range(3000)]
    df = spark.createDataFrame(words, "word string, n long")
    found = spelling.one_error_apart(df, narrow_at=400, group_rows=2000).collect()
    counts = dict(words)
    want = {w: sum(v != w and sum(a != b for a, b in zip(v, w, strict=True)) == 1 for v in list(counts)) for w in list(counts)[:40]}
    assert {r["word"]: r["n_near"] for r in found if r["word"] in want} == want


def test_counts_and_edges(spark):
    rows = [(i, t, "x") for i, t in enumerate([None, "", "Words WORDS words Ärger ärger", "don't 12 é😀straße", "word " * 5000] * 60)] + [(None, "words words", None), (7, "words", "y"), (7, "words", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    want = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            want[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert spelling.grouped(spelling.word_counts(docs.where("false"))).count() == 0
    assert as_rows(spelling.grouped(spark.createDataFrame([("", 3), (None, 2), ("ab", 9), ("a", 1), ("l" * 30_000, 2), ("l" * 30_001, 1)], "word string, n long")))["a"] == (1, 1, "ab", 9, "ab")


def test_chains_of_forms(spark):
    counts = {"a" * (5 + i): 2**i for i in range(12)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_rows(spelling.grouped(df)) == brute(counts)

"""Fill-in-middle: ropes against slices, outputs against the rule written out, exact round trips."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratapanel.llm import fill_middle as fim

TEXTS = [None, "", "a", "plain text of some words", "holds <P> itself", "ends <", "P> starts", "<", "é😀" * 3000, "x" * 100_000, "áb\r\n\x00c", "<S" * 40]


def plain_rule(doc_id, text, unit=None):
    """The contract, on slices."""
    text = text or ""
    starts = list(range(len(text)))
    if unit:
        starts = [m.start() for m in re.finditer(unit, text) if m[0]]
        starts = [0, *starts[1:]] if text else []
    n, x = len(starts), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    i, j = ([*starts, len(text)][r] for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    p, m, s = text[:i], text[i:j], text[j:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.integers(0, 90), st.integers(1, 9), st.booleans())
def test_split_equals_slices(text, rank, leaf, by_points):
    tree = fim.rope(text, None, leaf)
    assert (tree.units, tree.points) == (len(text), len(text))
    a, b = fim.split(tree, rank, by_points)
    assert (fim.said(a), fim.said(b)) == (text[:rank], text[rank:]) and (a.points, b.points) == (len(text[:rank]), len(text[rank:]))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=60), st.integers(0, 30), st.integers(1, 9))
def test_word_units(text, rank, leaf):
    tree = fim.rope(text, re.compile(r"\S+\s*"), leaf)
    starts = [m.start() for m in re.finditer(r"\S+\s*", text)]
    starts = [0, *starts[1:]] if text else []
    assert tree.units == len(starts) and fim.said(tree) == text
    at = starts[rank] if rank < len(starts) else len(text)
    a, b = fim.split(tree, rank)
    assert (fim.said(a), fim.said(b)) == (text[:at], text[at:]) and a.units + b.units == tree.units


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<PSM>ab", max_size=40), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["psm", "spm"]))
def test_round_trip(text, i, j, form):
    if not any(s in text for s in fim.SENTINELS):
        rule = fim.Rule(leaf_points=3)
        output, prefix, middle = fim.arranged(text, rule, (i, j), form)
        assert fim.restored(output, form, rule) == text and prefix == min(i, j, len(text))


def test_depth_stays_small():
    tree = fim.rope("x" * 100_000, None, 8)

    def depth(t):
        return 0 if isinstance(t, fim.Leaf) else 1 + max(depth(t.left), depth(t.right))

    a, b = fim.split(tree, 33_333)
    assert depth(tree) <= 14 and max(depth(a), depth(b)) <= 24


def test_sentinels_are_checked():
    for bad in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "d"), ("a", "xax", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.Rule(sentinels=bad)


@pytest.mark.parametrize("unit", [None, r"\S+\s*"])
def test_rows_equal_the_rule(spark, unit):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS * 5)] + [(3, TEXTS[3], "x", 1), (None, "no id here", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output int")
    rule = fim.Rule(unit=unit)
    made = fim.fill_in_middle(docs, rule)
    assert made.columns == [*docs.columns, "fim"]
    got = made.withColumn("again", fim.rebuilt(made["fim.output"], made["fim.form"], rule)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r["fim"]) == plain_rule(r["doc_id"], r["text"], unit) and r["again"] == (r["text"] or "")
    assert fim.round_trip(docs.where("false")).count() == 0


def test_query_on_tables(spark, tables):
    from stratapanel.llm import queries

    got = {r["doc_id"]: r for r in queries.op12_fill_middle(spark, tables).collect()}
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        *head, output = plain_rule(d["doc_id"], d["text"])
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in (output, d["text"] or "")]
        assert list(got[d["doc_id"]])[1:] == [*head, *sha]

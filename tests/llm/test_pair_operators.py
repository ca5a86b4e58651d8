"""The n-gram join, vector near-duplicates and components against brute force."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from stratapanel.llm import ngram_join, vectors
from stratapanel.llm.components import components, digest


def _groups(items, linked) -> dict:
    name = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            least = min(name[a], name[b])
            if name[a] != least or name[b] != least:
                name[a] = name[b] = least
                changed = True
    return name


def _shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def _corpus(seed: int) -> list[tuple[int, str | None]]:
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = " ".join(rnd.choices(vocabulary, k=40))
    base = rnd.choices(vocabulary, k=80)
    rows: list[tuple[int, str | None]] = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c d"), (7, "é É ß ẞ x y")]
    for i in range(10, 60):
        words = list(base)
        for _ in range(rnd.randrange(0, 6)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(words)))
    for i in range(60, 100):
        rows.append((i, passage + " " + " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 60)))))
    rows += [(100 + i, " ".join(base)) for i in range(20)] + [(7, "é É ß ẞ x y")]
    return rows


@pytest.mark.parametrize(("seed", "hot", "marked"), [(1, 16, 1 << 24), (2, 3, 0)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, seed, hot, marked):
    monkeypatch.setattr(ngram_join, "HOT_COUNT", hot)
    monkeypatch.setattr(ngram_join, "MARKED_ROWS", marked)
    rows = _corpus(seed)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, n double")
    sets = {i: _shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = _groups(sets, links)
    got = ngram_join.similar_documents(docs).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(s), want[i]) for i, s in sets.items()}
    kept = ngram_join.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in sets if want[i] == i)


def test_ngram_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_documents(empty).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.similar_documents(only).collect()} == {(1, 0, 1), (2, 0, 2)}


def test_ngram_join_of_rows_without_ids(spark):
    text, big = "one two three four five six seven eight nine ten", (1 << 53) + 1
    docs = spark.createDataFrame([(1, text), (None, text), (big, text + " eleven"), (None, None), (None, "a b")], "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.similar_documents(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 6, 1), (big, 7, 1), (None, 6, None), (None, 0, None), (None, 1, None)], key=str)
    assert sorted((r["doc_id"] or 0 for r in ngram_join.kept_documents(docs).collect())) == [0, 0, 0, 1]


def test_vectors_without_ids(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [0.0, 1.0]), (None, None), (None, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vectors.near_duplicates(rows).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 1, True), (None, 1, 1, False), (3, 0, 3, True), (None, 0, None, True), (None, 0, None, True)], key=str)


def test_long_text(spark):
    text = " ".join(f"word{i % 5000}" for i in range(120_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short one")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (None, 1), (20, 10), (10, 30), (30, 40), (40, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5, 10: 1, 20: 1, 30: 1, 40: 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digest_of_very_many_edges(spark):
    edges = spark.range(1 << 25).selectExpr("id + 1 as a", "id as b")
    n, mark = digest(edges)
    assert n == 1 << 25 and digest(edges.where("a <> 7"))[1] != mark


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 40)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    rnd = np.random.default_rng(3)
    centre = rnd.normal(size=(6, 16))
    rows = [centre[i % 6] + rnd.normal(size=16) * (0.05 if i % 3 else 0.3) for i in range(240)]
    rows += [rows[0]] * 5 + [rows[1] * 2]
    data = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(rows)]
    data += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0, 2.0], 1), (905, [1.0, 2.0], 1), (906, [], 1)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, n_links int")
    unit = np.array([d[1] for d in data[:246]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    names = _groups(range(246), list(zip(*np.nonzero(linked), strict=True)))
    got = {r["vec_id"]: r for r in vectors.near_duplicates(table).collect()}
    found = sum(got[i]["n_links"] for i in range(246))
    assert found <= linked.sum() and found >= 0.97 * linked.sum()
    assert np.mean([got[i]["component_id"] == names[i] for i in range(246)]) > 0.97
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (900, 901, 902, 903, 906)] == [(0, 900), (0, 901), (0, 902), (0, 903), (0, 906)]
    assert (got[905]["n_links"], got[905]["component_id"], got[905]["kept"]) == (1, 904, False)
    assert vectors.near_duplicates(table.where("false")).count() == 0


@pytest.mark.parametrize(("dim", "rank", "cells"), [(64, 4, 8), (64, 4, 64), (384, 8, 64)])
def test_linked_vectors_of_low_rank_meet(dim, rank, cells):
    rnd = np.random.default_rng(5)
    unit = rnd.normal(size=(4000, rank)) @ rnd.normal(size=(rank, dim))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    row, cell, home = vectors.cells_of(unit, vectors.spherical_kmeans(unit, cells))
    at, own = np.zeros((4000, cells), bool), np.zeros((4000, cells), bool)
    at[row, cell], own[row, cell] = True, cell == home
    meet = (own.astype(np.float32) @ at.T.astype(np.float32)) > 0
    linked = np.triu(unit @ unit.T >= 0.95, 1)
    assert linked.sum() > 10 and not (linked & ~(meet | meet.T)).any()


def test_correlated_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 40)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)
    monkeypatch.setattr(vectors, "fitted_cells", lambda sample, n, *_: vectors.spherical_kmeans(sample, 24), raising=False)
    rnd = np.random.default_rng(6)
    unit = rnd.normal(size=(900, 4)) @ rnd.normal(size=(4, 64))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(unit)], "vec_id long, embedding array<double>")
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    names = _groups(range(900), list(zip(*np.nonzero(linked), strict=True)))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(table).collect()}
    assert got == {i: (linked[i].sum(), names[i], names[i] == i) for i in range(900)}


def _two_blocks(rows, dim=64):
    rnd = np.random.default_rng(8)
    unit = rnd.normal(size=(2 * rows, dim)).astype(np.float32)
    unit[rows : rows + 40] = unit[:40] + 0.01 * rnd.normal(size=(40, dim))
    return unit, pa.table({"id": np.arange(2 * rows)[::-1], "copies": np.full(2 * rows, 2), "vector": pa.array(list(unit), pa.list_(pa.float32())), "side": np.repeat([1, 2], rows)})


def test_blocks_are_compared_without_a_matrix_of_them():
    """Two blocks of 16,384 vectors: a byte a pair would be 268 MB."""
    _, group = _two_blocks(16_384)
    tracemalloc.start()
    got = vectors._compared(0.95)(group).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    assert sorted((r["id"], r["n"], r["root"]) for r in got) == sorted((32_767 - k - extra, 2, 16_383 - k) for k in range(40) for extra in (0, 16_384))


def test_blocks_of_dense_links_join_what_is_kept(monkeypatch):
    monkeypatch.setattr(vectors, "KEPT_LINKS", 50)
    monkeypatch.setattr(vectors, "PRODUCT_ROWS", 8)
    monkeypatch.setattr(vectors, "PRODUCT_COLUMNS", 16)
    rnd = np.random.default_rng(9)
    for side in (np.repeat([1, 2], 90), np.full(180, 3)):
        unit = rnd.normal(size=(180, 3))
        group = pa.table({"id": np.arange(180), "copies": np.ones(180, np.int64), "vector": pa.array(list(unit), pa.list_(pa.float64())), "side": side})
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        linked = (unit @ unit.T >= 0.95) & ((side[:, None] != side[None, :]) | (side[0] == 3))
        np.fill_diagonal(linked, False)
        names = _groups(range(180), list(zip(*np.nonzero(linked), strict=True)))
        got = {r["id"]: (r["n"], r["root"]) for r in vectors._compared(0.95)(group).to_pylist()}
        assert got == {i: (linked[i].sum(), names[i]) for i in range(180) if linked[i].any()}


def test_a_vector_goes_to_few_blocks():
    """Copies of a vector that travel to be compared: 13 blocks until 400,000 vectors of 64 components, then one for 32,768."""
    for n, dim, most in ((50_000, 64, 13), (400_000, 64, 13), (4_000_000, 64, 123), (400_000, 2048, 391)):
        assert -(-n // vectors.block_size(n, dim)[1]) <= most


def test_a_guest_of_many_cells_stands_once():
    """Vectors without structure are guests of most cells: 2,000 of them came back 199,104 times."""
    rnd = np.random.default_rng(10)
    rows = pd.DataFrame({"id": np.arange(2000), "copies": 1, "vector": list(rnd.normal(size=(2000, 64))), "cell": "", "guest": np.int32(0)})
    centres = rnd.normal(size=(256, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    pieces = list(vectors._assigned(rows, centres, 0.95))
    assert max(map(len, pieces)) <= vectors.PRODUCT_ROWS and list(pd.concat(pieces)["id"]) == list(range(2000))
    row, cell, home = vectors.cells_of(vectors._units(rows["vector"]), centres)
    assert len(row) > 150_000 and [(i, c) for i, cells in enumerate(pd.concat(pieces)["cells"]) for c in cells] == list(zip(row, cell, strict=True))
    assert list(pd.concat(pieces)["home"][row]) == list(home)


def test_cells_that_save_little_are_none():
    rnd = np.random.default_rng(11)
    unit = rnd.normal(size=(8000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert len(vectors.fitted_cells(unit, 10_000_000)) == 1
    near = unit[rnd.integers(0, 64, 8000)] + 0.01 * rnd.normal(size=(8000, 64))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    assert len(vectors.fitted_cells(near, 1_000_000)) > 10


def test_exact_boundary_of_the_jaccard_limit(spark):
    words = [f"a{i}" for i in range(13)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:12])), (3, " ".join(words[:11])), (4, " ".join(words[:10]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(docs).collect()}
    assert got == {1: (9, 1), 2: (8, 1), 3: (7, 1), 4: (6, 1)}


def test_words_that_a_polynomial_modulo_a_power_of_two_confuses_stay_apart(spark):
    rows = []
    for k, size in enumerate((1024, 2048, 4096)):
        word = "".join("ab"[i.bit_count() & 1] for i in range(size))
        rows += [(2 * k, word), (2 * k + 1, word.translate(str.maketrans("ab", "ba")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(docs).collect()} == {i: i for i in range(6)}
    assert ngram_join.kept_documents(docs).count() == 6


def test_rows_of_one_id_with_unrelated_texts_all_stay(spark):
    one, two = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(5, one), (5, two), (5, two), (5, ""), (3, one + " more"), (9, two + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.kept_documents(docs).collect())) == [(3, one + " more"), (5, ""), (5, two)]


def test_first_pass_keeps_every_linked_node(monkeypatch):
    rnd = random.Random(8)
    for n in (5, 40, 63, 64, 70, 79, 80, 98, 99, 300):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(n + 4)]
        other = words[: len(words) - (n // 9)] + [f"x{i}" for i in range(n // 9)]
        texts = [" ".join(w).encode() for w in (words, other)]
        (batch,) = ngram_join._sets((np.zeros(0, np.uint64), np.zeros(0, np.int16)))(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2]), pa.array(texts, pa.binary())], ["doc_id", "h", "text"])]))
        a, b = (set(x) for x in batch.column("some").to_pylist())
        full = [set(ngram_join.shingle_sets([t])[0].view(np.int64).tolist()) for t in texts]
        assert 100 * len(full[0] & full[1]) >= 80 * len(full[0] | full[1])
        for shown, other_shown, size, need in zip((a, b), (b, a), batch.column("n").to_pylist(), batch.column("need").to_pylist(), strict=True):
            asked = {g for g in shown if size < ngram_join.SMALL or g < ngram_join.SAMPLE_BELOW}
            assert len(asked & other_shown) >= need


def test_a_template_of_many_unlinked_documents_makes_no_pairs(spark, monkeypatch):
    rnd = random.Random(9)
    template = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = [f"o{i}x{j}" for j in range(50)]
        rows += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + own[:-1] + [f"z{rnd.random()}"]))]
    tried = []
    real = ngram_join._linked
    monkeypatch.setattr(ngram_join, "_linked", lambda pairs, segments: tried.append(pairs.count()) or real(pairs, segments))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(300)} and sum(tried) <= 300


def test_cells_split_again_lose_and_double_no_link(spark, monkeypatch):
    for name, value in {"CELL_ROWS": 30, "BLOCK_ROWS": 16, "MOST_CELLS": 4, "SPLIT_AT": 2, "PARTS": 5}.items():
        monkeypatch.setattr(vectors, name, value)
    monkeypatch.setattr(vectors, "fitted_cells", lambda sample, n, threshold, block, most=4: vectors.spherical_kmeans(sample, most))
    rnd = np.random.default_rng(11)
    unit = rnd.normal(size=(700, 4)) @ rnd.normal(size=(4, 32))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(unit)], "vec_id long, embedding array<double>")
    placed = vectors._placed(table.selectExpr("vec_id as id", "1L as copies", "embedding as vector"), vectors.spherical_kmeans(unit / np.linalg.norm(unit, axis=1, keepdims=True), 4), 0.95, 16)
    assert max(len(r["cell"].split(".")) for r in placed.select("cell").distinct().collect()) > 2
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    names = _groups(range(700), list(zip(*np.nonzero(linked), strict=True)))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(table).collect()}
    assert got == {i: (linked[i].sum(), names[i], names[i] == i) for i in range(700)}

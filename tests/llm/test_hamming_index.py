"""Nearest neighbours: probing against a scan of all codes, recall and scores against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from stratapanel.llm import hamming_index as hi
from stratapanel.llm import queries


def brute(rows, k=20, every=20):
    """{query: [(vec_id, score)]} of usable rows with an id."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            best = out.setdefault(q, {})
            for i, v in good:
                if i != q and len(v) == len(x):
                    best[i] = max(best.get(i, -np.inf), float((v * x).sum()))
    return {q: sorted(((s, i) for i, s in b.items()), key=lambda x: (-x[0], x[1]))[:k] for q, b in out.items()}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        rows = out.setdefault(r["query_id"], [])
        rows.append((r["score"], r["vec_id"]))
        assert r["rank"] == len(rows)
    return out


def recall(got, want):
    n = sum(map(len, want.values()))
    return sum(len({i for _, i in got.get(q, [])} & {i for _, i in w}) for q, w in want.items()) / n


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 9, 16, 24])
def test_probing_finds_every_code_within_the_radius(radius):
    random = np.random.default_rng(radius)
    codes = random.integers(0, 256, (500, 3), dtype=np.uint8)
    codes[:100] = codes[0] ^ (1 << random.integers(0, 8, (100, 3))).astype(np.uint8)
    index = hi.Index(codes)
    for code in codes[:40]:
        want = np.flatnonzero(np.bitwise_count(codes ^ code).sum(1) <= radius)
        assert (index.within(code, radius) == want).all()


def test_words_of_codes():
    codes = np.random.default_rng(1).integers(0, 256, (300, 16), dtype=np.uint8)
    assert (hi.Index(codes).within(codes[5], 60) == np.flatnonzero(np.bitwise_count(codes ^ codes[5]).sum(1) <= 60)).all()


def test_rotation_is_learned():
    """Codes of a learned rotation are nearer for near vectors than signs of a random one."""
    random = np.random.default_rng(2)
    centres = random.normal(size=(30, 24))
    x = (centres[:, None] + 0.3 * random.normal(size=(30, 40, 24))).reshape(-1, 24)
    apart = []
    for rotation in (hi.learned_rotation(x, 24), np.linalg.qr(random.normal(size=(24, 24)))[0]):
        codes = (x @ rotation > 0).reshape(30, 40, 24)
        apart.append((codes[:, :1] != codes).mean())
    assert apart[0] < apart[1]


def test_query_on_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = found(queries.op11_nearest(spark, sf_dir)), brute(rows)
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in want) and recall(got, want) >= 0.95
    scores = {q: dict((i, s) for s, i in brute(rows, k=len(rows))[q]) for q in list(want)[:3]}
    assert all(abs(s - scores[q][i]) < 1e-12 for q in scores for s, i in got[q])


def test_blocks_chunks_and_lengths(spark):
    """Many blocks and chunks; vectors of very different lengths; a third of the rows in one spot; equal vectors."""
    random = np.random.default_rng(4)
    x = random.normal(size=(1500, 12)) * random.choice([0.2, 1, 1, 5], size=(1500, 1))
    x[:500] = x[0] + 0.01 * random.normal(size=(500, 12))
    x[600:640] = x[600]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(hi.nearest(df, lambda i: i % 20 == 0, block_rows=200, chunk_rows=30)), brute(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    again = found(hi.nearest(df.repartition(5), lambda i: i % 20 == 0, block_rows=200, chunk_rows=30))
    assert again == got


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.5, 1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (40, [0.0, 0.0]), (60, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [9.0, 9.0]), (7, [3.0]), (80, [2.0]), (2, [1.0, 2.0]), (20, [0.5, 1.0]), (20, [4.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, block int")
    got, want = found(hi.nearest(df, lambda i: i % 20 == 0)), brute(rows)
    assert {q: [(round(s, 9), i) for s, i in b] for q, b in got.items()} == {q: [(round(s, 9), i) for s, i in b] for q, b in want.items() if b}
    assert hi.nearest(df.where("false"), lambda i: i % 20 == 0).count() == 0

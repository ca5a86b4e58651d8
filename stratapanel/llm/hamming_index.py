"""Approximate nearest neighbours by inner product: multi-index hashing over learned rotated binary codes.

A rotation is learned on a bounded sample (principal axes, then alternating between codes and the rotation that brings
vectors closest to them); the signs of rotated vectors are codes. Every row is indexed: rows are dealt to blocks of
bounded size, and in a block each byte of the codes has its own index from byte value to rows. A query probes, by the
pigeonhole principle, the byte values near its own in each index: they hold every code of the block within the query's
Hamming radius. Codes within the radius are reranked by the original vectors. The query set meets all rows in blocks;
a task returns its best rows of each query only, so no pairs are made, and equal or crowded codes are spread by row.

Longer vectors have larger inner products, so codes are of vectors that one more component brings to the same length.
The radius of a query is learned: on the sample, codes of pairs at least as near as the query's k-th best of the sample
lie within it for a share ``COVERED`` of pairs. The sample is part of the table, so the true k-th best is at least as near.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.llm.common import collected, materialised

#: Rows that the rotation and radii are learned on at most, and values of them; queries among them that radii are learned from.
FIT_ROWS, FIT_VALUES, FIT_QUERIES = 20_000, 8_000_000, 400
#: Bits of a code, rounds of learning, share of near pairs within the radius, steps of the table of radii.
BITS, ROUNDS, COVERED, STEPS = 128, 20, 0.97, 64
#: Rows of a block and queries of a chunk, about.
BLOCK_ROWS, CHUNK_ROWS = 16_384, 2048
NEIGHBOURS = 20


@dataclass
class Codes:
    """The learned rotation (a column a bit), the length that vectors are brought to, and radii by nearness."""

    rotation: np.ndarray
    length: float
    steps: np.ndarray
    radii: np.ndarray
    sample: np.ndarray
    sample_ids: np.ndarray

    def of(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        """Codes of rows as bytes; a query is on the plane of the original components."""
        gap = np.zeros(len(vectors)) if queries else np.sqrt(np.maximum(self.length**2 - (vectors**2).sum(1), 0))
        return np.packbits(np.column_stack([vectors, gap]) @ self.rotation > 0, axis=1)

    def radius(self, query: np.ndarray, own: int, k: int) -> int:
        """The radius that holds codes at least as near as the k-th best row of the sample, but the query's own."""
        near = np.einsum("ij,j->i", self.sample, query)[self.sample_ids != own]
        if len(near) < k:
            return self.rotation.shape[1]
        cosine = np.partition(near, len(near) - k)[len(near) - k] / (self.length * np.linalg.norm(query))
        return int(self.radii[min(np.searchsorted(self.steps, cosine, "right"), len(self.steps)) - 1]) if cosine >= self.steps[0] else self.rotation.shape[1]


def learned_rotation(vectors: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """A matrix whose columns give a bit each. As many bits as there are components come from one learned rotation of the principal axes; more bits from further ones, that start elsewhere."""
    random = np.random.default_rng(seed)
    dim, parts = vectors.shape[1], []
    _, axes = np.linalg.eigh(vectors.T @ vectors)
    while sum(p.shape[1] for p in parts) < bits:
        width = min(dim, bits)
        base = axes[:, ::-1][:, :width]
        low = vectors @ base
        turn, _ = np.linalg.qr(random.normal(size=(width, width)))
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (u @ v).T
        parts.append(base @ turn)
    return np.column_stack(parts)[:, :bits]


def fitted(vectors: np.ndarray, ids: np.ndarray, longest: float, k: int = NEIGHBOURS, bits: int = BITS) -> Codes:
    """Codes learned on sample rows; ``longest`` is the length of the longest row of the whole table."""
    whole = np.column_stack([vectors, np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))])
    codes = Codes(learned_rotation(whole, bits), longest, np.array([-1.0]), np.array([bits]), vectors, ids)
    stored, some = codes.of(vectors), np.random.default_rng(3).permutation(len(vectors))[:FIT_QUERIES]
    asked = codes.of(vectors[some], queries=True)
    near, apart = [], []
    for i, code in zip(some, asked, strict=True):
        cosine = vectors @ vectors[i] / (longest * np.linalg.norm(vectors[i]))
        best = np.argpartition(-cosine, min(8 * k, len(cosine) - 1))[: 8 * k]
        best = best[best != i]
        near.append(cosine[best])
        apart.append(np.bitwise_count(stored[best] ^ code).sum(1))
    if near and len(np.concatenate(near)):
        near, apart = np.concatenate(near), np.concatenate(apart)
        order = np.argsort(near)
        near, apart = near[order], apart[order]
        starts = np.unique(np.linspace(0, len(near) * (1 - 1 / STEPS), STEPS).astype(int))
        # radii of nearer pairs are smaller, so the tail from each step on is an upper share
        tails = np.array([np.quantile(apart[s : s + max(50, len(near) // STEPS)], COVERED, method="higher") for s in starts])
        codes.steps, codes.radii = near[starts], np.maximum.accumulate(tails[::-1])[::-1]
    return codes


class Index:
    """For each byte of the codes of a block: its rows in order of that byte, and where each value starts."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.words = np.ascontiguousarray(codes).view(np.uint64) if codes.shape[1] % 8 == 0 else codes
        self.orders = [np.argsort(codes[:, j], kind="stable").astype(np.int32) for j in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.orders)]

    _BITS = np.bitwise_count(np.arange(256, dtype=np.uint8))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes are within the radius. A code at distance radius = parts * each + more agrees with the query in a byte of the first more + 1 up to ``each`` bits, or in another up to each - 1."""
        parts = self.codes.shape[1]
        each, more = divmod(radius, parts)
        seen = np.zeros(len(self.codes), bool)
        values = np.arange(256, dtype=np.uint8)
        for j in range(parts):
            limit = each if j <= more else each - 1
            if limit < 0:
                continue
            starts, order = self.starts[j], self.orders[j]
            near = np.flatnonzero(self._BITS[values ^ code[j]] <= limit)
            seen[np.concatenate([order[starts[v] : starts[v + 1]] for v in near])] = True
        rows = np.flatnonzero(seen)
        mine = np.ascontiguousarray(code).view(np.uint64) if self.words.dtype == np.uint64 else code
        return rows[np.bitwise_count(self.words[rows] ^ mine).sum(1) <= radius]


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids; an id counts once, by its best row."""
    if len(scores) > 4 * k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= limit)
        if len(np.unique(ids[some])) >= k:
            order = some[np.lexsort((ids[some], -scores[some]))]
            return order[_first_of(ids[order])][:k]
    order = np.lexsort((ids, -scores))
    return order[_first_of(ids[order])][:k]


def _first_of(ids: np.ndarray) -> np.ndarray:
    return np.sort(np.unique(ids, return_index=True)[1])


_FOUND = "query_id long, vec_id long, score double"


def _searched(shared, k: int):
    """The best rows of a block for each query of a chunk."""

    def run(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        model: Codes = shared.value
        vectors, ids = np.array(block["vector"].tolist(), dtype=np.float64), block["id"].to_numpy(np.int64)
        index = Index(model.of(vectors))
        out = []
        for own, query, radius, code in zip(asked["id"], asked["vector"], asked["radius"], asked["code"], strict=True):
            rows = index.within(np.frombuffer(code, np.uint8), radius)
            rows = rows[ids[rows] != own]
            scores = (vectors[rows] * query).sum(1)
            best = best_rows(scores, ids[rows], k)
            out.append(pd.DataFrame({"query_id": own, "vec_id": ids[rows][best], "score": scores[best]}))
        return pd.concat(out)

    return run


def _asked(shared, k: int):
    """Queries with their codes and radii."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Codes = shared.value
        for batch in batches:
            if len(batch):
                vectors = np.array(batch["vector"].tolist(), dtype=np.float64)
                codes = model.of(vectors, queries=True)
                yield batch.assign(code=[c.tobytes() for c in codes], radius=[model.radius(v, i, k) for v, i in zip(vectors, batch["id"], strict=True)])

    return run


def nearest(table: DataFrame, is_query, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS, bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of each row for which the column ``is_query`` of ids holds.

    The score is the inner product in double precision; ties go to the smaller id. A query's own id is no candidate.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part;
    vectors are compared with those of the same length only. Rows of one id count as one, by the best of them. With
    fewer than ``k`` candidates all are returned; other columns are ignored; an empty table gives an empty one.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = materialised(rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)))
    found = None
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    for dim, n, longest in sorted(tuple(r) for r in rows.groupBy(F.size("vector")).agg(F.count(F.lit(1)), F.sqrt(F.max(squares))).collect()):
        part = rows.where(F.size("vector") == dim)
        sample = collected(part.select("id", "vector", F.xxhash64("id", "vector").alias("h")).orderBy("h", "id").limit(max(1000, min(FIT_ROWS, FIT_VALUES // dim))))
        model = fitted(np.array(sample["vector"].tolist(), dtype=np.float64), sample["id"].to_numpy(np.int64), longest, k, bits)
        shared = spark.sparkContext.broadcast(model)
        asked = materialised(part.where(is_query(F.col("id"))).mapInPandas(_asked(shared, k), "id long, vector array<double>, code binary, radius int"))
        blocks, chunks = math.ceil(n / block_rows), max(1, math.ceil(asked.count() / chunk_rows))
        deal = lambda seed, parts: F.pmod(F.xxhash64("id", "vector", F.lit(seed)), F.lit(parts))
        each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
        left = part.select("id", "vector", deal(1, blocks).alias("block"), each(chunks).alias("chunk"))
        right = asked.select("id", "vector", "code", "radius", deal(2, chunks).alias("chunk"), each(blocks).alias("block"))
        by = ["block", "chunk"]
        best = left.repartition(blocks * chunks, *by).groupBy(*by).cogroup(right.repartition(blocks * chunks, *by).groupBy(*by)).applyInPandas(_searched(shared, k), _FOUND)
        found = best if found is None else found.union(best)
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)

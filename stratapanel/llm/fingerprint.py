"""Document fingerprints from prefix polynomial hashes.

With H[i] = sum of c[j] * B**j for j < i (mod a prime), the hash of any span is (H[e] - H[s]) * B**-s: one
subtraction and one product answer whether two spans are equal, and binary search over them finds the longest
common extension of two places. A fingerprint holds the length, the whole text's hash under two primes, the hashes
of its prefixes of ``STEPS`` code points, and anchors: places whose spans of ``SPAN`` code points have the smallest
hashes, each with the prefix hash there. As anchors are chosen by content, two texts have the same ones wherever
they agree, and the prefix hashes at two anchors give the hash of all that lies between. So two fingerprints can be
compared like the texts: from anchors with equal spans, binary search finds the longest common extension, and the
likeness is the share of the longer text that such extensions and the agreed prefix cover.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import blocks, collected, short_batches

#: Primes below 2**31 and bases; products of residues fit in 64 bits.
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
#: Code points of a span; span hashes kept; code points handled together.
SPAN, KEPT, BLOCK_CHARS = 12, 64, 1_000_000
#: Bytes of text of a range of ids at least; sampled rows of a range that its bounds are taken from; ranges at most: beyond, they grow with the table.
PART_BYTES, PER_PART, MOST_PARTS = 8_000_000, 20, 8192
#: Lengths of the prefixes that a fingerprint holds: each about 1.4 times the one before.
STEPS = np.unique((2.0 ** np.arange(0, 40, 0.5)).astype(np.int64))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of a base and of its inverse modulo a prime, extended on demand."""

    def __init__(self, prime: int, base: int):
        self.prime, self.base = prime, base
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        p = np.uint64(self.prime)
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.r_[self.up, self.up * np.uint64(pow(self.base, k, self.prime)) % p]
            self.down = np.r_[self.down, self.down * np.uint64(pow(self.base, -k, self.prime)) % p]


_POWERS = [Powers(p, b) for p, b in zip(PRIMES, BASES, strict=True)]


class Prefixes:
    """Prefix hashes of a run of texts; spans of any two such objects can be compared."""

    def __init__(self, texts: list[str], which: int = 0):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.r_[0, np.cumsum(self.lengths)][:-1]
        self.powers, self.prime = _POWERS[which], np.uint64(PRIMES[which])
        self.powers.reach(len(codes) + 1)
        terms = (codes.astype(np.uint64) + np.uint64(1)) * self.powers.up[: len(codes)] % self.prime
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(terms) % self.prime]

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of spans that do not depend on where the spans stand."""
        return (self.sums[end] + self.prime - self.sums[start]) % self.prime * self.powers.down[start] % self.prime

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all spans of one size."""
        n = max(len(self.sums) - size, 0)
        return (self.sums[size:] + self.prime - self.sums[:n]) % self.prime * self.powers.down[:n] % self.prime


def common_extension(a: Prefixes, i: np.ndarray, b: Prefixes, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest equal spans from places ``i`` of ``a`` and ``j`` of ``b``, up to ``most``."""
    low, high = np.zeros(len(i), np.int64), most.astype(np.int64).copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = a.span(i, i + middle) == b.span(j, j + middle)
        low, high = np.where(same, middle, low), np.where(same, high, np.minimum(high, middle - 1))
    return low


def _mixed(hashes: np.ndarray) -> np.ndarray:
    x = (hashes + np.uint64(1)) * _MIX
    return (((x ^ (x >> np.uint64(29))) * _MIX) >> np.uint64(32)).astype(np.uint32)


def anchors(prefixes: Prefixes) -> list[np.ndarray]:
    """For each text the places (within it) of the ``KEPT`` spans of smallest hash, in order; of equal spans the first.

    A text shorter than a span has none.
    """
    spans = _mixed(prefixes.windows(SPAN))
    n = np.maximum(prefixes.lengths - SPAN + 1, 0)
    limit = np.minimum(4.0 * KEPT / np.maximum(n, 1), 1.0) * 2.0**32
    per_place = np.repeat(np.minimum(limit, 2.0**32 - 1).astype(np.uint32), prefixes.lengths)[: len(spans)]
    low = np.flatnonzero(spans <= per_place)
    out = []
    for start, k in zip(prefixes.starts, n, strict=True):
        a, b = np.searchsorted(low, (start, start + k))
        for places in (low[a:b], np.arange(start, start + k)):
            found, first = np.unique(spans[places], return_index=True)
            if len(found) >= KEPT:
                break
        out.append(np.sort(places[first[:KEPT]]) - start)
    return out


@dataclass
class Fingerprint:
    """``places`` are the anchors, ``spans`` their span hashes, ``sums`` the prefix hashes at them."""

    n: int
    whole: str
    prefixes: np.ndarray
    places: np.ndarray
    spans: np.ndarray
    sums: np.ndarray

    def __str__(self) -> str:
        return "-".join((f"{self.n:x}", self.whole, *(x.astype(">u4").tobytes().hex() for x in (self.prefixes, self.places, self.spans, self.sums))))

    @classmethod
    def parse(cls, said: str) -> Fingerprint:
        n, whole, *arrays = said.split("-")
        return cls(int(n, 16), whole, *(np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in arrays))


def fingerprints(texts: list[str]) -> tuple[list[Fingerprint], Prefixes]:
    """The fingerprint of each text, and the prefix hashes they come from."""
    first, second = Prefixes(texts, 0), Prefixes(texts, 1)
    ends = first.starts + first.lengths
    whole, again = first.span(first.starts, ends), second.span(first.starts, ends)
    steps = np.searchsorted(STEPS, first.lengths, side="right")
    stops = np.cumsum(steps)
    place = np.arange(stops[-1] if len(stops) else 0) - np.repeat(stops - steps, steps)
    start = np.repeat(first.starts, steps)
    held = first.span(start, start + STEPS[place]).astype(np.uint32)
    chosen = anchors(first)
    counts = np.fromiter(map(len, chosen), np.int64, len(texts))
    at, cut = np.concatenate([np.zeros(0, np.int64), *chosen]), np.cumsum(counts)
    start = np.repeat(first.starts, counts)
    spans, sums = _mixed(first.span(start + at, start + at + SPAN)), first.span(start, start + at).astype(np.uint32)
    out = []
    for i, (n, h, g) in enumerate(zip(first.lengths.tolist(), whole.tolist(), again.tolist(), strict=True)):
        own = slice(cut[i] - counts[i], cut[i])
        out.append(Fingerprint(n, f"{h:08x}{g:08x}", held[stops[i] - steps[i] : stops[i]], at[own].astype(np.uint32), spans[own], sums[own]))
    return out, first


def agreed_prefix(a: Fingerprint, b: Fingerprint) -> int:
    """The longest held prefix that is equal in both, by binary search; the whole length if the texts are equal."""
    if (a.n, a.whole) == (b.n, b.whole):
        return a.n
    low, high = 0, min(len(a.prefixes), len(b.prefixes))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a.prefixes[middle - 1] == b.prefixes[middle - 1] else (low, middle - 1)
    return int(STEPS[low - 1]) if low else 0


def _between(x: Fingerprint, i: int, j: int) -> tuple[int, int]:
    """Length and hash of what lies between two anchors of a text, from the prefix hashes at them."""
    start, end = int(x.places[i]), int(x.places[j])
    _POWERS[0].reach(start + 1)
    return end - start, (int(x.sums[j]) - int(x.sums[i])) * int(_POWERS[0].down[start]) % PRIMES[0]


def common_parts(a: Fingerprint, b: Fingerprint) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of parts that are equal in both texts, found from their anchors.

    Only anchors that both texts would choose are looked at. From each pair with equal spans that no part covers yet,
    binary search over the anchors that follow finds the longest common extension.
    """
    limit = min(x.spans.max(initial=0) if len(x.spans) >= KEPT else np.uint32(2**32 - 1) for x in (a, b))
    mine, other = np.flatnonzero(a.spans <= limit), np.flatnonzero(b.spans <= limit)
    where = {int(b.spans[j]): k for k, j in enumerate(other)}
    parts, k = [], 0
    while k < len(mine):
        m = where.get(int(a.spans[mine[k]]), -1)
        if m < 0:
            k += 1
            continue
        low, high = 0, min(len(mine) - k, len(other) - m) - 1
        while low < high:
            step = (low + high + 1) // 2
            ends = mine[k + step], other[m + step]
            same = a.spans[ends[0]] == b.spans[ends[1]] and _between(a, mine[k], ends[0]) == _between(b, other[m], ends[1])
            low, high = (step, high) if same else (low, step - 1)
        parts.append((int(a.places[mine[k]]), int(b.places[other[m]]), int(a.places[mine[k + low]] - a.places[mine[k]]) + SPAN))
        k += low + 1
    return parts


def _covered(spans: list[tuple[int, int]]) -> int:
    total = end = 0
    for start, stop in sorted(spans):
        total += max(0, stop - max(start, end))
        end = max(end, stop)
    return total


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1: the share of the longer text that the agreed prefix and the common parts cover; 1 if both are empty."""
    longer, same = max(a.n, b.n), agreed_prefix(a, b)
    if not longer or same == longer:
        return 1.0
    parts = common_parts(a, b)
    return min(_covered([(0, same), *((i, i + n) for i, _, n in parts)]), _covered([(0, same), *((j, j + n) for _, j, n in parts)])) / longer


def _bounds(rows: DataFrame, parts: int) -> np.ndarray:
    """Up to ``parts - 1`` places (id, text hash) that cut the rows, in order of both, into parts of about one size.

    They come from a sample of about ``PER_PART`` rows a part, chosen by a hash; a null id is the smallest.
    """
    every = max(1, rows.count() // (PER_PART * parts))
    chosen = rows.where(F.pmod(F.xxhash64("id", "h", F.lit(5)), F.lit(every)) == 0).select(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "h")
    sample = np.unique(collected(chosen).to_records(index=False).astype([("id", "<i8"), ("h", "<i8")]))
    return sample[np.linspace(0, len(sample), parts + 1)[1:-1].astype(int)] if len(sample) and parts > 1 else sample[:0]


def _range(bounds: np.ndarray, key: Column) -> Column:
    """How many of the sorted bounds are above a key, by binary search over a constant array."""
    if not len(bounds):
        return F.lit(0).cast("long")
    bits = len(bounds).bit_length()
    most = {"id": (1 << 63) - 1, "h": (1 << 63) - 1}
    padded = [{"id": int(i), "h": int(h)} for i, h in bounds] + [most] * ((1 << bits) - 1 - len(bounds))
    known = F.from_json(F.lit(json.dumps(padded)), "array<struct<id:bigint,h:bigint>>")
    step = lambda at, size: F.when(F.get(known, at + size - 1) <= key, at + size).otherwise(at)
    below = F.aggregate(F.array(*(F.lit(1 << b) for b in range(bits - 1, -1, -1))), F.lit(0), step)
    return F.lit(len(bounds)).cast("long") - F.least(below, F.lit(len(bounds)))


def _chained(docs: DataFrame, id_col: str, text_col: str, part_bytes: int) -> DataFrame:
    """(bucket, id, text, own): rows dealt by descending ids, each bucket followed by the next one's first row.

    Buckets are ranges of (id, text hash), so rows that share an id are split too. Only a row a bucket goes to two
    buckets, so each row's successor stands beside it and texts move once.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, min(MOST_PARTS, math.ceil(total / part_bytes)))
    key = F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "h")
    rows = rows.withColumn("bucket", _range(_bounds(rows.select("id", "h"), parts), key))
    first = {r[0]: r[1] for r in rows.groupBy("bucket").agg(F.max(key).alias("k")).collect()}
    ordered = sorted(first)
    carried = [(b, *first[n], n) for b, n in zip(ordered, ordered[1:] + ordered[:1], strict=True)]
    heads = docs.sparkSession.createDataFrame(carried, "to long, id long, h long, bucket long")
    same = (F.coalesce(rows["id"], F.lit(-(1 << 63))) == heads["id"]) & (rows["h"] == heads["h"]) & (rows["bucket"] == heads["bucket"])
    extra = rows.join(F.broadcast(heads), same).groupBy(heads["to"].alias("bucket")).agg(F.min("text").alias("text"))
    every = rows.select("bucket", "id", "h", "text", F.lit(True).alias("own")).union(extra.select("bucket", F.lit(None).cast("long"), F.lit(None).cast("long"), "text", F.lit(False)))
    return every.repartitionByRange(max(parts, 1), "bucket").sortWithinPartitions(F.col("bucket"), F.col("own").desc(), F.col("id").desc_nulls_last(), F.col("h").desc(), F.col("text"))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the first as many code points of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprints of every whole text and its edited text, and their likeness.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix). The next
    document is that with the next smaller id, after the last the first; of rows with one id that with the larger
    hash of its text comes first, and a null id is last. A null text is an empty one; two empty texts have
    likeness 1. Ids are integers. Other columns are ignored; an empty table gives an empty result.
    ``common_prefix`` is the longest common extension of the text and its edit from their starts. Working memory
    is about 50 bytes a code point of the longest text.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = _chained(docs, id_col, text_col, part_bytes).select("bucket", "id", "own", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int | None, bool, str]] = []
        for batch in batches:
            new = zip(*(batch.column(i).to_pylist() for i in range(3)), (x.as_py().decode("utf-8", "replace") for x in batch.column(3)), strict=True)
            held += list(new)
            for a, b in list(blocks([len(r[3]) for r in held], BLOCK_CHARS))[:-1]:
                yield _block(held[a : b + 1])
            done = list(blocks([len(r[3]) for r in held], BLOCK_CHARS))
            held = held[done[-1][0] :] if done else held
        for a, b in blocks([len(r[3]) for r in held], BLOCK_CHARS):
            yield _block(held[a : b + 1])

    kinds = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix bigint"
    return rows.mapInArrow(run, kinds).withColumnRenamed("id", id_col)


def _block(rows: list[tuple[int, int | None, bool, str]]) -> pa.RecordBatch:
    """Results of the rows that have their successor in the block."""
    own = [i for i in range(len(rows) - 1) if rows[i][2]]
    texts = [r[3] for r in rows]
    made, prefixes = fingerprints(texts)
    changed = [edited(texts[i], texts[i + 1]) for i in own]
    made_2, prefixes_2 = fingerprints(changed)
    at = np.array(own, np.int64)
    n = prefixes.lengths[at] if own else np.zeros(0, np.int64)
    shared = common_extension(prefixes, prefixes.starts[at], prefixes_2, prefixes_2.starts, np.minimum(n, prefixes_2.lengths)) if own else n
    near = [likeness(made[i], made_2[k]) for k, i in enumerate(own)]
    following = [likeness(made[i], made[i + 1]) for i in own]
    digests = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed]
    return pa.RecordBatch.from_arrays(
        [pa.array([rows[i][1] for i in own], pa.int64()), pa.array(n), pa.array(digests, pa.string()), pa.array([str(made[i]) for i in own], pa.string()), pa.array(list(map(str, made_2)), pa.string()), pa.array(near, pa.float64()), pa.array(following, pa.float64()), pa.array(shared, pa.int64())],
        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"],
    )

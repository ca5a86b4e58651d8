"""Jaccard self-join of word n-gram sets by vertical partitioning.

Equal sets are one node. Two frequency passes leave only nodes that can link: a node dies when too few of its n-grams
occur in other nodes. The first pass looks at a fixed third of all 64-bit n-gram hashes (at all n-grams of small
sets), the second at all n-grams of the nodes that are left, mostly real copies. These have their shared n-grams in
one global order of (frequency class, hash) and are joined on a prefix of that order that any linked pair must share;
a posting list first links its nodes to its most central one, and only nodes still in different components are
paired. The order is cut into fragments at pivots of its quantiles; a pair's overlap is counted in each fragment
separately and summed. N-grams travel as plain rows (node, hash): their volume is in proportion to the text
whatever its size, counts are combined before they are shuffled, and joins on a hot n-gram can be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.llm.common import blocks, collected, materialised, short_batches, written
from stratapanel.llm.components import components

#: Words of an n-gram; a link needs 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 80
#: Characters of texts that are hashed together; bytes from which a word is hashed on its own.
BLOCK_CHARS, LONG_WORD = 500_000, 256
#: The first pass takes n-grams below this signed hash (a third of all); smaller sets are taken whole.
SAMPLE_BELOW, SMALL = (1 << 64) // 3 - (1 << 63), 64
#: N-grams of so many of about so many documents are hot, and this many of them at most: they are known to be shared and needn't travel.
HOT_COUNT, HOT_DOCS, MOST_HOT = 16, 20_000, 200_000
#: Rows whose names are sent to all tasks as a bit map at most (32 bits each); more are joined.
MARKED_ROWS = 1 << 24
#: Fragments of the order when overlaps of pairs are counted.
PAIR_FRAGMENTS = 4

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a permutation."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words in ``data``: eight bytes at a time through a permutation, long words by BLAKE2."""
    data, h = np.r_[data, np.zeros(8, np.uint8)], mixed(sizes.astype(np.uint64) + np.uint64(_BASE))
    at, k = np.flatnonzero(sizes <= LONG_WORD), 0
    while len(at):
        left = sizes[at] - k
        eight = data[(starts[at] + k)[:, None] + np.arange(8)].view("<u8")[:, 0] & _MASKS[np.minimum(left, 8)]
        h[at] = mixed(h[at] ^ eight)
        at, k = at[left > 8], k + 8
    for i in np.flatnonzero(sizes > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : starts[i] + sizes[i]].tobytes(), digest_size=8).digest())
    return h


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hash, document) of the distinct n-grams of each UTF-8 text, documents in order.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer than ``WORDS`` words
    has its whole sequence as one n-gram, a text without words none.
    """
    data = np.frombuffer(b"\n" + b"\n".join(texts).translate(_LOWER) + b"\n", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    words = word_hashes(data, starts, ends - starts)
    limits = 1 + np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(limits, starts, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    per = np.diff(first)
    odd = [np.uint64(pow(_BASE, 2 * k + 3, 1 << 64)) for k in range(WORDS)]
    n = max(len(words) - WORDS + 1, 0)
    whole = np.flatnonzero(doc[:n] == doc[WORDS - 1 :]) if n else np.zeros(0, np.int64)
    grams = np.zeros(len(whole), np.uint64)
    for k in range(WORDS):
        grams += words[whole + k] * odd[k]
    short = np.flatnonzero((per > 0) & (per < WORDS))
    few = np.zeros(len(short), np.uint64)
    for k in range(WORDS - 1):
        has = per[short] > k
        few[has] += words[first[short[has]] + k] * odd[k]
    few += per[short].astype(np.uint64) * np.uint64(_BASE)
    grams, owner = np.r_[mixed(grams), mixed(few + np.uint64(1))], np.r_[doc[whole], short]
    order = np.lexsort((grams, owner)) if len(short) else None
    if order is None:
        order = np.argsort(grams, kind="stable")
        order = order[np.argsort(owner[order], kind="stable")]
    grams, owner = grams[order], owner[order]
    fresh = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])][: len(grams)]
    return grams[fresh], owner[fresh]


def _reduced(how: np.ufunc, values: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n), values.dtype)
    if len(values):
        full = n > 0
        out[full] = how.reduceat(values, starts[full])
    return out


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(values.view(np.int64)))


def _blocks_of(batch: pa.RecordBatch, place: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, n-grams, their row, n-grams by row) of blocks of a batch's texts."""
    texts = [x.as_py() or b"" for x in batch.column(place)]
    for a, b in blocks([len(t) for t in texts], BLOCK_CHARS):
        grams, doc = shingle_sets(texts[a:b])
        yield a, b, grams, doc, np.bincount(doc, minlength=b - a)


_SETS = "doc_id long, h long, n int, one long, two long, need int, some array<long>"


def _known(hot: tuple[np.ndarray, np.ndarray], grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams are hot, and the frequency classes of these."""
    if not len(hot[0]):
        return np.zeros(len(grams), bool), hot[1]
    at = np.minimum(np.searchsorted(hot[0], grams), len(hot[0]) - 1)
    known = hot[0][at] == grams
    return known, hot[1][at[known]]


def _sets(hot: tuple[np.ndarray, np.ndarray], lists: bool = True):
    """Of (doc_id, h, text): size and digest of each set, n-grams for the first pass, and how many of those it asks for must be shared.

    ``hot`` n-grams are shared in any case: they are left out and less is needed. Without ``lists`` no n-grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, grams, doc, n in _blocks_of(batch, 2):
                at = np.cumsum(n) - n
                one, two = _reduced(np.add, mixed(grams), at, n), _reduced(np.bitwise_xor, mixed(grams + np.uint64(_BASE)), at, n)
                sampled = grams.view(np.int64) < SAMPLE_BELOW
                asked = sampled | (n < SMALL)[doc]
                shown = sampled | (n * PERCENT < SMALL * 100)[doc]
                known = _known(hot, grams)[0]
                shown &= ~known
                need = np.bincount(doc[asked & ~known], minlength=b - a) - n * (100 - PERCENT) // 100
                some = _lists(grams[shown], np.bincount(doc[shown], minlength=b - a)) if lists else pa.nulls(b - a, pa.list_(pa.int64()))
                columns = [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(need.astype(np.int32)), some]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "n", "one", "two", "need", "some"])

    return run


def _hot(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hot n-grams, sorted, and their frequency classes, from a sample of documents that is chosen by a hash of the id."""
    every = max(1, rows.select("doc_id").count() // HOT_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, grams, _, _ in _blocks_of(batch, 0):
                gram, k = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(k)], ["gram", "k"])

    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(every)) == 0).select("text").mapInArrow(run, "gram long, k long")
    often = some.groupBy("gram").agg(F.sum("k").alias("k")).where(F.col("k") >= HOT_COUNT).orderBy(F.desc("k"), "gram").limit(MOST_HOT)
    often = collected(often)
    gram = often["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(gram)
    return gram[order], np.minimum(8 * np.log2(often["k"].to_numpy(float)[order] * every), 32767).astype(np.int16)


_WHOLE = "doc_id long, h long, n int, grams array<long>, hot array<long>, levels array<smallint>"


def _all_grams(hot: tuple[np.ndarray, np.ndarray]):
    """Of (doc_id, h, text): all n-grams of each set, the hot ones apart and with their frequency classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, grams, doc, n in _blocks_of(batch, 2):
                known, levels = _known(hot, grams)
                k = np.bincount(doc[known], minlength=b - a)
                part = _lists(grams[known], k)
                classes = pa.ListArray.from_arrays(part.offsets, pa.array(levels, pa.int16()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n.astype(np.int32)), _lists(grams[~known], n - k), part, classes], ["doc_id", "h", "n", "grams", "hot", "levels"])

    return run


def _set_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for *_, n in _blocks_of(batch, 0):
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64))], ["n_shingles"])


def _of_live(rows: DataFrame, live: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, h, n, grams, hot, levels) of the rows (doc_id, h, text) named in ``live`` (doc_id, h), each once.

    Up to ``MARKED_ROWS`` names go to all tasks as a bit map of their hashes, so only texts that are needed, and about
    one in thirty-two others, leave their task; those others are harmless, as no n-gram count rests on a row being
    named. More names are joined.
    """
    live = materialised(live, narrow=True)
    n, grams_of = live.count(), _all_grams(hot)
    if n > MARKED_ROWS:
        once = rows.groupBy("doc_id", "h").agg(F.first("text").alias("text"))
        return once.join(live, ["doc_id", "h"]).mapInArrow(grams_of, _WHOLE)
    size = 1 << max(15, (32 * n).bit_length())
    place = F.pmod(F.xxhash64("doc_id", "h"), F.lit(size))
    maps = live.groupBy(F.bitmap_bucket_number(place + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits")).collect()
    marks = bytearray(size // 8)
    for k, bits in maps:
        marks[(k - 1) * 4096 : k * 4096] = bits
    shared = rows.sparkSession.sparkContext.broadcast(bytes(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            at = batch.column(3).to_numpy()
            some = batch.filter(pa.array((marks[at >> 3] >> (at & 7)) & 1 > 0))
            yield from grams_of(iter((some,)))

    marked = rows.select("doc_id", "h", "text", place.alias("at"))
    return marked.mapInArrow(run, _WHOLE).groupBy("doc_id", "h").agg(*(F.first(c).alias(c) for c in ("n", "grams", "hot", "levels")))


def _may_link(n: Column, m: Column) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def _linked(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Those of (a, n_a, b, n_b) that are links: overlaps counted by fragment, summed by pair."""
    wide = pairs.withColumn("f", F.explode(F.array(*map(F.lit, range(PAIR_FRAGMENTS)))))
    mine = wide.join(segments.select(F.col("node").alias("a"), "f", F.col("part").alias("part_a")), ["a", "f"])
    both = mine.join(segments.select(F.col("node").alias("b"), "f", F.col("part").alias("part_b")), ["b", "f"])
    counted = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("k")).groupBy("a", "b", "n_a", "n_b").agg(F.sum("k").alias("k"))
    return counted.where(F.col("k") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("k")) * PERCENT).select("a", "b")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Two rows link if their sets of distinct five-word n-grams have a Jaccard similarity of 0.8 or more; the
    component is the smallest id reachable. Null texts and texts without words have an empty set and no links.
    Equal sets are one node, so repeated rows and exact copies link; rows of one id with different texts are
    different nodes. Ids are integers. A row without an id can't be named as a partner: it links with nothing and has
    no component. Other columns are ignored; an empty table gives an empty result. Words and n-grams are compared
    by 64-bit hashes, sets by 128 bits.
    """
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(text_col).cast("binary")).mapInArrow(_set_sizes, "n_shingles long")
    nameless = nameless.select(F.lit(None).cast("long").alias(id_col), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    named = _similar(docs, id_col, text_col).select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component.doc_id").alias("component_id"))
    return named.union(nameless)


def _similar(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, n, component) of rows that have an id; a row is named by its id and the hash of its text, and a component by its least row."""
    short_batches(docs.sparkSession)
    text = F.col(text_col).cast("binary")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    hot = _hot(rows)
    sets = written(rows.mapInArrow(_sets(hot, lists=False), _SETS).drop("some"), "sets")
    row, gram = F.struct("doc_id", "h"), Window.partitionBy("gram")
    found = sets.where("n > 0").groupBy("one", "two", "n")
    first = found.agg(F.min(row).alias("node"), F.count(F.lit(1)).alias("rows"))
    asked = (F.col("n") < SMALL) | (F.col("gram") < SAMPLE_BELOW)
    shown = rows.mapInArrow(_sets(hot), _SETS).select("doc_id", "one", "n", "need", F.explode("some").alias("gram")).select("doc_id", "one", "need", "gram", asked.alias("asked"))
    other = F.min("one").over(gram) != F.max("one").over(gram)
    shared = shown.select("doc_id", "one", "need", "asked", other.alias("other")).where("asked and other")
    live = shared.groupBy("doc_id", "one", "need").agg(F.count(F.lit(1)).alias("k")).where("k >= need").select("doc_id", "one")
    live = live.union(sets.where("need <= 0 and n > 0").select("doc_id", "one"))
    live = first.select("node.*", "one").join(live, ["doc_id", "one"], "left_semi").select("doc_id", "h").distinct()
    whole = materialised(_of_live(rows, live, hot))
    counted = whole.select("doc_id", "h", "n", F.explode("grams").alias("gram")).withColumn("df", F.count(F.lit(1)).over(gram)).where("df > 1")
    cold = counted.select("doc_id", "h", "n", F.struct(F.floor(8 * F.log2("df")).cast("smallint").alias("level"), "gram").alias("x"))
    known = whole.select("doc_id", "h", "n", F.explode(F.arrays_zip(F.col("levels").alias("level"), F.col("hot").alias("gram"))).alias("x"))
    ordered = cold.union(known).groupBy("doc_id", "h", "n").agg(F.sort_array(F.collect_list("x")).alias("grams"))
    ordered = ordered.withColumn("shared", F.size("grams")).where(F.col("shared") * 100 >= F.col("n") * PERCENT)
    named = components(_links(materialised(ordered.select(row.alias("node"), "n", "shared", "grams"))))
    classes = first.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    changed = classes.where("rows > 1 or component <> node").select("one", "two", "n", "component")
    joined = sets.select("doc_id", "h", "n", "one", "two").join(changed, ["one", "two", "n"], "left")
    return joined.select("doc_id", "h", "n", F.coalesce("component", row).alias("component"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each group of linked rows, that with the smallest id; columns unchanged.

    Only rows that go are joined, by id and text, so rows of one id with unrelated texts are judged each on its own.
    Of linked rows that share the smallest id, the one with the smallest hash of its text stays, and of repeated
    rows one. Rows with an empty set, or without an id, all stay.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows, id_name, text_name = docs.toDF(*names), names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    found = written(_similar(rows.select(F.col(id_name).alias("doc_id"), F.col(text_name).alias("text")), "doc_id", "text"), "similar")
    mine, own = F.struct("doc_id", "h"), F.xxhash64(F.col(text_name).cast("binary"))
    go = found.where(mine != F.col("component")).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    twins = found.where((F.col("n") > 0) & (mine == F.col("component"))).groupBy("doc_id", "h").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    same = lambda: (F.col(id_name) == F.col("__id")) & (own == F.col("__h"))
    kept = rows.join(go, same(), "left_anti")
    if twins.limit(1).count():
        once = kept.join(twins, same(), "left_semi").withColumn("__h", own).groupBy(F.col(id_name).alias("__id"), "__h").agg(*(F.first(c).alias(c) for c in names))
        kept = kept.join(twins, same(), "left_anti").union(once.select(*names))
    return kept.toDF(*docs.columns)


def _key(x: Column) -> Column:
    """A number that rises along the order of (frequency class, n-gram)."""
    return x["level"] + x["gram"] / 2.0**64 + 0.5


def _pivots(nodes: DataFrame) -> list[float]:
    """Keys that cut the occurrences of the order into ``PAIR_FRAGMENTS`` parts of about one size."""
    parts = [i / PAIR_FRAGMENTS for i in range(1, PAIR_FRAGMENTS)]
    return sorted(nodes.select(F.explode(F.transform("grams", _key)).alias("key")).agg(F.percentile_approx("key", parts)).first()[0] or [])


def _links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all linked nodes; not all links inside a component.

    A posting knows the place of its n-gram in its node's order. If that is the first n-gram a pair shares, the
    overlap is at most what follows in either node, so the posting serves partners up to a size (``reach``) only.
    Postings that reach no node of their list are dropped before any pair is made. Rare n-grams come first, so a
    passage of very many nodes is in a prefix only where nearly all of a node is such passages. Lists are written
    before they are joined, so that a very frequent n-gram is a skewed join key that is split, not one task.
    """
    pivots = _pivots(nodes)
    bounds = [None, *pivots, *[float("inf")] * (PAIR_FRAGMENTS - 1 - len(pivots)), None]
    inside = lambda low, high: lambda x: (F.lit(True) if low is None else _key(x) >= low) & (F.lit(True) if high is None else _key(x) < high)
    part = lambda i: F.transform(F.filter("grams", inside(bounds[i], bounds[i + 1])), lambda x: x["gram"])
    pieces = F.array(*(F.struct(F.lit(i).alias("f"), part(i).alias("part")) for i in range(PAIR_FRAGMENTS)))
    segments = nodes.select("node", F.explode(pieces).alias("x")).select("node", "x.f", "x.part").where(F.size("part") > 0)
    needed = F.floor((F.col("n") * PERCENT + 99) / 100)
    prefix = (F.col("shared") - needed + 1).cast("int")
    postings = nodes.where(prefix > 0).select("node", "n", "shared", F.posexplode(F.slice("grams.gram", F.lit(1), prefix)).alias("i", "gram"))
    left = F.col("shared") - F.col("i")
    postings = postings.withColumn("reach", F.floor(left * (100 + PERCENT) / PERCENT) - F.col("n")).where(F.col("reach") * 100 >= F.col("n") * PERCENT)
    for _ in range(2):
        lists = postings.groupBy("gram").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1")
        postings = materialised(postings.join(materialised(lists.select("gram", "least"), narrow=True), "gram").where("reach >= least").drop("least"), narrow=True)
    centre = F.struct((-F.col("shared") / F.col("n")).alias("r"), "n", "node", "reach")
    lists = postings.groupBy("gram").agg(F.min(centre).alias("c"), F.count(F.lit(1)).alias("k")).where("k > 1")
    pairs = postings.join(materialised(lists.select("gram", "c"), narrow=True), "gram").where("node <> c.node and reach >= c.n and c.reach >= n").where(_may_link(F.col("n"), F.col("c.n")))
    pairs = materialised(pairs.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("c.node").alias("b"), F.col("c.n").alias("n_b")).distinct(), narrow=True)
    links = materialised(_linked(pairs, segments), narrow=True)
    names = materialised(components(links), narrow=True)
    own = postings.join(names, postings["node"] == names["node"], "left").select(postings["node"], "n", "reach", "gram", F.coalesce("component", postings["node"]).alias("name"))
    own = materialised(own, narrow=True)
    mixed_lists = materialised(own.groupBy("gram").agg(F.min("name").alias("x"), F.max("name").alias("y")).where("x <> y").select("gram"), narrow=True)
    open_rows = materialised(own.join(mixed_lists, "gram"), narrow=True)
    a, b = open_rows.alias("a"), open_rows.alias("b")
    across = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.name") != F.col("b.name")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.reach") >= F.col("b.n")) & (F.col("b.reach") >= F.col("a.n")) & _may_link(F.col("a.n"), F.col("b.n")))
    across = across.select(F.col("a.node").alias("a"), F.col("a.n").alias("n_a"), F.col("b.node").alias("b"), F.col("b.n").alias("n_b")).distinct()
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = materialised(across.join(tried, ["a", "b"], "left_anti"), narrow=True)
    return links.union(_linked(across, segments))

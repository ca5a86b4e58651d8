"""Language identification by interpolated Kneser-Ney character language models.

Texts become lower-case letters with single spaces between runs of letters. For each language a model of
``ORDER`` characters is estimated with interpolated Kneser-Ney smoothing: raw counts at the highest order,
continuation counts below, a uniform base. N-grams are 64-bit integers (16 bits a character) multiplied by an
odd constant; each order is a sorted array of such hashes with a row of log probabilities per language. A text
gets the language of the lowest cross-entropy per character. A threshold on that cross-entropy, set on training
texts kept aside, rejects texts that no model fits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import blocks, collected, short_batches

ORDER = 4
#: The classifier is fitted on so many labelled texts a language at most.
FIT_TEXTS = 3000
#: Characters that are handled together.
BLOCK_CHARS = 1_000_000
#: An odd 64-bit constant: multiplying by it permutes the n-grams.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Share of the calibration texts that may exceed the rejection threshold, and share of their scrambled copies that may stay below it.
REJECT_SHARE, SCRAMBLED_SHARE = 0.002, 0.05
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []
#: Marks of a kind of letter: 1 for letters, 2 for marks that belong to one.
LETTER, MARK = 1, 2


def letters() -> np.ndarray:
    """By code point: LETTER, MARK or 0. A text of marks alone has no letter."""
    if not _LETTERS:
        import unicodedata

        kinds = {"L": LETTER, "M": MARK}
        _LETTERS.append(np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8))
    return _LETTERS[0]


@dataclass
class Characters:
    """Codes of a block of texts; ``ORDER - 1`` zeros before each."""

    codes: np.ndarray
    text: np.ndarray
    at: np.ndarray
    has_letter: np.ndarray


def characters(texts: list[str | None]) -> Characters:
    gap = "\0" * (ORDER - 1)
    joined = gap + gap.join(" " + (t or "").replace("\0", " ").lower() + " " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    codes = np.where(letter > 0, codes, np.where(codes == 0, 0, 32))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    starts = (codes == 0) & np.r_[True, codes[:-1] != 0]
    text = np.cumsum(starts) - 1
    has = np.zeros(len(texts), bool)
    has[np.unique(text[letter == LETTER])] = True
    codes, text = np.where(codes > 0xFFFF, 0xE000 + codes % 0x1900, codes)[keep].astype(np.uint64), text[keep]  # rare letters share the private codes
    return Characters(codes, text, np.flatnonzero(codes), has)


def grams(block: Characters) -> np.ndarray:
    """The n-gram of ``ORDER`` characters that ends at each character."""
    key, at = np.zeros(len(block.at), np.uint64), block.at
    for back in range(ORDER - 1, -1, -1):
        key = (key << np.uint64(16)) | block.codes[at - back]
    return key


def counts(texts: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over all given texts; each batch is counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            rows = [(x.as_py() or b"").decode("utf-8", "replace") for x in batch.column(0)]
            for a, b in blocks([len(x) for x in rows], BLOCK_CHARS):
                block = characters(rows[a:b])
                key, lang = grams(block), code[a:b][block.text[block.at]]
                for i, name in enumerate(names):
                    found, n = np.unique(key[lang == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    rows = texts.select(F.col(text_col).cast("binary"), F.col(lang_col))
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted hash arrays by order: n-grams with log probabilities, contexts with log back-off weights."""

    langs: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    base: float
    scale: float = 1.0
    threshold: float = np.inf


def _hashed(keys: np.ndarray, *rows: np.ndarray) -> list[np.ndarray]:
    hashed = keys * SPREAD
    order = np.argsort(hashed)
    return [hashed[order], *(r[order] for r in rows)]


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (16 * order)) - 1)


def kneser_ney(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """The models of all languages from (language index, n-gram, count)."""
    keys, place = np.unique(gram, return_inverse=True)
    table = np.zeros((len(keys), len(langs)))
    table[place, lang] = n
    orders = [(keys, table)]
    for order in range(ORDER - 1, 0, -1):
        lower, to = np.unique(orders[0][0] & _mask(order), return_inverse=True)
        continued = np.zeros((len(lower), len(langs)))
        np.add.at(continued, to, (orders[0][1] > 0).astype(float))
        orders.insert(0, (lower, continued))
    base = 1.0 / (len(orders[0][0]) + 1)
    model, below = Model(list(langs), [], [], [], [], np.log(base)), None
    for order, (keys, table) in enumerate(orders, 1):
        ones, twos = (table == 1).sum(0), (table == 2).sum(0)
        discount = np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5).clip(0.1, 0.95)
        contexts, to = np.unique(keys >> np.uint64(16), return_inverse=True)
        total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(total, to, table)
        np.add.at(kinds, to, (table > 0).astype(float))
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        lower = np.full(table.shape, base) if below is None else below[1][np.searchsorted(below[0], keys & _mask(order - 1))]
        p = np.maximum(table - discount, 0) / np.maximum(total, 1)[to] + weight[to] * lower
        below = (keys, p)
        k, v = _hashed(keys, np.log(p).astype(np.float32))
        c, w = _hashed(contexts, np.log(weight).astype(np.float32))
        model.keys.append(k)
        model.logs.append(v)
        model.contexts.append(c)
        model.weights.append(w)
    return model


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == wanted


def log_probabilities(model: Model, key: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each n-gram, the log probability of its last character in each language."""
    if order == 0:
        return np.full((len(key), len(model.langs)), model.base, np.float32)
    at, seen = _find(model.keys[order - 1], key * SPREAD)
    out = model.logs[order - 1][at]
    if not seen.all():
        rest = key[~seen]
        lower = log_probabilities(model, rest & _mask(order - 1), order - 1)
        at, known = _find(model.contexts[order - 1], (rest >> np.uint64(16)) * SPREAD)
        out[~seen] = lower + np.where(known[:, None], model.weights[order - 1][at], 0)
    return out


def cross_entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nats a character by text and language, characters, and whether there is a letter."""
    total, n, has = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for a, b in blocks([len(t or "") for t in texts], BLOCK_CHARS):
        block = characters(texts[a:b])
        has[a:b] = block.has_letter
        for i in range(0, len(block.at), BLOCK_CHARS):
            part = Characters(block.codes, block.text, block.at[i : i + BLOCK_CHARS], block.has_letter)
            text = part.text[part.at]
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            total[a + text[first]] -= np.add.reduceat(log_probabilities(model, grams(part)), first, axis=0, dtype=float)
            n[a + text[first]] += np.diff(np.r_[first, len(text)])
    return total / np.maximum(n, 1)[:, None], n, has


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = FIT_TEXTS) -> Model:
    """The models of the languages named in the rows where ``train`` holds.

    Learns from at most about ``per_lang`` texts a language, chosen by a hash of the id; a tenth of them are kept
    aside for calibration. Rows without a text or a language are left out. Without rows there are no languages.
    """
    labelled = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    langs = sorted(found)
    if not langs:
        return Model([], [], [], [], [], 0.0)
    share = F.lit(0.0)
    for name, n in found.items():
        share = F.when(F.col(lang_col) == F.lit(name), F.lit(min(1.0, per_lang / n))).otherwise(share)
    name = F.coalesce(F.col(id_col).cast("string"), F.sha1(F.col(text_col).cast("binary")))
    place = F.pmod(F.xxhash64(name, F.lit(8)), F.lit(1_000_000)) / 1_000_000.0
    chosen = labelled.where(place < share)
    aside = F.pmod(F.xxhash64(name, F.lit(88)), F.lit(10)) == 0
    table = collected(counts(chosen.where(~aside), text_col, lang_col))
    if table.empty:
        return Model([], [], [], [], [], 0.0)
    langs = sorted(set(table["lang"]))
    model = kneser_ney(langs, table["lang"].map(langs.index).to_numpy(), table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy())
    scrambled = F.transform(F.array_sort(F.transform(F.split(text_col, ""), lambda c, i: F.struct(F.xxhash64(i, F.lit(7)).alias("h"), c.alias("c")))), lambda x: x["c"])
    kept = chosen.where(aside).select(id_col, F.col(lang_col).alias("__lang"), F.col(text_col).alias("__t"))
    both = kept.withColumn("__bad", F.lit(False)).union(chosen.where(aside).select(id_col, F.col(lang_col), F.array_join(scrambled, "")).withColumn("__bad", F.lit(True)))
    measured = collected(_measured(both, model, id_col, "__t", ["__lang", "__bad"]).select("__lang", "__bad", "n", "ces"))
    good, bad = measured[~measured["__bad"]], measured[measured["__bad"]]
    calibrate(model, good["__lang"].to_numpy(), good["n"].to_numpy(), list(good["ces"]), [min(c) for c in bad["ces"][bad["n"] > 0]])
    return model


def calibrate(model: Model, lang: np.ndarray, n: np.ndarray, ces: list, scrambled: list[float]) -> None:
    """Sets the scale of the score, by likelihood, and the rejection threshold.

    The threshold is half-way between nearly all texts kept aside and nearly all of their ``scrambled`` copies (the
    same characters in another order), or just above the former where the two overlap.
    """
    rows = [(model.langs.index(x), min(k, 200), np.asarray(c)) for x, k, c in zip(lang, n, ces, strict=True) if x in model.langs and k]
    if not rows:
        return
    right, size, ce = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def loss(scale: float) -> float:
        z = -(ce - ce.min(1, keepdims=True)) * size[:, None] * scale
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), right]))

    model.scale = min((0.01 * 2**i for i in range(10)), key=loss)
    best = ce.min(1)
    own = float(np.quantile(best, 1 - REJECT_SHARE))
    model.threshold = max(own, (own + float(np.quantile(scrambled, SCRAMBLED_SHARE))) / 2) if scrambled else own


def _measured(docs: DataFrame, model: Model, id_col: str, text_col: str, more: list[str]) -> DataFrame:
    """(id, more..., n, ces): characters and cross-entropies of every whole text."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*(F.col(c) for c in [*more]), F.col(text_col).cast("binary").alias("__text"), F.col(id_col).alias("__id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = [None if (v := x.as_py()) is None else v.decode("utf-8", "replace") for x in batch.column(batch.num_columns - 2)]
            ce, n, has = cross_entropies(model, rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], batch.column(batch.num_columns - 1), pa.array(np.where(has, n, 0).astype(np.int64)), pa.array(list(ce), pa.list_(pa.float64()))], [*more, "__id", "n", "ces"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in more]
    return kept.mapInArrow(run, ", ".join([*fields, f"__id {docs.schema[id_col].dataType.simpleString()}", "n bigint", "ces array<double>"])).withColumnRenamed("__id", id_col)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, cross_entropy, rejected) of every row; score is the calibrated probability.

    ``und`` and score 0 if the text is null, has no letter or there is no model; such rows are rejected, as are
    texts whose best cross-entropy is above the calibrated threshold. Equal cross-entropies: the first language
    in alphabetical order. Repeated rows give repeated results; other columns are ignored.
    """
    if not model.langs:
        return docs.select(F.col(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    best = F.array_min("ces")
    spread = F.aggregate("ces", F.lit(0.0), lambda s, c: s + F.exp(-(c - best) * F.least(F.col("n"), F.lit(200)) * F.lit(model.scale)))
    known = F.col("n") > 0
    name = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("ces", best).cast("int"))
    return _measured(docs, model, id_col, text_col, []).select(
        F.col(id_col),
        F.when(known, name).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(known, 1.0 / spread).otherwise(F.lit(0.0)).alias("score"),
        F.when(known, best).alias("cross_entropy"),
        (~known | (best > F.lit(model.threshold))).alias("rejected"),
    )


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns unchanged; all rows if there is no model."""
    if not model.langs:
        return docs
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ce, _, has = cross_entropies(model, batch.column(place).to_pylist())
            yield batch.filter(pa.array(has & (ce.min(1) <= model.threshold)))

    return docs.mapInArrow(run, docs.schema)

"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs to plain letters and undoes digit substitutions; whole words of plain letters
are also found under accents, which other languages need as they are. The lexicon
is learned from labelled documents: words and word stems (``stem*``) are taken greedily while they explain toxic
documents that few terms before explain, weighted by log odds. Exception phrases are blanked before matching. The weight found, and its rate by
length, become a probability through a logistic curve fitted on labelled documents that the terms were not chosen from.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import collected, short_batches

#: Labelled documents that are learned from at most; lexicon terms at most.
FIT_DOCS, TERMS = 40_000, 400
#: A toxic document asks for so many terms; a term must serve so many that ask, and be so many times as frequent as elsewhere.
ASKED, LEAST_DOCS, LEAST_RATIO = 3, 4, 5.0
#: One in so many labelled documents is kept aside for the curve; with fewer of a label than this it is fitted on all.
ASIDE, LEAST_ASIDE = 5, 20
#: Toxic documents whose sets of words are so alike (Jaccard) count as one; they are found by so many bands of so many minhashes.
COPY_LIKENESS, BANDS, BAND_HASHES = 0.8, 10, 6
#: Letters of a stem.
STEMS = range(3, 9)
# Look-alike letters of other scripts, and digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһқтмнвкαεορτυνικβκλ", "aeopcyxijsdhktmhbkaeoptuvikbkl", strict=True)) | {"ı": "i", "ł": "l", "đ": "d"}
DIGITS = dict(zip("013457@$!|", "oieastasil", strict=True))
#: One or two such signs before a letter stand for letters; signs that end a word don't.
_SIGNS = re.compile(r"(?<![013457@$!|])[013457@$!|]{1,2}(?=[^\W\d_])")
#: Harmless phrases with words that may be in a lexicon.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "rodeo clown", "pond scum", "sore loser clause")


def fold_table(accents: bool) -> dict[int, str]:
    """Look-alikes and full-width letters; with ``accents``, accented Latin letters too."""
    table = {ord(a): b for a, b in HOMOGLYPHS.items()}
    for code in (*(range(0xC0, 0x250) if accents else ()), *range(0xFF01, 0xFF5F)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if plain.isascii() and plain.isalpha():
            table.setdefault(code, plain)
    for code in (*range(0x200B, 0x2010), 0xAD, 0x2060, 0xFEFF):
        table[code] = ""
    return table


_FOLD, _PLAIN = fold_table(False), fold_table(True)


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    return _SIGNS.sub(lambda m: "".join(DIGITS[c] for c in m[0]), text)


def words(folded: str) -> list[str]:
    """Runs of letters."""
    return "".join(c if c.isalpha() else " " for c in folded).split() if not folded.isascii() else folded.translate(_ASCII).split()


_ASCII = {c: " " for c in range(128) if not chr(c).isalpha()}


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: Intercept, and factors of the logarithms of the total weight and of its rate a hundred words.
    curve: tuple[float, float, float] = (-3.0, 1.0, 0.0)
    _matcher: object = field(default=None, repr=False, compare=False)

    def matcher(self):
        if self._matcher is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            by_text = defaultdict(list)
            for term, weight in self.weights.items():
                by_text[term.removesuffix("*")].append((term, weight))
            for text, terms in by_text.items():
                made.add_word(text, (text, terms))
            for phrase in self.exceptions:
                made.add_word(phrase, (phrase, None))
            made.make_automaton()
            self._matcher = made
        return self._matcher

    def __getstate__(self):
        return self.__dict__ | {"_matcher": None}

    def matches(self, text: str) -> list[tuple[int, str, float]]:
        """(place in the folded text, term, weight) outside exception phrases; at one place the heaviest term."""
        if not self.weights:
            return []
        folded = fold(text)
        found, blanks = self._found(folded, stems=True)
        if not folded.isascii() and len(plain := folded.translate(_PLAIN)) == len(folded):
            more, also = self._found(plain, stems=False)
            at = {x[0] for x in found}
            found, blanks = sorted([*found, *(x for x in more if x[0] not in at)]), blanks + also
        if blanks:
            found = [x for x in found if not any(a <= x[0] <= b for a, b in blanks)]
        return found

    def _found(self, folded: str, stems: bool) -> tuple[list[tuple[int, str, float]], list[tuple[int, int]]]:
        found, blanks = [], []
        for end, (text, terms) in self.matcher().iter(folded):
            start = end - len(text) + 1
            if start and folded[start - 1].isalpha():
                continue
            whole = end + 1 == len(folded) or not folded[end + 1].isalpha()
            if terms is None:
                if whole:
                    blanks.append((start, end))
                continue
            found += [(start, term, weight) for term, weight in terms if (stems and term.endswith("*")) or (whole and not term.endswith("*"))]
        best: dict[int, tuple[int, str, float]] = {}
        for x in found:
            if x[0] not in best or x[2] > best[x[0]][2]:
                best[x[0]] = x
        return sorted(best.values()), blanks

    def measures(self, text: str | None) -> tuple[float, float, int]:
        """The logarithms of the total weight and of the weight a hundred words, and the number of matches."""
        text = text or ""
        found = self.matches(text)
        total = sum(x[2] for x in found)
        return float(np.log1p(total)), float(np.log1p(100 * total / (text.count(" ") + text.count("\n") + 10))) if total else 0.0, len(found)

    def score(self, text: str | None) -> tuple[float, int]:
        a, b, n = self.measures(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))), n


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Coefficients (intercept first) by Newton steps; factors other than the intercept are shrunk a little."""
    x, beta = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    shrink = ridge * np.eye(len(beta))
    shrink[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + shrink, x.T @ (y - p) - shrink @ beta)
        beta += np.clip(step, -5, 5)
    return beta


def terms_of(has: set[str]) -> set[str]:
    """A document's words and their stems."""
    return has | {f"{w[:k]}*" for w in has for k in STEMS if len(w) >= k}


_FACTORS = np.random.default_rng(6).integers(0, 1 << 63, (BANDS * BAND_HASHES, 2), dtype=np.uint64) | np.uint64(1)


def bands(has: set[str]) -> list[int]:
    """A hash of each band of minhashes: near copies share one or more, other documents seldom."""
    if not has:
        return [0] * BANDS
    hashes = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest()) for w in has], np.uint64)
    least = np.array([((hashes ^ (hashes >> np.uint64(31)) ^ b) * a >> np.uint64(8)).min() for a, b in _FACTORS], np.uint64).reshape(BANDS, BAND_HASHES)
    return [int.from_bytes(hashlib.blake2b(row.tobytes(), digest_size=8).digest(), signed=True) for row in least]


def without_copies(rows: Iterable[tuple[list[int], str]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """All words, and the word numbers of each document (bands, words joined by spaces) that is no near copy of one before."""
    number: dict[str, int] = {}
    kept: list[np.ndarray] = []
    at: defaultdict[tuple[int, int], list[int]] = defaultdict(list)
    for keys, text in rows:
        own = np.sort(np.array([number.setdefault(w, len(number)) for w in text.split()], np.int32))
        near = {i for key in enumerate(keys) for i in at[key]}
        if any(_likeness(own, kept[i]) >= COPY_LIKENESS for i in near):
            continue
        for key in enumerate(keys):
            at[key].append(len(kept))
        kept.append(own)
    return np.array(list(number), object), kept


def _likeness(a: np.ndarray, b: np.ndarray) -> float:
    if min(len(a), len(b)) < COPY_LIKENESS * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1) if len(a) + len(b) else 1.0


def worthy(everywhere: Counter, n: int, others: Counter, n_others: int) -> dict[str, float]:
    """The logarithm of how many times as frequent as elsewhere each term is that may be chosen."""
    ratio = lambda w: (everywhere[w] / n) / ((others[w] + 0.5) / (n_others + 1))
    return {w: float(np.log(ratio(w))) for w, k in everywhere.items() if k >= LEAST_DOCS and len(w) >= 3 and ratio(w) >= LEAST_RATIO}


def choose_terms(toxic: list[set[str]], others: Counter, n_others: int) -> dict[str, float]:
    """Terms that explain the toxic documents (sets of terms), taken greedily, with their log odds."""
    everywhere: Counter = Counter()
    for has in toxic:
        everywhere.update(has)
    worth = worthy(everywhere, len(toxic), others, n_others)
    serves = defaultdict(set)
    for i, has in enumerate(toxic):
        for word in has & worth.keys():
            serves[word].add(i)
    asks = [ASKED] * len(toxic)
    weights: dict[str, float] = {}
    while serves and len(weights) < TERMS:
        word = min(serves, key=lambda w: (-len(serves[w]) * worth[w], -len(w), w))
        new = serves.pop(word)
        if len(new) < LEAST_DOCS:
            break
        text = word.removesuffix("*")
        if any(t.endswith("*") and text.startswith(t[:-1]) and worth[word] < worth[t] + 1 or text == t or word.endswith("*") and t.startswith(text) for t in weights):
            continue
        weights[word] = float(np.log((everywhere[word] + 0.5) / (len(toxic) - everywhere[word] + 0.5)) - np.log((others[word] + 0.5) / (n_others - others[word] + 0.5)))
        for i in new:
            asks[i] -= 1
        done = {i for i in new if not asks[i]}
        if done:
            for rest in serves.values():
                rest -= done
    return {w: max(x, 0.5) for w, x in weights.items()}


def fit(docs: DataFrame, labels: DataFrame, train: Column, fit_docs: int = FIT_DOCS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon and curve learned from labelled documents (doc_id, toxic) where ``train`` (over doc_id) holds.

    At most ``fit_docs`` labels are used, chosen by a hash of the id; that bound holds for all that is broadcast or
    brought to the driver. Toxic near copies (a checked Jaccard likeness) count once. Without labels of both kinds the lexicon is empty.
    """
    spark = docs.sparkSession
    short_batches(spark)
    known = labels.where(F.coalesce(train, F.lit(False)) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    every = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).join(F.broadcast(known), "doc_id")
    every = every.select("toxic", "text", (F.pmod(F.xxhash64("doc_id", F.lit(66)), F.lit(ASIDE)) == 0).alias("aside"))
    chosen = every.where("not aside").select("toxic", "text")

    def toxic_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [set(words(fold(x.as_py().decode("utf-8", "replace")))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([bands(r) for r in rows], pa.list_(pa.int64())), pa.array([" ".join(sorted(r)) for r in rows], pa.string())], ["bands", "words"])

    rows = collected(chosen.where("toxic > 0").mapInArrow(toxic_words, "bands array<bigint>, words string")).sort_values("words", kind="stable")
    if rows.empty:
        return Lexicon({}, exceptions)
    names, once = without_copies(zip(rows["bands"], rows["words"], strict=True))
    del rows
    seen = Counter()
    for own in once:
        seen.update(terms_of(set(names[own])))
    asked = spark.sparkContext.broadcast(frozenset(w for w, k in seen.items() if k >= LEAST_DOCS))

    def other_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0
        for batch in batches:
            for text in batch.column(1):
                counts.update(terms_of(set(words(fold(text.as_py().decode("utf-8", "replace"))))) & asked.value)
                n += 1
        counts[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    table = collected(chosen.where("toxic = 0").mapInArrow(other_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    others = Counter(dict(zip(table["word"], table["n"].astype(int), strict=True)))
    good = {w: w for w in worthy(seen, len(once), others, others[""])}
    toxic = [{good[w] for w in terms_of(set(names[own])) if w in good} for own in once]
    lexicon = Lexicon(choose_terms(toxic, others, others[""]), exceptions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [lexicon.measures(x.as_py().decode("utf-8", "replace")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64())], ["toxic", "a", "b"])

    aside = collected(every.where("aside").select("toxic", "text").mapInArrow(measure, "toxic int, a double, b double"))
    few = min((aside["toxic"] > 0).sum(), (aside["toxic"] <= 0).sum()) < LEAST_ASIDE
    table = pd.concat([aside, collected(chosen.mapInArrow(measure, "toxic int, a double, b double"))]) if few else aside
    y = (table["toxic"] > 0).to_numpy(float)
    if 0 < y.mean() < 1:
        lexicon.curve = tuple(map(float, logistic(table[["a", "b"]].to_numpy(), y)))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_matches) of every whole text; null and empty texts get the score of a text without matches.

    Repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.
    """
    short_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [lexicon.score((x.as_py() or b"").decode("utf-8", "replace")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64())], ["id", "score", "n_matches"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, score double, n_matches bigint").withColumnRenamed("id", id_col)

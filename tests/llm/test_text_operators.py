"""BPE, language ID, fingerprints and toxicity against plain versions, with the edge cases each defines."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapanel.llm import bpe, fingerprint, langid, queries, toxicity
from stratapanel.llm.common import blocks

EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "x" * 50_000), (6, "Grüße 日本語 😀 l'été 123"), (6, "Grüße 日本語 😀 l'été 123"), (None, "no id"), (7, "1234567 !!! ???")]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([(i, t, "k", [1.0]) for i, t in EDGES], "doc_id long, text string, ids string, spans array<double>")


@pytest.fixture
def empty(edges):
    return edges.where("false")


def test_blocks_cover_all_items():
    assert list(blocks([5, 1, 1, 9, 2], 3)) == [(0, 1), (1, 3), (3, 4), (4, 5)]
    assert list(blocks([], 3)) == []


class TestBpe:
    def test_equals_the_library(self, spark, edges):
        import tiktoken

        path, pattern = queries.tokenizer()
        plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
        texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
        docs = edges.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
        got = sorted(map(tuple, bpe.round_trip(docs, path, pattern).collect()), key=str)
        want = []
        for i, t in [*EDGES, *enumerate(texts, 100)]:
            ids = plain.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert got == sorted(want, key=str)

    def test_encode_then_decode_gives_the_bytes(self, edges, empty):
        path, pattern = queries.tokenizer()
        back = bpe.decode(bpe.encode(edges, path, pattern), path, pattern)
        assert sorted((bytes(r[1]) for r in back.collect())) == sorted((t or "").encode() for _, t in EDGES)
        assert bpe.encode(empty, path, pattern).count() == 0

    def test_memo_that_overflows_changes_nothing(self, monkeypatch):
        path, pattern = queries.tokenizer()
        ranks = bpe.read_ranks(path)
        monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
        codec = bpe.Codec(ranks, bpe.model_bytes(ranks), pattern)
        text = "one two three four five six two one qqzzxx"
        assert [codec.decode(codec.encode(text)) for _ in range(3)] == [text.encode()] * 3


class TestLanguage:
    def test_held_out_accuracy(self, spark, tables):
        got = queries.op8_language_id(spark, "/root/testdata/sf0.01")
        langs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
        held = got.join(langs, "doc_id").where("held_out")
        assert held.where("lang_pred = lang").count() / held.count() > 0.97
        assert got.where("score < 0 or score > 1").count() == 0

    def test_probabilities_sum_to_one(self):
        texts = ["the cat sat on the mat", "die katze sitzt auf der matte"]
        langs = ["de", "en"]
        rows = [(l, g) for l, t in zip((1, 0), texts, strict=True) for g in langid.grams(langid.characters([t]))]
        keys = sorted(set(rows))
        model = langid.kneser_ney(langs, np.array([k[0] for k in keys]), np.array([k[1] for k in keys], np.uint64), np.array([rows.count(k) for k in keys]))
        alphabet = {int(g) & 0xFFFF for _, g in rows}
        context = ord("t") << 48 | ord("h") << 32 | ord("e") << 16
        total = np.exp(langid.log_probabilities(model, np.array([context | c for c in alphabet] + [context | 0xFFFE], np.uint64))).sum(0)
        assert np.allclose(total, 1.0, atol=1e-5)

    def test_edges(self, edges, empty):
        model = langid.fit(edges.withColumn("lang", F.lit("xx")), F.lit(True))
        got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(edges, model).collect()}
        assert {(1, "und"), (2, "und"), (3, "und"), (7, "und"), (4, "xx"), (None, "xx")} <= got
        marks = edges.sparkSession.createDataFrame([(1, "\u0301\u0302 \u0301"), (2, "e\u0301te\u0301 la")], "doc_id long, text string")
        assert {(r["doc_id"], r["lang_pred"] == "und") for r in langid.identify(marks, model).collect()} == {(1, True), (2, False)}
        assert langid.identify(empty, model).count() == 0
        none = langid.fit(empty.withColumn("lang", F.lit("xx")), F.lit(True))
        assert {r["lang_pred"] for r in langid.identify(edges, none).collect()} == {"und"}
        assert langid.accepted(edges, model).columns == edges.columns


class TestFingerprint:
    def test_spans_and_extensions(self):
        a, b = fingerprint.Prefixes(["hello world", "xhello wOrld"]), fingerprint.Prefixes(["hello there"])
        at = np.array([0, 12, 1]), np.array([0, 0, 1])
        assert list(fingerprint.common_extension(a, at[0], b, at[1], np.array([11, 11, 10]))) == [6, 6, 5]
        assert a.span(np.array([0]), np.array([5])) == a.span(np.array([12]), np.array([17]))

    def test_contract_against_brute_force(self, spark, edges):
        extra = [(10 + i, t) for i, t in enumerate(("abc" * 100, "abc" * 100, "def" * 90 + "é", "q"))]
        docs = spark.createDataFrame([r for r in EDGES if r[0] is not None and r[0] != 6] + extra, "doc_id long, text string")
        rows = sorted(((i, t or "") for i, t in [r for r in EDGES if r[0] is not None and r[0] != 6] + extra), reverse=True)
        got = {r["doc_id"]: r for r in fingerprint.compare_with_edits(docs, part_bytes=200).collect()}
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(rows):
            new = fingerprint.edited(t, rows[(k + 1) % len(rows)][1])
            assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
            assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
            common = next((j for j, (x, y) in enumerate(zip(t, new, strict=False)) if x != y), min(len(t), len(new)))
            assert got[i]["common_prefix"] == common
        assert got[10]["fingerprint"] == got[11]["fingerprint"] and got[10]["fingerprint"] != got[12]["fingerprint"]

    def test_likeness_follows_the_common_parts(self):
        import random

        rnd = random.Random(5)
        words = lambda n: " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(2, 9))) for _ in range(n))
        for n in (10, 60, 400, 3000):
            one, other = words(n), words(n)
            middle = one[: len(one) // 4] + words(n // 20) + one[len(one) // 4 :]
            moved = words(n // 3) + one[len(one) // 3 :]
            a, b, c, d, e = (fingerprint.fingerprints([t])[0][0] for t in (one, other, middle, moved, one[: len(one) * 2 // 3] + other[len(other) * 2 // 3 :]))
            assert fingerprint.likeness(a, a) == 1 and fingerprint.likeness(a, b) < 0.1
            slack = 0.12 + 40 / len(one)
            assert abs(fingerprint.likeness(a, c) - len(one) / len(middle)) < slack and abs(fingerprint.likeness(a, d) - 2 / 3) < slack + 0.05 and abs(fingerprint.likeness(a, e) - 2 / 3) < slack
            for i, j, k in fingerprint.common_parts(a, d):
                assert one[i : i + k] == moved[j : j + k]
            assert str(fingerprint.Fingerprint.parse(str(c))) == str(c) and fingerprint.likeness(fingerprint.Fingerprint.parse(str(a)), c) == fingerprint.likeness(a, c) == fingerprint.likeness(c, a)

    def test_rows_of_one_id_are_split_and_chained_in_order(self, spark, monkeypatch):
        rows = [(7, f"text number {i} of one id") for i in range(60)] + [(None, f"no id {i}") for i in range(40)] + [(7, "twice"), (7, "twice")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        chained = fingerprint._chained(docs, "doc_id", "text", 200)
        assert chained.where("own").groupBy("bucket").count().agg(F.max("count")).first()[0] < 40
        hashed = {r[0]: r[1] for r in docs.select("text", F.xxhash64(F.col("text").cast("binary"))).collect()}
        ordered = sorted(rows, key=lambda r: (r[0] is None, -hashed[r[1]]))
        want = sorted(hashlib.sha256(fingerprint.edited(t, ordered[(k + 1) % len(ordered)][1]).encode()).hexdigest() for k, (_, t) in enumerate(ordered))
        assert sorted(r["edited_sha256"] for r in fingerprint.compare_with_edits(docs, part_bytes=200).collect()) == want
        monkeypatch.setattr(fingerprint, "MOST_PARTS", 3)
        assert sorted(r["edited_sha256"] for r in fingerprint.compare_with_edits(docs, part_bytes=20).collect()) == want

    def test_repeats_nulls_and_empty(self, edges, empty):
        assert fingerprint.compare_with_edits(edges).count() == len(EDGES)
        assert fingerprint.compare_with_edits(empty).count() == 0


class TestToxicity:
    def test_folding_and_whole_words(self):
        lexicon = toxicity.Lexicon({"idiot": 5.0, "vequ*": 4.0, "trash": 3.0})
        found = lambda t: [x[1] for x in lexicon.matches(t)]
        assert found("You 1D10T!") == ["idiot"] and found("іdіоt") == ["idiot"] and found("ídiot") == ["idiot"] and found("idiot$$$") == ["idiot"]
        assert found("idiotic") == [] and found("vequaire") == ["vequ*"] and found("xvequ") == []
        assert found("the trash can") == [] and found("trash can and trash") == ["trash"]

    def test_terms_explain_documents(self):
        toxic = [{"foo", "a"}, {"foo", "b"}, {"foo", "c"}, {"foo", "a"}, {"bar", "a"}, {"bar", "b"}, {"bar", "c"}, {"bar", "d"}]
        from collections import Counter

        assert set(toxicity.choose_terms(toxic, Counter({"a": 50, "b": 40, "c": 45, "d": 50}), 100)) == {"foo", "bar"}

    def test_only_near_copies_count_once(self, spark):
        import hashlib
        import itertools

        # Unrelated documents share the word of the smallest hash.
        least = min(map("".join, itertools.product("bcdfghjklmnpqrstvwxz", repeat=4)), key=lambda w: hashlib.blake2b(w.encode(), digest_size=8).digest())
        plain = lambda i, k: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(k))
        docs = [(i, f"{least} {plain(i, 12)} {'zorgle' if i < 5 else 'vexum'}") for i in range(60)] + [(100 + i, f"{least} {plain(200 + i, 12)}") for i in range(200)]
        docs += [(400 + i, f"{plain(450, 20)} brindle {chr(97 + i)}x") for i in range(8)]
        labels = [(i, int(i < 60 or i >= 400)) for i, _ in docs]
        lexicon = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
        scores = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([(0, "you zorgle"), (1, "vexum"), (2, "plain"), (3, "brindle")], "doc_id long, text string"), lexicon).collect()}
        assert scores[0] > 0.5 and scores[1] > 0.5 and scores[2] < 0.3 and scores[3] < 0.3

    def test_held_out_accuracy(self, spark):
        labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
        got = queries.op6_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out and toxic is not null")
        n = {(r[0], r[1]): r[2] for r in got.groupBy("toxic", "predicted").count().collect()}
        assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85 and n.get((0, 1), 0) / n[0, 0] < 0.03

    def test_edges(self, edges, empty, spark):
        labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
        lexicon = toxicity.fit(edges, labels, F.lit(True))
        got = toxicity.score(edges, lexicon).collect()
        assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
        assert toxicity.score(empty, toxicity.fit(empty, labels.where("false"), F.lit(True))).count() == 0

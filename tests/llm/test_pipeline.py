"""The corpus pipeline, stage by stage, on the smallest documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_chain_and_keep_clean_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        seen[name] = (docs.count(), out.count())
        if name != "byte_bpe":
            assert out.columns == columns
            assert [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        docs = spark.createDataFrame(out.toPandas(), out.schema)
    assert seen["language"][1] >= 0.98 * seen["language"][0]
    assert 0 < seen["near_duplicates"][1] <= seen["near_duplicates"][0]
    assert seen["personal_data"][0] == seen["personal_data"][1] and seen["byte_bpe"][0] == seen["byte_bpe"][1]
    assert seen["mixing"][1] > seen["mixing"][0]


def test_run_gives_the_last_stage(spark, tables):
    assert set(corpus_pipeline.run(spark, tables).columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


@pytest.fixture
def edges(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from here to there"
    rows = [
        (1, text, "en", "a", 77, "k", 1.0), (1, text, "en", "a", 77, "k", 1.0), (2, None, None, None, None, None, None), (3, "", "en", "b", 0, "k", 1.0), (None, text + " once more", "en", "a", 90, "k", 2.0), (4, "other words altogether stand in this row again mail me@here.org", None, "b", 99, None, None),
        (5, " \n\t", "de", "b", 3, "k", 1.0), (6, "word " * 30_000, "en", "a", 150_000, "k", 1.0), (7, "12 34 !!", "en", None, 8, "k", 1.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, base string, copies double")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_defines_the_edges(spark, tables, edges, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, edges.where("false"), tables).count() == 0
    out = stage(spark, edges, tables)
    rows = out.collect()
    if name == "byte_bpe":
        assert len(rows) == edges.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}
        return
    assert out.columns == edges.columns and out.dtypes == edges.dtypes
    ids = [r["doc_id"] for r in rows]
    if name == "language":
        assert not {2, 3, 5, 7} & {*ids} and ids.count(1) == 2
    if name == "near_duplicates":
        assert sorted(i or 0 for i in ids) == [0, 1, 2, 3, 4, 5, 6, 7]
    if name == "personal_data":
        texts = {r["doc_id"]: r["text"] for r in rows}
        assert len(rows) == edges.count() and texts[2] is None and texts[3] == "" and texts[4].endswith("again mail [EMAIL]")
        assert {r["doc_id"]: r["n_chars"] for r in rows}[4] == len(texts[4])
    if name == "mixing":
        # sources by code point, null last, weigh 5, 2, 1; 150 % of all words are shared, twice a source's own words at most
        size = lambda r: len((r["text"] or "").split())
        given, taken, copies = {}, {}, {}
        for r in edges.collect():
            given.setdefault(r["source"], []).append(size(r))
        for r in rows:
            taken[r["source"]] = taken.get(r["source"], 0) + size(r)
            copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
        total = 1.5 * sum(map(sum, given.values()))
        target = {"a": min(total, 2 * sum(given["a"])), "b": 2 * sum(given["b"]), None: 2 * sum(given[None])}
        target["a"] = min(2 * sum(given["a"]), total - sum(min(2 * sum(given[x]), total) for x in ("b", None)))
        assert all(abs(taken.get(x, 0) - target[x]) <= max(given[x]) for x in given)
        assert all(n <= 2 * [r["doc_id"] for r in edges.collect()].count(i) for i, n in copies.items())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:4]])
def test_columns_of_any_name_keep_their_values(spark, tables, edges, name):
    taken = ["__id", "__h", "__size", "__key", "__nth", "__times", "__copy", "c0", "own3", "spans", "candidates", "__text", "key", "id", "h"]
    docs = edges.where("doc_id in (1, 4, 6)")
    for i, c in enumerate(taken):
        docs = docs.withColumn(c, F.col("doc_id") * 100 + i)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, tables)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == r["doc_id"] * 100 + i for r in rows for i, c in enumerate(taken))

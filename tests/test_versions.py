"""Versioned tables that survive a writer's death, and the state of files."""

from __future__ import annotations

import os
import time

import pytest

from stratapanel.sources import versions


def _rows(spark, *rows):
    return spark.createDataFrame(rows, "k int, v string")


def _found(spark, root):
    return sorted(tuple(r) for r in versions.read(spark, root).collect())


def test_versions_replace_one_another(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert versions.current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root)
    assert versions.upsert_version(spark, root, _rows(spark, (1, "a"), (2, "b")), ["k"]) == 1
    before = versions.read(spark, root)
    assert versions.upsert_version(spark, root, _rows(spark, (2, "c"), (3, "d")), ["k"]) == 2
    assert _found(spark, root) == [(1, "a"), (2, "c"), (3, "d")] and sorted(tuple(r) for r in before.collect()) == [(1, "a"), (2, "b")]
    versions.upsert_version(spark, root, _rows(spark, (9, "z")), ["k"])
    assert len(versions.prune(spark, root, 2)) == 1 and len(_found(spark, root)) == 4


@pytest.mark.parametrize("step", ["write", "create", "rename"])
def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    root = f"file://{tmp_path}/t"
    versions.upsert_version(spark, root, _rows(spark, (1, "a")), ["k"], batch=0)

    def die(*args, **kwargs):
        raise RuntimeError("killed")

    if step == "write":
        monkeypatch.setattr("pyspark.sql.DataFrameWriter.parquet", die)
    elif step == "create":
        monkeypatch.setattr(versions, "_point", die)
    else:
        real = versions._point

        def half(jvm, store, path, session, said):
            store.create(path(f"{versions.POINTER}.half"), False).close()
            die()

        monkeypatch.setattr(versions, "_point", half)
        assert real is not half
    with pytest.raises(RuntimeError):
        versions.upsert_version(spark, root, _rows(spark, (1, "b")), ["k"], batch=1)
    assert _found(spark, root) == [(1, "a")]
    monkeypatch.undo()
    versions.upsert_version(spark, root, _rows(spark, (1, "b")), ["k"], batch=1)
    assert _found(spark, root) == [(1, "b")]
    assert versions.upsert_version(spark, root, _rows(spark, (1, "again")), ["k"], batch=1) == 2 and _found(spark, root) == [(1, "b")]


def test_a_stream_counts_a_batch_once(spark, tmp_path):
    source, root = str(tmp_path / "in"), f"file://{tmp_path}/t"
    for i in range(2):
        _rows(spark, (i, f"v{i}"), (7, f"v{i}")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int, v string").parquet(source)
        versions.upsert_versions_stream(stream, root, ["k"], str(tmp_path / "state"))
    assert _found(spark, root) == [(0, "v0"), (1, "v1"), (7, "v1")]
    again = spark.readStream.schema("k int, v string").parquet(source)
    versions.upsert_versions_stream(again, root, ["k"], str(tmp_path / "lost-state"))  # the same batch number once more
    assert versions.current(spark, root)["version"] == 2


def test_state_of_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(name * 10)
    state = lambda: versions.files_state(spark, str(tmp_path), "*.csv").first()
    one = state()
    assert (one["files"], one["bytes"]) == (2, 20) and state() == one
    os.utime(tmp_path / "a.csv", (time.time() + 5, time.time() + 5))
    two = state()
    (tmp_path / "b.csv").write_text("c" * 11)
    assert len({one["digest"], two["digest"], state()["digest"]}) == 3
    (tmp_path / "note.txt").write_text("x")
    assert state()["files"] == 2

"""Saved models: a folder a version, checked before they serve; old versions are pruned."""

from __future__ import annotations

from collections.abc import Sequence

from pyarrow import fs
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(model: PipelineModel, folder: str, version: str) -> str:
    """Writes a version; versions sort by name, so a time stamp serves."""
    path = f"{folder}/{version}"
    model.write().overwrite().save(path)
    return path


def _entries(folder: str) -> tuple[fs.FileSystem, list[str]]:
    store, path = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return store, sorted(x.path for x in found if x.type == fs.FileType.Directory)


def versions(folder: str) -> list[str]:
    """Names of the saved versions, oldest first; a missing folder has none."""
    return [x.rsplit("/", 1)[-1] for x in _entries(folder)[1]]


def newest(folder: str) -> PipelineModel | None:
    found = versions(folder)
    return PipelineModel.load(f"{folder}/{found[-1]}") if found else None


def prune(folder: str, keep: int = 5, dry_run: bool = False) -> list[str]:
    """Deletes all but the newest ``keep`` versions (at least one stays); returns the names that go."""
    store, found = _entries(folder)
    old = found[: -max(keep, 1)]
    for path in old if not dry_run else ():
        store.delete_dir(path)
    return [x.rsplit("/", 1)[-1] for x in old]


def sample_rows(spark: SparkSession, features: Sequence[str], rows: int = 50, seed: int = 42) -> DataFrame:
    """Normal draws in every feature, to try a model on."""
    return spark.range(rows).select(*(F.randn(seed + i).alias(f) for i, f in enumerate(features)))


def serves(model: PipelineModel, spark: SparkSession, features: Sequence[str], least_std: float = 1e-6) -> bool:
    """Whether the model predicts a value for every sample row, and not the same for all."""
    rows = sample_rows(spark, features)
    one = model.transform(rows).agg(F.count("prediction").alias("k"), F.count(F.lit(1)).alias("n"), F.stddev_samp("prediction").alias("sd")).first()
    return one["k"] == one["n"] and (one["sd"] or 0.0) > least_std

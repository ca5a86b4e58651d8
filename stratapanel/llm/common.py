"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch sent to a Python worker at most (a single longer text is a batch of its own).
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a single machine without one uses its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, narrow: bool = False) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so lost executors cost no recomputation.

    A file is written for each partition, empty ones too. A result of a few numbers a row (``narrow``), which has been
    shuffled in as many partitions as whole texts, is kept in an eighth as many files.
    """
    if narrow:
        df = df.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again; unlike a checkpoint it can be read by column."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collected(df: DataFrame) -> pd.DataFrame:
    """A bounded table on the driver, by Arrow: no Python object is made for each row on the way."""
    return df.toArrow().to_pandas()


def short_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small enough for a worker's memory."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(re.sub("[^0-9-]", "", spark.conf.get(key))) <= most:
            spark.conf.set(key, str(most))


def crc_remainder(doc_id: Column, by: int) -> Column:
    """crc32 of an id's decimal text, modulo ``by``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def blocks(sizes: list[int], most: int):
    """(start, end) of consecutive runs whose sizes sum to ``most`` or less; a larger item stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)

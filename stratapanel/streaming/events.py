"""Streams of events: windows with watermarks, sessions, de-duplication, and daily state by key.

Extensions beside the batch operators: each function takes a streaming (or batch) DataFrame of (event_id, ts, user_id,
event_type, value) and returns one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratapanel.operators.shaping import keep_one
from stratapanel.sources.files import upsert_table

DELAY = "10 minutes"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Files of a folder as a stream; the schema is that of the files there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def tumbling(events: DataFrame, size: str = "1 hour", delay: str = DELAY) -> DataFrame:
    rows = events.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "6 hours", step: str = "1 hour", delay: str = DELAY) -> DataFrame:
    rows = events.withWatermark("ts", delay).groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    rows = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, delay: str = DELAY) -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total, high): each key's state after a batch, kept between batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, high = state.get if state.exists else (0, 0.0, 0.0)
        for batch in batches:
            values = batch["value"].dropna()
            n, total = n + len(values), total + float(values.sum())
            high = max([high, *values.tolist()])
        state.update((n, total, high))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "high": [high]})

    state = "n long, total double, high double"
    return events.groupBy("user_id").applyInPandasWithState(update, f"user_id long, {state}", state, "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now and stops; results go to Parquet below ``out``, exactly once."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")).start()
    query.awaitTermination()


def upsert_stream(stream: DataFrame, name: str, keys: list[str], checkpoint: str) -> None:
    """Adds each batch of a stream to a saved table until no input is left; on equal keys the later batch stays.

    Of a batch's rows with equal keys the one with the largest other values stays. A batch that is tried again gives
    the same table, as an upsert can be repeated.
    """

    def add(batch: DataFrame, _: int) -> None:
        upsert_table(batch.sparkSession, name, keep_one(batch, keys, [F.desc(c) for c in batch.columns if c not in keys]), keys)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

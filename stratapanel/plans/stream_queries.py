"""Registered queries of the streaming operators, run over the events at hand; the SQL takes the closed windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratapanel.sources.shared import shared_dir
from stratapanel.streaming import events

QUERIES, ORACLES = {}, {}
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE AS closed FROM events)"


def _drained(make, columns):
    def run(spark, d):
        path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        # a stream reads folders of files, so the one file is named by a pattern of its folder
        schema = spark.read.parquet(f"{d}/events.parquet").schema
        stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
        events.drain(make(stream), f"{path}/out", f"{path}/state")
        out = spark.read.parquet(f"{path}/out")
        return out.select(*(F.col(c).cast("timestamp_ntz").alias(c) if c == "start" else F.col(c) for c in columns))

    return run


QUERIES["stream_tumbling"] = _drained(events.tumbling, ["start", "event_type", "n"])
ORACLES["stream_tumbling"] = f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events, {_CLOSED} WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= closed GROUP BY 1, 2"
QUERIES["stream_sessions"] = _drained(events.sessions, ["user_id", "start", "n"])
ORACLES["stream_sessions"] = f"""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS t FROM events), b AS (SELECT *, sum(t) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT closed FROM {_CLOSED})"""
QUERIES["stream_distinct"] = _drained(events.distinct_events, ["event_id", "event_type"])
ORACLES["stream_distinct"] = "SELECT event_id, event_type FROM events"

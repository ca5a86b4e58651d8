"""Tables that change as a whole: each version is a folder of its own, a small pointer names the one that is current.

A writer makes the next version beside the others and then moves a new pointer over the old one, which is one step of
the file system; readers see the old version or the new one. A writer that dies leaves a folder that nobody names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.operators.shaping import upsert

POINTER = "CURRENT"


def _hadoop(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{root}/{name}" if name else root)
    return jvm, path().getFileSystem(spark._jsc.hadoopConfiguration()), path


def current(spark: SparkSession, root: str) -> dict | None:
    """What the pointer says: version, folder, and the last batch of a stream; None without a table."""
    _, store, path = _hadoop(spark, root)
    if not store.exists(path(POINTER)):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{root}/{POINTER}").collect()))


def read(spark: SparkSession, root: str) -> DataFrame:
    """The current version; later ones do not change what was read."""
    said = current(spark, root)
    if said is None:
        raise FileNotFoundError(f"no version of {root}")
    return spark.read.parquet(f"{root}/{said['folder']}")


def write(df: DataFrame, root: str, batch: int | None = None) -> int:
    """Writes ``df`` as the next version and makes it current; returns its number. ``df`` may read the current one."""
    spark = df.sparkSession
    jvm, store, path = _hadoop(spark, root)
    said = current(spark, root) or {"version": 0, "batch": None}
    version = said["version"] + 1
    folder = f"v{version:08d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{root}/{folder}")
    _point(jvm, store, path, spark, {"version": version, "folder": folder, "batch": said["batch"] if batch is None else batch})
    return version


def _point(jvm, store, path, spark: SparkSession, said: dict) -> None:
    fresh = path(f"{POINTER}.{uuid.uuid4().hex}")
    out = store.create(fresh, False)
    try:
        out.write(bytearray(json.dumps(said).encode()))
    finally:
        out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else store.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fresh, path(POINTER), options)


def upsert_version(spark: SparkSession, root: str, new: DataFrame, keys: Sequence[str], batch: int | None = None) -> int:
    """The table with new rows, of equal keys the new one; a batch that the table already holds is passed over."""
    said = current(spark, root)
    if said is None:
        return write(upsert(new.limit(0), new, list(keys)), root, batch)
    if batch is not None and said["batch"] is not None and batch <= said["batch"]:
        return said["version"]
    return write(upsert(read(spark, root), new, list(keys)), root, batch)


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes versions older than the ``keep`` newest, and folders that no pointer ever named; returns their names.

    Not to be run beside a writer.
    """
    said = current(spark, root)
    if said is None:
        return []
    _, store, path = _hadoop(spark, root)
    named = [f.getPath().getName() for f in store.listStatus(path()) if f.isDirectory() and f.getPath().getName().startswith("v")]
    old = [n for n in named if n != said["folder"] and int(n[1:9]) not in range(said["version"] - max(keep, 1) + 1, said["version"])]
    for name in old:
        store.delete(path(name), True)
    return sorted(old)


def upsert_versions_stream(stream: DataFrame, root: str, keys: Sequence[str], checkpoint: str) -> None:
    """Adds what a stream brings, a version a batch; a batch that is tried again after a failure counts once."""

    def add(rows: DataFrame, batch: int) -> None:
        upsert_version(rows.sparkSession, root, rows, keys, batch)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def files_state(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(files, bytes, newest, digest): one row on the files below a path, from their listing alone.

    The digest does not depend on the order of files, and changes with any name, size or time of change. No file is opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    listed = reader.load(path).select("path", "length", "modificationTime")
    each = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    return listed.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0).cast("long")).alias("bytes"), F.max("modificationTime").alias("newest"), F.hex(F.coalesce(F.bit_xor(each), F.lit(0).cast("long"))).alias("digest"))

"""The same aggregates over streams of files, and ingest of new files as they come.

Each stream runs with the AvailableNow trigger: it takes what is there, in one
or more batches, keeps its place in a checkpoint, and goes on from there when it
is started again.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import workload
from folioscan.operators.checkpoints import ensure_checkpoint_dir
from folioscan.sources import files


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the parquet files at *path*, a folder or a single file."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    is_dir = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    return reader.parquet(path) if is_dir else reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))


def run(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], place: str) -> None:
    """To the end of what is there now; a failed batch fails the call."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def _last_state(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """The final rows of a complete-mode aggregate: each batch writes its own folder, the last one is read."""
    base = shared_dir(spark, name)
    last: list[int] = []

    def sink(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/{n}")
        last.append(n)

    run(stream, "complete", sink, f"{base}/progress")
    return spark.read.parquet(f"{base}/out/{last[-1]}") if last else spark.createDataFrame([], stream.schema)


def query_stats(spark: SparkSession, path: str) -> DataFrame:
    return _last_state(spark, workload.query_stats(source(spark, path)), "query-stats")


def last_seen(spark: SparkSession, path: str, ttl_sec: int) -> DataFrame:
    """(client_id, last_ms) of the clients within the time to live of the newest beat.

    The state is one time per client; beats may come in any order.
    """
    beats = source(spark, path).where("client_id is not null and ts is not null").select("client_id", F.floor(F.col("ts") * 1000).cast("bigint").alias("t"))
    seen = _last_state(spark, beats.groupBy("client_id").agg(F.max("t").alias("last_ms")), "last-seen")
    newest = seen.agg(F.max("last_ms").alias("now"))
    return seen.join(F.broadcast(newest)).where(F.col("now") - F.col("last_ms") <= ttl_sec * 1000).select("client_id", "last_ms")


def feed_presence(beats: DataFrame, table: workload.Presence, place: str) -> None:
    """Keep a driver's presence table up to date from a stream; each batch is reduced to one row per client first."""

    def sink(df: DataFrame, _: int) -> None:
        newest = df.where("client_id is not null and ts is not null").groupBy("client_id").agg(F.max("ts").alias("ts")).orderBy("ts", "client_id")
        for r in newest.toLocalIterator():
            table.beat(r.client_id, r.ts)

    run(beats, "append", sink, place)


def ingest(spark: SparkSession, root: str, target: str, place: str) -> None:
    """Extract files that are new under *root* and append their pages and failures to *target*."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1000).load(root)
    listed = files._described(stream)

    def sink(df: DataFrame, n: int) -> None:
        # a batch that is repeated after a failure replaces itself
        files.extract(df).write.mode("overwrite").parquet(f"{target}/batch={n}")

    run(listed, "append", sink, place)

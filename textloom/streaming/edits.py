"""Streams: versioned edits of files, latest versions, invalidation, and event-time windows (an extension).

Late data here are edits whose version is not above the last one applied; they are dropped, as they must be.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators.graphs import reachable
from textloom.sources.shared import home

EDIT = "path string, version long, start long, end long, replacement string"


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key; the batch form of the stream below."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(version)).alias("x")).select(key, *[F.col("x").getField(c).alias(c) for c in cols])


def applied_edits(edits: DataFrame) -> DataFrame:
    """Streaming: each file's text after its edits in order of version, with rejected ones counted. State is one text."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, version, rejected = state.get if state.exists else ("", 0, 0)
        rows = pd.concat(list(batches)).sort_values("version")
        for e in rows.itertuples():
            if e.version <= version or not 0 <= e.start <= e.end <= len(text):
                rejected += 1
                continue
            text, version = text[: e.start] + e.replacement + text[e.end :], e.version
        state.update((text, int(version), int(rejected)))
        yield pd.DataFrame({"path": [key[0]], "text": [text], "version": [version], "rejected": [rejected]})

    return edits.groupBy("path").applyInPandasWithState(run, "path string, text string, version long, rejected long", "text string, version long, rejected long", "update", GroupStateTimeout.NoTimeout)


def collected(stream: DataFrame, mode: str = "append", key: str | None = None, version: str | None = None) -> DataFrame:
    """Run a stream over all that is there now into a Parquet folder and read it; exactly once, by its checkpoint."""
    spark = stream.sparkSession
    base = f"{home(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    out = spark.read.schema(stream.schema.add("batch", T.IntegerType())).parquet(f"{base}/out")
    return latest(out, key, "batch").drop("batch") if key else out.drop("batch")


def event_stream(spark: SparkSession, folder: str, schema, name: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*").parquet(folder)


def windowed(events: DataFrame, late: str = "1 hour", size: str = "6 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums of event types in event-time windows, with a watermark when streamed."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour") if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def invalidated(changed: DataFrame, depends: DataFrame, every: DataFrame, complete: bool) -> DataFrame:
    """Paths to look at again: the changed ones and their transitive dependents; all, if dependencies are not known in
    full. depends: a (the dependent), b (what it depends on)."""
    if not complete:
        return every.select("path").distinct()
    return reachable(depends.select(F.col("b").alias("a"), F.col("a").alias("b")), changed.select(F.col("path").alias("node"))).select(F.col("node").alias("path"))

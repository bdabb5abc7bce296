"""Streaming views: a growing run log, versioned snapshots of it, and windows over events."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import RUN_SCHEMA


def stream_runs(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Run records of a folder of JSONL files as they arrive, with ``seen``, their file's time; corrupt lines have no key and go."""
    rows = spark.readStream.schema(RUN_SCHEMA).option("maxFilesPerTrigger", per_batch).json(folder)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("seen")).filter("cfg_id IS NOT NULL")


def live_ranking(runs: DataFrame, late: str = "30 days") -> DataFrame:
    """Runs counted once by (cfg, part, tier), then means by configuration; for complete or update mode.

    A key is remembered for ``late`` after the file that brought it: a runner that
    resumes does so within that time, and the state does not grow for ever.
    """
    keys = ["cfg_id", "part", "tier"]
    once = runs.withWatermark("seen", late).dropDuplicatesWithinWatermark(keys) if runs.isStreaming else runs.dropDuplicates(keys)
    return once.groupBy("cfg_id").agg(F.count("*").alias("n_runs"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.round(F.avg(F.when(F.col("status") == "ok", F.col("accuracy.score")).otherwise(F.lit(0.0))), 6).alias("mean_score"))


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in event-time windows (batch or stream)."""
    w = F.window("ts", width, slide or width)
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events no further apart than gap."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def publish(df: DataFrame, table: str, checkpoint: str, mode: str = "complete"):
    """Starts a query into an in-memory table with a checkpoint, so that a restart resumes."""
    return df.writeStream.outputMode(mode).format("memory").queryName(table).option("checkpointLocation", checkpoint).start()


def publish_versions(df: DataFrame, path: str, checkpoint: str, mode: str = "complete"):
    """Starts a query that writes each batch's result as one version below path; a batch that runs again replaces its own."""

    def write(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={version}")

    return df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).start()


def newer(spark: SparkSession, path: str, than: int = -1) -> tuple[int, DataFrame] | None:
    """(version, rows) of the newest finished version, if it is newer than the one the caller has."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    found = [x.getPath() for x in files.listStatus(at) if x.getPath().getName().startswith("version=")]
    done = [int(p.getName().split("=")[1]) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    top = max(done, default=-1)
    return (top, spark.read.parquet(f"{path}/version={top}")) if top > than else None


def progress(query) -> dict:
    """A snapshot of a running query: its version, rows so far in the last batch, rows a second, state rows, whether it is active."""
    last = query.lastProgress or {}
    return {
        "version": last.get("batchId", -1), "rows": last.get("numInputRows", 0), "rows_per_second": last.get("processedRowsPerSecond", 0.0),
        "state_rows": sum(s.get("numRowsTotal", 0) for s in last.get("stateOperators", [])), "active": query.isActive,
    }


def run_within(query, seconds: float, done=None, pause: float = 0.2) -> str:
    """Waits until ``done()`` holds, the query ends, or the wall-clock budget is spent; then stops it.  Returns done, ended or budget."""
    end, why = time.monotonic() + seconds, "budget"
    while time.monotonic() < end:
        if done and done():
            why = "done"
            break
        if query.awaitTermination(pause):
            why = "ended"
            break
    query.stop()  # a restart from the checkpoint goes on where it stopped
    return why

"""The polling loops as Structured Streaming queries over file sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelquery.operators.relations import REF_KEY, last_attempts
from reelquery.sources.files import scan_files_stream


def file_stream(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, schema: T.StructType | str | None = None
) -> DataFrame:
    """Parquet files as a stream with a declared ``schema``; without one, that of what is there now."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is available, stop, and read the result back.

    A run with the same checkpoint goes on where this one ended.
    """
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


_NEVER = -(1 << 62)


def _send(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One ref: sent if its first change in the batch came after the last attempt and after it was last sent."""
    rows = pd.concat(list(frames))
    first = rows.loc[rows["updated_us"].idxmin()]
    sent_us = state.get[0] if state.exists else _NEVER
    if max(int(first["attempt_us"]), sent_us) >= int(first["updated_us"]):
        return
    state.update((int(first["stamp_us"]),))
    told = {name: [value] for name, value in zip(REF_KEY, key, strict=True)}
    yield pd.DataFrame({**told, "file_id": pd.array([first["file_id"]], "Int64"), "stamp_us": [int(first["stamp_us"])]})


def dispatch_jobs(
    refs: DataFrame, jobs: DataFrame, out: str, checkpoint: str, as_of: Column | None = None
) -> StreamingQuery:
    """New pending refs become embedding jobs once.

    Each micro-batch keeps refs with no attempt since their last change, neither in the job log nor sent
    by this stream. When a ref was last sent is state under its key, kept with the stream's progress, so a batch
    costs what it holds, however much was sent before. A batch writes its own folder and overwrites it when
    it is run again, so a restart adds nothing twice.
    """
    stamp = F.current_timestamp() if as_of is None else as_of
    last = last_attempts(jobs)
    keyed = refs.withColumn("_asset", F.col("asset_id").cast("string"))
    same = keyed["_asset"] == last["asset_id"]
    for name in REF_KEY[1:]:
        same = same & (keyed[name] == last[name])
    known = keyed.join(last.select(*REF_KEY, "last_attempt"), same, "left").select(
        *[keyed[c] for c in REF_KEY], keyed["file_id"], F.unix_micros(keyed["updated_at"]).alias("updated_us"),
        F.coalesce(F.unix_micros("last_attempt"), F.lit(_NEVER)).alias("attempt_us"), F.unix_micros(stamp).alias("stamp_us"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in refs.schema}
    columns = ", ".join(f"{name} {kinds[name]}" for name in REF_KEY)
    due = known.groupBy(*REF_KEY).applyInPandasWithState(
        _send, f"{columns}, file_id bigint, stamp_us bigint", "sent_us bigint", "append", GroupStateTimeout.NoTimeout
    )

    def dispatch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(
            F.lit(batch_id).cast("bigint").alias("batch_no"), *REF_KEY, "file_id",
            F.timestamp_micros("stamp_us").alias("created_at"),
        )
        rows.write.mode("overwrite").parquet(f"{out}/batch-{batch_id:08d}")

    return (
        due.writeStream.foreachBatch(dispatch)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def heartbeat_sessions(
    beats: DataFrame, worker: str, ts: str, gap_seconds: Column, lateness: str
) -> DataFrame:
    """A worker's session ends when no heartbeat comes within its timeout (per-row gap); later
    heartbeats than the watermark are dropped."""
    gap = F.concat(gap_seconds.cast("string"), F.lit(" seconds"))
    return (
        beats.withWatermark(ts, lateness)
        .groupBy(F.col(worker), F.session_window(F.col(ts), gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("n_beats"))
        .select(
            worker, F.col("session.start").alias("started_at"), F.col("session.end").alias("ended_at"),
            "n_beats",
        )
    )


def windowed_counts(
    log: DataFrame, ts: str, key: str, width: str, lateness: str, slide: str | None = None
) -> DataFrame:
    """Counts per time window and key, final once the watermark has passed the window."""
    return (
        log.withWatermark(ts, lateness)
        .groupBy(F.window(ts, width, slide or width).alias("w"), F.col(key))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key,
                "cnt")
    )


def discovered_files(spark: SparkSession, root: str, library_id: str, lateness: str = "1 day"):
    """Files as they appear; one version of a file (path and time) is reported once."""
    found = scan_files_stream(spark, root, library_id)
    return found.withWatermark("modified_at", lateness).dropDuplicatesWithinWatermark(
        ["path", "mtime_ms"]
    )

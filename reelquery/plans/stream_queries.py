"""Streams run over what is there now, next to their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery.plans.join_queries import ATTEMPTS
from reelquery.plans.registry import query
from reelquery.plans.source_queries import LISTED
from reelquery.session import shared_folder
from reelquery.streaming import log_streams as streams

LATENESS = "10 minutes"


def _stamped_events(t):
    folder = f"{t.folder}/events[.]parquet"  # a pattern: a stream reads folders
    return streams.file_stream(t.spark, folder, schema=t.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_dispatch",
    f"""
    SELECT r.asset_id, r.collection, r.model_name, r.model_version, r.file_id
    FROM v_refs r LEFT JOIN ({ATTEMPTS}) a ON CAST(r.asset_id AS VARCHAR) = a.asset_id
      AND r.collection = a.collection AND r.model_name = a.model_name
      AND r.model_version = a.model_version
    WHERE r.status = 'pending' AND (a.last_attempt IS NULL OR a.last_attempt < r.updated_at)""",
)
def stream_dispatch(t):
    """Pending refs arriving twice in several files; each is dispatched once."""
    base = shared_folder(t.spark)
    pending = t.v_refs.filter(F.col("status") == "pending").select(
        "asset_id", "collection", "model_name", "model_version", "file_id",
        F.col("updated_at").cast("timestamp").alias("updated_at"),
    )
    both = pending.unionByName(pending).repartition(4, "asset_id")
    both.write.mode("overwrite").parquet(f"{base}/refs")
    pending.repartition(2).write.mode("append").parquet(f"{base}/refs")
    jobs = t.v_jobs.withColumn("created_at", F.col("created_at").cast("timestamp"))
    source = streams.file_stream(t.spark, f"{base}/refs", files_per_trigger=2, schema=pending.schema)
    streams.dispatch_jobs(source, jobs, f"{base}/jobs", f"{base}/progress").awaitTermination()
    sent = t.spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/jobs")
    return sent.select("asset_id", "collection", "model_name", "model_version", "file_id")


# Gap by event type; a session ends that long after its last beat, or at a later end of another.
BEATS = """
    SELECT user_id, ts, ts + INTERVAL 1 SECOND * (CASE event_type WHEN 'error' THEN 60 WHEN 'view'
      THEN 3600 ELSE 7200 END) AS until FROM events"""


@query(
    "stream_stale_heartbeats",
    f"""
    SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(until)) AS ended_us,
      count(*) AS n_beats
    FROM (SELECT *, sum(CASE WHEN before IS NULL OR ts > before THEN 1 ELSE 0 END) OVER (PARTITION
        BY user_id ORDER BY ts, until) AS g
      FROM (SELECT *, max(until) OVER (PARTITION BY user_id ORDER BY ts, until
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({BEATS})))
    GROUP BY user_id, g
    HAVING max(until) <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def stream_stale_heartbeats(t):
    """Sessions that had ended when the stream stopped (its watermark is ten minutes behind)."""
    kind = F.col("event_type")
    gap = F.when(kind == "error", 60).when(kind == "view", 3600).otherwise(7200)
    sessions = streams.heartbeat_sessions(_stamped_events(t), "user_id", "ts", gap, LATENESS)
    base = shared_folder(t.spark)
    done = streams.run_available(sessions, f"{base}/sessions", f"{base}/progress")
    return done.select(
        "user_id", F.unix_micros("started_at").alias("started_us"),
        F.unix_micros("ended_at").alias("ended_us"), "n_beats",
    )


@query(
    "stream_job_rollup",
    """
    SELECT epoch_us(w) AS window_us, event_type, count(*) AS cnt
    FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type FROM events)
    WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
    GROUP BY w, event_type""",
)
def stream_job_rollup(t):
    """Hourly counts per type, for the hours the watermark has passed."""
    counts = streams.windowed_counts(_stamped_events(t), "ts", "event_type", "1 hour", LATENESS)
    base = shared_folder(t.spark)
    done = streams.run_available(counts, f"{base}/counts", f"{base}/progress")
    return done.select(F.unix_micros("window_start").alias("window_us"), "event_type", "cnt")


@query("stream_file_discovery", LISTED)
def stream_file_discovery(t):
    """Texts written as files, discovered as a stream: bytes per language folder."""
    base = shared_folder(t.spark)
    t.documents.select("lang", "text").write.mode("overwrite").partitionBy("lang").text(
        f"{base}/files"
    )
    found = streams.discovered_files(t.spark, f"{base}/files", "documents")
    done = streams.run_available(found, f"{base}/found", f"{base}/progress")
    return done.groupBy(
        F.regexp_extract("relative_path", r"^lang=([^/]+)/", 1).alias("lang"), "media_type"
    ).agg(F.sum("size_bytes").alias("size_bytes"))

"""Job-log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery.operators import jobs as J
from reelquery.operators import relations
from reelquery.plans.join_queries import PATHS
from reelquery.plans.registry import query
from reelquery.session import checkpointed

# The clock the log is looked at: the newest event.
AS_OF = "(SELECT max(ts) FROM events)"
STALE = f"""status = 'running' AND (heartbeat_at IS NULL OR epoch_us({AS_OF})
    - epoch_us(heartbeat_at) > timeout_seconds * 1000000::BIGINT)"""


def timed_jobs(t):
    """Jobs with the newest event time as their clock (a scalar subquery)."""
    now = t.events.agg(F.max("ts").cast("timestamp").alias("as_of"))
    stamps = {
        c: F.col(c).cast("timestamp")
        for c in ("created_at", "heartbeat_at", "updated_at", "finished_at")
    }
    locks = {"locked_by": F.lit("worker"), "locked_at": F.col("heartbeat_at")}
    return t.v_jobs.withColumns(stamps).withColumns(locks).withColumn(
        "as_of", now.scalar()
    )


@query("stale_jobs", f"SELECT job_id FROM v_jobs WHERE {STALE}")
def stale_jobs(t):
    return J.stale_jobs(timed_jobs(t), F.col("as_of")).select("job_id")


@query(
    "reclaim_snapshot",
    f"""SELECT job_id, CASE WHEN {STALE} THEN 'queued' ELSE status END AS status,
      NOT ({STALE}) AS is_locked,
      epoch_us(CASE WHEN {STALE} THEN NULL ELSE heartbeat_at END) AS heartbeat_us FROM v_jobs""",
)
def reclaim_snapshot(t):
    after = J.reclaim_snapshot(timed_jobs(t), F.col("as_of"))
    return after.select(
        "job_id", "status", F.col("locked_by").isNotNull().alias("is_locked"),
        F.unix_micros("heartbeat_at").alias("heartbeat_us"),
    )


@query(
    "claim_batch",
    """SELECT job_id, 'running' AS status, attempt + 1 AS attempt, 'w1' AS locked_by FROM v_jobs
      WHERE status = 'queued' ORDER BY priority DESC, created_at, job_id LIMIT 32""",
)
def claim_batch(t):
    claimed = J.claim_batch(timed_jobs(t), 32, "w1", F.col("as_of"))
    return claimed.select("job_id", "status", "attempt", "locked_by")


@query(
    "job_page",
    f"""SELECT j.job_id, j.job_type, j.status, p.file_paths, (SELECT count(*) FROM v_jobs) AS total
      FROM (SELECT * FROM v_jobs ORDER BY created_at DESC, job_id DESC LIMIT 100 OFFSET 50) j
      JOIN ({PATHS}) p USING (job_id)""",
)
def job_page(t):
    page = J.recent(t.v_jobs, limit=100, offset=50)
    paths = relations.job_file_paths(page, t.v_files, t.v_assets).select(
        "job_id", F.array_join("file_paths", ",").alias("file_paths")
    )
    total = t.v_jobs.agg(F.count(F.lit(1)).alias("total"))
    rows = page.select("job_id", "job_type", "status").join(paths, "job_id")
    return rows.withColumn("total", total.scalar())


@query(
    "job_durations",
    """SELECT job_type, count(finished_at) AS n_finished,
      round(avg((epoch_us(finished_at) - epoch_us(created_at)) / 1000000), 4) AS mean_seconds,
      round(max((epoch_us(finished_at) - epoch_us(created_at)) / 1000000), 4) AS max_seconds,
      round(count(*) FILTER (status = 'succeeded') / count(*) FILTER (status IN ('succeeded',
        'failed')), 6) AS success_ratio
    FROM v_jobs GROUP BY job_type""",
)
def job_durations(t):
    return J.job_durations(timed_jobs(t))


@query(
    "job_duration_percentiles",
    """SELECT job_type, share, count(finished_at) AS n, true AS within_bound
    FROM v_jobs, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) s(share)
    WHERE finished_at IS NOT NULL GROUP BY job_type, share""",
)
def job_duration_percentiles(t):
    """Percentiles from daily sketches kept between two runs, held against the exact ranks."""
    jobs = timed_jobs(t)
    even = F.pmod(F.xxhash64("job_id"), F.lit(2)) == 0
    kept = checkpointed(J.duration_sketches(jobs.filter(even)))  # an earlier run
    both = kept.unionByName(J.duration_sketches(jobs.filter(~even)))
    told = J.duration_quantiles(J.merged_sketches(both, "job_type", "day"))
    seconds = (F.unix_micros("finished_at") - F.unix_micros("created_at")) / 1_000_000
    done = jobs.filter(F.col("finished_at").isNotNull()).select("job_type", seconds.alias("exact"))
    ranked = done.join(told, "job_type").groupBy("job_type", "share", "n").agg(
        F.avg((F.col("exact") < F.col("seconds")).cast("double")).alias("below"),
        F.avg((F.col("exact") <= F.col("seconds")).cast("double")).alias("up_to"),
        (1 / F.count(F.lit(1))).alias("one"),
    )
    slack = J.SKETCH_ERROR + F.col("one")
    within = (F.col("below") <= F.col("share") + slack) & (F.col("up_to") >= F.col("share") - slack)
    return ranked.select("job_type", "share", "n", within.alias("within_bound"))


@query(
    "tool_call_audit",
    """SELECT tool_name, status, count(*) AS n_calls, count(*) FILTER (tool_name IN ('export_clip',
      'create_index_job')) AS n_need_confirmation FROM v_tool_calls GROUP BY tool_name, status""",
)
def tool_call_audit(t):
    return J.tool_call_audit(t.v_tool_calls)

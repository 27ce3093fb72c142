"""Job-log analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery.operators.ordered import numbered


def is_stale_job(as_of: Column) -> Column:
    """Running without a heartbeat, or silent for strictly longer than the timeout."""
    silent = F.unix_micros(as_of) - F.unix_micros(F.col("heartbeat_at"))
    late = silent > F.col("timeout_seconds").cast("bigint") * 1_000_000
    return (F.col("status") == "running") & (F.col("heartbeat_at").isNull() | late)


def stale_jobs(jobs: DataFrame, as_of: Column) -> DataFrame:
    return jobs.filter(is_stale_job(as_of))


def reclaim_snapshot(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Stale jobs back in the queue with their locks cleared; ``attempt`` stays."""
    stale = F.coalesce(is_stale_job(as_of), F.lit(False))
    cleared = {
        c: F.when(stale, F.lit(None)).otherwise(F.col(c))
        for c in ["locked_by", "locked_at", "heartbeat_at"]
        if c in jobs.columns
    }
    return jobs.withColumns(
        {
            **cleared,
            "status": F.when(stale, "queued").otherwise(F.col("status")),
            "updated_at": F.when(stale, as_of).otherwise(F.col("updated_at")),
        }
    )


def claim_order(jobs: DataFrame) -> DataFrame:
    """Queue position: highest priority first, then oldest. The whole queue is one ordered group,
    so a long queue is ranked in slices."""
    queued = jobs.filter(F.col("status") == "queued").withColumn("_urgency", -F.col("priority"))
    one_queue = queued.withColumn("_queue", F.lit(1))
    ranked = numbered(one_queue, ["_queue"], ["_urgency", "created_at", "job_id"], "position")
    return ranked.drop("_urgency", "_queue")


def claim_batch(jobs: DataFrame, n: int, worker: str, as_of: Column) -> DataFrame:
    """The next ``n`` queued jobs as running (batch form: one writer, no locks)."""
    head = (
        jobs.filter(F.col("status") == "queued")
        .orderBy(F.desc("priority"), F.asc("created_at"), F.asc("job_id"))
        .limit(n)
    )
    return head.withColumns(
        {
            "status": F.lit("running"), "locked_by": F.lit(worker), "locked_at": as_of,
            "heartbeat_at": as_of, "attempt": F.col("attempt") + 1, "updated_at": as_of,
        }
    )


def recent(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first; the limit is held to 1..500."""
    bounded = min(max(limit, 1), 500)
    ordered = df.orderBy(F.desc("created_at"), F.desc("job_id"))
    return ordered.offset(max(offset, 0)).limit(bounded)


def job_durations(jobs: DataFrame) -> DataFrame:
    """Mean time from creation to finish and success share per type."""
    seconds = (F.unix_micros("finished_at") - F.unix_micros("created_at")) / 1_000_000
    done = F.col("finished_at").isNotNull()
    return jobs.groupBy("job_type").agg(
        F.count_if(done).alias("n_finished"),
        F.round(F.avg(F.when(done, seconds)), 4).alias("mean_seconds"),
        F.round(F.max(F.when(done, seconds)), 4).alias("max_seconds"),
        F.round(
            F.count_if(F.col("status") == "succeeded")
            / F.count_if(F.col("status").isin("succeeded", "failed")), 6
        ).alias("success_ratio"),
    )


#: Size of a quantile sketch, and the share of ranks its answers may be off by (99 % confidence, for this size).
SKETCH_K = 800
SKETCH_ERROR = 0.005


def duration_sketches(jobs: DataFrame) -> DataFrame:
    """(job_type, day, n, sketch): a quantile sketch of the durations of the jobs that finished on a day.

    Sketches are of bounded size and merge, so a run adds the days it has seen to those kept from earlier runs.
    """
    seconds = (F.unix_micros("finished_at") - F.unix_micros("created_at")) / 1_000_000
    done = jobs.filter(F.col("finished_at").isNotNull()).select(
        "job_type", F.to_date("finished_at").alias("day"), seconds.alias("seconds")
    )
    return done.groupBy("job_type", "day").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("seconds", SKETCH_K).alias("sketch")
    )


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, sketch): sketches of the same keys as one."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch")
    )


def duration_quantiles(sketches: DataFrame, shares: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """(job_type, n, share, seconds) over all days of the sketches; ranks are off by ``SKETCH_ERROR`` at most."""
    told = [
        F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("seconds"))
        for s in shares
    ]
    return merged_sketches(sketches, "job_type").select("job_type", "n", F.inline(F.array(*told)))


CONFIRMED_TOOLS = ["export_clip", "create_index_job"]


def tool_call_audit(calls: DataFrame) -> DataFrame:
    """Tool calls by name and status; those with side effects wait for confirmation."""
    needs = F.col("tool_name").isin(CONFIRMED_TOOLS)
    return calls.groupBy("tool_name", "status").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(needs).alias("n_need_confirmation")
    )

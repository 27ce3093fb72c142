"""Counts, gates and summaries. All combine map-side before their exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.operators.ordered import top_per_group


def library_counts(libraries: DataFrame, files: DataFrame) -> DataFrame:
    """Media, indexed and failed files per library; soft-deleted files count too."""
    counts = files.groupBy("library_id").agg(
        F.count(F.lit(1)).alias("media_count"),
        F.count_if(F.col("index_status") == "indexed").alias("indexed_count"),
        F.count_if(F.col("index_status") == "failed").alias("failed_count"),
    )
    names = ["media_count", "indexed_count", "failed_count"]
    return (
        libraries.select("library_id")
        .join(counts, "library_id", "left")
        .fillna(0, subset=names)
    )


def library_totals(counts: DataFrame) -> DataFrame:
    """Both levels in one pass: each library and the grand total (library NULL)."""
    return counts.rollup("library_id").agg(
        F.sum("media_count").alias("media_count"),
        F.sum("indexed_count").alias("indexed_count"),
        F.sum("failed_count").alias("failed_count"),
    )


def count_by(df: DataFrame, *keys: str, name: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def library_distinct_counts(
    libraries: DataFrame, files: DataFrame, assets: DataFrame
) -> DataFrame:
    """Distinct files and assets per library.

    Assets are counted per file before the join, so files do not fan out by their assets.
    """
    per_file = assets.groupBy("file_id").agg(F.count_distinct("asset_id").alias("n_assets"))
    per_library = (
        files.select("library_id", "file_id")
        .join(per_file, "file_id", "left")
        .groupBy("library_id")
        .agg(
            F.count_distinct("file_id").alias("files"),
            F.coalesce(F.sum("n_assets"), F.lit(0)).alias("assets"),
        )
    )
    return libraries.select("library_id").join(per_library, "library_id", "left").fillna(
        0, subset=["files", "assets"]
    )


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page of rows, each with the total under the same predicate.

    The total is its own count: a count over a window would move every row to one task.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    page = df.orderBy(*order).offset(offset).limit(limit)
    return page.withColumn("total", total.scalar())


def status_pivot(refs: DataFrame) -> DataFrame:
    return (
        refs.groupBy("collection")
        .pivot("status", ["pending", "indexed", "stale"])
        .agg(F.count(F.lit(1)))
        .fillna(0)
    )


def error_code_rollup(jobs: DataFrame) -> DataFrame:
    """Failures by job type and error code, with subtotals (level 0 = pair, 1 = type, 3 = all)."""
    return jobs.filter(F.col("status") == "failed").rollup("job_type", "error_code").agg(
        F.count(F.lit(1)).alias("failures"),
        F.grouping_id().cast("bigint").alias("level"),
    )


def index_completeness(
    files: DataFrame, scenes: DataFrame, assets: DataFrame, refs: DataFrame
) -> DataFrame:
    """Integrity counts, one row per rule."""
    videos = files.filter((F.col("media_type") == "video") & ~F.col("is_deleted"))
    frames = assets.filter(F.col("asset_type") == "video_frame")
    indexed = refs.filter(F.col("status") == "indexed")
    mismatched = scenes.join(
        files.select("file_id", F.col("index_generation").alias("file_generation")), "file_id"
    ).filter(F.col("index_generation") != F.col("file_generation"))
    rules = {
        "videos_without_scenes": videos.join(scenes, "file_id", "left_anti"),
        "scenes_without_frames": scenes.join(frames, "scene_id", "left_anti"),
        "frames_without_indexed_ref": frames.join(indexed, "asset_id", "left_anti"),
        "generation_mismatch": mismatched,
    }
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit(rule))
        for rule, df in rules.items()
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


# --- gates -------------------------------------------------------------------------------------


def quality_gate(results: DataFrame) -> DataFrame:
    """Speed, stability and short-action rules per run. A rule over no rows fails.

    results: run_id, case_id, result_id, duration_s, fps, inference_s, expected_relevance,
    relevance, transient_action, failure_type.
    """
    complete = F.col("failure_type").isNull()
    clip = complete & (F.col("duration_s") == C.GATE_CLIP_SECONDS)
    base = results.groupBy("run_id").agg(
        F.bool_and(complete).alias("all_inferences_succeeded"),
        F.coalesce(
            F.bool_and(F.when(complete, F.col("relevance").eqNullSafe(F.col("expected_relevance")))),
            F.lit(False),
        ).alias("all_expected_relevance_matches"),
        F.coalesce(
            F.bool_and(F.when(clip, F.col("inference_s") <= C.GATE_MAX_LATENCY)), F.lit(False)
        ).alias("all_clips_in_time"),
        F.count_if(clip).alias("n_clips"),
    )
    slowest = (
        top_per_group(
            results.filter(clip), ["run_id"], [F.desc("inference_s"), F.asc("result_id")], 3
        )
        .groupBy("run_id")
        .agg(F.round(F.sum("inference_s"), 3).alias("worst_top3_seconds"))
    )
    # Of several results for one (case, fps) the last counts.
    at = lambda fps: F.max_by(
        F.when(F.col("fps") == fps, F.col("relevance")),
        F.when(F.col("fps") == fps, F.col("result_id")),
    )
    seen = lambda fps: F.count_if(F.col("fps") == fps) > 0
    cases = (
        results.filter(complete & F.col("transient_action"))
        .groupBy("run_id", "case_id")
        .agg(
            (
                seen(1.0) & seen(2.0)
                & (F.coalesce(at(1.0), F.lit(-1)) >= F.coalesce(at(2.0), F.lit(-1)))
            ).alias("kept")
        )
        .groupBy("run_id")
        .agg(F.bool_and("kept").alias("one_fps_keeps_actions"))
    )
    joined = base.join(slowest, "run_id", "left").join(cases, "run_id", "left").withColumns(
        {
            "worst_top3_seconds": F.coalesce("worst_top3_seconds", F.lit(0.0)),
            "one_fps_keeps_actions": F.coalesce("one_fps_keeps_actions", F.lit(False)),
        }
    ).withColumn(
        "worst_top3_in_time",
        (F.col("n_clips") >= 3) & (F.col("worst_top3_seconds") <= C.GATE_MAX_TOP3_TOTAL),
    )
    passed = (
        F.col("all_inferences_succeeded") & F.col("all_expected_relevance_matches")
        & F.col("all_clips_in_time") & F.col("worst_top3_in_time") & F.col("one_fps_keeps_actions")
    )
    return joined.withColumn("passed", passed).drop("n_clips")


def resource_gate(samples: DataFrame) -> DataFrame:
    """Growth of a byte gauge over a run against its start. samples: run_id, sample_id, ts,
    used_bytes."""
    when = F.struct("ts", "sample_id")
    gauges = samples.groupBy("run_id").agg(
        F.min_by("used_bytes", when).alias("first"), F.max_by("used_bytes", when).alias("last"),
        F.max("used_bytes").alias("peak"),
    )
    growth = lambda c: F.greatest(F.lit(0).cast("bigint"), F.col(c) - F.col("first"))
    return gauges.select(
        "run_id", growth("peak").alias("peak_growth"), growth("last").alias("end_growth"),
        (
            (growth("peak") <= C.MAX_PEAK_SWAP_GROWTH) & (growth("last") <= C.MAX_END_SWAP_GROWTH)
        ).alias("within_limit"),
    )


def latency_summary(results: DataFrame) -> DataFrame:
    """First latency, mean of the rest and total per run. results: run_id, result_id,
    inference_s.

    first = the latency at the least id; the rest is total minus first, so no row numbering.
    """
    sums = results.groupBy("run_id").agg(
        F.min_by("inference_s", "result_id").alias("first"), F.sum("inference_s").alias("total"),
        F.count("inference_s").alias("n"),
    )
    return sums.select(
        "run_id", F.round("first", 3).alias("first_seconds"),
        F.when(F.col("n") > 1, F.round((F.col("total") - F.col("first")) / (F.col("n") - 1), 3))
        .alias("rest_mean_seconds"),
        F.round("total", 3).alias("total_seconds"),
    )


def manifest_coverage(cases: DataFrame) -> DataFrame:
    """What a case manifest lacks, per manifest. cases: manifest_id, case_id, source_path,
    start_s, duration_s, transient_action, coverage_tags (array)."""
    tags = F.explode("coverage_tags").alias("tag")
    trimmed = F.regexp_replace("tag", r"^\s+|\s+$", "")
    have = lambda t: F.count_if(F.col("tag") == t) == 0
    tag_gaps = (
        cases.select("manifest_id", tags)
        .withColumn("tag", trimmed)
        .groupBy("manifest_id")
        .agg(
            F.array_join(
                F.array_sort(F.array_compact(
                    F.array(*[F.when(have(t), t) for t in C.REQUIRED_TAGS])
                )), ","
            ).alias("missing_tags")
        )
    )
    repeated = lambda keys, name: (
        cases.groupBy("manifest_id", *keys).count().filter(F.col("count") > 1)
        .groupBy("manifest_id").agg(F.count(F.lit(1)).alias(name))
    )
    lacks = lambda d: F.count_if(F.col("duration_s") == d) == 0
    base = cases.groupBy("manifest_id").agg(
        F.count(F.lit(1)).alias("n_cases"),
        (F.count(F.lit(1)) >= C.MIN_BENCHMARK_CASES).alias("enough_cases"),
        F.array_join(
            F.array_compact(
                F.array(*[F.when(lacks(d), f"{d:g}") for d in C.REQUIRED_DURATIONS])
            ), ","
        ).alias("missing_durations"),
        F.bool_or("transient_action").alias("has_transient_action"),
        F.bool_or(F.col("duration_s") < 1.0).alias("has_subsecond"),
        F.count_if(F.col("duration_s") > 30.0).alias("too_long"),
    )
    return (
        base.join(tag_gaps, "manifest_id", "left")
        .join(repeated(["case_id"], "duplicate_ids"), "manifest_id", "left")
        .join(
            repeated(["source_path", "start_s", "duration_s"], "duplicate_scenes"),
            "manifest_id", "left",
        )
        .withColumn(
            "missing_tags",
            F.coalesce("missing_tags", F.lit(",".join(sorted(C.REQUIRED_TAGS)))),
        )
        .fillna(0, subset=["duplicate_ids", "duplicate_scenes"])
    )


def failure_category(error_type: Column, message: Column) -> Column:
    """Stable category of a failure: typed errors first, then words in the message."""
    text = F.lower(F.coalesce(message, F.lit("")))
    has = lambda word: F.contains(text, F.lit(word))
    return (
        F.when(error_type == "InferenceTimeoutError", "VLM_TIMEOUT")
        .when(error_type == "KeyboardInterrupt", "INTERRUPTED")
        .when((error_type == "MemoryError") | has("out of memory"), "OUT_OF_MEMORY")
        .when(
            (error_type == "ValueError") & (has("strict json") | has("model response")),
            "INVALID_STRUCTURED_OUTPUT",
        )
        .when(has("video") | has("ffmpeg") | has("decode"), "VIDEO_DECODE_FAILED")
        .otherwise("INFERENCE_FAILED")
    )

"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.operators import hybrid, ranking, reports, temporal, vector_search
from reelquery.plans.join_queries import DEPTH, candidates, channel_hits
from reelquery.plans.registry import query

COUNTS = """
    SELECT l.library_id, count(f.file_id) AS media_count,
      count(*) FILTER (f.index_status = 'indexed') AS indexed_count,
      count(*) FILTER (f.index_status = 'failed') AS failed_count
    FROM v_libraries l LEFT JOIN v_files f ON f.library_id = l.library_id GROUP BY l.library_id"""


@query("library_counts", COUNTS)
def library_counts(t):
    return reports.library_counts(t.v_libraries, t.v_files)


@query(
    "library_totals",
    f"""
    SELECT library_id, CAST(sum(media_count) AS BIGINT) AS media_count,
      CAST(sum(indexed_count) AS BIGINT) AS indexed_count,
      CAST(sum(failed_count) AS BIGINT) AS failed_count
    FROM ({COUNTS}) GROUP BY ROLLUP (library_id)""",
)
def library_totals(t):
    return reports.library_totals(reports.library_counts(t.v_libraries, t.v_files))


@query(
    "job_status_rollup",
    "SELECT job_type, status, count(*) AS cnt FROM v_jobs GROUP BY job_type, status",
)
def job_status_rollup(t):
    return reports.count_by(t.v_jobs, "job_type", "status")


@query(
    "library_distinct_counts",
    """
    SELECT l.library_id, count(DISTINCT f.file_id) AS files, count(DISTINCT a.asset_id) AS assets
    FROM v_libraries l LEFT JOIN v_files f ON f.library_id = l.library_id
    LEFT JOIN v_assets a ON a.file_id = f.file_id GROUP BY l.library_id""",
)
def library_distinct_counts(t):
    return reports.library_distinct_counts(t.v_libraries, t.v_files, t.v_assets)


@query(
    "ref_progress",
    """
    SELECT collection, count(*) FILTER (status = 'pending') AS pending,
      count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'stale') AS stale
    FROM v_refs GROUP BY collection""",
)
def ref_progress(t):
    return reports.status_pivot(t.v_refs)


@query(
    "total_with_page",
    """
    SELECT file_id, relative_path, (SELECT count(*) FROM v_files WHERE NOT is_deleted) AS total
    FROM v_files WHERE NOT is_deleted ORDER BY relative_path, file_id LIMIT 25 OFFSET 10""",
)
def total_with_page(t):
    live = t.v_files.filter(~F.col("is_deleted")).select("file_id", "relative_path")
    return reports.page_with_total(live, [F.asc("relative_path"), F.asc("file_id")], 25, 10)


@query(
    "maxsim_by_scene",
    """
    SELECT query_id, variant_order, scene_id, point_id, score, hit_rank FROM v_hits
    WHERE collection = 'video_frame_vectors'""",
)
def maxsim_by_scene(t):
    frames = t.v_points.filter(F.col("collection") == C.GROUPED_CHANNEL)
    hits = vector_search.variant_hits(frames, t.v_queries, DEPTH)
    return hits.select(
        "query_id", "variant_order", F.col("identity").alias("scene_id"), "point_id", "score",
        "hit_rank",
    )


@query(
    "best_variant_hit",
    "SELECT query_id, collection, identity, point_id, score, channel_rank FROM v_channel",
)
def best_variant_hit(t):
    return channel_hits(t)


@query(
    "variant_hit_evidence",
    """
    SELECT query_id, collection, identity, variant_order, point_id, score,
      score * weight AS weighted_score,
      row_number() OVER (PARTITION BY query_id, collection, identity
        ORDER BY score * weight DESC, variant_order) = 1 AS winning
    FROM v_hits""",
)
def variant_hit_evidence(t):
    hits = vector_search.variant_hits(t.v_points, t.v_queries, DEPTH)
    return vector_search.variant_evidence(hits).select(
        "query_id", "collection", "identity", "variant_order", "point_id", "score",
        "weighted_score", "winning",
    )


@query(
    "merge_scores_max",
    """
    SELECT query_id, file_id, source, max(score) AS score FROM v_candidates GROUP BY ALL""",
)
def merge_scores_max(t):
    merged = hybrid.merge_scores_max(candidates(t), ["query_id", "file_id"])
    return merged.select("query_id", "file_id", F.explode("source_scores").alias("source", "score"))


RANKED = """
    SELECT * FROM (SELECT query_id, candidate_key, row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, candidate_key) AS rank
      FROM (SELECT query_id, point_id AS candidate_key, score FROM v_scored
        WHERE variant_order = 0)) WHERE rank <= 300"""
DISCOVERY = f"""
    SELECT q.query_id, m.precision_5, m.precision_10, m.ndcg_10, m.ndcg_20
    FROM (SELECT DISTINCT query_id FROM v_queries) q LEFT JOIN (
      SELECT query_id,
        round(count(*) FILTER (p <= 5 AND relevance > 0) / count(*) FILTER (p <= 5), 6)
          AS precision_5,
        round(count(*) FILTER (p <= 10 AND relevance > 0) / count(*) FILTER (p <= 10), 6)
          AS precision_10,
        round(CASE WHEN sum(i10) = 0 THEN 0 ELSE sum(g) FILTER (p <= 10) / sum(i10) END, 6)
          AS ndcg_10,
        round(CASE WHEN sum(i20) = 0 THEN 0 ELSE sum(g) / sum(i20) END, 6) AS ndcg_20
      FROM (SELECT *, (pow(2, relevance) - 1) / log2(p + 1) AS g,
          CASE WHEN p <= 10 THEN (pow(2, relevance) - 1) / log2(1 + row_number() OVER
            (PARTITION BY query_id, p <= 10 ORDER BY relevance DESC)) END AS i10,
          (pow(2, relevance) - 1) / log2(1 + row_number() OVER
            (PARTITION BY query_id ORDER BY relevance DESC)) AS i20
        FROM (SELECT r.query_id, j.relevance, row_number() OVER (PARTITION BY r.query_id
            ORDER BY rank) AS p FROM ({RANKED}) r JOIN v_judgments j USING (query_id, candidate_key)
          WHERE j.relevance IS NOT NULL) WHERE p <= 20) GROUP BY query_id) m USING (query_id)"""


def ranked(t):
    """The result list the metrics judge: top 300 over all points, by the first variant's score."""
    points = t.v_points.withColumn("collection", F.lit("image_vectors"))
    queries = t.v_queries.filter(F.col("variant_order") == 0)
    hits = vector_search.variant_hits(points, queries, C.MAX_SOURCE_LIMIT, grouped=False)
    return hits.select(
        "query_id", F.col("point_id").alias("candidate_key"), "score",
        F.col("hit_rank").alias("rank"),
    )


def discovery(t):
    metrics = ranking.discovery_metrics(ranked(t), t.v_judgments)
    names = ["precision_5", "precision_10", "ndcg_10", "ndcg_20"]
    return metrics.select("query_id", *[F.round(n, 6).alias(n) for n in names])


@query("ranking_metrics_discovery", DISCOVERY)
def ranking_metrics_discovery(t):
    return discovery(t)


TARGET = f"""
    SELECT CAST(t.label AS BIGINT) AS query_id, CAST(coalesce(rank <= 5, FALSE) AS INT) AS hit_5,
      CAST(coalesce(rank <= 10, FALSE) AS INT) AS hit_10,
      CAST(coalesce(rank <= 20, FALSE) AS INT) AS hit_20,
      coalesce(1 / rank, 0) AS reciprocal_rank
    FROM (SELECT label, max(vec_id) AS target FROM embeddings GROUP BY label) t
    LEFT JOIN ({RANKED}) r ON r.query_id = t.label AND r.candidate_key = t.target"""


def targets(t):
    """The newest vector of each label is the one a query of that label looks for."""
    return t.embeddings.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.max("vec_id").alias("candidate_key")
    )


@query("ranking_metrics_target", TARGET)
def ranking_metrics_target(t):
    return ranking.target_metrics(ranked(t), targets(t))


@query(
    "unjudgeable_count",
    """
    SELECT query_id, count(*) FILTER (relevance IS NULL) AS unjudgeable FROM v_judgments
    GROUP BY query_id""",
)
def unjudgeable_count(t):
    return ranking.unjudgeable_counts(t.v_judgments)


@query(
    "macro_metrics",
    f"""
    SELECT query_id % 2 = 0 AS run, round(avg(ndcg_10), 5) AS macro_ndcg_10,
      round(avg(reciprocal_rank), 5) AS macro_reciprocal_rank
    FROM ({DISCOVERY}) d JOIN ({TARGET}) g USING (query_id) GROUP BY ALL""",
)
def macro_metrics(t):
    """Means over the even and the odd queries as two runs."""
    joined = discovery(t).join(ranking.target_metrics(ranked(t), targets(t)), "query_id")
    runs = joined.withColumn("run", F.col("query_id") % 2 == 0)
    macro = ranking.macro_average(runs, "run", ["ndcg_10", "reciprocal_rank"])
    return macro.select("run", *[F.round(c, 5).alias(c) for c in macro.columns[1:]])


@query(
    "quality_gate",
    """
    WITH r AS (SELECT * FROM v_results), ok AS (SELECT * FROM r WHERE failure_type IS NULL),
    base AS (SELECT run_id, bool_and(failure_type IS NULL) AS all_inferences_succeeded,
        coalesce(bool_and(relevance IS NOT DISTINCT FROM expected_relevance)
          FILTER (failure_type IS NULL), FALSE) AS all_expected_relevance_matches,
        coalesce(bool_and(inference_s <= 60) FILTER (failure_type IS NULL AND duration_s = 30),
          FALSE) AS all_clips_in_time,
        count(*) FILTER (failure_type IS NULL AND duration_s = 30) AS n_clips
      FROM r GROUP BY run_id),
    top AS (SELECT run_id, round(sum(inference_s), 3) AS s FROM (SELECT *, row_number() OVER
        (PARTITION BY run_id ORDER BY inference_s DESC, result_id) AS n FROM ok
        WHERE duration_s = 30) WHERE n <= 3 GROUP BY run_id),
    kept AS (SELECT run_id, bool_and(k) AS k FROM (SELECT run_id, case_id,
          count(*) FILTER (fps = 1) > 0 AND count(*) FILTER (fps = 2) > 0
          AND coalesce(arg_max(relevance, result_id) FILTER (fps = 1), -1)
            >= coalesce(arg_max(relevance, result_id) FILTER (fps = 2), -1) AS k
        FROM ok WHERE transient_action GROUP BY ALL) GROUP BY run_id)
    SELECT run_id, all_inferences_succeeded, all_expected_relevance_matches, all_clips_in_time,
      coalesce(s, 0) AS worst_top3_seconds, coalesce(k, FALSE) AS one_fps_keeps_actions,
      n_clips >= 3 AND coalesce(s, 0) <= 180 AS worst_top3_in_time,
      all_inferences_succeeded AND all_expected_relevance_matches AND all_clips_in_time
        AND n_clips >= 3 AND coalesce(s, 0) <= 180 AND coalesce(k, FALSE) AS passed
    FROM base LEFT JOIN top USING (run_id) LEFT JOIN kept USING (run_id)""",
)
def quality_gate(t):
    return reports.quality_gate(t.v_results)


@query(
    "resource_gate",
    """
    SELECT run_id, greatest(0, peak - first) AS peak_growth, greatest(0, last - first)
        AS end_growth,
      greatest(0, peak - first) <= 4294967296 AND greatest(0, last - first) <= 1073741824
        AS within_limit
    FROM (SELECT run_id, max(used_bytes) AS peak,
        arg_min(used_bytes, (ts, sample_id)) AS first, arg_max(used_bytes, (ts, sample_id)) AS last
      FROM v_samples GROUP BY run_id)""",
)
def resource_gate(t):
    return reports.resource_gate(t.v_samples)


@query(
    "latency_summary",
    """
    SELECT run_id, round(first, 3) AS first_seconds,
      CASE WHEN n > 1 THEN round((total - first) / (n - 1), 3) END AS rest_mean_seconds,
      round(total, 3) AS total_seconds
    FROM (SELECT run_id, arg_min(inference_s, result_id) AS first, sum(inference_s) AS total,
        count(inference_s) AS n FROM (SELECT run_id, min(inference_s) AS inference_s, result_id
          FROM v_results WHERE failure_type IS NULL GROUP BY run_id, result_id) GROUP BY run_id)""",
)
def latency_summary(t):
    complete = t.v_results.filter(F.col("failure_type").isNull())
    one_each = complete.groupBy("run_id", "result_id").agg(
        F.min("inference_s").alias("inference_s")
    )
    return reports.latency_summary(one_each)


CASES = """
    SELECT p_brand AS manifest_id, p_size AS case_id, p_name AS source_path,
      CAST(p_size % 5 AS DOUBLE) AS start_s,
      CASE p_size % 4 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 15.0::DOUBLE WHEN 2 THEN 30.0::DOUBLE
        ELSE p_retailprice / 2000 END AS duration_s,
      p_type = 'PROMO' AS transient_action,
      CASE p_type WHEN 'PROMO' THEN 'transient_action' WHEN 'ECONOMY' THEN 'person_relationship'
        WHEN 'STANDARD' THEN 'environment_constraint' ELSE p_type END AS tag
    FROM part"""


@query(
    "manifest_coverage",
    f"""
    WITH c AS ({CASES}),
    ids AS (SELECT manifest_id, count(*) AS n FROM (SELECT manifest_id, case_id FROM c
      GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
    scenes AS (SELECT manifest_id, count(*) AS n FROM (SELECT manifest_id, source_path, start_s,
      duration_s FROM c GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL)
    SELECT c.manifest_id, count(*) AS n_cases, count(*) >= 10 AS enough_cases,
      concat_ws(',', CASE WHEN bool_and(duration_s <> 5) THEN '5' END,
        CASE WHEN bool_and(duration_s <> 15) THEN '15' END,
        CASE WHEN bool_and(duration_s <> 30) THEN '30' END) AS missing_durations,
      bool_or(transient_action) AS has_transient_action, bool_or(duration_s < 1) AS has_subsecond,
      count(*) FILTER (duration_s > 30) AS too_long,
      concat_ws(',', CASE WHEN bool_and(tag <> 'environment_constraint')
          THEN 'environment_constraint' END,
        CASE WHEN bool_and(tag <> 'person_relationship') THEN 'person_relationship' END,
        'single_hand_peace_sign',
        CASE WHEN bool_and(tag <> 'transient_action') THEN 'transient_action' END) AS missing_tags,
      coalesce(any_value(ids.n), 0) AS duplicate_ids,
      coalesce(any_value(scenes.n), 0) AS duplicate_scenes
    FROM c LEFT JOIN ids USING (manifest_id) LEFT JOIN scenes USING (manifest_id)
    GROUP BY c.manifest_id""",
)
def manifest_coverage(t):
    """Parts as benchmark cases, brands as manifests."""
    size, kind = F.col("p_size"), F.col("p_type")
    cases = t.part.select(
        F.col("p_brand").alias("manifest_id"), size.alias("case_id"),
        F.col("p_name").alias("source_path"), (size % 5).cast("double").alias("start_s"),
        F.when(size % 4 == 0, 5.0).when(size % 4 == 1, 15.0).when(size % 4 == 2, 30.0)
        .otherwise(F.col("p_retailprice") / 2000).alias("duration_s"),
        (kind == "PROMO").alias("transient_action"),
        F.array(
            F.concat(
                F.lit(" "),
                F.when(kind == "PROMO", "transient_action")
                .when(kind == "ECONOMY", "person_relationship")
                .when(kind == "STANDARD", "environment_constraint")
                .otherwise(kind),
            )
        ).alias("coverage_tags"),
    )
    return reports.manifest_coverage(cases)


@query(
    "run_counts",
    """
    SELECT file_id, count(DISTINCT scene_key) AS scenes_detected, count(*) AS assets_created,
      count(*) AS vector_refs_created, count(*) AS frames_created
    FROM (SELECT w.file_id, w.scene_key FROM v_windows w JOIN v_frames f
      ON f.file_id = w.file_id AND f.scene_key = w.scene_key) GROUP BY file_id""",
)
def run_counts(t):
    windows = temporal.split_long_scenes(temporal.merge_short_scenes(t.v_cuts))
    frames = temporal.frames(windows)
    return temporal.index_run_counts(frames, frames, windows)


@query(
    "index_completeness",
    """
    SELECT 'videos_without_scenes' AS rule, count(*) AS n FROM v_files WHERE media_type = 'video'
      AND NOT is_deleted AND file_id NOT IN (SELECT file_id FROM v_scenes)
    UNION ALL SELECT 'scenes_without_frames', count(*) FROM v_scenes s WHERE NOT EXISTS (SELECT 1
      FROM v_assets a WHERE a.asset_type = 'video_frame' AND a.scene_id = s.scene_id)
    UNION ALL SELECT 'frames_without_indexed_ref', count(*) FROM v_assets a
      WHERE a.asset_type = 'video_frame' AND NOT EXISTS (SELECT 1 FROM v_refs r
        WHERE r.asset_id = a.asset_id AND r.status = 'indexed')
    UNION ALL SELECT 'generation_mismatch', count(*) FROM v_scenes s JOIN v_files f
      ON f.file_id = s.file_id WHERE s.index_generation <> f.index_generation""",
)
def index_completeness(t):
    return reports.index_completeness(t.v_files, t.v_scenes, t.v_assets, t.v_refs)


@query(
    "error_code_rollup",
    """
    SELECT job_type, error_code, count(*) AS failures,
      CAST(grouping_id(job_type, error_code) AS BIGINT) AS level
    FROM v_jobs WHERE status = 'failed' GROUP BY ROLLUP (job_type, error_code)""",
)
def error_code_rollup(t):
    return reports.error_code_rollup(t.v_jobs)


@query(
    "failure_classify",
    """
    SELECT doc_id, CASE WHEN lang = 'en' THEN 'VLM_TIMEOUT' WHEN lang = 'de' THEN 'OUT_OF_MEMORY'
        WHEN lang = 'fr' AND (contains(m, 'strict json') OR contains(m, 'model response'))
          THEN 'INVALID_STRUCTURED_OUTPUT'
        WHEN contains(m, 'out of memory') THEN 'OUT_OF_MEMORY'
        WHEN contains(m, 'video') OR contains(m, 'ffmpeg') OR contains(m, 'decode')
          THEN 'VIDEO_DECODE_FAILED' ELSE 'INFERENCE_FAILED' END AS category
    FROM (SELECT doc_id, lang, lower(concat(text, CASE n_chars % 4 WHEN 0 THEN ' Model Response'
      WHEN 1 THEN ' FFmpeg' WHEN 2 THEN ' out of Memory' ELSE '' END)) AS m FROM documents)""",
)
def failure_classify(t):
    """Documents as error messages; their language stands for the exception type."""
    lang, tail = F.col("lang"), F.col("n_chars") % 4
    message = F.concat(
        "text",
        F.when(tail == 0, " Model Response").when(tail == 1, " FFmpeg")
        .when(tail == 2, " out of Memory").otherwise(""),
    )
    kind = (
        F.when(lang == "en", "InferenceTimeoutError").when(lang == "de", "MemoryError")
        .when(lang == "fr", "ValueError").otherwise("RuntimeError")
    )
    return t.documents.select("doc_id", reports.failure_category(kind, message).alias("category"))


"""Window functions, sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.functions import scoring
from reelquery.operators import jobs as J
from reelquery.operators import hybrid, ranking, relations, temporal, text_search, vector_search
from reelquery.operators.ordered import numbered, spread, top_per_group
from reelquery.plans import search
from reelquery.plans.join_queries import (
    DEPTH, candidates, channel_rows, hydrated,
)
from reelquery.plans.registry import query

# Result key and rank of each channel, as fusion reads them.
RANKS = """
    SELECT query_id, signal, candidate_key, row_number() OVER (PARTITION BY query_id, signal
        ORDER BY down, channel_no, channel_rank, candidate_key) AS source_rank
    FROM (SELECT query_id, signal, candidate_key, o[1] AS down, o[2] AS channel_no,
        o[3] AS channel_rank FROM (
          SELECT query_id, signal, candidate_key, min([-score, channel_no, channel_rank]) AS o
          FROM (SELECT query_id, score, CAST(floor(input_order / 301) AS DOUBLE) AS channel_no,
              CAST(input_order % 301 AS DOUBLE) AS channel_rank,
              CASE source WHEN 'text_search' THEN 'lexical' WHEN 'caption_text_vectors'
                THEN 'caption' ELSE 'visual' END AS signal,
              coalesce(scene_id, concat('asset-', asset_id)) AS candidate_key FROM v_candidates)
          GROUP BY ALL))"""
FUSED = f"""
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_key) AS rank,
      CASE greatest(visual, caption, lexical) WHEN visual THEN 'visual' WHEN caption
        THEN 'caption' ELSE 'lexical' END AS primary_signal
    FROM (SELECT query_id, candidate_key, visual, caption, lexical,
        coalesce(visual, 0) + coalesce(caption, 0) + coalesce(lexical, 0) AS score
      FROM (SELECT query_id, candidate_key,
          max(1 / (60 + source_rank)) FILTER (signal = 'visual') AS visual,
          max(1 / (60 + source_rank)) FILTER (signal = 'caption') AS caption,
          max(1 / (60 + source_rank)) FILTER (signal = 'lexical') AS lexical
        FROM ({RANKS}) GROUP BY ALL))"""


def ranks(t):
    return search.channel_ranks(channel_rows(t))


@query(
    "source_rank",
    "SELECT query_id, collection, point_id, source_rank FROM v_hydrated",
)
def source_rank(t):
    return hydrated(t).select("query_id", "collection", "point_id", "source_rank")


@query("rrf_fuse", f"SELECT query_id, candidate_key, score, rank FROM ({FUSED})")
def rrf_fuse(t):
    return ranking.rrf_fuse(ranks(t), large=False).select("query_id", "candidate_key", "score", "rank")


@query(
    "rrf_contributions",
    f"""SELECT query_id, candidate_key, visual, caption, lexical, primary_signal FROM ({FUSED})""",
)
def rrf_contributions(t):
    wide = ranking.contributions(ranks(t))
    return wide.withColumn("primary_signal", ranking.primary_signal())


@query(
    "rrf_input_check",
    """
    SELECT candidate_key, CASE WHEN signal = 'other' THEN 'no_channel' WHEN r IS NULL
      THEN 'no_rank' WHEN r <> floor(r) THEN 'not_whole' ELSE 'below_one' END AS problem
    FROM (SELECT l_orderkey * 10 + l_linenumber AS candidate_key,
        CASE l_returnflag WHEN 'R' THEN 'visual' WHEN 'A' THEN 'caption' ELSE 'other' END AS signal,
        CASE WHEN l_tax > 0.07 THEN NULL ELSE l_linenumber - 3 + l_discount * 10 END AS r
      FROM lineitem)
    WHERE signal = 'other' OR r IS NULL OR r <> floor(r) OR r < 1""",
)
def rrf_input_check(t):
    """Line items as ranks, many of them missing, fractional or below one."""
    flag = F.col("l_returnflag")
    rows = t.lineitem.select(
        F.lit(1).alias("query_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_key"),
        F.when(flag == "R", "visual").when(flag == "A", "caption").otherwise("other").alias(
            "signal"
        ),
        F.when(F.col("l_tax") <= 0.07, F.col("l_linenumber") - 3 + F.col("l_discount") * 10).alias(
            "source_rank"
        ),
    )
    return ranking.invalid_ranks(rows).select("candidate_key", "problem")


@query(
    "claim_order",
    """
    SELECT job_id, row_number() OVER (ORDER BY priority DESC, created_at, job_id) AS position
    FROM v_jobs WHERE status = 'queued'""",
)
def claim_order(t):
    return J.claim_order(t.v_jobs).select("job_id", "position")


DURATIONS = """
    SELECT conv_id AS file_id, turn AS seq, length(text) / CAST(16 AS DOUBLE) AS d
    FROM conversations"""


@query(
    "scene_cumulative_bounds",
    f"""
    SELECT file_id, seq, sum(d) OVER w - d AS start_s, sum(d) OVER w AS end_s FROM ({DURATIONS})
    WINDOW w AS (PARTITION BY file_id ORDER BY seq)""",
)
def scene_cumulative_bounds(t):
    durations = t.conversations.select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("seq"),
        (F.length("text") / F.lit(16.0)).alias("d"),
    )
    return temporal.cumulative_bounds(durations)


@query(
    "scene_boundary_check",
    """
    SELECT file_id, seq, CASE WHEN duration_seconds IS NULL THEN 'duration_missing'
        WHEN end_s <= start_s THEN 'not_positive'
        WHEN start_s < 0 OR end_s > duration_seconds + 1e-6 THEN 'outside_file'
        WHEN start_s < prev - 1e-6 THEN 'overlap' END AS problem
    FROM (SELECT c.*, lag(end_s) OVER (PARTITION BY file_id ORDER BY seq) AS prev
      FROM (SELECT l_orderkey AS file_id, seq, start_s, start_s + l - 5 AS end_s
        FROM (SELECT c.file_id AS l_orderkey, c.seq, c.start_s, (c.end_s - c.start_s) * 1.25 AS l
          FROM v_cuts c)) c) x LEFT JOIN v_cut_files f USING (file_id)""",
)
def scene_boundary_check(t):
    """Cuts stretched by a quarter and cut by five seconds, so some overlap and some are empty."""
    length = (F.col("end_s") - F.col("start_s")) * 1.25
    scenes = t.v_cuts.withColumn("end_s", F.col("start_s") + length - 5)
    return temporal.boundary_problems(scenes, t.v_cut_files).select("file_id", "seq", "problem")


@query(
    "last_attempt",
    """
    SELECT json_extract_string(input_json, '$.asset_id') AS asset_id,
      json_extract_string(input_json, '$.collection') AS collection,
      json_extract_string(input_json, '$.model_name') AS model_name,
      json_extract_string(input_json, '$.model_version') AS model_version,
      epoch_us(max(created_at)) AS last_attempt_us
    FROM v_jobs WHERE job_type IN ('embed_image', 'embed_video_frame', 'embed_text_asset')
    GROUP BY ALL""",
)
def last_attempt(t):
    micros = F.unix_micros(F.col("last_attempt").cast("timestamp")).alias("last_attempt_us")
    return relations.last_attempts(t.v_jobs).select(*relations.REF_KEY, micros)


@query(
    "frame_index",
    """
    SELECT file_id, scene_key, frame_index, frame_time_s, frame_index = 1 AS is_representative
    FROM v_frames""",
)
def frame_index(t):
    windows = temporal.split_long_scenes(temporal.merge_short_scenes(t.v_cuts))
    return temporal.frames(windows).select(
        "file_id", "scene_key", "frame_index", "frame_time_s", "is_representative"
    )


@query(
    "best_frames_by_scene",
    """
    WITH v AS (SELECT * FROM v_hydrated WHERE collection = 'video_frame_vectors'
      AND media_type = 'video')
    SELECT query_id, file_id, scene_id, point_id, position, incomplete_count
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_rank) AS position
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_id, scene_id
          ORDER BY source_rank) AS n FROM v WHERE scene_id IS NOT NULL AND start_s IS NOT NULL)
      WHERE n = 1) JOIN (SELECT query_id, count(*) FILTER (scene_id IS NULL OR start_s IS NULL)
        AS incomplete_count FROM v GROUP BY query_id) USING (query_id)
    WHERE position <= 5""",
)
def best_frames_by_scene(t):
    frames = hydrated(t).filter(F.col("collection") == C.GROUPED_CHANNEL)
    return relations.best_frames_by_scene(frames).select(
        "query_id", "file_id", "scene_id", "point_id", "position", "incomplete_count"
    )


@query(
    "vector_topk",
    """
    SELECT query_id, variant_order, collection, point_id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, variant_order, collection
        ORDER BY score DESC, point_id) AS rank FROM v_scored) WHERE rank <= 60""",
)
def vector_topk(t):
    hits = vector_search.variant_hits(t.v_points, t.v_queries, DEPTH, grouped=False)
    return hits.select(
        "query_id", "variant_order", "collection", "point_id", "score",
        F.col("hit_rank").alias("rank"),
    )


@query(
    "model_size_topk",
    """
    SELECT query_id, variant_order, collection, point_id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, variant_order, collection
        ORDER BY score DESC, point_id) AS rank
      FROM (SELECT q.query_id, q.variant_order, p.collection, p.point_id,
          CASE WHEN p.collection = 'caption_text_vectors'
            THEN round(list_dot_product(CAST(p.embedding[1:32] AS DOUBLE[]), q.query_embedding[1:32]), 6)
            ELSE round(list_dot_product(CAST(p.embedding AS DOUBLE[]), q.query_embedding), 6) END AS score
        FROM v_points p CROSS JOIN v_queries q)) WHERE rank <= 60""",
)
def model_size_topk(t):
    """Captions have a model of half the size, and queries a vector for each channel."""
    short = lambda column: F.slice(column, 1, 32)
    captions = F.col("collection") == C.CAPTION_CHANNEL
    points = t.v_points.withColumn(
        "embedding", F.when(captions, short("embedding")).otherwise(F.col("embedding"))
    )
    queries = t.v_queries.withColumn(
        "collection", F.explode(F.array(*map(F.lit, C.COLLECTIONS)))
    ).withColumn(
        "query_embedding", F.when(captions, short("query_embedding")).otherwise(F.col("query_embedding"))
    )
    hits = vector_search.variant_hits(points, queries, DEPTH, grouped=False)
    return hits.select(
        "query_id", "variant_order", "collection", "point_id", "score", F.col("hit_rank").alias("rank")
    )


@query(
    "source_limit",
    """
    SELECT o_orderkey, least(300, greatest(30, 3 * (o_custkey % 100 + o_orderkey % 50)))
      AS source_limit FROM orders""",
)
def source_limit(t):
    limit = scoring.source_limit(F.col("o_custkey") % 100, F.col("o_orderkey") % 50)
    return t.orders.select("o_orderkey", limit.alias("source_limit"))


@query(
    "hybrid_page",
    """
    SELECT query_id, file_id, start_s, score, position FROM (
      SELECT query_id, file_id, start_s, asset_id, score, row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, file_id, start_s NULLS LAST, asset_id, input_order) AS position
      FROM v_candidates) WHERE position > query_id AND position <= query_id + 15""",
)
def hybrid_page(t):
    """Unmerged candidates paged, each query from its own offset."""
    rows = candidates(t).select(
        "query_id", "file_id", "start_s", "asset_id",
        F.element_at(F.map_values("source_scores"), 1).alias("score"),
    )
    requests = t.v_queries.select("query_id").distinct().select(
        "query_id", F.lit(15).alias("page_limit"), F.col("query_id").alias("page_offset")
    )
    return hybrid.page(rows, requests).select(
        "query_id", "file_id", "start_s", "score", "position"
    )


@query(
    "stable_page",
    """
    SELECT file_id, relative_path FROM v_files WHERE NOT is_deleted
    ORDER BY relative_path, file_id LIMIT 50 OFFSET 20""",
)
def stable_page(t):
    live = t.v_files.filter(~F.col("is_deleted")).select("file_id", "relative_path")
    return live.orderBy("relative_path", "file_id").offset(20).limit(50)


@query(
    "recent_jobs",
    """SELECT job_id, job_type, status FROM v_jobs ORDER BY created_at DESC, job_id DESC
      LIMIT 500""",
)
def recent_jobs(t):
    return J.recent(t.v_jobs, limit=1000).select("job_id", "job_type", "status")


@query(
    "recent_failures",
    """SELECT job_id, job_type, error_message FROM v_jobs WHERE status = 'failed'
      ORDER BY created_at DESC, job_id DESC LIMIT 20""",
)
def recent_failures(t):
    return J.recent(t.v_jobs.filter(F.col("status") == "failed"), limit=20).select(
        "job_id", "job_type", "error_message"
    )


CAPTION_CHARS = 120


@query(
    "recent_captions",
    """SELECT asset_id, file_id, left(text_content, 120) AS caption, metadata_json FROM v_assets
      WHERE asset_type = 'caption' ORDER BY created_seq DESC LIMIT 20""",
)
def recent_captions(t):
    captions = t.v_assets.filter(F.col("asset_type") == "caption")
    return captions.orderBy(F.desc("created_seq")).limit(20).select(
        "asset_id", "file_id", F.substring("text_content", 1, CAPTION_CHARS).alias("caption"), "metadata_json"
    )


@query(
    "uniform_pick",
    """
    SELECT run_id, frame_no FROM (SELECT DISTINCT run_id, CAST(CASE WHEN n <= 6 THEN i + 1
        ELSE round_even(i * (n - 1) / 5, 0) + 1 END AS BIGINT) AS frame_no
      FROM (SELECT user_id AS run_id, count(*) AS n FROM events GROUP BY user_id)
        JOIN range(6) r(i) ON i < n)""",
)
def uniform_pick(t):
    """Events as frames of their user's scene: six of them, evenly spaced with both ends."""
    frames = t.events.select(
        F.col("user_id").alias("scene_id"), F.lit(0).alias("file_id"),
        F.col("ts").alias("frame_time_s"), F.col("event_id").alias("asset_id"),
    )
    ordered = numbered(frames, ["scene_id"], ["frame_time_s", "asset_id"], "frame_no")
    return temporal.pick_frames(ordered).select(F.col("scene_id").alias("run_id"), "frame_no")


@query(
    "text_topk",
    """
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, doc_id) AS rank FROM v_text_scores) WHERE rank <= 10""",
)
def text_topk(t):
    ranked = text_search.text_rank(spread(t.documents.select("doc_id", "text")), t.v_text_queries, "doc_id").withColumn(
        "score", F.round("score", 6)
    )
    return top_per_group(
        ranked, ["query_id"], [F.desc("score"), F.asc("doc_id")], 10, "rank"
    ).select("query_id", "doc_id", "score", "rank")

"""Scenes, frames, transcript chunks and the index built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery.functions.formatting import fmt_g
from reelquery.operators import relations, snapshots, temporal
from reelquery.plans.join_queries import UNATTEMPTED
from reelquery.plans.registry import query
from reelquery.plans.upsert_queries import NAMESPACE, UUID_SQL


@query("merge_short_scenes", "SELECT file_id, scene_no, start_s, end_s FROM v_merged")
def merge_short_scenes(t):
    return temporal.merge_short_scenes(t.v_cuts)


@query(
    "split_long_scenes",
    "SELECT file_id, scene_no, part, part_count, scene_key, start_s, end_s FROM v_windows",
)
def split_long_scenes(t):
    return temporal.split_long_scenes(temporal.merge_short_scenes(t.v_cuts))


@query(
    "chunk_transcript",
    """
    WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS rn,
        lead(end_s) OVER (PARTITION BY file_id ORDER BY seq) AS next_end
      FROM (SELECT file_id, seq, start_s, end_s, regexp_replace(segment_text, '^\\s+|\\s+$', '',
        'g') AS t FROM v_segments) WHERE end_s > start_s AND t <> ''),
    walk AS (
      SELECT file_id, seq, rn, start_s AS open, seq AS first, end_s - start_s >= 15 AND
        (next_end IS NULL OR next_end - start_s > 30) AS closed FROM s WHERE rn = 1
      UNION ALL
      SELECT file_id, seq, rn, open, first, end_s - open >= 15 AND (next_end IS NULL
        OR next_end - open > 30) AS closed
      FROM (SELECT s.file_id, s.seq, s.rn, s.end_s, s.next_end,
          CASE WHEN w.closed THEN s.start_s ELSE w.open END AS open,
          CASE WHEN w.closed THEN s.seq ELSE w.first END AS first
        FROM walk w JOIN s ON s.file_id = w.file_id AND s.rn = w.rn + 1))
    SELECT file_id, arg_min(start_s, seq) AS start_s, arg_max(end_s, seq) AS end_s,
      count(*) AS n_segments, string_agg(t, ' ' ORDER BY seq) AS text_content,
      concat(file_id, ':text:', printf('%g', arg_min(start_s, seq)), ':',
        printf('%g', arg_max(end_s, seq))) AS content_hash
    FROM s JOIN walk w USING (file_id, seq) GROUP BY file_id, first""",
)
def chunk_transcript(t):
    return temporal.chunk_transcript(t.v_segments)


# Scenes of files that pass every check, with the files that do not.
CHECKED = """
    SELECT m.file_id, m.scene_no, CASE WHEN m.end_s <= m.start_s OR m.start_s < 0
      OR m.end_s > f.duration_seconds + 1e-6 THEN 1 ELSE 0 END AS bad
    FROM v_merged m JOIN v_cut_files f USING (file_id) WHERE f.duration_seconds IS NOT NULL"""
INDEXED_SCENES = f"""
    SELECT file_id, scene_key, start_s, end_s FROM v_windows WHERE file_id IN
      (SELECT file_id FROM ({CHECKED}) GROUP BY file_id HAVING sum(bad) = 0)
    UNION ALL
    SELECT file_id, concat('scene-0001', CASE WHEN n = 1 THEN '' ELSE concat('-part-',
        printf('%03d', p)) END), (p - 1) * 30.0::DOUBLE, least(p * 30.0::DOUBLE, d)
    FROM (SELECT file_id, d, n, unnest(range(1, n + 1)) AS p FROM (SELECT o_orderkey AS file_id,
        o_totalprice / 1000 AS d, greatest(1, CAST(ceil(o_totalprice / 1000 / 30) AS BIGINT)) AS n
      FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey
        FROM lineitem)))"""


@query(
    "index_video",
    f"""
    SELECT file_id, scene_key, i + 1 AS frame_index, frame_time_s, {UUID_SQL} AS scene_id,
      concat(file_id, ':scene:', scene_key, ':', printf('%g', frame_time_s)) AS content_hash
    FROM (SELECT s.*, unnest(range(0, CAST(ceil((end_s - start_s) / 2.5::DOUBLE) AS BIGINT))) AS i,
        (start_s + i * 2.5::DOUBLE + least(start_s + (i + 1) * 2.5::DOUBLE, end_s)) / 2
          AS frame_time_s,
        sha1({NAMESPACE} || encode(concat(s.file_id, '|', scene_key, '|', f.index_generation))) AS h
      FROM ({INDEXED_SCENES}) s JOIN v_cut_files f USING (file_id))""",
)
def index_video(t):
    """Frame assets of every video whose cuts are sound."""
    built = temporal.index_video(t.v_cuts, t.v_cut_files)
    return built["assets"].select(
        "file_id", "scene_key", "frame_index", "frame_time_s", "scene_id", "content_hash"
    )


@query(
    "index_video_refs",
    f"""
    SELECT file_id, scene_key, count(*) AS n_frames, count(*) AS n_points
    FROM (SELECT s.*, unnest(range(0, CAST(ceil((end_s - start_s) / 2.5::DOUBLE) AS BIGINT))) AS i
      FROM ({INDEXED_SCENES}) s) GROUP BY ALL""",
)
def index_video_refs(t):
    """Pending refs per scene; point ids are all different."""
    refs = temporal.index_video(t.v_cuts, t.v_cut_files)["refs"]
    return refs.groupBy("file_id", "scene_key").agg(
        F.count(F.lit(1)).alias("n_frames"), F.count_distinct("point_id").alias("n_points")
    )


@query(
    "indexed_run_counts",
    f"""
    SELECT file_id, count(DISTINCT scene_key) AS scenes_detected, count(*) AS assets_created,
      count(*) AS vector_refs_created, count(*) AS frames_created
    FROM (SELECT s.*, unnest(range(0, CAST(ceil((end_s - start_s) / 2.5::DOUBLE) AS BIGINT))) AS i
      FROM ({INDEXED_SCENES}) s) GROUP BY file_id""",
)
def indexed_run_counts(t):
    """Scenes, frames and vector refs that an indexing run made, each counted in its own table."""
    built = temporal.index_video(t.v_cuts, t.v_cut_files)
    return temporal.index_run_counts(built["assets"], built["refs"], built["scenes"])


@query(
    "index_image",
    f"""
    SELECT file_id, {UUID_SQL} AS asset_id, 'hash' AS content_hash, 768 AS vector_dim
    FROM (SELECT file_id, sha1({NAMESPACE} || encode(concat('image|', file_id, '|', path))) AS h
      FROM v_files WHERE media_type = 'image')""",
)
def index_image(t):
    files = t.v_files.withColumn("content_hash", F.lit("hash"))
    return temporal.index_image(files).select("file_id", "asset_id", "content_hash", "vector_dim")


@query(
    "scene_count_guard",
    """
    SELECT o_orderkey AS file_id, coalesce(n, 0) AS n_scenes, CASE WHEN n IS NULL
      THEN 'INVALID_SCENE_BOUNDARIES' WHEN n > 4 THEN 'SCENE_COUNT_EXCEEDED' END AS error_code
    FROM orders LEFT JOIN (SELECT file_id, count(*) AS n FROM v_merged GROUP BY file_id) m
      ON m.file_id = o_orderkey""",
)
def scene_count_guard(t):
    """With a limit of four scenes, so that some files exceed it."""
    files = t.orders.select(F.col("o_orderkey").alias("file_id"))
    return temporal.scene_count_guard(temporal.merge_short_scenes(t.v_cuts), files, limit=4)


@query(
    "caption_inputs",
    """
    WITH f AS (SELECT scene_id, file_id, asset_id, frame_time_s, row_number() OVER (PARTITION BY
        scene_id ORDER BY frame_time_s, asset_id) AS n, count(*) OVER (PARTITION BY scene_id) AS c
      FROM v_assets WHERE asset_type = 'video_frame' AND scene_id IS NOT NULL
        AND coalesce(json_extract_string(metadata_json, '$.stale'), 'false') <> 'true'),
    p AS (SELECT DISTINCT f.* FROM f, range(6) r(i) WHERE CASE WHEN c <= 6 THEN n = i + 1
      ELSE n = round_even(i * (c - 1) / 5, 0) + 1 END)
    SELECT scene_id, file_id, count(*) AS n_frames, string_agg(printf('%g', frame_time_s), ','
        ORDER BY n) AS frame_times,
      sha256(concat(string_agg(asset_id, '|' ORDER BY n), '|', string_agg(printf('%g',
        frame_time_s), '|' ORDER BY n), '|scene-caption-v2|qwen2.5-vl-7b-instruct|about ', scene_id))
        AS content_hash
    FROM p GROUP BY scene_id, file_id""",
)
def caption_inputs(t):
    captions = t.v_scenes.select(
        "scene_id", F.concat(F.lit(" about "), "scene_id", F.lit("\n")).alias("caption_text")
    )
    built = temporal.caption_inputs(temporal.scene_frames(t.v_assets), captions)
    return built.select(
        "scene_id", "file_id", "n_frames",
        F.array_join(F.transform("frame_times", fmt_g), ",").alias("frame_times"), "content_hash",
    )


APPLIED = """SELECT *, collection = 'image_vectors' AND asset_id % 5 = 0 AS is_zero,
        collection = 'image_vectors' AND asset_id % 5 = 1 AS is_long,
        collection <> 'caption_text_vectors' AND NOT (collection = 'image_vectors'
          AND asset_id % 5 <= 1) AS is_good FROM v_refs"""


@query(
    "apply_embeddings",
    f"""
    WITH r AS ({APPLIED})
    SELECT r.ref_id, CASE WHEN is_good AND r.status IN ('pending', 'indexed') THEN 'indexed'
        ELSE r.status END AS status, r.file_id,
      CASE WHEN NOT f.is_deleted AND r.file_id IN (SELECT file_id FROM r WHERE status =
        'indexed' OR (status = 'pending' AND is_good))
        THEN 'indexed' ELSE f.index_status END AS file_status
    FROM r JOIN v_files f ON f.file_id = r.file_id""",
)
def apply_embeddings(t):
    after = embeddings_applied(t)
    files = after["files"].select("file_id", F.col("index_status").alias("file_status"))
    return after["refs"].select("ref_id", "status", "file_id").join(files, "file_id")


@query(
    "embedding_points",
    f"""
    SELECT r.collection, r.point_id, 'point' AS kind, round(list_sum(list_transform(p.embedding,
        lambda x: CAST(x AS DOUBLE))), 4) AS total
    FROM ({APPLIED}) r JOIN v_points p USING (point_id, collection)
    WHERE is_good AND r.status IN ('pending', 'indexed')
    UNION ALL
    SELECT collection, point_id, CASE WHEN is_zero THEN 'zero_norm' WHEN is_long THEN 'not_unit'
      ELSE 'dimension' END, NULL FROM ({APPLIED}) WHERE NOT is_good""",
)
def embedding_points(t):
    """The points to write and the rejects with their problems."""
    after = embeddings_applied(t)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    points = after["points"].select(
        "collection", "point_id", F.lit("point").alias("kind"), F.round(total, 4).alias("total")
    )
    return points.unionByName(after["rejects"].select(
        "collection", "point_id", F.col("problem").alias("kind"), F.lit(None).cast("double").alias("total")
    ))


def embeddings_applied(t):
    """Two vectors for every ref, of which the later counts. Those of captions come short by one value,
    some of images are zero or too long."""
    vectors = t.v_refs.select("asset_id", "model_name", "model_version").join(
        t.v_points.select("asset_id", "collection", "embedding"), "asset_id"
    )
    image, fifth = F.col("collection") == "image_vectors", F.col("asset_id") % 5
    factor = F.when(image & (fifth == 0), 0.0).when(image & (fifth == 1), 2.0).otherwise(1.0)
    scaled = F.transform("embedding", lambda x: x.cast("double") * factor)
    cut = F.when(
        F.col("collection") == "caption_text_vectors", F.slice(scaled, 1, F.size("embedding") - 1)
    ).otherwise(scaled)
    later = vectors.select(
        "asset_id", "collection", "model_name", "model_version", cut.alias("vector"), F.lit(2).alias("batch_order")
    )
    earlier = later.withColumns({"vector": F.array(F.lit(1.0)), "batch_order": F.lit(1)})
    return snapshots.apply_embeddings(t.v_refs, later.unionByName(earlier), t.v_files)


@query(
    "embedding_job_rows",
    f"""
    SELECT ref_id, file_id, CASE collection WHEN 'image_vectors' THEN 'embed_image'
        WHEN 'video_frame_vectors' THEN 'embed_video_frame' ELSE 'embed_text_asset' END AS job_type,
      CASE WHEN collection = 'image_vectors' THEN coalesce(asset_path, file_path) END AS path,
      CASE WHEN collection = 'video_frame_vectors' THEN coalesce(asset_path, file_path) END
        AS frame_path,
      CASE WHEN collection = 'video_frame_vectors' THEN coalesce(frame_time_s, (start_s + end_s) / 2,
        0) END AS frame_time, collection
    FROM ({UNATTEMPTED})""",
)
def embedding_job_rows(t):
    pending = relations.pending_refs(t.v_refs, t.v_assets, t.v_files)
    rows = relations.embedding_job_rows(relations.unattempted(pending, t.v_jobs))
    get = lambda k: F.get_json_object("input_json", f"$.{k}")
    return rows.select(
        "ref_id", "file_id", "job_type", get("path").alias("path"),
        get("frame_path").alias("frame_path"),
        get("frame_time_seconds").cast("double").alias("frame_time"),
        get("collection").alias("collection"),
    )

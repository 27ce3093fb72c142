"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery.operators import hybrid, relations, snapshots, temporal, vector_search
from reelquery.operators.ordered import spread
from reelquery.plans import search
from reelquery.plans.registry import query

DEPTH = search.depth_for(20)


def catalogue(t) -> search.Catalogue:
    return search.Catalogue(
        points=t.v_points, refs=t.v_refs, assets=t.v_assets, files=t.v_files,
        libraries=t.v_libraries, scenes=t.v_scenes, chunks=t.v_chunks,
    )


def channel_hits(t):
    return search.channel_hits(catalogue(t), t.v_queries, DEPTH)


def hydrated(t):
    return search.hydrated_hits(catalogue(t), channel_hits(t))


def search_texts(t):
    """Text of each vector query: the two longest words of the benchmark item of that number."""
    return t.v_text_queries.join(
        t.v_queries.select((F.col("query_id") * 3 + 2).alias("query_id")).distinct(), "query_id",
        "left_semi",
    ).withColumn("query_id", ((F.col("query_id") - 2) / 3).cast("bigint"))


def channel_rows(t):
    text = search.text_hits(catalogue(t), search_texts(t), DEPTH)
    return search.channel_union(hydrated(t), text)


def candidates(t):
    return hybrid.as_candidates(channel_rows(t))


@query(
    "hydrate_points",
    """
    SELECT query_id, collection, point_id, asset_id, file_id, media_type, path, scene_id, start_s,
      end_s, reason, score, source_rank FROM v_hydrated""",
)
def hydrate_points(t):
    return hydrated(t).select(
        "query_id", "collection", "point_id", "asset_id", "file_id", "media_type", "path",
        "scene_id", "start_s", "end_s", "reason", "score", "source_rank",
    )


PENDING = """
    SELECT r.ref_id, r.asset_id, r.file_id, r.library_id, r.collection, r.model_name,
      r.model_version, r.created_at, r.updated_at, a.asset_type, a.path AS asset_path, a.start_s,
      a.end_s, a.frame_time_s, f.path AS file_path, f.media_type
    FROM v_refs r JOIN v_assets a ON a.asset_id = r.asset_id JOIN v_files f
      ON f.file_id = r.file_id
    WHERE r.status = 'pending' AND NOT f.is_deleted AND f.index_status <> 'purge_queued'"""


@query(
    "pending_refs",
    f"""
    SELECT ref_id, asset_id, collection, asset_type, media_type, file_path
    FROM ({PENDING}) ORDER BY created_at, ref_id LIMIT 100""",
)
def pending_refs(t):
    """The oldest hundred, as a dispatch batch takes them."""
    return relations.oldest(
        relations.pending_refs(t.v_refs, t.v_assets, t.v_files), 100
    ).select("ref_id", "asset_id", "collection", "asset_type", "media_type", "file_path")


ATTEMPTS = """
    SELECT json_extract_string(input_json, '$.asset_id') AS asset_id,
      json_extract_string(input_json, '$.collection') AS collection,
      json_extract_string(input_json, '$.model_name') AS model_name,
      json_extract_string(input_json, '$.model_version') AS model_version,
      max(created_at) AS last_attempt
    FROM v_jobs WHERE job_type IN ('embed_image', 'embed_video_frame', 'embed_text_asset')
      AND status IN ('queued', 'running', 'failed', 'succeeded') GROUP BY ALL"""
UNATTEMPTED = f"""
    SELECT p.* FROM ({PENDING}) p LEFT JOIN ({ATTEMPTS}) a
      ON CAST(p.asset_id AS VARCHAR) = a.asset_id AND p.collection = a.collection
      AND p.model_name = a.model_name AND p.model_version = a.model_version
    WHERE a.last_attempt IS NULL OR a.last_attempt < p.updated_at"""


@query("unattempted_refs", f"SELECT ref_id, asset_id, collection FROM ({UNATTEMPTED})")
def unattempted_refs(t):
    pending = relations.pending_refs(t.v_refs, t.v_assets, t.v_files)
    return relations.unattempted(pending, t.v_jobs).select("ref_id", "asset_id", "collection")


ACTIVE = """
    SELECT DISTINCT job_id, job_type, status, f AS ref_file_id FROM (
      SELECT job_id, job_type, status, CAST(file_id AS VARCHAR) AS f FROM v_jobs
      UNION ALL SELECT job_id, job_type, status, json_extract_string(input_json, '$.file_id')
      FROM v_jobs)
    WHERE job_type IN ('index_media', 'purge_video_index', 'embed_image', 'embed_video_frame',
        'embed_text_asset', 'generate_caption') AND status IN ('queued', 'running')"""


@query(
    "active_jobs_for_file",
    f"""SELECT * FROM ({ACTIVE}) WHERE ref_file_id IN
      (SELECT CAST(file_id AS VARCHAR) FROM v_files)""",
)
def active_jobs_for_file(t):
    return relations.active_jobs(t.v_jobs, t.v_files).select(
        "job_id", "job_type", "status", "ref_file_id"
    )


ADMISSION = f"""
    SELECT r.file_id, coalesce(b.n, 0) AS n_active, CASE WHEN f.file_id IS NULL THEN 'missing'
      WHEN b.n > 0 THEN 'conflict' ELSE 'admitted' END AS outcome
    FROM (SELECT DISTINCT c_custkey AS file_id FROM customer) r
    LEFT JOIN v_files f ON f.file_id = r.file_id AND NOT f.is_deleted
    LEFT JOIN (SELECT ref_file_id, count(*) AS n FROM ({ACTIVE}) GROUP BY ALL) b
      ON b.ref_file_id = CAST(r.file_id AS VARCHAR)"""


@query(
    "reindex_admission",
    f"""
    SELECT a.*, f.index_status AS old_status, CASE WHEN a.outcome = 'admitted'
      THEN 'purge_queued' ELSE f.index_status END AS new_status
    FROM ({ADMISSION}) a LEFT JOIN v_files f ON f.file_id = a.file_id""",
)
def reindex_admission(t):
    """One request per customer key; some name no file, some a busy one."""
    requests = t.customer.select(F.col("c_custkey").alias("file_id"))
    admission = relations.reindex_admission(requests, t.v_files, t.v_jobs)
    marked = relations.admit_reindex(admission, t.v_files)["files"].select(
        "file_id", F.col("index_status").alias("new_status")
    )
    before = t.v_files.select("file_id", F.col("index_status").alias("old_status"))
    return admission.join(before, "file_id", "left").join(marked, "file_id", "left")


PATHS = """
    SELECT job_id, array_to_string(list(path ORDER BY place), ',') AS file_paths
    FROM (SELECT job_id, path, min(place) AS place
      FROM (SELECT job_id, 0 AS place, json_extract_string(input_json, '$.path') AS path
          FROM v_jobs
        UNION ALL SELECT j.job_id, 10, f.path FROM v_jobs j JOIN v_files f
          ON CAST(f.file_id AS VARCHAR) = json_extract_string(j.input_json, '$.file_id')
        UNION ALL SELECT j.job_id, 20 + j.nth, f.path FROM (SELECT job_id, unnest(ids) AS ak,
            generate_subscripts(ids, 1) AS nth FROM (SELECT job_id,
              list_concat([json_extract_string(input_json, '$.asset_id')],
                CAST(json_extract(input_json, '$.asset_ids') AS VARCHAR[])) AS ids
            FROM v_jobs)) j
          JOIN v_assets a ON CAST(a.asset_id AS VARCHAR) = j.ak
          JOIN v_files f ON f.file_id = a.file_id)
      GROUP BY job_id, path) GROUP BY job_id"""


@query("job_file_paths", PATHS)
def job_file_paths(t):
    return relations.job_file_paths(spread(t.v_jobs.select("job_id", "input_json")), t.v_files, t.v_assets).select(
        "job_id", F.array_join("file_paths", ",").alias("file_paths")
    )


@query(
    "ref_for_embedding",
    f"""
    SELECT r.ref_id, r.collection, r.model_name, a.asset_type, f.media_type, a.scene_id
    FROM (SELECT DISTINCT asset_id, collection, model_name, model_version FROM ({ATTEMPTS})) q
    JOIN v_refs r ON CAST(r.asset_id AS VARCHAR) = q.asset_id AND r.collection = q.collection
      AND r.model_name = q.model_name AND r.model_version = q.model_version
    JOIN v_assets a ON a.asset_id = r.asset_id JOIN v_files f ON f.file_id = r.file_id""",
)
def ref_for_embedding(t):
    """Refs the embedding jobs ask for."""
    wanted = relations.last_attempts(t.v_jobs).withColumn(
        "asset_id", F.col("asset_id").cast("bigint")
    )
    return relations.refs_for_embedding(wanted, t.v_refs, t.v_assets, t.v_files).select(
        "ref_id", "collection", "model_name", "asset_type", "media_type", "scene_id"
    )


@query(
    "caption_source",
    """
    SELECT a.asset_id, a.file_id, f.library_id, f.media_type, coalesce(a.path, f.path) AS path
    FROM v_assets a JOIN v_files f ON f.file_id = a.file_id WHERE a.asset_type = 'image'""",
)
def caption_source(t):
    return relations.caption_sources(t.v_assets, t.v_files)


@query(
    "scene_with_file",
    """
    SELECT s.scene_id, s.file_id, s.scene_key, s.start_s, s.end_s, f.library_id, f.path
    FROM v_scenes s JOIN v_files f ON f.file_id = s.file_id""",
)
def scene_with_file(t):
    return relations.scenes_with_file(t.v_scenes, t.v_files).select(
        "scene_id", "file_id", "scene_key", "start_s", "end_s", "library_id", "path"
    )


@query(
    "scene_frames",
    """
    SELECT scene_id, asset_id, frame_time_s, row_number() OVER (PARTITION BY scene_id
      ORDER BY frame_time_s, asset_id) AS frame_no
    FROM v_assets WHERE asset_type = 'video_frame' AND scene_id IS NOT NULL
      AND coalesce(json_extract_string(metadata_json, '$.stale'), 'false') <> 'true'""",
)
def scene_frames(t):
    return temporal.scene_frames(t.v_assets).drop("file_id")


def _flat_items(graph, *keys):
    items = F.transform("items", lambda i: F.concat(i["id"], F.lit(":"), i["value"]))
    return graph.select(*keys, "kind", "page", F.array_join(items, ",").alias("items"))


@query(
    "file_graph",
    """
    SELECT f.file_id, g.kind, g.page, g.items FROM v_files f LEFT JOIN (
      SELECT file_id, 'asset' AS kind, page, array_to_string(list(concat(asset_id, ':',
        asset_type) ORDER BY asset_id), ',') AS items
      FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY file_id ORDER BY asset_id) - 1)
          / 1000) AS BIGINT) AS page FROM v_assets) GROUP BY ALL
      UNION ALL
      SELECT file_id, 'ref', page, array_to_string(list(concat(ref_id, ':', status)
        ORDER BY ref_id), ',')
      FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY file_id ORDER BY ref_id) - 1)
          / 1000) AS BIGINT) AS page FROM v_refs) GROUP BY ALL) g ON g.file_id = f.file_id""",
)
def file_graph(t):
    return _flat_items(relations.file_graph(t.v_files, t.v_assets, t.v_refs), "file_id")


@query(
    "media_detail",
    """
    SELECT f.file_id, f.media_type, f.index_status, coalesce(c.n, 0) AS assets_total,
      coalesce(s.ids, '') AS shown
    FROM v_files f
    LEFT JOIN (SELECT file_id, count(*) AS n FROM v_assets GROUP BY ALL) c
      ON c.file_id = f.file_id
    LEFT JOIN (SELECT file_id, array_to_string(list(asset_id ORDER BY created_seq,
        asset_id), ',') AS ids
      FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY created_seq, asset_id) AS n
        FROM v_assets WHERE coalesce(json_extract_string(metadata_json, '$.stale'), 'false')
          <> 'true') WHERE n <= 50 GROUP BY file_id) s ON s.file_id = f.file_id""",
)
def media_detail(t):
    assets = t.v_assets.withColumn("created_at", F.timestamp_seconds("created_seq"))
    shown = F.transform("assets", lambda a: a["asset_id"].cast("string"))
    return relations.media_detail(t.v_files, assets).select(
        "file_id", "media_type", "index_status", "assets_total",
        F.coalesce(F.array_join(shown, ","), F.lit("")).alias("shown"),
    )


@query(
    "indexed_backfill",
    """
    SELECT file_id, CASE WHEN NOT is_deleted AND file_id IN (SELECT file_id FROM v_refs
      WHERE status = 'indexed') THEN 'indexed' ELSE index_status END AS index_status
    FROM v_files""",
)
def indexed_backfill(t):
    return snapshots.indexed_backfill(t.v_files, t.v_refs).select("file_id", "index_status")


CAPTION_ASSETS = """
    SELECT l_orderkey * 10 + l_linenumber AS asset_id, l_orderkey AS file_id,
      CASE WHEN l_returnflag = 'R' THEN 'video_segment' ELSE 'caption' END AS asset_type,
      l_linenumber AS scene_id, CASE WHEN l_returnflag = 'N' THEN 'scene-caption-v2'
        ELSE 'caption-v1' END AS prompt_version, l_discount > 0.08 AS is_stale
    FROM lineitem"""


SUPERSEDED = f"""
    WITH a AS ({CAPTION_ASSETS})
    SELECT c.asset_id, c.file_id FROM a c
    WHERE c.asset_type = 'caption' AND c.prompt_version = 'caption-v1' AND NOT c.is_stale
      AND EXISTS (SELECT 1 FROM a s WHERE s.file_id = c.file_id AND s.asset_type = 'caption'
        AND s.prompt_version = 'scene-caption-v2' AND NOT s.is_stale)
      AND NOT EXISTS (SELECT 1 FROM a g WHERE g.file_id = c.file_id
        AND g.asset_type = 'video_segment' AND NOT g.is_stale AND NOT EXISTS (
          SELECT 1 FROM a s WHERE s.file_id = g.file_id AND s.asset_type = 'caption'
            AND s.prompt_version = 'scene-caption-v2' AND s.scene_id = g.scene_id
            AND NOT s.is_stale))
      AND c.file_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"""


@query("superseded_captions", SUPERSEDED)
def superseded_captions(t):
    return snapshots.superseded_captions(*caption_tables(t)).select("asset_id", "file_id")


@query(
    "superseded_effects",
    f"""
    WITH gone AS (SELECT DISTINCT asset_id FROM ({SUPERSEDED})),
    lines AS (SELECT l_orderkey * 10 + l_linenumber AS asset_id, l_linestatus FROM lineitem)
    SELECT 'asset' AS kind, asset_id, l_linestatus AS mode, CASE WHEN asset_id IN (SELECT asset_id
      FROM gone) THEN 'superseded_by_scene_caption_v2' END AS outcome FROM lines
    UNION ALL
    SELECT 'ref', asset_id, NULL, CASE WHEN asset_id IN (SELECT asset_id FROM gone) THEN 'stale'
      ELSE 'indexed' END FROM lines""",
)
def superseded_effects(t):
    """Every line item's asset and ref after the superseded captions went stale."""
    files, assets = caption_tables(t)
    stored = assets.withColumn("metadata_json", F.to_json(F.struct("mode")))
    refs = assets.select("asset_id", F.lit("indexed").alias("status"))
    after = snapshots.mark_superseded(snapshots.superseded_captions(files, assets), stored, refs)
    get = lambda k: F.get_json_object("metadata_json", f"$.{k}")
    return after["assets"].select(
        F.lit("asset").alias("kind"), "asset_id", get("mode").alias("mode"),
        get("stale_reason").alias("outcome"),
    ).unionByName(after["refs"].select(
        F.lit("ref").alias("kind"), "asset_id", F.lit(None).cast("string").alias("mode"),
        F.col("status").alias("outcome"),
    ))


def caption_tables(t):
    """Line items as segments and captions of their order's video."""
    flag = F.col("l_returnflag")
    assets = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("asset_id"),
        F.col("l_orderkey").alias("file_id"),
        F.when(flag == "R", "video_segment").otherwise("caption").alias("asset_type"),
        F.col("l_linenumber").alias("scene_id"),
        F.when(flag == "N", "scene-caption-v2").otherwise("caption-v1").alias("prompt_version"),
        (F.col("l_discount") > 0.08).alias("is_stale"), F.col("l_linestatus").alias("mode"),
    )
    files = t.orders.select(
        F.col("o_orderkey").alias("file_id"),
        F.when(F.col("o_orderstatus") == "P", "image").otherwise("video").alias("media_type"),
    )
    return files, assets


@query(
    "agent_run_report",
    """
    SELECT r.run_id, r.status, g.kind, g.page, g.items FROM v_runs r LEFT JOIN (
      SELECT run_id, 'event' AS kind, page, array_to_string(list(concat(event_id, ':',
        event_type) ORDER BY created_at, event_id), ',') AS items
      FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY run_id ORDER BY created_at,
          event_id) - 1) / 1000) AS BIGINT) AS page FROM v_run_events) GROUP BY ALL
      UNION ALL
      SELECT run_id, 'call', page, array_to_string(list(concat(tool_call_id, ':', tool_name)
        ORDER BY created_at, tool_call_id), ',')
      FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY run_id ORDER BY created_at,
          tool_call_id) - 1) / 1000) AS BIGINT) AS page FROM v_tool_calls) GROUP BY ALL) g
      ON g.run_id = r.run_id""",
)
def agent_run_report(t):
    report = relations.agent_run_report(t.v_runs, t.v_run_events, t.v_tool_calls)
    return _flat_items(report, "run_id", "status")


@query(
    "window_overlap_join",
    """
    SELECT s.scene_id, c.asset_id, greatest(s.start_s, c.start_s) AS overlap_start,
      least(s.end_s, c.end_s) AS overlap_end
    FROM v_scenes s JOIN v_chunks c ON c.file_id = s.file_id
      AND greatest(s.start_s, c.start_s) < least(s.end_s, c.end_s)""",
)
def window_overlap_join(t):
    pairs = relations.window_overlaps(t.v_scenes, t.v_chunks, 8.0, "scene_id", "asset_id")
    return pairs.select(
        F.col("left_id").alias("scene_id"), F.col("right_id").alias("asset_id"),
        F.greatest("left_start", "right_start").alias("overlap_start"),
        F.least("left_end", "right_end").alias("overlap_end"),
    )


@query(
    "vector_cross_score",
    """
    SELECT query_id, variant_order, p.collection, count(*) AS n_points, round(avg(s), 6)
      AS mean_score, round(min(s), 6) AS min_score, round(max(s), 6) AS max_score
    FROM (SELECT q.query_id, q.variant_order, p.collection,
        list_dot_product(CAST(p.embedding AS DOUBLE[]), q.query_embedding) AS s
      FROM v_points p CROSS JOIN v_queries q) p GROUP BY ALL""",
)
def vector_cross_score(t):
    return vector_search.score_summary(t.v_points, t.v_queries)

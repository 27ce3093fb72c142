"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.functions.identifiers import uuid5
from reelquery.operators import hybrid, hydration, quality, relations
from reelquery.plans.registry import query


@query(
    "active_rows",
    "SELECT library_id, count(*) AS n FROM v_files WHERE NOT is_deleted GROUP BY library_id",
)
def active_rows(t):
    stamped = t.v_files.withColumn(
        "deleted_at", F.when(F.col("is_deleted"), F.timestamp_millis("mtime_ms"))
    )
    return hydration.active(stamped).groupBy("library_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "library_filter",
    """
    SELECT file_id, library_id FROM v_files WHERE library_id IN
      (SELECT library_id FROM v_libraries WHERE is_deleted)
    UNION ALL SELECT file_id, library_id FROM v_files WHERE library_id IN ('src1', 'src2')
    UNION ALL SELECT file_id, library_id FROM v_files""",
)
def library_filter(t):
    """By a table of ids, by a literal list, and with no list at all."""
    files = t.v_files.select("file_id", "library_id")
    wanted = t.v_libraries.filter("is_deleted")
    parts = [
        hydration.only_in(files, "library_id", allowed)
        for allowed in (wanted, ["src1", "src2"], [])
    ]
    return parts[0].select("file_id", "library_id").unionByName(parts[1]).unionByName(parts[2])


@query(
    "media_type_filter",
    """SELECT file_id, media_type FROM v_files WHERE media_type IN ('video', 'audio')""",
)
def media_type_filter(t):
    return hydration.only_in(t.v_files, "media_type", ["video", "audio"]).select(
        "file_id", "media_type"
    )


ALL_FACTS = """
    SELECT p.point_id, p.collection, r.status AS ref_status, a.asset_type, a.scene_id,
      a.metadata_json, f.media_type, f.index_generation, f.is_deleted AS file_deleted,
      l.is_deleted AS library_deleted, s.index_generation AS scene_generation
    FROM v_points p JOIN v_refs r ON r.collection = p.collection AND r.point_id = p.point_id
    JOIN v_assets a ON a.asset_id = r.asset_id JOIN v_files f ON f.file_id = r.file_id
    JOIN v_libraries l ON l.library_id = r.library_id
    LEFT JOIN v_scenes s ON s.scene_id = a.scene_id"""
STALE = "coalesce(json_extract_string(metadata_json, '$.stale'), 'false') = 'true'"
PROMPT = "coalesce(json_extract_string(metadata_json, '$.prompt_version'), '')"
OLD_GENERATION = """media_type = 'video' AND scene_id IS NOT NULL
    AND scene_generation IS DISTINCT FROM index_generation"""
OLD_CAPTION = f"""media_type = 'video' AND asset_type = 'caption'
    AND {PROMPT} <> 'scene-caption-v2'"""


def _stamped_assets(t):
    return t.v_assets.withColumn("created_at", F.timestamp_seconds("created_seq"))


def _all_facts(t):
    points = t.v_points.select("collection", "point_id")
    return hydration.joined_facts(
        points, t.v_refs, t.v_assets, t.v_files, t.v_libraries, t.v_scenes
    )


@query(
    "hydration_guards",
    f"""
    SELECT collection, point_id, media_type FROM ({ALL_FACTS})
    WHERE ref_status = 'indexed' AND NOT file_deleted AND NOT library_deleted AND NOT ({STALE})
      AND NOT (media_type = 'video' AND scene_id IS NULL) AND NOT ({OLD_GENERATION})
      AND NOT ({OLD_CAPTION})""",
)
def hydration_guards(t):
    return _all_facts(t).filter(hydration.passes_guards()).select(
        "collection", "point_id", "media_type"
    )


@query(
    "guard_reject_counts",
    f"""
    SELECT collection, count(*) AS n_rows,
      count(*) FILTER (ref_status <> 'indexed') AS not_indexed,
      count(*) FILTER ({STALE}) AS stale,
      count(*) FILTER (media_type = 'video' AND scene_id IS NULL) AS no_scene,
      count(*) FILTER ({OLD_GENERATION}) AS old_generation,
      count(*) FILTER ({OLD_CAPTION}) AS old_caption,
      count(*) FILTER (file_deleted) AS deleted_file,
      count(*) FILTER (library_deleted) AS deleted_library
    FROM ({ALL_FACTS}) GROUP BY collection""",
)
def guard_reject_counts(t):
    return hydration.guard_reject_counts(_all_facts(t))


@query("stale_flag", f"SELECT asset_id, {STALE} AS stale FROM v_assets")
def stale_flag(t):
    return t.v_assets.select("asset_id", hydration.is_stale(F.col("metadata_json")).alias("stale"))


@query(
    "path_ilike",
    "SELECT file_id, relative_path FROM v_files WHERE relative_path ILIKE '%Doc-_1%'",
)
def path_ilike(t):
    return hydration.path_contains(t.v_files, "Doc-_1").select("file_id", "relative_path")


@query(
    "text_chunk_filter",
    """
    SELECT a.asset_id, f.media_type, 'transcript_match' AS reason
    FROM v_assets a JOIN v_files f ON f.file_id = a.file_id
    WHERE a.asset_type = 'text_chunk' AND f.media_type IN ('audio', 'video')""",
)
def text_chunk_filter(t):
    chunks = t.v_assets.filter(F.col("asset_type") == "text_chunk")
    speech = hydration.only_in(t.v_files, "media_type", ["audio", "video"])
    return chunks.join(speech.select("file_id", "media_type"), "file_id").select(
        "asset_id", "media_type", F.lit("transcript_match").alias("reason")
    )


@query(
    "collection_pruning",
    """
    SELECT query_id, collection FROM (
      SELECT doc_id AS query_id, CASE lang WHEN 'en' THEN NULL WHEN 'de' THEN 'image'
        WHEN 'es' THEN 'video' ELSE 'audio' END AS media_type FROM documents) r
    JOIN (VALUES ('image_vectors', 'image'), ('video_frame_vectors', 'video'),
        ('caption_text_vectors', 'image'), ('caption_text_vectors', 'video')) c(collection, serves)
      ON r.media_type IS NULL OR r.media_type = c.serves
    GROUP BY query_id, collection""",
)
def collection_pruning(t):
    """One request per document, asking for the types its language stands for."""
    lang = F.col("lang")
    wanted = (
        F.when(lang == "en", F.array().cast("array<string>"))
        .when(lang == "de", F.array(F.lit("image")))
        .when(lang == "es", F.array(F.lit("video")))
        .otherwise(F.array(F.lit("audio")))
    )
    return hydration.selected_channels(
        t.documents.select(F.col("doc_id").alias("query_id"), wanted.alias("media_types"))
    )


@query(
    "play_window",
    """
    SELECT a.asset_id,
      CASE WHEN f.media_type = 'video' AND a.scene_id IS NOT NULL THEN s.start_s
        ELSE coalesce(a.start_s, a.frame_time_s) END AS start_s,
      CASE WHEN f.media_type = 'video' AND a.scene_id IS NOT NULL THEN s.end_s
        ELSE coalesce(a.end_s, a.frame_time_s) END AS end_s
    FROM v_assets a JOIN v_files f ON f.file_id = a.file_id
    LEFT JOIN v_scenes s ON s.scene_id = a.scene_id""",
)
def play_window(t):
    assets = t.v_assets.withColumnsRenamed({"start_s": "asset_start", "end_s": "asset_end"})
    scenes = t.v_scenes.select(
        "scene_id", F.col("start_s").alias("scene_start"), F.col("end_s").alias("scene_end")
    )
    joined = assets.join(t.v_files.select("file_id", "media_type"), "file_id").join(
        scenes, "scene_id", "left"
    )
    return hydration.play_window(joined).select("asset_id", "start_s", "end_s")


@query(
    "frame_time_fallback",
    """
    SELECT asset_id, coalesce(frame_time_s, (start_s + end_s) / 2, 0) AS frame_time
    FROM v_assets""",
)
def frame_time_fallback(t):
    value = hydration.frame_time(F.col("frame_time_s"), F.col("start_s"), F.col("end_s"))
    return t.v_assets.select("asset_id", value.alias("frame_time"))


@query(
    "redact_columns",
    f"""
    SELECT f.file_id, f.library_id, f.media_type, count(a.asset_id) AS n_assets,
      least(50, count(a.asset_id) FILTER (NOT ({STALE}))) AS n_redacted
    FROM v_files f LEFT JOIN v_assets a ON a.file_id = f.file_id GROUP BY ALL""",
)
def redact_columns(t):
    """Path dropped from the file, cache path and text from its shown assets."""
    detail = relations.media_detail(t.v_files, _stamped_assets(t))
    safe = hydration.redact_nested(
        hydration.redacted(detail, ["path", "relative_path"]), "assets",
        ["cache_path", "text_content"],
    )
    bare = F.filter(
        "assets", lambda a: ~F.to_json(a).rlike("cache_path|text_content")
    )
    return safe.select(
        "file_id", "library_id", "media_type", F.col("assets_total").alias("n_assets"),
        F.coalesce(F.size(bare), F.lit(0)).cast("bigint").alias("n_redacted"),
    )


@query(
    "window_validity",
    """
    SELECT o_orderkey AS asset_id, o_custkey AS file_id FROM orders
    WHERE o_orderstatus <> 'F' AND o_totalprice / 1000 < o_orderkey % 100""",
)
def window_validity(t):
    """Audit form: windows from order keys to prices, some of them reversed."""
    windows = t.orders.select(
        F.col("o_orderkey").alias("asset_id"), F.col("o_custkey").alias("file_id"),
        F.when(F.col("o_orderstatus") == "F", "image").otherwise("video").alias("media_type"),
        (F.col("o_orderkey") % 100).cast("double").alias("start_s"),
        (F.col("o_totalprice") / 1000).alias("end_s"),
    )
    return hybrid.invalid_windows(windows).select("asset_id", "file_id")


@query(
    "clip_range_check",
    """
    SELECT request_id, concat_ws(',', CASE WHEN NOT end_s > start_s THEN 'end_not_after_start' END,
        CASE WHEN start_s < 0 THEN 'negative_start' END,
        CASE WHEN output_format NOT IN ('mp4', 'mov') THEN 'bad_format' END,
        CASE WHEN f.media_type IS NULL THEN 'missing_file' END,
        CASE WHEN f.media_type <> 'video' THEN 'not_video' END) AS problems
    FROM (SELECT o_orderkey AS request_id, o_custkey AS file_id, o_totalprice / 1000 - 50 AS start_s,
        CAST(o_orderkey % 300 AS DOUBLE) AS end_s,
        CASE o_orderstatus WHEN 'F' THEN 'mov' WHEN 'P' THEN 'mkv' ELSE 'mp4' END AS output_format
      FROM orders) r LEFT JOIN v_files f ON f.file_id = r.file_id AND NOT f.is_deleted""",
)
def clip_range_check(t):
    status = F.col("o_orderstatus")
    requests = t.orders.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("file_id"),
        (F.col("o_totalprice") / 1000 - 50).alias("start_s"),
        (F.col("o_orderkey") % 300).cast("double").alias("end_s"),
        F.when(status == "F", "mov").when(status == "P", "mkv").alias("output_format"),
    )
    return quality.clip_range_check(requests, t.v_files).select(
        "request_id", F.array_join("problems", ",").alias("problems")
    )


@query(
    "job_payload_check",
    """
    SELECT job_id, CASE job_type
        WHEN 'index_media' THEN 'file_id,index_profile'
        WHEN 'embed_image' THEN 'asset_id,collection'
        WHEN 'embed_video_frame' THEN 'asset_id,frame_path'
        ELSE 'file_id' END AS problems FROM v_jobs
    UNION ALL
    SELECT -1 - file_id, '' FROM v_files WHERE media_type IN ('image', 'video')
    UNION ALL
    SELECT -1 - file_id, 'model' FROM v_files WHERE media_type = 'audio'
    UNION ALL
    SELECT -1 - file_id, 'job_type' FROM v_files WHERE media_type = 'document'
    UNION ALL
    SELECT -1000000000 - file_id, CASE file_id % 5 WHEN 0 THEN '' WHEN 3 THEN 'model_name'
      ELSE 'source_asset_ids' END FROM v_files""",
)
def job_payload_check(t):
    """The event log's payloads (ids are no UUIDs), well-formed ones built from the files, and caption
    jobs whose lists are right, empty, of numbers or null, or whose model is a number."""
    media = F.col("media_type")
    built = t.v_files.select(
        (-1 - F.col("file_id")).alias("job_id"),
        F.when(media == "image", "index_media").when(media == "video", "probe_media")
        .when(media == "audio", "transcribe_audio").otherwise("copy_file").alias("job_type"),
        F.to_json(
            F.struct(
                uuid5(F.col("path")).alias("file_id"), F.lit("balanced").alias("index_profile"),
                "path", "media_type", F.when(media == "audio", "").alias("model"),
            )
        ).alias("input_json"),
    )
    fifth, own = F.col("file_id") % 5, uuid5(F.col("path"))
    listed = F.when(fifth == 1, "[]").when(fifth == 2, "[5]").when(fifth == 4, "null").otherwise(
        F.concat(F.lit('["'), own, F.lit('"]'))
    )
    captions = t.v_files.select(
        (-1000000000 - F.col("file_id")).alias("job_id"), F.lit("generate_caption").alias("job_type"),
        F.concat(
            F.lit('{"file_id":"'), own, F.lit('","source_asset_ids":'), listed,
            F.when(fifth == 3, ',"model_name":5}').otherwise("}"),
        ).alias("input_json"),
    )
    jobs = t.v_jobs.select("job_id", "job_type", "input_json").unionByName(built).unionByName(captions)
    return quality.job_payload_check(jobs).select(
        "job_id", F.array_join(F.array_sort("problems"), ",").alias("problems")
    )


@query(
    "strict_json_check",
    """
    SELECT doc_id, CASE WHEN kind = 1 THEN 'wrong_keys' WHEN kind = 2 THEN 'relevance'
        WHEN kind = 3 THEN 'matched_constraints' WHEN kind = 4 THEN 'not_an_object'
        WHEN kind = 5 THEN 'reason' ELSE '' END AS problems
    FROM (SELECT doc_id, n_chars % 6 AS kind FROM documents)""",
)
def strict_json_check(t):
    """A response per document; the text length decides what is wrong with it."""
    kind = F.col("n_chars") % 6
    body = F.struct(
        F.when(kind == 2, 3).otherwise(F.col("n_chars") % 3).cast("int").alias("relevance"),
        F.when(kind == 3, F.array(F.lit("ok"), F.lit(" "))).otherwise(F.array("source")).alias(
            "matched_constraints"
        ),
        F.array().cast("array<string>").alias("missing_constraints"),
        F.when(kind == 5, " ").otherwise(F.concat(F.lit('lang "'), "lang", F.lit('"'))).alias(
            "reason"
        ),
    )
    extra = F.struct(*[body[c].alias(c) for c in C.STRICT_RESPONSE_KEYS], F.lit(1).alias("extra"))
    text = (
        F.when(kind == 1, F.to_json(extra))
        .when(kind == 4, F.concat(F.lit("```"), F.to_json(body), F.lit("```")))
        .otherwise(F.to_json(body))
    )
    responses = t.documents.select("doc_id", text.alias("response_json"))
    return quality.strict_response_check(responses).select(
        "doc_id", F.array_join("problems", ",").alias("problems")
    )


@query(
    "vector_quality_check",
    """
    SELECT point_id, collection, concat_ws(',',
        CASE WHEN collection = 'caption_text_vectors' THEN 'dimension' END,
        CASE WHEN n = 0 THEN 'zero_norm' END,
        CASE WHEN n > 0 AND abs(n - 1) > 0.001 THEN 'not_unit' END) AS problems
    FROM (SELECT point_id, collection, sqrt(list_dot_product(v, v)) AS n
      FROM (SELECT point_id, collection, list_transform(embedding, lambda x:
        CAST(x AS DOUBLE) * (label - 1)) AS v FROM v_points))""",
)
def vector_quality_check(t):
    """Vectors scaled by their label minus one (label 1 gives zero vectors), one collection
    registered with another dimension."""
    scaled = t.v_points.withColumn(
        "embedding", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") - 1))
    )
    dims = {"image_vectors": 64, "video_frame_vectors": 64, "caption_text_vectors": 32}
    return quality.vector_quality(scaled, dims).select(
        "point_id", "collection", F.array_join("problems", ",").alias("problems")
    )


@query(
    "model_identity_check",
    """
    SELECT ref_id, concat_ws(',', CASE WHEN collection = 'caption_text_vectors' THEN 'model_name'
      END, CASE WHEN collection = 'image_vectors' THEN 'vector_dim' END) AS problems FROM v_refs""",
)
def model_identity_check(t):
    registry = {
        "image_vectors": ("siglip", "v1", 768), "video_frame_vectors": ("siglip", "v1", 64),
        "caption_text_vectors": ("siglip", "v1", 64),
    }
    return quality.model_identity(t.v_refs, registry).select(
        "ref_id", F.array_join("problems", ",").alias("problems")
    )


@query(
    "point_lookup",
    """
    SELECT f.file_id, f.path, f.media_type FROM v_files f
    WHERE NOT is_deleted AND file_id IN (SELECT file_id FROM v_jobs)""",
)
def point_lookup(t):
    """Active files for a table of ids (those the job log names)."""
    return relations.point_lookup(t.v_jobs.select("file_id"), t.v_files, "file_id").select(
        "file_id", "path", "media_type"
    )


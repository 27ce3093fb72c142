"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.functions import media
from reelquery.operators import snapshots
from reelquery.plans.registry import query
from reelquery.session import shared_folder
from reelquery.sources import files as listings
from reelquery.sources import tables


def _listed(extensions: list[str]) -> str:
    return ",".join(f"'{e}'" for e in extensions)


IMAGE, VIDEO = _listed(C.IMAGE_EXTENSIONS), _listed(C.VIDEO_EXTENSIONS)
AUDIO, DOCUMENT = _listed(C.AUDIO_EXTENSIONS), _listed(C.DOCUMENT_EXTENSIONS)


#: The text writer puts every document on a line of its own, in a folder per language.
LISTED = """
    SELECT lang, 'document' AS media_type,
      CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size_bytes
    FROM documents GROUP BY lang"""


@query("scan_files", LISTED)
def scan_files(t) -> DataFrame:
    """Files written from the documents, then listed: one row per language folder."""
    root = f"{shared_folder(t.spark)}/listing"
    t.documents.select("lang", "text").write.mode("overwrite").partitionBy("lang").text(root)
    found = listings.scan_files(t.spark, root, "documents")
    folder = F.regexp_extract("relative_path", r"^lang=([^/]+)/", 1)
    return found.groupBy(folder.alias("lang"), "media_type").agg(
        F.sum("size_bytes").alias("size_bytes")
    )


@query(
    "media_type_of_path",
    f"""
    SELECT path, CASE WHEN ext IN ({IMAGE}) THEN 'image' WHEN ext IN ({VIDEO}) THEN 'video'
        WHEN ext IN ({AUDIO}) THEN 'audio' WHEN ext IN ({DOCUMENT}) THEN 'document' END
        AS media_type
    FROM (SELECT path, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS ext
      FROM (SELECT path FROM v_files UNION ALL SELECT url FROM pages))""",
)
def media_type_of_path(t):
    paths = t.v_files.select("path").unionByName(t.pages.select(F.col("url").alias("path")))
    return paths.withColumn("media_type", media.media_type_of(F.col("path")))


@query(
    "content_type_of_path",
    """
    SELECT path, coalesce(CASE lower(string_split(path, '.')[-1])
        WHEN 'jpg' THEN 'image/jpeg' WHEN 'mp4' THEN 'video/mp4' WHEN 'wav' THEN 'audio/wav' END,
      CASE media_type WHEN 'image' THEN 'image/jpeg' WHEN 'video' THEN 'video/mp4'
        WHEN 'audio' THEN 'audio/mpeg' END, 'application/octet-stream') AS content_type
    FROM (SELECT path, media_type FROM v_files UNION ALL SELECT url, 'unknown' FROM pages)""",
)
def content_type_of_path(t):
    paths = t.v_files.select("path", "media_type").unionByName(
        t.pages.select(F.col("url").alias("path"), F.lit("unknown").alias("media_type"))
    )
    return paths.select(
        "path", media.content_type_of(F.col("path"), F.col("media_type")).alias("content_type")
    )


@query(
    "relative_path",
    """
    SELECT f.file_id, substr(f.path, length(l.root_path) + 2) AS relative
    FROM v_files f JOIN v_libraries l ON f.library_id = l.library_id""",
)
def relative_path(t):
    joined = t.v_files.join(t.v_libraries.select("library_id", "root_path"), "library_id")
    return joined.select(
        "file_id", media.relative_to(F.col("path"), F.col("root_path")).alias("relative")
    )


def _listing(t):
    return t.v_files.select("library_id", "path", "media_type", "size_bytes", "mtime_ms")


DIFF = """
    SELECT c.library_id, c.path, c.media_type, p.file_id AS known_file_id,
      CASE WHEN p.file_id IS NULL THEN 'created' WHEN p.size_bytes = c.size_bytes
        AND p.mtime_ms = c.mtime_ms THEN 'skipped' ELSE 'updated' END AS outcome,
      CASE WHEN p.size_bytes = c.size_bytes AND p.mtime_ms = c.mtime_ms THEN p.index_status
        ELSE 'pending' END AS index_status
    FROM v_files c LEFT JOIN v_previous p ON p.library_id = c.library_id AND p.path = c.path"""


@query("file_snapshot_diff", DIFF)
def file_snapshot_diff(t):
    return snapshots.file_snapshot_diff(t.v_previous, _listing(t)).select(
        "library_id", "path", "media_type", "known_file_id", "outcome", "index_status"
    )


@query(
    "scan_summary",
    f"""
    SELECT library_id, count(*) AS discovered, count(*) FILTER (outcome = 'created') AS created,
      count(*) FILTER (outcome = 'updated') AS updated,
      count(*) FILTER (outcome = 'skipped') AS skipped,
      count(*) FILTER (outcome <> 'skipped') AS probe_jobs
    FROM ({DIFF}) GROUP BY library_id""",
)
def scan_summary(t):
    diff = snapshots.file_snapshot_diff(t.v_previous, _listing(t))
    jobs = snapshots.probe_job_rows(diff).groupBy("library_id").agg(
        F.count(F.lit(1)).alias("probe_jobs")
    )
    return snapshots.scan_summary(diff).join(jobs, "library_id", "left").fillna(
        0, subset=["probe_jobs"]
    )


@query(
    "table_read_write",
    """
    SELECT CAST(file_id AS VARCHAR) AS file_id, library_id, media_type, size_bytes,
      duration_seconds, index_generation FROM v_files""",
)
def table_read_write(t):
    """Files written twice as typed Parquet (the second write replaces the first), read back."""
    root = f"{shared_folder(t.spark)}/facts"
    for _ in range(2):
        tables.write_table(t.v_files, root, "media_files", files_per_partition=2)
    return tables.read_table(t.spark, root, "media_files").select(
        "file_id", "library_id", "media_type", "size_bytes", "duration_seconds", "index_generation"
    )


@query(
    "table_read",
    """
    SELECT CAST(job_id AS VARCHAR) AS job_id, job_type, status, priority, timeout_seconds,
      CAST(created_at AS DATE) AS created_date FROM v_jobs""",
)
def table_read(t):
    """The job log, partitioned by day, read with its declared schema."""
    root = f"{shared_folder(t.spark)}/facts"
    tables.write_table(t.v_jobs, root, "jobs")
    return tables.read_table(t.spark, root, "jobs").select(
        "job_id", "job_type", "status", "priority", "timeout_seconds", "created_date"
    )


@query(
    "table_write",
    """
    SELECT CAST(file_id AS VARCHAR) AS file_id, library_id, CASE WHEN library_id IN (SELECT
      library_id FROM v_libraries WHERE is_deleted) THEN 0 ELSE size_bytes END AS size_bytes
    FROM v_files""",
)
def table_write(t):
    """All files, then the deleted libraries again with no size: other partitions stay."""
    root = f"{shared_folder(t.spark)}/facts"
    tables.write_table(t.v_files, root, "media_files")
    gone = t.v_files.join(t.v_libraries.filter("is_deleted"), "library_id", "left_semi")
    tables.write_table(gone.withColumn("size_bytes", F.lit(0)), root, "media_files")
    return tables.read_table(t.spark, root, "media_files").select(
        "file_id", "library_id", "size_bytes"
    )


@query(
    "vector_point_write",
    """
    SELECT r.collection, r.point_id, len(p.embedding) AS dims, r.library_id, f.media_type,
      a.asset_type, a.scene_id, a.start_s AS start_time_seconds,
      a.frame_time_s AS frame_time_seconds,
      json_extract_string(a.metadata_json, '$.source') AS source,
      json_extract_string(a.metadata_json, '$.prompt_version') AS prompt_version, r.model_name,
      r.content_hash, 1 AS batch
    FROM v_refs r JOIN v_points p ON p.point_id = r.point_id AND p.collection = r.collection
    JOIN v_assets a ON a.asset_id = r.asset_id JOIN v_files f ON f.file_id = r.file_id""",
)
def vector_point_write(t):
    """Every point arrives in two batches; the later one is written."""
    one = t.v_points.select("collection", "point_id", "embedding")
    both = [
        one.select(
            "collection", "point_id",
            F.concat(F.col("embedding"), F.array(F.lit(b).cast("float"))).alias("vector"),
            F.lit(b).alias("batch_order"),
        )
        for b in (0, 1)
    ]
    points = snapshots.vector_points(
        t.v_refs, t.v_assets, t.v_files, both[0].unionByName(both[1])
    )
    fields = [
        "library_id", "media_type", "asset_type", "scene_id", "start_time_seconds",
        "frame_time_seconds", "source", "prompt_version", "model_name", "content_hash",
    ]
    return points.select(
        "collection", "point_id", (F.size("vector") - 1).cast("bigint").alias("dims"),
        *[f"payload.{f}" for f in fields],
        F.element_at("vector", -1).cast("int").alias("batch"),
    )


@query(
    "job_seed_rows",
    """
    SELECT file_id, 'index_media' AS job_type, NULL AS timeout_seconds,
      concat('{"file_id":"', file_id, '","index_profile":"balanced"}') AS input_json
    FROM v_files WHERE media_type IN ('image', 'video')
    UNION ALL
    SELECT file_id, 'transcribe_audio', 14400,
      concat('{"file_id":"', file_id, '","path":"', path, '","media_type":"', media_type,
        '","model":"base","language":"auto"}')
    FROM v_files WHERE media_type IN ('video', 'audio')""",
)
def job_seed_rows(t):
    return snapshots.probed_job_rows(t.v_files)


MODEL_JSON = f"""'","model_name":"{C.CAPTION_VLM[0]}","model_version":"{C.CAPTION_VLM[1]}"}}'"""


@query(
    "caption_job_rows",
    f"""
    SELECT 'generate_caption' AS job_type, 7200 AS timeout_seconds, file_id,
      'caption-v1' AS prompt_version, CAST(asset_id AS VARCHAR) AS source_asset_id,
      NULL AS scene_id, concat('{{"file_id":"', file_id, '","prompt_version":"caption-v1",',
        '"source_asset_ids":["', asset_id, '"],"model_name":"{C.CAPTION_VLM[0]}",',
        '"model_version":"{C.CAPTION_VLM[1]}"}}') AS input_json
    FROM v_assets WHERE asset_type = 'image'
    UNION ALL
    SELECT 'generate_caption', 7200, file_id, 'scene-caption-v2', NULL, scene_id,
      concat('{{"file_id":"', file_id, '","prompt_version":"scene-caption-v2","scene_id":"',
        scene_id, {MODEL_JSON}) FROM v_scenes""",
)
def caption_job_rows(t):
    images = t.v_assets.filter(F.col("asset_type") == "image")
    return snapshots.caption_job_rows(images, t.v_scenes).drop("model_name", "model_version")

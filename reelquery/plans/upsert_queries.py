"""Set operations, merges and new snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.operators import hybrid, snapshots
from reelquery.plans.join_queries import channel_rows
from reelquery.plans.registry import query


@query(
    "candidate_union",
    """
    SELECT query_id, input_order, asset_id, file_id, scene_id, start_s, end_s, source, score, reason
    FROM v_candidates""",
)
def candidate_union(t):
    rows = hybrid.as_candidates(channel_rows(t))
    return rows.select(
        "query_id", "input_order", "asset_id", "file_id", "scene_id", "start_s", "end_s",
        F.explode("source_scores").alias("source", "score"),
        F.element_at("reasons", 1).alias("reason"),
    )


@query(
    "page_union_last_wins",
    """
    SELECT file_id, max(batch) AS batch, arg_max(size, batch) AS size FROM (
      SELECT file_id, 0 AS batch, size_bytes AS size FROM v_files
      UNION ALL SELECT file_id, 1, size_bytes + 1 FROM v_files WHERE media_type = 'video'
      UNION ALL SELECT file_id, 2, size_bytes + 2 FROM v_files WHERE index_status = 'failed')
    GROUP BY file_id""",
)
def page_union_last_wins(t):
    page = lambda batch, rows: rows.select(
        "file_id", F.lit(batch).alias("batch"), (F.col("size_bytes") + batch).alias("size")
    )
    pages = (
        page(0, t.v_files)
        .unionByName(page(1, t.v_files.filter(F.col("media_type") == "video")))
        .unionByName(page(2, t.v_files.filter(F.col("index_status") == "failed")))
    )
    return snapshots.page_union_last_wins(pages, "file_id", "batch")


@query(
    "asset_upsert",
    """
    WITH old AS (SELECT * FROM v_assets WHERE asset_type <> 'caption'),
    new AS (SELECT *, CASE WHEN asset_type = 'text_chunk' THEN NULL
        ELSE concat('text ', asset_id) END AS new_text FROM v_assets
      WHERE asset_type <> 'video_frame'),
    ident AS (SELECT file_id, asset_type, coalesce(path, '') AS p, coalesce(start_s, -1) AS s,
        coalesce(end_s, -1) AS e, coalesce(frame_time_s, -1) AS f, min(asset_id) AS first_id,
        arg_max(new_text, asset_id) AS new_text, max(asset_id) AS last_id FROM new GROUP BY ALL)
    SELECT coalesce(o.asset_id, n.first_id) AS asset_id, coalesce(o.file_id, n.file_id) AS file_id,
      coalesce(o.asset_type, n.asset_type) AS asset_type,
      coalesce(n.new_text, o.text_content) AS text_content,
      CASE WHEN o.asset_id IS NULL THEN 'created' WHEN n.last_id IS NULL THEN 'kept'
        ELSE 'updated' END AS outcome,
      json_extract_string(o.metadata_json, '$.language') AS language,
      CASE WHEN n.last_id IS NOT NULL THEN concat('again ', n.last_id) END AS job,
      CASE WHEN n.last_id IS NOT NULL THEN CAST(n.last_id AS VARCHAR) END AS seen
    FROM old o FULL JOIN ident n ON o.file_id = n.file_id AND o.asset_type = n.asset_type
      AND coalesce(o.path, '') = n.p AND coalesce(o.start_s, -1) = n.s
      AND coalesce(o.end_s, -1) = n.e AND coalesce(o.frame_time_s, -1) = n.f""",
)
def asset_upsert(t):
    """Captions are new, chunks come again without a text, frames do not come again. Every row is
    followed by one of the same identity with another id, no text and other metadata."""
    assets = t.v_assets
    number = F.col("asset_id").cast("string")
    rows = assets.filter(F.col("asset_type") != "video_frame").withColumn("content_hash", F.lit("new"))
    first = rows.withColumns(
        {
            "text_content": F.when(F.col("asset_type") != "text_chunk", F.concat(F.lit("text "), number)),
            "metadata_json": F.concat(F.lit('{"job":"'), number, F.lit('","seen":"'), number, F.lit('"}')),
            "batch_order": F.col("asset_id") * 2,
        }
    )
    second = rows.withColumns(
        {
            "text_content": F.lit(None).cast("string"),
            "metadata_json": F.concat(F.lit('{"job":"again '), number, F.lit('"}')),
            "batch_order": F.col("asset_id") * 2 + 1,
            "asset_id": -F.col("asset_id") - 1,
        }
    )
    existing = assets.filter(F.col("asset_type") != "caption").withColumn(
        "content_hash", F.lit("old")
    )
    merged = snapshots.asset_upsert(existing, first.unionByName(second))
    get = lambda k: F.get_json_object("metadata_json", f"$.{k}").alias(k)
    return merged.select(
        "asset_id", "file_id", "asset_type", "text_content", "outcome", get("language"), get("job"),
        get("seen"),
    )


@query(
    "ref_upsert",
    """
    SELECT p.collection, p.point_id, 'first' AS content_hash,
      CASE WHEN r.status IS NULL OR r.status = 'stale' THEN 'created' ELSE 'skipped' END AS outcome,
      CASE WHEN r.status IS NULL OR r.status = 'stale' THEN 'pending' ELSE r.status END AS status
    FROM v_points p LEFT JOIN (SELECT * FROM v_refs WHERE library_id <> 'src4') r
      ON r.collection = p.collection AND r.point_id = p.point_id""",
)
def ref_upsert(t):
    """All points come in twice with different hashes; the refs of one library are not stored yet."""
    existing = t.v_refs.filter(F.col("library_id") != "src4")
    batch = lambda n, mark: t.v_points.select(
        "collection", "point_id", F.lit(mark).alias("content_hash"), F.lit(n).alias("batch_order")
    )
    both = batch(2, "second").unionByName(batch(1, "first"))
    return snapshots.ref_upsert(existing, both).select(
        "collection", "point_id", "content_hash", "outcome", "status"
    )


@query(
    "scene_upsert",
    """
    SELECT coalesce(s.file_id, n.file_id) AS file_id, coalesce(s.scene_key, n.scene_key)
        AS scene_key, coalesce(s.index_generation, n.index_generation) AS index_generation,
      coalesce(s.scene_id, n.scene_id) AS scene_id, coalesce(n.start_s, s.start_s) AS start_s,
      coalesce(n.end_s, s.end_s) AS end_s
    FROM v_scenes s FULL JOIN (SELECT concat(scene_id, '-new') AS scene_id, file_id, scene_key, 1
        AS index_generation, start_s + 2 AS start_s, end_s + 2 AS end_s FROM v_scenes) n
      ON s.file_id = n.file_id AND s.scene_key = n.scene_key
        AND s.index_generation = n.index_generation""",
)
def scene_upsert(t):
    """Every scene comes in twice for generation 1; the second pair of bounds wins."""
    existing = t.v_scenes.withColumn("strategy_fingerprint", F.lit("old"))
    batch = lambda n: existing.select(
        F.concat("scene_id", F.lit("-new")).alias("scene_id"), "file_id", "scene_key",
        F.lit(1).alias("index_generation"), (F.col("start_s") + n).alias("start_s"),
        (F.col("end_s") + n).alias("end_s"), F.lit("new").alias("strategy_fingerprint"),
        F.lit(n).alias("batch_order"),
    )
    merged = snapshots.scene_upsert(existing, batch(1).unionByName(batch(2)))
    return merged.drop("strategy_fingerprint")


@query(
    "purge_files",
    """
    WITH k AS (SELECT file_id FROM v_files WHERE index_status = 'purge_queued'
      OR index_status = 'failed')
    SELECT f.file_id, f.index_status = 'purge_queued' OR f.index_status = 'pending' AS is_pending,
      CAST(f.index_generation + CASE WHEN f.index_status = 'purge_queued' THEN 1 ELSE 0 END AS INT)
        AS index_generation,
      coalesce(a.n, 0) AS assets_left, coalesce(a.gone, 0) AS assets_deleted,
      coalesce(r.n, 0) AS refs_left, coalesce(r.gone, 0) AS refs_deleted,
      coalesce(s.n, 0) AS scenes_left, coalesce(s.gone, 0) AS scenes_deleted
    FROM v_files f
    LEFT JOIN (SELECT file_id, count(*) FILTER (asset_type = 'text_chunk' OR file_id NOT IN
        (SELECT file_id FROM k)) AS n, count(*) FILTER (asset_type <> 'text_chunk' AND file_id IN
        (SELECT file_id FROM k)) AS gone FROM v_assets GROUP BY file_id) a USING (file_id)
    LEFT JOIN (SELECT file_id, count(*) FILTER (file_id NOT IN (SELECT file_id FROM k)) AS n,
        count(*) FILTER (file_id IN (SELECT file_id FROM k)) AS gone FROM v_refs GROUP BY file_id) r
      USING (file_id)
    LEFT JOIN (SELECT file_id, count(*) FILTER (file_id NOT IN (SELECT file_id FROM k)) AS n,
        count(*) FILTER (file_id IN (SELECT file_id FROM k)) AS gone FROM v_scenes
        GROUP BY file_id) s USING (file_id)""",
)
def purge_files(t):
    """Queued and failed files purged; only the queued ones move to the next generation."""
    doomed = t.v_files.filter(F.col("index_status").isin("purge_queued", "failed"))
    after = snapshots.purge_files(doomed, t.v_files, t.v_assets, t.v_refs, t.v_scenes)
    left = lambda name, out: after[name].groupBy("file_id").agg(
        F.count(F.lit(1)).alias(out)
    )
    report = after["report"].select(
        "file_id", "assets_deleted", F.col("vector_refs_deleted").alias("refs_deleted"),
        "scenes_deleted",
    )
    files = after["files"].select(
        "file_id", (F.col("index_status") == "pending").alias("is_pending"), "index_generation"
    )
    joined = files.join(report, "file_id", "left")
    for name, out in [("assets", "assets_left"), ("refs", "refs_left"), ("scenes", "scenes_left")]:
        joined = joined.join(left(name, out), "file_id", "left")
    counts = [c for c in joined.columns if c.endswith(("_left", "_deleted"))]
    return joined.fillna(0, subset=counts)


NEW_MODEL = ("new-model", "v2", "frame_embedding", 32)
UUID_SQL = """concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',
    translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr(h, 18, 3), '-',
    substr(h, 21, 12))"""
NAMESPACE = "unhex('f3f4e35a688d4f7999e091f9480a5827')"


@query(
    "model_rollover",
    f"""
    SELECT ref_id, collection, CASE WHEN m THEN {UUID_SQL} ELSE CAST(point_id AS VARCHAR) END
        AS point_id, CASE WHEN m THEN 'new-model' ELSE model_name END AS model_name,
      CASE WHEN m THEN 32 ELSE vector_dim END AS vector_dim,
      CASE WHEN m THEN 'pending' ELSE status END AS status
    FROM (SELECT *, collection = 'video_frame_vectors' AS m, sha1({NAMESPACE} ||
        encode(concat(asset_id, '|video_frame_vectors|new-model|v2|frame_embedding|',
          content_hash))) AS h FROM v_refs)""",
)
def model_rollover(t):
    rolled = snapshots.model_rollover(t.v_refs, C.GROUPED_CHANNEL, *NEW_MODEL)
    return rolled.select("ref_id", "collection", "point_id", "model_name", "vector_dim", "status")


@query(
    "points_to_delete",
    """
    SELECT r.collection, r.file_id, r.point_id FROM v_refs r JOIN v_files f USING (file_id)
    WHERE f.index_status = 'purge_queued'""",
)
def points_to_delete(t):
    doomed = t.v_files.filter(F.col("index_status") == "purge_queued")
    return snapshots.points_to_delete(doomed, t.v_refs)


@query(
    "library_status_update",
    """
    SELECT l.library_id, coalesce(c.status, 'active') AS status,
      CASE WHEN c.status IS NULL THEN l.is_deleted ELSE c.status = 'deleted' END AS has_deleted_at
    FROM v_libraries l LEFT JOIN (SELECT source AS library_id, CASE WHEN max(n_chars) > 15000
        THEN 'deleted' WHEN max(n_chars) > 8000 THEN 'disabled' ELSE 'active' END AS status
      FROM documents GROUP BY source) c USING (library_id)""",
)
def library_status_update(t):
    """Every library is first deleted and then gets the status of its longest text."""
    longest = F.max("n_chars")
    changes = t.documents.groupBy(F.col("source").alias("library_id")).agg(
        F.when(longest > 15000, "deleted").when(longest > 8000, "disabled").otherwise("active")
        .alias("status")
    ).withColumn("batch_order", F.lit(2))
    changes = changes.unionByName(
        changes.withColumns({"status": F.lit("deleted"), "batch_order": F.lit(1)})
    )
    stamp = F.lit("2024-02-01 00:00:00").cast("timestamp")
    before = t.v_libraries.select(
        "library_id", F.lit("active").alias("status"),
        F.when(F.col("is_deleted"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias(
            "deleted_at"
        ),
    )
    after = snapshots.library_status_update(before, changes, stamp)
    return after.select(
        "library_id", "status", F.col("deleted_at").isNotNull().alias("has_deleted_at")
    )


@query(
    "apply_probe_metadata",
    """
    SELECT f.file_id, CASE WHEN p THEN 'probed' ELSE f.index_status END AS index_status,
      CASE WHEN p THEN CASE WHEN n % 3 = 0 THEN n / 10 WHEN media_type = 'video' THEN n / 20
        ELSE n / 40 END ELSE duration_seconds END AS duration_seconds,
      CASE WHEN p THEN CASE WHEN media_type = 'video' THEN 640 END END AS width,
      CASE WHEN p THEN CASE WHEN media_type = 'video' THEN 'h264' ELSE 'aac' END END AS codec
    FROM (SELECT *, media_type IN ('video', 'audio') AS p, size_bytes AS n FROM v_files) f""",
)
def apply_probe_metadata(t):
    """Probe output per video and audio file: streams in one order, container duration for some.
    An earlier probe of each file found nothing."""
    n, media = F.col("size_bytes"), F.col("media_type")
    stream = lambda kind, codec, width, duration: F.struct(
        F.lit(kind).alias("codec_type"), F.lit(codec).alias("codec_name"),
        F.lit(width).cast("int").alias("width"), F.lit(width).cast("int").alias("height"),
        duration.cast("string").alias("duration"),
    )
    audio = stream("audio", "aac", None, n / 40)
    video = stream("video", "h264", 640, n / 20)
    probe = F.struct(
        F.when(media == "video", F.array(audio, video)).otherwise(F.array(audio)).alias("streams"),
        F.struct(F.when(n % 3 == 0, n / 10).cast("string").alias("duration")).alias("format"),
    )
    probes = t.v_files.filter(media.isin("video", "audio")).select(
        "file_id", F.to_json(probe).alias("probe_json"), F.lit(2).alias("batch_order")
    )
    probes = probes.unionByName(
        probes.withColumns({"probe_json": F.lit('{"streams":[]}'), "batch_order": F.lit(1)})
    )
    return snapshots.apply_probe_metadata(t.v_files, probes).select(
        "file_id", "index_status", "duration_seconds", "width", "codec"
    )

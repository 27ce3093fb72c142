"""Catalogue-shaped views over the TESTDATA tables.

``SHARED`` texts run unchanged in Spark and DuckDB. Views whose Spark form must not put a whole
group into one task (running sums per file, means per label) are DataFrame code here, with their
DuckDB text in ``ORACLE_ONLY``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.operators import text_search, vector_search
from reelquery.operators.ordered import OrderedScan

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

SHARED: dict[str, str] = {
    "v_libraries": """
        SELECT source AS library_id, concat('/', source) AS root_path, source = 'src3' AS is_deleted
        FROM documents GROUP BY source""",
    "v_files": """
        SELECT file_id, library_id, media_type, relative_path,
          concat('/', library_id, '/', relative_path) AS path, size_bytes, mtime_ms,
          duration_seconds, index_status, index_generation, is_deleted
        FROM (SELECT d.doc_id AS file_id, d.source AS library_id,
            CASE d.doc_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio'
              ELSE 'document' END AS media_type,
            concat(d.lang, '/doc-', CAST(d.doc_id AS STRING),
              CASE d.doc_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.MP4' WHEN 2 THEN '.wav'
                ELSE '.txt' END) AS relative_path,
            d.n_chars AS size_bytes, d.doc_id * 1000 AS mtime_ms,
            d.n_chars / CAST(10 AS DOUBLE) AS duration_seconds,
            CASE WHEN d.doc_id % 23 = 0 THEN 'purge_queued' WHEN l.quality = 1 THEN 'indexed'
              WHEN l.quality = 0 THEN 'failed' ELSE 'pending' END AS index_status,
            CAST(d.doc_id % 2 AS INT) AS index_generation, d.doc_id % 17 = 0 AS is_deleted
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) t""",
    "v_previous": """
        SELECT f.file_id, f.library_id, f.path, f.size_bytes + l.toxic AS size_bytes, f.mtime_ms,
          f.index_status
        FROM v_files f JOIN labels l ON f.file_id = l.doc_id""",
    "v_points": """
        SELECT vec_id AS point_id, vec_id AS asset_id, label, collection, file_id, scene_no,
          CASE WHEN file_id % 4 = 1 AND vec_id % 29 <> 0
            THEN concat('scene-', CAST(file_id AS STRING), '-', CAST(scene_no AS STRING))
            END AS scene_id,
          CASE WHEN vec_id % 11 = 0 THEN 'stale' WHEN vec_id % 7 = 0 THEN 'pending'
            ELSE 'indexed' END AS ref_status,
          embedding
        FROM (SELECT vec_id, label, embedding,
            CASE vec_id % 3 WHEN 0 THEN 'image_vectors' WHEN 1 THEN 'video_frame_vectors'
              ELSE 'caption_text_vectors' END AS collection,
            label * 4 + CAST(floor(vec_id / 3) AS BIGINT) % 5 * 40
              + CASE WHEN vec_id % 3 = 0 OR (vec_id % 3 = 2 AND vec_id % 2 = 0) THEN 0
                ELSE 1 END AS file_id,
            CAST(floor(vec_id / 15) AS BIGINT) % 3 AS scene_no
          FROM embeddings) t""",
    "v_scenes": """
        SELECT scene_id, file_id, concat('scene-000', CAST(scene_no + 1 AS STRING)) AS scene_key,
          scene_no * CAST(10 AS DOUBLE) AS start_s, scene_no * CAST(10 AS DOUBLE) + 10 AS end_s,
          CAST(CASE WHEN scene_no = 2 THEN 0 ELSE file_id % 2 END AS INT) AS index_generation
        FROM (SELECT DISTINCT scene_id, file_id, scene_no FROM v_points
          WHERE scene_id IS NOT NULL) t""",
    "v_chunks": """
        SELECT 1000000000 + doc_id AS asset_id, doc_id AS file_id, 'text_chunk' AS asset_type,
          CAST(NULL AS STRING) AS path, CAST(NULL AS STRING) AS scene_id,
          CAST(n_chars % 20 AS DOUBLE) AS start_s, CAST(n_chars % 20 + 12 AS DOUBLE) AS end_s,
          CAST(NULL AS DOUBLE) AS frame_time_s, text AS text_content,
          concat('{"language":"', lang, '"}') AS metadata_json, doc_id AS created_seq
        FROM documents""",
    "v_assets": """
        SELECT asset_id, file_id,
          CASE collection WHEN 'image_vectors' THEN 'image' WHEN 'video_frame_vectors'
            THEN 'video_frame' ELSE 'caption' END AS asset_type,
          CASE WHEN collection = 'image_vectors' AND asset_id % 2 = 0
            THEN concat('/cache/', CAST(asset_id AS STRING), '.jpg') END AS path,
          scene_id,
          CASE WHEN collection = 'caption_text_vectors' AND scene_id IS NOT NULL
            THEN scene_no * CAST(10 AS DOUBLE) END AS start_s,
          CASE WHEN collection = 'caption_text_vectors' AND scene_id IS NOT NULL
            THEN scene_no * CAST(10 AS DOUBLE) + 10 END AS end_s,
          CASE WHEN collection = 'video_frame_vectors'
            THEN scene_no * 10 + (asset_id % 4) * CAST(2.5 AS DOUBLE) + CAST(1.25 AS DOUBLE)
            END AS frame_time_s,
          CASE WHEN collection = 'caption_text_vectors'
            THEN concat('caption of scene ', CAST(scene_no AS STRING), ' label ',
              CAST(label AS STRING), repeat(' seen again', 10 + label)) END AS text_content,
          CASE WHEN asset_id % 13 = 0 THEN '{"stale":true,"prompt_version":"caption-v1"}'
            WHEN asset_id % 5 = 0 THEN '{"prompt_version":"caption-v1"}'
            ELSE '{"stale":false,"prompt_version":"scene-caption-v2","source":"vlm"}'
            END AS metadata_json,
          asset_id AS created_seq
        FROM v_points
        UNION ALL
        SELECT asset_id, file_id, asset_type, path, scene_id, start_s, end_s, frame_time_s,
          text_content, metadata_json, created_seq FROM v_chunks""",
    "v_refs": """
        SELECT p.point_id AS ref_id, p.asset_id, p.file_id, f.library_id, p.collection, p.point_id,
          CASE WHEN p.collection = 'caption_text_vectors' THEN 'minilm' ELSE 'siglip' END
            AS model_name,
          'v1' AS model_version, concat(p.collection, '_kind') AS vector_kind, 64 AS vector_dim,
          'Cosine' AS distance, concat('hash-', CAST(p.asset_id AS STRING)) AS content_hash,
          'balanced' AS index_profile, p.ref_status AS status,
          TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * p.asset_id AS created_at,
          TIMESTAMP '2024-01-02 00:00:00' + INTERVAL '1' MINUTE * p.asset_id AS updated_at
        FROM v_points p JOIN v_files f ON p.file_id = f.file_id""",
    "v_jobs": """
        SELECT event_id AS job_id, job_type, status, priority, 0 AS attempt, timeout_seconds,
          file_id, created_at, heartbeat_at, created_at AS updated_at,
          CASE WHEN status IN ('succeeded', 'failed') THEN heartbeat_at END AS finished_at,
          CASE WHEN status = 'failed' THEN CASE k % 3 WHEN 0 THEN 'SCENE_COUNT_EXCEEDED'
            WHEN 1 THEN 'VIDEO_DECODE_FAILED' END END AS error_code,
          CASE WHEN status = 'failed' THEN concat('failed on ', CAST(k AS STRING)) END
            AS error_message,
          concat('{"file_id":"', CAST(k AS STRING), '","asset_id":"', CAST(k * 3 + 1 AS STRING),
            '","asset_ids":["', CAST(k AS STRING), '","', CAST(k + 1 AS STRING),
            '"],"path":"/in/', CAST(k % 7 AS STRING),
            '.mp4","collection":"video_frame_vectors","model_name":"siglip","model_version":"v1"}')
            AS input_json
        FROM (SELECT event_id, user_id AS file_id, ts AS created_at,
            CASE user_id % 4 WHEN 0 THEN 'index_media' WHEN 1 THEN 'embed_image'
              WHEN 2 THEN 'embed_video_frame' ELSE 'generate_caption' END AS job_type,
            CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running'
              WHEN 'signup' THEN 'queued' ELSE 'succeeded' END AS status,
            CAST(event_id % 3 AS INT) AS priority, CAST(300 AS INT) AS timeout_seconds,
            CASE WHEN event_id % 19 = 0 THEN NULL
              ELSE ts + INTERVAL '1' SECOND * CAST(floor(value) AS BIGINT) END AS heartbeat_at,
            CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k
          FROM events) t""",
    "v_runs": """
        SELECT user_id AS run_id, CASE WHEN max(value) > 490 THEN 'failed' ELSE 'succeeded' END
          AS status, min(ts) AS created_at
        FROM events GROUP BY user_id""",
    "v_run_events": """
        SELECT event_id, user_id AS run_id, event_type, ts AS created_at FROM events""",
    "v_tool_calls": """
        SELECT event_id AS tool_call_id, user_id AS run_id,
          CASE WHEN event_type = 'purchase' THEN 'export_clip' WHEN event_type = 'signup'
            THEN 'create_index_job' ELSE 'search_media' END AS tool_name,
          CASE WHEN event_type IN ('purchase', 'signup') AND value < 250
            THEN 'waiting_for_confirmation' ELSE 'succeeded' END AS status,
          ts AS created_at
        FROM events WHERE event_type <> 'error'""",
    "v_results": """
        SELECT l_suppkey AS run_id, l_partkey AS case_id,
          l_orderkey * 100 + l_linenumber AS result_id,
          CASE l_linenumber % 3 WHEN 0 THEN CAST(30 AS DOUBLE) WHEN 1 THEN CAST(5 AS DOUBLE)
            ELSE CAST(15 AS DOUBLE) END AS duration_s,
          CASE WHEN l_linenumber % 2 = 0 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS fps,
          l_quantity + l_tax AS inference_s, 1 AS expected_relevance,
          CASE WHEN l_returnflag = 'R' AND l_discount > 0.09 THEN 0 ELSE 1 END AS relevance,
          l_linestatus = 'F' AS transient_action,
          CASE WHEN l_returnflag = 'N' AND l_tax > 0.07 THEN 'VLM_TIMEOUT' END AS failure_type
        FROM lineitem""",
    "v_samples": """
        SELECT user_id AS run_id, event_id AS sample_id, ts,
          CAST(floor(value * 20000000) AS BIGINT) AS used_bytes
        FROM events""",
    "v_cut_files": """
        SELECT o_orderkey AS file_id, o_orderpriority AS library_id,
          CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 1000 END AS duration_seconds,
          CAST(o_custkey % 2 AS INT) AS index_generation
        FROM orders""",
}

ORACLE_ONLY: dict[str, str] = {
    "v_prototypes": """
        SELECT label, list(m / n ORDER BY pos) AS embedding
        FROM (SELECT label, pos, avg(x) AS m, sqrt(sum(avg(x) * avg(x)) OVER (PARTITION BY label))
                AS n
          FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x,
              generate_subscripts(embedding, 1) AS pos FROM embeddings)
          GROUP BY label, pos)
        GROUP BY label""",
    "v_queries": """
        SELECT CAST(label AS BIGINT) AS query_id, 0 AS variant_order, CAST(1 AS DOUBLE) AS weight,
          label AS query_label, embedding AS query_embedding FROM v_prototypes
        UNION ALL
        SELECT CAST(q.label AS BIGINT), 1, CAST(0.85 AS DOUBLE), q.label, p.embedding
        FROM v_prototypes q JOIN v_prototypes p ON p.label = q.label + 1""",
    "v_scored": """
        SELECT q.query_id, q.variant_order, q.weight, p.collection, p.point_id, p.scene_id,
          CASE WHEN p.collection = 'video_frame_vectors' THEN p.scene_id
            ELSE CAST(p.point_id AS VARCHAR) END AS identity,
          round(list_dot_product(CAST(p.embedding AS DOUBLE[]), q.query_embedding), 6) AS score
        FROM v_points p CROSS JOIN v_queries q""",
    "v_hits": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant_order,
            collection ORDER BY score DESC, point_id) AS hit_rank
          FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant_order, collection,
              identity ORDER BY score DESC, point_id) AS r
            FROM v_scored WHERE identity IS NOT NULL) WHERE r = 1) WHERE hit_rank <= 60""",
    "v_channel": """
        SELECT query_id, collection, identity, point_id, weighted_score AS score, channel_rank
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection
            ORDER BY weighted_score DESC, point_id) AS channel_rank
          FROM (SELECT *, score * weight AS weighted_score,
              row_number() OVER (PARTITION BY query_id, collection, identity
                ORDER BY score * weight DESC, variant_order) AS b FROM v_hits)
          WHERE b = 1) WHERE channel_rank <= 60""",
    "v_facts": """
        SELECT c.*, r.asset_id, r.file_id, r.library_id, r.status AS ref_status, a.asset_type,
          a.scene_id, a.start_s AS asset_start, a.end_s AS asset_end, a.frame_time_s,
          a.text_content, a.metadata_json, f.media_type, f.path, f.index_generation,
          f.is_deleted AS file_deleted, l.is_deleted AS library_deleted,
          s.start_s AS scene_start, s.end_s AS scene_end, s.index_generation AS scene_generation
        FROM v_channel c
        JOIN v_refs r ON r.collection = c.collection AND r.point_id = c.point_id
        JOIN v_assets a ON a.asset_id = r.asset_id
        JOIN v_files f ON f.file_id = r.file_id
        JOIN v_libraries l ON l.library_id = r.library_id
        LEFT JOIN v_scenes s ON s.scene_id = a.scene_id""",
    "v_hydrated": """
        SELECT query_id, collection, point_id, asset_id, file_id, media_type, path, scene_id,
          asset_type, frame_time_s, score, channel_rank, metadata_json, text_content,
          CASE WHEN media_type = 'video' AND scene_id IS NOT NULL THEN scene_start
            ELSE coalesce(asset_start, frame_time_s) END AS start_s,
          CASE WHEN media_type = 'video' AND scene_id IS NOT NULL THEN scene_end
            ELSE coalesce(asset_end, frame_time_s) END AS end_s,
          CASE WHEN collection = 'caption_text_vectors' THEN 'caption_match'
            ELSE 'vector_match' END AS reason,
          row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, point_id)
            AS source_rank
        FROM v_facts
        WHERE ref_status = 'indexed' AND NOT file_deleted AND NOT library_deleted
          AND coalesce(json_extract_string(metadata_json, '$.stale'), 'false') <> 'true'
          AND NOT (media_type = 'video' AND scene_id IS NULL)
          AND NOT (media_type = 'video' AND scene_id IS NOT NULL
            AND scene_generation IS DISTINCT FROM index_generation)
          AND NOT (media_type = 'video' AND asset_type = 'caption'
            AND coalesce(json_extract_string(metadata_json, '$.prompt_version'), '')
              <> 'scene-caption-v2')""",
    "v_judgments": """
        SELECT CAST(q.label AS BIGINT) AS query_id, p.vec_id AS candidate_key,
          CASE WHEN p.vec_id % 13 = 0 THEN NULL WHEN p.label = q.label THEN 2
            WHEN abs(p.label - q.label) = 1 THEN 1 ELSE 0 END AS relevance
        FROM v_prototypes q JOIN embeddings p ON abs(p.label - q.label) <= 2""",
    "v_words": """
        SELECT doc_id, pos, term FROM (SELECT doc_id,
            unnest(w) AS term, generate_subscripts(w, 1) AS pos
          FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text),
              '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents))""",
    "v_query_words": """
        SELECT item_id, term, row_number() OVER (PARTITION BY item_id
            ORDER BY length(term) DESC, term) AS nth
        FROM (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text),
            '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark)""",
    "v_query_terms": """
        SELECT item_id * 3 AS query_id, term FROM v_query_words
        UNION ALL SELECT item_id * 3 + 1, term FROM v_query_words WHERE nth = 1
        UNION ALL SELECT item_id * 3 + 2, term FROM v_query_words WHERE nth <= 2""",
    "v_matches": """
        SELECT query_id, doc_id FROM (SELECT q.query_id, w.doc_id, count(*) AS found
          FROM (SELECT DISTINCT doc_id, term FROM v_words) w JOIN v_query_terms q
            ON q.term = w.term GROUP BY ALL) m
        JOIN (SELECT query_id AS qid, count(*) AS n FROM v_query_terms GROUP BY ALL) t
          ON t.qid = m.query_id AND t.n = m.found""",
    "v_covers": """
        SELECT query_id, doc_id, pos AS start_pos, end_pos, end_pos - pos - (end_n - n) AS noise
        FROM (SELECT *, greatest(again, all_seen, pos) AS end_pos,
            greatest(again_n, all_seen_n, n) AS end_n
          FROM (SELECT *,
              coalesce(max(coalesce(next_pos, 4611686018427387904)) OVER prior, 0) AS again,
              coalesce(max(coalesce(next_n, 4611686018427387904)) OVER prior, 0) AS again_n,
              max(CASE WHEN is_first THEN pos END) OVER (PARTITION BY query_id, doc_id) AS all_seen,
              max(CASE WHEN is_first THEN n END) OVER (PARTITION BY query_id, doc_id) AS all_seen_n
            FROM (SELECT *, lead(n) OVER (PARTITION BY query_id, doc_id, term ORDER BY pos)
                AS next_n
              FROM (SELECT m.query_id, m.doc_id, w.term, w.pos,
                  row_number() OVER (PARTITION BY m.query_id, m.doc_id ORDER BY w.pos) AS n,
                  lead(w.pos) OVER (PARTITION BY m.query_id, m.doc_id, w.term ORDER BY w.pos)
                    AS next_pos,
                  row_number() OVER (PARTITION BY m.query_id, m.doc_id, w.term ORDER BY w.pos) = 1
                    AS is_first
                FROM v_matches m JOIN v_query_terms q ON q.query_id = m.query_id
                JOIN v_words w ON w.doc_id = m.doc_id AND w.term = q.term))
            WINDOW prior AS (PARTITION BY query_id, doc_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
        WHERE end_pos < coalesce(next_pos, 4611686018427387904)""",
    "v_text_scores": """
        SELECT query_id, doc_id, count(*) AS n_covers, round(sum(0.1 / (1 + noise)), 6) AS score
        FROM v_covers GROUP BY ALL""",
    "v_text_hits": """
        SELECT * FROM (SELECT s.query_id, c.asset_id, c.file_id, f.media_type, f.path, c.scene_id,
            c.start_s, c.end_s, s.score, row_number() OVER (PARTITION BY s.query_id
              ORDER BY s.score DESC, c.start_s, c.asset_id) AS channel_rank
          FROM v_text_scores s JOIN v_chunks c ON c.file_id = s.doc_id
          JOIN v_files f ON f.file_id = c.file_id JOIN v_libraries l
            ON l.library_id = f.library_id
          WHERE NOT f.is_deleted AND NOT l.is_deleted
            AND f.media_type IN ('image', 'audio', 'video'))
        WHERE channel_rank <= 60 AND media_type IN ('audio', 'video')""",
    "v_candidates": """
        SELECT h.query_id, CASE collection WHEN 'image_vectors' THEN 0
            WHEN 'video_frame_vectors' THEN 1 ELSE 2 END * 301 + channel_rank AS input_order,
          asset_id, file_id, media_type, path, scene_id, start_s, end_s,
          frame_time_s AS best_frame_s, reason, collection AS source, score
        FROM v_hydrated h
        UNION ALL
        SELECT CAST((t.query_id - 2) / 3 AS BIGINT), 3 * 301 + channel_rank, asset_id, file_id,
          media_type, path, scene_id, start_s, end_s, NULL, 'transcript_match', 'text_search', score
        FROM v_text_hits t WHERE t.query_id IN (SELECT query_id * 3 + 2 FROM v_queries)""",
    "v_kept": """
        SELECT *, CASE WHEN source = 'text_search' THEN 0.45 ELSE 0.55 END AS w,
          CASE WHEN source = 'text_search' THEN 0.45 ELSE 0.55 END * norm AS contrib
        FROM (SELECT *, CASE WHEN source = 'text_search'
            THEN CASE WHEN score <= 0 THEN 0 ELSE score / (score + 1) END
            ELSE least(greatest(score, 0), 1) END AS norm FROM v_candidates)
        WHERE source = 'text_search' OR norm >= 0.1""",
    "v_base": """
        SELECT query_id, file_id, asset_id, media_type, scene_id, start_s, end_s, input_order,
          CASE WHEN source = 'image_vectors' THEN score END AS img,
          CASE WHEN source = 'video_frame_vectors' THEN score END AS frm,
          CASE WHEN source = 'caption_text_vectors' THEN score END AS cap,
          CASE WHEN source = 'text_search' THEN score END AS txt, contrib AS strength,
          [{'o': input_order, 'a': asset_id}] AS members,
          row_number() OVER (PARTITION BY query_id, file_id, media_type = 'video'
            AND start_s IS NOT NULL AND end_s IS NOT NULL ORDER BY start_s, input_order) AS rn,
          media_type = 'video' AND start_s IS NOT NULL AND end_s IS NOT NULL AS timed
        FROM v_kept""",
    "v_fold": """
        SELECT query_id, file_id, rn, 1 AS g, asset_id, scene_id, start_s, end_s, img, frm, cap,
          txt, strength, members FROM v_base WHERE timed AND rn = 1
        UNION ALL
        SELECT query_id, file_id, rn, CASE WHEN m THEN g ELSE g + 1 END,
          CASE WHEN m AND NOT b_strength > strength THEN asset_id ELSE b_asset_id END,
          CASE WHEN NOT m THEN b_scene WHEN left_owns THEN scene_id WHEN right_owns THEN b_scene
            END,
          CASE WHEN NOT m OR right_owns THEN b_start WHEN left_owns THEN start_s
            ELSE least(start_s, b_start) END,
          CASE WHEN NOT m OR right_owns THEN b_end WHEN left_owns THEN end_s
            ELSE greatest(end_s, b_end) END,
          CASE WHEN m THEN greatest(img, b_img) ELSE b_img END,
          CASE WHEN m THEN greatest(frm, b_frm) ELSE b_frm END,
          CASE WHEN m THEN greatest(cap, b_cap) ELSE b_cap END,
          CASE WHEN m THEN greatest(txt, b_txt) ELSE b_txt END,
          CASE WHEN m THEN greatest(strength, b_strength) ELSE b_strength END,
          CASE WHEN m THEN list_concat(members, b_members) ELSE b_members END
        FROM (SELECT *, m AND ((scene_id IS NOT NULL AND b_scene IS NULL)
              OR (coalesce(scene_id = b_scene, FALSE) AND NOT (end_s <= start_s AND b_end > b_start)))
              AS left_owns,
            m AND ((scene_id IS NULL AND b_scene IS NOT NULL) OR (coalesce(scene_id = b_scene,
              FALSE) AND end_s <= start_s AND b_end > b_start)) AS right_owns
          FROM (SELECT f.query_id, f.file_id, b.rn, f.g, f.asset_id, f.scene_id, f.start_s, f.end_s,
              f.img, f.frm, f.cap, f.txt, f.strength, f.members, b.asset_id AS b_asset_id,
              b.scene_id AS b_scene, b.start_s AS b_start, b.end_s AS b_end, b.img AS b_img,
              b.frm AS b_frm, b.cap AS b_cap, b.txt AS b_txt, b.strength AS b_strength,
              b.members AS b_members,
              CASE WHEN f.scene_id IS NOT NULL AND b.scene_id IS NOT NULL
                  THEN f.scene_id = b.scene_id
                WHEN f.img IS NULL AND f.frm IS NULL AND f.txt IS NULL AND b.cap IS NOT NULL
                  THEN FALSE
                ELSE greatest(f.start_s, b.start_s) < least(f.end_s, b.end_s) END AS m
            FROM v_fold f JOIN v_base b ON b.query_id = f.query_id AND b.file_id = f.file_id
              AND b.timed AND b.rn = f.rn + 1))""",
    "v_windowed": """
        SELECT query_id, file_id, asset_id, scene_id, start_s, end_s, img, frm, cap, txt, strength,
          members FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_id, g
            ORDER BY rn DESC) AS last FROM v_fold) WHERE last = 1
        UNION ALL
        SELECT query_id, file_id, asset_id, scene_id, start_s, end_s, img, frm, cap, txt, strength,
          members FROM v_base WHERE NOT timed""",
    "v_results_scored": """
        SELECT *, round(least(1, greatest(
            (coalesce(0.55 * n_img, 0) + coalesce(0.55 * n_frm, 0) + coalesce(0.55 * n_cap, 0)
              + coalesce(0.45 * n_txt, 0))
            / (CASE WHEN img IS NULL THEN 0 ELSE 0.55 END + CASE WHEN frm IS NULL THEN 0 ELSE 0.55
              END + CASE WHEN cap IS NULL THEN 0 ELSE 0.55 END + CASE WHEN txt IS NULL THEN 0
              ELSE 0.45 END)
            + CASE WHEN CAST(coalesce(img, frm) IS NOT NULL AS INT) + CAST(cap IS NOT NULL AS INT)
              + CAST(txt IS NOT NULL AS INT) > 1 THEN 0.08 ELSE 0 END,
            greatest(n_img, n_frm, n_cap, n_txt))), 12) AS score,
          CASE WHEN txt IS NOT NULL AND 0.45 * n_txt >= 0.55 * coalesce(greatest(n_img, n_frm, n_cap), -1)
              THEN 'transcript_match'
            WHEN cap IS NOT NULL AND n_cap >= coalesce(greatest(n_img, n_frm), -1)
              THEN 'caption_match'
            ELSE 'vector_match' END AS primary_reason,
          array_to_string(list_transform(list_sort(members), lambda x: x.a), ',')
            AS merged_asset_ids
        FROM (SELECT *, least(greatest(img, 0), 1) + 0 * img AS n_img,
            least(greatest(frm, 0), 1) + 0 * frm AS n_frm,
            least(greatest(cap, 0), 1) + 0 * cap AS n_cap,
            CASE WHEN txt <= 0 THEN 0 ELSE txt / (txt + 1) END AS n_txt FROM v_windowed)""",
    "v_cuts": """
        SELECT file_id, seq, sum(d) OVER w - d AS start_s, sum(d) OVER w AS end_s
        FROM (SELECT l_orderkey AS file_id,
            CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
              l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS BIGINT) AS seq,
            CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 64 ELSE l_quantity END AS d
          FROM lineitem) t
        WINDOW w AS (PARTITION BY file_id ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "v_segments": """
        SELECT file_id, seq, sum(d) OVER w - d AS start_s, sum(d) OVER w AS end_s, segment_text
        FROM (SELECT conv_id AS file_id, turn AS seq, length(text) / CAST(16 AS DOUBLE) AS d,
            text AS segment_text FROM conversations) t
        WINDOW w AS (PARTITION BY file_id ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "v_islands": """
        SELECT file_id, island, arg_min(start_s, seq) AS start_s, arg_max(end_s, seq) AS end_s,
          arg_min(end_s, seq) AS first_end, count(*) AS n
        FROM (SELECT *, sum(CASE WHEN end_s - start_s >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY
            file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
          FROM v_cuts WHERE end_s > start_s)
        GROUP BY file_id, island""",
    "v_merged": """
        SELECT file_id, CAST(scene_no AS BIGINT) AS scene_no, min(start_s) AS start_s,
          max(end_s) AS end_s
        FROM (SELECT *, sum(CASE WHEN covered IS NULL OR start_s >= covered THEN 1 ELSE 0 END)
            OVER (PARTITION BY file_id ORDER BY island
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scene_no
          FROM (SELECT *, max(end_s) OVER (PARTITION BY file_id ORDER BY island
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered
            FROM (SELECT file_id, island, start_s, CASE WHEN island = 0 AND n = 1
                THEN greatest(end_s, lead(first_end) OVER (PARTITION BY file_id ORDER BY island))
                ELSE end_s END AS end_s FROM v_islands)))
        GROUP BY file_id, scene_no""",
    "v_windows": """
        SELECT file_id, scene_no, part, part_count,
          concat('scene-', printf('%04d', scene_no), CASE WHEN part_count = 1 THEN ''
            ELSE concat('-part-', printf('%03d', part)) END) AS scene_key,
          start_s + (part - 1) * 30.0::DOUBLE AS start_s,
          least(start_s + (part - 1) * 30.0::DOUBLE + 30.0::DOUBLE, end_s) AS end_s
        FROM (SELECT *, unnest(range(1, part_count + 1)) AS part
          FROM (SELECT *, greatest(1, CAST(ceil((end_s - start_s) / 30.0::DOUBLE) AS BIGINT))
            AS part_count FROM v_merged))""",
    "v_frames": """
        SELECT file_id, scene_key, i + 1 AS frame_index,
          (start_s + i * 2.5::DOUBLE + least(start_s + (i + 1) * 2.5::DOUBLE, end_s)) / 2
            AS frame_time_s
        FROM (SELECT *, unnest(range(0, CAST(ceil((end_s - start_s) / 2.5::DOUBLE) AS BIGINT)))
          AS i FROM v_windows)""",
}

VIEWS = {**SHARED, **ORACLE_ONLY}
_NAMES = re.compile(r"\bv_\w+\b")


def changed_views(suffix: str, changes: dict[str, list[tuple[str, str]]]) -> None:
    """Add a second form, named with ``suffix``, of the changed views and of all that build on them."""
    moved = set(changes)
    while more := {n for n, sql in VIEWS.items() if n not in moved and moved & set(_NAMES.findall(sql))}:
        moved |= more
    added = {}
    for name in moved:
        sql = VIEWS[name]
        for old, new in changes.get(name, []):
            if old not in sql:
                raise ValueError(f"{name} has no {old!r}")
            sql = sql.replace(old, new)
        added[name + suffix] = _NAMES.sub(lambda m: m[0] + suffix if m[0] in moved else m[0], sql)
    VIEWS.update(added)


def with_views(sql: str) -> str:
    """``sql`` with the definitions of every view it reaches put in front, dependencies first."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAMES.findall(text)):
            if name in VIEWS and name not in seen:
                seen.add(name)
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    if not order:
        return sql
    body = sql.strip()
    own = re.match(r"(?is)with\s+(recursive\s+)?", body)
    looped = (own and own[1]) or any(name in VIEWS[name] for name in order)
    defined = ", ".join(f"{name} AS ({VIEWS[name]})" for name in order)
    head = f"WITH RECURSIVE {defined}" if looped else f"WITH {defined}"
    return f"{head}, {body[own.end():]}" if own else f"{head} {body}"


class Tables:
    """TESTDATA tables and the views over them, as DataFrame attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BASE and not name.startswith("v_")):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = self._make(name)
        return self._known[name]

    def _make(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in SHARED:
            used = {}

            def bind(match: re.Match) -> str:
                used[match[2]] = getattr(self, match[2])
                return f"{match[1]} {{{match[2]}}}"

            names = "|".join([*BASE, r"v_\w+"])
            text = re.sub(rf"\b(FROM|JOIN)\s+({names})\b", bind, SHARED[name])
            return self.spark.sql(_escape_braces(text, used), **used)
        return getattr(self, f"_{name}")()

    # --- views that are DataFrame code -------------------------------------------------------

    def _v_prototypes(self) -> DataFrame:
        return vector_search.prototypes(self.embeddings, "label")

    def _v_queries(self) -> DataFrame:
        own = self.v_prototypes.select(
            F.col("label").cast("bigint").alias("query_id"), F.lit(0).alias("variant_order"),
            F.lit(1.0).alias("weight"), F.col("label").alias("query_label"),
            F.col("embedding").alias("query_embedding"),
        )
        # The vector of the next label serves as a second variant; the last label has none.
        shifted = self.v_prototypes.select(
            (F.col("label") - 1).alias("query_label"), F.col("embedding").alias("query_embedding")
        ).join(self.v_prototypes.select(F.col("label").alias("query_label")), "query_label")
        second = shifted.select(
            F.col("query_label").cast("bigint").alias("query_id"), F.lit(1).alias("variant_order"),
            F.lit(0.85).alias("weight"), "query_label", "query_embedding",
        )
        return own.unionByName(second)

    def _v_judgments(self) -> DataFrame:
        """Graded by label distance; labels further than two apart are not judged."""
        near = F.explode(F.sequence(F.col("label") - 2, F.col("label") + 2)).alias("near")
        queries = self.v_prototypes.select(F.col("label").alias("query_label"), near)
        points = self.embeddings.select("vec_id", "label")
        distance = F.abs(F.col("label") - F.col("query_label"))
        grade = F.when(F.col("vec_id") % 13 == 0, F.lit(None).cast("int")).otherwise(2 - distance)
        return points.join(queries, points["label"] == queries["near"]).select(
            F.col("query_label").cast("bigint").alias("query_id"),
            F.col("vec_id").alias("candidate_key"), grade.alias("relevance"),
        )

    def _v_text_queries(self) -> DataFrame:
        """Three queries per benchmark item: its text, its longest word, its two longest words."""
        by_length = lambda a, b: (
            F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1)
            .when(a < b, -1).when(a > b, 1).otherwise(0)
        )
        words = F.array_sort(
            F.array_distinct(text_search.tokens(F.col("text"))), by_length
        )
        kinds = F.array(
            F.struct(F.lit(0).alias("kind"), F.col("text").alias("query_text")),
            F.struct(F.lit(1).alias("kind"), F.try_element_at(words, F.lit(1)).alias("query_text")),
            F.struct(
                F.lit(2).alias("kind"), F.array_join(F.slice(words, 1, 2), " ").alias("query_text")
            ),
        )
        return self.benchmark.select("item_id", F.explode(kinds).alias("q")).select(
            (F.col("item_id") * 3 + F.col("q.kind")).alias("query_id"), "q.query_text"
        )

    def _v_cuts(self) -> DataFrame:
        order = [
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
            "l_discount", "l_tax",
        ]
        d = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") / 64).otherwise(
            F.col("l_quantity")
        )
        rows = self.lineitem.select("l_orderkey", *order, d.alias("d"))
        scan = OrderedScan(["l_orderkey"], order, number="seq", sums={"end_s": F.col("d")})
        return scan.run(rows).select(
            F.col("l_orderkey").alias("file_id"), "seq", (F.col("end_s") - F.col("d")).alias(
                "start_s"), "end_s",
        )

    def _v_segments(self) -> DataFrame:
        rows = self.conversations.select(
            F.col("conv_id").alias("file_id"), F.col("turn").alias("seq"),
            (F.length("text") / F.lit(16.0)).alias("d"), F.col("text").alias("segment_text"),
        )
        scan = OrderedScan(["file_id"], ["seq"], sums={"end_s": F.col("d")})
        return scan.run(rows).select(
            "file_id", "seq", (F.col("end_s") - F.col("d")).alias("start_s"), "end_s",
            "segment_text",
        )


def _escape_braces(text: str, used: dict) -> str:
    """Double every brace that is not one of the bound names."""
    doubled = text.replace("{", "{{").replace("}", "}}")
    for name in used:
        doubled = doubled.replace("{{" + name + "}}", "{" + name + "}")
    return doubled

"""Catalogue changes as new snapshots: diffs, upserts, purges and the rows that follow from them.

Parquet has no MERGE, so every change is a projection of (old snapshot ⟕ changes) that a caller
writes as the next snapshot. Incoming rows are first folded to one per key with ``max_by``, which
Spark combines before the shuffle, so repeated keys cost no skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.functions import identifiers as ids


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*keys, "_r.*")


def one_change(changes: DataFrame, keys: list[str], first: bool = False) -> DataFrame:
    """A change table with one row per key: the last (or first) by ``batch_order``.

    Without that column, or for equal numbers, a hash of the row decides, so the choice is stable.
    """
    rest = [c for c in changes.columns if c not in keys]
    number = [F.col("batch_order")] if "batch_order" in rest else []
    order = F.struct(*number, F.xxhash64(*rest)) if rest else F.lit(0)
    pick = F.min_by if first else F.max_by
    row = F.struct(*(rest or [F.lit(True).alias("_only")]))
    return changes.groupBy(*keys).agg(pick(row, order).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


# --- file snapshots ---------------------------------------------------------------------------


def file_snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Outcome per listed file: created, skipped (same size and time) or updated.

    Files missing from the listing are not reported; a scan never deletes. Of rows that repeat a path
    the newest (previous) or last (current) counts.
    """
    current = one_change(current, ["library_id", "path"])
    previous = last_per_key(previous, ["library_id", "path"], ["mtime_ms", "file_id"])
    old = previous.select(
        "library_id", "path", F.col("file_id").alias("known_file_id"),
        F.col("size_bytes").alias("old_size"), F.col("mtime_ms").alias("old_mtime"),
        F.col("index_status").alias("old_status"),
    )
    same = (F.col("size_bytes") == F.col("old_size")) & (F.col("mtime_ms") == F.col("old_mtime"))
    outcome = (
        F.when(F.col("known_file_id").isNull(), "created")
        .when(same, "skipped")
        .otherwise("updated")
    )
    joined = current.join(old, ["library_id", "path"], "left").withColumn("outcome", outcome)
    return joined.withColumn(
        "index_status",
        F.when(F.col("outcome") == "skipped", F.col("old_status")).otherwise("pending"),
    ).drop("old_size", "old_mtime", "old_status")


def scan_summary(diff: DataFrame) -> DataFrame:
    """Counts per library and outcome (partial counts, so one hot library is no problem)."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return diff.groupBy("library_id").agg(
        F.count(F.lit(1)).alias("discovered"), count("created"), count("updated"),
        count("skipped"),
    )


def probe_job_rows(diff: DataFrame) -> DataFrame:
    """Next-stage rows for files that are new or changed."""
    return diff.filter(F.col("outcome") != "skipped").select(
        F.lit("probe_media").alias("job_type"), "library_id", "path", "media_type"
    )


def probed_job_rows(files: DataFrame) -> DataFrame:
    """Jobs after probing: image and video are indexed, video and audio are transcribed."""
    media = F.col("media_type")
    jobs = F.array_compact(
        F.array(
            F.when(
                media.isin("image", "video"),
                F.struct(
                    F.lit("index_media").alias("job_type"),
                    F.lit(None).cast("int").alias("timeout_seconds"),
                ),
            ),
            F.when(
                media.isin("video", "audio"),
                F.struct(
                    F.lit("transcribe_audio").alias("job_type"),
                    F.lit(C.TRANSCRIBE_TIMEOUT_SECONDS).alias("timeout_seconds"),
                ),
            ),
        )
    )
    return files.select("file_id", "path", "media_type", F.explode(jobs).alias("j")).select(
        "file_id", "j.job_type", "j.timeout_seconds",
        F.when(
            F.col("j.job_type") == "index_media",
            F.to_json(
                F.struct(
                    F.col("file_id").cast("string").alias("file_id"),
                    F.lit(C.DEFAULT_PROFILE).alias("index_profile"),
                )
            ),
        ).otherwise(
            F.to_json(
                F.struct(
                    F.col("file_id").cast("string").alias("file_id"), "path", "media_type",
                    F.lit("base").alias("model"), F.lit("auto").alias("language"),
                )
            )
        ).alias("input_json"),
    )


def caption_job_rows(image_assets: DataFrame, scenes: DataFrame) -> DataFrame:
    """One caption job per image asset and one per scene, with its payload."""
    fixed = [
        F.lit("generate_caption").alias("job_type"),
        F.lit(C.CAPTION_TIMEOUT_SECONDS).alias("timeout_seconds"),
        F.lit(C.CAPTION_VLM[0]).alias("model_name"),
        F.lit(C.CAPTION_VLM[1]).alias("model_version"),
    ]
    images = image_assets.select(
        *fixed, "file_id", F.lit(C.IMAGE_PROMPT).alias("prompt_version"),
        F.col("asset_id").cast("string").alias("source_asset_id"),
        F.lit(None).cast("string").alias("scene_id"),
    )
    videos = scenes.select(
        *fixed, "file_id", F.lit(C.SCENE_PROMPT).alias("prompt_version"),
        F.lit(None).cast("string").alias("source_asset_id"), "scene_id",
    )
    payload = F.struct(
        F.col("file_id").cast("string").alias("file_id"), "prompt_version",
        F.when(F.col("source_asset_id").isNotNull(), F.array("source_asset_id")).alias("source_asset_ids"),
        F.col("scene_id").cast("string").alias("scene_id"), "model_name", "model_version",
    )
    return images.unionByName(videos).withColumn("input_json", F.to_json(payload))


def page_union_last_wins(pages: DataFrame, key: str, batch: str) -> DataFrame:
    """Pages merged by id; the latest page wins."""
    return last_per_key(pages, [key], [batch])


# --- upserts ------------------------------------------------------------------------------------


ASSET_IDENTITY = ["path", "start_s", "end_s", "frame_time_s"]


def _asset_identity(df: DataFrame) -> dict[str, Column]:
    """Absent values compare equal, as fixed stand-ins."""
    return {
        "_path": F.coalesce("path", F.lit("")),
        "_start": F.coalesce("start_s", F.lit(-1.0)),
        "_end": F.coalesce("end_s", F.lit(-1.0)),
        "_frame": F.coalesce("frame_time_s", F.lit(-1.0)),
    }


def json_patch(base: Column, patch: Column) -> Column:
    """Top-level JSON merge: keys of ``patch`` replace those of ``base``. Values stay as they are
    written, whatever their type."""
    as_map = lambda c: F.from_json(
        F.coalesce(c, F.lit("{}")), "map<string,variant>"
    )
    kept = F.map_filter(as_map(base), lambda k, _: ~F.array_contains(
        F.coalesce(F.json_object_keys(patch), F.array().cast("array<string>")), k
    ))
    return F.to_json(F.map_concat(kept, as_map(patch)))


def _folded_metadata(incoming: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metadata_json): the metadata patches of each identity applied in order.

    Values are handled as the JSON text they were written in. A group holds one entry per metadata key.
    """
    entries = incoming.select(
        *keys, "batch_order", F.explode(F.from_json("metadata_json", "map<string,variant>")).alias("k", "v")
    ).select(*keys, "batch_order", "k", F.to_json(F.create_map("k", "v")).alias("entry"))
    last = entries.groupBy(*keys, "k").agg(F.max_by("entry", F.struct("batch_order", "entry")).alias("entry"))
    inner = F.transform(
        F.sort_array(F.collect_list("entry")), lambda e: F.substring(e, F.lit(2), F.length(e) - 2)
    )
    return last.groupBy(*keys).agg(
        F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}")).alias("metadata_json")
    )


def asset_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Assets after an upsert, with ``outcome`` created / updated / kept.

    Identity is (file, type, path, start, end, frame). Incoming rows of one identity count in
    ``batch_order``, as if applied one after another: the first gives a new asset its id, a row
    without text keeps the text there is, metadata patches accumulate, and scene and hash are those
    of the last.
    """
    keys = ["file_id", "asset_type", "_path", "_start", "_end", "_frame"]
    named = incoming.withColumns(_asset_identity(incoming))
    order = F.struct("batch_order", "asset_id")
    last = F.struct(*ASSET_IDENTITY, "scene_id", "content_hash")
    new = (
        named.groupBy(*keys)
        .agg(
            F.min_by("asset_id", order).alias("n_asset_id"),
            F.max_by("text_content", F.when(F.col("text_content").isNotNull(), order)).alias("n_text_content"),
            F.max_by(last, order).alias("_last"),
            # An empty patch still makes an object of it; no patch at all stays null.
            F.max(F.when(F.col("metadata_json").isNotNull(), "{}")).alias("_some"),
        )
        .join(_folded_metadata(named, keys).withColumnRenamed("metadata_json", "_folded"), keys, "left")
        .select(
            *keys, F.lit(True).alias("_in"), "n_asset_id", "n_text_content",
            F.coalesce("_folded", "_some").alias("n_metadata_json"),
            *[F.col(f"_last.{c}").alias(f"n_{c}") for c in [*ASSET_IDENTITY, "scene_id", "content_hash"]],
        )
    )
    old = existing.withColumns(_asset_identity(existing)).withColumn("_old", F.lit(True))
    joined = old.join(new, keys, "full_outer")
    fresh, hit = F.col("_old").isNull(), F.col("_in").isNotNull()
    pick = lambda c: F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    take = lambda c: F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(
        pick("asset_id"), "file_id", "asset_type", *[pick(c) for c in ASSET_IDENTITY],
        take("scene_id"), take("content_hash"),
        F.coalesce("n_text_content", "text_content").alias("text_content"),
        F.when(fresh, F.col("n_metadata_json"))
        .when(hit, json_patch(F.col("metadata_json"), F.col("n_metadata_json")))
        .otherwise(F.col("metadata_json"))
        .alias("metadata_json"),
        F.when(fresh, "created").when(hit, "updated").otherwise("kept").alias("outcome"),
    )


def ref_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome per incoming ref: new or stale → created (pending), else skipped.

    Of several incoming rows for one point the first by ``batch_order`` counts.
    """
    old = existing.select("collection", "point_id", F.col("status").alias("old_status"))
    renewed = F.col("old_status").isNull() | (F.col("old_status") == "stale")
    return one_change(incoming, ["collection", "point_id"], first=True).join(
        old, ["collection", "point_id"], "left"
    ).withColumns(
        {
            "outcome": F.when(renewed, "created").otherwise("skipped"),
            "status": F.when(renewed, "pending").otherwise(F.col("old_status")),
        }
    )


def scene_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Scenes keyed by (file, key, generation): a conflict keeps the id and takes the new bounds."""
    keys = ["file_id", "scene_key", "index_generation"]
    fields = ["scene_id", "start_s", "end_s", "strategy_fingerprint"]
    new = last_per_key(incoming, keys, ["batch_order"]).select(
        *keys, F.lit(True).alias("_in"), *[F.col(c).alias(f"n_{c}") for c in fields]
    )
    joined = existing.select(*keys, *fields).join(new, keys, "full_outer")
    take = lambda c: F.when(
        F.col("_in").isNotNull(), F.col(f"n_{c}")
    ).otherwise(F.col(c)).alias(c)
    return joined.select(
        *keys, F.coalesce("scene_id", "n_scene_id").alias("scene_id"),
        take("start_s"), take("end_s"), take("strategy_fingerprint"),
    )


def library_status_update(libraries: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """New status per library; ``deleted_at`` is set only for deleted and cleared otherwise.

    Of several changes of one library the last by ``batch_order`` counts.
    """
    new = one_change(changes, ["library_id"]).select("library_id", F.col("status").alias("new_status"))
    changed = F.col("new_status").isNotNull()
    return libraries.join(new, "library_id", "left").withColumns(
        {
            "status": F.coalesce("new_status", "status"),
            "deleted_at": F.when(
                changed, F.when(F.col("new_status") == "deleted", as_of)
            ).otherwise(F.col("deleted_at")),
        }
    ).drop("new_status")


def probe_fields(probe: Column) -> dict[str, Column]:
    """Fields of a probe result: the first video stream, else the first audio stream, else none;
    duration of the container before that of the stream."""
    of_type = lambda t: F.try_element_at(
        F.filter(probe["streams"], lambda s: s["codec_type"] == t), F.lit(1)
    )
    video, audio = of_type("video"), of_type("audio")
    pick = lambda f: F.when(video.isNotNull(), video[f]).otherwise(audio[f])
    some = lambda c: F.when(c != "", c)
    return {
        "duration_seconds": F.coalesce(
            some(probe["format"]["duration"]), some(pick("duration"))
        ).cast("double"),
        "width": pick("width"),
        "height": pick("height"),
        "codec": pick("codec_name"),
    }


PROBE_SCHEMA = (
    "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,"
    "duration:string>>,format:struct<duration:string>>"
)


def apply_probe_metadata(files: DataFrame, probes: DataFrame) -> DataFrame:
    """Probe results (file_id, probe_json) written onto their files, which become probed.

    Of several probes of one file the last by ``batch_order`` counts.
    """
    parsed = one_change(probes, ["file_id"]).select("file_id", F.from_json("probe_json", PROBE_SCHEMA).alias("probe"))
    fields = parsed.select(
        "file_id", F.lit(True).alias("_hit"),
        *[c.alias(f"n_{name}") for name, c in probe_fields(F.col("probe")).items()],
    )
    joined = files.join(fields, "file_id", "left")
    hit = F.col("_hit").isNotNull()
    known = set(files.columns)
    old = lambda n, t: F.col(n) if n in known else F.lit(None).cast(t)
    types = {"duration_seconds": "double", "width": "int", "height": "int", "codec": "string"}
    updated = {
        n: F.when(hit, F.col(f"n_{n}")).otherwise(old(n, t)) for n, t in types.items()
    }
    updated["index_status"] = F.when(hit, "probed").otherwise(F.col("index_status"))
    return joined.withColumns(updated).drop("_hit", *[f"n_{n}" for n in types])


# --- purge and rollover ---------------------------------------------------------------------------


PURGED_ASSET_TYPES = ["image", "video_frame", "caption"]


def purge_files(
    purges: DataFrame, files: DataFrame, assets: DataFrame, refs: DataFrame, scenes: DataFrame
) -> dict[str, DataFrame]:
    """Snapshots after purging the files in ``purges`` (file_id), and a report per file.

    Refs, scenes and all assets but text chunks go. The generation rises only for a file still
    ``purge_queued``, so repeating a purge changes nothing more.
    """
    keys = purges.select("file_id").distinct()
    doomed = F.col("asset_type").isin(PURGED_ASSET_TYPES)
    marked = files.join(keys.withColumn("_purge", F.lit(True)), "file_id", "left")
    queued = F.col("_purge").isNotNull() & (F.col("index_status") == "purge_queued")
    new_files = marked.withColumns(
        {
            "index_generation": F.when(queued, F.col("index_generation") + 1).otherwise(
                F.col("index_generation")
            ),
            "index_status": F.when(queued, "pending").otherwise(F.col("index_status")),
        }
    )
    count = lambda df, name: df.join(keys, "file_id", "left_semi").groupBy(
        "file_id"
    ).agg(F.count(F.lit(1)).alias(name))
    report = new_files.filter("_purge").select("file_id", "index_generation")
    for part, name in [
        (refs, "vector_refs_deleted"), (assets.filter(doomed), "assets_deleted"),
        (scenes, "scenes_deleted"),
    ]:
        report = report.join(count(part, name), "file_id", "left")
    return {
        "files": new_files.drop("_purge"),
        "assets": assets.join(
            keys.withColumn("_purge", F.lit(True)), "file_id", "left"
        ).filter(F.col("_purge").isNull() | ~doomed).drop("_purge"),
        "refs": refs.join(keys, "file_id", "left_anti"),
        "scenes": scenes.join(keys, "file_id", "left_anti"),
        "report": report.fillna(0),
        "jobs": keys.select(
            F.lit("index_media").alias("job_type"), "file_id",
            F.lit(C.DEFAULT_PROFILE).alias("index_profile"),
        ),
    }


def points_to_delete(purges: DataFrame, refs: DataFrame) -> DataFrame:
    """Points of purged files per collection, as rows (a collection's list has no bound)."""
    return refs.join(purges.select("file_id").distinct(), "file_id", "left_semi").select(
        "collection", "file_id", "point_id"
    )


def model_rollover(refs: DataFrame, collection: str, model_name: str, model_version: str,
                   vector_kind: str, vector_dim: int) -> DataFrame:
    """Refs of a collection reset to a new model: new point id, pending again."""
    mine = F.col("collection") == collection
    swap = lambda name, value: F.when(mine, value).otherwise(F.col(name))
    new_id = ids.point_id(
        F.col("asset_id"), F.lit(collection), F.lit(model_name), F.lit(model_version),
        F.lit(vector_kind), F.col("content_hash"),
    )
    return refs.withColumns(
        {
            "point_id": swap("point_id", new_id) if dict(refs.dtypes)["point_id"] == "string"
            else F.when(mine, new_id).otherwise(F.col("point_id").cast("string")),
            "model_name": swap("model_name", F.lit(model_name)),
            "model_version": swap("model_version", F.lit(model_version)),
            "vector_kind": swap("vector_kind", F.lit(vector_kind)),
            "vector_dim": swap("vector_dim", F.lit(vector_dim)),
            "distance": swap("distance", F.lit(C.DISTANCE)),
            "status": swap("status", F.lit("pending")),
        }
    )


# --- status propagation -----------------------------------------------------------------------


def indexed_backfill(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Live files with at least one indexed ref become indexed."""
    has_ref = refs.filter(F.col("status") == "indexed").select("file_id").distinct()
    joined = files.join(has_ref.withColumn("_has", F.lit(True)), "file_id", "left")
    promote = F.col("_has").isNotNull() & ~F.col("is_deleted")
    return joined.withColumn(
        "index_status", F.when(promote, "indexed").otherwise(F.col("index_status"))
    ).drop("_has")


def superseded_captions(files: DataFrame, assets: DataFrame) -> DataFrame:
    """Old-format captions of videos whose every live segment has a scene caption.

    assets: asset_id, file_id, asset_type, scene_id, prompt_version, is_stale.
    """
    live = assets.filter(~F.col("is_stale"))
    captions = live.filter(F.col("asset_type") == "caption")
    current = captions.filter(F.col("prompt_version") == C.SCENE_PROMPT)
    uncovered = live.filter(F.col("asset_type") == "video_segment").join(
        current.select("file_id", "scene_id").distinct(), ["file_id", "scene_id"], "left_anti"
    )
    ready = (
        files.filter(F.col("media_type") == "video")
        .select("file_id")
        .join(current.select("file_id"), "file_id", "left_semi")
        .join(uncovered.select("file_id"), "file_id", "left_anti")
    )
    return captions.filter(F.col("prompt_version") == C.IMAGE_PROMPT).join(
        ready, "file_id", "left_semi"
    )


def mark_superseded(
    superseded: DataFrame, assets: DataFrame, refs: DataFrame
) -> dict[str, DataFrame]:
    """Effects of superseded captions (asset_id): their refs become stale, and the metadata of their
    assets says why."""
    gone = superseded.select("asset_id").distinct().withColumn("_gone", F.lit(True))
    hit = F.col("_gone").isNotNull()
    reason = F.to_json(F.struct(
        F.lit(True).alias("stale"), F.lit(C.SUPERSEDED_REASON).alias("stale_reason")
    ))
    patched = F.when(hit, json_patch(F.col("metadata_json"), reason)).otherwise(F.col("metadata_json"))
    return {
        "assets": assets.join(gone, "asset_id", "left").withColumn("metadata_json", patched).drop("_gone"),
        "refs": refs.join(gone, "asset_id", "left").withColumn(
            "status", F.when(hit, "stale").otherwise(F.col("status"))
        ).drop("_gone"),
    }


# --- points ---------------------------------------------------------------------------------------


def vector_points(refs: DataFrame, assets: DataFrame, files: DataFrame, vectors: DataFrame):
    """Points to write: id, vector and payload; of several vectors for one point the last wins.

    vectors: collection, point_id, vector, batch_order.
    """
    newest = last_per_key(vectors, ["collection", "point_id"], ["batch_order"])
    asset = assets.select(
        "asset_id", "asset_type", "scene_id", "start_s", "end_s", "frame_time_s", "metadata_json"
    )
    joined = (
        newest.join(refs, ["collection", "point_id"])
        .join(asset, "asset_id")
        .join(files.select("file_id", "media_type"), "file_id")
    )
    meta = lambda k: F.get_json_object("metadata_json", f"$.{k}").alias(k)
    payload = F.struct(
        "asset_id", "file_id", "library_id", "media_type", "asset_type",
        F.col("start_s").alias("start_time_seconds"), F.col("end_s").alias("end_time_seconds"),
        F.col("frame_time_s").alias("frame_time_seconds"), "scene_id",
        meta("source"), meta("prompt_version"), "model_name", "model_version", "vector_kind",
        "content_hash", "index_profile",
    )
    return joined.select("collection", "point_id", "vector", payload.alias("payload"))


def apply_embeddings(
    refs: DataFrame, vectors: DataFrame, files: DataFrame, tolerance: float = 1e-3
) -> dict[str, DataFrame]:
    """Pending refs that got a good vector become indexed, and so do their live files.

    vectors: asset_id, model_name, vector, and where known collection and model_version, which then
    belong to the key; of several for one key the last by ``batch_order`` counts. A vector of the
    wrong size, of length zero or not of unit length is a reject, with its ``problem``. ``points`` are
    the vectors to write (collection, point_id, vector).
    """
    keys = ["asset_id", "model_name"] + [c for c in ("collection", "model_version") if c in vectors.columns]
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    got = one_change(vectors, keys).select(
        *keys, "vector", F.size("vector").alias("n_dim"), length.alias("norm"), F.lit(True).alias("_got")
    )
    problem = (
        F.when(F.col("_got").isNull(), F.lit(None))
        .when(F.col("n_dim").isNull() | (F.col("n_dim") != F.col("vector_dim")), "dimension")
        .when(F.coalesce(F.col("norm") == 0, F.lit(True)), "zero_norm")
        .when(F.isnan("norm") | (F.abs(F.col("norm") - 1) > tolerance), "not_unit")
    )
    joined = refs.join(got, keys, "left").withColumn("problem", problem)
    usable = (
        F.col("_got").isNotNull() & F.col("problem").isNull() & F.col("status").isin("pending", "indexed")
    )
    added = ["vector", "n_dim", "norm", "_got", "problem"]
    new_refs = joined.withColumn(
        "status", F.when(usable, "indexed").otherwise(F.col("status"))
    ).drop(*added)
    return {
        "refs": new_refs,
        "points": joined.filter(usable).select("collection", "point_id", "vector"),
        "rejects": joined.filter("problem IS NOT NULL").drop("vector", "_got"),
        "files": indexed_backfill(files, new_refs),
    }

"""Scored points joined back to catalogue facts, behind staleness and generation guards.

Only ids and scores arrive here (top-k comes first), so the fact tables meet a small left side and
AQE decides at run time whether that side is broadcast or shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery import constants as C


def active(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.filter(F.col(column).isNull())


def only_in(df: DataFrame, column: str, allowed: Sequence | DataFrame | None) -> DataFrame:
    """Optional membership filter; an empty list filters nothing. A table filters by semi join."""
    if isinstance(allowed, DataFrame):
        return df.join(allowed.select(column).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(list(allowed))) if allowed else df


def json_text(column: Column, key: str) -> Column:
    return F.get_json_object(column, f"$.{key}")


def is_stale(metadata: Column) -> Column:
    """True when ``stale`` is set; a missing key counts as false."""
    return F.coalesce(json_text(metadata, "stale"), F.lit("false")) == "true"


def path_contains(df: DataFrame, text: str, column: str = "relative_path") -> DataFrame:
    """Case-insensitive LIKE; ``%`` and ``_`` in the text stay wildcards."""
    return df.filter(F.col(column).ilike(f"%{text}%"))


def guard_columns() -> dict[str, Column]:
    """Reject conditions on a row of ``joined_facts``; a point must pass them all."""
    video = F.col("media_type") == "video"
    with_scene = F.col("scene_id").isNotNull()
    prompt = F.coalesce(json_text(F.col("metadata_json"), "prompt_version"), F.lit(""))
    return {
        "not_indexed": F.col("ref_status") != "indexed",
        "stale": is_stale(F.col("metadata_json")),
        "no_scene": video & ~with_scene,
        "old_generation": video
        & with_scene
        & ~F.col("scene_generation").eqNullSafe(F.col("index_generation")),
        "old_caption": video
        & (F.col("asset_type") == "caption")
        & (prompt != C.SCENE_PROMPT),
        "deleted_file": F.col("file_deleted"),
        "deleted_library": F.col("library_deleted"),
    }


def joined_facts(
    points: DataFrame, refs: DataFrame, assets: DataFrame, files: DataFrame,
    libraries: DataFrame, scenes: DataFrame,
) -> DataFrame:
    """points (collection, point_id, …) with the facts the guards and the result need."""
    ref = refs.select(
        "collection", "point_id", "asset_id", "file_id", "library_id",
        F.col("status").alias("ref_status"),
    )
    asset = assets.select(
        "asset_id", "asset_type", "scene_id", F.col("start_s").alias("asset_start"),
        F.col("end_s").alias("asset_end"), "frame_time_s", "text_content", "metadata_json",
    )
    file = files.select(
        "file_id", "media_type", "path", "index_generation",
        F.col("is_deleted").alias("file_deleted"),
    )
    library = libraries.select("library_id", F.col("is_deleted").alias("library_deleted"))
    scene = scenes.select(
        "scene_id", F.col("start_s").alias("scene_start"), F.col("end_s").alias("scene_end"),
        F.col("index_generation").alias("scene_generation"),
    )
    return (
        points.join(ref, ["collection", "point_id"])
        .join(asset, "asset_id")
        .join(file, "file_id")
        .join(library, "library_id")
        .join(scene, "scene_id", "left")
    )


def passes_guards() -> Column:
    rejected = F.lit(False)
    for condition in guard_columns().values():
        rejected = rejected | condition
    return ~rejected


def guard_reject_counts(facts: DataFrame) -> DataFrame:
    """Rejected rows per collection and guard (a row can fail several)."""
    counts = [F.count_if(c).alias(name) for name, c in guard_columns().items()]
    return facts.groupBy("collection").agg(F.count(F.lit(1)).alias("n_rows"), *counts)


def play_window(df: DataFrame) -> DataFrame:
    """start_s/end_s: the scene's bounds for a video scene, else the asset's, else its frame time."""
    scened = (F.col("media_type") == "video") & F.col("scene_id").isNotNull()
    return df.withColumns(
        {
            "start_s": F.when(scened, F.col("scene_start")).otherwise(
                F.coalesce("asset_start", "frame_time_s")
            ),
            "end_s": F.when(scened, F.col("scene_end")).otherwise(
                F.coalesce("asset_end", "frame_time_s")
            ),
        }
    )


def frame_time(frame: Column, start: Column, end: Column) -> Column:
    return F.coalesce(frame, (start + end) / 2, F.lit(0.0))


def vector_reason(collection: Column) -> Column:
    return F.when(collection == C.CAPTION_CHANNEL, "caption_match").otherwise("vector_match")


def hydrate(facts: DataFrame) -> DataFrame:
    """Guarded rows with play window, caption text and reason."""
    kept = play_window(facts.filter(passes_guards()))
    caption = F.col("asset_type") == "caption"
    return kept.withColumns(
        {
            "reason": vector_reason(F.col("collection")),
            "caption_text": F.when(caption, F.col("text_content")),
            "prompt_version": json_text(F.col("metadata_json"), "prompt_version"),
        }
    ).drop("asset_start", "asset_end", "scene_start", "scene_end")


def source_rank(hydrated: DataFrame) -> DataFrame:
    """Contiguous rank per channel after the filters; a channel holds at most its depth."""
    window = Window.partitionBy("query_id", "collection").orderBy(
        F.desc("score"), F.asc("point_id")
    )
    return hydrated.withColumn("source_rank", F.row_number().over(window).cast("bigint"))


def redacted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop local paths and texts before export; unknown names are ignored."""
    return df.drop(*columns)


def redact_nested(df: DataFrame, array: str, fields: Sequence[str]) -> DataFrame:
    """Drop fields from the structs of an array column."""
    return df.withColumn(array, F.transform(array, lambda item: item.dropFields(*fields)))


def selected_channels(requests: DataFrame, captions_enabled: bool = True) -> DataFrame:
    """Which collections run per request. requests: query_id, media_types array (empty = all).

    A request that asks only for types no channel serves gets no rows.
    """
    names = [c for c in C.COLLECTIONS if captions_enabled or c != C.CAPTION_CHANNEL]
    serves = lambda c: F.array(
        *[F.lit(t) for t in C.COLLECTION_REGISTRY[c]["media_types"]]
    )
    chosen = [
        F.when(
            (F.size("media_types") == 0) | F.arrays_overlap(F.col("media_types"), serves(c)), c
        )
        for c in names
    ]
    return requests.select(
        "query_id", F.explode(F.array_compact(F.array(*chosen))).alias("collection")
    )

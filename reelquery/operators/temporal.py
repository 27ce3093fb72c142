"""Scenes, frames and transcript chunks: ordered work per file.

A file's rows may be many, so running totals go through ``OrderedScan`` and the transcript fold
works on short blocks of a file rather than on the file as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.functions import identifiers as ids
from reelquery.functions.formatting import fmt_g
from reelquery.operators import chunk_tasks
from reelquery.operators.ordered import OrderedScan, dealt, measured, numbered
from reelquery.session import checkpointed

FOLD_BLOCK = 512


# --- scenes -----------------------------------------------------------------------------------


def cumulative_bounds(durations: DataFrame, key: str = "file_id") -> DataFrame:
    """Ordered durations (seq, d) as (start_s, end_s)."""
    scan = OrderedScan([key], ["seq"], sums={"end_s": F.col("d")})
    return scan.run(durations).withColumn("start_s", F.col("end_s") - F.col("d")).drop("d")


def boundary_problems(
    scenes: DataFrame, files: DataFrame, key: str = "file_id", large: bool | None = None
) -> DataFrame:
    """Every scene with the first rule it breaks (NULL = fine).

    scenes: file_id, seq, start_s, end_s; files: file_id, duration_seconds.
    """
    scanned = OrderedScan([key], ["seq"], previous={"previous_end": F.col("end_s")}).run(
        scenes, large
    )
    joined = scanned.join(files.select(key, "duration_seconds"), key, "left")
    finite = lambda c: ~(F.isnan(c) | (F.abs(c) == float("inf")))
    start, end, tolerance = F.col("start_s"), F.col("end_s"), C.BOUNDARY_TOLERANCE
    return joined.withColumn(
        "problem",
        F.when(F.col("duration_seconds").isNull(), "duration_missing")
        .when(~(finite(start) & finite(end)), "not_finite")
        .when(end <= start, "not_positive")
        .when((start < 0) | (end > F.col("duration_seconds") + tolerance), "outside_file")
        .when(start < F.col("previous_end") - tolerance, "overlap"),
    )


def whole_file_scene(cuts: DataFrame, files: DataFrame) -> DataFrame:
    """Files without any cut get one scene over their whole duration."""
    whole = files.join(cuts.select("file_id").distinct(), "file_id", "left_anti").select(
        "file_id", F.lit(1).cast("bigint").alias("seq"), F.lit(0.0).alias("start_s"),
        F.col("duration_seconds").alias("end_s"),
    )
    return cuts.select("file_id", "seq", "start_s", "end_s").unionByName(whole)


def merge_short_scenes(
    cuts: DataFrame, min_seconds: float = C.SCENE_MIN_SECONDS, large: bool | None = None
) -> DataFrame:
    """Scenes shorter than ``min_seconds`` join the one before; overlaps are then compacted.

    Islands: every long scene opens one and the short scenes after it extend it. Short scenes at
    the start form an island of their own, except that a single one joins what follows. cuts:
    file_id, seq, start_s, end_s with starts in order.
    """
    valid = cuts.filter(F.col("end_s") > F.col("start_s")).select(
        "file_id", "seq", "start_s", "end_s"
    )
    if large is None:
        valid, large, _ = measured(valid, ["file_id"])
    long_one = (F.col("end_s") - F.col("start_s") >= min_seconds).cast("bigint")
    islands = (
        OrderedScan(["file_id"], ["seq"], sums={"island": long_one})
        .run(valid, large)
        .groupBy("file_id", "island")
        .agg(
            F.min_by("start_s", "seq").alias("start_s"),
            F.max_by("end_s", "seq").alias("end_s"),
            F.min_by("end_s", "seq").alias("first_end"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    # A single leading short scene reaches to the end of its successor, so it overlaps that one.
    reach = (
        OrderedScan(["file_id"], ["island"], following={"next_end": F.col("first_end")})
        .run(islands, large)
        .withColumn(
            "end_s",
            F.when(
                (F.col("island") == 0) & (F.col("n") == 1), F.greatest("end_s", "next_end")
            ).otherwise(F.col("end_s")),
        )
    )
    seen = OrderedScan(["file_id"], ["island"], maxima={"max_end": F.col("end_s")}).run(
        reach.select("file_id", "island", "start_s", "end_s"), large
    )
    before = OrderedScan(["file_id"], ["island"], previous={"covered": F.col("max_end")}).run(
        seen, large
    )
    opens = (F.col("covered").isNull() | (F.col("start_s") >= F.col("covered"))).cast("bigint")
    grouped = OrderedScan(["file_id"], ["island"], sums={"scene_no": opens}).run(before, large)
    return grouped.groupBy("file_id", "scene_no").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")
    )


def scene_count_guard(scenes: DataFrame, files: DataFrame, limit: int = C.SCENE_MAX_COUNT):
    """Error code per file: no usable scene, or more than ``limit`` scenes."""
    counts = scenes.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_scenes"))
    n = F.coalesce("n_scenes", F.lit(0))
    return files.select("file_id").join(counts, "file_id", "left").select(
        "file_id", n.cast("bigint").alias("n_scenes"),
        F.when(n == 0, "INVALID_SCENE_BOUNDARIES").when(n > limit, "SCENE_COUNT_EXCEEDED").alias(
            "error_code"
        ),
    )


def scene_key(scene_no: Column, part: Column, parts: Column) -> Column:
    """``scene-0001`` or ``scene-0001-part-002``; wider numbers are not cut."""
    pad = lambda c, width: F.when(
        F.length(c.cast("string")) < width, F.lpad(c.cast("string"), width, "0")
    ).otherwise(c.cast("string"))
    base = F.concat(F.lit("scene-"), pad(scene_no, 4))
    return F.when(parts == 1, base).otherwise(F.concat(base, F.lit("-part-"), pad(part, 3)))


def split_long_scenes(scenes: DataFrame, max_seconds: float = C.SCENE_MAX_SECONDS) -> DataFrame:
    """Windows of at most ``max_seconds`` with their part number and stable key."""
    if max_seconds <= 0:
        raise ValueError("max_seconds must be positive")
    length = F.col("end_s") - F.col("start_s")
    parts = F.greatest(F.lit(1), F.ceil(length / max_seconds)).cast("bigint")
    split = scenes.withColumn("part_count", parts).withColumn(
        "part", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("part_count")))
    )
    start = F.col("start_s") + (F.col("part") - 1) * max_seconds
    return split.select(
        "file_id", "scene_no", "part", "part_count",
        scene_key(F.col("scene_no"), F.col("part"), F.col("part_count")).alias("scene_key"),
        start.alias("start_s"), F.least(start + max_seconds, F.col("end_s")).alias("end_s"),
    )


def sample_times(
    start: Column, end: Column, interval: float = C.FRAME_INTERVAL_SECONDS
) -> Column:
    """Midpoints of slices of at most ``interval`` seconds; nothing for an empty window."""
    if interval <= 0:
        raise ValueError("interval must be positive")
    slices = F.ceil((end - start) / interval).cast("int")
    times = F.transform(
        F.sequence(F.lit(0), slices - 1),
        lambda i: (start + i * interval + F.least(start + (i + 1) * interval, end)) / 2,
    )
    return F.when(end > start, times).otherwise(F.array().cast("array<double>"))


def frames(windows: DataFrame, interval: float = C.FRAME_INTERVAL_SECONDS) -> DataFrame:
    """One row per frame with its 1-based index; the first represents the scene."""
    times = F.posexplode(sample_times(F.col("start_s"), F.col("end_s"), interval))
    return windows.select("*", times.alias("i", "frame_time_s")).select(
        *windows.columns, (F.col("i") + 1).cast("bigint").alias("frame_index"), "frame_time_s",
        (F.col("i") == 0).alias("is_representative"),
    )


def index_video(
    cuts: DataFrame, files: DataFrame, profile: str = C.DEFAULT_PROFILE, large: bool | None = None
) -> dict[str, DataFrame]:
    """Scenes, frame assets and pending refs of video files, all with deterministic ids.

    Files whose scenes break a boundary rule, or that have too many, are reported in ``rejects``
    and produce nothing. A ref names its asset and that one's scene. cuts: file_id, seq, start_s, end_s;
    files: file_id, library_id, duration_seconds, index_generation.
    """
    known = files.filter(F.col("duration_seconds").isNotNull())
    cut_scenes = whole_file_scene(cuts, known).join(known.select("file_id"), "file_id", "left_semi")
    rows = 0
    if large is None:
        cut_scenes, large, rows = measured(cut_scenes, ["file_id"])
    # Scenes are few next to cuts and are read by every check below: computed once.
    merged = checkpointed(merge_short_scenes(cut_scenes, large=large))
    checked = boundary_problems(merged.withColumnRenamed("scene_no", "seq"), files, large=large)
    bad_bounds = (
        checked.filter(F.col("problem").isNotNull())
        .groupBy("file_id")
        .agg(F.min_by("problem", "seq").alias("problem"))
        .withColumn("error_code", F.lit("INVALID_SCENE_BOUNDARIES"))
    )
    counted = scene_count_guard(merged, known).filter(F.col("error_code").isNotNull()).select(
        "file_id", F.lit("scene_count").alias("problem"), "error_code"
    )
    missing = files.filter(F.col("duration_seconds").isNull()).select(
        "file_id", F.lit("duration_missing").alias("problem"),
        F.lit("VIDEO_DURATION_MISSING").alias("error_code"),
    )
    # A boundary problem is found before a file's scenes are counted.
    rejects = checkpointed(
        bad_bounds.unionByName(counted)
        .groupBy("file_id")
        .agg(
            F.min_by(
                F.struct("problem", "error_code"), F.col("problem") == "scene_count"
            ).alias("r")
        )
        .select("file_id", "r.*")
        .unionByName(missing)
    )
    good = merged.join(rejects.select("file_id"), "file_id", "left_anti")
    if not large:
        # Scenes are dealt by file before they become frames: counts per file or scene move no frame.
        good = dealt(good, ["file_id"], rows)
    fingerprint = ids.strategy_fingerprint(
        F.lit(C.SCENE_THRESHOLD), F.lit(C.SCENE_MIN_SECONDS), F.lit(C.SCENE_MAX_SECONDS),
        F.lit(C.FRAME_INTERVAL_SECONDS),
    )
    scenes = (
        split_long_scenes(good)
        .join(files.select("file_id", "library_id", "index_generation"), "file_id")
        .withColumns(
            {
                "scene_id": ids.uuid5(
                    F.concat_ws("|", F.col("file_id").cast("string"), "scene_key",
                                F.col("index_generation").cast("string"))
                ),
                "detection_strategy": F.lit("scene_detection"),
                "strategy_fingerprint": fingerprint,
            }
        )
    )
    name, version, dim = C.COLLECTION_REGISTRY["video_frame_vectors"]["model"]
    kind = C.COLLECTION_REGISTRY["video_frame_vectors"]["vector_kind"]
    content_hash = F.concat(
        F.col("file_id").cast("string"), F.lit(":scene:"), F.col("scene_key"), F.lit(":"),
        fmt_g(F.col("frame_time_s")),
    )
    assets = frames(scenes).withColumn("content_hash", content_hash).withColumn(
        "asset_id",
        ids.uuid5(F.concat_ws("|", F.lit("video_frame"), "scene_id", "content_hash")),
    )
    refs = assets.select(
        "asset_id", "file_id", "library_id", F.lit("video_frame_vectors").alias("collection"),
        ids.point_id(
            F.col("asset_id"), F.lit("video_frame_vectors"), F.lit(name), F.lit(version),
            F.lit(kind), F.col("content_hash"),
        ).alias("point_id"),
        F.lit(name).alias("model_name"), F.lit(version).alias("model_version"),
        F.lit(kind).alias("vector_kind"), F.lit(dim).alias("vector_dim"),
        F.lit(C.DISTANCE).alias("distance"), "content_hash", F.lit(profile).alias("index_profile"),
        F.lit("pending").alias("status"), "scene_id", "scene_key",
    )
    return {"scenes": scenes, "assets": assets, "refs": refs, "rejects": rejects}


def index_image(files: DataFrame, profile: str = C.DEFAULT_PROFILE) -> DataFrame:
    """One image asset and its pending ref per image file. files: file_id, library_id, path,
    media_type, content_hash."""
    name, version, dim = C.COLLECTION_REGISTRY["image_vectors"]["model"]
    kind = C.COLLECTION_REGISTRY["image_vectors"]["vector_kind"]
    asset_id = ids.uuid5(F.concat_ws("|", F.lit("image"), F.col("file_id").cast("string"), "path"))
    return (
        files.filter(F.col("media_type") == "image")
        .withColumn("asset_id", asset_id)
        .select(
            "asset_id", "file_id", "library_id", F.lit("image").alias("asset_type"), "path",
            "content_hash", F.lit("image_vectors").alias("collection"),
            ids.point_id(
                F.col("asset_id"), F.lit("image_vectors"), F.lit(name), F.lit(version),
                F.lit(kind), F.col("content_hash"),
            ).alias("point_id"),
            F.lit(dim).alias("vector_dim"), F.lit(profile).alias("index_profile"),
            F.lit("pending").alias("status"),
        )
    )


def index_run_counts(assets: DataFrame, refs: DataFrame, scenes: DataFrame) -> DataFrame:
    """Assets, refs and scenes created per file by one indexing run."""
    part = lambda df, name: df.groupBy("file_id").agg(F.count(F.lit(1)).alias(name))
    joined = (
        part(scenes, "scenes_detected")
        .join(part(assets, "assets_created"), "file_id", "full_outer")
        .join(part(refs, "vector_refs_created"), "file_id", "full_outer")
    )
    return joined.fillna(0).withColumn("frames_created", F.col("assets_created"))


# --- captions ---------------------------------------------------------------------------------


def uniform_pick(items: Column, most: int) -> Column:
    """At most ``most`` evenly spaced items including both ends; the middle one when most <= 1."""
    n = F.size(items)
    if most <= 1:
        few = F.when(n > 0, F.array(F.try_element_at(items, F.floor(n / 2).cast("int") + 1)))
        return F.when(n <= most, items).otherwise(few)
    spots = F.array_distinct(
        F.transform(
            F.sequence(F.lit(0), F.lit(most - 1)),
            lambda i: F.rint(i * (n - 1) / (most - 1)).cast("int"),
        )
    )
    picked = F.transform(spots, lambda i: F.try_element_at(items, i + 1))
    return F.when(n <= most, items).otherwise(picked)


def scene_frames(assets: DataFrame) -> DataFrame:
    """Live frames of each scene with their place in time order."""
    stale = F.coalesce(F.get_json_object("metadata_json", "$.stale"), F.lit("false")) == "true"
    live = assets.filter(
        (F.col("asset_type") == "video_frame") & F.col("scene_id").isNotNull() & ~stale
    )
    return numbered(
        live.select("scene_id", "file_id", "frame_time_s", "asset_id"),
        ["scene_id"], ["frame_time_s", "asset_id"], "frame_no",
    )


def pick_frames(ordered_frames: DataFrame, most: int = C.CAPTION_MAX_FRAMES) -> DataFrame:
    """``uniform_pick`` over rows: at most ``most`` frames per scene, whatever its length."""
    sizes = ordered_frames.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    if most <= 1:
        spots = F.when(n <= most, F.array(F.lit(0))).otherwise(F.array(F.floor(n / 2).cast("int")))
    else:
        spaced = F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), F.lit(most - 1)),
                lambda i: F.rint(i * (n - 1) / (most - 1)).cast("int"),
            )
        )
        spots = F.when(n <= most, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(spaced)
    wanted = sizes.select("scene_id", F.explode(spots).alias("spot")).select(
        "scene_id", (F.col("spot") + 1).cast("bigint").alias("frame_no")
    )
    return ordered_frames.join(wanted, ["scene_id", "frame_no"])


def caption_inputs(
    ordered_frames: DataFrame, captions: DataFrame, max_frames: int = C.CAPTION_MAX_FRAMES
) -> DataFrame:
    """Frames to caption per scene and the caption asset with its pending ref.

    captions: scene_id, caption_text (model output, an input here). A frame without a time is an
    error, an empty caption as well.
    """
    if not 1 <= max_frames <= 12:
        raise ValueError("max_frames must be between 1 and 12")
    model_name, model_version, dim = C.CAPTION_MODEL
    kind = C.COLLECTION_REGISTRY[C.CAPTION_CHANNEL]["vector_kind"]
    timed = F.when(F.col("frame_time_s").isNull(), F.raise_error(
        F.concat(F.lit("frame without a time: "), F.col("asset_id").cast("string"))
    ).cast("double")).otherwise(F.col("frame_time_s"))
    picked = (
        pick_frames(ordered_frames, max_frames)
        .withColumn("frame_time_s", timed)
        .groupBy("scene_id", "file_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("frame_no", "frame_time_s", "asset_id"))
            ).alias("picked")
        )
    )
    text = F.regexp_replace("caption_text", r"^\s+|\s+$", "")
    said = captions.select("scene_id", F.when(text == "", F.raise_error(
        F.concat(F.lit("empty caption for scene "), F.col("scene_id").cast("string"))
    )).otherwise(text).alias("caption_text"))
    hashed = picked.join(said, "scene_id").withColumn(
        "content_hash",
        ids.caption_fingerprint(
            F.transform("picked", lambda f: f["asset_id"]),
            F.transform("picked", lambda f: f["frame_time_s"]),
            F.lit(C.SCENE_PROMPT), F.lit(C.CAPTION_VLM[1]), F.col("caption_text"),
        ),
    ).withColumn(
        "asset_id", ids.uuid5(F.concat_ws("|", F.lit("caption"), "scene_id", "content_hash"))
    )
    return hashed.select(
        "scene_id", "file_id", F.size("picked").cast("bigint").alias("n_frames"),
        F.transform("picked", lambda f: f["frame_time_s"]).alias("frame_times"),
        "caption_text", "content_hash", "asset_id",
        ids.point_id(
            F.col("asset_id"), F.lit(C.CAPTION_CHANNEL), F.lit(model_name), F.lit(model_version),
            F.lit(kind), F.col("content_hash"),
        ).alias("point_id"),
        F.lit(dim).alias("vector_dim"), F.lit("pending").alias("status"),
    )


# --- transcript chunks ---------------------------------------------------------------------------


def chunk_transcript(
    segments: DataFrame, min_seconds: float = C.CHUNK_MIN_SECONDS,
    max_seconds: float = C.CHUNK_MAX_SECONDS, block: int = FOLD_BLOCK, large: bool | None = None,
) -> DataFrame:
    """Greedy chunks: one closes once it lasts ``min_seconds`` and the next segment would take it
    past ``max_seconds``, or at the end of the file.

    Where a chunk begins depends on where the one before ended. Files are cut into blocks of ``block``
    segments; each block says which states (open chunks) it can hand on, wherever a chunk begins in it,
    and maps the states it may be entered in to those behind it. The maps are composed by doubling, so
    the states in which a file's blocks are really entered are known after as many rounds as the
    number of blocks has binary digits; then each block is cut on its own. A chunk that spans whole blocks
    takes a round more for each of them. segments: file_id, seq, start_s, end_s, segment_text.
    """
    text = F.regexp_replace("segment_text", r"^\s+|\s+$", "")
    valid = (
        segments.select("file_id", F.col("seq").cast("bigint").alias("seq"), "start_s", "end_s", text.alias("segment_text"))
        .filter((F.col("end_s") > F.col("start_s")) & (F.col("segment_text") != ""))
    )
    walked = OrderedScan(
        ["file_id"], ["seq"], number="rn", following={"next_end": F.col("end_s")}
    ).run(valid, large)
    blocks = checkpointed(
        walked.withColumn("block", F.floor((F.col("rn") - 1) / block))
        .groupBy("file_id", "block")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("rn", "seq", "start_s", "end_s", "next_end"))
            ).alias("items")
        )
    )
    entered = _entered_states(blocks, min_seconds, max_seconds)
    marks = _per_block(blocks.join(entered, ["file_id", "block"]), chunk_tasks.marks, chunk_tasks.MARKS, min_seconds, max_seconds)
    joined = valid.join(marks.drop("block"), ["file_id", "seq"])
    words = F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "segment_text"))), lambda s: s["segment_text"]
    )
    return joined.groupBy("file_id", "first").agg(
        F.min_by("start_s", "seq").alias("start_s"), F.max_by("end_s", "seq").alias("end_s"),
        F.count(F.lit(1)).alias("n_segments"), F.array_join(words, " ").alias("text_content"),
    ).drop("first").withColumn(
        "content_hash",
        F.concat(
            F.col("file_id").cast("string"), F.lit(":text:"), fmt_g(F.col("start_s")), F.lit(":"),
            fmt_g(F.col("end_s")),
        ),
    )


def _per_block(rows: DataFrame, task, columns: str, *limits: float) -> DataFrame:
    """Rows of ``task(batches, limits)`` behind the file and block they belong to."""
    kind = rows.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return task(batches, *limits)

    return rows.mapInArrow(run, f"file_id {kind}, block bigint, {columns}")


def _entered_states(blocks: DataFrame, *limits: float) -> DataFrame:
    """(file_id, block, rn, start_s): the state in which each block is entered; rn 0: no chunk is open."""
    node = ["file_id", "block", "rn"]
    begin = blocks.filter("block = 0").select("file_id", "block", F.lit(0).cast("bigint").alias("rn"), F.lit(0.0).alias("start_s"))
    later = blocks.filter("block > 0")
    n_blocks = later.agg(F.max("block")).first()[0]
    if n_blocks is None:
        return begin
    exits = _per_block(blocks, chunk_tasks.exits, chunk_tasks.EXITS, *limits)
    entries = exits.withColumn("block", F.col("block") + 1).unionByName(begin)
    steps, known = None, None
    while True:
        # Chunks that stay open through a whole block may enter the next in a state not met before.
        lists = entries.groupBy("file_id", "block").agg(F.collect_set(F.struct("rn", "start_s")).alias("entries"))
        new = checkpointed(_per_block(blocks.join(lists, ["file_id", "block"]), chunk_tasks.steps, chunk_tasks.STEPS, *limits))
        steps = new if steps is None else steps.unionByName(new)
        known = new.select(*node) if known is None else known.unionByName(new.select(*node))
        reached = new.select("file_id", (F.col("block") + 1).alias("block"), F.col("to_rn").alias("rn"), F.col("to_start_s").alias("start_s"))
        entries = checkpointed(
            reached.distinct().join(blocks.select("file_id", "block"), ["file_id", "block"], "left_semi").join(known, node, "left_anti")
        )
        if entries.isEmpty():
            break
    # ``jump``: where a state leads after 1, 2, 4 ... blocks; states visited so far take that jump in each round.
    visited = begin
    jump = steps.select(*node, (F.col("block") + 1).alias("to_block"), "to_rn", "to_start_s")
    for _ in range(int(n_blocks).bit_length()):
        landed = visited.select(*node).join(jump, node).select(
            "file_id", F.col("to_block").alias("block"), F.col("to_rn").alias("rn"), F.col("to_start_s").alias("start_s")
        )
        visited = checkpointed(visited.unionByName(landed))
        onward = jump.select("file_id", F.col("block").alias("from_block"), F.col("rn").alias("from_rn"),
                             F.col("to_block").alias("block"), F.col("to_rn").alias("rn"))
        jump = checkpointed(onward.join(jump, node).select(
            "file_id", F.col("from_block").alias("block"), F.col("from_rn").alias("rn"), "to_block", "to_rn", "to_start_s"
        ))
    return visited

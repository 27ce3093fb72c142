"""Candidates of several channels folded, scored and paged.

A candidate is (query_id, input_order, asset_id, file_id, media_type, path, scene_id, start_s,
end_s, best_frame_s, reasons, source_scores). Channels are cut at a depth of at most 300 before
they get here, so one query holds at most 300 candidates per channel and the ordered folds below
work on arrays of that size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.functions import scoring as S

# --- checks ---------------------------------------------------------------------------------


def reversed_window() -> Column:
    """True for a video window that ends before it starts (zero length is allowed)."""
    return F.coalesce(
        (F.col("media_type") == "video") & (F.col("end_s") < F.col("start_s")), F.lit(False)
    )


def invalid_windows(candidates: DataFrame) -> DataFrame:
    return candidates.filter(reversed_window())


def checked_windows(candidates: DataFrame) -> DataFrame:
    """Raise on a reversed window, before any weak or merged candidate could hide it.

    A filter, not a column: a column's check would be skipped for rows a later filter drops.
    """
    failure = F.raise_error(
        F.concat(F.lit("invalid video time range for asset "), F.col("asset_id").cast("string"))
    )
    return candidates.filter(
        F.when(reversed_window(), failure.cast("boolean")).otherwise(F.lit(True))
    )


def scene_conflicts(candidates: DataFrame) -> DataFrame:
    """Scenes that carry more than one positive-length window."""
    positive = F.col("end_s") > F.col("start_s")
    return (
        candidates.filter(F.col("scene_id").isNotNull() & positive)
        .groupBy("query_id", "file_id", "scene_id")
        .agg(F.count_distinct("start_s", "end_s").alias("n_bounds"))
        .filter(F.col("n_bounds") > 1)
    )


# --- one channel's rows to candidates ---------------------------------------------------------


def as_candidates(rows: DataFrame) -> DataFrame:
    """Channel rows (collection, score, reason, channel_no, channel_rank …) as candidates.

    Order: channel by channel, then the channel's own order.
    """
    return rows.select(
        "query_id",
        (F.col("channel_no") * (C.MAX_SOURCE_LIMIT + 1) + F.col("channel_rank")).alias(
            "input_order"
        ),
        "asset_id", "file_id", "media_type", "path", "scene_id", "start_s", "end_s",
        F.col("frame_time_s").alias("best_frame_s"),
        F.array("reason").alias("reasons"),
        F.create_map("collection", "score").alias("source_scores"),
    )


def weak_source_filter(candidates: DataFrame) -> DataFrame:
    """Drop weak vector sources, then candidates left with none; reasons follow what is left."""
    kept = F.map_filter("source_scores", S.keeps_source)
    before = F.col("reasons")
    reasons = F.transform(
        F.map_keys("source_scores"), lambda source: S.reason_of_source(source, before)
    )
    return (
        candidates.withColumn("source_scores", kept)
        .filter(F.size("source_scores") > 0)
        .withColumn("reasons", S.ordered_reasons(reasons))
    )


# --- folds ----------------------------------------------------------------------------------


def _strongest(scores: Column) -> Column:
    values = F.transform(
        F.map_entries(scores), lambda e: S.contribution(e["key"], e["value"])
    )
    return F.greatest(F.lit(0.0), F.array_max(values))


def _positive(c: Column) -> Column:
    return F.coalesce(c["end_s"] > c["start_s"], F.lit(False))


def _combine(left: Column, right: Column) -> Column:
    """Two merged candidates as one; the left side came first."""
    stronger = right["strength"] > left["strength"]
    same_scene = left["scene_id"].isNotNull() & (left["scene_id"] == right["scene_id"])
    same_scene = F.coalesce(same_scene, F.lit(False))
    conflict = (
        same_scene
        & _positive(left)
        & _positive(right)
        & ((left["start_s"] != right["start_s"]) | (left["end_s"] != right["end_s"]))
    )
    left_owns = (left["scene_id"].isNotNull() & right["scene_id"].isNull()) | (
        same_scene & ~(~_positive(left) & _positive(right))
    )
    right_owns = (left["scene_id"].isNull() & right["scene_id"].isNotNull()) | (
        same_scene & ~_positive(left) & _positive(right)
    )
    start = (
        F.when(left_owns, left["start_s"])
        .when(right_owns, right["start_s"])
        .otherwise(F.least(left["start_s"], right["start_s"]))
    )
    end = (
        F.when(left_owns, left["end_s"])
        .when(right_owns, right["end_s"])
        .otherwise(F.greatest(left["end_s"], right["end_s"]))
    )
    scene = F.when(left_owns, left["scene_id"]).when(right_owns, right["scene_id"])
    scores = F.map_zip_with(
        left["source_scores"], right["source_scores"], lambda _, a, b: F.greatest(a, b)
    )
    checked_end = F.when(
        conflict,
        F.raise_error(
            F.concat(F.lit("conflicting boundaries for scene "), left["scene_id"].cast("string"))
        ).cast("double"),
    ).otherwise(end)
    return F.struct(
        F.when(stronger, right["asset_id"]).otherwise(left["asset_id"]).alias("asset_id"),
        left["file_id"].alias("file_id"),
        left["media_type"].alias("media_type"),
        left["path"].alias("path"),
        scene.alias("scene_id"),
        start.alias("start_s"),
        checked_end.alias("end_s"),
        F.when(stronger, right["best_frame_s"]).otherwise(left["best_frame_s"]).alias(
            "best_frame_s"
        ),
        S.ordered_reasons(F.concat(left["reasons"], right["reasons"])).alias("reasons"),
        scores.alias("source_scores"),
        F.array_union(left["members"], right["members"]).alias("members"),
        F.greatest(left["strength"], right["strength"]).alias("strength"),
    )


def _caption_only(c: Column) -> Column:
    return (F.size(c["source_scores"]) == 1) & (
        c["reasons"] == F.array(F.lit("caption_match"))
    ) & F.map_contains_key(c["source_scores"], C.CAPTION_CHANNEL)


def _can_merge(left: Column, right: Column) -> Column:
    both_scened = left["scene_id"].isNotNull() & right["scene_id"].isNotNull()
    overlap = F.greatest(left["start_s"], right["start_s"]) < F.least(
        left["end_s"], right["end_s"]
    )
    return (
        F.when(both_scened, left["scene_id"] == right["scene_id"])
        .when(_caption_only(left) & _caption_only(right), F.lit(False))
        .otherwise(F.coalesce(overlap, F.lit(False)))
    )


def _fold(items: Column, joins) -> Column:
    """Left fold of ``items`` (structs with a merged candidate ``m``): each joins the last result
    when ``joins`` says so, else starts a new one."""

    def step(done: Column, item: Column) -> Column:
        # The pair is bound once; spelled out, its expressions would repeat at every field.
        pair = F.struct(F.try_element_at(done, F.lit(-1)).alias("last"), item["m"].alias("next"))

        def grown(p: Column) -> Column:
            joined = F.coalesce(p["last"].isNotNull() & joins(p["last"], p["next"]), F.lit(False))
            kept = F.when(joined, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
            newest = F.when(joined, _combine(p["last"], p["next"])).otherwise(p["next"])
            return F.concat(kept, F.array(newest))

        return F.transform(F.array(pair), grown)[0]

    nothing = F.slice(F.transform(items, lambda i: i["m"]), 1, 0)
    return F.aggregate(items, nothing, step)


def _with_strength(candidates: DataFrame) -> DataFrame:
    return candidates.withColumns(
        {
            "strength": _strongest(F.col("source_scores")),
            "members": F.array(F.struct("input_order", "asset_id")),
        }
    )


_MERGED = [
    "asset_id", "file_id", "media_type", "path", "scene_id", "start_s", "end_s", "best_frame_s",
    "reasons", "source_scores", "members", "strength",
]


def same_asset_merge(candidates: DataFrame) -> DataFrame:
    """Candidates of one asset folded in input order (one per channel at most)."""
    entry = F.struct("input_order", F.struct(*_MERGED).alias("m"))
    packed = (
        _with_strength(candidates)
        .withColumn("_asset", F.col("asset_id"))
        .groupBy("query_id", "_asset")
        .agg(F.array_sort(F.collect_list(entry), _by("input_order")).alias("items"))
    )
    folded = packed.withColumn("m", F.element_at(_fold(F.col("items"), lambda a, b: F.lit(True)), 1))
    # Merged ids are listed by the last place an asset came in, as later entries win there.
    last_seen = F.element_at("items", -1)["input_order"].alias("input_order")
    return folded.select(
        "query_id", F.col("items")[0]["input_order"].alias("input_order"), "m.*",
        F.array(F.struct(last_seen, F.col("_asset").alias("asset_id"))).alias("own"),
    ).drop("members").withColumnRenamed("own", "members")


def _by(*names: str):
    """Comparator over struct fields, in order."""

    def compare(a: Column, b: Column) -> Column:
        result: Column = F.lit(0)
        for name in reversed(names):
            result = F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(result)
        return result

    return compare


def window_merge(merged: DataFrame) -> DataFrame:
    """Overlapping video windows folded per (query, file) in start order.

    Not an overlap-connected grouping: once a scene gives a window its bounds they stop growing,
    two scenes never join, and two captions never join.
    """
    timed = (
        (F.col("media_type") == "video")
        & F.col("start_s").isNotNull()
        & F.col("end_s").isNotNull()
    )
    entry = F.struct("start_s", "input_order", F.struct(*_MERGED).alias("m"))
    packed = (
        merged.filter(timed)
        .withColumn("_file", F.col("file_id"))
        .groupBy("query_id", "_file")
        .agg(F.array_sort(F.collect_list(entry), _by("start_s", "input_order")).alias("items"))
    )
    folded = packed.select(
        "query_id", F.explode(_fold(F.col("items"), _can_merge)).alias("m")
    ).select("query_id", "m.*")
    others = merged.filter(~timed).select("query_id", *_MERGED)
    return others.unionByName(folded)


def scene_merge(candidates: DataFrame) -> DataFrame:
    """The equi-key case of window merging: everything with the same scene."""
    scores = F.explode("source_scores").alias("source", "score")
    long = candidates.filter(F.col("scene_id").isNotNull()).select(
        "query_id", "file_id", "scene_id", "asset_id", "start_s", "end_s", scores
    )
    return long.groupBy("query_id", "file_id", "scene_id").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"),
        F.count_distinct("asset_id").alias("n_assets"),
        F.count_distinct("source").alias("n_sources"),
        F.max(S.contribution(F.col("source"), F.col("score"))).alias("strength"),
    )


def representative(candidates: DataFrame) -> DataFrame:
    """Per (query, file, scene) the asset with the strictly largest contribution; earlier wins."""
    return (
        _with_strength(candidates)
        .groupBy("query_id", "file_id", "scene_id")
        .agg(
            F.min_by(
                F.struct("asset_id", "strength"), F.struct(-F.col("strength"), "input_order")
            ).alias("r")
        )
        .select("query_id", "file_id", "scene_id", "r.asset_id", "r.strength")
    )


def merged_ids(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct asset ids per group, each at the last place it came in."""
    places = candidates.groupBy(*keys, "asset_id").agg(F.max("input_order").alias("o"))
    packed = F.sort_array(F.collect_list(F.struct("o", "asset_id")))
    return places.groupBy(*keys).agg(
        F.transform(packed, lambda x: x["asset_id"]).alias("merged_asset_ids")
    )


def merge_scores_max(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Largest score per source over a group, as a map."""
    long = scored.select(*keys, F.explode("source_scores").alias("source", "score"))
    best = long.groupBy(*keys, "source").agg(F.max("score").alias("score"))
    return best.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "score")))).alias(
            "source_scores"
        )
    )


# --- scoring and paging ------------------------------------------------------------------------


def hybrid_score(scores: Column, reasons: Column) -> Column:
    """Weighted mean of the sources, plus a bonus for more than one reason, at least the
    strongest single source."""
    entries = F.map_entries(scores)
    add = lambda total, x: total + x
    contributed = F.aggregate(
        F.transform(entries, lambda e: S.contribution(e["key"], e["value"])), F.lit(0.0), add
    )
    weight = F.aggregate(
        F.transform(entries, lambda e: S.source_weight(e["key"])), F.lit(0.0), add
    )
    strongest = F.greatest(
        F.lit(0.0),
        F.array_max(F.transform(entries, lambda e: S.normalize_score(e["key"], e["value"]))),
    )
    mean = F.when(weight > 0, contributed / weight).otherwise(F.lit(0.0))
    bonus = F.when(F.size(F.array_distinct(reasons)) > 1, C.MULTI_SIGNAL_BONUS).otherwise(0.0)
    return S.clamp(F.greatest(mean + bonus, strongest), 0.0, 1.0)


def primary_reason(scores: Column, reasons: Column) -> Column:
    """Reason with the largest single contribution; ties: transcript, caption, vector."""
    entries = F.transform(
        F.map_entries(scores),
        lambda e: F.struct(
            S.reason_of_source(e["key"], reasons).alias("reason"),
            S.contribution(e["key"], e["value"]).alias("value"),
        ),
    )

    def strongest_of(reason: str) -> Column:
        own = F.filter(entries, lambda e: e["reason"] == reason)
        return F.coalesce(F.array_max(F.transform(own, lambda e: e["value"])), F.lit(-1.0))

    best = {reason: strongest_of(reason) for reason in C.PRIMARY_REASON_ORDER}
    top = F.greatest(*best.values())
    chosen = F.lit("vector_match")
    for reason in reversed(C.PRIMARY_REASON_ORDER):
        chosen = F.when((best[reason] == top) & (top > -1), reason).otherwise(chosen)
    return chosen


def scored(merged: DataFrame) -> DataFrame:
    ids = F.transform(F.array_sort("members"), lambda m: m["asset_id"])
    return merged.withColumns(
        {
            "score": F.round(hybrid_score(F.col("source_scores"), F.col("reasons")), 12),
            "score_kind": F.lit("hybrid_score"),
            "primary_reason": primary_reason(F.col("source_scores"), F.col("reasons")),
            "confidence": F.lit("high"),
            "merged_asset_ids": F.array_distinct(ids),
        }
    ).drop("members", "strength")


def page(results: DataFrame, requests: DataFrame | None = None, limit: int = 20, offset: int = 0):
    """Rank per query by score, file, start (missing last) and cut the page after merging.

    requests (query_id, page_limit, page_offset) gives each query its own page.
    """
    window = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.asc("file_id"), F.asc_nulls_last("start_s"), F.asc("asset_id")
    )
    ranked = results.withColumn("position", F.row_number().over(window).cast("bigint"))
    if requests is None:
        first, last = F.lit(offset), F.lit(offset + limit)
        return ranked.filter((F.col("position") > first) & (F.col("position") <= last))
    own = requests.select("query_id", "page_limit", "page_offset")
    inside = (F.col("position") > F.col("page_offset")) & (
        F.col("position") <= F.col("page_offset") + F.col("page_limit")
    )
    return ranked.join(own, "query_id").filter(inside).drop("page_limit", "page_offset")


def hybrid_results(candidates: DataFrame) -> DataFrame:
    """Checked, filtered, folded and scored candidates, not yet paged."""
    kept = weak_source_filter(checked_windows(candidates))
    return scored(window_merge(same_asset_merge(kept)))


# --- query variants -----------------------------------------------------------------------------


def normalize_variants(variants: DataFrame, max_variants: int) -> DataFrame:
    """Trim, drop empty, clamp weights, keep the largest weight per text, heaviest first.

    variants: query_id, variant_order, variant_text, weight (NULL = default), source; the row with
    source ``original`` weighs 1 and also claims every variant with its text. Ties keep the order
    in which texts first came up.
    """
    trimmed = variants.withColumn("variant_text", F.regexp_replace("variant_text", r"^\s+|\s+$", ""))
    originals = trimmed.filter(F.col("source") == "original").select(
        "query_id", F.col("variant_text").alias("original_text")
    )
    weighed = (
        trimmed.join(originals, "query_id", "left")
        .filter((F.col("source") == "original") | (F.col("variant_text") != ""))
        .withColumn("is_original", F.col("variant_text").eqNullSafe(F.col("original_text")))
        .withColumn(
            "weight",
            F.when(F.col("is_original"), 1.0).otherwise(
                S.clamp(
                    F.coalesce("weight", F.lit(C.DEFAULT_VARIANT_WEIGHT)), C.MIN_VARIANT_WEIGHT, 1.0
                )
            ),
        )
    )
    per_text = weighed.groupBy("query_id", "variant_text").agg(
        F.max("weight").alias("weight"),
        F.min("variant_order").alias("variant_order"),
        F.when(F.bool_or("is_original"), "original").otherwise("expansion").alias("source"),
    )
    window = Window.partitionBy("query_id").orderBy(F.desc("weight"), F.asc("variant_order"))
    return (
        per_text.withColumn("position", F.row_number().over(window))
        .filter(F.col("position") <= max_variants)
        .withColumn("position", F.col("position").cast("bigint"))
        .drop("variant_order")
    )


def route_variants(variants: DataFrame, mode: str) -> DataFrame:
    """(query, collection) variants. Only ``translate`` routes: visual channels take the
    translation at weight 1, captions the original; other modes pass everything on."""
    channels = F.explode(F.array(*[F.lit(c) for c in C.COLLECTIONS])).alias("collection")
    routed = variants.select("*", channels)
    if mode != "translate":
        return routed
    captions = F.col("collection") == C.CAPTION_CHANNEL
    original = F.col("source") == "original"
    return routed.filter(captions == original).withColumn(
        "weight", F.when(captions, F.col("weight")).otherwise(1.0)
    )

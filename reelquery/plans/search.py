"""Search as one lazy plan for a whole table of queries."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.functions import scoring
from reelquery.operators import hybrid, hydration, ranking, text_search, vector_search
from reelquery.session import checkpointed


@dataclass
class Catalogue:
    """The fact tables a search reads."""

    points: DataFrame
    refs: DataFrame
    assets: DataFrame
    files: DataFrame
    libraries: DataFrame
    scenes: DataFrame
    chunks: DataFrame
    #: Stored blocks of postings of the chunks (``text_search.block_index``), if there are any.
    index: DataFrame | None = None


def depth_for(limit: int, offset: int = 0) -> int:
    """Depth per channel for a page (see ``scoring.source_limit`` for the per-query form)."""
    return min(C.MAX_SOURCE_LIMIT, max(C.MIN_SOURCE_LIMIT, (limit + offset) * C.OVERFETCH))


def channel_hits(
    catalogue: Catalogue, queries: DataFrame, depth: int, prefilter: bool = False
) -> DataFrame:
    """Top points per query and channel, variants folded.

    Guards run after the cut, so fewer than ``depth`` may survive; ``prefilter`` applies the
    status guard to the points first instead.
    """
    points = catalogue.points
    if prefilter:
        live = catalogue.refs.filter(F.col("status") == "indexed").select("collection", "point_id")
        points = points.join(live, ["collection", "point_id"], "left_semi")
    hits = vector_search.variant_hits(points, queries, depth)
    return vector_search.channel_top(hits, depth).select(
        "query_id", "collection", "identity", "point_id",
        F.col("weighted_score").alias("score"), "channel_rank",
    )


def hydrated_hits(
    catalogue: Catalogue, hits: DataFrame, requests: DataFrame | None = None
) -> DataFrame:
    facts = hydration.joined_facts(
        hits, catalogue.refs, catalogue.assets, catalogue.files, catalogue.libraries,
        catalogue.scenes,
    )
    if requests is not None:
        facts = text_search.admitted(facts, requests)
    return hydration.source_rank(hydration.hydrate(facts))


def text_hits(
    catalogue: Catalogue, text_queries: DataFrame, depth: int, requests: DataFrame | None = None
) -> DataFrame:
    return text_search.text_search(
        catalogue.chunks, catalogue.files, catalogue.libraries, text_queries, depth,
        catalogue.index, requests,
    )


_CHANNEL_FIELDS = [
    "query_id", "collection", "score", "reason", "channel_no", "channel_rank", "asset_id",
    "file_id", "media_type", "path", "scene_id", "start_s", "end_s", "frame_time_s",
]


def channel_union(hydrated: DataFrame, text: DataFrame) -> DataFrame:
    """All channels as one set of rows, vectors first."""
    number = F.lit(None).cast("int")
    for i, name in enumerate(C.COLLECTIONS):
        number = F.when(F.col("collection") == name, i).otherwise(number)
    vectors = hydrated.withColumn("channel_no", number).select(*_CHANNEL_FIELDS)
    texts = text.withColumns(
        {
            "collection": F.lit(C.TEXT_CHANNEL), "channel_no": F.lit(len(C.COLLECTIONS)),
            "frame_time_s": F.lit(None).cast("double"),
        }
    ).select(*_CHANNEL_FIELDS)
    return vectors.unionByName(texts)


def candidates(
    catalogue: Catalogue, queries: DataFrame, text_queries: DataFrame, depth: int
) -> DataFrame:
    hydrated = hydrated_hits(catalogue, channel_hits(catalogue, queries, depth))
    return hybrid.as_candidates(
        channel_union(hydrated, text_hits(catalogue, text_queries, depth))
    )


def hybrid_search(
    catalogue: Catalogue, queries: DataFrame, text_queries: DataFrame, limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """Ranked page per query. queries: query_id, variant_order, weight, query_embedding;
    text_queries: query_id, query_text."""
    # At most 300 rows per query and channel: stored, so the fold is planned on its own instead of
    # again at every stage of the search before it.
    found = checkpointed(candidates(catalogue, queries, text_queries, depth_for(limit, offset)))
    return hybrid.page(hybrid.hybrid_results(found), limit=limit, offset=offset)


def routed(queries: DataFrame, requests: DataFrame) -> DataFrame:
    """Query rows for the channels their request asks for, with its libraries.

    Rows that name a collection are kept if it is asked for; others are repeated for every asked one. Requests
    may have a ``mode``: where it is ``translate``, captions are searched with the original text alone and the
    visual channels with the translation alone, at weight 1. A row is an original if its ``source`` says so
    or, without that column, if its variant_order is 0.
    """
    mode = F.col("mode") if "mode" in requests.columns else F.lit(None).cast("string")
    own = requests.select("query_id", "library_ids", "channels", mode.alias("_mode"))
    asked = F.coalesce("channels", F.array(*map(F.lit, C.COLLECTIONS)))
    known = queries.join(own, "query_id").withColumn(
        "_asked", F.array_intersect(asked, F.array(*map(F.lit, C.COLLECTIONS)))
    )
    if "collection" in queries.columns:
        known = known.filter(F.col("collection").isNull() | F.array_contains("_asked", F.col("collection")))
        known = known.withColumn("collection", F.explode(
            F.when(F.col("collection").isNull(), F.col("_asked")).otherwise(F.array("collection"))
        ))
    else:
        known = known.withColumn("collection", F.explode("_asked"))
    original = F.col("source") == "original" if "source" in queries.columns else F.col("variant_order") == 0
    captions, translated = F.col("collection") == C.CAPTION_CHANNEL, F.coalesce(F.col("_mode") == "translate", F.lit(False))
    known = known.filter(~translated | (captions == F.coalesce(original, F.lit(False)))).withColumn(
        "weight", F.when(translated & ~captions, F.lit(1.0)).otherwise(F.col("weight"))
    )
    return known.drop("_asked", "channels", "_mode")


def _with_libraries(catalogue: Catalogue, requests: DataFrame) -> Catalogue:
    """Points with the library of their ref, if requests ask for libraries and points do not name theirs."""
    if "library_id" in catalogue.points.columns:
        return catalogue
    if requests.filter(F.col("library_ids").isNotNull()).isEmpty():
        return replace(catalogue, points=catalogue.points.withColumn("library_id", F.lit(None).cast("string")))
    of_point = catalogue.refs.select("collection", "point_id", "library_id")
    return replace(catalogue, points=catalogue.points.join(of_point, ["collection", "point_id"]))


def _requested_rows(
    catalogue: Catalogue, queries: DataFrame, text_queries: DataFrame, requests: DataFrame
) -> DataFrame:
    """Hits of all channels, each cut at the depth of its request."""
    catalogue = _with_libraries(catalogue, requests)
    limits = requests.select(
        "query_id", scoring.source_limit(F.col("page_limit"), F.col("page_offset")).alias("own_depth")
    )
    depth = limits.agg(F.max("own_depth")).first()[0] or C.MIN_SOURCE_LIMIT
    cut = lambda hits: hits.join(limits, "query_id").filter(
        F.col("channel_rank") <= F.col("own_depth")
    ).drop("own_depth")
    hits = cut(channel_hits(catalogue, routed(queries, requests), depth))
    speaks = requests.filter(
        F.col("channels").isNull() | F.array_contains("channels", C.TEXT_CHANNEL)
    )
    texts = text_queries.join(speaks.select("query_id"), "query_id", "left_semi")
    everywhere = requests.withColumn("library_ids", F.lit(None).cast("array<string>"))
    return channel_union(
        hydrated_hits(catalogue, hits, everywhere), cut(text_hits(catalogue, texts, depth, requests))
    )


def requested_search(
    catalogue: Catalogue, queries: DataFrame, text_queries: DataFrame, requests: DataFrame
) -> DataFrame:
    """Ranked page per request, each with its own filters, channels and page.

    requests: query_id, library_ids, media_types, channels (null: all), page_limit, page_offset and,
    for queries in two languages, mode (see ``routed``). Libraries are filtered before the depth is cut,
    media types when facts are joined. Channels are cut at each request's own depth.
    """
    found = checkpointed(hybrid.as_candidates(_requested_rows(catalogue, queries, text_queries, requests)))
    return hybrid.page(hybrid.hybrid_results(found), requests)


def requested_search_rrf(
    catalogue: Catalogue, queries: DataFrame, text_queries: DataFrame, requests: DataFrame
) -> DataFrame:
    """The same requests fused by reciprocal rank, each with its own page."""
    fused = ranking.rrf_fuse(channel_ranks(_requested_rows(catalogue, queries, text_queries, requests)), large=False)
    pages = requests.select("query_id", "page_limit", "page_offset")
    return fused.join(pages, "query_id").filter(
        (F.col("rank") > F.col("page_offset")) & (F.col("rank") <= F.col("page_offset") + F.col("page_limit"))
    ).drop("page_limit", "page_offset")


def diagnostics(
    catalogue: Catalogue, queries: DataFrame, requests: DataFrame, depth: int = C.MAX_SOURCE_LIMIT
) -> DataFrame:
    """Every vector hit with its rank, its caption and the query variants that found it.

    (query_id, collection, point_id, source_rank, caption_text, prompt_version, variant_hits), the last one a
    list of (variant_order, variant_text, source, weight, score, weighted_score, winning). queries may carry
    variant_text and source; only variants really searched in a channel are listed. A list holds at most
    one entry per variant of a query.
    """
    catalogue = _with_libraries(catalogue, requests)
    searched = routed(queries, requests)
    hits = checkpointed(vector_search.variant_hits(catalogue.points, searched, depth))
    told = [
        (F.col(c) if c in queries.columns else F.lit(None).cast("string")).alias(c) for c in ("variant_text", "source")
    ]
    texts = queries.select("query_id", "variant_order", *told).distinct()
    entry = F.struct("variant_order", "variant_text", "source", "weight", "score", "weighted_score", "winning")
    evidence = vector_search.variant_evidence(hits).join(texts, ["query_id", "variant_order"], "left").groupBy(
        "query_id", "collection", "point_id"
    ).agg(F.sort_array(F.collect_list(entry)).alias("variant_hits"))
    best = vector_search.channel_top(hits, depth).select(
        "query_id", "collection", "identity", "point_id", F.col("weighted_score").alias("score"), "channel_rank"
    )
    everywhere = requests.withColumn("library_ids", F.lit(None).cast("array<string>"))
    return hydrated_hits(catalogue, best, everywhere).join(evidence, ["query_id", "collection", "point_id"]).select(
        "query_id", "collection", "point_id", "source_rank", "caption_text", "prompt_version", "variant_hits"
    )


def channel_ranks(rows: DataFrame) -> DataFrame:
    """Rank of each result key per fusion signal: images by asset, videos by scene, and a
    transcript without a scene by its asset."""
    signal = (
        F.when(F.col("collection") == C.TEXT_CHANNEL, "lexical")
        .when(F.col("collection") == C.CAPTION_CHANNEL, "caption")
        .otherwise("visual")
    )
    key = F.coalesce(F.col("scene_id"), F.concat(F.lit("asset-"), F.col("asset_id").cast("string")))
    keyed = rows.select(
        "query_id", signal.alias("signal"), key.alias("candidate_key"), "score",
        "channel_no", "channel_rank",
    )
    best = keyed.groupBy("query_id", "signal", "candidate_key").agg(
        F.min(F.struct(-F.col("score"), "channel_no", "channel_rank")).alias("o")
    )
    return vector_search.top_per_group(
        best, ["query_id", "signal"], [F.asc("o"), F.asc("candidate_key")],
        2 * C.MAX_SOURCE_LIMIT, "source_rank",
    ).drop("o")


def hybrid_search_rrf(
    catalogue: Catalogue, queries: DataFrame, text_queries: DataFrame, limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """The same channels fused by reciprocal rank."""
    depth = depth_for(limit, offset)
    hydrated = hydrated_hits(catalogue, channel_hits(catalogue, queries, depth))
    rows = channel_union(hydrated, text_hits(catalogue, text_queries, depth))
    fused = ranking.rrf_fuse(channel_ranks(rows), large=False)
    return fused.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit))

"""The hybrid search core and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.functions import scoring as S
from reelquery.operators import hybrid, ranking, vector_search
from reelquery.plans import search
from reelquery.plans.join_queries import (
    DEPTH, candidates, catalogue, hydrated, search_texts,
)
from reelquery.plans.order_queries import FUSED
from reelquery.plans.registry import query
from reelquery.plans.report_queries import DISCOVERY, TARGET, discovery, ranked, targets
from reelquery.sources.adapters import changed_views

PER_FILE = """
    SELECT query_id, file_id, source, max(score) AS score FROM v_candidates GROUP BY ALL"""
NORM = """CASE WHEN source = 'text_search' THEN CASE WHEN score <= 0 THEN 0
    ELSE score / (score + 1) END ELSE least(greatest(score, 0), 1) END"""
WEIGHT = "CASE WHEN source = 'text_search' THEN 0.45 ELSE 0.55 END"
REASON = """CASE source WHEN 'caption_text_vectors' THEN 'caption_match' WHEN 'text_search'
    THEN 'transcript_match' ELSE 'vector_match' END"""


def per_file(t):
    """Candidates folded per file into one map of scores, with all their reasons."""
    merged = hybrid.merge_scores_max(candidates(t), ["query_id", "file_id"])
    reasons = F.transform(F.map_keys("source_scores"), lambda s: S.reason_of_source(s))
    return merged.withColumn("reasons", S.ordered_reasons(reasons))


def long_form(t):
    return candidates(t).select(
        "query_id", "asset_id", F.explode("source_scores").alias("source", "score")
    )


@query(
    "weak_source_filter",
    f"""
    SELECT query_id, file_id, string_agg(source, ',' ORDER BY source) AS sources,
      concat_ws(',', CASE WHEN bool_or(r = 'vector_match') THEN 'vector_match' END,
        CASE WHEN bool_or(r = 'transcript_match') THEN 'transcript_match' END,
        CASE WHEN bool_or(r = 'caption_match') THEN 'caption_match' END) AS reasons
    FROM (SELECT *, {REASON} AS r FROM ({PER_FILE}) WHERE source = 'text_search' OR {NORM} >= 0.1)
    GROUP BY query_id, file_id""",
)
def weak_source_filter(t):
    kept = hybrid.weak_source_filter(per_file(t))
    return kept.select(
        "query_id", "file_id",
        F.array_join(F.array_sort(F.map_keys("source_scores")), ",").alias("sources"),
        F.array_join("reasons", ",").alias("reasons"),
    )


@query(
    "normalize_score",
    f"SELECT query_id, asset_id, source, round({NORM}, 12) AS normalized FROM v_candidates",
)
def normalize_score(t):
    value = S.normalize_score(F.col("source"), F.col("score"))
    return long_form(t).select(
        "query_id", "asset_id", "source", F.round(value, 12).alias("normalized")
    )


@query(
    "weighted_contribution",
    f"""SELECT query_id, asset_id, source, round({WEIGHT} * {NORM}, 12) AS contribution
      FROM v_candidates""",
)
def weighted_contribution(t):
    value = S.contribution(F.col("source"), F.col("score"))
    return long_form(t).select(
        "query_id", "asset_id", "source", F.round(value, 12).alias("contribution")
    )


@query(
    "reason_of_source",
    f"SELECT query_id, asset_id, source, {REASON} AS reason FROM v_candidates",
)
def reason_of_source(t):
    return long_form(t).select(
        "query_id", "asset_id", "source", S.reason_of_source(F.col("source")).alias("reason")
    )


@query(
    "same_asset_merge",
    f"""
    SELECT query_id, file_id, min(start_s) AS start_s, max(end_s) AS end_s,
      count(DISTINCT source) AS n_sources, round(max({WEIGHT} * {NORM}), 12) AS strength,
      round(max(score) FILTER (source = 'video_frame_vectors'), 12) AS frame_score
    FROM v_candidates GROUP BY query_id, file_id""",
)
def same_asset_merge(t):
    """Each file taken as one asset without scenes, so its bounds grow over all its hits."""
    one = candidates(t).withColumns(
        {"asset_id": F.col("file_id"), "scene_id": F.lit(None).cast("string")}
    )
    return hybrid.same_asset_merge(one).select(
        "query_id", F.col("asset_id").alias("file_id"), "start_s", "end_s",
        F.size("source_scores").cast("bigint").alias("n_sources"),
        F.round("strength", 12).alias("strength"),
        F.round(F.col("source_scores")["video_frame_vectors"], 12).alias("frame_score"),
    )


@query(
    "window_merge",
    """
    SELECT query_id, file_id, asset_id, scene_id, start_s, end_s,
      array_to_string(list_transform(list_sort(members), lambda x: x.a), ',') AS merged_asset_ids
    FROM v_windowed""",
)
def window_merge(t):
    kept = hybrid.weak_source_filter(hybrid.checked_windows(candidates(t)))
    merged = hybrid.scored(hybrid.window_merge(hybrid.same_asset_merge(kept)))
    return merged.select(
        "query_id", "file_id", "asset_id", "scene_id", "start_s", "end_s",
        F.array_join("merged_asset_ids", ",").alias("merged_asset_ids"),
    )


@query(
    "scene_merge",
    f"""
    SELECT query_id, file_id, scene_id, min(start_s) AS start_s, max(end_s) AS end_s,
      count(DISTINCT asset_id) AS n_assets, count(DISTINCT source) AS n_sources,
      round(max({WEIGHT} * {NORM}), 12) AS strength
    FROM v_candidates WHERE scene_id IS NOT NULL GROUP BY query_id, file_id, scene_id""",
)
def scene_merge(t):
    return hybrid.scene_merge(candidates(t)).withColumn("strength", F.round("strength", 12))


@query(
    "scene_conflict_check",
    """
    SELECT query_id, file_id, scene_id, count(DISTINCT (start_s, end_s)) AS n_bounds
    FROM (SELECT o_custkey % 7 AS query_id, o_custkey AS file_id, o_orderpriority AS scene_id,
        floor(o_totalprice / 100000) AS start_s, floor(o_totalprice / 100000) + o_orderkey % 3
          AS end_s FROM orders)
    WHERE end_s > start_s GROUP BY ALL HAVING count(DISTINCT (start_s, end_s)) > 1""",
)
def scene_conflict_check(t):
    """Orders as scene hits of their customer's file; most scenes disagree on their bounds."""
    start = F.floor(F.col("o_totalprice") / 100000)
    hits = t.orders.select(
        (F.col("o_custkey") % 7).alias("query_id"), F.col("o_custkey").alias("file_id"),
        F.col("o_orderpriority").alias("scene_id"), start.alias("start_s"),
        (start + F.col("o_orderkey") % 3).alias("end_s"),
    )
    return hybrid.scene_conflicts(hits)


@query(
    "representative",
    f"""
    SELECT query_id, file_id, scene_id, asset_id, round(c, 12) AS strength FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, file_id, scene_id
          ORDER BY c DESC, input_order) AS n
      FROM (SELECT *, {WEIGHT} * {NORM} AS c FROM v_candidates)) WHERE n = 1""",
)
def representative(t):
    return hybrid.representative(candidates(t)).withColumn("strength", F.round("strength", 12))


@query(
    "hybrid_score",
    f"""
    SELECT query_id, file_id, round(least(1, greatest(sum(w * n) / sum(w)
        + CASE WHEN count(DISTINCT r) > 1 THEN 0.08 ELSE 0 END, max(n))), 12) AS score
    FROM (SELECT *, {WEIGHT} AS w, {NORM} AS n, {REASON} AS r FROM ({PER_FILE}))
    GROUP BY query_id, file_id""",
)
def hybrid_score(t):
    score = hybrid.hybrid_score(F.col("source_scores"), F.col("reasons"))
    return per_file(t).select("query_id", "file_id", F.round(score, 12).alias("score"))


@query(
    "primary_reason",
    f"""
    SELECT query_id, file_id, arg_max(r, (c, -o)) AS primary_reason
    FROM (SELECT *, CASE r WHEN 'transcript_match' THEN 0 WHEN 'caption_match' THEN 1 ELSE 2 END
        AS o FROM (SELECT *, {REASON} AS r, round({WEIGHT} * {NORM}, 12) AS c FROM ({PER_FILE})))
    GROUP BY query_id, file_id""",
)
def primary_reason(t):
    reason = hybrid.primary_reason(F.col("source_scores"), F.col("reasons"))
    return per_file(t).select("query_id", "file_id", reason.alias("primary_reason"))


@query(
    "merged_ids",
    """
    SELECT query_id, file_id, string_agg(asset_id, ',' ORDER BY o) AS merged_asset_ids
    FROM (SELECT query_id, file_id, asset_id, max(input_order) AS o FROM v_candidates
      GROUP BY ALL) GROUP BY query_id, file_id""",
)
def merged_ids(t):
    merged = hybrid.merged_ids(candidates(t), ["query_id", "file_id"])
    return merged.withColumn("merged_asset_ids", F.array_join("merged_asset_ids", ","))


@query(
    "hybrid_search",
    """
    SELECT query_id, position, file_id, asset_id, scene_id, start_s, end_s, score, primary_reason,
      merged_asset_ids
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id,
      start_s NULLS LAST, asset_id) AS position FROM v_results_scored) WHERE position <= 20""",
)
def hybrid_search(t):
    results = search.hybrid_search(catalogue(t), t.v_queries, search_texts(t), limit=20)
    return results.select(
        "query_id", "position", "file_id", "asset_id", "scene_id", "start_s", "end_s", "score",
        "primary_reason", F.array_join("merged_asset_ids", ",").alias("merged_asset_ids"),
    )


@query(
    "hybrid_search_rrf",
    f"""
    SELECT query_id, rank, candidate_key, score, primary_signal FROM ({FUSED})
    WHERE rank <= 20""",
)
def hybrid_search_rrf(t):
    results = search.hybrid_search_rrf(catalogue(t), t.v_queries, search_texts(t), limit=20)
    return results.select("query_id", "rank", "candidate_key", "score", "primary_signal")


def _requested(query_id: str) -> dict[str, str]:
    """A request as functions of its number: libraries, media types, channels, page and depth."""
    page, start = f"(5 + {query_id} % 3 * 10)", f"({query_id} % 2 * 3)"
    return {
        "library": f"({query_id} % 3 = 0 OR CAST(substr(library_id, 4) AS INT) % 3 <> {query_id} % 3)",
        "media": f"({query_id} % 2 = 0 OR media_type IN ('video', 'audio'))",
        "vectors": f"({query_id} % 4 <> 3 OR collection = 'caption_text_vectors')",
        "speaks": f"{query_id} % 5 <> 4", "page": page, "start": start,
        "depth": f"least(300, greatest(30, 3 * ({page} + {start})))",
    }


_OF_QUERY, _OF_TEXT = _requested("query_id"), _requested("CAST((s.query_id - 2) / 3 AS BIGINT)")
changed_views("_asked", {
    "v_scored": [
        ("p.scene_id,", "p.scene_id, r.library_id,"),
        ("FROM v_points p CROSS JOIN v_queries q",
         "FROM v_points p JOIN v_refs r USING (collection, point_id) CROSS JOIN v_queries q"),
    ],
    "v_hits": [
        ("identity IS NOT NULL", f"identity IS NOT NULL AND {_OF_QUERY['library']} AND {_OF_QUERY['vectors']}"),
        ("hit_rank <= 60", "hit_rank <= 300"), ("SELECT * FROM", "SELECT * EXCLUDE library_id FROM"),
    ],
    "v_channel": [("channel_rank <= 60", f"channel_rank <= {_OF_QUERY['depth']}")],
    "v_hydrated": [("NOT file_deleted", f"{_OF_QUERY['media']} AND NOT file_deleted")],
    "v_text_hits": [
        ("WHERE NOT f.is_deleted", "WHERE " + " AND ".join(_OF_TEXT[k] for k in ("library", "media", "speaks")).replace(
            "library_id", "f.library_id") + " AND s.query_id % 3 = 2 AND NOT f.is_deleted"),
        ("channel_rank <= 60", f"channel_rank <= {_requested('CAST((query_id - 2) / 3 AS BIGINT)')['depth']}"),
    ],
})


PAGE = """SELECT query_id, position, file_id, asset_id, scene_id, start_s, end_s, score, primary_reason,
      merged_asset_ids
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id,
      start_s NULLS LAST, asset_id) AS position FROM {view})"""


def page_columns(results):
    return results.select(
        "query_id", "position", "file_id", "asset_id", "scene_id", "start_s", "end_s", "score",
        "primary_reason", F.array_join("merged_asset_ids", ",").alias("merged_asset_ids"),
    )


def requests_of(t):
    """Every query with libraries, media types, channels and a page of its own."""
    q = F.col("query_id")
    numbers = F.filter(F.sequence(F.lit(0), F.lit(19)), lambda n: n % 3 != q % 3)
    of_third = F.transform(numbers, lambda n: F.concat(F.lit("src"), n.cast("string")))
    some = F.array_compact(F.array(
        *[F.when((q % 4 != 3) | F.lit(name == C.CAPTION_CHANNEL), F.lit(name)) for name in C.COLLECTIONS],
        F.when(q % 5 != 4, F.lit(C.TEXT_CHANNEL)),
    ))
    return t.v_queries.select("query_id").distinct().select(
        "query_id", F.when(q % 3 != 0, of_third).alias("library_ids"),
        F.when(q % 2 != 0, F.array(F.lit("video"), F.lit("audio"))).alias("media_types"),
        F.when((q % 4 == 3) | (q % 5 == 4), some).alias("channels"),
        (5 + q % 3 * 10).alias("page_limit"), (q % 2 * 3).alias("page_offset"),
    )


@query(
    "requested_search",
    f"""{PAGE.format(view='v_results_scored_asked')}
    WHERE position > {_OF_QUERY['start']} AND position <= {_OF_QUERY['start']} + {_OF_QUERY['page']}""",
)
def requested_search(t):
    return page_columns(search.requested_search(catalogue(t), t.v_queries, search_texts(t), requests_of(t)))


@query(
    "requested_search_rrf",
    f"""
    SELECT query_id, rank, candidate_key, score, primary_signal
    FROM ({FUSED.replace("v_candidates", "v_candidates_asked")})
    WHERE rank > {_OF_QUERY['start']} AND rank <= {_OF_QUERY['start']} + {_OF_QUERY['page']}""",
)
def requested_search_rrf(t):
    """The same requests by reciprocal rank."""
    found = search.requested_search_rrf(catalogue(t), t.v_queries, search_texts(t), requests_of(t))
    return found.select("query_id", "rank", "candidate_key", "score", "primary_signal")


# Odd queries are translated: the first variant is the original, the second the translation.
changed_views("_routed", {
    "v_scored": [
        ("q.weight,", "CASE WHEN q.query_id % 2 = 1 AND p.collection <> 'caption_text_vectors' THEN CAST(1 AS DOUBLE) "
                      "ELSE q.weight END AS weight,"),
        ("CROSS JOIN v_queries q", "CROSS JOIN v_queries q WHERE q.query_id % 2 = 0 OR "
                                   "(p.collection = 'caption_text_vectors') = (q.variant_order = 0)"),
    ],
})


def translated(t):
    nothing = F.lit(None).cast("array<string>")
    return t.v_queries.select("query_id").distinct().select(
        "query_id", nothing.alias("library_ids"), nothing.alias("media_types"), nothing.alias("channels"),
        F.lit(20).alias("page_limit"), F.lit(0).alias("page_offset"),
        F.when(F.col("query_id") % 2 == 1, "translate").otherwise("expand").alias("mode"),
    )


@query("routed_search", f"{PAGE.format(view='v_results_scored_routed')} WHERE position <= 20")
def routed_search(t):
    """Variants routed to the channels whose model reads their language."""
    return page_columns(search.requested_search(catalogue(t), t.v_queries, search_texts(t), translated(t)))


@query(
    "search_diagnostics",
    """
    SELECT h.query_id, h.collection, h.point_id, h.source_rank, e.variant_order,
      concat('text ', e.variant_order, ' of ', h.query_id) AS variant_text,
      CASE WHEN e.variant_order = 0 THEN 'original' ELSE 'expansion' END AS source,
      e.weight, e.score, e.score * e.weight AS weighted_score, e.win AS winning
    FROM v_hydrated_routed h JOIN (SELECT *, row_number() OVER (PARTITION BY query_id, collection,
        identity ORDER BY score * weight DESC, variant_order) = 1 AS win FROM v_hits_routed) e
      USING (query_id, collection, point_id)""",
)
def search_diagnostics(t):
    """The variants behind every hit, with their texts, weights and raw scores."""
    order = F.col("variant_order")
    queries = t.v_queries.withColumns({
        "variant_text": F.concat(F.lit("text "), order.cast("string"), F.lit(" of "), F.col("query_id").cast("string")),
        "source": F.when(order == 0, "original").otherwise("expansion"),
    })
    found = search.diagnostics(catalogue(t), queries, translated(t), DEPTH)
    return found.select("query_id", "collection", "point_id", "source_rank", F.inline("variant_hits"))


VARIANTS = """
    SELECT conv_id AS query_id, turn AS variant_order,
      CASE WHEN turn % 4 = 3 THEN '  ' ELSE concat(' ', role, ' ', turn % 3) END AS variant_text,
      CASE WHEN turn % 5 <> 2 THEN length(text) / CAST(400 AS DOUBLE) END AS weight,
      CASE WHEN turn = 0 THEN 'original' ELSE 'expansion' END AS source
    FROM conversations"""
NORMALIZED = f"""
    SELECT query_id, variant_text, weight, source, position FROM (
      SELECT query_id, variant_text, max(w) AS weight,
        CASE WHEN bool_or(is_original) THEN 'original' ELSE 'expansion' END AS source,
        row_number() OVER (PARTITION BY query_id ORDER BY max(w) DESC, min(variant_order))
          AS position
      FROM (SELECT *, CASE WHEN is_original THEN 1 ELSE least(1, greatest(0.1, coalesce(weight,
            0.85))) END AS w
        FROM (SELECT v.query_id, v.variant_order, trim(v.variant_text) AS variant_text, v.weight,
            v.source, trim(v.variant_text) IS NOT DISTINCT FROM o.t AS is_original
          FROM ({VARIANTS}) v LEFT JOIN (SELECT query_id, trim(variant_text) AS t
            FROM ({VARIANTS}) WHERE source = 'original') o USING (query_id))
        WHERE variant_text <> '' OR source = 'original')
      GROUP BY query_id, variant_text) WHERE position <= 4"""


def normalized_variants(t):
    turn = F.col("turn")
    variants = t.conversations.select(
        F.col("conv_id").alias("query_id"), turn.alias("variant_order"),
        F.when(turn % 4 == 3, "  ").otherwise(
            F.concat(F.lit(" "), "role", F.lit(" "), (turn % 3).cast("string"))
        ).alias("variant_text"),
        F.when(turn % 5 != 2, F.length("text") / F.lit(400.0)).alias("weight"),
        F.when(turn == 0, "original").otherwise("expansion").alias("source"),
    )
    return hybrid.normalize_variants(variants, 4)


@query("variant_normalize", NORMALIZED)
def variant_normalize(t):
    """Conversation turns as variants of their conversation's query."""
    return normalized_variants(t)


@query(
    "variant_routing",
    f"""
    SELECT query_id, collection, variant_text, source, CASE WHEN collection = 'caption_text_vectors'
        OR mode <> 'translate' THEN weight ELSE 1 END AS weight, mode
    FROM ({NORMALIZED}), (VALUES ('image_vectors'), ('video_frame_vectors'),
        ('caption_text_vectors')) c(collection), (VALUES ('translate'), ('expand')) m(mode)
    WHERE mode <> 'translate' OR (collection = 'caption_text_vectors') = (source = 'original')""",
)
def variant_routing(t):
    variants = normalized_variants(t)
    routed = [
        hybrid.route_variants(variants, mode).withColumn("mode", F.lit(mode))
        for mode in ("translate", "expand")
    ]
    return routed[0].unionByName(routed[1]).drop("position")


@query(
    "diagnostics_report",
    """
    SELECT h.query_id, h.collection, h.point_id, h.source_rank,
      CASE WHEN h.asset_type = 'caption' THEN h.text_content END AS caption_text,
      json_extract_string(h.metadata_json, '$.prompt_version') AS prompt_version,
      e.variants, e.winner
    FROM v_hydrated h JOIN (SELECT query_id, collection, point_id,
        string_agg(variant_order, ',' ORDER BY variant_order) AS variants,
        max(variant_order) FILTER (win) AS winner
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection, identity
          ORDER BY score * weight DESC, variant_order) = 1 AS win FROM v_hits)
      GROUP BY ALL) e USING (query_id, collection, point_id)""",
)
def diagnostics_report(t):
    """Rank of each hit in its channel with the query variants that found it."""
    hits = vector_search.variant_hits(t.v_points, t.v_queries, DEPTH)
    evidence = vector_search.variant_evidence(hits).groupBy(
        "query_id", "collection", "point_id"
    ).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list("variant_order")), lambda v: v.cast("string")),
            ",",
        ).alias("variants"),
        F.max(F.when(F.col("winning"), F.col("variant_order"))).alias("winner"),
    )
    return hydrated(t).join(evidence, ["query_id", "collection", "point_id"]).select(
        "query_id", "collection", "point_id", "source_rank", "caption_text", "prompt_version",
        "variants", "winner",
    )


@query(
    "knn_label_eval",
    f"""
    SELECT d.*, g.hit_5, g.hit_10, g.hit_20, round(g.reciprocal_rank, 6) AS reciprocal_rank,
      u.unjudgeable
    FROM ({DISCOVERY}) d JOIN ({TARGET}) g USING (query_id) JOIN (SELECT query_id, count(*) FILTER
      (relevance IS NULL) AS unjudgeable FROM v_judgments GROUP BY query_id) u USING (query_id)""",
)
def knn_label_eval(t):
    target = ranking.target_metrics(ranked(t), targets(t)).withColumn(
        "reciprocal_rank", F.round("reciprocal_rank", 6)
    )
    return discovery(t).join(target, "query_id").join(
        ranking.unjudgeable_counts(t.v_judgments), "query_id"
    )



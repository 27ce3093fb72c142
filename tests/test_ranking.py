import pytest

from reelquery.operators import hybrid, ranking


def ranks(spark, rows):
    return spark.createDataFrame(rows, "query_id int, candidate_key string, signal string, "
                                       "source_rank double")


def test_two_channels_beat_one(spark):
    found = ranking.rrf_fuse(ranks(spark, [
        (1, "visual-only", "visual", 1.0), (1, "multi", "visual", 20.0), (1, "multi", "caption", 20.0),
    ])).orderBy("rank").collect()
    assert [(r.candidate_key, r.score) for r in found] == [
        ("multi", pytest.approx(2 / 80)), ("visual-only", pytest.approx(1 / 61))
    ]
    assert found[0].primary_signal == "visual"


def test_ties_by_key(spark):
    found = ranking.rrf_fuse(ranks(spark, [(1, "b", "visual", 1.0), (1, "a", "visual", 1.0)]))
    assert [r.candidate_key for r in found.orderBy("rank").collect()] == ["a", "b"]


@pytest.mark.parametrize("rank", [0.0, 1.5, None])
def test_bad_ranks_fail(spark, rank):
    bad = ranks(spark, [(1, "a", "visual", rank)])
    assert ranking.invalid_ranks(bad).count() == 1
    with pytest.raises(Exception, match="invalid source rank"):
        ranking.rrf_fuse(bad, large=False).collect()


def test_discovery_metrics(spark):
    ranked = spark.createDataFrame(
        [(1, k, i + 1) for i, k in enumerate(["high", "unknown", "partial", "none"])]
        + [(2, "x", 1), (3, "y", 1)],
        "query_id int, candidate_key string, rank int",
    )
    judged = spark.createDataFrame(
        [(1, "high", 2), (1, "unknown", None), (1, "partial", 1), (1, "none", 0), (3, "y", 0)],
        "query_id int, candidate_key string, relevance int",
    )
    one, two, three = ranking.discovery_metrics(ranked, judged).orderBy("query_id").collect()
    assert one.precision_5 == pytest.approx(2 / 3) and one.ndcg_10 == pytest.approx(1.0)
    assert two.precision_5 is None and two.ndcg_20 is None
    assert three.precision_10 == 0 and three.ndcg_10 == 0
    counts = {r.query_id: r.unjudgeable for r in ranking.unjudgeable_counts(judged).collect()}
    assert counts == {1: 1, 3: 0}


def test_target_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2)],
                                   "query_id int, candidate_key string, rank int")
    targets = spark.createDataFrame([(1, "b"), (2, "zzz")], "query_id int, candidate_key string")
    one, two = ranking.target_metrics(ranked, targets).orderBy("query_id").collect()
    assert (one.hit_5, one.hit_20, one.reciprocal_rank) == (1, 1, 0.5)
    assert (two.hit_5, two.reciprocal_rank) == (0, 0.0)


def test_variant_routing(spark):
    variants = spark.createDataFrame(
        [(1, "原文", 1.0, "original"), (1, "translation", 0.9, "expansion")],
        "query_id int, variant_text string, weight double, source string",
    )
    routed = {(r.collection, r.variant_text, r.weight)
              for r in hybrid.route_variants(variants, "translate").collect()}
    assert routed == {
        ("image_vectors", "translation", 1.0), ("video_frame_vectors", "translation", 1.0),
        ("caption_text_vectors", "原文", 1.0),
    }
    assert hybrid.route_variants(variants, "expand").count() == 6


def test_variants_keep_the_largest_weight(spark):
    variants = spark.createDataFrame(
        [(1, 0, " dog ", 1.0, "original"), (1, 1, "puppy", 0.5, "expansion"),
         (1, 2, " puppy", 0.7, "expansion"), (1, 3, "dog", 0.2, "expansion"),
         (1, 4, "  ", 0.9, "expansion"), (1, 5, "hound", None, "expansion"),
         (1, 6, "pet", 0.01, "expansion")],
        "query_id int, variant_order int, variant_text string, weight double, source string",
    )
    found = hybrid.normalize_variants(variants, 3).orderBy("position").collect()
    assert [(r.variant_text, r.weight, r.source) for r in found] == [
        ("dog", 1.0, "original"), ("hound", 0.85, "expansion"), ("puppy", 0.7, "expansion")
    ]

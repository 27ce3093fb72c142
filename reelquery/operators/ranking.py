"""Reciprocal rank fusion and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.operators.ordered import OrderedScan

METRIC_DEPTHS = {"precision": (5, 10), "ndcg": (10, 20), "hit": (5, 10, 20)}


def invalid_ranks(ranks: DataFrame) -> DataFrame:
    """Rows fusion must not accept: rank missing, below 1 or not whole, or an unknown signal.

    ranks: query_id, candidate_key, signal, source_rank.
    """
    rank = F.col("source_rank").cast("double")
    return ranks.withColumn(
        "problem",
        F.when(~F.coalesce(F.col("signal").isin(C.RRF_SIGNALS), F.lit(False)), "no_channel")
        .when(rank.isNull(), "no_rank")
        .when(rank != F.floor(rank), "not_whole")
        .when(rank < 1, "below_one"),
    ).filter(F.col("problem").isNotNull())


def _rank(df: DataFrame, keys: list[str], name: str, large: bool | None) -> DataFrame:
    """Rank by descending score, then candidate key."""
    ordered = df.withColumn("_down", -F.col("score"))
    scan = OrderedScan(keys, ["_down", "candidate_key"], number=name)
    return scan.run(ordered, large).drop("_down")


def contributions(ranks: DataFrame, strict: bool = True) -> DataFrame:
    """One row per candidate with its contribution per signal (NULL = not in that channel).

    ``strict`` raises on an invalid rank; the audit form is ``invalid_ranks``.
    """
    rank: Column = F.col("source_rank").cast("double")
    if strict:
        good = rank.isNotNull() & (rank >= 1) & (rank == F.floor(rank)) & F.col("signal").isin(
            C.RRF_SIGNALS
        )
        rank = F.when(good, rank).otherwise(
            F.raise_error(
                F.concat(F.lit("invalid source rank for "), F.col("candidate_key").cast("string"))
            ).cast("double")
        )
    value = 1 / (F.lit(C.RRF_K) + rank)
    per_signal = [
        F.max(F.when(F.col("signal") == s, value)).alias(s) for s in C.RRF_SIGNALS
    ]
    return ranks.groupBy("query_id", "candidate_key").agg(*per_signal)


def primary_signal() -> Column:
    """Signal with the largest contribution; ties follow the signal order."""
    best = F.greatest(*C.RRF_SIGNALS)
    chosen = F.lit(None).cast("string")
    for signal in reversed(C.RRF_SIGNALS):
        chosen = F.when(F.col(signal) == best, signal).otherwise(chosen)
    return chosen


def rrf_fuse(ranks: DataFrame, strict: bool = True, large: bool | None = None) -> DataFrame:
    """Σ 1/(60 + rank) per candidate, ranked 1..N by score then key.

    ``large`` False tells that channels were cut at a depth, so a query's candidates fit a window;
    None looks at the largest query.
    """
    wide = contributions(ranks, strict)
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in C.RRF_SIGNALS), F.lit(0.0))
    scored = wide.withColumns({"score": total, "primary_signal": primary_signal()})
    return _rank(scored, ["query_id"], "rank", large)


def judged(ranked: DataFrame, judgments: DataFrame) -> DataFrame:
    """Ranked candidates that have a grade, renumbered without the others.

    ranked: query_id, candidate_key, rank; judgments: query_id, candidate_key, relevance.
    """
    graded = judgments.filter(F.col("relevance").isNotNull()).select(
        "query_id", "candidate_key", "relevance"
    )
    joined = ranked.select("query_id", "candidate_key", "rank").join(
        graded, ["query_id", "candidate_key"]
    )
    # Metrics read the first 20 judged candidates at most: a literal limit, applied before the
    # exchange.
    window = Window.partitionBy("query_id").orderBy("rank")
    return joined.withColumn("position", F.row_number().over(window)).filter(
        F.col("position") <= 20
    )


def _gain(relevance: Column, position: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(position + 1)


def discovery_metrics(ranked: DataFrame, judgments: DataFrame) -> DataFrame:
    """Precision@5/10 and nDCG@10/20 over judged candidates; none judged gives NULL.

    The ideal order is taken from the same first k candidates.
    """
    top = judged(ranked, judgments)
    aggregates = []
    for k in METRIC_DEPTHS["precision"]:
        seen = F.col("position") <= k
        aggregates.append(
            (F.count_if(seen & (F.col("relevance") > 0)) / F.count_if(seen)).alias(f"precision_{k}")
        )
    for k in METRIC_DEPTHS["ndcg"]:
        seen = F.col("position") <= k
        ideal = Window.partitionBy("query_id", seen).orderBy(F.desc("relevance"), "position")
        top = top.withColumn(f"ideal_{k}", F.row_number().over(ideal))
        dcg = F.sum(F.when(seen, _gain(F.col("relevance"), F.col("position"))))
        best = F.sum(F.when(seen, _gain(F.col("relevance"), F.col(f"ideal_{k}"))))
        aggregates.append(F.when(best == 0, 0.0).otherwise(dcg / best).alias(f"ndcg_{k}"))
    metrics = top.groupBy("query_id").agg(*aggregates)
    return ranked.select("query_id").distinct().join(metrics, "query_id", "left")


def target_metrics(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """Hit@5/10/20 and reciprocal rank of one known target per query; not found is 0."""
    found = targets.join(
        ranked.select("query_id", "candidate_key", "rank"), ["query_id", "candidate_key"], "left"
    ).groupBy("query_id").agg(F.min("rank").alias("rank"))
    hits = [
        F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0)).alias(f"hit_{k}")
        for k in METRIC_DEPTHS["hit"]
    ]
    return found.select(
        "query_id", *hits, F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("reciprocal_rank")
    )


def unjudgeable_counts(judgments: DataFrame) -> DataFrame:
    """Judgments without a grade, over the whole table and not only what was ranked."""
    return judgments.groupBy("query_id").agg(
        F.count_if(F.col("relevance").isNull()).alias("unjudgeable")
    )


def macro_average(metrics: DataFrame, run: str, names: list[str]) -> DataFrame:
    """Mean over queries per run; NULL metrics are left out of their mean."""
    return metrics.groupBy(run).agg(*[F.avg(n).alias(f"macro_{n}") for n in names])


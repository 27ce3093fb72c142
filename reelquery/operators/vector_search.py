"""Cosine search of a table of query vectors over a table of points.

Queries are cut into blocks of a bounded number of values and of results, always the same way, and stored
by block. A block is broadcast and the points are scanned once for it, column-pruned, without a shuffle: each
task scores its batches against the block in tiles of bounded rows x queries, and keeps in flat arrays only
what can still reach a result (the best K identities per query variant and collection). So its memory depends
neither on the length of the vectors nor on the number of queries, and the exchange carries K rows per task,
not the scores. With more than one block, each block's result is written before the next is fetched, so
one block at a time is on the driver, read from its own folder.

A query row belongs to one ``collection`` or, without that column (or null), to all; a point is scored by
the queries of its collection whose vectors have its length, so every channel can have its own model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelquery import constants as C
from reelquery.functions import vectors as V
from reelquery.operators import topk_tasks as tasks
from reelquery.operators.ordered import top_per_group
from reelquery.session import checkpointed, shared_folder

#: Values of one broadcast block (doubles: 32 MB), and results a task keeps for it; a query is never split.
BLOCK_VALUES = 4_000_000
BLOCK_RESULTS = 2_000_000
SALTS = 16


def _points(points: DataFrame, grouped: bool) -> DataFrame:
    """Identity = scene for the grouped channel, else the point; a point without a scene cannot
    be grouped and is left out there, as a group-by on a missing payload key does."""
    identity: Column = F.col("point_id").cast("string")
    if grouped:
        is_grouped = F.col("collection") == C.GROUPED_CHANNEL
        points = points.filter(~is_grouped | F.col("scene_id").isNotNull())
        identity = F.when(is_grouped, F.col("scene_id")).otherwise(identity)
    scope = F.col("library_id") if "library_id" in points.columns else F.lit(None).cast("string")
    return points.select(
        "point_id", "collection", identity.alias("identity"), scope.alias("scope"), "embedding"
    )


def _query_rows(queries: DataFrame) -> DataFrame:
    """Query rows with a usable vector; ``collection`` is null for a row that asks them all."""
    channel = F.col("collection") if "collection" in queries.columns else F.lit(None).cast("string")
    scopes = F.col("library_ids") if "library_ids" in queries.columns else F.lit(None).cast("array<string>")
    return queries.select(
        "query_id", F.col("variant_order").cast("int").alias("variant_order"),
        F.col("weight").cast("double").alias("weight"), channel.alias("collection"),
        scopes.alias("scopes"), V.as_double(F.col("query_embedding")).alias("query_embedding"),
    ).filter(F.size("query_embedding") > 0)


def _per_block(points: DataFrame, queries: DataFrame, task, schema: str, depth: int = 1) -> DataFrame:
    """Rows of ``task(batches, block)`` over all points, for every block of queries.

    ``depth``: rows the task keeps for a query.
    """
    spark = points.sparkSession
    rows = checkpointed(_query_rows(queries))
    size = rows.agg(F.coalesce(F.sum(F.size("query_embedding")), F.lit(0)).alias("values"), F.count("*").alias("n")).first()
    need = max(size["values"] / BLOCK_VALUES, size["n"] * depth / BLOCK_RESULTS)
    # Rows are dealt by hash, so blocks come out uneven: twice as many as would just do.
    n_blocks = 1 if need <= 1 else math.ceil(2 * need)
    if n_blocks > 1:
        number = F.pmod(F.xxhash64("query_id", "variant_order", "collection"), F.lit(n_blocks)).cast("int")
        path = shared_folder(spark)
        rows.withColumn("block", number).repartition("block").write.partitionBy("block").parquet(path)
        stored = T.StructType([*rows.schema.fields, T.StructField("block", T.IntegerType())])
        rows = spark.read.schema(stored).parquet(path)
    parts = []
    for number in range(n_blocks):
        frame = (rows.filter(F.col("block") == number).drop("block") if n_blocks > 1 else rows).toPandas()
        if frame.empty:
            continue
        shared = spark.sparkContext.broadcast(tasks.block_of(frame))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return task(batches, shared.value)

        part = points.mapInArrow(run, schema)
        if n_blocks > 1:
            part = checkpointed(part)
            shared.destroy()
        parts.append(part)
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def variant_hits(
    points: DataFrame, queries: DataFrame, depth: int, grouped: bool = True
) -> DataFrame:
    """Best ``depth`` identities per (query, variant, collection), exact.

    points: point_id, collection, scene_id, embedding; queries: query_id, variant_order, weight,
    query_embedding and, if channels have models of their own, collection. With library_id on the points
    and library_ids on the queries (null: all), only those libraries are searched. Score is the raw cosine of
    unit vectors, rounded (see ``topk_tasks``). Points no query can score are in ``unscorable``.
    """
    if "library_ids" in queries.columns and "library_id" not in points.columns:
        raise ValueError("queries name libraries, but points have no library_id")

    def task(batches, block):
        return tasks.best_hits(batches, block, depth)

    partial = _per_block(_points(points, grouped), queries, task, tasks.HIT_SCHEMA, depth)
    keys = ["query_id", "variant_order", "collection"]
    best = top_per_group(
        partial, [*keys, "identity"], [F.desc("score"), F.asc("point_id")], 1
    )
    return top_per_group(best, keys, [F.desc("score"), F.asc("point_id")], depth, "hit_rank", SALTS)


def score_summary(points: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query variant scored against every point, reduced in the task that scored it."""
    partial = _per_block(
        points.select("collection", "embedding"), queries, tasks.summaries, tasks.SUMMARY_SCHEMA
    )
    return partial.groupBy("query_id", "variant_order", "collection").agg(
        F.sum("n").alias("n_points"),
        F.round(F.sum("total") / F.sum("n"), 6).alias("mean_score"),
        F.round(F.min("low"), 6).alias("min_score"),
        F.round(F.max("high"), 6).alias("max_score"),
    )


def unscorable(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(point_id, collection, reason) of the points that no query vector can be compared with."""
    # One row per collection and vector size.
    sizes = _query_rows(queries).select(
        F.col("collection").alias("for_collection"), F.size("query_embedding").alias("size")
    ).distinct()
    vector = F.col("embedding")
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = F.when(vector.isNull(), "missing").when(broken, "not_finite")
    known = points.select("point_id", "collection", F.size(vector).alias("n"), reason.alias("reason"))
    fits = known.join(
        sizes,
        (known["n"] == sizes["size"]) & F.coalesce(sizes["for_collection"] == known["collection"], F.lit(True)),
        "left_anti",
    ).withColumn("reason", F.coalesce("reason", F.lit("size")))
    return fits.unionByName(
        known.filter("reason IS NOT NULL").join(fits.select("point_id", "collection"), ["point_id", "collection"], "left_anti")
    ).select("point_id", "collection", "reason")


def weighted(hits: DataFrame) -> DataFrame:
    return hits.withColumn("weighted_score", F.col("score") * F.col("weight"))


def best_variant(hits: DataFrame) -> DataFrame:
    """Per identity the hit with the largest score x weight; the earlier variant wins ties."""
    return top_per_group(
        weighted(hits), ["query_id", "collection", "identity"],
        [F.desc("weighted_score"), F.asc("variant_order")], 1,
    )


def channel_top(hits: DataFrame, depth: int) -> DataFrame:
    """Variants folded per identity, then the channel cut at ``depth``."""
    return top_per_group(
        best_variant(hits), ["query_id", "collection"],
        [F.desc("weighted_score"), F.asc("point_id")], depth, "channel_rank",
    )


def variant_evidence(hits: DataFrame) -> DataFrame:
    """All hits behind each identity with exactly one winner marked.

    A group holds at most one row per query variant.
    """
    window = Window.partitionBy("query_id", "collection", "identity").orderBy(
        F.desc("weighted_score"), F.asc("variant_order")
    )
    return weighted(hits).withColumn("winning", F.row_number().over(window) == 1)


def prototypes(points: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per key, scaled to unit length; null vectors do not count.

    Means are aggregated as vectors, map-side first, so a hot key sends one row per task.
    """
    dense = points.filter(F.col(vector).isNotNull()).select(
        key, array_to_vector(V.as_double(F.col(vector))).alias("v")
    )
    means = dense.groupBy(key).agg(Summarizer.mean(F.col("v")).alias("m"))
    return means.select(key, V.l2_normalize(vector_to_array("m")).alias(vector))


def masked_mean_pool(tokens: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """Mean of the token vectors whose mask is set, scaled to unit length."""
    return prototypes(tokens.filter(F.col(mask) > 0), key, vector)

"""Mixing sources to target weights by Sainte-Laguë apportionment of blocks.

A source's documents, in a seeded order, form one stream of words that is cut into blocks of ``BLOCK``
words and into ``SHARDS`` runs of consecutive blocks. Targets follow the weights; a target stops at
``PASSES`` times its source, and what is over goes to the others by weight until none is above.

Blocks are allotted by highest quotients: a source with target v that has k blocks competes with
v / (2k + 1), so quotas are whole numbers and add up exactly. A source's quota is whole passes over its
stream and a rest of single blocks. The rest is apportioned to its shards the same way, and a seeded
permutation of each shard picks that many of its blocks, so no block is taken more often than ``PASSES``
times and a rerun takes the same ones.

Scale: texts are only counted where they are scanned. Documents are dealt by a hash of their id into
``BUCKETS`` buckets a source: bucket totals give every document its place in the stream, and a hot
source spreads over all its buckets. Nothing is ranked block by block. A table of sources is ranked in
range slices, and only near the quotient where the blocks run out: about four rows a source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelquery.llm.common import SPACE_CLASS
from reelquery.session import checkpointed

WEIGHTS = (3, 1, 2)
#: Words the mix takes, as a share of all words in hundredths.
SHARE = 150
PASSES = 2
BLOCK = 16
SHARDS = 64
BUCKETS = 1 << 14
SEED = 11

_WORD = f"[^{SPACE_CLASS}]+"
#: Blocks of a document that one step of a task looks at.
_STEP = 1 << 20


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, copies): words of each document; equal rows are one with their number."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
    )
    return rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))


def _ranked(rows: DataFrame, order: list, sums: dict) -> DataFrame:
    """Adds ``place`` (from 0) and ``sums`` over the rows before, along one order of all rows.

    Rows are cut into range slices, and the totals of the slices before (one row a slice) are added.
    """
    sliced = checkpointed(rows.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()))
    before = Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy("slice").agg(F.count("*").alias("place_of"), *[F.sum(c).alias(f"{n}_of") for n, c in sums.items()])
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    names = ["place", *sums]
    offsets = totals.select("slice", *[F.coalesce(F.sum(f"{n}_of").over(earlier), F.lit(0)).alias(f"{n}_of") for n in names])
    local = sliced.withColumns({
        "place": F.count("*").over(before), **{n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()},
    })
    placed = local.join(F.broadcast(offsets), "slice")  # a row a slice
    return placed.withColumns({n: F.col(n) + F.col(f"{n}_of") for n in names}).drop("slice", *[f"{n}_of" for n in names])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): sources by code point, null last.

    With the sources in order of size over weight, those that reach their limit come first; the level of
    the others is what is left over the weights that are left.
    """
    order = [F.col("source").isNull(), F.col("source")]
    weighted = _ranked(sources, order, {}).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    )
    by_need = [F.col("source_size") / F.col("weight"), *order]
    filled = checkpointed(_ranked(weighted.drop("place"), by_need, {
        "size_before": F.col("source_size"), "weight_before": F.col("weight"),
    }))
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left = share / 100 * (whole["size"] or 0) - passes * F.col("size_before")
    level = left / (F.lit(whole["weight"] or 0) - F.col("weight_before"))
    open_ = filled.withColumn("level", level).where(passes * F.col("source_size") > F.col("level") * F.col("weight"))
    # The first open source has the level of all that are open; later ones come out the same but for rounding.
    first = open_.agg(F.min_by("level", "place")).first()[0]
    limit = (passes * F.col("source_size")).cast("double")
    aim = limit if first is None else F.least(limit, F.lit(first) * F.col("weight"))
    return filled.select("source", "source_size", aim.alias("target"))


def apportioned(parties: DataFrame, total_votes, seats) -> tuple:
    """Columns (sure, most) of a party with ``votes``: seats it has in any case, and a bound it stays within.

    For n ``parties``, rounding the shares of seats - n takes too few seats together and rounding those of
    seats + n enough, so the quotients that decide lie between.
    """
    share = F.col("votes") / total_votes
    sure = F.greatest(F.floor(share * (seats - parties) + 0.5), F.lit(0))
    return sure, F.floor(share * (seats + parties) + 0.5)


def _quotients(rows: DataFrame) -> DataFrame:
    """A row per quotient between ``sure`` and ``most``."""
    seats = F.when(F.col("most") > F.col("sure"), F.sequence("sure", F.col("most") - 1))
    return rows.withColumn("seat", F.explode(seats)).withColumn("quotient", F.col("votes") / (2 * F.col("seat") + 1))


def source_quotas(aims: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, quota): blocks of every source, in all the rounded sum of targets over ``block``."""
    votes = aims.select("source", F.col("target").alias("votes"))
    whole = votes.agg(F.sum("votes").alias("votes"), F.count("*").alias("parties")).first()
    seats = math.floor((whole["votes"] or 0) / block + 0.5)
    sure, most = apportioned(F.lit(whole["parties"]), F.lit(whole["votes"]), F.lit(seats))
    cut = checkpointed(votes.where("votes > 0").withColumns({"sure": sure, "most": most}))
    given = cut.agg(F.sum("sure")).first()[0] or 0
    order = [F.desc("quotient"), F.col("source").isNull(), F.col("source")]
    ranked = _ranked(_quotients(cut), order, {}).where(F.col("place") < seats - given)
    won = ranked.groupBy("source").agg(F.count("*").alias("won"))
    both = cut.select("source", "sure").join(won.withColumnRenamed("source", "winner"), F.col("source").eqNullSafe(F.col("winner")), "left")
    return both.select("source", (F.col("sure") + F.coalesce("won", F.lit(0))).cast("long").alias("quota"))


def shard_quotas(rests: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(source, length, quotas): from whole ``blocks`` and the ``rest`` of them to take, the blocks of a shard and
    the quota of each. A source has at most ``shards`` shards, so its window is bounded.
    """
    length = F.greatest(F.ceil(F.col("blocks") / shards), F.lit(1)).cast("long")
    cut = rests.withColumn("length", length).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    cut = cut.withColumn("votes", F.greatest(F.least("length", F.col("blocks") - F.col("shard") * F.col("length")), F.lit(0)))
    sure, most = apportioned(F.lit(shards), F.greatest("blocks", F.lit(1)), F.col("rest"))
    cut = cut.withColumns({"sure": sure, "most": most})
    per = Window.partitionBy("source")
    open_ = F.col("rest") - F.sum("sure").over(per)
    cut = cut.withColumn("open", open_)
    order = Window.partitionBy("source").orderBy(F.desc("quotient"), "shard")
    won = _quotients(cut).withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("open"))
    counts = cut.select("source", "shard", "length", F.col("sure").alias("n")).union(
        won.select("source", "shard", "length", F.lit(1).cast("long"))
    ).groupBy("source", "length", "shard").agg(F.sum("n").cast("long").alias("n"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("shard", "n"))), lambda s: s["n"])
    return counts.groupBy("source", "length").agg(listed.alias("quotas"))


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each ``x`` below ``n`` in a seeded permutation of 0 to n - 1 (a Feistel network of four
    rounds over the next power of four; places beyond n walk on).
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1)).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    at, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = at[todo] >> h, at[todo] & m
        for turn in range(4):
            mixed = (right + k + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(29)
            left, right = right, left ^ (mixed & m)
        at[todo] = left << h | right
        todo = todo[at[todo] >= n[todo].astype(np.uint64)]
    return at.astype(np.int64)


def _picked(batch: dict[str, np.ndarray], block: int) -> np.ndarray:
    """Words of picked single blocks in each document: rows with start, size, blocks, length, first, quotas, key."""
    start, size = batch["start"], batch["size"]
    first = start // block
    last = np.minimum((start + size - 1) // block, batch["blocks"] - 1)  # a short last block is no single block
    counts = np.where(size > 0, np.maximum(last - first + 1, 0), 0)
    words = np.zeros(len(start), np.int64)
    quotas, offsets = batch["quotas"], batch["offsets"]
    ends = np.cumsum(counts)
    for low in range(0, int(ends[-1]) if len(ends) else 0, _STEP):
        flat = np.arange(low, min(low + _STEP, int(ends[-1])))
        row = np.searchsorted(ends, flat, side="right")
        j = first[row] + flat - (ends[row] - counts[row])
        length = batch["length"][row]
        shard = j // length
        n = np.minimum(length, batch["blocks"][row] - shard * length)
        quota = quotas[offsets[row] + shard - batch["first"][row]]
        key = (batch["key"][row].view(np.uint64) + shard.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        inside = np.minimum((j + 1) * block, (start + size)[row]) - np.maximum(j * block, start[row])
        open_ = quota > 0
        taken = np.zeros(len(flat), bool)
        taken[open_] = permuted((j - shard * length)[open_], n[open_], key[open_]) < quota[open_]
        np.add.at(words, row[taken], inside[taken])
    return words


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, passes: int = PASSES,
    block: int = BLOCK, shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, passes, taken), one row per input row.

    ``taken``: words of the document in the mix, repeats counted. ``passes``: whole passes over its source.
    The words taken of a source differ from its target by at most about a block and a half. Null texts have
    no words; a null source is a source of its own, the last. Rows that repeat each have their own place
    in the stream. Sources without words have target 0. A source at its limit is taken whole, ``passes`` times. Empty table: no rows. Other columns are ignored.
    """
    mark = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = checkpointed(sizes(docs).withColumn("mark", mark))
    bucketed = sized.withColumn("bucket", F.pmod("mark", F.lit(BUCKETS)))
    loads = checkpointed(bucketed.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("load")))
    aims = checkpointed(targets(loads.groupBy("source").agg(F.sum("load").alias("source_size")), weights, share, passes))
    quotas = source_quotas(aims, block).withColumnRenamed("source", "party")
    most = F.lit(passes) * F.col("source_size")
    asked = F.least(F.coalesce(F.col("quota"), F.lit(0)) * block, most)
    words = F.when(F.col("target") >= most, most).otherwise(asked)  # at its limit: all of it, the odd words too
    whole = F.floor(words / F.greatest("source_size", F.lit(1))).cast("long")
    blocks = F.floor(F.col("source_size") / block).cast("long")
    rest = F.least(F.round((words - whole * F.col("source_size")) / block), blocks).cast("long")
    rests = checkpointed(aims.join(quotas, F.col("source").eqNullSafe(F.col("party")), "left").select(
        "source", "source_size", "target", whole.alias("whole"), blocks.alias("blocks"), rest.alias("rest")
    ))
    planned = rests.join(
        shard_quotas(rests, shards).withColumnRenamed("source", "party"), F.col("source").eqNullSafe(F.col("party"))
    ).select(F.col("source").alias("origin"), "source_size", "target", "whole", "blocks", "length", "quotas")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most BUCKETS rows a source; each carries the quotas of the shards it meets.
    based = loads.withColumn("base", F.coalesce(F.sum("load").over(earlier), F.lit(0)))
    span = F.lit(block) * F.col("length")
    low = F.floor(F.col("base") / span).cast("int")
    high = F.floor((F.col("base") + F.col("load")) / span).cast("int")
    plan = based.join(planned, F.col("source").eqNullSafe(F.col("origin"))).select(
        F.col("source").alias("origin"), F.col("bucket").alias("cell"), "base", "source_size", "target", "whole", "blocks",
        "length", low.alias("first"), F.slice("quotas", low + 1, high - low + 1).alias("quotas"),
    )
    inside = Window.partitionBy("source", "bucket").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    met = placed.join(plan, F.col("source").eqNullSafe(F.col("origin")) & (F.col("bucket") == F.col("cell")))
    copies = met.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    ready = copies.select(
        "doc_id", "source", "size", "source_size", "target", F.col("whole").alias("passes"), "blocks", "length", "first", "quotas",
        (F.col("base") + F.col("before") + F.col("copy") * F.col("size")).alias("start"),
        F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("key"),
    )
    kept = ["doc_id", "source", "size", "source_size", "target", "passes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = {n: batch[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "size", "blocks", "length", "first", "key")}
            lists = batch["quotas"]
            numbers["quotas"] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            numbers["offsets"] = np.cumsum(counts) - counts
            taken = numbers["size"] * batch["passes"].to_numpy(zero_copy_only=False) + _picked(numbers, block)
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), pa.array(taken, pa.int64())], [*kept, "taken"])

    return ready.mapInArrow(
        run, "doc_id long, source string, size long, source_size long, target double, passes long, taken long"
    )

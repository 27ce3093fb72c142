"""Exact duplicates through an extendible-hash index on shared files.

A text's key is the 64-bit hash of its normalised form. The directory starts with one bucket; as long as
a bucket holds more distinct keys than its capacity, it splits by one more leading key bit (directory
doubling), so the number of buckets follows the data. Slots (distinct texts) are found by comparing whole
normalised bytes under their key: different texts under one key become a chain. Owner tasks each take a
range of buckets, number the chains and write the slots, without texts, as index files in the shared
folder; every document then looks its slot up.

Scale: one exchange of texts, pre-aggregated in the map tasks, so a hot text sends one row per task; all
else is narrow rows. The directory has at most ``2 ** MAX_DEPTH`` rows, which bounds its broadcast; a
bucket that is still overfull there just has more slots (an overflow chain). DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelquery.llm.common import ascii_lower, texts
from reelquery.session import checkpointed

#: Distinct texts a bucket holds before it splits, and the most leading key bits the directory uses.
BUCKET_CAPACITY = 20_000
MAX_DEPTH = 16


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, norm): the normalised text and its key; a null text is empty."""
    rows = texts(docs).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    return rows.select("doc_id", F.xxhash64("norm").alias("key"), "norm")


def directory(slots: DataFrame, capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """(cell, depth, bucket) for every directory cell in use, from slots with their ``key``.

    A cell is a prefix of ``MAX_DEPTH`` key bits. The directory doubles until the cell's bucket, the
    shortest prefix that suffices, holds at most ``capacity`` slots; a cell that is too full by itself
    keeps ``MAX_DEPTH``. At most ``2 ** MAX_DEPTH`` rows. Equal keys always share a bucket.
    """
    cells = slots.groupBy(_cell(F.col("key")).alias("cell")).agg(F.count("*").alias("n"))
    levels = cells.select(
        "cell", "n", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth")
    ).withColumn("prefix", F.expr(f"shiftright(cell, {MAX_DEPTH} - depth)"))
    fits = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("load")).where(
        (F.col("load") <= capacity) | (F.col("depth") == MAX_DEPTH)
    )
    # ``fits`` has fewer than twice as many rows as there can be cells.
    depths = levels.join(F.broadcast(fits), ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    # Left-aligned prefixes keep buckets in key order.
    return depths.withColumn(
        "bucket", F.expr(f"shiftleft(shiftright(cell, {MAX_DEPTH} - depth), {MAX_DEPTH} - depth)")
    )


def _cell(key):
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH)


def build_index(docs: DataFrame, capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """The index files: one row per distinct text, in key ranges, without the texts.

    Columns: bucket, depth, key, chain (0, 1, ... among the texts that collide under a key),
    text_sha256, keep_id (largest doc_id), group_size.
    """
    # Grouping by the text itself compares whole bytes; its map-side part folds hot groups.
    slots = checkpointed(
        keyed(docs).groupBy("key", "norm").agg(
            F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
        ).select("key", F.sha2(F.col("norm"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    cells = directory(slots, capacity)
    owned = slots.join(F.broadcast(cells), _cell(slots["key"]) == cells["cell"]).drop("cell")
    in_key = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    ranged = owned.repartitionByRange("bucket", "key")
    return checkpointed(
        ranged.withColumn("chain", F.row_number().over(in_key) - 1).select(
            "bucket", "depth", "key", "chain", "text_sha256", "keep_id", "group_size"
        )
    )


def exact_duplicates(docs: DataFrame, capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, chain), one row per input row.

    Texts are equal when identical after lower-casing A-Z; a null text is empty. The largest doc_id of
    a group stays. Rows that repeat a doc_id count one by one in ``group_size`` and are all returned;
    a group whose doc_ids are all null has a null ``keep_id`` and nothing of it is kept. Empty table: no
    rows. Other columns of ``docs`` are ignored.
    """
    index = build_index(docs, capacity)
    looked_up = keyed(docs).select("doc_id", "key", F.sha2(F.col("norm"), 256).alias("text_sha256"))
    return looked_up.join(
        index.select("key", "text_sha256", "keep_id", "group_size", "chain"), ["key", "text_sha256"]
    ).select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        "text_sha256", "chain",
    )


def keep_one(docs: DataFrame, capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """The rows of ``docs``, all columns, that have the largest doc_id of their group.

    Rows that repeat that doc_id with an equal text stay with it; a group whose doc_ids are all null
    stays.
    """
    index = build_index(docs, capacity).select(
        F.col("key").alias("_key"), F.col("text_sha256").alias("_sha256"), F.col("keep_id").alias("_keep")
    )
    norm = ascii_lower(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(
        index,
        (F.xxhash64(norm) == index["_key"]) & (F.sha2(norm, 256) == index["_sha256"])
        & docs["doc_id"].cast("long").eqNullSafe(index["_keep"]),
        "left_semi",
    )

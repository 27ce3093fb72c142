"""SimHash near-duplicates with the pigeonring filter.

The 64 bits are cut into ``SEGMENTS`` consecutive segments laid out as a ring. If two fingerprints differ
in at most ``BUDGET`` bits, some segment starts a chain whose first l segments differ together in at most
l * BUDGET / SEGMENTS bits, for every l. For three segments and two bits: the first segment is equal,
the first two differ in at most one bit, all three in at most two. So a fingerprint stays a candidate
only if, for some start, another one shares the first segment (chain length 1) and then also the second
one up to one bit (chain length 2); everything else is pruned. The second length is met in two steps: up to
one bit, one half of the second segment is equal too, so fingerprints first meet in the first segment with
a half of the next (31 to 33 bits, two rows each, so that few meet by accident), and only those that do are
compared without each bit of the second segment.

Full check: candidates of one chain start differ only in the other 43 bits. Two of them are within two
bits exactly if flipping at most one of those bits in each gives the same value, so each candidate sends
itself and its 43 one-bit neighbours, and those that meet in a value are linked to the smallest of them.
The links number at most 44 per candidate and start, however large a group of near copies is, and lose
no pair: no two fingerprints are ever paired up inside a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import texts
from reelquery.llm.components import components
from reelquery.session import checkpointed

SHINGLE = 3
SEED = 42
BUDGET = 2
#: Bits of each segment of the ring, from the lowest bit up.
SEGMENTS = (22, 21, 21)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles in order; fewer words than a shingle are one, no words none."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words)
    if n < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, last = xxhash.xxh64_intdigest, shingle - 1
    return np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts[: n - last].tolist(), ends[last:].tolist(), strict=True)),
        np.uint64, n - last,
    )


def fingerprint(text: str) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the word shingles, repeats included."""
    hashes = shingle_hashes(text)
    return majority(hashes) if len(hashes) else 0


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.fromiter((fingerprint(t.as_py()) for t in batch["text"]), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(marks.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer; no words: 0."""
    return texts(docs).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _met(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of ``rows`` whose key is shared by two different fingerprints (both sides stay narrow)."""
    shared = rows.groupBy(*key).agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    return rows.join(shared.where("low <> high").select(*key), list(key), "left_semi")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp``; joined up, exactly those within ``BUDGET`` bits."""
    edges = []
    offsets = [sum(SEGMENTS[:i]) for i in range(3)]
    for i in range(3):
        second, third = (i + 1) % 3, (i + 2) % 3
        # Chain of length 1, with the half of the next segment that a chain of length 2 leaves equal.
        cut = SEGMENTS[second] // 2
        parts = [((1 << cut) - 1) << offsets[second], ((1 << (SEGMENTS[second] - cut)) - 1) << (offsets[second] + cut)]
        halves = [part | ((1 << SEGMENTS[i]) - 1) << offsets[i] for part in parts]
        half = distinct.select("fp", F.explode(_longs(halves)).alias("half")).withColumn(
            "key", F.col("fp").bitwiseAND(F.col("half"))
        )
        first = _met(half, "key", "half").select("fp").distinct()
        # Chain of length 2: the second segment differs in at most one bit, so it is equal without it.
        masks = [1 << (offsets[second] + b) for b in range(SEGMENTS[second])]
        two = _long(sum(((1 << SEGMENTS[s]) - 1) << offsets[s] for s in (i, second)))
        chain = first.select("fp", F.explode(_longs(masks)).alias("skip")).withColumn(
            "key", F.col("fp").bitwiseAND(two).bitwiseAND(F.bitwise_not(F.col("skip")))
        )
        kept = _met(chain.select("fp", "key", "skip"), "key", "skip").select("fp").distinct()
        # All three: values at most one flip away, within the two later segments.
        flips = [0] + [1 << (offsets[s] + b) for s in (second, third) for b in range(SEGMENTS[s])]
        balls = kept.select("fp", F.explode(_longs(flips)).alias("flip")).select(
            "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub")
        )
        hubs = balls.groupBy("hub").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
        edges.append(balls.join(hubs.select("hub", "low"), "hub").where("fp <> low").select(
            F.col("fp").alias("a"), F.col("low").alias("b")
        ))
    return edges[0].union(edges[1]).union(edges[2]).distinct()


def _longs(values: list[int]):
    return F.array(*map(_long, values))


def _long(bits: int):
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    ``component_id`` is the smallest doc_id reachable over links of at most ``BUDGET`` differing bits, the
    document itself included. Null and empty texts have fingerprint zero and link like any other. Rows
    that repeat a doc_id each count; null doc_ids are never the smallest unless all are null. Empty table:
    no rows. Other columns are ignored.
    """
    marked = checkpointed(fingerprints(docs))
    firsts = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = components(links(firsts.select("fp")))
    classes = firsts.join(labels, firsts["fp"] == labels["node"], "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label")
    )
    smallest = classes.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_mark = classes.join(smallest, "label").select("fp", "component_id")
    return marked.join(of_mark, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that have the smallest doc_id of their component.

    Rows that repeat that doc_id stay with it; a component whose doc_ids are all null stays.
    """
    marked = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = checkpointed(marked.select(F.col("doc_id").alias("stays")).distinct())
    return docs.join(stays, docs["doc_id"].cast("long").eqNullSafe(stays["stays"]), "left_semi")

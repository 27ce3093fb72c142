"""Near copies by the Jaccard similarity of their word shingles, without loss.

Two texts are linked if the sets of their shingles (``SHINGLE`` words; a shorter text is one shingle)
share at least ``SIMILARITY``. SimHash fingerprints of the same shingles come first: the pairs that the
pigeonring filter finds within its bits (``simhash.links``) are checked exactly and linked. A 64-bit
fingerprint cannot hold the bound, though: pairs at 0.8 differ in any number of bits. So what the ring
leaves apart is met in prefixes, an exact way for the rest. Shingles have one fixed order: those frequent
in a sample of the documents last, else by hash. Sets that reach the similarity then share ``SHARED`` of their
first n - ceil(0.8 n) + ``SHARED`` shingles (or all they must share, if that is less), whatever the order; the
sample only saves work.

The sets that share a prefix shingle form a block. The pairs of a block of up to ``SMALL`` sets are listed where
sizes and places in the order allow the similarity, and a pair listed often enough is a candidate: two sets
that have one rare shingle in common by accident are none. In a larger block every set is compared with one of
them, then, where that leaves the block apart, with a few more, picked by hash (so that the blocks of a group
pick up to ``HUBS`` different ones); a large group of near copies costs few comparisons a set. What is still
apart there is compared pair by pair, unless sizes, places or sketches rule it out. A sketch has a bit
for each of 2,048 parts of the range of hashes; a bit that only one of two sets has stands for a shingle that
only it has, so sketches bound what two sets share, exactly, before any text is moved.
Each comparison is exact, on all shingles of both texts, and made only between sets not yet joined.

Scale: texts are shingled once; one exchange of (shingle, set) over prefixes, read as a stream in shingle order;
only texts of candidates are compared. The sample and its list of frequent shingles are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import texts
from reelquery.llm.components import components
from reelquery.llm.simhash import links as ring_links
from reelquery.llm.simhash import majority, shingle_hashes
from reelquery.session import checkpointed

SHINGLE = 5
#: As a fraction in whole numbers, so that the bound itself is met exactly.
SIMILARITY = (4, 5)
SAMPLE_DOCS = 20_000
#: A shingle of so many documents of the sample goes last; so many of these are listed at most.
FREQUENT, FREQUENT_LISTED = 3, 200_000
#: Prefix shingles that a candidate shares, and the most sets of a block whose pairs are listed.
SHARED, SMALL = 3, 32
#: Different sets that the blocks of one group may pick for the second round, and how many a block picks.
HUBS, PICKS = 16, 4
#: Bits of a set's sketch: a power of two. A shingle sets the bit that the leading bits of its hash name.
SKETCH_BITS = 2048


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def set_mark(shingles: np.ndarray) -> int:
    """One signed number for a set of shingles; no shingle: 0."""
    folded = shingles * np.uint64(0x9E3779B97F4A7C15)
    folded ^= folded >> np.uint64(29)
    folded *= np.uint64(0xBF58476D1CE4E5B9)
    folded ^= folded >> np.uint64(32)
    return int(np.add.reduce(folded, dtype=np.uint64).view(np.int64)) if len(shingles) else 0


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The bits of a set, as signed 64-bit numbers."""
    bits = np.zeros(SKETCH_BITS, np.uint8)
    bits[shingles >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def reaches(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return similarity[1] * common >= similarity[0] * (len(a) + len(b) - common)


def prefix(shingles: np.ndarray, frequent: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """The first shingles of a sorted set; ``frequent`` is sorted by hash, with the place in the order behind."""
    n = len(shingles)
    take = min(n, n - -(-similarity[0] * n // similarity[1]) + SHARED)
    if take and len(frequent):
        at = np.minimum(np.searchsorted(frequent["hash"], shingles), len(frequent) - 1)
        place = np.where(frequent["hash"][at] == shingles, frequent["place"][at], 0)
        shingles = shingles[np.argsort(place, kind="stable")]
    return shingles[:take]


def _frequent(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles frequent in a sample, with places from 1 up by their number of documents."""
    every = max(1, docs.count() // SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch["text"]:
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), shingle).view(np.int64))], ["hash"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    counts = sample.mapInArrow(run, "hash long").groupBy("hash").count().where(F.col("count") >= FREQUENT)
    rows = counts.orderBy(F.desc("count"), "hash").limit(FREQUENT_LISTED).toPandas()
    listed = np.zeros(len(rows), [("hash", np.uint64), ("place", np.int64)])
    listed["hash"] = rows["hash"].to_numpy(np.int64).view(np.uint64)
    listed["place"] = np.arange(len(rows), 0, -1)
    return np.sort(listed, order="hash")


def _marks(docs: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """(doc_id, text_key, node, n, fp, bits, keys): hash of a row's text; mark, size, fingerprint, sketch and prefix of its set."""
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, marks, bits, keys = [], [], [], [], []
            for text in batch["text"]:
                hashes = shingle_hashes(text.as_py(), shingle)
                shingles = np.unique(hashes)
                nodes.append(set_mark(shingles))
                sizes.append(len(shingles))
                marks.append(majority(hashes) if len(hashes) else 0)
                bits.append(sketch(shingles))
                keys.append(prefix(shingles, sent.value, similarity).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(bits, pa.list_(pa.int64())),
                 pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "node", "n", "fp", "bits", "keys"],
            )

    return docs.mapInArrow(run, "doc_id long, text_key long, node long, n long, fp long, bits array<long>, keys array<long>")


_BLOCK_ROW = [("key", np.int64), ("node", np.int64), ("place", np.int64), ("n", np.int64)]
_BLOCKS = "key long, a long, b long, place long, n long"


def _listed(rows: np.ndarray, starts: np.ndarray, size: int, similarity: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """(a, b, how often they must be listed) of the possible pairs in the blocks of one size, a < b."""
    small, large = similarity
    left, right = np.triu_indices(size, 1)
    mine, other = (rows[(starts[:, None] + at).ravel()] for at in (left, right))
    both = mine["n"] + other["n"]
    must = -(-small * both // (small + large))
    # If a pair reaches the similarity, its first SHARED common shingles leave enough behind them.
    behind = np.minimum(mine["n"] - mine["place"], other["n"] - other["place"]) - 1
    fits = (behind + SHARED >= must) & (mine["n"] * large >= other["n"] * small) & (other["n"] * large >= mine["n"] * small)
    return mine["node"][fits], other["node"][fits], np.minimum(must, SHARED)[fits]


def _block_batches(similarity: tuple[int, int]):
    """Blocks with two sets or more, from rows in order of (key, node): of small ones the pairs (no key, a, b, no
    place, n: how often they must be listed), of others the rows (key, a: set, b: first set, place, n)."""

    def out(key, a, b, place, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (key, a, b, place, n)], ["key", "a", "b", "place", "n"])

    def of_block(rows: np.ndarray, first: int) -> pa.RecordBatch:
        return out(rows["key"], rows["node"], np.full(len(rows), first), rows["place"], rows["n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, _BLOCK_ROW)  # the block that may go on in the next batch
        going = None  # key, first set and last set of a large block that was given out up to here
        for batch in batches:
            new = np.zeros(len(batch), _BLOCK_ROW)
            for name, _ in _BLOCK_ROW:
                new[name] = batch[name].to_numpy()
            rows = np.concatenate((held, new))
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
            rows = rows[fresh]
            if going and len(rows):
                more = int(np.searchsorted(rows["key"], going[0], "right"))
                if more:
                    yield of_block(rows[:more][rows["node"][:more] != going[2]], going[1])
                    going = (going[0], going[1], int(rows["node"][more - 1]))
                rows = rows[more:]
            if not len(rows):
                held = rows
                continue
            starts = np.flatnonzero(np.concatenate(([True], rows["key"][1:] != rows["key"][:-1])))
            sizes = np.diff(np.append(starts, len(rows)))
            for at in np.flatnonzero(sizes > SMALL).tolist():
                block = rows[starts[at] : starts[at] + sizes[at]]
                yield of_block(block, block["node"][0])
            held, going = rows[starts[-1] :], None
            if len(held) > SMALL:
                held, going = held[:0], (int(held["key"][0]), int(held["node"][0]), int(held["node"][-1]))
            yield from pairs(rows, starts[:-1], sizes[:-1])
        if len(held):
            yield from pairs(held, np.zeros(1, np.int64), np.array([len(held)]))

    def pairs(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for size in range(2, SMALL + 1):
            if (here := starts[sizes == size]).size:
                a, b, must = _listed(rows, here, size, similarity)
                none = pa.nulls(len(a), pa.int64())
                yield out(none, a, b, none, must)

    return run


def _compared(pairs: DataFrame, wanted: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of set marks whose texts in ``wanted`` (node, text) reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, seen = [], {}
            for a, b, mine, theirs in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["mine"], batch["theirs"], strict=True):
                if a not in seen:
                    seen = {a: shingle_set(mine.as_py(), shingle)}
                kept.append(reaches(seen[a], shingle_set(theirs.as_py(), shingle), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    mine = wanted.select(F.col("node").alias("a"), F.col("text").alias("mine"))
    theirs = wanted.select(F.col("node").alias("b"), F.col("text").alias("theirs"))
    return checkpointed(pairs.join(mine, "a").join(theirs, "b").select("a", "b", "mine", "theirs").mapInArrow(run, "a long, b long"))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) after more links; only the labels that they join are united again."""
    if labels is None:
        return components(links)
    ends = [labels.toDF(x, f"l{x}") for x in "ab"]
    between = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")
    )
    united = components(between)
    moved = labels.join(united.toDF("label", "low"), "label", "left").select("node", F.coalesce("low", "label").alias("label"))
    return checkpointed(moved.union(united.join(labels, "node", "left_anti").select("node", "label")))


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) that the labels leave apart."""
    ends = [labels.toDF(x, f"l{x}") for x in "ab"]
    return pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").where(
        F.coalesce("la", "a") != F.coalesce("lb", "b")
    ).select("a", "b")


def _apart(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, place, n, label) of the blocks that the labels leave in two components or more."""
    labelled = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return checkpointed(labelled.join(apart.select("key"), "key", "left_semi").select("key", "node", "place", "n", "label"))


def _ring_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of sets whose fingerprints are equal or within the bits of the pigeonring filter; joined up, all."""
    marks = checkpointed(sets.groupBy("fp").agg(F.min("node").alias("head")))
    ends = [marks.toDF(x, f"h{x}") for x in "ab"]
    near = ring_links(marks.select("fp")).join(ends[0], "a").join(ends[1], "b").select("ha", "hb")
    same = sets.join(marks, "fp").where("node <> head").select("head", "node")
    return near.union(same).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, component_id), one row per input row.

    ``component_id`` is the smallest doc_id reachable over links, the document itself included. Texts
    with the same set are linked, null and empty ones too. Null doc_ids are the smallest only among
    themselves. Empty table: no rows. Other columns are ignored.
    """
    rows = texts(docs).withColumn("text_key", F.xxhash64("text"))
    marked = checkpointed(_marks(rows, shingle, similarity))
    sets = checkpointed(marked.groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min("n").alias("n"), F.min("text_key").alias("text_key"),
        F.min("fp").alias("fp"), F.first("bits").alias("bits"),
    ))
    blocks = checkpointed(
        marked.select("node", "n", F.posexplode("keys").alias("place", "key")).select("key", "node", F.col("place").cast("long"), "n")
        .repartition("key").sortWithinPartitions("key", "node").mapInArrow(_block_batches(similarity), _BLOCKS)
    )
    small, large = similarity
    enough = lambda most, a, b: (small + large) * most >= small * (F.col(a) + F.col(b))

    def fits(a: str, b: str):
        """Whether sizes and sketches leave two sets a chance: what only one sketch has is in one set only."""
        words = range(SKETCH_BITS // 64)
        alone = lambda x, y: sum(F.bit_count(F.col(x)[k].bitwiseAND(F.bitwise_not(F.col(y)[k]))) for k in words)
        sizes = (F.col(f"n{a}") * large >= F.col(f"n{b}") * small) & (F.col(f"n{b}") * large >= F.col(f"n{a}") * small)
        most = F.least(F.col(f"n{a}") - alone(f"s{a}", f"s{b}"), F.col(f"n{b}") - alone(f"s{b}", f"s{a}"))
        return sizes & enough(most, f"n{a}", f"n{b}")

    sketched = sets.select("node", "n", "bits")

    def possible(pairs: DataFrame) -> DataFrame:
        return checkpointed(
            pairs.join(sketched.toDF("a", "na", "sa"), "a").join(sketched.toDF("b", "nb", "sb"), "b").where(fits("a", "b")).select("a", "b")
        )

    # Candidates of the ring, of small blocks, and of large blocks with their first sets.
    ring = possible(_ring_pairs(sets))
    listed = possible(
        blocks.where("key IS NULL").groupBy("a", "b").agg(F.count("*").alias("times"), F.max("n").alias("must"))
        .where("times >= must").select("a", "b")
    )
    hot = blocks.where("key IS NOT NULL").select("key", F.col("a").alias("node"), "place", "n", F.col("b").alias("first"))
    stars = possible(hot.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    # Texts of the sets to compare, each once: one text of each set, found by its hash, so that
    # rows which share a doc_id or have none do not meet.
    met = ring.union(listed).select(F.explode(F.array("a", "b")).alias("node")).union(hot.select("node")).distinct()
    told = checkpointed(met.join(sets.select("node", "text_key"), "node"))
    wanted = checkpointed(
        rows.select("text_key", "text").join(told, "text_key").select("node", "text").mapInArrow(
            _own_texts(shingle), "node long, text string"
        ).dropDuplicates(["node"])
    )
    labels = _joined(None, _compared(ring, wanted, shingle, similarity))
    # The rest: first one candidate a set and the first sets of large blocks, then what these leave apart.
    few = listed.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(stars).distinct()
    labels = _joined(labels, _compared(checkpointed(_between(few, labels)), wanted, shingle, similarity))
    rest = _apart(hot.select("key", "node", "place", "n"), labels)
    picks = [F.min_by("node", F.xxhash64("node", F.pmod("key", F.lit(HUBS)), F.lit(pick))) for pick in range(PICKS)]
    hubs = rest.groupBy("key").agg(F.array_distinct(F.array(*picks)).alias("hubs"))
    tried = possible(rest.join(hubs, "key").select("node", F.explode("hubs").alias("hub")).where("node <> hub").select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")
    ).distinct())
    more = _between(listed.union(tried).distinct().join(few, ["a", "b"], "left_anti"), labels)
    labels = _joined(labels, _compared(checkpointed(more), wanted, shingle, similarity))
    # Last, in large blocks, what is still apart, pair by pair. With places i, j at most the smaller rest is shared if
    # this is the first shingle shared; later ones only find the pair again.
    rest = _apart(hot.select("key", "node", "place", "n"), labels).join(sets.select("node", "bits"), "node")
    mine, other = (
        rest.select("key", "node", "place", "n", "label", "bits").toDF("key", x, f"i{x}", f"n{x}", f"l{x}", f"s{x}") for x in "ab"
    )
    left = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    pairs = mine.join(other, (mine["key"] == other["key"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))
                      & enough(left + (SHARED - 1), "na", "nb") & fits("a", "b")).select("a", "b").distinct().join(
        few.union(tried), ["a", "b"], "left_anti"
    )
    labels = _joined(labels, _compared(checkpointed(pairs), wanted, shingle, similarity))
    classes = sets.join(labels, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
    smallest = classes.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_set = classes.join(smallest, "label").select("node", "component_id")
    return marked.select("doc_id", "node").join(of_set, "node").select("doc_id", "component_id")


def _own_texts(shingle: int):
    """Rows whose text really has the mark they were joined with: two texts may have one hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = [set_mark(shingle_set(t.as_py(), shingle)) == node for node, t in zip(batch["node"].to_pylist(), batch["text"], strict=True)]
            yield batch.filter(pa.array(right, pa.bool_()))

    return run


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that have the smallest doc_id of their component.

    Rows that repeat that doc_id stay with it; a component whose doc_ids are all null stays.
    """
    found = near_copies(docs).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    goes = checkpointed(found.where("NOT stays").select(F.col("doc_id").alias("goes")))
    return docs.join(goes, docs["doc_id"].cast("long").eqNullSafe(goes["goes"]), "left_anti")

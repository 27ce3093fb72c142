"""Removal of repeated word spans over a compacted de Bruijn graph of the corpus.

Every ``WINDOW`` consecutive words are an edge of the graph between their two (WINDOW - 1)-word ends. The
graph is compacted by minimizers: each edge is labelled with its smallest ``KMER``-word hash, and the
consecutive edges of a document that share that very k-mer form a path, at most ``WINDOW - KMER + 1``
edges long, that is handled as one row (about one row per eight words). Equal edges always carry the same
minimizer, so a repeat can only be among the paths of one minimizer. Spark joins then compact further:

* minimizers with a single path are dropped: nothing on it repeats;
* equal paths (same words throughout) collapse into one class; all but the earliest copy repeat whole;
* where a minimizer has one class, the path does not branch and its earliest copy is original;
* where it has several, the path branches; the source coordinates of each class's earliest copy lead back
  to the words, and these edges are compared one by one to find the earliest start of each.

Scale: paths are narrow rows; hot minimizers, classes and edges are pre-aggregated, and the joins that
bring results back are plain sort-merge joins, which AQE splits where a key is hot. Texts meet the
coordinates twice, compressed. What is gathered per document is bounded by that document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.session import checkpointed

WINDOW = 20
KMER = 6
#: Windows of a very long text handled at a time; bounds memory and the room for positions below.
SEGMENT = 1 << 16
_POSITION_BITS = np.uint64(17)

_PATHS = "doc_id long, tag int, start int, n int, minimizer long, path long"
_EDGES = "doc_id long, tag int, start int, high long, low long"
_ROWS = "doc_id long, tag int, packed binary"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def words_of(text: bytes) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters."""
    return text.split()


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def paths(words: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(start, edges, minimizer, hash of the words) of each path of one document."""
    out = []
    last = len(words) - WINDOW + 1
    for low in range(0, last, SEGMENT):
        high = min(last, low + SEGMENT)
        out += _segment_paths(words[low : high + WINDOW - 1], low)
    return out


def _segment_paths(words: list[bytes], base: int) -> list[tuple[int, int, int, int]]:
    n = len(words)
    digest = xxhash.xxh64_intdigest
    one = np.fromiter(map(digest, words), np.uint64, n)
    kmers = np.zeros(n - KMER + 1, np.uint64)
    for k in range(KMER):
        kmers *= np.uint64(0x9E3779B97F4A7C15)
        kmers += one[k : n - KMER + 1 + k]
    kmers ^= kmers >> np.uint64(31)
    kmers *= np.uint64(0xBF58476D1CE4E5B9)
    kmers ^= kmers >> np.uint64(29)
    # The position in the low bits makes the leftmost of equal k-mers the minimizer.
    packed = (kmers >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(kmers), dtype=np.uint64)
    least = _sliding_min(packed, WINDOW - KMER + 1)
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts = np.concatenate(([0], cuts))
    counts = np.diff(np.concatenate((starts, [len(least)])))
    at = (least[starts] & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(begins[starts].tolist(), ends[starts + counts + WINDOW - 2].tolist(), strict=True)
    hashes = np.fromiter((digest(line[a:b], 7) for a, b in spans), np.uint64, len(starts))
    return list(zip(
        (starts + base).tolist(), counts.tolist(), kmers[at].view(np.int64).tolist(),
        hashes.view(np.int64).tolist(), strict=True,
    ))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
        yield doc_id, (text.as_py() or "").encode()


def _tag(raw: bytes) -> int:
    """Tells apart rows that repeat a doc_id with another text."""
    return zlib.crc32(raw) - (1 << 31)


def _path_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[], [], [], [], [], []]
        for doc_id, raw in _rows(batch):
            found = paths(words_of(raw))
            if found:
                columns[0] += [doc_id] * len(found)
                columns[1] += [_tag(raw)] * len(found)
                for column, values in zip(columns[2:], zip(*found, strict=True), strict=True):
                    column += values
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["doc_id", "tag", "start", "n", "minimizer", "path"],
        )


def _packed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        rows = list(_rows(batch))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([_tag(raw) for _, raw in rows], pa.int32()),
             pa.array([squeeze.compress(raw) for _, raw in rows], pa.binary())],
            ["doc_id", "tag", "packed"],
        )


def _edge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of the given paths, each with a 128-bit hash of its words."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        ids, tags, starts, high, low = [], [], [], [], []
        for doc_id, tag, packed, spans in zip(*(batch[c].to_pylist() for c in batch.schema.names), strict=True):
            words = words_of(expand.decompress(packed))
            for span in spans:
                for start in range(span["start"], span["start"] + span["n"]):
                    mark = xxhash.xxh3_128_digest(b" ".join(words[start : start + WINDOW]))
                    ids.append(doc_id)
                    tags.append(tag)
                    starts.append(start)
                    high.append(int.from_bytes(mark[:8], "big", signed=True))
                    low.append(int.from_bytes(mark[8:], "big", signed=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(tags, pa.int32()), pa.array(starts, pa.int32()),
             pa.array(high, pa.int64()), pa.array(low, pa.int64())],
            ["doc_id", "tag", "start", "high", "low"],
        )


def kept_words(words: list[bytes], spans: list[dict]) -> list[bytes]:
    """Words outside every span; a span of n edges covers n + WINDOW - 1 words."""
    if not spans:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, [s["start"] for s in spans], 1)
    np.add.at(change, [s["start"] + s["n"] + WINDOW - 1 for s in spans], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _result_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        for packed, spans in zip(batch["packed"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            words = words_of(expand.decompress(packed))
            kept = kept_words(words, spans or [])
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        totals, removed, marks = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(marks, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, start, n): paths of n edges, from word ``start``, whose edges all start earlier too."""
    place = ["doc_id", "tag", "start"]
    all_paths = docs.select("doc_id", "text").mapInArrow(_path_batches, _PATHS)
    again = all_paths.groupBy("minimizer").agg(F.count("*").alias("times")).where("times > 1")
    shared = checkpointed(all_paths.join(again.select("minimizer"), "minimizer", "left_semi"))
    classes = checkpointed(
        shared.groupBy("minimizer", "path").agg(
            F.min(F.struct("doc_id", "start", "tag", "n")).alias("first"), F.count("*").alias("copies")
        )
    )
    firsts = classes.select("minimizer", "path", "first.*")
    # Copies of a path after its earliest.
    many = classes.where("copies > 1").select("minimizer", "path", "first")
    later = shared.join(many, ["minimizer", "path"]).where(
        ~F.struct(*place).eqNullSafe(F.struct(*[F.col(f"first.{c}").alias(c) for c in place]))
    ).select(*place, "n")
    # Edges of the earliest copies where a minimizer branches.
    branching = classes.groupBy("minimizer").agg(F.count("*").alias("kinds")).where("kinds > 1")
    sources = firsts.join(branching.select("minimizer"), "minimizer", "left_semi")
    edges = checkpointed(
        _meet(docs, sources, "inner").mapInArrow(_edge_batches, _EDGES)
    )
    origin = edges.groupBy("high", "low").agg(
        F.min(F.struct("doc_id", "start", "tag")).alias("first"), F.count("*").alias("times")
    ).where("times > 1").select("high", "low", "first")
    repeated = edges.join(origin, ["high", "low"]).where(
        ~F.struct(*place).eqNullSafe(F.struct(*[F.col(f"first.{c}").alias(c) for c in place]))
    ).select(*place, F.lit(1).alias("n"))
    return later.unionByName(repeated)


def _meet(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """(doc_id, tag, packed, spans): compressed texts beside the list of their own spans."""
    lists = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("spans")).select(
        F.col("doc_id").alias("at"), F.col("tag").alias("tag_at"), "spans"
    )
    packed = docs.select("doc_id", "text").mapInArrow(_packed_batches, _ROWS)
    return packed.join(
        lists, packed["doc_id"].eqNullSafe(lists["at"]) & (packed["tag"] == lists["tag_at"]), how
    ).select("doc_id", "tag", "packed", "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per input row.

    A word is removed if a window of ``WINDOW`` words over it starts earlier as well: in a smaller
    doc_id, or in the same document further left. Windows are judged on the input. Null and empty texts
    have no words. Rows that repeat both doc_id and text are one document and get the same result; rows
    that repeat a doc_id with another text are told apart, the earlier start first. A null doc_id comes
    before all others. Empty table: no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _meet(docs, checkpointed(repeated_spans(docs)), "left").mapInArrow(_result_batches, _RESULT)

"""Token ids in Simple-8b blocks: a word-aligned binary layout with vectorised decoding.

Layout of a block (one row of a token table; the table's files are Parquet, so writing is atomic per task
and works on any store Spark can write): ``words`` holds 64-bit little-endian words, the selector in the
upper four bits. Selector s < 15 packs ``COUNTS[s]`` ids of ``BITS[s]`` bits each, first id lowest. Selector 15 is the
escape: the next whole word is one raw id, for ids over 60 bits. ``doc_ids`` and ``ends`` (ids up to and
including each document) give the documents of a block; ``first`` and ``n_ids`` place the block in its
shard. A shard is one range of doc_ids; shards and blocks follow ascending doc_id.

Scale: one exchange, which orders the texts by doc_id; encoding, packing and writing happen in the task
that receives a range. Ids of the shards before are summed from one row per shard.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelquery.llm.common import texts
from reelquery.session import shared_folder

#: Fixed values of Simple-8b: ids per word and bits per id, by selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
END_ID = 1
#: Ids after which a block is closed (a document is never split), words a worker keeps encoded (and their
#: longest), and new words encoded in one line.
BLOCK_IDS = 1 << 18
CACHE_WORDS = 800_000
CACHE_WORD = 64
LINE_WORDS = 200

_BLOCKS = "shard int, block int, first long, n_ids long, doc_ids array<long>, ends array<long>, words binary"
_PLACED = "shard int, doc_id long, before long, n_tokens long, ids_crc32 long"


@lru_cache(maxsize=1)
def _width_table() -> np.ndarray:
    return np.frexp(np.arange(1 << 17).astype(np.float64))[1].astype(np.uint8)


def _bit_width(ids: np.ndarray) -> np.ndarray:
    if ids.max() < 1 << 17:
        return _width_table()[ids]
    high = (ids >> np.uint64(32)).astype(np.float64)
    low = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """Simple-8b words of unsigned ids; each word takes as many ids as fit."""
    n = len(ids)
    if not n:
        return b""
    ids = ids.astype(np.uint64)
    width = _bit_width(ids)
    # The selector of a word that starts at each id: the first whose next ids all fit.
    selector = np.full(n, ESCAPE, np.uint8)
    spread = {1: width}
    size = 1
    while size * 2 <= min(n, COUNTS[0]):
        wide = spread[size]
        spread[size * 2] = np.maximum(wide[:-size], wide[size:])
        size *= 2
    for s in reversed(range(len(COUNTS))):  # the fullest selector is set last
        count = COUNTS[s]
        if count > n:
            continue
        base = 1 << (count.bit_length() - 1)
        most = spread[base]
        if count > base:
            most = np.maximum(most[: n - count + 1], most[count - base :])
        selector[: len(most)][most <= BITS[s]] = s
    take = np.array([*COUNTS, 1, 1])[selector]
    step = (np.arange(n) + take).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = step[at]
    starts = np.array(starts)
    kinds = selector[starts]
    room = 1 + (kinds == ESCAPE)
    place = np.concatenate(([0], np.cumsum(room)))
    words = np.zeros(place[-1], np.uint64)
    for s in np.unique(kinds):
        here = kinds == s
        if s == ESCAPE:
            words[place[:-1][here]] = np.uint64(ESCAPE) << np.uint64(60)
            words[place[:-1][here] + 1] = ids[starts[here]]
            continue
        shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s])
        parts = ids[starts[here][:, None] + np.arange(COUNTS[s])] << shifts
        words[place[:-1][here]] = np.bitwise_or.reduce(parts, axis=1) | (np.uint64(s) << np.uint64(60))
    return words.astype("<u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    """All ids of a packed block; every selector is decoded in one array operation."""
    words = np.frombuffer(data, "<u8").astype(np.uint64)
    if not len(words):
        return np.zeros(0, np.uint64)
    kinds = (words >> np.uint64(60)).astype(np.int64)
    if (kinds == ESCAPE).any():  # a word after an escape is raw, whatever its upper bits are
        raw, at = np.zeros(len(words), bool), 0
        marks = np.flatnonzero(kinds == ESCAPE)
        for mark in marks.tolist():
            if mark >= at:
                raw[mark + 1] = True
                at = mark + 2
    else:
        raw = np.zeros(len(words), bool)
    counts = np.array([*COUNTS, 0, 0])[kinds]
    counts[raw] = 1
    begins = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(begins[-1], np.uint64)
    out[begins[:-1][raw]] = words[raw]
    for s in range(len(COUNTS)):
        here = (kinds == s) & ~raw
        if here.any():
            shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s])
            parts = (words[here][:, None] >> shifts) & np.uint64((1 << BITS[s]) - 1)
            out[begins[:-1][here][:, None] + np.arange(COUNTS[s])] = parts
    return out


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path)
    encoder.no_truncation()
    encoder.no_padding()
    return encoder, {}


def _words(raw: bytes) -> list[bytes]:
    """Words between ASCII white space; A-Z is lower-cased, as the vocabulary does, beside special tokens."""
    return raw.split() if b"<|" in raw else raw.lower().split()


def encode_batch(path: str, batch: list[str]) -> list[bytes]:
    """Ids of each text as 32-bit little-endian bytes, as the library encodes it.

    The vocabulary drops white space and never joins letters over it, so a text's ids are those of its
    words in turn, and a word's ids are kept.
    """
    encoder, known = _tokenizer(path)
    split = [_words(text.encode()) for text in batch]
    fresh = {w for words in split for w in words if w not in known}
    coded: dict[bytes, bytes] = {}
    # A full stop or comma after letters is a piece of its own, so the stem is encoded by itself.
    tailed = {w for w in fresh if w[-1:] in (b".", b",") and w[:-1].decode().lower().isalpha()}
    stems = {w[:-1] for w in tailed}.union((b".", b",") if tailed else ())
    plain = [w for w in (fresh - tailed) | {s for s in stems if s not in known} if b"<|" not in w]
    for at in range(0, len(plain), LINE_WORDS):
        # A token belongs to the word that its first letter lies in; no token lies over a space.
        part = [w.decode() for w in plain[at : at + LINE_WORDS]]
        line = encoder.encode(" ".join(part), add_special_tokens=False)
        ids = np.array(line.ids, "<u4")
        starts = np.fromiter((offset[0] for offset in line.offsets), np.int64, len(ids))
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        cuts = (np.searchsorted(starts, ends) * 4).tolist()
        raw = ids.tobytes()
        coded.update((w, raw[a:b]) for w, a, b in zip(plain[at : at + LINE_WORDS], [0, *cuts[:-1]], cuts, strict=True))
    get = known.get
    for word in tailed:
        stem, tail = word[:-1], word[-1:]
        coded[word] = (get(stem) or coded[stem]) + (get(tail) or coded[tail])
    for word in fresh:
        if word not in coded:
            coded[word] = np.array(encoder.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
    if len(known) < CACHE_WORDS:
        known.update((w, ids) for w, ids in coded.items() if len(w) <= CACHE_WORD)
    return [b"".join([coded[w] if (ids := get(w)) is None else ids for w in words]) for words in split]


class _Block:
    def __init__(self, shard: int):
        self.shard, self.block, self.first = shard, 0, 0
        self.doc_ids: list[int | None] = []
        self.ends: list[int] = []
        self.parts: list[bytes] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> bool:
        self.parts += (ids, END_ID.to_bytes(4, "little"))
        self.n_ids += len(ids) // 4 + 1
        self.doc_ids.append(doc_id)
        self.ends.append(self.n_ids)
        return self.n_ids >= BLOCK_IDS

    def close(self) -> pa.RecordBatch:
        words = pack(np.frombuffer(b"".join(self.parts), "<u4"))
        row = pa.RecordBatch.from_arrays(
            [pa.array([self.shard], pa.int32()), pa.array([self.block], pa.int32()), pa.array([self.first], pa.int64()),
             pa.array([self.n_ids], pa.int64()), pa.array([self.doc_ids], pa.list_(pa.int64())),
             pa.array([self.ends], pa.list_(pa.int64())), pa.array([words], pa.binary())],
            ["shard", "block", "first", "n_ids", "doc_ids", "ends", "words"],
        )
        self.first += self.n_ids
        self.block += 1
        self.doc_ids, self.ends, self.parts, self.n_ids = [], [], [], 0
        return row


def write_tokens(docs: DataFrame, vocabulary: str, path: str) -> None:
    """Write the ids of every text, each followed by ``END_ID``, as a token table at ``path``.

    Documents are in ascending doc_id order (null first; rows that repeat a doc_id by their text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(TaskContext.get().partitionId())
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            rows = batch["text"].to_pylist()
            for low in range(0, len(rows), 256):
                for doc_id, coded in zip(ids[low : low + 256], encode_batch(vocabulary, rows[low : low + 256]), strict=True):
                    if block.add(doc_id, coded):
                        yield block.close()
        if block.doc_ids:
            yield block.close()

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _BLOCKS).write.option("compression", "zstd").parquet(path)


def read_tokens(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a token table, decoded from its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["words"]).astype("<u4")
                ends = np.array(row["ends"], np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                marks = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ends), row["shard"], np.int32)), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(starts + row["first"]), pa.array(ends - starts), pa.array(marks, pa.int64())],
                    ["shard", "doc_id", "before", "n_tokens", "ids_crc32"],
                )

    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))  # one row per shard
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("shard").alias("of_shard"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base")
    )
    placed = blocks.mapInArrow(run, _PLACED)
    return placed.join(F.broadcast(bases), placed["shard"] == bases["of_shard"]).select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_output(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Write the token table (to ``path`` or a new shared folder) and read it back.

    (doc_id, start, n_tokens, ids_crc32), one row per input row. Null text: empty, only the end id.
    Repeated rows each have their own place. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark)
    write_tokens(docs, vocabulary, path)
    return read_tokens(spark.read.schema(_BLOCKS).parquet(path))

"""Periodic runs of words by a Kruskal walk down the LCP values.

The suffixes of a text's word sequence are sorted, and neighbours are united in descending order of their
longest common prefix (LCP). A class is a union-find tree with an ordered set of positions. When two classes
meet at LCP l, the smaller one's positions enter the larger set, and two positions that become neighbours
there at a distance d of at most l seed a run: the words from the first one on repeat with period d for d + l
words. Every run is seeded exactly once by its first position, and d is then its smallest period: were it
not, a position in between would have joined earlier. Positions enter from the last one down, so that a
neighbour met on the way is one in the end.

Runs of ``least`` words and ``folds`` periods have an LCP of at least ``least * (folds - 1) / folds``, so the
walk ends there, and a text in which no stretch of so many words recurs has no suffixes sorted at all.

Scale: every text is read where it is scanned, without an exchange. A task holds one text at a time, about
150 bytes a word while it sorts; position sets are cut in chunks, so that entering one costs a bounded move.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import SPACE_CLASS, texts

LEAST = 24
FOLDS = 3
#: Positions of a chunk before it is cut in two.
CHUNK = 1024

Run = tuple[int, int, int]


def _codes(words: list[bytes]) -> np.ndarray:
    """One number per word, equal for equal words."""
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(place.__getitem__, words), np.int64, len(words))


def _stretch_recurs(codes: np.ndarray, length: int) -> bool:
    """Whether a stretch of ``length`` codes may occur twice (by hash: never a false no)."""
    if len(codes) <= length:
        return False
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        total, width, factor = mixed, 1, np.uint64(0xD6E8FEB86659FD93)
        while width * 2 <= length:
            total = total[:-width] * factor + total[width:]
            factor, width = factor * factor, width * 2
    return len(np.unique(total)) < len(total)


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes sorted by prefix doubling, and the LCP of each with the one before (first: 0)."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels = [np.append(rank, -1).astype(np.int32)]
    width = 1
    while rank.max(initial=-1) + 1 < n:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - width)] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)
        levels.append(np.append(rank, -1).astype(np.int32))
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a] == levels[k][b]
        a, b = a + (same << k), b + (same << k)
        lcp[1:] += same << k
    return order, lcp


def _enter(chunks: list[list[int]], x: int) -> tuple[int, int]:
    """Put ``x`` in a set of sorted chunks; its neighbours (-1: none)."""
    c = bisect.bisect_left(chunks, x, key=lambda chunk: chunk[-1]) if len(chunks) > 1 else 0
    c = min(c, len(chunks) - 1)
    chunk = chunks[c]
    i = bisect.bisect_left(chunk, x)
    before = chunk[i - 1] if i else (chunks[c - 1][-1] if c else -1)
    after = chunk[i] if i < len(chunk) else (chunks[c + 1][0] if c + 1 < len(chunks) else -1)
    chunk.insert(i, x)
    if len(chunk) > CHUNK:
        chunks[c : c + 1] = [chunk[: CHUNK // 2], chunk[CHUNK // 2 :]]
    return before, after


def runs(words: list[bytes], least: int = LEAST, folds: int = FOLDS) -> list[Run]:
    """(start, length, period) of all runs, by start, then period."""
    floor = -(-least * (folds - 1) // folds)  # the smallest LCP of a run
    codes = _codes(words)
    if not _stretch_recurs(codes, floor):
        return []
    order, lcp = suffix_order(codes)
    joins = np.flatnonzero(lcp >= max(floor, 1))
    joins = joins[np.argsort(-lcp[joins], kind="stable")]
    parent: dict[int, int] = {}
    sets: dict[int, tuple[int, list[list[int]]]] = {}  # of the roots: size and chunks
    at, word = order.tolist(), codes.tolist()
    found: list[Run] = []

    def root(i: int) -> int:
        while (up := parent[i]) != i:
            parent[i] = i = parent[up]
        return i

    for join, common in zip(joins.tolist(), lcp[joins].tolist(), strict=True):
        for i in (join - 1, join):
            if i not in parent:
                parent[i] = i
                sets[i] = (1, [[at[i]]])
        a, b = root(join - 1), root(join)
        if sets[a][0] < sets[b][0]:
            a, b = b, a
        (size, large), (entering, small) = sets[a], sets.pop(b)
        parent[b] = a
        last = None
        for chunk in reversed(small):
            for x in reversed(chunk):
                before, after = _enter(large, x)
                # Two of the smaller set that stay neighbours were neighbours before.
                met = ((before, x),) if after == last else ((before, x), (x, after))
                last = x
                for i, j in met:
                    d = j - i
                    # A run starts where the word before does not go on with the period.
                    if i >= 0 and 0 < d <= common and d + common >= max(least, folds * d) and (i == 0 or word[i - 1] != word[j - 1]):
                        found.append((i, d + common, d))
        sets[a] = (size + entering, large)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not found:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def best(found: list[Run]) -> Run | None:
    """The run with the greatest length over period; ties: smallest start, then period."""
    top = None
    for run in found:
        if top is None or (cross := run[1] * top[2] - top[1] * run[2]) > 0 or (
            cross == 0 and (run[0], run[2]) < (top[0], top[2])
        ):
            top = run
    return top


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents of which one in ten is made periodic by the crc32 of its id.

    With h the crc32 of the decimal doc_id and g = floor(h / 10): if h % 10 = 0 and the text has n > 0
    words, each word i >= a = g % n becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). A null
    doc_id has no h; its text stays.
    """
    rows = texts(docs).withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    words = F.array_remove(F.split("text", f"[{SPACE_CLASS}]+"), "")
    g = F.floor(F.col("h") / 10)
    n = F.size("words")
    a = F.pmod(g, n).cast("int")
    p = (F.lit(1) + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")
    at = F.sequence(F.lit(0), n - 1)
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    moved = F.array_join(F.transform(at, lambda i: F.get("words", source(i))), " ")
    hit = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    spread = rows.withColumn("words", F.when(hit, words)).withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    return spread.select("doc_id", F.when(n > 0, moved).otherwise(F.col("text")).alias("text"))


_RESULT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string"
)


def periodic_runs(docs: DataFrame, least: int = LEAST, folds: int = FOLDS) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), one row per input row.

    start, length, period and exponent_milli are those of the run with the greatest length over period, null
    without a run. Null and empty texts have no words, no runs, and the hashes of the empty string. Repeated
    rows each give a row; a null doc_id stays null. Empty table: no rows. Other columns are ignored.
    """

    def digest(parts: bytes) -> str:
        return hashlib.sha256(parts).hexdigest()

    def one(text: str) -> tuple:
        words = text.encode().split()  # of bytes: the six ASCII white-space characters only
        found = runs(words, least, folds)
        top = best(found)
        told = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        return len(found), *told, digest(lines.encode()), digest(b" ".join(collapsed(words, found)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*[one(t.as_py()) for t in batch["text"]], strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                [part.split()[0] for part in _RESULT.split(", ")],
            )

    return texts(docs).mapInArrow(run, _RESULT)

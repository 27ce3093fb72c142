"""What a task does with its batches of points: score them and keep the best.

Functions here run on executors. The module is pickled by value, so executors need NumPy, pandas
and PyArrow but not this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Summation order differs between partitionings and libraries in the last bits; ordering by a
# rounded score with an id tie-break keeps ranks the same on any cluster layout.
SCORE_DECIMALS = 6
HIT_SCHEMA = (
    "query_id bigint, variant_order int, weight double, collection string, identity string, "
    "point_id bigint, score double"
)
_ARROW_TYPES = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
}
HIT_ARROW = pa.schema(
    [(name, _ARROW_TYPES[kind]) for name, kind in (p.split() for p in HIT_SCHEMA.split(", "))]
)
SUMMARY_SCHEMA = (
    "query_id bigint, variant_order int, collection string, n bigint, total double, low double, high double"
)
#: Scores computed at once: rows x queries of a tile (doubles: 8 MB), and the most queries of one.
TILE_CELLS, TILE_QUERIES = 1 << 20, 1024
#: Candidate rows a task holds; beyond it, it trims, and if that is not enough sends them and goes on.
HELD_ROWS = 4_000_000


@dataclass
class Part:
    """Queries of a block that share a collection (or None: any) and a vector size."""

    channel: str | None
    size: int
    keys: pd.DataFrame
    matrix: np.ndarray
    #: Lists of libraries, and the list of each query (-1: everything is searched).
    scopes: list[list[str]]
    scope_of: np.ndarray


def block_of(frame: pd.DataFrame) -> list[Part]:
    frame = frame.sort_values(["query_id", "variant_order"], ignore_index=True)
    sizes = frame["query_embedding"].map(len)
    channels = frame["collection"].where(frame["collection"].notna(), None)
    parts = []
    for channel, size in sorted({*zip(channels, sizes, strict=True)}, key=str):
        at = np.flatnonzero((sizes == size) & ((channels == channel) if channel is not None else channels.isna()))
        keys = frame.iloc[at][["query_id", "variant_order", "weight"]].reset_index(drop=True)
        matrix = np.vstack([np.asarray(v, dtype=np.float64) for v in frame["query_embedding"].iloc[at]])
        known: dict[tuple, int] = {}
        scope_of = [
            -1 if s is None else known.setdefault(tuple(sorted({x for x in s if x is not None})), len(known))
            for s in frame["scopes"].iloc[at]
        ]
        parts.append(Part(channel, size, keys, matrix, [list(s) for s in known], np.array(scope_of, np.int64)))
    return parts


def vectors_of(batch: pa.RecordBatch, size: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose vector has ``size`` finite values, and their vectors."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), size), False)
    rows = batch.filter(fits)
    flat = rows.column("embedding").flatten().to_numpy(zero_copy_only=False)
    vectors = flat.astype(np.float64, copy=False).reshape(len(rows), size)
    finite = np.isfinite(vectors).all(axis=1)
    if finite.all():
        return rows, vectors
    return rows.filter(pa.array(finite)), vectors[finite]


def comparable(batch: pa.RecordBatch, block: list[Part]) -> Iterator[tuple[int, str, pa.RecordBatch, np.ndarray]]:
    """(part of the block, collection, points, their vectors) for all that can be compared."""
    for number, part in enumerate(block):
        rows, vectors = vectors_of(batch, part.size)
        names = rows.column("collection").to_pandas().to_numpy()
        for name in [part.channel] if part.channel is not None else pd.unique(names):
            at = np.flatnonzero(names == name)
            if len(at):
                yield number, name, rows.take(pa.array(at)), vectors[at]


def tiles(n_rows: int, n_queries: int) -> Iterator[tuple[slice, slice]]:
    """(rows, queries) of tiles of at most ``TILE_CELLS`` scores that cover all pairs once."""
    width = max(1, min(n_queries, TILE_QUERIES))
    height = max(1, TILE_CELLS // width)
    for low in range(0, n_rows, height):
        for first in range(0, n_queries, width):
            yield slice(low, min(low + height, n_rows)), slice(first, min(first + width, n_queries))


def best_per_identity(identity: np.ndarray, ids: np.ndarray, scores: np.ndarray):
    """(first row of each identity, point ids, scores) with one row per identity (its number); of equal scores the
    smallest point id."""
    order = np.lexsort((ids, identity))
    starts = np.flatnonzero(np.diff(identity[order], prepend=-1))
    if len(starts) == len(order):  # every row is an identity of its own
        return order, np.broadcast_to(ids[order][:, None], scores.shape), scores[order]
    scores = scores[order]
    top = np.maximum.reduceat(scores, starts, axis=0)
    counts = np.diff(np.append(starts, len(order)))
    place = np.where(scores == np.repeat(top, counts, axis=0), np.arange(len(order))[:, None], len(order))
    return order[starts], ids[order][np.minimum.reduceat(place, starts, axis=0)], top


def in_scope(part: Part, queries: slice, libraries: np.ndarray, codes: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Scores with those outside a query's libraries at minus infinity; ``codes``: the library of each row."""
    lists, which = np.unique(part.scope_of[queries], return_inverse=True)
    if lists[-1] < 0:
        return scores
    allowed = np.ones((len(lists), len(libraries) + 1), bool)  # the last column: rows without a library
    for i, number in enumerate(lists.tolist()):
        if number >= 0:
            wanted = set(part.scopes[number])
            allowed[i] = [library in wanted for library in libraries] + [False]
    scores[~allowed[:, codes][which].T] = -np.inf
    return scores


class Best:
    """The best K identities per (query variant, collection) seen by one task, in flat arrays."""

    def __init__(self, block: list[Part], depth: int):
        self.block, self.depth = block, depth
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = self.kept = 0  # in all, and after the last trim
        #: A slot is a query of a part, for one collection; the first slot and the K-th scores of both.
        self.first: dict[tuple[int, str], int] = {}
        self.slots = 0
        self.floor: dict[tuple[int, str], np.ndarray] = {}
        self.number: dict[str, int] = {}  # identities held, by name

    def add(self, part: int, name: str, queries: slice, names: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        key = part, name
        if key not in self.first:
            self.first[key], n = self.slots, len(self.block[part].keys)
            self.slots += n
            self.floor[key] = np.full(n, -np.inf)
        # A score below the K-th identity so far cannot enter; equal scores still can, by id.
        floor = self.floor[key][queries]
        if len(scores) > self.depth:
            np.maximum(floor, np.partition(scores, -self.depth, axis=0)[-self.depth], out=floor)
        row, query = np.nonzero((scores >= floor) & (scores > -np.inf))
        used, at = np.unique(row, return_inverse=True)
        number = self.number
        codes = np.array([number.setdefault(n, len(number)) for n in names[used].tolist()], np.int64)
        slot = self.first[key] + queries.start + query
        self.held.append((slot, codes[at], ids[row, query], scores[row, query]))
        self.rows += len(row)
        # Trimming raises the floors; a sort at every doubling costs little beside the scores.
        if self.rows > 2 * self.kept + TILE_CELLS // 4:
            self.trim()

    def trim(self) -> None:
        """Keep K identities per query variant and collection."""
        if not self.held:
            return
        slot, code, ids, score = (np.concatenate(columns) for columns in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, code, slot))
        again = (np.diff(slot[order], prepend=-1) == 0) & (np.diff(code[order], prepend=-1) == 0)
        order = order[~again]
        order = order[np.lexsort((ids[order], -score[order], slot[order]))]
        starts = np.flatnonzero(np.diff(slot[order], prepend=-1))
        counts = np.diff(np.append(starts, len(order)))
        order = order[np.arange(len(order)) - np.repeat(starts, counts) < self.depth]
        slot, code, ids, score = slot[order], code[order], ids[order], score[order]
        ends = np.append(np.flatnonzero(np.diff(slot)), len(slot) - 1) if len(slot) else np.zeros(0, np.int64)
        last = np.full(self.slots, -np.inf)
        full = np.diff(ends, prepend=-1) == self.depth
        last[slot[ends[full]]] = score[ends[full]]
        for key, first in self.first.items():
            floor = self.floor[key]
            np.maximum(floor, last[first : first + len(floor)], out=floor)
        # Names that are no longer held go.
        used, code = np.unique(code, return_inverse=True)
        names = np.array(list(self.number), dtype=object)[used]
        self.number = dict(zip(names.tolist(), range(len(names)), strict=True))
        self.held, self.rows, self.kept = [(slot, code.astype(np.int64), ids, score)], len(slot), len(slot)

    def send(self) -> Iterator[pa.RecordBatch]:
        self.trim()
        if not self.rows:
            return
        slot, code, ids, score = self.held[0]
        names = pa.array(list(self.number), pa.string())
        for (part, name), first in self.first.items():
            keys = self.block[part].keys
            low, high = np.searchsorted(slot, [first, first + len(keys)])
            query = slot[low:high] - first
            columns = {
                "query_id": pa.array(keys["query_id"].to_numpy()[query], pa.int64()),
                "variant_order": pa.array(keys["variant_order"].to_numpy()[query], pa.int32()),
                "weight": pa.array(keys["weight"].to_numpy()[query], pa.float64(), from_pandas=True),
                "collection": pa.array([name], pa.string()).take(pa.array(np.zeros(high - low, np.int64))),
                "identity": names.take(pa.array(code[low:high])),
                "point_id": pa.array(ids[low:high], pa.int64()),
                "score": pa.array(score[low:high], pa.float64()),
            }
            yield pa.RecordBatch.from_arrays([columns[n] for n in HIT_ARROW.names], schema=HIT_ARROW)
        self.held, self.rows, self.kept, self.number = [], 0, 0, {}


def best_hits(batches: Iterator[pa.RecordBatch], block: list[Part], depth: int) -> Iterator[pa.RecordBatch]:
    best = Best(block, depth)
    for batch in batches:
        for number, name, rows, vectors in comparable(batch, block):
            part = block[number]
            ids = rows.column("point_id").to_numpy(zero_copy_only=False)
            identity, names = pd.factorize(rows.column("identity").to_pandas().to_numpy())
            scope, libraries = pd.factorize(rows.column("scope").to_pandas().to_numpy())  # null: -1
            for at, queries in tiles(len(rows), len(part.keys)):
                scores = np.round(vectors[at] @ part.matrix[queries].T, SCORE_DECIMALS)
                scores = in_scope(part, queries, libraries, scope[at], scores)
                first, points, top = best_per_identity(identity[at], ids[at], scores)
                best.add(number, name, queries, names[identity[at][first]], points, top)
                if best.rows > HELD_ROWS // 2:
                    best.trim()
                    if best.rows > HELD_ROWS // 2:
                        yield from best.send()
    yield from best.send()


def summaries(batches: Iterator[pa.RecordBatch], block: list[Part]) -> Iterator[pa.RecordBatch]:
    """Count, sum and range of each query variant's scores in a task, per collection."""
    found: dict[tuple[int, str], list] = {}
    for batch in batches:
        for number, name, _, vectors in comparable(batch, block):
            part = block[number]
            n = len(part.keys)
            if (number, name) not in found:
                found[number, name] = [0, np.zeros(n), np.full(n, np.inf), np.full(n, -np.inf)]
            told = found[number, name]
            told[0] += len(vectors)
            for at, queries in tiles(len(vectors), n):
                scores = vectors[at] @ part.matrix[queries].T
                told[1][queries] += scores.sum(axis=0)
                np.minimum(told[2][queries], scores.min(axis=0), out=told[2][queries])
                np.maximum(told[3][queries], scores.max(axis=0), out=told[3][queries])
    for (number, name), (count, total, low, high) in found.items():
        keys = block[number].keys
        frame = pd.DataFrame(
            {"query_id": keys["query_id"], "variant_order": keys["variant_order"], "collection": name,
             "n": count, "total": total, "low": low, "high": high}
        )
        yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

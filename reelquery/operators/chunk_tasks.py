"""What a task does with a block of transcript segments: how chunks run through it.

A block is entered with an open chunk or none. Which chunks it makes, and the open chunk it hands on, follow
from that alone, so a block is a map of states; a state is the first segment of the open chunk, or none.
The module is pickled by value, so executors need NumPy and PyArrow but not this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: No chunk is open (row numbers start at 1).
NONE = 0
State = tuple[int, float]
CLOSED: State = (NONE, 0.0)


@dataclass
class Block:
    numbers: np.ndarray
    seqs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    nexts: np.ndarray
    last: np.ndarray
    shortest: float
    longest: float

    def close(self, start: float, at: int) -> int | None:
        """The segment from ``at`` on that closes a chunk begun at ``start`` seconds."""
        long_enough = self.ends[at:] - start >= self.shortest
        full = long_enough & (self.last[at:] | (self.nexts[at:] - start > self.longest))
        j = int(full.argmax()) if len(full) else 0
        return at + j if len(full) and full[j] else None

    def left_open(self) -> list[State]:
        """For each segment: the state behind the block if a chunk begins there."""
        states: list[State] = [CLOSED] * (len(self.starts) + 1)
        for p in range(len(self.starts) - 1, -1, -1):
            j = self.close(self.starts[p], p)
            states[p] = (int(self.numbers[p]), float(self.starts[p])) if j is None else states[j + 1]
        return states

    def through(self, state: State, states: list[State]) -> State:
        """The state behind the block, entered in ``state``."""
        if state[0] == NONE:
            return states[0]
        j = self.close(state[1], 0)
        return state if j is None else states[j + 1]

    def marks(self, state: State) -> np.ndarray:
        """The first segment of the chunk of each segment, by number."""
        first = np.zeros(len(self.starts), np.int64)
        at = 0
        while at < len(first):
            number, start = state if state[0] != NONE else (int(self.numbers[at]), float(self.starts[at]))
            j = self.close(start, at)
            first[at : len(first) if j is None else j + 1] = number
            at = len(first) if j is None else j + 1
            state = CLOSED
        return first


def blocks_of(batch: pa.RecordBatch, shortest: float, longest: float) -> Iterator[Block]:
    """Blocks from a column ``items`` of lists of (rn, seq, start_s, end_s, next_end)."""

    def seconds(column: pa.Array) -> np.ndarray:
        values = column.to_numpy(zero_copy_only=False).astype(np.float64)
        return np.where(np.isnan(values), np.inf, values)  # NaN counts as the largest number

    for items in batch["items"]:
        rows = items.values
        following = rows.field("next_end")
        yield Block(
            rows.field("rn").to_numpy(zero_copy_only=False), rows.field("seq").to_numpy(zero_copy_only=False),
            seconds(rows.field("start_s")), seconds(rows.field("end_s")), seconds(following),
            following.is_null().to_numpy(zero_copy_only=False), shortest, longest,
        )


def _told(batch: pa.RecordBatch, lists: list[list], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    """One row per entry of each row's list, behind the row's file and block."""
    number = pa.array(np.repeat(np.arange(len(lists)), [len(told) for told in lists]))
    entries = list(zip(*[e for told in lists for e in told], strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays(
        [batch["file_id"].take(number), batch["block"].take(number), *(pa.array(e, t) for e, t in zip(entries, columns.values(), strict=True))],
        ["file_id", "block", *columns],
    )


EXITS = "rn bigint, start_s double"
STEPS = "rn bigint, start_s double, to_rn bigint, to_start_s double"
MARKS = "seq bigint, first bigint"


def exits(batches: Iterator[pa.RecordBatch], shortest: float, longest: float) -> Iterator[pa.RecordBatch]:
    """Every state a block can hand on if a chunk begins in it."""
    for batch in batches:
        lists = [sorted(set(block.left_open()[:-1])) for block in blocks_of(batch, shortest, longest)]
        yield _told(batch, lists, {"rn": pa.int64(), "start_s": pa.float64()})


def steps(batches: Iterator[pa.RecordBatch], shortest: float, longest: float) -> Iterator[pa.RecordBatch]:
    """The state behind a block for each of its ``entries`` (rn, start_s)."""
    for batch in batches:
        lists = []
        for block, entries in zip(blocks_of(batch, shortest, longest), batch["entries"].to_pylist(), strict=True):
            states = block.left_open()
            told = [(e["rn"], e["start_s"]) for e in entries]
            lists.append([(*state, *block.through(state, states)) for state in told])
        yield _told(batch, lists, {"rn": pa.int64(), "start_s": pa.float64(), "to_rn": pa.int64(), "to_start_s": pa.float64()})


def marks(batches: Iterator[pa.RecordBatch], shortest: float, longest: float) -> Iterator[pa.RecordBatch]:
    """(seq, first): each segment of a block entered in (rn, start_s), and the number of its chunk's first one."""
    for batch in batches:
        lists = []
        entered = zip(batch["rn"].to_pylist(), batch["start_s"].to_pylist(), strict=True)
        for block, state in zip(blocks_of(batch, shortest, longest), entered, strict=True):
            lists.append(list(zip(block.seqs.tolist(), block.marks(state).tolist(), strict=True)))
        yield _told(batch, lists, {"seq": pa.int64(), "first": pa.int64()})

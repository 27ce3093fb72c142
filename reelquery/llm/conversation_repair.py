"""Cheapest repair of conversations with Four-Russians block tables.

A conversation is a string of symbols, one a row: the initial of its role, whether it is cut off, or that it
has to go (blank or duplicate). A repair keeps, reroles, deletes or inserts rows so that the initials read
``(s?(ua)+)?``. The cost to go from each of the automaton's four states is a vector; less its smallest entry
it is one of a few dozen normalised vectors. So for each vector and each block of ``BLOCK`` symbols the
vector before the block and the cost it adds are computed once, and a conversation is walked from its
end by one look-up a block, which leaves the vector behind every block. The trace goes forward: a block is
expanded backward from the vector behind it, and of the edits that stay on a cheapest way the one with the
smallest letter is taken, so ties end with the smallest audit string.

Scale: one exchange by conversation. Each row is sent twice, once without its text; a task reads a
conversation's narrow rows first (some 40 bytes a row), repairs it, and then streams the texts through the
hash. No texts are collected. The hash of a conversation and its audit are one value each, so a conversation
cannot be split further; conversations spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import SPACE_CLASS

BLOCK = 4
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled row; after a kept row, by the initial of its role.
TURN = (USER, USER, ASSISTANT, USER)
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
#: Symbols: twice the place of the initial (3: another one), plus one if cut off; and a row that has to go.
GOES = 8
SYMBOLS = 9
NEVER = 1 << 40

Vector = tuple[int, int, int, int]


def _relaxed(costs: list[int]) -> Vector:
    """Costs to go when rows may be inserted first; two insertions at most make sense in a row."""
    for _ in range(2):
        costs = [min(costs[s], INSERT + costs[TURN[s]]) for s in range(4)]
    return tuple(costs)


#: Nothing follows: the start and an assistant's row may be the end.
END: Vector = _relaxed([0, NEVER, NEVER, 0])


def _kept(state: int, symbol: int) -> int | None:
    return None if symbol >= 6 else KEEP[state].get(INITIALS[symbol // 2])


def before(behind: Vector, symbol: int) -> Vector:
    """Costs to go before a symbol from those behind it."""
    costs = []
    for state in range(4):
        ways = [DELETE + behind[state]]
        if symbol != GOES:
            extra = CUT_OFF * (symbol % 2)
            ways.append(REROLE + extra + behind[TURN[state]])
            if (kept := _kept(state, symbol)) is not None:
                ways.append(extra + behind[kept])
        costs.append(min(ways))
    return _relaxed(costs)


class Tables:
    """Normalised vectors, their single steps, and their steps over whole blocks."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors: list[Vector] = [END]
        place = {END: 0}
        steps: list[list[tuple[int, int]]] = []
        for vector in self.vectors:  # grows while it is read
            row = []
            for symbol in range(SYMBOLS):
                costs = before(vector, symbol)
                low = min(costs)
                normal = tuple(c - low for c in costs)
                if normal not in place:
                    place[normal] = len(self.vectors)
                    self.vectors.append(normal)
                row.append((place[normal], low))
            steps.append(row)
        self.step = np.array([[p for p, _ in row] for row in steps], np.int32)
        self.add = np.array([[c for _, c in row] for row in steps], np.int64)
        # Blocks are numbers in base SYMBOLS, first symbol first; composed from the last symbol on.
        to = np.arange(len(self.vectors), dtype=np.int32)[:, None]
        cost = np.zeros_like(to, np.int64)
        for _ in range(block):
            cost = np.concatenate([cost + self.add[to, s] for s in range(SYMBOLS)], axis=1)
            to = np.concatenate([self.step[to, s] for s in range(SYMBOLS)], axis=1)
        self.block_step, self.block_add = to, cost
        self.traced: dict[tuple, tuple[str, int]] = {}

    def walk(self, symbols: np.ndarray) -> tuple[int, list[int], np.ndarray]:
        """Cost, the vector behind each whole block, and the numbers of the blocks."""
        whole = len(symbols) // self.block
        vector, total = 0, 0
        for symbol in symbols[whole * self.block :][::-1].tolist():
            total += int(self.add[vector, symbol])
            vector = int(self.step[vector, symbol])
        powers = SYMBOLS ** np.arange(self.block - 1, -1, -1)
        codes = symbols[: whole * self.block].reshape(whole, self.block).astype(np.int64) @ powers
        behind = [0] * whole
        for i in range(whole - 1, -1, -1):
            behind[i] = vector
            total += int(self.block_add[vector, codes[i]])
            vector = int(self.block_step[vector, codes[i]])
        return total + self.vectors[vector][START], behind, codes

    def _trace(self, symbols: tuple[int, ...], vector: int, state: int) -> tuple[str, int]:
        """Letters of a stretch from ``state``, and the state behind it."""
        behind = [vector]
        for symbol in reversed(symbols[1:]):
            behind.append(int(self.step[behind[-1], symbol]))
        letters = []
        for symbol, after in zip(symbols, reversed(behind), strict=True):
            costs = self.vectors[after]
            here = before(costs, symbol)
            extra = CUT_OFF * (symbol % 2)
            while True:
                kept = _kept(state, symbol)
                if here[state] == DELETE + costs[state]:
                    letters.append("D")
                    break
                if here[state] == INSERT + here[TURN[state]]:
                    letters.append("I")
                    state = TURN[state]
                    continue
                if kept is not None and here[state] == extra + costs[kept]:
                    letters.append("K")
                    state = kept
                    break
                letters.append("R")
                state = TURN[state]
                break
        return "".join(letters), state

    def repair(self, symbols: np.ndarray) -> tuple[int, str]:
        """Cost and audit of a conversation's symbols (uint8)."""
        cost, behind, codes = self.walk(symbols)
        state, parts = START, []
        for i, (vector, code) in enumerate(zip(behind, codes.tolist(), strict=True)):
            key = (vector, code, state)
            if key not in self.traced:
                self.traced[key] = self._trace(tuple(symbols[i * self.block : (i + 1) * self.block].tolist()), vector, state)
            part, state = self.traced[key]
            parts.append(part)
        if tail := symbols[len(codes) * self.block :].tolist():
            part, state = self._trace(tuple(tail), 0, state)
            parts.append(part)
        while state in (SYSTEM, USER):
            parts.append("I")
            state = TURN[state]
        return cost, "".join(parts)


@cache
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, gone): rows damaged by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row (``gone``), 1 empties its text, 2 removes ``.``, ``!`` and ``?`` from it, 3 repeats it, 4 makes
    it a user's. Null roles and texts are one space, and so are null ids and turns in the hashed string.
    """
    written = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn"))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), written("role").alias("role"),
        written("text").alias("text"), kind.alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy"), (F.col("kind") == 0).alias("gone"),
    )


def _twice(rows: DataFrame) -> DataFrame:
    """Each row as a narrow one (part 0) and, unless it is gone, as one with its text (part 1), dealt by
    conversation and in order."""
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    # The length keeps role and text apart.
    mark = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    written = {n: F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("role", "text")}
    marked = rows.withColumns({**written, "gone": F.coalesce("gone", F.lit(False))}).withColumns({
        "place": place.cast("int"), "mark": mark, "blank": ~F.col("text").rlike(f"[^{SPACE_CLASS}]"),
        "cut": ~F.col("text").rlike(f"[.!?][{SPACE_CLASS}]*\\z"),
        "part": F.explode(F.when(F.col("gone"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))),
    })
    told = F.col("part") == 1
    return marked.select(
        "conv_id", "part", "turn", "gone", "place", "mark", "blank", "cut", "copy",
        F.when(told, F.col("role")).alias("role"), F.when(told, F.col("text")).alias("text"),
        # Both parts of a conversation stand in one order; equal turns by the digest of role and text.
    ).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "mark", "copy")


class _Conversation:
    """One conversation while its rows stream by."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.places, self.faults, self.marks = bytearray(), bytearray(), bytearray()
        self.low = self.high = self.last_turn = None
        self.turns = 0
        self.audit: str | None = None
        self.hash, self.lines, self.at, self.state = hashlib.sha256(), 0, 0, START

    def narrow(self, turn, gone, place, mark, blank, cut) -> None:
        if gone:
            return
        self.places.append(place)
        self.faults.append(1 if blank else 2 if cut else 0)
        self.marks += mark
        if turn is not None and turn != self.last_turn:
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
            self.turns += 1

    def solve(self) -> None:
        places = np.frombuffer(bytes(self.places), np.uint8)
        faults = np.frombuffer(bytes(self.faults), np.uint8)
        marks = np.frombuffer(bytes(self.marks), "S32")
        again = np.ones(len(places), bool)
        again[np.unique(marks, return_index=True)[1]] = False
        blank = faults == 1
        duplicate = again & ~blank
        cut = (faults == 2) & ~duplicate
        symbols = np.where(blank | duplicate, GOES, places * 2 + cut).astype(np.uint8)
        a, b = places[:-1], places[1:]
        legal = ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
        self.counts = (
            0 if self.low is None else self.high - self.low + 1 - self.turns,
            int(blank.sum()), int(duplicate.sum()), int(cut.sum()), int((~legal).sum()),
        )
        self.cost, self.audit = tables().repair(symbols)
        self.marks = bytearray()

    def _line(self, line: str) -> None:
        self.hash.update(("\n" + line if self.lines else line).encode())
        self.lines += 1

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = TURN[self.state]
            self._line(ROLES[self.state] + ":")

    def text(self, role: str, text: str, place: int) -> None:
        if self.audit is None:
            self.solve()
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        self.state = TURN[self.state] if letter == "R" else KEEP[self.state][INITIALS[place]]
        self._line((ROLES[self.state] if letter == "R" else role) + ":" + text)

    def result(self) -> tuple:
        if self.audit is None:
            self.solve()
        self._inserted()
        return self.conv_id, *self.counts, self.cost, self.audit, self.hash.hexdigest()


_RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
_ROWS_OUT = 2000


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    ``rows``: conv_id, turn, role, text, copy (order of repeats) and gone (only its conversation counts). Rows
    are taken by turn, nulls first, equal turns by the digest of role and text. Rows with a null conv_id are
    one conversation; null roles and texts are one space. Nothing but gone rows: zeros, empty audit and the hash of the empty string. Empty
    table: no rows. Other columns are ignored.
    """
    names = [part.split()[0] for part in _RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def packed(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            columns = {name: batch[name] for name in batch.schema.names}
            listed = {n: columns[n].to_pylist() for n in ("conv_id", "part", "turn", "gone", "place", "mark", "blank", "cut", "role")}
            texts = columns["text"]
            for i, (conv_id, part) in enumerate(zip(listed["conv_id"], listed["part"], strict=True)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                        if len(done) >= _ROWS_OUT:
                            yield packed(done)
                            done = []
                    now = _Conversation(conv_id)
                if part == 0:
                    now.narrow(*(listed[n][i] for n in ("turn", "gone", "place", "mark", "blank", "cut")))
                else:
                    now.text(listed["role"][i], texts[i].as_py(), listed["place"][i])
        if now is not None:
            done.append(now.result())
        yield packed(done)

    return _twice(rows).mapInArrow(run, _RESULT)

"""Conversation repair: block tables against a search over all edits, rows against a plain version, odd rows."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from reelquery.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, part int, mark string, cost int, copy string"
TURN = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def search(rows):
    """Cheapest edits, then the least audit: (role, goes, cut) rows; all edit sequences in order of (cost, audit)."""
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit
        if (i, state, cost, audit) in seen:
            continue
        seen.add((i, state, cost, audit))
        heapq.heappush(heap, (cost + 2, audit + "I", i, TURN[state]))
        if i < len(rows):
            role, goes, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if not goes:
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, TURN[state]))
                if (state, role[:1]) in KEPT:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, KEPT[state, role[:1]]))


def symbol(role, goes, cut):
    return repair.GOES if goes else 2 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + cut


@pytest.mark.parametrize("block", [1, 3, 4])
def test_block_tables_equal_search(block):
    rnd = random.Random(block)
    made = repair.Tables(block)
    assert len(made.vectors) < 40
    for _ in range(300):
        rows = [(rnd.choice("suat"), rnd.random() < 0.2, int(rnd.random() < 0.3)) for _ in range(rnd.randint(0, 6))]
        assert made.repair(np.array([symbol(*r) for r in rows], np.uint8)) == search(rows)


def test_block_lengths_agree_on_long_strings():
    symbols = np.random.default_rng(1).integers(0, repair.SYMBOLS, 5003).astype(np.uint8)
    results = {repair.Tables(block).repair(symbols) for block in (1, 2, 4)}
    assert len(results) == 1


def plain(rows):
    """The contract's columns of one conversation, from its rows in order after damage."""
    seen, marked, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        kept = text.strip(" \t\n\v\f\r")
        fault = 0 if not kept else 1 if (role, text) in seen else 2 if kept[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        marked.append((role, fault in (0, 1), int(fault == 2)))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = search(marked)
    state, i, lines = 0, 0, []
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        state = KEPT[state, rows[i][1][:1]] if edit == "K" else TURN[state]
        role = rows[i][1] if edit == "K" else {2: "user", 3: "assistant"}[state]
        lines.append(f"{role}:{'' if edit == 'I' else rows[i][2]}")
        i += edit != "I"
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        told = out.setdefault(conv, [])
        written = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{written(conv)}:{written(turn)}".encode()) % 20
        role, text = written(role), written(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        told += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in out.items()}


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 7, "m", 5, "c") for r in rows], SCHEMA)


def test_rows_equal_plain_version(spark):
    rnd = random.Random(12)
    rows = []
    for conv in range(150):
        for turn in range(rnd.randint(1, 6)):
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = rnd.choice(["Yes.", "No", "Why?\n ", " ", "", None, "wait ...", "a.b", "é!", " "])
            rows.append((conv, turn * rnd.choice([1, 1, 2]) if rnd.random() > 0.1 or turn else None, role, text))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes.")]
    got = {r[0]: tuple(r)[1:] for r in repair.repaired(repair.damaged(rows_of(spark, rows))).collect()}
    assert got == {c: plain(r) for c, r in plain_damaged(rows).items()}


def test_odd_conversations(spark):
    assert repair.repaired(repair.damaged(rows_of(spark, []))).collect() == []
    gone = next((c, 0, "user", "Hi.") for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repaired(repair.damaged(rows_of(spark, [gone]))).collect()
    assert [tuple(r) for r in got] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    # Equal rows of one turn: all but the first go.
    sound = next(c for c in range(100) if zlib.crc32(f"{c}:5".encode()) % 20 > 4)
    got = repair.repaired(repair.damaged(rows_of(spark, [(sound, 5, "user", "Hi.")] * 4))).first()
    assert (got["duplicate"], got["illegal"], got["cost"]) == (3, 3, 11)
    assert sorted(got["audit"]) == list("DDDIK")


def test_long_conversation_and_text(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} is it.") for t in range(3000)]
    rows.append((2, 0, "user", "x" * 3_000_000))
    got = {r["conv_id"]: r for r in repair.repaired(repair.damaged(rows_of(spark, rows))).collect()}
    left = plain_damaged(rows)
    assert len(got[1]["audit"].replace("I", "")) == len(left[1])
    assert got[2]["truncated"] == len([r for r in left[2] if r[2]])

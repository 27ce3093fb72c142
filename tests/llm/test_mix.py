"""Mixing: targets, quotas and picked blocks against plain versions; odd rows."""

import heapq
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.llm import mixing

DOCS = "doc_id long, source string, text string, size long, target string, mark string, bucket int, taken int"


def documents(spark, rows):
    """Rows (doc_id, source, words) with extra columns whose names clash."""
    return spark.createDataFrame(
        [(i, s, None if n is None else " \t".join(["w"] * n), -1, "t", "m", 3, 9) for i, s, n in rows], DOCS
    )


def plain_targets(sized, weights=mixing.WEIGHTS, share=mixing.SHARE, passes=mixing.PASSES):
    """Share by weight, stop at the limit, reshare what is over, until none is above."""
    names = sorted(sized, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, fixed = Fraction(share, 100) * sum(sized.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        if not open_:
            return {s: float(t) for s, t in fixed.items()}
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] >= passes * sized[s]]
        if not over:
            return {s: float(t) for s, t in fixed.items()} | {s: float(level * weight[s]) for s in open_}
        for s in over:
            fixed[s] = passes * sized[s]
            left -= fixed[s]


def highest_quotients(votes, seats):
    """Seat by seat, to the highest votes / (2k + 1)."""
    heap = [(-Fraction(v), s is None, s or "", 0, v, s) for s, v in votes.items() if v]
    heapq.heapify(heap)
    won = {s: 0 for s, v in votes.items() if v}
    for _ in range(seats if heap else 0):
        _, none, name, k, v, s = heapq.heappop(heap)
        won[s] += 1
        heapq.heappush(heap, (-Fraction(v) / (2 * k + 3), none, name, k + 1, v, s))
    return won


@pytest.mark.parametrize("seed", range(2))
def test_targets_and_quotas_equal_plain_versions(spark, seed):
    rnd = random.Random(seed)
    sized = {f"s{i}": rnd.choice([0, rnd.randint(1, 9), rnd.randint(1, 3000)]) for i in range(rnd.randint(1, 30))}
    sized |= {None: rnd.randint(1, 500), "é": 40, "Z": 7}
    table = spark.createDataFrame(list(sized.items()), "source string, source_size long")
    aims = mixing.targets(table)
    got = {r["source"]: r["target"] for r in aims.collect()}
    assert got == pytest.approx(plain_targets(sized))
    quotas = {r["source"]: r["quota"] for r in mixing.source_quotas(aims, 16).collect()}
    assert quotas == highest_quotients(got, int(sum(got.values()) / 16 + 0.5))


def test_shard_quotas_equal_highest_quotients(spark):
    cases = [(f"s{i}", blocks, rest) for i, (blocks, rest) in enumerate(
        [(0, 0), (1, 0), (1, 1), (5, 3), (64, 31), (65, 40), (200, 199), (200, 200), (1000, 333)]
    )]
    rows = spark.createDataFrame(cases, "source string, blocks long, rest long")
    for r in mixing.shard_quotas(rows, 8).collect():
        _, blocks, rest = next(c for c in cases if c[0] == r["source"])
        votes = {k: max(0, min(r["length"], blocks - k * r["length"])) for k in range(8)}
        ranked = highest_quotients({f"{k}": v for k, v in votes.items()}, rest)
        assert r["quotas"] == [ranked.get(f"{k}", 0) for k in range(8)]
        assert sum(r["quotas"]) == rest and all(q <= votes[k] for k, q in enumerate(r["quotas"]))


def test_permutation_takes_every_place_once():
    for n in [1, 2, 3, 4, 5, 16, 17, 63, 64, 65, 1000]:
        x = np.arange(n)
        for key in (0, 12345):
            assert sorted(mixing.permuted(x, np.full(n, n), np.full(n, key, np.uint64)).tolist()) == x.tolist()


def test_words_picked_equal_a_walk_word_by_word():
    rnd = random.Random(2)
    block, length, blocks = 5, 7, 33
    start, rows = 0, []
    for _ in range(40):
        size = rnd.choice([0, 1, 3, 4, 11, 30])
        rows.append((start, size))
        start += size
    quotas = [rnd.randint(0, 7) for _ in range(start // (block * length) + 2)]
    key = 77
    batch = {
        "start": np.array([s for s, _ in rows]), "size": np.array([n for _, n in rows]),
        "blocks": np.full(len(rows), blocks), "length": np.full(len(rows), length), "first": np.zeros(len(rows), np.int64),
        "key": np.full(len(rows), key), "quotas": np.array(quotas), "offsets": np.zeros(len(rows), np.int64),
    }
    got = mixing._picked(batch, block)

    def is_picked(word):
        j = word // block
        if j >= blocks:
            return False
        shard = j // length
        n = min(length, blocks - shard * length)
        mixed = np.array([(key + shard) * 0xBF58476D1CE4E5B9 % 2**64], np.uint64)
        return mixing.permuted(np.array([j - shard * length]), np.array([n]), mixed)[0] < quotas[shard]

    assert got.tolist() == [sum(is_picked(w) for w in range(s, s + n)) for s, n in rows]


def test_mix_keeps_to_targets_and_reruns_agree(spark):
    rnd = random.Random(8)
    # One source holds a third of all rows, one document is very long.
    rows = [(i, "hot" if i % 3 == 0 else f"s{rnd.randint(0, 6)}", rnd.randint(0, 90)) for i in range(600)]
    rows += [(600, "s1", 60_000), (601, None, 40), (602, "", 0), (603, "empty", None)]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7, "taken", F.rand(3))).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    sized, taken = {}, {}
    for r in got:
        sized[r["source"]] = sized.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert {r["doc_id"]: r["size"] for r in got} == {i: n or 0 for i, _, n in rows}
    want = plain_targets(sized)
    for r in got:
        assert r["source_size"] == sized[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 1.5 * mixing.BLOCK for s in sized)


def test_mix_of_odd_tables(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    none = mixing.mix(documents(spark, [(1, "a", None), (None, None, 0)])).collect()
    assert sorted((r["target"], r["taken"]) for r in none) == [(0.0, 0), (0.0, 0)]
    # Repeated rows and null ids each count.
    same = mixing.mix(documents(spark, [(1, "a", 50)] * 30 + [(None, "b", 50)] * 30)).collect()
    assert len(same) == 60 and sum(r["size"] for r in same) == 3000
    for source, aim in (("a", 3000.0), ("b", 1500.0)):
        mine = [r for r in same if r["source"] == source]
        assert {r["target"] for r in mine} == {aim} and abs(sum(r["taken"] for r in mine) - aim) <= 24
    everything = mixing.mix(documents(spark, [(i, "a", 10) for i in range(5)]), share=200).collect()
    assert [r["taken"] for r in everything] == [20] * 5

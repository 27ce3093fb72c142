"""Periodic runs against brute force; the damage rule against a plain version; odd rows."""

import hashlib
import random
import zlib

import pytest

from reelquery.llm import periodic_runs

SCHEMA = "doc_id long, text string, words string, a int, p int, h string, start string"


def plain_runs(words, least, folds):
    n, out = len(words), []
    for p in range(1, n // folds + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - s
            smaller = any(all(words[k] == words[k + q] for k in range(s, s + length - q)) for q in range(1, p))
            if length >= max(least, folds * p) and not smaller:
                out.append((s, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def text_with_runs(rnd, most):
    k = rnd.choice([1, 2, 2, 3, 6])
    words = [b"%d" % rnd.randrange(k) for _ in range(rnd.randint(0, most))]
    for _ in range(rnd.randint(0, 4)):
        if len(words) > 4:
            a, p = rnd.randrange(len(words)), rnd.randint(1, len(words) // 5 + 1)
            for i in range(a, min(len(words), a + p * rnd.randint(2, 7) + rnd.randint(0, p))):
                words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("least, folds", [(24, 3), (4, 2), (1, 2)])
@pytest.mark.parametrize("chunk", [2, 1024])
def test_runs_equal_brute_force(monkeypatch, least, folds, chunk):
    monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
    rnd = random.Random(least * 100 + chunk)
    total = 0
    for _ in range(250):
        words = text_with_runs(rnd, 140)
        found = periodic_runs.runs(words, least, folds)
        assert found == plain_runs(words, least, folds)
        total += len(found)
    assert total > 80


def test_suffixes_and_prefixes():
    rnd = random.Random(4)
    for _ in range(60):
        words = text_with_runs(rnd, 60)
        order, lcp = periodic_runs.suffix_order(periodic_runs._codes(words))
        codes = periodic_runs._codes(words).tolist()
        assert order.tolist() == sorted(range(len(codes)), key=lambda i: codes[i:])
        for a, b, common in zip(order, order[1:], lcp[1:], strict=False):
            assert codes[a : a + common] == codes[b : b + common]
            assert codes[a + common : a + common + 1] != codes[b + common : b + common + 1] or not codes[b + common :]


def test_very_long_texts_end():
    assert periodic_runs.runs([b"a"] * 200_000) == [(0, 200_000, 1)]
    words = [b"%d" % (i * i % 4999) for i in range(4999)] * 20
    assert periodic_runs.runs(words) == [(0, len(words), 4999)]


def plain_result(text):
    words = (text or "").encode().split()
    found = plain_runs(words, 24, 3)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    told = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (len(found), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def plain_planted(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return text or ""
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return b" ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n)).decode()


def test_query_rows_equal_plain_version(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.randint(0, 120)))) for i in range(120)]
    rows += [(1000 + i, b" \n".join(text_with_runs(rnd, 90)).decode()) for i in range(60)]
    rows += [(5, None), (5, ""), (5, " \t\r"), (None, "x " * 40), (7, "é é " * 30), (7, "é é " * 30)]
    docs = spark.createDataFrame([(i, t, "w", 1, 2, "h", "s") for i, t in rows], SCHEMA)
    got = periodic_runs.periodic_runs(periodic_runs.planted(docs))
    assert got.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
    ]
    want = [(i, *plain_result(plain_planted(i, t))) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(1 for w in want if w[1]) > 15
    assert periodic_runs.periodic_runs(periodic_runs.planted(docs.limit(0))).collect() == []

"""Language ID, exact and near duplicates, decontamination: brute force on small tables, odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reelquery.llm import components, decontamination, exact_dedup, lang_id, resemblance, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, fp string"


def frame(spark, rows, lang=None):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, lang, None, None, 1.0, "k", "f") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (4, "other"), (None, "null id"), (5, "12 34 !?"), (6, "x" * 200_000)]


@pytest.mark.parametrize("capacity", [1, 3, 20_000])
def test_exact_groups_do_not_depend_on_bucket_capacity(spark, capacity):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["Alpha", "alpha", "ALPHA ", "beta", "É", "é", None, ""]) or None) for i in range(200)]
    rows += [(1000 + i, f"text {i}") for i in range(100)]
    got = {r[0]: tuple(r)[1:5] for r in exact_dedup.exact_duplicates(frame(spark, rows), capacity).collect()}
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    for i, t in rows:
        members = groups[fold(t)]
        want = (max(members), len(members), i == max(members), hashlib.sha256(fold(t).encode()).hexdigest())
        assert got[i] == want


def test_exact_odd_rows(spark):
    rows = exact_dedup.exact_duplicates(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    assert {r["group_size"] for r in rows if r["doc_id"] in (1, 2)} == {2}
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [False]
    kept = exact_dedup.keep_one(frame(spark, ODD))
    assert kept.columns == frame(spark, ODD).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "4", "4", "4", "5", "6", "None"]
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_directory_splits_overfull_buckets_only(spark):
    slots = spark.range(4000).select(F.xxhash64("id").alias("key"))
    cells = exact_dedup.directory(slots, 300)
    load = slots.join(cells, exact_dedup._cell(F.col("key")) == cells["cell"]).groupBy("bucket", "depth").count().collect()
    assert sum(r["count"] for r in load) == 4000
    assert max(r["count"] for r in load) <= 300
    assert min(r["depth"] for r in load) >= 3


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks):
    """marks: (doc_id, fingerprint) pairs; smallest id reachable over at most two differing bits."""
    ids, values = zip(*marks, strict=True)
    values = np.array(values, np.uint64)
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2)
            low = min(label[j] for j in near)
            if low < label[i]:
                label[i], changed = low, True
    return dict(zip(ids, label, strict=True))


def test_simhash_matches_brute_force(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        base = [rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 5, 120]))]
        for copy in range(3):
            changed = list(base)
            if changed and copy:
                changed[rnd.randrange(len(changed))] = rnd.choice(words)
            rows.append((3 * i + copy, " ".join(changed)))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    marks = [(i, brute_fingerprint(t)) for i, t in rows]
    assert all(int(got[i]["fingerprint"], 16) == m and len(got[i]["fingerprint"]) == 16 for i, m in marks)
    want = brute_components(marks)
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_ring_filter_loses_no_link(spark):
    rnd = random.Random(3)
    values = set()
    for _ in range(60):
        value = rnd.getrandbits(64)
        values.add(value)
        for flips in (1, 2, 3):
            near = value
            for bit in rnd.sample(range(64), flips):
                near ^= 1 << bit
            values.add(near)
    # Values that agree with others in one segment only, and are far apart in the rest.
    for low, width in ((0, 22), (22, 21), (43, 21)):
        part = rnd.getrandbits(width) << low
        for _ in range(40):
            values.add(rnd.getrandbits(64) & ~(((1 << width) - 1) << low) | part)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    linked = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    label = {r["node"]: r["label"] for r in components.components(linked).collect()}
    of_ids = dict(zip(signed, values, strict=True))
    want = brute_components(sorted(of_ids.items()))
    assert {v: label.get(v, v) for v in signed} == want


def test_simhash_odd_rows(spark):
    rows = simhash.near_duplicates(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    kept = simhash.keep_one(frame(spark, [(7, "a b c d"), (8, "a b c d"), (9, None), (10, "")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [7, 9]


def test_near_copies_match_brute_force_at_four_fifths(spark):
    import corpus_pipeline

    rnd = random.Random(4)
    rows = []
    for i in range(60):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([0, 2, 5, 30, 120]))]
        for copy in range(5):
            changed = list(base)
            for _ in range(copy if changed else 0):
                changed[rnd.randrange(len(changed))] = f"w{rnd.randrange(3000)}"
            rows.append((5 * i + copy, " ".join(changed).upper() if copy == 3 else " ".join(changed)))
    sets = {}
    for i, t in rows:
        words = t.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and label[b] < label[a]:
                    label[a], changed = label[b], True
    assert {r[0]: r[1] for r in resemblance.near_copies(frame(spark, rows)).collect()} == label
    kept = corpus_pipeline.drop_near(spark, frame(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label.values()))
    odd = resemblance.near_copies(frame(spark, ODD)).collect()
    assert len(odd) == len(ODD) and {r["component_id"] for r in odd if r["doc_id"] in (1, 2, 3)} == {1}
    assert resemblance.keep_one(frame(spark, [])).count() == 0


def test_near_copies_meet_on_the_ring_first(spark, monkeypatch):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(9000)}" for _ in range(400)]
    rows = []
    for i in range(60):  # one changed word each: close fingerprints, all linked
        changed = list(base)
        changed[rnd.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(changed)))
    shared = [f"s{i}" for i in range(5)]  # and texts that have one rare shingle in common
    rows += [(100 + i, " ".join([f"v{rnd.randrange(9000)}" for _ in range(90)] + shared)) for i in range(20)]
    sets = {resemblance.set_mark(resemblance.shingle_set(t)): t for _, t in rows}
    marks = {node: simhash.majority(simhash.shingle_hashes(t, 5)) for node, t in sets.items()}
    calls, compared = [], resemblance._compared

    def seen(pairs, *rest):
        calls.append({(r["a"], r["b"]) for r in pairs.collect()})
        return compared(pairs, *rest)

    monkeypatch.setattr(resemblance, "_compared", seen)
    found = {r["doc_id"]: r["component_id"] for r in resemblance.near_copies(frame(spark, rows)).collect()}
    assert found == {i: 0 if i < 100 else i for i, _ in rows}
    near = {(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 2}
    assert calls[0] and calls[0] <= near
    assert sum(map(len, calls)) < 5 * len(rows) and not any(calls[0] & later for later in calls[1:])


def test_blocks_over_batches_list_every_pair_once():
    import pyarrow as pa

    rnd = random.Random(2)
    most = resemblance.SMALL
    blocks = {key: sorted(rnd.sample(range(10**6), size)) for key, size in enumerate([1, 2, most, most + 1, 3 * most, 1, 2, 40, 5])}
    flat = [(key, node, 0, 9) for key, nodes in blocks.items() for node in nodes for _ in range(1 + node % 2)]  # repeated sets
    for step in (1, 7, most, len(flat)):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat[at : at + step], strict=True)], ["key", "node", "place", "n"])
            for at in range(0, len(flat), step)
        ]
        out = [r for batch in resemblance._block_batches((4, 5))(iter(batches)) for r in batch.to_pylist()]
        assert sorted((r["a"], r["b"]) for r in out if r["key"] is None) == sorted(
            (a, b) for nodes in blocks.values() if len(nodes) <= most for a in nodes for b in nodes if a < b
        )
        assert sorted((r["key"], r["a"], r["b"]) for r in out if r["key"] is not None) == [
            (key, node, nodes[0]) for key, nodes in blocks.items() if len(nodes) > most for node in nodes
        ]


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    labels = components.components(edges).collect()
    assert len(labels) == 301 and {r["label"] for r in labels} == {0}


ITEM = "If Alice has 12 apples and Bob takes 5 apples, then how many apples does Alice keep now?"


def test_templates_and_slots(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "So what"), (3, None), (None, ITEM)], "item_id long, text string")
    docs = frame(spark, [
        (1, f"Before that. {ITEM} After that."),
        (2, "If Carol has 99 apples and Dave takes 3.5 apples, then how many apples does Carol keep now?"),
        (3, "If Carol has 99 apples and Dave takes 3 apples, then how many apples does Eve keep now?"),
        (4, "how many apples does it take"), (5, "so what?"), *ODD,
    ])
    found = {(r["doc_id"], r["item_id"]): (r["kind"], r["n_changed"]) for r in decontamination.contaminated(docs, items).collect()}
    assert found == {(1, 1): ("verbatim", 0), (2, 1): ("reparameterised", 4), (5, 2): ("verbatim", 0)}
    left = {r["doc_id"] for r in decontamination.keep_clean(docs, items).collect()}
    assert left == {3, 4, 6, None}
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert decontamination.contaminated(docs.limit(0), items).count() == 0


def test_names_at_the_start_of_sentences(spark):
    items = spark.createDataFrame([
        (1, "Janet has 16 eggs in a basket. Janet sells 9 of them to Peter. How many eggs does Janet keep?"),
        (2, "Tom reads 12 pages on Monday. Anna reads 8 pages more. Tom then gives his book to Anna."),
    ], "item_id long, text string")
    docs = frame(spark, [
        (1, "Maria has 20 eggs in a basket. Maria sells 4 of them to Oscar. How many eggs does Maria keep?"),
        (2, "Said he:\nPaul reads 7 pages on Friday. Eve reads 5 pages more. Paul then gives his book to Eve."),
        (3, "Paul reads 7 pages on Friday. Eve reads 5 pages more. Max then gives his book to Jo."),
    ])
    found = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontamination.contaminated(docs, items).collect()}
    assert found == {(1, 1): "reparameterised", (2, 2): "reparameterised"}


def test_every_item_is_found_verbatim(spark):
    texts = ["Compute 12 * 34 + 56 - 7 / 8.", "12, 17, 22, 27, 32, ?", "What is 48 + 24?", "Who wrote Hamlet?"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = frame(spark, [(i, f"Some words come first. {t} And others after it.") for i, t in enumerate(texts)] + [
        (10, "Some words first. Compute 13 * 34 + 56 - 7 / 9. What is 48 + 25? Who wrote Faust?"), (11, "13, 18, 22, 27, 32, 99"),
    ])
    found = decontamination.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in found} == {(i, i, "verbatim") for i in range(4)}


def test_many_rows_without_an_id_do_not_meet(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(None, " ".join(words + [f"x{i}"])) for i in range(1500)] + [(7, " ".join(words + [f"y{i}"])) for i in range(1500)]
    found = resemblance.near_copies(frame(spark, rows)).collect()
    assert len(found) == 3000 and {r["component_id"] for r in found} == {7}


def test_rows_without_an_id_and_repeated_items(spark):
    text = "If Alice has 12 apples and gives 5 of them to her brother Robert, how many apples does Alice keep then?"
    items = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "item_id long, text string")
    docs = frame(spark, [(None, f"So. {text} Yes."), (None, "a clean text of some words that is in no benchmark"), (3, text), (3, "other")])
    found = sorted((str(r["doc_id"]), r["item_id"], r["kind"]) for r in decontamination.contaminated(docs, items).collect())
    assert found == [("3", 1, "verbatim"), ("3", 2, "verbatim"), ("None", 1, "verbatim"), ("None", 2, "verbatim")]
    kept = [tuple(r)[:2] for r in decontamination.keep_clean(docs, items).collect()]
    assert kept == [(None, "a clean text of some words that is in no benchmark")]


def test_decontamination_of_a_very_long_text(spark):
    item = "If Alice has 12 apples and gives 5 of them to her brother Robert, how many apples does Alice keep then?"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = frame(spark, [(1, "Some words of No use 7 km away. " * 60_000 + item), (2, "no " * 900_000)])
    assert [(r["doc_id"], r["kind"]) for r in decontamination.contaminated(docs, items).collect()] == [(1, "verbatim")]


def test_decontamination_both_join_paths_agree_with_brute_force(spark, folder, monkeypatch):
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    first = sorted(map(tuple, decontamination.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, decontamination.contaminated(docs, items).collect())) == first
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    verbatim = {(i, r["item_id"]) for r in items.collect() for i, t in texts if r["text"] in t}
    assert verbatim <= {(r[0], r[1]) for r in first}


def test_language_odd_rows_and_no_labels(spark):
    docs = frame(spark, ODD)
    assert lang_id.train(docs) is None
    rows = lang_id.language_of(docs, None).collect()
    assert len(rows) == len(ODD) and {r["lang_pred"] for r in rows} == {"und"}
    one = frame(spark, ODD, "en")
    net = lang_id.train(one)
    found = {r["doc_id"]: r["lang_pred"] for r in lang_id.language_of(one, net).collect()}
    assert found[1] == found[2] == found[5] == "und" and found[6] == "en"
    assert lang_id.keep_known(one, net).columns == one.columns
    assert lang_id.language_of(docs.limit(0), net).count() == 0


def test_language_gradients():
    net = lang_id.new_network(["a", "b", "c"], 3)
    for array in net.weights():
        array[...] = np.round(array, 2)
    rng = np.random.default_rng(5)
    windows = rng.integers(97, 100, (6, 4)).astype(np.uint8)
    labels, mask = np.array([0, 1, 2, 1]), np.ones((6, 4), np.float32)

    def loss():
        shares = lang_id.position_probabilities(net, windows)
        return -np.log(shares[:, labels, np.arange(4)]).mean()

    for array, slope in zip(net.weights(), lang_id._gradients(net, windows, labels, mask), strict=True):
        flat = np.abs(slope).ravel().argsort()[-3:]
        for place in flat:
            at = np.unravel_index(place, array.shape)
            old = array[at]
            array[at] = old + 1e-2
            up = loss()
            array[at] = old - 1e-2
            down = loss()
            array[at] = old
            assert slope[at] == pytest.approx((up - down) / 2e-2, rel=0.1, abs=2e-3)


def test_language_held_out_accuracy(spark):
    from reelquery.llm.queries import op1_language_id

    folder = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op1_language_id(spark, folder).collect()
    assert len(rows) == len(langs)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)

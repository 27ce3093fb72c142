import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.operators import text_search, vector_search


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(11)
    names = ["image_vectors", "video_frame_vectors", "caption_text_vectors"]

    def unit(n):
        v = rng.normal(size=(n, 8))
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    # A third of all points belong to one scene; some vectors repeat, so scores tie.
    data = unit(300)
    data[50:60] = data[40]
    points = [
        (i, names[i % 3], None if i % 17 == 0 else ("hot" if i % 9 == 1 else f"s{i % 40}"),
         [float(np.float32(x)) for x in data[i]])
        for i in range(300)
    ]
    queries = [(q, v, 1.0 - 0.15 * v, [float(x) for x in unit(1)[0]])
               for q in range(5) for v in range(2)]
    return (
        spark.createDataFrame(points, "point_id long, collection string, scene_id string, "
                                      "embedding array<float>").repartition(5),
        spark.createDataFrame(queries, "query_id long, variant_order int, weight double, "
                                       "query_embedding array<double>"),
        points, queries,
    )


def brute(points, queries, depth, grouped):
    out = set()
    for q, v, _, e in queries:
        for name in {p[1] for p in points}:
            best = {}
            for pid, collection, scene, vec in points:
                if collection != name:
                    continue
                by_scene = grouped and name == "video_frame_vectors"
                if by_scene and scene is None:
                    continue
                score = round(float(np.dot(np.float32(vec).astype(float), e)), 6)
                key = scene if by_scene else str(pid)
                best[key] = min(best.get(key, (9, 0)), (-score, pid))
            for score, pid in sorted(best.values())[:depth]:
                out.add((q, v, name, pid, -score + 0.0))
    return out


@pytest.mark.parametrize("grouped", [True, False])
@pytest.mark.parametrize("values", [2_000_000, 30])
def test_hits_equal_brute_force(spark, vectors, grouped, values, monkeypatch):
    """One block of queries or several, with small tiles and a budget of held rows that is soon full."""
    points, queries, raw_points, raw_queries = vectors
    monkeypatch.setattr(vector_search, "BLOCK_VALUES", values)
    if values == 30:
        monkeypatch.setattr(vector_search.tasks, "HELD_ROWS", 100)
        monkeypatch.setattr(vector_search.tasks, "TILE_CELLS", 12)
        monkeypatch.setattr(vector_search.tasks, "TILE_QUERIES", 3)
    found = vector_search.variant_hits(points, queries, 7, grouped)
    got = {(r.query_id, r.variant_order, r.collection, r.point_id, r.score + 0.0)
           for r in found.collect()}
    assert got == brute(raw_points, raw_queries, 7, grouped)


@pytest.mark.parametrize("size, n_queries", [(4, 3000), (768, 3000)])
def test_tiles_bound_memory_and_equal_one_tile(size, n_queries, monkeypatch):
    """A task's batches against a block: the peak is far below the matrix of all scores."""
    import tracemalloc

    import pandas as pd
    import pyarrow as pa

    rng = np.random.default_rng(size)
    frame = pd.DataFrame({
        "query_id": np.arange(n_queries), "variant_order": 0, "weight": 1.0, "collection": None,
        "scopes": [None if q % 3 else ["l1", "l2"][: q % 2 + 1] for q in range(n_queries)],
        "query_embedding": list(rng.normal(size=(n_queries, size))),
    })
    block = vector_search.tasks.block_of(frame)
    points = [
        pa.RecordBatch.from_pydict({
            "point_id": np.arange(low, low + 2000), "collection": ["a"] * 2000,
            "identity": [f"s{i // 3}" for i in range(low, low + 2000)],
            "scope": [None if i % 7 == 0 else f"l{i % 4}" for i in range(low, low + 2000)],
            "embedding": pa.array(list(rng.normal(size=(2000, size)).astype(np.float32))),
        }) for low in (0, 2000)
    ]

    def hits(cells):
        monkeypatch.setattr(vector_search.tasks, "TILE_CELLS", cells)
        monkeypatch.setattr(vector_search.tasks, "TILE_QUERIES", max(1, cells // 100))
        tracemalloc.start()
        out = pa.Table.from_batches(vector_search.tasks.best_hits(iter(points), block, 20)).to_pandas()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out.sort_values(["query_id", "score", "point_id"], ignore_index=True), peak

    small, peak = hits(1 << 16)
    whole, whole_peak = hits(1 << 30)
    assert small.equals(whole) and len(small) == 20 * n_queries
    assert peak < 60e6 < whole_peak


def test_summary_does_not_depend_on_blocks(spark, vectors, monkeypatch):
    points, queries, _, _ = vectors
    whole = sorted(map(tuple, vector_search.score_summary(points, queries).collect()))
    monkeypatch.setattr(vector_search, "BLOCK_VALUES", 30)
    assert sorted(map(tuple, vector_search.score_summary(points, queries).collect())) == whole
    assert len(whole) == 30


def test_each_channel_has_its_own_size_and_bad_vectors_are_told(spark):
    nan = float("nan")
    points = spark.createDataFrame(
        [(1, "a", "s", [1.0, 0.0, 0.0]), (2, "a", "s", [0.0, 1.0, 0.0]), (3, "b", "s", [0.6, 0.8, 0.0, 0.0, 0.0]),
         (4, "a", "s", None), (5, "a", "s", [1.0, nan, 0.0]), (6, "b", "s", [1.0, 0.0, 0.0]), (7, "a", "s", []),
         (8, "a", "s", [None, 1.0, 0.0])],
        "point_id long, collection string, scene_id string, embedding array<double>",
    ).coalesce(1)
    queries = spark.createDataFrame(
        [(1, 0, 1.0, "a", [0.0, 1.0, 0.0]), (1, 0, 1.0, "b", [1.0, 0.0, 0.0, 0.0, 0.0]), (2, 0, 1.0, "a", None)],
        "query_id long, variant_order int, weight double, collection string, query_embedding array<double>",
    )
    hits = vector_search.variant_hits(points, queries, 5, grouped=False).collect()
    assert sorted((r.collection, r.point_id, r.score) for r in hits) == [("a", 1, 0.0), ("a", 2, 1.0), ("b", 3, 0.6)]
    told = {r.point_id: r.reason for r in vector_search.unscorable(points, queries).collect()}
    assert told == {4: "missing", 5: "not_finite", 6: "size", 7: "size", 8: "not_finite"}


def test_only_the_libraries_asked_for_are_searched(spark):
    points = spark.createDataFrame(
        [(i, "a", "s", f"l{i % 3}", [1.0, float(i)]) for i in range(30)],
        "point_id long, collection string, scene_id string, library_id string, embedding array<double>",
    )
    queries = spark.createDataFrame(
        [(1, 0, 1.0, [0.0, 1.0], ["l1"]), (2, 0, 1.0, [0.0, 1.0], None), (3, 0, 1.0, [0.0, 1.0], [])],
        "query_id long, variant_order int, weight double, query_embedding array<double>, library_ids array<string>",
    )
    hits = vector_search.variant_hits(points, queries, 3, grouped=False).collect()
    found = sorted((r.query_id, r.hit_rank, r.point_id) for r in hits)
    assert found == [(1, 1, 28), (1, 2, 25), (1, 3, 22), (2, 1, 29), (2, 2, 28), (2, 3, 27)]


def test_earlier_variant_wins_ties_and_one_wins(spark):
    hits = spark.createDataFrame(
        [(1, 0, 1.0, "image_vectors", "p", 5, 0.4), (1, 1, 0.5, "image_vectors", "p", 5, 0.8)],
        vector_search.tasks.HIT_SCHEMA,
    )
    best = vector_search.best_variant(hits).collect()
    assert [(r.variant_order, r.weighted_score) for r in best] == [(0, 0.4)]
    assert [r.winning for r in vector_search.variant_evidence(hits).orderBy("variant_order")
            .collect()] == [True, False]


def test_no_queries_no_hits(spark, vectors):
    assert vector_search.variant_hits(vectors[0], vectors[1].filter("query_id < 0"), 5).count() == 0


def loop_covers(words, terms):
    """Minimal spans by definition: hold all terms, and no smaller span inside does."""
    spots = [i for i, w in enumerate(words) if w in terms]
    spans = [(a, b) for a in spots for b in spots if a <= b
             and terms <= set(words[a:b + 1])]
    minimal = [s for s in spans if not any(
        o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return sorted((a + 1, b + 1, sum(1 for w in words[a:b + 1] if w not in terms))
                  for a, b in minimal)


def test_covers_equal_definition(spark):
    rng = random.Random(2)
    docs = [(d, " ".join(rng.choice("abcdexyz") for _ in range(rng.randint(1, 40))))
            for d in range(25)]
    queries = [(1, "a"), (2, "a b"), (3, "B, c-a"), (4, "a b c d"), (5, "q"), (6, "a A a"), (7, "!")]
    docs_df = spark.createDataFrame(docs, "doc_id int, text string")
    queries_df = spark.createDataFrame(queries, "query_id int, query_text string")
    matches = text_search.match_all_terms(
        docs_df, text_search.query_terms(queries_df), "doc_id"
    )
    found = {}
    for r in text_search.covers(text_search.term_positions(matches, "doc_id"), "doc_id").collect():
        found.setdefault((r.query_id, r.doc_id), []).append((r.start_pos, r.end_pos, r.noise))
    expected = {}
    terms = {1: "a", 2: "ab", 3: "abc", 4: "abcd", 5: "q", 6: "a"}
    for q, wanted in terms.items():
        for d, text in docs:
            spans = loop_covers(text.split(), set(wanted))
            if spans:
                expected[(q, d)] = spans
    assert {k: sorted(v) for k, v in found.items()} == expected


def test_packing_gives_back_what_went_in():
    tasks = text_search.tasks
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40, 5] * 3)
    data, lengths = tasks.packed(values)
    assert tasks.unpacked(data.tobytes()).tolist() == values.tolist() and lengths.sum() == len(data)
    assert tasks.unpacked(b"").tolist() == []
    rng = np.random.default_rng(5)
    n = 5000
    term, pos = rng.integers(0, 7, n), rng.integers(1, 300, n)
    doc = rng.integers(-3, 4, n) * (1 << tasks.RANGE_BITS) + rng.integers(0, 50, n)
    import pyarrow as pa

    rows = tasks.blocks_of(pa.array(list("abcdefg")), term, doc, pos).to_pylist()
    back = [(r["term"], d, p) for r in rows for d, p in zip(
        *(a.tolist() for a in tasks.occurrences(r["doc_range"], r["docs"], r["tfs"], r["positions"])), strict=True)]
    assert sorted(back) == sorted(("abcdefg"[t], d, p) for t, d, p in zip(term.tolist(), doc.tolist(), pos.tolist(), strict=True))
    assert len({(r["term"], r["doc_range"]) for r in rows}) == len(rows)


def test_rank_equals_covers_by_definition(spark, monkeypatch):
    """Scores of the blocks against the windows over positions, with ranges of four documents."""
    monkeypatch.setattr(text_search.tasks, "RANGE_BITS", 2)
    rng = random.Random(7)
    docs = [(d, " ".join(rng.choice("abcdexyz") for _ in range(rng.randint(0, 60)))) for d in range(40)] + [(None, "a")]
    queries = [(1, "a"), (2, "a b"), (3, "b c a"), (4, "a b c d"), (5, "q"), (6, "a A a"), (7, "!")]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    queries_df = spark.createDataFrame(queries, "query_id int, query_text string")
    matches = text_search.match_all_terms(docs_df, text_search.query_terms(queries_df), "doc_id")
    by_windows = {}
    for r in text_search.covers(text_search.term_positions(matches, "doc_id"), "doc_id").collect():
        by_windows.setdefault((r.query_id, r.doc_id), []).append(0.1 / (1 + r.noise))
    ranked = {(r.query_id, r.doc_id): (r.n_covers, r.score) for r in text_search.text_rank(docs_df, queries_df, "doc_id").collect()}
    assert ranked.keys() == by_windows.keys() and len(ranked) > 100
    for key, parts in by_windows.items():
        assert ranked[key] == (len(parts), pytest.approx(sum(parts)))


def test_postings_exchange_no_tokens(spark):
    docs = spark.createDataFrame([(i, f"a b{i} a") for i in range(50)], "doc_id long, text string")
    index = text_search.postings(docs, "doc_id")
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning(term") == 1
    rows = {(r.term, r.doc_id): (r.positions, r.tf) for r in index.collect()}
    assert rows[("a", 7)] == ([1, 3], 2) and len(rows) == 100


def test_early_cut_equals_the_full_result(spark, tmp_path, monkeypatch):
    """Many ranges, a word in every document: few ranges are scored, the page is the same."""
    rng = random.Random(31)
    rows = []
    for i in range(800):
        words = [rng.choice("uvwxyz") for _ in range(rng.randint(1, 12))] + ["all"] * (1 + (i % 97 == 0) * 6 + (i % 5 == 0))
        rng.shuffle(words)
        rows.append((i, i % 4, "text_chunk", None, float(i % 7), 1.0, " ".join(words)))
    chunks = spark.createDataFrame(
        rows, "asset_id long, file_id long, asset_type string, scene_id string, start_s double, end_s double, text_content string"
    )
    files = spark.createDataFrame(
        [(f, "l0", "video", "p", f == 3) for f in range(4)], "file_id long, library_id string, media_type string, path string, is_deleted boolean"
    )
    libraries = spark.createDataFrame([("l0", False)], "library_id string, is_deleted boolean")
    queries = spark.createDataFrame([(1, "all"), (2, "all u"), (3, "v w"), (4, "nowhere")], "query_id long, query_text string")

    def page(bits, index=None):
        monkeypatch.setattr(text_search.tasks, "RANGE_BITS", bits)
        found = text_search.text_search(chunks, files, libraries, queries, 6, index)
        return sorted((r.query_id, r.channel_rank, r.asset_id, r.score) for r in found.collect())

    whole = page(14)
    assert len(whole) == 18 and page(3) == whole
    text_search.write_index(text_search.block_index(chunks, "asset_id", "text_content"), f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    assert page(3, index) == whole
    looked = []
    ranked = text_search._Search.ranked
    monkeypatch.setattr(text_search._Search, "ranked", lambda self, ranges: looked.append(ranges.filter("query_id = 1").count()) or ranked(self, ranges))
    page(3, index)
    assert 8 <= sum(looked) <= 12  # of the 100 ranges of the word in every document


def test_search_opens_the_folders_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(300)], "doc_id long, text string")
    text_search.write_index(text_search.block_index(docs, "doc_id"), f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    wanted = spark.createDataFrame([("w5",)], "term string")
    own = text_search._blocks(index, "doc_id", wanted)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert len(list((tmp_path / "index").glob("bucket=*"))) > 40 and own.count() == 1


def test_single_term_rank_is_weight_times_frequency(spark):
    docs = spark.createDataFrame([(1, "x a a y a")], "doc_id int, text string")
    query = spark.createDataFrame([(1, "A")], "query_id int, query_text string")
    row = text_search.text_rank(docs, query, "doc_id").first()
    assert row.score == pytest.approx(0.3) and row.n_covers == 3


def test_search_over_a_stored_index_reads_no_text(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, i % 3, "text_chunk", "s", float(i), i + 1.0, f"red {'blue' if i % 2 else 'green'} apple {i}") for i in range(30)],
        "asset_id long, file_id long, asset_type string, scene_id string, start_s double, end_s double, text_content string",
    )
    docs.write.parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    text_search.postings(chunks, "asset_id", "text_content").write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    files = spark.createDataFrame(
        [(0, "l0", "video", "p", False), (1, "l1", "audio", "p", False), (2, "l2", "video", "p", True)],
        "file_id long, library_id string, media_type string, path string, is_deleted boolean",
    )
    libraries = spark.createDataFrame([("l0", False), ("l1", False)], "library_id string, is_deleted boolean")
    queries = spark.createDataFrame([(1, "red blue"), (2, "apple"), (3, "none")], "query_id long, query_text string")
    args = (chunks, files, libraries, queries, 4)
    stored = text_search.text_search(*args, index=index)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "text_content" not in plan
    found = sorted((r.query_id, r.channel_rank, r.asset_id) for r in stored.collect())
    assert found == sorted((r.query_id, r.channel_rank, r.asset_id) for r in text_search.text_search(*args).collect())
    assert [a for q, _, a in found if q == 1] == [1, 3, 7, 9]
    filters = spark.createDataFrame([(1, ["l1"], None), (2, None, ["audio"])], "query_id long, library_ids array<string>, media_types array<string>")
    some = text_search.text_search(*args, index=index, filters=filters)
    got = sorted((r.query_id, r.channel_rank, r.asset_id) for r in some.collect())
    assert [a for q, _, a in got if q == 1] == [1, 7, 13, 19] and [a for q, _, a in got if q == 2] == [1, 4, 7, 10]


def test_search_plan_has_no_cross_join(spark, folder):
    from reelquery.plans import join_queries
    from reelquery.sources.adapters import Tables

    hits = join_queries.channel_hits(Tables(spark, folder))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan
    source = plan[plan.rindex("FileScan"):]
    assert "ReadSchema: struct<vec_id" in source or "embedding" in source
    assert F is not None


def test_translated_requests_send_each_channel_its_variant(spark):
    from reelquery.plans import search

    queries = spark.createDataFrame(
        [(q, v, w, [1.0, 0.0], s) for q in (1, 2) for v, w, s in ((0, 1.0, "original"), (1, 0.85, "expansion"))],
        "query_id long, variant_order int, weight double, query_embedding array<double>, source string",
    )
    requests = spark.createDataFrame(
        [(1, None, None, "translate"), (2, None, ["image_vectors"], "expand")],
        "query_id long, library_ids array<string>, channels array<string>, mode string",
    )
    found = sorted((r.query_id, r.collection, r.variant_order, r.weight) for r in search.routed(queries, requests).collect())
    assert found == [
        (1, "caption_text_vectors", 0, 1.0), (1, "image_vectors", 1, 1.0), (1, "video_frame_vectors", 1, 1.0),
        (2, "image_vectors", 0, 1.0), (2, "image_vectors", 1, 0.85),
    ]
    plain = search.routed(queries.drop("source"), requests.drop("mode"))
    assert plain.count() == 8
    with pytest.raises(ValueError):
        points = spark.createDataFrame([(1, "a", "s", [1.0, 0.0])], "point_id long, collection string, scene_id string, embedding array<double>")
        vector_search.variant_hits(points, search.routed(queries, requests), 5)


def test_tasks_hold_a_bounded_number_of_occurrences(monkeypatch):
    """However many rows a batch has, blocks are packed, merged and unpacked in shares."""
    import pyarrow as pa

    tasks = text_search.tasks
    monkeypatch.setattr(tasks, "HELD_TOKENS", 300)
    rng = random.Random(8)
    texts = {key: [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))] for key in range(400)}
    held = []
    whole = tasks.blocks_of
    monkeypatch.setattr(tasks, "blocks_of", lambda names, term, doc, pos: held.append(len(pos)) or whole(names, term, doc, pos))
    given = pa.RecordBatch.from_arrays(
        [pa.array(texts, pa.int64()), pa.array(list(texts.values()), pa.list_(pa.string()))], ["key", "tokens"]
    )
    packed = pa.Table.from_batches(tasks.pack_tokens(iter([given]), None)).sort_by([("term", "ascending"), ("doc_range", "ascending")])
    assert max(held) <= 300 and sum(held) == sum(map(len, texts.values()))
    merged = list(tasks.merge_blocks(iter(packed.combine_chunks().to_batches())))
    assert sum(map(len, merged)) == 8
    rows = list(tasks.posting_rows(iter(pa.Table.from_batches(merged).combine_chunks().to_batches())))
    assert len(rows) > 1
    found = {(r["key"], r["term"]): r["positions"] for batch in rows for r in batch.to_pylist()}
    assert found == {(k, w): [i + 1 for i, x in enumerate(t) if x == w] for k, t in texts.items() for w in t}

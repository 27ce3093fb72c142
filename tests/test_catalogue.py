import random

import json

import pytest
from pyspark.sql import functions as F

from reelquery.operators import hydration, jobs, quality, relations, reports, snapshots
from reelquery.sources import files as listings
from reelquery.sources import tables


def test_listing_twice_skips(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.jpg").write_bytes(b"x")
    (tmp_path / "sub" / "b.MP4").write_bytes(b"yy")
    (tmp_path / "c.zip").write_bytes(b"z")
    found = listings.scan_files(spark, str(tmp_path), "lib")
    assert sorted((r.relative_path, r.media_type, r.size_bytes) for r in found.collect()) == [
        ("a.jpg", "image", 1), ("sub/b.MP4", "video", 2)
    ]
    empty = spark.createDataFrame([], "library_id string, path string, file_id string, "
                                      "size_bytes long, mtime_ms long, index_status string")
    first = snapshots.file_snapshot_diff(empty, found)
    assert {r.outcome for r in first.collect()} == {"created"}
    stored = first.withColumn("file_id", F.col("path")).drop("known_file_id")
    again = snapshots.scan_summary(snapshots.file_snapshot_diff(stored, found)).first()
    assert (again.created, again.updated, again.skipped) == (0, 0, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan[plan.index("ReadSchema"):]


def test_dynamic_overwrite_keeps_other_partitions(spark, tmp_path):
    one = spark.createDataFrame([("f1", "a", 1), ("f2", "b", 2)],
                                "file_id string, library_id string, size_bytes long")
    tables.write_table(one, str(tmp_path), "media_files")
    tables.write_table(one.filter("library_id = 'b'").withColumn("size_bytes", F.lit(9)),
                       str(tmp_path), "media_files", files_per_partition=3)
    found = tables.read_table(spark, str(tmp_path), "media_files")
    assert sorted((r.file_id, r.size_bytes) for r in found.collect()) == [("f1", 1), ("f2", 9)]


def test_json_patch_keeps_types(spark):
    base, patch = '{"a":1,"b":[1,"x"],"c":{"d":null}}', '{"a":"new","stale":true}'
    df = spark.createDataFrame([(base, patch), (None, patch)], "b string, p string")
    merged = [json.loads(r[0]) for r in df.select(
        snapshots.json_patch(F.col("b"), F.col("p"))).collect()]
    assert merged == [{"a": "new", "b": [1, "x"], "c": {"d": None}, "stale": True},
                      {"a": "new", "stale": True}]


def test_stale_is_strictly_later_than_the_timeout(spark):
    log = spark.sql("""
        SELECT * FROM VALUES (1, 'running', timestamp'2024-01-01 00:00:00', 60),
          (2, 'running', timestamp'2024-01-01 00:00:01', 60), (3, 'running', null, 60),
          (4, 'queued', null, 60) AS t(job_id, status, heartbeat_at, timeout_seconds)""")
    as_of = F.lit("2024-01-01 00:01:01").cast("timestamp")
    assert sorted(r.job_id for r in jobs.stale_jobs(log, as_of).collect()) == [1, 3]


def gate_row(case, seconds, duration=30.0, fps=1.0, relevance=2, failure=None, i=0):
    return ("r", case, i, duration, fps, seconds, 2, relevance, True, failure)


GATE = ("run_id string, case_id string, result_id int, duration_s double, fps double, "
        "inference_s double, expected_relevance int, relevance int, transient_action boolean, "
        "failure_type string")


def test_quality_gate(spark):
    good = [gate_row(f"c{c}", 20.0, fps=f, i=int(c * 2 + f)) for c in range(3) for f in (1.0, 2.0)]
    row = reports.quality_gate(spark.createDataFrame(good, GATE)).first()
    assert row.passed and row.worst_top3_seconds == 60.0
    failed = [*good, gate_row("c9", 1.0, failure="VLM_TIMEOUT", i=99)]
    assert not reports.quality_gate(spark.createDataFrame(failed, GATE)).first().passed
    slow = [gate_row(f"c{c}", 61.0, fps=f, i=int(c * 2 + f)) for c in range(3) for f in (1.0, 2.0)]
    assert not reports.quality_gate(spark.createDataFrame(slow, GATE)).first().all_clips_in_time
    only_one_fps = [r for r in good if r[4] == 1.0]
    found = reports.quality_gate(spark.createDataFrame(only_one_fps, GATE)).first()
    assert not found.one_fps_keeps_actions


def test_resource_gate(spark):
    gib = 1024**3
    rows = [("r", i, f"2024-01-01 00:00:0{i}", int(v * gib)) for i, v in enumerate([1, 6, 3])]
    df = spark.createDataFrame(rows, "run_id string, sample_id int, ts string, used_bytes long")
    row = reports.resource_gate(df).first()
    assert (row.peak_growth, row.end_growth, row.within_limit) == (5 * gib, 2 * gib, False)


@pytest.mark.parametrize("kind, message, expected", [
    ("InferenceTimeoutError", "video", "VLM_TIMEOUT"), ("RuntimeError", "MPS Out of memory",
                                                       "OUT_OF_MEMORY"),
    ("ValueError", "not strict JSON", "INVALID_STRUCTURED_OUTPUT"),
    ("RuntimeError", "not strict JSON", "INFERENCE_FAILED"), ("OSError", "FFmpeg exited 1",
                                                            "VIDEO_DECODE_FAILED"),
    ("KeyboardInterrupt", None, "INTERRUPTED"),
])
def test_failure_category(spark, kind, message, expected):
    df = spark.createDataFrame([(kind, message)], "k string, m string")
    assert df.select(reports.failure_category(F.col("k"), F.col("m"))).first()[0] == expected


def test_strict_response(spark):
    good = {"relevance": 2, "matched_constraints": ["a"], "missing_constraints": [], "reason": "r"}
    cases = [
        (good, ""), ({**good, "relevance": "2"}, "relevance"), ({**good, "relevance": 2.0},
                                                              "relevance"),
        ({**good, "reason": " "}, "reason"), ({**good, "matched_constraints": [1]},
                                            "matched_constraints"),
        ({**good, "missing_constraints": "x"}, "missing_constraints"),
        ({**good, "x": 1}, "wrong_keys"), ([good], "not_an_object"),
    ]
    rows = [(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, "{oops")]
    df = spark.createDataFrame(rows, "i int, response_json string")
    found = [",".join(r.problems) for r in quality.strict_response_check(df).orderBy("i").collect()]
    assert found == [p for _, p in cases] + ["not_an_object"]


def test_reindex_admission(spark):
    files = spark.createDataFrame([(1, False, "indexed"), (2, False, "indexed"), (3, True, "x")],
                                  "file_id long, is_deleted boolean, index_status string")
    log = spark.createDataFrame(
        [(7, "embed_image", "queued", None, '{"file_id":"2"}'),
         (8, "scan_library", "queued", 1, "{}"), (9, "index_media", "failed", 1, "{}")],
        "job_id int, job_type string, status string, file_id long, input_json string")
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "file_id long")
    found = relations.reindex_admission(wanted, files, log)
    assert {r.file_id: r.outcome for r in found.collect()} == {
        1: "admitted", 2: "conflict", 3: "missing"
    }


def test_purge_twice_raises_the_generation_once(spark):
    files = spark.createDataFrame([(1, "purge_queued", 4)],
                                  "file_id int, index_status string, index_generation int")
    assets = spark.createDataFrame([(1, "text_chunk"), (1, "caption")],
                                   "file_id int, asset_type string")
    none = spark.createDataFrame([(1,)], "file_id int")
    once = snapshots.purge_files(none, files, assets, none, none)
    twice = snapshots.purge_files(none, once["files"], once["assets"], once["refs"], once["scenes"])
    assert once["report"].first().assets_deleted == 1
    row = twice["files"].first()
    assert (row.index_generation, row.index_status) == (5, "pending")
    assert [r.asset_type for r in twice["assets"].collect()] == ["text_chunk"]


def test_redacted_arrays(spark):
    df = spark.sql("SELECT array(named_struct('id', 1, 'cache_path', '/x')) AS assets, 'p' AS path")
    safe = hydration.redact_nested(hydration.redacted(df, ["path"]), "assets", ["cache_path"])
    assert safe.columns == ["assets"] and safe.first()[0][0].asDict() == {"id": 1}


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 20).alias("file_id"), F.col("id").alias("asset_id"))
    tables.write_bucketed(rows, "t_assets", "file_id", 4, str(tmp_path / "a"))
    tables.write_bucketed(spark.range(20).withColumnRenamed("id", "file_id"), "t_files", "file_id",
                          4, str(tmp_path / "f"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("t_assets").join(spark.table("t_files"), "file_id")
        assert joined.count() == 200
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE t_assets")
        spark.sql("DROP TABLE t_files")


def test_prefilter_leaves_only_indexed_points(spark, folder):
    from reelquery.plans import join_queries, search
    from reelquery.sources.adapters import Tables

    t = Tables(spark, folder)
    hits = search.channel_hits(join_queries.catalogue(t), t.v_queries, 30, prefilter=True)
    live = t.v_refs.filter("status = 'indexed'").select("collection", "point_id")
    assert hits.count() > 0
    assert hits.join(live, ["collection", "point_id"], "left_anti").count() == 0


def test_range_join_equals_direct_comparison(spark):
    import random

    rng = random.Random(8)
    make = lambda n: [(rng.randint(0, 2), i, float(a), a + rng.choice([0.0, 0.5, 7.0, 30.0]))
                      for i, a in enumerate(rng.uniform(0, 60) for _ in range(n))]
    left, right = make(60), make(50)
    schema = "file_id int, w int, start_s double, end_s double"
    pairs = relations.window_overlaps(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 4.0, "w", "w")
    expected = sorted((a[1], b[1]) for a in left for b in right
                      if a[0] == b[0] and max(a[2], b[2]) < min(a[3], b[3]))
    assert sorted((r.left_id, r.right_id) for r in pairs.collect()) == expected


def test_window_overlaps_in_a_time_tree(spark, monkeypatch):
    """Long, short and crowded windows against all pairs; nodes a window stands at grow with the logarithm."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(relations, "HOT_NODE", 5)
    rng = random.Random(6)

    def made(n):
        rows = []
        for i in range(n):
            start = rng.choice([0.0, 8.0, -16.0, rng.uniform(-50, 4000)])
            rows.append((i, rng.choice([1, 1, 2]), start, start + rng.choice([-1.0, 0.0, 0.5, 8.0, 40.0, 3000.0, rng.uniform(0, 90)])))
        return rows

    left, right = made(120), made(140)
    schema = "id long, file_id long, start_s double, end_s double"
    pairs = relations.window_overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 8.0, "id", "id")
    want = sorted(
        (a[0], b[0]) for a in left for b in right
        if a[1] == b[1] and max(a[2], b[2]) < min(a[3], b[3]) and a[3] > a[2] and b[3] > b[2]
    )
    assert sorted((r.left_id, r.right_id) for r in pairs.collect()) == want and len(want) > 1000
    spans = [(a, a + n) for a in (-7, 0, 1, 5, 1023, 1024) for n in (0, 1, 2, 30, 1000, 100_000)]
    told = spark.createDataFrame(spans, "a long, b long").select("a", "b", relations._tree_nodes(F.col("a"), F.col("b")).alias("n"))
    for r in told.collect():
        leaves = sorted(x for n in r.n for x in (n["node"] << n["level"], ((n["node"] + 1) << n["level"]) - 1))
        assert leaves[0] == r.a and leaves[-1] == r.b and sum(1 << n["level"] for n in r.n) == r.b - r.a + 1
        assert len(r.n) <= 2 * (r.b - r.a + 1).bit_length()

"""Change tables that repeat a key, with rows that disagree."""

import json

from reelquery.operators import snapshots


def test_assets_fold_incoming_rows_in_order(spark):
    schema = (
        "asset_id long, file_id long, asset_type string, path string, start_s double, end_s double, "
        "frame_time_s double, scene_id string, content_hash string, text_content string, metadata_json string"
    )
    row = lambda i, kind, text, meta: (i, 1, kind, None, None, None, None, f"s{i}", f"h{i}", text, meta)
    existing = spark.createDataFrame([row(9, "caption", "old", '{"z":1}'), row(8, "image", "kept", None)], schema)
    incoming = spark.createDataFrame(
        [(*row(1, "chunk", "hello", '{"a":1,"n":{"x":[1,"2"]}}'), 1), (*row(2, "chunk", None, '{"b":"2","a":3}'), 2),
         (*row(3, "chunk", None, None), 3), (*row(4, "caption", None, '{"q\\"":true}'), 4)],
        f"{schema}, batch_order int",
    )
    got = {r.asset_type: r for r in snapshots.asset_upsert(existing, incoming).collect()}
    chunk = got["chunk"]
    assert (chunk.asset_id, chunk.text_content, chunk.scene_id, chunk.content_hash) == (1, "hello", "s3", "h3")
    assert json.loads(chunk.metadata_json) == {"a": 3, "b": "2", "n": {"x": [1, "2"]}}
    assert (got["caption"].asset_id, got["caption"].text_content) == (9, "old")
    assert json.loads(got["caption"].metadata_json) == {"z": 1, 'q"': True}
    assert got["image"].outcome == "kept" and got["image"].metadata_json is None


def test_one_row_per_key_stays(spark):
    refs = spark.createDataFrame([("c", 1, "stale")], "collection string, point_id long, status string")
    incoming = spark.createDataFrame(
        [("c", 1, "b", 2), ("c", 1, "a", 1), ("c", 2, "x", 1)], "collection string, point_id long, content_hash string, batch_order int"
    )
    got = {r.point_id: (r.content_hash, r.outcome) for r in snapshots.ref_upsert(refs, incoming).collect()}
    assert got == {1: ("a", "created"), 2: ("x", "created")}

    files = spark.createDataFrame([(1, "new")], "file_id long, index_status string")
    probes = spark.createDataFrame(
        [(1, '{"streams":[{"codec_type":"video","codec_name":"b"}]}', 2), (1, '{"streams":[]}', 1)],
        "file_id long, probe_json string, batch_order int",
    )
    assert [(r.codec, r.index_status) for r in snapshots.apply_probe_metadata(files, probes).collect()] == [("b", "probed")]


def test_embeddings_are_checked_and_come_out_as_points(spark):
    refs = spark.createDataFrame(
        [(i, i, 10, "c", i, "m", "v1", 2, "pending") for i in range(1, 6)],
        "ref_id long, asset_id long, file_id long, collection string, point_id long, model_name string, "
        "model_version string, vector_dim int, status string",
    )
    vectors = spark.createDataFrame(
        [(1, "m", "v1", [0.0, 0.0], 1), (1, "m", "v1", [0.6, 0.8], 2), (2, "m", "v1", [0.0, 0.0], 1),
         (3, "m", "v1", [3.0, 4.0], 1), (4, "m", "v1", [1.0], 1), (5, "m", "v0", [0.6, 0.8], 1)],
        "asset_id long, model_name string, model_version string, vector array<double>, batch_order int",
    )
    files = spark.createDataFrame([(10, "pending", False)], "file_id long, index_status string, is_deleted boolean")
    after = snapshots.apply_embeddings(refs, vectors, files)
    assert {r.ref_id: r.status for r in after["refs"].collect()} == {1: "indexed", 2: "pending", 3: "pending", 4: "pending", 5: "pending"}
    assert [(r.point_id, r.vector) for r in after["points"].collect()] == [(1, [0.6, 0.8])]
    assert {r.ref_id: r.problem for r in after["rejects"].collect()} == {2: "zero_norm", 3: "not_unit", 4: "dimension"}
    assert [r.index_status for r in after["files"].collect()] == ["indexed"]


def test_superseded_captions_go_stale(spark):
    gone = spark.createDataFrame([(1,), (1,)], "asset_id long")
    assets = spark.createDataFrame([(1, '{"a":1}'), (2, None)], "asset_id long, metadata_json string")
    refs = spark.createDataFrame([(1, "indexed"), (2, "indexed")], "asset_id long, status string")
    after = snapshots.mark_superseded(gone, assets, refs)
    assert {r.asset_id: r.status for r in after["refs"].collect()} == {1: "stale", 2: "indexed"}
    told = {r.asset_id: r.metadata_json for r in after["assets"].collect()}
    assert json.loads(told[1])["stale"] is True and json.loads(told[1])["a"] == 1 and told[2] is None

import random

import pytest
from pyspark.sql import functions as F

from reelquery.operators import temporal


def cuts(spark, rows):
    return spark.createDataFrame(rows, "file_id int, seq int, start_s double, end_s double")


def bounds(df):
    return [(r.file_id, r.start_s, r.end_s) for r in df.orderBy("file_id", "start_s").collect()]


@pytest.mark.parametrize("given, expected", [
    ([(0, .3), (.3, 4), (4, 12)], [(0, 4), (4, 12)]),
    ([(0, .2)], [(0, .2)]),
    ([(0, .2), (.2, .4), (.4, 5)], [(0, .4), (.4, 5)]),
    ([(0, 5), (5, 5.1), (5.1, 5.3), (5.3, 9)], [(0, 5.3), (5.3, 9)]),
    ([(0, 5), (4, 8), (8, 9)], [(0, 8), (8, 9)]),
    ([(3, 3), (3, 9)], [(3, 9)]),
])
@pytest.mark.parametrize("large", [False, True])
def test_merge_short_scenes(spark, given, expected, large):
    rows = [(1, i, float(a), float(b)) for i, (a, b) in enumerate(given)]
    assert bounds(temporal.merge_short_scenes(cuts(spark, rows), large=large)) == [
        (1, float(a), float(b)) for a, b in expected
    ]


def test_long_scene_is_split_and_sampled(spark):
    scenes = spark.createDataFrame([(1, 1, 0.0, 60.0), (2, 1, 0.0, 6.0), (3, 1, 0.0, 0.5)],
                                   "file_id int, scene_no long, start_s double, end_s double")
    windows = temporal.split_long_scenes(scenes)
    keys = [(r.file_id, r.scene_key) for r in windows.orderBy("file_id", "part").collect()]
    assert keys == [(1, "scene-0001-part-001"), (1, "scene-0001-part-002"), (2, "scene-0001"),
                    (3, "scene-0001")]
    frames = temporal.frames(windows)
    assert frames.filter("file_id = 1").count() == 24
    times = lambda f: [r.frame_time_s for r in frames.filter(f"file_id = {f}")
                       .orderBy("frame_index").collect()]
    assert times(2) == [1.25, 3.75, 5.5] and times(3) == [0.25]


def test_index_video_rejects_and_whole_file(spark):
    files = spark.createDataFrame(
        [(1, "l", 60.0, 0), (2, "l", None, 0), (3, "l", 5.0, 1), (4, "l", 7.0, 0)],
        "file_id int, library_id string, duration_seconds double, index_generation int",
    )
    given = cuts(spark, [(1, 0, 0.0, 60.0), (2, 0, 0.0, 4.0), (3, 0, 0.0, 9.0)])
    built = temporal.index_video(given, files)
    codes = {r.file_id: r.error_code for r in built["rejects"].collect()}
    assert codes == {2: "VIDEO_DURATION_MISSING", 3: "INVALID_SCENE_BOUNDARIES"}
    per_file = {r.file_id: r["count"] for r in built["assets"].groupBy("file_id").count().collect()}
    assert per_file == {1: 24, 4: 3}
    assert built["refs"].select("point_id").distinct().count() == 27


def loop_chunks(segments, low=15.0, high=30.0):
    live = [s for s in segments if s[1] > s[0] and s[2].strip()]
    out, current, start = [], [], None
    for i, (a, b, text) in enumerate(live):
        start = a if start is None else start
        current.append((b, text.strip()))
        last = i + 1 == len(live)
        if b - start >= low and (last or live[i + 1][1] - start > high):
            out.append((start, b, " ".join(t for _, t in current)))
            current, start = [], None
    if current:
        out.append((start, current[-1][0], " ".join(t for _, t in current)))
    return out


def segments(spark, per_file):
    rows = [(f, i, float(a), float(b), t) for f, items in per_file.items()
            for i, (a, b, t) in enumerate(items)]
    return spark.createDataFrame(
        rows, "file_id int, seq long, start_s double, end_s double, segment_text string"
    )


def chunks(df):
    found = {}
    for r in df.orderBy("file_id", "start_s").collect():
        found.setdefault(r.file_id, []).append((r.start_s, r.end_s, r.text_content))
    return found


def test_chunk_example(spark):
    given = {1: [(0, 7, "hello"), (7, 16, "world"), (16, 31, "next"), (31, 42, "tail")]}
    found = temporal.chunk_transcript(segments(spark, given))
    assert chunks(found) == {1: [(0.0, 16.0, "hello world"), (16.0, 42.0, "next tail")]}


@pytest.mark.parametrize("block, large", [(512, False), (3, False), (7, True)])
def test_blocked_chunks_equal_loop(spark, block, large):
    rng = random.Random(4)
    given = {}
    for file in range(6):
        at, items = 0.0, []
        for _ in range(rng.choice([1, 5, 40, 90])):
            length = rng.choice([0.0, 0.5, 2.0, 4.25, 9.0, 16.0, 33.0])
            items.append((at, at + length, rng.choice([" ", "a b", " word ", "x"])))
            at += length + rng.choice([0.0, 0.0, 1.5, 20.0])
        given[file] = items
    found = temporal.chunk_transcript(segments(spark, given), block=block, large=large)
    expected = {f: loop_chunks(items) for f, items in given.items()}
    assert chunks(found) == {f: c for f, c in expected.items() if c}


def test_rounds_grow_with_the_logarithm_of_blocks(spark, monkeypatch):
    """Segments of equal length never fall into step; a chunk of very many short ones spans whole blocks."""
    rounds = []
    stored = temporal.checkpointed
    monkeypatch.setattr(temporal, "checkpointed", lambda df: rounds.append(1) or stored(df))
    equal = [(5.0 * i, 5.0 * i + 5.0, f"w{i}") for i in range(400)]
    odd = [(7.0 * i, 7.0 * i + 7.0, "x") for i in range(95)]
    given = {1: equal, 2: odd, 3: [(0.0, 3.0, "a")]}
    found = temporal.chunk_transcript(segments(spark, given), block=8, large=False)
    assert chunks(found) == {f: loop_chunks(items) for f, items in given.items()}
    assert len(rounds) <= 3 + 2 * 6  # 50 blocks
    short = [(0.3 * i, 0.3 * i + 0.3, "s") for i in range(260)]
    assert chunks(temporal.chunk_transcript(segments(spark, {1: short}), block=16, large=False)) == {1: loop_chunks(short)}


def test_uniform_pick(spark):
    pick = lambda n, m: spark.range(1).select(
        temporal.uniform_pick(F.sequence(F.lit(1), F.lit(n)), m).alias("p")).first().p
    assert pick(12, 6) == [1, 3, 5, 8, 10, 12]
    assert pick(5, 6) == [1, 2, 3, 4, 5] and pick(4, 1) == [3] and pick(7, 2) == [1, 7]
    rows = spark.createDataFrame([("s", 1, float(i), i) for i in range(12)],
                                 "scene_id string, file_id int, frame_time_s double, asset_id int")
    numbered = rows.withColumn("frame_no", (F.col("asset_id") + 1).cast("bigint"))
    assert sorted(r.frame_no for r in temporal.pick_frames(numbered).collect()) == [1, 3, 5, 8, 10, 12]
    assert [r.frame_no for r in temporal.pick_frames(numbered, 1).collect()] == [7]


def test_refs_name_the_scene_of_their_asset(spark, monkeypatch):
    from reelquery.operators import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 4)
    files = spark.createDataFrame([(f, "l", 60.0, 0) for f in range(30)],
                                  "file_id int, library_id string, duration_seconds double, index_generation int")
    built = temporal.index_video(cuts(spark, [(f, i, 20.0 * i, 20.0 * i + 20) for f in range(25) for i in range(3)]), files)
    told = lambda name: sorted(map(tuple, built[name].select("asset_id", "file_id", "scene_id", "scene_key").collect()))
    assert told("refs") == told("assets") and len(told("refs")) == 30 * 24

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.functions import formatting, identifiers, media, scoring, vectors


def column(spark, values, kind, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[1] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_fmt_g_equals_percent_g(spark):
    rng = random.Random(7)
    values = [
        0.0, -0.0, 1.0, 1.25, 0.25, 100000.5, 1234565.0, 1.015625, 999999.5, 9999995.0, 1e-5,
        0.0001, 0.00012345678, 123456.0, 1e22, 1.5e300, 2.5e-300, 76367.05, 2.000005, 0.1234565,
        -3.75, float("inf"), float("-inf"), 16.0, 42.0,
    ]
    values += [rng.uniform(0, 10 ** rng.randint(-6, 9)) for _ in range(300)]
    values += [round(rng.uniform(0, 100000), rng.randint(0, 5)) for _ in range(300)]
    values += [rng.randint(1, 10**7) / 64 for _ in range(200)]
    assert column(spark, values, "double", formatting.fmt_g) == [f"{v:g}" for v in values]
    assert column(spark, [None], "double", formatting.fmt_g) == [None]


def test_uuid5_equals_library(spark):
    names = ["a|b|c", "", "视频|帧", "x" * 5000]
    space = uuid.UUID(C.POINT_NAMESPACE)
    assert column(spark, names, "string", identifiers.uuid5) == [
        str(uuid.uuid5(space, n)) for n in names
    ]


def test_fingerprints(spark):
    df = spark.range(1)
    strategy = identifiers.strategy_fingerprint(F.lit(27.0), F.lit(0.5), F.lit(30.0), F.lit(2.5))
    caption = identifiers.caption_fingerprint(
        F.array(F.lit("a1"), F.lit("a2")), F.array(F.lit(1.25), F.lit(None).cast("double")),
        F.lit("scene-caption-v2"), F.lit("v1"), F.lit("text"),
    )
    row = df.select(strategy.alias("s"), caption.alias("c")).first()
    text = "threshold=27|min_seconds=0.5|max_seconds=30|interval_seconds=2.5|layout=scene-frames-v3"
    assert row.s == hashlib.sha256(text.encode()).hexdigest()
    assert row.c == hashlib.sha256(b"a1|a2|1.25||scene-caption-v2|v1|text").hexdigest()


def test_media_types(spark):
    paths = ["clip.MP4", "photo.jpeg", "voice.wav", "notes.txt", "archive.zip", "a.b/none",
             "/x/.mp4", "/x/y.tar.webm"]
    assert column(spark, paths, "string", media.media_type_of) == [
        "video", "image", "audio", "document", None, None, None, "video"
    ]


def test_content_types(spark):
    given = column(spark, ["a.MOV", "b.heic", "noext"], "string",
                   lambda c: media.content_type_of(c, F.lit("image")))
    assert given == ["video/quicktime", "image/jpeg", "image/jpeg"]
    assert column(spark, ["b.bin"], "string", lambda c: media.content_type_of(c, F.lit("x"))) == [
        "application/octet-stream"
    ]


def test_relative_path_outside_root_fails(spark):
    assert column(spark, ["/r/a/b.mp4"], "string",
                  lambda c: media.relative_to(c, F.lit("/r"))) == ["a/b.mp4"]
    with pytest.raises(Exception, match="outside"):
        column(spark, ["/other/b.mp4"], "string", lambda c: media.relative_to(c, F.lit("/r")))


def test_time_and_clip_names(spark):
    assert column(spark, [0.0, 65.9, 3725.0], "double", formatting.playback_time) == [
        "0:00", "1:05", "1:02:05"
    ]
    name = lambda c: formatting.clip_name(F.lit("f1"), c, c + 2.5, F.lit("mp4"))
    assert column(spark, [1.5], "double", name) == ["f1-1_5-4.mp4"]


def test_zero_vector_has_no_direction(spark):
    with pytest.raises(Exception, match="zero vector"):
        column(spark, [[0.0, 0.0]], "array<double>", vectors.l2_normalize)
    assert column(spark, [[3.0, 4.0]], "array<double>", vectors.l2_normalize) == [[0.6, 0.8]]


def test_source_limit(spark):
    limit = lambda c: scoring.source_limit(c, F.lit(0))
    assert column(spark, [1, 20, 100, 500], "int", limit) == [30, 60, 300, 300]


def test_labels_fall_back(spark):
    show = lambda kind: lambda c: formatting.label(kind, c)
    assert column(spark, ["running", "odd"], "string", show("status")) == ["运行中", "odd"]
    assert column(spark, ["odd"], "string", show("media_type")) == ["未知"]


def test_fmt_g_near_ties_and_powers(spark):
    """Six digits of numbers of every size, those next to a tie or to a power of ten among them."""
    rng = random.Random(3)
    given = [0.0, -0.0, None, float("nan"), float("inf"), 1e-4, 9.9999999e-5, 999999.5, 999999.4999, 0.0001000005, 12.6953125]
    for p in range(-7, 9):
        for _ in range(40):
            given += [rng.uniform(1, 10) * 10**p, (rng.randrange(10**5, 10**6) + 0.5) * 10.0 ** (p - 5),
                      9.999995 * 10**p, 10.0**p * (1 - 1e-16), rng.randrange(1, 10**6) / 128]
    rows = spark.createDataFrame([(x,) for x in given], "x double").select("x", formatting.fmt_g(F.col("x")).alias("text")).collect()
    assert [r.text for r in rows] == [None if r.x is None else "%g" % r.x for r in rows]

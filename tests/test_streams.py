from pyspark.sql import functions as F

from reelquery.streaming import log_streams as streams

REFS = ("asset_id long, collection string, model_name string, model_version string, "
        "file_id long, updated_at timestamp")
JOBS = "job_type string, status string, created_at timestamp, input_json string"


def refs(spark, *rows):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    plain = [(a, "image_vectors", "m", "v", a * 10, day(d)) for a, d in rows]
    return spark.createDataFrame(plain, REFS.replace("timestamp", "string")).withColumn(
        "updated_at", F.col("updated_at").cast("timestamp"))


def test_restarted_dispatch_adds_nothing_twice(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("refs", "jobs", "progress"))
    payload = '{"asset_id":"3","collection":"image_vectors","model_name":"m","model_version":"v"}'
    log = spark.createDataFrame([("embed_image", "failed", "2024-01-05", payload)],
                                JOBS.replace("timestamp", "string")).withColumn(
        "created_at", F.col("created_at").cast("timestamp"))
    stamp = F.lit("2024-01-20").cast("timestamp")

    def run():
        stream = streams.file_stream(spark, source, files_per_trigger=1)
        streams.dispatch_jobs(stream, log, out, progress, as_of=stamp).awaitTermination()
        found = spark.read.option("recursiveFileLookup", "true").parquet(out)
        return sorted(r.asset_id for r in found.collect())

    # 3 was tried after its last change; 4 comes twice.
    refs(spark, (1, 2), (3, 4), (4, 2), (4, 3)).coalesce(1).write.parquet(source)
    assert run() == [1, 4]
    assert run() == [1, 4]
    # 1 again unchanged; 4 changed after it was dispatched; 5 is new.
    refs(spark, (1, 2), (4, 25), (5, 2)).coalesce(1).write.mode("append").parquet(source)
    assert run() == [1, 4, 4, 5]


def test_sessions_use_their_own_gap(spark, tmp_path):
    rows = [("w", "2024-01-01 00:00:00", 60), ("w", "2024-01-01 00:00:50", 60),
            ("w", "2024-01-01 00:02:00", 300), ("z", "2024-01-01 03:00:00", 60)]
    beats = spark.createDataFrame(rows, "worker string, ts string, gap int").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    beats.coalesce(1).write.parquet(str(tmp_path / "beats"))
    stream = streams.heartbeat_sessions(
        streams.file_stream(spark, str(tmp_path / "beats")), "worker", "ts", F.col("gap"),
        "1 minute")
    done = streams.run_available(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    found = [(str(r.started_at)[11:], str(r.ended_at)[11:], r.n_beats)
             for r in done.orderBy("started_at").collect()]
    assert found == [("00:00:00", "00:01:50", 2), ("00:02:00", "00:07:00", 1)]


def test_files_are_discovered_once(spark, tmp_path):
    root = tmp_path / "media"
    root.mkdir()
    (root / "a.mp4").write_bytes(b"1")

    def run():
        found = streams.discovered_files(spark, str(root), "lib")
        done = streams.run_available(found, str(tmp_path / "out"), str(tmp_path / "progress"))
        return sorted(r.relative_path for r in done.collect())

    assert run() == ["a.mp4"]
    (root / "b.wav").write_bytes(b"2")
    (root / "c.bin").write_bytes(b"3")
    assert run() == ["a.mp4", "b.wav"]

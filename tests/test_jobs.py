"""Duration percentiles from sketches kept between runs."""

import random

from pyspark.sql import functions as F

from reelquery.operators import jobs


def test_sketches_of_two_runs_merge_within_the_bound(spark):
    rng = random.Random(9)
    seconds = [round(rng.expovariate(0.01), 3) for _ in range(20_000)]
    rows = spark.createDataFrame(
        [("embed" if i % 3 else "index", f"2024-01-{1 + i % 9:02d} 00:00:00", s) for i, s in enumerate(seconds)] + [("index", None, 1.0)],
        "job_type string, created string, s double",
    )
    log = rows.select("job_type", F.col("created").cast("timestamp").alias("created_at"), F.timestamp_micros(
        F.unix_micros(F.col("created").cast("timestamp")) + (F.col("s") * 1_000_000).cast("bigint")).alias("finished_at"))
    first, second = log.filter(F.col("created_at") < "2024-01-05"), log.filter(F.col("created_at") >= "2024-01-05")
    kept = jobs.duration_sketches(first).unionByName(jobs.duration_sketches(second))
    days = jobs.merged_sketches(kept, "job_type", "day")
    found = {(r.job_type, r.share): (r.n, r.seconds) for r in jobs.duration_quantiles(days, (0.1, 0.5, 0.95)).collect()}
    for kind, wanted in (("embed", 1), ("index", 0)):
        mine = sorted(s for i, s in enumerate(seconds) if bool(i % 3) == bool(wanted))
        for share in (0.1, 0.5, 0.95):
            n, told = found[kind, share]
            rank = sum(s <= told for s in mine) / len(mine)
            assert n == len(mine) and abs(rank - share) <= jobs.SKETCH_ERROR + 1 / n
    assert jobs.duration_sketches(log.limit(0)).count() == 0

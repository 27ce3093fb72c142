import random

import pytest

from pyspark.sql import functions as F

from reelquery.operators.ordered import OrderedScan, paged_lists, top_per_group


def rows(seed, n=400):
    rng = random.Random(seed)
    # A third of all rows share one key; values can be missing.
    return [
        ("hot" if i % 3 == 0 else f"k{rng.randint(0, 20)}", i,
         float(rng.randint(1, 9)) if rng.random() > 0.1 else None)
        for i in range(n)
    ]


def test_sliced_scan_equals_window_scan(spark):
    df = spark.createDataFrame(rows(3), "k string, seq int, v double")
    scan = OrderedScan(
        ["k"], ["seq"], number="n", sums={"s": F.col("v")}, maxima={"m": F.col("v")},
        previous={"p": F.col("v")}, following={"f": F.col("v")},
    )
    columns = ["k", "seq", "v", "n", "s", "m", "p", "f"]
    plain = sorted(map(tuple, scan.run(df, large=False).select(*columns).collect()), key=str)
    sliced = sorted(map(tuple, scan.run(df, large=True).select(*columns).collect()), key=str)
    assert plain == sliced


@pytest.mark.parametrize("slices", ["2", "5", "16"])
def test_sums_of_fractions_do_not_depend_on_slices(spark, slices):
    df = spark.range(2000).selectExpr("'k' AS k", "id AS seq", "0.1D AS d", "CAST(id % 7 AS DOUBLE) / 10 AS e")
    scan = OrderedScan(["k"], ["seq"], sums={"s": F.col("d"), "t": F.col("e")})
    plain = scan.run(df, large=False).orderBy("seq").collect()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        assert scan.run(df, large=True).select(*df.columns, "s", "t").orderBy("seq").collect() == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r.s for r in plain[:3]] == [0.1, 0.2, 0.3] and plain[-1].s == 200.0


def test_large_groups_are_noticed(spark, monkeypatch):
    from reelquery.operators import ordered

    df = spark.createDataFrame(rows(5), "k string, seq int, v double")
    monkeypatch.setattr(ordered, "MAX_GROUP_ROWS", 50)
    assert ordered.has_large_groups(df, ["k"])
    numbers = ordered.numbered(df, ["k"], ["seq"], "n").filter("k = 'hot'").orderBy("seq")
    assert [r.n for r in numbers.collect()] == list(range(1, 135))


def test_salted_top_equals_plain_top(spark):
    df = spark.createDataFrame(rows(9), "k string, seq int, v double").repartition(7)
    order = [F.desc_nulls_last("v"), F.asc("seq")]
    plain = top_per_group(df, ["k"], order, 5, "r")
    salted = top_per_group(df, ["k"], order, 5, "r", salts=4)
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))


def test_pages_hold_everything_in_order(spark):
    df = spark.createDataFrame(rows(2), "k string, seq int, v double")
    pages = paged_lists(df, ["k"], ["seq"], ["seq", "v"], "x", size=25).filter("k = 'hot'")
    found = pages.orderBy("page").collect()
    assert [len(p["items"]) for p in found] == [25, 25, 25, 25, 25, 9]
    assert [int(i["id"]) for p in found for i in p["items"]] == list(range(0, 400, 3))


def test_rows_are_dealt_so_that_a_task_holds_few(spark, monkeypatch):
    """More rows make more parts, not larger ones, and the windows on the keys stay in them."""
    from reelquery.operators import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 50)
    df = spark.range(3000).select((F.col("id") % 700).alias("k"), F.col("id").alias("o"))
    scanned = ordered.OrderedScan(["k"], ["o"], number="n").run(df)
    parts = [r[0] for r in scanned.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1))).select("count(1)").collect()]
    assert sum(parts) == 3000 and max(parts) < 150
    assert scanned.filter("n <> floor(o / 700) + 1").isEmpty()

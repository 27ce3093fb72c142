"""Ordered work inside groups that may be very large.

A plain window holds a whole group in one task. These helpers look at the largest group first:
groups of a checked size use a window; beyond that the rows are range-partitioned on (keys, order)
so one group spans many slices, each slice is scanned on its own and the per-slice totals are
carried over. A window holds its rows sorted, so beyond what the cores take in shares of ``ROWS_PER_TASK`` rows are
dealt into as many parts as they need: the memory of a task does not grow with the table. Fractions are summed as decimals of ``SUM_DECIMALS`` places, which is exact however
the rows are sliced, so the plan never shows in the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelquery.session import checkpointed

MAX_GROUP_ROWS = 1_000_000
ROWS_PER_TASK = 250_000
SUM_DECIMALS = 9


def spread(df: DataFrame) -> DataFrame:
    """Use every core for work that is heavy per row.

    Only an input of fewer partitions than cores (one small file) is spread; a large table keeps
    its partitions and pays no exchange. Meant for scans: asking a plan with exchanges for its
    partitions would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows in the largest group and in all (map-side combined count of the key columns only)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most, rows = counts.agg(F.max("_n"), F.sum("_n")).first()
    return most or 0, rows or 0


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    return group_sizes(df, keys)[0]


def has_large_groups(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    return largest_group(df, keys) > (MAX_GROUP_ROWS if limit is None else limit)


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` of ``rows`` rows by hash of ``keys``, ``ROWS_PER_TASK`` rows a part; few rows stay as they are.

    Windows, groupings and joins on the keys that follow stay in these parts, which Spark does not put together.
    """
    if rows <= ROWS_PER_TASK * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(-(-rows // ROWS_PER_TASK), *keys)


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None,
    salts: int = 0,
) -> DataFrame:
    """First ``k`` rows per group. ``k`` is a literal, so Spark limits rows before the shuffle.

    ``salts`` adds a level for few groups over very many input partitions: each salt keeps its own
    first ``k``, then the survivors are ranked.
    """
    if salts > 1:
        salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        within = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_rank", F.row_number().over(within))
            .filter(F.col("_rank") <= k)
            .drop("_salt", "_rank")
        )
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return kept.withColumn(name, F.col(name).cast("bigint")) if rank else kept.drop(name)


def measured(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, bool, int]:
    """``df`` dealt for windows over ``keys``, whether a group is too large for one, and the number of rows."""
    most, rows = group_sizes(df, keys)
    large = most > MAX_GROUP_ROWS
    return (df if large else dealt(df, keys, rows)), large, rows


@dataclass
class OrderedScan:
    """What to compute along the order of each group.

    ``number``    name of the 1-based row number
    ``sums``      output name -> column summed up to and including the row (exact, see above; a fraction that
                  is NaN, infinite or of more than 20 digits before the point does not count, and steps
                  below 1e-9 are rounded away)
    ``maxima``    output name -> largest value up to and including the row
    ``previous``  output name -> value of the row before
    ``following`` output name -> value of the row after
    """

    keys: Sequence[str]
    order: Sequence[str]
    number: str | None = None
    sums: dict[str, Column] = field(default_factory=dict)
    maxima: dict[str, Column] = field(default_factory=dict)
    previous: dict[str, Column] = field(default_factory=dict)
    following: dict[str, Column] = field(default_factory=dict)

    def run(self, df: DataFrame, large: bool | None = None) -> DataFrame:
        """``large`` tells a size already checked; None checks it here."""
        if large is None:
            df, large, _ = measured(df, self.keys)
        sums = df.select([c.alias(name) for name, c in self.sums.items()]).schema
        fractions = [f.name for f in sums if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        exact = T.DecimalType(38 - SUM_DECIMALS - 1, SUM_DECIMALS)
        whole = replace(self, sums={
            name: c.try_cast(exact) if name in fractions else c for name, c in self.sums.items()
        })
        done = whole._sliced(df) if large else whole._windowed(df, list(self.keys))
        return done.withColumns({name: F.col(name).cast("double") for name in fractions})

    def _windowed(self, df: DataFrame, keys: list[str]) -> DataFrame:
        ordered = Window.partitionBy(*keys).orderBy(*self.order)
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added = {}
        if self.number:
            added[self.number] = F.row_number().over(ordered).cast("bigint")
        added |= {name: F.sum(c).over(upto) for name, c in self.sums.items()}
        added |= {name: F.max(c).over(upto) for name, c in self.maxima.items()}
        added |= {name: F.lag(c).over(ordered) for name, c in self.previous.items()}
        added |= {name: F.lead(c).over(ordered) for name, c in self.following.items()}
        return df.withColumns(added)

    def _sliced(self, df: DataFrame) -> DataFrame:
        keys, columns = list(self.keys), df.columns
        slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # The slice number is stored with the rows: range boundaries come from a sample, so a
        # recomputed slice could differ from the one its totals were taken from.
        staged = checkpointed(
            df.repartitionByRange(slices, *keys, *self.order).withColumn(
                "_slice", F.spark_partition_id()
            )
        )
        local = OrderedScan(
            [*keys, "_slice"], self.order, "_rn", self.sums, self.maxima, self.previous,
            self.following,
        )._windowed(staged, [*keys, "_slice"])

        totals = [F.max("_rn").alias("_t_rn")]
        for i, name in enumerate(self.sums):
            totals.append(F.max_by(name, "_rn").alias(f"_t_s{i}"))
        for i, name in enumerate(self.maxima):
            totals.append(F.max_by(name, "_rn").alias(f"_t_m{i}"))
        for i, c in enumerate(self.previous.values()):
            totals.append(F.max_by(F.struct(c.alias("v")), "_rn").alias(f"_t_p{i}"))
        for i, c in enumerate(self.following.values()):
            totals.append(F.min_by(F.struct(c.alias("v")), "_rn").alias(f"_t_f{i}"))
        per_slice = local.groupBy(*keys, "_slice").agg(*totals)

        # At most one row per slice and group: small enough for a window over the group.
        across = Window.partitionBy(*keys).orderBy("_slice")
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        carried = {"_c_rn": F.sum("_t_rn").over(before)}
        carried |= {f"_c_s{i}": F.sum(f"_t_s{i}").over(before) for i in range(len(self.sums))}
        carried |= {f"_c_m{i}": F.max(f"_t_m{i}").over(before) for i in range(len(self.maxima))}
        carried |= {f"_c_p{i}": F.lag(f"_t_p{i}").over(across) for i in range(len(self.previous))}
        carried |= {f"_c_f{i}": F.lead(f"_t_f{i}").over(across) for i in range(len(self.following))}
        offsets = per_slice.withColumns(carried).select(
            *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_k_slice"),
            F.col("_t_rn").alias("_rows"), *carried,
        )

        same = F.col("_slice") == F.col("_k_slice")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        joined = local.join(offsets, same, "left")
        first, last = F.col("_rn") == 1, F.col("_rn") == F.col("_rows")
        result = {}
        if self.number:
            result[self.number] = (
                F.col("_rn") + F.coalesce(F.col("_c_rn"), F.lit(0))
            ).cast("bigint")
        for i, name in enumerate(self.sums):
            result[name] = F.when(
                F.col(f"_c_s{i}").isNull(), F.col(name)
            ).otherwise(F.coalesce(F.col(name), F.lit(0)) + F.col(f"_c_s{i}"))
        for i, name in enumerate(self.maxima):
            result[name] = F.greatest(name, f"_c_m{i}")
        for i, name in enumerate(self.previous):
            result[name] = F.when(first, F.col(f"_c_p{i}.v")).otherwise(F.col(name))
        for i, name in enumerate(self.following):
            result[name] = F.when(last, F.col(f"_c_f{i}.v")).otherwise(F.col(name))
        return joined.select(
            *[F.col(c) for c in columns if c not in result],
            *[c.alias(name) for name, c in result.items()],
        )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1-based position of every row in its group."""
    return OrderedScan(keys, order, number=name).run(df)


PAGE_ITEMS = 1000


def paged_lists(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], item: Sequence[str], kind: str,
    size: int | None = None,
) -> DataFrame:
    """Ordered lists per group in pages of a fixed size: (keys, kind, page, items).

    ``item`` names an id and a text; both come out as text.
    """
    place = numbered(df, keys, order, "_n")
    per_page = size or PAGE_ITEMS
    key, text = item
    entry = F.struct(
        F.col("_n").alias("n"), F.col(key).cast("string").alias("id"),
        F.col(text).cast("string").alias("value"),
    )
    paged = place.withColumn("page", F.floor((F.col("_n") - 1) / per_page))
    return paged.groupBy(*keys, "page").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e.dropFields("n")).alias("items")
    ).withColumn("kind", F.lit(kind))

"""Typed reads and idempotent writes of the fact tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelquery import schemas


def _with_partitions(name: str) -> T.StructType:
    schema = schemas.TABLES[name]
    extra = [p for p in schemas.PARTITIONS.get(name, []) if p not in schema.names]
    return T.StructType([*schema.fields, *[T.StructField(p, T.DateType()) for p in extra]])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(_with_partitions(name)).parquet(f"{root}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of the declared schema, cast; a column the frame lacks is NULL."""
    have = set(df.columns)
    columns = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.TABLES[name].fields
    ]
    out = df.select(*columns)
    if "created_date" in schemas.PARTITIONS.get(name, []):
        out = out.withColumn("created_date", F.to_date("created_at"))
    return out


def write_table(df: DataFrame, root: str, name: str, files_per_partition: int | None = None) -> None:
    """Replace the partitions present in ``df`` and leave the others.

    Rows are spread by a hash of all columns within each partition value, so one big partition is
    written by many tasks.
    """
    out = conform(df, name)
    partitions = schemas.PARTITIONS.get(name, [])
    writer = out
    if partitions and files_per_partition:
        spread = F.pmod(F.xxhash64(*out.columns), F.lit(files_per_partition))
        writer = out.withColumn("_f", spread).repartition(*partitions, "_f").drop("_f")
    save = writer.write.mode("overwrite")
    if partitions:
        save = save.partitionBy(*partitions).option("partitionOverwriteMode", "dynamic")
    save.parquet(f"{root}/{name}")


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None):
    """Catalogue table bucketed and sorted by ``key``, so joins on it need no exchange."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)

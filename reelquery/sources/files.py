"""File listings as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelquery.functions.media import media_type_of

_SCHEME = r"^[a-z0-9]+:/+"

BINARY_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def _listing(raw: DataFrame, root: str, library_id: str) -> DataFrame:
    """Known media files of a listing; ``content`` is not selected, so no file is opened."""
    plain = F.regexp_replace("path", _SCHEME, "/")
    base = re.sub(_SCHEME, "/", root).rstrip("/")
    listed = raw.select(
        F.lit(library_id).alias("library_id"), plain.alias("path"),
        F.col("length").alias("size_bytes"),
        F.floor(F.unix_micros("modificationTime") / 1000).alias("mtime_ms"),
    )
    return listed.withColumns(
        {
            "relative_path": F.expr(f"substring(path, {len(base) + 2})"),
            "media_type": media_type_of(F.col("path")),
        }
    ).filter(F.col("media_type").isNotNull())


def scan_files(spark: SparkSession, root: str, library_id: str) -> DataFrame:
    """Recursive listing of a root, files of a known extension only."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    )
    return _listing(raw, root, library_id)


def scan_files_stream(spark: SparkSession, root: str, library_id: str) -> DataFrame:
    """The same listing as a stream of files not seen before."""
    raw = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    return _listing(raw, root, library_id).withColumn(
        "modified_at", F.timestamp_millis("mtime_ms")
    )

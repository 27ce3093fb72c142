"""Helpers shared by the operators: table reads, column access, fixed word and letter rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the operators' word rule, and upper and lower case of A-Z.
SPACE_CLASS = "\\x20\\x09-\\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Upper-case letters up to the Cyrillic and Armenian blocks that have one lower-case letter.
_CASED = [chr(c) for c in range(0x41, 0x560) if chr(c).lower() != chr(c) and len(chr(c).lower()) == 1]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty) of a documents table, whatever else it carries."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def ascii_lower(text):
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def crc_class(classes: int):
    """crc32 of the decimal ``doc_id``, modulo ``classes``: the fold of a document."""
    return F.crc32(F.col("doc_id").cast("string")) % classes


def letters_lower(text):
    """Lower-case Latin, Greek, Cyrillic and Armenian letters one by one (much cheaper than ``lower``)."""
    return F.translate(text, "".join(_CASED), "".join(_CASED).lower())


#: Parts a group is dealt into before its sample is cut, so no task sorts a whole group.
SAMPLE_PARTS = 32


def sample_by_hash(rows: DataFrame, group: str, mark: str, size) -> DataFrame:
    """At most ``size`` rows of each group: those with the smallest ``mark`` (a hash, ties as they come).

    Each of a group's parts is cut first, so at most ``SAMPLE_PARTS`` times ``size`` rows of it meet.
    """
    part = F.pmod(F.xxhash64(mark), F.lit(SAMPLE_PARTS))
    narrow = Window.partitionBy(group, "part").orderBy(mark)
    first = rows.withColumn("part", part).withColumn("place", F.row_number().over(narrow)).where(F.col("place") <= size)
    whole = Window.partitionBy(group).orderBy(mark)
    return first.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= size).drop("part")

"""Vector arithmetic on array columns (double precision)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(as_double(left), as_double(right), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector has no direction and raises."""
    length = norm(vector)
    checked = F.when(length > 0, length).otherwise(
        F.raise_error(F.lit("cannot normalise a zero vector")).cast("double")
    )
    return F.transform(as_double(vector), lambda x: x / checked)

"""Vector expressions over array<float|double> columns (JVM higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(a: Column) -> Column:
    """Unit vector as array<double>; null for null or all-zero vectors."""
    n = norm(a)
    return F.when(a.isNull() | (n == 0), F.lit(None)) \
        .otherwise(F.transform(a, lambda x: x.cast("double") / n))

"""Vectors as array<double> columns; all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(*columns: str | Column) -> Column:
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

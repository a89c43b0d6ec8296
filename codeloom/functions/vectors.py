"""Distances between vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two dense vectors, computed in double."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda total, value: total + value)


def similarity(distance: Column, threshold: float) -> Column:
    return F.lit(threshold) - distance

"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v over its length, 1e-8 added to it."""
    n = F.sqrt(dot(v, v)) + 1e-8
    return F.transform(v, lambda x: x / n)

"""Ratios and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.ranking import running


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b rounded, null where b is 0 or null."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def share(flag: Column, digits: int = 6) -> Column:
    """Share of rows with the flag; null over no rows."""
    return F.round(F.avg(flag.cast("double")), digits)


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float], digits: int = 6) -> DataFrame:
    """by and one column for each share: the exact percentile of `value` with linear interpolation, null where a group has no value.

    Values are counted first; the counts of each group, in order of value, are summed over ranges of values (see running), so
    that no task holds the values of a group, however large it is.
    """
    counted = rows.groupBy(F.col(by).alias("g"), F.col(value).alias("v")).agg(F.count(value).alias("n"))
    total = counted.groupBy(F.col("g").alias("h")).agg(F.sum("n").alias("total"))
    placed = running(counted.where("v is not null"), "g", "v", "n").join(total, F.col("g").eqNullSafe(F.col("h")), "right")
    pick = lambda k: F.max(F.when((F.col("up_to") - F.col("n") <= k) & (k < F.col("up_to")), F.col("v")))

    def percentile(p: float, name: str) -> Column:
        place = (F.col("total") - 1) * p
        low, high, part = pick(F.floor(place)), pick(F.ceil(place)), F.max(place - F.floor(place))
        return F.round(low * (1 - part) + high * part, digits).alias(name)

    return placed.groupBy(F.col("h").alias(by)).agg(*[percentile(p, name) for name, p in shares.items()])

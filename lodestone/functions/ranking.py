"""Running sums over a whole order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.plans.scratch import cut


def running(rows: DataFrame, by: str, order: str, n: str) -> DataFrame:
    """rows with up_to: the sum of n over the rows of the same `by` that come up to and with this one in `order`.

    Rows are dealt by ranges of (by, order) and written; each range sums its own, and the sums of the ranges before it, a row
    for each range and group in it, are added. Pairs of by and order must not repeat. Runs a job while the plan is built.
    """
    dealt = cut(rows.repartitionByRange(F.col(by), F.col(order)).withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy("range", by).agg(F.sum(n).alias("own"))
    before = F.sum("own").over(W.partitionBy(by).orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(F.col("range").alias("r"), F.col(by).alias("b"), F.coalesce(before, F.lit(0)).alias("before"))
    own = dealt.withColumn("inner", F.sum(n).over(W.partitionBy("range", by).orderBy(order)))
    out = own.join(sums, (F.col("range") == F.col("r")) & F.col(by).eqNullSafe(F.col("b")))
    return out.select(*rows.columns, (F.col("inner") + F.col("before")).alias("up_to"))

"""Strips of recommendations: shown and logged, and what checkouts take of them kept up batch by batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.numeric import ratio
from lodestone.operators.analytics import first_bought, strip_orders, strip_rows
from lodestone.operators.customers import recommend
from lodestone.plans import versions
from lodestone.plans.scratch import cut, fresh
from lodestone.plans.views import event_log, parts
from lodestone.registry import SQL, query
from lodestone.streaming.kept import SEGMENTS, append_log, read_log


def keep_strips(batch: DataFrame, number: int, path: str) -> bool:
    """Takes one micro-batch of shown strips and checkouts (rows as in `strip_orders`) into what is kept at a path; whether it changed anything.

    Kept are the strip of each client that no checkout has used up, when a client first bought a part, and the counts. What a batch
    wrote is put in use in one step with its number, so a batch that comes again changes nothing. The first purchases
    are written for the batch's own only; every SEGMENTS batches they are merged. A row that is earlier than its client's kept strip
    counts by its own time: a checkout before the strip doesn't use it up, and the strip that it could have used is gone.
    """
    spark = batch.sparkSession
    after, facts = versions.current(spark, path)
    if number <= facts.get("batch", -1):
        return False
    columns = ("user_id", "ts", "event_id", "kind", "parts")
    own = cut(batch.where("user_id is not null and kind in ('shown', 'checkout')").select(*columns))
    rows, others, had = own, None, None
    if facts:
        old, clients = spark.read.schema(own.schema).parquet(facts["strips"]), own.select("user_id").distinct()
        rows, others = own.unionByName(old.join(clients, "user_id", "left_semi")), old.join(clients, "user_id", "left_anti")
        had = reduce(DataFrame.unionByName, [spark.read.parquet(s) for s in facts["bought"]])
    done = strip_orders(rows, had if had is None else had.join(own.select("user_id").distinct(), "user_id", "left_semi"))
    n, took, new = done.agg(F.count("*"), F.count_if("took"), F.count_if("new")).first()
    at = F.struct("ts", "event_id")
    latest = lambda kind: F.max(F.when(F.col("kind") == kind, at))
    left = rows.groupBy("user_id").agg(F.max_by(F.struct(*columns[1:]), F.when(F.col("kind") == "shown", at)).alias("strip"), latest("shown").alias("shown"), latest("checkout").alias("used"))
    left = left.where("shown is not null and (used is null or used < shown)").select("user_id", "strip.*")
    strips, bought = versions.new_folder(path), versions.new_folder(path)
    (left if others is None else left.unionByName(others)).write.parquet(strips)
    fresh_ones = first_bought(own.withColumn("at", at))
    segments = [*facts.get("bought", []), bought]
    if len(segments) > SEGMENTS:
        fresh_ones, segments = first_bought(own.withColumn("at", at), had), [bought]
    fresh_ones.write.parquet(bought)
    counts = {k: facts.get(k, 0) + v for k, v in (("n", n), ("took", took), ("new", new))}
    versions.publish(spark, path, after, {"batch": number, "strips": strips, "bought": segments, **counts})
    return True


def kept_takes(spark: SparkSession, path: str) -> DataFrame:
    """(orders_after_strip, take, new_take) of all batches so far, as `strip_takes` gives for their rows."""
    facts = versions.current(spark, path)[1]
    counts = spark.range(1).select(*[F.lit(facts.get(k, 0)).cast("bigint").alias(k) for k in ("n", "took", "new")])
    return counts.select(F.col("n").alias("orders_after_strip"), ratio(F.col("took"), F.col("n")).alias("take"), ratio(F.col("new"), F.col("n")).alias("new_take"))


def strip_stream(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream of strips and checkouts over what is there into what is kept at a path."""

    def put(batch: DataFrame, number: int) -> None:
        keep_strips(batch, number, path)

    rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@query(SQL["strip_sets"])
def strip_sets_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often checkouts take a part of the strip shown before, kept up over six stretches of time, of which two come twice."""
    path, rows = fresh(spark), cut(strip_rows(event_log(spark, sf_dir)))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.min(us), F.max(us)).first()
    sixth = F.floor((us - F.lit(low)) * 6 / F.lit((high or 0) - (low or 0) + 1))
    for number in (0, 1, 1, 2, 3, 4, 3, 5):
        keep_strips(rows.where(sixth == number), number, path)
    return kept_takes(spark, path)


@query(f"""WITH r AS ({SQL["recommend"]}), p AS (SELECT p_name AS family, min(p_partkey) AS part, arg_min(p_type || ' > ' || p_brand, p_partkey) AS category FROM part GROUP BY 1)
 SELECT client, 'recommend_shown' AS kind, count(*) AS n, string_agg(part, ',' ORDER BY place) AS parts, string_agg(category, ';' ORDER BY place) AS categories FROM r JOIN p USING (family) GROUP BY client""")
def shown_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strip of each client as it goes to the log and is read from there: of each recommended family its first part with its category, in
    order of place. Families that the catalog lacks are left out. A strip has six places, so it fits a row."""
    path = fresh(spark)
    one = parts(spark, sf_dir).groupBy("family").agg(F.min_by(F.struct(F.col("part").cast("string").alias("part"), F.array_join(F.slice("path", 1, 2), " > ").alias("category")), "part").alias("x"))
    strip = F.array_sort(F.collect_list(F.struct("place", "x.part", "x.category")))
    shown = recommend(spark, sf_dir).join(one, "family").groupBy("client").agg(strip.alias("s"))
    listed = lambda k, by: F.array_join(F.transform("s", lambda e: e[k]), by)
    append_log(shown.select("client", F.lit("recommend_shown").alias("kind"), F.size("s").cast("bigint").alias("n"), listed("part", ",").alias("parts"), listed("category", ";").alias("categories")), path)
    return read_log(spark, path)

"""Tables that streams and logs keep up: upserts whose replay changes nothing, and a log compacted to the newest of each class."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.plans import versions
from lodestone.plans.scratch import fresh
from lodestone.plans.views import SQL_EVENTS, event_log, order_lines, table
from lodestone.registry import query
from lodestone.streaming.events import event_stream

#: Journey rows that the log report keeps, and chatty ones; segments beyond which a merge writes one of all.
KEEP, CHATTY, SEGMENTS = 2000, 500, 4


def _segment(rows: DataFrame, path: str, folder: str) -> str:
    rows.write.parquet(folder)
    return folder


def merge_batch(batch: DataFrame, number: int, path: str, keys: list[str], order: list[str] | None = None, sums: list[str] | None = None) -> bool:
    """Puts one micro-batch into the kept table at a path; whether it changed anything.

    With `order`, of the rows of a key the one that arrived last stays: the later batch, within one the greatest `order`. With `sums`,
    these columns are added up by key. The batch's number is published with its rows in one step, so a batch that is
    replayed after a crash, or comes again, changes nothing. A batch writes only its own keys; every SEGMENTS batches are
    merged into one.
    """
    spark = batch.sparkSession
    after, facts = versions.current(spark, path)
    if number <= facts.get("batch", -1):
        return False
    facts = facts or {"segments": [], "keys": keys, "order": order, "sums": sums}
    rest = [c for c in batch.columns if c not in keys]
    if sums:
        own = batch.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    else:
        at = F.struct(F.lit(number).cast("long").alias("__batch"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(order)])
        own = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("row"), F.max(at).alias("arrived")).select(*keys, "row.*", "arrived")
    segments = [*facts["segments"], _segment(own, path, versions.new_folder(path))]
    if len(segments) > SEGMENTS:
        segments = [_segment(_folded(spark, facts | {"segments": segments}, drop=False), path, versions.new_folder(path))]
    versions.publish(spark, path, after, facts | {"segments": segments, "batch": number})
    return True


def _folded(spark: SparkSession, facts: dict, drop: bool = True) -> DataFrame:
    every = reduce(DataFrame.unionByName, [spark.read.parquet(s) for s in facts["segments"]])
    keys = facts["keys"]
    if facts["sums"]:
        return every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in facts["sums"]])
    rest = [c for c in every.columns if c not in (*keys, "arrived")]
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "arrived").alias("row"), F.max("arrived").alias("arrived"))
    return last.select(*keys, "row.*", *([] if drop else ["arrived"]))


def kept_table(spark: SparkSession, path: str) -> DataFrame:
    """What the batches so far make of the table, in the version now in use: a row a key."""
    return _folded(spark, versions.current(spark, path)[1])


def keep_up(stream: DataFrame, path: str, checkpoint: str, keys: list[str], **how) -> None:
    """Runs a stream over what is there, merging each micro-batch into the kept table."""
    put = lambda batch, number: merge_batch(batch, number, path, keys, **how)
    stream.writeStream.foreachBatch(lambda batch, number: None if put(batch, number) else None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_log(rows: DataFrame, path: str) -> None:
    """Appends rows to a log without reading it. Where another writer publishes at the same time it publishes after it; no rows are lost."""
    segment = _segment(rows, path, versions.new_folder(path))
    _publish(rows.sparkSession, path, lambda segments: [*segments, segment])


def _publish(spark: SparkSession, path: str, change: Callable[[list[str]], list[str]], tries: int = 20) -> None:
    for left in reversed(range(tries)):
        after, facts = versions.current(spark, path)
        try:
            versions.publish(spark, path, after, facts | {"segments": change(facts.get("segments", []))})
            return
        except versions.Conflict:
            if not left:
                raise


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a log that are in use."""
    return reduce(DataFrame.unionByName, [spark.read.parquet(s) for s in versions.current(spark, path)[1]["segments"]])


def newest(rows: DataFrame, by: str, keep: dict[str, int], at: list[str], slot: str = "hour") -> DataFrame:
    """The newest rows of each class of `by`, as many as `keep` says; classes it doesn't name go.

    Rows are counted by class and hour, newest first: hours before the one in which a class is full go whole, later ones stay whole,
    and only rows of that hour are put in order. So no task sorts a class. at: the time, then what orders rows of one time.
    """
    limits = F.create_map(*[F.lit(x) for pair in keep.items() for x in pair])
    own = rows.withColumn("__slot", F.date_trunc(slot, F.col(at[0]).cast("timestamp"))).withColumn("__most", limits[F.col(by)]).where("__most is not null")
    later = F.sum("n").over(W.partitionBy("c").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, -1))
    counted = own.groupBy(F.col(by).alias("c"), F.col("__slot").alias("s"), F.col("__most").alias("m")).agg(F.count("*").alias("n")).withColumn("later", F.coalesce(later, F.lit(0))).where("later < m")
    met = own.join(counted, (F.col(by) == F.col("c")) & F.col("__slot").eqNullSafe(F.col("s")))
    whole = met.where("later + n <= m")
    edge = met.where("later + n > m").withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(*[F.desc(c) for c in at]))).where("later + __r <= m")
    return whole.select(*rows.columns).unionByName(edge.select(*rows.columns))


def compact_log(spark: SparkSession, path: str, by: str, keep: dict[str, int], at: list[str]) -> None:
    """Rewrites a log to the newest rows of each class and puts that in use in one step. Rows that others append meanwhile stay."""
    old = versions.current(spark, path)[1]["segments"]
    segment = _segment(newest(read_log(spark, path), by, keep, at), path, versions.new_folder(path))
    _publish(spark, path, lambda segments: [segment, *segments[len(old) :]] if segments[: len(old)] == old else segments)


@query("""SELECT user_id || ':' || json_extract_string(props, '$.k') AS request_id, event_id, value, event_type FROM events WHERE event_type IN ('signup', 'error')
 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY event_id DESC) = 1""")
def upserted_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last feedback of each request in order of arrival, merged from a stream of which one batch comes twice."""
    base = fresh(spark)
    request = F.concat_ws(":", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("request_id")
    rows = lambda e: e.where("event_type in ('signup', 'error')").select(request, "event_id", "value", "event_type")
    keep_up(rows(event_stream(spark, sf_dir)), f"{base}/kept", f"{base}/checkpoint", ["request_id"], order=["event_id"])
    merge_batch(rows(table(spark, sf_dir, "events")).withColumn("value", F.lit(-1.0)), 0, f"{base}/kept", ["request_id"], order=["event_id"])  # a replay, which counts for nothing
    return kept_table(spark, f"{base}/kept")


@query("""SELECT o_custkey AS client, p_type AS kind, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS pieces FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def refreshed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and pieces of each client and type, refreshed batch by batch as orders come, out of order and some twice."""
    path, lines = fresh(spark), order_lines(spark, sf_dir).select("order_id", "client", "kind", F.lit(1).cast("long").alias("lines"), F.col("quantity").alias("pieces"))
    for number in (0, 1, 1, 2, 0, 3, 4, 5, 5):
        merge_batch(lines.where(F.pmod(F.col("order_id"), F.lit(6)) == 5 - number), number, path, ["client", "kind"], sums=["lines", "pieces"])
    return kept_table(spark, path)


@query(f"""WITH {SQL_EVENTS} SELECT event_id, event_type FROM (SELECT *, CASE WHEN event_type = 'click' THEN 'chatty' ELSE 'journey' END AS class FROM log) x
 QUALIFY row_number() OVER (PARTITION BY class ORDER BY ts DESC, event_id DESC) <= CASE class WHEN 'chatty' THEN {CHATTY} ELSE {KEEP} END""")
def compacted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log appended in three steps, compacted after the second and at the end."""
    path, keep = fresh(spark), {"journey": KEEP, "chatty": CHATTY}
    log = event_log(spark, sf_dir).withColumn("class", F.when(F.col("event_type") == "click", "chatty").otherwise("journey"))
    for i in range(3):
        append_log(log.where(F.col("event_id") % 3 == i), path)
        if i:
            compact_log(spark, path, "class", keep, ["ts", "event_id"])
    return read_log(spark, path).select("event_id", "event_type")

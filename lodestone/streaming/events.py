"""Structured Streaming over the event log: daily windows with a watermark, and keyed carts. Each has a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.plans.scratch import fresh
from lodestone.registry import query

#: Most lines of a cart and most pieces of a line.
CART_LINES, LINE_PIECES = 50, 999
CART = "user_id bigint, lines int, pieces bigint, placed bigint, seen bigint"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over what is there, into parquet of the shared folder, and reads that."""
    spark, path = stream.sparkSession, fresh(stream.sparkSession)
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY ALL")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each closed UTC day by kind, from a stream with a watermark of an hour: a day is written once no more of it
    can come, so the last day, still open, isn't among them."""
    w = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    days = drained(w.select(F.to_date("w.start").alias("day"), "event_type", "n", "total"), "append")
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.to_date("ts")).alias("last"))
    return days.join(F.broadcast(last), F.col("day") < F.col("last")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))  # one row


def fold_cart(cart: dict[int, int], placed: int, rows: pd.DataFrame) -> tuple[dict[int, int], int]:
    """A cart after rows in order: clicks add a piece (capped), errors take the line out, purchases place the order."""
    for kind, part in zip(rows["event_type"], rows["part"], strict=True):
        if kind == "purchase":
            placed += bool(cart)
            cart = {}
        elif kind == "error":
            cart.pop(part, None)
        elif part in cart or len(cart) < CART_LINES:
            cart[part] = min(LINE_PIECES, cart.get(part, 0) + 1)
    return cart, placed


def cart_events(events: DataFrame) -> DataFrame:
    return events.where("event_type in ('click', 'error', 'purchase')").select("user_id", "ts", "event_id", "event_type", F.pmod(F.floor("value"), F.lit(10)).alias("part"))


def carts_batch(events: DataFrame) -> DataFrame:
    """Carts of all users after all events, by windows: the orders before an event number its cart, and of each part the clicks
    after its last error in that cart count. Parts are ten at most, so the cap of lines is never met."""
    e, at = cart_events(events), F.struct("ts", "event_id")
    before = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("cart", F.count_if(F.col("event_type") == "purchase").over(before)).withColumn("at", at)
    taken = e.groupBy("user_id", "cart", "part").agg(F.max(F.when(F.col("event_type") == "error", F.col("at"))).alias("out"))
    clicks = e.where("event_type = 'click'").join(taken, ["user_id", "cart", "part"]).where("out is null or at > out").groupBy("user_id", "cart", "part").agg(F.least(F.lit(LINE_PIECES), F.count("*")).alias("pieces"))
    full = clicks.groupBy("user_id", "cart").agg(F.count("*").cast("int").alias("lines"), F.sum("pieces").alias("pieces"))
    carts = e.groupBy("user_id", "cart").agg(F.max(F.col("event_type") == "purchase").alias("bought")).join(full, ["user_id", "cart"], "left")
    open_ = lambda c: F.coalesce(F.max(F.when(~F.col("bought"), F.col(c))), F.lit(0))
    return carts.groupBy("user_id").agg(open_("lines").cast("int").alias("lines"), open_("pieces").alias("pieces"), F.count_if(F.col("bought") & (F.col("lines") > 0)).alias("placed"))


def carts_stream(events: DataFrame, idle_ms: int | None = 14 * 86_400_000) -> DataFrame:
    """Carts as keyed state of a stream: each user's cart after every micro-batch, with the number of events seen so far, dropped
    after idle_ms (two weeks) without an event; None keeps them, for streams that end."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts, pieces, placed, seen = state.get if state.exists else ([], [], 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        cart, placed = fold_cart(dict(zip(parts, pieces, strict=True)), placed, rows)
        seen += len(rows)
        state.update((list(cart), list(cart.values()), placed, seen))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"user_id": [key[0]], "lines": [len(cart)], "pieces": [sum(cart.values())], "placed": [placed], "seen": [seen]})

    return cart_events(events).groupBy("user_id").applyInPandasWithState(fold, CART, "parts array<bigint>, pieces array<bigint>, placed bigint, seen bigint", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


@query(f"""WITH e AS (SELECT user_id, ts, event_id, event_type, CAST(floor(value) AS BIGINT) % 10 AS part FROM events WHERE event_type IN ('click', 'error', 'purchase')),
 n AS (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cart FROM e),
 c AS (SELECT user_id, cart, part, least({LINE_PIECES}, count(*)) AS pieces FROM (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, cart, part ORDER BY ts DESC, event_id DESC) AS later FROM n) x WHERE event_type = 'click' AND later = 0 GROUP BY ALL),
 f AS (SELECT user_id, cart, count(*) AS lines, sum(pieces) AS pieces FROM c GROUP BY ALL), o AS (SELECT user_id, cart, bool_or(event_type = 'purchase') AS bought FROM n GROUP BY ALL)
 SELECT user_id, CAST(coalesce(max(lines) FILTER (WHERE NOT bought), 0) AS INT) AS lines, CAST(coalesce(max(pieces) FILTER (WHERE NOT bought), 0) AS BIGINT) AS pieces, count(*) FILTER (WHERE bought AND lines > 0) AS placed FROM o LEFT JOIN f USING (user_id, cart) GROUP BY user_id""")
def stream_carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open carts and placed orders of every user, from the stream: of each user the state after the last of its micro-batches."""
    every = drained(carts_stream(event_stream(spark, sf_dir), None), "append")
    return every.groupBy("user_id").agg(F.max_by(F.struct("lines", "pieces", "placed"), "seen").alias("x")).select("user_id", "x.*")

"""Admission of calls by a sliding window with feedback: a refused call isn't recorded, so each decision depends on those before it."""

from __future__ import annotations

import ipaddress
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType

from lodestone.plans.views import table
from lodestone.registry import query
from lodestone.streaming.events import drained, event_stream

#: The reports' limit: so much cost a user in so many microseconds.
MOST, SPAN = 3, 36 * 3600 * 1_000_000
DECIDED = "event_id bigint, key bigint, allowed boolean"


@F.pandas_udf(StringType())
def client_bucket(host: pd.Series) -> pd.Series:
    """Whom calls of a host count for: an IPv6 host's /64 network, the IPv4 address that one stands for, any other text as it is."""

    def one(h):
        if h is None or ":" not in h:
            return h
        try:
            ip = ipaddress.ip_address(h)
            return str(ip.ipv4_mapped or ipaddress.ip_network(f"{h}/64", strict=False)) if ip.version == 6 else h
        except ValueError:
            return h

    return host.map(one)


def decide(held: deque[int], at: int, cost: int, most: int, span: int) -> bool:
    """Whether a call is admitted; an admitted one is put into `held`, once for each unit of cost. Entries older than the span
    leave first, so at most `most` are held. most = 0 or less admits all."""
    if most <= 0:
        return True
    while held and at - held[0] > span:
        held.popleft()
    if len(held) + cost > most:
        return False
    held.extend([at] * max(1, cost))
    return True


def admitted(calls: DataFrame, most: int, span: int) -> DataFrame:
    """(event_id, key, allowed) of all calls (key, at in microseconds, event_id, cost), in the order of at, then event_id, by key.

    A key's calls are cut where a whole span passes without one, which empties its window; pieces are found from the spans that
    have calls, not from the calls. Each piece goes to one task in order and is read batch by batch with at most `most`
    entries held, so a busy key costs time in a task, not memory. Null keys are a key; null cost counts as 1.
    """
    own = calls.select("event_id", "key", "at", F.coalesce("cost", F.lit(1)).alias("cost"), F.floor(F.col("at") / span).alias("slot"))
    slots = own.select(F.col("key").alias("k"), F.col("slot").alias("s")).distinct()
    before = F.lag("s").over(W.partitionBy("k").orderBy("s"))
    starts = slots.withColumn("new", F.when(before == F.col("s") - 1, None).otherwise(F.col("s")))
    starts = starts.withColumn("piece", F.last("new", ignorenulls=True).over(W.partitionBy("k").orderBy("s")))
    own = own.join(starts, own["key"].eqNullSafe(starts["k"]) & (own["slot"] == starts["s"])).select("key", "piece", "at", "event_id", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, deque()
        for batch in batches:
            out = np.empty(batch.num_rows, dtype=bool)
            columns = [batch.column(c).to_pylist() for c in ("key", "piece", "at", "cost")]
            for i, (key, piece, at, cost) in enumerate(zip(*columns, strict=True)):
                if (key, piece) != last:
                    last, held = (key, piece), deque()
                out[i] = decide(held, at, cost, most, span)
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("key"), pa.array(out)], names=["event_id", "key", "allowed"])

    return own.repartition("key", "piece").sortWithinPartitions("key", "piece", "at", "event_id").mapInArrow(run, DECIDED)


def admitted_stream(calls: DataFrame, most: int, span: int, idle_ms: int | None = None) -> DataFrame:
    """The same for a stream, with each key's window as state of at most `most` times. A micro-batch's calls of a key are put in order of
    at, then event_id, as three columns of numbers; one that is earlier than the last of a former micro-batch is
    judged at that one's time. State is dropped after idle_ms without a call; None keeps it, for streams that end."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, last = state.get if state.exists else ([], None)
        held = deque(times)
        parts = [np.stack([b["at"].to_numpy(np.int64), b["event_id"].to_numpy(np.int64), b["cost"].fillna(1).to_numpy(np.int64)]) for b in batches]
        at, ids, cost = np.concatenate(parts, axis=1)
        order = np.lexsort((ids, at))
        at, ids, cost = at[order], ids[order], cost[order]
        at = np.maximum(at, at[0] if last is None else last)
        allowed = [decide(held, a, c, most, span) for a, c in zip(at.tolist(), cost.tolist(), strict=True)]
        state.update((list(held), int(at[-1])))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"event_id": ids, "key": pd.array([key[0]] * len(ids), dtype="Int64"), "allowed": allowed})

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return calls.select("key", "at", "event_id", "cost").groupBy("key").applyInPandasWithState(fold, DECIDED, "times array<bigint>, last bigint", "append", timeout)


def event_calls(events: DataFrame) -> DataFrame:
    """Events as calls of their user; a fifth cost two."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", F.when(k % 5 == 0, 2).otherwise(1).alias("cost"))


_SQL = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 = 0 THEN 2 ELSE 1 END AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 f AS (SELECT event_id, user_id, i, cost <= {MOST} AS allowed, CASE WHEN cost <= {MOST} THEN list_transform(range(cost), lambda x: us) ELSE CAST([] AS BIGINT[]) END AS held FROM e WHERE i = 1
  UNION ALL SELECT event_id, user_id, i, n + cost <= {MOST}, CASE WHEN n + cost <= {MOST} THEN list_concat(live, list_transform(range(cost), lambda x: us)) ELSE live END
   FROM (SELECT e.event_id, e.user_id, e.i, e.us, e.cost, list_filter(f.held, lambda x: e.us - x <= {SPAN}) AS live, len(list_filter(f.held, lambda x: e.us - x <= {SPAN})) AS n FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) y)
 SELECT event_id, user_id, allowed FROM f"""


@query(_SQL)
def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event of a user is admitted."""
    return admitted(event_calls(table(spark, sf_dir, "events")), MOST, SPAN).withColumnRenamed("key", "user_id")


@query(_SQL)
def stream_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions from a stream, with the windows as keyed state."""
    return drained(admitted_stream(event_calls(event_stream(spark, sf_dir)), MOST, SPAN), "append").withColumnRenamed("key", "user_id")

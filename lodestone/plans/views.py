"""The engine's entities over the driver's tables: catalog parts, order lines, the event log and the vector gallery."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.scratch import cut, dealt

#: Views that plans built within `shared` read from a written table, by name and folder.
_SHARED: ContextVar[dict[tuple[str, str], DataFrame]] = ContextVar("shared", default={})

#: Order lines of a task that counts for its clients.
LINES = 250_000

#: DuckDB twins of the views below, as common table expressions.
SQL_EVENTS = """
ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
log AS (SELECT event_id, ts, user_id, event_type, value, k, user_id || ':' || k AS request_id, CAST(floor(value) AS BIGINT) % 10 AS part,
  CASE WHEN k < 25 THEN 'exact' WHEN k < 50 THEN 'likely' WHEN k < 90 THEN 'candidate' END AS tier, k % 7 AS category,
  CASE WHEN k % 11 = 0 THEN NULL ELSE (k % 100) / 100.0 END AS confidence, k % 3 = 0 AS measured FROM ev),
ident AS (SELECT * FROM log WHERE event_type = 'view'),
answer AS (SELECT * FROM ident QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, event_id DESC) = 1),
bought AS (SELECT * FROM log WHERE event_type = 'purchase'),
hit AS (SELECT b.event_id, b.ts, b.user_id, b.request_id, b.part AS truth, a.part AS best, a.tier, a.category, a.confidence, a.measured, a.ts AS asked_at
  FROM bought b JOIN answer a USING (request_id))
"""
SQL_LINES = """
lines AS (SELECT o_orderkey AS order_id, o_custkey AS client, o_orderdate AS placed_at, l_partkey AS part, l_linenumber AS line_no, CAST(l_quantity AS BIGINT) AS quantity,
  p_type AS kind, p_brand AS brand, p_name AS family, p_size AS size FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey)
"""
SQL_PARTS = """
parts AS (SELECT p_partkey AS part, p_name AS name, p_name AS family, [p_type, p_brand] AS path, p_type AS kind, p_brand AS brand, p_size AS size, p_retailprice AS price FROM part)
"""
SQL_GALLERY = """
gallery AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sharable(view: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = _SHARED.get().get((view.__name__, sf_dir))
        return view(spark, sf_dir) if kept is None else kept

    read.__name__, read.__doc__ = view.__name__, view.__doc__
    return read


@contextlib.contextmanager
def shared(spark: SparkSession, sf_dir: str, view: Callable[[SparkSession, str], DataFrame]) -> Iterator[None]:
    """Plans that are built inside read the view from a table that is written once, for reports that are made of many of it. Runs a job."""
    key = (view.__name__, sf_dir)
    if key in _SHARED.get():
        yield
        return
    token = _SHARED.set(_SHARED.get() | {key: cut(view(spark, sf_dir))})
    try:
        yield
    finally:
        _SHARED.reset(token)


@_sharable
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the fields of the log: request_id, part (answered or bought), tier, category, confidence, measured."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    tier = F.when(F.col("k") < 25, "exact").when(F.col("k") < 50, "likely").when(F.col("k") < 90, "candidate")
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value", "k",
        F.concat_ws(":", F.col("user_id").cast("string"), F.col("k").cast("string")).alias("request_id"),
        F.pmod(F.floor("value"), F.lit(10)).alias("part"), tier.alias("tier"), (F.col("k") % 7).alias("category"),
        F.when(F.col("k") % 11 != 0, F.col("k") % 100 / 100.0).alias("confidence"), (F.col("k") % 3 == 0).alias("measured"),
    )


def identified(log: DataFrame) -> DataFrame:
    return log.where("event_type = 'view'")


def answers(log: DataFrame) -> DataFrame:
    """The latest identify row of each request, as a partial aggregate rather than a window: a hot request stays one row per task."""
    latest = F.max_by(F.struct("part", "tier", "category", "confidence", "measured", "ts"), F.struct("ts", "event_id")).alias("a")
    return identified(log).groupBy("request_id").agg(latest).select("request_id", "a.*")


def bought(log: DataFrame) -> DataFrame:
    return log.where("event_type = 'purchase'")


def attributed(log: DataFrame) -> DataFrame:
    """Bought items with the answer that led to them; items without a known request are left out."""
    a = answers(log).withColumnsRenamed({"part": "best", "ts": "asked_at"})
    return bought(log).select("event_id", "ts", "user_id", "request_id", F.col("part").alias("truth")).join(a, "request_id")


@_sharable
def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with client, time and the part's facts; a line of an unknown part stays with nulls."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("client"), F.col("o_orderdate").alias("placed_at"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line_no"), F.col("l_quantity").cast("bigint").alias("quantity"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.col("p_name").alias("family"), F.col("p_size").alias("size"))
    return o.join(line, "order_id").join(p, "part", "left")


def client_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of order lines, dealt by client before rows are made of them: counts by client and more are then made in the task that has the
    client, of about LINES lines however large the table, and no row that stands for a part of a line is shuffled."""
    return dealt(order_lines(spark, sf_dir).select("client", *columns), LINES, "client", of=table(spark, sf_dir, "lineitem"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog parts: path is type, then brand; a family shares its name."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), F.col("p_name").alias("name"), F.col("p_name").alias("family"), F.array("p_type", "p_brand").alias("path"),
        F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
    )


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in double precision with their category."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))

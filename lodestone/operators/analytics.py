"""Reports over the event log: counts, funnel, attribution, precision, latency, trends and the rules that raise issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.numeric import percentiles, ratio, share
from lodestone.functions.ranking import running
from lodestone.plans.scratch import cut
from lodestone.plans.views import SQL_EVENTS, SQL_PARTS, answers, attributed, bought, event_log, identified, parts, shared
from lodestone.registry import SQL, query


@query(f"""WITH {SQL_EVENTS} SELECT event_type AS kind, count(*) AS n, count(DISTINCT request_id) AS requests,
 count(*) FILTER (WHERE tier IS NULL) AS without_tier FROM log GROUP BY event_type""")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and requests by event kind."""
    return event_log(spark, sf_dir).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("request_id").alias("requests"), F.count_if(F.col("tier").isNull()).alias("without_tier"))


@query(f"""WITH {SQL_EVENTS}, c AS (SELECT count(*) FILTER (WHERE event_type = 'view') AS identify,
 count(DISTINCT CASE WHEN event_type = 'click' THEN request_id END) AS carted, count(DISTINCT CASE WHEN event_type = 'purchase' THEN request_id END) AS bought FROM log)
 SELECT identify, carted, bought, round(carted / nullif(identify, 0), 6) AS identify_to_cart, round(least(1.0, bought / nullif(carted, 0)), 6) AS cart_to_checkout,
 round(bought / nullif(identify, 0), 6) AS identify_to_checkout FROM c""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that reach the cart and the checkout; the step from cart to checkout is capped at 1, null over nothing."""
    of = lambda kind: F.countDistinct(F.when(F.col("event_type") == kind, F.col("request_id")))
    c = event_log(spark, sf_dir).agg(F.count_if(F.col("event_type") == "view").alias("identify"), of("click").alias("carted"), of("purchase").alias("bought"))
    return c.select("*", ratio(F.col("carted"), F.col("identify")).alias("identify_to_cart"), F.least(F.lit(1.0), ratio(F.col("bought"), F.col("carted"))).alias("cart_to_checkout"), ratio(F.col("bought"), F.col("identify")).alias("identify_to_checkout"))


@query(f"WITH {SQL_EVENTS} SELECT best AS predicted, truth, count(*) AS times FROM hit WHERE best <> truth GROUP BY ALL ORDER BY times DESC, predicted, truth LIMIT 12")
def confusion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve most frequent wrong answers."""
    return attributed(event_log(spark, sf_dir)).where("best <> truth").groupBy(F.col("best").alias("predicted"), "truth").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "predicted", "truth").limit(12)


def _precision(spark: SparkSession, sf_dir: str, key: F.Column, name: str) -> DataFrame:
    ok = F.col("best") == F.col("truth")
    return attributed(event_log(spark, sf_dir)).groupBy(key.alias(name)).agg(F.count("*").alias("n"), F.count_if(ok).alias("right"), share(ok).alias("precision"))


@query(f"WITH {SQL_EVENTS} SELECT coalesce(tier, '?') AS tier, count(*) AS n, count(*) FILTER (WHERE best = truth) AS \"right\", round(avg(CAST(best = truth AS INT)), 6) AS precision FROM hit GROUP BY 1")
def tier_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of bought items that were the first answer, by tier."""
    return _precision(spark, sf_dir, F.coalesce("tier", F.lit("?")), "tier")


@query(f"WITH {SQL_EVENTS} SELECT measured, count(*) AS n, count(*) FILTER (WHERE best = truth) AS \"right\", round(avg(CAST(best = truth AS INT)), 6) AS precision FROM hit GROUP BY 1")
def measured_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, measured photos against others."""
    return _precision(spark, sf_dir, F.col("measured"), "measured")


@query(f"WITH {SQL_EVENTS} SELECT category, count(*) AS n, count(*) FILTER (WHERE best = truth) AS \"right\", round(avg(CAST(best = truth AS INT)), 6) AS precision FROM hit GROUP BY 1")
def category_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by category."""
    return _precision(spark, sf_dir, F.col("category"), "category")


@query(f"""WITH {SQL_EVENTS} SELECT round(avg(CAST(best = truth AS INT)), 6) AS top1_rate, round(avg(coalesce(confidence, 0)) FILTER (WHERE best = truth), 6) AS when_right,
 round(avg(coalesce(confidence, 0)) FILTER (WHERE best <> truth), 6) AS when_wrong FROM hit""")
def confidence_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of first answers bought, and mean confidence when right and wrong; a missing confidence counts as 0."""
    ok, c = F.col("best") == F.col("truth"), F.coalesce("confidence", F.lit(0.0))
    return attributed(event_log(spark, sf_dir)).agg(share(ok).alias("top1_rate"), F.round(F.avg(F.when(ok, c)), 6).alias("when_right"), F.round(F.avg(F.when(~ok, c)), 6).alias("when_wrong"))


@query(f"WITH {SQL_EVENTS} SELECT event_type AS kind, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM log GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile of latency with linear interpolation."""
    return percentiles(event_log(spark, sf_dir).withColumnRenamed("event_type", "kind"), "kind", "value", {"p50": 0.5, "p95": 0.95})


@query(f"WITH {SQL_EVENTS} SELECT k AS status, count(*) AS n FROM log WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, status LIMIT 8")
def error_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most frequent errors."""
    return event_log(spark, sf_dir).where("event_type = 'error'").groupBy(F.col("k").alias("status")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status").limit(8)


@query(f"""WITH {SQL_EVENTS}, c AS (SELECT coalesce(tier, 'other') AS via, part % 5 + 1 AS rank FROM log WHERE event_type = 'click')
 SELECT 'via' AS dim, via AS key, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'rank', CAST(rank AS VARCHAR), count(*) FROM c GROUP BY ALL""")
def found_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How cart adds were found, and at which rank: both histograms in one pass."""
    c = event_log(spark, sf_dir).where("event_type = 'click'").select(F.explode(F.array(F.struct(F.lit("via").alias("dim"), F.coalesce("tier", F.lit("other")).alias("key")), F.struct(F.lit("rank").alias("dim"), (F.col("part") % 5 + 1).cast("string").alias("key")))).alias("x"))
    return c.groupBy("x.dim", "x.key").agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_EVENTS}, s AS (SELECT *, k % 5 AS results, k % 2 = 0 AS narrowed FROM log WHERE event_type = 'signup'),
 c AS (SELECT count(*) AS searches, avg(CAST(narrowed AS INT)) AS narrowed, avg(CAST(results = 0 AS INT)) AS empty, min(ts) AS since FROM s)
 SELECT searches, round(narrowed, 6) AS narrowed, round(empty, 6) AS no_result, round(least(1.0, (SELECT count(*) FROM log WHERE event_type = 'click' AND ts >= c.since) / nullif(searches, 0)), 6) AS to_cart FROM c""")
def search_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches, narrowed and empty shares, and cart adds since the oldest search kept, capped at 1."""
    log = event_log(spark, sf_dir)
    s = log.where("event_type = 'signup'")
    c = s.agg(F.count("*").alias("searches"), share(F.col("k") % 2 == 0).alias("narrowed"), share(F.col("k") % 5 == 0).alias("no_result"), F.min("ts").alias("since"))
    carts = log.where("event_type = 'click'").join(F.broadcast(c.select("since")), F.col("ts") >= F.col("since")).agg(F.count("*").alias("adds"))  # one row
    return c.join(F.broadcast(carts)).select("searches", "narrowed", "no_result", F.least(F.lit(1.0), ratio(F.col("adds"), F.col("searches"))).alias("to_cart"))


@query(f"""WITH {SQL_EVENTS}, b AS (SELECT coalesce(a.ts, b.ts) AS seen_at, a.part AS best, b.part AS truth, a.request_id IS NOT NULL AS photo FROM bought b LEFT JOIN answer a USING (request_id)),
 u AS (SELECT strftime(ts, '%Y-%m-%d') AS day, 1 AS identify, 0 AS bought, 0 AS photo, 0 AS top1 FROM ident UNION ALL SELECT strftime(seen_at, '%Y-%m-%d'), 0, 1, CAST(photo AS INT), CAST(coalesce(best = truth, false) AS INT) FROM b)
 SELECT day, CAST(sum(identify) AS BIGINT) AS identify, CAST(sum(bought) AS BIGINT) AS bought, CAST(sum(photo) AS BIGINT) AS bought_from_photo, CAST(sum(top1) AS BIGINT) AS bought_top1 FROM u GROUP BY day ORDER BY day DESC LIMIT 30""")
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per UTC day; a bought item counts on the day of its photo, or of its checkout without one. The last 30 days."""
    log = event_log(spark, sf_dir)
    a = answers(log).select("request_id", F.col("part").alias("best"), F.col("ts").alias("asked_at"), F.lit(1).alias("photo"))
    b = bought(log).join(a, "request_id", "left").select(F.date_format(F.coalesce("asked_at", "ts"), "yyyy-MM-dd").alias("day"), F.lit(0).alias("i"), F.lit(1).alias("b"), F.coalesce("photo", F.lit(0)).alias("p"), F.coalesce((F.col("best") == F.col("part")).cast("int"), F.lit(0)).alias("t"))
    u = identified(log).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit(1).alias("i"), F.lit(0).alias("b"), F.lit(0).alias("p"), F.lit(0).alias("t")).unionByName(b)
    return u.groupBy("day").agg(F.sum("i").alias("identify"), F.sum("b").alias("bought"), F.sum("p").alias("bought_from_photo"), F.sum("t").alias("bought_top1")).orderBy(F.desc("day")).limit(30)


@query(f"""WITH {SQL_EVENTS}, s AS (SELECT user_id, ts, event_id, event_type, part FROM log WHERE event_type IN ('view', 'purchase')),
 t AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN struct_pack(ts := ts, id := event_id, part := part) END IGNORE NULLS) OVER w AS strip,
  last_value(CASE WHEN event_type = 'purchase' THEN struct_pack(ts := ts, id := event_id) END IGNORE NULLS) OVER w AS used FROM s
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT count(*) AS orders_after_strip, round(avg(CAST(strip.part = part AS INT)), 6) AS take FROM t
 WHERE event_type = 'purchase' AND strip IS NOT NULL AND (used IS NULL OR (used.ts, used.id) < (strip.ts, strip.id))""")
def strip_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each checkout takes the latest strip shown to that client since the checkout before it, and uses it up; take: it bought what was shown.

    A window covers a client's day; the last strip and checkout of the days before are carried in a row for each day, so a task
    holds a day of a client, not the client.
    """
    s = event_log(spark, sf_dir).where("event_type in ('view', 'purchase')").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type", "part")
    of = lambda kind: F.when(F.col("event_type") == kind, F.struct("ts", "event_id", "part"))
    before = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = s.groupBy("user_id", "day").agg(F.max(of("view")).alias("strip"), F.max(of("purchase")).alias("used"))
    days = days.select("user_id", "day", *[F.last(c, ignorenulls=True).over(before).alias(f"old_{c}") for c in ("strip", "used")])
    w = W.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    t = s.withColumns({"strip": F.last(of("view"), ignorenulls=True).over(w), "used": F.last(of("purchase"), ignorenulls=True).over(w)}).where("event_type = 'purchase'").join(days, ["user_id", "day"])
    t = t.withColumns({c: F.coalesce(c, f"old_{c}") for c in ("strip", "used")}).where("strip is not null")
    t = t.where(F.col("used").isNull() | (F.struct("used.ts", "used.event_id") < F.struct("strip.ts", "strip.event_id")))
    return t.agg(F.count("*").alias("orders_after_strip"), share(F.col("strip.part") == F.col("part")).alias("take"))


def strip_orders(rows: DataFrame, had: DataFrame | None = None) -> DataFrame:
    """(user_id, at, took, new) of each checkout that a strip was shown before: whether it took a part of it, and one that the client
    had never bought. had: (user_id, part, first), what was bought before these rows and when.

    rows: user_id, ts, event_id, kind (`shown` or `checkout`), parts (a list). A checkout takes the latest strip shown to the client
    since the checkout before it, and uses it up, also where it takes nothing. Rows without user don't count. A window covers
    a client's day, with the last strip and checkout of former days carried in a row for each day; whether a part was
    bought before goes by the first checkout of each client and part.
    """
    rows = rows.where("user_id is not null and kind in ('shown', 'checkout')").select("user_id", F.to_date("ts").alias("day"), F.struct("ts", "event_id").alias("at"), "kind", F.coalesce("parts", F.array().cast(rows.schema["parts"].dataType)).alias("parts"))
    of = lambda kind: F.when(F.col("kind") == kind, F.struct("at", "parts"))
    before = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    latest = lambda kind: F.max_by(F.struct("at", "parts"), F.when(F.col("kind") == kind, F.col("at")))
    days = rows.groupBy("user_id", "day").agg(latest("shown").alias("strip"), latest("checkout").alias("used"))
    days = days.select("user_id", "day", *[F.last(c, ignorenulls=True).over(before).alias(f"old_{c}") for c in ("strip", "used")])
    w = W.partitionBy("user_id", "day").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    met = rows.withColumns({"strip": F.last(of("shown"), ignorenulls=True).over(w), "used": F.last(of("checkout"), ignorenulls=True).over(w)}).where("kind = 'checkout'").join(days, ["user_id", "day"])
    met = met.withColumns({c: F.coalesce(c, f"old_{c}") for c in ("strip", "used")}).where(F.col("strip").isNotNull() & (F.col("used").isNull() | (F.col("used.at") < F.col("strip.at"))))
    first = first_bought(rows, had)
    each = met.select("user_id", "at", F.explode_outer(F.array_intersect("parts", "strip.parts")).alias("part")).join(first, ["user_id", "part"], "left")
    return each.groupBy("user_id", "at").agg(F.max(F.col("part").isNotNull()).alias("took"), F.max(F.coalesce(F.col("first") == F.col("at"), F.lit(False))).alias("new"))


def first_bought(rows: DataFrame, had: DataFrame | None = None) -> DataFrame:
    """(user_id, part, first): the first checkout of each client and part, in rows (user_id, at, kind, parts) and in what was known."""
    own = rows.where("kind = 'checkout' and user_id is not null").select("user_id", F.explode(F.array_distinct("parts")).alias("part"), F.col("at").alias("first"))
    return (own if had is None else own.unionByName(had)).groupBy("user_id", "part").agg(F.min("first").alias("first"))


def strip_takes(rows: DataFrame) -> DataFrame:
    """(orders_after_strip, take, new_take) over `strip_orders`: how many, and the shares that took a part and a new one; null over none."""
    orders = strip_orders(rows)
    return orders.agg(F.count("*").alias("orders_after_strip"), share(F.col("took")).alias("take"), share(F.col("new")).alias("new_take"))


@query(f"""WITH {SQL_EVENTS}, s AS (SELECT user_id, ts, event_id, event_type = 'view' AS shown, CASE WHEN event_type = 'view' THEN [part, (part + 3) % 10, k % 10] ELSE [part, k % 7] END AS parts FROM log WHERE event_type IN ('view', 'purchase')),
 t AS (SELECT *, last_value(CASE WHEN shown THEN struct_pack(ts := ts, id := event_id, parts := parts) END IGNORE NULLS) OVER w AS strip, last_value(CASE WHEN NOT shown THEN struct_pack(ts := ts, id := event_id) END IGNORE NULLS) OVER w AS used,
  flatten(list(CASE WHEN NOT shown THEN parts ELSE [] END) OVER w) AS had FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 o AS (SELECT list_intersect(parts, strip.parts) AS got, coalesce(had, []) AS had FROM t WHERE NOT shown AND strip IS NOT NULL AND (used IS NULL OR (used.ts, used.id) < (strip.ts, strip.id)))
 SELECT count(*) AS orders_after_strip, round(avg((len(got) > 0)::INT), 6) AS take, round(avg((len(list_filter(got, lambda x: NOT list_contains(had, x))) > 0)::INT), 6) AS new_take FROM o""")
def strip_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often checkouts take a part of the strip shown before, and one never bought; strips and checkouts are lists of parts."""
    return strip_takes(strip_rows(event_log(spark, sf_dir)))


def strip_rows(log: DataFrame) -> DataFrame:
    """Views as strips shown and purchases as checkouts, each of some parts."""
    shown = F.col("event_type") == "view"
    parts_of = F.when(shown, F.array("part", (F.col("part") + 3) % 10, F.col("k") % 10)).otherwise(F.array("part", F.col("k") % 7))
    return log.where("event_type in ('view', 'purchase')").select("user_id", "ts", "event_id", F.when(shown, "shown").otherwise("checkout").alias("kind"), parts_of.alias("parts"))


@query(f"""WITH {SQL_EVENTS}, f AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, event_id DESC) AS rn, min(ts) OVER (PARTITION BY request_id) AS first_at FROM log WHERE event_type IN ('click', 'signup'))
 SELECT request_id, part, event_type AS source, first_at FROM f WHERE rn = 1""")
def latest_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest feedback of each request with the time of its first."""
    f = event_log(spark, sf_dir).where("event_type in ('click', 'signup')")
    return f.groupBy("request_id").agg(F.max_by(F.struct("part", F.col("event_type").alias("source")), F.struct("ts", "event_id")).alias("x"), F.min("ts").alias("first_at")).select("request_id", "x.part", "x.source", "first_at")


@query(f"""WITH {SQL_EVENTS}, f AS (SELECT * FROM log WHERE event_type IN ('click', 'signup') QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, event_id DESC) = 1)
 SELECT count(*) AS total, count(*) FILTER (WHERE f.part <> 0) AS confirmed, count(*) FILTER (WHERE f.part = 0) AS unknown, count(*) FILTER (WHERE f.part = a.part AND f.part <> 0) AS correct_top1,
 count(DISTINCT CASE WHEN f.part <> 0 THEN f.part END) AS parts, count(*) FILTER (WHERE f.event_type = 'click') AS from_cart FROM f LEFT JOIN answer a ON a.request_id = f.request_id""")
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after last-write-wins; part 0 stands for `none of these`."""
    f = latest_feedback(spark, sf_dir).join(answers(event_log(spark, sf_dir)).select("request_id", F.col("part").alias("best")), "request_id", "left")
    known = F.col("part") != 0
    return f.agg(F.count("*").alias("total"), F.count_if(known).alias("confirmed"), F.count_if(~known).alias("unknown"), F.count_if(known & (F.col("part") == F.col("best"))).alias("correct_top1"), F.countDistinct(F.when(known, F.col("part"))).alias("parts"), F.count_if(F.col("source") == "click").alias("from_cart"))


@query(f"""WITH {SQL_EVENTS} SELECT part, CAST(sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM log
 WHERE event_type IN ('purchase', 'signup', 'click') AND part <> 0 GROUP BY part""")
def confirmation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by part: checkout 3, label 2, cart 1."""
    w = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    return event_log(spark, sf_dir).where("event_type in ('purchase', 'signup', 'click') and part <> 0").groupBy("part").agg(F.sum(w).alias("weight"))


@query(f"""WITH {SQL_EVENTS} SELECT coalesce(tier, '?') AS tier, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
 round(coalesce(avg(CAST(k % 4 = 0 AS INT)), 0), 6) AS multi_photo_share FROM ident GROUP BY 1""")
def request_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by tier with latency and the share of several photos, 0 over nothing."""
    rows = identified(event_log(spark, sf_dir)).withColumn("tier", F.coalesce("tier", F.lit("?")))
    counts = rows.groupBy("tier").agg(F.count("*").alias("n"), F.coalesce(share(F.col("k") % 4 == 0), F.lit(0.0)).alias("multi_photo_share"))
    return counts.join(percentiles(rows, "tier", "value", {"p50": 0.5, "p95": 0.95}), "tier")


@query(f"WITH {SQL_EVENTS} SELECT event_id, request_id, ts FROM log WHERE event_type = 'click' AND request_id IN (SELECT request_id FROM ident)")
def known_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cart adds whose request was identified."""
    log = event_log(spark, sf_dir)
    return log.where("event_type = 'click'").join(identified(log).select("request_id"), "request_id", "left_semi").select("event_id", "request_id", "ts")


@query(f"WITH {SQL_EVENTS} SELECT event_id, request_id, part FROM log WHERE event_type = 'signup' AND ts > TIMESTAMP '2024-01-15 00:00:00'")
def feedback_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback newer than a time; the filter reaches the scan."""
    return event_log(spark, sf_dir).where("event_type = 'signup' and ts > timestamp_ntz '2024-01-15 00:00:00'").select("event_id", "request_id", "part")


@query(f"WITH {SQL_EVENTS} SELECT event_id, ts, request_id, tier FROM ident ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest requests: a top-k of each task, then of all."""
    return identified(event_log(spark, sf_dir)).select("event_id", "ts", "request_id", "tier").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query(f"""WITH {SQL_EVENTS} SELECT event_id, event_type FROM log QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= CASE WHEN event_type = 'view' THEN 500 ELSE 125 END""")
def retained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of each class: 500 of one, a quarter of that of the others. Tasks keep their own newest first."""
    rank = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return event_log(spark, sf_dir).withColumn("r", rank).where("r <= 500").where("r <= if(event_type = 'view', 500, 125)").select("event_id", "event_type")


@query(f"""WITH {SQL_EVENTS}, c AS (SELECT request_id, count(DISTINCT part) AS parts FROM log WHERE event_type = 'click' GROUP BY 1)
 SELECT e.event_id, e.request_id, c.parts > 1 AS ambiguous FROM log e JOIN c USING (request_id) WHERE e.event_type = 'click'""")
def ambiguous_carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cart adds whose request has more than one distinct part in carts; those confirm no photo."""
    c = event_log(spark, sf_dir).where("event_type = 'click'")
    n = c.groupBy("request_id").agg((F.countDistinct("part") > 1).alias("ambiguous"))
    return c.join(n, "request_id").select("event_id", "request_id", "ambiguous")


@query(f"""WITH {SQL_EVENTS}, s AS (SELECT c_custkey AS user_id, c_mktsegment AS segment FROM customer)
 SELECT segment, count(*) AS n, round(avg(CAST(best = truth AS INT)), 6) AS precision FROM hit JOIN s USING (user_id) GROUP BY 1""")
def segment_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision by customer segment."""
    s = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return attributed(event_log(spark, sf_dir)).join(s, "user_id").groupBy("segment").agg(F.count("*").alias("n"), share(F.col("best") == F.col("truth")).alias("precision"))


@query(f"""WITH {SQL_EVENTS}, {SQL_PARTS}, c AS (SELECT best, truth, count(*) AS times FROM hit WHERE best <> truth GROUP BY ALL), s AS (SELECT * FROM ({SQL["search_funnel"]}) x), strip AS (SELECT * FROM ({SQL["strip_take"]}) x),
 spec AS (SELECT part, concat_ws('|', brand, kind, name, CAST(size AS VARCHAR)) AS spec FROM parts), eq AS (SELECT sum(CASE WHEN p.spec = t.spec THEN times ELSE 0 END) / sum(times) AS share FROM c LEFT JOIN spec p ON p.part = best LEFT JOIN spec t ON t.part = truth),
 a AS (SELECT (SELECT count(*) FROM ident) AS identify, (SELECT count(*) FROM hit) AS items, (SELECT avg(CAST(best = truth AS INT)) FROM hit) AS top1, (SELECT quantile_cont(value, 0.95) FROM ident) AS p95,
  (SELECT avg(coalesce(confidence, 0)) FILTER (WHERE best = truth) FROM hit) AS sure, (SELECT avg(coalesce(confidence, 0)) FILTER (WHERE best <> truth) FROM hit) AS unsure, (SELECT count(*) FROM log WHERE event_type = 'error') AS errors,
  (SELECT count(*) FROM log WHERE event_type = 'signup' AND k % 9 = 0) AS none, (SELECT count(DISTINCT request_id) FROM log WHERE event_type = 'click') AS carted)
 SELECT 1 AS no, 'bad' AS severity, 'top answer rarely bought' AS what FROM a WHERE items >= 10 AND top1 < 0.6
 UNION ALL SELECT 2, 'warn', 'confused pair ' || best || ' ' || truth FROM (FROM c ORDER BY times DESC, best, truth LIMIT 5) x WHERE times >= 2
 UNION ALL SELECT 3, 'bad', 'weak tier ' || tier FROM (SELECT tier, count(*) AS n, avg(CAST(best = truth AS INT)) AS p FROM hit GROUP BY 1) x WHERE n >= 5 AND p < CASE tier WHEN 'exact' THEN 0.9 WHEN 'likely' THEN 0.7 END
 UNION ALL SELECT 4, 'warn', 'weak category ' || category FROM (SELECT category, count(*) AS n, round(avg(CAST(best = truth AS INT)), 6) AS p FROM hit GROUP BY 1 ORDER BY p, category LIMIT 2) x WHERE n >= 5 AND p < 0.5
 UNION ALL SELECT 5, 'warn', 'weak segment ' || segment FROM (SELECT c_mktsegment AS segment, count(*) AS n, round(avg(CAST(best = truth AS INT)), 6) AS p FROM hit JOIN customer ON c_custkey = user_id GROUP BY 1 ORDER BY p, segment LIMIT 1) x WHERE n >= 10 AND p < 0.5
 UNION ALL SELECT 6, 'info', 'parts of one specification confused' FROM eq WHERE share >= 0.3
 UNION ALL SELECT 7, 'warn', 'searches find nothing' FROM s WHERE searches >= 50 AND no_result >= 0.2
 UNION ALL SELECT 8, 'info', 'strip rarely taken' FROM strip WHERE orders_after_strip >= 30 AND take < 0.2
 UNION ALL SELECT 9, 'warn', 'confidence does not tell right from wrong' FROM a WHERE unsure > sure - 0.05
 UNION ALL SELECT 10, 'warn', 'slow answers' FROM a WHERE p95 > 1500 UNION ALL SELECT 11, 'bad', 'errors' FROM a WHERE errors >= 3
 UNION ALL SELECT 12, 'bad', 'nothing in the list fits' FROM a WHERE identify >= 20 AND none / identify > 0.25
 UNION ALL SELECT 13, 'warn', 'few answers reach the cart' FROM a WHERE identify >= 20 AND carted / identify < 0.3""")
def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen rules with a least support over the report, in fixed order: number, severity and what is wrong.

    Outcomes are counted once, by pair of parts, tier, category, segment and in all; each rule reads its rows of those counts
    or of another one-row report. Ties go to the smaller key. The log is parsed once and written.
    """
    with shared(spark, sf_dir, event_log):
        return _issues(spark, sf_dir)


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, c = event_log(spark, sf_dir), F.col
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(c("c_custkey").alias("user_id"), c("c_mktsegment").alias("segment"))
    ok, sure = c("best") == c("truth"), F.coalesce("confidence", F.lit(0.0))
    named = lambda level, *keys: F.struct(F.lit(level).alias("level"), F.concat_ws(" ", *[c(k).cast("string") for k in keys]).alias("key"), *[c(k).cast("bigint").alias(k) if level == "pair" else F.lit(None).cast("bigint").alias(k) for k in ("best", "truth")])
    levels = F.array(named("all"), *[F.when(c(k).isNotNull(), named(k, k)) for k in ("tier", "category", "segment")], F.when(~ok, named("pair", "best", "truth")))
    each = attributed(log).join(customers, "user_id", "left").select(F.explode(F.filter(levels, lambda x: x.isNotNull())).alias("x"), ok.alias("ok"), sure.alias("sure")).select("x.*", "ok", "sure")
    counted = cut(each.groupBy("level", "key", "best", "truth").agg(F.count("*").alias("n"), share(c("ok")).alias("p"), F.avg(F.when(c("ok"), c("sure"))).alias("sure"), F.avg(F.when(~c("ok"), c("sure"))).alias("unsure")))
    of = lambda level: counted.where(c("level") == level)
    spec = lambda key, name: parts(spark, sf_dir).select(c("part").alias(key), F.concat_ws("|", "brand", "kind", "name", c("size").cast("string")).alias(name))
    same = of("pair").join(spec("best", "s"), "best", "left").join(spec("truth", "t"), "truth", "left").agg((F.sum(F.when(c("s") == c("t"), c("n")).otherwise(0)) / F.sum("n")).alias("share"))
    whole = log.agg(F.count_if(c("event_type") == "view").alias("identify"), F.count_if(c("event_type") == "error").alias("errors"), F.count_if((c("event_type") == "signup") & (c("k") % 9 == 0)).alias("none"), F.countDistinct(F.when(c("event_type") == "click", c("request_id"))).alias("carted"))
    p95 = percentiles(identified(log).withColumn("all", F.lit(1)), "all", "value", {"p95": 0.95})
    rate = lambda name: F.try_divide(c(name), c("identify"))

    def rule(no: int, severity: str, what: str, rows: DataFrame, when: Column, keyed: bool = False) -> DataFrame:
        text = F.concat(F.lit(what + " "), c("key")) if keyed else F.lit(what)
        return rows.where(when).select(F.lit(no).alias("no"), F.lit(severity).alias("severity"), text.alias("what"))

    worst = lambda level, order, n: of(level).orderBy(*order).limit(n)
    category = of("category").withColumn("number", c("key").cast("bigint")).orderBy("p", "number").limit(2)
    rules = [
        rule(1, "bad", "top answer rarely bought", of("all"), (c("n") >= 10) & (c("p") < 0.6)),
        rule(2, "warn", "confused pair", worst("pair", [F.desc("n"), "best", "truth"], 5), c("n") >= 2, keyed=True),
        rule(3, "bad", "weak tier", of("tier"), (c("n") >= 5) & (c("p") < F.when(c("key") == "exact", 0.9).when(c("key") == "likely", 0.7)), keyed=True),
        rule(4, "warn", "weak category", category, (c("n") >= 5) & (c("p") < 0.5), keyed=True),
        rule(5, "warn", "weak segment", worst("segment", ["p", "key"], 1), (c("n") >= 10) & (c("p") < 0.5), keyed=True),
        rule(6, "info", "parts of one specification confused", same, c("share") >= 0.3),
        rule(7, "warn", "searches find nothing", search_funnel(spark, sf_dir), (c("searches") >= 50) & (c("no_result") >= 0.2)),
        rule(8, "info", "strip rarely taken", strip_take(spark, sf_dir), (c("orders_after_strip") >= 30) & (c("take") < 0.2)),
        rule(9, "warn", "confidence does not tell right from wrong", of("all"), c("unsure") > c("sure") - 0.05),
        rule(10, "warn", "slow answers", p95, c("p95") > 1500),
        rule(11, "bad", "errors", whole, c("errors") >= 3),
        rule(12, "bad", "nothing in the list fits", whole, (c("identify") >= 20) & (rate("none") > 0.25)),
        rule(13, "warn", "few answers reach the cart", whole, (c("identify") >= 20) & (rate("carted") < 0.3)),
    ]
    return reduce(DataFrame.unionByName, rules)


@query(f"WITH {SQL_EVENTS} SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS calls FROM log")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user in the six hours up to each call. Every call stands in its own six hours and, to be counted only, in the
    next six, so a task holds twelve hours of a user."""
    six = 6 * 3600 * 1_000_000
    calls = event_log(spark, sf_dir).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).withColumn("own", F.floor(F.col("at") / six))
    calls = calls.withColumn("span", F.explode(F.array("own", F.col("own") + 1)))
    w = W.partitionBy("user_id", "span").orderBy("at").rangeBetween(-six, 0)
    return calls.withColumn("calls", F.count("*").over(w)).where("span = own").select("event_id", "user_id", "calls")


@query(f"""WITH {SQL_EVENTS}, p AS (SELECT event_id, part, row_number() OVER (PARTITION BY part ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY part) AS n FROM log WHERE event_type = 'signup')
 SELECT event_id, part, n >= 2 AND (i = n - 1 OR i % 5 = 4) AS held_out FROM p""")
def feedback_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos held out of each part that has two or more: the last, and every fifth before it. Photos are numbered by ranges of
    part and time (see running), so a part of many photos isn't one task's. Runs a job while the plan is built."""
    p = event_log(spark, sf_dir).where("event_type = 'signup'").select("event_id", "part", F.struct("ts", "event_id").alias("at"), F.lit(1).alias("one"))
    n = p.groupBy(F.col("part").alias("of")).agg(F.count("*").alias("n"))
    placed = running(p, "part", "at", "one").join(n, F.col("part").eqNullSafe(F.col("of")))
    last_or_fifth = (F.col("up_to") == F.col("n")) | (F.col("up_to") % 5 == 0)
    return placed.select("event_id", "part", ((F.col("n") >= 2) & last_or_fifth).alias("held_out"))

"""Composed paths: the search page, the answer with constraints and equivalents, and what carts, labels and reports add to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.customers import boosts, popularity_boosts, recommend
from lodestone.operators.fusion import EXACT_MARGIN, EXACT_P, LEAST_SIM, LIKELY_P, SQL_PROB, TEMPERATURE, fused, rerank_within_tiers, softmax
from lodestone.operators.search import bm25
from lodestone.operators.text_index import sql_hits
from lodestone.operators.vector import SQL_TOP, retrieved
from lodestone.plans.views import SQL_EVENTS, SQL_LINES, SQL_PARTS, answers, bought, event_log, order_lines, parts, table
from lodestone.registry import SQL, query

#: The search report's stated queries, its client and page, and the hits that are re-ranked.
ASKED, CLIENT, LIMIT, OFFSET, RERANKED = ("small ring", "ring", "plate 12", "ate brand#1", "nothing here", "000042", "0001", "brand#1/7"), 7, 12, 2, 50


def search_page(entries: DataFrame, asked: list[str], boost: DataFrame, prefix: tuple[str, ...] = (), limit: int = LIMIT, offset: int = OFFSET, reranked: int = RERANKED, tolerance: float = 0.1) -> DataFrame:
    """(query, part, place): one page of each query's hits.

    entries: part, part_number, path, text, values (words of attribute values). Hits have all phrases of the query (BM25, see
    `search.phrases`); a query without any takes the entries whose text contains it as it stands, all with score -1. Parts
    whose number starts with the query are pinned first, in number order. A value that stands in the query as a whole word lifts a hit by a quarter. The first
    max(limit + offset, reranked) hits are kept, then those outside the path prefix leave, the first `reranked` are put in
    order within tiers of like score by boost (part, boost), and the page is cut out. An empty table gives no rows.
    """
    own = entries.select("part", "part_number", "path", F.lower("text").alias("text"), "values")
    queries = F.array(*map(F.lit, asked))
    found = bm25(own, "part", "text", [q for q in asked if q.strip()])
    plain = own.select("part", F.explode(F.filter(queries, lambda q: F.contains(F.col("text"), F.lower(q)))).alias("query"))
    plain = plain.join(found.select("query").distinct(), "query", "left_anti").select("query", "part", F.lit(-1.0).alias("score"))
    number = own.select(F.explode(F.filter(queries, lambda q: (F.trim(q) != "") & F.startswith(F.upper("part_number"), F.upper(F.trim(q))))).alias("query"), "part", F.lit(-1e9).alias("score"))
    every = found.select("query", "part", F.round("score", 6).alias("score")).unionByName(plain).unionByName(number)
    every = every.groupBy("query", "part").agg(F.min("score").alias("score")).join(own.select("part", "part_number", "path", "values"), "part")
    words = F.concat(F.lit(" "), F.lower("query"), F.lit(" "))
    lifts = F.size(F.filter("values", lambda v: F.contains(words, F.concat(F.lit(" "), v, F.lit(" ")))))
    every = every.withColumn("score", F.when(F.col("score") > -1e8, F.round(F.col("score") * (1 + 0.25 * lifts), 6)).otherwise(F.col("score")))
    first = W.partitionBy("query").orderBy("score", F.when(F.col("score") <= -1e8, F.col("part_number")), "part")
    kept = every.withColumn("r", F.row_number().over(first)).where(F.col("r") <= max(limit + offset, reranked))
    kept = kept.where(F.slice("path", 1, len(prefix)) == F.array(*map(F.lit, prefix))) if prefix else kept
    kept = kept.withColumn("pos", F.row_number().over(first)).join(boost, "part", "left")
    head = rerank_within_tiers(kept.where(F.col("pos") <= reranked).select(F.col("query").alias("query_id"), F.col("part").alias("item"), "score", "boost"), tolerance)
    head = head.select(F.col("query_id").alias("query"), F.col("item").alias("part"), F.col("place").cast("bigint").alias("place"))
    both = head.unionByName(kept.where(F.col("pos") > reranked).select("query", "part", F.col("pos").cast("bigint").alias("place")))
    return both.where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def search_boosts(spark: SparkSession, sf_dir: str, client: int) -> DataFrame:
    """(part, boost): how often all buy a part, and how much its type suits the client."""
    taste = boosts(spark, sf_dir).where(F.col("client") == client).select("kind", F.col("boost").alias("taste"))
    p = parts(spark, sf_dir).select("part", "kind").join(taste, "kind", "left").join(popularity_boosts(spark, sf_dir), "part", "left")
    return p.select("part", F.round(F.coalesce("boost", F.lit(0.0)) + F.coalesce("taste", F.lit(0.0)), 6).alias("boost"))


@query(f"""WITH RECURSIVE {SQL_PARTS}, e AS (SELECT part, kind, size, lower(brand) AS brand, lpad(CAST(part AS VARCHAR), 6, '0') AS number, lower(name || ' ' || brand || ' ' || size) AS text FROM parts),
 {sql_hits(ASKED, "part", "e")},
 q(query) AS (VALUES {", ".join(f"('{q}')" for q in ASKED)}), every AS (SELECT query, part, min(score) AS score FROM (SELECT * FROM found UNION ALL SELECT query, part, -1.0 FROM q, e WHERE contains(text, query) AND query NOT IN (SELECT query FROM found) UNION ALL SELECT query, part, -1e9 FROM q, e WHERE starts_with(number, upper(trim(query)))) x GROUP BY ALL),
 lifted AS (SELECT query, part, kind, CASE WHEN score > -1e8 THEN round(score * (1 + 0.25 * (contains(' ' || query || ' ', ' ' || brand || ' ')::INT + contains(' ' || query || ' ', ' ' || size || ' ')::INT)), 6) ELSE score END AS score FROM every JOIN e USING (part)),
 kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, part) AS r FROM lifted) x WHERE r <= {max(LIMIT + OFFSET, RERANKED)} AND kind = 'ECONOMY'), hits AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, part) AS pos, score <= -1e8 AS pinned FROM kept),
 loose AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, part) AS i FROM hits WHERE NOT pinned), fold AS (SELECT query, part, score, i, 1 AS tier, score AS leader FROM loose WHERE i = 1
  UNION ALL SELECT l.query, l.part, l.score, l.i, CASE WHEN l.score > f.leader * 0.9 THEN f.tier + 1 ELSE f.tier END, CASE WHEN l.score > f.leader * 0.9 THEN l.score ELSE f.leader END FROM fold f JOIN loose l ON l.query = f.query AND l.i = f.i + 1),
 taste AS ({SQL["boosts"]}), popular AS ({SQL["popularity_boosts"]}), boost AS (SELECT part, round(coalesce(p.boost, 0) + coalesce(t.boost, 0), 6) AS boost FROM parts LEFT JOIN popular p USING (part) LEFT JOIN (SELECT kind, boost FROM taste WHERE client = {CLIENT}) t USING (kind)),
 ordered AS (SELECT query, part, row_number() OVER (PARTITION BY query ORDER BY tier, CASE WHEN tier > 0 AND b >= 0.05 THEN b ELSE 0 END DESC, i) AS place FROM (SELECT query, part, tier, i, coalesce(boost, 0) AS b FROM fold LEFT JOIN boost USING (part) UNION ALL SELECT query, part, 0, pos, 0 FROM hits WHERE pinned) x)
 SELECT query, part, place FROM ordered WHERE place > {OFFSET} AND place <= {OFFSET + LIMIT}""")
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each stated query's hits of one type, in the order that suits one client."""
    e = parts(spark, sf_dir).select("part", F.lpad(F.col("part").cast("string"), 6, "0").alias("part_number"), "path", F.concat_ws(" ", "name", "brand", F.col("size").cast("string")).alias("text"), F.array(F.lower("brand"), F.col("size").cast("string")).alias("values"))
    return search_page(e, list(ASKED), search_boosts(spark, sf_dir, CLIENT), ("ECONOMY",))


def answer(candidates: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """The answer of each query: query_id, label, p, twins, tier, unfiltered.

    candidates: query_id, label, spec, score, sim, fits (whether all constraints hold). Candidates that fit stay; where none
    does all stay and `unfiltered` says so. Probabilities are the softmax of the scores; candidates with the specification of
    the best one are its twins: their probability counts for it, 1 at most, and they leave the rest. The tier goes by
    that probability, its margin to the next of the rest, and similarity. An empty table gives no rows.
    """
    every = W.partitionBy("query_id")
    kept = candidates.withColumn("any", F.max("fits").over(every)).where("fits or not any")
    ranked = softmax(kept, "query_id", "score", temperature)
    best = F.max_by(F.struct("label", "spec", "sim"), F.struct("score", "sim", (-F.col("label")).alias("l"))).over(every)
    ranked = ranked.withColumn("best", best).withColumn("twin", F.col("spec") == F.col("best.spec"))
    out = ranked.groupBy("query_id", "best").agg(
        F.least(F.lit(1.0), F.sum(F.when(F.col("twin"), F.col("p")).otherwise(0.0))).alias("p"), F.coalesce(F.max(F.when(~F.col("twin"), F.col("p"))), F.lit(0.0)).alias("next_p"),
        F.array_sort(F.collect_list(F.when(F.col("twin") & (F.col("label") != F.col("best.label")), F.col("label")))).alias("twins"), (~F.first("any")).alias("unfiltered"),
    )
    p = F.col("p")
    tier = F.when(F.col("best.sim") < LEAST_SIM, "unknown").when((p >= EXACT_P) & (p - F.col("next_p") >= EXACT_MARGIN), "exact").when(p >= LIKELY_P, "likely").otherwise("candidate")
    return out.select("query_id", "best.label", "p", "twins", tier.alias("tier"), "unfiltered")


@query(f"""WITH {SQL_PROB}, cand AS (SELECT query_id, label, label % 4 AS spec, score, sim, label % 5 = (query_id // 20) % 7 AS fits FROM fused), k AS (SELECT *, bool_or(fits) OVER (PARTITION BY query_id) AS hit FROM cand QUALIFY fits OR NOT hit),
 e2 AS (SELECT *, exp((score - max(score) OVER w) / {TEMPERATURE}) AS e, first_value(label) OVER o AS best, first_value(spec) OVER o AS best_spec, first_value(sim) OVER o AS best_sim FROM k WINDOW w AS (PARTITION BY query_id), o AS (PARTITION BY query_id ORDER BY score DESC, sim DESC, label)),
 p2 AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS p FROM e2), a AS (SELECT query_id, best AS label, best_sim, least(1.0, sum(p) FILTER (WHERE spec = best_spec)) AS p, coalesce(max(p) FILTER (WHERE spec <> best_spec), 0) AS next_p,
  coalesce(string_agg(CAST(label AS VARCHAR), ' ' ORDER BY label) FILTER (WHERE spec = best_spec AND label <> best), '') AS twins, NOT bool_or(hit) AS unfiltered FROM p2 GROUP BY ALL)
 SELECT query_id, label, round(p, 5) AS p, twins, CASE WHEN best_sim < {LEAST_SIM} THEN 'unknown' WHEN p >= {EXACT_P} AND p - next_p >= {EXACT_MARGIN} THEN 'exact' WHEN p >= {LIKELY_P} THEN 'likely' ELSE 'candidate' END AS tier, unfiltered FROM a""")
def answer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of every stated query under a constraint, with its twins."""
    fits = F.col("label") % 5 == F.floor(F.col("query_id") / 20) % 7
    c = fused(spark, sf_dir).select("query_id", "label", (F.col("label") % 4).alias("spec"), "score", "sim", fits.alias("fits"))
    return answer(c).select("query_id", "label", F.round("p", 5).alias("p"), F.array_join(F.transform("twins", lambda t: t.cast("string")), " ").alias("twins"), "tier", "unfiltered")


@query(f"""WITH {SQL_EVENTS}, {SQL_PARTS}, c AS (SELECT best, truth, count(*) AS times FROM hit WHERE best <> truth GROUP BY ALL), j AS (SELECT best, truth, times, concat_ws(' ', CASE WHEN p.brand <> t.brand THEN 'brand' END, CASE WHEN p.kind <> t.kind THEN 'category' END, CASE WHEN p.name <> t.name THEN 'name' END, CASE WHEN p.size <> t.size THEN 'size' END) AS differ_by, p.family = t.family AS same_family FROM c JOIN parts p ON p.part = best JOIN parts t ON t.part = truth)
 SELECT best AS predicted, truth, times, differ_by, same_family AND differ_by = '' AS equivalent, round(sum(CASE WHEN same_family AND differ_by = '' THEN times ELSE 0 END) OVER () / (SELECT sum(times) FROM c), 6) AS equivalent_share FROM j""")
def confusion_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confused pairs with what tells the two parts apart, and the share of confusions between parts of one specification."""
    hit = bought(event_log(spark, sf_dir)).select("request_id", F.col("part").alias("truth")).join(answers(event_log(spark, sf_dir)).select("request_id", F.col("part").alias("predicted")), "request_id")
    c = hit.where("predicted <> truth").groupBy("predicted", "truth").agg(F.count("*").alias("times"))
    total = c.agg(F.sum("times").alias("total"))
    side = lambda key, name: parts(spark, sf_dir).select(F.col("part").alias(key), F.struct("brand", F.col("kind").alias("category"), "name", "size").alias(name))
    j = c.join(side("predicted", "p"), "predicted").join(side("truth", "t"), "truth")
    j = j.withColumn("differ_by", F.concat_ws(" ", *[F.when(F.col(f"p.{k}") != F.col(f"t.{k}"), k) for k in ("brand", "category", "name", "size")]))
    j = j.withColumn("equivalent", F.col("differ_by") == "")
    same = j.agg(F.sum(F.when(F.col("equivalent"), F.col("times")).otherwise(0)).alias("same"))
    share = F.round(F.col("same") / F.col("total"), 6)
    return j.join(F.broadcast(same)).join(F.broadcast(total)).select("predicted", "truth", "times", "differ_by", "equivalent", share.alias("equivalent_share"))  # one row each


@query(f"""WITH {SQL_EVENTS} SELECT c.event_id, a.request_id, c.part, nullif(list_position([a.part, (a.part + 1) % 10, (a.part + 3) % 10], c.part), 0) AS rank, CASE WHEN a.part = c.part THEN a.confidence END AS confidence FROM log c LEFT JOIN answer a USING (request_id) WHERE c.event_type = 'click'""")
def cart_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cart adds with the place of the part among the answer's candidates, its confidence where it was the best, and no request where it isn't known."""
    log = event_log(spark, sf_dir)
    a = answers(log).select(F.col("request_id").alias("asked"), F.col("part").alias("best"), "confidence")
    c = log.where("event_type = 'click'").select("event_id", "request_id", "part").join(a, F.col("request_id") == F.col("asked"), "left")
    rank = F.nullif(F.array_position(F.array("best", (F.col("best") + 1) % 10, (F.col("best") + 3) % 10), F.col("part")), F.lit(0))
    return c.select("event_id", F.col("asked").alias("request_id"), "part", rank.alias("rank"), F.when(F.col("best") == F.col("part"), F.col("confidence")).alias("confidence"))


@query(f"""WITH {SQL_EVENTS}, n AS (SELECT request_id, count(DISTINCT part) AS parts FROM log WHERE event_type IN ('click', 'purchase') GROUP BY 1)
 SELECT e.event_id, e.part, CASE e.event_type WHEN 'purchase' THEN 'checkout' ELSE 'cart' END AS source FROM log e JOIN n USING (request_id) JOIN answer USING (request_id) WHERE e.event_type IN ('click', 'purchase') AND parts = 1""")
def label_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cart adds and checkouts that confirm a photo: those of a known request with one part only."""
    log = event_log(spark, sf_dir)
    e = log.where("event_type in ('click', 'purchase')")
    clear = e.groupBy("request_id").agg(F.countDistinct("part").alias("parts")).where("parts = 1").join(answers(log), "request_id", "left_semi")
    return e.join(clear, "request_id", "left_semi").select("event_id", "part", F.when(F.col("event_type") == "purchase", "checkout").otherwise("cart").alias("source"))


@query(f"""WITH {SQL_LINES}, o AS (SELECT client, count(DISTINCT order_id) AS orders, CAST(sum(quantity) AS BIGINT) AS items FROM lines GROUP BY 1), b AS (SELECT client, brand FROM (SELECT client, brand, count(*) AS n FROM lines WHERE brand IS NOT NULL GROUP BY ALL) x QUALIFY row_number() OVER (PARTITION BY client ORDER BY n DESC, brand) = 1)
 SELECT client, c_mktsegment AS segment, orders, items, brand, round(least(1.0, orders / 5.0), 6) AS weight FROM o JOIN customer ON c_custkey = client LEFT JOIN b USING (client)""")
def client_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client's own page says: segment, orders, usual brand and how much the history weighs."""
    lines = order_lines(spark, sf_dir)
    o = lines.groupBy("client").agg(F.countDistinct("order_id").alias("orders"), F.sum("quantity").alias("items"))
    b = lines.where("brand is not null").groupBy("client", "brand").agg(F.count("*").alias("n")).groupBy("client").agg(F.min(F.struct((-F.col("n")).alias("m"), "brand")).alias("b")).select("client", "b.brand")
    segment = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client"), F.col("c_mktsegment").alias("segment"))
    return o.join(segment, "client").join(b, "client", "left").select("client", "segment", "orders", "items", "brand", F.round(F.least(F.lit(1.0), F.col("orders") / 5.0), 6).alias("weight"))


@query(f"""WITH {SQL_PARTS}, m AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY family ORDER BY part) <= 40), n AS (SELECT family, count(DISTINCT brand) > 1 AS brands, count(DISTINCT size) > 1 AS sizes, count(*) AS members FROM m GROUP BY 1)
 SELECT part, family, CASE WHEN brands THEN brand END AS brand, CASE WHEN sizes THEN size END AS size, members FROM m JOIN n USING (family)""")
def family_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to forty look-alikes of each family with the attributes that tell them apart, null where all agree."""
    m = parts(spark, sf_dir).withColumn("r", F.row_number().over(W.partitionBy("family").orderBy("part"))).where("r <= 40")
    n = m.groupBy("family").agg((F.countDistinct("brand") > 1).alias("brands"), (F.countDistinct("size") > 1).alias("sizes"), F.count("*").alias("members"))
    return m.join(n, "family").select("part", "family", F.when(F.col("brands"), F.col("brand")).alias("brand"), F.when(F.col("sizes"), F.col("size")).alias("size"), "members")


@query(f"""WITH {SQL_EVENTS}, {SQL_PARTS} SELECT event_id, part FROM log WHERE event_type = 'signup' AND part IN (SELECT part FROM parts) AND request_id NOT IN (SELECT request_id FROM log WHERE event_type = 'click')""")
def fresh_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled photos of catalog parts that haven't been learned: a semi join and an anti join."""
    log = event_log(spark, sf_dir)
    learned = log.where("event_type = 'click'").select("request_id")
    return log.where("event_type = 'signup'").join(parts(spark, sf_dir).select("part"), "part", "left_semi").join(learned, "request_id", "left_anti").select("event_id", "part")


@query(f"""WITH {SQL_EVENTS}, f AS (SELECT * FROM log WHERE event_type IN ('signup', 'purchase') AND part <> 0), m AS (SELECT quantile_disc(ts, 0.5) AS learned_at, min(ts) + INTERVAL 2 DAY AS retrained_at FROM f)
 SELECT count(*) FILTER (WHERE ts > retrained_at) AS since_retrain, count(*) FILTER (WHERE ts > retrained_at) >= 50 AS retrain_due, count(*) FILTER (WHERE ts > retrained_at AND event_type = 'purchase') AS new_purchases FROM f, m""")
def learning_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmations since the last training and whether another is due: fifty of them."""
    f = event_log(spark, sf_dir).where("event_type in ('signup', 'purchase') and part <> 0")
    m = f.agg((F.min("ts") + F.expr("interval 2 days")).alias("retrained_at"))
    late = F.col("ts") > F.col("retrained_at")
    return f.join(F.broadcast(m)).agg(F.count_if(late).alias("since_retrain"), (F.count_if(late) >= 50).alias("retrain_due"), F.count_if(late & (F.col("event_type") == "purchase")).alias("new_purchases"))  # m is one row


@query(f"WITH {SQL_PARTS} SELECT part, family FROM parts QUALIFY row_number() OVER (PARTITION BY family ORDER BY sha1('17:' || part), part) = 1")
def one_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part of each family, drawn by a seeded hash; a partial aggregate, so a large family is one row a task."""
    draw = F.struct(F.sha1(F.concat(F.lit("17:"), F.col("part").cast("string"))).alias("h"), "part")
    return parts(spark, sf_dir).groupBy("family").agg(F.min_by("part", draw).alias("part")).select("part", "family")


@query("SELECT o_orderkey AS order_id, o_custkey AS client, o_orderdate AS placed_at FROM orders WHERE o_custkey % 10 = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty newest orders of some clients: each task's newest first, then those of all."""
    o = table(spark, sf_dir, "orders").where("o_custkey % 10 = 7").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("client"), F.col("o_orderdate").alias("placed_at"))
    return o.orderBy(F.desc("placed_at"), F.desc("order_id")).limit(50)


@query(f"""WITH {SQL_LINES}, b AS (SELECT client, order_id, min(placed_at) AS placed_at, list_sort(list(DISTINCT family) FILTER (WHERE family IS NOT NULL)) AS now FROM lines GROUP BY ALL), p AS (SELECT *, lag(now) OVER (PARTITION BY client ORDER BY placed_at, order_id) AS prev FROM b)
 SELECT client, order_id, len(list_filter(coalesce(now, []), lambda x: list_contains(coalesce(prev, []), x))) AS again, len(list_filter(coalesce(now, []), lambda x: NOT list_contains(coalesce(prev, []), x))) AS new FROM p""")
def repeated_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order, how many families the client's order before had, and how many it hadn't."""
    none = F.array().cast("array<string>")
    b = order_lines(spark, sf_dir).groupBy("client", "order_id").agg(F.min("placed_at").alias("placed_at"), F.collect_set("family").alias("now"))
    prev = F.coalesce(F.lag("now").over(W.partitionBy("client").orderBy("placed_at", "order_id")), none)
    p = b.withColumn("prev", prev)
    return p.select("client", "order_id", F.size(F.array_intersect("now", "prev")).cast("bigint").alias("again"), F.size(F.array_except("now", "prev")).cast("bigint").alias("new"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN 'not a time' END AS said, ts FROM events)
 SELECT event_id, CASE WHEN event_id % 4 < 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at, CASE WHEN event_id % 4 < 2 THEN date_trunc('second', ts) < TIMESTAMP '2024-01-10 00:00:00' END AS stale FROM s""")
def stated_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times read from texts with or without a Z, null where they are none, and whether they are before a limit."""
    form = F.col("event_id") % 4
    said = F.when(form == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(form == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(form == 2, "not a time")
    at = F.try_to_timestamp(said)
    return table(spark, sf_dir, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"), (at < F.lit("2024-01-10 00:00:00").cast("timestamp")).alias("stale"))


@query(f"WITH r AS ({SQL['recommend']}) SELECT CASE WHEN why IN ('complement', 'segment', 'aisle', 'popular') THEN why ELSE 'own history' END AS reason, count(*) AS n FROM r GROUP BY 1")
def recommendation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations by the kind of their reason."""
    kind = F.when(F.col("why").isin("complement", "segment", "aisle", "popular"), F.col("why")).otherwise("own history")
    return recommend(spark, sf_dir).groupBy(kind.alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {SQL_TOP}, q2 AS (SELECT query_id, coalesce(min(place) FILTER (WHERE label = query_label), 0) AS first_right FROM top WHERE place <= 10 GROUP BY 1) SELECT query_id, first_right FROM q2 ORDER BY first_right <> 0, first_right DESC, query_id LIMIT 20")
def hardest_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty queries that retrieval serves worst: those without a right answer, then those where it comes late."""
    right = F.coalesce(F.min(F.when(F.col("label") == F.col("query_label"), F.col("place"))), F.lit(0))
    q = retrieved(spark, sf_dir, 10).groupBy("query_id").agg(right.alias("first_right"))
    return q.orderBy(F.col("first_right") != 0, F.desc("first_right"), "query_id").limit(20)

"""Replay of recommendations with what was known before each round, and what segments hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.plans.scratch import cut, dealt
from lodestone.plans.views import SQL_LINES, order_lines
from lodestone.registry import query

#: Places of a recommendation, and companions of a family that it looks at.
PLACES, COMPANIONS = 6, 6
#: Baskets' rows of a task that makes the rounds of its clients of them.
BASKETS = 100_000
#: Parts that a segment's summary lists.
FAVOURITES = 40


def as_of(counts: DataFrame, keys: list[str], last: Column | None = None) -> DataFrame:
    """(keys, round, n): of counts (keys, round, n, and `last` where that is a column of it) the sum over all rounds before each round, up
    to round `last`; only rounds that have one before them. One running sum over the rounds that occur, each standing until the next, so
    no round needs a job or a pass of its own."""
    w = W.partitionBy(*keys).orderBy("round")
    upto = F.coalesce(F.lead("round").over(w), last)
    own = counts.withColumns({"n": F.sum("n").over(w), "to": upto})
    return own.where(F.col("to") > F.col("round")).select(*keys, F.explode(F.sequence(F.col("round") + 1, F.col("to"))).alias("round"), "n")


def replayed(lines: DataFrame) -> DataFrame:
    """(round, orders, hits, new_hits): how many of the clients' k-th orders hold a family that was among the PLACES recommended for them,
    and how many one that the client hadn't bought before.

    lines: client, order_id, placed_at, family. What is recommended for round k comes from rounds before k of all clients: the
    client's own families (1 and a tenth of the lines), the COMPANIONS that stood most often in one order with a family of
    the client's last order (0.4 and up to 0.1 by that number), and the PLACES most bought families (up to 0.1).
    A family has the best of its scores; ties go by name. Lines without family count as orders only. Other reasons are looked for
    only where a client has fewer than PLACES families of their own.
    """
    numbered = lines.withColumn("round", F.dense_rank().over(W.partitionBy("client").orderBy("placed_at", "order_id")).cast("bigint"))
    baskets = cut(numbered.groupBy("client", "round", "family").agg(F.count("*").alias("n")))  # orders without family too, as null
    end = baskets.agg(F.max("round").alias("end"))
    named = baskets.where("family is not null")
    parted = dealt(named.where("client is not null"), BASKETS, "client")

    bought = as_of(named.groupBy("family", "round").agg(F.sum("n").alias("n")).join(F.broadcast(end)), ["family"], F.col("end"))  # one row
    top = F.row_number().over(W.partitionBy("round").orderBy(F.desc("n"), "family"))
    popular = cut(bought.withColumn("r", top).where(F.col("r") <= PLACES).select("round", "family", (0.1 * F.least(F.lit(1.0), F.col("n") / 50)).alias("score")))

    together = parted.groupBy("client", "round").agg(F.collect_list("family").alias("p"))  # an order's families
    pairs = together.select("round", "p", F.explode("p").alias("family")).select("round", "family", F.explode("p").alias("companion")).where("family <> companion")
    met = as_of(pairs.groupBy("family", "companion", "round").agg(F.count("*").alias("n")).join(F.broadcast(end)), ["family", "companion"], F.col("end"))  # one row
    near = F.row_number().over(W.partitionBy("family", "round").orderBy(F.desc("n"), "companion"))
    met = cut(met.withColumn("r", near).where(F.col("r") <= COMPANIONS))

    open_ = cut(_own(parted))
    short = open_.where(F.col("owns") < PLACES)
    along = short.where("latest").join(met, ["family", "round"]).select("client", "round", F.col("companion").alias("family"), (0.4 + F.least(F.col("n"), F.lit(5)) / 50).alias("score"))
    usual = short.select("client", "round").distinct().join(popular, "round").select("client", "round", "family", "score")
    scored = short.select("client", "round", "family", "score", "bought", "new").unionByName(along.unionByName(usual), allowMissingColumns=True)
    scored = scored.groupBy("client", "round", "family").agg(F.round(F.max("score"), 9).alias("score"), F.max("bought").alias("bought"), F.max("new").alias("new")).where("score is not null")
    shown = scored.withColumn("r", F.row_number().over(W.partitionBy("client", "round").orderBy(F.desc("score"), "family"))).where(F.col("r") <= PLACES)
    hit = shown.unionByName(open_.where(F.col("owns") >= PLACES), allowMissingColumns=True).where("bought").groupBy("client", "round").agg(F.max("new").alias("new"))
    orders = baskets.select("client", "round").distinct().groupBy("round").agg(F.count("*").alias("orders"))
    hits = hit.groupBy("round").agg(F.count("*").alias("hits"), F.count_if("new").alias("new_hits"))
    return orders.join(hits, "round", "left").select("round", "orders", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "new_hits")])


def _own(baskets: DataFrame) -> DataFrame:
    """(client, round, family, bought, new, latest, score, owns) of baskets dealt by client: what is bought in a round, and the client's own
    families before it with their score and whether they are of the last order. Own families have the best scores, so rounds that know PLACES
    of them (owns) show these only, and only bought ones among these are kept; of other rounds after the first, all rows. A round's rows
    are made, sorted and dropped in the task that has its client."""
    w = W.partitionBy("client", "family").orderBy("round")
    to = F.coalesce(F.lead("round").over(w), F.max("round").over(W.partitionBy("client")))
    b = baskets.withColumns({"n": F.sum("n").over(w), "to": to, "first": F.min("round").over(W.partitionBy("client", "family"))})
    said = F.array(F.struct(F.col("round"), F.lit(True).alias("bought"), (F.col("first") == F.col("round")).alias("new"), F.lit(False).alias("latest"), F.lit(None).cast("double").alias("score")))
    later = lambda r: F.struct(r.alias("round"), F.lit(False).alias("bought"), F.lit(False).alias("new"), (r == F.col("round") + 1).alias("latest"), (1 + F.col("n") / 10).alias("score"))
    known = F.when(F.col("to") > F.col("round"), F.transform(F.sequence(F.col("round") + 1, F.col("to")), later)).otherwise(F.slice(F.transform(F.array("round"), later), 1, 0))
    rows = b.select("client", "family", F.inline(F.concat(said, known)))
    rows = rows.groupBy("client", "round", "family").agg(*[F.max(c).alias(c) for c in ("bought", "new", "latest", "score")])
    best = W.partitionBy("client", "round").orderBy(F.desc_nulls_last("score"), "family")
    rows = rows.withColumns({"r": F.row_number().over(best), "owns": F.count("score").over(best.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    return rows.where(F.when(F.col("owns") < PLACES, F.col("round") > 1).otherwise(F.col("bought") & (F.col("r") <= PLACES) & F.col("score").isNotNull())).drop("r")


@query(f"""WITH {SQL_LINES}, o AS (SELECT DISTINCT client, order_id, placed_at FROM lines), r AS (SELECT client, order_id, row_number() OVER (PARTITION BY client ORDER BY placed_at, order_id) AS round FROM o),
 b AS (SELECT client, round, family, count(*) AS n FROM lines JOIN r USING (client, order_id) WHERE family IS NOT NULL GROUP BY ALL), k AS (SELECT DISTINCT round FROM r),
 own AS (SELECT r.client, r.round, b.family, 1 + sum(b.n) / 10.0 AS score FROM r JOIN b ON b.client = r.client AND b.round < r.round GROUP BY ALL),
 pop AS (SELECT k.round, family, 0.1 * least(1.0, sum(n) / 50.0) AS score FROM k JOIN b ON b.round < k.round GROUP BY k.round, family QUALIFY row_number() OVER (PARTITION BY k.round ORDER BY sum(n) DESC, family) <= {PLACES}),
 p AS (SELECT x.family, y.family AS companion, x.round, count(*) AS n FROM b x JOIN b y ON x.client = y.client AND x.round = y.round AND x.family <> y.family GROUP BY ALL),
 met AS (SELECT k.round, family, companion, sum(n) AS n FROM k JOIN p ON p.round < k.round GROUP BY k.round, family, companion QUALIFY row_number() OVER (PARTITION BY k.round, family ORDER BY sum(n) DESC, companion) <= {COMPANIONS}),
 along AS (SELECT r.client, r.round, met.companion AS family, 0.4 + least(met.n, 5) / 50.0 AS score FROM r JOIN b ON b.client = r.client AND b.round = r.round - 1 JOIN met ON met.round = r.round AND met.family = b.family),
 s AS (SELECT client, round, family, round(max(score), 9) AS score FROM (SELECT * FROM own UNION ALL SELECT * FROM along UNION ALL SELECT r.client, r.round, pop.family, pop.score FROM r JOIN pop USING (round)) x GROUP BY ALL),
 shown AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY client, round ORDER BY score DESC, family) <= {PLACES}), f AS (SELECT client, family, min(round) AS first FROM b GROUP BY ALL),
 hit AS (SELECT client, round, bool_or(first = round) AS new FROM shown JOIN b USING (client, round, family) JOIN f USING (client, family) GROUP BY ALL)
 SELECT round, count(*) AS orders, count(new) AS hits, count(*) FILTER (WHERE new) AS new_hits FROM r LEFT JOIN hit USING (client, round) GROUP BY round""")
def replayed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of recommendations by round, each from what came before it."""
    return replayed(order_lines(spark, sf_dir))


def segment_summaries(lines: DataFrame, assigned: DataFrame) -> DataFrame:
    """(segment, clients, orders, label, shares, favourites): each segment's clients and orders, its two largest types as a name, what share
    of its lines each type has, and its FAVOURITES parts of most lines.

    lines: client, order_id, part, kind; assigned: client, segment. Clients without lines count. Lines are counted by segment,
    type and part once; lists are of types and of FAVOURITES parts, not of lines.
    """
    met = lines.join(assigned, "client")
    counted = cut(met.groupBy("segment", "kind", "part").agg(F.count("*").alias("n")))
    kinds = counted.where("kind is not null").groupBy("segment", "kind").agg(F.sum("n").alias("n"))
    whole = kinds.groupBy("segment").agg(F.sum("n").alias("whole"))
    listed = kinds.join(whole, "segment").groupBy("segment").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "kind", F.round(F.col("n") / F.col("whole"), 4).alias("share")))).alias("k"))
    place = F.row_number().over(W.partitionBy("segment").orderBy(F.desc("n"), "part"))
    best = counted.groupBy("segment", "part").agg(F.sum("n").alias("n")).withColumn("place", place).where(F.col("place") <= FAVOURITES)
    best = best.groupBy("segment").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]).alias("favourites"))
    sizes = assigned.groupBy("segment").agg(F.count_distinct("client").alias("clients"))
    orders = met.groupBy("segment").agg(F.count_distinct("order_id").alias("orders"))
    out = sizes.join(orders, "segment", "left").join(listed, "segment", "left").join(best, "segment", "left")
    label = F.array_join(F.transform(F.slice("k", 1, 2), lambda x: x["kind"]), " + ")
    shares = F.transform("k", lambda x: F.concat_ws(":", x["kind"], x["share"].cast("string")))
    return out.select("segment", "clients", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce(label, F.lit("")).alias("label"), F.coalesce(F.array_join(shares, ","), F.lit("")).alias("shares"), F.coalesce("favourites", F.array().cast("array<bigint>")).alias("favourites"))


def purity(assigned: DataFrame, known: DataFrame) -> DataFrame:
    """(clients, purity): over clients of both tables, how many fall in the known class that is largest in their segment, as a share; null for
    no clients. assigned: client, segment; known: client, class."""
    n = assigned.join(known, "client").groupBy("segment", "class").agg(F.count("*").alias("n"))
    each = n.groupBy("segment").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("clients"), F.round(F.try_divide(F.sum("most"), F.sum("n")), 6).alias("purity"))


_SQL_SEGMENT = f"{SQL_LINES}, seg AS (SELECT c_custkey AS client, c_mktsegment AS segment FROM customer)"


@query(f"""WITH {_SQL_SEGMENT}, m AS (SELECT * FROM lines JOIN seg USING (client)), k AS (SELECT segment, kind, count(*) AS n FROM m WHERE kind IS NOT NULL GROUP BY ALL), w AS (SELECT *, round(n / sum(n) OVER (PARTITION BY segment), 4) AS share FROM k),
 p AS (SELECT segment, part, count(*) AS n FROM m GROUP BY segment, part QUALIFY row_number() OVER (PARTITION BY segment ORDER BY n DESC, part) <= {FAVOURITES})
 SELECT segment, (SELECT count(*) FROM seg s WHERE s.segment = o.segment) AS clients, (SELECT count(DISTINCT order_id) FROM m WHERE m.segment = o.segment) AS orders, (SELECT array_to_string(list(kind ORDER BY n DESC, kind)[:2], ' + ') FROM k WHERE k.segment = o.segment) AS label,
  (SELECT list(share ORDER BY n DESC, kind)[1] FROM w WHERE w.segment = o.segment) AS top_share, (SELECT array_to_string(list(part ORDER BY n DESC, part), ',') FROM p WHERE p.segment = o.segment) AS favourites FROM (SELECT DISTINCT segment FROM seg) o""")
def segment_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the customers' segments hold."""
    assigned = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("client"), F.col("c_mktsegment").alias("segment"))
    found = segment_summaries(order_lines(spark, sf_dir), assigned)
    share = F.split(F.get(F.split("shares", ","), F.lit(0)), ":")
    return found.select("segment", "clients", "orders", "label", F.get(share, F.lit(1)).cast("double").alias("top_share"), F.array_join(F.col("favourites").cast("array<string>"), ",").alias("favourites"))


@query(f"""WITH {_SQL_SEGMENT}, t AS (SELECT client, kind, count(*) AS n FROM lines WHERE kind IS NOT NULL GROUP BY client, kind QUALIFY row_number() OVER (PARTITION BY client ORDER BY n DESC, kind) = 1), c AS (SELECT kind AS segment, segment AS class, count(*) AS n FROM t JOIN seg USING (client) GROUP BY ALL)
 SELECT CAST(sum(n) AS BIGINT) AS clients, round(sum(most) / sum(n), 6) AS purity FROM (SELECT segment, max(n) AS most, sum(n) AS n FROM c GROUP BY 1) x""")
def taste_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well clients' favourite types tell their market segment."""
    n = order_lines(spark, sf_dir).where("kind is not null").groupBy("client", "kind").agg(F.count("*").alias("n"))
    first = W.partitionBy("client").orderBy(F.desc("n"), "kind")
    taste = n.withColumn("r", F.row_number().over(first)).where("r = 1").select("client", F.col("kind").alias("segment"))
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("client"), F.col("c_mktsegment").alias("class"))
    return purity(taste, known)

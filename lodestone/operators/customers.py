"""Customer operators over order lines: histograms, co-purchase, re-orders, priors, boosts, recommendations, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.numeric import ratio
from lodestone.functions.text import once
from lodestone.plans.scratch import cut, dealt
from lodestone.plans.views import LINES, SQL_LINES, SQL_PARTS, client_lines, order_lines, parts, shared, table
from lodestone.registry import query

#: Fixed value: an order's first so many families, in order of name, make the pairs of `copurchase_pairs` and the complements of `recommend`.
PAIR_CAP = 40
#: Lines of an order that is one row when all its pairs are made, and families of about one block of a longer one.
BLOCK = 128


@query(f"""WITH {SQL_LINES} SELECT client, dim, key, count(*) AS n FROM (SELECT client, unnest(['kind', 'brand', 'family', 'size']) AS dim, unnest([kind, brand, family, CAST(size AS VARCHAR)]) AS key FROM lines) x
 WHERE key IS NOT NULL GROUP BY ALL""")
def customer_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of each client in long form: one aggregate for all dimensions."""
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key")) for d in ("kind", "brand", "family", "size")])
    return order_lines(spark, sf_dir).select("client", F.explode(dims).alias("x")).where("x.key is not null").groupBy("client", "x.dim", "x.key").agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_LINES} SELECT client, min(placed_at) AS first_at, max(placed_at) AS last_at, count(DISTINCT order_id) AS orders, CAST(sum(quantity) AS BIGINT) AS items,
 arg_max(order_id, struct_pack(placed_at := placed_at, order_id := order_id)) AS recent FROM lines GROUP BY client""")
def customer_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last and latest order of each client."""
    return order_lines(spark, sf_dir).groupBy("client").agg(F.min("placed_at").alias("first_at"), F.max("placed_at").alias("last_at"), F.countDistinct("order_id").alias("orders"), F.sum("quantity").alias("items"), F.max_by("order_id", F.struct("placed_at", "order_id")).alias("recent"))


_SQL_BASKET = "SELECT DISTINCT order_id, client, family AS part FROM lines WHERE family IS NOT NULL"


def _sql_pairs(basket: str) -> str:
    return f"""basket AS ({basket}),
pairs AS (SELECT a.part AS a, b.part AS b, count(DISTINCT a.order_id) AS orders, count(DISTINCT a.client) AS clients FROM basket a JOIN basket b ON a.order_id = b.order_id AND a.part < b.part GROUP BY ALL)"""


SQL_PAIRS = _sql_pairs(f"SELECT * FROM ({_SQL_BASKET}) x QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY part) <= {PAIR_CAP}")


def _pairs_within(p: Column) -> Column:
    """Pairs of the names of a sorted array."""
    return F.flatten(F.transform(p, lambda a, i: F.transform(F.slice(p, i + 2, F.size(p)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and clients of each pair of families bought together. The basket of an order is one row of at most PAIR_CAP
    names, so pairs are made within rows and no order is joined with itself, and counted in the task that has the client."""
    lines = client_lines(spark, sf_dir, "order_id", "family").where("family is not null")
    basket = lines.groupBy("order_id", "client").agg(F.slice(F.array_sort(F.collect_set("family")), 1, PAIR_CAP).alias("p"))
    each = basket.select("order_id", "client", F.explode(_pairs_within(F.col("p"))).alias("x")).groupBy("x.a", "x.b", "client").agg(F.count("*").alias("n"))
    return each.groupBy("a", "b").agg(F.sum("n").alias("orders"), F.count("*").alias("clients"))


@query(f"WITH {SQL_LINES}, {SQL_PAIRS} SELECT a, b, orders, clients FROM pairs WHERE orders >= 2 AND clients >= 2")
def copurchase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with two orders and two clients at least."""
    return pair_counts(spark, sf_dir).where("orders >= 2 and clients >= 2")


def sized_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(long, orders): a row for each order of more than BLOCK lines, and one without its key for the number of all others with lines. Runs a job."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.count("*").alias("n"))
    known = n.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id")), "order_id", "left_semi")
    return cut(known.groupBy(F.when(F.col("n") > BLOCK, F.col("order_id")).alias("long")).agg(F.count("*").alias("orders")))


def all_pairs(spark: SparkSession, sf_dir: str, sized: DataFrame) -> DataFrame:
    """(a, b, orders, first, last): orders of each pair of families bought together, of whole orders, and the smallest and largest of their clients.

    An order of at most BLOCK lines is a row, in which its pairs are made. A longer one (see sized_orders) is dealt into blocks by a hash of the
    family, and every two of them, and each with itself, are a row, dealt over the tasks; no row or task has all pairs of it, which are as many
    as half the square of its families. Runs jobs.
    """
    lines = order_lines(spark, sf_dir).select("order_id", "client", "family").where("family is not null")
    item, long = table(spark, sf_dir, "lineitem"), sized.where("long is not null").select(F.col("long").alias("order_id"))
    some = long.limit(1).count() > 0
    clients = lambda a, b: (F.min(a).alias("first"), F.max(b).alias("last"))
    basket = dealt(lines.join(long, "order_id", "left_anti") if some else lines, LINES, "order_id", of=item).groupBy("order_id").agg(F.array_sort(F.collect_set("family")).alias("p"), *clients("client", "client"))
    each = basket.select("first", "last", F.inline(_pairs_within(F.col("p"))))
    if some:
        each = each.unionByName(_pairs_of_blocks(lines.join(long, "order_id", "left_semi").groupBy("order_id", "family").agg(*clients("client", "client"))))
    return each.groupBy("a", "b").agg(F.count("*").alias("orders"), *clients("first", "last"))


def _pairs_of_blocks(names: DataFrame) -> DataFrame:
    """names (order_id, family, first, last) -> first, last, a, b for every two families of an order. Runs jobs."""
    names = cut(names)
    blocks = names.groupBy("order_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = names.join(blocks, "order_id").withColumn("own", F.pmod(F.xxhash64("family"), "blocks"))
    met = own.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    met = dealt(met, LINES // 16, "order_id", "i", "j").groupBy("order_id", "i", "j").agg(  # a row of these is met by half a block
        F.min("first").alias("first"), F.max("last").alias("last"), *[F.collect_list(F.when(F.col("own") == F.col(k), F.col("family"))).alias(f"of_{k}") for k in ("i", "j")]
    )
    others = lambda a: F.filter("of_j", lambda b: (F.col("i") < F.col("j")) | (a < b))
    return met.select("first", "last", F.inline(F.flatten(F.transform("of_i", lambda a: F.transform(others(a), lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))))))


def _sql_lift(pairs: str) -> str:
    return f"""WITH {SQL_LINES}, {pairs}, cnt AS (SELECT family AS part, count(*) AS n FROM lines WHERE family IS NOT NULL GROUP BY 1), total AS (SELECT count(DISTINCT order_id) AS orders FROM lines),
 twoway AS (SELECT a AS part, b AS other, orders FROM pairs WHERE orders >= 2 AND clients >= 2 UNION ALL SELECT b, a, orders FROM pairs WHERE orders >= 2 AND clients >= 2)
 SELECT part, other, round(twoway.orders / (x.n * y.n / total.orders), 6) AS lift FROM twoway JOIN cnt x USING (part) JOIN cnt y ON y.part = other, total
 QUALIFY row_number() OVER (PARTITION BY part ORDER BY round(twoway.orders / (x.n * y.n / total.orders), 6) DESC, other) <= 5"""


def _strongest(lines: DataFrame, kept: DataFrame, total: DataFrame) -> DataFrame:
    """The five strongest complements of each family by lift over pairs (a, b, orders); total is one row, the number of orders."""
    counts = lines.where("family is not null").groupBy(F.col("family").alias("part")).agg(F.count("*").alias("n"))
    both = kept.select(F.explode(F.array(F.struct(F.col("a").alias("part"), F.col("b").alias("other")), F.struct(F.col("b").alias("part"), F.col("a").alias("other")))).alias("x"), "orders").select("x.*", "orders")
    lift = F.round(F.col("orders") / (F.col("n") * F.col("m") / F.col("total")), 6)
    both = both.join(counts, "part").join(counts.select(F.col("part").alias("other"), F.col("n").alias("m")), "other").join(F.broadcast(total)).select("part", "other", lift.alias("lift"))  # total is one row
    return both.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy(F.desc("lift"), "other"))).where("r <= 5").drop("r")


@query(_sql_lift(_sql_pairs(_SQL_BASKET)))
def complements_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest complements of each family by lift, over pairs of whole orders with two orders and two clients at least; counts are of order lines."""
    sized = sized_orders(spark, sf_dir)
    kept = all_pairs(spark, sf_dir, sized).where("orders >= 2 and first < last")
    return _strongest(order_lines(spark, sf_dir), kept, sized.agg(F.sum("orders").alias("total")))


def _sql_due(key: str) -> str:
    return f"""b AS (SELECT DISTINCT client, {key}, placed_at FROM lines WHERE {key} IS NOT NULL), g AS (SELECT client, {key}, placed_at, date_diff('second', lag(placed_at) OVER (PARTITION BY client, {key} ORDER BY placed_at), placed_at) AS gap FROM b),
 m AS (SELECT client, {key}, count(*) AS times, max(placed_at) AS last_at, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gaps FROM g GROUP BY ALL HAVING count(*) >= 3),
 due AS (SELECT * FROM (SELECT client, {key}, times, gaps[len(gaps) // 2 + 1] AS every_s, date_diff('second', last_at, TIMESTAMP '2001-01-01') AS since_s FROM m) x WHERE every_s >= 3600 AND since_s >= every_s)"""


def due(lines: DataFrame, key: str) -> DataFrame:
    """(client, key, times, every, since): what a client bought three times or more and whose upper median gap has passed, in seconds, on the report's day."""
    b = lines.where(F.col(key).isNotNull()).select("client", key, "placed_at").distinct()
    seconds = F.unix_timestamp(F.col("placed_at").cast("timestamp"))
    gap = seconds - F.lag(seconds).over(W.partitionBy("client", key).orderBy("placed_at"))
    m = b.withColumn("gap", gap).groupBy("client", key).agg(F.count("*").alias("times"), F.max("placed_at").alias("last_at"), F.sort_array(F.collect_list("gap")).alias("gaps")).where("times >= 3")
    every = F.element_at("gaps", (F.floor(F.size("gaps") / 2) + 1).cast("int"))
    since = F.unix_timestamp(F.lit("2001-01-01 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("last_at").cast("timestamp"))
    return m.select("client", key, "times", every.alias("every"), since.alias("since")).where("every >= 3600 and since >= every")


@query(f"WITH {SQL_LINES}, {_sql_due('brand')} SELECT client, brand, times, round(every_s / 86400.0, 1) AS every_days, round(since_s / 86400.0, 1) AS since_days FROM due")
def reorder_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands due again."""
    return due(order_lines(spark, sf_dir), "brand").select("client", "brand", "times", F.round(F.col("every") / 86400.0, 1).alias("every_days"), F.round(F.col("since") / 86400.0, 1).alias("since_days"))


@query(f"""WITH {SQL_LINES}, h AS (SELECT client, kind AS value, count(*) AS n FROM lines WHERE kind IS NOT NULL GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY client) AS total, row_number() OVER (PARTITION BY client ORDER BY n DESC, value) AS r FROM h)
 SELECT client, value, n, round(n / total, 6) AS share FROM t WHERE r = 1 AND n >= 2 AND n / total >= 0.4""")
def usual_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual type of a client: the most frequent, twice at least and four tenths of all."""
    h = order_lines(spark, sf_dir).where("kind is not null").groupBy("client", F.col("kind").alias("value")).agg(F.count("*").alias("n"))
    t = h.groupBy("client").agg(F.sum("n").alias("total"), F.max_by(F.struct("value", "n"), F.struct("n", F.lit(0))).alias("x"), F.min(F.struct((-F.col("n")).alias("m"), "value", "n")).alias("top"))
    return t.select("client", "top.value", "top.n", (F.col("top.n") / F.col("total")).alias("s")).where("n >= 2 and s >= 0.4").select("client", "value", "n", F.round("s", 6).alias("share"))


SQL_PRIOR = """own AS (SELECT client, kind, count(*) AS n FROM lines WHERE kind IS NOT NULL GROUP BY ALL), tot AS (SELECT client, sum(n) AS n FROM own GROUP BY 1),
overall AS (SELECT kind, sum(n) / (SELECT sum(n) FROM own) AS share FROM own GROUP BY 1), cust AS (SELECT c_custkey AS client, c_mktsegment AS segment FROM customer),
segk AS (SELECT segment, kind, sum(n) AS n FROM own JOIN cust USING (client) GROUP BY ALL), seg AS (SELECT segment, kind, n / sum(n) OVER (PARTITION BY segment) AS share FROM segk),
prior AS (SELECT t.client, g.kind, (coalesce(o.n, 0) + 5 * coalesce(s.share, g.share) + 2 * g.share) / (t.n + 7) AS p, g.share AS g FROM tot t CROSS JOIN overall g LEFT JOIN own o ON o.client = t.client AND o.kind = g.kind
 LEFT JOIN cust c ON c.client = t.client LEFT JOIN seg s ON s.segment = c.segment AND s.kind = g.kind)"""


def priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(client, kind, p, g): a client's own counts, smoothed by those of the segment and of all. Kinds are the catalog's few types."""
    own = order_lines(spark, sf_dir).where("kind is not null").groupBy("client", "kind").agg(F.count("*").alias("n"))
    segment = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("client"), F.col("c_mktsegment").alias("segment"))
    everyone = own.agg(F.sum("n").alias("every"))
    g = own.groupBy("kind").agg(F.sum("n").alias("n")).join(F.broadcast(everyone)).select("kind", (F.col("n") / F.col("every")).alias("g"))  # one row
    mixes = g.agg(F.map_from_entries(F.collect_list(F.struct("kind", "g"))).alias("mix"))  # one row: shares of the few types
    s = own.join(segment, "client").groupBy("segment", "kind").agg(F.sum("n").alias("n"))
    s = s.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("seg"), F.sum("n").alias("seg_n"))
    c = own.groupBy("client").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("own"), F.sum("n").alias("n")).join(segment, "client", "left").join(s, "segment", "left").join(F.broadcast(mixes))
    c = c.select("client", "own", "n", "seg", "seg_n", F.explode("mix").alias("kind", "g"))
    p = (F.coalesce(F.col("own")[F.col("kind")], F.lit(0)) + 5 * F.coalesce(F.col("seg")[F.col("kind")] / F.col("seg_n"), F.col("g")) + 2 * F.col("g")) / (F.col("n") + 7)
    return c.select("client", "kind", p.alias("p"), "g")


@query(f"WITH {SQL_LINES}, {SQL_PRIOR} SELECT client, kind, round(p, 6) AS prior FROM prior")
def category_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed category shares of each client."""
    return priors(spark, sf_dir).select("client", "kind", F.round("p", 6).alias("prior"))


@query(f"""WITH {SQL_LINES}, {SQL_PRIOR}, w AS (SELECT client, least(1.0, count(DISTINCT order_id) / 5.0) AS weight FROM lines GROUP BY 1)
 SELECT client, kind, round(greatest(-1, least(1, weight * greatest(-1.5, least(1.5, ln((p + 0.001) / (g + 0.001)))) / 1.5)), 6) AS boost FROM prior JOIN w USING (client)""")
def boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft boost of a category for a client: the clipped log of the prior over the global share, by how well the client is known."""
    w = order_lines(spark, sf_dir).groupBy("client").agg(F.least(F.lit(1.0), F.countDistinct("order_id") / 5.0).alias("weight"))
    soft = F.greatest(F.lit(-1.5), F.least(F.lit(1.5), F.log((F.col("p") + 0.001) / (F.col("g") + 0.001)))) / 1.5
    return priors(spark, sf_dir).join(w, "client").select("client", "kind", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("weight") * soft)), 6).alias("boost"))


SQL_CANDIDATES = "candidates AS (SELECT client, part FROM lines UNION SELECT client, part FROM (SELECT DISTINCT client FROM lines) x, (SELECT part FROM lines GROUP BY part ORDER BY count(*) DESC, part LIMIT 6) y)"


def part_scores(candidates: DataFrame, catalog: DataFrame, lines: DataFrame, prior: DataFrame) -> DataFrame:
    """candidates (client, part) with the boost of each part for its client, from -1 to 1.

    Soft evidence, by how well the client is known: the clipped log of the type's prior over its global share, the share of
    lines of the same size and of the same brand. Strong evidence in full: lines of the family, and of the part itself.
    Parts that aren't in the catalog and clients without lines of a known type have 0. Lines and candidates are dealt by client
    once; counts are windows over a client's rows of one key, which are sorted where they lie, and types are few, so that a client's
    priors fit a row. A client's lines meet in one task, which sorts them and spills.
    """
    dims = ("kind", "brand", "family", "size", "part")
    known = lines.groupBy("client").agg(F.count("kind").alias("items"), F.least(F.lit(1.0), F.countDistinct("order_id") / 5.0).alias("weight"))
    c = candidates.select("client", "part").distinct().join(catalog.select(*dims), "part", "left")
    rows = c.select("client", *dims, F.lit(0).alias("line")).unionByName(lines.select("client", *dims, F.lit(1).alias("line")))
    of = lambda d: F.when(F.col(d).isNotNull(), F.sum("line").over(W.partitionBy("client", d))).otherwise(0)
    wide = rows.repartition("client").withColumns({f"n_{d}": of(d) for d in dims}).where("line = 0").join(known, "client", "left")
    shares = prior.where("kind is not null").groupBy("client").agg(F.map_from_entries(F.collect_list(F.struct("kind", F.struct("p", "g")))).alias("shares"))
    wide = wide.join(shares, "client", "left").withColumn("x", F.col("shares")[F.col("kind")]).select("*", F.col("kind").alias("type"), "x.p", "x.g")
    taste = F.greatest(F.lit(-1.5), F.least(F.lit(1.5), F.log((F.col("p") + 0.001) / (F.col("g") + 0.001)))) / 1.5
    part_of = lambda d, most: most * F.least(F.lit(1.0), 4 * F.col(f"n_{d}") / F.col("items"))
    soft = F.coalesce(taste, F.lit(0.0)) + part_of("size", 0.15) + part_of("brand", 0.1)
    strong = 0.3 * F.least(F.lit(1.0), F.col("n_family") / 3) + F.when(F.col("n_part") > 0, 0.5 + 0.1 * F.least(F.lit(3), F.col("n_part"))).otherwise(0.0)
    boost = F.when(F.col("type").isNotNull() & (F.col("items") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("weight") * soft + strong))).otherwise(0.0)
    return wide.select("client", "part", F.round(boost, 6).alias("boost"))


def _sql_count(dim: str) -> str:
    return f"LEFT JOIN (SELECT client, {dim}, count(*) AS n FROM lines WHERE {dim} IS NOT NULL GROUP BY ALL) n_{dim} ON n_{dim}.client = c.client AND n_{dim}.{dim} = p.{dim}"


@query(f"""WITH {SQL_LINES}, {SQL_PRIOR}, {SQL_PARTS}, {SQL_CANDIDATES}, known AS (SELECT client, count(kind) AS items, least(1.0, count(DISTINCT order_id) / 5.0) AS weight FROM lines GROUP BY 1)
 SELECT c.client, c.part, CASE WHEN p.kind IS NULL OR items = 0 THEN 0 ELSE round(greatest(-1, least(1, weight * (coalesce(greatest(-1.5, least(1.5, ln((r.p + 0.001) / (r.g + 0.001)))) / 1.5, 0) + 0.15 * least(1.0, 4 * coalesce(n_size.n, 0) / items) + 0.1 * least(1.0, 4 * coalesce(n_brand.n, 0) / items))
  + 0.3 * least(1.0, coalesce(n_family.n, 0) / 3) + CASE WHEN n_part.n > 0 THEN 0.5 + 0.1 * least(3, n_part.n) ELSE 0 END)), 6) END AS boost
 FROM candidates c LEFT JOIN parts p USING (part) JOIN known k ON k.client = c.client LEFT JOIN prior r ON r.client = c.client AND r.kind = p.kind {" ".join(map(_sql_count, ("size", "brand", "family", "part")))}""")
def part_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosts of the parts a client has bought and of the six most frequent ones."""
    lines = order_lines(spark, sf_dir)
    popular = lines.groupBy("part").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "part").limit(6).agg(F.collect_list("part").alias("popular"))  # six parts in one row
    candidates = lines.select("client", "part").unionByName(lines.select("client").distinct().join(F.broadcast(popular)).select("client", F.explode("popular").alias("part")))
    return part_scores(candidates, parts(spark, sf_dir), lines, priors(spark, sf_dir))


@query(f"WITH {SQL_LINES}, c AS (SELECT part, count(*) AS n FROM lines GROUP BY 1) SELECT part, round(0.3 * ln(1 + n) / ln(1 + (SELECT max(n) FROM c)), 6) AS boost FROM c")
def popularity_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boost of a part by how often it is bought, 0.3 for the most frequent."""
    c = order_lines(spark, sf_dir).groupBy("part").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.max("n").alias("most")))).select("part", F.round(0.3 * F.log1p("n") / F.log1p("most"), 6).alias("boost"))  # one row


@query(f"WITH {SQL_LINES}, c AS (SELECT client, count(DISTINCT order_id) AS n FROM lines GROUP BY 1) SELECT count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders, count(*) FILTER (WHERE n >= 2) AS repeat_customers, round(avg(least(1.0, n / 5.0)), 6) AS mean_weight FROM c")
def repeat_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders and repeat customers."""
    c = order_lines(spark, sf_dir).groupBy("client").agg(F.countDistinct("order_id").alias("n"))
    return c.agg(F.count("*").alias("customers"), F.sum("n").alias("orders"), F.count_if(F.col("n") >= 2).alias("repeat_customers"), F.round(F.avg(F.least(F.lit(1.0), F.col("n") / 5.0)), 6).alias("mean_weight"))


@query("""WITH s AS (SELECT c_mktsegment || '/' || c_nationkey AS segment, count(*) AS customers FROM customer GROUP BY 1), f AS (SELECT CASE WHEN customers < 12 THEN 'small segments' ELSE segment END AS segment, customers, customers < 12 AS small FROM s)
 SELECT segment, count(*) AS folded, CAST(sum(customers) AS BIGINT) AS customers FROM f GROUP BY segment""")
def segments_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with few customers folded into one row."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("segment")).agg(F.count("*").alias("customers"))
    return c.groupBy(F.when(F.col("customers") < 12, "small segments").otherwise(F.col("segment")).alias("segment")).agg(F.count("*").alias("folded"), F.sum("customers").alias("customers"))


SQL_SHARES = """top AS (SELECT client, kind AS key, count(*) AS n FROM lines WHERE kind IS NOT NULL GROUP BY ALL), sub AS (SELECT client, kind || ' > ' || brand AS key, count(*) AS n FROM lines WHERE kind IS NOT NULL GROUP BY ALL),
u AS (SELECT client, key, sqrt(n / sum(n) OVER (PARTITION BY client)) AS x FROM top UNION ALL SELECT client, key, sqrt(0.5 * n / sum(n) OVER (PARTITION BY client)) FROM sub)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(client, key, x): square roots of the shares of types, and of half the shares of types and brands, to unit length."""
    lines = client_lines(spark, sf_dir, "kind", "brand").where("kind is not null")
    each = lines.select("client", F.explode(F.array(F.struct(F.lit(1.0).alias("w"), F.col("kind").alias("key")), F.struct(F.lit(0.5).alias("w"), F.concat_ws(" > ", "kind", "brand").alias("key")))).alias("e"))
    n = each.groupBy("client", "e.w", "e.key").agg(F.count("*").alias("n"))
    x = n.select("client", "key", (F.col("w") * F.col("n") / F.sum("n").over(W.partitionBy("client", "w"))).alias("q"))
    return x.select("client", "key", F.sqrt(F.col("q") / F.sum("q").over(W.partitionBy("client"))).alias("x"))


@query(f"WITH {SQL_LINES}, {SQL_SHARES} SELECT client, key, round(x / sqrt(sum(x * x) OVER (PARTITION BY client)), 6) AS x FROM u")
def customer_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taste vectors in long form."""
    return vectors(spark, sf_dir).select("client", "key", F.round("x", 6).alias("x"))


@query(f"""WITH {SQL_LINES}, c AS (SELECT client, part, count(*) AS n, max(placed_at) AS last_at FROM lines GROUP BY ALL), o AS (SELECT client, part, row_number() OVER (PARTITION BY client ORDER BY last_at DESC, part) - 1 AS i, count(*) OVER (PARTITION BY client) AS n FROM c WHERE n = 1)
 SELECT client, part, round(0.8 - 0.04 * i / greatest(1, 2 * n), 6) AS score FROM o""")
def once_bought_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought once, newest first, with falling scores."""
    c = order_lines(spark, sf_dir).groupBy("client", "part").agg(F.count("*").alias("n"), F.max("placed_at").alias("last_at")).where("n = 1")
    i = F.row_number().over(W.partitionBy("client").orderBy(F.desc("last_at"), "part")) - 1
    return c.withColumns({"i": i, "n": F.count("*").over(W.partitionBy("client"))}).select("client", "part", F.round(0.8 - 0.04 * F.col("i") / F.greatest(F.lit(1), 2 * F.col("n")), 6).alias("score"))


#: Places of the strip, those kept for what a client never bought, and how many of a list of guesses are looked at.
PLACES, NEW, GUESSES = 6, 1, 12


@query(f"""WITH {SQL_LINES}, {_sql_due('family')}, {SQL_PARTS}, lift AS ({_sql_lift(SQL_PAIRS)}), c AS (SELECT client, family, count(*) AS n, max(placed_at) AS last_at FROM lines WHERE family IS NOT NULL GROUP BY ALL), cust AS (SELECT c_custkey AS client, c_mktsegment AS segment FROM customer),
 latest AS (SELECT client, arg_max(order_id, (placed_at, order_id)) AS order_id FROM lines WHERE family IS NOT NULL GROUP BY 1), recent AS (SELECT client, family, row_number() OVER (PARTITION BY client ORDER BY family) AS i FROM (SELECT DISTINCT client, family FROM lines JOIN latest USING (client, order_id) WHERE family IS NOT NULL) x),
 l4 AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY lift DESC, other) AS r FROM lift QUALIFY r <= 4),
 fav AS (SELECT segment, family, count(*) AS n, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, family) AS r FROM lines JOIN cust USING (client) WHERE family IS NOT NULL GROUP BY segment, family QUALIFY r <= {GUESSES}),
 kinds AS (SELECT client, kind, row_number() OVER (PARTITION BY client ORDER BY count(*) DESC, kind) - 1 AS j FROM lines WHERE kind IS NOT NULL GROUP BY client, kind QUALIFY j < 2), brands AS (SELECT client, brand, row_number() OVER (PARTITION BY client ORDER BY count(*) DESC, brand) - 1 AS m FROM lines WHERE brand IS NOT NULL GROUP BY client, brand QUALIFY m < 2),
 aisle AS (SELECT k.client, j, s.family, row_number() OVER (PARTITION BY k.client, j ORDER BY m, s.family) - 1 AS found FROM kinds k JOIN brands USING (client) JOIN (SELECT DISTINCT kind, brand, family FROM parts WHERE family IS NOT NULL) s ON s.kind = k.kind AND s.brand = brands.brand
  WHERE (k.client, s.family) NOT IN (SELECT (client, family) FROM c) QUALIFY found < {GUESSES}),
 pop AS (SELECT family, count(*) AS n FROM lines WHERE family IS NOT NULL GROUP BY 1 ORDER BY n DESC, family LIMIT {PLACES}),
 t AS (SELECT client, family, 1 AS tier, 0 AS sub, 2.0 AS score, 'due' AS why FROM due UNION ALL SELECT client, family, 2, 0, 1 + n / 10.0, 'staple' FROM c WHERE n >= 2
  UNION ALL SELECT client, family, 3, i, 0.8 - 0.04 * i / {GUESSES}, 'once' FROM (SELECT client, family, row_number() OVER (PARTITION BY client ORDER BY last_at DESC, family) - 1 AS i FROM c WHERE n = 1) o WHERE i < {GUESSES}
  UNION ALL SELECT client, other, 4, i * 10 + r, 0.4 + least(lift, 5) / 50, 'complement' FROM recent JOIN l4 ON l4.part = recent.family WHERE (client, other) NOT IN (SELECT (client, family) FROM c)
  UNION ALL SELECT client, fav.family, 5, r, 0.2 + 0.1 * least(1.0, fav.n / 50), 'segment' FROM (SELECT DISTINCT client FROM c) x JOIN cust USING (client) JOIN fav USING (segment) WHERE (client, fav.family) NOT IN (SELECT (client, family) FROM c)
  UNION ALL SELECT client, family, 6, j * 100 + found, 0.6 - 0.03 * j - 0.002 * found, 'aisle' FROM aisle
  UNION ALL SELECT client, family, 7, 0, 0.2 * least(1.0, n / 50), 'popular' FROM cust, pop WHERE client NOT IN (SELECT client FROM c)),
 f AS (SELECT client, family, round(arg_min(score, (tier, sub)), 6) AS score, arg_min(why, (tier, sub)) AS why, min(tier) AS tier FROM t GROUP BY ALL),
 o AS (SELECT *, tier <= 3 AS own, row_number() OVER (PARTITION BY client, tier <= 3 ORDER BY score DESC, tier, family) AS r, count(*) FILTER (WHERE tier <= 3) OVER (PARTITION BY client) AS owns, count(*) FILTER (WHERE tier > 3) OVER (PARTITION BY client) AS news FROM f),
 h AS (SELECT *, least(owns, CASE WHEN news > 0 THEN {PLACES - NEW} ELSE {PLACES} END) AS head FROM o)
 SELECT client, family, score, why, CAST(CASE WHEN NOT own THEN head + r WHEN r <= head THEN r ELSE r + least(news, {PLACES} - head) END AS BIGINT) AS place FROM h WHERE (own OR r <= {PLACES} - head) AND place <= {PLACES}""")
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six families for each client, before a search.

    Reasons in order: due again, bought twice or more, bought once (newest first), bought by others with those of the last
    order, frequent in the segment, new in the client's two usual types and two usual brands, and, for customers without
    orders, frequent ones. The first reason of a family stays and gives its score; equal scores go by reason, then name. The
    last place is kept for a family the client never bought, if there is one. Lines without a family don't count, nor do
    aisles of clients without a known brand. A list of the shelf is read as deep as a client's own families can reach into
    it, so none is missed. The lines are joined once and written, and so is a row for each client, made where its lines are dealt to;
    what it asks of the shop (see `_offers`) is held against its own families in that row, so that no family of a list is a row.
    """
    with shared(spark, sf_dir, order_lines):
        return _recommended(spark, sf_dir)


#: Reasons in order; the first three are of what a client bought.
REASONS = ("due", "staple", "once", "complement", "segment", "aisle", "popular")


def _due_by(days: Column, times: Column) -> Column:
    """`due` of one client and key, by the sorted days of its orders and their number."""
    seconds = lambda x: F.unix_timestamp(x.cast("timestamp"))
    gaps = F.array_sort(F.transform(F.slice(days, 2, F.size(days)), lambda x, i: seconds(x) - seconds(F.get(days, i))))
    since = seconds(F.lit("2001-01-01 00:00:00")) - seconds(F.element_at(days, -1))
    passed = once(gaps, lambda g: once(F.get(g, F.floor(F.size(g) / 2).cast("int")), lambda every: (every >= 3600) & (since >= every)))
    return F.coalesce(F.when(times >= 3, passed), F.lit(False))


def _histories(spark: SparkSession, sf_dir: str, customers: DataFrame) -> DataFrame:
    """A row for each client with lines of a family: segment, own (its families with counts), the best PLACES of them (see `_entry`) and their
    number, the families of its last order, its two usual kinds and brands. Lines are dealt by client, and all else is made where they lie."""
    lines = client_lines(spark, sf_dir, "order_id", "placed_at", "family").where("family is not null")
    usual = client_lines(spark, sf_dir, "family", "kind", "brand").where("family is not null")
    each = lines.groupBy("client", "family").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("placed_at")).alias("days"), F.max(F.col("placed_at").isNull().cast("int")).alias("undated"), F.max(F.struct("placed_at", "order_id")).alias("last"))
    age = F.coalesce(-F.unix_micros(F.col("last.placed_at").cast("timestamp")), F.lit(2**63 - 1))
    each = each.select("client", "family", "n", "last", age.alias("age"), _due_by(F.col("days"), F.size("days") + F.col("undated")).alias("due"))
    h = each.groupBy("client").agg(F.max("last").alias("recent"), F.collect_list(F.struct("family", "n")).alias("own"), F.collect_list(F.when(F.col("n") > 1, _entry(F.when(F.col("due"), 1).otherwise(2), F.when(F.col("due"), 2.0).otherwise(1 + F.col("n") / 10.0), F.col("family")))).alias("again"),
                                   F.collect_list(F.when(F.col("n") == 1, F.struct("age", "family"))).alias("once"), F.collect_list(F.struct("last", "family")).alias("lasts"))
    newest = F.transform(F.slice(F.array_sort("once"), 1, GUESSES), lambda x, i: _entry(F.lit(3), 0.8 - 0.04 * i / GUESSES, x["family"]))
    families = F.array_sort(F.transform(F.filter("lasts", lambda x: x["last"] == F.col("recent")), lambda x: x["family"]))
    h = h.select("client", "own", families.alias("recent"), F.slice(F.array_sort(F.concat("again", newest)), 1, PLACES).alias("strip"), (F.size("again") + F.least(F.size("once"), F.lit(GUESSES))).alias("owns"))
    for key in ("kind", "brand"):
        n = usual.where(F.col(key).isNotNull()).groupBy("client", key).agg(F.count("*").alias("n"))
        h = h.join(n.groupBy("client").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), key))), 1, 2)[key].alias(f"{key}s")), "client", "left")
    return h.join(customers, "client", "left")


def _entry(tier: Column, score: Column, family: Column) -> Column:
    """What sorts by falling score, reason and name."""
    return F.struct((-F.round(score, 6)).alias("less"), tier.cast("int").alias("tier"), family.alias("family"))


def _offers(spark: SparkSession, sf_dir: str, favourites: DataFrame) -> DataFrame:
    """(what, a, b, level, top, offer): lists of families with scores, in order: the complements of family a, the favourites of segment a, and the shelf
    of kind a and brand b. A shelf comes at several lengths, the first 2^level names up to level `top`, so that who needs few reads few."""
    listed = lambda rows, *by: rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("r", "family", "score"))).alias("offer"))
    lines = order_lines(spark, sf_dir)
    lift = _strongest(lines, copurchase_pairs(spark, sf_dir), lines.agg(F.countDistinct("order_id").alias("total"))).withColumn("r", F.row_number().over(W.partitionBy("part").orderBy(F.desc("lift"), "other"))).where("r <= 4")
    lift = listed(lift.select("part", "r", F.col("other").alias("family"), (0.4 + F.least(F.col("lift"), F.lit(5.0)) / 50).alias("score")), "part")
    frequent = favourites.where("segment is not null").withColumn("r", F.row_number().over(W.partitionBy("segment").orderBy(F.desc("n"), "family"))).where(F.col("r") <= GUESSES)
    frequent = listed(frequent.select("segment", "r", "family", (0.2 + 0.1 * F.least(F.lit(1.0), F.col("n") / 50)).alias("score")), "segment")
    shelf = listed(parts(spark, sf_dir).where("family is not null").select("kind", "brand", "family", F.lit(0).alias("r"), F.lit(None).cast("double").alias("score")).distinct(), "kind", "brand")
    shelf = shelf.withColumn("top", F.ceil(F.log2(F.size("offer"))).cast("int")).select("*", F.explode(F.sequence(F.lit(0), "top")).alias("level"))
    offer = lambda rows, what, a, b, level, top, these: rows.select(F.lit(what).alias("what"), F.col(a).alias("a"), b.alias("b"), level.alias("level"), top.alias("top"), these.alias("offer"))
    whole, none = [F.lit(0), F.lit(0), F.col("offer")], F.lit("")
    return offer(lift, "complement", "part", none, *whole).unionByName(offer(frequent, "segment", "segment", none, *whole)).unionByName(offer(shelf, "aisle", "kind", F.col("brand"), F.col("level"), F.col("top"), F.slice("offer", 1, F.pow(F.lit(2), F.col("level")).cast("int"))))


def _recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("client"), F.col("c_mktsegment").alias("segment"))
    h = cut(_histories(spark, sf_dir, customers))
    favourites = cut(h.select("segment", F.explode("own").alias("x")).groupBy("segment", "x.family").agg(F.sum("x.n").alias("n")))
    offers = cut(_offers(spark, sf_dir, favourites))

    # what a client asks for: by each family of its last order, by its segment, and by its usual types and brands, in this order
    ask = lambda what, a, b, at: F.struct(F.lit(what).alias("what"), a.alias("a"), b.alias("b"), at.cast("int").alias("at"))
    none = F.lit("")
    aisles = F.flatten(F.transform(F.coalesce("kinds", F.array().cast("array<string>")), lambda k, j: F.transform(F.coalesce("brands", F.array().cast("array<string>")), lambda b, m: ask("aisle", k, b, 2 * j + m))))
    asks = F.concat(F.transform("recent", lambda f, i: ask("complement", f, none, i)), F.array(ask("segment", F.col("segment"), none, F.lit(0))), aisles)
    asked = h.select("client", "strip", "owns", F.col("own.family").alias("own"), F.ceil(F.log2(F.size("own") + GUESSES)).cast("int").alias("deep"), F.explode(asks).alias("x")).select("*", "x.*").drop("x")
    met = asked.join(offers, (asked["what"] == offers["what"]) & (asked["a"] == offers["a"]) & (asked["b"] == offers["b"]) & (F.least("deep", "top") == F.col("level")), "left").drop(offers["what"])
    unbought = F.when(F.col("what") == "aisle", F.transform(F.slice(F.array_except("offer.family", "own"), 1, GUESSES), lambda f: F.struct(F.lit(0).alias("r"), f.alias("family"), F.lit(None).cast("double").alias("score"))))
    unbought = unbought.otherwise(F.filter("offer", lambda x: ~F.array_contains("own", x["family"])))
    g = met.select("client", "strip", "owns", "what", "at", unbought.alias("offer")).groupBy("client").agg(
        F.first("strip").alias("strip"), F.first("owns").alias("owns"),
        *[F.array_sort(F.collect_list(F.when((F.col("what") == what) & F.col("offer").isNotNull(), F.struct("at", "offer")))).alias(what) for what in ("complement", "segment", "aisle")],
    )

    # new families in order of reason, of which each first one counts
    scored = lambda what, tier: F.transform(F.flatten(F.col(what)["offer"]), lambda x: _entry(F.lit(tier), x["score"], x["family"]))
    aisle = lambda j: F.transform(F.slice(F.flatten(F.filter("aisle", lambda x: F.floor(x["at"] / 2) == j)["offer"]), 1, GUESSES), lambda x, found: _entry(F.lit(6), 0.6 - 0.03 * j - 0.002 * found, x["family"]))
    firsts = lambda these: once(these["family"], lambda names: F.filter(these, lambda x, i: F.array_position(names, x["family"]) == i + 1))
    new = once(F.concat(scored("complement", 4), scored("segment", 5), aisle(0), aisle(1)), lambda x: F.array_sort(firsts(x)))
    head = lambda n: F.least("owns", F.when(F.size(n) > 0, PLACES - NEW).otherwise(PLACES))
    strip = once(new, lambda n: once(head(n), lambda k: F.concat(F.slice("strip", 1, k), F.slice(n, 1, PLACES - k))))
    known = g.select("client", F.posexplode(strip).alias("i", "x"))

    six = favourites.groupBy("family").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "family").limit(PLACES)
    popular = six.agg(F.array_sort(F.collect_list(_entry(F.lit(7), 0.2 * F.least(F.lit(1.0), F.col("n") / 50), F.col("family")))).alias("popular"))  # six families in one row
    unknown = customers.join(h.select("client"), "client", "left_anti").join(F.broadcast(popular)).select("client", F.posexplode("popular").alias("i", "x"))
    why = F.element_at(F.array(*map(F.lit, REASONS)), F.col("x.tier"))
    return known.unionByName(unknown).select("client", "x.family", (-F.col("x.less")).alias("score"), why.alias("why"), (F.col("i") + 1).cast("bigint").alias("place"))


@query(f"""WITH {SQL_LINES}, o AS (SELECT DISTINCT client, order_id, placed_at FROM lines), r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY placed_at, order_id) AS round FROM o),
 f AS (SELECT l.client, l.family, min(r.round) AS first_round FROM lines l JOIN r USING (client, order_id) GROUP BY ALL)
 SELECT r.round, count(*) AS lines, round(avg(CAST(f.first_round < r.round AS INT)), 6) AS seen_before FROM lines l JOIN r USING (client, order_id) JOIN f ON f.client = l.client AND f.family = l.family GROUP BY 1""")
def replay_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay: of each client's k-th order, the share of lines whose family was bought in an earlier one."""
    lines = order_lines(spark, sf_dir)
    numbered = lines.withColumn("round", F.dense_rank().over(W.partitionBy("client").orderBy("placed_at", "order_id")).cast("bigint"))
    seen = numbered.where("family is not null").withColumn("first_round", F.min("round").over(W.partitionBy("client", "family")))
    return seen.groupBy("round").agg(F.count("*").alias("lines"), F.round(F.avg((F.col("first_round") < F.col("round")).cast("int")), 6).alias("seen_before"))


@query(f"WITH {SQL_LINES}, t AS (SELECT order_id, client, sum(quantity) AS quantity, count(*) AS n FROM lines GROUP BY ALL) SELECT client, count(*) AS orders, CAST(sum(quantity) AS BIGINT) AS items, round(avg(n), 6) AS lines_per_order FROM t GROUP BY client ORDER BY orders DESC, client LIMIT 50")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clients with most orders."""
    t = order_lines(spark, sf_dir).groupBy("client", "order_id").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("n"))
    return t.groupBy("client").agg(F.count("*").alias("orders"), F.sum("quantity").alias("items"), F.round(F.avg("n"), 6).alias("lines_per_order")).orderBy(F.desc("orders"), "client").limit(50)


@query()
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients by k-means over their taste vectors (see customer_vector: types, and at half weight type and brand). Spark starts with k-means||
    from a fixed seed; an empty cluster goes. The numbers of segments tell nothing: compare by purity. A vector is as long as the
    catalog's first two levels are wide."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    tastes = cut(vectors(spark, sf_dir))
    places = tastes.select("key").distinct().withColumn("place", F.row_number().over(W.orderBy("key")))  # the catalog's few thousand types and pairs
    wide = places.agg(F.count("*").alias("wide"))
    own = tastes.join(places, "key").groupBy("client").agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("at")).join(F.broadcast(wide))  # one row
    dense = F.transform(F.sequence(F.lit(1), F.col("wide").cast("int")), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0.0)))
    v = cut(own.select("client", array_to_vector(dense).alias("features")))  # read in every iteration
    if not v.limit(1).count():
        return v.select("client", F.lit(0).alias("segment"))
    return KMeans(k=8, seed=7, maxIter=25, featuresCol="features", predictionCol="segment").fit(v).transform(v).select("client", "segment")


@query(f"WITH {SQL_LINES} SELECT kind, brand, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS quantity, grouping(kind) AS all_kinds, grouping(brand) AS all_brands FROM lines WHERE kind IS NOT NULL GROUP BY ROLLUP (kind, brand)")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and quantities by type and brand, by type, and in all."""
    r = order_lines(spark, sf_dir).where("kind is not null").rollup("kind", "brand").agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"), F.grouping("kind").cast("bigint").alias("all_kinds"), F.grouping("brand").cast("bigint").alias("all_brands"))
    return r


@query(f"WITH {SQL_LINES}, t AS (SELECT client, max(placed_at) AS last_at, count(DISTINCT order_id) AS n FROM lines GROUP BY 1) SELECT CASE WHEN n <= 3 THEN '1-3' WHEN n <= 8 THEN '4-8' ELSE '9+' END AS bucket, count(*) AS clients, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM t GROUP BY 1")
def order_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients by number of orders."""
    n = F.countDistinct("order_id")
    t = order_lines(spark, sf_dir).groupBy("client").agg(n.alias("n"))
    b = t.groupBy(F.when(F.col("n") <= 3, "1-3").when(F.col("n") <= 8, "4-8").otherwise("9+").alias("bucket")).agg(F.count("*").alias("clients"))
    return b.join(F.broadcast(b.agg(F.sum("clients").alias("every")))).select("bucket", "clients", ratio(F.col("clients"), F.col("every")).alias("share"))  # three rows


@query(f"WITH {SQL_LINES}, h AS (SELECT client, brand, count(*) AS n FROM lines WHERE brand IS NOT NULL GROUP BY ALL) SELECT client, brand, n, n >= 2 AS repeated FROM h QUALIFY row_number() OVER (PARTITION BY client ORDER BY n DESC, brand) <= 3")
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three brands a client buys most."""
    h = order_lines(spark, sf_dir).where("brand is not null").groupBy("client", "brand").agg(F.count("*").alias("n"))
    return h.withColumn("r", F.row_number().over(W.partitionBy("client").orderBy(F.desc("n"), "brand"))).where("r <= 3").select("client", "brand", "n", (F.col("n") >= 2).alias("repeated"))

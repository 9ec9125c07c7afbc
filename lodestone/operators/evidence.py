"""All evidence for a candidate in one score, what tells a family's members apart, usual attribute values, pooled and joined vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.vectors import unit
from lodestone.operators.vector import EVERY, SQL_TOP, retrieved
from lodestone.plans.views import SQL_EVENTS, SQL_GALLERY, SQL_LINES, client_lines, event_log, gallery
from lodestone.registry import query

#: Weights of similarity, near identity (from EXACT_AT on), hits, category, attributes, a number read, a ranking from outside, size,
#: confirmations and the customer; masses and shares that hints need.
WEIGHTS = {"sim": 1.0, "exact": 0.35, "hits": 0.03, "category": 0.15, "attributes": 0.12, "read": 0.5, "ranked": 0.3, "size": 0.2, "confirmed": 0.02, "customer": 0.06}
EXACT_AT, LEAST_MASS, LEAST_SHARE = 0.99, 0.6, 0.4
NUMBERS = ("sim", "hits", "category", "attributes", "ranked", "size", "confirmed", "customer")


def with_read(candidates: DataFrame, read: DataFrame, catalog: DataFrame) -> DataFrame:
    """candidates (query_id, label, sim, hits, ...) and `read`: whether the candidate's number was read on the photo. Numbers that were
    read (query_id, label) and that the catalog has come in as candidates of similarity and hits 0; others don't count."""
    known = read.select("query_id", "label").distinct().join(catalog.select("label").distinct(), "label", "left_semi").withColumn("read", F.lit(True))
    both = candidates.join(known, ["query_id", "label"], "full")
    return both.withColumns({"read": F.coalesce("read", F.lit(False)), "sim": F.coalesce("sim", F.lit(0.0)), "hits": F.coalesce("hits", F.lit(0))})


def evidence(rows: DataFrame) -> DataFrame:
    """rows with `score` and `reasons`. rows: sim, hits, category (share of its prior), attributes and size (votes from -1 to 1), ranked (0 to
    1), confirmed (weighted confirmations), customer (0 to 1), read (boolean). Evidence that is null or absent as a column
    counts 0; a candidate without hits, as one that was only read, loses what one hit more would give."""
    has = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in rows.columns else F.lit(0.0)
    x = {name: has(name) for name in NUMBERS}
    read = F.coalesce(F.col("read"), F.lit(False)) if "read" in rows.columns else F.lit(False)
    value: dict[str, Column] = x | {
        "hits": F.least(x["hits"] - 1, F.lit(3.0)), "exact": F.least(F.lit(1.0), F.greatest(F.lit(0.0), x["sim"] - EXACT_AT) / (1 - EXACT_AT)),
        "read": read.cast("double"), "confirmed": F.log1p(F.least(F.greatest(x["confirmed"], F.lit(0.0)) / 2, F.lit(50.0))),
    }
    score = sum((w * value[name] for name, w in WEIGHTS.items()), F.lit(0.0))
    said = {"near identical": x["sim"] > EXACT_AT, "of the likely category": x["category"] > 0.5, "attributes agree": x["attributes"] > 0.5, "attributes differ": x["attributes"] < -0.5, "number read": read, "ranked from outside": x["ranked"] > 0, "size agrees": x["size"] > 0.5, "size differs": x["size"] < -0.5, "confirmed before": x["confirmed"] > 0, "usual for the customer": x["customer"] >= 0.4}
    return rows.withColumns({"score": score, "reasons": F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in said.items()]))})


def told_apart(ranked: DataFrame, attributes: DataFrame, least: float = LEAST_MASS) -> DataFrame:
    """(query_id, family, mass, members, names): the family that holds most of a query's probability, if that is `least` or more by
    two members or more, with the names of attributes in which its members differ; a missing one differs from any value. ranked: query_id, item,
    family, p; attributes: item, name, value, a row for each name that an item has. Ties go to the smaller family."""
    mass = ranked.where("family is not null").groupBy("query_id", "family").agg(F.sum("p").alias("mass"), F.count_distinct("item").alias("members"))
    best = mass.groupBy("query_id").agg(F.max_by(F.struct("family", "mass", "members"), F.struct("mass", (-F.col("family")).alias("minus"))).alias("b")).select("query_id", "b.*")
    best = best.where((F.round("mass", 9) >= least) & (F.col("members") >= 2))
    held = ranked.join(best, ["query_id", "family"]).join(attributes, "item").groupBy("query_id", "name").agg(F.count_distinct("item").alias("holders"), F.count_distinct("value").alias("values"), F.first("members").alias("all"))
    names = held.where("values > 1 or (values >= 1 and holders < all)").groupBy("query_id").agg(F.sort_array(F.collect_list("name")).alias("names"))
    return best.join(names, "query_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def usual(bought: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """(client, name, value, n, share): a client's commonest value of each attribute, where it stands twice or more and in `least` of all its
    values. bought: client, name, value. Ties go to the smaller value; null values don't count."""
    n = bought.where("value is not null").groupBy("client", "name", "value").agg(F.count("*").alias("n"))
    top = n.groupBy("client", "name").agg(F.sum("n").alias("whole"), F.min(F.struct((-F.col("n")).alias("minus"), "value")).alias("t"))
    out = top.select("client", "name", "t.value", (-F.col("t.minus")).alias("n"), (-F.col("t.minus") / F.col("whole")).alias("share"))
    return out.where((F.col("n") >= 2) & (F.col("share") >= least))


def pooled(variants: DataFrame) -> DataFrame:
    """(query_id, v): the mean of a query's variants (query_id, v) at unit length."""
    mean = variants.select("query_id", F.posexplode("v").alias("pos", "x")).groupBy("query_id", "pos").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return mean.select("query_id", unit(F.col("v")).alias("v"))


def joined(*vectors: tuple[Column, float]) -> Column:
    """One vector of several models' (vector, weight): the dot product of two of them is the weighted mean of the models' cosines."""
    whole = sum(w for _, w in vectors)
    scaled = lambda v, by: F.transform(unit(v), lambda x: x * by)
    return F.concat(*[scaled(v, (w / whole) ** 0.5) for v, w in vectors])


def newest(photos: DataFrame, n: int) -> DataFrame:
    """The n newest photos (part_number, path, taken) of each part; ties by path. A time that is missing sorts before all others."""
    at = F.coalesce(F.col("taken").cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    place = F.row_number().over(W.partitionBy("part_number").orderBy(at.desc(), "path"))
    return photos.withColumn("place", place).where(F.col("place") <= n).drop("place")


_SQL_CANDIDATES = f"""{SQL_TOP}, c AS (SELECT query_id, label, max(score) AS sim, count(*) AS hits FROM top WHERE place <= 50 GROUP BY ALL), num AS (SELECT DISTINCT query_id, (query_id // 20) % 12 AS label FROM q SEMI JOIN gallery g ON g.label = (q.query_id // 20) % 12),
 x AS (SELECT coalesce(c.query_id, num.query_id) AS query_id, coalesce(c.label, num.label) AS label, coalesce(sim, 0) AS sim, coalesce(hits, 0) AS hits, num.label IS NOT NULL AS read FROM c FULL JOIN num ON c.query_id = num.query_id AND c.label = num.label),
 s AS (SELECT query_id, label, sim, read, {WEIGHTS["sim"]} * sim + {WEIGHTS["exact"]} * least(1, greatest(0, sim - {EXACT_AT}) / {1 - EXACT_AT}) + {WEIGHTS["hits"]} * least(hits - 1, 3) + {WEIGHTS["category"]} * hits / 50.0 + {WEIGHTS["attributes"]} * (label % 5 - 2) / 2.0 + {WEIGHTS["read"]} * read::INT
  + {WEIGHTS["ranked"]} * CASE WHEN label % 3 = 0 THEN 0.4 ELSE 0 END + {WEIGHTS["size"]} * CASE WHEN query_id % 40 = 0 THEN 0 ELSE (label % 4 - 1) / 2.0 END + {WEIGHTS["confirmed"]} * ln(1 + least(label * 30 / 2.0, 50)) + {WEIGHTS["customer"]} * CASE WHEN label % 4 = 1 THEN 0.5 ELSE 0 END AS score FROM x)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, label = gallery(spark, sf_dir), F.col("label")
    found = retrieved(spark, sf_dir, 50).groupBy("query_id", "label").agg(F.max("score").alias("sim"), F.count("*").alias("hits"))
    numbers = g.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), (F.floor(F.col("vec_id") / 20) % 12).alias("label"))
    rows = with_read(found, numbers, g)
    return rows.withColumns({
        "category": F.col("hits") / 50.0, "attributes": (label % 5 - 2) / 2.0, "ranked": F.when(label % 3 == 0, 0.4), "size": F.when(F.col("query_id") % 40 != 0, (label % 4 - 1) / 2.0),
        "confirmed": label * 30, "customer": F.when(label % 4 == 1, 0.5),
    })


@query(f"WITH {_SQL_CANDIDATES} SELECT query_id, label, round(score, 5) AS score, read, label > 0 AS confirmed, label % 4 = 1 AS usual FROM s")
def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each stated query, with numbers that were read, scored by all ten kinds of evidence."""
    said = lambda t: F.array_contains("reasons", t)
    return evidence(_candidates(spark, sf_dir)).select("query_id", "label", F.round("score", 5).alias("score"), "read", said("confirmed before").alias("confirmed"), said("usual for the customer").alias("usual"))


@query(f"""WITH {_SQL_CANDIDATES}, p AS (SELECT query_id, label, label % 3 AS family, exp(score / 0.5) / sum(exp(score / 0.5)) OVER (PARTITION BY query_id) AS p FROM s), m AS (SELECT query_id, family, sum(p) AS mass, count(*) AS members FROM p GROUP BY ALL),
 b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mass DESC, family) = 1), a AS (SELECT label AS item, 'even' AS name, CAST(label % 2 AS VARCHAR) AS value FROM (SELECT DISTINCT label FROM gallery) x UNION ALL SELECT label, 'large', 'yes' FROM (SELECT DISTINCT label FROM gallery) x WHERE label > 5 UNION ALL SELECT label, 'all', 'same' FROM (SELECT DISTINCT label FROM gallery) x),
 n AS (SELECT b.query_id, name FROM b JOIN p USING (query_id, family) JOIN a ON a.item = p.label GROUP BY b.query_id, b.members, name HAVING count(DISTINCT value) > 1 OR count(*) < b.members)
 SELECT query_id, family, members, (SELECT coalesce(string_agg(name, ',' ORDER BY name), '') FROM n WHERE n.query_id = b.query_id) AS names FROM b WHERE round(mass, 9) >= 0.4 AND members >= 2""")
def differing_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families that hold four tenths of a query's probability, and what tells their members apart."""
    e = F.exp(F.col("score") / 0.5)
    ranked = evidence(_candidates(spark, sf_dir)).select("query_id", F.col("label").alias("item"), (F.col("label") % 3).alias("family"), (e / F.sum(e).over(W.partitionBy("query_id"))).alias("p"))
    label = F.col("label")
    listed = F.array(F.struct(F.lit("even").alias("name"), (label % 2).cast("string").alias("value")), F.when(label > 5, F.struct(F.lit("large").alias("name"), F.lit("yes").alias("value"))), F.struct(F.lit("all").alias("name"), F.lit("same").alias("value")))
    attributes = gallery(spark, sf_dir).select("label").distinct().select(label.alias("item"), F.explode(F.array_compact(listed)).alias("x")).select("item", "x.*")
    return told_apart(ranked, attributes, 0.4).select("query_id", "family", "members", F.array_join("names", ",").alias("names"))


@query(f"""WITH {SQL_LINES}, a AS (SELECT client, unnest(['kind', 'brand', 'size']) AS name, unnest([kind, brand, CAST(size AS VARCHAR)]) AS value FROM lines), n AS (SELECT client, name, value, count(*) AS n FROM a WHERE value IS NOT NULL GROUP BY ALL),
 t AS (SELECT *, n / sum(n) OVER (PARTITION BY client, name) AS share, row_number() OVER (PARTITION BY client, name ORDER BY n DESC, value) AS r FROM n) SELECT client, name, value, n, round(share, 6) AS share FROM t WHERE r = 1 AND n >= 2 AND share >= {LEAST_SHARE}""")
def usual_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each client's usual value of every attribute."""
    lines = client_lines(spark, sf_dir, "kind", "brand", "size")
    named = F.explode(F.create_map(F.lit("kind"), F.col("kind"), F.lit("brand"), F.col("brand"), F.lit("size"), F.col("size").cast("string"))).alias("name", "value")
    return usual(lines.select("client", named)).withColumn("share", F.round("share", 6))


@query(f"""WITH {SQL_GALLERY}, e AS (SELECT vec_id // 7 AS query_id, unnest(generate_series(1, 64)) AS pos, unnest(v) AS x FROM gallery), m AS (SELECT query_id, pos, avg(x) AS x FROM e GROUP BY ALL), u AS (SELECT query_id, pos, x / (sqrt(sum(x * x) OVER (PARTITION BY query_id)) + 1e-8) AS x FROM m)
 SELECT query_id, round(max(x) FILTER (WHERE pos = 1), 6) AS first_x, round(sum(x), 5) AS total FROM u GROUP BY query_id""")
def pooled_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven rows a query pooled to one vector, in short."""
    p = pooled(gallery(spark, sf_dir).select(F.floor(F.col("vec_id") / 7).alias("query_id"), "v"))
    return p.select("query_id", F.round(F.element_at("v", 1), 6).alias("first_x"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"""WITH {SQL_EVENTS}, s AS (SELECT CASE WHEN k % 9 = 8 THEN '  ' WHEN k % 2 = 0 THEN ' Term' || (k % 9) ELSE 'term' || (k % 9) || ' ' END AS text, part = 0 AS empty FROM log WHERE event_type = 'click')
 SELECT lower(trim(text)) AS asked, count(*) AS times FROM s WHERE empty AND trim(text) <> '' GROUP BY 1 ORDER BY times DESC, asked LIMIT 5""")
def empty_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five searches that find nothing most often, whatever their case and blanks at the ends."""
    k = F.col("k")
    text = F.when(k % 9 == 8, "  ").when(k % 2 == 0, F.concat(F.lit(" Term"), (k % 9).cast("string"))).otherwise(F.concat(F.lit("term"), (k % 9).cast("string"), F.lit(" ")))
    s = event_log(spark, sf_dir).where("event_type = 'click' and part = 0").select(F.lower(F.trim(text)).alias("asked")).where("asked <> ''")
    return s.groupBy("asked").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "asked").limit(5)

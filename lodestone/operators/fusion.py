"""Evidence fusion and decision: weighted scores, calibrated tiers, temperature fit, thresholds, tiers of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.vector import SQL_TOP, retrieved
from lodestone.registry import query

#: Weights of the evidence and thresholds of the tiers.
W_SIM, W_HITS, W_EXACT, EXACT_AT, W_PRIOR, W_POP = 1.0, 0.03, 0.35, 0.99, 0.15, 0.02
TEMPERATURE, EXACT_P, EXACT_MARGIN, LIKELY_P, LEAST_SIM = 0.05, 0.90, 0.15, 0.60, 0.35
GRID = (0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5, 1.0)

SQL_PROB = f"""{SQL_TOP}, c AS (SELECT query_id, query_label, label, max(score) AS sim, count(*) AS hits FROM top WHERE place <= 50 GROUP BY ALL), pop AS (SELECT label, count(*) AS n FROM gallery GROUP BY 1),
fused AS (SELECT query_id, query_label, c.label, sim, hits, round({W_SIM} * sim + {W_HITS} * least(hits - 1, 3) + {W_EXACT} * greatest(0, sim - {EXACT_AT}) / (1 - {EXACT_AT}) + {W_PRIOR} * hits / 50.0 + {W_POP} * ln(1 + least(n / 2.0, 50)), 6) AS score FROM c JOIN pop USING (label)),
ex AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query_id)) / {TEMPERATURE}) AS e FROM fused), prob AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS p FROM ex)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query_label, label, sim, hits, score): candidates by category with the weighted sum of their evidence."""
    from lodestone.plans.views import gallery

    c = retrieved(spark, sf_dir, 50).groupBy("query_id", "query_label", "label").agg(F.max("score").alias("sim"), F.count("*").alias("hits"))
    pop = gallery(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    sim, hits = F.col("sim"), F.col("hits")
    score: Column = W_SIM * sim + W_HITS * F.least(hits - 1, F.lit(3)) + W_EXACT * F.greatest(F.lit(0.0), sim - EXACT_AT) / (1 - EXACT_AT) + W_PRIOR * hits / 50.0 + W_POP * F.log(1 + F.least(F.col("n") / 2.0, F.lit(50.0)))
    return c.join(pop, "label").select("query_id", "query_label", "label", "sim", "hits", F.round(score, 6).alias("score"))


def softmax(rows: DataFrame, by: str, score: str, temperature: Column | float) -> DataFrame:
    """rows with p: the softmax of score over all rows of a key."""
    w = W.partitionBy(by)
    e = rows.withColumn("e", F.exp((F.col(score) - F.max(score).over(w)) / temperature))
    return e.withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


@query(f"WITH {SQL_PROB} SELECT query_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sim DESC, label) AS place FROM fused")
def fusion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in the order of their fused score."""
    return fused(spark, sf_dir).withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("sim"), "label")).cast("bigint")).select("query_id", "label", "score", "place")


@query(f"""WITH {SQL_PROB}, r AS (SELECT *, lead(p, 1, 0) OVER w AS next_p, row_number() OVER w AS place FROM prob WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, sim DESC, label))
 SELECT query_id, label, round(p, 5) AS p, CASE WHEN sim < {LEAST_SIM} THEN 'unknown' WHEN p >= {EXACT_P} AND p - next_p >= {EXACT_MARGIN} THEN 'exact' WHEN p >= {LIKELY_P} THEN 'likely' ELSE 'candidate' END AS tier FROM r WHERE place = 1""")
def answer_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate with its probability and tier: by probability, margin to the next and similarity."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("sim"), "label")
    r = softmax(fused(spark, sf_dir), "query_id", "score", TEMPERATURE).withColumns({"next_p": F.lead("p", 1, 0.0).over(w), "place": F.row_number().over(w)}).where("place = 1")
    p = F.col("p")
    tier = F.when(F.col("sim") < LEAST_SIM, "unknown").when((p >= EXACT_P) & (p - F.col("next_p") >= EXACT_MARGIN), "exact").when(p >= LIKELY_P, "likely").otherwise("candidate")
    return r.select("query_id", "label", F.round("p", 5).alias("p"), tier.alias("tier"))


@query(f"""WITH {SQL_PROB}, t(temp) AS (VALUES {", ".join(f"({x})" for x in GRID)}), x AS (SELECT temp, query_id, query_label, label, exp((score - max(score) OVER (PARTITION BY temp, query_id)) / temp) AS e FROM fused, t),
 y AS (SELECT temp, query_id, query_label, label, e / sum(e) OVER (PARTITION BY temp, query_id) AS p FROM x) SELECT temp, count(*) AS queries, round(avg(-ln(greatest(p, 1e-9))), 5) AS nll FROM y WHERE label = query_label GROUP BY temp""")
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean negative log-likelihood of the right candidate at each temperature of the grid; queries without it don't count."""
    x = fused(spark, sf_dir).withColumn("temp", F.explode(F.array(*[F.lit(t) for t in GRID]))).withColumn("key", F.struct("temp", "query_id"))
    y = softmax(x, "key", "score", F.col("temp")).where("label = query_label")
    return y.groupBy("temp").agg(F.count("*").alias("queries"), F.round(F.avg(-F.log(F.greatest("p", F.lit(1e-9)))), 5).alias("nll"))


@query(f"""WITH {SQL_PROB}, b AS (SELECT query_id, round(p, 3) AS p, label = query_label AS ok FROM prob QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sim DESC, label) = 1), t AS (SELECT DISTINCT p AS threshold FROM b)
 SELECT threshold, count(*) AS kept, round(avg(CAST(ok AS INT)), 6) AS precision FROM t JOIN b ON b.p >= t.threshold GROUP BY threshold""")
def threshold_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and support of the first answers at every threshold on their probability: running sums over distinct
    thresholds, so that no threshold is joined with the answers."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("sim"), "label")
    b = softmax(fused(spark, sf_dir), "query_id", "score", TEMPERATURE).withColumn("place", F.row_number().over(w)).where("place = 1")
    t = b.groupBy(F.round("p", 3).alias("threshold")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("query_label")).alias("k"))
    down = W.orderBy(F.desc("threshold"))  # one row for each of at most 1,001 thresholds
    return t.select("threshold", F.sum("n").over(down).alias("kept"), F.round(F.sum("k").over(down) / F.sum("n").over(down), 6).alias("precision"))


@query(f"WITH {SQL_PROB}, f AS (SELECT query_id, label % 3 AS family, sum(p) AS mass, count(*) AS members FROM prob GROUP BY ALL) SELECT query_id, family, round(mass, 5) AS mass, members FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mass DESC, family) = 1 AND mass >= 0.6 AND members >= 2")
def family_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family that holds most of the probability, six tenths at least, by two members or more."""
    f = softmax(fused(spark, sf_dir), "query_id", "score", TEMPERATURE).groupBy("query_id", (F.col("label") % 3).alias("family")).agg(F.sum("p").alias("mass"), F.count("*").alias("members"))
    best = f.groupBy("query_id").agg(F.max_by(F.struct("family", "mass", "members"), F.struct("mass", (-F.col("family")).alias("f"))).alias("b")).select("query_id", "b.*")
    return best.where("mass >= 0.6 and members >= 2").select("query_id", "family", F.round("mass", 5).alias("mass"), "members")


@query(f"""WITH {SQL_PROB}, r AS (SELECT *, first_value(score) OVER w AS leader, row_number() OVER w AS place FROM fused WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, label))
 SELECT query_id, label, score, CAST(floor((leader - score) / 0.1) AS BIGINT) AS tier FROM r""")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in bands of a tenth below the leader."""
    leader = F.max("score").over(W.partitionBy("query_id"))
    return fused(spark, sf_dir).select("query_id", "label", "score", F.floor((leader - F.col("score")) / 0.1).alias("tier"))


def fold_tiers(hits: Column, tolerance: float = 0.1) -> Column:
    """Numbers the tiers of sorted hits array<struct<score, ...>> with negative scores, the best first: a hit opens a new tier
    when its score is above (1 - tolerance) times that of the tier's first hit."""
    start = F.struct(F.lit(0).alias("tier"), F.lit(None).cast("double").alias("leader"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, h: Column) -> Column:
        opens = a["leader"].isNull() | (h["score"] > a["leader"] * (1 - tolerance))
        tier = F.when(opens, a["tier"] + 1).otherwise(a["tier"])
        return F.struct(tier.alias("tier"), F.when(opens, h["score"]).otherwise(a["leader"]).alias("leader"), F.concat(a["out"], F.array(tier)).alias("out"))

    return F.aggregate(hits, start, step, lambda a: a["out"])


def rerank_within_tiers(hits: DataFrame, tolerance: float = 0.1, least_boost: float = 0.05) -> DataFrame:
    """hits (query_id, item, score, boost): score negative, lower is better, -1e8 and below pinned -> with place.

    Pinned hits keep their places before all others; inside a tier (see fold_tiers) boosts of at least least_boost lead,
    greatest first, and the order by score decides the rest. Null boosts are 0; an empty table gives an empty result.
    """
    pinned = F.col("score") <= -1e8
    rest = hits.where(~pinned).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("score", "item", F.coalesce("boost", F.lit(0.0)).alias("boost")))).alias("hits"))
    rest = rest.select("query_id", F.posexplode(F.arrays_zip("hits", fold_tiers(F.col("hits"), tolerance).alias("tier"))).alias("pos", "x"))
    rest = rest.select("query_id", "x.hits.item", "x.hits.score", "x.hits.boost", "x.tier", "pos")
    every = hits.where(pinned).select("query_id", "item", "score", "boost", F.lit(0).alias("tier"), F.lit(0).alias("pos")).unionByName(rest)
    lift = F.when((F.col("tier") > 0) & (F.col("boost") >= least_boost), F.col("boost")).otherwise(0.0)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("tier", F.desc(lift), "pos", "score", "item"))
    return every.withColumn("place", place).select("query_id", "item", "score", "boost", "place")

"""Vector retrieval: exact top-k of stated queries against all rows, max-pooling, centroids, expansion, hard negatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.vectors import dot, unit
from lodestone.plans.scratch import fresh
from lodestone.plans.views import SQL_GALLERY, gallery
from lodestone.registry import query

#: A report's stated queries: every row whose id is divisible by this, against all rows.
EVERY = 20
#: Queries that the driver and each task hold at once, and those of one matrix product.
BLOCK, STEP = 4096, 256
SQL_DOT = "list_sum(list_transform(generate_series(1, 64), lambda i: a.v[i] * b.v[i]))"


def topk(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, place): the k rows of greatest dot product with each query, ties to the smaller id.

    Scores are rounded to 6 decimals before any row is left out, so ties are the same whatever the batches; they are below
    1e8 in size. Up to BLOCK queries go to every task as one matrix; each Arrow batch is one matrix product and keeps k rows a query, so
    what is shuffled is k rows a query and batch, whatever the number of rows. More queries are dealt into blocks by id and
    answered block by block into one written table, so that driver and tasks hold one block at a time.
    """
    asked = asked.select("query_id", "v")
    held = asked.limit(BLOCK + 1).collect()
    if len(held) <= BLOCK:
        return _block(rows, held, k)
    spark, n = rows.sparkSession, -(-asked.count() // (BLOCK // 2))  # half full on average, as ids are dealt by hash
    path = fresh(spark)
    for i in range(n):
        held = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).collect()
        _block(rows, held, k).write.mode("append").parquet(path)
    return spark.read.schema("query_id bigint, vec_id bigint, score double, place bigint").parquet(path)


def _block(rows: DataFrame, held: list, k: int) -> DataFrame:
    """topk for the queries held."""
    ids, matrix = np.array([r[0] for r in held], dtype=np.int64), np.array([r[1] for r in held], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            own = np.array(batch.column(0), dtype=np.int64)
            v = np.array(batch.column(1).flatten(), dtype=np.float64).reshape(len(own), -1)
            minor = np.empty(len(own), dtype=np.int64)
            minor[np.argsort(own, kind="stable")] = np.arange(len(own))[::-1]
            for low in range(0, len(ids), STEP):
                scores = matrix[low : low + STEP] @ v.T
                # One whole number a row, unique in the batch, in the order of the result: rounded score, then smaller id.
                key = (np.sign(scores) * np.floor(np.abs(scores) * 1e6 + 0.5)).astype(np.int64) * len(own) + minor
                n = min(k, len(own))
                best = np.argpartition(-key, n - 1, axis=1)[:, :n]
                score = (np.take_along_axis(key, best, 1) // len(own)) / 1e6
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[low : low + STEP], n)), pa.array(own[best].ravel()), pa.array(score.ravel())], names=["query_id", "vec_id", "score"])

    found = rows.select("vec_id", "v").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place.cast("bigint")).where(F.col("place") <= k)


SQL_TOP = f"""{SQL_GALLERY}, q AS (SELECT vec_id AS query_id, label, v FROM gallery WHERE vec_id % {EVERY} = 0),
scored AS (SELECT a.query_id, a.label AS query_label, b.vec_id, b.label, round({SQL_DOT}, 6) AS score FROM q a, gallery b WHERE a.query_id <> b.vec_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored QUALIFY place <= 50)"""


def retrieved(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The stated queries' top rows other than themselves, with both labels."""
    g = gallery(spark, sf_dir)
    asked = g.where(F.col("vec_id") % EVERY == 0)
    found = topk(g, asked.select(F.col("vec_id").alias("query_id"), "v"), k + 1).where("query_id <> vec_id")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("bigint")
    found = found.withColumn("place", place).where(F.col("place") <= k)
    return found.join(g.select("vec_id", "label"), "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")


@query(f"WITH {SQL_TOP} SELECT query_id, vec_id, score, place FROM top WHERE place <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of each query."""
    return retrieved(spark, sf_dir, 10).select("query_id", "vec_id", "score", "place")


@query(f"WITH {SQL_TOP} SELECT query_id // 40 AS request, label, max(score) AS best, count(DISTINCT query_id) AS hits FROM top WHERE place <= 30 GROUP BY ALL")
def vector_maxpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants a request, each with its own row budget: best score of each category and the number of variants it came up in."""
    return retrieved(spark, sf_dir, 30).groupBy(F.floor(F.col("query_id") / (2 * EVERY)).alias("request"), "label").agg(F.max("score").alias("best"), F.countDistinct("query_id").alias("hits"))


@query(f"WITH {SQL_TOP}, w AS (SELECT query_id, vec_id, round(score * CASE WHEN vec_id % 4 = 0 THEN 0.9 ELSE 1.0 END, 6) AS score FROM top WHERE place <= 30) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM w QUALIFY place <= 10")
def photo_weighted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo rows weigh less, after the row budget and before the final cut."""
    w = retrieved(spark, sf_dir, 30).select("query_id", "vec_id", F.round(F.col("score") * F.when(F.col("vec_id") % 4 == 0, 0.9).otherwise(1.0), 6).alias("score"))
    return w.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("bigint")).where("place <= 10")


@query(f"WITH {SQL_TOP}, n AS (SELECT query_id, vec_id, score FROM top WHERE label <> query_label) SELECT query_id, vec_id, score FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 4")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest rows of other categories among the fifty nearest."""
    n = retrieved(spark, sf_dir, 50).where("label <> query_label")
    return n.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where("r <= 4").select("query_id", "vec_id", "score")


SQL_CENTROIDS = f"""{SQL_GALLERY}, e AS (SELECT label, unnest(generate_series(1, 64)) AS pos, unnest(v) AS x FROM gallery), m AS (SELECT label, pos, avg(x) AS x FROM e GROUP BY ALL),
centroid AS (SELECT label, list(x / n ORDER BY pos) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) + 1e-8 AS n FROM m) GROUP BY label)"""


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, v): mean vector of each category at unit length, averaged by position so that tasks send sums only."""
    mean = gallery(spark, sf_dir).select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return mean.select("label", unit(F.col("v")).alias("v"))


@query(f"WITH {SQL_CENTROIDS} SELECT label, round(v[1], 6) AS first_x, round(v[64], 6) AS last_x, round(list_sum(v), 5) AS total FROM centroid")
def category_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids in short: two positions and the sum."""
    return centroids(spark, sf_dir).select("label", F.round(F.element_at("v", 1), 6).alias("first_x"), F.round(F.element_at("v", 64), 6).alias("last_x"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"""WITH {SQL_CENTROIDS}, s AS (SELECT a.vec_id, b.label, {SQL_DOT} AS s FROM (SELECT vec_id, v FROM gallery) a, centroid b), p AS (SELECT vec_id, label, exp((s - max(s) OVER w) / 0.05) AS p FROM s WINDOW w AS (PARTITION BY vec_id))
 SELECT vec_id, label, round(p / sum(p) OVER (PARTITION BY vec_id), 5) AS p FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) = 1""")
def category_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category of every row: the softmax of its products with the centroids at temperature 0.05. One row holds the few centroids."""
    held = centroids(spark, sf_dir).agg(F.sort_array(F.collect_list(F.struct("label", "v"))).alias("centroids"))
    scored = gallery(spark, sf_dir).join(F.broadcast(held)).select("vec_id", F.transform("centroids", lambda c: F.struct(dot(F.col("v"), c["v"]).alias("s"), (-c["label"]).alias("minus"))).alias("s"))
    best = F.array_max("s")
    scored = scored.withColumn("best", best)
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp((x["s"] - F.col("best.s")) / 0.05))
    return scored.select("vec_id", (-F.col("best.minus")).alias("label"), F.round(1 / total, 5).alias("p"))


@query(f"""WITH {SQL_TOP}, near AS (SELECT query_id, vec_id, greatest(score, 0) AS w FROM top WHERE place <= 3), e AS (SELECT query_id, pos, sum(x) AS x FROM (
  SELECT query_id, unnest(generate_series(1, 64)) AS pos, unnest(v) AS x FROM q UNION ALL SELECT query_id, unnest(generate_series(1, 64)), unnest(list_transform(v, lambda x: x * w * w * w)) FROM near JOIN gallery USING (vec_id)) t GROUP BY ALL)
 SELECT query_id, pos, round(x / (sqrt(sum(x * x) OVER (PARTITION BY query_id)) + 1e-8), 5) AS x FROM e""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with their three nearest rows added, weighed by the cube of their scores, at unit length."""
    g = gallery(spark, sf_dir)
    near = retrieved(spark, sf_dir, 3).select("query_id", "vec_id", F.pow(F.greatest("score", F.lit(0.0)), F.lit(3.0)).alias("w")).join(g.select("vec_id", "v"), "vec_id")
    e = near.select("query_id", F.posexplode("v").alias("pos", "x"), "w").select("query_id", "pos", (F.col("x") * F.col("w")).alias("x"))
    e = e.unionByName(g.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.posexplode("v").alias("pos", "x")))
    s = e.groupBy("query_id", "pos").agg(F.sum("x").alias("x"))
    return s.select("query_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round(F.col("x") / (F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("query_id"))) + 1e-8), 5).alias("x"))


@query(f"WITH {SQL_GALLERY} SELECT count(*) AS vectors, max(len(v)) AS dim, count(DISTINCT label) AS categories, round(avg(sqrt(list_sum(list_transform(v, lambda x: x * x)))), 5) AS mean_length FROM gallery")
def gallery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, dimension and mean length of the gallery."""
    return gallery(spark, sf_dir).agg(F.count("*").alias("vectors"), F.max(F.size("v")).cast("bigint").alias("dim"), F.countDistinct("label").alias("categories"), F.round(F.avg(F.sqrt(dot(F.col("v"), F.col("v")))), 5).alias("mean_length"))


@query(f"WITH {SQL_TOP} SELECT query_id, round(avg(CAST(label = query_label AS INT)), 6) AS recall_at_10, coalesce(min(CASE WHEN label = query_label THEN place END), 0) AS first_right, coalesce(round(1.0 / min(CASE WHEN label = query_label THEN place END), 6), 0.0) AS rr FROM top WHERE place <= 10 GROUP BY query_id")
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of right categories among the ten nearest, and the place of the first right one; 0 where none is."""
    right = F.min(F.when(F.col("label") == F.col("query_label"), F.col("place")))
    return retrieved(spark, sf_dir, 10).groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("query_label")).cast("int")), 6).alias("recall_at_10"), F.coalesce(right, F.lit(0)).alias("first_right"), F.coalesce(F.round(1.0 / right, 6), F.lit(0.0)).alias("rr"))

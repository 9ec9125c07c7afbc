"""A kept vector index: rows in cells around fitted centroids, versions with appends, category means merged by counts, search of the nearest cells."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.vectors import unit
from lodestone.operators.vector import EVERY, SQL_CENTROIDS, SQL_TOP, retrieved
from lodestone.plans import versions
from lodestone.plans.scratch import cut, fresh
from lodestone.plans.views import gallery
from lodestone.registry import query

#: Rows and queries of one group of a search.
ROWS, QUERIES = 20_000, 2_048
KIND = "vec_id bigint, label bigint, photo boolean, v array<double>, cell int"
HITS = "query_id bigint, vec_id bigint, score double"


class Broken(ValueError):
    """What is kept doesn't fit together."""


def fit_cells(rows: DataFrame, cells: int, sample: int = 50_000, seed: int = 7) -> np.ndarray:
    """Centres of at most `cells` cells by k-means over `sample` rows, those of the smallest hash of their id. The driver gets the
    centres only; an empty table has one cell around 0."""
    picked = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    dim = picked.select(F.size("v")).first()
    if dim is None:
        return np.zeros((1, 1))
    picked = cut(picked.select(array_to_vector("v").alias("features")))
    k = min(cells, picked.distinct().count())
    if k < 2:
        return np.zeros((1, dim[0]))
    return np.array(KMeans(k=k, seed=seed, maxIter=20).fit(picked).clusterCenters())


def nearest_cells(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """rows (with v) and `cells`: the n nearest centres, nearest first; ties to the smaller number."""
    half = (centres * centres).sum(axis=1) / 2
    n = min(n, len(centres))
    kind = rows.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column("v").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            far = half - v @ centres.T if v.shape[1] == centres.shape[1] else np.zeros((batch.num_rows, len(centres)))
            best = np.argsort(far, axis=1, kind="stable")[:, :n].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(best), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(run, f"{kind}, cells array<int>")


def means(rows: DataFrame) -> DataFrame:
    """(label, n, v): count and mean vector of each label; tasks send sums by position only."""
    sums = rows.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return sums.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))


def merged_means(one: DataFrame, other: DataFrame) -> DataFrame:
    """Means of both, weighed by their counts."""
    both = one.unionByName(other).select("label", "n", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    return both.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))


def _put(rows: DataFrame, path: str, facts: dict, centres: np.ndarray, files: int) -> dict:
    """Writes rows (vec_id, label, photo, v) as a segment, and what follows for the facts."""
    spark, folder = rows.sparkSession, versions.new_folder(path)
    placed = nearest_cells(rows, centres, 1).withColumn("cell", F.col("cells")[0]).drop("cells")
    placed.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(files))).write.partitionBy("cell").parquet(f"{folder}/rows")
    new = spark.read.schema(KIND).parquet(f"{folder}/rows")
    odd = new.where(F.size("v") != F.lit(centres.shape[1])).select("vec_id").first() if facts.get("n") or new.limit(1).count() else None
    if odd is not None:
        raise Broken(f"row {odd[0]} has another dimension than {centres.shape[1]}")
    old = spark.read.schema("label bigint, n bigint, v array<double>").parquet(facts["means"]) if facts else means(new).where("false")
    merged_means(old, means(new)).write.parquet(f"{folder}/means")
    sizes = dict(new.groupBy("cell").count().collect())  # a row a cell
    cells = {str(c): facts.get("cells", {}).get(str(c), 0) + sizes.get(c, 0) for c in range(len(centres))}
    return {"segments": [*facts.get("segments", []), f"{folder}/rows"], "means": f"{folder}/means", "n": sum(cells.values()), "cells": cells}


def create_index(rows: DataFrame, path: str, cells: int = 64, sample: int = 50_000, files: int = 4) -> None:
    """Writes an index of rows (vec_id, label, v) at a path, or puts a new one in place of what is there.

    Cells are fitted on at most `sample` rows; every row is put into the cell whose centre is nearest. Rows without id or
    vector are left out; of rows that repeat an id the one of the greatest vector stays. Rows of another dimension than the sample's raise
    Broken, and what was in use stays in use.
    """
    spark = rows.sparkSession
    after, _ = versions.current(spark, path)
    own = cut(_own(rows, False))
    centres = fit_cells(own, cells, sample)
    folder = versions.new_folder(path)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, v array<double>").write.parquet(f"{folder}/centres")
    versions.publish(spark, path, after, {"centres": f"{folder}/centres", "files": files} | _put(own, path, {}, centres, files))


def _own(rows: DataFrame, photo: bool) -> DataFrame:
    own = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.lit(photo).alias("photo"), F.col("v").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    return own.groupBy("vec_id").agg(F.max(F.struct("v", "label", "photo")).alias("x")).select("vec_id", "x.label", "x.photo", "x.v")


def append_rows(spark: SparkSession, path: str, rows: DataFrame, photo: bool = False) -> int:
    """Adds the rows whose id the index hasn't got, to the cells it has, and merges the category means by counts. Returns how
    many were new; nothing is published for none."""
    after, facts = versions.current(spark, path)
    new = cut(_own(rows, photo).join(_rows(spark, facts).select("vec_id"), "vec_id", "left_anti"))
    n = new.count()
    if n:
        versions.publish(spark, path, after, facts | _put(new, path, facts, _centres(spark, facts), facts["files"]))
    return n


def _rows(spark: SparkSession, facts: dict, cells: list[int] | None = None) -> DataFrame:
    read = [spark.read.schema(KIND).parquet(s) for s in facts["segments"]]
    return reduce(DataFrame.unionByName, read if cells is None else [r.where(F.col("cell").isin(cells)) for r in read])


def _centres(spark: SparkSession, facts: dict) -> np.ndarray:
    return np.array([r.v for r in spark.read.schema("cell int, v array<double>").parquet(facts["centres"]).orderBy("cell").collect()])


def load_index(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(version, rows) of what is in use, after a check that there are as many ids as vectors and as many as the version says;
    Broken otherwise, and where nothing is there. A reader that keeps the number sees by `versions.current` when to load anew."""
    number, facts = versions.current(spark, path)
    if not number:
        raise Broken(f"{path}: no index")
    rows = _rows(spark, facts)
    got = rows.agg(F.count("*"), F.count_distinct("vec_id"), F.count("v")).first()
    if set(got) != {facts["n"]}:
        raise Broken(f"{path}: {got[0]} rows, {got[1]} ids and {got[2]} vectors instead of {facts['n']}")
    return number, rows


def category_means(spark: SparkSession, path: str) -> DataFrame:
    """(label, n, v): the categories' mean vectors at unit length."""
    facts = versions.current(spark, path)[1]
    return spark.read.schema("label bigint, n bigint, v array<double>").parquet(facts["means"]).select("label", "n", unit(F.col("v")).alias("v"))


def search_cells(spark: SparkSession, path: str, asked: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, place): the k rows of greatest dot product with each query (query_id, v) in the `probes` cells that are
    nearest to it, in all cells where probes is None; ties to the smaller id.

    Only the folders of cells that some query probes are read. Rows of a cell and its queries meet in groups of about ROWS
    rows and QUERIES queries, whose numbers follow from the sizes of cells and queries, so a large cell or a popular one
    takes more groups instead of a larger one; a group sends k rows a query.
    """
    facts = versions.current(spark, path)[1]
    centres = _centres(spark, facts)
    sizes = spark.createDataFrame([(int(c), max(1, -(-n // ROWS))) for c, n in facts["cells"].items()], "cell int, parts int")
    wanted = cut(nearest_cells(asked.select("query_id", "v"), centres, probes or len(centres)).select("query_id", "v", F.explode("cells").alias("cell")))
    counted = wanted.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")).join(F.broadcast(sizes), "cell")  # a row a cell
    counted = cut(counted)
    cells = sorted(r.cell for r in counted.select("cell").collect())
    dealt = lambda table, own, name: table.withColumn(name, F.pmod(F.xxhash64(own), F.col(f"{name}s")).cast("int"))
    spread = lambda table, name: table.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1)))
    left = spread(dealt(_rows(spark, facts, cells).select("cell", "vec_id", "v").join(F.broadcast(counted), "cell"), "vec_id", "part"), "block").select("cell", "part", "block", "vec_id", "v")
    right = spread(dealt(wanted.join(F.broadcast(counted), "cell"), "query_id", "block"), "part").select("cell", "part", "block", "query_id", "v")

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, own = np.array(queries["query_id"]), np.array(rows["vec_id"])
        if not len(ids) or not len(own):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, v = (np.array(t["v"].combine_chunks().flatten(), dtype=np.float64).reshape(len(t), -1) for t in (queries, rows))
        order = np.argsort(own, kind="stable")  # equal scores keep the smaller id
        own, v, n, out = own[order], v[order], min(k, len(own)), []
        for low in range(0, len(ids), 256):
            scores = np.round(q[low : low + 256] @ v.T, 6)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :n]
            out.append((np.repeat(ids[low : low + 256], n), own[best].ravel(), np.take_along_axis(scores, best, 1).ravel()))
        return pa.table({name: pa.array(np.concatenate(c)) for name, c in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    keys = ("cell", "part", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, HITS)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("bigint")
    return found.withColumn("place", place).where(F.col("place") <= k)


def _two_appends(spark: SparkSession, sf_dir: str) -> str:
    """The gallery, indexed in three steps whose rows overlap."""
    g, path = gallery(spark, sf_dir), fresh(spark)
    create_index(g.where("vec_id % 3 = 0"), path, cells=24)
    append_rows(spark, path, g.where("vec_id % 3 <= 1"))
    append_rows(spark, path, g, photo=True)
    return path


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gallery(spark, sf_dir).where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "v")


def _others(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("bigint")
    return found.where("query_id <> vec_id").withColumn("place", place).where(F.col("place") <= k)


@query(f"WITH {SQL_TOP} SELECT query_id, vec_id, score, place FROM top WHERE place <= 10")
def index_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of each query from an index with appends, all of whose cells are searched."""
    return _others(search_cells(spark, _two_appends(spark, sf_dir), _asked(spark, sf_dir), 11), 10)


@query(f"WITH {SQL_TOP} SELECT count(DISTINCT query_id) AS queries, TRUE AS enough, TRUE AS fewer FROM top WHERE place <= 10")
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the nearest cells, three quarters of all, hold at least nine of ten of the ten nearest rows over all queries, held
    against exact top k; and whether that is fewer cells than all. The given vectors point evenly in all directions, so
    cells tell little about them; clustered ones need far fewer (see the tests)."""
    path = _two_appends(spark, sf_dir)
    facts = versions.current(spark, path)[1]
    found = _others(search_cells(spark, path, _asked(spark, sf_dir), 11, probes=-(-3 * len(facts["cells"]) // 4)), 10)
    exact = retrieved(spark, sf_dir, 10).select("query_id", "vec_id")
    right = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("one")), ["query_id", "vec_id"], "left")
    return right.agg(F.count_distinct("query_id").alias("queries"), (F.avg(F.coalesce("one", F.lit(0))) >= 0.9).alias("enough")).withColumn("fewer", F.lit(len(facts["cells"]) > 1))


@query(f"WITH {SQL_CENTROIDS} SELECT label, n, round(v[1], 6) AS first_x, round(v[64], 6) AS last_x, round(list_sum(v), 5) AS total FROM centroid JOIN (SELECT label, count(*) AS n FROM gallery GROUP BY 1) c USING (label)")
def appended_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories' means after two appends are those of all rows."""
    m = category_means(spark, _two_appends(spark, sf_dir))
    return m.select("label", "n", F.round(F.element_at("v", 1), 6).alias("first_x"), F.round(F.element_at("v", 64), 6).alias("last_x"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT count(*) AS vectors, count(*) FILTER (WHERE vec_id % 3 = 2) AS photos, 3 AS version FROM embeddings")
def loaded_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the loaded index, and those that were appended as photos."""
    number, rows = load_index(spark, _two_appends(spark, sf_dir))
    return rows.agg(F.count("*").alias("vectors"), F.count_if("photo").alias("photos")).withColumn("version", F.lit(number))

"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing to target weights, packing.

Every stage works on the whole of what its predecessor kept. Each function takes (spark, docs, sf_dir); all but the last
return the columns of documents. Stages decide about rows, not ids: a row without id, or one that repeats another's id with
another text, is a document like all others. Rows without text are empty documents: stages keep them but for exact copies.
Empty tables give empty results. Stages run jobs while their plans are built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import mixing, queries
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.minhash import near_dedup
from lodestone.llm.packing import pack
from lodestone.llm.shared import ascii_lower, cut
from lodestone.llm.toxicity import score
from lodestone.plans.scratch import temporary

#: None: no stage but exact dedup can be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored under the threshold; the model is fitted on the labelled rows outside the held-out quarter."""
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    columns = tuple(docs.columns)
    return score(docs, model, keep=columns, out="__score").where(F.col("__score") < queries.THRESHOLD).select(*columns)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for the case of A-Z, one row with the largest doc_id; of none with an id, any one row."""
    name = lambda i, digest: F.concat_ws(":", digest, F.coalesce(i.cast("string"), F.lit("none")))
    dropped = exact_dedup(docs).where("not kept").select(name(F.col("doc_id"), F.col("text_sha256")).alias("__row")).distinct()
    own = docs.withColumn("__row", name(F.col("doc_id"), F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)))
    return own.join(cut(dropped), "__row", "left_anti").dropDuplicates(["__row"]).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id: five-word shingles, similarity 0.8 or more."""
    numbered = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = cut(near_dedup(numbered, id_col="__row", k=5, percent=80).select(F.col("doc_id").alias("__row"), "component_id"))
    ids = found.join(numbered.select("__row", "doc_id"), "__row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    dropped = found.join(first.select("component_id", F.col("first.__row").alias("kept")), "component_id").where("__row <> kept").select("__row")
    return numbered.join(cut(dropped), "__row", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a document without words, which no target counts, stays once."""
    taken = cut(mixing.shares(mixing.sized(docs)).select(*[F.col(c).alias(f"__{c}") for c in mixing.ALIKE], "n", "total").withColumnsRenamed({"n": "__n", "total": "__total"}))
    own = docs.withColumn("__words", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long"))
    alike = own["doc_id"].eqNullSafe(taken["__doc_id"]) & own["source"].cast("string").eqNullSafe(taken["__source"]) & (own["__words"] == taken["__size"])
    total = F.when(F.col("__words") > 0, F.col("__total")).otherwise(F.col("__n"))
    single = own.join(taken.where("__n = 1"), alike).withColumn("__copies", total)
    several = own.join(taken.where("__n > 1"), alike)  # rows alike in id, source and size share what all of them get
    place = F.row_number().over(W.partitionBy("__doc_id", "__source", "__size").orderBy(F.xxhash64("text")))
    several = several.withColumn("__copies", mixing.nth(total, F.col("__n"), place))
    both = single.unionByName(several).where("__copies > 0")
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024."""
    return queries.packed(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", dedup_exact), ("near dedup", dedup_near), ("mixing", mix), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again as the next one's input; what a stage wrote on its way is
    deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = _written(spark, stage, docs, sf_dir)
    return STAGES[-1][1](spark, docs, sf_dir)


def _written(spark: SparkSession, stage, docs: DataFrame, sf_dir: str) -> DataFrame:
    with temporary(spark):
        result = stage(spark, docs, sf_dir)
        with temporary(spark, keep=True):
            return cut(result)

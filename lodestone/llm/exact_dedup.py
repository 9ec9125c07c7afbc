"""Exact dedup by skew-safe combining, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import ascii_lower, cut


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document with the document that stays for its text.

    Texts are equal when identical after lower-casing A-Z; the largest id of a group stays. Three combining stages, each
    of which groups by the full content and not by the digest alone: within each task (the partial aggregate), over the
    tasks that share a salt, and over the salts. A group of copies of any size reaches a task as at most one row per
    sending task, then as one row per salt. On the way back a document finds its group by digest where all texts with that
    digest were found equal; a digest of different texts sends its documents back by full content. Only groups of two or
    more take part, and Spark splits the documents of a hot digest between tasks.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Null text counts as empty. Rows that repeat an id count in
    group_size and share their decision. A row without id never stays if its group has one with an id; a group without
    any id has keep_id null and stays. An empty table gives an empty result; other columns are ignored. Runs jobs while the
    plan is built.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("content"))
    own = own.withColumn("digest", digest(F.col("content")))
    salted = own.groupBy("digest", "content", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    groups = salted.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    digests = groups.groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size")).where("group_size > 1")
    digests = cut(digests.withColumn("copied", F.lit(True)))
    found = own.select("doc_id", "digest").join(digests, "digest", "left")
    if digests.where("texts > 1").limit(1).count():
        several = digests.where("texts > 1").select("digest")
        exact = own.join(several, "digest").join(groups.select("digest", "content", "keep_id", F.col("n").alias("group_size")), ["digest", "content"])
        exact = exact.select("doc_id", "digest", F.lit(1).cast("bigint").alias("texts"), "keep_id", "group_size", F.lit(True).alias("copied"))
        found = found.where("texts is null or texts = 1").unionByName(exact)
    keep = F.when(F.col("copied"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.shared import cut

#: Fixed value: a word is a run of anything but these.
WORD = r"[^\x20\x09-\x0D]+"
_MASK = (1 << 64) - 1
#: What makes rows alike: they can change places without a trace in the result.
ALIKE = ["doc_id", "source", "size"]


def _draw(*parts: int) -> float:
    """Uniform in [0, 1) from whole numbers, the same at every run."""
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = (x ^ (p & _MASK)) * 0xBF58476D1CE4E5B9 & _MASK
        x = (x ^ x >> 29) * 0x94D049BB133111EB & _MASK
        x ^= x >> 32
    return (x >> 11) / (1 << 53)


def pivotal(keys: list[int], sizes: list[int], shares: list[float], seed: int) -> list[float]:
    """Pairs fractional shares in order and moves words within a pair, at random but keeping every expectation, until one of
    the two is integral; the other meets the next. The words that the shares stand for stay as they were; at most one share
    stays fractional."""
    out, held = list(shares), None
    for i, p in enumerate(shares):
        if not 1e-9 < p < 1 - 1e-9:
            out[i] = float(round(p))
            continue
        if held is None:
            held = i
            continue
        a, s, t = out[held], sizes[held], sizes[i]
        up, down = min((1 - a) * s, p * t), min(a * s, (1 - p) * t)  # words that the held one can gain or give
        moved = up if _draw(seed, keys[held], keys[i], i) * (up + down) < down else -down
        for k, share in ((held, a + moved / s), (i, p - moved / t)):
            out[k] = float(round(share)) if min(share, 1 - share) < 1e-9 else share
        left = [k for k in (held, i) if 0 < out[k] < 1]
        held = left[0] if left else None
    return out


def targets(totals: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """totals (source, source_size), one row per source -> with its number by code point (null last) and target.

    All sizes together are shared by weight; a target stops at cap times its source's size and the excess is shared again,
    which comes to one level: target = least(cap * size, level * weight). Sorted by where they stop, the level is the
    greatest of what is left to share over the weight that is left. One task sorts the sources, a row each.
    """
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    own = totals.withColumn("source_no", number).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("source_no", F.lit(len(weights))) + 1))
    own = own.withColumn("most", F.col("source_size") * float(cap))
    every, order = W.partitionBy(), W.orderBy(F.col("most") / F.col("w"), "source_no")
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    own = own.withColumn("level", left / rest)
    return own.select("source", "source_size", "source_no", F.least("most", F.max("level").over(every) * F.col("w")).alias("target"))


def _round(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    rows = rows.sort_values(["size", "tag"], ascending=[False, True], kind="stable")
    return rows.assign(p=pivotal(rows["tag"].tolist(), rows["size"].tolist(), rows["p"].tolist(), seed))


def _grouped(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """Rounds within groups of about `most` rows: those of one source are dealt by hash to as many chunks as that takes."""
    sizes = cut(rows.groupBy("source_no").agg(F.ceil(F.count("*") / most).alias("chunks")))
    dealt = rows.join(sizes, "source_no").withColumn("chunk", F.pmod(F.xxhash64("tag", F.lit(seed)), F.col("chunks"))).drop("chunks")
    return cut(dealt.groupBy("source_no", "chunk").applyInPandas(lambda rows: _round(rows, seed), dealt.schema))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source and size: the number of words of the text, 0 for null."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))


def shares(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, seed: int = 0, chunk: int = 256) -> DataFrame:
    """rows (doc_id, source, size) -> one row for all that are alike: ALIKE, n, source_size, target, total: the copies of all n.

    Every document of a source has the share target / source_size of copies: its whole part for sure, the fractional part
    by pivotal rounding. Leaves of the reduction tree are chunks of one source, sorted from large to small; words move
    within pairs, so a chunk keeps its sum of words but for one fractional document. These residuals meet, `chunk` at a time,
    until one is left for a source, which a draw of its own rounds up or down by its share. So every document has its
    expected number of copies, and a source misses its target by less than the size of one document. Alike rows count as
    one whose last copy is rounded. Groups are bounded by chunk, whatever a source holds.
    """
    alike = cut(rows.groupBy(*ALIKE).agg(F.count("*").alias("n")))
    totals = cut(targets(alike.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap))
    share: Column = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size") * F.col("n")).otherwise(0.0)
    own = alike.join(totals, alike["source"].eqNullSafe(totals["source"])).select(alike["*"], "source_no", "source_size", "target", F.floor(share).alias("whole"), (share - F.floor(share)).alias("p"))
    leaves = _grouped(own.withColumn("tag", F.xxhash64("doc_id", "size")), chunk, seed)
    inner = (F.col("p") > 0) & (F.col("p") < 1)
    leaf = F.xxhash64("source_no", "chunk")  # at most one fractional row in each
    rest = cut(leaves.where(inner).select("source_no", "size", leaf.alias("tag"), "p"))
    settled, level = rest.where("false").select("source_no", "tag", "p"), 1
    while rest.groupBy("source_no").count().where("count > 1").limit(1).count():
        rounded = _grouped(rest, chunk, seed + level)
        settled = settled.unionByName(rounded.where(~inner).select("source_no", "tag", "p"))
        rest = rounded.where(inner).select("source_no", "size", "tag", "p")
        level += 1
    draw = F.pmod(F.xxhash64("source_no", "tag", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    settled = settled.unionByName(rest.select("source_no", "tag", F.when(draw < F.col("p"), 1.0).otherwise(0.0).alias("p")))
    ends = leaves.where(inner).withColumn("tag", leaf).drop("p").join(settled, ["source_no", "tag"])
    columns = (*ALIKE, "n", "source_no", "source_size", "target", (F.col("whole") + F.col("p")).cast("long").alias("total"))
    return leaves.where(~inner).select(*columns).unionByName(ends.select(*columns))


def nth(total: Column, n: Column, i: Column) -> Column:
    """Copies of the i-th of n alike rows, counted from 1, so that all have `total` and none differs from another by over one."""
    return (F.floor(total / n) + F.when(i <= total % n, 1).otherwise(0)).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, seed: int = 0, chunk: int = 256) -> DataFrame:
    """How many whole copies of each document a mix takes, so that each source's words come near its target (see shares).

    Returns doc_id, size, source_no, source_size, target, copies: a row per document. Null or empty text has size 0 and takes
    nothing, as its copies have no words. The null source is a source, the last. Repeated rows, and rows without id, are
    documents of their own. With no words at all every target is 0. An empty table gives an empty result; other columns are
    ignored. Runs on the same rows agree, in whatever order they come. Runs jobs while the plan is built.
    """
    each = shares(sized(docs, id_col, text_col, source_col), weights, cap, seed, chunk)
    block = 4096  # alike rows are dealt out by blocks, so that no list grows with them
    each = each.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    each = each.withColumn("i", F.explode(F.sequence(F.col("block") * block + 1, F.least(F.col("n"), (F.col("block") + 1) * block))))
    return each.select("doc_id", "size", "source_no", "source_size", "target", nth(F.col("total"), F.col("n"), F.col("i")).alias("copies"))

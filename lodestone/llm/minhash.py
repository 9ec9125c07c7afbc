"""MinHash near-dedup with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.shared import cut, freed, mix, seeds, shingles, steps, words


def collections_for(threshold: float, rows: int, miss: float = 3e-4) -> int:
    """Fewest collections of `rows` minhashes of which two or more agree, but for a share `miss`, at the threshold."""
    p, m = threshold**rows, 2
    while (1 - p) ** m + m * p * (1 - p) ** (m - 1) > miss:
        m += 1
    return m


def _signatures(k: int, m: int, r: int):
    factor, shift = seeds(m * r, 101) | np.uint64(1), seeds(m * r, 202)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in steps(batch.column(1)):
                hashes, rows, _, _ = words(data, offsets)
                sets, ends = shingles(hashes, rows, high - low, k)
                sizes = np.diff(ends)
                full = np.flatnonzero(sizes)
                keys = np.zeros((len(full), m), dtype=np.uint64)
                for j in range(m if len(full) else 0):
                    for i in range(r):
                        least = np.minimum.reduceat(sets * factor[j * r + i] + shift[j * r + i], ends[:-1][full])
                        keys[:, j] = mix(keys[:, j] * np.uint64(31) + least + np.uint64(j))
                held = np.concatenate(([0], np.cumsum(np.where(sizes > 0, m, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(held), pa.array(keys.reshape(-1).view(np.int64)))
                raw = [blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sizes), pa.array(raw, pa.binary()), lists], names=["doc_id", "n_shingles", "digest", "keys"])

    return run


def _sets(k: int):
    """Full sets of the wanted texts: rows (id, text, node, digest) whose set has that digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3).to_pylist()
            for low, high, data, offsets in steps(batch.column(1)):
                hashes, rows, _, _ = words(data, offsets)
                sets, ends = shingles(hashes, rows, high - low, k)
                grouped = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sets.view(np.int64)))
                right = pa.array([blake2b(sets[a:b].tobytes(), digest_size=16).digest() == wanted[low + i] for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))], pa.bool_())
                own = pa.RecordBatch.from_arrays([batch.column(2).slice(low, high - low), grouped], names=["node", "shingles"])
                yield own.filter(right)

    return run


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v) with their full sets x and y and the size i of what they share."""
    x, y = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    both = pairs.join(x.hint("merge"), "u").join(y.hint("merge"), "v")
    return both.withColumn("i", F.size(F.array_intersect("x", "y")).cast("long"))


def _linked(percent: int) -> Column:
    return 100 * F.col("i") >= percent * (F.size("x") + F.size("y") - F.col("i"))


def _marks(groups: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """groups (u, v, added, missing, x_size): members v of hubs u with what they have beyond the hub and lack of it ->
    the members restated against their group's consensus, (u, v, best): the member to compare each with, and (u, v, mark): two
    members that can be linked, though not through the best, share a mark.

    Differences are restated against the group's consensus C, the hub with every difference that most members have, so that
    the hub's own oddities are nobody's difference. With A and R what v has beyond C and lacks of it, the similarity of v and
    w is (|C| - |R v| - |R w| + s) / (|C| + |A v| + |A w| - s), s being the differences they share. Let t be the threshold
    and c = |R| + t |A|. Without shared differences, v and w are linked just if c(v) + c(w) <= (1 - t) |C|, so whatever can be
    linked in that way is linked to the member of least c, the best. With shared ones, c(w) is at least |R shared| +
    t |A shared|, so a link needs |A shared| + t |R shared| >= need = c(v) - (1 - t) |C|. In any fixed order (here: rarest first) the
    first shared difference lies before the point from which the differences left weigh less than need; those before it are
    the marks, or all where need is not above 0.
    """
    t = percent / 100
    rows = groups.select("u", "v", F.explode(F.concat(F.transform("added", lambda e: F.struct(F.lit(1).alias("side"), e.alias("e"))), F.transform("missing", lambda e: F.struct(F.lit(0).alias("side"), e.alias("e"))))).alias("d")).select("u", "d.side", "d.e")
    counts = groups.groupBy("u").agg(F.count("*").alias("n"))
    most = rows.groupBy("u", "side", "e").agg(F.count("*").alias("k")).join(counts, "u").where("2 * k > n")
    flips = cut(most.groupBy("u").agg(F.collect_list(F.when(F.col("side") == 1, F.col("e"))).alias("gain"), F.collect_list(F.when(F.col("side") == 0, F.col("e"))).alias("loss")))
    none = F.array().cast("array<bigint>")
    own = groups.join(flips, "u", "left").withColumns({"gain": F.coalesce("gain", none), "loss": F.coalesce("loss", none)})
    own = own.select(
        "u", "v", (F.col("x_size") + F.size("gain") - F.size("loss")).alias("c_size"),
        F.array_union(F.array_except("added", "gain"), F.array_except("loss", "missing")).alias("added"),
        F.array_union(F.array_except("missing", "loss"), F.array_except("gain", "added")).alias("missing"),
    ).withColumn("c", F.size("missing") + t * F.size("added"))
    own = cut(own)
    best = cut(own.groupBy("u").agg(F.min_by("v", F.struct("c", "v")).alias("best"), F.min("c").alias("least")))
    each = own.select("u", "v", "c", "c_size", F.explode_outer(F.concat(F.transform("added", lambda e: F.struct(F.lit(1.0).alias("w"), e.alias("e"))), F.transform("missing", lambda e: F.struct(F.lit(t).alias("w"), e.alias("e"))))).alias("d")).select("u", "v", "c", "c_size", "d.w", "d.e").where("e is not null")
    often = each.groupBy("u", "w", "e").agg(F.count("*").alias("k")).where("k > 1")  # a difference of one member is nobody's link
    ranked = each.join(cut(often), ["u", "w", "e"], "left").groupBy("u", "v").agg(
        F.sort_array(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "e", "w")))).alias("shared"), F.first("c").alias("c"), F.first("c_size").alias("c_size")
    ).join(best, "u")
    few = (F.col("c") + F.col("least") - (1 - t) * F.col("c_size")) / (1 + t)
    need = F.col("c") - (1 - t) * F.col("c_size")
    # Differences of one member come first; of the others, those with less than need from themselves on are left out.
    left = F.aggregate("shared", F.lit(0.0), lambda a, d: a + d["w"])
    far = F.aggregate("shared", F.struct(F.col("left").alias("left"), F.lit(0).alias("n")), lambda a, d: F.struct((a["left"] - d["w"]).alias("left"), (a["n"] + F.when(a["left"] >= F.col("need") - 1e-6, 1).otherwise(0)).alias("n")), lambda a: a["n"])
    enough = F.floor(F.size("shared") - F.col("few") + 1e-6) + 1
    cut_off = F.transform(F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.least(far, enough)).cast("int")), lambda d: F.xxhash64("u", d["w"], d["e"]))
    marks = ranked.withColumns({"need": need, "few": few, "left": left}).select("u", "v", F.explode(cut_off).alias("mark"))
    return own, own.select("u", "v").join(best.drop("least"), "u").where("v <> best"), marks


def _full_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of nodes (node, doc_id, digest)."""
    picked = docs.join(nodes.hint("merge"), "doc_id").select("doc_id", "text", "node", "digest")  # the same plan at every size
    return picked.mapInArrow(freed(_sets(k)), "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def _pairs_of(keys: Column) -> Column:
    """Table keys: one for each pair of the keys at hand."""
    return F.flatten(F.transform(keys, lambda a, i: F.transform(F.slice(keys, i + 2, F.size(keys)), lambda b: F.xxhash64(a, b))))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, rows: int = 3, pairwise: int = 8) -> DataFrame:
    """One row per document with the smallest id of its group of near copies.

    Documents are linked when the Jaccard similarity of their sets of k-word shingles (A-Z in lower case) is percent/100
    or more; groups are the connected components. Tensored banding: each document has m small collections of `rows`
    minhashes, and every pair of collections is a table, so m(m-1)/2 tables cost m * rows minhashes. A pair of documents
    meets if two of its collections agree; m is the least number for which the chance to miss a pair at the threshold
    stays under 3e-4. A key of a pair of collections can be shared only if each collection's own key is, so only those
    that occur twice are combined.

    Documents of equal sets are one node, however many there are. In each table bucket every node is first compared, on full
    sets, with the smallest one, its hub. Hubs of at most `pairwise` members that they do not all connect have their members of
    different components compared directly. Members of larger ones are compared with the one nearest to their consensus,
    and then only those that share differences from it which a link needs (see _marks). So a large bucket of copies costs
    two comparisons a node and a few for common edits, and no link between nodes that meet in a bucket is lost.

    Returns doc_id, n_shingles, component_id, kept. A document with fewer than k words has its whole sequence as one
    shingle; one without words or text has none and is linked with nothing. Rows that repeat an id are documents of their
    own and share their result where their texts are equal. A row without id gets its group's component, or null, and is not
    kept. An empty table gives an empty result; other columns are ignored. Runs jobs while the plan is built.
    """
    m = collections_for(percent / 100, rows)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = cut(docs.mapInArrow(freed(_signatures(k, m, rows)), f"doc_id {kind}, n_shingles bigint, digest binary, keys array<bigint>"))
    nodes = marked.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min_by("keys", "doc_id").alias("keys"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    single = nodes.select("node", F.explode("keys").alias("key"))
    shared = cut(single.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key"))
    live = single.join(shared, "key", "left_semi").groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys")).where(F.size("keys") > 1)
    tables = cut(live.select("node", F.explode(_pairs_of(F.col("keys"))).alias("key")))
    heads = cut(tables.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u < last").select("key", "u"))
    star = cut(tables.join(heads, "key").where("node > u").select("u", F.col("node").alias("v")).distinct())
    wanted = cut(star.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    sets = cut(_full_sets(docs, nodes.select("node", "doc_id", "digest").join(wanted, "node"), k))
    first = _met(star, sets).withColumns({"linked": _linked(percent), "x_size": F.size("x"), "added": F.array_except("y", "x"), "missing": F.array_except("x", "y")})
    first = cut(first.select("u", "v", "linked", "x_size", "added", "missing"))
    links = first.where("linked").select("u", "v")
    hubs = first.groupBy("u").agg(F.count("*").alias("n"), F.min("linked").alias("whole")).where("not whole").select("u", "n")
    groups = first.join(cut(hubs), "u")
    own, nearest, marks = _marks(cut(groups.where(F.col("n") > pairwise).drop("linked", "n")), percent)
    nearest = nearest.select(F.least("v", "best").alias("u"), F.greatest("v", "best").alias("v")).distinct().join(star, ["u", "v"], "left_anti")
    links = links.unionByName(cut(_met(cut(nearest), sets).where(_linked(percent)).select("u", "v")))
    labels = cut(connected_components(links))
    small = groups.where(F.col("n") <= pairwise)
    marks = marks.unionByName(small.select("u", "v", F.xxhash64("u").alias("mark")))
    placed = cut(marks.join(labels, F.col("v") == F.col("node"), "left").select("u", "v", "mark", F.coalesce("component", "v").alias("component")))
    mixed = cut(placed.groupBy("mark").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("mark"))
    placed = placed.join(mixed, "mark", "left_semi")
    # Any reference set C gives a pair's exact similarity: (|C| - |R v| - |R w| + s) / (|C| + |A v| + |A w| - s).
    stated = own.select("u", "v", "c_size", "added", "missing").unionByName(small.select("u", "v", F.col("x_size").alias("c_size"), "added", "missing"))
    placed = cut(placed.join(stated, ["u", "v"]))
    x, y = placed.alias("x"), placed.alias("y")
    s = F.size(F.array_intersect("x.added", "y.added")) + F.size(F.array_intersect("x.missing", "y.missing"))
    i = F.col("x.c_size") - F.size("x.missing") - F.size("y.missing") + s
    union = F.col("x.c_size") + F.size("x.added") + F.size("y.added") - s
    across = x.join(y, (F.col("x.mark") == F.col("y.mark")) & (F.col("x.component") < F.col("y.component")) & (100 * i >= percent * union))
    second = across.select(F.least("x.v", "y.v").alias("u"), F.greatest("x.v", "y.v").alias("v"))
    merged = connected_components(links.unionByName(second))
    grouped = cut(nodes.select("digest", "doc_id", "node").join(merged.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("digest", "doc_id", "component"))
    least = cut(grouped.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    grouped = cut(grouped.join(least, "component", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id")))
    out = marked.join(grouped, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))

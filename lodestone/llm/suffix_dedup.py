"""Repeated passages across documents by sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.shared import cut, mix, seeds, steps, words

#: Neighbours in suffix order that each suffix of a small class is compared with, on either side; larger classes are split first.
NEIGHBOURS = 8
_ODD = seeds(4096, 31) | np.uint64(1)
_OTHER = seeds(4096, 47) | np.uint64(1)


def _grams(hashes: np.ndarray, k: int, odd: np.ndarray = _ODD) -> np.ndarray:
    """Hash of the k words from each position on."""
    n = max(len(hashes) - k + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k if n else 0):
        out += hashes[j : j + n] * odd[j]
    return mix(out)


def minimisers(hashes: np.ndarray, rows: np.ndarray, window: int, k: int) -> np.ndarray:
    """Positions of words that have the least k-gram hash of some `window` consecutive k-grams of one row; the first of equals."""
    grams = _grams(hashes, k)
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least = np.arange(len(grams))  # place of the minimum over a stretch that doubles
    width = 1
    while width < window:
        step = min(width, window - width)
        a, b = least[: len(least) - step], least[step:]
        least = np.where(grams[b] < grams[a], b, a)
        width += step
    inside = rows[: len(least)] == rows[window + k - 2 : window + k - 2 + len(least)]
    chosen = np.zeros(len(hashes), dtype=bool)
    chosen[least[inside]] = True
    return np.flatnonzero(chosen)


def _anchors(window: int, k: int, right: int):
    """(doc_id, position, class) of each retained suffix: the class is the hash of its first `right` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0))
            for low, high, data, offsets in steps(batch.column(1)):
                hashes, rows, _, _ = words(data, offsets)
                at = minimisers(hashes, rows, window, k)
                at = at[at + right <= len(hashes)]
                at = at[rows[at] == rows[at + right - 1]]
                classes = _grams(hashes, right)
                first = np.searchsorted(rows, rows[at])
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high][rows[at]]), pa.array(at - first), pa.array(classes[at].view(np.int64))], names=["doc_id", "position", "class"])

    return run


def _contexts(left: int, least: int, right: int):
    """Words after and before each retained suffix's start as 32-bit hashes, nearest first; 0 beyond the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = np.array(batch.column(0)), batch.column(2)
            for low, high, data, offsets in steps(batch.column(1)):
                hashes, rows, _, _ = words(data, offsets)
                own = lists.slice(low, high - low)
                positions = np.array(own.flatten(), dtype=np.int64)
                row = np.repeat(np.arange(high - low), np.array(own.value_lengths(), dtype=np.int64))
                start, end = np.searchsorted(rows, row), np.searchsorted(rows, row, side="right")
                at = positions + start
                fine = at + least <= end  # rows that repeat an id with another text may lack a position
                at, row, start, end, positions = at[fine], row[fine], start[fine], end[fine], positions[fine]
                narrow = np.append((hashes >> np.uint64(32)).astype(">u4") | np.uint32(1), 0).astype(">u4")
                after = at[:, None] + np.arange(right)
                after = narrow[np.where(after < end[:, None], after, len(hashes))]
                before = at[:, None] - 1 - np.arange(left)
                before = narrow[np.where(before >= start[:, None], before, len(hashes))]
                classes = _grams(hashes, least)[at] if len(at) else np.zeros(0, dtype=np.uint64)
                as_binary = lambda x, n: pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * n), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high][row]), pa.array(positions), pa.array(classes.view(np.int64)), as_binary(after, right), as_binary(before, left)], names=["doc_id", "position", "class", "after", "before"])

    return run


def _windows(least: int, window: int):
    """Every stretch of `least` words that starts at a listed position or up to window - 1 words before: its first word and two
    independent hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = np.array(batch.column(0)), batch.column(2)
            for low, high, data, offsets in steps(batch.column(1)):
                hashes, rows, _, _ = words(data, offsets)
                own = lists.slice(low, high - low)
                row = np.repeat(np.arange(high - low), np.array(own.value_lengths(), dtype=np.int64))
                start, end = np.searchsorted(rows, row), np.searchsorted(rows, row, side="right")
                at = np.array(own.flatten(), dtype=np.int64) + start
                chosen = np.zeros(len(hashes), dtype=bool)
                for j in range(window):
                    chosen[(at - j)[(at - j >= start) & (at - j + least <= end)]] = True
                at = np.flatnonzero(chosen)
                both = [_grams(hashes, least, odd)[at] if len(at) else np.zeros(0, dtype=np.uint64) for odd in (_ODD, _OTHER)]
                places = pa.array(at - np.searchsorted(rows, rows[at]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high][rows[at]]), places, *(pa.array(x.view(np.int64)) for x in both)], names=["doc_id", "start", "gram", "other"])

    return run


def _matrix(values: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), dtype=np.uint32).reshape(-1, n)


def compare(ids: np.ndarray, positions: np.ndarray, classes: np.ndarray, after: np.ndarray, before: np.ndarray, least: int) -> pd.DataFrame:
    """Matches of suffixes in suffix order with their neighbours of other documents, extended right and left.

    Rows of one document with equal words on both sides stand for each other, so that a document's own repetition does not
    hide others. Returns doc_id, start, end, first, last for each suffix with a match of `least` or more words: first and last are
    the smallest and the greatest id among its document and those it matches."""
    n = len(ids)
    if not n:
        return pd.DataFrame({"doc_id": ids, "start": positions, "end": positions, "first": ids, "last": ids})
    new = np.ones(n, dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (classes[1:] != classes[:-1]) | (after[1:] != after[:-1]).any(axis=1) | (before[1:] != before[:-1]).any(axis=1)
    group, head = np.cumsum(new) - 1, np.flatnonzero(new)
    k, a, b = len(head), after[head], before[head]
    right, left = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
    least_id, most_id = ids[head].copy(), ids[head].copy()
    for s in range(1, min(NEIGHBOURS, k - 1) + 1):
        x, y = head[s:], head[:-s]
        pair = np.flatnonzero((classes[x] == classes[y]) & (ids[x] != ids[y]))
        if not len(pair):
            continue
        run = [np.where(e.all(axis=1), e.shape[1], e.argmin(axis=1)) for e in ((a[s:][pair] == a[:-s][pair]) & (a[s:][pair] != 0), (b[s:][pair] == b[:-s][pair]) & (b[s:][pair] != 0))]
        good = run[0] + run[1] >= least
        pair, r, l = pair[good], run[0][good], run[1][good]
        for own, other in ((pair + s, pair), (pair, pair + s)):
            right[own], left[own] = np.maximum(right[own], r), np.maximum(left[own], l)
            least_id[own], most_id[own] = np.minimum(least_id[own], ids[head[other]]), np.maximum(most_id[own], ids[head[other]])
    met = np.flatnonzero((least_id < most_id)[group])
    g = group[met]
    return pd.DataFrame({"doc_id": ids[met], "start": positions[met] - left[g], "end": positions[met] + right[g], "first": least_id[g], "last": most_id[g]})


def _neighbours(left: int, right: int, least: int):
    """Streams a sorted partition; the last NEIGHBOURS rows of a batch meet the next batch."""
    names = ["doc_id", "start", "end", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            block = now if held is None else pa.concat_tables([held, now])
            found = compare(np.array(block.column("doc_id")), np.array(block.column("position")), np.array(block.column("class")), _matrix(block.column("after"), right), _matrix(block.column("before"), left), least)
            yield pa.RecordBatch.from_arrays([pa.array(found[c].astype("int64")) for c in names], names=names)
            held = block.slice(max(0, block.num_rows - NEIGHBOURS))

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, window: int = 24, k: int = 4) -> DataFrame:
    """Passages of `least` or more words that another document has too: a row per maximal stretch of words of a document.

    Words are runs without white space, A-Z in lower case. A suffix of a document's words is retained where its first k words
    have the least hash of `window` consecutive k-grams, so any repeated passage retains the same suffixes in all its places:
    the first starts within its first `window` words. Suffixes that share their first least - window + 1 words with no other
    are left out; those that do, a class, meet in one task and are sorted there. Classes of up to NEIGHBOURS + 1 suffixes are
    small enough to share out by hash; each suffix is compared with the NEIGHBOURS nearest on either side, which is its whole
    class, and matches extend to the right and to the left; matches of `least` words count.

    Larger classes, which may hold a third of all suffixes, are split by the words before and after until a part shares all its
    `least` words: a suffix belongs to a part for each stretch of `least` words that starts at it or up to window - 1 words
    before it. A part is known by two independent 64-bit hashes of its words, so that at 10^12 stretches a false match has a chance
    under 10^-14. Parts of two or more documents are matches, extended as far as stretches follow each other. Any match of
    `least` words around a suffix consists of such stretches, so none is missed, no pairs are made, and the result is the one
    that comparing all suffixes of the class gives. Overlapping matches of a document are merged, which covers longer passages.

    Returns doc_id, start_word, end_word (exclusive, counted from 0), n_words, seen_in: of the documents that share `least` of its
    words in a row, the smallest id, or where that is the document itself, the greatest. Ids are integers. Repetition within
    one document alone does not count. Null and short texts have no rows; rows without id are left out; rows that repeat an id
    are one document. An empty table gives an empty result; other columns are ignored.
    """
    right = least - window + 1
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    anchors = cut(docs.mapInArrow(_anchors(window, k, right), "doc_id bigint, position bigint, class bigint"))
    shared = anchors.groupBy("class").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b")
    shared = cut(shared.select("class", (F.col("n") > NEIGHBOURS + 1).alias("large")))
    listed = lambda large: F.array_sort(F.collect_set(F.when(F.col("large") == large, F.col("position"))))
    live = cut(anchors.join(shared, "class").groupBy("doc_id").agg(listed(False).alias("positions"), listed(True).alias("crowded")))
    wide = docs.join(live.where(F.size("positions") > 0), "doc_id").select("doc_id", "text", "positions").mapInArrow(_contexts(window - 1, right, least), "doc_id bigint, position bigint, class bigint, after binary, before binary")
    grams = cut(docs.join(live.where(F.size("crowded") > 0), "doc_id").select("doc_id", "text", "crowded").mapInArrow(_windows(least, window), "doc_id bigint, start bigint, gram bigint, other bigint"))
    common = cut(grams.groupBy("gram", "other").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"))
    crowded = grams.join(common, ["gram", "other"]).select("doc_id", "start", (F.col("start") + least).alias("end"), "first", "last")
    order = ["class", "after", "before", "doc_id", "position"]
    ranged = wide.repartition("class").sortWithinPartitions(*order)
    found = ranged.mapInArrow(_neighbours(window - 1, least, least), "doc_id bigint, start bigint, end bigint, first bigint, last bigint")
    found = found.unionByName(crowded)
    by = W.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    found = found.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    found = found.withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    out = found.groupBy("doc_id", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("first").alias("first"), F.max("last").alias("last"))
    seen = F.when(F.col("first") < F.col("doc_id"), F.col("first")).otherwise(F.col("last"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), seen.alias("seen_in"))

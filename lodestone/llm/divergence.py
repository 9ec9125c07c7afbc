"""Source divergence audit: terms by iceberg refinement of byte prefixes, and how far sources of a language differ in them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.llm.shared import cut, mix, steps

SCALE = 1_000_000_000
#: Bytes of text that one vectorised step takes: terms of a larger step combine better.
STEP = 4_000_000
#: Bits of the marks of kept prefixes, least and most: a broadcast of at most 16 MB.
BITS = (16, 27)
#: Bytes of terms: letters, and all bytes of signs beyond ASCII.
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row and number of each term, the distinct terms by number)."""
    inside = _IN_TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, sizes = np.flatnonzero(first), np.flatnonzero(last) + 1 - np.flatnonzero(first)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[inside])])
    coded = terms.dictionary_encode()
    return np.searchsorted(offsets, starts, side="right") - 1, coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _distinct(left: np.ndarray, right: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each occurs; right is under size."""
    pairs, counts = np.unique(left * size + right, return_counts=True)
    return pairs // size, pairs % size, counts


def _numbered(column: pa.Array) -> tuple[list, np.ndarray]:
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def _level(size: int, before: int, marks: np.ndarray | None):
    """Rows (lang, source, term, whole, docs, n) of one level, combined within each step. Terms of before + 1 to `size` bytes
    are whole; of longer ones the first `size` bytes are a prefix, counted once for a document. Only terms whose first
    `before` bytes are marked take part; marks say yes too often at times, never too seldom."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lang_of = _numbered(batch.column(0))
            pairs = {}
            sources, source_of = _numbered(batch.column(1))
            group_of = np.array([pairs.setdefault(p, len(pairs)) for p in zip(lang_of.tolist(), source_of.tolist(), strict=True)], dtype=np.int64)
            groups = np.array(list(pairs))
            for low, high, data, offsets in steps(batch.column(2), size=STEP):
                rows, terms, codes = _terms(data, offsets)
                if not len(codes):
                    continue
                n = len(terms)
                long = pc.binary_length(terms).to_numpy() > before
                rows, codes = (rows[long[codes]], codes[long[codes]]) if before else (rows, codes)
                rows, codes, counts = _distinct(rows, codes, n)
                lang, group = lang_of[low:high][rows], group_of[low:high][rows]
                if marks is not None and len(codes):
                    hashes = np.zeros(n, dtype=np.uint64)
                    hashes[long] = _hashes(terms.filter(pa.array(long)), before)
                    place = (mix(hashes[codes] + _seeds(langs)[lang]) & np.uint64(len(marks) * 8 - 1)).astype(np.int64)
                    good = (marks[place >> 3] >> (place & 7)) & 1 == 1
                    rows, codes, counts, lang, group = rows[good], codes[good], counts[good], lang[good], group[good]
                whole = (pc.binary_length(terms).to_numpy() <= size)[codes]
                if whole.any():
                    order = np.argsort(group[whole] * n + codes[whole], kind="stable")
                    g, c = group[whole][order], codes[whole][order]
                    first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1]))))
                    docs = np.diff(np.append(first, len(g)))
                    yield _rows(_named(langs, groups[g[first], 0]), _named(sources, groups[g[first], 1]), terms.take(pa.array(c[first])), True, docs, np.add.reduceat(counts[whole][order], first))
                if not whole.all():
                    stems, stem_of = (x := pc.binary_slice(terms, 0, size).dictionary_encode()).dictionary, x.indices.to_numpy().astype(np.int64)
                    rows, stem, _ = _distinct(rows[~whole], stem_of[codes[~whole]], len(stems))
                    own_lang, stem, docs = _distinct(lang_of[low:high][rows], stem, len(stems))
                    yield _rows(_named(langs, own_lang), _named([""], np.zeros(len(stem), dtype=np.int64)), stems.take(pa.array(stem)), False, docs, np.zeros(len(stem), dtype=np.int64))

    return run


def _named(names: list, places: np.ndarray) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(places), pa.array(names, pa.string())).cast(pa.string())


def _rows(langs: pa.Array, sources: pa.Array, terms: pa.Array, whole: bool, docs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [langs, sources, terms.cast(pa.binary()), pa.array(np.full(len(langs), whole)), pa.array(docs.astype(np.int64)), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "whole", "docs", "n"])


def _hashes(terms: pa.Array, size: int) -> np.ndarray:
    """64-bit hash of the first `size` bytes of each term; none is shorter."""
    stems = pc.binary_slice(terms.cast(pa.large_binary()), 0, size)
    data = np.frombuffer(stems.buffers()[2] or b"", dtype=np.uint8)[stems.offset * size :][: len(stems) * size].reshape(len(stems), size)
    wide = np.zeros((len(stems), -(-size // 8) * 8), dtype=np.uint8)
    wide[:, :size] = data
    out = np.zeros(len(stems), dtype=np.uint64)
    for column in wide.view("<u8").T:
        out = mix(out + column)
    return out


def _seeds(langs: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) for x in langs], dtype=np.uint64) << np.uint64(32)


def _marked(prefixes: DataFrame, size: int) -> np.ndarray | None:
    """A bit for the hash of each (lang, prefix of `size` bytes), in a table of fixed size; None where there are no prefixes."""
    n = prefixes.count()
    if not n:
        return None
    bits = 1 << min(max(int(n).bit_length() + 3, BITS[0]), BITS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lang_of = _numbered(batch.column(0))
            place = mix(_hashes(batch.column(1), size) + _seeds(langs)[lang_of]) & np.uint64(bits - 1)
            own = np.unique(place).astype(np.int64)
            words, at = np.unique(own >> 6, return_index=True)
            values = np.bitwise_or.reduceat(np.uint64(1) << (own & 63).astype(np.uint64), at) if len(own) else own.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(values.view(np.int64))], names=["word", "bits"])

    rows = prefixes.select("lang", "term").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype="<i8")
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def iceberg_terms(docs: DataFrame, least: int = 3, first: int = 6) -> tuple[DataFrame, DataFrame]:
    """(lang, term, n_lang) of each kept term with how often it occurs in its language, and (lang, source, term, n, n_lang) with how
    often in each source that has it. docs: lang, source, text, no nulls.

    A term is a longest stretch of letters A-Z, a-z and signs beyond ASCII, with A-Z in lower case. A language keeps the
    terms that stand in at least `least` of its documents. Level by level, prefixes of `first` bytes, then three times as many and so on are counted
    by documents; those under `least` are dropped, and the next level extends only those that are left, until no prefix
    of a longer term is. Terms no longer than the level's prefixes are counted whole. The counts of a step are
    combined before they are shuffled; the prefixes that are left reach the tasks as marks in a table of at most 16 MB, which
    lets some dropped ones pass: they fall at the next level or by the final count, which is exact. Each level is one
    scan of the texts. Runs jobs while the plan is built.
    """
    own = docs.select("lang", "source", "text")
    found, size, before, marks = [], first, 0, None
    while True:
        level = own.mapInArrow(_level(size, before, marks), "lang string, source string, term binary, whole boolean, docs bigint, n bigint")
        level = cut(level.groupBy("lang", "source", "term", "whole").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")))
        found.append(level.where("whole").drop("whole"))
        marks = _marked(level.where(~F.col("whole") & (F.col("docs") >= least)), size)
        if marks is None:
            break
        size, before = 3 * size, size
    every = found[0]
    for level in found[1:]:
        every = every.unionByName(level)
    kept = cut(every.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= least).drop("docs"))
    counts = cut(every.drop("docs").join(kept, ["lang", "term"]).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "n_lang"))
    return kept.select("lang", F.col("term").cast("string").alias("term"), "n_lang"), counts


def _p(n: Column | str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), in whole numbers of any size: decimals where a long can't hold the product."""
    wide = f"(cast({SCALE} AS decimal(38,0)) * cast({n} + 1 AS decimal(20,0))) div cast({total} + {terms} AS decimal(20,0))"
    return F.expr(f"1 + CASE WHEN {n} < {2**63 // SCALE - 1} THEN ({SCALE}L * ({n} + 1)) div ({total} + {terms}) ELSE {wide} END").cast("long")


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200, salts: int = 16, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How far each source of a language stands from its other sources, and by which terms it stands out.

    Rows (lang, source, part, item, value, rank) for every (lang, source) that occurs. Each kept term of a language (see
    `iceberg_terms`) has p = 1 + floor(10^9 (n + 1) / (N + V)) in each source and in the language, n its occurrences there, N those of
    all V kept terms; f = floor((p - q)^2 / q). Part `pair`: item is another source, q its p, value the sum of f over all
    kept terms, 0 where there are none. Part `term`: item is a term of the source with p > q, q the language's p, value f;
    the `top` first. Ranks count from 1 by value descending, then item by bytes.

    Terms that only one of two sources has are summed by how often they occur, so a pair of sources meets the terms that
    both have and two short lists of counts; the result has a row for each pair of sources of a language all the same. Nulls
    count as ''. Every row is a document, also one that repeats an id. An empty table gives an empty result. Runs jobs while
    the plan is built.
    """
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept, counts = iceberg_terms(own, least)
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "total_lang"])
    groups = cut(groups.withColumn("p0", F.when(F.col("v") > 0, _p("0L", "total", "v"))))
    placed = cut(counts.join(groups, ["lang", "source"]).withColumns({"p": _p("n", "total", "v"), "q": _p("n_lang", "total_lang", "v")}).select("lang", "source", "term", "p", "p0", "q"))

    out = placed.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    out = _ranked(out, "term").where(F.col("rank") <= top)

    here = groups.select("lang", "source", "v", "p0", F.pmod(F.xxhash64("source"), F.lit(salts)).alias("salt"))
    there = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    pairs = here.join(there, ["lang", "salt"]).where("source <> item").drop("salt")
    alone = placed.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    alone = alone.join(pairs, ["lang", "source"]).groupBy("lang", "source", "item").agg(
        F.expr(f"sum(times * ({_f('p', 'q0')} - {_f('p0', 'q0')}))").alias("a"), F.expr(f"sum(times * ({_f('q0', 'p')} - {_f('q0', 'p0')}))").alias("b"))
    one, other = placed.select("lang", "term", "source", "p", "p0"), placed.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = one.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(
        *[F.expr(f"sum({_f(x, y)} - {_f(x, y0)} - {_f(x0, y)} + {_f(x0, y0)})").alias(name) for name, x, x0, y, y0 in (("a", "p", "p0", "q", "q0"), ("b", "q", "q0", "p", "p0"))])
    each = F.explode(F.array(F.struct("source", "item", F.col("a").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("b").alias("value")))).alias("e")
    value = pairs.select("lang", "source", "item", F.expr(f"coalesce(v * {_f('p0', 'q0')}, 0L)").alias("value")).unionByName(alone.select("lang", each).select("lang", "e.*")).unionByName(both.select("lang", each).select("lang", "e.*"))
    value = value.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(value, "pair").unionByName(out)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))

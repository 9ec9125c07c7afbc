"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.llm.shared import _IS_SPACE, cut, freed, steps, words

#: Byte lengths of the n-grams; with words they are the features.
GRAMS = (4, 5, 6)
#: Rows of counted features that leave a task at a time.
COUNTED = 100_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """Sorted 64-bit features with their weights, and the bias; without features every score is that of the bias."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -10.0


def _feature_runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, row of each; -1 where an n-gram leaves its row): n-grams of bytes with white space as one kind of byte, then words."""
    plain = np.where(_IS_SPACE[data], 32, data).astype(np.uint64)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n in GRAMS:
        if len(plain) < n:
            continue
        value = np.full(len(plain) - n + 1, n << 56, dtype=np.uint64)
        for j in range(n):
            value |= plain[j : len(plain) - n + 1 + j] << np.uint64(8 * j)
        first, last = row_of[: len(value)], row_of[n - 1 :]
        yield value, np.where(first == last, first, -1)
    hashes, rows, _, _ = words(data, offsets)
    yield hashes | np.uint64(1 << 63), rows


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the task that have a feature: among the positive and among the unlabelled, and the exclusive or of all their hashes, equal for features of the same
    documents. Kinds of features share none, so each is counted by itself, and what is found leaves in batches of at most COUNTED rows."""
    for batch in batches:
        sides, hashes = np.array(batch.column(2)), np.array(batch.column(3))
        for low, high, data, offsets in steps(batch.column(1), size=500_000):
            side, own = sides[low:high], hashes[low:high]
            for value, rows in _feature_runs(data, offsets):
                value, rows = value[rows >= 0], rows[rows >= 0]
                order = np.argsort(value, kind="stable")  # rows ascend, so those of a feature still do
                value, rows = value[order], rows[order]
                differs = value[1:] != value[:-1]
                new = np.concatenate(([True], differs | (rows[1:] != rows[:-1])))[: len(value)]
                starts = np.flatnonzero(np.concatenate(([True], differs))[: len(value)][new])
                value, rows = value[new], rows[new]
                if not len(value):
                    continue
                flags = side[rows].astype(np.int64)
                counts = [value[starts].view(np.int64), np.add.reduceat(flags & 1, starts), np.add.reduceat(flags >> 1, starts), np.bitwise_xor.reduceat(own[rows], starts)]
                for i in range(0, len(starts), COUNTED):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + COUNTED]) for c in counts], names=["feature", "p", "u", "held"])


def _present(data: np.ndarray, offsets: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in `features`) of those at hand, each once for a row. A bit table passes over nearly all others."""
    bits = np.zeros(1 << 20, dtype=bool)
    bits[(features * _SPREAD) >> np.uint64(44)] = True
    met = []
    for value, rows in _feature_runs(data, offsets):
        maybe = np.flatnonzero(bits[(value * _SPREAD) >> np.uint64(44)])
        place = np.searchsorted(features, value[maybe])
        place[place == len(features)] = 0
        true = (features[place] == value[maybe]) & (rows[maybe] >= 0) if len(features) else np.zeros(len(maybe), dtype=bool)
        met.append(rows[maybe][true] * np.int64(1 << 32) + place[true])
    both = np.unique(np.concatenate(met)) if met else np.zeros(0, dtype=np.int64)
    return both >> 32, both & ((1 << 32) - 1)


def _lists(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in steps(batch.column(1)):
                rows, place = _present(data, offsets, features)
                ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=high - low)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(low, high - low), pa.ListArray.from_arrays(pa.array(ends), pa.array(place))], names=["side", "place"])

    return run


def nnpu(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = 150, rate: float = 0.05, decay: float = 3e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear scorer under the non-negative PU risk with the logistic loss.

    x: rows of 0 and 1; y: 1 positive, 0 unlabelled. The risk is prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]).
    Where the second part falls below 0, the step goes up its gradient instead. Adam steps over all rows.
    """
    p, u = x[y == 1], x[y == 0]
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, rounds + 1):
        narrow = w[:-1].astype(x.dtype)
        gp, gu = p @ narrow + w[-1], u @ narrow + w[-1]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        dp_plus, dp_minus, du = -sigmoid(-gp) / len(p), sigmoid(gp) / len(p), sigmoid(gu) / len(u)
        back = negative < 0
        cp = prior * dp_minus if back else prior * (dp_plus - dp_minus)
        cu = -du if back else du
        g = np.append(cp.astype(x.dtype) @ p + cu.astype(x.dtype) @ u, cp.sum() + cu.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, positive: DataFrame, prior: float, id_col: str = "doc_id", text_col: str = "text", max_positive: int = 3000, max_unlabelled: int = 6000, max_features: int = 1024) -> Model:
    """A model from the texts of `docs`, of which those with an id in `positive` (one column, id_col) are confirmed toxic.

    The fit uses at most max_positive confirmed and max_unlabelled other or same documents, those of the smallest hash of
    their id, with whole texts. Features are words and byte n-grams that confirmed documents have more often than the
    unlabelled by at least four standard errors and twice. Of features that the very same documents have, as n-grams of one
    word, three are taken; then the clearest, max_features of them at most. No confirmed documents, no unlabelled or no such
    features: a model of the bias alone.
    """
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    toxic = positive.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    first = lambda rows, n: rows.orderBy(F.xxhash64("id"), "id").limit(n)
    picked = first(ids.join(toxic, "id", "left_semi"), max_positive).select("id", F.lit(1).alias("f")).unionByName(first(ids, max_unlabelled).select("id", F.lit(2).alias("f")))
    picked = cut(picked.groupBy("id").agg(F.sum("f").cast("int").alias("side")))  # bit 0: confirmed, bit 1: unlabelled
    n_p, n_u = picked.agg(F.sum(F.col("side").bitwiseAND(1)), F.sum(F.shiftright("side", 1))).first()
    bias = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else Model.bias
    if not n_p or not n_u:
        return Model(bias=bias)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id").select("id", "text", "side", F.xxhash64("id").alias("hash"))
    sample = cut(sample.dropDuplicates(["id"]))  # at most max_positive + max_unlabelled rows
    counted = sample.mapInArrow(freed(_counts), "feature bigint, p bigint, u bigint, held bigint").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"), F.bit_xor("held").alias("held"))
    pp, pu = F.col("p") / n_p, (F.col("u") + 0.5) / (n_u + 1)
    clear = (pp - pu) / F.sqrt(pu * (1 - pu) / n_p + 1e-12)
    best = counted.withColumn("z", clear).where((F.col("p") >= 8) & (pp > 2 * pu) & (F.col("z") >= 4))
    best = best.withColumn("like", F.row_number().over(W.partitionBy("p", "u", "held").orderBy("feature"))).where("like <= 3")
    best = best.orderBy(F.desc("z"), "feature").limit(max_features).select("feature")
    features = np.sort(np.array([r[0] for r in best.collect()], dtype=np.int64).view(np.uint64))
    if not len(features):
        return Model(bias=bias)
    rows = sample.mapInArrow(freed(_lists(features)), "side int, place array<bigint>").collect()
    data = [(r.place, y) for r in rows for y in ((1,) if r.side == 1 else (0,) if r.side == 2 else (1, 0))]
    x = np.zeros((len(data), len(features)), dtype=np.float32)
    for i, (places, _) in enumerate(data):
        x[i, places] = 1
    weights, bias = nnpu(x, np.array([y for _, y in data]), prior)
    return Model(features, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, out: str = "score") -> DataFrame:
    """doc_id and score (0 to 1, higher: more likely toxic) of every whole text; the id and all other columns stay out of the score.

    With `keep`, these columns of the rows instead of doc_id; `out` names the score. Null and empty texts get the score of the bias. Repeated rows get
    equal scores, rows without id one as well; an empty table gives an empty result.
    """
    features, weights, bias = model.features, model.weights, model.bias
    kept = [F.col(id_col).alias("doc_id")] if keep is None else [F.col(f"`{c}`") for c in keep]
    fields = [StructField(f.name, f.dataType) for f in docs.select(*kept).schema] + [StructField(out, DoubleType())]
    names = [f.name for f in fields]
    own = docs.select(F.col(text_col).cast("string").alias("c"), *[c.alias(f"c{i}") for i, c in enumerate(kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in steps(batch.column(0)):
                rows, place = _present(data, offsets, features)
                z = np.bincount(rows, weights=weights[place], minlength=high - low) + bias
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[1:]), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=names)

    return own.mapInArrow(freed(run), StructType(fields))


def prior_of(labels: DataFrame, label_col: str = "toxic") -> float:
    """Share of label 1 among the labelled rows, kept within 0.001 and 0.5; 0.05 without labels."""
    share = labels.where(F.col(label_col).isNotNull()).agg(F.avg((F.col(label_col) == 1).cast("double"))).first()[0]
    return 0.05 if share is None else min(max(share, 0.001), 0.5)

"""Language identification by segmentation-marginalised unigrams."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.shared import cut, mix, seeds, steps, words

#: Fixed value: the vocabulary's mark of a word start.
MARK = "▁"
#: Words of up to so many characters are scored many at a time, in plain numbers that a double holds; longer ones one by one, in logarithms.
SHORT = 32
#: Characters of a long word whose pieces are looked up in one step.
STRETCH = 20_000
#: Probability of a character that no piece covers, and least probability of a piece.
FLOOR = 1e-7
#: Bytes of text that one step takes; distinct words are scored once a step.
STEP = 6_000_000
_ODD = seeds(256, 7) | np.uint64(1)


@dataclass
class Model:
    """Languages in order and probabilities of pieces: (languages, pieces + 2), the last two for an uncovered character and for no piece."""

    langs: list[str]
    p: np.ndarray


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes of the pieces, table from their high bits to the first, greatest length) of a sentencepiece file; control and byte pieces stay out."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = sorted({s.id_to_piece(i) for i in range(s.get_piece_size()) if not (s.is_control(i) or s.is_unknown(i) or s.is_byte(i))} - {""})
    hashes = np.sort(np.concatenate([_hash(codes) for _, codes in _by_length(pieces)]))
    slots = np.full(1 << 22, -1, dtype=np.int32)
    slots[(hashes >> np.uint64(42))[::-1]] = np.arange(len(hashes), dtype=np.int32)[::-1]
    return hashes, slots, max(map(len, pieces))


def _hash(codes: np.ndarray) -> np.ndarray:
    n = codes.shape[1]
    return mix((codes.astype(np.uint64) + np.uint64(1)) @ _ODD[:n] + np.uint64(n))


def _pieces(h: np.ndarray, hashes: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of h are pieces, which pieces). A slot names the first of the few pieces that share its bits."""
    place = slots[h >> np.uint64(42)]
    at = np.flatnonzero(place >= 0)
    place, own = place[at], h[at]
    wrong = np.flatnonzero(hashes[place] != own)
    while len(wrong):
        place[wrong] += 1
        wrong = wrong[(place[wrong] < len(hashes))]
        wrong = wrong[(hashes[place[wrong]] != own[wrong]) & (hashes[place[wrong]] >> np.uint64(42) == own[wrong] >> np.uint64(42))]
    true = (place < len(hashes)) & (hashes[np.minimum(place, len(hashes) - 1)] == own)
    return at[true], place[true]


def _arcs(codes: np.ndarray, path: str) -> list[tuple[int, int, np.ndarray]]:
    """(from, to, piece of each word) over all stretches of words of one length; the number of pieces stands for an uncovered character, one more for none."""
    hashes, slots, most = vocabulary(path)
    n, none = codes.shape[1], len(hashes) + 1
    out = []
    for low in range(n):
        sums = np.zeros(len(codes), dtype=np.uint64)
        for high in range(low + 1, min(n, low + most) + 1):
            sums += (codes[:, high - 1].astype(np.uint64) + np.uint64(1)) * _ODD[high - 1 - low]
            ids = np.full(len(codes), none, dtype=np.int64)
            at, place = _pieces(mix(sums + np.uint64(high - low)), hashes, slots)
            ids[at] = place
            if high == low + 1:
                ids[ids == none] = none - 1
            if high == low + 1 or len(at):
                out.append((low, high, ids))
    return out


def _forward(codes: np.ndarray, arcs: list, p: np.ndarray) -> np.ndarray:
    """Probabilities of all beginnings, summed over all segmentations: (length + 1, languages, words)."""
    a = np.zeros((codes.shape[1] + 1, len(p), len(codes)))
    a[0] = 1
    for low, high, ids in sorted(arcs, key=lambda x: x[1]):
        a[high] += a[low] * p[:, ids]
    return a


def _by_length(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points) of words of one length at a time, at most 20,000 of them."""
    lengths = np.array([len(t) for t in texts])
    for n in np.unique(lengths):
        same = np.flatnonzero(lengths == n)
        for i in range(0, len(same), 20_000):
            part = same[i : i + 20_000]
            yield part, np.array([texts[j] for j in part], dtype=f"U{n}").view(np.uint32).reshape(len(part), n)


def _tails(codes: np.ndarray, path: str, low: int, high: int) -> np.ndarray:
    """Pieces of the stretches of one word that end after characters low to high - 1: (high - low, greatest length), numbered
    as by _arcs; column n is for stretches of n + 1 characters."""
    hashes, slots, most = vocabulary(path)
    none = len(hashes) + 1
    out = np.full((high - low, most), none, dtype=np.int64)
    first = max(0, low - most + 1)
    sums = np.zeros(high - first, dtype=np.uint64)
    plain = codes[first:high].astype(np.uint64) + np.uint64(1)
    for n in range(1, min(most, high - first) + 1):
        sums = sums[: high - first - n + 1] + plain[n - 1 :] * _ODD[n - 1]
        at, place = _pieces(mix(sums + np.uint64(n)), hashes, slots)
        end = at + first + n - 1
        fine = end >= low
        out[end[fine] - low, n - 1] = place[fine]
    out[out[:, 0] == none, 0] = none - 1
    return out


def _sum_logs(x: np.ndarray) -> np.ndarray:
    """log of the sum of exp over the last axis."""
    top = x.max(axis=-1, keepdims=True)
    return top[..., 0] + np.log(np.exp(x - top).sum(axis=-1))


def _long_forward(codes: np.ndarray, logs: np.ndarray, path: str) -> np.ndarray:
    """_forward of one word of any length in logarithms: (length + 1, languages); logs: (languages, pieces + 2)."""
    most = vocabulary(path)[2]
    a = np.full((most + len(codes) + 1, len(logs)), -np.inf)  # the row of a beginning of n characters is most + n
    a[most] = 0
    for low in range(0, len(codes), STRETCH):
        high = min(low + STRETCH, len(codes))
        arcs = logs[:, _tails(codes, path, low, high)]
        for i in range(low, high):
            a[most + i + 1] = _sum_logs(a[i + 1 : i + 1 + most][::-1].T + arcs[:, i - low])
    return a[most:]


def _long_expected(codes: np.ndarray, logs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, expected counts) of one word under one language, forward and backward; logs: (pieces + 2,)."""
    most = vocabulary(path)[2]
    a = _long_forward(codes, logs[None], path)[:, 0]
    b = np.full(len(codes) + 1, -np.inf)
    b[-1] = 0
    pieces, counts = [], []
    for high in range(len(codes), 0, -STRETCH):
        low = max(0, high - STRETCH)
        tails = _tails(codes, path, low, high)
        for i in range(high - 1, low - 1, -1):  # the stretches that end after character i; b[i + 1] is whole by then
            n = min(most, i + 1)
            own = logs[tails[i - low, :n]] + b[i + 1]
            starts = i - np.arange(n)
            b[starts] = np.logaddexp(b[starts], own)
            pieces.append(tails[i - low, :n])
            counts.append(np.exp(a[starts] + own - a[-1]))
    return np.concatenate(pieces), np.concatenate(counts)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def log_probabilities(texts: list[str], model: Model, path: str) -> np.ndarray:
    """(words, languages): log of the probability of each word, summed over all segmentations into pieces."""
    marked = [MARK + t for t in texts]
    out = np.zeros((len(texts), len(model.langs)))
    short = np.array([i for i, t in enumerate(marked) if len(t) <= SHORT], dtype=np.int64)
    for place, codes in _by_length([marked[i] for i in short]):
        out[short[place]] = np.log(_forward(codes, _arcs(codes, path), model.p)[-1].T)
    with np.errstate(divide="ignore"):
        logs = np.log(model.p)
    for i, t in enumerate(marked):
        if len(t) > SHORT:
            out[i] = _long_forward(_codes(t), logs, path)[-1]
    return out


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(hashes of the distinct words, their bytes' ends, which of them each word is, row of each word)."""
    hashes, rows, starts, ends = words(data, offsets)
    kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    return kinds, list(zip(starts[first].tolist(), ends[first].tolist(), strict=True)), which, rows


def _texts(data: np.ndarray, spans: list[tuple[int, int]]) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode(errors="replace").lower() for a, b in spans]


class Known:
    """Scores of words met before in this task, by hash: at most about `most_bytes` of them, then it starts anew."""

    def __init__(self, model: Model, path: str, most_bytes: int = 16_000_000):
        self.model, self.path, self.most = model, path, most_bytes // (8 + 8 * max(1, len(model.langs)))
        self.hashes, self.logs = np.zeros(0, dtype=np.uint64), np.zeros((0, len(model.langs)))

    def of(self, kinds: np.ndarray, data: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
        place = np.searchsorted(self.hashes, kinds)
        met = np.zeros(len(kinds), dtype=bool)
        inner = place < len(self.hashes)
        met[inner] = self.hashes[place[inner]] == kinds[inner]
        out = np.zeros((len(kinds), len(self.model.langs)))
        out[met] = self.logs[place[met]]
        new = np.flatnonzero(~met)
        out[new] = log_probabilities(_texts(data, [spans[i] for i in new]), self.model, self.path)
        if len(self.hashes) + len(new) > self.most:
            self.hashes, self.logs = kinds, out
        else:
            self.hashes, self.logs = np.concatenate([self.hashes, kinds[new]]), np.concatenate([self.logs, out[new]])
            order = np.argsort(self.hashes)
            self.hashes, self.logs = self.hashes[order], self.logs[order]
        return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(1))
        for low, high, data, offsets in steps(batch.column(0)):
            _, spans, which, rows = _distinct(data, offsets)
            texts = _texts(data, spans)
            own = langs[low:high][rows] * np.int64(1 << 40) + which
            kinds, counts = np.unique(own, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds >> 40), pa.array([texts[i] for i in (kinds & ((1 << 40) - 1)).tolist()], pa.string()), pa.array(counts, pa.int64())], names=["lang_no", "word", "n"])


def _expected(p: np.ndarray | None, langs: int, path: str):
    """Counts of pieces by language, as expected under p; without p, each stretch that is a piece counts by its length, as a start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary(path)[0]) + 2
        total = np.zeros((langs, size))
        with np.errstate(divide="ignore"):
            logs = None if p is None else np.log(p)
        for batch in batches:
            lang, n = np.array(batch.column(0)), np.array(batch.column(2)).astype(float)
            marked = [MARK + t for t in batch.column(1).to_pylist()]
            short = np.array([i for i, t in enumerate(marked) if len(t) <= SHORT], dtype=np.int64)
            for place, codes in _by_length([marked[i] for i in short]):
                own, times = lang[short[place]], n[short[place]]
                arcs = _arcs(codes, path)
                if p is not None:
                    mine, each = p, own
                    a, b = (np.zeros((codes.shape[1] + 1, len(codes))) for _ in range(2))
                    a[0], b[-1] = 1, 1
                    for low, high, ids in sorted(arcs, key=lambda x: x[1]):
                        a[high] += a[low] * mine[each, ids]
                    for low, high, ids in sorted(arcs, key=lambda x: -x[0]):
                        b[low] += b[high] * mine[each, ids]
                    whole = a[-1]
                weights = [times * (high - low) if p is None else times * a[low] * mine[each, ids] * b[high] / whole for low, high, ids in arcs]
                cells = np.concatenate([own * size + ids for _, _, ids in arcs])
                total += np.bincount(cells, weights=np.concatenate(weights), minlength=langs * size).reshape(langs, size)
            for i, t in enumerate(marked):
                if len(t) <= SHORT:
                    continue
                if p is None:
                    codes = _codes(t)
                    for low in range(0, len(codes), STRETCH):
                        tails = _tails(codes, path, low, min(low + STRETCH, len(codes)))
                        total[lang[i]] += np.bincount(tails.ravel(), weights=np.tile(n[i] * np.arange(1, tails.shape[1] + 1), len(tails)), minlength=size)
                else:
                    pieces, counts = _long_expected(_codes(t), logs[lang[i]], path)
                    total[lang[i]] += n[i] * np.bincount(pieces, weights=counts, minlength=size)
        at = np.flatnonzero(total.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], names=["cell", "n"])

    return run


def _sampled(ids: DataFrame, most: int) -> DataFrame:
    """(id, lang): of each language the `most` ids of smallest hash. Ids are counted by language first, and only those with a hash
    under a limit that four times as many are expected to pass are put in order, so no task sorts a language."""
    ids = cut(ids.distinct().withColumn("h", F.xxhash64("id")))
    limits = ids.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.when(F.col("n") > 4 * most, F.lit(4.0 * most) / F.col("n") * 2.0**64 - 2.0**63).otherwise(F.lit(2.0**64)).alias("limit"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("h", "id"))
    near = ids.join(limits, "lang").where(F.col("h").cast("double") < F.col("limit"))
    return near.withColumn("place", place).where(F.col("place") <= most).select("id", "lang")


def fit(docs: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = 3_000, rounds: int = 3) -> Model:
    """Probabilities of the pieces of a fixed vocabulary for each language, by expectation maximisation over all segmentations.

    Learns from whole texts of at most max_docs ids of each language, those of the smallest hash, so that rare languages are
    learnt too. Words are counted by language, then every round is one pass over the word counts and sums expected counts of
    pieces, so the driver gets languages times pieces at most. Rows without text, language or id are left out; no others: a
    model without languages.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null and id is not null")
    picked = cut(_sampled(rows.select("id", "lang"), max_docs))
    rows = cut(rows.join(picked, ["id", "lang"], "left_semi"))
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    size = len(vocabulary(path)[0]) + 2
    if not langs:
        return Model([], np.zeros((0, size)))
    numbers = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i).cast("long"))])
    counted = rows.select("text", numbers[F.col("lang")].alias("lang_no")).mapInArrow(_word_counts, "lang_no bigint, word string, n bigint")
    counted = cut(counted.groupBy("lang_no", "word").agg(F.sum("n").alias("n")))
    p = None
    for _ in range(rounds + 1):
        sums = counted.mapInArrow(_expected(p, len(langs), path), "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros(len(langs) * size)
        total[sums["cell"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy()
        total = total.reshape(len(langs), size)
        total[:, -2:] = 0
        p = np.maximum(total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300), FLOOR)
        p[:, -2], p[:, -1] = FLOOR, 0
    return Model(langs, p)


def identify(docs: DataFrame, model: Model, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every whole text; id and other columns stay out of the prediction.

    Each word's probability under a language is the sum over all its segmentations into pieces (forward algorithm); the
    score is the posterior of the best language for equal priors. und with score 0 where text is null or has no letter, and
    for all texts where the model has no language. Ties go to the first language by name. Repeated rows get equal results; an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = Known(model, path)
        for batch in batches:
            lettered = np.array(batch.column(2))
            for low, high, data, offsets in steps(batch.column(1), size=STEP):
                kinds, spans, which, rows = _distinct(data, offsets)
                logs = np.zeros((high - low, len(model.langs)))
                if len(kinds) and model.langs:
                    each = known_words.of(kinds, data, spans)
                    for k in range(len(model.langs)):
                        logs[:, k] = np.bincount(rows, weights=each[which, k], minlength=high - low)
                known = lettered[low:high] & bool(model.langs)
                best = logs.argmax(axis=1) if model.langs else np.zeros(high - low, dtype=int)
                posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1) if model.langs else np.zeros(high - low)
                names = [model.langs[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(names, pa.string()), pa.array(np.where(known, posterior, 0.0))], names=["doc_id", "lang_pred", "score"])

    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return own.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")

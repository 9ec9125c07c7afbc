"""Encoding by a merge-type vocabulary: a score-ordered agenda of adjacent symbol pairs, held against the sentencepiece library."""

from __future__ import annotations

import functools
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import STEP_BYTES

#: Fixed value: the sign that stands for a space in pieces.
MARK = "▁"
#: Stretches of each of the two generations that a worker keeps with their ids, and the longest one that it keeps.
KEPT, KEPT_LENGTH = 200_000, 40
#: Signs up to which stretches are merged many at a time, in tables of these widths; a longer one has an agenda of its own.
WIDTHS = (8, 16, 32, 64)
NEVER = np.iinfo(np.int32).max


class Vocabulary:
    """Pieces, scores and byte ids of a model file, with the library's own processor.

    Only merge-type models with byte fallback, and whose normaliser does no more than put MARK before the text and in place
    of spaces, are taken; others raise ValueError. In tables a symbol is the id of a piece, or size + code point.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = sp.vocab_size()
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        probe = "  aﬁ Åb\n "
        if not all(map(sp.is_byte, self.bytes)) or any(map(sp.is_unused, plain)) or sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError(f"{path}: not a plain vocabulary with byte fallback")
        #: No piece has MARK after another sign, so no merge crosses such a place and texts can be cut there.
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.signs = np.arange(0x110000, dtype=np.int64) + size
        for p, i in self.ids.items():
            if len(p) == 1:
                self.signs[ord(p)] = i
        self.base = size + 0x110000
        order = np.unique([-self.scores[p] for p in self.ids], return_inverse=True)[1]
        rank = dict(zip(self.ids, order.tolist(), strict=True))
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self._symbol(p[:k]), self._symbol(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = (rank[p], i)
        self.codes = np.array(sorted(pairs), dtype=np.int64)
        self.ranks, self.wholes = (np.array([pairs[c][k] for c in self.codes.tolist()], dtype=np.int32) for k in (0, 1))

    def _symbol(self, piece: str) -> int | None:
        return self.ids.get(piece, self.size + ord(piece) if len(piece) == 1 else None)

    def spelt(self, symbol: int) -> list[int]:
        """Ids of a symbol: its own, or those of the bytes of a sign that is no piece."""
        return [symbol] if symbol < self.size else [self.bytes[b] for b in chr(symbol - self.size).encode()]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the order of scores, id) of what two symbols make; NEVER where that is no piece."""
        code = left * self.base + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NEVER), self.wholes[at]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """The symbols of a text, MARK standing for spaces, after all merges.

    Every adjacent pair that forms a piece is on the agenda. The pair of highest score goes first, the leftmost of several;
    entries whose symbols have changed since are passed over. Each merge brings at most two new pairs, so the work is
    n log n.
    """
    symbols = list(text)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def entries(places: list[tuple[int, int]]) -> list[tuple[float, int, int, int]]:
        pairs = [(left, right, symbols[left] + symbols[right]) for left, right in places if left >= 0 and right < n]
        return [(-scores[pair], left, right, len(pair)) for left, right, pair in pairs if pair in scores]

    agenda = entries([(i, i + 1) for i in range(n - 1)])
    heapq.heapify(agenda)
    while agenda:
        _, left, right, length = heapq.heappop(agenda)
        if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != length:
            continue
        symbols[left] += symbols[right]
        symbols[right] = ""
        after[left] = after[right]
        if after[left] < n:
            before[after[left]] = left
        for entry in entries([(before[left], left), (left, after[left])]):
            heapq.heappush(agenda, entry)
    return [s for s in symbols if s]


def merged_many(texts: list[str], width: int, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts after all merges, how many each has), for texts of at most `width` signs.

    The agendas are the rows of a table: at each place the rank of the pair that starts there. In every round each row makes
    the merge of the first of its best ranks, and ranks the two pairs at the new symbol.
    """
    n = len(texts)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    symbols = v.signs[np.array(texts, dtype=f"<U{width}").view(np.uint32)]
    places = np.tile(np.arange(width), n)
    there = places < np.repeat(sizes, width)
    after, before = places + 1, places - 1
    ranks, wholes = np.full(n * width, NEVER, dtype=np.int32), np.zeros(n * width, dtype=np.int32)

    def rank(left: np.ndarray, right: np.ndarray) -> None:
        ranks[left], wholes[left] = v.pair(symbols[left], symbols[right])

    at = np.flatnonzero(there & (places + 1 < np.repeat(sizes, width)))
    rank(at, at + 1)
    rows = np.arange(n)
    while len(rows):
        best = ranks.reshape(n, width)[rows].argmin(axis=1)
        left = rows * width + best
        go = ranks[left] != NEVER
        rows, best, left = rows[go], best[go], left[go]
        right = rows * width + after[left]
        symbols[left] = wholes[left]
        there[right], ranks[right], ranks[left] = False, NEVER, NEVER
        after[left] = after[right]
        more = after[left] < sizes[rows]
        onward = (rows * width + after[left])[more]
        before[onward] = best[more]
        rank(left[more], onward)
        back = before[left] >= 0
        rank((rows * width + before[left])[back], left[back])
    return symbols[there], there.reshape(n, width).sum(axis=1)


def piece_ids(text: str, v: Vocabulary) -> list[int]:
    """Ids of a text in which MARK stands for spaces; a sign that is no piece gives the ids of its bytes."""
    out: list[int] = []
    for s in merged(text, v.scores):
        i = v.ids.get(s)
        out.extend([i] if i is not None else [v.bytes[b] for b in s.encode()])
    return out


def many_ids(texts: list[str], v: Vocabulary) -> list[bytes]:
    """Little-endian ids of each text; long ones go one by one."""
    out: list[bytes] = [b""] * len(texts)
    single, low = [i for i, t in enumerate(texts) if len(t) > WIDTHS[-1]], 0
    for width in WIDTHS:
        own = [i for i, t in enumerate(texts) if low < len(t) <= width]
        low = width
        if not own:
            continue
        symbols, counts = merged_many([texts[i] for i in own], width, v)
        ends = np.cumsum(counts)
        odd = np.searchsorted(ends, np.flatnonzero(symbols >= v.size), side="right")
        data = symbols.astype("<i4").tobytes()
        for i, a, b in zip(own, (4 * (ends - counts)).tolist(), (4 * ends).tolist(), strict=True):
            out[i] = data[a:b]
        for k in np.unique(odd).tolist():
            ids = [v.spelt(s) for s in symbols[ends[k] - counts[k] : ends[k]].tolist()]
            out[own[k]] = np.array(list(itertools.chain.from_iterable(ids)), dtype="<i4").tobytes()
    for i in single:
        out[i] = np.array(piece_ids(texts[i], v), dtype="<i4").tobytes()
    return out


class Encoder:
    """Whole texts to little-endian ids. Each distinct stretch between spaces is encoded once while it is kept, and then
    compared with what the library gives for it. Stretches are named without their first MARK."""

    def __init__(self, path: str):
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.vocabulary = vocabulary(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [self._stretches(t.replace(" ", MARK)) for t in texts]
        if len(self.known) > KEPT:
            self.known, self.older = {}, self.known
        known = self.known
        new = set().union(*cut).difference(known)
        again = new & self.older.keys()
        known.update((s, self.older[s]) for s in again)
        new = list(new - again)
        known.update(zip(new, self._checked(new), strict=True))
        out = [b"".join(map(known.__getitem__, stretches)) for stretches in cut]
        for s in new:
            if len(s) > KEPT_LENGTH:
                del known[s]
        return out

    def _stretches(self, text: str) -> list[str]:
        if not text or not self.vocabulary.cuts:
            return [text] if text else []
        out = text.split(MARK)
        return [s[1:] for s in re.findall(f"{MARK}+[^{MARK}]*", MARK + text)] if "" in out else out  # spaces in a row stay together

    def _checked(self, stretches: list[str]) -> list[bytes]:
        own = many_ids([MARK + s for s in stretches], self.vocabulary)
        sp = self.vocabulary.library
        theirs = sp.encode([s.replace(MARK, " ") for s in stretches], num_threads=1)  # it puts the first MARK back, but not before nothing
        ids = np.fromiter(itertools.chain.from_iterable(x or [self.vocabulary.ids[MARK]] for x in theirs), dtype="<i4")
        if b"".join(own) != ids.tobytes() or any(len(mine) != 4 * max(len(x), 1) for mine, x in zip(own, theirs, strict=True)):
            raise ValueError("ids differ from the library's")
        return own


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker, so that stretches stay known."""
    return Encoder(path)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        decode = own.vocabulary.library.decode

        def rows(keys: list, texts: list[str]) -> pa.RecordBatch:
            ids = own.encode(texts)
            decoded = [decode(np.frombuffer(x, dtype="<i4").tolist()) for x in ids]
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            columns = [pa.array(keys, kind), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(decoded, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

        for batch in batches:
            kind = batch.schema.field(0).type
            keys, texts, held = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= STEP_BYTES:
                    yield rows(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield rows(keys, texts)

    return run


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>, without begin or end ids) and decoded of every whole text, by the model file at `path`.

    Ids come from the agenda of pairs; every distinct stretch of a task is compared with the library's ids, and the task
    fails if any differ. `decoded` is the library's decode(ids). Null and empty texts have no ids and decode to ''. A MARK
    in a text is read as a space, as the library does, and signs outside the vocabulary, control signs and the strings of special
    tokens are ordinary text. Repeated rows get equal results; an empty table gives an empty result; other columns are
    ignored. Nothing is shuffled; a task holds about a megabyte of text, or one text if that is longer, and up to 400,000 short stretches
    besides those of that megabyte.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_encoded(path), f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")

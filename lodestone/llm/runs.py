"""Periodic runs of words by a suffix automaton with link-cut access."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import mix, steps, words

#: Slots of the table in which stretches of three words are counted: a power of two.
SLOTS = 1 << 20
#: Times that a text is split at rare stretches; what is left then goes to the automaton as it is.
PASSES = 24


class Automaton:
    """Suffix automaton of the words so far, whose suffix links are kept as a link-cut tree.

    States are numbered from 1, the empty word first. Each preferred path of the tree is a splay tree by depth and has one
    colour: the place where all its words ended last. Appending a word opens the path of the new prefix, so that path is
    walked in stretches of one colour, an amortised logarithm of them, and gets the new place as colour.
    """

    def __init__(self):
        self.length, self.link = [0, 0], [0, 0]
        self.word, self.target, self.more = [-1, -1], [0, 0], {}  # the first transition of a state; the others by state
        self.up, self.shallow, self.deep, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last = 1

    def append(self, word: int, place: int) -> list[tuple[int, int]]:
        """Adds the word at `place`. Returns (place before, length) of the stretches of the new prefix's path, longest
        first: suffixes longer than the next stretch's length, and up to this one's, ended last at that place."""
        state = self._extend(word)
        return self._access(state, place)

    def _step(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.target[state]
        return self.more[state].get(word, 0) if state in self.more else 0

    def _set(self, state: int, word: int, target: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.target[state] = word, target
        else:
            self.more.setdefault(state, {})[word] = target

    def _new(self, length: int) -> int:
        for column, value in ((self.length, length), (self.link, 0), (self.word, -1), (self.target, 0), (self.up, 0), (self.shallow, 0), (self.deep, 0), (self.colour, -1)):
            column.append(value)
        return len(self.length) - 1

    def _extend(self, word: int) -> int:
        now, at = self._new(self.length[self.last] + 1), self.last
        self.last = now
        while at and not self._step(at, word):
            self._set(at, word, now)
            at = self.link[at]
        to = self._step(at, word) if at else 1
        if at and self.length[to] != self.length[at] + 1:
            to = self._split(to, at, word)
        self.link[now] = self.up[now] = to
        return now

    def _split(self, state: int, at: int, word: int) -> int:
        """A new state between `state` and its link, for its words of length[at] + 1 and less. Both have the same places."""
        new = self._new(self.length[at] + 1)
        self.word[new], self.target[new] = self.word[state], self.target[state]
        if state in self.more:
            self.more[new] = dict(self.more[state])
        self.link[new], self.link[state] = self.link[state], new
        while at and self._step(at, word) == state:
            self._set(at, word, new)
            at = self.link[at]
        self._splay(state)
        above = self.shallow[state]
        self.shallow[new], self.shallow[state], self.up[new] = above, new, state
        if above:
            self.up[above] = new
        return new

    def _access(self, state: int, place: int) -> list[tuple[int, int]]:
        found, below, at = [], 0, state
        while at:
            self._splay(at)
            if self.deep[at]:
                self.colour[self.deep[at]] = self.colour[at]  # what hangs deeper becomes a path of its own
            if at != state:
                found.append((self.colour[at], self.length[at]))
            self.deep[at] = below
            below, at = at, self.up[at]
        self.colour[below] = place
        return found

    def _splay(self, x: int) -> None:
        """Turns x to the top of its path's tree; the top carries the colour."""
        up, shallow, deep = self.up, self.shallow, self.deep
        while True:
            p = up[x]
            if not p or (shallow[p] != x and deep[p] != x):
                return
            g = up[p]
            if g and (shallow[g] == p or deep[g] == p):
                self._rotate(p if (shallow[g] == p) == (shallow[p] == x) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, shallow, deep = self.up, self.shallow, self.deep
        p = up[x]
        g = up[p]
        if shallow[p] == x:
            moved = shallow[p] = deep[x]
            deep[x] = p
        else:
            moved = deep[p] = shallow[x]
            shallow[x] = p
        if moved:
            up[moved] = p
        up[p], up[x] = x, g
        if g and shallow[g] == p:
            shallow[g] = x
        elif g and deep[g] == p:
            deep[g] = x
        else:
            self.colour[x] = self.colour[p]


def runs(codes: Sequence[int], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal runs of at least max(least, times * period) words, by start, then period.

    When a word is appended at i, a stretch of its path whose words ended last at j, d = i - j before, and whose lengths
    hold d, shows the square of two words of length d: nothing shorter repeats there, so d is the smallest period. The length
    of the stretch tells where the run starts; it is then followed to its end once.
    """
    automaton, n, out = Automaton(), len(codes), []
    done: dict[int, int] = {}  # place after the last found run of a period
    for i, code in enumerate(codes):
        found = automaton.append(code, i)
        for k, (j, longest) in enumerate(found):
            d = i - j
            shorter = found[k + 1][1] if k + 1 < len(found) else 0
            if j < 0 or not shorter < d <= longest or done.get(d, 0) > i:
                continue
            start, end = j - longest + 1, i + 1
            while end < n and codes[end] == codes[end - d]:
                end += 1
            done[d] = end
            if end - start >= max(least, times * d):
                out.append((start, end - start, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def candidates(hashes: np.ndarray, rows: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int]]:
    """(first word, word after the last) of stretches that can hold runs; no run lies outside of them.

    In a run each stretch of three words stands at least times - 1 times, so texts are cut wherever one stands less often
    in its piece, until nothing changes. Counts go by hash and are never too small, so pieces may be too long only.
    """
    floor = min(times - 1, max(least, times) - 2)
    n = len(hashes) - 2
    if n <= 0 or floor < 1:
        return [(0, len(hashes))] if len(hashes) else []
    key = mix(mix(mix(hashes[:n]) + hashes[1 : n + 1]) + hashes[2:])
    alive = rows[:n] == rows[2:]
    piece = rows[:n].astype(np.uint64)
    at = np.flatnonzero(alive)
    for _ in range(PASSES):
        slot = (mix(key[at] + mix(piece[at])) & np.uint64(SLOTS - 1)).astype(np.int64)
        often = np.bincount(slot, minlength=SLOTS)[slot] >= floor
        kept = at[often]
        first = np.ones(len(kept), dtype=bool)
        first[1:] = (np.diff(kept) > 1) | (rows[kept[1:]] != rows[kept[:-1]])
        number = np.cumsum(first) - 1
        long = np.bincount(number, minlength=1)[number] >= least - 2 if len(kept) else first
        kept, number = kept[long], number[long]
        if len(kept) == len(at):
            break
        at = kept
        piece[at] = number.astype(np.uint64)
    if not len(at):
        return []
    edge = np.flatnonzero((np.diff(at) > 1) | (rows[at[1:]] != rows[at[:-1]]))
    lows, highs = at[np.concatenate(([0], edge + 1))], at[np.concatenate((edge, [len(at) - 1]))] + 3
    return list(zip(lows.tolist(), highs.tolist(), strict=True))


def _found(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in steps(batch.column(1), lower=False):
                hashes, rows, starts, ends = words(data, offsets)
                n = high - low
                first = np.searchsorted(rows, np.arange(n))  # each row's first word
                own: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
                kept = np.ones(len(starts), dtype=bool)
                for a, b in candidates(hashes, rows, least, times):
                    codes: dict[bytes, int] = {}
                    text = [codes.setdefault(data[s:e].tobytes(), len(codes)) for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                    for start, length, period in runs(text, least, times):
                        own[rows[a]].append((start + a - int(first[rows[a]]), length, period))
                        kept[a + start + period : a + start + length] = False
                flat = np.array([r for x in own for r in x], dtype=np.int64).reshape(-1, 3)
                each = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32))
                found = pa.ListArray.from_arrays(each, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"]))
                counts = pa.array(np.bincount(rows, minlength=n).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), counts, found, _joined(data, offsets, rows, starts, ends, kept)], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def _joined(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    rows, starts, ends = rows[kept], starts[kept], ends[kept]
    change = np.zeros(len(data) + 1, dtype=np.int8)
    change[starts] += 1
    change[ends] -= 1
    inside = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    gaps = ends[:-1][rows[1:] == rows[:-1]]  # the byte after a word that another one of its row follows
    signs = data.copy()
    signs[gaps] = 0x20
    inside[gaps] = True
    place = np.concatenate(([0], np.cumsum(inside)))[offsets]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(place.astype(np.int64)), pa.py_buffer(signs[inside])]).cast(pa.string())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every whole text.

    Words are stretches without white space. A run is a stretch of words with smallest period q, at least
    max(least, times * q) long, which no neighbouring word extends; runs is array<struct<start, length, period>> in word
    numbers from 0, by start, then period. collapsed is the text without what runs repeat: words joined by one space, less those that
    any run holds after its first q words. times is 2 or more.

    Texts are cut at words that no run can hold (`candidates`); what is left goes through the automaton. Null and empty
    texts have no words, no runs and ''. Repeated rows get equal results; an empty table gives an empty result; other columns
    are ignored. Nothing is shuffled. A task holds about a megabyte of text, or one text if that is longer, and the automaton of one
    piece of it: about 500 bytes a word.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return own.mapInArrow(_found(least, times), f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")

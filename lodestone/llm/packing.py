"""Packing token pieces into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import freed

#: Fixed value: the string of the vocabulary's special token.
SPECIAL = "<|endoftext|>"
#: White space of this length and more goes to the slower library: the faster one's pattern nests a call for each character.
RUN = re.compile(r"\s{10000}")


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of `sizes` in k windows of near-equal sums.

    Each item starts as a partition with one window in use. The two partitions of largest spread merge, the largest
    windows of one onto the smallest of the other, until one is left. A partition lists its windows in use, largest
    first; the others are empty.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = max(0, len(a) + len(b) - k)
        met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)]
        now = sorted(a[: len(a) - over] + met + b[: len(b) - over], key=lambda w: -w[0])
        heapq.heappush(heap, (-(now[0][0] - (now[-1][0] if len(now) == k else 0)), tick, now))
        tick += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                items.append(x)
        out.append(items)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most `capacity`, from the fewest that could hold the sum; one more whenever the largest is too full."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        out = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in out):
            return out
        k += 1


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """text -> little-endian ids as the tokenizers file gives them. The file's ranks in tiktoken give the same ids in a third
    of the time; texts with the special token, or a run of white space that tiktoken's pattern can't take, go to tokenizers."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    core = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text or RUN.search(text):
            return np.array(_whole(vocabulary).encode(text, add_special_tokens=False).ids, dtype="<u4")
        return core.encode_to_numpy(text, disallowed_special=())

    return encode


@functools.lru_cache(maxsize=1)
def _whole(vocabulary: str):
    """The file's own tokenizer, which few tasks need."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def _pack(vocabulary: str, capacity: int, chunk: int, pool: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        waiting: list[tuple] = []
        kind = None

        def flush() -> None:
            nonlocal sequence, waiting
            for w in windows([x[2] for x in waiting], capacity):
                at = 0
                for i in sorted(w):
                    rows.append((*waiting[i], sequence, at))
                    at += waiting[i][2]
                sequence += 1
            waiting = []

        def table() -> pa.RecordBatch:
            nonlocal rows
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            rows = []
            types = (kind, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), 0).astype("<u4")
                n, whole = len(ids), len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    rows.append((key, start, capacity, n, ids[start : start + capacity].tobytes(), sequence, 0))
                    sequence += 1
                for start in range(whole, n, chunk):
                    part = ids[start : start + chunk]
                    waiting.append((key, start, len(part), n, part.tobytes()))
                if len(waiting) >= pool:
                    flush()
                if len(rows) >= 4 * pool:
                    yield table()
        if kind is not None:
            flush()
            yield table()

    return run


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, chunk: int = 128, pool: int = 1024) -> DataFrame:
    """Token pieces of all documents in windows of at most `capacity` ids.

    A document is its ids and then id 0. Whole windows are cut off it; what is left is cut into pieces of at most `chunk`
    ids. Every `pool` such pieces or so, in the order a task meets them, are spread over near-equal windows by
    Karmarkar-Karp differencing; the number of windows starts at what could just hold them and rises whenever one would
    exceed the capacity. Windows need no ids from other tasks, so nothing is shuffled, and a task holds one pool.

    Returns a row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset.
    Null text is empty and still has its id 0. Repeated rows are packed each. An empty table gives an empty result; other
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(freed(_pack(vocabulary, capacity, chunk, pool)), f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint")

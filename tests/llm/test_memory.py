"""What a worker holds while it counts features, and after its task."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from lodestone.llm import toxicity
from lodestone.llm.shared import freed


def sample(texts, sides):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(sides, pa.int32()), pa.array(np.arange(len(texts)) * 7919 + 5)], names=["id", "text", "side", "hash"])


def counted(batch):
    found = defaultdict(lambda: [0, 0, 0])
    for out in toxicity._counts(iter([batch])):
        assert out.num_rows <= toxicity.COUNTED
        for feature, p, u, held in zip(*[c.to_pylist() for c in out.columns], strict=True):
            x = found[feature]
            x[0], x[1], x[2] = x[0] + p, x[1] + u, x[2] ^ held
    return found


def test_counts_leave_in_small_batches():
    """A step of 500,000 bytes gave one batch of all its features, about as many as bytes of all four kinds."""
    g = np.random.default_rng(3)
    texts = ["".join(chr(c) for c in g.integers(97, 123, 60_000)) for _ in range(8)]
    assert len(counted(sample(texts, [1, 2, 3, 2, 1, 2, 2, 2]))) > 3 * toxicity.COUNTED


def test_counts_are_those_of_each_document():
    texts, sides = ["ab cab cab", None, "", "cab\tcabx", "ab c", "xyz", "ab cab cab", "x"], [1, 2, 2, 3, 2, 3, 2, 2]
    got = counted(sample(texts, sides))
    want = defaultdict(lambda: [0, 0, 0])
    for i, text in enumerate(texts):
        plain = re.sub(r"\s", " ", text or "")
        own = {sum(ord(c) << 8 * j for j, c in enumerate(plain[k : k + n])) | n << 56 for n in toxicity.GRAMS for k in range(len(plain) - n + 1)}
        for feature in own:
            x = want[feature]
            x[0], x[1], x[2] = x[0] + (sides[i] & 1), x[1] + (sides[i] >> 1), x[2] ^ (i * 7919 + 5)
    assert {k: v for k, v in got.items() if k > 0} == dict(want)
    words = sorted(v for k, v in got.items() if k < 0)  # ab, c, cab, cabx, x, xyz
    h = lambda *rows: np.bitwise_xor.reduce([i * 7919 + 5 for i in rows])
    assert words == sorted([[1, 2, h(0, 4, 6)], [0, 1, h(4)], [2, 2, h(0, 3, 6)], [1, 1, h(3)], [0, 1, h(7)], [1, 1, h(5)]])


def test_freed_gives_what_it_wraps():
    assert list(freed(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4]

"""Top-k of many queries and of tied rows against brute force."""

import numpy as np
import pandas as pd

from lodestone.operators.vector import topk


def brute(rows, asked, k):
    out = set()
    for q, x in asked:
        scored = sorted((-round(float(np.dot(x, v)), 6), i) for i, v in rows)
        out |= {(q, i, -s, place) for place, (s, i) in enumerate(scored[:k], 1)}
    return out


def frame(spark, name, rows):
    return spark.createDataFrame(pd.DataFrame({name: [i for i, _ in rows], "v": [list(map(float, v)) for _, v in rows]}), f"{name} bigint, v array<double>")


def test_topk_of_more_queries_than_a_block(spark):
    rng = np.random.default_rng(2)
    rows, asked = [(i, rng.integers(-9, 9, 4)) for i in range(40)], [(i, rng.integers(-9, 9, 4)) for i in range(5000)]
    got = topk(frame(spark, "vec_id", rows), frame(spark, "query_id", asked), 3).collect()
    assert {(r.query_id, r.vec_id, r.score, r.place) for r in got} == brute(rows, asked, 3) and len(got) == 15_000


def test_topk_of_many_equal_rows(spark):
    rng = np.random.default_rng(3)
    close = np.array([0.5, 0.5, 0.5, 0.5])
    rows = [(i, close + 1e-9 * rng.normal(size=4)) for i in rng.permutation(500)] + [(1000 + i, rng.normal(size=4) / 9) for i in range(100)]
    asked = [(1, close), (2, -close)]
    got = topk(frame(spark, "vec_id", rows).coalesce(1), frame(spark, "query_id", asked), 5).collect()
    assert [(r.vec_id, r.score, r.place) for r in sorted(got, key=lambda r: (r.query_id, r.place))][:5] == [(i, 1.0, i + 1) for i in range(5)]
    assert {(r.query_id, r.vec_id, r.score, r.place) for r in got} == brute(rows, asked, 5)

"""Evidence, usual values, joined vectors and newest photos by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import evidence


def test_all_ten_weights(spark):
    rows = [(1, 0.995, 6, 0.6, 1.0, 0.5, -1.0, 200, 0.4, True), (2, 0.5, 1, None, None, None, None, None, None, None), (3, 0.0, 0, 0.0, -0.6, 0.0, 0.7, -5, 0.1, True)]
    table = spark.createDataFrame(rows, "i int, sim double, hits int, category double, attributes double, ranked double, size double, confirmed int, customer double, read boolean")
    got = {r.i: r for r in evidence.evidence(table).collect()}
    assert got[1].score == pytest.approx(0.995 + 0.35 * 0.5 + 0.03 * 3 + 0.15 * 0.6 + 0.12 + 0.5 + 0.3 * 0.5 - 0.2 + 0.02 * math.log(51) + 0.06 * 0.4)
    assert got[1].reasons == ["near identical", "of the likely category", "attributes agree", "number read", "ranked from outside", "size differs", "confirmed before", "usual for the customer"]
    assert got[2].score == pytest.approx(0.5) and got[2].reasons == []
    assert got[3].score == pytest.approx(-0.03 - 0.072 + 0.5 + 0.14 + 0.006) and got[3].reasons == ["attributes differ", "number read", "size agrees"]
    assert evidence.evidence(table.select("i", "sim", "hits")).where("i = 2").first().score == pytest.approx(0.5)


def test_numbers_read(spark):
    found = spark.createDataFrame([(1, 5, 0.9, 2), (2, 6, 0.8, 1)], "query_id int, label int, sim double, hits int")
    read = spark.createDataFrame([(1, 5), (1, 7), (1, 7), (1, 99), (2, None)], "query_id int, label int")
    got = evidence.with_read(found, read, spark.createDataFrame([(5,), (6,), (7,)], "label int")).collect()
    assert sorted((r.query_id, r.label, r.sim, r.hits, r.read) for r in got) == [(1, 5, 0.9, 2, True), (1, 7, 0.0, 0, True), (2, 6, 0.8, 1, False)]


def test_told_apart(spark):
    ranked = spark.createDataFrame([(1, 1, 10, 0.3), (1, 2, 10, 0.35), (1, 3, 11, 0.35), (2, 1, 10, 0.9), (3, 1, None, 0.9), (3, 2, 10, 0.05)], "query_id int, item int, family int, p double")
    attributes = spark.createDataFrame([(1, "size", "1"), (2, "size", "2"), (1, "kind", "a"), (2, "kind", "a"), (1, "note", "x"), (3, "size", "9")], "item int, name string, value string")
    assert [(r.query_id, r.family, r.members, r.names) for r in evidence.told_apart(ranked, attributes).collect()] == [(1, 10, 2, ["note", "size"])]
    assert evidence.told_apart(ranked.limit(0), attributes).count() == 0


def test_usual_values(spark):
    rows = [(1, "size", "2")] * 2 + [(1, "size", "1")] * 2 + [(1, "kind", "x"), (1, "kind", None), (2, "size", "3"), (3, "size", "4"), (3, "size", "4")] + [(3, "size", str(i)) for i in range(10, 14)]
    got = evidence.usual(spark.createDataFrame(rows, "client int, name string, value string")).collect()
    assert [(r.client, r.name, r.value, r.n, r.share) for r in got] == [(1, "size", "1", 2, 0.5)]


def test_joined_and_pooled_vectors(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 4)), rng.normal(size=(2, 6))
    table = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(2)], "i int, a array<double>, b array<double>")
    v = [np.array(r.v) for r in table.select("i", evidence.joined((F.col("a"), 3.0), (F.col("b"), 1.0)).alias("v")).orderBy("i").collect()]
    cosine = lambda x: x[0] @ x[1] / np.linalg.norm(x[0]) / np.linalg.norm(x[1])
    assert v[0] @ v[1] == pytest.approx(0.75 * cosine(a) + 0.25 * cosine(b), abs=1e-6)
    (p,) = evidence.pooled(table.select(F.lit(1).alias("query_id"), F.col("a").alias("v"))).collect()
    assert np.allclose(p.v, a.mean(0) / np.linalg.norm(a.mean(0)), atol=1e-6)


def test_newest_photos(spark):
    rows = [("A", "1", "2024-01-01"), ("A", "2", "2024-03-01"), ("A", "3", None), ("A", "4", "2024-03-01"), ("B", "5", None)]
    photos = spark.createDataFrame(rows, "part_number string, path string, taken string")
    assert sorted(r.path for r in evidence.newest(photos, 2).collect()) == ["2", "4", "5"]
    assert sorted(r.path for r in evidence.newest(photos, 3).collect()) == ["1", "2", "4", "5"]

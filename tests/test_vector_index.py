"""The kept vector index: appends, means, checks on load, failed writes, pruned scans and recall on clustered vectors."""

import numpy as np
import pytest

from lodestone.operators import vector, vector_index
from lodestone.plans import versions

KIND = "vec_id bigint, label bigint, v array<double>"


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 4
    rows = [(i, i % 12, (centres[i % 12] + rng.normal(size=16)).tolist()) for i in range(600)]
    return spark.createDataFrame(rows, KIND).cache()


def found(rows):
    return {(r.query_id, r.vec_id, round(r.score, 6), r.place) for r in rows.collect()}


def test_appends_equal_one_build(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "ROWS", 20)  # cells go in many groups
    monkeypatch.setattr(vector_index, "QUERIES", 3)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    vector_index.create_index(clustered, one, cells=10)
    vector_index.create_index(clustered.where("vec_id % 4 = 1"), two, cells=7)
    assert vector_index.append_rows(spark, two, clustered.where("vec_id % 4 < 3")) == 300
    assert vector_index.append_rows(spark, two, clustered, photo=True) == 150
    assert vector_index.append_rows(spark, two, clustered) == 0
    asked = clustered.where("vec_id % 20 = 0").select(clustered.vec_id.alias("query_id"), "v")
    want = found(vector.topk(clustered.select("vec_id", "v"), asked, 5))
    assert found(vector_index.search_cells(spark, one, asked, 5)) == found(vector_index.search_cells(spark, two, asked, 5)) == want
    a, b = ({r.label: (r.n, np.round(r.v, 9).tolist()) for r in vector_index.category_means(spark, p).collect()} for p in (one, two))
    assert a == b and sum(n for n, _ in a.values()) == 600
    number, rows = vector_index.load_index(spark, two)
    assert number == 3 and rows.where("photo").count() == 150
    few = found(vector_index.search_cells(spark, two, asked, 5, probes=2))
    assert len({x[:2] for x in few} & {x[:2] for x in want}) >= 0.9 * len(want)
    plan = vector_index._rows(spark, versions.current(spark, two)[1], [1, 2]).where("v is not null")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_failed_writes_and_checks(spark, clustered, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(vector_index.Broken, match="no index"):
        vector_index.load_index(spark, path)
    vector_index.create_index(clustered.limit(50), path, cells=4)
    before = versions.current(spark, path)
    with pytest.raises(vector_index.Broken, match="dimension"):
        vector_index.append_rows(spark, path, spark.createDataFrame([(9999, 1, [1.0, 2.0])], KIND))
    assert versions.current(spark, path) == before
    number, facts = before
    versions.publish(spark, path, number, facts | {"segments": facts["segments"] * 2})
    with pytest.raises(vector_index.Broken, match="instead of 50"):
        vector_index.load_index(spark, path)


def test_odd_rows(spark, clustered, tmp_path):
    path = str(tmp_path / "index")
    vector_index.create_index(clustered.limit(0), path)
    assert vector_index.load_index(spark, path)[1].count() == 0
    odd = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, None, [0.5, 0.5]), (None, 1, [1.0, 1.0]), (3, 1, None)], KIND)
    vector_index.create_index(odd, path, cells=3)
    assert sorted(r.vec_id for r in vector_index.load_index(spark, path)[1].collect()) == [1, 2]
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id bigint, v array<double>")
    assert found(vector_index.search_cells(spark, path, asked, 5)) == {(7, 1, 1.0, 1), (7, 2, 0.5, 2)}

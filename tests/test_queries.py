"""Every registered query of the engine against its SQL in DuckDB."""

import math
import os

import duckdb
import pandas as pd
import pytest

from lodestone import registry
from lodestone.operators import analytics, answers, catalog, customers, evidence, fusion, learning, pages, printed, replay, reports, search, text_index, threads, vector, vector_index  # noqa: F401
from lodestone.streaming import admission, carts, events, kept, strips  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v if isinstance(v, int | str | bool) else str(v).removesuffix(" 00:00:00")


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(registry.SQL[name]).df())


def test_segments_cover_all_clients(spark):
    got = customers.segments(spark, SF)
    assert got.count() == got.select("client").distinct().count() > 0
    assert got.select("segment").distinct().count() <= 8


def test_carts_stream_as_batch(spark):
    key = lambda r: r.user_id
    stream = sorted(events.stream_carts(spark, SF).collect(), key=key)
    assert stream == sorted(events.carts_batch(spark.read.parquet(f"{SF}/events.parquet")).collect(), key=key)


def test_carts_over_micro_batches(spark, tmp_path):
    """Events in order of time over several files, one a micro-batch: the last state of each user is that of all events at once."""
    rows = pd.read_parquet(f"{SF}/events.parquet").sort_values(["ts", "event_id"])
    for i, at in enumerate(range(0, len(rows), len(rows) // 3)):
        rows.iloc[at : at + len(rows) // 3].to_parquet(tmp_path / f"{i}.parquet", index=False)
        os.utime(tmp_path / f"{i}.parquet", (1_000_000 + i * 60, 1_000_000 + i * 60))
    whole = spark.read.parquet(str(tmp_path))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    every = events.drained(events.carts_stream(stream, None), "append")
    assert every.count() > every.select("user_id").distinct().count()
    last = {r.user_id: (r.lines, r.pieces, r.placed) for r in every.orderBy("seen").collect()}
    assert last == {r.user_id: (r.lines, r.pieces, r.placed) for r in events.carts_batch(whole).collect()}

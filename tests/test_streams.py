"""Streams over several micro-batches, replays and conflicts against plain loops."""

import os
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.plans import versions
from lodestone.operators import analytics
from lodestone.streaming import admission, kept, strips
from lodestone.streaming.events import drained

SF = "/root/testdata/sf0.001"


def in_files(folder, rows, n):
    """Rows in n files, read in this order, one a micro-batch."""
    for i, at in enumerate(np.array_split(np.arange(len(rows)), n)):
        rows.iloc[at].to_parquet(folder / f"{i}.parquet", index=False)
        os.utime(folder / f"{i}.parquet", (1_000_000 + i * 60, 1_000_000 + i * 60))


def stream_of(spark, folder):
    whole = spark.read.parquet(str(folder))
    return whole, spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def loop(calls, most, span):
    held, out = {}, {}
    for c in sorted(calls, key=lambda c: (c.at, c.event_id)):
        own = held.setdefault(c.key, [])
        own[:] = [x for x in own if c.at - x <= span]
        out[c.event_id] = len(own) + (c.cost or 1) <= most
        if out[c.event_id]:
            own += [c.at] * (c.cost or 1)
    return out


@pytest.mark.parametrize(("most", "hours"), [(1, 5), (3, 36), (8, 100)])
def test_admission(spark, tmp_path, most, hours):
    """Batch and stream decide like a plain loop for every user, over five micro-batches."""
    rows = pd.read_parquet(f"{SF}/events.parquet").sort_values(["ts", "event_id"])
    rows.loc[rows.index[::3], "user_id"] = 1  # a busy user
    in_files(tmp_path, rows, 5)
    whole, stream = stream_of(spark, tmp_path)
    calls, span = admission.event_calls(whole), hours * 3_600_000_000
    want = loop(calls.collect(), most, span)
    assert {r.event_id: r.allowed for r in admission.admitted(calls, most, span).collect()} == want
    assert {r.event_id: r.allowed for r in drained(admission.admitted_stream(admission.event_calls(stream), most, span), "append").collect()} == want
    assert len(set(want.values())) == 2


def test_admission_of_odd_calls(spark):
    rows = [(None, 5, 1, None), (None, 6, 2, 1), (1, 0, 3, 2), (1, 0, 4, 2), (1, 61, 5, 1), (1, 60, 6, 0)]
    calls = spark.createDataFrame(rows, "key bigint, at bigint, event_id bigint, cost int")
    assert {r.event_id: r.allowed for r in admission.admitted(calls, 2, 60).collect()} == {1: True, 2: True, 3: True, 4: False, 5: True, 6: True}
    assert all(r.allowed for r in admission.admitted(calls, 0, 60).collect())
    assert admission.admitted(calls.limit(0), 2, 60).count() == 0
    held = deque()
    assert [admission.decide(held, t, 1, 3, 10) for t in range(0, 40, 2)].count(True) < 20 and len(held) <= 3


def test_client_buckets(spark):
    hosts = ["10.0.0.1", "::ffff:10.0.0.1", "2001:db8:1:2:3::4", "host:x", None, ""]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(admission.client_bucket("h")).collect()]
    assert got == ["10.0.0.1", "10.0.0.1", "2001:db8:1:2::/64", "host:x", None, ""]


def test_upserts_over_micro_batches(spark, tmp_path):
    """Seven micro-batches out of order of time: the last to arrive wins, and a second run or a replayed batch changes nothing."""
    rows = pd.read_parquet(f"{SF}/events.parquet").sample(frac=1, random_state=3).reset_index(drop=True)
    rows["arrival"] = np.arange(len(rows))
    folder, path = tmp_path / "in", str(tmp_path / "kept")
    folder.mkdir()
    in_files(folder, rows, 7)
    whole, stream = stream_of(spark, folder)
    for _ in range(2):
        kept.keep_up(stream.select("user_id", "value", "arrival"), path, str(tmp_path / "checkpoint"), ["user_id"], order=["arrival"])
    want = rows.groupby("user_id")["arrival"].max().to_dict()
    state = lambda: {r.user_id: (r.value, r.arrival) for r in kept.kept_table(spark, path).collect()}
    assert {u: a for u, (_, a) in state().items()} == want and {u: v for u, (v, _) in state().items()} == {u: rows["value"][a] for u, a in want.items()}
    number, facts = versions.current(spark, path)
    assert facts["batch"] == 6 and len(facts["segments"]) <= kept.SEGMENTS + 1
    before = state()
    assert not kept.merge_batch(whole.select("user_id", F.lit(0.0).alias("value"), "arrival"), 6, path, ["user_id"], order=["arrival"])
    with pytest.raises(Exception, match="broken"):
        kept.merge_batch(whole.selectExpr("user_id", "cast(raise_error('broken') as double) AS value", "arrival"), 7, path, ["user_id"], order=["arrival"])
    assert versions.current(spark, path)[0] == number and state() == before
    assert kept.merge_batch(spark.createDataFrame([(1, 5.5, -1)], "user_id bigint, value double, arrival bigint"), 7, path, ["user_id"], order=["arrival"])
    assert state()[1] == (5.5, -1)  # it came later


def test_log_compaction(spark, tmp_path, monkeypatch):
    """A compacted log gives the newest rows that the raw one gives; rows appended while it runs stay."""
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", F.when(F.col("event_type") == "click", "chatty").when(F.col("event_type") == "error", "none").otherwise("journey").alias("class"))
    keep, at, path = {"journey": 70, "chatty": 20}, ["ts", "event_id"], str(tmp_path / "log")
    pdf = rows.toPandas().sort_values(["ts", "event_id"], ascending=False)
    want = {i for c, n in keep.items() for i in pdf[pdf["class"] == c]["event_id"].head(n)}
    kept.append_log(rows.where("event_id % 2 = 0"), path)
    kept.append_log(rows.where("event_id % 2 = 1"), path)
    assert {r.event_id for r in kept.newest(kept.read_log(spark, path), "class", keep, at).collect()} == want
    real = kept.newest

    def slow(*args, **more):
        kept.append_log(spark.createDataFrame([(-1, None, "journey")], rows.schema), path)  # another writer, in between
        return real(*args, **more)

    monkeypatch.setattr(kept, "newest", slow)
    kept.compact_log(spark, path, "class", keep, at)
    assert {r.event_id for r in kept.read_log(spark, path).collect()} == want | {-1}
    monkeypatch.undo()
    tied = spark.createDataFrame([(i, "2024-01-01", "journey") for i in range(9)], "event_id bigint, ts string, class string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.event_id for r in kept.newest(tied, "class", {"journey": 4}, at).collect()) == [5, 6, 7, 8]
    assert kept.newest(tied.limit(0), "class", keep, at).count() == 0


def strip_loop(rows):
    """(orders after a strip, took a part, took a new one) by a plain loop over rows in order."""
    shown, had, n, took, new = {}, {}, 0, 0, 0
    for user, _, _, kind, items in rows:
        if user is None:
            continue
        if kind == "shown":
            shown[user] = set(items or [])
        elif kind == "checkout":
            own = set(items or [])
            strip = shown.pop(user, None)
            if strip is not None:
                n, took, new = n + 1, took + bool(own & strip), new + bool(own & strip - had.get(user, set()))
            had.setdefault(user, set()).update(own)
    return n, took, new


def test_strips_over_micro_batches(spark, tmp_path):
    """Six files with repeated parts, empty lists, missing users and other kinds, a batch that comes again, and merged first purchases."""
    rng = np.random.default_rng(4)
    users, kinds = [1, 1, 1, 2, 3, None], ["shown", "shown", "checkout", "checkout", "other"]
    rows = [(users[rng.integers(6)], pd.Timestamp("2024-01-01") + pd.Timedelta(hours=int(i) // 2 * 5), i, kinds[rng.integers(5)], [int(x) for x in rng.integers(0, 12, rng.integers(0, 4))]) for i in range(300)]
    (tmp_path / "in").mkdir()
    in_files(tmp_path / "in", pd.DataFrame(rows, columns=["user_id", "ts", "event_id", "kind", "parts"]).astype({"user_id": "Int64", "ts": "datetime64[us]"}), 6)
    whole, stream = stream_of(spark, tmp_path / "in")
    path = str(tmp_path / "kept")
    strips.strip_stream(stream, path, str(tmp_path / "checkpoint"))
    n, took, new = strip_loop(rows)
    want = (n, round(took / n, 6), round(new / n, 6))
    assert 0 < new < took < n
    assert tuple(strips.kept_takes(spark, path).first()) == want == tuple(analytics.strip_takes(whole).first())
    assert not strips.keep_strips(whole, 5, path) and strips.keep_strips(whole.limit(0), 6, path)
    assert tuple(strips.kept_takes(spark, path).first()) == want
    assert tuple(strips.kept_takes(spark, str(tmp_path / "none")).first()) == (0, None, None)

"""The kept text index against scans of the texts, after changes, compaction and failed writes."""

import pytest

from lodestone.operators import search, text_index
from lodestone.plans import versions


def hits(rows):
    return {(r.query, r[1]): round(r.score, 9) for r in rows.collect()}


def same(spark, path, docs, asked):
    assert hits(text_index.search_index(spark, path, asked)) == hits(search.bm25(docs, "id", "text", asked))


ASKED = ["common", "rare common", "word-14", "14 word", "missing common", "a/a", "", "--", '"rare rare-rare"']


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, text string, number string")


def test_phrases():
    assert search.phrases('1/2"  Pipe pipe -- NPT-x') == [("1", "2"), ("pipe",), ("npt", "x")]
    assert search.phrases('" - "') == []


def test_kept_index(spark, tmp_path):
    """Every score of a kept index is that of the texts: terms of all documents, rare and missing ones, phrases in order only, tokens that repeat."""
    rows = [(i, f"common word {i} " + "rare " * (i % 7 == 0) * (1 + i % 3) + "a " * (i % 5), f"n{i:03}") for i in range(60)] + [(60, "", None), (61, None, "N00"), (62, "--", ""), (None, "common", "x")]
    path = str(tmp_path / "index")
    text_index.write_index(frame(spark, rows), path, "id", "text", "number", buckets=4, files=3)
    docs = frame(spark, [r for r in rows if r[0] is not None])
    same(spark, path, docs, ASKED)
    assert text_index.search_index(spark, path, ["14 word"]).count() == 1  # both tokens, in any order, as two phrases
    assert text_index.search_index(spark, path, ["14-word"]).count() == 0
    assert sorted((r.query, r.key) for r in text_index.numbered(spark, path, ["n00", " N05 ", "", "zz"]).collect()) == sorted([("n00", i) for i in range(10)] + [("n00", 61)] + [(" N05 ", i) for i in range(50, 60)])


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "index")
    text_index.write_index(frame(spark, []), path, "id", "text")
    assert text_index.search_index(spark, path, ["common", ""]).count() == 0
    text_index.update_index(spark, path, frame(spark, [(1, "common", None)]), "id", "text")
    assert [r.key for r in text_index.search_index(spark, path, ["common"]).collect()] == [1]


def test_changes(spark, tmp_path, monkeypatch):
    """After updates, deletions, documents that come back, and compaction, searches are those of a fresh index."""
    path, state = str(tmp_path / "index"), {i: f"common word {i} a a" for i in range(40)}
    text_index.write_index(frame(spark, [(i, t, f"N{i}") for i, t in state.items()]), path, "id", "text", "number", buckets=4, files=2)
    steps = [({3: "rare rare rare", 41: "common a/a"}, [5, 6, 99]), ({5: "word 14", 3: None}, []), ({}, [41, 7]), ({41: "rare common", 8: ""}, [3])]
    for k, (changed, deleted) in enumerate(steps):
        gone = spark.createDataFrame([(i,) for i in deleted], "id int")
        text_index.update_index(spark, path, frame(spark, [(i, t, f"N{i}") for i, t in changed.items()]), "id", "text", "number", gone)
        for i in deleted:
            state.pop(i, None)
        state |= changed
        docs = frame(spark, [(i, t, None) for i, t in state.items()])
        same(spark, path, docs, ASKED)
        if k == 1:
            text_index.compact_index(spark, path)
            same(spark, path, docs, ASKED)
            assert len(versions.current(spark, path)[1]["segments"]) == 1
    assert sorted(r.key for r in text_index.numbered(spark, path, ["n4"]).collect()) == [4, 41]
    number, facts = versions.current(spark, path)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, path, number - 1, facts | {"n": 0})
    broken = frame(spark, [(1, "common", None)]).selectExpr("id", "raise_error('broken') AS text", "number")
    with pytest.raises(Exception, match="broken"):
        text_index.update_index(spark, path, broken, "id", "text", "number")
    assert versions.current(spark, path) == (number, facts)
    same(spark, path, docs, ASKED)
    assert versions.sweep(spark, path, set(facts["segments"])) > 0
    same(spark, path, docs, ASKED)


def test_repeated_keys(spark, tmp_path):
    path = str(tmp_path / "index")
    text_index.write_index(frame(spark, [(1, "a", None), (1, "b b", None), (2, None, None), (2, "a", None)]), path, "id", "text")
    assert sorted((r.query, r.key) for r in text_index.search_index(spark, path, ["a", "b"]).collect()) == [("a", 2), ("b", 1)]


def test_refined(spark):
    tier = spark.createDataFrame([("q", i) for i in range(6)] + [("z", 9)], "query string, key int")
    rows = [(i, "size", str(i % 2)) for i in range(6)] + [(i, "kind", "x") for i in range(6)] + [(0, "rare", "1"), (1, "rare", "2"), (9, "size", "1"), (0, "finish", None)] + [(i, "brand", f"b{i}") for i in range(3)]
    got = text_index.refined(tier, spark.createDataFrame(rows, "key int, name string, value string"), most=2).collect()
    assert sorted((r.query, r.name, r.carriers, r.value, r.n, r.name_place, r.value_place) for r in got) == [("q", "brand", 3, "b0", 1, 2, 1), ("q", "brand", 3, "b1", 1, 2, 2), ("q", "size", 6, "0", 3, 1, 1), ("q", "size", 6, "1", 3, 1, 2)]

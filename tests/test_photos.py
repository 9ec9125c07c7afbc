"""Photos as files: copies by content, and flat folders with a list of facts."""

from lodestone.sources import readers


def test_copies_by_content(spark, tmp_path):
    files = {"a/1.jpg": b"one", "a/2.jpg": b"two", "a/3.jpg": b"one", "b/1.jpg": b"one", "b/9.jpg": b"", "b/8.jpg": b""}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    at = lambda name: f"file:{tmp_path}/{name}"
    rows = [("A", at("a/3.jpg"), 0), ("A", at("a/1.jpg"), 1), ("A", at("a/2.jpg"), 2), ("A", at("a/2.jpg"), 2), ("B", at("b/9.jpg"), 0), ("B", at("b/8.jpg"), 0), ("B", at("b/1.jpg"), 1), ("B", "file:/gone.jpg", 2)]
    photos = spark.createDataFrame(rows, "part_number string, path string, position int")
    kept = readers.distinct_photos(spark, photos, str(tmp_path))
    assert sorted((r.part_number, r.path.rpartition("/")[2], r.position) for r in kept.collect()) == [("A", "2.jpg", 2), ("A", "3.jpg", 0), ("B", "1.jpg", 1), ("B", "8.jpg", 0), ("B", "9.jpg", 0), ("B", "gone.jpg", 2)]
    assert readers.distinct_photos(spark, photos.limit(0), str(tmp_path)).count() == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert all("content" not in line.split("Exchange", 1)[1].split("(")[0] for line in plan.splitlines() if "Exchange" in line)


def test_flat_folder_with_facts(spark, tmp_path):
    for name in ("1234A5.jpg", "1234a5 back.png", "7777B1_2.jpg", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "meta.jsonl").write_text('{"part_number": "1234a5", "name": "old"}\nnot json\n[1]\n{"name": "no number"}\n{"part_number": "1234A5", "name": "new"}\n{"part_number": "9999Z9"}\n')
    got = {r.part_number: (len(r.image_paths), r.m and r.m["name"]) for r in readers.flat_records(spark, str(tmp_path)).collect()}
    assert got == {"1234A5": (2, "new"), "7777B1": (1, None)}

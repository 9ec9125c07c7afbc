"""The pipeline's stages, each against what its predecessor kept."""

from collections import defaultdict
from pathlib import Path

import corpus_pipeline
from lodestone.llm import queries
from test_operators import LOWER, brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    kept = corpus_pipeline.toxicity(spark, docs, SF).cache()
    assert kept.columns == columns
    clean = docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0"), "doc_id", "left_semi")
    assert kept.join(clean, "doc_id", "left_semi").count() >= 0.8 * clean.count()
    one = corpus_pipeline.dedup_exact(spark, kept, SF).cache()
    groups = defaultdict(int)
    for r in kept.collect():
        groups[(r.text or "").translate(LOWER)] = max(groups[(r.text or "").translate(LOWER)], r.doc_id)
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(groups.values())
    near = corpus_pipeline.dedup_near(spark, one, SF).cache()
    parts = brute_components([(r.doc_id, r.text or "") for r in one.collect()], 5, 80)
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in parts.items() if i == c)
    mixed = corpus_pipeline.mix(spark, near, SF).cache()
    assert mixed.columns == columns and mixed.join(near, "doc_id", "left_anti").count() == 0
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3
    packed = corpus_pipeline.packing(spark, mixed, SF)
    per_copy = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    tokens = defaultdict(int)
    for r in packed.collect():
        tokens[r.doc_id] += r.length
        size = r.doc_tokens
        assert r.start + r.length <= size
    assert tokens.keys() == per_copy.keys()


def test_stages_on_repeated_rows_and_null_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.where("length(text) between 900 and 3000").orderBy("doc_id").limit(1).first()
    words = base.text.split(" ")
    near, other = " ".join(["Zz", *words[1:]]), " ".join(reversed(words))
    rows = [(1, base.text), (1, base.text), (2, base.text), (3, near), (3, other), (None, other.translate({b: a for a, b in LOWER.items()})), (None, None), (4, ""), (None, "lone words stand here quite by themselves today")]
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").select(*docs.columns)
    kept = corpus_pipeline.toxicity(spark, odd.unionByName(docs), SF)
    assert kept.where("doc_id is null").count() == 3
    one = corpus_pipeline.dedup_exact(spark, odd, SF).cache()
    got = sorted(((r.doc_id, r.text) for r in one.collect()), key=repr)
    assert got == sorted([(2, base.text), (3, near), (3, other), (4, ""), (None, rows[-1][1])], key=repr)
    two = corpus_pipeline.dedup_near(spark, odd, SF)
    assert sorted((r.doc_id or 0 for r in two.collect())) == [0, 0, 1, 3, 4]  # of other and its copy the one with an id
    mixed = corpus_pipeline.mix(spark, one, SF)
    assert mixed.where("coalesce(text, '') = ''").count() == 1 and mixed.columns == docs.columns
    assert corpus_pipeline.packing(spark, odd, SF).where("doc_id is null").count() >= 3


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_deletes_what_stages_wrote(spark):
    written = Path(spark.conf.get("spark.checkpoint.dir")) / "lodestone"
    before = set(written.iterdir())
    corpus_pipeline.run(spark, SF).write.format("noop").mode("overwrite").save()
    assert len(set(written.iterdir()) - before) == 4  # the results of the stages but the last


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert set(queries.QUERIES) <= set(names)

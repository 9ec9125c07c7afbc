"""Work that grows no faster than the input: long rules are planned once, and rows of few bytes are dealt over the tasks."""

import pytest
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.functions import dimensions, threads
from lodestone.operators import customers, evidence, printed, replay, text_index  # noqa: F401  they register queries
from lodestone.plans.scratch import dealt


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.mark.parametrize("rule", [printed.material_of, printed.head_of, printed.field_of])
def test_rules_of_lines_clean_a_line_once(spark, rule):
    df = spark.createDataFrame([("Brass", 1)], "line string, n int").select(rule(F.col("line")).alias("x"))
    assert plan(df).count("lower(line") <= 1 + (rule is printed.material_of) and plan(df).count("line#") <= 3


def test_printed_pages_are_dealt_over_tasks(spark):
    """Forty small pages in one partition were read by one task."""
    pages = spark.createDataFrame([(i, f"Fittings of one page\nPipe Size     Elbows\n1/2 ..... {50000 + i}D1 ... 1.00") for i in range(40)], "page bigint, text string").coalesce(1)
    found = printed.printed_parts(pages)
    assert found.count() == 40
    dealt = [line for line in plan(found, "executedPlan").splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 1 and "hashpartitioning(page" in dealt[0]


def test_summary_of_printed_pages_is_dealt_over_tasks(spark):
    from lodestone.operators import reports

    assert "REPARTITION_BY_NUM" in plan(reports.printed_summary(spark, "/root/testdata/sf0.001"), "executedPlan")


def test_facts_read_a_stated_size_once(spark):
    df = spark.createDataFrame([("1 1/4 NPT", 1)], "text string, n int")
    facts = threads.part_facts(threads.pipe_size(F.col("text")), F.col("text"), F.lit(None).cast("double"))
    df = df.select(facts.alias("x"))
    assert plan(df).count("regexp_extract(") <= 4 and plan(df).count("regexp_replace(") <= 3


def test_lengths_and_nut_widths_read_a_text_once(spark):
    df = spark.createDataFrame([("M6 x 1", 1)], "text string, n int")
    for rule in (dimensions.length_mm, threads.nut_width_mm):
        assert plan(df.select(rule(F.col("text")).alias("x"))).count("lower(trim(") == 1


def test_part_scores_shuffle_lines_once_by_client(spark):
    """Counts of five keys aren't rows of their own; null keys and unknown parts and clients count nothing."""
    lines = spark.createDataFrame([(1, 10, "A", "x", "f", 3, 7), (1, 11, "A", None, "f", 4, 8), (2, 12, None, None, None, None, 9)], "client long, order_id long, kind string, brand string, family string, size int, part long")
    catalog = spark.createDataFrame([("A", "x", "f", 3, 7), ("B", None, "g", 4, 8)], "kind string, brand string, family string, size int, part long")
    prior = spark.createDataFrame([(1, "A", 0.5, 0.5), (1, "B", 0.5, 0.5)], "client long, kind string, p double, g double")
    asked = spark.createDataFrame([(1, 7), (1, 7), (1, 8), (1, 9), (2, 7), (3, 7)], "client long, part long")
    scores = customers.part_scores(asked, catalog, lines, prior)
    assert "Generate" not in plan(scores, "executedPlan")
    assert {(r.client, r.part): r.boost for r in scores.collect()} == {(1, 7): 0.9, (1, 8): 0.66, (1, 9): 0.0, (2, 7): 0.0, (3, 7): 0.0}


def test_rounds_of_a_client_are_made_where_its_baskets_lie(spark):
    """Own families of every round were shuffled twice; now only open rounds leave the task, and rounds with enough own families only show hits."""
    baskets = spark.createDataFrame([(1, r, f, 1) for r in (1, 2, 3) for f in "abcdefgh"] + [(2, 1, "a", 1), (2, 2, "b", 1), (2, 3, "a", 1)], "client long, round long, family string, n long")
    own = replay._own(baskets.repartition(3, "client"))
    assert plan(own, "executedPlan").split("Initial Plan")[-1].count("Exchange ") == 1
    got = {(r.client, r.round, r.family, r.bought, r.new, r.latest, r.score, r.owns) for r in own.collect()}
    assert {g for g in got if g[0] == 1} == {(1, r, f, True, False, True, 1 + (r - 1) / 10, 8) for r in (2, 3) for f in "abcdef"}
    assert {g for g in got if g[0] == 2} == {(2, 2, "a", False, False, True, 1.1, 1), (2, 2, "b", True, True, False, None, 1), (2, 3, "a", True, False, False, 1.1, 2), (2, 3, "b", False, False, True, 1.1, 2)}


def test_dealt_rows_bound_a_task(spark):
    assert dealt(spark.range(1000).toDF("k"), 50, "k").rdd.getNumPartitions() == 20


def test_index_moves_a_row_a_document_and_bucket(spark, tmp_path):
    """A row was shuffled for each token and document, and every text for the sake of keys that repeat; the texts of single keys stay where they are."""
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "c"), (3, "d d")], "key long, text string")
    own = text_index._own(docs, "key", "text", None)
    assert sorted((r.key, r.text) for r in own.collect()) == [(1, "a b a"), (2, ""), (3, "d d")]
    packed = spark.createDataFrame([(["a", "b", "a"],)], "t array<string>").select(text_index._by_bucket("t", F.lit(1)).alias("m")).first().m
    assert packed == {0: "a:0,2 b:1"}
    text_index.write_index(docs, str(tmp_path / "i"), "key", "text", buckets=2, files=2)
    post = text_index._live(spark, text_index.versions.current(spark, str(tmp_path / "i"))[1], "postings")
    assert {(r.token, r.key, r.dl, tuple(r.places)) for r in post.collect()} == {("a", 1, 3, (0, 2)), ("b", 1, 3, (1,)), ("d", 3, 2, (0, 1))}


@pytest.mark.parametrize("query", ["copurchase_pairs", "usual_attributes", "customer_vector"])
def test_lines_are_dealt_by_client_before_rows_are_made_of_them(spark, query):
    """Pairs and attributes were counted in as few tasks as joins left, with a hash entry for each of a line's rows."""
    found = plan(registry.QUERIES[query](spark, "/root/testdata/sf0.001"), "executedPlan").split("Initial Plan")[-1].splitlines()
    made = next(i for i, line in enumerate(found) if "Generate" in line)
    assert "REPARTITION_BY_NUM" in next(line for line in found[made:] if "Exchange " in line)
    assert "client" not in next((line for line in found[:made] if "Exchange " in line), "")


def test_recommended_lists_are_held_against_a_client_s_row(spark):
    """Every family of a list was a row that was joined with all that clients bought; now a list is a cell, and only unknown customers are told by a join."""
    found = plan(customers.recommend(spark, "/root/testdata/sf0.001"))
    assert found.count("LeftAnti") == 1 and found.count("Window") == 0


def test_due_of_a_row_counts_undated_orders(spark):
    day = "transform({}, x -> timestamp '2000-01-01' + make_dt_interval(x))"
    rows = spark.sql(f"select i, {day.format('d')} as days, n from values (1, array(0, 10, 30), 3), (2, array(0, 400), 3), (3, array(0, 10), 2), (4, array(0, 1, 2, 300), 4), (5, array(0, 10), 3) as t(i, d, n)")
    assert {r.i: r.due for r in rows.select("i", customers._due_by(F.col("days"), F.col("n")).alias("due")).collect()} == {1: True, 2: False, 3: False, 4: True, 5: True}


@pytest.mark.parametrize("query", ["measured_sizes", "fitting_facts", "pipe_dimensions", "thread_families"])
def test_parts_that_state_sizes_are_dealt_over_tasks(spark, query):
    """A small file of parts was read, and all its rules worked out, by one task."""
    found = plan(registry.QUERIES[query](spark, "/root/testdata/sf0.001"), "executedPlan").split("Initial Plan")[-1]
    assert "REPARTITION_BY_NUM" in found and found.index("regexp") < found.index("REPARTITION_BY_NUM")


@pytest.mark.parametrize("query", ["printed_catalog", "printed_summary"])
def test_a_catalog_is_printed_once(spark, query):
    """Files were made of the part table twice, for their numbers of pages and for the pages."""
    from lodestone.operators import reports  # noqa: F401  it registers a query

    assert "p_partkey" not in plan(registry.QUERIES[query](spark, "/root/testdata/sf0.001"))

"""Queries against their SQL on tables made by hand for rules that the small tables don't reach."""

import duckdb
import pandas as pd
import pytest

from lodestone import registry
from lodestone.operators import customers, pages  # noqa: F401
from lodestone.streaming import carts  # noqa: F401


def same_as_sql(spark, folder, name):
    c = duckdb.connect()
    for p in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = registry.QUERIES[name](spark, str(folder)).toPandas()
    want = c.sql(registry.SQL[name]).df()[list(got.columns)]
    flat = lambda df: sorted((tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False)), key=repr)
    assert len(got) > 0 and flat(got) == flat(want)
    return got


@pytest.fixture
def cut_pages(tmp_path):
    titles = ["a ring &amp", "&lt;b&gt bolts&quot", "a &amp;amp b", "&amp;lt c", "bolts & nuts &am", "&amplt d", ""]
    rows = [(i, f"http://a.example/{i}?x=1", f'<html><title>{t}</title><img alt="" src="/p{i}.png">') for i, t in enumerate(titles)]
    pd.DataFrame(rows, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    part = [(i, f"part {i}", "Brand#1", "LARGE", i % 50, 900.0) for i in range(12)]
    pd.DataFrame(part, columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]).to_parquet(tmp_path / "part.parquet")
    return tmp_path


def test_names_of_signs_without_semicolon(spark, cut_pages):
    got = same_as_sql(spark, cut_pages, "page_products")
    assert dict(zip(got["page_id"], got["name"]))[0] == "a ring &"


def test_parts_named_by_cut_titles(spark, cut_pages):
    got = same_as_sql(spark, cut_pages, "enriched_parts")
    assert "a ring &" in set(got["name"])


@pytest.fixture
def long_ids(tmp_path):
    """Ids of pages above 66,667, whose numbers would have six digits, and keys of parts above 99,999."""
    rows = [(i, f"http://a.example/{i}?x=1", f"<html><title>page {i}</title>") for i in (8, 6682, 66674, 66675, 66822)]
    pd.DataFrame(rows, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    part = [(i, f"part {i}", "Brand#1", "LARGE", i % 50, 900.0) for i in (12, 10023, 100011, 110001, 300012)]
    pd.DataFrame(part, columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]).to_parquet(tmp_path / "part.parquet")
    return tmp_path


def test_numbers_of_pages_with_long_ids(spark, long_ids):
    """Pages told the last five digits of a long number, where the SQL has the first five."""
    got = same_as_sql(spark, long_ids, "enriched_parts")
    assert sorted(zip(got["part_number"], got["name"])) == [("00012A2", "page 8"), ("00012A2", "page 8"), ("10001A1", "page 66674"), ("10023A3", "page 6682")]


@pytest.fixture(scope="module")
def large_orders(tmp_path_factory):
    """Two orders of 60 families; two of 300, by two clients; two of 150, by one; one of 200 lines with three families; small ones, of which one key
    is stated for two clients and one has no client."""
    folder = tmp_path_factory.mktemp("orders")
    baskets = {1: range(60), 2: range(60), 3: range(300), 4: range(299, -1, -1), 5: range(300, 450), 6: range(300, 450), 7: [400, 401, 402] * 67, 8: [1, 2], 9: [310, 311, 500], 10: [310, 311], 11: [320, 321], 12: [320, 321]}
    clients = [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 6), (8, 1), (9, 7), (9, 8), (10, 7), (11, None), (12, None)]
    orders = pd.DataFrame(clients, columns=["o_orderkey", "o_custkey"]).astype("Int64")
    orders["o_orderdate"] = pd.Timestamp("2000-01-01")
    orders.astype({"o_orderdate": "datetime64[us]"}).to_parquet(folder / "orders.parquet")
    pd.DataFrame([(k, p, i, 1.0) for k, these in baskets.items() for i, p in enumerate(these)], columns=["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]).to_parquet(folder / "lineitem.parquet")
    part = [(i, f"family {i:03}", "Brand#1", "LARGE", 1) for i in range(500)]  # part 500 is unknown
    pd.DataFrame(part, columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size"]).to_parquet(folder / "part.parquet")
    return folder


def test_complements_are_of_whole_orders(spark, large_orders):
    """Only the first forty families of an order made pairs."""
    got = same_as_sql(spark, large_orders, "complements_lift")
    assert set(got["part"]) >= {f"family {i:03}" for i in (39, 40, 59, 60, 128, 299, 310, 311)} and "family 500" not in set(got["part"])


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_pairs_of_an_order_don_t_depend_on_its_blocks(spark, large_orders, monkeypatch, block):
    """Split into rows of one family each, of a few, and not at all."""
    monkeypatch.setattr(customers, "BLOCK", block)
    folder = str(large_orders)
    got = {(r.a, r.b): (r.orders, r.first, r.last) for r in customers.all_pairs(spark, folder, customers.sized_orders(spark, folder)).collect()}
    assert len(got) == 300 * 299 // 2 + 150 * 149 // 2
    assert got["family 000", "family 059"] == (4, 1, 4) and got["family 001", "family 002"] == (5, 1, 4) and got["family 298", "family 299"] == (2, 3, 4)
    assert got["family 300", "family 449"] == (2, 5, 5) and got["family 310", "family 311"] == (4, 5, 8) and got["family 320", "family 321"] == (4, 5, 5)


@pytest.fixture(scope="module")
def many_carts(tmp_path_factory):
    """Events of 24,000 clients over three stretches of a day; each touches its cart in one of them, every fourth again in the last."""
    folder, kinds = tmp_path_factory.mktemp("carts"), ["click", "view", "signup", "click"]
    day = 86_400
    rows = [(u, u % 3 * day // 3 + u % 997 + 1, kinds[u % 4]) for u in range(24_000)] + [(u, day - 5000 + u % 4001, kinds[u % 3]) for u in range(0, 24_000, 4)] + [(0, 0, "click"), (0, day - 1, "purchase")]
    events = pd.DataFrame([(i, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=at), u, kind, float(u % 90) + 0.5, f'{{"k": {u % 97}}}') for i, (u, at, kind) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    events["ts"] = events["ts"].astype("datetime64[us]")
    events.to_parquet(folder / "events.parquet")
    return folder


def test_carts_above_the_limit_go(spark, many_carts):
    open_ = same_as_sql(spark, many_carts, "cart_orders")
    assert open_["order_id"].isna().sum() <= 24_000 - 2_000


def test_kept_carts_above_the_limit_go(spark, many_carts):
    """After each stretch, so that of what one keeps the next may drop more than all events at once."""
    assert same_as_sql(spark, many_carts, "cart_orders_kept")["order_id"].notna().sum() >= 1

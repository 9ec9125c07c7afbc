"""Carts against a plain loop: limits of lines, pieces, age and number, over one batch, several, a stream and replays."""

import random
from collections import defaultdict

import pandas as pd
from test_streams import in_files, stream_of

from lodestone.streaming import carts

KINDS = ["add", "add", "add", "set", "remove", "place", "clear"]


def some_actions(n, seed=3):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 1, 5, 40])
        request = rng.choice([None, f"r{i}"])
        rows.append((rng.choice([1, 1, 1, 2, 3, 4]), at, i, rng.choices(KINDS, [6, 6, 6, 4, 4, 1, 1])[0], rng.randrange(9), rng.choice([None, 0, 1, 7, 600, -2]), request, rng.choice([None, 0.5, 0.25]), rng.choice([None, "exact", "likely"])))
    return rows


def loop(actions, max_lines, max_age):
    """(open carts, orders, refused events) by client, part and quantity rules stated once more."""
    held, touched, orders, refused = defaultdict(list), {}, {}, set()
    for client, at, event, action, part, quantity, *rest in sorted(actions, key=lambda a: (a[1], a[2])):
        cart = held[client]
        if cart and at - touched[client] > max_age:
            cart.clear()
        found = [x for x in cart if x["part"] == part]
        number = 1 if quantity is None else quantity
        if action == "place":
            if not cart:
                refused.add(event)
                continue
            orders[event] = (client, [tuple(x.values()) for x in cart])
            cart.clear()
        elif action == "clear":
            cart.clear()
        elif action == "remove":
            cart[:] = [x for x in cart if x["part"] != part]
        elif found:
            x = found[0]
            x["n"] = min(999, number if action == "set" else x["n"] + number)
            x["request"] = x["request"] or rest[0]
            if rest[0] and x["confidence"] is None:
                x["confidence"], x["tier"] = rest[1:]
        elif len(cart) >= max_lines:
            refused.add(event)
            continue
        else:
            cart.append({"part": part, "n": min(999, number), "request": rest[0], "confidence": rest[1], "tier": rest[2]})
        cart[:] = [x for x in cart if x["n"] > 0]
        touched[client] = at
    return {c: [tuple(x.values()) for x in cart] for c, cart in held.items() if cart}, touched, orders, refused


def read(lines):
    """The same of rows of lines."""
    open_, orders, refused = defaultdict(list), {}, set()
    for r in sorted(lines.collect(), key=lambda r: r.place):
        line = (r.part, r.quantity, r.request_id, r.confidence, r.tier)
        if r.kind == "open":
            open_[r.client].append(line)
        elif r.kind == "order":
            orders.setdefault(r.event_id, (r.client, []))[1].append(line)
        else:
            refused.add(r.event_id)
    return dict(open_), orders, refused


def test_carts_as_a_loop(spark):
    for max_lines, max_age in ((50, 10**9), (4, 60)):
        rows = some_actions(600, seed=max_lines)
        open_, _, orders, refused = loop(rows, max_lines, max_age)
        got = read(carts.carts_after(None, spark.createDataFrame(rows, carts.ACTIONS), max_lines, max_age))
        assert got == (open_, orders, refused) and orders and open_
    assert refused & {r[2] for r in rows if r[3] == "add"}


def test_carts_over_micro_batches(spark, tmp_path):
    """A stream of five files, then a batch that comes again: as all actions at once, without carts too old at the end."""
    rows, limits = some_actions(400, seed=8), {"max_lines": 5, "max_age": 200}
    rows += [(9, rows[0][1], 1000, "add", 1, 1, None, None, None)]  # touched once, long ago
    rows.sort(key=lambda r: (r[1], r[2]))
    types = dict.fromkeys(["client", "at", "event_id", "part", "quantity"], "Int64")
    (tmp_path / "in").mkdir()
    in_files(tmp_path / "in", pd.DataFrame(rows, columns=[c.split()[0] for c in carts.ACTIONS.split(", ")]).astype(types), 5)
    whole, stream = stream_of(spark, tmp_path / "in")
    path = str(tmp_path / "kept")
    carts.cart_stream(stream, path, str(tmp_path / "checkpoint"), **limits)
    open_, touched, orders, refused = loop(rows, **limits)
    now = max(r[1] for r in rows)
    want = {c: x for c, x in open_.items() if now - touched[c] <= limits["max_age"]}, orders, refused
    assert 9 in open_ and 9 not in want[0]
    assert read(carts.kept_carts(spark, path)) == want
    assert not carts.keep_carts(whole, 4, path, **limits)
    assert carts.keep_carts(whole.limit(0), 5, path, **limits)
    assert read(carts.kept_carts(spark, path)) == want


def test_oldest_carts_go(spark):
    rows = [(c, 1000 - c // 2, c, "add", p, 1, None, None, None) for c in range(50) for p in range(2)]
    lines = carts.carts_after(None, spark.createDataFrame(rows, carts.ACTIONS))
    left = lambda n: {r.client for r in carts.young(lines, 1000, max_carts=n).collect()}
    assert left(50) == set(range(50))
    assert left(49) == set(range(50)) - {49, 48, 47, 46, 44}  # five of fifty; 44 and 45 were touched at one time
    assert {r.client for r in carts.young(lines, 1000, max_age=10).collect()} == set(range(22))


def test_odd_actions(spark):
    rows = [(None, 1, 1, "add", 1, 1, None, None, None), (1, None, 2, "add", 1, 1, None, None, None), (1, 5, 3, "add", None, 1, None, None, None), (1, 6, 4, "dance", 1, 1, None, None, None), (1, 7, 5, "place", None, None, None, None, None), (1, 8, 6, None, 1, 1, None, None, None)]
    some = spark.createDataFrame(rows, carts.ACTIONS)
    assert read(carts.carts_after(None, some)) == ({}, {}, {3, 4, 5, 6})
    assert carts.carts_after(None, some.limit(0)).count() == 0
    held = carts.carts_after(None, spark.createDataFrame([(1, 50, 1, "add", 1, 2, None, None, None)], carts.ACTIONS))
    late = spark.createDataFrame([(1, 20, 2, "add", 1, 3, "r", 0.5, "exact")], carts.ACTIONS)
    assert [(r.at, r.quantity, r.request_id, r.confidence) for r in carts.carts_after(held, late).collect()] == [(50, 5, "r", 0.5)]

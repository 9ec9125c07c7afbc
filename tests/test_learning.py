"""Replay, segments, thresholds and periods against plain loops and by hand."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import customers, learning, replay
from lodestone.plans.views import order_lines

SF = "/root/testdata/sf0.001"


def plain_thresholds(rows, exact=0.9, likely=0.6, margin=0.15):
    """(exact, likely) by the rules, threshold by threshold."""
    wrong = sum(not ok for _, _, ok in rows)
    if len(rows) < 30 or wrong < 5:
        return exact, likely

    def pick(target, need, now):
        at = lambda t: [ok for p, m, ok in rows if p >= t and (not need or m >= margin)]
        rate = lambda t: sum(at(t)) / len(at(t)) if at(t) else 0.0
        names = sorted({round(p, 3) for p, _, _ in rows})
        for t in names:
            if len(at(t)) >= 10 and rate(t) >= target:
                return t
        above = [(rate(t), -t) for t in names if t > now and len(at(t)) >= 10]
        return -max(above)[1] if above and max(above)[0] >= rate(now) + 0.05 else now

    low = pick(0.9, False, likely)
    return max(pick(0.98, True, exact), low), low


def test_thresholds(spark):
    rng = random.Random(8)
    for n, bias in ((0, 1), (29, 1), (30, 1), (60, 0.2), (200, 0.5), (300, 1), (400, 1.6), (400, 9)):
        rows = [(p := rng.random(), rng.random(), rng.random() < min(1, p * bias)) for _ in range(n)]
        rows += [(round(p, 3), m, ok) for p, m, ok in rows[:40]]
        got = learning.chosen_thresholds(spark.createDataFrame(rows, "p double, margin double, ok boolean")).collect()
        assert len(got) == 1 and (got[0].exact, got[0].likely) == plain_thresholds(rows) and got[0].samples == len(rows)
        assert got[0].refit == (len(rows) >= 30 and sum(not ok for *_, ok in rows) >= 5)
    few = [(0.95, 0.5, True)] * 100 + [(0.3, 0.1, False)] * 4
    assert not learning.chosen_thresholds(spark.createDataFrame(few, "p double, margin double, ok boolean")).first().refit
    labelled, catalog = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None)], "photo int, part string"), spark.createDataFrame([("a",), ("b",)], "part string")
    assert [r.photo for r in learning.unseen(labelled, catalog, spark.createDataFrame([(2,)], "photo int"), "photo", "part").collect()] == [1]


@pytest.mark.parametrize("every", [4, 7.5, 11, 23])
def test_periods(spark, every):
    n, rng = 240, np.random.default_rng(1)
    i = np.arange(n)
    wave, slope = np.sin(2 * np.pi * i / every), 0.02 * i
    found, strength = learning.period(wave + slope + 0.1 * rng.normal(size=n))
    assert found == pytest.approx(every, rel=0.02) and strength > 3
    pulses = ((i % 12) == 0).astype(float)
    assert learning.period(pulses)[0] == pytest.approx(12, rel=0.02)  # overtones don't stand for the ground wave
    rows = [(1, [float(x) for x in wave]), (2, None), (3, []), (4, [1.0] * 31), (5, [0.0] * 100), (6, [None] * 100)]
    got = {r.key: r.period for r in learning.dominant_periods(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v").collect()}
    assert got[1] == pytest.approx(every, rel=0.02) and all(got[k] is None for k in range(2, 7))


def test_replay_by_loop(spark):
    """Round by round over plain counters of what came before."""
    rows = [(r.client, r.placed_at, r.order_id, r.family) for r in order_lines(spark, SF).where("client % 3 = 0").collect()]
    rows += [(10**6, "2024-01-01", 10**7, None)]
    orders = {}
    for client, at, order, family in rows:
        orders.setdefault(client, {}).setdefault((str(at), order), []).append(family)
    rounds = {c: [[f for f in o[k] if f] for k in sorted(o)] for c, o in orders.items()}
    want = {}
    for k in range(1, max(map(len, rounds.values())) + 1):
        popular, pairs = Counter(), Counter()
        for own in rounds.values():
            for basket in own[: k - 1]:
                popular.update(basket)
                pairs.update((a, b) for a in set(basket) for b in set(basket) if a != b)
        top = [f for f, _ in sorted(popular.items(), key=lambda x: (-x[1], x[0]))[:6]]
        near = {a: sorted(((-n, b) for (x, b), n in pairs.items() if x == a))[:6] for a in {a for a, _ in pairs}}
        tally = [0, 0, 0]
        for own in rounds.values():
            if len(own) < k:
                continue
            before, scores = Counter(f for basket in own[: k - 1] for f in basket), {}
            offers = [(f, 1 + n / 10) for f, n in before.items()] + [(f, 0.1 * min(1, popular[f] / 50)) for f in top]
            offers += [(b, 0.4 + min(-n, 5) / 50) for f in (set(own[k - 2]) if k > 1 else ()) for n, b in near.get(f, [])]
            for f, s in offers:
                scores[f] = max(scores.get(f, 0), round(s, 9))
            shown = {f for f, _ in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:6]}
            hit = shown & set(own[k - 1])
            tally = [tally[0] + 1, tally[1] + bool(hit), tally[2] + bool(hit - set(before))]
        want[k] = tuple(tally)
    frame = spark.createDataFrame([(c, o, str(at), f) for c, at, o, f in rows], "client bigint, order_id bigint, placed_at string, family string")
    assert {r.round: (r.orders, r.hits, r.new_hits) for r in replay.replayed(frame).collect()} == want
    assert replay.replayed(frame.limit(0)).count() == 0


def test_learned_segments(spark):
    """Summaries and purity of the learned segments, from their assignment written once."""
    assigned, lines = customers.segments(spark, SF).cache(), order_lines(spark, SF)
    got = {r.segment: r for r in replay.segment_summaries(lines, assigned).collect()}
    of = {r.client: r.segment for r in assigned.collect()}
    kinds, parts, orders = {}, {}, {}
    for r in lines.collect():
        s = of.get(r.client)
        if s is not None:
            kinds.setdefault(s, Counter())[r.kind] += r.kind is not None
            parts.setdefault(s, Counter())[r.part] += 1
            orders.setdefault(s, set()).add(r.order_id)
    assert set(got) == set(of.values())
    for s, r in got.items():
        first = sorted(kinds[s].items(), key=lambda x: (-x[1], x[0]))
        assert r.label == " + ".join(k for k, _ in first[:2]) and r.orders == len(orders[s]) and r.clients == sum(x == s for x in of.values())
        assert r.favourites == [p for p, _ in sorted(parts[s].items(), key=lambda x: (-x[1], x[0]))[:40]]
    known = lines.groupBy("client").agg(F.max_by("kind", F.struct("order_id", "line_no")).alias("class"))
    cells = Counter((of[r.client], r["class"]) for r in known.collect() if r.client in of)
    best = Counter()
    for (s, _), n in cells.items():
        best[s] = max(best[s], n)
    row = replay.purity(assigned, known).first()
    assert row.clients == sum(cells.values()) and row.purity == round(sum(best.values()) / row.clients, 6)
    assert replay.purity(assigned.limit(0), known).first().purity is None

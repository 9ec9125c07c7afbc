"""Guarded refit of answer thresholds, and the dominant period of series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.fusion import EXACT_MARGIN, EXACT_P, LIKELY_P
from lodestone.plans.views import SQL_EVENTS, attributed, event_log, table
from lodestone.registry import query

#: Precision that a tier has to have, answers that a threshold needs, what a raised one has to gain, samples and wrong ones
#: below which nothing is refitted; shortest series, shortest period and longest as a share of the series.
EXACT_PRECISION, LIKELY_PRECISION, SUPPORT, GAIN, LEAST, LEAST_WRONG = 0.98, 0.90, 10, 0.05, 30, 5
LEAST_SAMPLES, LEAST_PERIOD, MOST_SHARE = 32, 3.0, 0.15
#: Slots of the event series, of three hours each.
SLOTS, SLOT = 240, 10_800


def unseen(labelled: DataFrame, catalog: DataFrame, learned: DataFrame, key: str, part: str) -> DataFrame:
    """Labelled rows whose part the catalog has and whose key was never learned."""
    return labelled.join(catalog.select(part), part, "left_semi").join(learned.select(key), key, "left_anti")


def chosen_thresholds(samples: DataFrame, exact: float = EXACT_P, likely: float = LIKELY_P, margin: float = EXACT_MARGIN) -> DataFrame:
    """(samples, wrong, refit, exact, likely): thresholds for the first answers' probabilities, in one row.

    samples: p, margin, ok. A threshold is one of the probabilities rounded to three digits; p at it or above is in the tier, for
    `exact` with at least `margin`. The lowest whose precision meets the tier's target on SUPPORT answers or more; where
    none does, the most precise one above the threshold in use that has the support, lowest of several, if it gains GAIN or more on
    that. exact is never under likely. With fewer than LEAST samples, or LEAST_WRONG wrong ones, the thresholds stay.
    Samples are counted by the thousandth that they reach, a thousand rows at most; sums run over these.
    """
    rows = samples.where("p is not null").select("p", "ok", (F.coalesce("margin", F.lit(0.0)) >= margin).alias("clear"), F.round(F.col("p") * 1000).cast("int").alias("near"))
    rows = rows.withColumn("reached", F.when(F.col("p") >= F.col("near") / F.lit(1000.0), F.col("near")).otherwise(F.col("near") - 1))
    tiers = {"exact": (F.col("clear"), EXACT_PRECISION, exact), "likely": (F.lit(True), LIKELY_PRECISION, likely)}
    facts = [F.count("*").alias("samples"), F.count_if(~F.col("ok")).alias("wrong")]
    for name, (inside, _, now) in tiers.items():
        there = inside & (F.col("p") >= now)
        facts.append(F.coalesce(F.try_divide(F.count_if(there & F.col("ok")), F.count_if(there)), F.lit(0.0)).alias(f"{name}_now"))
    whole = rows.agg(*facts)
    marks = F.array(F.struct(F.col("reached").alias("at"), F.lit(1).alias("one"), F.lit(False).alias("named")), F.struct(F.col("near").alias("at"), F.lit(0).alias("one"), F.lit(True).alias("named")))
    counts = rows.select("ok", "clear", F.explode(marks).alias("m")).select("ok", "clear", "m.*")
    sums = [F.max("named").alias("named")]
    for name, (inside, _, _) in tiers.items():
        sums += [F.sum(F.when(inside, F.col("one")).otherwise(0)).alias(f"{name}_n"), F.sum(F.when(inside & F.col("ok"), F.col("one")).otherwise(0)).alias(f"{name}_k")]
    counts = counts.groupBy("at").agg(*sums)
    up = W.orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, 0)  # at most a thousand rows
    counts = counts.withColumns({f"{name}_{x}": F.sum(f"{name}_{x}").over(up) for name in tiers for x in "nk"}).where("named").withColumn("threshold", F.col("at") / F.lit(1000.0))
    picks = []
    for name, (_, target, now) in tiers.items():
        precision, held = F.try_divide(F.col(f"{name}_k"), F.col(f"{name}_n")), F.col(f"{name}_n") >= SUPPORT
        picks += [F.min(F.when(held & (precision >= target), F.col("threshold"))).alias(f"{name}_met"), F.max(F.when(held & (F.col("threshold") > now), F.struct(precision.alias("precision"), (-F.col("threshold")).alias("minus")))).alias(f"{name}_best")]
    found = counts.agg(*picks).join(F.broadcast(whole))  # a row each
    new = lambda name, now: F.coalesce(F.col(f"{name}_met"), F.when(F.col(f"{name}_best.precision") >= F.col(f"{name}_now") + GAIN, -F.col(f"{name}_best.minus")), F.lit(now))
    refit = (F.col("samples") >= LEAST) & (F.col("wrong") >= LEAST_WRONG)
    low = F.when(refit, new("likely", likely)).otherwise(likely)
    high = F.when(refit, F.greatest(new("exact", exact), low)).otherwise(exact)
    return found.select("samples", "wrong", refit.alias("refit"), high.alias("exact"), low.alias("likely"))


_SQL_SAMPLES = f"""{SQL_EVENTS}, learned AS (SELECT DISTINCT request_id FROM log WHERE event_type = 'signup'),
 sample AS (SELECT confidence AS p, category / 10.0 AS margin, best = truth OR (confidence * 100 >= 62 AND event_id % 25 <> 0) AS ok FROM hit WHERE truth IN (SELECT p_partkey FROM part) AND request_id NOT IN (SELECT request_id FROM learned) AND confidence IS NOT NULL)"""


def _tier(name: str, target: float, inside: str, now: float) -> str:
    return f""" {name}_t AS (SELECT t, count(*) AS n, avg(ok::INT) AS prec FROM cand JOIN sample ON p >= t AND {inside} GROUP BY t HAVING count(*) >= {SUPPORT}), {name}_now AS (SELECT coalesce(avg(ok::INT), 0) AS prec FROM sample WHERE p >= {now} AND {inside}),
 {name} AS (SELECT coalesce((SELECT min(t) FROM {name}_t WHERE prec >= {target}), (SELECT t FROM {name}_t WHERE t > {now} AND prec >= (SELECT prec FROM {name}_now) + {GAIN} ORDER BY prec DESC, t LIMIT 1), {now}) AS t)"""


@query(f"""WITH {_SQL_SAMPLES}, cand AS (SELECT DISTINCT round(p, 3) AS t FROM sample),{_tier("exact", EXACT_PRECISION, f"margin >= {EXACT_MARGIN}", EXACT_P)},{_tier("likely", LIKELY_PRECISION, "true", LIKELY_P)}, c AS (SELECT count(*) AS samples, count(*) FILTER (WHERE NOT ok) AS wrong FROM sample)
 SELECT samples, wrong, samples >= {LEAST} AND wrong >= {LEAST_WRONG} AS refit, CAST(CASE WHEN samples >= {LEAST} AND wrong >= {LEAST_WRONG} THEN greatest((SELECT t FROM exact), (SELECT t FROM likely)) ELSE {EXACT_P} END AS DOUBLE) AS exact, CAST(CASE WHEN samples >= {LEAST} AND wrong >= {LEAST_WRONG} THEN (SELECT t FROM likely) ELSE {LIKELY_P} END AS DOUBLE) AS likely FROM c""")
def refitted_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from bought answers whose photos were never learned."""
    log = event_log(spark, sf_dir)
    right = (F.col("best") == F.col("truth")) | ((F.col("confidence") * 100 >= 62) & (F.col("event_id") % 25 != 0))
    learned, catalog = log.where("event_type = 'signup'"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("truth"))
    rows = unseen(attributed(log), catalog, learned, "request_id", "truth")
    return chosen_thresholds(rows.select(F.col("confidence").alias("p"), (F.col("category") / 10.0).alias("margin"), right.alias("ok")))


def period(x: np.ndarray) -> tuple[float, float] | None:
    """(samples a period, strength) of the strongest wave of a series, None where it is short or flat.

    A moving mean over a fifth of the series, 31 at least, with 0 beyond the ends, is taken off, a Hann window laid over, and of the spectrum's lines with
    periods from LEAST_PERIOD samples to MOST_SHARE of the series the largest counts. Where the line of half its frequency has a
    third of its size (0.35) and stands thrice over the median line, that is the ground wave and the other its overtone. Strength is the
    line over the largest one that is no neighbour of it or of its double. A parabola through the neighbours refines the place.
    """
    n = len(x)
    if n < LEAST_SAMPLES:
        return None
    reach = max(31, n // 5) // 2
    sums = np.concatenate(([0.0], np.cumsum(x)))
    low, high = np.maximum(np.arange(n) - reach, 0), np.minimum(np.arange(n) + reach + 1, n)
    flat = x - (sums[high] - sums[low]) / (2 * reach + 1)
    lines = np.abs(np.fft.rfft(flat * np.hanning(n)))
    first, last = int(np.ceil(1 / MOST_SHARE - 1e-9)), int(n / LEAST_PERIOD)
    inside = slice(first, last + 1)
    if first > last or not lines[inside].max() > 1e-9 * (1 + np.abs(x).max()):
        return None
    at = first + int(lines[inside].argmax())
    half = at // 2
    if half >= first and lines[half] >= 0.35 * lines[at] and lines[half] > 3 * np.median(lines[inside]):
        at = half
    rest = np.zeros_like(lines)
    rest[inside] = lines[inside]
    for k in (at, 2 * at):
        rest[max(k - 2, 0) : k + 3] = 0
    place = float(at)
    if at + 1 < len(lines):
        a, b, c = lines[at - 1 : at + 2]
        bend = a - 2 * b + c
        place += 0.5 * (a - c) / bend if abs(bend) > 1e-9 else 0.0
    return n / place, float(lines[at] / (rest.max() + 1e-9))


def dominant_periods(series: DataFrame, key: str, values: str) -> DataFrame:
    """(key, period, strength) of each series (key, values array<double>), both null where it has none (see `period`). A series is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [period(np.array(v.as_py() or [], dtype=np.float64)) or (None, None) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]], names=["key", "period", "strength"])

    kind = series.schema[key].dataType.simpleString()
    return series.select(F.col(key).alias("key"), F.transform(values, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("values")).mapInArrow(run, f"key {kind}, period double, strength double")


_WINDOW = max(31, SLOTS // 5) // 2


@query(f"""WITH g AS (SELECT user_id % 20 AS key, i FROM (SELECT DISTINCT user_id % 20 AS user_id FROM events) u, range({SLOTS}) r(i)), c AS (SELECT user_id % 20 AS key, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / {SLOT}) AS BIGINT) AS i, count(*) AS n FROM events GROUP BY ALL),
 s AS (SELECT g.key, g.i, coalesce(n, 0) + 6.0 * (sin(2 * pi() * g.i / (5 + g.key)) > 0.5)::INT AS x FROM g LEFT JOIN c ON c.key = g.key AND c.i = g.i),
 f AS (SELECT key, i, (x - sum(x) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN {_WINDOW} PRECEDING AND {_WINDOW} FOLLOWING) / {2 * _WINDOW + 1}.0) * (0.5 - 0.5 * cos(2 * pi() * i / {SLOTS - 1})) AS y FROM s),
 l AS (SELECT key, k, sqrt(pow(sum(y * cos(2 * pi() * k * i / {SLOTS})), 2) + pow(sum(y * sin(2 * pi() * k * i / {SLOTS})), 2)) AS v FROM f, range({SLOTS // 2 + 1}) t(k) GROUP BY ALL),
 v AS (SELECT * FROM l WHERE {SLOTS}.0 / nullif(k, 0) BETWEEN {LEAST_PERIOD} AND {SLOTS * MOST_SHARE}), top AS (SELECT key, arg_max(k, v) AS k, max(v) AS peak, median(v) AS mid FROM v GROUP BY key),
 p AS (SELECT top.key, CASE WHEN h.v >= 0.35 * peak AND h.v > 3 * mid THEN h.k ELSE top.k END AS k FROM top LEFT JOIN v h ON h.key = top.key AND h.k = top.k // 2),
 o AS (SELECT p.key, max(v.v) AS rest FROM p JOIN v ON v.key = p.key AND abs(v.k - p.k) > 2 AND abs(v.k - 2 * p.k) > 2 GROUP BY 1)
 SELECT p.key AS series, round({SLOTS} / (p.k + 0.5 * (a.v - c.v) / (a.v - 2 * b.v + c.v)), 4) AS period, round(b.v / (coalesce(rest, 0) + 1e-9), 4) AS strength
 FROM p LEFT JOIN o USING (key) JOIN l a ON a.key = p.key AND a.k = p.k - 1 JOIN l b ON b.key = p.key AND b.k = p.k JOIN l c ON c.key = p.key AND c.k = p.k + 1""")
def event_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant periods of the events of twenty groups of users in slots of three hours, with a square wave of 5 to 24 slots laid over each."""
    e = table(spark, sf_dir, "events")
    slot = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / SLOT)
    counted = e.groupBy((F.col("user_id") % 20).alias("key"), slot.alias("slot")).agg(F.count("*").alias("n"))
    series = counted.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("at"))  # a row a slot
    wave = lambda i: 6.0 * (F.sin(2 * F.pi() * i / (5 + F.col("key"))) > 0.5).cast("int")
    values = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0)) + wave(i))
    return dominant_periods(series.select("key", values.alias("v")), "key", "v").select(F.col("key").alias("series"), F.round("period", 4).alias("period"), F.round("strength", 4).alias("strength"))

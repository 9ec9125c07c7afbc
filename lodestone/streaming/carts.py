"""Carts by line: add, set, remove, clear and place, with limits of lines, pieces, age and number, in batch and kept up batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.ranking import running
from lodestone.plans import versions
from lodestone.plans.scratch import cut, fresh
from lodestone.plans.views import SQL_EVENTS, event_log
from lodestone.registry import query
from lodestone.streaming.events import CART_LINES, LINE_PIECES

#: How long a cart lives untouched, in microseconds, and how many carts are kept before the oldest tenth goes.
CART_AGE, CARTS = 14 * 86_400_000_000, 20_000
ACTIONS = "client bigint, at bigint, event_id bigint, action string, part bigint, quantity bigint, request_id string, confidence double, tier string"
LINES = "client bigint, at bigint, kind string, event_id bigint, place bigint, part bigint, quantity bigint, request_id string, confidence double, tier string"
_NAMES = [c.split()[0] for c in LINES.split(", ")]
_TYPES = [{"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in LINES.split(", ")]


class Cart:
    """One client's cart: lines by part in the order in which they came, [quantity, request_id, confidence, tier]."""

    def __init__(self) -> None:
        self.lines: dict[int, list] = {}
        self.at = 0

    def take(self, action: str, at: int, part: int | None, line: list, max_lines: int, max_age: int) -> tuple[str, dict[int, list]] | None:
        """Does one action; ('order', lines) where it places an order, ('refused', {}) where it can't be done."""
        at = max(at, self.at) if self.lines else at
        if self.lines and at - self.at > max_age:
            self.lines = {}
        if action in ("add", "set"):
            if part is None:
                return "refused", {}
            own = self.lines.get(part)
            if own is None:
                if len(self.lines) >= max_lines:
                    return "refused", {}
                own = self.lines[part] = [min(LINE_PIECES, line[0]), *line[1:]]
            else:
                own[0] = min(LINE_PIECES, line[0] + (own[0] if action == "add" else 0))
                own[1] = own[1] or line[1]
                if line[1] and own[2] is None:
                    own[2:] = line[2:]
            if own[0] <= 0:
                del self.lines[part]
        elif action == "remove":
            self.lines.pop(part, None)
        elif action == "clear":
            self.lines = {}
        elif action == "place" and self.lines:
            placed, self.lines = self.lines, {}
            return "order", placed
        else:
            return "refused", {}
        self.at = at
        return None


def carts_after(held: DataFrame | None, actions: DataFrame, max_lines: int = CART_LINES, max_age: int = CART_AGE) -> DataFrame:
    """The carts (rows of LINES of kind `open`, or None) after actions (rows of ACTIONS) in order of time and event_id.

    Returns open lines, the lines of each order placed (kind `order`, with the event that placed it) and what was refused (kind
    `refused`): a part more than a cart takes, an order of an empty cart, an unknown action, a line without a part. `add` sums,
    `set` replaces, at most 999 pieces; none or fewer take the line out. The first request of a line stays, its confidence and tier
    are filled while there is no confidence. A cart that nothing touched for max_age microseconds is gone at the next action;
    who asks for open carts leaves out those too old by then. An action that is earlier than its cart's last is done at that
    one's time. Null quantities are 1; rows without client or time are left out.

    A client's rows meet in one task sorted, read batch by batch, with one cart in memory: a busy client costs time there, not memory.
    """
    own = actions.where("client is not null and at is not null").select("client", F.lit(1).alias("turn"), "at", "event_id", F.lit(0).cast("bigint").alias("place"), "action", "part", F.coalesce("quantity", F.lit(1)).alias("quantity"), "request_id", "confidence", "tier")
    if held is not None:
        kept = held.where("kind = 'open'").select("client", F.lit(0).alias("turn"), "at", F.lit(None).cast("bigint").alias("event_id"), "place", F.lit("held").alias("action"), "part", "quantity", "request_id", "confidence", "tier")
        own = own.unionByName(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, cart = None, Cart()
        out: list[tuple] = []

        def put(kind: str, event: int | None, at: int, lines: dict[int, list]) -> None:
            out.extend((client, at, kind, event, i, part, *line) for i, (part, line) in enumerate(lines.items()))

        def full() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(_NAMES)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            for who, _, at, event, _, action, part, *line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if who != client:
                    put("open", None, cart.at, cart.lines)
                    client, cart = who, Cart()
                if action == "held":
                    cart.lines[part], cart.at = line, at
                elif (done := cart.take(action, at, part, line, max_lines, max_age)) is not None:
                    kind, lines = done
                    put(kind, event, at, lines if kind == "order" else {part: line})
            yield full()
        put("open", None, cart.at, cart.lines)
        yield full()

    return own.repartition("client").sortWithinPartitions("client", "turn", "at", "event_id", "place").mapInArrow(run, LINES)


def young(lines: DataFrame, now: int | None, max_age: int = CART_AGE, max_carts: int = CARTS) -> DataFrame:
    """Open lines without those of carts untouched for max_age at `now`; above max_carts the tenth of them that was touched longest
    ago goes (of equals, the smallest client). Carts are ranked by ranges, not in one task. Runs jobs while the plan is built."""
    live = cut(lines.where("kind = 'open'").where(F.lit(True) if now is None else F.lit(now) - F.col("at") <= max_age))
    carts = live.groupBy("client").agg(F.max("at").alias("at"))
    n = carts.count()
    if n <= max_carts:
        return live
    ranked = running(carts.select(F.lit(0).alias("all"), F.struct("at", "client").alias("age"), F.lit(1).alias("n")), "all", "age", "n")
    return live.join(ranked.where(F.col("up_to") <= n // 10).select("age.client"), "client", "left_anti")


def keep_carts(batch: DataFrame, number: int, path: str, max_lines: int = CART_LINES, max_age: int = CART_AGE, max_carts: int = CARTS) -> bool:
    """Takes one micro-batch of actions into the carts kept at a path; whether it changed anything. Open carts are written anew, orders and
    refusals appended, and both put in use in one step with the batch's number, so a batch that comes again changes nothing."""
    spark = batch.sparkSession
    after, facts = versions.current(spark, path)
    if number <= facts.get("batch", -1):
        return False
    held = spark.read.schema(LINES).parquet(facts["open"]) if facts else None
    done = cut(carts_after(held, batch, max_lines, max_age))
    latest = batch.agg(F.max("at")).first()[0]
    now = max((x for x in (latest, facts.get("now")) if x is not None), default=None)
    open_, log = versions.new_folder(path), versions.new_folder(path)
    young(done, now, max_age, max_carts).select(*_NAMES).write.parquet(open_)
    done.where("kind <> 'open'").write.parquet(log)
    versions.publish(spark, path, after, {"batch": number, "now": now, "open": open_, "log": [*facts.get("log", []), log]})
    return True


def kept_carts(spark: SparkSession, path: str) -> DataFrame:
    """Open lines, orders and refusals kept at a path."""
    facts = versions.current(spark, path)[1]
    return spark.read.schema(LINES).parquet(facts["open"], *facts["log"])


def cart_stream(actions: DataFrame, path: str, checkpoint: str, **limits: int) -> None:
    """Runs a stream of actions over what is there into the carts kept at a path."""

    def put(batch: DataFrame, number: int) -> None:
        keep_carts(batch, number, path, **limits)

    actions.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_actions(log: DataFrame) -> DataFrame:
    """The event log as actions: clicks and most signups add, views set (a quarter to nothing), errors remove, purchases place, the rest clears."""
    kind, k = F.col("event_type"), F.col("k")
    action = F.when(kind == "click", "add").when(kind == "view", "set").when(kind == "error", "remove").when(kind == "purchase", "place").when(k % 4 == 0, "clear").otherwise("add")
    return log.select(
        F.col("user_id").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", action.alias("action"), "part",
        F.when(kind == "view", k % 4).otherwise(1 + k * 7 % 600).alias("quantity"), F.when(k % 3 > 0, F.col("request_id")).alias("request_id"), "confidence", "tier",
    )


#: The queries' carts live for a day and a half.
DAY_AND_HALF = 129_600_000_000


def _sql(stretches: int) -> str:
    """SQL of the carts after events that come in so many stretches of equal time. At the end of each, above CARTS open carts the tenth of
    them that was touched longest ago goes (of equals, the smallest client): `gone` names them and the stretch."""
    steps = [f"""WITH {SQL_EVENTS}, a AS (SELECT user_id AS client, epoch_us(ts) AS us, event_id, part, confidence, tier, CASE WHEN k % 3 > 0 THEN request_id END AS request_id, CASE WHEN event_type = 'view' THEN k % 4 ELSE 1 + k * 7 % 600 END AS quantity,
  CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'set' WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'place' ELSE CASE WHEN k % 4 = 0 THEN 'clear' ELSE 'add' END END AS action FROM log),
 s AS (SELECT a.*, (us - low) * {stretches} // (high - low + 1) AS stretch FROM a, (SELECT min(us) AS low, max(us) AS high FROM a)),
 b AS (SELECT *, lag(action) OVER w AS was, lag(us) OVER w AS before, lag(stretch) OVER w AS was_in FROM s WINDOW w AS (PARTITION BY client ORDER BY us, event_id)),
 gone0 AS (SELECT CAST(NULL AS BIGINT) AS client, CAST(NULL AS BIGINT) AS stretch WHERE false)"""]
    for i in range(stretches):
        steps.append(f"""
 n{i} AS (SELECT b.*, count(*) FILTER (WHERE was IN ('place', 'clear') OR us - before > {DAY_AND_HALF} OR g.client IS NOT NULL) OVER (PARTITION BY b.client ORDER BY us, event_id) AS cart
  FROM b LEFT JOIN gone{i} g ON g.client = b.client AND g.stretch BETWEEN b.was_in AND b.stretch - 1 WHERE b.stretch <= {i}),
 c{i} AS (SELECT client, cart, max(us) AS touched, max(stretch) AS stretch, max(event_id) FILTER (WHERE action = 'place') AS order_id, bool_or(action = 'clear') AS cleared, cart = max(cart) OVER (PARTITION BY client) AND (SELECT max(us) FROM n{i}) - max(us) <= {DAY_AND_HALF} AS open FROM n{i} GROUP BY client, cart),
 d{i} AS (SELECT *, count(*) FILTER (WHERE action = 'remove' OR (action = 'set' AND quantity = 0)) OVER l AS dropped, count(*) FILTER (WHERE action = 'set') OVER l - CASE WHEN action = 'set' THEN 1 ELSE 0 END AS sets
  FROM n{i} WHERE action IN ('add', 'set', 'remove') WINDOW l AS (PARTITION BY client, cart, part ORDER BY us DESC, event_id DESC)),
 e{i} AS (SELECT *, row_number() OVER (PARTITION BY client, cart, part ORDER BY us, event_id) AS i FROM d{i} WHERE dropped = 0),
 o{i} AS (SELECT c.client, c.cart, c.touched FROM c{i} c SEMI JOIN e{i} USING (client, cart) ANTI JOIN gone{i} g ON g.client = c.client AND g.stretch >= c.stretch WHERE open AND order_id IS NULL AND NOT cleared),
 gone{i + 1} AS (SELECT * FROM gone{i} UNION ALL SELECT client, {i} FROM (SELECT client, row_number() OVER (ORDER BY touched, client) AS place, count(*) OVER () AS n FROM o{i}) WHERE n > {CARTS} AND place <= n // 10)""")
    last = stretches - 1
    return ",".join(steps) + f""",
 f AS (SELECT client, cart, part, least({LINE_PIECES}, sum(quantity) FILTER (WHERE sets = 0)) AS quantity, arg_min(request_id, i) FILTER (WHERE request_id IS NOT NULL) AS request_id,
   arg_min({{'c': confidence, 't': tier}}, i) FILTER (WHERE confidence IS NOT NULL AND (i = 1 OR request_id IS NOT NULL)) AS known, arg_max({{'c': confidence, 't': tier}}, i) FILTER (WHERE i = 1 OR request_id IS NOT NULL) AS unknown FROM e{last} GROUP BY ALL),
 kept AS (SELECT client, cart, order_id FROM c{last} WHERE order_id IS NOT NULL UNION ALL SELECT client, cart, NULL FROM o{last} WHERE client NOT IN (SELECT client FROM gone{stretches} WHERE stretch = {last}))
 SELECT client, order_id, part, CAST(quantity AS BIGINT) AS quantity, request_id, CASE WHEN known IS NULL THEN NULL ELSE known.c END AS confidence, CASE WHEN known IS NULL THEN unknown.t ELSE known.t END AS tier FROM f JOIN kept USING (client, cart)"""


def _shown(lines: DataFrame) -> DataFrame:
    return lines.where("kind in ('open', 'order')").select("client", F.col("event_id").alias("order_id"), "part", "quantity", "request_id", "confidence", "tier")


@query(_sql(1))
def cart_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every order and of the carts that are open after all events (without an order). Of more than CARTS open carts the tenth
    that was touched longest ago is gone."""
    actions = event_actions(event_log(spark, sf_dir))
    done, now = cut(carts_after(None, actions, max_age=DAY_AND_HALF)), actions.agg(F.max("at")).first()[0]
    return _shown(done.where("kind = 'order'").unionByName(young(done, now, DAY_AND_HALF)))


@query(_sql(3))
def cart_orders_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from carts kept up over three stretches of time, of which one comes twice. Carts above CARTS go at the end of each stretch."""
    path, actions = fresh(spark), cut(event_actions(event_log(spark, sf_dir)))
    low, high = actions.agg(F.min("at"), F.max("at")).first()
    third = F.floor((F.col("at") - F.lit(low)) * 3 / F.lit((high or 0) - (low or 0) + 1))
    for number in (0, 1, 1, 2):
        keep_carts(actions.where(third == number), number, path, max_age=DAY_AND_HALF)
    return _shown(kept_carts(spark, path))

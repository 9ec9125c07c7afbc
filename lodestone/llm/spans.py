"""Spans of pattern matches in a text column, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SPANS = "array<struct<start:bigint,end:bigint>>"
#: Matches that one fold handles. A fold copies its list at every step, so a text's matches are folded block by block.
BLOCK = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often nested lambdas name it."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, group: int = 0, around: int = 0) -> Column:
    """array<struct<start, end, hit, before, after>> of the leftmost non-overlapping matches that `keep` accepts: code points
    from 0, end exclusive. `hit` is the match, or its group where one is given; keep gets hit. before and after are up to
    `around` code points next to the match, up to the next match on that side; a word that the far end may cut is left out. The
    pattern must not match the empty string. Where a text has no match only the pattern's search is paid for; the work grows
    with the text and its matches, not with their product."""
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    parts = [whole, F.regexp_extract_all(text, F.lit(pattern), group)] if group else [whole]
    names = ["w", "hit"] if group else ["w"]
    gaps = F.split(text, pattern, -1)
    parts, names = ([*parts, F.slice(F.split(text, pattern, -1), 2, 2**30)], [*names, "next"]) if around else (parts, names)
    rows = F.filter(F.arrays_zip(gaps.alias("gap"), *[p.alias(n) for p, n in zip(parts, names, strict=True)]), lambda x: x["w"].isNotNull())
    first = F.lit(0).cast("bigint")
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>")

    def width(x: Column) -> Column:
        return (F.length(x["gap"]) + F.length(x["w"])).cast("bigint")

    def add(acc: Column, x: Column) -> Column:
        high = acc["at"] + width(x)
        hit = x["hit"] if group else x["w"]
        before = after = F.lit(None).cast("string")
        if around:
            cut_off = lambda gap, side, edge: F.when(F.length(gap) > around, F.regexp_replace(side, edge, "")).otherwise(side)
            before = cut_off(x["gap"], F.right(x["gap"], F.lit(around)), r"^\p{L}+")
            after = cut_off(x["next"], F.left(x["next"], F.lit(around)), r"\p{L}+$")
        span = F.array(F.struct((high - F.length(x["w"])).alias("start"), high.alias("end"), hit.alias("hit"), before.alias("before"), after.alias("after")))
        good = keep(hit) if keep else F.lit(True)
        return F.struct(high.alias("at"), F.when(F.coalesce(good, F.lit(False)), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def starts(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda n, x: n + width(x)))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(sums, F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out")), step, lambda acc: acc["out"])

    def folded(blocks: Column) -> Column:
        return F.flatten(F.zip_with(blocks, starts(blocks), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), add, lambda acc: acc["out"])))

    def blocked(r: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / BLOCK).cast("int")), lambda i: F.slice(r, i * BLOCK + 1, BLOCK))

    found = bound(rows, lambda r: F.when(F.size(r) > 0, bound(blocked(r), folded)).otherwise(none))
    return F.when(text.rlike(pattern), found).otherwise(none)


def labelled(spans: Column, no: int, kind: str) -> Column:
    """array<struct<start, no, end, kind>>, which sorts by start, then by the number of the kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def rendered(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

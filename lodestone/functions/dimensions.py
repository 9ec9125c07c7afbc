"""Dimensional strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import once

#: Screw gauges and their diameters in inches.
GAUGES = {"0": 0.060, "1": 0.073, "2": 0.086, "3": 0.099, "4": 0.112, "5": 0.125, "6": 0.138, "8": 0.164, "10": 0.190, "12": 0.216, "14": 0.242}
MM = 25.4
#: Fixed value: one number: whole and fraction, fraction, or decimal.
NUMBER = r"(\d+)[- ](\d+)/(\d+)|(\d+)/(\d+)|(\d*\.?\d+)"
UNIT = r"(mm|cm|m|in\.?|inch(?:es)?|\"|ft|')"


def length_mm(text: Column) -> Column:
    """Millimetres of the first dimension in a text; null for ranges, for bare numbers and where there is none.

    Metric threads give their diameter, numbered screws that of their gauge, thread sizes in inches their diameter.
    """
    with_unit = rf"(?<![\d./])(?:{NUMBER})\s*{UNIT}"
    gauges = F.create_map(*[F.lit(x) for kv in GAUGES.items() for x in kv])

    def value(x: Column) -> Column:
        g = lambda i: F.regexp_extract(x, with_unit, i).try_cast("double")
        unit = once(F.regexp_extract(x, with_unit, 7), lambda u: F.when(u == "mm", 1.0).when(u == "cm", 10.0).when(u == "m", 1000.0).when(u.isin("ft", "'"), 304.8).when(u != "", MM))
        return F.coalesce(g(1) + g(2) / g(3), g(4) / g(5), g(6)) * unit

    def read(t: Column) -> Column:
        ranged = t.rlike(rf"\d\s*{UNIT}?\s*(to|\s-)\s*\.?\d")
        metric = F.regexp_extract(t, r"^m(\d+(?:\.\d+)?)(?![a-wyz])", 1).try_cast("double")
        gauge = gauges[F.regexp_extract(t, r"^#(\d+)-\d+", 1)]
        return F.when(~ranged, F.round(F.coalesce(metric, gauge * MM, value(t)), 3))

    return once(F.lower(F.trim(text)), lambda t: F.when(F.rlike(t, F.lit(r"\d")), read(t)))


def ratio_score(ratio: Column, low: float, high: float, falloff: float = 1.6) -> Column:
    """1 within [low, high], falling by the log of the excess to -1; -1 for what isn't positive, null for null."""
    excess = F.when(ratio < low, F.log(low / ratio)).otherwise(F.log(ratio / high))
    return F.when(ratio <= 0, -1.0).when(ratio.between(low, high), 1.0).when(ratio.isNotNull(), F.greatest(F.lit(-1.0), 1 - 2 * excess / F.log(F.lit(falloff))))

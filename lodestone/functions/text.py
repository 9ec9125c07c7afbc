"""String functions of the catalog as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out and planned once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def split_path(path: Column) -> Column:
    """`A > B | C` to its trimmed, non-empty steps."""
    return F.filter(F.transform(F.split(F.translate(path, "|", ">"), ">"), lambda x: F.trim(x)), lambda x: x != "")


def split_list(value: Column) -> Column:
    """`a; b` to its trimmed, non-empty items."""
    return F.filter(F.transform(F.split(value, ";"), lambda x: F.trim(x)), lambda x: x != "")


def norm_attr(value: Column) -> Column:
    """Loose equality key of an attribute value: case, quotes, inch words, white space and kinds of dash don't count."""
    v = F.regexp_replace(F.lower(F.trim(value)), "[\"'″”]", "")
    v = F.regexp_replace(v, r"\b(inches|inch|in\.?)(?![a-z])", "")
    return F.regexp_replace(F.regexp_replace(v, "[–—]", "-"), r"\s+", "")


def collapse(value: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def tokens(value: Column) -> Column:
    """Lower-case alphanumeric runs."""
    return F.regexp_extract_all(F.lower(value), F.lit("[0-9a-z]+"), 0)


def part_numbers(value: Column) -> Column:
    """Part numbers in a text, with letter O read as 0 and blanks dropped first, then as written; in order, each once."""
    pattern = F.lit(r"\b(\d{4,5}[A-Z]\d{1,4}[A-Z]?)\b")
    upper = F.upper(value)
    return F.array_distinct(F.concat(F.regexp_extract_all(F.replace(F.replace(upper, F.lit("O"), F.lit("0")), F.lit(" "), F.lit("")), pattern, 1), F.regexp_extract_all(upper, pattern, 1)))


def price(value: Column) -> Column:
    """`$1,234.50` as a number, null where it is none."""
    return F.regexp_replace(value, "[$, ]", "").try_cast("double")


def path_key(path: Column, depth: int, empty: str) -> Column:
    """The first steps of a path joined, with the given key for an empty one."""
    return F.when(F.size(path) > 0, F.array_join(F.slice(path, 1, depth), " > ")).otherwise(F.lit(empty))

"""Secret scans: fixed patterns and a randomness test battery, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import cut
from lodestone.llm.spans import NO_SPANS, bound, labelled, matches, rendered

#: The base patterns. Runs of one class are maximal, so a least length can stand in the pattern; the value of an assignment cannot, as a match that fails is not tried again.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the battery: whole runs of what encodings use. `=` ends a run, so keys and values are apart; it is padding only where nothing of the alphabet follows.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by the first pattern that a whole token fits, with their alphabets in order.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", r"^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", r"^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
BINS = 50


def _above(z: Column) -> Column:
    """Chance of a standard normal value above z: the usual rational approximation, good to 1e-7."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(tokens: DataFrame) -> DataFrame:
    """tokens (token and other columns) -> with encoding, symbols and p: how well a token agrees with independent uniform symbols.

    Three tests, combined by Fisher's method: chi-squared of the symbol counts (Wilson-Hilferty), runs of the upper and the
    lower half of the alphabet, and serial correlation of neighbours. encoding and p are null for tokens without both a
    digit and a letter, those that fit no encoding and those of less than 80 bits.
    """
    body = F.rtrim(F.col("token"), F.lit("="))
    mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z]")
    name, letters = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, pattern, alphabet in reversed(ENCODINGS):
        fits = mixed & body.rlike(pattern) & (F.length(body) * math.log2(len(alphabet)) >= 80)
        name, letters = F.when(fits, F.lit(kind)).otherwise(name), F.when(fits, F.lit(alphabet)).otherwise(letters)
    columns = [F.col(f"`{c}`") for c in tokens.columns]
    own = tokens.select(*columns, body.alias("body"), name.alias("encoding"), letters.alias("letters"))
    chars = F.split("body", "")
    size, n = F.length("letters").cast("double"), F.length("body").cast("double")
    own = own.withColumns({"size": size, "n": n, "y": F.transform(chars, lambda c: F.position(c, F.col("letters")) - (F.length("letters") + 1) / 2), "kinds": F.array_distinct(chars)})
    squares = F.aggregate("kinds", F.lit(0.0), lambda a, c: a + F.pow(F.length("body") - F.length(F.replace(F.col("body"), c, F.lit(""))), F.lit(2.0)))
    start = F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("turns"), F.lit(None).cast("double").alias("last"))
    pairs = F.aggregate("y", start, lambda a, y: F.struct((a["r"] + F.coalesce(a["last"] * y, F.lit(0.0))).alias("r"), (a["turns"] + F.when(a["last"] * y < 0, 1.0).otherwise(0.0)).alias("turns"), y.alias("last")))
    known = F.col("encoding").isNotNull()
    own = own.withColumns({"squares": F.when(known, squares), "pairs": F.when(known, pairs)})
    size, n = F.col("size"), F.col("n")
    df = size - 1
    chi = F.col("squares") * size / n - n
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    z_runs = (F.col("pairs.turns") - (n - 1) / 2) / (F.sqrt(n - 1) / 2)
    z_serial = F.col("pairs.r") / ((size * size - 1) / 12 * F.sqrt(n - 1))
    own = own.withColumn("ps", F.array(_above(z_chi), 2 * _above(F.abs(z_runs)), 2 * _above(F.abs(z_serial))))
    half = F.aggregate("ps", F.lit(0.0), lambda a, p: a - F.log(F.greatest(p, F.lit(1e-300))))
    own = own.withColumn("half", half)
    fisher = F.exp(-F.col("half")) * (1 + F.col("half") + F.col("half") * F.col("half") / 2)
    return own.select(*columns, "encoding", F.col("n").cast("bigint").alias("symbols"), F.when(known, F.least(fisher, F.lit(1.0))).alias("p"))


def thresholds(tokens: DataFrame, rate: float, least: float = 0.02, pseudo: float = 20.0) -> DataFrame:
    """tokens (encoding, length_class, bin), each distinct token once -> (encoding, length_class, least_bin): the first bin
    of p that counts as random there; classes without one are left out.

    Random tokens have uniform p, so within each encoding and length class twice the tokens above one half, with one
    standard error, estimate all random ones. From the lowest bin on (at least `least`), the first is taken at which those
    estimated above it fall short of the tokens above it by a share of at most `rate`: the expected share of false
    discoveries. A class is counted together with `pseudo` tokens spread as its encoding's are, an encoding's with as many
    spread as all tokens are, and all with as many spread evenly, so that a class of few tokens leans on those around it.
    Classes are few, whatever the corpus: 8 encodings by at most 62 lengths, of BINS counts each.
    """
    spread = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.element_at(F.map_from_entries(F.col("bins")), b), F.lit(0)).cast("double"))
    counted = tokens.groupBy("encoding", "length_class", F.col("bin").cast("int").alias("bin")).count()

    def histogram(*by: str) -> DataFrame:
        each = counted.groupBy(*by, "bin").agg(F.sum("count").alias("n"))
        return each.groupBy(*by).agg(F.collect_list(F.struct("bin", "n")).alias("bins")).select(*by, spread.alias("own"))

    def leaning(own: Column, on: Column) -> Column:
        """Counts of own and pseudo more, spread as `on` is."""
        return bound(F.aggregate(on, F.lit(0.0), lambda a, x: a + x), lambda total: F.zip_with(own, on, lambda x, y: x + pseudo * y / total))

    flat = F.array_repeat(F.lit(1.0), BINS)
    every = histogram().select(leaning(F.col("own"), flat).alias("every"))  # one row
    encodings = histogram("encoding").join(F.broadcast(every)).select("encoding", leaning(F.col("own"), F.col("every")).alias("wide"))
    classes = histogram("encoding", "length_class").join(F.broadcast(encodings), "encoding")  # 8 rows
    classes = classes.select("encoding", "length_class", leaning(F.col("own"), F.col("wide")).alias("counts"))
    above = lambda b: F.aggregate(F.slice("counts", b + 1, BINS), F.lit(0.0), lambda a, x: a + x)
    classes = classes.withColumn("random", 2 * (above(F.lit(BINS // 2)) + F.sqrt(above(F.lit(BINS // 2)))))
    good = F.filter(F.sequence(F.lit(math.ceil(least * BINS)), F.lit(BINS - 1)), lambda b: 1 - F.col("random") * (1 - b / BINS) / above(b) <= rate)
    return classes.select("encoding", "length_class", F.array_min(good).alias("least_bin")).where("least_bin is not null")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """One row per document: doc_id, base and spans, each array<struct<start, no, end, kind>> sorted by start, then kind.

    base: assignments, access keys and hex strings by pattern. spans: base and the kind `random`, whole tokens of 20 or more
    symbols that pass the test battery under the false-discovery control of their encoding and length class; also where
    they lie in a base span, whose randomness is then confirmed. Every distinct token is one test, however often it occurs.
    Code points, end exclusive. Null text is empty; empty texts have no spans. Rows that repeat an id are expected to repeat
    its text and share their random spans; rows without id have base spans only. An empty table gives an empty result;
    other columns are ignored. Runs jobs while the plan is built.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        F.concat(
            labelled(matches(text, ASSIGN, lambda v: F.length(v) >= 6, 2), 0, "assign"),
            labelled(matches(text, ACCESS), 1, "access"),
            labelled(matches(text, HEX), 2, "hex"),
        ).alias("base"),
        matches(text, CANDIDATE, lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]")).alias("candidates"),
    )
    found = cut(found)
    each = found.where("doc_id is not null").select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.start", "c.end", F.col("c.hit").alias("token"))
    tested = battery(each.select("token").distinct()).where("encoding is not null")
    tested = tested.withColumns({"length_class": F.floor(2 * F.log2("symbols")), "bin": F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1))})
    tested = cut(tested.select("token", "encoding", "length_class", "bin"))
    least = cut(thresholds(tested, rate))
    random = cut(tested.join(F.broadcast(least), ["encoding", "length_class"]).where("bin >= least_bin").select("token"))  # 8 encodings by at most 62 classes
    random = cut(each.join(random, "token").groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("random")))
    both = found.select("doc_id", "base").join(random, "doc_id", "left")
    random = labelled(F.coalesce("random", F.array().cast(NO_SPANS)), 3, "random")
    return both.select("doc_id", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", random)).alias("spans"))


def digest(found: DataFrame, kinds: tuple[str, ...]) -> list[Column]:
    """Counts of the base kinds, base_sha256 and spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return [*map(count, kinds), F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans")]

"""Full-text search: an inverted index as a table, BM25 over all-terms matches, exact-value promotion, facets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.plans.views import SQL_PARTS, parts, table
from lodestone.registry import query

K1, B = 1.2, 0.75
#: The report's stated queries.
ASKED = ("the of", "der die", "el la", "les")

SQL_POSTINGS = """tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS token FROM documents), post AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY ALL),
lens AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z]+')) AS dl FROM documents)"""
#: The weight of a phrase that df of n documents have.
SQL_IDF = "greatest(1e-6, ln(greatest(1e-6, (n - df + 0.5) / (df + 0.5))))"


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf): how often a document has a token; one aggregate over exploded tokens, combined in each task first."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def phrases(asked: str) -> list[tuple[str, ...]]:
    """The phrases of a query, each once, in order: each of its blank-separated words, as the tokens that stand in it. Double
    quotes don't count; a word without a token is no phrase."""
    words = [tuple(re.findall("[0-9a-z]+", w)) for w in asked.replace('"', " ").lower().split()]
    return list(dict.fromkeys(w for w in words if w))


def idf(n, df):
    """Weight of a phrase: ln((n - df + 0.5) / (df + 0.5)), at least 1e-6."""
    return F.greatest(F.lit(1e-6), F.log(F.greatest(F.lit(1e-6), (n - df + 0.5) / (df + 0.5))))


def weighted(idf_, tf, dl, avgdl):
    """What a phrase adds to a document's score."""
    return idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(docs: DataFrame, key: str, text: str, asked: list[str]) -> DataFrame:
    """(query, key, score) of the documents that have all phrases of a query; negative, lower is better.

    Queries are a stated few: each document's tokens are matched with theirs in the scan, so only hits are shuffled. A phrase of
    several tokens is counted wherever these stand next to each other. Lengths and document frequencies cover all
    documents; one without tokens counts with length 0.
    """
    wanted = {q: ps for q in asked if (ps := phrases(q))}
    every = list(dict.fromkeys(p for ps in wanted.values() for p in ps))
    at = {p: i for i, p in enumerate(every)}
    own = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    own = own.select(key, F.size("t").alias("dl"), *[F.size(F.filter("t", _starts(p))).alias(f"tf_{i}") for p, i in at.items()])
    facts = own.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in at.values()])
    own = own.join(F.broadcast(facts))  # one row
    part = lambda i: weighted(idf(F.col("n"), F.col(f"df_{i}")), F.col(f"tf_{i}"), F.col("dl"), F.col("avgdl"))
    hits = []
    for q, ps in wanted.items():
        score = -sum((part(at[p]) for p in ps[1:]), part(at[ps[0]]))
        hits.append(F.when(F.forall(F.array(*[F.col(f"tf_{at[p]}") > 0 for p in ps]), lambda x: x), F.struct(F.lit(q).alias("query"), score.alias("score"))))
    return own.select(key, F.explode(F.filter(F.array(*hits) if hits else F.array().cast("array<struct<query:string,score:double>>"), lambda h: h.isNotNull())).alias("h")).select("h.query", key, "h.score")


def _starts(phrase: tuple[str, ...]):
    """Whether a phrase starts at a token."""

    def at(x, i):
        out = x == F.lit(phrase[0])
        for k, token in enumerate(phrase[1:], 1):
            out = out & F.coalesce(F.get("t", i + k) == F.lit(token), F.lit(False))
        return out

    return at


_SQL_BM25 = " UNION ALL ".join(
    f"SELECT '{q}' AS query, doc_id, -round(sum({SQL_IDF} * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / avgdl))), 6) AS score FROM s WHERE token IN ({', '.join(repr(t) for t in sorted(set(q.split())))}) GROUP BY doc_id HAVING count(*) = {len(set(q.split()))}"
    for q in ASKED
)


@query(f"""WITH {SQL_POSTINGS}, f AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens), d AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
 s AS (SELECT doc_id, token, tf, dl, df, n, avgdl FROM post JOIN lens USING (doc_id) JOIN d USING (token), f), h AS ({_SQL_BM25})
 SELECT query, doc_id, score FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY score, doc_id) <= 20""")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of each stated query."""
    hits = bm25(table(spark, sf_dir, "documents"), "doc_id", "text", list(ASKED)).withColumn("score", F.round("score", 6))
    return hits.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("score", "doc_id"))).where("r <= 20").drop("r")


@query(f"WITH {SQL_POSTINGS} SELECT token, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS times FROM post GROUP BY token ORDER BY documents DESC, token LIMIT 100")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most common terms of the index."""
    return postings(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("token").agg(F.count("*").alias("documents"), F.sum("tf").alias("times")).orderBy(F.desc("documents"), "token").limit(100)


@query(f"WITH {SQL_PARTS} SELECT part, lpad(CAST(part AS VARCHAR), 6, '0') AS part_number FROM parts WHERE lpad(CAST(part AS VARCHAR), 6, '0') LIKE '0001%' ORDER BY part_number LIMIT 20")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers that start with what was typed, in order."""
    n = F.lpad(F.col("part").cast("string"), 6, "0")
    return parts(spark, sf_dir).select("part", n.alias("part_number")).where(F.col("part_number").startswith("0001")).orderBy("part_number").limit(20)


@query(f"""WITH {SQL_PARTS}, h AS (SELECT part, name, brand, size, -1.0 - (part % 7) / 10.0 AS score, CAST(lower(brand) = 'brand#2' AS INT) + CAST(CAST(size AS VARCHAR) = '10' AS INT) AS n FROM parts WHERE name LIKE '%ring%')
 SELECT part, n, round(score * (1 + 0.25 * n), 6) AS score FROM h ORDER BY 3, part LIMIT 200""")
def promoted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with attribute values that stand in the query as whole words move up by a quarter of their score for each."""
    asked = F.lit(" ring brand#2 10 ")
    n = F.size(F.filter(F.array("brand", F.col("size").cast("string")), lambda v: F.contains(asked, F.concat(F.lit(" "), F.lower(v), F.lit(" "))))).cast("int")
    h = parts(spark, sf_dir).where(F.contains("name", F.lit("ring"))).select("part", n.alias("n"), (-1.0 - F.col("part") % 7 / 10.0).alias("score"))
    return h.select("part", "n", F.round(F.col("score") * (1 + 0.25 * F.col("n")), 6).alias("score")).orderBy("score", "part").limit(200)


@query(f"""WITH {SQL_PARTS}, a AS (SELECT unnest(['kind', 'brand', 'size']) AS key, unnest([kind, brand, CAST(size AS VARCHAR)]) AS value FROM parts WHERE name LIKE '%ring%'), c AS (SELECT key, value, count(*) AS n FROM a GROUP BY ALL)
 SELECT key, value, n FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, value) <= 8""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most frequent values of each attribute among the hits."""
    a = parts(spark, sf_dir).where(F.contains("name", F.lit("ring"))).select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("kind", "brand", "size")])).alias("x"))
    c = a.groupBy("x.key", "x.value").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "value"))).where("r <= 8").drop("r")


@query("SELECT doc_id FROM documents WHERE ' ' || array_to_string(regexp_extract_all(lower(text), '[0-9a-z]+'), ' ') || ' ' LIKE '% of the %'")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which the tokens of a phrase stand next to each other."""
    joined = F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), " "), F.lit(" "))
    return table(spark, sf_dir, "documents").where(F.contains(joined, F.lit(" of the "))).select("doc_id")

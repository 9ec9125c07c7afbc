"""A kept text index with positions: phrase search by merging lists of positions, changes by document, refined facets."""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import tokens
from lodestone.operators import search
from lodestone.operators.search import SQL_IDF, B, K1, idf, phrases, weighted
from lodestone.plans import versions
from lodestone.plans.scratch import cut, fresh
from lodestone.plans.views import SQL_PARTS, parts, table
from lodestone.registry import SQL, query

#: Score of a hit by its number, hits within which exact values are promoted, and hits that facets are made from.
PINNED, PROMOTED, FACETED = -1e9, 200, 60
#: Stated queries of the reports.
ASKED = ("of-the", "the of", '"der-die" und', "un el", "one/2")
PART_ASKED = ("small ring", "brand#2 small", "ring 12", "00012", "brand#1/7", "ring", '"hot gear"', "gear brand#17 28")


def _segment(docs: DataFrame, path: str, buckets: int, files: int) -> tuple[str, int, int]:
    """Writes the tables of (key, number, text): (folder, documents, tokens)."""
    folder = versions.new_folder(path)
    own = docs.withColumn("t", tokens(F.coalesce("text", F.lit("")))).withColumn("dl", F.size("t"))
    _write_postings(own.select("key", "dl", F.explode(_by_bucket("t", F.lit(buckets))).alias("bucket", "posts")), folder, files)
    own.select("key", "number", "dl").sortWithinPartitions("number").write.parquet(f"{folder}/docs")
    facts = docs.sparkSession.read.schema(f"key {docs.schema['key'].dataType.simpleString()}, number string, dl int").parquet(f"{folder}/docs").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return folder, facts[0], facts[1]


@F.udf(T.MapType(T.IntegerType(), T.StringType()))
def _by_bucket(words: list[str], buckets: int) -> dict[int, str]:
    """A document's tokens with their places (`a:0,4 b:1`), by the bucket of the token: one short row a bucket is shuffled, not one a token."""
    places, out = {}, {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(str(i))
    for w, at in places.items():
        out.setdefault(zlib.crc32(w.encode()) % buckets, []).append(f"{w}:{','.join(at)}")
    return {b: " ".join(posts) for b, posts in out.items()}


def _write_postings(packed: DataFrame, folder: str, files: int) -> None:
    """Writes postings of (key, dl, bucket, posts). A bucket's are dealt over `files` tasks or more: large ones are divided further and small ones
    put together, so that what a task sorts fits its memory."""
    post = packed.withColumn("file", F.pmod(F.xxhash64("key"), F.lit(files))).hint("rebalance", "bucket", "file")
    post = post.select("bucket", "key", "dl", F.explode(F.split("posts", " ")).alias("x")).withColumn("x", F.split("x", ":"))
    post = post.select(F.get("x", F.lit(0)).alias("token"), "key", "dl", F.split(F.get("x", F.lit(1)), ",").cast("array<int>").alias("places"), "bucket")
    post.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{folder}/postings")


def _own(docs: DataFrame, key: str, text: str, number: str | None) -> DataFrame:
    """(key, number, text), a row a key: of rows that repeat one the greatest text stays; rows without a key are left out. Texts are
    moved only where keys repeat."""
    n = F.upper(F.col(number).cast("string")) if number else F.lit(None).cast("string")
    own = docs.select(F.col(key).alias("key"), n.alias("number"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("key is not null")
    again = cut(own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    most = own.join(again, "key", "left_semi").groupBy("key").agg(F.max(F.struct("text", "number")).alias("x")).select("key", "x.number", "x.text")
    return own.join(again, "key", "left_anti").unionByName(most)


def write_index(docs: DataFrame, path: str, key: str, text: str, number: str | None = None, buckets: int = 64, files: int = 8) -> None:
    """Writes an index at a path, or puts a new one in place of what is there.

    Postings (token, key, places, dl) lie in folders by a hash of the token, sorted by token; places are the token's
    positions in the document. A common token's postings are dealt over `files` tasks. `docs` keeps each key's number, which
    searches can start with, and length; null and empty texts have no postings but count. Of rows that repeat a key the greatest text
    stays; rows without key are left out.
    """
    spark = docs.sparkSession
    after, _ = versions.current(spark, path)
    folder, n, length = _segment(_own(docs, key, text, number), path, buckets, files)
    versions.publish(spark, path, after, {"segments": [folder], "n": n, "length": length, "buckets": buckets, "files": files, "key_type": docs.schema[key].dataType.simpleString()})


def update_index(spark: SparkSession, path: str, changed: DataFrame, key: str, text: str, number: str | None = None, deleted: DataFrame | None = None) -> None:
    """Puts changed documents in place of those of their keys, adds new ones, and deletes those of `deleted` (a column of the key's name).

    Only what changed is written: its postings, and the keys touched, which hide what older segments say of them. Counts of
    documents and tokens are carried on by what the touched keys had before. Searches see the old state until the new
    version is published, and after a failed write still.
    """
    after, facts = versions.current(spark, path)
    own = _own(changed, key, text, number)
    gone = own.select("key") if deleted is None else own.select("key").union(deleted.select(F.col(key).alias("key")).where("key is not null"))
    touched = cut(gone.distinct())
    before = _live(spark, facts, "docs").join(touched, "key", "left_semi").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    folder, n, length = _segment(own, path, facts["buckets"], facts["files"])
    touched.write.parquet(f"{folder}/touched")
    versions.publish(spark, path, after, facts | {"segments": [*facts["segments"], folder], "n": facts["n"] - before[0] + n, "length": facts["length"] - before[1] + length})


def compact_index(spark: SparkSession, path: str) -> None:
    """Writes what is live as one segment."""
    after, facts = versions.current(spark, path)
    folder = versions.new_folder(path)
    post = _live(spark, facts, "postings")
    _write_postings(post.select("key", "dl", "bucket", F.concat_ws(":", "token", F.array_join(F.col("places").cast("array<string>"), ",")).alias("posts")), folder, facts["files"])
    _live(spark, facts, "docs").sortWithinPartitions("number").write.parquet(f"{folder}/docs")
    versions.publish(spark, path, after, facts | {"segments": [folder]})


def _live(spark: SparkSession, facts: dict, name: str, where=None) -> DataFrame:
    """A table over all segments, without rows whose key a later segment touches. The filter reaches each scan."""
    kind = {"postings": "token string, key {}, dl int, places array<int>, bucket int", "docs": "key {}, number string, dl int"}[name].format(facts["key_type"])
    read = [spark.read.schema(kind).parquet(f"{s}/{name}") for s in facts["segments"]]
    read = [t if where is None else t.where(where) for t in read]
    if len(read) == 1:
        return read[0]
    numbered = reduce(DataFrame.unionByName, [t.withColumn("segment", F.lit(i)) for i, t in enumerate(read)])
    touched = [spark.read.schema(f"key {facts['key_type']}").parquet(f"{s}/touched").withColumn("later", F.lit(i)) for i, s in enumerate(facts["segments"]) if i]
    last = reduce(DataFrame.unionByName, touched).groupBy("key").agg(F.max("later").alias("later"))
    return numbered.join(last.withColumnRenamed("key", "of"), (F.col("key") == F.col("of")) & (F.col("later") > F.col("segment")), "left_anti").drop("segment")


def search_index(spark: SparkSession, path: str, asked: list[str]) -> DataFrame:
    """(query, key, score) like `search.bm25`, from a kept index.

    Only the folders of the queries' tokens are read, and in them only row groups that can hold these tokens. A token's places less
    its place in the phrase say where the phrase would start; a document has the phrase where the lists of all its tokens
    meet. Queries are a stated few, so their tokens are known while the plan is built; what is shuffled is the postings of phrases of
    several tokens, by document.
    """
    _, facts = versions.current(spark, path)
    wanted = {q: ps for q in asked if (ps := phrases(q))}
    rows = [(p, len(p), k, t) for p in dict.fromkeys(p for ps in wanted.values() for p in ps) for k, t in enumerate(p)]
    terms = spark.createDataFrame([(" ".join(p), m, k, t) for p, m, k, t in rows], "phrase string, m int, k int, token string")
    every = sorted({t for *_, t in rows})
    folders = sorted({zlib.crc32(t.encode()) % facts["buckets"] for t in every})
    post = _live(spark, facts, "postings", F.col("bucket").isin(folders) & F.col("token").isin(every))
    met = post.join(F.broadcast(terms), "token").select("phrase", "m", "key", "dl", F.transform("places", lambda x: x - F.col("k")).alias("starts"))  # a row for each stated term
    meeting = F.aggregate(F.slice("lists", 2, F.size("lists")), F.element_at("lists", 1), lambda a, x: F.array_intersect(a, x))
    several = met.where("m > 1").groupBy("phrase", "m", "key", "dl").agg(F.collect_list("starts").alias("lists")).where(F.size("lists") == F.col("m"))
    found = met.where("m = 1").select("phrase", "key", "dl", F.size("starts").alias("tf")).unionByName(several.select("phrase", "key", "dl", F.size(meeting).alias("tf")).where("tf > 0"))
    found = cut(found)
    df = found.groupBy("phrase").agg(F.count("*").alias("df"))
    asks = spark.createDataFrame([(q, " ".join(p), len(ps)) for q, ps in wanted.items() for p in ps], "query string, phrase string, phrases int")
    score = weighted(idf(F.lit(facts["n"]), F.col("df")), F.col("tf"), F.col("dl"), F.lit(facts["length"] / max(facts["n"], 1)))
    hits = found.join(F.broadcast(asks.join(df, "phrase")), "phrase").groupBy("query", "key", "phrases").agg(F.count("*").alias("had"), (-F.sum(score)).alias("score"))
    return hits.where("had = phrases").select("query", "key", "score")


def numbered(spark: SparkSession, path: str, asked: list[str]) -> DataFrame:
    """(query, key, number) of documents whose number starts with a query, whatever the case of letters."""
    _, facts = versions.current(spark, path)
    starts = {q: q.strip().upper() for q in asked if q.strip()}
    hit = lambda s: F.col("number").startswith(s)
    rows = _live(spark, facts, "docs", reduce(lambda a, b: a | b, map(hit, starts.values()), F.lit(False)))
    return rows.select("key", "number", F.explode(F.array_compact(F.array(*[F.when(hit(s), F.lit(q)) for q, s in starts.items()]))).alias("query")) if starts else rows.select("key", "number", F.lit("").alias("query"))


def search_hits(spark: SparkSession, path: str, asked: list[str], values: DataFrame, limit: int = 20) -> DataFrame:
    """(query, key, score, place): the first hits of each query.

    Documents whose number starts with the query come first, in number order, with score PINNED; then those that have all
    its phrases, by score, then key. Among the first max(limit, PROMOTED), a hit's score grows by a quarter for each of its
    attribute values (values: key, values) that stands in the query as a whole word, and they are put in order anew; then the first `limit`
    are taken. Blank queries have no hits.
    """
    pins = numbered(spark, path, asked).select("query", "key", F.lit(PINNED).alias("score"), "number")
    text = search_index(spark, path, asked).select("query", "key", F.round("score", 6).alias("score"))
    text = text.join(pins, ["query", "key"], "left_anti").withColumn("number", F.lit(None).cast("string"))
    first = F.row_number().over(W.partitionBy("query").orderBy("score", "number", "key"))
    kept = pins.unionByName(text).withColumn("before", first).where(F.col("before") <= max(limit, PROMOTED))
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.trim("query")), r"[\t\n]", " "), F.lit(" "))
    lifts = F.size(F.filter("values", lambda v: F.contains(words, F.concat(F.lit(" "), F.lower(v), F.lit(" ")))))
    kept = kept.join(values.select("key", "values"), "key", "left").withColumn("lifts", F.greatest(F.coalesce(lifts, F.lit(0)), F.lit(0)))
    up = F.when(F.col("score") < 0, F.col("score") * (1 + 0.25 * F.col("lifts"))).otherwise(F.col("score") - 0.25 * F.col("lifts"))
    kept = kept.withColumn("score", F.when(F.col("score") <= PINNED, F.col("score")).otherwise(F.round(up, 6)))
    place = F.row_number().over(W.partitionBy("query").orderBy("score", "before")).cast("bigint")
    return kept.withColumn("place", place).where(F.col("place") <= limit).select("query", "key", "score", "place")


def top_tier(hits: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """The first hits of each query whose scores are like the best one's: up to the first that is more than `tolerance` worse. hits:
    query, key, score, place; scores are negative."""
    w = W.partitionBy("query").orderBy("place")
    far = F.col("score") > F.first("score").over(w) * (1 - tolerance)
    return hits.withColumn("far", F.max(far).over(w)).where("not far").drop("far")


def refined(tier: DataFrame, attributes: DataFrame, most: int = 8) -> DataFrame:
    """(query, name, carriers, value, n, name_place, value_place): what a first tier can be narrowed by.

    tier: query, key; attributes: key, name, value. Names that at least half of the tier carry, with two values or more,
    most carried first; of each the `most` commonest values. Ties by name and value.
    """
    sizes = tier.groupBy("query").agg(F.count("*").alias("hits"))
    carried = tier.select("query", "key").join(attributes.where("value is not null"), "key").dropDuplicates(["query", "key", "name"])
    n = carried.groupBy("query", "name", "value").agg(F.count("*").alias("n"))
    names = n.groupBy("query", "name").agg(F.sum("n").alias("carriers"), F.count("*").alias("kinds")).join(sizes, "query").where("kinds >= 2 and 2 * carriers >= hits")
    names = names.withColumn("name_place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("carriers"), "name")))
    out = n.join(names.select("query", "name", "carriers", "name_place"), ["query", "name"])
    out = out.withColumn("value_place", F.row_number().over(W.partitionBy("query", "name").orderBy(F.desc("n"), "value")))
    return out.where(F.col("value_place") <= most).select("query", "name", "carriers", "value", "n", "name_place", "value_place")


def sql_hits(asked: tuple[str, ...], key: str, source: str) -> str:
    """Tables tok, size, found (query, key, score) in SQL: all phrases by joins on neighbouring positions."""
    each = {p: i for i, p in enumerate(dict.fromkeys(p for q in asked for p in phrases(q)))}
    one = lambda p, i: f"SELECT {i} AS p, t0.{key}, count(*) AS tf FROM tok t0" + "".join(f" JOIN tok t{k} ON t{k}.{key} = t0.{key} AND t{k}.at = t0.at + {k} AND t{k}.token = '{t}'" for k, t in enumerate(p) if k) + f" WHERE t0.token = '{p[0]}' GROUP BY ALL"
    asks = ", ".join(f"('{q}', {each[p]}, {len(phrases(q))})" for q in asked for p in phrases(q))
    return f"""tok AS (SELECT {key}, unnest(t) AS token, unnest(range(len(t))) AS at FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z]+') AS t FROM {source}) x),
 size AS (SELECT {key}, len(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z]+')) AS dl FROM {source}), f AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM size), phrase AS ({" UNION ALL ".join(one(p, i) for p, i in each.items())}),
 d AS (SELECT p, count(*) AS df FROM phrase GROUP BY 1), asks(query, p, phrases) AS (VALUES {asks}),
 found AS (SELECT query, {key}, round(-sum({SQL_IDF} * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / avgdl))), 6) AS score FROM asks JOIN phrase USING (p) JOIN d USING (p) JOIN size USING ({key}), f GROUP BY query, {key}, phrases HAVING count(*) = phrases)"""


@query(f"WITH {sql_hits(ASKED, 'doc_id', 'documents')} SELECT query, doc_id, score FROM found")
def indexed_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit of the stated phrases, from a kept index over all documents."""
    path = fresh(spark)
    write_index(table(spark, sf_dir, "documents"), path, "doc_id", "text")
    return search_index(spark, path, list(ASKED)).select("query", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(SQL["bm25_search"])
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of each stated query from a kept index, which is written first."""
    path = fresh(spark)
    write_index(table(spark, sf_dir, "documents"), path, "doc_id", "text")
    hits = search_index(spark, path, list(search.ASKED)).select("query", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
    return hits.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("score", "doc_id"))).where("r <= 20").drop("r")


@query(f"""WITH final AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'the of ' || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3), {sql_hits(ASKED, 'doc_id', 'final')} SELECT query, doc_id, score FROM found""")
def indexed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after changes: two thirds of the documents are indexed, the others added, a fifth changed and a seventh deleted, part of it compacted."""
    path, docs = fresh(spark), table(spark, sf_dir, "documents")
    write_index(docs.where("doc_id % 3 <> 0"), path, "doc_id", "text")
    update_index(spark, path, docs.where("doc_id % 3 = 0"), "doc_id", "text")
    update_index(spark, path, docs.where("doc_id % 5 = 1").withColumn("text", F.concat(F.lit("the of "), "text")), "doc_id", "text")
    compact_index(spark, path)
    update_index(spark, path, docs.where("false"), "doc_id", "text", deleted=docs.where("doc_id % 7 = 3"))
    return search_index(spark, path, list(ASKED)).select("query", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


_SQL_ENTRIES = f"{SQL_PARTS}, entry AS (SELECT part, lpad(CAST(part AS VARCHAR), 6, '0') AS number, name || ' ' || kind || ' ' || brand || ' size ' || size AS text, kind, brand, size FROM parts)"
_SQL_PAGE = f"""{_SQL_ENTRIES}, {sql_hits(PART_ASKED, "part", "entry")}, q(query) AS (VALUES {", ".join(f"('{q}')" for q in PART_ASKED)}),
 pin AS (SELECT query, part, {PINNED} AS score, number FROM q JOIN entry ON starts_with(number, upper(trim(query)))),
 kept AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, number, part) AS before FROM (SELECT * FROM pin UNION ALL SELECT query, part, score, NULL FROM found ANTI JOIN pin USING (query, part)) x QUALIFY before <= {PROMOTED}),
 lifted AS (SELECT query, part, before, CASE WHEN score <= {PINNED} THEN score ELSE round(score * (1 + 0.25 * (contains(' ' || query || ' ', ' ' || lower(brand) || ' ')::INT + contains(' ' || query || ' ', ' ' || lower(kind) || ' ')::INT + contains(' ' || query || ' ', ' ' || size || ' ')::INT)), 6) END AS score FROM kept JOIN entry USING (part)),
 hits AS (SELECT query, part, score, row_number() OVER (PARTITION BY query ORDER BY score, before) AS place FROM lifted)"""


def _part_index(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The catalog's index and (key, name, value) of its attributes."""
    p, path = parts(spark, sf_dir), fresh(spark)
    entries = p.select("part", F.lpad(F.col("part").cast("string"), 6, "0").alias("number"), F.concat_ws(" ", "name", "kind", "brand", F.lit("size"), F.col("size").cast("string")).alias("text"))
    write_index(entries, path, "part", "text", "number", buckets=16)
    named = F.explode(F.create_map(F.lit("kind"), F.col("kind"), F.lit("brand"), F.col("brand"), F.lit("size"), F.col("size").cast("string"))).alias("name", "value")
    return path, p.select(F.col("part").alias("key"), named)


def _page(spark: SparkSession, sf_dir: str, limit: int) -> tuple[DataFrame, DataFrame]:
    path, attributes = _part_index(spark, sf_dir)
    values = attributes.groupBy("key").agg(F.collect_list("value").alias("values"))
    return search_hits(spark, path, list(PART_ASKED), values, limit), attributes


@query(f"WITH {_SQL_PAGE} SELECT query, part, score, place FROM hits WHERE place <= 20")
def catalog_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty hits of each stated query in the catalog: by number, by phrases, exact values promoted."""
    return _page(spark, sf_dir, 20)[0].withColumnRenamed("key", "part")


@query(f"""WITH {_SQL_PAGE}, tier AS (SELECT query, part, max(CAST(score > lead * 0.9 AS INT)) OVER (PARTITION BY query ORDER BY place) AS far FROM (SELECT *, first_value(score) OVER (PARTITION BY query ORDER BY place) AS lead FROM hits WHERE place <= {FACETED}) x WHERE query NOT IN (SELECT query FROM pin)),
 t AS (SELECT query, part FROM tier WHERE far = 0), c AS (SELECT query, part, unnest(['kind', 'brand', 'size']) AS name, unnest([kind, brand, CAST(size AS VARCHAR)]) AS value FROM t JOIN entry USING (part)),
 n AS (SELECT query, name, value, count(*) AS n FROM c WHERE value IS NOT NULL GROUP BY ALL), k AS (SELECT query, name, CAST(sum(n) AS BIGINT) AS carriers FROM n GROUP BY ALL HAVING count(*) >= 2), s AS (SELECT query, count(*) AS hits FROM t GROUP BY 1),
 o AS (SELECT k.*, row_number() OVER (PARTITION BY query ORDER BY carriers DESC, name) AS name_place FROM k JOIN s USING (query) WHERE 2 * carriers >= hits)
 SELECT query, name, carriers, value, n, name_place::INT AS name_place, CAST(row_number() OVER (PARTITION BY query, name ORDER BY n DESC, value) AS INT) AS value_place FROM o JOIN n USING (query, name) QUALIFY value_place <= 8""")
def refined_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first tier of each stated search can be narrowed by; searches that name a number have none."""
    hits, attributes = _page(spark, sf_dir, FACETED)
    hits = cut(hits)
    pinned = hits.where(F.col("score") <= PINNED).select("query").distinct()
    return refined(top_tier(hits.join(pinned, "query", "left_anti")), attributes)

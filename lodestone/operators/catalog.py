"""Catalog operators: normalising, lookups, validation, upserts, taxonomy, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.dimensions import ratio_score
from lodestone.functions.ranking import running
from lodestone.functions.text import norm_attr, path_key, split_path
from lodestone.functions.threads import OD, nearest
from lodestone.plans.views import SQL_PARTS, parts
from lodestone.registry import query


@query(f"""WITH {SQL_PARTS}, r AS (SELECT part, upper(trim('p' || lpad(CAST(part AS VARCHAR), 6, '0'))) AS part_number, kind || ' > ' || brand || ' | ' AS raw FROM parts)
 SELECT part_number, raw, array_to_string(list_filter(list_transform(string_split(translate(raw, '|', '>'), '>'), lambda x: trim(x)), lambda x: x <> ''), '/') AS path FROM r""")
def normalised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers trimmed and in upper case, and path strings split on either separator."""
    p = parts(spark, sf_dir)
    raw = F.concat("kind", F.lit(" > "), "brand", F.lit(" | "))
    number = F.upper(F.trim(F.concat(F.lit("p"), F.lpad(F.col("part").cast("string"), 6, "0"))))
    return p.select(number.alias("part_number"), raw.alias("raw"), F.array_join(split_path(raw), "/").alias("path"))


@query(f"WITH {SQL_PARTS} SELECT part, name, price FROM parts WHERE part IN (7, 11, 13, 17, 999999)")
def get_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup of several keys; the filter reaches the scan."""
    return parts(spark, sf_dir).where(F.col("part").isin(7, 11, 13, 17, 999999)).select("part", "name", "price")


@query(f"WITH {SQL_PARTS} SELECT part, name FROM parts WHERE family = 'small ring' ORDER BY part")
def family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a family."""
    return parts(spark, sf_dir).where("family = 'small ring'").select("part", "name").orderBy("part")


@query(f"WITH {SQL_PARTS} SELECT part, kind, brand FROM parts WHERE path[1:1] = ['ECONOMY'] AND size >= 10 ORDER BY part LIMIT 60 OFFSET 20")
def by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the parts under a path prefix."""
    return parts(spark, sf_dir).where((F.slice("path", 1, 1) == F.array(F.lit("ECONOMY"))) & (F.col("size") >= 10)).select("part", "kind", "brand").orderBy("part").offset(20).limit(60)


@query(f"""WITH {SQL_PARTS}, e AS (SELECT unnest([array_to_string(path[1:1], ' > '), array_to_string(path[1:2], ' > ')]) AS prefix, unnest([1, 2]) AS depth FROM parts)
 SELECT prefix, depth, count(*) AS n FROM e GROUP BY ALL""")
def taxonomy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under every path prefix."""
    e = parts(spark, sf_dir).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda d: F.struct(F.array_join(F.slice("path", 1, d), " > ").alias("prefix"), d.alias("depth")))).alias("x"))
    return e.groupBy("x.prefix", "x.depth").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_PARTS} SELECT DISTINCT kind, brand AS child FROM parts WHERE kind = 'ECONOMY'")
def taxonomy_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names right under a prefix."""
    return parts(spark, sf_dir).where("kind = 'ECONOMY'").select("kind", F.col("brand").alias("child")).distinct()


@query(f"WITH {SQL_PARTS}, p AS (SELECT DISTINCT kind || ' > ' || brand AS prefix, kind AS parent FROM parts UNION SELECT DISTINCT kind, '' FROM parts) SELECT prefix FROM p WHERE prefix NOT IN (SELECT parent FROM p)")
def taxonomy_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes with none below."""
    p = taxonomy_counts(spark, sf_dir).select("prefix", "depth")
    parents = p.where("depth > 1").select(F.regexp_replace("prefix", " > [^>]*$", "").alias("prefix")).distinct()
    return p.select("prefix").join(parents, "prefix", "left_anti")


@query(f"""WITH {SQL_PARTS} SELECT count(*) AS parts, count(*) - count(DISTINCT name) AS duplicate_names, count(DISTINCT family) AS families, count(DISTINCT kind || brand) AS categories,
 count(*) FILTER (WHERE name IS NULL OR name = '') AS without_name, count(*) FILTER (WHERE size > 0) AS with_dimensions, count(*) > 0 AND count(*) = count(DISTINCT part) AS ok FROM parts""")
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data quality of a source in one pass."""
    return parts(spark, sf_dir).agg(
        F.count("*").alias("parts"), (F.count("*") - F.countDistinct("name")).alias("duplicate_names"), F.countDistinct("family").alias("families"),
        F.countDistinct(F.concat("kind", "brand")).alias("categories"), F.count_if(F.col("name").isNull() | (F.col("name") == "")).alias("without_name"),
        F.count_if(F.col("size") > 0).alias("with_dimensions"), ((F.count("*") > 0) & (F.count("*") == F.countDistinct("part"))).alias("ok"),
    )


@query(f"""WITH {SQL_PARTS}, incoming AS (SELECT part, nullif(CASE WHEN part % 2 = 0 THEN name || ' mk2' ELSE '' END, '') AS name, price * 2 AS price, seq FROM parts, (VALUES (1), (2)) s(seq) WHERE part % 3 = 0),
 last AS (SELECT part, name, price + seq AS price FROM incoming WHERE seq = 2)
 SELECT part, coalesce(l.name, p.name) AS name, round(coalesce(l.price, p.price), 2) AS price FROM parts p FULL JOIN last l USING (part)""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge of incoming rows: the last of a key wins, empty fields keep what was there, unknown keys are added."""
    p = parts(spark, sf_dir).select("part", "name", "price")
    incoming = p.where("part % 3 = 0").select("part", F.when(F.col("part") % 2 == 0, F.concat("name", F.lit(" mk2"))).alias("name"), (F.col("price") * 2).alias("price"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    last = incoming.groupBy("part").agg(F.max_by(F.struct("name", (F.col("price") + F.col("seq")).alias("price")), "seq").alias("l"))
    return p.join(last, "part", "full").select("part", F.coalesce("l.name", "name").alias("name"), F.round(F.coalesce("l.price", "price"), 2).alias("price"))


@query(f"WITH {SQL_PARTS}, k AS (SELECT *, family || '|' || brand || '|' || size AS spec FROM parts), f AS (SELECT *, min(part) OVER (PARTITION BY spec) AS first_part FROM k) SELECT part, spec, dense_rank() OVER (ORDER BY first_part) - 1 AS label FROM f")
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense labels of distinct specifications in order of their first part, numbered by ranges."""
    k = parts(spark, sf_dir).select("part", F.concat_ws("|", "family", "brand", F.col("size").cast("string")).alias("spec"))
    first = k.groupBy("spec").agg(F.min("part").alias("first_part")).withColumns({"n": F.lit(1).cast("long"), "all": F.lit(0)})
    ranked = running(first, "all", "first_part", "n").select("spec", (F.col("up_to") - 1).alias("label"))
    return k.join(ranked, "spec").select("part", "spec", "label")


@query(f"""WITH {SQL_PARTS}, h AS (SELECT part, sha1(family) AS d FROM parts), c AS (SELECT part, list_transform([1, 11, 21, 31], lambda i: CAST('0x' || substr(d, i, 10) AS BIGINT)) AS x FROM h)
 SELECT part, (((x[1] % 1000 * 776 + x[2]) % 1000 * 776 + x[3]) % 1000 * 776 + x[4]) % 1000 < 100 AS held_out FROM c""")
def split_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash split by family: the 160-bit digest modulo 1000, ten hex digits at a time (16^10 is 776 modulo 1000)."""
    digest = F.sha1(F.col("family").cast("binary"))
    chunks = F.transform(F.array(*[F.lit(i) for i in (1, 11, 21, 31)]), lambda i: F.conv(F.substr(digest, i, F.lit(10)), 16, 10).cast("bigint"))
    rest = F.aggregate(chunks, F.lit(0).cast("bigint"), lambda a, x: (a * 776 + x) % 1000)
    return parts(spark, sf_dir).select("part", (rest < 100).alias("held_out"))


@query(f"WITH {SQL_PARTS} SELECT part, lower(replace(replace(brand || ' \"' || size || ' in', ' ', ''), '\"', '')) AS ignored, lower(replace(brand, ' ', '')) || size AS key FROM parts")
def attribute_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose keys of attribute values."""
    value = F.concat("brand", F.lit(' "'), F.col("size").cast("string"), F.lit(" in"))
    return parts(spark, sf_dir).select("part", F.lower(F.regexp_replace(value, '[ "]', "")).alias("ignored"), norm_attr(value).alias("key"))


@query(f"WITH {SQL_PARTS} SELECT part, i AS copy FROM parts, LATERAL (SELECT unnest(generate_series(1, greatest(1, size % 4))) AS i) g")
def weighted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows repeated by weight, once at least."""
    return parts(spark, sf_dir).select("part", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1), F.col("size") % 4).cast("bigint"))).alias("copy"))


@query(f"""WITH {SQL_PARTS}, s(size_name, mm) AS (VALUES ('1/16', 7.9375), ('1/8', 10.287), ('1/4', 13.716), ('3/8', 17.145), ('1/2', 21.336), ('3/4', 26.67), ('1', 33.401), ('1-1/4', 42.164), ('1-1/2', 48.26), ('2', 60.325), ('2-1/2', 73.025), ('3', 88.9), ('3-1/2', 101.6), ('4', 114.3), ('5', 141.3002), ('6', 168.275), ('8', 219.075)),
 n AS (SELECT part, size, arg_min(size_name, abs(size * 4.5 - mm) / mm) AS near, min(abs(size * 4.5 - mm) / mm) AS err FROM parts, s GROUP BY ALL)
 SELECT part, CASE WHEN err < 0.12 THEN near END AS pipe, round(CASE WHEN size / 25.4 BETWEEN 0.8 AND 1.25 THEN 1.0 WHEN size / 25.4 < 0.8 THEN greatest(-1, 1 - 2 * ln(0.8 / (size / 25.4)) / ln(1.6)) ELSE greatest(-1, 1 - 2 * ln(size / 25.4 / 1.25) / ln(1.6)) END, 6) AS fit FROM n""")
def pipe_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest nominal pipe of each part's size read as four and a half millimetres each, and how near an inch the size in millimetres is."""
    return parts(spark, sf_dir).select("part", nearest(OD, F.col("size") * 4.5).alias("pipe"), F.round(ratio_score(F.col("size") / 25.4, 0.8, 1.25), 6).alias("fit"))


@query(f"WITH {SQL_PARTS}, c AS (SELECT kind || ' > ' || brand AS category, count(*) AS n FROM parts GROUP BY 1) SELECT category, n, rank() OVER (ORDER BY n DESC, category) AS place FROM c ORDER BY place LIMIT 20")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest categories."""
    c = parts(spark, sf_dir).groupBy(path_key(F.col("path"), 2, "?").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(20)
    return c.withColumn("place", F.rank().over(W.orderBy(F.desc("n"), "category")).cast("bigint"))


@query(f"WITH {SQL_PARTS} SELECT part, name FROM parts WHERE part NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def never_in_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no line orders by fifty or more: rows without a match, as for parts that an index doesn't have yet."""
    bulk = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 50").select(F.col("l_partkey").alias("part"))
    return parts(spark, sf_dir).select("part", "name").join(bulk, "part", "left_anti")


@query(f"WITH {SQL_PARTS} SELECT part, name || ' | ' || kind || ' > ' || brand || ' | brand: ' || brand || ', size: ' || size AS spec FROM parts")
def spec_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as text: name, path and attributes in the order of their keys."""
    attributes = F.map_from_arrays(F.array(F.lit("size"), F.lit("brand")), F.array(F.col("size").cast("string"), F.col("brand")))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat_ws(": ", e["key"], e["value"])), ", ")
    return parts(spark, sf_dir).select("part", F.concat_ws(" | ", "name", path_key(F.col("path"), 2, ""), listed).alias("spec"))

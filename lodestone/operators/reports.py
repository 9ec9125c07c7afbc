"""Reports over several operators, ingest and export over the catalog, and the evaluation of retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.numeric import share
from lodestone.operators.analytics import feedback_stats, funnel, search_funnel, strip_take
from lodestone.operators.answers import learning_state
from lodestone.operators.customers import repeat_customers
from lodestone.operators.printed import FOOTER, printed_files, printed_parts, split_pages
from lodestone.operators.vector import SQL_TOP, gallery_stats, retrieved
from lodestone.plans.scratch import cut
from lodestone.plans.views import SQL_EVENTS, SQL_GALLERY, SQL_PARTS, event_log, gallery, parts
from lodestone.registry import SQL, query
from lodestone.sources.readers import STRING_MAP, ingest, labels, with_photos

#: The one-row reports that `report` lists, in its order.
SECTIONS = {"funnel": funnel, "searches": search_funnel, "strip": strip_take, "feedback": feedback_stats, "customers": repeat_customers, "learning": learning_state, "gallery": gallery_stats}


def listed(row: DataFrame, section: str) -> DataFrame:
    """(section, name, value) of each column of a one-row report; flags are 1 and 0."""
    values = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in row.columns]
    return row.select(F.lit(section).alias("section"), F.inline(F.array(*values)))


@query(" UNION ALL ".join(f"SELECT '{s}' AS section, name, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({SQL[f.__name__]}) q) ON COLUMNS(*) INTO NAME name VALUE value) u" for s, f in SECTIONS.items()))
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of all one-row reports in one long table; those without a value are left out."""
    return reduce(DataFrame.unionByName, [listed(f(spark, sf_dir), s) for s, f in SECTIONS.items()]).where("value is not null")


@query(f"""WITH {SQL_EVENTS}, {SQL_PARTS}, {SQL_GALLERY}, c AS (SELECT count(*) AS parts, count(DISTINCT family) AS families FROM parts), v AS (SELECT count(*) AS vectors FROM gallery), s AS (SELECT max(ts) FILTER (WHERE event_type = 'signup') AS updated, max(ts) FILTER (WHERE event_type = 'purchase') AS built, count(*) FILTER (WHERE event_type = 'signup') AS photos FROM log)
 SELECT parts, families, vectors, photos, coalesce(updated > built, true) AS index_stale FROM c, v, s""")
def catalog_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the catalog and its index, and whether the catalog changed after the index was built (or it never was)."""
    of = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    c = parts(spark, sf_dir).agg(F.count("*").alias("parts"), F.countDistinct("family").alias("families"))
    v = gallery(spark, sf_dir).agg(F.count("*").alias("vectors"))
    s = event_log(spark, sf_dir).agg(F.coalesce(of("signup") > of("purchase"), F.lit(True)).alias("index_stale"), F.count_if(F.col("event_type") == "signup").alias("photos"))
    return c.join(F.broadcast(v)).join(F.broadcast(s)).select("parts", "families", "vectors", "photos", "index_stale")  # one row each


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as catalog records; each has two images, named after vectors, which may not exist."""
    n = F.col("part").cast("string")
    image = lambda k: F.concat((F.col("part") * k).cast("string"), F.lit(".jpg"))
    attributes = F.map_from_arrays(F.array(F.lit("brand"), F.lit("size")), F.array("brand", F.col("size").cast("string")))
    return parts(spark, sf_dir).select(n.alias("part_number"), "name", F.col("path").alias("category_path"), F.lit("").alias("description"), attributes.cast(STRING_MAP).alias("attributes"), F.array(image(1), image(3)).alias("image_paths"), F.col("family").alias("family_id"), F.lit(None).cast("string").alias("url"))


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every third part comes in again, without a name where its number is even; vectors stand for the files that exist."""
    r, third = records(spark, sf_dir), F.col("part_number").cast("bigint") % 3 == 0
    incoming = r.where(third).withColumn("name", F.when(F.col("part_number").cast("bigint") % 2 == 1, F.concat("name", F.lit(" mk2"))))
    files = gallery(spark, sf_dir).select(F.concat(F.col("vec_id").cast("string"), F.lit(".jpg")).alias("path"))
    return ingest(incoming, r, files, merge=True)


_SQL_FILES = f"{SQL_PARTS}, {SQL_GALLERY}, i AS (SELECT *, (part IN (SELECT vec_id FROM gallery))::INT + (part * 3 IN (SELECT vec_id FROM gallery))::INT AS found FROM parts)"


@query(f"WITH {_SQL_FILES} SELECT count(*) AS parts, CAST(coalesce(sum(2 - found), 0) AS BIGINT) AS missing_images, count(*) FILTER (WHERE found = 0) AS without_images, count(*) AS written FROM i WHERE part % 3 = 0")
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an ingest: parts, images that don't exist, parts without any, rows written."""
    return _ingested(spark, sf_dir)[1]


@query(f"WITH {_SQL_FILES} SELECT CAST(part AS VARCHAR) AS part_number, CASE WHEN part % 3 = 0 AND part % 2 = 1 THEN name || ' mk2' ELSE name END AS name, CASE WHEN part % 3 = 0 AND found > 0 THEN found ELSE 2 END AS images FROM i")
def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after an ingest that merges: empty names keep the old one, parts none of whose images exist keep the old ones."""
    return _ingested(spark, sf_dir)[0].select("part_number", "name", F.size("image_paths").alias("images"))


@query(f"""WITH {SQL_EVENTS}, {SQL_PARTS} SELECT x.path, CAST(part AS VARCHAR) AS part_number, family AS family_id, kind || ' > ' || brand AS category, source FROM parts JOIN (SELECT part, part || '.jpg' AS path, 'catalog' AS source FROM parts UNION ALL SELECT part, part * 3 || '.jpg', 'catalog' FROM parts UNION ALL SELECT part, 'photo-' || event_id || '.jpg', 'feedback' FROM log WHERE event_type = 'signup') x USING (part)""")
def export_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the catalog and confirmed photos of known parts with their labels, as an export lists them."""
    photos = event_log(spark, sf_dir).where("event_type = 'signup'").select(F.col("part").cast("string").alias("part_number"), F.concat(F.lit("photo-"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("path"))
    return labels(records(spark, sf_dir), photos)


@query(f"""WITH {SQL_TOP}, r AS (SELECT query_id, query_label, coalesce(min(place) FILTER (WHERE label = query_label), 0) AS rank, coalesce(min(place) FILTER (WHERE label % 4 = query_label % 4), 0) AS family FROM top GROUP BY ALL)
 SELECT query_label, count(*) AS queries, {", ".join(f"round(avg(CAST({c} BETWEEN 1 AND {k} AS INT)), 6) AS {n}recall_{k}" for c, n in (("rank", ""), ("family", "family_")) for k in (1, 5, 10, 50))}, round(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0 END), 6) AS mrr, max(rank) AS worst FROM r GROUP BY ROLLUP (query_label)""")
def retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the right label and of its family among the first 1, 5, 10 and 50, mean reciprocal rank and the worst rank, by label and in all."""
    first = lambda hit: F.coalesce(F.min(F.when(hit, F.col("place"))), F.lit(0))
    same = F.col("label") == F.col("query_label")
    r = retrieved(spark, sf_dir, 50).groupBy("query_id", "query_label").agg(first(same).alias("rank"), first(F.col("label") % 4 == F.col("query_label") % 4).alias("family"))
    recall = [share(F.col(c).between(1, k)).alias(f"{n}recall_{k}") for c, n in (("rank", ""), ("family", "family_")) for k in (1, 5, 10, 50)]
    mrr = F.round(F.avg(F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0)), 6)
    return r.rollup("query_label").agg(F.count("*").alias("queries"), *recall, mrr.alias("mrr"), F.max("rank").alias("worst"))


@query(f"""WITH {SQL_PARTS}, {SQL_GALLERY}, g AS (SELECT vec_id % 40 AS part, vec_id FROM gallery WHERE vec_id % 5 = 0), o AS (SELECT part, [CAST(part AS VARCHAR) || '.jpg', CAST(part * 3 AS VARCHAR) || '.jpg'] AS own FROM parts),
 m AS (SELECT o.part, list_sort(list(DISTINCT CAST(vec_id AS VARCHAR) || '.jpg') FILTER (WHERE NOT list_contains(own, CAST(vec_id AS VARCHAR) || '.jpg'))) AS more FROM o JOIN g USING (part) GROUP BY o.part)
 SELECT CAST(part AS VARCHAR) AS part_number, array_to_string(list_concat(own, coalesce(more, [])), ' ') AS paths FROM o LEFT JOIN m USING (part)""")
def photographed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of every part, with labelled photos of forty of them (every fifth vector stands for one) after its own."""
    v = F.col("vec_id")
    photos = gallery(spark, sf_dir).where(v % 5 == 0).select((v % 40).cast("string").alias("part_number"), F.concat(v.cast("string"), F.lit(".jpg")).alias("path"))
    return with_photos(records(spark, sf_dir), photos).select("part_number", F.array_join("image_paths", " ").alias("paths"))


def page_summary(found: DataFrame) -> DataFrame:
    """(what, name, n) of parts read from pages before they are taken in: parts, families, parts without a size, and parts by section, material
    and size (`?` where a part has none). All counts come from one pass."""
    size, material = (F.coalesce(F.col("attributes")[k], F.lit("?")) for k in ("pipe_size", "material"))
    each = F.array(*[F.struct(F.lit(w).alias("what"), n.alias("name")) for w, n in (("parts", F.lit("")), ("section", F.array_join("path", " > ")), ("material", material), ("size", size), ("family", F.col("family")))])
    counts = found.select(F.explode(each).alias("x")).groupBy("x.what", "x.name").agg(F.count("*").alias("n"))
    families = F.col("what") == "family"
    kept = counts.groupBy(F.when(families, "families").otherwise(F.col("what")).alias("what"), F.when(families, "").otherwise(F.col("name")).alias("name"))
    return kept.agg(F.sum(F.when(~families, F.col("n")).when(F.col("name").isNotNull() & (F.col("name") != ""), 1).otherwise(0)).alias("n"))


@query(f"""WITH p AS ({SQL["printed_catalog"]}), f AS (SELECT path, family, split_part(name, ', ', 1) AS material, replace(split_part(name, ', ', 3), ' pipe size', '') AS size FROM p)
 SELECT 'parts' AS what, '' AS name, count(*) AS n FROM f HAVING count(*) > 0 UNION ALL SELECT 'families', '', count(DISTINCT family) FROM f HAVING count(*) > 0
 UNION ALL SELECT 'section', path, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'material', material, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'size', size, count(*) FROM f GROUP BY 2""")
def printed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the printed catalog would bring in, counted before it is."""
    return page_summary(printed_parts(split_pages(cut(printed_files(spark, sf_dir))), FOOTER))

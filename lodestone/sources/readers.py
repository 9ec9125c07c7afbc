"""Catalog sources: JSON lines, CSV, image and part folders and parquet, normalised to one part schema; ingest and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import split_list, split_path

KNOWN = ("part_number", "name", "category_path", "description", "attributes", "image_paths", "family_id", "url")
#: Other names of known columns.
ALIASES = {"category": "category_path", "images": "image_paths"}
#: Fixed value: image file names that start with a part number.
IMAGE = r"^([0-9]{4,5}[A-Za-z][0-9A-Za-z]{1,5})(?:[_\- ].*)?\.(?:jpe?g|png|webp|tiff?)$"
STRING_MAP = "map<string,string>"
#: Suffixes of image files, and folders that are no parts.
PHOTO = r"(?i)\.(jpe?g|png|webp|tiff?|bmp)$"
NO_PART = r"^([._].*|__MACOSX)$"


def normalise(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, rejected) of loosely typed rows.

    Part numbers are trimmed and in upper case; rows without one are rejected. Unknown columns become attributes, explicit
    attributes win over them, and empty values are dropped. The name falls back to the description, then the number.
    """
    for old, new in ALIASES.items():
        if old in rows.columns and new not in rows.columns:
            rows = rows.withColumnRenamed(old, new)
    types = {f.name: f.dataType for f in rows.schema}
    has = lambda c: F.col(f"`{c}`") if c in types else F.lit(None).cast("string")

    def as_list(c: str, split) -> Column:
        if c in types and types[c].typeName() == "array":
            return F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>"))
        return F.coalesce(split(has(c).cast("string")), F.array().cast("array<string>"))

    if "attributes" in types and types["attributes"].typeName() in ("struct", "map"):
        explicit = F.from_json(F.to_json("attributes"), STRING_MAP)
    else:
        explicit = F.from_json(has("attributes").cast("string"), STRING_MAP)
    extra = [c for c in rows.columns if c not in KNOWN]
    folded = F.map_from_arrays(F.array(*[F.lit(c) for c in extra]), F.array(*[F.col(f"`{c}`").cast("string") for c in extra])) if extra else F.create_map().cast(STRING_MAP)
    full = lambda m: F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))
    explicit = full(F.coalesce(explicit, F.create_map().cast(STRING_MAP)))
    attributes = F.map_concat(explicit, F.map_filter(full(folded), lambda k, v: ~F.map_contains_key(explicit, k)))
    number = F.upper(F.trim(has("part_number").cast("string")))
    empty = lambda c: F.nullif(F.trim(has(c).cast("string")), F.lit(""))
    parts = rows.withColumns({"_number": F.nullif(number, F.lit(""))})
    rejected = parts.where("_number is null").drop("_number")
    parts = parts.where("_number is not null").select(
        F.col("_number").alias("part_number"), F.coalesce(empty("name"), empty("description"), F.col("_number")).alias("name"), as_list("category_path", split_path).alias("category_path"),
        F.coalesce(empty("description"), F.lit("")).alias("description"), attributes.alias("attributes"), as_list("image_paths", split_list).alias("image_paths"), empty("family_id").alias("family_id"), empty("url").alias("url"),
    )
    return parts, rejected


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line; broken lines are dropped."""
    rows = spark.read.option("mode", "DROPMALFORMED").json(path)
    return rows.drop("_corrupt_record") if "_corrupt_record" in rows.columns else rows


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headed UTF-8 with or without a byte-order mark; cells beyond the header are ignored."""
    return spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').option("multiLine", True).csv(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(part_number, image_paths) of files named by part number, in name order; the files themselves aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    number = F.upper(F.regexp_extract(name, IMAGE, 1))
    return files.select(number.alias("part_number"), "path").where("part_number <> ''").groupBy("part_number").agg(F.sort_array(F.collect_list("path")).alias("image_paths"))


def flat_records(spark: SparkSession, root: str) -> DataFrame:
    """(part_number, image_paths, m): photos named by part number with what the root's meta.jsonl says of the part, a map of text.

    Numbers of both sides are compared in upper case; the last line of a number counts, of lines of one number in the order of the
    file. Lines that are no JSON object, or state no part_number, don't count; parts without photos give no row, nor does the
    file's absence change photos. The file is read whole by one task, as lines have no other order.
    """
    images = read_images(spark, root)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "meta.jsonl").load(root)
    lines = found.select(F.posexplode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("no", "line")).select("no", F.from_json("line", STRING_MAP).alias("m"))
    lines = lines.where("m is not null").select(F.upper(F.trim(F.element_at("m", F.lit("part_number")))).alias("part_number"), "no", "m").where("part_number <> ''")
    return images.join(lines.groupBy("part_number").agg(F.max_by("m", "no").alias("m")), "part_number", "left")


def part_files(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name, path, content) of the files in the folders of a root; hidden folders and those that start with _ are left out."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*")
    steps = F.split("path", "/")
    return files.select(F.element_at(steps, -2).alias("folder"), F.element_at(steps, -1).alias("name"), "path", "content").where(~F.col("folder").rlike(NO_PART))


def read_directories(spark: SparkSession, root: str) -> DataFrame:
    """A row for each part folder: its images in name order and what its meta.json says; name and number fall back to the folder's.

    A meta.json that is no JSON object counts as none. Folders without files aren't listed by object stores and give no row. Only
    meta.json files are read. Parts are few files each, so a folder's paths fit a row.
    """
    files = part_files(spark, root)
    images = files.where(F.col("name").rlike(PHOTO)).groupBy("folder").agg(F.sort_array(F.collect_list("path")).alias("image_paths"))
    said = F.from_json(F.decode("content", "UTF-8"), STRING_MAP)
    meta = files.where("name = 'meta.json'").select("folder", said.alias("m"))
    rows = images.join(meta, "folder", "full")
    m = F.coalesce("m", F.create_map().cast(STRING_MAP))
    at = lambda k: F.element_at("m", F.lit(k))
    path = F.coalesce(at("category_path"), at("category"))
    other = F.map_filter("m", lambda k, v: ~k.isin(*KNOWN, *ALIASES) & v.isNotNull())
    explicit = F.coalesce(F.from_json(at("attributes"), STRING_MAP), F.create_map().cast(STRING_MAP))
    return rows.withColumn("m", m).select(
        F.coalesce(at("part_number"), F.col("folder")).alias("part_number"), F.coalesce(at("name"), F.col("folder")).alias("name"), F.coalesce(F.from_json(path, "array<string>"), split_path(path)).alias("category_path"), at("description").alias("description"),
        F.map_concat(explicit, F.map_filter(other, lambda k, v: ~F.map_contains_key(explicit, k))).alias("attributes"), "image_paths", at("family_id").alias("family_id"), at("url").alias("url"),
    )


def labelled_images(spark: SparkSession, root: str) -> DataFrame:
    """(part_number, path) of photos in folders named by part, the number in upper case; the photos themselves aren't read."""
    return part_files(spark, root).where(F.col("name").rlike(PHOTO)).select(F.upper("folder").alias("part_number"), "path")


def with_photos(parts: DataFrame, photos: DataFrame) -> DataFrame:
    """parts with the paths of photos (part_number, path) put after their own images, in order of path; a path the part has already isn't
    put again. Photos of unknown parts are left out, parts without photos stay as they are. A part's paths fit a row."""
    more = photos.where("path is not null").groupBy("part_number").agg(F.array_sort(F.collect_set("path")).alias("more"))
    own = F.coalesce("image_paths", F.array().cast("array<string>"))
    return parts.join(more, "part_number", "left").withColumn("image_paths", F.when(F.col("more").isNull(), F.col("image_paths")).otherwise(F.concat(own, F.array_except("more", own)))).drop("more")


def distinct_photos(spark: SparkSession, photos: DataFrame, root: str) -> DataFrame:
    """photos (part_number, path, position) without copies: of a part's photos of equal content the first by position, then path, stays.

    Files under the root are hashed where they are read, so only paths and digests are shuffled; photos whose file isn't there
    or is empty stay. Paths are as Spark lists them. An empty table gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.sha2("content", 256).alias("digest"))
    own = photos.select("part_number", "path", "position").distinct().join(files, "path", "left")
    first = own.groupBy("part_number", F.coalesce("digest", F.col("path")).alias("content")).agg(F.min(F.struct("position", "path")).alias("p"))
    return first.select("part_number", "p.path", "p.position")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(item) of a list with one item a line; empty lines and those that start with # are left out."""
    return spark.read.text(path).select(F.trim("value").alias("item")).where("item <> '' and not startswith(item, '#')")


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Event lines; broken ones and those without a kind are skipped. Lines are parsed whole, so that which columns are asked for
    doesn't decide what counts as broken."""
    row = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return spark.read.text(path).select(row.alias("e")).select("e.*").where("_corrupt_record is null and kind is not null").drop("_corrupt_record")


def open_source(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(parts, rejected) of a source by the suffix of its path; a folder holds images named by part, or else a folder for each part."""
    if path.endswith((".jsonl", ".json", ".ndjson")):
        return normalise(read_jsonl(spark, path))
    if path.endswith(".csv"):
        return normalise(read_csv(spark, path))
    if path.endswith(".parquet"):
        return normalise(spark.read.parquet(path))
    flat = read_images(spark, path)
    return normalise(read_directories(spark, path) if flat.isEmpty() else flat)


def write_jsonl(parts: DataFrame, path: str) -> None:
    parts.write.mode("overwrite").json(path)


def ingest(incoming: DataFrame, catalog: DataFrame | None = None, files: DataFrame | None = None, strict: bool = False, merge: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the catalog with the incoming parts, one row of counts: parts, missing_images, without_images, written).

    files: (path) of what exists; images not in it are dropped, with strict an error (which runs a job). The last row of a number
    wins. With merge, empty fields keep what the catalog has and attributes are joined; else the part is replaced.
    """
    rows = incoming.select(*KNOWN).withColumn("_row", F.monotonically_increasing_id())
    if files is not None:
        images = rows.select("_row", F.posexplode("image_paths").alias("at", "path"))
        found = images.join(files.select("path").distinct().withColumn("here", F.lit(True)), "path", "left")
        if strict:
            gone = [r.path for r in found.where("here is null").select("path").limit(1).collect()]
            if gone:
                raise FileNotFoundError(gone[0])
        kept = found.groupBy("_row").agg(F.array_sort(F.collect_list(F.when(F.col("here"), F.struct("at", "path")))).alias("kept"), F.count_if(F.col("here").isNull()).alias("missing"))
        rows = rows.join(kept, "_row", "left").withColumn("image_paths", F.coalesce(F.col("kept.path"), F.array().cast("array<string>")))
    else:
        rows = rows.withColumn("missing", F.lit(0))
    counts = rows.agg(F.count("*").alias("parts"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_images"), F.count_if(F.size("image_paths") == 0).alias("without_images"), F.count("*").alias("written"))
    fields = [c for c in KNOWN if c != "part_number"]
    new = rows.groupBy("part_number").agg(F.max_by(F.struct(*fields), "_row").alias("new"))
    if catalog is None:
        return new.select("part_number", "new.*"), counts
    both = catalog.select("part_number", F.struct(*fields).alias("old")).join(new, "part_number", "full")

    def merged(c: str) -> Column:
        n, o = F.col(f"new.{c}"), F.col(f"old.{c}")
        if not merge:
            return F.when(F.col("new").isNotNull(), n).otherwise(o).alias(c)
        if c == "attributes":
            none = F.create_map().cast(STRING_MAP)
            n, o = F.coalesce(n, none), F.coalesce(o, none)
            return F.map_concat(n, F.map_filter(o, lambda k, v: ~F.map_contains_key(n, k))).alias(c)
        return F.coalesce(F.when(F.size(n) > 0, n) if c in ("category_path", "image_paths") else F.nullif(n, F.lit("")), o).alias(c)

    return both.select("part_number", *map(merged, fields)), counts


def labels(parts: DataFrame, photos: DataFrame) -> DataFrame:
    """(path, part_number, family_id, category, source) of catalog images and of confirmed photos (part_number, path) of known parts."""
    facts = parts.select("part_number", "family_id", F.concat_ws(" > ", "category_path").alias("category"))
    images = parts.select("part_number", F.explode("image_paths").alias("path")).withColumn("source", F.lit("catalog"))
    every = images.unionByName(photos.select("part_number", "path").withColumn("source", F.lit("feedback")))
    return every.join(facts, "part_number").select("path", "part_number", "family_id", "category", "source")


def export_dataset(parts: DataFrame, photos: DataFrame, path: str) -> None:
    """Writes labels/ (CSV with a header) and parts/ (JSON lines) for training elsewhere."""
    labels(parts, photos).write.mode("overwrite").option("header", True).csv(f"{path}/labels")
    write_jsonl(parts, f"{path}/parts")

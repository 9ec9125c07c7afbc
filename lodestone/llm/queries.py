"""The registered queries of the operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, media_tiff
from lodestone.llm.divergence import source_divergence
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.minhash import near_dedup
from lodestone.llm.mixing import mix_sources
from lodestone.llm.packing import pack
from lodestone.llm.pieces import encode_pieces
from lodestone.llm.pii import find_personal
from lodestone.llm.runs import periodic_runs
from lodestone.llm.secrets import digest, find_secrets
from lodestone.llm.spans import bound
from lodestone.llm.suffix_dedup import repeated_passages
from lodestone.llm.toxicity import Model, fit, prior_of, score

THRESHOLD = 0.3


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(docs: DataFrame, n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Model:
    """Fitted on what is not held out: rows with crc32(doc_id as text) mod 4 other than 2."""
    known = labels.where(remainder(labels, 4) != 2)
    return fit(docs.where(remainder(docs, 4) != 2), known.where("toxic = 1").select("doc_id"), prior_of(known))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *digest(found, ("assign", "access", "hex")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder(scored, 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *digest(found, ("email", "ip", "card", "phone")))


def packed(docs: DataFrame) -> DataFrame:
    pieces = pack(docs, vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op5_rows(docs: DataFrame) -> DataFrame:
    stored = media_tiff.store_texts(docs)
    stored = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    pages = media_tiff.tiff_pages(stored, "media", ("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    tail = F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32")
    return pages.select("doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), tail, "media_bytes", "media_sha256", "feature", "page", "error")


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_rows(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = vocabulary("piece_bpe_32k.model")
    found = langid.identify(docs, langid.fit(docs.where(remainder(docs, 5) != 0), path), path)
    return found.select("doc_id", F.coalesce(remainder(found, 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), k=3, percent=85)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_pieces(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a tenth of the documents made periodic: with h = crc32(doc_id as text), h % 10 = 0, g = h div 10 and
    n > 0 words, each word i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def periodic(words):
        n = F.size(words).cast("long")
        g = ((h - h % 10) / 10).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i, a, p: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        made = bound(F.struct(words.alias("w"), a.alias("a"), p.alias("p"), n.alias("n")), lambda x: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), x["n"] - 1), lambda i: F.get(x["w"], place(i, x["a"], x["p"]).cast("int"))), " "))
        return F.when(F.size(words) > 0, made).otherwise("")

    text = F.when(h % 10 == 0, bound(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), 0), periodic)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    better = lambda r, best: (r["length"] * best["period"] > best["length"] * r["period"])  # noqa: E731  runs come by start, then period
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    best = F.aggregate("runs", F.lit(None).cast(kind), lambda best, r: F.when(best.isNull() | better(r, best), r).otherwise(best))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


OPERATORS = (op1_secrets, op2_toxicity, op3_personal, op4_packing, op5_tiff, op6_mixing, op7_exact_dedup, op8_passages, op9_langid, op10_minhash, op11_divergence, op12_pieces, op13_runs)
QUERIES = {f.__name__: f for f in OPERATORS}

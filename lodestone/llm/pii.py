"""Personal data: fixed patterns and information-theoretic sanitisation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import cut
from lodestone.llm.spans import labelled, matches

#: The base patterns. Runs of one class are taken whole from where they start, so that a text is passed over once; a match can also start where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Letters that make a term; shorter words tell nothing.
TERM = r"\p{L}{3,}"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _ip(v: Column) -> Column:
    """Each part at most 255, whatever zeros stand before it."""
    return F.forall(F.split(v, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _luhn(v: Column) -> Column:
    digits = F.reverse(F.filter(F.split(_digits(v), ""), lambda c: c != ""))
    value = lambda c, i: F.when(i % 2 == 1, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")).cast("int")
    return F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _card(v: Column) -> Column:
    return F.when(F.length(v) >= 14, F.length(_digits(v)).between(14, 19) & _luhn(v)).otherwise(False)


def _phone(v: Column) -> Column:
    return F.length(_digits(v)).between(10, 15)


def _without_emails(text: Column) -> Column:
    """The text with blanks for each address; no other base span has letters."""
    return F.array_join(F.zip_with(F.split(text, EMAIL, -1), F.regexp_extract_all(text, F.lit(EMAIL), 0), lambda gap, w: F.concat(gap, F.coalesce(F.repeat(F.lit(" "), F.length(w)), F.lit("")))), "")


KINDS = (("email", EMAIL, None), ("ip", IP, _ip), ("card", CARD, _card), ("phone", PHONE, _phone))


#: What stands for an entity's kin: the domain of an address, the network of an ip, the issuer of a card, the area of a phone.
KIN = {"email": lambda v: F.substring_index(v, "@", -1), "ip": lambda v: F.substring_index(v, ".", 2), "card": lambda v: F.substring(v, 1, 6), "phone": lambda v: F.substring(v, 1, 4)}


def disclosure(n_e: Column, n_t: Column, n_et: Column, total: float) -> Column:
    """The share of an entity's information that a term reveals, by documents: PMI over IC with what is sure of P(e | t).

    Information IC(e) = -log2(n(e) / N), PMI(e, t) = log2(P(e | t) * N / n(e)). P(e | t) is not n(e, t) / n(t) but the lower
    end of Wilson's interval of one standard error about it: 1/2 for a term of one document, which holds the entity, 2/3 for two of two,
    6/7 for six of six, and 0.21 for one of two. So a word that stands beside an address and nowhere else tells all but one bit,
    one that is common elsewhere little, and no number of holders is too small to count.
    """
    p = n_et / n_t
    sure = (p + 0.5 / n_t - F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n_t + 0.25 / (n_t * n_t))) / (1 + 1 / n_t)
    return F.log2(F.greatest(sure, F.lit(1e-12)) * total / n_e) / F.greatest(-F.log2(n_e / total), F.lit(1e-9))


def disclosing_terms(near: DataFrame, docs: DataFrame, generalise: float) -> DataFrame:
    """(entity, term, share): terms near an entity that reveal at least `generalise` of its information.

    near: doc_id, entity, around (a hash of the text about it), terms. Documents are counted, over the whole corpus; windows
    of the same text count as one document, so that copies of a passage reveal nothing by being copied.
    """
    total = float(max(docs.count(), 1))
    one = near.groupBy("entity", "around").agg(F.min("doc_id").alias("doc_id"), F.min_by("terms", "doc_id").alias("terms"))
    one = cut(one.select("entity", "doc_id", "terms"))
    holders = one.select("entity", "doc_id").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    met = one.select("entity", "doc_id", F.explode("terms").alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    pairs = cut(met.join(holders, "entity"))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), 0))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    known = pairs.join(words, "term").withColumn("share", disclosure(F.col("n_e"), F.col("n_t"), F.col("n_et"), total))
    return known.where(F.col("share") >= generalise).select("entity", "term", "share")


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 64, generalise: float = 0.75, remove: float = 0.9) -> DataFrame:
    """One row per document: doc_id, base and spans, each array<struct<start, no, end, kind>> sorted by start, then kind.

    base: e-mail addresses, IP addresses, card and phone numbers by pattern and rule. spans: base, and the kinds `generalised`
    and `removed`: terms of three or more letters which, over the whole corpus, reveal the shares `generalise` and `remove`
    of the information of an entity of the document, wherever in its text they stand. An entity is a value, and also its kin
    (the domain of an address, the network of an ip, the issuer of a card, the area of a phone), which recur where values
    don't. Terms are counted with an entity within `window` code points of it, up to the next match of its pattern; a document without base spans has no others.
    Code points, end exclusive. Null text is empty; rows that repeat an id are expected to repeat its text and share their
    terms; rows without id have base spans only. An empty table gives an empty result; other columns are ignored. Runs jobs
    while the plan is built.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = docs.select("doc_id", "text", *[matches(F.col("text"), pattern, keep, around=window).alias(kind) for kind, pattern, keep in KINDS])

    def entity(kind: str) -> Column:
        value = _digits if kind in ("card", "phone") else F.lower
        named = lambda v: F.array(F.xxhash64(F.lit(kind), v), F.xxhash64(F.lit(f"kin of {kind}"), KIN[kind](v)))
        return F.transform(kind, lambda s: F.struct(named(value(s["hit"])).alias("names"), F.concat_ws(" ", s["before"], s["after"]).alias("around")))

    entities = F.concat(*[entity(kind) for kind, _, _ in KINDS])
    found = found.withColumns({"base": F.concat(*[labelled(F.col(kind), i, kind) for i, (kind, _, _) in enumerate(KINDS)]), "entities": entities})
    found = cut(found.select("doc_id", "base", "entities", F.when(F.size("base") > 0, F.col("text")).alias("text")))
    named = found.where("text is not null and doc_id is not null")
    each = named.select("doc_id", F.explode("entities").alias("e"))
    each = each.select("doc_id", F.explode("e.names").alias("entity"), F.xxhash64("e.around").alias("around"), F.array_distinct(F.regexp_extract_all(F.lower("e.around"), F.lit(TERM), 0)).alias("terms"))
    near = cut(each)
    telling = cut(disclosing_terms(near, docs, generalise))
    # Every place of a telling term in the documents that hold its entity.
    places = named.select("doc_id", F.explode(matches(_without_emails(F.col("text")), TERM)).alias("t")).select("doc_id", "t.start", "t.end", F.lower("t.hit").alias("term"))
    told = near.select("doc_id", "entity").distinct().join(telling, "entity").groupBy("doc_id", "term").agg(F.max("share").alias("share"))
    spans = places.join(told, ["doc_id", "term"]).select("doc_id", "start", "end", "share").distinct()
    kind = F.when(F.col("share") >= remove, F.struct(F.lit(5).alias("no"), F.lit("removed").alias("kind"))).otherwise(F.struct(F.lit(4).alias("no"), F.lit("generalised").alias("kind")))
    spans = spans.select("doc_id", F.struct("start", kind["no"].alias("no"), "end", kind["kind"].alias("kind")).alias("s"))
    more = cut(spans.groupBy("doc_id").agg(F.collect_list("s").alias("more")))
    both = found.select("doc_id", "base").join(more, "doc_id", "left")
    return both.select("doc_id", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string>>")))).alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; removed terms leave nothing. Of overlapping spans the later is cut short."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def put(a: Column, s: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        mark = F.when((s["kind"] == "removed") | (s["end"] <= a["at"]), F.lit("")).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], gap, mark).alias("out"))

    done = F.aggregate(F.sort_array(spans), start, put)
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.lit(2**31 - 1)))

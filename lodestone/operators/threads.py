"""Pipe, thread, nut and attribute rules over the catalog's parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import threads as T
from lodestone.functions.dimensions import MM, ratio_score
from lodestone.plans.scratch import dealt
from lodestone.plans.views import SQL_PARTS, parts
from lodestone.registry import query

_values = lambda table: ", ".join(f"('{k}', {float(v)})" for k, v in table.items())
_mm = lambda x: f"CAST(round(CAST(round({x} * {MM}, 6) AS DECIMAL(18, 6)), 2) AS DOUBLE)"
_walls = ", ".join(f"('{s}', '{k}', {v})" for s, w in T.WALL.items() for k, v in w.items())
_fits = ", ".join(f"('{k}', '{' '.join(v) if ' ' not in k else v[0]}', '{' '.join(T.FEMALE_FITS[k]) if ' ' not in k else v[0]}')" for k, v in T.MALE_FITS.items())

#: Sizes as catalogs write them, from each part's key and size.
SQL_STATED = f"""{SQL_PARTS}, raw AS (SELECT part, size, name, CASE part % 5 WHEN 0 THEN (size % 4) || '-' || (part % 16) || '/16"' WHEN 1 THEN (size % 4) || ' ' || (part % 16) || '/16 NPT' WHEN 2 THEN 'Pipe size ' || (size % 9) WHEN 3 THEN (part % 16) || '/16 in' ELSE 'BSPT ' || (1 + size % 3) || '/8' END AS stated FROM parts),
cleaned AS (SELECT *, trim(regexp_replace(lower(trim(stated)), '\\s*\\b(pipe|size|thread|nptf|npt|bspt|bspp)\\b\\s*', ' ', 'g'), ' .') AS t FROM raw),
split AS (SELECT *, regexp_extract(t, '^(\\d+)?\\s*[- ]?\\s*(\\d+/\\d+)?\\s*(?:"|inch|inches|in)?$', 1) AS whole, regexp_extract(t, '^(\\d+)?\\s*[- ]?\\s*(\\d+/\\d+)?\\s*(?:"|inch|inches|in)?$', 2) AS frac FROM cleaned),
num AS (SELECT *, TRY_CAST(split_part(frac, '/', 1) AS INT) * 16 // TRY_CAST(nullif(split_part(frac, '/', 2), '') AS INT) AS k FROM split),
keyed AS (SELECT *, gcd(k, 16) AS g FROM num), known(key, od) AS (VALUES {_values(T.OD)}, ('5/8', 0)),
sized AS (SELECT part, size, stated, known.key FROM keyed LEFT JOIN known ON known.key = CASE WHEN frac = '' THEN whole WHEN k BETWEEN 1 AND 15 THEN CASE WHEN whole = '' THEN '' ELSE whole || '-' END || (k // g) || '/' || (16 // g) END)"""


#: Parts of a task that reads what they state: a part is few bytes for the work that it makes, so a file's parts are dealt over tasks.
PARTS = 50_000


def stated_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts with the size as a catalog writes it."""
    whole, k = (F.col("size") % 4).cast("string"), (F.col("part") % 16).cast("string")
    forms = [F.concat(whole, F.lit("-"), k, F.lit('/16"')), F.concat(whole, F.lit(" "), k, F.lit("/16 NPT")), F.concat(F.lit("Pipe size "), (F.col("size") % 9).cast("string")), F.concat(k, F.lit("/16 in"))]
    other = F.concat(F.lit("BSPT "), (1 + F.col("size") % 3).cast("string"), F.lit("/8"))
    stated = F.coalesce(*[F.when(F.col("part") % 5 == i, f) for i, f in enumerate(forms)], other)
    return dealt(parts(spark, sf_dir), PARTS, "part").withColumn("stated", stated)


@query(f"""WITH {SQL_STATED}, od(key, v) AS (VALUES {_values(T.OD)}), bore(key, v) AS (VALUES {_values(T.BORE)}), wall(s, key, v) AS (VALUES {_walls}), female(key, v) AS (VALUES {_values(T.FEMALE)})
 SELECT part, stated, s.key AS pipe, {_mm('od.v')} AS od_mm, {_mm('coalesce(od.v - 2 * wall.v, CASE WHEN od.v IS NOT NULL THEN bore.v END)')} AS bore_mm, {_mm('female.v')} AS female_mm
 FROM sized s LEFT JOIN od USING (key) LEFT JOIN bore USING (key) LEFT JOIN female USING (key) LEFT JOIN wall ON wall.key = s.key AND wall.s = CASE part % 4 WHEN 0 THEN '10' WHEN 1 THEN '40' WHEN 2 THEN '80' ELSE '40' END""")
def pipe_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominal pipe size of a stated one, with its outside diameter, its bore by schedule (40 where none is stated) and that of its female thread."""
    key, schedule = F.col("pipe"), F.when(F.col("part") % 4 == 0, "10").when(F.col("part") % 4 == 1, "40").when(F.col("part") % 4 == 2, "80")
    s = stated_sizes(spark, sf_dir).withColumn("pipe", T.pipe_size(F.col("stated")))
    return s.select("part", "stated", "pipe", T.outside_mm(key).alias("od_mm"), T.bore_mm(key, schedule, F.lit(None).cast("double")).alias("bore_mm"), T.female_mm(key).alias("female_mm"))


@query(f"""WITH {SQL_PARTS}, bore(key, v) AS (VALUES {_values(T.BORE)}), n AS (SELECT part, arg_min(key, abs(size / (v * {MM}) - 1)) AS key, min(abs(size / (v * {MM}) - 1)) AS e FROM parts, bore GROUP BY part)
 SELECT part, CASE WHEN e < 0.12 THEN key END AS pipe FROM n""")
def pipe_of_bore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominal pipe whose schedule-40 bore is nearest to each part's size in millimetres."""
    return parts(spark, sf_dir).select("part", T.nearest(T.BORE, F.col("size")).alias("pipe"))


@query(f"""WITH {SQL_STATED}, npt(key, v) AS (VALUES {_values(T.NPT)}), bsp(key, v) AS (VALUES {_values(T.BSP)}), m AS (SELECT part, key, 8 + part % 21 AS per_inch FROM sized)
 SELECT part, key AS pipe, per_inch, concat_ws(' ', CASE WHEN abs(per_inch - npt.v) / npt.v < 0.025 THEN 'NPT' END, CASE WHEN abs(per_inch - bsp.v) / bsp.v < 0.025 THEN 'BSP' END) AS families FROM m LEFT JOIN npt USING (key) LEFT JOIN bsp USING (key)""")
def thread_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pipe threads have a measured pitch at a stated size."""
    s = stated_sizes(spark, sf_dir).select("part", T.pipe_size(F.col("stated")).alias("pipe"), (8 + F.col("part") % 21).alias("per_inch"))
    return s.withColumn("families", F.array_join(F.coalesce(T.families(F.col("pipe"), F.col("per_inch")), F.array()), " "))


_KINDS = ["npt ", "NPTF", "bspt", "BSPP", "NPSM", "NPSL", "GHT", "NH/NST", "acme"]
_WALLS = ["Sch. 80 pipe", "Schedule 40", "thin-wall tube", "Thick wall", "standard-wall", "sch 5", "extra-heavy"]


@query(f"""WITH {SQL_PARTS}, k AS (SELECT part, {_KINDS!r}[CAST(part % {len(_KINDS)} AS INT) + 1] AS kind, CASE WHEN size % 2 = 0 THEN 'Male' ELSE 'female' END AS gender, {_WALLS!r}[CAST(part % {len(_WALLS)} AS INT) + 1] AS wall FROM parts), f(kind, male, female) AS (VALUES {_fits})
 SELECT part, k.kind, gender, coalesce(CASE gender WHEN 'Male' THEN f.male ELSE f.female END, '') AS fits, CASE WHEN f.kind IN {T.TAPERED} THEN true WHEN f.kind IS NOT NULL THEN false END AS tapered,
 CASE wall WHEN 'Sch. 80 pipe' THEN '80' WHEN 'Schedule 40' THEN '40' WHEN 'thin-wall tube' THEN '10' WHEN 'Thick wall' THEN '80' WHEN 'standard-wall' THEN '40' WHEN 'extra-heavy' THEN '80' END AS schedule FROM k LEFT JOIN f ON f.kind = upper(trim(k.kind))""")
def thread_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part's thread mates with, whether it is tapered, and the wall schedule that a text states."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("part") % len(names) + 1).cast("int"))
    k = parts(spark, sf_dir).select("part", pick(_KINDS).alias("kind"), F.when(F.col("size") % 2 == 0, "Male").otherwise("female").alias("gender"), pick(_WALLS).alias("wall"))
    return k.select("part", "kind", "gender", F.array_join(T.fits(F.col("kind"), F.col("gender")), " ").alias("fits"), T.tapered(F.col("kind")).alias("tapered"), T.schedule(F.col("wall")).alias("schedule"))


_NUTS = ["hex nut", "nut driver", "Lock nuts", "T-nut", "walnut knob", "Wingnut, steel", "bolt"]
_nut_values = ", ".join(f"({k * MM}, {v * MM})" for k, v in T.NUT_IN.items()) + ", " + ", ".join(f"({k}, {v})" for k, v in T.NUT_MM.items())


@query(f"""WITH {SQL_PARTS}, w(d, width) AS (VALUES {_nut_values}), m AS (SELECT part, size, arg_min(width, abs(size - d) / d) AS width, min(abs(size - d) / d) AS e FROM parts, w GROUP BY ALL)
 SELECT part, 'M' || size || ' x 1.25' AS thread, round(CASE WHEN e <= 0.04 THEN width ELSE 1.6 * size END, 6) AS width_mm, part % {len(_NUTS)} IN (0, 2, 5) AS nut, 1.25 AS pitch_mm FROM m""")
def nut_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width across flats and pitch of each part's size read as a metric thread, and whether a name is a nut's."""
    thread = F.concat(F.lit("M"), F.col("size").cast("string"), F.lit(" x 1.25"))
    name = F.element_at(F.array(*map(F.lit, _NUTS)), (F.col("part") % len(_NUTS) + 1).cast("int"))
    return parts(spark, sf_dir).select("part", thread.alias("thread"), F.round(T.nut_width_mm(thread), 6).alias("width_mm"), T.is_nut(name).alias("nut"), T.pitch_mm(thread).alias("pitch_mm"))


#: Attributes of stated parts, and by hand in SQL below the pitches in millimetres that they imply; -p: that of a pipe thread.
_PITCHED = [{"thread_size": "M6 x 1"}, {"thread": 'M8-1.25'}, {"thread_size": '1/4"-20'}, {"thread size": "#8-32 x 1/2"}, {"tpi": "18 per inch"}, {"pitch": "1.5 mm"}, {"pitch": "13 tpi"}, {"pipe_size": "1/2", "type": "NPT"}, {"pipe_size": "1 1/4", "type": "BSPP"}, {"thread_size": "3/8", "type": "NPT"}, {"thread_size": "3/8"}, {"thread_size": "M6-20"}, {"thread": "1-1/4-11"}]
_SQL_PITCHES = "['1', '1.25', '1.27', '0.79375', '1.4111111111', '1.5', '1.9538461538', '1.8142857143p', '2.3090909091p', '1.4111111111p', NULL, NULL, '2.3090909091']"


@query(f"""WITH {SQL_PARTS}, m AS (SELECT part, {_SQL_PITCHES}[part % {len(_PITCHED)} + 1] AS stated, 0.7 + size / 20.0 AS measured FROM parts), r AS (SELECT part, measured / CAST(rtrim(stated, 'p') AS DOUBLE) AS ratio, stated LIKE '%p' AS pipe FROM m),
 b AS (SELECT *, CASE WHEN pipe THEN 0.985 ELSE 0.93 END AS low, CASE WHEN pipe THEN 1.015 ELSE 1.07 END AS high, CASE WHEN pipe THEN 1.06 ELSE 1.3 END AS falloff FROM r)
 SELECT part, pipe, round(CASE WHEN ratio IS NULL THEN NULL WHEN ratio BETWEEN low AND high THEN 1.0 WHEN ratio < low THEN greatest(-1, 1 - 2 * ln(low / ratio) / ln(falloff)) ELSE greatest(-1, 1 - 2 * ln(ratio / high) / ln(falloff)) END, 6) AS vote FROM b""")
def pitch_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a pitch measured from a part's size agrees with the one that its attributes state: by thread, threads per inch, pitch or pipe."""
    stated = F.element_at(F.array(*[F.create_map(*[F.lit(x) for kv in a.items() for x in kv]) for a in _PITCHED]), (F.col("part") % len(_PITCHED) + 1).cast("int"))
    p = parts(spark, sf_dir).select("part", T.catalog_pitch(stated, F.lit("Fitting")).alias("stated"), (0.7 + F.col("size") / 20.0).alias("measured"))
    return p.select("part", F.col("stated")["pipe"].alias("pipe"), F.round(T.pitch_vote(F.col("measured"), F.col("stated")), 6).alias("vote"))


_GUESSES = ["Stainless steel", "zinc plated", "brass", "Plastic", "", "ring metal"]
_CATALOG = ["304 stainless", "alloy steel", "nylon", "brass"]


@query(f"""WITH {SQL_PARTS}, m AS (SELECT part, brand, kind || ' ' || brand || ' ' || name AS entry, {_GUESSES!r}[CAST(part % 6 AS INT) + 1] AS guess, {_CATALOG!r}[CAST(size % 4 AS INT) + 1] AS material FROM parts),
 v AS (SELECT part, CASE guess WHEN 'Stainless steel' THEN CASE WHEN material = '304 stainless' THEN 1.0 ELSE -1.0 END WHEN 'zinc plated' THEN CASE WHEN material = 'alloy steel' THEN 1.0 ELSE -1.0 END WHEN 'brass' THEN CASE WHEN material = 'brass' THEN 1.0 ELSE -1.0 END WHEN 'Plastic' THEN CASE WHEN material = 'nylon' THEN 1.0 ELSE -1.0 END END AS a,
  CASE WHEN contains(lower(entry), 'ring') THEN 1.0 ELSE -0.5 END AS b, CASE WHEN contains(lower(entry), 'brand#2') THEN 1.0 END AS c, CASE WHEN CAST(part AS VARCHAR) LIKE '%111%' THEN 1.0 END AS d FROM m)
 SELECT part, round((coalesce(a, 0) + b + coalesce(c, 0) + coalesce(d, 0)) / (1 + (a IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT), 6) AS vote FROM v""")
def attribute_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vote of what a photo shows for each part: material, type, and texts read on it."""
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    p = parts(spark, sf_dir)
    vote = T.attribute_votes(F.concat_ws(" ", "kind", "brand", "name"), F.col("part").cast("string"), pick(_CATALOG, "size"), pick(_GUESSES, "part"), F.array(F.lit("a ring"), F.lit("")), F.array(F.lit("Brand#2"), F.lit("no"), F.lit("111")))
    return p.select("part", F.round(vote, 6).alias("vote"))


@query(f"""WITH {SQL_PARTS} SELECT part, kind || ' :: ' || name AS family_key, array_to_string(list_filter(string_split(name, ' '), lambda w: len(w) > 2)[-3:], ' ') AS words FROM parts""")
def family_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of look-alikes: a name that states sizes, threads and a count falls together with the bare one; and the last three words of a name as a search."""
    name = F.concat(F.col("size").cast("string"), F.lit('" x '), F.col("name"), F.lit(", M6 (3/8 NPT) #"), F.col("part").cast("string"))
    words = F.filter(F.regexp_extract_all("name", F.lit("[A-Za-z][A-Za-z-]+"), 0), lambda w: F.length(w) > 2)
    last = F.when(F.size(words) > 3, F.slice(words, -3, 3)).otherwise(words)
    return parts(spark, sf_dir).select("part", T.family_key(F.array("kind"), name).alias("family_key"), F.array_join(last, " ").alias("words"))


_round = lambda inches: round(inches * MM + 1e-9, 2)
_PIPE, _FEMALE, _BORE80 = _round(T.OD["1/2"]), _round(T.FEMALE["1/2"]), _round(T.OD["1/2"] - 2 * T.WALL["80"]["1/2"])
_NUT8 = T.NUT_MM[8.0]
_sql_score = lambda r, low, high, falloff: f"CASE WHEN {r} <= 0 THEN -1.0 WHEN {r} BETWEEN {low} AND {high} THEN 1.0 ELSE greatest(-1.0, 1 - 2 * (CASE WHEN {r} < {low} THEN ln({low} / ({r})) ELSE ln(({r}) / {high}) END) / ln({falloff})) END"
_sql_body = lambda low, high: f"CASE WHEN short / {_PIPE} < {low} THEN {_sql_score(f'short / {_PIPE}', low, high, 1.25)} ELSE {_sql_score(f'short / {_PIPE}', low, high, 1.4)} END"


@query(f"""WITH {SQL_PARTS}, m AS (SELECT part, part % 6 AS form, 5.0 + size AS stated, 4.0 + part % 30 AS long, 3.0 + part % 19 AS short, 8.0 + part % 17 AS bore FROM parts),
 v AS (SELECT part, CASE WHEN form < 2 THEN {_sql_score('long / stated', 0.85, 1.4, 1.6)} END AS a, CASE form WHEN 1 THEN {_sql_score('short / 9.0', 0.85, 1.15, 1.35)} WHEN 2 THEN {_sql_score('long / 9.0', 0.85, 1.15, 1.35)} END AS b,
  CASE WHEN form = 3 THEN CASE WHEN long < 1.5 * short THEN {_sql_score(f'short / {_NUT8}', 0.85, 1.15, 1.3)} ELSE {_sql_score(f'long / 1.08 / {_NUT8}', 0.85, 1.15, 1.3)} END END AS c,
  CASE form WHEN 4 THEN {_sql_body(1.1, 1.6)} WHEN 5 THEN {_sql_body(0.9, 1.5)} END AS d, CASE form WHEN 4 THEN {_sql_score(f'bore / {_FEMALE}', 0.85, 1.15, 1.3)} WHEN 5 THEN {_sql_score(f'bore / {_BORE80}', 0.85, 1.15, 1.3)} END AS e FROM m)
 SELECT part, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0) + coalesce(e, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 1 END + CASE WHEN d IS NULL THEN 0 ELSE 1 END + CASE WHEN e IS NULL THEN 0 ELSE 1 END), 5) AS vote,
  concat_ws(' ', CASE WHEN a IS NOT NULL THEN 'length' END, CASE WHEN b IS NOT NULL THEN 'width' END, CASE WHEN c IS NOT NULL THEN 'nut' END, CASE WHEN d IS NOT NULL THEN 'pipe' END, CASE WHEN e IS NOT NULL THEN 'bore' END) AS votes FROM v""")
def measured_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How measured sides and a bore agree with the length, width, thread or pipe that each part states."""
    form, number = F.col("part") % 6, lambda c, low, n: (low + F.col(c) % n).cast("double")
    entry = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    length = F.concat((5 + F.col("size")).cast("string"), F.lit(" mm"))
    attributes = F.when(form == 0, entry("Length", length)).when(form == 1, entry("Overall-Length", length, "OD", "9 mm")).when(form == 2, entry("Outside Diameter", "9 mm")).when(form == 3, entry("Thread Size", "M8 x 1.25"))
    attributes = attributes.when(form == 4, entry("Pipe Size", "1/2", "Gender", "Female")).otherwise(entry("pipe", "1/2 NPT", "gender", "male", "schedule", "80"))
    p = dealt(parts(spark, sf_dir).select("part", "size"), PARTS, "part")
    p = p.select("part", attributes.alias("attributes"), F.when(form == 3, "hex nut").otherwise("fitting").alias("name"), number("part", 4, 30).alias("long"), number("part", 3, 19).alias("short"), number("part", 8, 17).alias("bore"))
    p = T.size_votes(p.withColumn("pitch", F.lit(None)))
    return p.select("part", F.round(T.size_score(F.col("votes")), 5).alias("vote"), F.array_join("votes.what", " ").alias("votes"))


@query(f"""WITH {SQL_STATED}, od(key, v) AS (VALUES {_values(T.OD)}), bore(key, v) AS (VALUES {_values(T.BORE)}), wall(s, key, v) AS (VALUES {_walls}), female(key, v) AS (VALUES {_values(T.FEMALE)}), npt(key, v) AS (VALUES {_values(T.NPT)}), bsp(key, v) AS (VALUES {_values(T.BSP)}),
 f AS (SELECT part, {_mm('od.v')} AS od, {_mm('coalesce(od.v - 2 * w40.v, CASE WHEN od.v IS NOT NULL THEN bore.v END)')} AS id, {_mm('female.v')} AS fb, CASE WHEN part % 3 = 0 THEN {_mm('coalesce(od.v - 2 * w80.v, CASE WHEN od.v IS NOT NULL THEN bore.v END)')} END AS wb, npt.v AS n, bsp.v AS b, contains(stated, 'NPT') AS is_npt, contains(stated, 'BSPT') AS is_bspt
  FROM sized s LEFT JOIN od USING (key) LEFT JOIN bore USING (key) LEFT JOIN female USING (key) LEFT JOIN npt USING (key) LEFT JOIN bsp USING (key) LEFT JOIN wall w40 ON w40.key = s.key AND w40.s = '40' LEFT JOIN wall w80 ON w80.key = s.key AND w80.s = '80')
 SELECT * FROM (SELECT part, unnest(['pipe OD', 'pipe ID', 'female bore', 'bore of the wall', 'NPT per inch', 'BSP per inch', 'male fits', 'female fits']) AS fact, unnest([CAST(od AS VARCHAR), CAST(id AS VARCHAR), CAST(fb AS VARCHAR), CAST(wb AS VARCHAR), CAST(CAST(n AS DOUBLE) AS VARCHAR), CAST(CAST(b AS DOUBLE) AS VARCHAR),
  CASE WHEN is_npt THEN '{", ".join(T.MALE_FITS["NPT"])}' WHEN is_bspt THEN '{", ".join(T.MALE_FITS["BSPT"])}' END, CASE WHEN is_npt THEN '{", ".join(T.FEMALE_FITS["NPT"])}' WHEN is_bspt THEN '{", ".join(T.FEMALE_FITS["BSPT"])}' END]) AS value FROM f) x WHERE value IS NOT NULL""")
def fitting_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a part's page says about its nominal pipe size and thread; every third part states schedule 80."""
    s = stated_sizes(spark, sf_dir)
    text = F.concat_ws(" ", "stated", F.when(F.col("part") % 3 == 0, "schedule 80"))
    return s.select("part", F.inline(T.part_facts(T.pipe_size(F.col("stated")), text, F.lit(None).cast("double"))))

"""Scalar functions and sources on small cases."""

import json
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import dimensions, text, threads
from lodestone.functions.numeric import percentiles
from lodestone.operators import search
from lodestone.operators.answers import answer
from lodestone.operators.fusion import rerank_within_tiers
from lodestone.operators.pages import enriched, page_parts, parse_product
from lodestone.sources import readers

UNITS = {"mm": 1, "cm": 10, "in": Fraction("25.4"), '"': Fraction("25.4"), "inches": Fraction("25.4"), "ft": Fraction("304.8")}


def lengths():
    """Stated lengths and what they come to, from numbers of every form and all units."""
    rng = random.Random(11)
    for n, (unit, size) in enumerate(40 * list(UNITS.items())):
        whole, den = rng.randint(1, 60), rng.choice([2, 4, 8, 16, 32])
        part = Fraction(rng.randrange(1, den, 2), den)
        text, value = [(f"{whole}", Fraction(whole)), (f"{part}", part), (f"{whole}-{part}", whole + part), (f"{whole} {part}", whole + part), (f"{whole}.{den}", Fraction(f"{whole}.{den}"))][n % 5]
        yield f"{text}{' ' * (n % 2)}{unit}", float(value * size)
        yield f"{text} {unit} to {whole + 9} {unit}", None
    for number in (0, 1, 2, 3, 4, 5, 6, 8, 10, 12):  # screw gauges follow 0.060 + 0.013 n inches
        yield f"#{number}-{20 + number}", (60 + 13 * number) * 0.0254
    for size in (3, 7, 14):
        yield f"M{size} x 0.5", float(size)
    yield from ((None, None), ("", None), ("seventeen", None), ("42", None))


def test_length_mm(spark):
    cases = list(lengths())
    got = spark.createDataFrame(cases, "t string, want double").select("t", "want", dimensions.length_mm(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want if r.want is None else pytest.approx(r.want, abs=6e-4)) for r in got]


def test_nearest_pipes(spark):
    values = [round(0.9 * 1.07**i, 3) for i in range(80)]

    def want(table, mm):
        error, size = min((abs(mm / (v * 25.4) - 1), k) for k, v in table.items())
        return size if error < 0.12 else None

    got = spark.createDataFrame([(v,) for v in values], "mm double").select("mm", threads.nearest(threads.OD, F.col("mm")).alias("od"), threads.nearest(threads.BORE, F.col("mm")).alias("bore")).collect()
    assert [(r.od, r.bore) for r in got] == [(want(threads.OD, v), want(threads.BORE, v)) for v in values]
    row = spark.range(1).select(threads.outside_mm(F.lit("2")).alias("od"), threads.nearest(threads.OD, F.lit(61.0)).alias("near"), threads.nearest(threads.OD, F.lit(5.0)).alias("none")).first()
    assert row.od == pytest.approx(2.375 * 25.4, abs=0.01) and (row.near, row.none) == ("2", None)


def test_pipe_sizes_as_written(spark):
    """Every known size in several spellings, and fractions that reduce to it."""
    spell = ["{}", "{} NPT", " {} in", "pipe size {}", '{}"', "{} BSPT thread"]
    cases = [(f.format(form), size) for size in threads.OD for form in {size, size.replace("-", " ")} for f in spell]
    cases += [(f"{w}{2 * int(n)}/{2 * int(d)}", w + f"{n}/{d}") for w, n, d in (("", 1, 4), ("", 3, 8), ("1-", 1, 2), ("2 ".replace(" ", "-"), 1, 2))]
    cases += [(t, None) for t in ("", "7", "3/5", "9/8", "1/0", "0/8", "1/32", "hose", None)] + [("5/8", "5/8")]
    got = spark.createDataFrame(cases, "t string, want string").select("t", "want", threads.pipe_size(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]


def test_nuts_pitches_and_families(spark):
    rows = [("M10", 16.0, None), ("M7", 11.2, None), ("1/2\"-13", 19.05, 25.4 / 13), ("M20 x 2.5", 30.0, 2.5), ("M4-0.7", 7.0, 0.7), ("1\"", 38.1, None), ("none", None, None)]
    got = spark.createDataFrame(rows, "t string, w double, p double").select("*", threads.nut_width_mm(F.col("t")).alias("width"), threads.pitch_mm(F.col("t")).alias("pitch")).collect()
    for r in got:
        assert (r.width, r.pitch) == (r.w and pytest.approx(r.w, abs=1e-3), r.p and pytest.approx(r.p))
    names = {"Jam nuts, brass": True, "cap nut": True, "nut wrench": False, "Peanut butter": False, "minute": False, "T-Nut": False}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", threads.is_nut(F.col("n")).alias("nut")).collect()
    assert {r.n: r.nut for r in got} == names
    keys = {('2-1/2" NPT coupling, M5 x 30 mm', 1): "Fittings :: coupling", ("coupling #12", 1): "Fittings :: coupling", ("304 coupling", 1): "Fittings :: 304 coupling", ("3/8", 0): None}
    for (name, n), want in keys.items():
        assert spark.range(1).select(threads.family_key(F.array(*[F.lit("Fittings")] * n).cast("array<string>"), F.lit(name)).alias("k")).first().k == want


def test_text(spark):
    row = spark.range(1).select(
        text.split_path(F.lit(" Valves|Ball >> Brass ")).alias("path"), text.part_numbers(F.lit("7O21T15, then 12345B6C")).alias("pn"), text.price(F.lit("$ 9,870.05")).alias("price"), text.price(F.lit("on request")).alias("none"),
        *[text.norm_attr(F.lit(v)).alias(f"n{i}") for i, v in enumerate(('7/16 in', '7/16"', " 7/16 Inch", "Zinc", "Tin"))],
    ).first()
    assert row.path == ["Valves", "Ball", "Brass"] and row.pn == ["7021T15", "12345B6C"] and row.price == 9870.05 and row.none is None
    assert row.n0 == row.n1 == row.n2 and row.n3 != row.n4


def plain_places(hits, tolerance, least):
    """The order within tiers by a plain loop: hits (item, score, boost)."""
    pinned = sorted((s, i) for i, s, _ in hits if s <= -1e8)
    rest = sorted((s, i, b or 0.0) for i, s, b in hits if s > -1e8)
    tiers, leader = [], None
    for s, i, b in rest:
        if leader is None or s > leader * (1 - tolerance):
            tiers.append([])
            leader = s
        tiers[-1].append((-(b if b >= least else 0.0), s, i))
    return [i for _, i in pinned] + [i for t in tiers for *_, i in sorted(t, key=lambda x: x[0])]


def test_rerank_within_tiers(spark):
    rng = random.Random(5)
    lists = {q: [(f"i{n}", rng.choice([-2e9, -1e9 - n]) if rng.random() < 0.1 else -round(rng.uniform(1, 9), 2) - n / 1000, rng.choice([None, 0.01, 0.2, 0.2, 0.9])) for n in range(rng.randint(1, 30))] for q in range(25)}
    rows = spark.createDataFrame([(q, *h) for q, hits in lists.items() for h in hits], "query_id int, item string, score double, boost double")
    for tolerance, least in ((0.1, 0.05), (0.3, 0.5)):
        got = defaultdict(list)
        for r in rerank_within_tiers(rows, tolerance, least).orderBy("query_id", "place").collect():
            got[r.query_id].append(r.item)
        assert got == {q: plain_places(hits, tolerance, least) for q, hits in lists.items()}


def test_percentiles_of_any_group(spark):
    rng = random.Random(8)
    rows = [(g, rng.choice([None, rng.randint(0, 9), rng.random()])) for g in ("a", "b", None) for _ in range(200)] + [("empty", None), ("one", 3.0)]
    table = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    got = {r.g: (r.x, r.y) for r in percentiles(table, "g", "v", {"x": 0.5, "y": 0.9}).collect()}
    for g in ("a", "b", None, "one"):
        own = [float(v) for h, v in rows if h == g and v is not None]
        assert got[g] == tuple(pytest.approx(np.percentile(own, p), abs=1e-6) for p in (50, 90))
    assert got["empty"] == (None, None) and len(got) == 5


def test_answer(spark):
    """Twins count for the best; a constraint that nothing meets leaves all in."""
    rows = [(1, 10, "s", 1.0, 0.9, True), (1, 11, "s", 0.95, 0.9, True), (1, 12, "t", 0.9, 0.9, True), (1, 13, "t", 2.0, 0.9, False), (2, 20, "s", 0.5, 0.2, False), (2, 21, "u", 0.4, 0.9, False)]
    got = {r.query_id: r for r in answer(spark.createDataFrame(rows, "query_id int, label int, spec string, score double, sim double, fits boolean"), 0.1).collect()}
    e = [math.exp(x / 0.1) for x in (0, -0.05, -0.1)]
    assert (got[1].label, got[1].twins, got[1].tier, got[1].unfiltered) == (10, [11], "likely", False) and got[1].p == pytest.approx((e[0] + e[1]) / sum(e))
    assert (got[2].label, got[2].twins, got[2].tier, got[2].unfiltered) == (20, [], "unknown", True)


def test_jsonl_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"part_number": " x1 ", "name": "", "description": "Hex nut", "category": "A > B", "images": "a;b", "attributes": {"size": "M6"}, "size": "no", "finish": "zinc"}), "", json.dumps({"name": "no number"})]))
    parts, rejected = readers.open_source(spark, str(tmp_path / "a.jsonl"))
    row = parts.first()
    assert (row.part_number, row.name, row.category_path, row.image_paths, row.attributes) == ("X1", "Hex nut", ["A", "B"], ["a", "b"], {"size": "M6", "finish": "zinc"}) and rejected.count() == 1
    (tmp_path / "a.csv").write_bytes('﻿part_number,name,length\r\n91251a537,"Screw ""x""","1"""\r\n'.encode())
    row = readers.open_source(spark, str(tmp_path / "a.csv"))[0].first()
    assert (row.part_number, row.name, row.attributes) == ("91251A537", 'Screw "x"', {"length": '1"'})


def test_images_and_events(spark, tmp_path):
    for name in ("91251A537_2.jpg", "91251a537 1.png", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    row = readers.read_images(spark, str(tmp_path)).first()
    assert row.part_number == "91251A537" and len(row.image_paths) == 2
    (tmp_path / "e.log").write_text('{"kind": "view", "at": "x"}\nbroken\n{"at": "y"}\n')
    assert readers.read_events(spark, str(tmp_path / "e.log"), "kind string, at string").count() == 1


def test_size_votes(spark):
    rows = [
        (1, "Screw", {"LENGTH": "20 mm", "Outside-Diameter": "5 mm"}, 20.0, 5.0, None, None),
        (2, "Screw", {"od": "10 mm"}, 40.0, 1.0, None, -0.5),  # no length: the long side counts as the width
        (3, "Hex nut", {"thread": "M8"}, 14.04, 4.0, None, None),  # on its edge: 14.04 / 1.08 is 13 mm
        (4, "Elbow, female", {"pipe": "1/2"}, None, 30.0, 18.0, None),
        (5, "Pipe, butt-weld", {"pipe size": "1/2", "schedule": "80"}, None, 21.0, 30.0, None),
        (6, None, None, None, None, None, None),
        (7, "Screw", {"length": "none", "pipe": "odd"}, 3.0, 2.0, 1.0, None),
    ]
    df = spark.createDataFrame(rows, "id int, name string, attributes map<string,string>, long double, short double, bore double, pitch double")
    got = {r.id: r for r in threads.size_votes(df).withColumn("score", threads.size_score(F.col("votes"))).collect()}
    votes = {k: {v.what: round(v.vote, 4) for v in r.votes} for k, r in got.items()}
    assert votes == {1: {"length": 1, "width": 1}, 2: {"width": -1, "pitch": -0.5}, 3: {"nut": 1}, 4: {"pipe": 1, "bore": 1}, 5: {"pipe": 1, "bore": -1}, 6: {}, 7: {}}
    assert [got[k].score for k in (1, 2, 5, 6)] == [1, -0.75, 0, 0] and set(got[1].asDict()) == {*df.columns, "votes", "score"}


def test_part_folders(spark, tmp_path):
    for name in ("x1/b.jpg", "x1/a.PNG", "x1/notes.txt", "Y2/1.webp", "_drafts/1.jpg", ".cache/1.jpg", "__MACOSX/1.jpg", "Z3/meta.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"no json")
    (tmp_path / "x1/meta.json").write_text(json.dumps({"name": "Nut", "category_path": ["A", "B"], "attributes": {"size": "M6"}, "size": "no", "finish": 3}))
    parts, rejected = readers.open_source(spark, str(tmp_path))
    got = {r.part_number: r for r in parts.collect()}
    assert set(got) == {"X1", "Y2", "Z3"} and rejected.count() == 0
    x = got["X1"]
    assert (x.name, x.category_path, x.attributes, [p.rpartition("/")[2] for p in x.image_paths]) == ("Nut", ["A", "B"], {"size": "M6", "finish": "3"}, ["a.PNG", "b.jpg"])
    assert (got["Y2"].name, got["Z3"].name, got["Z3"].image_paths) == ("Y2", "Z3", [])
    assert sorted((r.part_number, r.path.rpartition("/")[2]) for r in readers.labelled_images(spark, str(tmp_path)).collect()) == [("X1", "a.PNG"), ("X1", "b.jpg"), ("Y2", "1.webp")]
    (tmp_path / "items.txt").write_text(" a1 \n# no\n\nb2#3\n")
    assert [r.item for r in readers.read_items(spark, str(tmp_path / "items.txt")).collect()] == ["a1", "b2#3"]


def test_ingest(spark):
    make = lambda rows: readers.normalise(spark.createDataFrame(rows, "part_number string, name string, description string, attributes map<string,string>, image_paths array<string>"))[0]
    held = make([("a", "Old", "kept", {"size": "1", "grade": "8"}, ["old.jpg"]), ("c", "Other", "", {}, [])])
    incoming = make([("a", "First", "", {}, []), ("a", "New", "", {"size": "2"}, ["gone.jpg", "z.jpg", "b.jpg"]), ("b", "", "", None, None)])
    files = spark.createDataFrame([("b.jpg",), ("z.jpg",), ("b.jpg",)], "path string")
    catalog, counts = readers.ingest(incoming, held, files, merge=True)
    got = {r.part_number: r for r in catalog.collect()}
    assert counts.first().asDict() == {"parts": 3, "missing_images": 1, "without_images": 2, "written": 3} and set(got) == {"A", "B", "C"}
    assert (got["A"].name, got["A"].description, got["A"].attributes, got["A"].image_paths) == ("New", "kept", {"size": "2", "grade": "8"}, ["z.jpg", "b.jpg"])
    replaced = {r.part_number: r for r in readers.ingest(incoming, held, files)[0].collect()}["A"]
    assert (replaced.description, replaced.attributes) == ("", {"size": "2"})
    assert readers.ingest(incoming.limit(0), None, files)[1].first().asDict() == {"parts": 0, "missing_images": 0, "without_images": 0, "written": 0}
    with pytest.raises(FileNotFoundError, match="gone.jpg"):
        readers.ingest(incoming, held, files, strict=True)


def test_parse_product():
    html = '<title>t</title><script type="application/ld+json">{"@type":"Product","name":"N","image":"a.jpg"}</script><img src="logo.png"><img src="b.jpg"><table><tr><td>Size:</td><td>M6</td></tr><tr><td>Size</td><td>M8</td></tr></table>'
    assert parse_product(html) == {"name": "N", "description": "", "images": ["a.jpg", "b.jpg"], "attributes": {"Size": "M6"}}
    assert parse_product("")["name"] == ""
    marked = '<meta property="OG:Title" content="Bolt"><table><tr><td>Thread <b>size</b></td><td>M6<br>coarse <i>pitch</i></td></tr><tr><td>lone</td></tr><tr><th>Use</th><td><p>in</p><p>doors</p></td></tr></table>'
    assert parse_product(marked) == {"name": "Bolt", "description": "", "images": [], "attributes": {"Thread size": "M6 coarse pitch", "Use": "in doors"}}


def test_robots(spark):
    from lodestone.functions.robots import allowed, disallowed

    rules = disallowed("User-agent: a\nUser-agent: *\nDisallow: /cart\nDisallow: /search$\nDisallow: /*?\n\nUser-agent: b\nDisallow: /")
    assert rules == ["/cart", "/search$", "/*?"] and disallowed("User-agent: b\nDisallow: /x", "b") == ["/x"]
    paths = {"/cart/1": False, "/search": False, "/search/2": True, "/p?q=1": False, "/p": True}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", allowed(F.col("p"), rules).alias("ok")).collect()
    assert {r.p: r.ok for r in got} == paths


def test_stated_pitches(spark):
    texts = {"M6 x 1": (True, 1.0), "m10×1.5": (True, 1.5), "M6-1.0 x 20": (True, 1.0), "M6-20": None, '1/4"-20': (False, 20.0), "#8-32": (False, 32.0), "1-1/4 - 11": (False, 11.0), "1-1/4": None, "3/8": None, "": None, None: None, "mx1": None, "8-32 x 1": (False, 32.0)}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", threads.designation(F.col("t")).alias("d")).collect()
    assert {r.t: r.d and tuple(r.d) for r in rows} == texts
    sizes = {101.6: "3-1/2", 141.3: "5", 168.0: "6", 219.0: "8", 7.9: "1/16", 250.0: None, None: None}
    rows = spark.createDataFrame([(mm,) for mm in sizes], "mm double").select("mm", threads.nearest(threads.OD, F.col("mm")).alias("size")).collect()
    assert {r.mm: r.size for r in rows} == sizes
    names = {"Hex Nuts": True, "Locknut, M6": True, "Nut Driver": False, "T-Nut": False, "Coconut nut": False, "Wing Nut": True, "Donut": False, "Nut Plate": False, "Bolt": False}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", threads.is_nut(F.col("n")).alias("nut")).collect()
    assert {r.n: r.nut for r in rows} == names


def _page(*, data=(), head="", body=""):
    blocks = "".join(f'<script type="application/ld+json">{d if isinstance(d, str) else json.dumps(d)}</script>' for d in data)
    return f"<html><head>{head}{blocks}</head><body>{body}</body></html>"


def test_page_parts(spark):
    product = {"@type": "Product", "name": " Hex  nut ", "sku": "90101a5", "description": "Zinc", "image": ["/a.png", {"@type": "ImageObject", "contentUrl": "b.png"}, 7], "additionalProperty": [{"name": "Thread", "value": "M5"}, {"name": "Pack", "value": 10}, "x"]}
    crumbs = {"@type": "BreadcrumbList", "itemListElement": [{"position": 2, "item": {"name": "Nuts"}}, {"position": "1", "name": "Fasteners"}, {"position": "?", "name": " "}, 4]}
    rows = "<table><tr><th>Thread:</th><td>M6</td></tr><tr><td>Finish:</td><td>Plain</td></tr><tr><td>" + "k" * 40 + "</td><td>v</td></tr><tr><td>only</td></tr></table>"
    pictures = '<img src="/img/logo-product.png"><img data-src="/gfx/c.png"><img src="/x/90101A5.png"><img src="/y.png" alt="The 90101A5 nut"><img src="/z.png"><img src="/a.png">'
    meta = '<title>Steel Bolt, M6 | Shop of bolts</title><meta name="description" content="Strong"><meta property="og:image" content="/og.png">'
    pages = [
        (1, "https://shop.test/p/1?x=1", _page(data=["{broken", [product, crumbs]], body=rows + pictures)),
        (2, "https://shop.test/12345B67/?ref=99999C1", _page(head=meta, body='<a class="Breadcrumb-link" href="/"><b>Fasteners</b></a><a href="/">no</a><a class="breadcrumb" href="/b">Bolts</a>')),
        (3, "https://shop.test/none", _page(head="<title>Washer 7777w1 - wide</title>")),
        (4, "https://5555a1.test/none", _page(head="<title>Nothing here</title>")),
        (5, None, None),
        (6, "https://shop.test/8888D1", "<table><tr><td>a<td>b</tr>"),
    ]
    got = {r.page_id: r for r in page_parts(spark.createDataFrame(pages, "page_id long, url string, html string"), site="Shop").collect()}
    assert set(got) == {1, 2, 3, 6}
    a = got[1]
    assert (a.part_number, a.name, a.category_path, a.description) == ("90101A5", "Hex nut", ["Fasteners", "Nuts"], "Zinc")
    assert a.attributes == {"Thread": "M5", "Pack": "10", "Finish": "Plain"}
    assert a.image_paths == [f"https://shop.test{x}" for x in ("/a.png", "/p/b.png", "/gfx/c.png", "/x/90101A5.png", "/y.png")]
    b = got[2]
    assert (b.part_number, b.name, b.category_path, b.description, b.image_paths) == ("12345B67", "Steel Bolt, M6", ["Fasteners", "Bolts"], "Strong", ["https://shop.test/og.png"])
    assert b.family_id == "Fasteners > Bolts :: steel bolt"
    assert (got[3].part_number, got[3].name) == ("7777W1", "Washer 7777w1 - wide") and (got[6].part_number, got[6].name) == ("8888D1", "8888D1")


def test_enriched(spark):
    parts = spark.createDataFrame(
        [("P1", "P1", ["A"], "", {"Size": "1"}, ["p.png"]), ("P2", "Nut", [], "old", {}, []), ("P3", "Bolt", ["B"], "", {}, []), ("P4", None, None, None, None, None)],
        "part_number string, name string, category_path array<string>, description string, attributes map<string,string>, image_paths array<string>",
    )
    found = spark.createDataFrame(
        [(2, "P1", "later", ["Z"], "z", {"Z": "z"}, "u2"), (1, "P1", "Plug", [], "", {"Size": "2", "Use": "air"}, "u1"), (3, "P2", "", ["N"], "new", {}, "u3"), (4, "P3", "Screw", ["S"], "", {}, "u4"), (5, "P9", "x", [], "", {}, "u5")],
        "page_id long, part_number string, name string, category_path array<string>, description string, attributes map<string,string>, url string",
    )
    got = {r.part_number: r for r in enriched(parts, found).collect()}
    assert set(got) == {"P1", "P2"}
    assert tuple(got["P1"]) == ("P1", "Plug", ["A"], "", {"Size": "1", "Use": "air"}, ["p.png"], "u1")
    assert tuple(got["P2"]) == ("P2", "Nut", ["N"], "new", {}, [], "u3")
    every = {r.part_number: r.name for r in enriched(parts, found, only_missing=False).collect()}
    assert every == {"P1": "Plug", "P2": "Nut", "P3": "Screw"} and enriched(parts, found.limit(0)).count() == 0

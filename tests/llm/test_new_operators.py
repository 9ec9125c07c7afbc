"""Source divergence, pieces and periodic runs against plain versions, the library and brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import sentencepiece

from lodestone.llm import divergence, pieces, queries, runs, sql
from lodestone.llm.shared import mix

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, ids string, term string, cell int"


def frame(spark, rows):
    """doc_id, text, lang, source and columns whose names the operators use."""
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "ÀB àb AB ab aB", "en", "a"), (3, "ÀB àb AB ab aB", "en", "a"), (4, "ab Àb x1y2 é", "en", "b"), (5, "x" * 50_000, "en", "a"), (6, "x" * 50_000 + "y", "en", "b"),
    (7, "x" * 50_000, "en", "c"), (8, "abcdefgh abcdefgi abcdefgj", "de", "a"), (9, "abcdefgh abcdefgk", "de", ""), (10, "abcdefgh", "de", None), (11, "日本 日本語 日本", None, "a"), (12, "日本", None, "b"), (13, "日本,日本", "", "c"), (14, "\x00\x01 12", "fr", "a"), (None, "ab", "en", "d"),
]


def plain_divergence(rows, least=3, top=200):
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        docs[lang].update(set(terms))
        n[lang, source].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= least]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (n[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in sources}
        whole = {t: 1 + 10**9 * (sum(n[lang, s][t] for s in sources) + 1) // (sum(total.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(f(p[s][t], whole[t]), t) for t in kept if n[lang, s][t] and p[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", own, top)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(ordered, 1)}
    return out


@pytest.mark.parametrize("first", [1, 6])
def test_divergence_of_odd_rows(spark, monkeypatch, first):
    found = divergence.iceberg_terms
    monkeypatch.setattr(divergence, "iceberg_terms", lambda docs, least: found(docs, least, first))
    got = {tuple(r) for r in divergence.source_divergence(frame(spark, ODD)).collect()}
    assert got == plain_divergence(ODD)
    assert {tuple(r) for r in divergence.source_divergence(frame(spark, ODD), least=1, top=2).collect()} == plain_divergence(ODD, 1, 2)
    assert divergence.source_divergence(frame(spark, [])).count() == 0


def test_divergence_with_full_marks(spark, monkeypatch):
    """Where the marks let everything pass, and where they are tiny, counts stay exact."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(1, 14))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words, 40)), "en", f"s{i % 5}") for i in range(120)]
    monkeypatch.setattr(divergence, "BITS", (6, 6))
    assert {tuple(r) for r in divergence.source_divergence(frame(spark, rows)).collect()} == plain_divergence(rows)


def test_divergence_as_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op11_divergence(spark, SF)
    assert {tuple(r) for r in got.collect()} == set(duck.sql(f"SELECT {', '.join(got.columns)} FROM ({sql.ORACLES['op11_divergence']}) x").fetchall())


@pytest.mark.parametrize(("n", "total", "v"), [(0, 0, 1), (7, 20, 3), (9_223_372_035, 10**10, 5), (10**13, 10**14, 10**6)])
def test_shares_of_large_counts(spark, n, total, v):
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(divergence._p("n", "total", "v")).first()
    assert row[0] == 1 + 10**9 * (n + 1) // (total + v)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))


def test_pieces_as_library(spark, library):
    rng = np.random.default_rng(6)
    texts = [None, "", " ", "  ", "▁", "a▁b", "<s> </s><unk> <0x0A>", "\x00\x01", "𝄞é\n\n a", "ﬁ Ａ ﻿", " lead", "trail  ", "日本語 テキスト", "á " * 50, "x" * 5000, "word " * 3000, "a\tb\nc\r\n"]
    texts += ["".join(rng.choice(list("ab \n▁é日\t1𝄞"), rng.integers(0, 90))) for _ in range(500)]
    rows = frame(spark, [(i, t, None, None) for i, t in enumerate([*texts, texts[9]])])
    got = {r.doc_id: r for r in pieces.encode_pieces(rows, queries.vocabulary("piece_bpe_32k.model")).collect()}
    for i, t in enumerate([*texts, texts[9]]):
        ids = library.encode(t or "")
        assert (got[i].ids, got[i].decoded) == (ids, library.decode(ids))
    assert pieces.encode_pieces(frame(spark, []), queries.vocabulary("piece_bpe_32k.model")).count() == 0


def test_agendas_agree(library, monkeypatch):
    """One stretch at a time, many at a time, with stretches forgotten all the time, and without cuts at spaces."""
    path = queries.vocabulary("piece_bpe_32k.model")
    v = pieces.vocabulary(path)
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    stretches = list({pieces.MARK + w for t in texts for w in t.split()})
    assert [np.array(pieces.piece_ids(s, v), dtype="<i4").tobytes() for s in stretches] == pieces.many_ids(stretches, v)
    want = [np.array(x, dtype="<i4").tobytes() for x in library.encode(texts)]
    monkeypatch.setattr(pieces, "KEPT", 50)
    small = pieces.Encoder(path)
    assert [small.encode([t])[0] for t in texts] == want
    whole = pieces.Encoder(path)
    monkeypatch.setattr(v, "cuts", False)
    assert whole.encode(texts[:20]) == want[:20]


def test_ids_that_differ_fail(monkeypatch):
    own = pieces.Encoder(queries.vocabulary("piece_bpe_32k.model"))
    monkeypatch.setattr(pieces, "many_ids", lambda texts, v: [b"\0\0\0\0" for _ in texts])
    with pytest.raises(ValueError, match="differ"):
        own.encode(["some words"])


def test_pieces_query(spark, library):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    for r in queries.op12_pieces(spark, SF).collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def plain_runs(c, least=6, times=4):
    out, n = [], len(c)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if c[i] != c[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and c[i] == c[i + q]:
                i += 1
            length = i - start + q
            shorter = any(all(c[k] == c[k + p] for k in range(start, start + length - p)) for p in range(1, q))
            if length >= max(least, times * q) and not shorter:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        c = rng.integers(0, rng.choice([1, 2, 3, 5]), rng.integers(0, 60)).tolist()
        if rng.random() < 0.5 and c:
            a, p = int(rng.integers(len(c))), int(rng.integers(1, 9))
            c = [x if i < a else c[min(a + (i - a) % p, len(c) - 1)] for i, x in enumerate(c)]
        for least, times in ((6, 4), (2, 2), (3, 3)):
            want = plain_runs(c, least, times)
            assert runs.runs(c, least, times) == want
            hashes = mix(np.array(c, dtype=np.uint64) + np.uint64(9))
            held = runs.candidates(hashes, np.zeros(len(c), dtype=np.int64), least, times)
            assert all(any(a <= s and s + n <= b for a, b in held) for s, n, _ in want)


def test_long_runs():
    """Words of one kind, a long period and Fibonacci's word, which is full of squares but has no fourth power, stay near linear."""
    a, b = [0], [0, 1]
    while len(b) < 30_000:
        a, b = b, b + a
    assert runs.runs(b) == [] and runs.runs([1] * 30_000) == [(0, 30_000, 1)] and runs.runs([i % 70 for i in range(30_000)]) == [(0, 30_000, 70)]


def test_runs_of_odd_rows(spark):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x  a b a b a b a b\ty", "É é " * 9, "a " * 30_000, "one two three " * 5 + "four " + "one two " * 4, "a a a a a a b b b b b b"]
    rows = frame(spark, [(i, t, None, None) for i, t in enumerate([*texts, texts[6]])])
    got = {r.doc_id: r for r in runs.periodic_runs(rows).collect()}
    for i, t in enumerate([*texts, texts[6]]):
        w = WORD.findall(t or "")
        want = plain_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        dropped = {k for s, n, q in want for k in range(s + q, s + n)}
        assert (got[i].n_words, [tuple(x) for x in got[i].runs], got[i].collapsed) == (len(w), want, " ".join(x for k, x in enumerate(w) if k not in dropped))
    assert runs.periodic_runs(frame(spark, [])).count() == 0


def test_runs_query(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE length(text) < 6000").fetchall())
    some = 0
    for r in queries.op13_runs(spark, SF).collect():
        if r.doc_id not in texts:
            continue
        w, h = WORD.findall(texts[r.doc_id] or ""), zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        some += len(found)
        dropped = {k for s, m, q in found for k in range(s + q, s + m)}
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if found else (None, None, None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        want = (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in dropped).encode()).hexdigest())
        assert tuple(r)[1:] == want
    assert some > 5

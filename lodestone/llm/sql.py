"""DuckDB SQL for the operators that SQL can express."""

ORACLES = {
    "op7_exact_dedup": """
        WITH own AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content FROM documents),
        g AS (SELECT content, max(doc_id) AS keep_id, count(*) AS group_size, sha256(content) AS text_sha256 FROM own GROUP BY content)
        SELECT own.doc_id, g.keep_id, g.group_size, own.doc_id = g.keep_id AS kept, g.text_sha256 FROM own JOIN g USING (content)
    """,
    "op11_divergence": r"""
        WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        term AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS n_lang FROM term GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
        langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY lang),
        n AS (SELECT lang, source, term, count(*) AS n FROM term SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        totals AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY lang, source),
        groups AS (SELECT g.lang, g.source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN totals USING (lang, source) LEFT JOIN langs USING (lang)),
        placed AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, CAST(1 + (1000000000 * (coalesce(n.n, 0) + 1)::HUGEINT) // (g.total + g.v) AS HUGEINT) AS p,
            CAST(1 + (1000000000 * (k.n_lang + 1)::HUGEINT) // (l.total_lang + l.v) AS HUGEINT) AS q
          FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
        pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM placed a JOIN placed b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
        every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
          UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM placed WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every QUALIFY part = 'pair' OR rank <= 200
    """,
}

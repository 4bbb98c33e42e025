"""DuckDB SQL for the corpus queries that SQL can express, over views with the tables' names."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1(words: int = 3, share: int = 90) -> str:
    """Equal sets are one node; links by counting common shingles; what a node reaches by a recursive query."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return rf"""
WITH RECURSIVE texts AS (SELECT doc_id, text, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, text, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: {shingle}))) END AS s FROM texts),
nodes AS MATERIALIZED (
  SELECT row_number() OVER () AS node, s, len(s) AS n, count(DISTINCT text) AS texts FROM sets WHERE len(s) > 0 GROUP BY s),
items AS MATERIALIZED (SELECT node, n, unnest(s) AS item FROM nodes),
near AS MATERIALIZED (
  SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.item = b.item AND a.node <> b.node
  GROUP BY a.node, b.node HAVING 100 * count(*) >= {share} * (any_value(a.n) + any_value(b.n) - count(*))),
reached AS (
  SELECT node, node AS other FROM nodes
  UNION SELECT r.node, l.b FROM reached r JOIN near l ON r.other = l.a),
least AS (SELECT s, min(doc_id) AS doc_id FROM sets GROUP BY s),
components AS (
  SELECT r.node, min(l.doc_id) AS component_id FROM reached r JOIN nodes n ON n.node = r.other JOIN least l ON l.s = n.s GROUP BY r.node),
linked AS (SELECT l.a AS node, sum(n.texts) AS links FROM near l JOIN nodes n ON n.node = l.b GROUP BY l.a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, CASE WHEN len(d.s) > 0 THEN c.component_id ELSE d.doc_id END AS component_id,
       coalesce(n.texts - 1 + coalesce(k.links, 0), 0)::BIGINT AS n_links
FROM sets d LEFT JOIN nodes n ON n.s = d.s LEFT JOIN components c ON c.node = n.node LEFT JOIN linked k ON k.node = n.node
"""


#: The digest in base32: five hex digits are four letters.
OP9 = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
digests AS (
  SELECT page_id, octet_length(encode(payload)) AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS keeper,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
           (('0x' || substr(sha1(payload), 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '') AS payload_digest
  FROM payloads)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM digests
"""

OP11 = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
kept AS MATERIALIZED (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
found AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM docs)
  SEMI JOIN kept USING (lang, term) GROUP BY ALL),
counts AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)),
weights AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
  FROM counts JOIN sizes USING (lang)),
langs AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY lang, term) JOIN sizes USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM weights a JOIN weights b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT w.lang, w.source, 'term', w.term, ((w.p - l.q) * (w.p - l.q) // (w.p + l.q))::BIGINT
  FROM weights w JOIN langs l USING (lang, term) WHERE w.n > 0 AND w.p > l.q)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""


def op12(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Each round as three steps: nearest entries, sums by position, and the entries that follow."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cuts AS MATERIALIZED (
  SELECT vec_id, label, p AS part, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v
  FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (
  SELECT part, entry - 1 AS entry, v
  FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS entry FROM cuts) WHERE entry <= {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, part, any_value(v) AS v, min(d) AS d, arg_min(entry, (d, entry)) AS entry
  FROM (SELECT c.vec_id, c.label, c.part, c.v, b.entry,
               list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM cuts c JOIN book{r} b USING (part)) GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""
mean{r} AS (
  SELECT part, entry, pos, sum(x) AS s, count(*) AS n
  FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM near{r}) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN (
    SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS v FROM mean{r} GROUP BY part, entry) m
  USING (part, entry))""")
    return ",".join(steps) + f"""
, digest AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM book{rounds})),
codes AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes, digest
"""


ORACLES: dict[str, str] = {"op1_token_combinations": op1(), "op9_zip_archives": OP9, "op11_source_divergence": OP11, "op12_anchor_codes": op12()}

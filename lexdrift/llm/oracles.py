"""DuckDB SQL of the operators that SQL can express, over the same tables.

Names, patterns and numbers are those of the queries' contracts.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
POLYNOMIAL = 0xEDB88320

OP11 = rf"""
WITH terms AS (
  SELECT doc_id, rn, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS rn FROM documents)),
tfs AS (SELECT doc_id, rn, term, count(*)::BIGINT AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT rn, count(*)::BIGINT AS n FROM terms GROUP BY rn),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, tfs.rn,
         sum(times * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN dfs USING (term) JOIN sizes ON sizes.rn = tfs.rn, totals
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS "rank" FROM scored WHERE score > 0)
SELECT item_id, "rank"::INTEGER AS "rank", doc_id, score FROM ranked WHERE "rank" <= 10
"""


def _crc_table() -> str:
    """The 256 CRC-32 remainders, from the polynomial."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (POLYNOMIAL if byte & 1 else 0)
        out.append(str(byte))
    return f"[{', '.join(out)}]::BIGINT[]"


OP13 = rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_crc_table()} AS t),
runs AS MATERIALIZED (
  SELECT doc_id, word, count(*)::BIGINT AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS word
    FROM documents) GROUP BY ALL),
sums AS MATERIALIZED (
  SELECT word, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(key))),
      lambda k: ('0x' || substr(hex(encode(key)), 2 * k + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM (SELECT *, doc_id || ':' || word AS key FROM runs), crc),
counts AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(word, 1, (h % length(word))::INTEGER) || substr(word, (h % length(word))::INTEGER + 2)
         ELSE word END AS word, n FROM sums),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM counts WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS MATERIALIZED (
  SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS k FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT c.word, c.n, w.word AS other, w.n AS other_n FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT DISTINCT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN cuts b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word),
best AS (
  SELECT word, count(*)::BIGINT AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS form, max(other_n) AS form_n
  FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form,
         CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c USING (word) WHERE c.next IS NULL
"""

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         list_sum(list_transform(range(1, least(len(q.e), len(v.e)) + 1), lambda i: q.e[i] * v.e[i]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS "rank" FROM scored)
SELECT query_id, "rank"::INTEGER AS "rank", vec_id, score FROM ranked WHERE "rank" <= 5
"""

OP4 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS words FROM documents),
words AS MATERIALIZED (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM texts),
windows AS (
  SELECT doc_id, j AS i, row_number() OVER (PARTITION BY sequence ORDER BY doc_id, j) AS n FROM (
    SELECT doc_id, j, lead(j, 19) OVER w AS last, string_agg(word, ' ') OVER (w ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS sequence
    FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY j)) WHERE last IS NOT NULL),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM windows WHERE n > 1),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

#: Kind, pattern (of which group 2 of the first one must have six characters) and place in the list of kinds.
SECRETS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", "AKIA[A-Z0-9]+"),
    ("hex", "[0-9a-f]{24,}"),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    ("slack", "xox[abeprs]-[A-Za-z0-9-]{10,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def _spans(place: int, kind: str, pattern: str) -> str:
    """(doc_id, place, kind, start, end) of one kind: what lies between the matches tells where they are."""
    quoted = pattern.replace("'", "''")
    kept = f"regexp_extract_all(text, '{quoted}', 2)" if kind == "assign" else "found"
    least = {"assign": 6, "access": 20}.get(kind, 1)
    return f"""
  SELECT doc_id, {place} AS place, '{kind}' AS kind, upto - size AS "start", upto AS "end" FROM (
    SELECT *, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM (
      SELECT doc_id, unnest(list_transform(found, lambda x: length(x))) AS size,
             unnest(list_transform({kept}, lambda x: length(x))) AS own,
             unnest(list_transform(between[1:len(found)], lambda x: length(x))) AS gap,
             unnest(range(len(found))) AS n
      FROM (SELECT doc_id, text, regexp_extract_all(text, '{quoted}') AS found,
                   string_split_regex(text, '{quoted}') AS between
            FROM documents WHERE regexp_matches(text, '{quoted}'))))
  WHERE own >= {least}"""


OP8 = f"""
WITH spans AS MATERIALIZED ({' UNION ALL '.join(_spans(n, *rule) for n, rule in enumerate(SECRETS))}),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", place) AS spans,
         string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", place) FILTER (place < 3) AS base
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN joined USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_topk": OP1,
    "op4_substrings": OP4,
    "op8_secrets": OP8,
    "op11_lexical_search": OP11,
    "op13_spelling": OP13,
}

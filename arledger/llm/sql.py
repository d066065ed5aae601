"""SQL restatements of the operators, for another engine."""

#: Near lines share a half (an edit leaves one alone), which keeps the comparison an equi-join. Lines
#: under 20 characters are dropped only as exact repeats.
LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), firsts AS (
  SELECT line, min(struct_pack(d := doc_id, n := line_no)) AS place, length(line) AS n
  FROM lines WHERE length(line) >= 20 OR regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line
), long AS (
  SELECT * FROM firsts WHERE n >= 20
), bases AS (
  SELECT line, place, n, n AS base FROM long UNION ALL SELECT line, place, n, n - 1 FROM long
), halves AS (
  SELECT *, 'head' AS side, left(line, (base // 2)::BIGINT) AS half FROM bases
  UNION ALL SELECT *, 'tail', right(line, (base - base // 2)::BIGINT) FROM bases
), near AS (
  SELECT DISTINCT b.line
  FROM halves a JOIN halves b ON a.side = b.side AND a.base = b.base AND a.half = b.half
  WHERE a.place < b.place AND a.line <> b.line AND levenshtein(a.line, b.line) <= 1
), judged AS (
  SELECT l.doc_id, l.line_no, l.line,
    f.line IS NOT NULL AND (n.line IS NOT NULL OR f.place <> struct_pack(d := l.doc_id, n := l.line_no)) AS dropped
  FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near n ON l.line = n.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

NGRAM_JOIN = f"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM lowered WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT r.a AS doc_id, any_value(coalesce(n, 0)) AS n_shingles, min(r.b) AS component_id
FROM reached r LEFT JOIN sizes ON r.a = sizes.doc_id GROUP BY r.a
"""

QUALITY = f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS w,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) > 3)
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS times FROM windows), range(3) r(k)
  WHERE times > 1 GROUP BY doc_id
), measured AS (
  SELECT doc_id, text, len(lines) AS n_lines, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 14 * n_words
    OR 100 * length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) > 60 * length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))
  ) AS kept
FROM judged
"""

FILL_MIDDLE = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || doc_id) AS h
  FROM documents
), drawn AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM hashed
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s
  FROM cut
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Codebook rounds written out: b0 are the first entries, a0 the parts' entries under b0, ..."""
    steps = []
    for k in range(rounds + 1):
        if k:
            steps.append(f"""
b{k} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k - 1} b LEFT JOIN (
    SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (
      SELECT p, best.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n
      FROM a{k - 1}, range(1, 1000) r(i) WHERE i <= len(x) GROUP BY ALL
    ) GROUP BY p, e
  ) m USING (p, e)
)""")
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT row_id, any_value(vec_id) AS vec_id, any_value(label) AS label, p, any_value(x) AS x, min(struct_pack(
    d := list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x, c)])::BIGINT, e := e)) AS best
  FROM parts JOIN b{k} USING (p) GROUP BY row_id, p
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, vec_id, label,
    [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), parts AS MATERIALIZED (
  SELECT row_id, vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x
  FROM kept, range({parts}) r(p)
), b0 AS MATERIALIZED (
  SELECT p, row_id AS e, x AS c FROM parts WHERE row_id < {entries}
),{",".join(steps)}, coded AS (
  SELECT row_id, any_value(vec_id) AS vec_id, any_value(label) AS label, sum(best.d)::BIGINT AS error,
    lower(string_agg(printf('%02x', best.e), '' ORDER BY p)) AS code
  FROM a{rounds} GROUP BY row_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM coded
"""


VECTOR_CODES = _vector_codes()

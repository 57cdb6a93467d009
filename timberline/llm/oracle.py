"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows of a document are found by the join on the first word's place, so long texts stay linear.
DECONTAMINATE = f"""
WITH docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
items AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT m FROM windows),
grams AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, sizes WHERE len(w) >= m)
),
hits AS (SELECT doc_id, item_id, i, m FROM grams JOIN windows USING (m, g)),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

PIVOTS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""

LINE_DEDUP = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
raw AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM docs),
words AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM raw),
l AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM words WHERE n > 0
),
spans AS (
  SELECT 0 AS kind, a.doc_id, a.k AS i, min(b.k) AS j FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 49 WHERE b.upto - a.upto + a.n >= 50 GROUP BY a.doc_id, a.k
  UNION ALL
  SELECT 1, b.doc_id, max(a.k), b.k FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 49 WHERE b.upto - a.upto + a.n >= 50 GROUP BY b.doc_id, b.k
),
w AS (
  SELECT s.kind, s.doc_id, s.i, s.j, min(l.pos) AS start, max(l.pos) AS stop, string_agg(l.line, chr(10) ORDER BY l.pos) AS content
  FROM spans s JOIN l ON l.doc_id = s.doc_id AND l.k BETWEEN s.i AND s.j GROUP BY s.kind, s.doc_id, s.i, s.j
),
later AS (SELECT doc_id, start, stop FROM w QUALIFY row_number() OVER (PARTITION BY kind, content ORDER BY doc_id, start) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS pos FROM later),
kept AS (
  SELECT raw.doc_id, string_agg(line, chr(10) ORDER BY raw.pos) FILTER (gone.pos IS NULL) AS text, count(*) AS n_lines, count(gone.pos) AS n_removed
  FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.pos = gone.pos GROUP BY raw.doc_id
)
SELECT doc_id, CASE WHEN docs.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM docs LEFT JOIN kept USING (doc_id)
"""

#: Candidates share one of the rarest tenth (and one) of their shingles, which every linked pair does.
JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
df AS (SELECT g, count(*) AS df FROM s GROUP BY g),
p AS (
  SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id) JOIN df USING (g)
  QUALIFY row_number() OVER (PARTITION BY s.doc_id ORDER BY df.df, s.g) <= n.n - CAST(ceil(0.9 * n.n - 1e-9) AS BIGINT) + 1
),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
i AS (SELECT c.a, c.b, c.an, c.bn, count(*) AS x FROM c JOIN s sa ON sa.doc_id = c.a JOIN s sb ON sb.doc_id = c.b AND sb.g = sa.g GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * x >= 90 * (an + bn - x)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT u AS doc_id, u AS spot FROM e UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.spot)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(spot) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""

def _assigned(name: str, books: str) -> str:
    """Each part's nearest entry of ``books``, ties to the lower index."""
    return f"""{name} AS (
  SELECT vec_id, p, any_value(x) AS x, CAST(min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) * 64 + k) AS BIGINT) AS best
  FROM parts JOIN {books} USING (p) GROUP BY vec_id, p
)"""


def _moved(name: str, books: str, assigned: str) -> str:
    """``books`` with each entry that has parts at the floor of their mean."""
    return f"""{name} AS (
  SELECT p, k, coalesce(m.c, {books}.c) AS c FROM {books} LEFT JOIN (
    SELECT p, k, list(y ORDER BY place) AS c FROM (
      SELECT p, best % 64 AS k, place, floor(sum(x[place]) / count(*)) AS y FROM {assigned}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS place) GROUP BY ALL
    ) GROUP BY p, k
  ) m USING (p, k)
)"""


VECTOR_CODES = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (SELECT vec_id, p, e[p * w + 1:(p + 1) * w] AS x FROM (SELECT *, len(e) // 16 AS w, unnest(range(16)) AS p FROM v)),
b0 AS (SELECT p, k, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v QUALIFY k < 64) USING (vec_id)),
{_assigned("a0", "b0")}, {_moved("b1", "b0", "a0")}, {_assigned("a1", "b1")}, {_moved("b2", "b1", "a1")}, {_assigned("a2", "b2")},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, k, place)) AS d FROM (SELECT p, k, unnest(c) AS y, unnest(range(len(c))) AS place FROM b2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256 FROM coded JOIN v USING (vec_id), digest
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""

ORACLE_SQL: dict[str, str] = {
    "op1_pivots": PIVOTS,
    "op3_jaccard_join": JACCARD_JOIN,
    "op4_decontaminate": DECONTAMINATE,
    "op7_line_dedup": LINE_DEDUP,
    "op11_vector_codes": VECTOR_CODES,
    "op13_hard_negatives": HARD_NEGATIVES,
}

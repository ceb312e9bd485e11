"""SQL for DuckDB with the rows of those queries of this subpackage that SQL can express. They compare everything with everything."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, p.w FROM reach JOIN pairs p ON p.u = reach.r
)
SELECT vec_id, (SELECT count(*) FROM pairs p WHERE p.u = reach.vec_id) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept FROM reach GROUP BY vec_id
"""

AUTOMATA = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
spans AS (SELECT doc_id, n, i, md5(array_to_string(list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING), ' ')) AS h FROM words),
windows AS (SELECT doc_id, i, h FROM spans WHERE i + 12 <= n),
firsts AS (SELECT h, min(doc_id) AS f FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (h) WHERE f < doc_id),
kept AS (
  SELECT words.doc_id, count(gone.i) AS n_removed, string_agg(x, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS k
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i GROUP BY words.doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""



def _runs(n: int, name: str) -> str:
    """Maximal runs (doc_id, a, b) that strings of n bytes cover which start more than once; texts are in hexadecimal digits."""
    return f"""
chunks{n} AS (SELECT doc_id, c, substr(x, 2 * c + 1, {2 * (999 + n)}) AS y FROM (SELECT doc_id, x, unnest(range(0, greatest(len(x) // 2 - {n - 1}, 0), 1000)) AS c FROM d)),
windows{n} AS (SELECT doc_id, c + j AS s, md5(substr(y, 2 * j + 1, {2 * n})) AS h FROM (SELECT doc_id, c, y, unnest(range(0, least(1000, len(y) // 2 - {n - 1}))) AS j FROM chunks{n})),
many{n} AS (SELECT h FROM windows{n} GROUP BY h HAVING count(*) > 1),
hits{n} AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM windows{n} WHERE h IN (SELECT h FROM many{n})),
{name} AS (SELECT doc_id, min(s) AS a, max(s) + {n} AS b FROM (SELECT doc_id, s, sum(CASE WHEN gap <= {n} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM hits{n}) GROUP BY doc_id, g)"""


SUFFIXES = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),{_runs(400, "runs")},
before AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs),
kept AS (
  SELECT before.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS k
  FROM before JOIN d ON d.doc_id = before.doc_id GROUP BY before.doc_id
)
SELECT d.doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

DECONTAMINATE = f"""
WITH i AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {WORDS.format(LOWER.format("text"))} AS w FROM benchmark) WHERE len(w) > 0),
item_shingles AS (SELECT item_id, k, len(w) - k + 1 AS m, array_to_string(w[p:p + k - 1], ' ') AS h FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM i)),
of_item AS (SELECT item_id, k, m, h, count(*) AS c FROM item_shingles GROUP BY ALL),
d AS (SELECT doc_id, {WORDS.format(LOWER.format("text"))} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p, len(w) AS size FROM d),
ks AS (SELECT DISTINCT k FROM i),
shingles AS ({" UNION ALL ".join(f"SELECT doc_id, p, size, {k} AS k, array_to_string(list(x) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING), ' ') AS h FROM words WHERE {k} IN (SELECT k FROM ks)" for k in range(1, 6))}),
hits AS (SELECT s.doc_id, o.item_id, o.k, o.m, o.h, o.c, s.p, s.size - o.k + 1 AS n FROM shingles s JOIN of_item o ON o.k = s.k AND o.h = s.h WHERE s.p <= s.size - s.k + 1),
windows AS (SELECT DISTINCT doc_id, item_id, k, m, n, unnest(range(greatest(p - m + 1, 1), p + 1)) AS s FROM hits),
counts AS (SELECT w.doc_id, w.item_id, w.k, w.m, w.s, least(w.m, w.n - w.s + 1) AS size, least(count(*), any_value(h.c)) AS shared FROM windows w JOIN hits h ON h.doc_id = w.doc_id AND h.item_id = w.item_id AND h.p >= w.s AND h.p < w.s + w.m GROUP BY w.doc_id, w.item_id, w.k, w.m, w.n, w.s, h.h),
judged AS (SELECT doc_id, item_id, k, s, size, sum(shared) / (m + size - sum(shared))::DOUBLE AS similarity FROM counts GROUP BY doc_id, item_id, k, m, s, size),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS r FROM judged WHERE similarity >= 0.8 - 1e-12)
SELECT doc_id, item_id, (s - 1)::INTEGER AS start, (size + k - 1)::INTEGER AS n_words, similarity FROM best WHERE r = 1
"""

_GRAMS = " UNION ALL ".join(f"SELECT lang, array_to_string(list(x) OVER (PARTITION BY lang, piece ORDER BY p ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING), ' ') AS g, {k} AS k, size - p + 1 AS room FROM words" for k in range(1, 6))
COLLOCATIONS = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, {LOWER.format("text")} AS t FROM documents),
pieces AS (SELECT lang, doc, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS t FROM d),
numbered AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(t, '[^\\x20\\x09]+') AS w FROM pieces),
words AS (SELECT lang, piece, unnest(w) AS x, generate_subscripts(w, 1) AS p, len(w) AS size FROM numbered),
n AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f AS (SELECT lang, g, any_value(k) AS k, count(*) AS f FROM ({_GRAMS}) WHERE room >= k GROUP BY lang, g HAVING count(*) >= 100),
often AS (SELECT lang, g, k, f, string_split(g, ' ') AS w FROM f),
around AS (SELECT lang, g, max(f) AS longer FROM (
  SELECT lang, array_to_string(w[:k - 1], ' ') AS g, f FROM often WHERE k > 1 UNION ALL SELECT lang, array_to_string(w[2:], ' ') AS g, f FROM often WHERE k > 1
) GROUP BY lang, g),
kept AS (SELECT o.* FROM often o LEFT JOIN around USING (lang, g) WHERE o.k > 1 AND (longer IS NULL OR 100 * longer < 100 * o.f)),
cuts AS (SELECT lang, g, f AS a, c, array_to_string(w[:c], ' ') AS gl, array_to_string(w[c + 1:], ' ') AS gr FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
scored AS (
  SELECT cuts.lang, cuts.g, a, c, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = gl JOIN f r ON r.lang = cuts.lang AND r.g = gr JOIN n ON n.lang = cuts.lang
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM best)
SELECT lang, rank, g AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOWER.format("text")} AS t FROM documents),
x AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM x GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
langs AS (SELECT lang, count(*) AS V, sum(c)::BIGINT AS N FROM kept GROUP BY lang),
n AS (SELECT x.lang, source, x.term, count(*) AS n FROM x JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT groups.lang, groups.source, coalesce(sum(n), 0)::BIGINT AS N FROM groups LEFT JOIN n USING (lang, source) GROUP BY ALL),
p AS (
  SELECT t.lang, t.source, kept.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 1)) // (t.N + V) AS p
  FROM totals t JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN n ON n.lang = t.lang AND n.source = t.source AND n.term = kept.term
),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (N + V) AS q FROM kept JOIN langs USING (lang)),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM all_pairs UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM terms
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

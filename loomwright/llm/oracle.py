"""SQL for the corpus queries that SQL can express, for whole tables in DuckDB."""

from __future__ import annotations

from .clustering import CLUSTERS, DIMENSIONS, ROUNDS, SCALE, SEED
from .mixing import EPOCHS, GOLDEN, MOST_BLOCK, PARTS, POINT_BITS, SLOTS, WEIGHTS
from .packing import BUCKETS, BUDGET, LONGEST
from .phrases import LEAST, TOP
from .phrases import LONGEST as LONGEST_PHRASE
from .urls import ENDINGS, LOWER, LURES, RULES, TRADES, UPPER

#: Split pattern of words, and the words of a column ``t``.
_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda x: x <> '')"

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_WORDS} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
v AS (SELECT r, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i : i + 7], ' ')) AS n FROM v),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM k WHERE n > 1) GROUP BY r),
c AS (
    SELECT w.r, doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
        len(list_distinct(ws)) AS n_kinds, len(string_split(t, chr(10))) AS n_lines,
        length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS capitals
    FROM w LEFT JOIN p ON p.r = w.r
),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1) AS n FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR n_symbols * 100 > n * 30 OR word_chars < n * 2 OR word_chars > n * 20 OR n_dup_lines * 100 > n_lines * 50
        OR letters * 100 < word_chars * 50 OR capitals * 100 > letters * 60 OR n_kinds * 100 < least(n, 200) * 10) AS kept
FROM f
"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
#: Hosts alone are listed, so that of the canonical form the host is enough: no user info, port or last dot.
URLS = f"""
WITH l AS (SELECT * FROM (VALUES {_RULES}) AS l(h, p, v)),
a AS (SELECT t || d || u || '.' || e AS h FROM (SELECT unnest({list(TRADES)}) AS t), (SELECT unnest({list(LURES)}) AS u), (SELECT unnest(['-', '']) AS d), (SELECT unnest({list(ENDINGS)}) AS e)),
u AS (
    SELECT row_number() OVER () AS r, page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
),
b AS (SELECT r, max(struct_pack(n := length(h || p), v := v, k := h || p)) AS e FROM u JOIN l ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
c AS (SELECT r, string_split(rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.'), '.') AS parts FROM u),
s AS (SELECT r, array_to_string(parts[i:], '.') AS h FROM (SELECT r, parts, unnest(range(1, len(parts) + 1)) AS i FROM c)),
f AS (SELECT r, max(struct_pack(n := length(h), h := h)).h AS h FROM s WHERE h IN (SELECT h FROM a) GROUP BY r)
SELECT page_id, host, path, e.k AS rule, coalesce(e.v, CASE WHEN f.h IS NOT NULL THEN 'block' END, 'allow') AS verdict, CASE WHEN e.k IS NULL THEN f.h END AS listed
FROM u LEFT JOIN b ON b.r = u.r LEFT JOIN f ON f.r = u.r
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT doc_id, {_WORDS} AS ws FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT j.a, j.b FROM j JOIN n p ON p.doc_id = j.a JOIN n q ON q.doc_id = j.b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""

NEIGHBOURS = """
WITH v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0
),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

MIXING = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS s, CAST(len({_WORDS}) AS BIGINT) AS size FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
p AS (SELECT s, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY s NULLS LAST) - 1 AS src FROM d GROUP BY s),
w AS (SELECT *, CAST({list(WEIGHTS)}[src % {len(WEIGHTS)} + 1] AS DOUBLE) AS w FROM p),
q AS (
    SELECT *, sum(size) OVER () AS total, coalesce(sum({EPOCHS} * size) OVER (ORDER BY size / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_words,
        sum(w) OVER (ORDER BY size / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w
),
l AS (SELECT (total - full_words) / rest AS share FROM q WHERE (total - full_words) / rest * w <= {EPOCHS} * size ORDER BY size / w, src LIMIT 1),
g AS (SELECT s, src, size, least(share * w, CAST({EPOCHS} * size AS DOUBLE)) AS target, greatest(1, least({MOST_BLOCK}, (size + {SLOTS - 1}) // {SLOTS})) AS block FROM q, l),
b AS (SELECT *, (size + block - 1) // block AS blocks FROM g),
u AS (SELECT *, CASE WHEN size > 0 AND target > 0 THEN CAST(round(target * blocks / size * {PARTS}) AS BIGINT) ELSE 0 END AS quota FROM b),
e AS (SELECT *, CAST(sum(quota) OVER (ORDER BY src) AS BIGINT) AS q_end, CAST(sum(quota) OVER () AS BIGINT) AS q_all FROM u),
x AS (
    SELECT src, blocks, CAST(floor((q_end - quota) / CAST(q_all AS DOUBLE) * {float(1 << POINT_BITS)}) AS BIGINT) AS lo,
        CASE WHEN q_end = q_all THEN {1 << POINT_BITS} ELSE CAST(floor(q_end / CAST(q_all AS DOUBLE) * {float(1 << POINT_BITS)}) AS BIGINT) END AS hi FROM e WHERE quota > 0
),
i AS (SELECT slot, CAST(CAST(slot AS HUGEINT) * {GOLDEN} % {1 << POINT_BITS} AS BIGINT) AS point FROM (SELECT unnest(range((max(q_all) + {PARTS - 1}) // {PARTS})) AS slot FROM e)),
k AS (SELECT src, blocks, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank FROM i JOIN x ON lo <= point AND point < hi),
n AS (SELECT src, rank % blocks AS block_no, count(*) AS times FROM k WHERE rank < {EPOCHS} * blocks GROUP BY ALL),
o AS (
    SELECT r, doc_id, d.size, u.size AS source_size, u.target, u.src, u.block, coalesce(sum(d.size) OVER (
        PARTITION BY u.src ORDER BY CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 15) AS BIGINT), doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM d JOIN u ON d.s IS NOT DISTINCT FROM u.s
),
t AS (SELECT r, src, size, start, block, unnest(range(CAST(start // block AS BIGINT), CAST((start + size - 1) // block + 1 AS BIGINT))) AS block_no FROM o WHERE size > 0),
v AS (SELECT r, sum((least(start + size, (t.block_no + 1) * block) - greatest(start, t.block_no * block)) * times) AS taken FROM t JOIN n ON n.src = t.src AND n.block_no = t.block_no GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM o LEFT JOIN v ON v.r = o.r
"""

PACKING = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, CAST(len({_WORDS}) AS BIGINT) AS size FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
p AS (SELECT r, doc_id, piece, least({LONGEST}, size - piece * {LONGEST}) AS n FROM (SELECT *, unnest(range(greatest((size + {LONGEST - 1}) // {LONGEST}, 1))) AS piece FROM d)),
h AS (SELECT n, CAST(count(*) AS BIGINT) AS c FROM p WHERE n > 0 GROUP BY n),
l AS (SELECT row_number() OVER (ORDER BY n) AS j, n, CAST(sum(c) OVER (ORDER BY n) AS BIGINT) AS before, CAST(sum(c * n) OVER (ORDER BY n) AS BIGINT) AS tokens FROM h),
z AS (SELECT * FROM l UNION ALL SELECT 0, 0, 0, 0),
m AS (SELECT max(j) AS all_kinds, least({BUCKETS}, max(j)) AS buckets FROM l),
c AS (
    SELECT 0 AS k, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS cost, CAST(0 AS BIGINT) AS came
    UNION ALL
    SELECT k + 1, e.j, min(cost + (e.before - a.before) * e.n - (e.tokens - a.tokens)), arg_min(a.j, struct_pack(x := cost + (e.before - a.before) * e.n - (e.tokens - a.tokens), y := a.j))
    FROM c JOIN z a ON a.j = c.j JOIN l e ON e.j > a.j, m WHERE k < buckets GROUP BY k, e.j
),
b AS (
    SELECT c.k, c.j, c.came FROM c, m WHERE c.k = buckets AND c.j = all_kinds
    UNION ALL
    SELECT c.k, c.j, c.came FROM b JOIN c ON c.k = b.k - 1 AND c.j = b.came WHERE b.k > 1
),
g AS (SELECT l.n AS bucket, coalesce(lag(l.n) OVER (ORDER BY l.n), 0) AS above FROM b JOIN l ON l.j = b.j),
o AS (
    SELECT doc_id, piece, n, bucket, greatest(1, {BUDGET} // bucket) AS hold,
        row_number() OVER (PARTITION BY bucket ORDER BY CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':pack:' || piece), 1, 15) AS BIGINT), doc_id NULLS FIRST, piece, n) - 1 AS place
    FROM p JOIN g ON n > above AND n <= bucket
)
SELECT doc_id, piece, n AS n_tokens, bucket, place // hold AS batch, place % hold AS slot FROM o
UNION ALL SELECT doc_id, piece, n, NULL, NULL, NULL FROM p WHERE n = 0
"""

EXACT = f"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS x FROM documents),
k AS (SELECT doc_id, x, count(*) OVER (PARTITION BY x) AS n, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place FROM t WINDOW w AS (PARTITION BY x ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, n AS group_size, place = 1 AS kept, sha256(x) AS text_sha256 FROM k
"""


def _clusters() -> str:
    """Each round's assignment a<k> and centroids c<k>, as tables that are made once."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS x FROM embeddings "
        f"WHERE embedding IS NOT NULL AND len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS m FROM (SELECT x, sha256('{SEED}' || vec_id) AS h FROM v) ORDER BY h, x LIMIT {CLUSTERS})",
        f"i AS MATERIALIZED (SELECT unnest(range(1, {DIMENSIONS + 1})) AS i)",
    ]
    for k in range(ROUNDS + 1):
        apart = f"list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (x[i] - m[i]) * (x[i] - m[i])))"
        parts.append(f"a{k} AS MATERIALIZED (SELECT row, vec_id, x, min(struct_pack(d := CAST(d AS BIGINT), c := c)) AS b FROM (SELECT row, vec_id, x, c, {apart} AS d FROM v, c{k}) GROUP BY row, vec_id, x)")
        if k < ROUNDS:
            parts.append(
                f"c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(w.m, o.m) AS m FROM c{k} o LEFT JOIN (SELECT c, list(s ORDER BY i) AS m FROM "
                f"(SELECT b.c AS c, i, CAST((sum(x[i]) - (sum(x[i]) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS s FROM a{k}, i GROUP BY b.c, i) GROUP BY c) w ON w.c = o.c)"
            )
    last = f"SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} ON c = b.c"
    return f"WITH {', '.join(parts)} {last}"


CLUSTERED = _clusters()

PHRASES = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS s FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(s, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
    SELECT lang, m, ws[i : i + m - 1] AS ws, count(*) AS f FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, {LONGEST_PHRASE + 1})) AS m) WHERE len(ws) >= m)
    GROUP BY lang, m, ws[i : i + m - 1]
),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT lang, m, ws, f FROM g WHERE f >= {LEAST}),
c AS (
    SELECT lang, ws, f FROM f WHERE m > 1 AND NOT EXISTS (
        SELECT 1 FROM (SELECT lang AS wl, m AS wm, f AS wf, ws[j : j + k - 1] AS part FROM (SELECT *, unnest(range(1, m - k + 2)) AS j FROM (SELECT *, unnest(range(2, m)) AS k FROM f WHERE m > 2))) x
        WHERE wl = f.lang AND part = f.ws AND 100 * wf >= 100 * f.f
    )
),
k AS (SELECT lang, ws, f, unnest(range(1, len(ws))) AS k FROM c),
s AS (
    SELECT k.lang, array_to_string(k.ws, ' ') AS phrase, k.f AS a, n, k, l.f AS l, r.f AS r, CAST((CAST(1000 AS HUGEINT) * k.f * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
    FROM k JOIN n ON n.lang = k.lang JOIN f l ON l.lang = k.lang AND l.ws = k.ws[1 : k] JOIN f r ON r.lang = k.lang AND r.ws = k.ws[k + 1 :]
),
b AS (SELECT lang, phrase, a, n, min(struct_pack(score := score, k := k, l := l, r := r)) AS b FROM s GROUP BY lang, phrase, a, n)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank, phrase, a, b.l AS l, b.r AS r, n, b.score AS score FROM b
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) <= {TOP}
"""

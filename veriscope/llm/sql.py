"""DuckDB SQL of those queries that SQL can express."""

from .license_scan import ANCHOR, BETWEEN, BLOCKS, COMMENT, FILE_NAME, FIRST_LINES, NO_NAME, TEMPLATES, THRESHOLD, TOKEN
from .packing import N_BUCKETS, TOKEN_BUDGET

SPACE = r"[\x20\x09-\x0D]+"

LINE_DEDUP_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.last_doc IS NOT NULL AND k.doc_id < c.last_doc AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS place
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM d GROUP BY source),
w AS (
  SELECT *, CAST((i - 1) % 3 + 1 AS DOUBLE) AS weight, CASE (i - 1) % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS tilt,
         CAST(3 * source_size AS DOUBLE) AS cap, CAST(3 * source_size AS DOUBLE) / CAST((i - 1) % 3 + 1 AS DOUBLE) AS full_at
  FROM s),
f AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT f.*, least(weight * (SELECT arg_min(level, full_at) FROM f WHERE level <= full_at), cap) AS target FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.tilt,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, CAST(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size))
            + greatest(0, least(size, floor(target) - start - 2 * source_size)) AS BIGINT) AS taken FROM p)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN tilt = 0 THEN start / target
            ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (start / target)) - (1 - tilt)) / (2 * tilt) END END AS position
FROM q
"""

PII_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS (SELECT * FROM (VALUES
  (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 80, 'mail|contact|write'),
  (2, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', 60, 'ip|host|server|address'),
  (3, 'card', '[0-9](?:[\x20-]?[0-9])+', 80, 'card|visa|credit|payment|account'),
  (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]', 60, 'phone|tel|call|mobile|fax'),
  (5, 'iban', '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b', 80, 'iban|bank|account|transfer'),
  (6, 'national_id', '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', 40, 'ssn|social security|national id|identity')
  ) AS v(ord, kind, pattern, prior, words)),
r AS (SELECT doc_id, text, ord, kind, prior, words, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS gaps FROM d, k),
u AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM r WHERE len(found) > 0),
s AS (
  SELECT doc_id, text, ord, kind, prior, words, found[i] AS hit, regexp_replace(found[i], '[^0-9]', '', 'g') AS digits,
         CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0) AS BIGINT) AS b
  FROM u),
c AS (
  SELECT *, b + length(hit) AS e, replace(hit, ' ', '') AS packed,
         lower(substring(text, greatest(b - 40, 0) + 1, least(b, 40)) || ' ' || substring(text, b + length(hit) + 1, 40)) AS near
  FROM s),
t AS (
  SELECT *, least(100, prior + CASE WHEN regexp_matches(near, '\b(?:' || words || ')') THEN 20 ELSE 0 END
                 - CASE WHEN regexp_matches(near, '\b(?:version|isbn|order|serial|part no|example)') THEN 20 ELSE 0 END) AS score
  FROM c
  WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(hit, '.'), lambda p: CAST(p AS HUGEINT) <= 255))
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN CAST(digits[-i] AS INT) WHEN CAST(digits[-i] AS INT) > 4 THEN 2 * CAST(digits[-i] AS INT) - 9
             ELSE 2 * CAST(digits[-i] AS INT) END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'iban' THEN length(packed) BETWEEN 15 AND 34 AND list_reduce(
        list_prepend(CAST(0 AS BIGINT), list_transform(string_split(packed[5:] || packed[1:4], ''), lambda x: CAST(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x) - 1 AS BIGINT))),
        lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
    ELSE NOT regexp_matches(hit, '^(?:000|666|9)|-00-|-0000$') END),
f AS (SELECT *, kind || ':' || b || ':' || e AS span FROM t WHERE ord <= 4 OR score >= 60)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
       count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(span, ',' ORDER BY ord, b) FILTER (WHERE ord <= 4), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY ord, b), '') AS spans,
       coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY ord, b), '') AS scores
FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""

EMBEDDING_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id, vec_id <= coalesce(c.low, vec_id) AS kept
FROM embeddings LEFT JOIN k ON vec_id = k.a LEFT JOIN c ON vec_id = c.a
"""



def _plain(pattern: str) -> str:
    """A pattern without possessive marks, which change no match here, and quoted for SQL."""
    return pattern.replace("*+", "*").replace("++", "+").replace("'", "''")


def _matching(p: str, templates: list[tuple[str, str]]) -> str:
    """Tables that find the best template of each row of {p}c(lid, line), all named with the prefix."""
    rows = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(templates))
    return f"""
{p}t AS (SELECT * FROM (VALUES {rows}) AS v(tid, name, body)),
{p}tt AS (SELECT tid, name, token, count(*) AS n FROM (SELECT tid, name, unnest(regexp_extract_all(lower(body), '{TOKEN}')) AS token FROM {p}t) GROUP BY ALL),
{p}vocab AS (SELECT DISTINCT token FROM {p}tt),
{p}lt AS (SELECT lid, token, count(*) AS n FROM (SELECT lid, unnest(regexp_extract_all(lower(line), '{TOKEN}')) AS token FROM {p}c) GROUP BY ALL),
{p}total AS (SELECT (SELECT count(*) FROM {p}c) + (SELECT count(*) FROM {p}t) AS n),
{p}seen AS (SELECT token, count(*) AS n FROM (SELECT token FROM {p}lt UNION ALL SELECT token FROM {p}tt) GROUP BY token),
{p}idf AS (SELECT token, ln((1 + (SELECT n FROM {p}total)) / (1 + n)::DOUBLE) + 1 AS w FROM {p}vocab JOIN {p}seen USING (token)),
{p}tw AS (SELECT tid, name, token, q.n * w / sqrt(sum(q.n * w * q.n * w) OVER (PARTITION BY tid)) AS w FROM {p}tt q JOIN {p}idf USING (token)),
{p}norm AS (SELECT lid, sqrt(sum(CASE WHEN i.w IS NULL THEN pow(ln(1 + (SELECT n FROM {p}total)) + 1, 2) ELSE pow(q.n * i.w, 2) END)) AS norm FROM {p}lt q LEFT JOIN {p}idf i ON q.token = i.token GROUP BY lid),
{p}s AS (SELECT q.lid, w.name, w.tid, round(sum(q.n * i.w * w.w) / any_value(z.norm), 6) AS score FROM {p}lt q JOIN {p}idf i ON q.token = i.token JOIN {p}tw w ON q.token = w.token JOIN {p}norm z ON q.lid = z.lid GROUP BY ALL),
{p}b AS (SELECT lid, score, name FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY score DESC, name) AS i FROM {p}s) WHERE i = 1 AND score >= {THRESHOLD}),"""


LICENSE_SQL = f"""
WITH d AS (SELECT doc_id, text, concat_ws('/', coalesce(source, '{NO_NAME}'), coalesce(lang, '{NO_NAME}'), coalesce(CAST(doc_id // 64 AS VARCHAR), '{NO_NAME}'), coalesce(CAST(doc_id AS VARCHAR), '{NO_NAME}')) AS path FROM documents),
lc AS (SELECT row_number() OVER () AS lid, doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{ANCHOR}')),
g AS (SELECT doc_id, text, CASE WHEN regexp_extract(text, '{_plain(COMMENT)}', 1) <> '' THEN regexp_extract(text, '{_plain(COMMENT)}', 1) ELSE regexp_extract(text, '{_plain(FIRST_LINES)}', 1) END AS lead,
             regexp_split_to_array(text, '{_plain(BETWEEN)}') AS parts FROM d WHERE regexp_matches(text, '{ANCHOR}')),
bc AS (SELECT row_number() OVER () AS lid, doc_id, line, whole FROM (SELECT doc_id, line, bool_or(line = text) AS whole FROM (SELECT doc_id, text, unnest(list_concat([lead, text], parts)) AS line FROM g) GROUP BY doc_id, line) WHERE regexp_matches(line, '{ANCHOR}')),
{_matching("l", TEMPLATES)}{_matching("b", BLOCKS)}
m AS (SELECT doc_id, score, name, length(line) AS chars, 1 AS n, false AS whole FROM lb JOIN lc ON lb.lid = lc.lid
      UNION ALL SELECT doc_id, score, name, 0, 0, whole FROM bb JOIN bc ON bb.lid = bc.lid),
h AS (SELECT doc_id, max(score) AS score, min(name) FILTER (WHERE score = top) AS license, CAST(sum(n) AS BIGINT) AS n, sum(chars) AS covered, bool_or(whole) AS whole
      FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM m) GROUP BY doc_id),
f AS (SELECT d.doc_id, d.path, regexp_extract(d.path, '^(.*)/[^/]*$', 1) AS dir, h.score, h.license, coalesce(h.n, 0) AS n,
             h.n IS NOT NULL AND (h.whole OR regexp_matches(regexp_extract(d.path, '([^/]*)$', 1), '{FILE_NAME}') OR 2 * h.covered >= length(d.text)) AS is_file
      FROM d LEFT JOIN h ON d.doc_id = h.doc_id),
o AS (SELECT dir AS own, score, license FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) AS i FROM f WHERE is_file) WHERE i = 1),
a AS (SELECT dir, o.score, o.license FROM (SELECT DISTINCT dir FROM f) JOIN o ON dir = own OR own = '' OR starts_with(dir, own || '/')
      QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(own) DESC) = 1)
SELECT doc_id, path, coalesce(f.license, a.license) AS license, coalesce(f.score, a.score) AS score,
       CASE WHEN f.license IS NOT NULL THEN 'header' WHEN a.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, n AS n_header_lines
FROM f LEFT JOIN a ON f.dir = a.dir
"""

#: One layer of the dynamic program for each further bucket: the cheapest way to end at each length.
_LAYERS = ",\n".join(
    f"""b{k} AS (SELECT e.j, min(struct_pack(c := p.v.c + e.len * (e.cn - p.cn) - (e.cs - p.cs), i := p.j, b := list_append(p.v.b, e.len))) AS v, any_value(e.cn) AS cn, any_value(e.cs) AS cs
     FROM b{k - 1} p JOIN h e ON p.j < e.j GROUP BY e.j)"""
    for k in range(2, N_BUCKETS + 1)
)

PACKING_SQL = rf"""
WITH d AS (SELECT doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key, CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS length FROM documents),
g AS (SELECT length AS len, count(*) AS n FROM d GROUP BY length),
h AS (SELECT row_number() OVER w AS j, len, CAST(sum(n) OVER w AS BIGINT) AS cn, CAST(sum(n * len) OVER w AS BIGINT) AS cs FROM g WINDOW w AS (ORDER BY len ROWS UNBOUNDED PRECEDING)),
b1 AS (SELECT j, struct_pack(c := len * cn - cs, i := CAST(0 AS BIGINT), b := [len]) AS v, cn, cs FROM h),
{_LAYERS},
o AS (SELECT v FROM ({" UNION ALL ".join(f"SELECT {k} AS k, j, v FROM b{k}" for k in range(1, N_BUCKETS + 1))}) WHERE j = (SELECT max(j) FROM h) ORDER BY v.c, k LIMIT 1),
x AS (SELECT d.*, o.v.b AS bounds, len(list_filter(o.v.b, lambda u: u < d.length)) AS bucket FROM d, o),
y AS (SELECT *, bounds[bucket + 1] AS bound, row_number() OVER (PARTITION BY bucket ORDER BY key, doc_id, length) AS i FROM x)
SELECT doc_id, length, CAST(bucket AS INTEGER) AS bucket, bound, CAST((i - 1) // greatest(1, {TOKEN_BUDGET} // greatest(bound, 1)) AS BIGINT) AS batch, bound - length AS padding FROM y
"""

FILL_MIDDLE_SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
        sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
    FROM documents),
h AS (
    SELECT *, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
        CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 AS h4
    FROM t),
p AS (
    SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
        coalesce(array_to_string(u[1 : least(c1, c2)], ''), '') AS pre, coalesce(array_to_string(u[least(c1, c2) + 1 : greatest(c1, c2)], ''), '') AS mid, coalesce(array_to_string(u[greatest(c1, c2) + 1 :], ''), '') AS suf
    FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""

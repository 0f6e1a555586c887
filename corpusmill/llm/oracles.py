"""DuckDB SQL of the queries."""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, (k // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM d
"""

SUBSTRINGS = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
pos AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
covered AS (SELECT p.rid, p.i, p.x, max(r.i) OVER (PARTITION BY p.rid ORDER BY p.i ROWS UNBOUNDED PRECEDING) AS prev FROM pos p LEFT JOIN rep r USING (rid, i)),
k AS (SELECT rid, count(*) FILTER (prev IS NOT NULL AND i - prev < 35) AS gone, string_agg(x, ' ' ORDER BY i) FILTER (prev IS NULL OR i - prev >= 35) AS kept FROM covered GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS s
      FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
x AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g))),
hit AS (SELECT rid, i, n, item FROM x JOIN g USING (n, s)),
c AS (SELECT rid, count(DISTINCT i) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS i FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

SECRETS = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT rid, 'assign' AS kind, 0 AS rank, regexp_extract_all(t, '((?i)password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS x,
        regexp_extract_all(t, '((?i)password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS g,
        string_split_regex(t, '((?i)password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gap FROM d
      UNION ALL SELECT rid, 'access', 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
      UNION ALL SELECT rid, 'hex', 2, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM d
      UNION ALL SELECT rid, 'entropy', 3, regexp_extract_all(t, '[A-Za-z0-9+/_=-]+'), regexp_extract_all(t, '[A-Za-z0-9+/_=-]+'), string_split_regex(t, '[A-Za-z0-9+/_=-]+') FROM d),
m AS (SELECT rid, kind, rank, x[k] AS x, g[k] AS g, sum(length(gap[k]) + CASE WHEN k > 1 THEN length(x[k - 1]) ELSE 0 END) OVER (PARTITION BY rid, rank ORDER BY k) AS s
      FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM a)),
base AS (SELECT rid, kind, rank, s, s + length(x) AS e FROM m
         WHERE (kind = 'assign' AND length(g) >= 12) OR (kind = 'access' AND length(x) >= 18) OR (kind = 'hex' AND length(x) >= 16)),
c AS (SELECT row_number() OVER () AS cid, rid, s, x, regexp_replace(x, '0123456789|abcdefghij|ABCDEFGHIJ', 'aaaaaaaaaa', 'g') AS y,
        CASE WHEN regexp_full_match(x, '[0-9a-fA-F]+') THEN 3.2 ELSE 3.9 END::DOUBLE AS bits FROM m
      WHERE kind = 'entropy' AND length(x) >= 20 AND NOT regexp_full_match(x, '[A-Za-z]+|[a-z]+([_/-]+[a-z]+)*[0-9]{0,4}|[0-9]+([_/-][0-9]+)*|[=_+/-]+')
        AND NOT regexp_full_match(x, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')),
h AS (SELECT cid, min(i) AS a, max(i) AS z FROM (SELECT cid, y, bits, unnest(range(0, length(y) - 19)) AS i FROM c)
      WHERE list_aggregate(string_split(substr(y, (i + 1)::INT, 20), ''), 'entropy') >= bits GROUP BY cid),
every AS (SELECT * FROM base UNION ALL SELECT rid, 'entropy', 3, s + a, s + z + 20 FROM c JOIN h USING (cid)),
r AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n1, count(*) FILTER (kind = 'access') AS n2, count(*) FILTER (kind = 'hex') AS n3,
        string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank, e) FILTER (rank < 3) AS b,
        string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank, e) AS spans FROM every GROUP BY rid)
SELECT doc_id, coalesce(n1, 0)::BIGINT AS n_assign, coalesce(n2, 0)::BIGINT AS n_access, coalesce(n3, 0)::BIGINT AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (rid)
"""

SUFFIXES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT rid, i, md5_number(substr(h, 2 * i + 1, 400)) AS w FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d)),
rep AS (SELECT rid, i FROM win JOIN (SELECT w FROM win GROUP BY w HAVING count(*) > 1) USING (w)),
edge AS (SELECT rid, i, i + 200 AS z, max(i + 200) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM rep),
run AS (SELECT rid, min(i) AS a, max(z) AS z FROM (SELECT rid, i, z, sum((prev IS NULL OR i > prev)::INT) OVER (PARTITION BY rid ORDER BY i) AS g FROM edge) GROUP BY rid, g),
kept AS (SELECT rid, h, n, gone, list_aggregate(list_transform(range(0, n + 1), lambda k: substr(h, 2 * (CASE WHEN k = 0 THEN 0 ELSE zs[k] END)::BIGINT + 1,
    2 * ((CASE WHEN k = n THEN length(h) // 2 ELSE starts[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE zs[k] END))::BIGINT)), 'string_agg', '') AS rest
  FROM (SELECT rid, h, count(a) AS n, coalesce(sum(z - a), 0)::BIGINT AS gone, list(a ORDER BY a) FILTER (a IS NOT NULL) AS starts, list(z ORDER BY a) FILTER (a IS NOT NULL) AS zs
        FROM d LEFT JOIN run USING (rid) GROUP BY rid, h))
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, gone AS n_removed, n::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM d JOIN kept USING (rid)
"""

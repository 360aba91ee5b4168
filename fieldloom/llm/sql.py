"""SQL of those text queries that DuckDB can state over whole tables."""

_PAIRS = r"""
WITH d AS (SELECT DISTINCT app_id, description FROM developments WHERE app_id IS NOT NULL AND description IS NOT NULL),
w AS (SELECT app_id, word, row_number() OVER (PARTITION BY app_id, word) AS k FROM (SELECT app_id, unnest(regexp_extract_all(lower(description), '[\pL\pN]+')) AS word FROM d)),
n AS (SELECT app_id, count(*) AS n FROM w GROUP BY app_id),
met AS (SELECT a.app_id AS x, b.app_id AS y, count(*) AS s FROM w a JOIN w b ON a.word = b.word AND a.k = b.k AND a.app_id < b.app_id GROUP BY 1, 2)
SELECT x AS app_id_a, y AS app_id_b FROM met JOIN n nx ON nx.app_id = x JOIN n ny ON ny.app_id = y WHERE 2.0 * s / (nx.n + ny.n) >= 0.88 - 1e-12
"""
_LINKS = r"""
WITH d AS (SELECT DISTINCT app_id, list_sort(regexp_extract_all(lower(description), '[\pL\pN]+')) AS bag FROM developments WHERE app_id IS NOT NULL AND description IS NOT NULL),
c AS (SELECT bag, min(app_id) AS class_id, count(*) AS class_size, row_number() OVER () AS c FROM d WHERE len(bag) > 0 GROUP BY bag),
w AS (SELECT c, word, row_number() OVER (PARTITION BY c, word) AS k FROM (SELECT c, unnest(bag) AS word FROM c)),
n AS (SELECT c, count(*) AS n FROM w GROUP BY c),
met AS (SELECT a.c AS x, b.c AS y, count(*) AS s FROM w a JOIN w b ON a.word = b.word AND a.k = b.k AND a.c <> b.c GROUP BY 1, 2),
links AS (SELECT x, count(*) AS n_links FROM met JOIN n nx ON nx.c = x JOIN n ny ON ny.c = y WHERE 2.0 * s / (nx.n + ny.n) >= 0.88 - 1e-12 GROUP BY x)
SELECT d.app_id, c.class_id, c.class_size, coalesce(l.n_links, 0) AS n_links FROM d JOIN c ON c.bag = d.bag LEFT JOIN links l ON l.x = c.c
"""
_SPIKES = r"""
WITH t AS (SELECT DISTINCT app_id, lower(trim(coalesce(authority, ''))) AS source, length(description) AS c, strlen(description) AS b FROM developments WHERE app_id IS NOT NULL AND trim(description) <> ''),
h AS (SELECT source, 'chars' AS measure, c AS length, count(*) AS n_at FROM t GROUP BY 1, 3 UNION ALL SELECT source, 'bytes', b, count(*) FROM t GROUP BY 1, 3),
g AS (SELECT *, CAST(sum(n_at) OVER (PARTITION BY source, measure ORDER BY length RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) - n_at AS BIGINT) AS n_near, length = max(length) OVER (PARTITION BY source, measure) AS at_top FROM h)
SELECT source, measure, CAST(length AS INTEGER) AS length, n_at, n_near, at_top FROM g
WHERE n_at >= 4.0 * n_near / CASE WHEN at_top THEN 25 ELSE 50 END AND n_at >= CASE WHEN at_top THEN 3 ELSE 10 END
"""

_SPIKE_CTES, _SPIKE_ROWS = _SPIKES.strip().split("\nSELECT ", 1)
# What ends without a stop: white space, dashes and marks of omission at the end are passed over, and abbreviations' stops don't count.
_LIMIT_SUSPECTS = (
    _SPIKE_CTES
    + ",\nspike AS (SELECT "
    + _SPIKE_ROWS
    + r"""),
v AS (SELECT DISTINCT app_id, lower(trim(coalesce(authority, ''))) AS source, length(description) AS c, strlen(description) AS b, trim(regexp_replace(description, '\s+', ' ', 'g')) AS s FROM developments WHERE app_id IS NOT NULL AND trim(description) <> ''),
e AS (SELECT *, regexp_matches(s, '(?:…|\.\.\.|\[|\x{FFFD}|[\pL\pN][-–—])$') AS marker, regexp_replace(s, '[\s…\[\x{FFFD}–—-]+$', '') AS z FROM v),
w AS (SELECT *, list_last(string_split(z, ' ')) AS last FROM e WHERE z <> '')
SELECT DISTINCT app_id, w.source FROM w JOIN spike k ON k.source = w.source AND k.length = CASE k.measure WHEN 'chars' THEN w.c ELSE w.b END
WHERE marker OR NOT regexp_matches(last, '[.!?]["\x27)\]]*$') OR lower(last) IN ('no.', 'nos.', 'approx.', 'incl.', 'ref.', 'st.', 'co.', 'dr.', 'mr.', 'mrs.')
"""
)

SQL: dict[str, str] = {"p3_found": _PAIRS, "p3_links": _LINKS, "p5_spikes": _SPIKES, "p5_limit_suspects": _LIMIT_SUSPECTS}

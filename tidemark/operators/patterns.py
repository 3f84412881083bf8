"""Pattern mining: attribute statistics, information gain, dependencies, bands, closed sets, prefixes, shapes."""

from tidemark.plans.dialect import plan

plan("attr_registry_stats", """
WITH a AS (SELECT system, 'token' AS attr, token AS v FROM {obs} o UNION ALL SELECT system, 'object' AS attr, CAST(object_id AS STRING) AS v FROM {obs} o UNION ALL SELECT system, 'status' AS attr, CAST(status AS STRING) AS v FROM {obs} o)
SELECT system, attr, COUNT(*) AS n, COUNT(DISTINCT v) AS card, MIN(v) AS low, MAX(v) AS high FROM a GROUP BY system, attr""")

plan("info_gain_attr", """
WITH c AS (SELECT token, object_id % 10 AS g, CAST(COUNT(*) AS DOUBLE) AS c FROM {obs} o GROUP BY token, object_id % 10), n AS (SELECT SUM(c) AS n FROM c), b AS (SELECT token, SUM(c) AS c FROM c GROUP BY token), h AS (SELECT g, SUM(c) AS c FROM c GROUP BY g)
SELECT ROUND(SUM(c.c / n * LOG2(c.c * n / (b.c * h.c))) - (COUNT(DISTINCT c.token) - 1) * (COUNT(DISTINCT c.g) - 1) * LOG2(MAX(n)) / (2 * MAX(n)), 6) AS gain FROM c CROSS JOIN n JOIN b ON b.token = c.token JOIN h ON h.g = c.g""")

plan("g3_redundancy", """
WITH c AS (SELECT object_id, token, COUNT(*) AS c FROM {obs} o GROUP BY object_id, token), m AS (SELECT object_id, MAX(c) AS m, SUM(c) AS n FROM c GROUP BY object_id) SELECT ROUND(1 - CAST(SUM(m) AS DOUBLE) / SUM(n), 6) AS g3 FROM m""")

plan("mdl_split_gain", """
WITH c AS (SELECT system, token, CAST(COUNT(*) AS DOUBLE) AS c FROM {obs} o GROUP BY system, token), s AS (SELECT system, SUM(c) AS n FROM c GROUP BY system), t AS (SELECT token, SUM(c) AS c FROM c GROUP BY token), n AS (SELECT SUM(c) AS n FROM c),
leaf AS (SELECT SUM(c.c * LOG2(s.n / c.c)) AS bits FROM c JOIN s ON c.system = s.system), root AS (SELECT SUM(t.c * LOG2(n.n / t.c)) AS bits FROM t CROSS JOIN n)
SELECT ROUND(root.bits - leaf.bits - 2 * LOG2(3e0), 4) AS gain_bits FROM root CROSS JOIN leaf""")

plan("approx_fd_bindings", """
WITH c AS (SELECT p_brand AS x, p_type AS y, COUNT(*) AS c FROM {part} p GROUP BY p_brand, p_type), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY x ORDER BY c DESC, y) AS k, SUM(c) OVER (PARTITION BY x) AS n FROM c)
SELECT x, y, c, CAST(n AS BIGINT) AS n, ROUND((c + 0.5e0) / (n + 1), 6) AS bound_share FROM k WHERE k = 1""")

plan("reverse_binding", "SELECT p_type AS y, COUNT(DISTINCT p_brand) AS brands, COUNT(*) AS parts FROM {part} p GROUP BY p_type HAVING COUNT(*) >= 2")

plan("value_history_rename", """
WITH f AS (SELECT object_id, MIN(day) AS first_day, MAX(day) AS last_day FROM {obs} o WHERE token = 'signup' GROUP BY object_id HAVING COUNT(*) >= 2),
a AS (SELECT object_id, last_day + 1 AS next_day, 1 AS gap FROM f UNION ALL SELECT object_id, last_day + 2 AS next_day, 2 AS gap FROM f)
SELECT a.object_id AS old_value, b.object_id AS new_value, CAST(gap AS BIGINT) AS gap FROM a JOIN f b ON b.first_day = a.next_day""")

plan("numeric_bands", "SELECT token, COUNT(*) AS n, ROUND(PERCENTILE(up, 0.01), 6) AS q01, ROUND(PERCENTILE(up, 0.5), 6) AS q50, ROUND(PERCENTILE(up, 0.99), 6) AS q99 FROM {obs} o GROUP BY token")

plan("closed_value_set", """
WITH c AS (SELECT system, token, COUNT(*) AS c FROM {obs} o GROUP BY system, token), k AS (SELECT system, token, c / CAST(SUM(c) OVER (PARTITION BY system) AS DOUBLE) AS share, SUM(CASE WHEN c = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY system) AS n1, SUM(c) OVER (PARTITION BY system) AS n FROM c)
SELECT system, COUNT(*) AS members, ROUND(MIN(share), 6) AS rarest, CASE WHEN MAX((n1 + 0.5e0) / (n + 1)) < MIN(share) THEN 1 ELSE 0 END AS closed FROM k GROUP BY system""")

plan("required_keys", "SELECT token, COUNT(*) AS n, ROUND(AVG(CASE WHEN object_id IS NOT NULL THEN 1e0 ELSE 0e0 END), 6) AS has_object, ROUND(AVG(CASE WHEN up IS NOT NULL THEN 1e0 ELSE 0e0 END), 6) AS has_value FROM {obs} o GROUP BY token")

plan("hhh_prefix_rollup", """
WITH n AS (SELECT CAST(FLOOR(peer / 10e0) AS BIGINT) AS p1, CAST(FLOOR(peer / 100e0) AS BIGINT) AS p2, SUM(w) AS n FROM {flow} f GROUP BY CAST(FLOOR(peer / 10e0) AS BIGINT), CAST(FLOOR(peer / 100e0) AS BIGINT)), t AS (SELECT SUM(n) AS t FROM n)
SELECT 1 AS level, p1 AS prefix, CAST(n AS BIGINT) AS mass FROM n CROSS JOIN t WHERE n >= 0.02 * t UNION ALL SELECT 2 AS level, p2 AS prefix, CAST(SUM(n) AS BIGINT) AS mass FROM n GROUP BY p2""")

plan("negative_statements_anti", """
WITH e AS (SELECT DISTINCT entity FROM {obs} o), v AS (SELECT DISTINCT token FROM {obs} o) SELECT e.entity, v.token FROM e CROSS JOIN v LEFT ANTI JOIN (SELECT DISTINCT entity, token FROM {obs} o) s ON s.entity = e.entity AND s.token = v.token""".replace("LEFT ANTI JOIN (SELECT DISTINCT entity, token FROM {obs} o) s ON s.entity = e.entity AND s.token = v.token", "WHERE NOT EXISTS (SELECT 1 FROM {obs} s WHERE s.entity = e.entity AND s.token = v.token)"))

plan("shape_grammar_counts", """
WITH s AS (SELECT doc_id, GSUB(GSUB(url_like, '[0-9]+', '9'), '[a-z]+', 'a') AS shape FROM (SELECT page_id AS doc_id, LOWER(url) AS url_like FROM {pages} p) u)
SELECT shape, COUNT(*) AS n FROM s GROUP BY shape""")

plan("popular_objects", "SELECT object_id, COUNT(*) AS n, COUNT(DISTINCT entity) AS entities, ROUND(AVG(up), 6) AS mean_up FROM {obs} o GROUP BY object_id HAVING COUNT(*) >= 5")

plan("when_density_hdr", """
WITH n AS (SELECT system, slot, COUNT(*) AS n FROM {obs} o GROUP BY system, slot), p AS (SELECT system, slot, (n + 0.5e0 / 96) / (SUM(n) OVER (PARTITION BY system) + 0.5e0) AS p FROM n)
SELECT system, slot, ROUND(p, 8) AS density, ROUND(SUM(p) OVER (PARTITION BY system ORDER BY p, slot ROWS UNBOUNDED PRECEDING), 6) AS hdr_p FROM p""")

plan("hierarchical_dirichlet", """
WITH c AS (SELECT system, entity, token, COUNT(*) AS c FROM {obs} o GROUP BY system, entity, token), g AS (SELECT token, SUM(c) / CAST(SUM(SUM(c)) OVER () AS DOUBLE) AS p FROM c GROUP BY token), n AS (SELECT entity, SUM(c) AS n FROM c GROUP BY entity)
SELECT c.entity, c.token, ROUND((c.c + 3 * g.p) / (n.n + 3), 6) AS p FROM c JOIN g ON c.token = g.token JOIN n ON n.entity = c.entity""")

plan("windows_dense_slots", """
WITH n AS (SELECT system, slot, COUNT(*) AS n FROM {obs} o GROUP BY system, slot), m AS (SELECT system, AVG(n) AS mu FROM n GROUP BY system), d AS (SELECT n.system, slot, n, slot - ROW_NUMBER() OVER (PARTITION BY n.system ORDER BY slot) AS island FROM n JOIN m ON n.system = m.system WHERE n >= mu)
SELECT system, MIN(slot) AS opens, MAX(slot) AS closes, CAST(SUM(n) AS BIGINT) AS n FROM d GROUP BY system, island""")

"""Store and API read queries: snapshots, latest values, tails, as-of lookups, timelines, retention, facets."""

from tidemark.plans.dialect import plan

plan("snapshot_wide", "SELECT entity, MAX_BY(token, us) AS last_token, MAX_BY(object_id, us) AS last_object, ROUND(MAX_BY(up, us), 6) AS last_up, ROUND(MAX(t), 3) AS last_ts FROM {obs} o GROUP BY entity")

plan("latest_fresh", """
WITH e AS (SELECT MAX(t) AS now FROM {obs} o), l AS (SELECT system, entity, MAX(t) AS last_t FROM {obs} o GROUP BY system, entity)
SELECT system, entity, ROUND(now - last_t, 3) AS age_s FROM l CROSS JOIN e WHERE now - last_t <= 86400""")

plan("tail_n", """
WITH k AS (SELECT entity, event_id, ROUND(t, 3) AS ts, token, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY t DESC, event_id DESC) AS k FROM {obs} o)
SELECT entity, event_id, ts, token, CAST(k AS BIGINT) AS k FROM k WHERE k <= 5""")

plan("asof_checkpoint", """
WITH k AS (SELECT entity, id, day, MAX(NAMED_STRUCT('day', day, 'id', id)) OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {ord} o)
SELECT entity, id, day, b.id AS before_id, day - b.day AS age_days FROM k""", """
WITH o AS (SELECT entity, id, day FROM {ord} o)
SELECT a.entity, a.id, a.day, ARG_MAX(b.id, b.day * 1000000000 + b.id) AS before_id, a.day - MAX(b.day) AS age_days FROM o a LEFT JOIN o b ON a.entity = b.entity AND b.day < a.day GROUP BY a.entity, a.id, a.day""")

plan("timeline_union_band_change", """
WITH d AS (SELECT entity, day, COUNT(*) AS n FROM {obs} o GROUP BY entity, day), b AS (SELECT entity, day, CASE WHEN n >= 6 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS band FROM d),
c AS (SELECT *, LAG(band) OVER (PARTITION BY entity ORDER BY day) AS before FROM b),
e AS (SELECT entity, day, 'error' AS kind, CAST(COUNT(*) AS STRING) AS detail FROM {obs} o WHERE status >= 500 GROUP BY entity, day)
SELECT entity, day, 'band' AS kind, COALESCE(before, 'none') || '>' || band AS detail FROM c WHERE before IS NULL OR before <> band UNION ALL SELECT entity, day, kind, detail FROM e""")

plan("retention_prefix_rule", """
WITH e AS (SELECT MAX(day) AS today FROM {obs} o), r AS (SELECT token, CASE WHEN token LIKE 's%' OR token LIKE 'p%' THEN 20 WHEN token LIKE 'e%' THEN 14 ELSE 7 END AS keep_days, day FROM {obs} o)
SELECT token, COUNT(*) AS kept, MIN(day) AS oldest FROM r CROSS JOIN e WHERE day > today - keep_days GROUP BY token""")

plan("entities_ranked", """
WITH n AS (SELECT system, entity, COUNT(*) AS n, CAST(SUM(CASE WHEN status >= 500 THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM {obs} o GROUP BY system, entity),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY system ORDER BY errors DESC, n DESC, entity) AS place FROM n)
SELECT system, CAST(place AS BIGINT) AS place, entity, n, errors FROM k WHERE place <= 20""")

plan("facet_counts_before_limit", """
WITH m AS (SELECT * FROM {obs} o WHERE up > 20) SELECT 'token' AS facet, token AS value, COUNT(*) AS n FROM m GROUP BY token
UNION ALL SELECT 'system' AS facet, system AS value, COUNT(*) AS n FROM m GROUP BY system UNION ALL SELECT 'status' AS facet, CAST(status AS STRING) AS value, COUNT(*) AS n FROM m GROUP BY status""")

plan("range_downsample", "SELECT system, day, slot, COUNT(*) AS n, ROUND(MIN(up), 6) AS low, ROUND(MAX(up), 6) AS high, ROUND(AVG(up), 6) AS mean FROM {obs} o WHERE day BETWEEN 19730 AND 19745 GROUP BY system, day, slot")

plan("entity_overview", """
SELECT system, entity, ROUND(MIN(t), 3) AS first_seen, ROUND(MAX(t), 3) AS last_seen, COUNT(*) AS n, COUNT(DISTINCT day) AS active_days, COUNT(DISTINCT token) AS tokens FROM {obs} o GROUP BY system, entity""")

plan("order_status_board", "SELECT priority, state, COUNT(*) AS orders, ROUND(AVG(amount), 6) AS mean_amount, MIN(day) AS first_day, MAX(day) AS last_day FROM {ord} o GROUP BY priority, state")

plan("label_join_latest", """
SELECT d.source, COUNT(*) AS labelled, CAST(SUM(l.toxic) AS BIGINT) AS toxic, CAST(SUM(l.quality) AS BIGINT) AS good FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source""")

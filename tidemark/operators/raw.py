"""Raw metrics: one aggregation per tick, system and entity. Weights are record counts; a metric whose base
weight is zero is NULL. Flow observations come from `lineitem` (day ticks), request observations from `events`."""

from tidemark.plans.dialect import plan

plan("raw_l4_flow_metrics", """
SELECT system, entity, day, SUM(w) AS flows, ROUND(SUM(w * up), 2) AS bytes_up, ROUND(SUM(w * down), 4) AS bytes_down,
       CASE WHEN SUM(w * down) > 0 THEN ROUND(SUM(w * up) / SUM(w * down), 6) WHEN SUM(w * up) > 0 THEN ROUND(SUM(w * up), 6) ELSE 0e0 END AS updown_ratio,
       COUNT(DISTINCT peer) AS distinct_peers, COUNT(DISTINCT CASE WHEN dport BETWEEN 1 AND 65535 THEN dport END) AS distinct_dports,
       CAST(SUM(CASE WHEN flag = 'R' THEN w ELSE 0 END) AS BIGINT) AS syn_count,
       ROUND(SUM(CASE WHEN flag = 'A' THEN w ELSE 0 END) / CAST(SUM(w) AS DOUBLE), 6) AS retransmit_rate
FROM {flow} f WHERE w > 0 GROUP BY system, entity, day""".replace("SUM(w) AS flows", "CAST(SUM(w) AS BIGINT) AS flows"))

plan("raw_proto_ratio", """
SELECT system, day, ROUND(CAST(SUM(CASE WHEN proto = 'O' THEN w ELSE 0 END) AS DOUBLE) / SUM(w), 6) AS tcp_ratio,
       ROUND(CAST(SUM(CASE WHEN proto = 'F' THEN w ELSE 0 END) AS DOUBLE) / SUM(w), 6) AS udp_ratio, MIN(dport) AS ttl_min
FROM {flow} f WHERE w > 0 GROUP BY system, day""")

plan("raw_http_status_mix", """
SELECT system, entity, day, COUNT(*) AS requests, CAST(SUM(CASE WHEN status < 300 THEN 1 ELSE 0 END) AS BIGINT) AS status_2xx,
       CAST(SUM(CASE WHEN status >= 500 THEN 1 ELSE 0 END) AS BIGINT) AS status_5xx, CAST(SUM(is_write) AS BIGINT) AS write_count,
       ROUND(AVG(up), 6) AS req_bytes_avg, ROUND(CAST(SUM(is_write) AS DOUBLE) / COUNT(*), 6) AS write_ratio,
       COUNT(DISTINCT object_id) AS distinct_paths, ROUND(AVG(CASE WHEN up > 0 THEN up END), 6) AS latency_ms_avg
FROM {obs} o GROUP BY system, entity, day""")

plan("raw_weighted_counts", """
SELECT system, entity, CAST(SUM(w) AS BIGINT) AS mass, ROUND(SUM(w * up) / SUM(w), 6) AS up_weighted_avg,
       ROUND(SUM(CASE WHEN down > 0 THEN w * down END) / SUM(CASE WHEN down > 0 THEN w END), 6) AS down_weighted_avg
FROM {flow} f WHERE w > 0 GROUP BY system, entity""")

plan("raw_probe_state_latest", """
SELECT system, entity, COUNT(*) AS probes,
       ROUND(SUM(CASE token WHEN 'view' THEN 1e0 WHEN 'click' THEN 0.5e0 WHEN 'purchase' THEN 0.2e0 ELSE 0e0 END) / COUNT(*), 6) AS reachable,
       ROUND(CAST(SUM(CASE WHEN token IN ('signup', 'error') THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 6) AS loss_ratio,
       MAX(object_id) AS hop_count, MAX_BY(token, us * 1000000 + event_id) AS state
FROM {obs} o GROUP BY system, entity""".replace("us * 1000000 + event_id", "us"))

plan("raw_top64_other_set", """
WITH n AS (SELECT system, day, peer, CAST(SUM(w) AS BIGINT) AS n FROM {flow} f GROUP BY system, day, peer),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY system, day ORDER BY n DESC, peer) AS k FROM n)
SELECT system, day, CASE WHEN k <= 64 THEN CAST(peer AS STRING) ELSE '__other__' END AS peer, CAST(SUM(n) AS BIGINT) AS n
FROM r GROUP BY system, day, CASE WHEN k <= 64 THEN CAST(peer AS STRING) ELSE '__other__' END""")

plan("raw_distinct_peers", """
SELECT system, COUNT(DISTINCT peer) AS peers, COUNT(DISTINCT entity) AS entities, COUNT(DISTINCT dport) AS dports FROM {flow} f GROUP BY system""")

plan("raw_l3_packets", """
SELECT system, day, CAST(SUM(w * dport) AS BIGINT) AS pkts_total, ROUND(SUM(w * (up + down)), 3) AS bytes_total FROM {flow} f GROUP BY system, day""")

plan("raw_action_tokens", """
WITH n AS (SELECT system, entity, day, token, COUNT(*) AS n FROM {obs} o GROUP BY system, entity, day, token)
SELECT system, entity, day, token, n, ROUND(CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY system, entity, day), 6) AS share FROM n""")

plan("raw_new_template_ratio", """
WITH f AS (SELECT *, MIN(t) OVER (PARTITION BY system, token, object_id) AS first_t FROM {obs} o)
SELECT system, day, COUNT(DISTINCT object_id) AS distinct_templates,
       ROUND(AVG(CASE WHEN t - first_t <= 900 THEN 1e0 ELSE 0e0 END), 6) AS new_template_ratio FROM f GROUP BY system, day""")

plan("raw_rare_events", """
WITH e AS (SELECT COUNT(DISTINCT entity) AS all_entities FROM {flow} f),
p AS (SELECT system, peer, COUNT(DISTINCT entity) AS users FROM {flow} f GROUP BY system, peer)
SELECT f.system, f.entity, COUNT(*) AS rare_events FROM {flow} f JOIN p ON p.system = f.system AND p.peer = f.peer CROSS JOIN e
WHERE p.users <= 0.2 * e.all_entities GROUP BY f.system, f.entity""")

plan("raw_slot_events", "SELECT system, day, slot, COUNT(*) AS n FROM {obs} o GROUP BY system, day, slot")

plan("raw_client_stack", """
WITH s AS (SELECT system, entity, token || '|' || CAST(object_id % 4 AS STRING) AS stack, t, up FROM {obs} o)
SELECT system, entity, stack, COUNT(*) AS n, ROUND(SUM(up), 4) AS bytes, ROUND(MIN(t), 3) AS first_ts, ROUND(MAX(t), 3) AS last_ts FROM s GROUP BY system, entity, stack""")

plan("raw_stack_episodes", """
WITH s AS (SELECT system, entity, token, t, CASE WHEN t - LAG(t) OVER (PARTITION BY entity, token ORDER BY t, event_id) <= 43200 THEN 0 ELSE 1 END AS opens, event_id FROM {obs} o),
e AS (SELECT *, SUM(opens) OVER (PARTITION BY entity, token ORDER BY t, event_id) AS episode FROM s)
SELECT system, entity, token, CAST(episode AS BIGINT) AS episode, ROUND(MIN(t), 3) AS first_ts, ROUND(MAX(t), 3) AS last_ts, COUNT(*) AS n FROM e GROUP BY system, entity, token, episode""")

plan("url_host_path", """
SELECT page_id, LOWER(SPLIT_PART(SPLIT_PART(url, '://', 2), '/', 1)) AS host,
       GSUB(GSUB(LOWER(url), '[a-z]+://[^/]*', ''), '[0-9]+', '{{num}}') AS path_template, LENGTH(url) AS url_length
FROM {pages} p""".replace("{{num}}", "<num>").replace("LENGTH(url)", "CAST(LENGTH(url) AS BIGINT)"))

plan("url_etld1", """
WITH h AS (SELECT page_id, LOWER(SPLIT_PART(SPLIT_PART(url, '://', 2), '/', 1)) AS host FROM {pages} p),
n AS (SELECT *, LENGTH(host) - LENGTH(REPLACE(host, '.', '')) AS dots FROM h)
SELECT page_id, host, CASE WHEN dots <= 1 THEN host ELSE SPLIT_PART(host, '.', CAST(dots AS INTEGER)) || '.' || SPLIT_PART(host, '.', CAST(dots + 1 AS INTEGER)) END AS etld1 FROM n""")

plan("url_host_traffic", """
SELECT LOWER(SPLIT_PART(SPLIT_PART(url, '://', 2), '/', 1)) AS host, COUNT(*) AS pages, CAST(SUM(LENGTH(html)) AS BIGINT) AS chars FROM {pages} p
GROUP BY LOWER(SPLIT_PART(SPLIT_PART(url, '://', 2), '/', 1))""")

plan("size_and_status_class", """
SELECT event_id, CAST(CAST(FLOOR(status / 100e0) AS BIGINT) AS STRING) || 'xx' AS status_class,
       CASE WHEN up > 0 THEN CAST(FLOOR(LOG2(up)) AS BIGINT) END AS size_class FROM {obs} o""")

plan("text_shape_skeleton", """
WITH s AS (SELECT item_id, GSUB(GSUB(GSUB(GSUB(text, '[0-9]+', '9'), '[A-Z]+', 'A'), '[a-z]+', 'a'), ' +', ' ') AS shape FROM {benchmark} b)
SELECT shape, COUNT(*) AS n, MIN(item_id) AS example FROM s GROUP BY shape""")

plan("document_line_stats", """
SELECT source, lang, COUNT(*) AS docs, CAST(SUM(LENGTH(text)) AS BIGINT) AS chars, CAST(SUM(LENGTH(text) - LENGTH(REPLACE(text, ' ', ''))) AS BIGINT) AS blanks,
       ROUND(AVG(CAST(LENGTH(text) AS DOUBLE)), 6) AS mean_chars, CAST(MAX(n_chars) AS BIGINT) AS longest FROM {documents} d GROUP BY source, lang""")

"""Novelty, vocabulary and sequences: tiers, backoff, unseen mass, n-grams, burstiness, transitions."""

from tidemark.plans.dialect import plan

plan("novelty_tiers", """
WITH x AS (SELECT entity, system, object_id, event_id, t, ROW_NUMBER() OVER (PARTITION BY entity, object_id ORDER BY t, event_id) AS ke, ROW_NUMBER() OVER (PARTITION BY system, object_id ORDER BY t, event_id) AS ks, ROW_NUMBER() OVER (PARTITION BY object_id ORDER BY t, event_id) AS ko FROM {obs} o)
SELECT event_id, CASE WHEN ko = 1 THEN 'org' WHEN ks = 1 THEN 'system' WHEN ke = 1 THEN 'entity' ELSE 'known' END AS tier FROM x""")

plan("dirichlet_backoff_surprisal", """
WITH c AS (SELECT system, entity, token, COUNT(*) AS c FROM {obs} o GROUP BY system, entity, token), n AS (SELECT entity, SUM(c) AS n FROM c GROUP BY entity), s AS (SELECT system, token, SUM(c) AS c FROM c GROUP BY system, token), sn AS (SELECT system, SUM(c) AS n FROM s GROUP BY system),
p AS (SELECT s.system, s.token, (s.c + 0.05e0) / (sn.n + 1) AS p FROM s JOIN sn ON s.system = sn.system)
SELECT c.entity, c.token, ROUND(-LOG2((c.c + 5 * p.p) / (n.n + 5)), 6) AS bits FROM c JOIN n ON c.entity = n.entity JOIN p ON p.system = c.system AND p.token = c.token""")

plan("good_turing_unseen", """
WITH c AS (SELECT entity, object_id, COUNT(*) AS c FROM {obs} o GROUP BY entity, object_id)
SELECT entity, COUNT(*) AS species, CAST(SUM(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons, ROUND((SUM(CASE WHEN c = 1 THEN 1 ELSE 0 END) + 0.5e0) / (SUM(c) + 1), 6) AS unseen FROM c GROUP BY entity""")

plan("idf_rarity", """
WITH n AS (SELECT COUNT(DISTINCT entity) AS n FROM {obs} o), d AS (SELECT object_id, COUNT(DISTINCT entity) AS df FROM {obs} o GROUP BY object_id)
SELECT object_id, df, ROUND(LN((n + 1e0) / (df + 1)) + 1, 6) AS idf FROM d CROSS JOIN n""")

plan("jsd_recent_vs_profile", """
WITH n AS (SELECT system, token, COUNT(CASE WHEN day >= 19746 THEN 1 END) AS a, COUNT(CASE WHEN day < 19746 THEN 1 END) AS b FROM {obs} o GROUP BY system, token),
p AS (SELECT system, a / CAST(NULLIF(SUM(a) OVER (PARTITION BY system), 0) AS DOUBLE) AS p, b / CAST(NULLIF(SUM(b) OVER (PARTITION BY system), 0) AS DOUBLE) AS q FROM n)
SELECT system, ROUND(SUM(CASE WHEN p > 0 THEN 0.5e0 * p * LOG2(2 * p / (p + q)) ELSE 0e0 END + CASE WHEN q > 0 THEN 0.5e0 * q * LOG2(2 * q / (p + q)) ELSE 0e0 END), 6) AS jsd_bits FROM p GROUP BY system""")

plan("class_adoption", """
WITH f AS (SELECT class, peer, entity, MIN(day) AS first_day FROM {flow} f GROUP BY class, peer, entity), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY class, peer ORDER BY first_day, entity) AS adopters FROM f)
SELECT class, peer, CAST(MAX(adopters) AS BIGINT) AS adopters, MIN(CASE WHEN adopters = 3 THEN first_day END) AS adopted_day FROM k GROUP BY class, peer""")

_NGRAM = """
WITH s AS (SELECT entity, event_id, token AS c, LAG(token) OVER (PARTITION BY entity ORDER BY t, event_id) AS b, LAG(token, 2) OVER (PARTITION BY entity ORDER BY t, event_id) AS a FROM {obs} o)"""

plan("ngram_backoff_surprisal", _NGRAM + """,
t3 AS (SELECT a, b, c, COUNT(*) AS n FROM s WHERE a IS NOT NULL GROUP BY a, b, c), t2 AS (SELECT b, c, COUNT(*) AS n FROM s WHERE b IS NOT NULL GROUP BY b, c), t1 AS (SELECT c, COUNT(*) AS n FROM s GROUP BY c),
p1 AS (SELECT c, (n + 1e0) / (SUM(n) OVER () + COUNT(*) OVER ()) AS p FROM t1), p2 AS (SELECT t2.b, t2.c, (t2.n + 2 * p) / (SUM(t2.n) OVER (PARTITION BY t2.b) + 2) AS p FROM t2 JOIN p1 ON t2.c = p1.c)
SELECT a, b, c, n, ROUND(-LOG2((n + 2 * p2.p) / (SUM(n) OVER (PARTITION BY a, b) + 2)), 6) AS bits FROM t3 JOIN p2 USING (b, c)""")

plan("session_surprisal_excess", _NGRAM + """,
t2 AS (SELECT b, c, COUNT(*) AS n FROM s WHERE b IS NOT NULL GROUP BY b, c), p AS (SELECT b, c, -LOG2(n / CAST(SUM(n) OVER (PARTITION BY b) AS DOUBLE)) AS bits FROM t2), x AS (SELECT s.entity, p.bits FROM s JOIN p ON s.b = p.b AND s.c = p.c), m AS (SELECT AVG(bits) AS mu FROM x)
SELECT entity, COUNT(*) AS length, ROUND((SUM(bits) - COUNT(*) * MAX(mu)) / (COUNT(*) + 5), 6) AS excess FROM x CROSS JOIN m GROUP BY entity""")

plan("burstiness_memory", """
WITH g AS (SELECT entity, t, event_id, t - LAG(t) OVER (PARTITION BY entity ORDER BY t, event_id) AS gap FROM {obs} o), h AS (SELECT entity, gap, LAG(gap) OVER (PARTITION BY entity ORDER BY t, event_id) AS before FROM g)
SELECT entity, ROUND((STDDEV_POP(gap) - AVG(gap)) / (STDDEV_POP(gap) + AVG(gap)), 6) AS burstiness, ROUND(CORR(gap, before), 6) AS memory FROM h WHERE gap IS NOT NULL AND before IS NOT NULL GROUP BY entity HAVING COUNT(*) >= 5""")

plan("run_length_dwell", """
WITH s AS (SELECT entity, token, t, event_id, CASE WHEN token = LAG(token) OVER (PARTITION BY entity ORDER BY t, event_id) THEN 0 ELSE 1 END AS opens FROM {obs} o), r AS (SELECT *, SUM(opens) OVER (PARTITION BY entity ORDER BY t, event_id) AS run FROM s), l AS (SELECT entity, token, run, COUNT(*) AS n, MAX(t) - MIN(t) AS dwell FROM r GROUP BY entity, token, run)
SELECT token, n AS run_length, COUNT(*) AS runs, ROUND(AVG(dwell), 4) AS mean_dwell FROM l GROUP BY token, n""")

plan("dfg_edges_dependency", _NGRAM + """,
e AS (SELECT b AS a, c AS b, COUNT(*) AS ab FROM s WHERE b IS NOT NULL AND b <> c GROUP BY b, c)
SELECT x.a, x.b, x.ab, ROUND((x.ab - COALESCE(y.ab, 0)) / (x.ab + COALESCE(y.ab, 0) + 1e0), 6) AS dependency FROM e x LEFT JOIN e y ON x.a = y.b AND x.b = y.a""")

plan("dfg_loop2", _NGRAM + " SELECT a, b, COUNT(*) AS aba FROM s WHERE a = c AND a <> b GROUP BY a, b")

plan("transition_predictive", _NGRAM + """,
m AS (SELECT c, COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS p FROM s GROUP BY c), e AS (SELECT b, c, COUNT(*) AS n FROM s WHERE b IS NOT NULL GROUP BY b, c)
SELECT e.b, e.c, ROUND((n + 2 * p) / (SUM(n) OVER (PARTITION BY e.b) + 2), 6) AS p FROM e JOIN m ON e.c = m.c""")

plan("required_predecessor", """
WITH f AS (SELECT entity, day, token, MIN(t) AS t FROM {obs} o GROUP BY entity, day, token), c AS (SELECT token AS b, COUNT(*) AS n FROM f GROUP BY token),
w AS (SELECT x.token AS a, y.token AS b, COUNT(*) AS n FROM f x JOIN f y ON x.entity = y.entity AND x.day = y.day AND x.t < y.t GROUP BY x.token, y.token)
SELECT a, w.b, ROUND((c.n - w.n + 0.5e0) / (c.n + 1), 6) AS without_rate FROM w JOIN c ON w.b = c.b""")

plan("cross_system_mixture", """
WITH c AS (SELECT class, peer, COUNT(*) AS c FROM {flow} f GROUP BY class, peer), o AS (SELECT peer, SUM(c) AS c FROM c GROUP BY peer), k AS (SELECT COUNT(*) AS k, SUM(c) AS n FROM o), g AS (SELECT class, SUM(c) AS n, SUM(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS n1 FROM c GROUP BY class)
SELECT c.class, c.peer, ROUND((1 - (n1 + 0.5e0) / (g.n + 1)) * c.c / g.n + (n1 + 0.5e0) / (g.n + 1) * (o.c + 1e0) / (k.n + k.k), 8) AS p FROM c JOIN g ON c.class = g.class JOIN o ON c.peer = o.peer CROSS JOIN k""")

"""Sessions: gap sessions, think times, episodes, blocks of a stream, gap histograms, conversations."""

from tidemark.plans.dialect import plan

_SESSIONS = """
WITH g AS (SELECT *, t - LAG(t) OVER (PARTITION BY entity ORDER BY t, event_id) AS gap FROM {obs} o),
s AS (SELECT *, SUM(CASE WHEN gap <= GAP THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY t, event_id) AS session FROM g)"""

plan("session_counts_gap30m", (_SESSIONS + """
SELECT entity, COUNT(DISTINCT session) AS sessions, COUNT(*) AS requests, ROUND(CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT session), 6) AS req_per_session FROM s GROUP BY entity""").replace("GAP", "1800"))

plan("session_table_12h", (_SESSIONS + """
SELECT entity, CAST(session AS BIGINT) AS session, ROUND(MIN(t), 3) AS opened, ROUND(MAX(t) - MIN(t), 3) AS lasted, COUNT(*) AS requests, COUNT(DISTINCT token) AS tokens FROM s GROUP BY entity, session""").replace("GAP", "43200"))

plan("think_time_median", (_SESSIONS + """
SELECT entity, COUNT(*) AS gaps, ROUND(PERCENTILE(gap, 0.5), 6) AS think_time_s, ROUND(SUM(LN(gap)), 6) AS think_log_sum FROM s WHERE gap > 0 AND gap <= GAP GROUP BY entity HAVING COUNT(*) >= 2""").replace("GAP", "43200"))

plan("episodes_5m", (_SESSIONS.replace("PARTITION BY entity", "PARTITION BY system") + """
SELECT system, CAST(session AS BIGINT) AS episode, COUNT(*) AS n, COUNT(DISTINCT entity) AS entities, ROUND(MAX(t) - MIN(t), 3) AS lasted FROM s GROUP BY system, session""").replace("GAP", "300"))

plan("session_stream_blocks", (_SESSIONS + """,
b AS (SELECT entity, session, COUNT(*) AS n, MIN(day) AS day FROM s GROUP BY entity, session),
c AS (SELECT *, SUM(n) OVER (PARTITION BY day ORDER BY entity, session) AS kept FROM b)
SELECT day, COUNT(*) AS blocks, CAST(SUM(n) AS BIGINT) AS rows_kept FROM c WHERE kept <= 512 GROUP BY day""").replace("GAP", "43200"))

plan("learned_gap_histogram", """
WITH g AS (SELECT system, t - LAG(t) OVER (PARTITION BY entity ORDER BY t, event_id) AS gap FROM {obs} o)
SELECT system, CAST(FLOOR(LOG10(gap) * 10) AS BIGINT) AS bin, COUNT(*) AS n FROM g WHERE gap > 0 GROUP BY system, CAST(FLOOR(LOG10(gap) * 10) AS BIGINT)""")

plan("gap_otsu_valley", """
WITH g AS (SELECT system, t - LAG(t) OVER (PARTITION BY entity ORDER BY t, event_id) AS gap FROM {obs} o),
h AS (SELECT system, CAST(FLOOR(LOG10(gap) * 10) AS BIGINT) AS bin, CAST(COUNT(*) AS DOUBLE) AS n FROM g WHERE gap > 0 GROUP BY system, CAST(FLOOR(LOG10(gap) * 10) AS BIGINT)),
c AS (SELECT system, bin, SUM(n) OVER lo AS n0, SUM(n * bin) OVER lo AS s0, SUM(n) OVER (PARTITION BY system) AS n1, SUM(n * bin) OVER (PARTITION BY system) AS s1 FROM h WINDOW lo AS (PARTITION BY system ORDER BY bin ROWS UNBOUNDED PRECEDING)),
v AS (SELECT system, bin, n0 * (n1 - n0) * POWER(s0 / n0 - (s1 - s0) / (n1 - n0), 2) AS between_var FROM c WHERE n1 > n0),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY system ORDER BY between_var DESC, bin) AS k FROM v)
SELECT system, bin, ROUND(POWER(10e0, (bin + 1) / 10e0), 4) AS gap_s FROM k WHERE k = 1""")

plan("conversation_turns", """
SELECT conv_id, COUNT(*) AS turns, CAST(SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS user_turns, CAST(SUM(LENGTH(text)) AS BIGINT) AS chars, MAX(turn) AS last_turn FROM {conversations} c GROUP BY conv_id""")

plan("conversation_transitions", """
WITH n AS (SELECT role, LEAD(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM {conversations} c)
SELECT role, COALESCE(next_role, 'end') AS next_role, COUNT(*) AS n FROM n GROUP BY role, COALESCE(next_role, 'end')""")

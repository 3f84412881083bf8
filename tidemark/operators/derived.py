"""Derived metrics: ratios with exposure, entropies, graph novelty, windows, trends and periodicity."""

from tidemark.plans.dialect import plan

plan("ratio_with_exposure", """
SELECT system, entity, day, COUNT(*) AS n, CASE WHEN COUNT(*) > 0 THEN ROUND(CAST(SUM(CASE WHEN status >= 400 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 6) END AS http_error_rate,
       ROUND(CAST(SUM(CASE WHEN status < 300 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 6) AS http_success_rate,
       ROUND(CAST(COUNT(*) AS DOUBLE) / NULLIF(COUNT(DISTINCT object_id), 0), 6) AS req_per_peer FROM {obs} o GROUP BY system, entity, day""")

plan("upload_dominance", """
SELECT system, entity, CASE WHEN SUM(up + down) > 1e-9 THEN ROUND(SUM(up) / SUM(up + down), 6) END AS upload_dominance,
       CASE WHEN SUM(w) > 0 THEN ROUND(SUM(up + down) / SUM(w), 6) END AS bytes_per_flow, COUNT(*) AS n FROM {flow} f GROUP BY system, entity""")

plan("set_entropy_normalized", """
WITH n AS (SELECT system, day, token, CAST(COUNT(*) AS DOUBLE) AS n FROM {obs} o GROUP BY system, day, token),
p AS (SELECT system, day, n / SUM(n) OVER (PARTITION BY system, day) AS p FROM n)
SELECT system, day, COUNT(*) AS k, CASE WHEN COUNT(*) <= 1 THEN 0e0 ELSE ROUND(SUM(p * LOG2(1 / p)) / LOG2(CAST(COUNT(*) AS DOUBLE)), 6) END AS entropy FROM p GROUP BY system, day""")

plan("host_char_entropy", """
WITH h AS (SELECT DISTINCT LOWER(SPLIT_PART(SPLIT_PART(url, '://', 2), '/', 1)) AS host FROM {pages} p),
l AS (SELECT host, SPLIT_PART(host, '.', 1) AS label FROM h),
a AS (SELECT host, CAST(LENGTH(label) AS DOUBLE) AS n, c.ch, CAST(LENGTH(label) - LENGTH(REPLACE(label, c.ch, '')) AS DOUBLE) AS k FROM l
      CROSS JOIN (VALUES ('a'),('b'),('c'),('d'),('e'),('f'),('g'),('h'),('i'),('j'),('k'),('l'),('m'),('n'),('o'),('p'),('q'),('r'),('s'),('t'),('u'),('v'),('w'),('x'),('y'),('z'),('0'),('1'),('2'),('3'),('4'),('5'),('6'),('7'),('8'),('9'),('-')) AS c(ch))
SELECT host, ROUND(SUM(k / n * LOG2(n / k)), 6) AS char_entropy FROM a WHERE k > 0 GROUP BY host""")

plan("peer_first_seen_30d", """
WITH s AS (SELECT system, entity, peer, day, LAG(day) OVER (PARTITION BY system, entity, peer ORDER BY day) AS before FROM (SELECT DISTINCT system, entity, peer, day FROM {flow} f) d)
SELECT system, entity, day, COUNT(*) AS peers, CAST(SUM(CASE WHEN before IS NULL OR day - before > 30 THEN 1 ELSE 0 END) AS BIGINT) AS new_peers,
       ROUND(AVG(CASE WHEN before IS NULL OR day - before > 30 THEN 1e0 ELSE 0e0 END), 6) AS peer_novelty FROM s GROUP BY system, entity, day""")

plan("dest_concentration", """
WITH n AS (SELECT system, entity, peer, SUM(w) AS n FROM {flow} f GROUP BY system, entity, peer)
SELECT system, entity, COUNT(*) AS fanout, ROUND(CAST(MAX(n) AS DOUBLE) / SUM(n), 6) AS dest_concentration FROM n GROUP BY system, entity""")

plan("window_stats_6h", """
WITH w AS (SELECT system, hour, CAST(COUNT(*) AS DOUBLE) AS x FROM {obs} o GROUP BY system, hour)
SELECT system, hour, CAST(SUM(x) OVER v AS BIGINT) AS sum_6h, ROUND(AVG(x) OVER v, 6) AS mean_6h, CAST(MAX(x) OVER v AS BIGINT) AS max_6h,
       CASE WHEN ABS(AVG(x) OVER v) < 1e-9 THEN 0e0 ELSE ROUND(STDDEV_POP(x) OVER v / AVG(x) OVER v, 6) END AS cv_6h
FROM w WINDOW v AS (PARTITION BY system ORDER BY hour RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)""")

plan("window_p95", """
SELECT a.system, a.day, ROUND(PERCENTILE(b.up, 0.95), 6) AS p95, ROUND(PERCENTILE(b.up, 0.5), 6) AS median, COUNT(*) AS n
FROM (SELECT DISTINCT system, day FROM {obs} o) a JOIN {obs} b ON a.system = b.system AND b.day BETWEEN a.day - 2 AND a.day GROUP BY a.system, a.day""")

plan("zero_filled_grid", """
WITH s AS (SELECT system, MIN(hour) AS lo, MAX(hour) AS hi FROM {obs} o GROUP BY system),
h AS (SELECT DISTINCT hour FROM {obs} o), n AS (SELECT system, hour, COUNT(*) AS n FROM {obs} o GROUP BY system, hour)
SELECT s.system, h.hour, COALESCE(n.n, 0) AS events FROM s JOIN h ON h.hour BETWEEN s.lo AND s.hi LEFT JOIN n ON n.system = s.system AND n.hour = h.hour""")

_EWMA = """
WITH x AS (SELECT system, hour, CAST(COUNT(*) AS DOUBLE) AS x FROM {obs} o GROUP BY system, hour),
g AS (SELECT *, LAG(hour) OVER (PARTITION BY system ORDER BY hour) AS before FROM x),
{left}p AS (SELECT a.system, a.hour, SUM(CASE WHEN b.before IS NULL THEN 1e0 ELSE 1 - POWER(2e0, -(b.hour - b.before) / 12e0) END * POWER(2e0, -(a.hour - b.hour) / 12e0) * b.x) AS ewma
      FROM {a} a JOIN {b} b ON a.system = b.system {same}AND b.hour <= a.hour GROUP BY a.system, a.hour)
SELECT system, hour, ROUND(ewma, 6) AS ewma FROM p"""


def _ewma(left: str, a: str, b: str, same: str) -> str:
    return _EWMA.replace("{left}", left).replace("{a}", a).replace("{b}", b).replace("{same}", same)


# what is over 720 hours old weighs less than 2^-60: hours meet those of their own block of 720 and the one before it
_HOURS = """y AS (SELECT *, CAST(FLOOR(hour / 720e0) AS BIGINT) AS b FROM g), z AS (SELECT * FROM y UNION ALL SELECT system, hour, x, before, b + 1 FROM y),
"""
plan("ewma_12h", _ewma(_HOURS, "y", "z", "AND a.b = b.b "), _ewma("", "g", "g", ""))

plan("trend_slope", """
WITH x AS (SELECT system, entity, day, CAST(COUNT(*) AS DOUBLE) AS n FROM {obs} o GROUP BY system, entity, day)
SELECT system, entity, COUNT(*) AS days, CASE WHEN COUNT(*) < 2 THEN 0e0 ELSE ROUND(REGR_SLOPE(n, CAST(day - 19700 AS DOUBLE)), 6) END AS slope FROM x GROUP BY system, entity""")

plan("split_half_z", """
WITH x AS (SELECT system, day, CAST(COUNT(*) AS DOUBLE) AS n FROM {obs} o GROUP BY system, day), m AS (SELECT system, (MIN(day) + MAX(day)) / 2e0 AS mid FROM x GROUP BY system),
h AS (SELECT x.system, AVG(CASE WHEN day <= mid THEN n END) AS a, AVG(CASE WHEN day > mid THEN n END) AS b, COALESCE(VAR_POP(CASE WHEN day <= mid THEN n END), 0) AS va, COALESCE(VAR_POP(CASE WHEN day > mid THEN n END), 0) AS vb,
             COUNT(CASE WHEN day <= mid THEN 1 END) AS na, COUNT(CASE WHEN day > mid THEN 1 END) AS nb FROM x JOIN m ON x.system = m.system GROUP BY x.system)
SELECT system, ROUND(GREATEST(-50e0, LEAST(50e0, (b - a) / SQRT(GREATEST(va, 1e0) / na + GREATEST(vb, 1e0) / nb))), 6) AS z FROM h""")

plan("autocorr_peak", """
WITH x AS (SELECT system, hour, CAST(COUNT(*) AS DOUBLE) AS n FROM {obs} o GROUP BY system, hour), m AS (SELECT system, AVG(n) AS mu, VAR_POP(n) * COUNT(*) AS ss FROM x GROUP BY system),
c AS (SELECT a.system, b.hour - a.hour AS lag, SUM((a.n - m.mu) * (b.n - m.mu)) / MAX(m.ss) AS r FROM x a JOIN x b ON a.system = b.system AND b.hour BETWEEN a.hour + 2 AND a.hour + 48 JOIN m ON m.system = a.system GROUP BY a.system, b.hour - a.hour),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY system ORDER BY r DESC, lag) AS k FROM c)
SELECT system, lag * 3600 AS beacon_lag, ROUND(r, 6) AS periodicity_score FROM k WHERE k = 1""")

plan("timing_regularity", """
WITH g AS (SELECT entity, t - LAG(t) OVER (PARTITION BY entity ORDER BY t, event_id) AS gap FROM {obs} o)
SELECT entity, COUNT(gap) AS gaps, ROUND(1 - LEAST(STDDEV_POP(gap) / AVG(gap), 1e0), 6) AS timing_regularity FROM g WHERE gap IS NOT NULL GROUP BY entity""")

plan("duty_cycle_slots", """
SELECT entity, day, COUNT(DISTINCT slot) AS active_slots, ROUND(COUNT(DISTINCT slot) / 96e0, 6) AS duty_cycle FROM {obs} o GROUP BY entity, day""")

plan("presence_by_bin48", """
WITH n AS (SELECT system, dow IN (0, 6) AS weekend, CAST(FLOOR(slot / 2e0) AS BIGINT) AS bin48, COUNT(*) AS n, COUNT(DISTINCT day) AS days FROM {obs} o GROUP BY system, dow IN (0, 6), CAST(FLOOR(slot / 2e0) AS BIGINT)),
d AS (SELECT system, dow IN (0, 6) AS weekend, COUNT(DISTINCT day) AS of_days FROM {obs} o GROUP BY system, dow IN (0, 6))
SELECT n.system, CAST(n.weekend AS INTEGER) AS weekend, bin48, n, ROUND(CAST(days AS DOUBLE) / of_days, 6) AS presence FROM n JOIN d ON n.system = d.system AND n.weekend = d.weekend""")

plan("bin168_profile", """
WITH n AS (SELECT system, dow * 24 + CAST(FLOOR(slot / 4e0) AS BIGINT) AS bin168, COUNT(*) AS n FROM {obs} o GROUP BY system, dow * 24 + CAST(FLOOR(slot / 4e0) AS BIGINT))
SELECT system, bin168, n, ROUND(n / CAST(SUM(n) OVER (PARTITION BY system) AS DOUBLE), 6) AS share FROM n""")

plan("circular_mean_hour", """
WITH a AS (SELECT entity, (t - day * 86400e0) / 86400e0 * 2 * PI() AS phi FROM {obs} o)
SELECT entity, COUNT(*) AS n, ROUND(SQRT(POWER(AVG(COS(phi)), 2) + POWER(AVG(SIN(phi)), 2)), 6) AS resultant,
       ROUND(EXP(-POWER(SUM(COS(phi)), 2) / COUNT(*) - POWER(SUM(SIN(phi)), 2) / COUNT(*)), 6) AS rayleigh_p FROM a GROUP BY entity""")

plan("slot_histogram_daytype", """
SELECT system, CASE WHEN dow IN (0, 6) THEN 'weekend' ELSE 'workday' END AS day_type, slot, COUNT(*) AS n FROM {obs} o GROUP BY system, CASE WHEN dow IN (0, 6) THEN 'weekend' ELSE 'workday' END, slot""")

plan("activity_window_80", """
WITH n AS (SELECT entity, CAST(FLOOR(slot / 4e0) AS BIGINT) AS h, COUNT(*) AS n FROM {obs} o GROUP BY entity, CAST(FLOOR(slot / 4e0) AS BIGINT)),
w AS (SELECT a.entity, a.h AS opens, b.len, SUM(c.n) AS n FROM n a CROSS JOIN (VALUES (4), (8), (12), (16), (20), (24)) AS b(len) JOIN n c ON c.entity = a.entity AND (c.h - a.h + 24) % 24 < b.len GROUP BY a.entity, a.h, b.len),
s AS (SELECT entity, SUM(n) AS total FROM n GROUP BY entity),
k AS (SELECT w.*, total, ROW_NUMBER() OVER (PARTITION BY w.entity ORDER BY len, w.n DESC, opens) AS k FROM w JOIN s ON s.entity = w.entity WHERE w.n >= 0.8 * total)
SELECT entity, opens, len, ROUND(CAST(n AS DOUBLE) / total, 6) AS share FROM k WHERE k = 1""")

plan("feature_transforms", """
WITH k AS (SELECT system, entity, day, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(CASE WHEN status >= 500 THEN 1 ELSE 0 END) AS DOUBLE) AS e, AVG(up) AS a FROM {obs} o GROUP BY system, entity, day)
SELECT system, entity, day, ROUND(LN(1 + n / 24), 6) AS log_rate, ROUND(LN((e + 0.5e0) / (n - e + 0.5e0)), 6) AS logit_error, ROUND(LN(GREATEST(a, 1e-9)), 6) AS log_avg FROM k""")

plan("clr_composition", """
WITH n AS (SELECT system, token, LN(COUNT(*) + 0.5e0) AS l FROM {obs} o GROUP BY system, token)
SELECT system, token, ROUND(l - AVG(l) OVER (PARTITION BY system), 6) AS clr FROM n""")

plan("grain_from_parts", """
WITH h AS (SELECT system, hour, COUNT(*) AS n, SUM(up) AS s, SUM(up * up) AS ss, MAX(up) AS m FROM {obs} o GROUP BY system, hour)
SELECT system, CAST(FLOOR(hour / 24e0) AS BIGINT) AS day, CAST(SUM(n) AS BIGINT) AS n, ROUND(SUM(s), 4) AS total, ROUND(SUM(s) / SUM(n), 6) AS mean, ROUND(MAX(m), 6) AS largest FROM h GROUP BY system, CAST(FLOOR(hour / 24e0) AS BIGINT)""")

plan("tctx_local_time", """
SELECT event_id, slot, dow, CASE WHEN dow IN (0, 6) THEN 'weekend' ELSE 'workday' END AS day_type, CASE WHEN slot < 24 THEN 'night' WHEN slot < 48 THEN 'morning' WHEN slot < 72 THEN 'afternoon' ELSE 'evening' END AS daypart FROM {obs} o""")

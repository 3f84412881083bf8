"""Behaviour statistics that a statement can hold: robust scores, combined p-values, charts, tails, risk, incidents."""

from tidemark.plans.dialect import plan

plan("robust_median_mad_z", """
WITH x AS (SELECT system, entity, CAST(COUNT(*) AS DOUBLE) AS n FROM {obs} o GROUP BY system, entity), m AS (SELECT system, PERCENTILE(n, 0.5) AS med FROM x GROUP BY system),
d AS (SELECT x.system, PERCENTILE(ABS(n - med), 0.5) * 1.4826e0 AS mad FROM x JOIN m ON x.system = m.system GROUP BY x.system)
SELECT x.system, x.entity, ROUND((n - med) / GREATEST(mad, 1e-9), 6) AS robust_z FROM x JOIN m ON x.system = m.system JOIN d ON x.system = d.system""")

#: Upper tail shares of each entity-day among all, by the distinct values: those are few, the rows are not.
_X = """
WITH x AS (SELECT entity, day, COUNT(*) AS n, SUM(CASE WHEN status >= 500 THEN 1 ELSE 0 END) AS e, SUM(is_write) AS w FROM {obs} o GROUP BY entity, day), k AS (SELECT COUNT(*) + 1e0 AS k FROM x),
vn AS (SELECT n, c, SUM(c) OVER (ORDER BY n DESC) AS above FROM (SELECT n, COUNT(*) AS c FROM x GROUP BY n) g),
ve AS (SELECT e, SUM(c) OVER (ORDER BY e DESC) AS above FROM (SELECT e, COUNT(*) AS c FROM x GROUP BY e) g),
vw AS (SELECT w, SUM(c) OVER (ORDER BY w DESC) AS above FROM (SELECT w, COUNT(*) AS c FROM x GROUP BY w) g)"""
_P = _X + """,
p AS (SELECT entity, day, vn.above / k AS p_rate, ve.above / k AS p_error, vw.above / k AS p_write FROM x JOIN vn ON x.n = vn.n JOIN ve ON x.e = ve.e JOIN vw ON x.w = vw.w CROSS JOIN k)"""
#: The same by windows over all rows, for the oracles.
_OWN = """
WITH x AS (SELECT entity, day, COUNT(*) AS n, SUM(CASE WHEN status >= 500 THEN 1 ELSE 0 END) AS e, SUM(is_write) AS w FROM {obs} o GROUP BY entity, day),
p AS (SELECT entity, day, (COUNT(*) OVER (ORDER BY n DESC RANGE UNBOUNDED PRECEDING)) / (COUNT(*) OVER () + 1e0) AS p_rate,
             (COUNT(*) OVER (ORDER BY e DESC RANGE UNBOUNDED PRECEDING)) / (COUNT(*) OVER () + 1e0) AS p_error, (COUNT(*) OVER (ORDER BY w DESC RANGE UNBOUNDED PRECEDING)) / (COUNT(*) OVER () + 1e0) AS p_write FROM x)"""


def _over_p(name: str, rest: str) -> None:
    plan(name, _P + rest, _OWN + rest)


_over_p("whmp_by_family", """
SELECT entity, day, ROUND(LEAST(1e0, 2e0 / (1 / p_rate + 0.5e0 / p_error + 0.5e0 / p_write)), 6) AS p_fused, ROUND(LEAST(p_rate, LEAST(p_error, p_write)), 6) AS p_least FROM p""")

_over_p("eday_severity", """,
e AS (SELECT entity, day, LEAST(1e0, 2e0 / (1 / p_rate + 0.5e0 / p_error + 0.5e0 / p_write)) AS e_day FROM p)
SELECT entity, day, ROUND(e_day, 6) AS e_day, CASE WHEN e_day <= 3e-6 THEN 'critical' WHEN e_day <= 3e-4 THEN 'high' WHEN e_day <= 3e-3 THEN 'medium' WHEN e_day <= 0.03 THEN 'low' ELSE 'none' END AS severity FROM e""")

_over_p("bh_threshold", """,
r AS (SELECT day, p_rate AS p, ROW_NUMBER() OVER (PARTITION BY day ORDER BY p_rate, entity) AS k, COUNT(*) OVER (PARTITION BY day) AS m FROM p)
SELECT day, ROUND(COALESCE(MAX(CASE WHEN p <= k * 0.05e0 / m THEN p END), -1e0), 6) AS threshold, MAX(m) AS tests FROM r GROUP BY day""")

_PRIOR = """
WITH x AS (SELECT entity, event_id, up AS s, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY t, event_id) AS k FROM {obs} o),
{left}c AS (SELECT a.entity, a.event_id, COUNT(b.s) AS n, SUM(CASE WHEN b.s > a.s THEN 1 ELSE 0 END) AS above, SUM(CASE WHEN b.s = a.s THEN 1 ELSE 0 END) AS ties
      FROM {a} a LEFT JOIN {b} b ON a.entity = b.entity {same}AND b.k < a.k AND b.k >= a.k - 256 GROUP BY a.entity, a.event_id)
SELECT entity, event_id, CASE WHEN n = 0 THEN 0.5e0 ELSE ROUND((above + 0.5e0 * (ties + 1)) / (n + 1), 6) END AS p FROM c"""


def _prior(left: str, a: str, b: str, same: str) -> str:
    return _PRIOR.replace("{left}", left).replace("{a}", a).replace("{b}", b).replace("{same}", same)


# the 256 before a row lie in its block of 256 or the one before it
_BLOCKS = """y AS (SELECT *, CAST(FLOOR((k - 1) / 256e0) AS BIGINT) AS g FROM x), z AS (SELECT entity, k, s, g FROM y UNION ALL SELECT entity, k, s, g + 1 FROM y),
"""
plan("conformal_p_prior256", _prior(_BLOCKS, "y", "z", "AND a.g = b.g "), _prior("", "x", "x", ""))

plan("ks_uniform", _X + """
SELECT ROUND(MAX(GREATEST(above / (k - 1) - above / k, above / k - (above - c) / (k - 1))), 6) AS ks_d, CAST(MAX(k) - 1 AS BIGINT) AS n FROM vn CROSS JOIN k""", _OWN + """,
r AS (SELECT p_rate AS p, ROW_NUMBER() OVER (ORDER BY p_rate) AS i, COUNT(*) OVER () AS n FROM p)
SELECT ROUND(MAX(GREATEST(i / CAST(n AS DOUBLE) - p, p - (i - 1) / CAST(n AS DOUBLE))), 6) AS ks_d, MAX(n) AS n FROM r""")

plan("cusum_two_sided", """
WITH x AS (SELECT system, day, CAST(COUNT(*) AS DOUBLE) AS n FROM {obs} o GROUP BY system, day), m AS (SELECT system, AVG(n) AS mu, GREATEST(STDDEV_POP(n), 1e-9) AS sd FROM x GROUP BY system),
z AS (SELECT x.system, day, (n - mu) / sd AS z FROM x JOIN m ON x.system = m.system),
s AS (SELECT system, day, SUM(z - 0.5e0) OVER v AS up_sum, SUM(-z - 0.5e0) OVER v AS down_sum FROM z WINDOW v AS (PARTITION BY system ORDER BY day ROWS UNBOUNDED PRECEDING))
SELECT system, day, ROUND(up_sum - LEAST(0e0, MIN(up_sum) OVER v), 6) AS cusum_up, ROUND(down_sum - LEAST(0e0, MIN(down_sum) OVER v), 6) AS cusum_down FROM s WINDOW v AS (PARTITION BY system ORDER BY day ROWS UNBOUNDED PRECEDING)""")

plan("bernoulli_cusum_offhours", """
WITH h AS (SELECT entity, hour, MAX(CASE WHEN slot < 24 OR slot >= 88 THEN 1 ELSE 0 END) AS a FROM {obs} o GROUP BY entity, hour),
r AS (SELECT entity, GREATEST(0.02e0, LEAST(0.98e0, AVG(CAST(a AS DOUBLE)))) AS p0 FROM h GROUP BY entity), q AS (SELECT entity, p0, LEAST(0.95e0, GREATEST(0.5e0, 5 * p0)) AS p1 FROM r WHERE p0 <= 0.3),
s AS (SELECT h.entity, hour, SUM(a * LOG2(p1 / p0) + (1 - a) * LOG2((1 - p1) / (1 - p0))) OVER (PARTITION BY h.entity ORDER BY hour ROWS UNBOUNDED PRECEDING) AS s FROM h JOIN q ON h.entity = q.entity)
SELECT entity, hour, ROUND(s - LEAST(0e0, MIN(s) OVER (PARTITION BY entity ORDER BY hour ROWS UNBOUNDED PRECEDING)), 6) AS w FROM s""")

plan("silence_accumulator", """
WITH d AS (SELECT DISTINCT entity, day FROM {obs} o), b AS (SELECT MIN(day) AS lo, MAX(day) AS hi FROM {obs} o), p AS (SELECT entity, LEAST(0.999e0, COUNT(*) / CAST(MAX(hi - lo + 1) AS DOUBLE)) AS p FROM d CROSS JOIN b GROUP BY entity),
g AS (SELECT d.entity, d.day, LEAD(d.day) OVER (PARTITION BY d.entity ORDER BY d.day) AS next_day FROM d)
SELECT g.entity, g.day, g.next_day - g.day - 1 AS silent_days, ROUND(-(g.next_day - g.day - 1) * LN(1 - p.p), 6) AS silence FROM g JOIN p ON g.entity = p.entity WHERE g.next_day > g.day + 1""")

plan("mann_kendall_sen", """
WITH x AS (SELECT system, day, CAST(COUNT(*) AS DOUBLE) AS n FROM {obs} o GROUP BY system, day),
c AS (SELECT a.system, SIGN(b.n - a.n) AS s, (b.n - a.n) / (b.day - a.day) AS slope FROM x a JOIN x b ON a.system = b.system AND a.day < b.day)
SELECT system, CAST(SUM(s) AS BIGINT) AS mk_s, ROUND(PERCENTILE(slope, 0.5), 6) AS sen_slope, COUNT(*) AS pairs FROM c GROUP BY system""")

plan("gpd_pwm_tail", """
WITH u AS (SELECT system, PERCENTILE(up, 0.9) AS u FROM {obs} o GROUP BY system), y AS (SELECT o.system, up - u AS y FROM {obs} o JOIN u ON o.system = u.system WHERE up > u),
r AS (SELECT system, y, (ROW_NUMBER() OVER (PARTITION BY system ORDER BY y) - 0.35e0) / COUNT(*) OVER (PARTITION BY system) AS p FROM y), a AS (SELECT system, COUNT(*) AS n, AVG(y) AS a0, AVG((1 - p) * y) AS a1 FROM r GROUP BY system),
x AS (SELECT *, 2 - a0 / (a0 - 2 * a1) AS raw FROM a)
SELECT system, n, ROUND(GREATEST(-0.5e0, LEAST(0.5e0, raw)), 6) AS xi, ROUND(CASE WHEN ABS(raw) > 0.5 THEN a0 * (1 - GREATEST(-0.5e0, LEAST(0.5e0, raw))) ELSE 2 * a0 * a1 / (a0 - 2 * a1) END, 5) AS sigma FROM x""")

# Of m members in order, the others of the k-th keep their rank below k and lose one above it; their median is the mean of
# the floor(m / 2)-th and the floor((m + 1) / 2)-th of them.
plan("loo_median_residual", """
WITH x AS (SELECT system, entity, CAST(COUNT(*) AS DOUBLE) AS n FROM {obs} o GROUP BY system, entity),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY system ORDER BY n, entity) AS k, COUNT(*) OVER (PARTITION BY system) AS m FROM x),
p AS (SELECT *, CAST(FLOOR(m / 2e0) AS BIGINT) AS i, CAST(FLOOR((m + 1) / 2e0) AS BIGINT) AS j FROM r WHERE m > 3),
q AS (SELECT system, entity, n, CASE WHEN i < k THEN i ELSE i + 1 END AS i, CASE WHEN j < k THEN j ELSE j + 1 END AS j FROM p)
SELECT q.system, q.entity, ROUND(q.n - (a.n + b.n) / 2, 6) AS residual FROM q JOIN r a ON a.system = q.system AND a.k = q.i JOIN r b ON b.system = q.system AND b.k = q.j""", """
WITH x AS (SELECT system, entity, COUNT(*)::DOUBLE AS n FROM {obs} o GROUP BY ALL)
SELECT a.system, a.entity, ROUND(ANY_VALUE(a.n) - MEDIAN(b.n), 6) AS residual FROM x a JOIN x b ON a.system = b.system AND a.entity <> b.entity GROUP BY a.system, a.entity HAVING COUNT(*) >= 3""")

plan("renewal_kappa0", """
WITH g AS (SELECT entity, t - LAG(t) OVER (PARTITION BY entity ORDER BY t, event_id) AS x FROM {obs} o), s AS (SELECT entity, COUNT(*) AS n, LN(AVG(x)) - AVG(LN(x)) AS s FROM g WHERE x > 0 GROUP BY entity HAVING COUNT(*) >= 8)
SELECT entity, n, ROUND((3 - s + SQRT(POWER(s - 3, 2) + 24 * s)) / (12 * s), 5) AS kappa0 FROM s""")

plan("loading_beta", """
WITH x AS (SELECT system, entity, day, CAST(COUNT(*) AS DOUBLE) AS n FROM {obs} o GROUP BY system, entity, day), l AS (SELECT system, day, AVG(n) AS l FROM x GROUP BY system, day), c AS (SELECT system, AVG(n) AS mu FROM x GROUP BY system),
z AS (SELECT x.system, entity, POWER(2e0, -((SELECT MAX(day) FROM {obs} e) - x.day) / 7e0) AS w, l - mu AS l, n - mu AS z FROM x JOIN l ON x.system = l.system AND x.day = l.day JOIN c ON c.system = x.system)
SELECT system, entity, ROUND(GREATEST(0e0, LEAST(2e0, (SUM(w * l * z) + 4) / (SUM(w * l * l) + 4))), 6) AS beta FROM z GROUP BY system, entity""")

plan("risk_decayed_load", """
WITH e AS (SELECT MAX(day) AS today FROM {obs} o), x AS (SELECT entity, day, SUM(CASE WHEN status >= 500 THEN 1 ELSE 0 END) AS e, COUNT(*) AS n, COUNT(DISTINCT token) AS k FROM {obs} o GROUP BY entity, day),
l AS (SELECT entity, SUM(20e0 * x.e / n * POWER(2e0, -(today - day) / 3e0)) AS load, MAX(k) AS k FROM x CROSS JOIN e GROUP BY entity)
SELECT entity, ROUND(100 * (1 - EXP(-LEAST(2.2e0, 1 + 0.3e0 * (k - 1)) * load / 60)), 6) AS risk, CASE WHEN load > 40 THEN 'high' WHEN load > 15 THEN 'medium' ELSE 'low' END AS tier FROM l""")

plan("stage_multiplier", """
SELECT entity, COUNT(DISTINCT CASE token WHEN 'view' THEN 'recon' WHEN 'click' THEN 'recon' WHEN 'signup' THEN 'access' WHEN 'error' THEN 'impact' ELSE 'action' END) AS stages,
       ROUND(LEAST(2.2e0, 1 + 0.3e0 * (COUNT(DISTINCT CASE token WHEN 'view' THEN 'recon' WHEN 'click' THEN 'recon' WHEN 'signup' THEN 'access' WHEN 'error' THEN 'impact' ELSE 'action' END) - 1)), 6) AS multiplier FROM {obs} o GROUP BY entity""")

plan("incident_islands", """
WITH f AS (SELECT system, entity, t, event_id, LAG(t) OVER (PARTITION BY system, entity ORDER BY t, event_id) AS before FROM {obs} o WHERE status >= 500),
i AS (SELECT *, SUM(CASE WHEN t - before <= 172800 THEN 0 ELSE 1 END) OVER (PARTITION BY system, entity ORDER BY t, event_id) AS incident FROM f)
SELECT system, entity, CAST(incident AS BIGINT) AS incident, ROUND(MIN(t), 3) AS opened, ROUND(MAX(t), 3) AS last_t, COUNT(*) AS findings FROM i GROUP BY system, entity, incident""")

plan("incident_rate_limit", """
WITH k AS (SELECT system, event_id, hour, ROW_NUMBER() OVER (PARTITION BY system, hour ORDER BY t, event_id) AS k FROM {obs} o WHERE status >= 500)
SELECT system, hour, COUNT(*) AS findings, CAST(SUM(CASE WHEN k <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM k GROUP BY system, hour""")

plan("campaign_jaccard", """
WITH t AS (SELECT DISTINCT day, system, entity, object_id FROM {obs} o WHERE status >= 500), n AS (SELECT day, system, entity, COUNT(*) AS n FROM t GROUP BY day, system, entity),
c AS (SELECT a.day, a.system, a.entity AS e1, b.entity AS e2, COUNT(*) AS common FROM t a JOIN t b ON a.day = b.day AND a.system = b.system AND a.object_id = b.object_id AND a.entity < b.entity GROUP BY a.day, a.system, a.entity, b.entity)
SELECT c.day, c.system, e1, e2, ROUND(CAST(common AS DOUBLE) / (x.n + y.n - common), 6) AS jaccard FROM c JOIN n x ON x.day = c.day AND x.system = c.system AND x.entity = e1 JOIN n y ON y.day = c.day AND y.system = c.system AND y.entity = e2
WHERE common * 2 >= x.n + y.n - common""")

plan("feedback_precision_beta", """
WITH f AS (SELECT d.source, d.lang, SUM(l.toxic) AS tp, SUM(1 - l.toxic) AS fp FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source, d.lang),
m AS (SELECT lang, (1e0 + SUM(tp)) / (2e0 + SUM(tp) + SUM(fp)) AS mean FROM f GROUP BY lang)
SELECT f.source, f.lang, ROUND((tp + 2 * mean) / (tp + fp + 2), 6) AS precision_key, ROUND(GREATEST(0.2e0, LEAST(1e0, mean / 0.5e0)), 6) AS multiplier FROM f JOIN m ON f.lang = m.lang""")

plan("portrait_version_diff", """
WITH v AS (SELECT CAST(FLOOR((MIN(day) + MAX(day)) / 2e0) AS BIGINT) AS mid FROM {obs} o), n AS (SELECT entity, token, COUNT(CASE WHEN day < mid THEN 1 END) AS old_n, COUNT(CASE WHEN day >= mid THEN 1 END) AS new_n FROM {obs} o CROSS JOIN v GROUP BY entity, token),
s AS (SELECT entity, token, old_n / CAST(NULLIF(SUM(old_n) OVER (PARTITION BY entity), 0) AS DOUBLE) AS a, new_n / CAST(NULLIF(SUM(new_n) OVER (PARTITION BY entity), 0) AS DOUBLE) AS b FROM n)
SELECT entity, token, ROUND(COALESCE(a, 0), 6) AS old_share, ROUND(COALESCE(b, 0), 6) AS new_share, CASE WHEN COALESCE(a, 0) = 0 THEN 'added' WHEN COALESCE(b, 0) = 0 THEN 'removed' ELSE 'kept' END AS change FROM s""")

_over_p("calibration_health", """,
d AS (SELECT day, COUNT(*) AS n, COUNT(CASE WHEN p_rate <= 0.05 THEN 1 END) AS hits FROM p GROUP BY day)
SELECT day, n, hits, ROUND(hits / (0.05e0 * n), 6) AS rate_ratio, CASE WHEN hits / (0.05e0 * n) BETWEEN 0.6 AND 1.6667 THEN 1e0 ELSE 0.5e0 END AS weight FROM d""")

_over_p("dual_anchor", " SELECT entity, day, ROUND(LEAST(1e0, 2 * LEAST(p_rate, p_write)), 6) AS p FROM p")
_over_p("sidak_day", " SELECT day, COUNT(*) AS n, ROUND(1 - POWER(1 - MIN(p_rate), COUNT(*)), 6) AS p_day FROM p GROUP BY day")

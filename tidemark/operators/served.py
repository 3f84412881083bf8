"""What the store and the service answer: ranges, newest rows, versions, clocks, staleness, facets, queues; and sketches
whose state merges by addition or minimum. Each oracle says the same in another way."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import pairs
from tidemark.plans.catalog import query
from tidemark.plans.dialect import oracle, plan, run

plan("vec_since_range", """
WITH n AS (SELECT entity, MAX(us) AS newest FROM {obs} o GROUP BY entity)
SELECT o.entity, event_id, ROUND(t, 3) AS t, up FROM {obs} o JOIN n ON o.entity = n.entity AND o.us >= n.newest - 172800000000 AND o.us < n.newest - 43200000000""", """
SELECT entity, event_id, ROUND(t, 3) AS t, up FROM (SELECT *, MAX(us) OVER (PARTITION BY entity) - us AS age FROM {obs}) q WHERE age > 43200000000 AND age <= 172800000000""")

plan("events_newest", """
SELECT event_id, system, entity, token, ROUND(t, 3) AS t FROM {obs} o WHERE token IN ('error', 'signup') AND system IN ('sys0', 'sys2') ORDER BY us DESC, event_id DESC LIMIT 100""", """
SELECT event_id, system, entity, token, ROUND(t, 3) AS t FROM {obs} o WHERE (token = 'error' OR token = 'signup') AND system <> 'sys1'
QUALIFY ROW_NUMBER() OVER (ORDER BY us DESC, event_id DESC) <= 100""")

plan("model_versions", """
WITH v AS (SELECT priority AS model, day, COUNT(*) AS rows_fitted, ROW_NUMBER() OVER (PARTITION BY priority ORDER BY day) AS version FROM {ord} o GROUP BY priority, day)
SELECT model, MAX(version) AS version, MAX_BY(day, version) AS fitted, MAX_BY(rows_fitted, version) AS rows_fitted FROM v GROUP BY model""", """
WITH d AS (SELECT priority AS model, MAX(day) AS fitted, COUNT(DISTINCT day) AS version FROM {ord} GROUP BY priority)
SELECT model, version, fitted, (SELECT COUNT(*) FROM {ord} x WHERE x.priority = d.model AND x.day = d.fitted) AS rows_fitted FROM d""")

plan("batch_compaction", """
WITH e AS (SELECT system, MAX(hour) AS last_hour FROM {obs} o GROUP BY system),
b AS (SELECT o.system, CASE WHEN o.hour < e.last_hour - 48 THEN 'day-' || CAST(o.day AS STRING) ELSE 'hour-' || CAST(o.hour AS STRING) END AS batch, o.us, o.event_id FROM {obs} o JOIN e ON o.system = e.system)
SELECT system, batch, COUNT(*) AS n, MIN(event_id) AS first_id, MAX(event_id) AS last_id, ROUND((MAX(us) - MIN(us)) / 1e6, 3) AS span_s FROM b GROUP BY system, batch""", """
WITH b AS (SELECT *, hour < MAX(hour) OVER (PARTITION BY system) - 48 AS old FROM {obs}),
k AS (SELECT system, 'day-' || day AS batch, * EXCLUDE (system) FROM b WHERE old UNION ALL SELECT system, 'hour-' || hour, * EXCLUDE (system) FROM b WHERE NOT old)
SELECT system, batch, COUNT(*) AS n, MIN(event_id) AS first_id, MAX(event_id) AS last_id, ROUND((MAX(us) - MIN(us)) / 1e6, 3) AS span_s FROM k GROUP BY ALL""")

plan("tick_clock_idle", """
WITH s AS (SELECT system, MIN(hour) AS lo, MAX(hour) AS hi FROM {obs} o GROUP BY system), g AS (SELECT system, EXPLODE(SEQUENCE(lo, hi)) AS hour FROM s),
n AS (SELECT system, hour, COUNT(*) AS n FROM {obs} o GROUP BY system, hour)
SELECT g.system, CAST(FLOOR(g.hour / 24e0) AS BIGINT) AS day, COUNT(*) AS ticks, CAST(SUM(CASE WHEN n.n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS idle
FROM g LEFT JOIN n ON n.system = g.system AND n.hour = g.hour GROUP BY g.system, CAST(FLOOR(g.hour / 24e0) AS BIGINT)""", """
WITH s AS (SELECT system, MIN(hour) AS lo, MAX(hour) AS hi FROM {obs} GROUP BY system), d AS (SELECT system, UNNEST(range(lo // 24, hi // 24 + 1)) AS day, lo, hi FROM s),
t AS (SELECT system, day, LEAST(hi, day * 24 + 23) - GREATEST(lo, day * 24) + 1 AS ticks FROM d), a AS (SELECT system, day, COUNT(DISTINCT hour) AS busy FROM {obs} GROUP BY system, day)
SELECT t.system, t.day, t.ticks, t.ticks - COALESCE(busy, 0) AS idle FROM t LEFT JOIN a USING (system, day)""")

plan("store_health", """
WITH w AS (SELECT system, token, MAX(us) AS last_us FROM {obs} o GROUP BY system, token), e AS (SELECT MAX(us) AS now_us FROM {obs} o)
SELECT system, token, ROUND(last_us / 1e6, 3) AS last_write, ROUND((now_us - last_us) / 1e6, 3) AS staleness_s, CASE WHEN now_us - last_us <= 900000000 THEN 'ok' WHEN now_us - last_us <= 21600000000 THEN 'stale' ELSE 'silent' END AS health FROM w CROSS JOIN e""", """
SELECT system, token, ROUND(m, 3) AS last_write, ROUND(s, 3) AS staleness_s, CASE WHEN s > 21600 THEN 'silent' WHEN s > 900 THEN 'stale' ELSE 'ok' END AS health
FROM (SELECT system, token, MAX(us) / 1e6 AS m, ((SELECT MAX(us) FROM {obs}) - MAX(us)) / 1e6 AS s FROM {obs} GROUP BY system, token) q""")

plan("memory_report", """
SELECT 'documents' AS layer, COUNT(*) AS points, CAST(COALESCE(SUM(LENGTH(text)), 0) + 8 * COUNT(*) AS BIGINT) AS size FROM {documents} d UNION ALL
SELECT 'pages', COUNT(*), CAST(COALESCE(SUM(LENGTH(html) + LENGTH(url)), 0) + 8 * COUNT(*) AS BIGINT) FROM {pages} p UNION ALL
SELECT 'events', COUNT(*), CAST(SUM(LENGTH(event_type) + LENGTH(props)) + 32 * COUNT(*) AS BIGINT) FROM {events} e""", """
SELECT 'documents' AS layer, COUNT(*) AS points, SUM(8 + COALESCE(LENGTH(text), 0))::BIGINT AS size FROM {documents} UNION ALL
SELECT 'pages', COUNT(*), SUM(8 + COALESCE(LENGTH(html), 0) + COALESCE(LENGTH(url), 0))::BIGINT FROM {pages} UNION ALL
SELECT 'events', COUNT(*), SUM(32 + LENGTH(event_type) + LENGTH(props))::BIGINT FROM {events}""")

plan("overview_breakdown", """
WITH r AS (SELECT event_id, system, token, up, us FROM {obs} o ORDER BY us DESC, event_id DESC LIMIT 500)
SELECT system, token, CASE WHEN up >= 30 THEN 'high' WHEN up >= 10 THEN 'medium' ELSE 'low' END AS severity, COUNT(*) AS n, MAX(event_id) AS newest_id FROM r GROUP BY system, token, CASE WHEN up >= 30 THEN 'high' WHEN up >= 10 THEN 'medium' ELSE 'low' END""", """
WITH r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY us DESC, event_id DESC) AS k FROM {obs}), s AS (SELECT *, CASE WHEN up < 10 THEN 'low' WHEN up < 30 THEN 'medium' ELSE 'high' END AS severity FROM r WHERE k <= 500)
SELECT system, token, severity, COUNT(*) AS n, MAX(event_id) AS newest_id FROM s GROUP BY ALL""")

plan("entity_feature_rows", """
WITH d AS (SELECT entity, token, day, COUNT(*) AS n FROM {obs} o GROUP BY entity, token, day),
q AS (SELECT entity, token, PERCENTILE(n, 0.05) AS p5, PERCENTILE(n, 0.5) AS p50, PERCENTILE(n, 0.95) AS p95, MAX_BY(n, day) AS latest, COUNT(*) AS days FROM d GROUP BY entity, token),
m AS (SELECT d.entity, d.token, 1.4826e0 * PERCENTILE(ABS(n - p50), 0.5) AS mad FROM d JOIN q ON d.entity = q.entity AND d.token = q.token GROUP BY d.entity, d.token)
SELECT q.entity, q.token, ROUND(p5, 6) AS p5, ROUND(p50, 6) AS p50, ROUND(p95, 6) AS p95, latest, days, ROUND((latest - p50) / GREATEST(mad, 0.5e0), 6) AS zr FROM q JOIN m ON q.entity = m.entity AND q.token = m.token""", """
WITH d AS (SELECT entity, token, day, COUNT(*) AS n FROM {obs} GROUP BY ALL)
SELECT entity, token, ROUND(quantile_cont(n, 0.05), 6) AS p5, ROUND(median(n), 6) AS p50, ROUND(quantile_cont(n, 0.95), 6) AS p95, arg_max(n, day) AS latest, COUNT(*) AS days,
       ROUND((arg_max(n, day) - median(n)) / GREATEST(1.4826 * mad(n), 0.5), 6) AS zr FROM d GROUP BY entity, token""")

plan("series_thinned", """
WITH h AS (SELECT system, hour, COUNT(*) AS n FROM {obs} o GROUP BY system, hour), b AS (SELECT *, NTILE(50) OVER (PARTITION BY system ORDER BY hour) AS bin FROM h)
SELECT system, CAST(bin AS BIGINT) AS bin, MIN(hour) AS from_hour, MAX(hour) AS to_hour, MAX(n) AS peak, COUNT(*) AS points FROM b GROUP BY system, bin""", """
WITH h AS (SELECT system, hour, COUNT(*) AS n FROM {obs} GROUP BY system, hour), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY system ORDER BY hour) - 1 AS k, COUNT(*) OVER (PARTITION BY system) AS m FROM h),
b AS (SELECT *, CASE WHEN k < (m % 50) * (m // 50 + 1) THEN k // (m // 50 + 1) ELSE m % 50 + (k - (m % 50) * (m // 50 + 1)) // GREATEST(m // 50, 1) END + 1 AS bin FROM k)
SELECT system, bin, MIN(hour) AS from_hour, MAX(hour) AS to_hour, MAX(n) AS peak, COUNT(*) AS points FROM b GROUP BY system, bin""")

plan("label_queue", """
WITH n AS (SELECT d.doc_id, d.source, d.n_chars, l.quality, l.toxic FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id),
r AS (SELECT source, AVG(CAST(toxic AS DOUBLE)) AS rate FROM n WHERE toxic IS NOT NULL GROUP BY source),
q AS (SELECT n.doc_id, n.source, r.rate, ROW_NUMBER() OVER (PARTITION BY n.source ORDER BY n.n_chars DESC, n.doc_id) AS longest, ROW_NUMBER() OVER (PARTITION BY n.source ORDER BY n.doc_id) AS oldest FROM n JOIN r ON n.source = r.source WHERE n.toxic IS NULL)
SELECT doc_id, source, ROUND(ABS(rate - 0.5e0), 6) AS certainty, CASE WHEN oldest <= 5 THEN 'held' ELSE 'risk' END AS reason FROM q WHERE longest <= 5 OR oldest <= 5""", """
WITH u AS (SELECT doc_id, source, n_chars FROM {documents} WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = documents.doc_id AND l.toxic IS NOT NULL)),
r AS (SELECT source, SUM(toxic)::DOUBLE / COUNT(toxic) AS rate FROM {documents} JOIN {labels} USING (doc_id) GROUP BY source HAVING COUNT(toxic) > 0),
h AS (SELECT doc_id, source FROM u QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) <= 5), k AS (SELECT doc_id, source FROM u QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5)
SELECT q.doc_id, q.source, ROUND(ABS(rate - 0.5), 6) AS certainty, q.reason FROM (SELECT *, 'held' AS reason FROM h UNION ALL SELECT *, 'risk' FROM k WHERE doc_id NOT IN (SELECT doc_id FROM h)) q JOIN r USING (source)""")

plan("group_lattice_bfs", """
WITH RECURSIVE e AS (SELECT DISTINCT before, token FROM (SELECT LAG(token) OVER (PARTITION BY entity ORDER BY t, event_id) AS before, token FROM {obs} o) q WHERE before IS NOT NULL AND before <> token),
w AS (SELECT 'signup' AS token, 0 AS depth UNION ALL SELECT e.token, w.depth + 1 FROM w JOIN e ON e.before = w.token WHERE w.depth < 3)
SELECT token, CAST(MIN(depth) AS BIGINT) AS depth FROM w GROUP BY token""", """
WITH e AS (SELECT DISTINCT before, token FROM (SELECT LAG(token) OVER (PARTITION BY entity ORDER BY t, event_id) AS before, token FROM {obs}) q WHERE before <> token),
a AS (SELECT token FROM e WHERE before = 'signup'), b AS (SELECT e.token FROM e JOIN a ON e.before = a.token), c AS (SELECT e.token FROM e JOIN b ON e.before = b.token)
SELECT token, MIN(depth)::BIGINT AS depth FROM (SELECT 'signup' AS token, 0 AS depth UNION ALL SELECT token, 1 FROM a UNION ALL SELECT token, 2 FROM b UNION ALL SELECT token, 3 FROM c) q GROUP BY token""")

plan("facet_counts", """
WITH f AS (SELECT system, token, CASE WHEN status >= 500 THEN 'open' ELSE 'closed' END AS state FROM {obs} o)
SELECT COALESCE(system, '*') AS system, COALESCE(token, '*') AS token, COALESCE(state, '*') AS state, COUNT(*) AS n FROM f GROUP BY GROUPING SETS ((system), (token), (state), ())""", """
WITH f AS (SELECT system, token, IF(status < 500, 'closed', 'open') AS state FROM {obs})
SELECT system, '*' AS token, '*' AS state, COUNT(*) AS n FROM f GROUP BY system UNION ALL SELECT '*', token, '*', COUNT(*) FROM f GROUP BY token UNION ALL SELECT '*', '*', state, COUNT(*) FROM f GROUP BY state UNION ALL SELECT '*', '*', '*', COUNT(*) FROM f""")

plan("raw_dport_set", """
WITH n AS (SELECT system, class, dport, CAST(SUM(w) AS BIGINT) AS n FROM {flow} f WHERE w > 0 AND dport BETWEEN 1 AND 65535 GROUP BY system, class, dport), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY system, class ORDER BY n DESC, dport) AS k FROM n)
SELECT system, class, CASE WHEN k <= 4 THEN CAST(dport AS STRING) ELSE '__other__' END AS dport, CAST(SUM(n) AS BIGINT) AS n FROM r GROUP BY system, class, CASE WHEN k <= 4 THEN CAST(dport AS STRING) ELSE '__other__' END""", """
WITH n AS (SELECT system, class, dport, SUM(w)::BIGINT AS n FROM {flow} GROUP BY ALL), t AS (SELECT * FROM n QUALIFY RANK() OVER (PARTITION BY system, class ORDER BY n DESC, dport) <= 4)
SELECT system, class, dport::VARCHAR AS dport, n FROM t UNION ALL
SELECT system, class, '__other__', SUM(n)::BIGINT FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.system = n.system AND t.class = n.class AND t.dport = n.dport) GROUP BY system, class""")

plan("raw_path_set", """
WITH n AS (SELECT system, day, object_id, COUNT(*) AS n FROM {obs} o GROUP BY system, day, object_id), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY system, day ORDER BY n DESC, object_id) AS k FROM n)
SELECT system, day, CASE WHEN k <= 16 THEN CAST(object_id AS STRING) ELSE '__other__' END AS path, CAST(SUM(n) AS BIGINT) AS n FROM r GROUP BY system, day, CASE WHEN k <= 16 THEN CAST(object_id AS STRING) ELSE '__other__' END""", """
WITH n AS (SELECT system, day, object_id, COUNT(*) AS n FROM {obs} GROUP BY ALL), t AS (SELECT * FROM n QUALIFY RANK() OVER (PARTITION BY system, day ORDER BY n DESC, object_id) <= 16), a AS (SELECT system, day, COUNT(*) AS n FROM {obs} GROUP BY ALL)
SELECT system, day, object_id::VARCHAR AS path, n FROM t UNION ALL SELECT a.system, a.day, '__other__', a.n - SUM(t.n)::BIGINT FROM a JOIN t ON a.system = t.system AND a.day = t.day GROUP BY a.system, a.day, a.n HAVING a.n > SUM(t.n)""")

# Signed feature hashing: 16 buckets by one digit of a digest, the sign by the next, root shares as weights, unit length.
plan("signed_feature_hash", """
WITH c AS (SELECT entity, token || '/' || CAST(object_id % 8 AS STRING) AS f, COUNT(*) AS n FROM {obs} o GROUP BY entity, token || '/' || CAST(object_id % 8 AS STRING)),
s AS (SELECT entity, f, SQRT(n / CAST(SUM(n) OVER (PARTITION BY entity) AS DOUBLE)) AS w, HEX8(f, 1) AS h FROM c),
b AS (SELECT entity, h % 16 AS bucket, SUM(CASE WHEN CAST(FLOOR(h / 16e0) AS BIGINT) % 2 = 0 THEN w ELSE -w END) AS v FROM s GROUP BY entity, h % 16)
SELECT entity, bucket, ROUND(COALESCE(v / NULLIF(SQRT(SUM(v * v) OVER (PARTITION BY entity)), 0), 0), 6) + 0e0 AS x FROM b""", """
WITH o AS (SELECT entity, token || '/' || (object_id % 8) AS f FROM {obs}), t AS (SELECT entity, COUNT(*)::DOUBLE AS m FROM o GROUP BY entity),
s AS (SELECT o.entity, f, SQRT(COUNT(*) / ANY_VALUE(m)) AS w, instr('0123456789abcdef', substr(md5(f), 8, 1)) - 1 AS bucket, instr('0123456789abcdef', substr(md5(f), 7, 1)) - 1 AS sign FROM o JOIN t ON o.entity = t.entity GROUP BY o.entity, f),
b AS (SELECT entity, bucket, SUM(w * (1 - 2 * (sign % 2))) AS v FROM s GROUP BY entity, bucket), l AS (SELECT entity, SQRT(SUM(v * v)) AS norm FROM b GROUP BY entity)
SELECT b.entity, bucket, ROUND(CASE WHEN norm = 0 THEN 0 ELSE v / norm END, 6) + 0e0 AS x FROM b JOIN l ON b.entity = l.entity""")

# Count-Min: four rows of 64 counters, which merge by addition; an estimate is the least of a key's counters.
plan("count_min_estimate", """
WITH k AS (SELECT CAST(object_id AS STRING) || ':' || token AS f, COUNT(*) AS n FROM {obs} o GROUP BY CAST(object_id AS STRING) || ':' || token),
c AS (SELECT f, n, r, CASE r WHEN 0 THEN HEX8(f, 1) WHEN 1 THEN HEX8(f, 9) WHEN 2 THEN HEX8(f, 17) ELSE HEX8(f, 25) END % 64 AS place FROM k CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(r)),
s AS (SELECT r, place, SUM(n) AS total FROM c GROUP BY r, place)
SELECT c.f, MAX(c.n) AS n, CAST(MIN(s.total) AS BIGINT) AS estimate FROM c JOIN s ON c.r = s.r AND c.place = s.place GROUP BY c.f""", """
WITH k AS (SELECT object_id || ':' || token AS f, COUNT(*) AS n, ('0x' || md5(object_id || ':' || token)[5:8])::INT % 64 AS p0, ('0x' || md5(object_id || ':' || token)[13:16])::INT % 64 AS p1, ('0x' || md5(object_id || ':' || token)[21:24])::INT % 64 AS p2, ('0x' || md5(object_id || ':' || token)[29:32])::INT % 64 AS p3 FROM {obs} GROUP BY object_id, token)
SELECT f, n, LEAST(SUM(n) OVER (PARTITION BY p0), SUM(n) OVER (PARTITION BY p1), SUM(n) OVER (PARTITION BY p2), SUM(n) OVER (PARTITION BY p3))::BIGINT AS estimate FROM k""")

_SETS = "SELECT entity AS id, token || '/' || CAST(object_id % 4 AS STRING) AS f, COUNT(*) AS w FROM {obs} o GROUP BY entity, token || '/' || CAST(object_id % 4 AS STRING)"
_ALIKE = "e1 long, e2 long, jaccard double"


def _sets(spark, sf_dir):
    return run(spark, sf_dir, _SETS).where("id IS NOT NULL AND f IS NOT NULL")


def _totalled(table: pa.Table) -> pairs.Block:
    block = pairs.from_rows(table)
    block.columns["total"] = np.add.reduceat(block.w, block.ptr[:-1])
    return block


def _alike(a: pairs.Block, b: pairs.Block, x: np.ndarray, y: np.ndarray, common: np.ndarray) -> dict:
    total = a.columns["total"][x] + b.columns["total"][y]
    return pairs.ends(a, b, x, y) | {"jaccard": pairs.rounded(common / (total - common), 6)}


def _half(a: pairs.Block, b: pairs.Block):
    """Keeps pairs of a weighted Jaccard index of a half or more, each once."""
    p, q = a.columns["total"], b.columns["total"]

    def keep(x, y, values):
        m = 3 * values[0] >= p[x] + q[y]
        return m & (x < y) if a is b else m

    return keep


#: Hashes of the consistent weighted sampling below, and bands of them.
HASHES, BANDS = 64, 16


def _hex8(names: list[str], tail: str, place: int) -> np.ndarray:
    """A number below 2 ** 32 for each name and hash: eight digits of its digest."""
    return np.array([[int(hashlib.md5(f"{f}{tail}{k}".encode()).hexdigest()[place : place + 8], 16) for k in range(HASHES)] for f in names], float).reshape(-1, HASHES)


def band_keys(block: pairs.Block) -> np.ndarray:
    """A 64-bit key for each entity and band: of each hash the feature of least a_k with its level, four choices a band."""
    r = -np.log((_hex8(block.names, "#", 0) + 1) / 4294967297.0) - np.log((_hex8(block.names, "#", 8) + 1) / 4294967297.0)
    c = -np.log((_hex8(block.names, "#", 16) + 1) / 4294967297.0) - np.log((_hex8(block.names, "#", 24) + 1) / 4294967297.0)
    beta = _hex8(block.names, "@", 0) / 4294967296.0
    name = np.array([int(hashlib.md5(f.encode()).hexdigest()[:16], 16) for f in block.names], np.uint64)
    cuts = np.unique(np.searchsorted(block.ptr, np.arange(0, len(block.at) + 65536, 65536), side="right") - 1)
    keys = np.empty((len(block), HASHES), np.uint64)
    for a, b in zip(cuts, np.append(cuts[1:], len(block))):
        if a == b:
            continue
        own = slice(block.ptr[a], block.ptr[b])
        at, n = block.at[own], np.diff(block.ptr[a : b + 1])
        level = np.floor(np.log(block.w[own])[:, None] / r[at] + beta[at])
        cost = c[at] * np.exp(-r[at] * (level - beta[at]) - r[at])
        row = np.repeat(np.arange(b - a), n)
        least = np.minimum.reduceat(cost, block.ptr[a:b] - block.ptr[a])
        entry, k = np.nonzero(cost == least[row])
        keys[a + row[entry], k] = _mixed(name[at[entry]], level[entry, k].astype(np.int64).astype(np.uint64))
    out = np.arange(BANDS, dtype=np.uint64) + np.zeros((len(block), 1), np.uint64)
    for step in range(HASHES // BANDS):
        out = _mixed(out, keys[:, step :: HASHES // BANDS])
    return out.view(np.int64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two (the finaliser of SplitMix64)."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _banded(table: pa.Table) -> pairs.Block:
    block = _totalled(table)
    block.columns["keys"] = band_keys(block)
    return block


def _keyed(block: pairs.Block) -> pairs.Block:
    """A block whose features are its band keys."""
    names, at = np.unique(block.columns["keys"], return_inverse=True)
    n = len(block) * BANDS
    return pairs.Block(block.ids, np.arange(0, n + 1, BANDS), at.ravel(), np.ones(n), names.tolist())


def _common(a: pairs.Block, b: pairs.Block, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of lesser weights of single pairs, from lists of their features."""
    where = {f: k for k, f in enumerate(b.names)}
    to = np.array([where.get(f, -1) for f in a.names], np.int64)
    pair, at, w = a.take(x, to)
    other, bt, v = b.take(y, np.arange(len(b.names)))
    left, right = pair * len(b.names) + at, other * len(b.names) + bt
    order = np.argsort(right)
    k = np.minimum(np.searchsorted(right, left, sorter=order), len(right) - 1)
    k = order[k]
    m = right[k] == left
    return np.bincount(pair[m], np.minimum(w[m], v[k[m]]), minlength=len(x))


#: More shared keys than this part of all pairs: lesser weights of all pairs cost less than those of candidates one by one.
MANY = 1 / 40


@query("weighted_minhash_pairs")
def weighted_minhash_pairs(spark, sf_dir):
    """Consistent weighted sampling: equal choices (feature and level) estimate weighted Jaccard. 64 hashes in 16 bands give
    candidates, which exact minima and maxima confirm, block by block; only blocks are shuffled."""

    def work(a: pairs.Block, b: pairs.Block) -> Iterator[dict]:
        half = _half(a, b)
        p = _keyed(a)
        q = p if a is b else _keyed(b)
        where = dict(zip(q.names, np.bincount(q.at).tolist()))
        hits = sum(n * where.get(f, 0) for f, n in zip(p.names, np.bincount(p.at).tolist()))
        if hits > MANY * len(a) * len(b):
            codes = {f: k for k, f in enumerate(q.names)}
            r = np.array([codes.get(f, -1) for f in p.names], np.int32)[p.at].reshape(-1, BANDS)
            c = q.at.astype(np.int32).reshape(-1, BANDS)

            def keep(x, y, values):
                m = half(x, y, values)
                near = np.zeros(m.shape, bool)
                for k in range(BANDS):
                    near |= r[x, k] == c[y, k]
                return m & near

            for x, y, (common,) in pairs.overlaps(a, b, "least", keep):
                yield _alike(a, b, x, y, common.astype(float))
            return
        for x, y, _ in pairs.overlaps(p, q, "least", (lambda x, y, v: x < y) if a is b else (lambda x, y, v: v[0] > 0)):
            common = _common(a, b, x, y)
            m = half(x, y, [common])
            if m.any():
                yield _alike(a, b, x[m], y[m], common[m])

    n, line = pairs.PLANE
    return pairs.block_pairs(pairs.blocks(_sets(spark, sf_dir), _banded, n), (n, line), work, _ALIKE)


@query("weighted_jaccard_exact", oracle("""
WITH f AS (SELECT entity, token || '/' || (object_id % 4) AS f, COUNT(*) AS w FROM {obs} GROUP BY ALL), e AS (SELECT DISTINCT f FROM f), p AS (SELECT a.entity AS e1, b.entity AS e2 FROM (SELECT DISTINCT entity FROM f) a JOIN (SELECT DISTINCT entity FROM f) b ON a.entity < b.entity),
j AS (SELECT e1, e2, SUM(LEAST(COALESCE(x.w, 0), COALESCE(y.w, 0)))::DOUBLE / SUM(GREATEST(COALESCE(x.w, 0), COALESCE(y.w, 0))) AS j FROM p CROSS JOIN e LEFT JOIN f x ON x.entity = e1 AND x.f = e.f LEFT JOIN f y ON y.entity = e2 AND y.f = e.f GROUP BY e1, e2)
SELECT e1, e2, ROUND(j, 6) AS jaccard FROM j WHERE j >= 0.5"""))
def weighted_jaccard_exact(spark, sf_dir):
    """Pairs of entities by their sums of lesser weights, block by block."""

    def work(a: pairs.Block, b: pairs.Block) -> Iterator[dict]:
        for x, y, (common,) in pairs.overlaps(a, b, "least", _half(a, b)):
            yield _alike(a, b, x, y, common.astype(float))

    n, line = pairs.PLANE
    return pairs.block_pairs(pairs.blocks(_sets(spark, sf_dir), _totalled, n), (n, line), work, _ALIKE)


def _normed(table: pa.Table) -> pairs.Block:
    block = pairs.from_rows(table)
    block.columns["norm"] = np.sqrt(np.add.reduceat(block.w * block.w, block.ptr[:-1]))
    return block


@query("mutual_ten_nearest", oracle("""
WITH f AS (SELECT entity, COUNT(*) FILTER (token = 'view')::DOUBLE AS v, COUNT(*) FILTER (token = 'click')::DOUBLE AS c, COUNT(*) FILTER (token = 'purchase')::DOUBLE AS p, COUNT(*) FILTER (token = 'signup')::DOUBLE AS s, COUNT(*) FILTER (token = 'error')::DOUBLE AS e FROM {obs} GROUP BY entity),
s AS (SELECT a.entity AS e1, b.entity AS e2, ROUND((a.v * b.v + a.c * b.c + a.p * b.p + a.s * b.s + a.e * b.e) / (SQRT(a.v ** 2 + a.c ** 2 + a.p ** 2 + a.s ** 2 + a.e ** 2) * SQRT(b.v ** 2 + b.c ** 2 + b.p ** 2 + b.s ** 2 + b.e ** 2)), 9) AS cos FROM f a JOIN f b ON a.entity <> b.entity),
t AS (SELECT * FROM s WHERE cos > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY e1 ORDER BY cos DESC, e2) <= 10)
SELECT e1, e2, ROUND(cos, 6) AS cos FROM t WHERE e1 < e2 AND EXISTS (SELECT 1 FROM t b WHERE b.e1 = t.e2 AND b.e2 = t.e1)"""))
def mutual_ten_nearest(spark, sf_dir):
    """The entities of a block against all blocks, ten best each; of these the pairs that are there both ways."""

    def work(g: int, held: dict[int, bytes]) -> Iterator[dict]:
        if g not in held:
            return
        a = pairs.Block.unpack(held[g])
        tops, p = pairs.Tops(len(a), 10), a.columns["norm"]
        for k, data in held.items():
            b = a if k == g else pairs.Block.unpack(data)
            q = b.columns["norm"]

            def keep(x, y, values):
                m = values[0] >= tops.floor()[x] * (p[x] * q[y])
                return m & (x != y) if b is a else m

            for x, y, (dot,) in pairs.overlaps(a, b, "dot", keep):
                tops.add(x, b.ids[y], dot / (p[x] * q[y]))
        yield tops.rows(a.ids)

    n, _ = pairs.PLANE
    sets = run(spark, sf_dir, "SELECT entity AS id, token AS f, COUNT(*) AS w FROM {obs} o GROUP BY entity, token").where("id IS NOT NULL AND f IS NOT NULL")
    near = pairs.in_groups(pairs.blocks(sets, _normed, n), F.sequence(F.lit(0), F.lit(n - 1)), n, work, "id long, other long, value double")
    return near.groupBy(F.least("id", "other").alias("e1"), F.greatest("id", "other").alias("e2")).agg(F.count("*").alias("n"), F.max("value").alias("cos")).where("n = 2").select("e1", "e2", F.round(F.round("cos", 9), 6).alias("cos"))

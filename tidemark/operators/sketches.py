"""Mergeable summaries and samples, and the operators that judge results.

Where a summary of the stream is exact in batch (decayed counts, top-k, heavy hitters), it is computed exactly. The
HyperLogLog queries are approximate and have no oracle. Uniform numbers come from ids by a multiplicative hash.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import pairs
from tidemark.operators.rules import _MATCHES
from tidemark.plans.catalog import query
from tidemark.plans.dialect import oracle, plan
from tidemark.sources.tables import table

_U = "(((event_id * 2654435761 + 12345) % 4294967296) + 0.5e0) / 4294967296e0"

plan("sketch_hll_per_day", "SELECT system, day, hll_sketch_estimate(hll_sketch_agg(entity, 10)) AS entities FROM {obs} o GROUP BY system, day", with_oracle=False)

plan("sketch_hll_union", """
WITH d AS (SELECT system, day, hll_sketch_agg(entity, 10) AS s FROM {obs} o GROUP BY system, day)
SELECT system, hll_sketch_estimate(hll_union_agg(s)) AS entities FROM d GROUP BY system""", with_oracle=False)

plan("sketch_quantiles", "SELECT system, percentile_approx(up, array(0.5D, 0.95D, 0.99D), 10000) AS q FROM {obs} o GROUP BY system", with_oracle=False)

plan("sketch_decayed_topk", """
WITH n AS (SELECT MAX(t) AS now FROM {obs} o), d AS (SELECT system, object_id, SUM(POWER(2e0, -(now - t) / 604800e0)) AS mass FROM {obs} o CROSS JOIN n GROUP BY system, object_id),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY system ORDER BY ROUND(mass, 9) DESC, object_id) AS k FROM d)
SELECT system, CAST(k AS BIGINT) AS k, object_id, ROUND(mass, 6) AS mass FROM k WHERE k <= 16""")

plan("sample_weighted_reservoir", f"""
WITH u AS (SELECT system, event_id, up, -LN({_U}) / GREATEST(up, 1e-9) AS score FROM {{obs}} o), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY system ORDER BY score, event_id) AS k FROM u)
SELECT system, event_id, ROUND(up, 6) AS weight FROM k WHERE k <= 32""")

plan("sample_priority", f"""
WITH u AS (SELECT system, event_id, up, up / ({_U}) AS q FROM {{obs}} o WHERE up > 0), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY system ORDER BY q DESC, event_id) AS k FROM u), t AS (SELECT system, MAX(q) AS tau FROM k WHERE k > 32 GROUP BY system)
SELECT k.system, k.event_id, ROUND(GREATEST(up, tau), 4) AS estimate FROM k JOIN t ON k.system = t.system WHERE k <= 32""")

plan("sample_stratified_threshold", f"""
WITH c AS (SELECT entity, CAST(COUNT(*) AS DOUBLE) AS c FROM {{obs}} o GROUP BY entity), r AS (SELECT c, ROW_NUMBER() OVER (ORDER BY c, entity) AS k, COUNT(*) OVER () AS m, COALESCE(SUM(c) OVER (ORDER BY c, entity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS below FROM c),
t AS (SELECT MIN(tau) AS tau FROM (SELECT (500 - below) / (m - k + 1) AS tau, c FROM r) x WHERE tau <= c AND tau > 0)
SELECT event_id, ROUND(GREATEST(1e0, c.c / tau), 6) AS weight FROM {{obs}} o JOIN c ON o.entity = c.entity CROSS JOIN t WHERE {_U} < tau / c.c""")

plan("drift_page_hinkley", """
WITH x AS (SELECT system, hour, CAST(COUNT(*) AS DOUBLE) AS n FROM {obs} o GROUP BY system, hour), m AS (SELECT system, hour, n - AVG(n) OVER v - 0.05e0 AS d FROM x WINDOW v AS (PARTITION BY system ORDER BY hour ROWS UNBOUNDED PRECEDING)),
s AS (SELECT system, hour, SUM(d) OVER (PARTITION BY system ORDER BY hour ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT system, hour, ROUND(s - MIN(s) OVER (PARTITION BY system ORDER BY hour ROWS UNBOUNDED PRECEDING), 6) AS ph FROM s""")

plan("heavy_hitters_hierarchical", """
WITH n AS (SELECT CAST(FLOOR(peer / 100e0) AS BIGINT) AS p2, CAST(FLOOR(peer / 10e0) AS BIGINT) AS p1, SUM(w) AS n FROM {flow} f GROUP BY CAST(FLOOR(peer / 100e0) AS BIGINT), CAST(FLOOR(peer / 10e0) AS BIGINT)),
t AS (SELECT SUM(n) AS t FROM n), h AS (SELECT p1, p2, n FROM n CROSS JOIN t WHERE n >= 0.015 * t), r AS (SELECT n.p2, SUM(n.n) - COALESCE(SUM(h.n), 0) AS residual FROM n LEFT JOIN h ON n.p1 = h.p1 AND n.p2 = h.p2 GROUP BY n.p2)
SELECT 1 AS level, p1 AS prefix, CAST(n AS BIGINT) AS mass FROM h UNION ALL SELECT 2 AS level, p2 AS prefix, CAST(residual AS BIGINT) AS mass FROM r CROSS JOIN t WHERE residual >= 0.05 * t""")

plan("intervals_merged", """
WITH i AS (SELECT entity, t - 7200 AS a, t + 7200 AS b, event_id FROM {obs} o), m AS (SELECT *, MAX(b) OVER (PARTITION BY entity ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT entity, a, b, SUM(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY a, event_id) AS island FROM m)
SELECT entity, COUNT(DISTINCT island) AS windows, COUNT(*) AS events, CAST(MAX(island) AS BIGINT) AS last_island FROM g GROUP BY entity""")

plan("exposure_without_excluded", """
WITH x AS (SELECT DISTINCT entity, day FROM {obs} o WHERE status >= 500), d AS (SELECT DISTINCT entity, day FROM {obs} o)
SELECT d.entity, COUNT(*) AS exposed_days FROM d WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.entity = d.entity AND x.day BETWEEN d.day - 1 AND d.day) GROUP BY d.entity""")

plan("detection_precision_recall", _MATCHES + """,
truth AS (SELECT entity, day FROM {obs} o WHERE status >= 500 GROUP BY entity, day HAVING COUNT(*) >= 2), found AS (SELECT DISTINCT rule, entity, day FROM matches), n AS (SELECT COUNT(*) AS n FROM truth)
SELECT f.rule, COUNT(*) AS alerts, COUNT(t.entity) AS hits, ROUND(CAST(COUNT(t.entity) AS DOUBLE) / COUNT(*), 6) AS precision_, ROUND(CAST(COUNT(t.entity) AS DOUBLE) / NULLIF(MAX(n.n), 0), 6) AS recall
FROM found f CROSS JOIN n LEFT JOIN truth t ON t.entity = f.entity AND t.day = f.day GROUP BY f.rule""")

plan("false_alarm_rate", _MATCHES + """,
e AS (SELECT COUNT(*) AS days FROM (SELECT DISTINCT entity, day FROM {obs} o) d)
SELECT category, COUNT(*) AS alerts, ROUND(CAST(COUNT(*) AS DOUBLE) / MAX(days), 6) AS per_entity_day FROM matches CROSS JOIN e GROUP BY category""")

plan("rank_correlation", """
WITH x AS (SELECT entity, COUNT(*) AS n, COUNT(DISTINCT object_id) AS k FROM {obs} o GROUP BY entity), r AS (SELECT CAST(RANK() OVER (ORDER BY n) AS DOUBLE) AS a, CAST(RANK() OVER (ORDER BY k) AS DOUBLE) AS b FROM x)
SELECT ROUND(CORR(a, b), 6) AS spearman, COUNT(*) AS n FROM r""")

plan("power_law_slope", """
WITH x AS (SELECT entity, LN(CAST(COUNT(*) AS DOUBLE)) AS lx, LN(CAST(COUNT(DISTINCT object_id) AS DOUBLE)) AS ly FROM {obs} o GROUP BY entity) SELECT ROUND(REGR_SLOPE(ly, lx), 6) AS slope, COUNT(*) AS n FROM x""")

plan("adjusted_rand_index", """
WITH x AS (SELECT entity % 5 AS a, system AS b FROM (SELECT DISTINCT entity, system FROM {obs} o) d), c AS (SELECT a, b, COUNT(*) AS n FROM x GROUP BY a, b), p AS (SELECT SUM(n * (n - 1) / 2e0) AS p FROM c),
q AS (SELECT SUM(n * (n - 1) / 2e0) AS q FROM (SELECT a, SUM(n) AS n FROM c GROUP BY a) y), r AS (SELECT SUM(n * (n - 1) / 2e0) AS r FROM (SELECT b, SUM(n) AS n FROM c GROUP BY b) z), t AS (SELECT SUM(n) * (SUM(n) - 1) / 2e0 AS t FROM c)
SELECT ROUND((p - q * r / t) / (0.5e0 * (q + r) - q * r / t), 6) AS ari FROM p CROSS JOIN q CROSS JOIN r CROSS JOIN t""")

@query("knn_cosine", oracle("""
WITH n AS (SELECT vec_id, SQRT(SUM(x * x)) AS norm FROM {vec} v GROUP BY vec_id), s AS (SELECT a.vec_id AS q, b.vec_id AS c, SUM(a.x * b.x) AS dot FROM {vec} a JOIN {vec} b ON a.dim = b.dim AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id),
k AS (SELECT q, c, dot / (x.norm * y.norm) AS cosine, ROW_NUMBER() OVER (PARTITION BY q ORDER BY ROUND(dot / (x.norm * y.norm), 9) DESC, c) AS k FROM s JOIN n x ON x.vec_id = q JOIN n y ON y.vec_id = c)
SELECT q, CAST(k AS BIGINT) AS k, c, ROUND(cosine, 6) AS cosine FROM k WHERE k <= 3"""))
def knn_cosine(spark, sf_dir):
    """The three nearest of each vector, by products of blocks; each group of blocks gives its best, the best of these count."""

    def work(g: int, held: dict[int, bytes]) -> Iterator[dict]:
        own = [(k, Vectors(*pickle.loads(held[k]))) for d in line if (k := (g + d) % n) in held]
        tops = [pairs.Tops(len(v.ids), 3) for _, v in own]
        for i, (k, a) in enumerate(own):
            for j in range(i if k == g else i + 1, len(own)):
                nearest(a, own[j][1], tops[i], tops[j])
        for (_, v), t in zip(own, tops):
            yield t.rows(v.ids)

    n, line = pairs.NARROW
    packed = pairs.blocks(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding").where("id IS NOT NULL AND SIZE(embedding) > 0"), Vectors.of, n)
    found = pairs.in_groups(packed, F.array(*(F.pmod(F.col("block") - d, F.lit(n)) for d in line)), n, work, "id long, other long, value double")
    order = Window.partitionBy("id").orderBy(F.round("value", 9).desc(), "other")
    best = found.withColumn("k", F.row_number().over(order)).where("k <= 3")
    return best.select(F.col("id").alias("q"), F.col("k").cast("long").alias("k"), F.col("other").alias("c"), F.round("value", 6).alias("cosine"))


class Vectors:
    """Vectors of a block, as they are stored, zeros for nulls; `none` are those with nulls only, whose cosines are null."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, none: np.ndarray):
        self.ids, self.x, self.none = ids, x, none
        wide = x.astype(float)
        with np.errstate(all="ignore"):
            self.unit = wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]

    @classmethod
    def of(cls, rows: pa.Table) -> Vectors:
        v = rows["embedding"].combine_chunks()
        n = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        flat = v.flatten()
        x = np.zeros((len(n), n.max()), flat.type.to_pandas_dtype())
        x[row, pairs.spread(np.zeros_like(n), n)] = flat.fill_null(0).to_numpy(zero_copy_only=False)
        known = np.bincount(row, flat.is_valid().to_numpy(zero_copy_only=False), minlength=len(n))
        return cls(rows["id"].to_numpy(), x, known == 0)

    def pack(self) -> bytes:
        return pickle.dumps((self.ids, self.x, self.none))


def nearest(a: Vectors, b: Vectors, of_a: pairs.Tops, of_b: pairs.Tops) -> None:
    """Enters each vector's cosines with the other block into its best, tile by tile; for a block with itself once."""
    d = min(a.x.shape[1], b.x.shape[1])
    for i in range(0, len(a.ids), pairs.STRIP):
        p = slice(i, i + pairs.STRIP)
        for j in range(0, len(b.ids), pairs.WIDE):
            q = slice(j, j + pairs.WIDE)
            s = a.unit[p, :d] @ b.unit[q, :d].T
            if a.none.any() or b.none.any():
                s[a.none[p][:, None] | b.none[q]] = -np.inf
            same = a.ids[p][:, None] == b.ids[q] if a is b else None
            _enter(s, same, p, q, b.ids, of_a)
            if a is not b:
                _enter(s.T, None, q, p, a.ids, of_b)


def _enter(s: np.ndarray, same, p: slice, q: slice, ids: np.ndarray, tops: pairs.Tops) -> None:
    least, k = tops.floor()[p], tops.key.shape[1]
    if same is not None:
        s[same] = np.nan
    if s.shape[1] > k and (empty := np.isneginf(least)).any():
        # Not-a-number counts as the least here, which lowers the bound at most.
        least[empty] = -np.partition(-s[empty], k - 1, axis=1)[:, k - 1] - 1e-9
    m = ~(s < least[:, None])
    if same is not None:
        m &= ~same
    row, column = np.nonzero(m)
    tops.add(row + p.start, ids[column + q.start], s[row, column])


# An edge for each peer that two entities share: C(n, 2) inside a class of n at a peer, and n * (all - 1) ends.
plan("modularity_of_classes", """
WITH c AS (SELECT peer, class AS g, CAST(COUNT(DISTINCT entity) AS DOUBLE) AS n FROM {flow} f WHERE peer IS NOT NULL GROUP BY peer, class), p AS (SELECT peer, SUM(n) AS s FROM c GROUP BY peer),
i AS (SELECT g, SUM(n * (n - 1) / 2) AS inside, SUM(n * (s - 1)) AS degree FROM c JOIN p ON c.peer = p.peer GROUP BY g), m AS (SELECT SUM(degree) / 2 AS m FROM i),
q AS (SELECT g, CAST(inside AS BIGINT) AS inside, CAST(degree AS BIGINT) AS degree, inside / m AS share, inside / m - POWER(degree / (2 * m), 2) AS part FROM i CROSS JOIN m WHERE m > 0)
SELECT g, inside, degree, ROUND(share, 6) AS share, ROUND(part, 6) AS part, ROUND(SUM(part) OVER (), 6) AS modularity FROM q""")

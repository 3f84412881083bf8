"""Budgets over horizons, roll-ups of tiers, and footprints across systems."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import pairs
from tidemark.plans.catalog import query
from tidemark.plans.dialect import oracle, plan, run

plan("budget_horizons", """
WITH d AS (SELECT entity, day, SUM(w) AS n FROM {flow} f GROUP BY entity, day)
SELECT entity, day, CAST(n AS BIGINT) AS day_1, CAST(SUM(n) OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS day_7, CAST(SUM(n) OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS day_30 FROM d""")

plan("budget_same_phase_p98", """
WITH d AS (SELECT system, hour, CAST(COUNT(*) AS DOUBLE) AS n FROM {obs} o GROUP BY system, hour)
SELECT system, hour % 24 AS phase, COUNT(*) AS hours, ROUND(PERCENTILE(n, 0.98), 6) AS p98, ROUND(PERCENTILE(n, 0.5), 6) AS median FROM d GROUP BY system, hour % 24""")

plan("peer_ratio_guard", """
WITH e AS (SELECT class, entity, CAST(SUM(w) AS DOUBLE) AS n FROM {flow} f GROUP BY class, entity), m AS (SELECT class, PERCENTILE(n, 0.5) AS med, COUNT(*) AS members FROM e GROUP BY class)
SELECT e.class, entity, ROUND(n / med, 6) AS ratio FROM e JOIN m ON e.class = m.class WHERE members >= 5 AND n > 2 * med""")

plan("cross_system_footprint", "SELECT peer, COUNT(DISTINCT system) AS systems, COUNT(DISTINCT org) AS orgs, COUNT(DISTINCT entity) AS entities, CAST(SUM(w) AS BIGINT) AS mass FROM {flow} f GROUP BY peer")

_WRITTEN = "SELECT DISTINCT entity, object_id FROM {obs} o WHERE is_write = 1"


@query("adamic_adar_support", oracle(f"""
WITH d AS ({_WRITTEN}), f AS (SELECT object_id, COUNT(*) AS df FROM d GROUP BY object_id)
SELECT a.entity AS e1, b.entity AS e2, COUNT(*) AS common, ROUND(SUM(1 / LN(df + 1e0)), 6) AS adamic_adar FROM d a JOIN d b ON a.object_id = b.object_id AND a.entity < b.entity JOIN f ON f.object_id = a.object_id GROUP BY a.entity, b.entity HAVING COUNT(*) >= 3"""))
def adamic_adar_support(spark, sf_dir):
    """Pairs of entities by the objects both write, as products of matrices, block by block."""

    def work(a: pairs.Block, b: pairs.Block) -> Iterator[dict]:
        def keep(x, y, values):
            m = values[0] >= 3
            return m & (x < y) if a is b else m

        for x, y, (common, support) in pairs.overlaps(a, b, "adamic", keep, 1 / np.log(a.columns["df"] + 1.0)):
            yield pairs.ends(a, b, x, y) | {"common": common.astype(np.int64), "adamic_adar": pairs.rounded(support, 6)}

    d = run(spark, sf_dir, _WRITTEN).where("object_id IS NOT NULL")
    f = d.groupBy("object_id").agg(F.count("*").alias("w"))
    sets = d.where("entity IS NOT NULL").join(f, "object_id").select(F.col("entity").alias("id"), F.col("object_id").alias("f"), "w")
    n, line = pairs.PLANE
    return pairs.block_pairs(pairs.blocks(sets, _spread, n), (n, line), work, "e1 long, e2 long, common long, adamic_adar double")


def _spread(table: pa.Table) -> pairs.Block:
    """A block whose weights are 1, with the entities of each object (`df`)."""
    block = pairs.from_rows(table)
    df = np.zeros(len(block.names))
    df[block.at] = block.w
    return pairs.Block(block.ids, block.ptr, block.at, np.ones(len(block.at)), block.names, df=df)


plan("tier_rollup_entity_class_system_org", """
SELECT system, org, class, CAST(SUM(w) AS BIGINT) AS mass, COUNT(DISTINCT entity) AS entities, CAST(GROUPING(system) + GROUPING(org) + GROUPING(class) AS BIGINT) AS level FROM {flow} f GROUP BY ROLLUP (system, org, class)""")

plan("class_pooled_ratios", "SELECT class, ROUND(SUM(up) / SUM(down), 6) AS updown, ROUND(CAST(SUM(CASE WHEN flag = 'R' THEN w ELSE 0 END) AS DOUBLE) / SUM(w), 6) AS returned, COUNT(DISTINCT entity) AS members FROM {flow} f GROUP BY class")

plan("class_coherence_count", """
WITH e AS (SELECT class, entity, CAST(SUM(CASE WHEN flag = 'R' THEN w ELSE 0 END) AS DOUBLE) / SUM(w) AS r FROM {flow} f GROUP BY class, entity), m AS (SELECT class, AVG(r) AS mu, STDDEV_POP(r) AS sd FROM e GROUP BY class)
SELECT e.class, COUNT(*) AS members, COUNT(CASE WHEN ABS(r - mu) > 2 * sd THEN 1 END) AS off FROM e JOIN m ON e.class = m.class GROUP BY e.class""")

plan("role_distance_pairs", """
WITH n AS (SELECT class, flag, SUM(w) AS n FROM {flow} f GROUP BY class, flag), p AS (SELECT class, flag, n / CAST(SUM(n) OVER (PARTITION BY class) AS DOUBLE) AS p FROM n)
SELECT a.class AS c1, b.class AS c2, ROUND(SQRT(GREATEST(0e0, SUM(0.5e0 * a.p * LOG2(2 * a.p / (a.p + b.p)) + 0.5e0 * b.p * LOG2(2 * b.p / (a.p + b.p))))), 5) AS distance FROM p a JOIN p b ON a.flag = b.flag AND a.class < b.class GROUP BY a.class, b.class""")

plan("order_budget_month", "SELECT entity, CAST(FLOOR(day / 30e0) AS BIGINT) AS month, COUNT(*) AS orders, ROUND(SUM(amount), 2) AS amount, ROUND(MAX(amount), 2) AS largest FROM {ord} o GROUP BY entity, CAST(FLOOR(day / 30e0) AS BIGINT)")

"""Identity over window vectors, and linking of entities in time."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.plans.catalog import query
from tidemark.plans.dialect import oracle, plan, run
from tidemark.sources.tables import table

_CENTRE = """
WITH c AS (SELECT label, dim, AVG(x) AS mu, VAR_POP(x) AS v, COUNT(*) AS n FROM {vec} v GROUP BY label, dim)"""

plan("centroid_distance_rank", _CENTRE + """,
d AS (SELECT a.vec_id, a.label, c.label AS of_label, SUM(POWER(a.x - c.mu, 2)) AS d2 FROM {vec} a JOIN c ON a.dim = c.dim GROUP BY a.vec_id, a.label, c.label), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY d2, of_label) AS k FROM d)
SELECT vec_id, label, of_label AS nearest, ROUND(SQRT(d2), 5) AS distance FROM k WHERE k = 1""")

plan("confusion_row_nearest_centroid", _CENTRE + """,
d AS (SELECT a.vec_id, a.label, c.label AS of_label, SUM(POWER(a.x - c.mu, 2)) AS d2 FROM {vec} a JOIN c ON a.dim = c.dim GROUP BY a.vec_id, a.label, c.label), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY d2, of_label) AS k FROM d)
SELECT label, of_label AS assigned, COUNT(*) AS n FROM k WHERE k = 1 GROUP BY label, of_label""")

plan("mahalanobis_diag_t2", _CENTRE + """
SELECT a.vec_id, ROUND(SUM(POWER(a.x - c.mu, 2) / GREATEST(c.v, 1e-6)), 4) AS t2 FROM {vec} a JOIN c ON a.dim = c.dim AND a.label = c.label GROUP BY a.vec_id""")

@query("cov_matrix_long", oracle("""
WITH m AS (SELECT dim, AVG(x) AS mu FROM {vec} v GROUP BY dim)
SELECT a.dim AS i, b.dim AS j, ROUND(AVG((a.x - m.mu) * (b.x - k.mu)), 8) AS cov FROM {vec} a JOIN {vec} b ON a.vec_id = b.vec_id AND a.dim <= b.dim JOIN m ON m.dim = a.dim JOIN m k ON k.dim = b.dim GROUP BY a.dim, b.dim"""))
def cov_matrix_long(spark, sf_dir):
    """Covariances of every two dimensions, over the rows that have both: products are summed row by row, with no join."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"))
    mean = {r.dim: r.mu for r in run(spark, sf_dir, "SELECT dim, AVG(x) AS mu FROM {vec} v GROUP BY dim").collect()}  # a number a dimension
    d = max(mean, default=-1) + 1
    mu = np.array([np.nan if mean.get(k) is None else mean[k] for k in range(d)])

    def parts(batches):
        total, count = np.zeros((d, d)), np.zeros((d, d), np.int64)
        for batch in batches:
            rows = [r for r in batch.column(0).to_pylist() if r]
            for at in range(0, len(rows), 4096):
                x, has = np.zeros((len(rows[at : at + 4096]), d)), np.zeros((len(rows[at : at + 4096]), d))
                for k, r in enumerate(rows[at : at + 4096]):
                    has[k, : len(r)] = [v is not None for v in r]
                    x[k, : len(r)] = [0.0 if v is None else v for v in r]
                x = np.where(has > 0, x - mu, 0.0)
                total += x.T @ x
                count += (has.T @ has).astype(np.int64)
        i, j = np.nonzero(np.triu(count))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j]), pa.array(count[i, j])], names=["i", "j", "s", "n"])

    sums = vectors.mapInArrow(parts, "i int, j int, s double, n long").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select("i", "j", F.round(F.col("s") / F.col("n"), 8).alias("cov"))


plan("centroid_cosine", _CENTRE + """
SELECT a.label AS l1, b.label AS l2, ROUND(SUM(a.mu * b.mu) / SQRT(SUM(a.mu * a.mu) * SUM(b.mu * b.mu)), 6) AS cosine FROM c a JOIN c b ON a.dim = b.dim AND a.label < b.label GROUP BY a.label, b.label""")

plan("fisher_score_traits", _CENTRE + """,
g AS (SELECT dim, AVG(x) AS m FROM {vec} v GROUP BY dim)
SELECT c.dim, ROUND(SUM(n * POWER(mu - m, 2)) / SUM(n * v), 6) AS fisher FROM c JOIN g ON c.dim = g.dim GROUP BY c.dim""")

plan("link_candidates_interval_join", """
WITH s AS (SELECT entity, MIN(t) AS first_t, MAX(t) AS last_t, MIN(system) AS system FROM {obs} o GROUP BY entity)
SELECT a.entity AS from_entity, b.entity AS to_entity, ROUND(b.first_t - a.last_t, 3) AS gap_s, ROUND(-(b.first_t - a.last_t) / 86400e0, 6) AS time_prior FROM s a JOIN s b ON a.system = b.system AND b.first_t > a.last_t AND b.first_t <= a.last_t + 604800""")

plan("first_seen_links", """
WITH s AS (SELECT entity, MIN(day) AS first_day, MAX(day) AS last_day FROM {ord} o GROUP BY entity), c AS (SELECT s.*, c_nationkey FROM s JOIN {customer} c ON c_custkey = entity)
SELECT a.entity AS e1, b.entity AS e2, b.first_day - a.last_day AS gap FROM c a JOIN c b ON a.c_nationkey = b.c_nationkey AND b.first_day - a.last_day BETWEEN 1 AND 30""")

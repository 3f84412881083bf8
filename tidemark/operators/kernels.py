"""Operators whose statistic has no SQL form: Arrow kernels over batches, or over one entity's bounded history."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dist
from tidemark.plans.catalog import query
from tidemark.plans.dialect import run, view


def with_nb_midp(df: DataFrame, k: str, size: str, mean: str, out: str = "p") -> DataFrame:
    """Adds the upper mid-p of a count under a negative binomial predictive."""

    @F.pandas_udf("double")
    def midp(k: pd.Series, r: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(dist.nb_midp(k.to_numpy(float), r.to_numpy(float), m.to_numpy(float)))

    return df.withColumn(out, midp(F.col(k).cast("double"), size, mean))


def with_t_midp(df: DataFrame, x: str, freedom: str, out: str = "p") -> DataFrame:
    """Adds the two-sided p of a Student predictive."""

    @F.pandas_udf("double")
    def midp(x: pd.Series, df_: pd.Series) -> pd.Series:
        return pd.Series(dist.t_midp(x.to_numpy(float), df_.to_numpy(float)))

    return df.withColumn(out, midp(x, freedom))


_DAYS = """
WITH d AS (SELECT entity, day, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(CASE WHEN status >= 500 THEN 1 ELSE 0 END) AS DOUBLE) AS e, AVG(up) AS a FROM {obs} o GROUP BY entity, day)
SELECT entity, day, n, e, a, COUNT(*) OVER v AS seen, COALESCE(SUM(n) OVER v, 0e0) AS n0, COALESCE(SUM(e) OVER v, 0e0) AS e0, AVG(a) OVER v AS mu, STDDEV_SAMP(a) OVER v AS sd
FROM d WINDOW v AS (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("nb_midp")
def nb_midp(spark, sf_dir):
    """A day's requests under the gamma-Poisson predictive of the entity's earlier days (prior 2 / 1)."""
    d = run(spark, sf_dir, _DAYS).withColumn("size", F.col("n0") + 2).withColumn("mean", F.col("size") / (F.col("seen") + 1))
    return with_nb_midp(d, "n", "size", "mean").select("entity", "day", "n", F.round("p", 9).alias("p"))


@query("bb_midp")
def bb_midp(spark, sf_dir):
    """A day's errors among its requests under the beta-binomial predictive of earlier days."""

    @F.pandas_udf("double")
    def midp(k: pd.Series, n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(dist.bb_midp(k, n, a, b))

    d = run(spark, sf_dir, _DAYS)
    return d.select("entity", "day", F.round(midp("e", "n", F.col("e0") + 0.5, F.col("n0") - F.col("e0") + 2.0), 9).alias("p"))


@query("t_midp")
def t_midp(spark, sf_dir):
    """A day's mean value under Student's predictive of earlier days, from the third day on."""
    d = run(spark, sf_dir, _DAYS).where("seen >= 2 AND sd > 0")
    x = d.withColumn("x", (F.col("a") - F.col("mu")) / (F.col("sd") * F.sqrt(1 + 1 / F.col("seen")))).withColumn("f", (F.col("seen") - 1).cast("double"))
    return with_t_midp(x, "x", "f").select("entity", "day", F.round("p", 9).alias("p"))


def bocpd(x: np.ndarray, hazard: float = 1 / 168, most: int = 200) -> np.ndarray:
    """P(run length <= 3) after each value: Bayesian online change points, Normal-Gamma model, runs merged at `most`."""
    mu, kappa, alpha, beta, w = np.zeros(1), np.ones(1), np.ones(1), np.ones(1), np.ones(1)
    out = []
    for v in x:
        scale = beta * (kappa + 1) / (alpha * kappa)
        df = 2 * alpha
        log = dist.gammaln((df + 1) / 2) - dist.gammaln(df / 2) - 0.5 * np.log(np.pi * df * scale) - (df + 1) / 2 * np.log1p((v - mu) ** 2 / (df * scale))
        like = np.exp(log - log.max())
        grow = w * like * (1 - hazard)
        w = np.append((w * like * hazard).sum(), grow)
        beta = np.append(1.0, beta + kappa * (v - mu) ** 2 / (2 * (kappa + 1)))
        mu = np.append(0.0, (kappa * mu + v) / (kappa + 1))
        kappa, alpha = np.append(1.0, kappa + 1), np.append(1.0, alpha + 0.5)
        if len(w) > most:
            w[-2] += w[-1]
            mu, kappa, alpha, beta, w = mu[:-1], kappa[:-1], alpha[:-1], beta[:-1], w[:-1]
        w = w / w.sum()
        out.append(w[:4].sum())
    return np.array(out)


@query("bocpd_prob")
def bocpd_prob(spark, sf_dir):
    """Change-point probability of each system's hourly counts, each standardised by the hours before it."""
    hours = run(spark, sf_dir, "SELECT system, hour, CAST(COUNT(*) AS DOUBLE) AS n FROM {obs} o GROUP BY system, hour")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hour")
        before = pdf.n.expanding()
        mean, spread = before.mean().shift(), before.std(ddof=0).shift()
        z = ((pdf.n - mean) / spread.clip(lower=1.0)).fillna(0.0).clip(-6, 6)
        return pd.DataFrame({"system": pdf.system, "hour": pdf.hour, "p_change": np.round(bocpd(z.to_numpy()), 9)})

    return hours.groupBy("system").applyInPandas(one, "system string, hour long, p_change double")


@query("beacon_renewal_lrt")
def beacon_renewal_lrt(spark, sf_dir):
    """Gamma against exponential gaps: maximum-likelihood shape by Newton steps, one-sided likelihood ratio."""
    gaps = run(spark, sf_dir, "SELECT entity, t - LAG(t) OVER (PARTITION BY entity ORDER BY t, event_id) AS x FROM {obs} o").where("x > 0")
    stats = gaps.groupBy("entity").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.avg(F.log("x")).alias("l")).where("n >= 8")

    @F.pandas_udf("kappa double, lr double")
    def fit(n: pd.Series, m: pd.Series, l: pd.Series) -> pd.DataFrame:  # noqa: E741
        s = np.maximum(np.log(m) - l, 1e-9).to_numpy()
        k = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
        psi = lambda v: (dist.gammaln(v + 1e-4) - dist.gammaln(v - 1e-4)) / 2e-4
        for _ in range(4):
            slope = 1 / k - (psi(k + 1e-3) - psi(k - 1e-3)) / 2e-3
            k = np.maximum(k - (np.log(k) - psi(k) - s) / slope, 1e-3)
        like = n * (k * np.log(k) - dist.gammaln(k) - k - (k - 1) * s - (-1.0))
        return pd.DataFrame({"kappa": np.round(k, 6), "lr": np.round(np.where(k > 1, 2 * np.maximum(like, 0), 0.0), 6)})

    return stats.select("entity", "n", fit("n", "m", "l").alias("f")).select("entity", "n", "f.kappa", "f.lr")


def shrunk(n: float, s: np.ndarray, ss: np.ndarray, kept: float = 0.9):
    """mean, inverse of the covariance shrunk towards its mean variance, and the leading directions that hold `kept` of the
    variance, from a number of rows, their sum and the sum of their products."""
    mu, d = s / n, len(s)
    cov = ss / n - np.outer(mu, mu)
    trace, square = np.trace(cov), (cov * cov).sum()
    rho = min(1.0, ((1 - 2 / d) * square + trace**2) / max((n + 1 - 2 / d) * (square - trace**2 / d), 1e-12))
    shrunken = (1 - rho) * cov + rho * trace / d * np.eye(d)
    values, vectors = np.linalg.eigh(shrunken)
    share = np.cumsum(values[::-1]) / values.sum()
    return mu, np.linalg.inv(shrunken), vectors[:, ::-1][:, : int(np.searchsorted(share, kept)) + 1]


@query("oas_t2_spe")
def oas_t2_spe(spark, sf_dir):
    """Of every vector within its label: Hotelling's T squared by a shrunk covariance, its p as a new point's (null where a
    label has too few rows), and the squared error that the leading directions leave.

    Moments are summed in the cluster, first in each batch, then by label; vectors meet their label's model, a few
    thousand numbers, in the task that scores them, a label at a time."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))

    def parts(batches):
        for pdf in batches:
            for label, own in pdf.groupby("label"):
                x = np.stack(own.x.to_list())
                yield pd.DataFrame({"label": [label], "m": [np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])]})

    moments = vectors.mapInPandas(parts, "label int, m array<double>").select("label", F.posexplode("m").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v"))
    models = {}
    for r in moments.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).getField("v").alias("m")).toLocalIterator():  # one row a label
        m = np.array(r.m)
        d = int((np.sqrt(4 * len(m) - 3) - 1) / 2)
        models[r.label] = (m[0], *shrunk(m[0], m[1 : 1 + d], m[1 + d :].reshape(d, d)))

    def score(batches):
        for pdf in batches:
            for label, own in pdf.groupby("label"):
                n, mu, inverse, lead = models[label]
                v = np.stack(own.x.to_list()) - mu
                d = len(mu)
                t2 = np.einsum("ij,jk,ik->i", v, inverse, v)
                p = dist.f_sf(t2 * n * (n - d) / (d * (n - 1) * (n + 1)), d, n - d) if n > d + 1 else [None] * len(v)
                spe = ((v - v @ lead @ lead.T) ** 2).sum(1)
                yield pd.DataFrame({"vec_id": own.vec_id.to_numpy(), "t2": np.round(t2, 6), "p": p, "spe": np.round(spe, 6)})

    return vectors.mapInPandas(score, "vec_id long, t2 double, p double, spe double")


@query("bayesian_blocks")
def bayesian_blocks(spark, sf_dir):
    """Activity windows: optimal partition of each system's 96 slots of the day, fitness N (ln N - ln T) - penalty."""
    slots = run(spark, sf_dir, "SELECT system, slot, COUNT(*) AS n FROM {obs} o GROUP BY system, slot")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(96)
        n[pdf.slot.to_numpy()] = pdf.n.to_numpy()
        c = np.r_[0, np.cumsum(n)]
        best, last = np.zeros(97), np.zeros(97, int)
        for j in range(1, 97):
            i = np.arange(j)
            k, t = c[j] - c[i], (j - i).astype(float)
            value = best[i] + np.where(k > 0, k * (np.log(np.maximum(k, 1)) - np.log(t)), 0) - 4.0
            last[j] = int(value.argmax())
            best[j] = value[last[j]]
        cuts, j = [], 96
        while j:
            cuts.append((last[j], j, int(c[j] - c[last[j]])))
            j = last[j]
        return pd.DataFrame([(pdf.system.iloc[0], a, b, k) for a, b, k in cuts[::-1]], columns=["system", "opens", "closes", "n"])

    return slots.groupBy("system").applyInPandas(one, "system string, opens long, closes long, n long")


@query("governor_state_machine")
def governor_state_machine(spark, sf_dir):
    """Token bucket per system with continuous refill: which error findings pass (2 an hour, 6 at most held)."""
    found = view(spark, sf_dir, "obs").where("status >= 500").select("system", "event_id", "t")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "event_id"])
        held, before, passed = 6.0, None, []
        for t in pdf.t:
            held = min(6.0, held + (0 if before is None else (t - before) * 2 / 3600))
            before = t
            passed.append(held >= 1)
            held -= passed[-1]
        return pdf.assign(passed=passed)[["system", "event_id", "passed"]]

    return found.groupBy("system").applyInPandas(one, "system string, event_id long, passed boolean")


@query("connected_entities")
def connected_entities(spark, sf_dir):
    """Components of entities that wrote the same object on one day: labels passed along, in the cluster."""
    seen = view(spark, sf_dir, "obs").where("is_write = 1").select("entity", F.concat_ws("-", "day", "object_id").alias("key")).distinct()
    head = seen.groupBy("key").agg(F.min("entity").alias("b"))
    edges = seen.join(head, "key").select(F.col("entity").alias("a"), "b").where("a <> b").distinct()
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = seen.select("entity").distinct().withColumn("label", F.col("entity")).checkpoint()
    while True:
        near = both.join(labels, F.col("b") == F.col("entity")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("entity") == F.col("a"), "left").select("entity", "label", F.least("label", F.coalesce("near", "label")).alias("next")).checkpoint()
        labels = step.select("entity", F.col("next").alias("label"))
        if step.where("next <> label").isEmpty():
            return labels.withColumn("size", F.count("*").over(Window.partitionBy("label")))


@query("isotonic_pav")
def isotonic_pav(spark, sf_dir):
    """Pool-adjacent-violators fit of label rate by document length: at most 200 quantile bins reach the kernel."""
    rows = run(spark, sf_dir, "SELECT CAST(d.n_chars AS DOUBLE) AS x, l.quality AS y FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id")
    edges = rows.approxQuantile("x", [k / 200 for k in range(1, 200)], 1e-4)
    binned = rows.withColumn("bin", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("x")))).groupBy("bin").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))

    def pav(batches):
        pdf = pd.concat(list(batches)).sort_values("bin")
        blocks: list[list[float]] = []
        for y, n in zip(pdf.y, pdf.n):
            blocks.append([y, n, 1])
            while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
                y1, n1, k1 = blocks.pop()
                y0, n0, k0 = blocks.pop()
                blocks.append([(y0 * n0 + y1 * n1) / (n0 + n1), n0 + n1, k0 + k1])
        yield pd.DataFrame({"bin": pdf.bin.to_numpy(), "x": np.round(pdf.x.to_numpy(), 6), "fitted": np.round(np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks]), 9)})

    return binned.coalesce(1).mapInPandas(pav, "bin int, x double, fitted double")

import numpy as np
import pytest

from tidemark.functions import dist
from tidemark.functions.fuzzy import member_at_least, member_at_most
from tidemark.operators.kernels import bocpd
from tidemark.operators.rules import Condition, Rule


def test_log_gamma_and_beta():
    assert dist.gammaln(np.array([1.0, 5.0, 0.5])) == pytest.approx([0, np.log(24), np.log(np.sqrt(np.pi))], abs=1e-12)
    assert dist.betainc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)
    assert dist.betainc(3, 2, 0.6) == pytest.approx(1 - 0.5248, abs=1e-12)
    assert dist.betainc(1, 1, np.array([0.0, 1.0])) == pytest.approx([0, 1])


def test_negative_binomial_sums_up():
    r, m = 2.5, 4.0
    p = r / (r + m)
    pmf, total = p**r, 0.0
    for k in range(12):
        before, total = total, total + pmf
        assert dist.nb_cdf(k, r, m) == pytest.approx(total, abs=1e-10)
        assert dist.nb_midp(k, r, m) == pytest.approx(1 - (before + total) / 2, abs=1e-10)
        pmf *= (k + r) / (k + 1) * (1 - p)


def test_beta_binomial_and_student():
    assert dist.bb_pmf(np.arange(6), 5, 1, 1).tolist() == pytest.approx([1 / 6] * 6)
    assert dist.bb_midp(0, 5, 1, 1) == pytest.approx(1 - 1 / 12)
    k, n, a, b = np.array([0, 3, 9, 40, 7]), np.array([5, 9, 9, 90, 7]), np.array([1, 0.5, 2, 3, 0.7]), np.array([1, 4, 2, 8, 9])
    slow = [sum(dist.bb_pmf(np.arange(x, m + 1), m, p, q)) - 0.5 * dist.bb_pmf(x, m, p, q) for x, m, p, q in zip(k, n, a, b)]
    assert dist.bb_midp(k, n, a, b, chunk=8) == pytest.approx(slow, rel=1e-9)
    assert dist.t_sf(1.0, 1) == pytest.approx(0.25, abs=1e-12)
    assert dist.t_midp(0.0, 7) == pytest.approx(1.0)
    assert dist.f_sf(1.0, 2, 2) == pytest.approx(0.5)


def test_change_point_is_seen():
    p = bocpd(np.r_[np.zeros(60), 6 * np.ones(10)] + np.random.default_rng(0).normal(0, 0.3, 70))
    assert p[61] > 0.5 > p[55]


def test_ramps(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.0,), (0.05,), (0.1,), (None,)], "x double")
    up = [r[0] for r in df.select(member_at_least(F.col("x"), 0.1, 0.1)).collect()]
    down = [r[0] for r in df.select(member_at_most(F.col("x"), 0.0, 0.1)).collect()]
    assert up == pytest.approx([0, 0.5, 1, 0]) and down == pytest.approx([1, 0.5, 0, 0])


@pytest.mark.parametrize(
    "condition, value, wanted",
    [
        (Condition("x", "ge", 2), 2, 1), (Condition("x", "gt", 2), 2, 0), (Condition("x", "le", 2, 2.0), 3, 0.5), (Condition("x", "between", (1, 3)), 3, 1),
        (Condition("x", "in", ("a", "b")), "'c'", 0), (Condition("x", "not_in", (1, 2)), 3, 1), (Condition("x", "eq", 1), 1, 1), (Condition("x", "ne", 1), 1, 0), (Condition("x", "present"), "NULL", 0),
    ],
)
def test_conditions(spark, condition, value, wanted):
    assert spark.sql(f"SELECT {condition.sql()} AS m FROM (SELECT {value} AS x)").first().m == pytest.approx(wanted)


def test_rule_groups(spark):
    rule = Rule("r", "c", all=[Condition("x", "ge", 1)], any=[Condition("y", "ge", 1, 1.0), Condition("y", "eq", -5)], none=[Condition("z", "ge", 9)], weight=1.2)
    got = [spark.sql(f"SELECT {rule.sql()} AS m FROM (SELECT {x} AS x, {y} AS y, {z} AS z)").first().m for x, y, z in ((1, 0.5, 0), (1, 5, 0), (0, 5, 0), (1, 5, 9), (1, -1, 0))]
    assert got == pytest.approx([0.6, 1, 0, 0, 0])


def test_shrunk_model_against_numpy():
    """T squared, leading directions and errors of one label, by the rows themselves."""
    from tidemark.operators.kernels import shrunk

    x = np.random.default_rng(0).normal(size=(300, 6)) * np.array([5, 3, 1, 1, 0.5, 0.1])
    mu, inverse, lead = shrunk(len(x), x.sum(0), x.T @ x)
    cov = np.cov(x.T, bias=True)
    assert mu == pytest.approx(x.mean(0)) and np.trace(np.linalg.inv(inverse)) == pytest.approx(np.trace(cov))
    v = x - mu
    assert np.einsum("ij,jk,ik->i", v, inverse, v).mean() == pytest.approx(6, rel=0.15)
    assert lead.shape[1] < 6 and lead.T @ lead == pytest.approx(np.eye(lead.shape[1]))
    assert (((v - v @ lead @ lead.T) ** 2).sum(1).mean()) < 0.25 * (v**2).sum(1).mean()

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import hypothesis as h
from statloom.operators import regression as rg


def _irls(x, y, variance):
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(y.mean())
    for _ in range(200):
        mu = np.exp(x @ beta)
        w = mu * mu / variance(mu)
        beta = np.linalg.solve((x * w[:, None]).T @ x, x.T @ (w * (x @ beta + (y - mu) / mu)))
    return beta, np.linalg.inv((x * w[:, None]).T @ x)


@pytest.mark.parametrize("name, variance, dispersion", [("negative_binomial(2.5)", lambda m: m + m * m / 2.5, False), ("tweedie(1.5)", lambda m: m**1.5, True), ("tweedie(2.7)", lambda m: m**2.7, True)])
def test_families_with_a_parameter(spark, name, variance, dispersion):
    r = np.random.default_rng(2)
    z = r.normal(size=300)
    y = r.poisson(np.exp(1 + 0.4 * z) * r.gamma(2.5, 1 / 2.5, 300)).astype(float) + (0.1 if "2.7" in name else 0)
    x = np.column_stack([np.ones(300), z])
    fit = rg.glm(spark.createDataFrame(pd.DataFrame({"y": y, "z": z})), "y", [rg.ONE, "z"], name)
    beta, inv = _irls(x, y, variance)
    mu = np.exp(x @ beta)
    phi = ((y - mu) ** 2 / variance(mu)).sum() / 298 if dispersion else 1.0
    assert fit.beta == pytest.approx(beta, rel=1e-4) and fit.cov == pytest.approx(inv * phi, rel=1e-3)


@pytest.mark.parametrize("name", ["tweedie(1)", "tweedie(2)", "tweedie(nan)", "negative_binomial(0)", "negative_binomial(inf)", "other"])
def test_impossible_families(name):
    with pytest.raises(ValueError):
        rg.family_of(name)


def test_intervals_of_a_variance_ratio(spark):
    d = pd.DataFrame({"g": ["a"] * 6 + ["b"] * 5 + ["c"], "v": [1.0, 4, 2, 8, 5, 7, 3, 3.5, 4, 2, 6, 9]})
    r = h.variance_ratio(spark.createDataFrame(d), "v", "g", "a", "b").collect()[0]
    f, g = 9.36447, 7.38789  # upper 2.5 % points of F(5, 4) and F(4, 5), from tables
    assert r.ci_low == pytest.approx(r.statistic / f, rel=1e-4) and r.ci_high == pytest.approx(r.statistic * g, rel=1e-4)
    r = h.variance_ratio(spark.createDataFrame(d), "v", "g", "a", "c").collect()[0]
    assert r.ci_low is None and r.ci_high is None


def test_interval_of_a_difference_of_proportions(spark):
    d = pd.DataFrame({"g": ["a"] * 100 + ["b"] * 80, "s": [True] * 30 + [False] * 70 + [True] * 12 + [False] * 68})
    df = spark.createDataFrame(d)
    r = h.proportion(df, F.col("s"), "g").collect()[0]
    half = 1.959963985 * np.sqrt(0.3 * 0.7 / 100 + 0.15 * 0.85 / 80) + 0.5 * (1 / 100 + 1 / 80)
    assert (r.difference, r.ci_low, r.ci_high) == (pytest.approx(0.15), pytest.approx(0.15 - half), pytest.approx(0.15 + half))
    one = h.proportion(df.filter("g = 'a'"), F.col("s"), "g").collect()[0]
    assert one.difference is None and one.ci_low is None

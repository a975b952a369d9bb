import numpy as np
import pandas as pd
import pytest

from statloom.operators import factored as fa
from statloom.operators import regression as rg


def _data(n=60):
    r = np.random.default_rng(4)
    x = r.normal(size=(n, 3))
    y = x @ [[1.0, 0.5], [0.0, -2.0], [3.0, 0.0]] + r.normal(size=(n, 2)) + 5
    return pd.DataFrame(np.column_stack([x, y]), columns=["x0", "x1", "x2", "y0", "y1"])


def test_triangle_has_the_cross_products(spark):
    d = _data()
    r, n = fa.triangle(spark.createDataFrame(d).repartition(7), [rg.ONE, "x0", "y0"])
    a = np.column_stack([np.ones(60), d.x0, d.y0])
    assert n == 60 and r.shape == (3, 3) and r.T @ r == pytest.approx(a.T @ a)


def test_min_norm_with_full_rank_is_least_squares(spark):
    df = spark.createDataFrame(_data())
    a, b = fa.min_norm(df, "y0", [rg.ONE, "x0", "x1"]), rg.ols(df, "y0", [rg.ONE, "x0", "x1"])
    assert a.beta == pytest.approx(b.beta) and a.cov == pytest.approx(b.cov) and a.df == b.df and a.extra["rank"] == 3


def test_min_norm_shares_the_effect_of_aliased_terms(spark):
    d = _data().assign(twice=lambda d: 2 * d.x0)
    d.loc[5, "x1"] = np.nan
    fit = fa.min_norm(spark.createDataFrame(d), "y0", [rg.ONE, "x0", "twice", "x1"])
    whole = d.dropna()
    a = np.column_stack([np.ones(59), whole.x0, whole.twice, whole.x1])
    assert fit.beta == pytest.approx(np.linalg.lstsq(a, whole.y0, rcond=None)[0])
    rss = np.sum((whole.y0 - a @ fit.beta) ** 2)
    assert fit.extra["rank"] == 3 and fit.n == 59 and fit.cov == pytest.approx(np.linalg.pinv(a.T @ a) * rss / 56, abs=1e-10)


def test_min_norm_keeps_digits_that_cross_products_lose(spark):
    e = 1e-9
    d = pd.DataFrame({"a": [1.0, e, 0.0, 0.0], "b": [1.0, 0.0, e, 0.0], "y": [2.0, e, e, 0.0]})
    assert fa.min_norm(spark.createDataFrame(d), "y", ["a", "b"]).beta == pytest.approx([1, 1], rel=1e-5)


def test_fewer_rows_than_terms(spark):
    d = _data(2)
    fit = fa.min_norm(spark.createDataFrame(d), "y0", ["x0", "x1", "x2"])
    a = d[["x0", "x1", "x2"]].to_numpy()
    assert fit.beta == pytest.approx(np.linalg.pinv(a) @ d.y0.to_numpy()) and fit.extra["rank"] == 2
    with pytest.raises(ValueError):
        fa.min_norm(spark.createDataFrame(d).limit(0), "y0", ["x0"])


def test_multivariate_against_one_fit_for_each_outcome(spark):
    d = _data()
    df = spark.createDataFrame(d)
    terms = [rg.ONE, "x0", "x1"]
    fit = fa.multivariate(df, ["y0", "y1"], terms)
    a = np.column_stack([np.ones(60), d.x0, d.x1])
    beta = np.linalg.lstsq(a, d[["y0", "y1"]].to_numpy(), rcond=None)[0]
    left = d[["y0", "y1"]].to_numpy() - a @ beta
    assert fit.beta == pytest.approx(beta) and fit.residual_cov == pytest.approx(left.T @ left / 57)
    t = fit.table()
    one = rg.ols(df, "y1", terms).table()
    assert t[t.outcome == "y1"].se.to_numpy() == pytest.approx(one.se.to_numpy()) and t[t.outcome == "y1"].p_value.to_numpy() == pytest.approx(one.p_value.to_numpy())
    assert list(fit.covariance_table()["a"]) == ["y0", "y0", "y1"]
    one = fa.multivariate_effect(fa.multivariate(df, ["y0"], terms), ["x0"])
    assert one["statistic"] == pytest.approx(rg.ols(df, "y0", terms).table().statistic[1] ** 2)
    with pytest.raises(ValueError):
        fa.multivariate(df.selectExpr("*", "x0 * 3 as z"), ["y0"], ["x0", "z"])

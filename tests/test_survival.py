import numpy as np
import pandas as pd
import pytest

from statloom.operators import series
from statloom.operators import survival as sv


def _data(n=90, seed=3):
    r = np.random.default_rng(seed)
    z = r.normal(size=(n, 2)).round(2)
    t = np.ceil(r.exponential(np.exp(-0.6 * z[:, 0])) * 8)  # with ties
    return pd.DataFrame({"sample_id": np.arange(n), "t": t, "e": r.random(n) < 0.7, "z0": z[:, 0], "z1": z[:, 1], "g": r.choice(["a", "b"], n), "entry": np.floor(t * r.random(n) * 0.9), "c": r.integers(0, 20, n)})


def _steps(d, x, beta, ties, start=None):
    """Every step of every event time, the plain way: (rows at risk, rows dead, share of the dead that is left out, time)."""
    for g in sorted(d.g.unique()):
        for t in sorted(d.t[(d.g == g) & d.e].unique()):
            risk = np.flatnonzero((d.g == g) & (d.t >= t) & (d[start] < t if start else True))
            dead = np.flatnonzero((d.g == g) & (d.t == t) & d.e)
            for k in range(len(dead)):
                yield risk, dead, (k / len(dead) if ties == "efron" else 0.0), t


def _plain(d, x, beta, ties, start=None):
    """(martingale, score residuals, information, Schoenfeld sums by time and information by time)."""
    n, p = x.shape
    r = np.exp(x @ beta)
    m, s = d.e.to_numpy(float).copy(), np.zeros((n, p))
    info, by_time = np.zeros((p, p)), {}
    for risk, dead, f, t in _steps(d, x, beta, ties, start):
        share = np.zeros(n)
        share[risk] = 1
        share[dead] -= f
        w = share * r
        mean = w @ x / w.sum()
        v = (x - mean).T @ ((x - mean) * w[:, None]) / w.sum()
        m -= w / w.sum()
        s -= (w / w.sum())[:, None] * (x - mean)
        s[dead] += (x[dead] - mean) / len(dead)
        info += v
        a, b = by_time.get(t, (0, 0))
        by_time[t] = (a + (x[dead] - mean).sum(0) / len(dead), b + v)
    return m, s, info, by_time


@pytest.mark.parametrize("ties, start", [("efron", None), ("breslow", None), ("efron", "entry")])
def test_residuals_robust_and_proportional(spark, ties, start):
    d = _data()
    df = spark.createDataFrame(d)
    fit = series.cox(df, "t", "e", ["z0", "z1"], ties, start, "g")
    x = d[["z0", "z1"]].to_numpy()
    m, s, info, by_time = _plain(d, x, fit.beta, ties, start)
    assert np.linalg.inv(info) == pytest.approx(fit.cov, rel=1e-6)
    got = sv.cox_residuals(df, "t", "e", ["z0", "z1"], fit.beta, ties, start, "g").toPandas().sort_values("sample_id")
    assert list(got.columns[: len(d.columns)]) == list(d.columns) and len(got) == len(d)
    assert got.martingale.to_numpy() == pytest.approx(m, abs=1e-9)
    assert got[["score_z0", "score_z1"]].to_numpy() == pytest.approx(s, abs=1e-8)
    assert got[["score_z0", "score_z1"]].sum().to_numpy() == pytest.approx([0, 0], abs=1e-6)
    assert (got.schoenfeld_z0.notna() == got.e).all() and got.schoenfeld_z0.sum() == pytest.approx(0, abs=1e-6)
    inside = -2 * (m + np.where(d.e, np.log(np.maximum(1e-300, d.e - m)), 0))
    assert got.deviance.to_numpy() == pytest.approx(np.sign(m) * np.sqrt(np.maximum(0, inside)), abs=1e-8)
    by = pd.DataFrame(s).groupby(d.c).sum().to_numpy()
    assert sv.cox_robust(df, fit, "t", "e", "c", ties, start, "g").cov == pytest.approx(fit.cov @ by.T @ by @ fit.cov, rel=1e-6)
    ph = sv.proportional_hazards(df, fit, "t", "e", ties, start, "g")
    deaths = d[d.e].groupby("t").size()
    mean = sum(np.log(t) * k for t, k in deaths.items()) / deaths.sum()
    u = sum((np.log(t) - mean) * a for t, (a, _) in by_time.items())
    v = sum((np.log(t) - mean) ** 2 * b for t, (_, b) in by_time.items())
    assert ph.statistic.to_numpy() == pytest.approx([*(u**2 / np.diag(v)), u @ np.linalg.solve(v, u)], rel=1e-6)


@pytest.mark.parametrize("ties", ["efron", "breslow"])
@pytest.mark.parametrize("covariates", [[], ["z0", "z1"]])
def test_scan_against_the_information_of_the_joint_model(spark, ties, covariates):
    d = _data(70, 5)
    r = np.random.default_rng(8)
    values = np.column_stack([r.normal(size=70) + 50, d.z0 + r.normal(size=70), np.full(70, 3.0), r.integers(0, 3, 70)])
    values[r.random(values.shape) < 0.15] = np.nan
    long = pd.DataFrame(values, columns=list("pqrs")).assign(sample_id=d.sample_id).melt("sample_id", var_name="feature_id").dropna()
    got = sv.cox_scan(spark.createDataFrame(long), spark.createDataFrame(d), "t", "e", covariates, ties, "g").toPandas().set_index("feature_id")
    beta = series.cox(spark.createDataFrame(d), "t", "e", covariates, ties, stratum="g").beta if covariates else np.zeros(0)
    for i, f in enumerate("pqrs"):
        x = np.where(np.isnan(values[:, i]), np.nanmean(values[:, i]), values[:, i])
        full = np.column_stack([d[covariates].to_numpy(), x])
        _, s, info, _ = _plain(d, full, np.append(beta, 0.0), ties)
        score, k = s[:, -1].sum(), len(covariates)
        var = info[k, k] - info[k, :k] @ np.linalg.solve(info[:k, :k], info[:k, k]) if k else info[0, 0]
        row = got.loc[f]
        assert row.called == np.isfinite(values[:, i]).sum()
        if f == "r":
            assert row.status == "non_estimable" and np.isnan(row.beta)
        else:
            assert (row.status, row.score, row.variance) == ("ok", pytest.approx(score, abs=1e-7), pytest.approx(var, rel=1e-6))
            assert row.statistic == pytest.approx(score / np.sqrt(var), rel=1e-6)


def test_missing_values_and_an_empty_table(spark):
    d = _data(30, 9)
    d.loc[3, "t"] = np.nan
    d.loc[4, "z0"] = np.inf
    df = spark.createDataFrame(d)
    got = sv.cox_residuals(df, "t", "e", ["z0"], [0.2]).toPandas()
    assert sorted(set(range(30)) - set(got.sample_id)) == [3, 4]
    assert sv.cox_residuals(df.limit(0), "t", "e", ["z0"], [0.2]).count() == 0
    long = spark.createDataFrame([], "feature_id string, sample_id long, value double")
    assert sv.cox_scan(long, df, "t", "e", ["z0"]).count() == 0

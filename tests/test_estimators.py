import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import genetics as ge
from statloom.operators import hypothesis as h
from statloom.operators import likelihood as lk
from statloom.operators import meta, omics, series
from statloom.operators import regression as rg
from statloom.operators import settests as st

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def table(spark):
    n = 3000
    x, g = RNG.normal(size=n), RNG.integers(0, 60, n)
    u = RNG.normal(size=60)[g] * 0.7
    d = pd.DataFrame({"x": x, "z": RNG.uniform(size=n), "g": g, "id": np.arange(n)})
    d["y"] = 1 + 2 * x + u + RNG.normal(size=n)
    d["b"] = (RNG.uniform(size=n) < 1 / (1 + np.exp(-(0.3 + 0.8 * x + u)))).astype(float)
    d["c"] = RNG.poisson(np.exp(0.5 + 0.4 * x)).astype(float)
    d["zi"] = np.where(RNG.uniform(size=n) < 0.3, 0.0, d["c"])
    d["nb"] = RNG.negative_binomial(2, 2 / (2 + np.exp(0.7 + 0.5 * x))).astype(float)
    lat = 0.9 * x + RNG.logistic(size=n)
    d["o"] = np.digitize(lat, [-1.0, 0.5, 2.0]).astype(float)
    t = np.exp(1 + 0.5 * x + 0.6 * np.log(RNG.exponential(size=n)))
    d["t"], d["s"] = np.minimum(t, 6.0), (t > 6).astype(float)
    mu = 1 / (1 + np.exp(-(0.2 + 0.5 * x)))
    d["p"] = np.clip(RNG.beta(mu * 12, (1 - mu) * 12), 1e-6, 1 - 1e-6)
    d["w"] = np.sin(6 * d["z"]) + RNG.normal(size=n) * 0.3
    d["q"] = 3 * np.exp(-1.5 * d["z"]) + RNG.normal(size=n) * 0.05
    d["event"] = (RNG.uniform(size=n) < 0.7).astype(int)
    d["time"] = np.round(RNG.exponential(size=n) / np.exp(0.7 * x), 2) + 0.01
    return spark.createDataFrame(d).repartition(3).cache()


def near(fit, want, digits=0.12):
    got = dict(zip(fit.terms, fit.beta))
    for k, v in want.items():
        assert abs(got[k] - v) < digits, (k, got)
    assert np.isfinite(np.diag(fit.cov)).all()


def test_likelihood_models_recover_parameters(table):
    one = [rg.ONE, "x"]
    near(lk.ordinal(table, "o", ["x"]), {"x": 0.9, "0|1": -1.0, "1|2": 0.5, "2|3": 2.0})
    near(lk.censored(table, "t", "s", one, "weibull"), {rg.ONE: 1.0, "x": 0.5, "log(scale)": math.log(0.6)})
    near(lk.beta_regression(table, "p", one), {rg.ONE: 0.2, "x": 0.5, "precision:(Intercept)": math.log(12)})
    near(lk.zero_inflated(table, "zi", one), {rg.ONE: 0.5, "x": 0.4, "zero:(Intercept)": math.log(0.3 / 0.7)}, 0.2)
    near(lk.negative_binomial(table, "nb", one), {rg.ONE: 0.7, "x": 0.5, "log(size)": math.log(2)}, 0.2)
    near(lk.nonlinear(table, "q", ["z"], lambda th, d: th[0] * np.exp(th[1] * d["z"]), [1.0, -1.0], ["a", "b"]), {"a": 3.0, "b": -1.5}, 0.03)
    near(lk.quantile(table, "y", one, 0.5), {"x": 2.0})


def test_generalised_and_grouped_models(table):
    one = [rg.ONE, "x"]
    near(rg.glm(table, "c", one, "poisson"), {rg.ONE: 0.5, "x": 0.4}, 0.06)
    near(rg.glm(table, "c", one, "quasi_poisson"), {"x": 0.4}, 0.06)
    fit = lk.mixed_intercept(table, "y", one, "g")
    near(fit, {"x": 2.0}, 0.06)
    assert 0.25 < fit.extra["group_variance"] < 0.9 and 0.9 < fit.extra["residual_variance"] < 1.1
    gee = lk.gee(table, "y", one, "g")
    near(gee, {"x": 2.0}, 0.06)
    assert 0.15 < gee.extra["rho"] < 0.5 and gee.extra["clusters"] == 60
    glmm = lk.glmm_intercept(table, "b", one, "g")
    near(glmm, {"x": 0.8, "log(sd)": math.log(0.7)}, 0.3)
    cox = series.cox(table, "time", "event", ["x"])
    near(cox, {"x": 0.7}, 0.08)
    assert cox.extra["converged"] and cox.extra["lrt_p"] < 1e-10


def test_cox_ties_against_brute_force(spark):
    rows = [(1.0, 1, 0.5), (1.0, 1, -1.0), (2.0, 0, 0.3), (2.0, 1, 1.2), (3.0, 1, -0.4), (3.0, 1, 0.1), (3.0, 1, 2.0), (4.0, 0, 0.0)]
    df = spark.createDataFrame(rows, "t double, e int, x double")

    def ll(b, efron):
        total = 0.0
        for t in sorted({r[0] for r in rows if r[1]}):
            risk, dead = [math.exp(b * r[2]) for r in rows if r[0] >= t], [math.exp(b * r[2]) for r in rows if r[0] == t and r[1]]
            total += sum(b * r[2] for r in rows if r[0] == t and r[1])
            total -= sum(math.log(sum(risk) - (k / len(dead) * sum(dead) if efron else 0)) for k in range(len(dead)))
        return total

    for ties in ("efron", "breslow"):
        fit = series.cox(df, "t", "e", ["x"], ties)
        grid = np.linspace(-3, 3, 60001)
        best = grid[np.argmax([ll(b, ties == "efron") for b in grid[::60]]) * 60]
        assert abs(fit.beta[0] - best) < 0.05
        assert fit.extra["loglik"] == pytest.approx(ll(fit.beta[0], ties == "efron"), rel=1e-9)
        assert fit.extra["loglik"] >= max(ll(fit.beta[0] + d, ties == "efron") for d in (-0.01, 0.01))


def test_smooths(table):
    fit = lk.gam(table, "w", ["z"])
    at = np.linspace(0.05, 0.95, 10)
    curve = fit["curve"]("z", at) + fit["coef"][0]
    assert np.abs(curve - np.sin(6 * at)).max() < 0.12 and 4 < fit["edf"] < 12
    lo = lk.loess(table.withColumn("k", F.lit(1)), "z", "w", ["k"], span=0.2, points=21).toPandas()
    assert np.abs(lo["fitted"] - np.sin(6 * lo["x"])).mean() < 0.12


def test_published_values(spark):
    x = spark.createDataFrame([(float(i), float(v)) for i, v in enumerate((2, 1, 4, 3, 6, 5), 1)], "x double, y double")
    r = h.pearson(x, "x", "y").collect()[0]
    assert (r.statistic, r.p_value, r.estimate) == pytest.approx((2.95980010586301, 0.0415626822157434, 0.828571428571429), rel=1e-9)
    d = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 4.0, 3.0)] + [("b", v) for v in (3.0, 5.0, 4.0, 6.0)], "g string, v double")
    one = h.t_one_sample(d.filter("g = 'a'"), "v").collect()[0]
    assert (one.statistic, one.p_value) == pytest.approx((3.87298334620742, 0.030466291662171), rel=1e-9)
    two = h.t_two_sample(d, "v", "g", "a", "b").collect()[0]
    assert (two.statistic, two.p_value) == pytest.approx((-2.19089023002066, 0.0709876543209875), rel=1e-8)
    f = h.variance_ratio(d, "v", "g", "a", "b").collect()[0]
    assert (f.statistic, f.p_value) == pytest.approx((1.0, 1.0), abs=1e-9)
    n = 5000
    s = h.spearman(spark.range(n).select(F.col("id").cast("double").alias("x"), ((F.col("id") * 37) % (n + 1)).cast("double").alias("y")), "x", "y").collect()[0]
    assert s.estimate == pytest.approx(0.0264531288981252, rel=1e-9) and s.p_value == pytest.approx(0.0614313060687661, rel=1e-3)


def test_meta_methods_agree_with_direct_formulas(spark):
    y, se = np.array([0.1, 0.5, 0.3, -0.2, 0.6]), np.array([0.1, 0.2, 0.15, 0.12, 0.3])
    df = spark.createDataFrame([("f", f"c{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(y, se))] + [("one", "c0", 0.2, 0.1), ("bad", "c0", float("nan"), 0.1)], "f string, c string, y double, s double")
    pm = {r.feature: r for r in meta.pool(df, "f", "c", "y", "s", "pm").collect()}
    w = 1 / (se**2 + pm["f"].tau2)
    assert (w * (y - (w @ y) / w.sum()) ** 2).sum() == pytest.approx(4.0, rel=1e-6)
    assert pm["one"].status == "single_cohort" and pm["one"].estimate == pytest.approx(0.2) and "bad" not in pm
    reml = {r.feature: r for r in meta.pool(df, "f", "c", "y", "s", "reml").collect()}["f"]

    def dev(t):
        w = 1 / (se**2 + t)
        m = (w @ y) / w.sum()
        return -np.log(w).sum() + np.log(w.sum()) + (w * (y - m) ** 2).sum()

    grid = np.linspace(0, 1, 200001)
    assert reml.tau2 == pytest.approx(grid[np.argmin([dev(t) for t in grid[::20]]) * 20], abs=2e-4)


def test_omics(spark):
    n, p = 12, 200
    group = np.array([0] * 6 + [1] * 6, float)
    batch = np.array([0, 1] * 6)
    x = RNG.normal(size=(p, n)) + RNG.normal(size=(p, 1))
    x[:20] += 3 * group
    b = x + 2.0 * batch + RNG.normal(size=(p, 1)) * 0.3 * batch
    long = lambda m: spark.createDataFrame([(f"f{i:03d}", f"s{j:02d}", float(m[i, j])) for i in range(p) for j in range(n)], "feature_id string, sample_id string, value double")
    design = np.stack([np.ones(n), group], 1)
    out = omics.moderated(long(x), design, 1).toPandas().set_index("feature_id")
    assert (out["p_value"].iloc[:20] < 0.01).mean() > 0.8 and (out["p_value"].iloc[20:] < 0.01).mean() < 0.05
    ids = [f"s{j:02d}" for j in range(n)]
    fixed = omics.combat(long(b), pd.Series(batch, ids), design[:, 1:]).toPandas().pivot(index="feature_id", columns="sample_id", values="value").to_numpy()
    gap = np.abs(fixed[:, batch == 0].mean(1) - fixed[:, batch == 1].mean(1)).mean()
    assert gap < 0.35 < np.abs(b[:, batch == 0].mean(1) - b[:, batch == 1].mean(1)).mean()
    pc = omics.pca(long(b), 2)
    assert abs(np.corrcoef(pc["PC1"], batch)[0, 1]) > 0.8
    counts = RNG.poisson(np.exp(3 + 0.8 * group * (np.arange(p)[:, None] < 20) + RNG.normal(size=(p, 1)) * 0.3), size=(p, n)).astype(float)
    nb = omics.nb_differential(long(counts), design, 1).toPandas().set_index("feature_id").sort_index()
    assert (nb["p_value"].iloc[:20] < 0.01).mean() > 0.8
    vm = omics.voom(long(counts), design, 1).toPandas().set_index("feature_id").sort_index()
    assert (vm["p_value"].iloc[:20] < 0.01).mean() > 0.8
    sv = omics.surrogate_variables(long(b), design, k=1)
    assert sv.shape == (n, 1) and abs(np.corrcoef(sv[:, 0], batch)[0, 1]) > 0.8
    holes = spark.createDataFrame([(float(a), None if i % 5 == 0 else float(2 * a)) for i, a in enumerate(RNG.normal(size=60))], "a double, b double")
    imp = omics.impute(holes, ["a", "b"], m=3).toPandas()
    assert len(imp) == 180 and not imp["b"].isna().any() and np.corrcoef(imp["a"], imp["b"])[0, 1] > 0.9


def test_kinship(spark):
    ped = spark.createDataFrame([("f", None, None), ("m", None, None), ("a", "f", "m"), ("b", "f", "m"), ("c", "a", "b")], "id string, sire string, dam string")
    k = {(r.a, r.b): r.value for r in omics.kinship(ped).collect()}
    assert k[("a", "b")] == 0.25 and k[("a", "f")] == 0.25 and k[("c", "c")] == 0.625 and k[("a", "c")] == 0.375 and ("f", "m") not in k


def test_genetics_kernels(spark):
    assert ge.hwe_exact(0, 4, 6) == 1.0
    n, rare = 20, 10
    probs = {}
    for het in range(0, rare + 1, 2):
        a, c = (rare - het) // 2, n - het - (rare - het) // 2
        probs[het] = 2**het / (math.factorial(het) * math.factorial(a) * math.factorial(c))
    total = sum(probs.values())
    assert ge.hwe_exact(2, 6, 12) == pytest.approx(sum(v for v in probs.values() if v <= probs[6] * (1 + 1e-12)) / total)
    g = RNG.binomial(2, 0.3, size=(800, 5)).astype(float)
    r = RNG.normal(size=800)
    out = st.set_statistics((g - g.mean(0)).T @ r, np.cov(g.T) * 799, np.ones(5))
    q = np.array([(((g - g.mean(0)).T @ RNG.normal(size=800)) ** 2).sum() for _ in range(3000)])
    assert out["skat_p"] == pytest.approx((q >= out["skat_q"]).mean(), abs=0.04)
    assert 0 <= out["skato_p"] <= 1
    hits = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.04)], "variant_id string, p_value double")
    ld = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("c", "d", 0.9)], "a string, b string, r double")
    assert sorted(r.variant_id for r in ge.clump(hits, ld, r2=0.5).collect()) == ["a", "c"]


def test_arima_and_ldsc(spark):
    e = RNG.normal(size=600)
    y = np.zeros(600)
    for i in range(1, 600):
        y[i] = 0.6 * y[i - 1] + e[i]
    fit = series.fit_arima(y + 3, 1, 0, 0, 2)
    assert fit["ar"][0] == pytest.approx(0.6, abs=0.1) and fit["mean"] == pytest.approx(3, abs=0.4)
    m = 4000
    l = RNG.gamma(2, 20, m)
    z = RNG.normal(size=m) * np.sqrt(1 + 50_000 * 0.4 / 100_000 * l)
    df = spark.createDataFrame(pd.DataFrame({"chromosome": 1, "position": np.arange(m), "z": z, "n": 50_000.0, "l": l}))
    out = ge.ldsc(df, "z", "z", "n", "n", "l", 100_000.0, blocks=50)
    assert out["h2"] == pytest.approx(0.4, abs=0.15) and out["blocks"] == 50 and out["h2_se"] > 0

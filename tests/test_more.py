import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions import special as sp
from statloom.operators import graphs as gr
from statloom.operators import predictions as pr
from statloom.operators import rare
from statloom.operators import regression as rg
from statloom.plans import association as asc
from statloom.sources import svg

RNG = np.random.default_rng(5)


def test_rare_kernels_under_the_null():
    g = RNG.binomial(2, 0.05, size=(600, 6)).astype(float)
    maf, mac = g.mean(0) / 2, g.sum(0)
    cov = np.cov(g.T) * 599
    root = np.linalg.cholesky(cov)
    ps = {"acat_o": [], "vt": [], "het": []}
    for _ in range(150):
        u = root @ RNG.normal(size=6)
        ps["acat_o"].append(rare.acat_o(u, cov, maf, mac))
        ps["vt"].append(rare.variable_threshold(u, cov, maf, 500)[1])
        ps["het"].append(rare.heterogeneous([u, root @ RNG.normal(size=6)], [cov, cov], rare.beta_weights(maf, 1, 25))[0])
    for name, p in ps.items():
        assert 0.35 < np.mean(p) < 0.65 and np.min(p) > 1e-4, name
    assert rare.cauchy(np.array([0.5, 0.5])) == pytest.approx(0.5) and rare.cauchy(np.array([0.0, 0.3])) == 0.0 and math.isnan(rare.cauchy(np.array([0.0, 1.0])))


def test_conditioning_and_stepwise():
    r = np.array([[1, 0.9, 0.0], [0.9, 1, 0.0], [0, 0, 1.0]])
    z = np.array([8.0, 7.2, 7.0])
    u, c = rare.condition(z, r, [0])
    assert u[1] == pytest.approx(0.0) and c[2, 2] == 1
    assert rare.stepwise(z, r, ["g"] * 3) == ([0, 2], True)
    assert rare.stepwise(z, r, ["g"] * 3, most=1) == ([0], True)


def test_sets_over_cohorts(spark):
    rows, cov = [], []
    for s in range(3):
        for c in ("a", "b"):
            k = np.diag([4.0, 3.0]) + 0.5
            u = np.linalg.cholesky(k) @ RNG.normal(size=2)
            rows += [(s, f"v{i}", c, float(u[i]), 0.01 * (i + 1), 20.0) for i in range(2)]
            cov += [(s, c, f"v{i}", f"v{j}", float(k[i, j])) for i in range(2) for j in range(i, 2)]
    out = rare.by_set(spark.createDataFrame(rows, "set_id int, variant_id string, cohort string, u double, maf double, mac double"), spark.createDataFrame(cov, "set_id int, cohort string, row string, col string, v double")).collect()
    assert len(out) == 3 and all(0 <= r[n] <= 1 for r in out for n in ("burden", "skat", "skat_o", "acat_v", "acat_o", "vt", "het_skat", "het_skat_o", "burden_fixed", "burden_random"))
    w = rare.sliding_windows(spark.createDataFrame([("x", "1", 1000)], "variant_id string, chromosome string, position long"), 2000, 500)
    assert sorted(r.set_id for r in w.collect()) == ["1:0", "1:1000", "1:500"]


def test_covariance_window(spark):
    g = RNG.binomial(2, 0.4, size=(40, 3)).astype(float)
    df = spark.createDataFrame([(f"v{j}", "1", 100 * j, f"s{i}", float(g[i, j])) for i in range(40) for j in range(3)], "variant_id string, chromosome string, position long, sample_id string, dosage double")
    got = {(r.row, r.col): r.v for r in rare.covariance_window(df, df.select("sample_id").distinct(), 100).collect()}
    c = np.cov(g.T) * 39
    assert set(got) == {("v0", "v0"), ("v1", "v1"), ("v2", "v2"), ("v0", "v1"), ("v1", "v2")}
    assert got[("v0", "v1")] == pytest.approx(c[0, 1]) and got[("v2", "v2")] == pytest.approx(c[2, 2])


def test_networks(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a")], "source string, target string")
    assert {(r.node, r.near) for r in gr.neighborhoods(e, 2).filter("node = 'a'").collect()} == {("a", "b"), ("a", "c"), ("a", "x")}
    out = {r.node: r for r in gr.driver_permutation(e, spark.createDataFrame([("b",)], "node string"), permutations=60).collect()}
    assert out["a"].observed == 1 and 0 < out["a"].p_value <= 1 and out["d"].p_value == 1.0
    x = RNG.normal(size=(200, 1))
    m = np.hstack([x + RNG.normal(size=(200, 1)) * 0.3, x, x * -1 + RNG.normal(size=(200, 1)) * 0.3, RNG.normal(size=(200, 2))])
    long = spark.createDataFrame([(i, f"g{j}", float(m[i, j])) for i in range(200) for j in range(5)], "s int, f string, v double")
    net = {(r.a, r.b) for r in gr.sparse_network(long, "s", "f", "v", 0.2).collect()}
    assert ("g0", "g1") in net and ("g1", "g2") in net and not any("g3" in p or "g4" in p for p in net)
    labels = spark.createDataFrame([("a", "p", "s1"), ("b", "q", "s1"), ("c", "p", "s1"), ("d", "p", "s1"), ("x", "q", "s1")], "node string, label string, sample_id string")
    f = {(r.a, r.b): r.k for r in gr.edge_fractions(e, labels).collect()}
    assert f == {("p", "q"): 3, ("p", "p"): 1}


def test_predictions_and_scores(spark):
    n = 800
    x, z = RNG.normal(size=n), RNG.normal(size=n)
    y = (RNG.uniform(size=n) < 1 / (1 + np.exp(-(0.5 * x)))).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b), float(c), float(2 * a + b * 0.5)) for i, (a, b, c) in enumerate(zip(x, z, y))], "sample int, x double, z double, y double, t double")
    fit = rg.glm(df, "y", [rg.ONE, "x"], "binomial")
    d = pr.contrast(df, fit, "binomial", {"x": 1.0}, {"x": 0.0})
    mean = lambda v: 1 / (1 + math.exp(-(fit.beta[0] + fit.beta[1] * v)))
    assert d["estimate"] == pytest.approx(mean(1) - mean(0), rel=1e-6)
    r = pr.contrast(df, fit, "binomial", {"x": 1.0}, {"x": 0.0}, kind="ratio")
    assert r["ratio"] == pytest.approx(mean(1) / mean(0), rel=1e-6)
    model = pr.train_score(df, "t", ["x", "z"], alpha=0.5)
    assert model["weights"]["x"] == pytest.approx(2, abs=0.05)
    assert "score" in pr.apply_score(df, model).columns


def test_association_end_to_end(spark):
    n = 60
    g = RNG.binomial(2, 0.3, size=(n, 4)).astype(float)
    g[:, 3] = 1.0
    age = RNG.normal(size=n)
    y = 0.8 * g[:, 0] + 0.3 * age + RNG.normal(size=n) * 0.3
    pheno = spark.createDataFrame([(f"s{i}", i, float(y[i]), float(age[i]), "m" if i % 2 else "f", float(y[i] > 0.5)) for i in range(n)], "sample_id string, i int, y double, age double, sex string, b double")
    feats = spark.createDataFrame([(f"v{j}", f"s{i}", None if (i + j) % 17 == 0 else float(g[i, j])) for i in range(n) for j in range(4)], "feature_id string, sample_id string, value double")
    out = {r.feature_id: r for r in asc.associate(pheno, feats, "y ~ <omics> + age + sex", order="i", variants=True, maf=(0.01, 0.5), annotation=spark.createDataFrame([("v0", "G")], "feature_id string, gene string")).collect()}
    assert out["v0"].status == "ok" and out["v0"].p_value < 1e-10 and out["v0"].annot_gene == "G" and out["v1"].annot_gene == ""
    assert out["v3"].status == "filtered" and "MONOMORPHIC" in out["v3"].filter_reason
    # the scan against a direct fit with the mean-imputed feature
    x = np.array([np.nan if i % 17 == 0 else g[i, 0] for i in range(n)])
    x = np.where(np.isnan(x), np.nanmean(x), x)
    d = np.stack([np.ones(n), age, (np.arange(n) % 2 == 1).astype(float), x], 1)
    b, rss = np.linalg.lstsq(d, y, rcond=None)[:2]
    se = math.sqrt(rss[0] / (n - 4) * np.linalg.inv(d.T @ d)[3, 3])
    assert out["v0"].beta == pytest.approx(b[3]) and out["v0"].standard_error == pytest.approx(se)
    assert out["v0"].p_value == pytest.approx(float(np.exp(sp.t_logsf2(b[3] / se, n - 4))), rel=1e-6)
    binary = {r.feature_id: r for r in asc.associate(pheno, feats, "b ~ <omics> + age").collect()}
    assert binary["v0"].p_value < 0.01


def test_plots_are_svg(spark):
    df = spark.range(500).select((F.col("id") % 7).cast("string").alias("g"), (F.col("id") % 13).cast("string").alias("h"), F.rand(1).alias("x"), F.rand(2).alias("p"))
    for text in (svg.scatter(df, "x", "p"), svg.histogram(df, "x"), svg.boxes(df, "g", "x"), svg.quantile_quantile(df, "p"), svg.heatmap(df, "g", "h", "x"), svg.bars(df.groupBy("g").count(), "g", "count"), svg.scatter(df.limit(0), "x", "p")):
        assert text.startswith("<svg") and text.endswith("</svg>")


def test_missing_values_stay_missing(spark):
    from statloom.operators import genetics as ge
    from statloom.operators import multiplicity as mt
    from statloom.operators import transforms as tr

    d = spark.createDataFrame([("v", "a", 1.0), ("v", "b", None), ("v", "c", float("nan")), ("v", "d", 1.0), ("w", "a", None)], "variant_id string, sample_id string, dosage double")
    s = {r.variant_id: r for r in ge.variant_filters(ge.variant_statistics(d)).collect()}
    assert s["v"].called == 2 and s["v"].missing_rate == 0.5 and s["v"].reasons == ["MONOMORPHIC"] and s["w"].reasons == ["NO_CALLED_SAMPLES"]
    x = spark.createDataFrame([("f", 0.1 * i) for i in range(10)] + [("f", None), ("f", float("nan"))], "f string, v double")
    for pipe in ("winsor()", "winsor_mad()", "zscore()", "log1p()", "log(shift=1)", "mvalue()"):
        assert sum(r.v is None for r in tr.apply(x, pipe, "f", "v").collect()) == 2, pipe
    p = spark.createDataFrame([(1, 0.01, 1.0), (2, None, 2.0), (3, float("nan"), 1.0), (4, 0.5, 2.0)], "id int, p double, w double")
    for out in (mt.bh(p, "p", "id"), mt.weighted_bh(p, "p", "w", "id"), mt.by_adjust(p, "p", "id"), mt.bh(p, "p", "id", missing_as_one=True)):
        assert sorted(r.id for r in out.collect() if r.q is None) == [2, 3]
    e = ge.evidence_score(spark.createDataFrame([(0.5, None), (2.0, 1.0)], "a double, b double"), [{"column": "a", "weight": 1, "minimum": 0, "maximum": 1}, {"column": "b", "weight": 3, "minimum": 0, "maximum": 2, "direction": "lower"}]).collect()
    assert e[0].score is None and e[0].coverage == 0.25 and e[1].score == pytest.approx(0.25 + 0.375)


def test_probe_enrichment_against_direct_computation(spark):
    names = [f"G{i:02d}" for i in range(20)]
    rows = []
    for i in range(60):
        g = [names[i % 20]] + ([names[(i * 7) % 20]] if i % 5 == 0 else [])
        rows.append((f"p{i:02d}", ";".join(g), i % 6 == 0 or i in (1, 21)))
    sets = {"a": names[:6], "b": names[6:9], "c": names[::4], "none": ["X"]}
    c = {}
    for _, g, sel in rows:
        own = sorted(set(g.split(";")))
        for x in own:
            c.setdefault(x, [0.0, 0.0])
            c[x][0] += 1 / len(own)
            c[x][1] += sel / len(own)
    order = sorted(sorted(c), key=lambda x: round(c[x][0], 12))
    t = gr.tricube_trend(np.array([c[x][1] > 0 for x in order], float))
    k = sum(c[x][1] > 0 for x in c)
    out = {r.set_id: r for r in gr.probe_enrichment(spark.createDataFrame([(s, x) for s, v in sets.items() for x in v], "set_id string, gene string"), spark.createDataFrame(rows, "probe string, genes string, sel boolean"), F.col("sel")).collect()}
    assert set(out) == {"a", "b", "c"}
    for s in out:
        m = np.array([x in sets[s] for x in order])
        odds, hits = t[m].mean() / t[~m].mean(), sum(min(1.0, c[x][1]) for x in sets[s])
        assert out[s].odds == pytest.approx(odds) and out[s].weighted == pytest.approx(hits)
        assert out[s].p_value == pytest.approx(sp.wallenius_sf(int(hits + 1e-9), int(m.sum()), int((~m).sum()), k, odds))


def test_overlap_and_joint_outcomes(spark):
    import pandas as pd

    from statloom.operators import mr

    x, sx = np.array([0.22, 0.31, 0.45, 0.19, 0.38]), np.array([0.03, 0.04, 0.035, 0.025, 0.045])
    y, sy = np.array([0.244, 0.277, 0.41, 0.238, 0.336]), np.array([0.04, 0.05, 0.045, 0.035, 0.055])
    df = spark.createDataFrame([(1, f"v{i}", float(a), float(b), float(c), float(d), 0.3 * float(b * d)) for i, (a, b, c, d) in enumerate(zip(x, sx, y, sy))], "g int, variant string, beta_x double, se_x double, beta_y double, se_y double, cov double")
    r = mr.overlap_aware(df, ["g"], "cov").collect()[0]
    v = sy**2 + (r.estimate * sx) ** 2 - 2 * r.estimate * 0.3 * sx * sy
    assert r.converged and r.estimate == pytest.approx((x * y / v).sum() / (x * x / v).sum(), rel=1e-8) and r.se == pytest.approx(1 / math.sqrt((x * x / v).sum()))
    both = df.withColumn("outcome", F.lit("a")).unionByName(df.withColumn("outcome", F.lit("b")).withColumn("beta_y", F.col("beta_y") * 0.5))
    plain = mr.ivw(df, ["g"]).collect()[0]
    j = mr.joint_outcomes(both, ["g"], pd.DataFrame(np.eye(2), ["a", "b"], ["a", "b"])).collect()[0]
    assert j.n == 5 and j.estimates == pytest.approx([plain.estimate, plain.estimate / 2])
    assert j.statistic == pytest.approx((plain.estimate / plain.se) ** 2 * 1.25)


def test_pooling_keeps_the_digits_of_large_effects_and_the_place_of_missing_cohorts(spark):
    from statloom.operators import meta

    rows = [("f", "b", 1e7, 0.01), ("f", "a", 1e7 + 0.02, 0.01), ("g", "a", 0.5, 0.1), ("g", "b", None, 0.1), ("g", "c", -0.5, 0.0), ("h", "c", 0.0, 0.2)]
    df = spark.createDataFrame(rows, "f string, c string, y double, s double")
    got = {r.feature: r for r in meta.pool(df, "f", "c", "y", "s").collect()}
    assert got["f"].q == pytest.approx(2.0, rel=1e-6) and got["f"].estimate == pytest.approx(1e7 + 0.01, abs=1e-8)
    assert [got[x].direction for x in "fgh"] == ["++?", "+??", "??0"]
    order = {r.feature: r.direction for r in meta.pool(df, "f", "c", "y", "s", "dl", cohorts=["c", "b", "a"]).collect()}
    assert order == {"f": "?++", "g": "??+", "h": "0??"}
    hk = {r.feature: r for r in meta.pool(df, "f", "c", "y", "s", "fixed", "hk").collect()}["f"]
    assert hk.se == pytest.approx(math.sqrt(2.0 / (2 / 0.01**2)), rel=1e-6)


@pytest.mark.parametrize("mean", [0.0, 1e4, 1e7])
def test_a_scan_does_not_depend_on_the_mean_of_a_feature(spark, mean):
    rng = np.random.default_rng(2)
    x, z, e = rng.normal(size=200), rng.normal(size=200), rng.normal(size=200)
    y = 2 * x + z + e
    pheno = spark.createDataFrame([(i, float(y[i]), float(z[i]), float(2 * z[i] + 1)) for i in range(200)], "sample_id int, y double, z double, again double")
    feats = [(f, i, v) for i in range(200) for f, v in (("x", float(x[i] + mean)), ("z", float(3 * z[i] + mean)), ("one", mean))] + [("gap", i, float(x[i] + mean) if i % 5 else None) for i in range(200)]
    feats = spark.createDataFrame(feats, "feature_id string, sample_id int, value double")
    want = np.linalg.lstsq(np.stack([np.ones(200), z, x], 1), y, rcond=None)[0][2]
    for covariates in (["z"], ["z", "again"]):  # a covariate that repeats another is left out
        got = {r.feature_id: r for r in rg.scan(feats, pheno, "y", covariates).collect()}
        assert got["x"].beta == pytest.approx(want, rel=1e-6) and got["x"].df == 197
        assert got["z"].status == got["one"].status == "non_estimable" and got["z"].beta is None and got["gap"].status == "ok"


def test_score_scan_tells_what_cannot_be_estimated(spark):
    rng = np.random.default_rng(3)
    pheno = spark.createDataFrame([(i, int(rng.random() < 0.4), float(rng.normal())) for i in range(120)], "sample_id int, y int, z double")
    z = {r.sample_id: r.z for r in pheno.collect()}
    feats = spark.createDataFrame([(f, i, v) for i in range(120) for f, v in (("ok", float(rng.normal())), ("z", z[i]), ("none", 0.0))], "feature_id string, sample_id int, value double")
    got = {r.feature_id: r for r in rg.score_scan(feats, pheno, "y", ["z"], "binomial").collect()}
    assert {f: r.status for f, r in got.items()} == {"ok": "ok", "z": "non_estimable", "none": "non_estimable"} and got["z"].p_value is None


def test_limits_raise_instead_of_dropping(spark, monkeypatch):
    from statloom.operators import likelihood as lk

    monkeypatch.setattr(lk, "MOST_CATEGORIES", 3)
    with pytest.raises(ValueError):
        lk.multinomial(spark.range(40).select((F.col("id") % 5).alias("y"), F.rand(1).alias("x")), "y", [rg.ONE, "x"])
    monkeypatch.setattr(gr, "MOST_EDGES", 2)
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "source int, target int")
    with pytest.raises(ValueError):
        gr.moran_permutation(edges, spark.createDataFrame([(0, "f", 1.0)], "node int, feature_id string, value double"))


def test_harmonic_factor_is_one_formula_for_all_sizes(spark):
    from statloom.operators import multiplicity as mu

    ps = [0.001, 0.02, 0.03, 0.5, 0.9]
    got = {r.i: r.q for r in mu.by_adjust(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p", "i").collect()}
    assert got[0] == pytest.approx(0.001 * 5 * sum(1 / k for k in range(1, 6)), rel=1e-12)


def test_running_sums_over_many_partitions_and_risk_sets(spark):
    from statloom.operators import ordered as od
    from statloom.operators import series

    df = spark.createDataFrame([(float(t), t % 3, t % 2) for t in range(50)], "t double, v int, g int").repartition(7)
    up = {r.t: (r.a, r.b) for r in od.running_sums(df, {"a": F.col("v"), "b": F.col("t")}, [F.desc("t")]).collect()}
    assert up == {float(t): (sum(k % 3 for k in range(t, 50)), float(sum(range(t, 50)))) for t in range(50)}
    own = {r.t: r.a for r in od.running_sums(df, {"a": F.col("v")}, [F.asc("t")], ["g"]).collect()}
    assert own[7.0] == 1 % 3 + 3 % 3 + 5 % 3 + 7 % 3
    km = {r.t: (r.at_risk, r.survival) for r in series.kaplan_meier(spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1), (4.0, 1)], "t double, e int"), "t", "e").collect()}
    assert km[1.0] == (4, pytest.approx(0.75)) and km[3.0] == (2, pytest.approx(0.375)) and km[4.0] == (1, 0.0)

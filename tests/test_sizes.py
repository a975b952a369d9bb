"""What only shows on tables of several tasks, many samples or dense positions."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from statloom.operators import genetics, likelihood, mr, omics, transforms
from statloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_mr_effects_do_not_depend_on_how_rows_are_dealt(spark, tmp_path):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t in ("part", "supplier"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    con.execute(f"COPY (FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (ROW_GROUP_SIZE 2048)")
    for t in ("part", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    want = sorted((r[0], r[1], r[2]) for r in con.execute(f"SELECT exposure, outcome, variant FROM ({catalogue.oracle_sql()['mr_harmonize']})").fetchall())
    keys = {"spark.sql.files.maxPartitionBytes": "40000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    was = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert spark.read.parquet(f"{tmp_path}/lineitem.parquet").rdd.getNumPartitions() > 1
        got = sorted((r[0], r[1], r[2]) for r in catalogue.queries()["mr_harmonize"](spark, str(tmp_path)).select("exposure", "outcome", "variant").collect())
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == want


def _long(spark, x):
    rows = [(f"f{i}", j, None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["feature_id", "sample_id", "value"]), "feature_id string, sample_id long, value double")


def test_feature_wide_models_take_more_samples_than_the_sample_matrix_may_have(spark, monkeypatch):
    monkeypatch.setattr(omics, "MAX_SAMPLES", 50)
    rng = np.random.default_rng(5)
    n = 90
    x = rng.normal(size=(6, n)) + np.arange(6)[:, None]
    x[2, 7] = np.nan
    design = np.stack([np.ones(n), np.arange(n) % 2.0], 1)
    filled = np.where(np.isnan(x), np.nanmean(x, 1, keepdims=True), x)
    d = _long(spark, x)
    got = omics.moderated(d, design, 1).toPandas().set_index("feature_id").sort_index()
    assert np.allclose(got["effect"], [np.linalg.lstsq(design, v, rcond=None)[0][1] for v in filled])
    counts = _long(spark, rng.poisson(20, size=(6, n)))
    assert len(omics.nb_differential(counts, design, 1).dropna().collect()) == 6 and len(omics.voom(counts, design, 1).dropna().collect()) == 6
    monkeypatch.setattr(omics, "_CELLS", 100)
    fixed = omics.combat(d, pd.Series(np.arange(n) % 3, index=range(n))).toPandas().pivot(index="feature_id", columns="sample_id", values="value").to_numpy()
    assert fixed.shape == (6, n) and np.isfinite(fixed).all()
    gap = lambda v: np.abs([v[:, np.arange(n) % 3 == k].mean(1) - v.mean(1) for k in range(3)]).max()
    assert gap(fixed) <= gap(filled)


def test_components_from_the_features_side_agree_with_those_of_the_samples(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 70
    hidden = rng.normal(size=(2, n))
    x = rng.normal(size=(12, n)) + rng.normal(size=(12, 2)) @ hidden + 0.1 * np.arange(12)[:, None]
    x[4, 9] = np.nan
    d = _long(spark, x)
    design = np.stack([np.ones(n), np.arange(n) % 2.0], 1)
    run = lambda: (omics.pca(d, 3), omics.surrogate_variables(d, design, k=2), omics.surrogate_variables(d, design[:, 1:], design[:, :0], k=2))
    monkeypatch.setattr(omics, "MAX_FEATURES", 0)
    pc, sv, bare = run()
    monkeypatch.setattr(omics, "MAX_FEATURES", 2048)
    monkeypatch.setattr(omics, "MAX_SAMPLES", 50)
    pc2, sv2, bare2 = run()
    assert np.allclose(pc.to_numpy(), pc2.to_numpy(), atol=1e-8) and np.allclose(pc.attrs["share"], pc2.attrs["share"])
    same = lambda a, b: np.allclose(np.abs(a.T @ b), np.eye(2), atol=1e-6)
    assert same(sv, sv2) and same(bare, bare2)


def test_regions_sum_covariances_of_all_pairs_without_pairing(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(0, 400, 300), 10_000 + rng.integers(0, 30_000, 400), [99_000, 99_001]])
    d = spark.createDataFrame(pd.DataFrame({"c": "1", "x": x, "b": rng.normal(size=len(x)), "p": rng.uniform(size=len(x)), "id": np.arange(len(x))}))
    plan = transforms.regions(d, "c", "x", "b", "p", "id", max_gap=1_000, min_probes=2, length=37.0)
    assert not any("Join" in line and "_y" in line for line in plan._jdf.queryExecution().optimizedPlan().toString().splitlines())
    got = plan.orderBy("region").toPandas()
    own = [np.sort(x[(x >= a) & (x <= b)]).astype(float) for a, b in zip(got["start"], got["end"])]
    assert sum(len(o) for o in own) == len(x) and len(own) == 3
    assert np.allclose(got["var"], [np.exp(-np.abs(o[:, None] - o) / 37.0).sum() for o in own], rtol=1e-12)


def test_contamination_mixture_keeps_no_table_of_all_instruments(spark):
    rng = np.random.default_rng(9)
    n = 20_000
    x = rng.normal(1, 0.1, n)
    d = spark.createDataFrame(pd.DataFrame({"e": "x", "beta_x": x, "beta_y": 0.4 * x + rng.normal(0, 0.1, n), "se_x": 0.01, "se_y": 0.1}))

    def peak(pdf):
        import resource

        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024

    row = mr.contamination_mixture(d, ["e"]).collect()[0]
    assert row.n == n and abs(row.estimate - 0.4) < 0.02
    used = d.repartition(4).mapInPandas(lambda it: (pd.DataFrame({"m": [peak(p)]}) for p in it), "m long").agg(F.max("m")).collect()[0][0]
    assert used < 900


def test_mixed_logit_takes_many_groups_at_a_time(spark):
    rng = np.random.default_rng(10)
    g = rng.integers(0, 300, 3000)
    x = rng.integers(0, 5, 3000) / 4
    b = (rng.uniform(size=3000) < 1 / (1 + np.exp(-(0.8 * x - 0.3 + 0.7 * rng.normal(size=300)[g])))).astype(float)
    d = spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "b": b}))
    calls = spark.sparkContext.accumulator(0)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    dealt = d.groupBy("g", "x", "b").agg(F.count(F.lit(1)).alias("_n")).repartition("g").sortWithinPartitions("g")

    def one(pdf, starts):
        calls.add(1)
        own = np.add.reduceat(pdf["_n"].to_numpy(float), starts)
        return np.array([len(starts), own.sum(), (own * own).sum()])

    try:
        for size in (7, 1, 10_000):  # groups go on over the edges of batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            before = calls.value
            n = np.bincount(g)
            assert likelihood.group_totals(dealt, "g", one).tolist() == [(n > 0).sum(), 3000, (n * n).sum()]
        assert calls.value - before < 50
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    fit = likelihood.glmm_intercept(d, "b", ["x"], "g")
    assert fit.n == 3000


def test_relationships_by_blocks_join_no_rows_by_variant(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 3, size=(1500, 3)).astype(float)
    d = spark.createDataFrame(pd.DataFrame({"variant_id": np.tile(np.arange(3), 1500), "sample_id": np.repeat(np.arange(1500), 3), "dosage": x.ravel()}))
    plan = genetics.grm(d)
    assert "zb" not in plan._jdf.queryExecution().optimizedPlan().toString()
    got = plan.toPandas().set_index(["a", "b"])["value"].unstack().to_numpy()
    p = x.mean(0) / 2
    z = (x - 2 * p) / np.sqrt(2 * p * (1 - p))
    assert np.allclose(got[np.triu_indices(1500)], (z @ z.T / 3)[np.triu_indices(1500)]) and np.isnan(got[np.tril_indices(1500, -1)]).all()


@pytest.mark.parametrize("name", ["mr_harmonize", "mr_ivw", "xwas_mr_grid", "mr_egger", "mr_steiger", "mr_weighted_median"])
def test_mr_lines_of_unlisted_parts_are_left_out(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t in ("lineitem", "supplier"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    con.execute(f"COPY (FROM '{SF}/part.parquet' WHERE p_partkey % 5 <> 0) TO '{tmp_path}/part.parquet'")
    for t in ("part", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = catalogue.queries()[name](spark, str(tmp_path)).select(*names).toPandas()
    pd.testing.assert_frame_equal(*(d.sort_values([c for c in ("exposure", "outcome", "variant") if c in d]).reset_index(drop=True) for d in (got, want.df())), check_dtype=False, rtol=1e-6)


def test_relationships_shuffle_no_copies_of_samples(spark):
    rng = np.random.default_rng(12)
    n, m = 2300, 5  # three blocks
    x = rng.integers(0, 3, size=(n, m)).astype(float)
    d = pd.DataFrame({"variant_id": np.tile(np.arange(m), n), "sample_id": np.repeat([f"s{i:04d}" for i in range(n)], m), "dosage": x.ravel()})
    there = rng.random(n * m) > 0.03
    plan = genetics.grm(spark.createDataFrame(d[there]), min_call=0.9)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()  # each block was dealt once for every other before
    got = plan.toPandas()
    there = there.reshape(n, m)
    p = np.where(there, x, 0).sum(0) / there.sum(0) / 2
    z = np.where(there, (x - 2 * p) / np.sqrt(2 * p * (1 - p)), 0)
    meet = np.triu(there.astype(int) @ there.T > 0)
    a, b = got["a"].str[1:].astype(int).to_numpy(), got["b"].str[1:].astype(int).to_numpy()
    assert len(got) == meet.sum() and meet[a, b].all() and len(set(zip(a, b))) == len(got)
    assert np.allclose(got["value"], (z @ z.T / m)[a, b])


def test_relationships_over_many_variants(spark):
    rng = np.random.default_rng(13)
    n, m = 40, 1500  # two groups of variants
    x = rng.integers(0, 3, size=(n, m)).astype(float)
    d = spark.createDataFrame(pd.DataFrame({"variant_id": np.tile(np.arange(m), n), "sample_id": np.repeat(np.arange(n), m), "dosage": x.ravel()}))
    got = genetics.grm(d).toPandas().set_index(["a", "b"])["value"].unstack().to_numpy()
    p = x.mean(0) / 2
    z = (x - 2 * p) / np.sqrt(2 * p * (1 - p))
    assert np.allclose(got[np.triu_indices(n)], (z @ z.T / m)[np.triu_indices(n)])

"""Queries over iterative estimators and feature-wide models; most have no SQL, their tests recover known parameters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from statloom.operators import graphs as gr
from statloom.operators import likelihood as lk
from statloom.operators import omics, predictions, rare
from statloom.operators import regression as rg
from statloom.plans import association
from statloom.plans.domain_queries import _EDGES, _LONG, _PTS, _long, _panel, _points, _trade, _up
from statloom.plans.registry import query, table
from statloom.streaming import scan as st


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), (F.col("l_linenumber") % 4).cast("double").alias("o"), F.col("l_linenumber").cast("double").alias("c"),
        (F.col("l_extendedprice") / 1000).alias("p"), F.col("l_suppkey").alias("g"), (F.col("l_discount") > 0.05).cast("double").alias("b"), (F.col("l_discount") * 8 + 0.1).alias("share"),
    )


@query("ordinal_logit")
def ordinal_logit(spark, sf):
    return lk.ordinal(_lines(spark, sf), "o", ["d", "t"]).frame(spark)


@query("censored_weibull")
def censored_weibull(spark, sf):
    d = _lines(spark, sf).withColumn("s", (F.col("q") > 45).cast("double"))
    return lk.censored(d, "q", "s", [rg.ONE, "d"], "weibull").frame(spark)


@query("beta_regression")
def beta_regression(spark, sf):
    return lk.beta_regression(_lines(spark, sf), "share", [rg.ONE, "t"]).frame(spark)


@query("zero_inflated_poisson")
def zero_inflated_poisson(spark, sf):
    return lk.zero_inflated(_lines(spark, sf), "o", [rg.ONE, "d"]).frame(spark)


@query("negative_binomial")
def negative_binomial(spark, sf):
    return lk.negative_binomial(_lines(spark, sf), "c", [rg.ONE, "d"]).frame(spark)


@query("multinomial_logit")
def multinomial_logit(spark, sf):
    return lk.multinomial(_lines(spark, sf), "o", [rg.ONE, "d"]).frame(spark)


@query("rare_events_logit")
def rare_events_logit(spark, sf):
    return lk.rare_events(_lines(spark, sf), "b", [rg.ONE, "t"], prevalence=0.3).frame(spark)


@query(
    "nonlinear_fit",
    """WITH f AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) AS s, regr_sxx(y, x) AS sxx, count(*) AS n, avg(x) AS m
        FROM (SELECT l_extendedprice::DOUBLE / 1000 AS y, l_quantity::DOUBLE AS x FROM lineitem))
        SELECT 'a' AS term, a AS estimate, sqrt(s * (1.0 / n + m * m / sxx)) AS se FROM f UNION ALL SELECT 'b', b, sqrt(s / sxx) FROM f""",
    floats=("estimate", "se"),
)
def nonlinear_fit(spark, sf):
    fit = lk.nonlinear(_lines(spark, sf), "p", ["q"], lambda th, d: th[0] + th[1] * d["q"] ** 1.0, [0.0, 1.0], ["a", "b"])
    return fit.frame(spark).select("term", "estimate", "se")


@query("quantile_regression")
def quantile_regression(spark, sf):
    return lk.quantile(_lines(spark, sf), "p", [rg.ONE, "q"], 0.75).frame(spark)


@query("mixed_intercept")
def mixed_intercept(spark, sf):
    return lk.mixed_intercept(_lines(spark, sf), "p", [rg.ONE, "q"], "g").frame(spark)


@query("gee_exchangeable")
def gee_exchangeable(spark, sf):
    return lk.gee(_lines(spark, sf), "b", [rg.ONE, "t"], "g", "binomial").frame(spark)


@query("glmm_logit")
def glmm_logit(spark, sf):
    return lk.glmm_intercept(_lines(spark, sf), "b", [rg.ONE, "t"], "g").frame(spark)


@query("gam_curve")
def gam_curve(spark, sf):
    fit = lk.gam(_lines(spark, sf), "p", ["q"])
    at = np.linspace(1, 50, 20)
    return spark.createDataFrame(pd.DataFrame({"x": at, "effect": fit["curve"]("q", at), "edf": fit["edf"]}))


@query("loess_by_flag")
def loess_by_flag(spark, sf):
    d = table(spark, sf, "events").select("event_type", F.col("user_id").cast("double").alias("x"), "value")
    return lk.loess(d, "x", "value", ["event_type"], points=15)


@query("kernel_by_type")
def kernel_by_type(spark, sf):
    d = table(spark, sf, "events").select("event_type", F.col("user_id").cast("double").alias("x"), "value")
    return lk.kernel_regression(d, "x", "value", ["event_type"], 5.0, points=15)


@query("sem_one_factor")
def sem_one_factor(spark, sf):
    e = table(spark, sf, "embeddings")
    r = e.agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(F.col("embedding")[i] + F.col("label") / 10.0, F.col("embedding")[j] + F.col("label") / 10.0).alias(f"c{i}_{j}") for i in range(4) for j in range(4)]).collect()[0]
    cov = np.array([[r[f"c{i}_{j}"] for j in range(4)] for i in range(4)])
    out = lk.sem(cov, int(r["n"]), {(1, 4): 1.0, (2, 4): 1.0, (3, 4): 1.0}, {(k, k): 0.01 for k in range(4)} | {(4, 4): 0.05}, [0, 1, 2, 3], 5, a_fixed={(0, 4): 1.0})
    return spark.createDataFrame([(str(k), float(v), float(out["se"][k])) for k, v in out["estimates"].items()], "entry string, estimate double, se double")


# -- feature-wide ---------------------------------------------------------------------------------------------------------------------------


def _matrix(spark, sf):
    return _long(spark, sf).select(F.col("f").cast("string").alias("feature_id"), F.col("vec_id").alias("sample_id"), F.col("v").alias("value"))


def _design(spark, sf) -> np.ndarray:
    """Intercept and group of every sample, in the order of their ids."""
    ids = np.array([r[0] for r in table(spark, sf, "embeddings").select("vec_id").distinct().orderBy("vec_id").collect()])
    return np.stack([np.ones(len(ids)), ids % 2.0], 1)


@query("pca_samples")
def pca_samples(spark, sf):
    return omics.pca_frame(_matrix(spark, sf), k=3)


@query("surrogate_variables")
def surrogate_variables(spark, sf):
    sv = omics.surrogate_variables(_matrix(spark, sf), _design(spark, sf), k=2)
    return spark.createDataFrame(pd.DataFrame(sv, columns=["sv1", "sv2"]))


@query("batch_adjust")
def batch_adjust(spark, sf):
    ids = [r[0] for r in table(spark, sf, "embeddings").select("vec_id").distinct().orderBy("vec_id").collect()]
    return omics.combat(_matrix(spark, sf), pd.Series(np.array(ids) % 3, index=ids))


@query("moderated_t")
def moderated_t(spark, sf):
    return omics.moderated(_matrix(spark, sf), _design(spark, sf), 1)


def _counts(spark, sf):
    return _matrix(spark, sf).withColumn("value", F.round(F.exp(3 + 4 * F.col("value"))))


@query("count_differential")
def count_differential(spark, sf):
    return omics.nb_differential(_counts(spark, sf), _design(spark, sf), 1)


@query("voom_differential")
def voom_differential(spark, sf):
    return omics.voom(_counts(spark, sf), _design(spark, sf), 1)


@query("multiple_imputation")
def multiple_imputation(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal") * 2 + F.col("c_nationkey")).alias("b"))
    return omics.impute(d, ["a", "b"], m=3)


@query(
    "kinship_pairs",
    """WITH RECURSIVE m AS (SELECT 2 AS k, [[0.5::DOUBLE, 0], [0, 0.5]] AS phi UNION ALL
            SELECT k + 1, list_append(list_transform(range(1, k + 1), lambda j: list_append(phi[j], v[j])), list_append(v, self)) FROM (
                SELECT k, phi, list_transform(range(1, k + 1), lambda j: (phi[s][j] + phi[d][j]) / 2) AS v, 0.5 + phi[s][d] / 2 AS self FROM (SELECT *, CASE WHEN k < 5 THEN 1 ELSE 3 END AS s, CASE WHEN k < 5 THEN 2 ELSE k - 1 END AS d FROM m WHERE k < 8))),
        f AS (SELECT phi FROM m WHERE k = 8)
        SELECT a.p_partkey AS a, b.p_partkey AS b, phi[a.p_partkey % 8 + 1][b.p_partkey % 8 + 1] AS value FROM part a JOIN part b ON a.p_partkey // 8 = b.p_partkey // 8 AND a.p_partkey <= b.p_partkey, f
        WHERE phi[a.p_partkey % 8 + 1][b.p_partkey % 8 + 1] > 0""",
    floats=("value",),
)
def kinship_pairs(spark, sf):
    p = table(spark, sf, "part").withColumn("k", F.col("p_partkey") % 8)  # families of eight: two founders, their children and these children's
    first = F.col("p_partkey") - F.col("k")
    p = p.select(F.col("p_partkey").alias("id"), F.when(F.col("k") >= 2, first + F.when(F.col("k") < 5, 0).otherwise(2)).alias("sire"), F.when(F.col("k") >= 2, first + F.when(F.col("k") < 5, 1).otherwise(F.col("k") - 2)).alias("dam"))
    return omics.kinship(p)


@query(
    "association_scan",
    f"""WITH d AS (SELECT f, v, label, vec_id % 3 AS z FROM ({_LONG}) JOIN embeddings USING (vec_id)), m AS (SELECT f, avg(v) AS mv, avg(z) AS mz, avg(label) AS ml, count(*) AS n FROM d GROUP BY f),
        s AS (SELECT f, any_value(n) AS n, sum((v - mv) * (v - mv)) AS a, sum((v - mv) * (z - mz)) AS b, sum((z - mz) * (z - mz)) AS c, sum((v - mv) * (label - ml)) AS u, sum((z - mz) * (label - ml)) AS w, sum((label - ml) * (label - ml)) AS yy FROM d JOIN m USING (f) GROUP BY f),
        e AS (SELECT *, (c * u - b * w) / (a * c - b * b) AS beta, (a * w - b * u) / (a * c - b * b) AS g FROM s)
        SELECT f AS feature_id, beta, sqrt((yy - beta * u - g * w) / (n - 3) * c / (a * c - b * b)) AS standard_error, 'ok' AS status FROM e""",
    floats=("beta", "standard_error"),
)
def association_scan(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("double").alias("y"), (F.col("vec_id") % 3).cast("double").alias("z"))
    x = _long(spark, sf).select(F.col("f").alias("feature_id"), F.col("vec_id").alias("sample_id"), F.col("v").alias("value"))
    return association.associate(e, x, "y ~ <omics> + z").select("feature_id", "beta", "standard_error", "status")


# -- sets, networks, space ---------------------------------------------------------------------------------------------------------------------


@query("rare_set_tests")
def rare_set_tests(spark, sf):
    d = _panel(spark, sf).withColumn("cohort", F.col("sample_id") % 2)
    m = d.groupBy("variant_id", "cohort").agg(F.avg("dosage").alias("m"), F.sum("dosage").alias("mac"))
    c = d.join(m, ["variant_id", "cohort"]).select("variant_id", "cohort", "sample_id", (F.col("dosage") - F.col("m")).alias("x"))
    u = c.groupBy("variant_id", "cohort").agg(F.sum(F.col("x") * ((F.col("sample_id") % 7) - 3)).alias("u"))
    v = c.join(c.select(F.col("variant_id").alias("col"), "cohort", "sample_id", F.col("x").alias("y")), ["cohort", "sample_id"]).filter("variant_id <= col and variant_id % 4 = col % 4")
    v = v.groupBy("cohort", "variant_id", "col").agg((F.sum(F.col("x") * F.col("y")) * 4.0).alias("v")).select((F.col("variant_id") % 4).alias("set_id"), "cohort", F.col("variant_id").alias("row"), "col", "v")
    s = u.join(m, ["variant_id", "cohort"]).select((F.col("variant_id") % 4).alias("set_id"), "variant_id", "cohort", "u", F.least(F.col("m") / 2, 1 - F.col("m") / 2).alias("maf"), "mac")
    return rare.by_set(s, v)


@query(
    "sliding_windows",
    "SELECT '1:' || CAST(k * 40 AS BIGINT) AS set_id, p_partkey AS variant_id FROM (SELECT p_partkey, unnest(range(CAST(greatest(floor((p_partkey - 100) / 40.0) + 1, 0) AS BIGINT), CAST(floor(p_partkey / 40.0) AS BIGINT) + 1)) AS k FROM part)",
)
def sliding_windows(spark, sf):
    return rare.sliding_windows(table(spark, sf, "part").select(F.col("p_partkey").alias("variant_id"), F.lit("1").alias("chromosome"), F.col("p_partkey").alias("position")), 100, 40)


@query(
    "graph_neighborhoods",
    """WITH e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region),
       d AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT a AS node, b AS near FROM d UNION SELECT x.a, y.b FROM d x JOIN d y ON x.b = y.a WHERE x.a <> y.b""",
)
def graph_neighborhoods(spark, sf):
    return gr.neighborhoods(_up(spark, sf), 2, "child", "parent")


@query("driver_permutation")
def driver_permutation(spark, sf):
    hits = spark.createDataFrame([("c1",), ("c2",), ("s3",)], "node string")
    return gr.driver_permutation(_trade(spark, sf).filter("weight > 1"), hits, permutations=99)


@query("sparse_network")
def sparse_network(spark, sf):
    shared = table(spark, sf, "embeddings").select("vec_id", (F.col("label") / 20.0).alias("l"))
    return gr.sparse_network(_long(spark, sf).join(shared, "vec_id").withColumn("v", F.col("v") + F.col("l")), "vec_id", "f", "v", 0.05, "or")


@query(
    "spatial_edge_fractions",
    f"""WITH e AS ({_EDGES}), c AS (SELECT a.node % 3 AS sample_id, least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, count(*) AS k FROM e JOIN ({_PTS}) a ON e.source = a.node JOIN ({_PTS}) b ON e.target = b.node GROUP BY 1, 2, 3),
        n AS (SELECT sample_id, CAST(sum(k) AS BIGINT) AS n FROM c GROUP BY 1) SELECT n.sample_id, t.a, t.b, coalesce(k, 0) AS k, n, asin(sqrt(coalesce(k, 0) / n::DOUBLE)) AS value
        FROM n CROSS JOIN (SELECT DISTINCT a, b FROM c) t LEFT JOIN c ON c.sample_id = n.sample_id AND c.a = t.a AND c.b = t.b""",
    floats=("value",),
)
def spatial_edge_fractions(spark, sf):
    p = _points(spark, sf).withColumn("sample_id", F.col("node") % 3)
    return gr.edge_fractions(gr.radius_edges(_points(spark, sf), 0.03), p)


@query(
    "spatial_distance_slopes",
    f"SELECT label, count(*) AS n, regr_slope(v, sqrt(x * x + y * y)) AS slope FROM ({_PTS}) GROUP BY 1 HAVING count(*) >= 3",
    floats=("slope",),
)
def spatial_distance_slopes(spark, sf):
    return gr.distance_slopes(_points(spark, sf).withColumn("r", F.hypot("x", "y")), ["label"], "r", "v")


@query(
    "event_windows",
    "SELECT date_trunc('hour', ts) AS start, event_type, count(value) AS n, avg(value) AS mean FROM events GROUP BY 1, 2",
    floats=("mean",),
)
def event_windows(spark, sf):
    return st.windowed_moments(table(spark, sf, "events"), "ts", "value", ["event_type"]).drop("var")


@query("risk_difference")
def risk_difference(spark, sf):
    d = _lines(spark, sf)
    fit = rg.glm(d, "b", [rg.ONE, "t"], "binomial")
    return predictions.as_frame(spark, predictions.contrast(d, fit, "binomial", {"t": 0.08}, {"t": 0.0}))


@query("score_training")
def score_training(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample"), "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    m = predictions.train_score(d, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], alpha=0.5, n_lambda=12)
    return spark.createDataFrame([(k, float(v)) for k, v in m["weights"].items()], "predictor string, weight double")

"""What follows a Cox fit: residuals, robust covariance, the test of proportional hazards, and score scans over many features.

Risk-set sums live in a table of distinct event times; rows meet it by an equality join on their time. Rows with a missing or non-finite time, event
or term are left out, and a missing stratum is a stratum of its own. An empty table is an error where a fit is needed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from statloom.functions import pvalues as pv
from statloom.functions import special as sp
from statloom.operators import ordered as od
from statloom.operators import regression as rg
from statloom.operators import series
from statloom.operators.multiplicity import finite
from statloom.session import materialize


def _linear(terms: list[str], beta) -> Column:
    eta = F.lit(0.0)
    for t, b in zip(terms, beta, strict=True):
        eta = eta + F.col(f"`{t}`").cast("double") * F.lit(float(b))
    return eta


def _event_times(d: DataFrame, terms: list[str], eta: Column, ties: str, start: bool, stratum: bool) -> DataFrame:
    """(_g, t, deaths, and sums over the steps of each event time).

    A step k of m tied deaths sees a share f of the deaths less: f = k / m by Efron, 0 by Breslow. ``h`` sums 1 / den, ``a{i}`` mean_i / den, ``m{i}`` mean_i;
    ``hd`` and ``ad{i}`` are weighted by 1 - f; ``w0 w1 w2`` sum f^0, f^1, f^2 over den^2; ``v{i}`` and ``u{i}`` sum mean_i / den and f mean_i / den
    (the cross terms of a score scan); ``s{i}`` are the sums of Schoenfeld residuals and ``i{i}_{j}`` the information.
    """
    if ties not in ("efron", "breslow"):
        raise ValueError("ties are efron or breslow")
    p = len(terms)
    r = series.risk_sets(d, "_t", "_e", terms, eta, "_from" if start else None, "_g" if stratum else None)
    if not stratum:
        r = r.withColumn("_g", F.lit(None).cast("string"))
    k = F.sequence(F.lit(0), F.col("deaths").cast("int") - 1) if ties == "efron" else F.array_repeat(F.lit(0), F.col("deaths").cast("int"))
    e = r.withColumn("k", F.explode(k)).withColumn("f", F.col("k") / F.col("deaths"))
    less = lambda c: F.col(f"c{c}") - F.col("f") * F.coalesce(F.col(f"d{c}"), F.lit(0.0))
    den = less("r")
    e = e.select("_g", "t", "deaths", "f", den.alias("den"), *[F.col(f"s{i}") for i in range(p)], *[(less(f"x{i}") / den).alias(f"e{i}") for i in range(p)], *[(less(f"x{i}_{j}") / den).alias(f"e{i}_{j}") for i in range(p) for j in range(i, p)])
    f, one = F.col("f"), 1 / F.col("den")
    sums = {"h": one, "hd": (1 - f) * one, "w0": one * one, "w1": f * one * one, "w2": f * f * one * one}
    for i in range(p):
        mean = F.col(f"e{i}")
        sums |= {f"a{i}": mean * one, f"ad{i}": (1 - f) * mean * one, f"m{i}": mean, f"u{i}": f * mean * one}
        sums |= {f"i{i}_{j}": F.col(f"e{i}_{j}") - mean * F.col(f"e{j}") for j in range(i, p)}
    out = e.groupBy("_g", "t").agg(F.first("deaths").alias("deaths"), *[F.first(f"s{i}").alias(f"s{i}") for i in range(p)], *[F.sum(c).alias(n) for n, c in sums.items()])
    return out.select("*", *[(F.col(f"s{i}") - F.col(f"m{i}")).alias(f"r{i}") for i in range(p)])


def _prepared(df: DataFrame, time: str, event: str, terms: list[str], start: str | None, stratum: str | None) -> DataFrame:
    d = rg.complete(df, time, *terms, *([start] if start else [])).filter(F.col(event).isNotNull())
    d = d.withColumn("_t", F.col(time).cast("double")).withColumn("_e", F.col(event).cast("int")).withColumn("_g", F.col(stratum).cast("string") if stratum else F.lit(None).cast("string"))
    return d.withColumn("_from", F.col(start).cast("double")) if start else d


def cox_residuals(df: DataFrame, time: str, event: str, terms: list[str] = (), beta=(), ties: str = "efron", start: str | None = None, stratum: str | None = None) -> DataFrame:
    """``df`` with ``martingale`` and ``deviance`` residuals, and ``score_<term>`` and ``schoenfeld_<term>`` (null without an event) for each term.

    Without terms these are the residuals of the null model. Columns of these names, and ``_t _e _g _from``, must not exist.
    """
    terms, p = list(terms), len(terms)
    d = _prepared(df, time, event, terms, start, stratum)
    eta = _linear(terms, beta)
    at = materialize(_event_times(d, terms, eta, ties, bool(start), bool(stratum)))
    times = d.select("_g", F.col("_t").alias("t"))
    if start:
        times = times.union(d.select("_g", F.col("_from").alias("t")))
    carried = ["h", "hd", *[f"{n}{i}" for i in range(p) for n in ("a", "ad", "m")]]
    same = lambda x, y: (x["_g"].eqNullSafe(y["_g"])) & (x["t"] == y["t"])
    times = times.distinct()
    times = times.join(at, same(times, at), "left").select(times["_g"], times["t"], *[F.coalesce(at[c], F.lit(0.0)).alias(c) for c in carried])
    upto = {"hazard": F.col("h")} | {f"moved{i}": F.col(f"a{i}") for i in range(p)}
    times = materialize(od.running_sums(times, upto, [F.asc("t")], ["_g"] if stratum else []))
    own = times.select(F.col("_g").alias("_g1"), F.col("t").alias("_t1"), *[F.col(c).alias(f"_{c}") for c in [*carried, *upto]])
    d = d.join(own, F.col("_g").eqNullSafe(F.col("_g1")) & (F.col("_t") == F.col("_t1")))
    if start:
        before = times.select(F.col("_g").alias("_g0"), F.col("t").alias("_t0"), *[F.col(c).alias(f"_before_{c}") for c in upto])
        d = d.join(before, F.col("_g").eqNullSafe(F.col("_g0")) & (F.col("_from") == F.col("_t0")))
    dead, r = F.col("_e"), F.exp(eta)
    since = lambda c: F.col(f"_{c}") - F.col(f"_before_{c}") if start else F.col(f"_{c}")
    hazard = since("hazard") - dead * (F.col("_h") - F.col("_hd"))
    out = {"martingale": dead - r * hazard}
    for i, t in enumerate(terms):
        x = F.col(f"`{t}`").cast("double")
        mean = F.col(f"_m{i}")
        out[f"score_{t}"] = dead * x - r * x * hazard + r * (since(f"moved{i}") - dead * (F.col(f"_a{i}") - F.col(f"_ad{i}")))
        out[f"schoenfeld_{t}"] = mean
    d = d.select(*[F.col(f"`{c}`") for c in df.columns], "_g", "_t", "_e", *[c.alias(n) for n, c in out.items()])
    if p:
        deaths = at.select(F.col("_g").alias("_g2"), F.col("t").alias("_t2"), F.col("deaths").cast("double").alias("_n"))
        d = d.join(deaths, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_t") == F.col("_t2")), "left")
    for t in terms:  # the mean over the steps, of which there is one for each tied death
        mean = F.col(f"`schoenfeld_{t}`") / F.col("_n")
        d = d.withColumn(f"score_{t}", F.col(f"`score_{t}`") - F.when(F.col("_e") == 1, mean).otherwise(0.0))
        d = d.withColumn(f"schoenfeld_{t}", F.when(F.col("_e") == 1, F.col(f"`{t}`").cast("double") - mean))
    m, dead = F.col("martingale"), F.col("_e")
    inside = -2 * (m + F.when(dead == 1, F.log(F.greatest(F.lit(1e-300), dead - m))).otherwise(0.0))
    return d.withColumn("deviance", F.signum(m) * F.sqrt(F.greatest(F.lit(0.0), inside))).drop("_g", "_t", "_e", "_g2", "_t2", "_n")


def cox_robust(df: DataFrame, fit: rg.Fit, time: str, event: str, cluster: str | None = None, ties: str = "efron", start: str | None = None, stratum: str | None = None) -> rg.Fit:
    """``fit`` with the sandwich covariance of its score residuals, summed by ``cluster`` where given; a row without a cluster is one of its own."""
    p = len(fit.terms)
    s = cox_residuals(df, time, event, fit.terms, fit.beta, ties, start, stratum).select(*([F.col(f"`{cluster}`").alias("_cluster")] if cluster else []), *[F.col(f"`score_{t}`").alias(f"s{i}") for i, t in enumerate(fit.terms)])
    if cluster:
        known = s.filter("_cluster is not null").groupBy("_cluster").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(p)]).drop("_cluster")
        s = known.unionByName(s.filter("_cluster is null").drop("_cluster"))
    r = s.agg(F.count(F.lit(1)).alias("clusters"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]).collect()[0]
    return rg.Fit(fit.terms, fit.beta, fit.cov @ rg.gram(r, p) @ fit.cov, fit.df, fit.n, fit.extra | {"clusters": int(r["clusters"])})


def proportional_hazards(df: DataFrame, fit: rg.Fit, time: str, event: str, ties: str = "efron", start: str | None = None, stratum: str | None = None) -> pd.DataFrame:
    """Score test of hazard ratios that change with log time: (term, statistic, df, p_value) for each term and ``GLOBAL`` for all of them."""
    terms, p = fit.terms, len(fit.terms)
    d = _prepared(df, time, event, terms, start, stratum)
    at = _event_times(d, terms, _linear(terms, fit.beta), ties, bool(start), bool(stratum))
    at = materialize(at.select(F.log("t").alias("g"), "deaths", *[f"r{i}" for i in range(p)], *[f"i{i}_{j}" for i in range(p) for j in range(i, p)]))
    mean = at.agg(F.sum(F.col("g") * F.col("deaths")) / F.sum("deaths")).collect()[0][0]
    g = F.col("g") - F.lit(mean)
    r = at.agg(*[F.sum(g * F.col(f"r{i}")).alias(f"s{i}") for i in range(p)], *[F.sum(g * g * F.col(f"i{i}_{j}")).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]).collect()[0]
    score, info = np.array([r[f"s{i}"] for i in range(p)]), rg.gram(r, p)
    each = np.where(np.diag(info) > 0, score**2 / np.where(np.diag(info) > 0, np.diag(info), 1.0), np.nan)
    whole = float(score @ np.linalg.solve(info, score))
    rows = [(t, x, 1, float(sp.chi2_sf(x, 1))) for t, x in zip(terms, each)] + [("GLOBAL", whole, p, float(sp.chi2_sf(whole, p)))]
    return pd.DataFrame(rows, columns=["term", "statistic", "df", "p_value"])


def cox_scan(
    features: DataFrame, survival: DataFrame, time: str, event: str, covariates: list[str] = (), ties: str = "efron", stratum: str | None = None, sample: str = "sample_id", feature: str = "feature_id", value: str = "value",
) -> DataFrame:
    """Score test of every feature of a long table (feature, sample, value) against one Cox fit of the covariates: no refit.

    Samples that a feature lacks count as its mean. A feature is first summed by event time (map-side combine); a running sum over its own times gives the risk
    sets, and event times at which it has no sample are covered by running sums of the null model, so that no product of features and times is built.
    Features without information are ``non_estimable``. Sample ids must be unique in ``survival``.
    """
    terms, p = list(covariates), len(covariates)
    d = _prepared(survival, time, event, terms, None, stratum)
    fit = series.cox(d, "_t", "_e", terms, ties, stratum="_g" if stratum else None) if p else None
    if fit is not None and not fit.extra["converged"]:
        raise ValueError("the null model did not converge")
    beta = fit.beta if fit is not None else []
    names = [f"_z{i}" for i in range(p)]
    d = d.select(F.col(sample).alias("_sample"), "_t", "_e", "_g", *[F.col(f"`{t}`").cast("double").alias(n) for t, n in zip(terms, names)])
    eta = _linear(names, beta)
    rows = cox_residuals(d, "_t", "_e", names, beta, ties, stratum="_g" if stratum else None).select("_sample", F.col("martingale").alias("_m"))
    at = materialize(_event_times(d, names, eta, ties, False, bool(stratum)).select("_g", "t", "w0", "w1", "w2", *[f"{c}{i}" for i in range(p) for c in ("a", "u")]))
    sums = ["w0", *[f"a{i}" for i in range(p)]]
    times = d.select("_g", F.col("_t").alias("t")).distinct()
    times = times.join(at, times["_g"].eqNullSafe(at["_g"]) & (times["t"] == at["t"]), "left").select(times["_g"], times["t"], *[F.coalesce(at[c], F.lit(0.0)).alias(c) for c in at.columns[2:]])
    times = od.running_sums(times, {f"_c_{c}": F.col(c) for c in sums}, [F.desc("t")], ["_g"] if stratum else [])
    total = at.groupBy("_g").agg(*[F.sum(c).alias(f"_all_{c}") for c in sums])
    times = times.join(total, times["_g"].eqNullSafe(total["_g"]), "left").select(times["_g"].alias("_gt"), F.col("t").alias("_tt"), *at.columns[2:], *[f"_c_{c}" for c in sums], *[F.coalesce(f"_all_{c}", F.lit(0.0)).alias(f"_all_{c}") for c in sums])
    null = d.withColumn("_r", F.exp(eta)).join(rows, "_sample").join(times, F.col("_g").eqNullSafe(F.col("_gt")) & (F.col("_t") == F.col("_tt")))
    null = materialize(null.drop("_gt", "_tt"))
    x = features.select(F.col(feature).alias("feature_id"), F.col(sample).alias("_sample"), finite(value).alias("x")).filter("x is not null").join(null, "_sample")
    # one shuffle by feature serves the mean, the sums by event time and the running sums
    x = x.withColumn("x", F.col("x") - F.avg("x").over(W.partitionBy("feature_id")))
    expected = F.col("_e") - F.col("_m")
    part = x.groupBy("feature_id", "_g", "_t").agg(
        F.count(F.lit(1)).alias("called"), F.sum(F.col("x") * F.col("_m")).alias("score"), F.sum(expected * F.col("x") * F.col("x")).alias("xx"),
        F.sum(F.col("_r") * F.col("x")).alias("s"), F.sum(F.when(F.col("_e") == 1, F.col("_r") * F.col("x")).otherwise(0.0)).alias("dx"),
        *[F.sum(expected * F.col("x") * F.col(n)).alias(f"xz{i}") for i, n in enumerate(names)], *[F.first(c).alias(c) for c in [*at.columns[2:], *[f"{k}{c}" for c in sums for k in ("_c_", "_all_")]]],
    )
    back = W.partitionBy("feature_id", "_g").orderBy(F.desc("_t"))
    part = part.withColumn("_risk", F.sum("s").over(back.rowsBetween(W.unboundedPreceding, W.currentRow)))
    for c in sums:  # the null model's sum over event times until this feature's next one
        part = part.withColumn(f"_gap_{c}", F.coalesce(F.lead(F.col(f"_c_{c}") - F.col(c)).over(back), F.col(f"_all_{c}")) - F.col(f"_c_{c}"))
    s, dx = F.col("_risk"), F.col("dx")
    less = {"xx": s * s * (F.col("w0") + F.col("_gap_w0")) - 2 * s * dx * F.col("w1") + dx * dx * F.col("w2")}
    less |= {f"xz{i}": s * (F.col(f"a{i}") + F.col(f"_gap_a{i}")) - dx * F.col(f"u{i}") for i in range(p)}
    out = part.groupBy("feature_id").agg(F.sum("called").alias("called"), F.sum("score").alias("score"), F.sum("xx").alias("raw"), *[F.sum(F.col(n) - c).alias(n) for n, c in less.items()])
    var = F.col("xx")
    for i in range(p):
        for j in range(p):
            var = var - F.lit(float(fit.cov[i, j])) * F.col(f"xz{i}") * F.col(f"xz{j}")
    out = out.withColumn("variance", var)
    ok = F.coalesce((F.col("variance") > 1e-12 * F.col("raw")) & (F.col("raw") > 0), F.lit(False))
    out = out.withColumn("beta", F.when(ok, F.col("score") / F.col("variance"))).withColumn("standard_error", F.when(ok, 1 / F.sqrt("variance"))).withColumn("statistic", F.when(ok, F.col("score") / F.sqrt("variance")))
    return out.withColumn("p_value", pv.p_normal(F.col("statistic"))).select("feature_id", "called", "score", "variance", "beta", "standard_error", "statistic", "p_value", F.when(ok, "ok").otherwise("non_estimable").alias("status"))

"""Meta-analysis: fixed and random effects pooling over long tables (feature, cohort, effect, se).

A feature's studies are a handful of rows, so every sum is one aggregate by feature; the estimators of the between-study variance
that have no closed form run as vectorised numpy over batches of features, each feature one row with its arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import pvalues as pv
from statloom.functions import special as sp
from statloom.operators.multiplicity import finite
from statloom.session import materialize


def studies(df: DataFrame, feature: str, cohort: str, effect: str, se: str) -> DataFrame:
    """(feature, cohort, y, v): pairs with a missing effect or SE, or an SE that is not positive, are left out."""
    return df.select(F.col(feature).alias("feature"), F.col(cohort).alias("cohort"), finite(effect).alias("y"), finite(se).alias("_se")).filter("y is not null and _se > 0").select("feature", "cohort", "y", (F.col("_se") * F.col("_se")).alias("v"))


def _total(values, term) -> Column:
    """The sum of ``term`` over a column of study structs."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + term(x))


def pool(df: DataFrame, feature: str, cohort: str, effect: str, se: str, method: str = "fixed", test: str = "normal", min_cohorts: int = 1, cohorts: list | None = None) -> DataFrame:
    """One row for each feature: k, estimate, se, statistic, p_value, tau2, q, i2, h2, direction, status.

    ``method``: fixed, dl, pm or reml. ``test``: normal, t, hk (Hartung-Knapp) or mhk (modified). With one study that study passes through.
    ``direction`` has a sign for every cohort, ``?`` where the feature has no usable effect: the order of ``cohorts``, or by name if it is not given.

    A feature's studies are gathered once; Q is the sum of squared deviations from the mean, so large effects with small SEs keep their digits.
    """
    if cohorts is None:  # as many as studies were pooled, not as rows; the table is then read twice
        df = materialize(df.select(*dict.fromkeys([feature, cohort, effect, se])))
        cohorts = [r[0] for r in df.select(F.col(cohort).alias("c")).filter("c is not null").distinct().orderBy("c").collect()]
    s = studies(df, feature, cohort, effect, se)
    if method in ("fixed", "dl"):
        base = s.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("cohort", "y", "v"))).alias("d")).withColumn("k", F.size("d").cast("long"))
        base = base.withColumn("sw", _total("d", lambda x: 1 / x["v"])).withColumn("mean", _total("d", lambda x: x["y"] / x["v"]) / F.col("sw"))
        base = base.withColumn("q", _total("d", lambda x: (x["y"] - F.col("mean")) * (x["y"] - F.col("mean")) / x["v"]))
        tau2 = F.lit(0.0)
        if method == "dl":
            spread = F.col("sw") - _total("d", lambda x: 1 / (x["v"] * x["v"])) / F.col("sw")
            tau2 = F.when(F.col("k") > 1, F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("k") - 1), spread), F.lit(0.0)))).otherwise(0.0)
        base = base.withColumn("tau2", tau2)
    else:
        base = tau2_iterative(s, method)
    out = base.withColumn("rw", _total("d", lambda x: 1 / (x["v"] + F.col("tau2"))))
    out = out.withColumn("estimate", _total("d", lambda x: x["y"] / (x["v"] + F.col("tau2"))) / F.col("rw"))
    scale = F.lit(1.0)
    if test in ("hk", "mhk"):
        scale = _total("d", lambda x: (x["y"] - F.col("estimate")) * (x["y"] - F.col("estimate")) / (x["v"] + F.col("tau2"))) / (F.col("k") - 1)
        scale = scale if test == "hk" else F.greatest(F.lit(1.0), scale)
    elif test not in ("normal", "t"):
        raise ValueError("test is 'normal', 't', 'hk' or 'mhk'")
    out = out.withColumn("se", F.sqrt(F.when(F.col("k") > 1, scale).otherwise(1.0) / F.col("rw"))).withColumn("statistic", F.try_divide("estimate", "se"))
    p = pv.p_normal(F.col("statistic"))
    if test != "normal":
        p = F.when(F.col("k") > 1, pv.p_t(F.col("statistic"), F.greatest(F.col("k") - 1, F.lit(1)))).otherwise(p)
    many = F.col("k") > 1
    out = out.withColumn("p_value", p).withColumn("q", F.when(many, F.col("q"))).withColumn("i2", F.when(many, F.greatest(F.lit(0.0), F.coalesce(F.try_divide(100 * (F.col("q") - (F.col("k") - 1)), F.col("q")), F.lit(0.0)))))
    out = out.withColumn("h2", F.when(many, F.greatest(F.lit(1.0), F.col("q") / (F.col("k") - 1)))).withColumn("tau2", F.when(many, F.col("tau2")))
    every = F.array(*[F.lit(c) for c in cohorts]).cast(f"array<{dict(s.dtypes)['cohort']}>")
    y = lambda c: F.get(F.filter("d", lambda x: x["cohort"] == c), F.lit(0))["y"]
    signs = F.transform(every, lambda c: F.when(y(c) > 0, "+").when(y(c) < 0, "-").when(y(c) == 0, "0").otherwise("?"))
    out = out.withColumn("direction", F.array_join(signs, "")).withColumn("status", F.when(F.col("k") < min_cohorts, "below_min_cohorts").when(F.col("k") == 1, "single_cohort").otherwise("ok"))
    drop = F.col("status") == "below_min_cohorts"
    values = [F.when(~drop, F.col(c)).alias(c) for c in ("estimate", "se", "statistic", "p_value", "tau2", "q", "i2", "h2")]
    return out.select("feature", "k", *values, "direction", "status")


def tau2_iterative(s: DataFrame, method: str) -> DataFrame:
    """(feature, d, k, q, tau2) with Paule-Mandel or REML, for batches of features at a time; d are the studies by cohort."""
    rows = s.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("cohort", "y", "v"))).alias("d"))
    rows = rows.select("feature", "d", F.transform("d", lambda x: x["y"]).alias("y"), F.transform("d", lambda x: x["v"]).alias("v"))
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            ys, vs = batch.column("y"), batch.column("v")
            k = np.diff(np.asarray(ys.offsets)).astype(np.int64)
            if not len(k):
                continue
            # short rows are padded with infinite variances, which have no weight
            at = (np.repeat(np.arange(len(k)), k), np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
            y, v = np.zeros((len(k), max(1, k.max()))), np.full((len(k), max(1, k.max())), np.inf)
            y[at], v[at] = np.asarray(ys.flatten()), np.asarray(vs.flatten())
            tau2 = paule_mandel(y, v, k) if method == "pm" else reml(y, v, k)
            w = 1 / v
            mean = (w * y).sum(1) / w.sum(1)
            q = (w * (y - mean[:, None]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("feature"), batch.column("d"), pa.array(k), pa.array(q), pa.array(np.where(k > 1, tau2, 0.0))], names=["feature", "d", "k", "q", "tau2"])

    return rows.mapInArrow(run, f"feature {kinds['feature']}, d {kinds['d']}, k long, q double, tau2 double")


def _q(y, v, tau2):
    w = 1 / (v + tau2[:, None])
    mean = (w * y).sum(1) / w.sum(1)
    return (w * (y - mean[:, None]) ** 2).sum(1), w


def paule_mandel(y, v, k, rounds: int = 100):
    """Where Q(tau2) = k - 1, by bisection; 0 if Q(0) is not above that."""
    goal = k - 1
    low, high = np.zeros(len(k)), np.ones(len(k))
    for _ in range(200):
        over = _q(y, v, high)[0] > goal
        if not over.any():
            break
        high = np.where(over, high * 4, high)
    for _ in range(rounds):
        mid = (low + high) / 2
        over = _q(y, v, mid)[0] > goal
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    return np.where(_q(y, v, np.zeros(len(k)))[0] <= goal, 0.0, (low + high) / 2)


def _reml_score(y, v, tau2):
    """Twice the slope of the restricted log-likelihood."""
    w = 1 / (v + tau2[:, None])
    total = w.sum(1)
    mean = (w * y).sum(1) / total
    return (w * w * (y - mean[:, None]) ** 2).sum(1) - total + (w * w).sum(1) / total


def reml(y, v, k, rounds: int = 90):
    """Golden-section minimum of the restricted deviance over a bracket that grows fourfold; 0 where it is no worse."""

    def deviance(tau2):
        q, w = _q(y, v, tau2)
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(np.isfinite(v), np.log(np.where(np.isfinite(v), v, 1) + tau2[:, None]), 0).sum(1)
        return logs + np.log(w.sum(1)) + q

    n = len(k)
    spread = np.where(k > 1, np.maximum(((y - (y.sum(1) / np.maximum(k, 1))[:, None]) ** 2 * np.isfinite(v)).sum(1) / np.maximum(k - 1, 1), 1e-12), 1e-12)
    high = spread
    for _ in range(60):
        grow = deviance(high * 4) < deviance(high)
        if not grow.any():
            break
        high = np.where(grow, high * 4, high)
    high = high * 4
    g = (np.sqrt(5) - 1) / 2
    low = np.zeros(n)
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = deviance(a), deviance(b)
    for _ in range(rounds):
        left = fa < fb
        low, high = np.where(left, low, a), np.where(left, b, high)
        a, b = high - g * (high - low), low + g * (high - low)
        fa, fb = deviance(a), deviance(b)
    best = (low + high) / 2
    # the deviance is flat there, so the last half of the digits comes from where its slope changes sign
    low, high = best * (1 - 1e-4), best * (1 + 1e-4)
    inside = (_reml_score(y, v, low) > 0) & (_reml_score(y, v, high) < 0)
    for _ in range(50):
        mid = (low + high) / 2
        up = _reml_score(y, v, mid) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    best = np.where(inside, (low + high) / 2, best)
    return np.where(deviance(np.zeros(n)) <= deviance(best) + 1e-12, 0.0, best)


def prediction_interval(pooled: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Interval of a new study's effect: estimate -+ normal quantile times sqrt(tau2 + se^2)."""
    half = F.lit(float(sp.normal_ppf(1 - alpha / 2))) * F.sqrt(F.coalesce("tau2", F.lit(0.0)) + F.col("se") * F.col("se"))
    return pooled.withColumn("pi_low", F.col("estimate") - half).withColumn("pi_high", F.col("estimate") + half)


def leave_one_out(df: DataFrame, feature: str, cohort: str, effect: str, se: str) -> DataFrame:
    """Fixed-effect pooling without each cohort in turn: totals minus the one, no refit."""
    s = studies(df, feature, cohort, effect, se)
    t = s.groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("v")).alias("sw"), F.sum(F.col("y") / F.col("v")).alias("swy"))
    out = s.join(t, "feature").filter("k > 1").withColumn("w", 1 / F.col("v"))
    out = out.select("feature", F.col("cohort").alias("left_out"), ((F.col("swy") - F.col("w") * F.col("y")) / (F.col("sw") - F.col("w"))).alias("estimate"), F.sqrt(1 / (F.col("sw") - F.col("w"))).alias("se"))
    return out.withColumn("p_value", pv.p_normal(F.col("estimate") / F.col("se")))


def egger(df: DataFrame, feature: str, effect: str, se: str) -> DataFrame:
    """Precision-effect test: weighted regression of effect on SE, t on k - 2 df."""
    d = df.select(F.col(feature).alias("feature"), finite(effect).alias("y"), finite(se).alias("x")).filter("y is not null and x > 0").withColumn("w", 1 / (F.col("x") * F.col("x")))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    m = d.groupBy("feature").agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy"))
    det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    m = m.withColumn("slope", F.try_divide(F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy"), det)).withColumn("intercept", F.try_divide(F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy"), det))
    rss = F.col("syy") - F.col("intercept") * F.col("sy") - F.col("slope") * F.col("sxy")
    m = m.withColumn("se", F.sqrt(F.greatest(F.lit(0.0), rss) / (F.col("k") - 2) * F.col("s") / det)).withColumn("statistic", F.try_divide("slope", "se")).withColumn("df", F.col("k") - 2)
    return m.filter("k > 2").withColumn("p_value", pv.p_t(F.col("statistic"), F.col("df"))).select("feature", "k", "intercept", "slope", "se", "statistic", "df", "p_value")


def regression(df: DataFrame, feature: str, effect: str, se: str, moderator: str, tau2: float | None = None) -> DataFrame:
    """Mixed-effects meta-regression on one moderator with an intercept; tau2 by the method of moments unless given."""
    d = df.select(F.col(feature).alias("feature"), finite(effect).alias("y"), finite(se).alias("_se"), finite(moderator).alias("x")).filter("y is not null and x is not null and _se > 0").withColumn("v", F.col("_se") * F.col("_se"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y, v, x = (pdf[c].to_numpy(float) for c in "yvx")
        row = {"feature": [pdf["feature"].iloc[0]], "k": [len(y)]}
        if len(y) < 3 or np.ptp(x) == 0:
            return pd.DataFrame(row | dict.fromkeys(("intercept", "slope", "se", "tau2", "statistic", "p_value"), [np.nan]) | {"status": ["rank_deficient" if len(y) >= 3 else "insufficient_cohorts"]})
        z = np.stack([np.ones(len(y)), x], 1)
        w = 1 / v
        inv = np.linalg.inv(z.T @ (w[:, None] * z))
        b = inv @ z.T @ (w * y)
        t2 = tau2
        if t2 is None:
            q = float((w * (y - z @ b) ** 2).sum())
            trace = w.sum() - np.trace(inv @ (z.T @ ((w * w)[:, None] * z)))
            t2 = max(0.0, (q - (len(y) - 2)) / trace)
        w = 1 / (v + t2)
        inv = np.linalg.inv(z.T @ (w[:, None] * z))
        b = inv @ z.T @ (w * y)
        s = float(np.sqrt(inv[1, 1]))
        return pd.DataFrame(row | {"intercept": [b[0]], "slope": [b[1]], "se": [s], "tau2": [t2], "statistic": [b[1] / s], "p_value": [float(2 * sp.normal_sf(abs(b[1] / s)))], "status": ["ok"]})

    kind = dict(d.dtypes)["feature"]
    return d.select("feature", "y", "v", "x").groupBy("feature").applyInPandas(fit, f"feature {kind}, k long, intercept double, slope double, se double, tau2 double, statistic double, p_value double, status string")


def rubin(df: DataFrame, by: list[str], estimate: str, se: str, complete_df: float | None = None) -> DataFrame:
    """Rubin's rules over imputations: within, between, total variance, Barnard-Rubin df, fraction of missing information."""
    m = df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("m"), F.avg(estimate).alias("estimate"), F.avg(F.col(se) * F.col(se)).alias("within"), F.coalesce(F.var_samp(estimate), F.lit(0.0)).alias("between"))
    m = m.withColumn("total", F.col("within") + (1 + 1 / F.col("m")) * F.col("between")).withColumn("se", F.sqrt("total"))
    lam = F.try_divide((1 + 1 / F.col("m")) * F.col("between"), F.col("total"))
    old = F.when(F.col("between") > 0, (F.col("m") - 1) / (lam * lam)).otherwise(F.lit(float("inf")))
    if complete_df is not None:
        obs = (complete_df + 1) / (complete_df + 3) * F.lit(float(complete_df)) * (1 - lam)
        old = F.when(F.col("between") > 0, old * obs / (old + obs)).otherwise(F.lit(float(complete_df)))
    m = m.withColumn("lambda", lam).withColumn("df", old)
    r = F.try_divide((1 + 1 / F.col("m")) * F.col("between"), F.col("within"))
    m = m.withColumn("fmi", F.when(F.col("between") > 0, (r + 2 / (F.col("df") + 3)) / (r + 1)).otherwise(0.0)).withColumn("statistic", F.try_divide("estimate", "se"))
    return m.withColumn("p_value", pv.p_t(F.col("statistic"), F.col("df")))

"""Set tests from scores and covariances: Cauchy combination, burden, variance components, and their meta-analysis."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import pvalues as pv
from statloom.functions import special as sp
from statloom.operators.multiplicity import finite


def acat(df: DataFrame, by: list[str], p: str, weight: Column | None = None) -> DataFrame:
    """Cauchy combination: sum w tan(pi (1/2 - p)) / sum w, with w / (p pi) for tiny p; a family that holds 0 and 1 has no answer."""
    v, w = finite(p), weight if weight is not None else F.lit(1.0)
    t = F.when(v < 1e-8, w / (v * math.pi)).otherwise(w * F.tan(F.lit(math.pi) * (F.lit(0.5) - v)))
    s = df.filter(v.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum(F.when((v > 0) & (v < 1), t)).alias("t"), F.sum(w).alias("w"), F.min(v).alias("low"), F.max(v).alias("high"))
    s = s.withColumn("statistic", F.col("t") / F.col("w"))
    tail = F.when(F.col("statistic") > 1e15, 1 / (F.col("statistic") * math.pi)).otherwise(0.5 - F.atan("statistic") / math.pi)
    out = F.when((F.col("low") == 0) & (F.col("high") == 1), F.lit(None)).when(F.col("low") == 0, 0.0).when(F.col("high") == 1, 1.0).otherwise(tail)
    return s.withColumn("p_value", out).select(*by, "k", "statistic", "p_value")


def beta_density(maf: Column, a: float = 1.0, b: float = 25.0) -> Column:
    """Density of Beta(a, b) at the minor allele frequency; its square root weights kernels, itself weights burdens."""
    norm = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return F.lit(norm) * F.pow(maf, F.lit(a - 1)) * F.pow(1 - maf, F.lit(b - 1))


def score_meta(df: DataFrame, variant: str = "variant_id", cohort: str = "cohort", u: str = "u", v: str = "v", minimum: int = 1) -> DataFrame:
    """Scores and variances summed over informative cohorts (u present, v > 0): z = U / sqrt V, beta = U / V."""
    uu, vv = finite(u), finite(v)
    ok = uu.isNotNull() & (vv > 0)
    sign = F.when(~ok, "?").when(uu > 0, "+").when(uu < 0, "-").otherwise("0")
    s = df.groupBy(variant).agg(F.count_if(ok).alias("cohorts"), F.sum(F.when(ok, uu)).alias("u"), F.sum(F.when(ok, vv)).alias("v"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(cohort, sign.alias("s")))), lambda x: x["s"]), "").alias("direction"))
    s = s.filter(F.col("cohorts") >= minimum).withColumn("statistic", F.col("u") / F.sqrt("v")).withColumn("beta", F.col("u") / F.col("v")).withColumn("se", 1 / F.sqrt("v"))
    return s.withColumn("p_value", pv.p_normal(F.col("statistic")))


def scores(genotypes: DataFrame, null: DataFrame, variant: str = "variant_id", sample: str = "sample_id", dosage: str = "dosage") -> DataFrame:
    """u = g'r by variant for a null model's residuals (sample, r); missing dosages take the variant's mean."""
    j = genotypes.join(null, sample)
    d = finite(dosage)
    s = j.groupBy(variant).agg(F.sum(d * F.col("r")).alias("_u"), F.avg(d).alias("mean"), F.sum(F.when(d.isNull(), F.col("r"))).alias("_mr"))
    return s.select(variant, (F.col("_u") + F.col("mean") * F.coalesce("_mr", F.lit(0.0))).alias("u"), (F.col("mean") / 2).alias("af"))


def set_statistics(u: np.ndarray, cov: np.ndarray, weight: np.ndarray, rho: np.ndarray | None = None) -> dict:
    """Burden, SKAT and SKAT-O of one set from scores, their covariance and weights."""
    out = {"variants": len(u)}
    wu = weight * u
    k = weight[:, None] * cov * weight[None, :]
    total, var = wu.sum(), k.sum()
    out["burden_z"] = total / math.sqrt(var) if var > 0 else 0.0
    out["burden_p"] = float(2 * sp.normal_sf(abs(out["burden_z"]))) if var > 0 else 1.0
    lam = np.linalg.eigvalsh((k + k.T) / 2)
    lam = lam[lam > max(lam.max(), 0) * 1e-10]
    out["skat_q"] = float((wu * wu).sum())
    out["skat_p"] = sp.chi2_mixture_sf(out["skat_q"], lam) if len(lam) else 1.0
    out["skato_p"] = skat_o(wu, k, rho) if len(lam) else 1.0
    return out


def skat_o(wu: np.ndarray, k: np.ndarray, rho: np.ndarray | None = None) -> float:
    """Smallest p over a grid between SKAT and burden, calibrated by conditioning on the burden direction (one-dimensional quadrature)."""
    rho = np.array([0, 0.01, 0.04, 0.09, 0.16, 0.25, 0.5, 0.999]) if rho is None else rho
    m = len(wu)
    if m == 1:
        return sp.chi2_mixture_sf(float(wu[0] ** 2), [k[0, 0]])
    root = np.linalg.cholesky(k + np.eye(m) * 1e-12 * np.trace(k) / m)
    ps, eigen = [], []
    for r in rho:
        kernel = (1 - r) * np.eye(m) + r
        lam = np.linalg.eigvalsh(root.T @ kernel @ root)
        eigen.append(lam[lam > lam.max() * 1e-10])
        ps.append(sp.chi2_mixture_sf(float((1 - r) * (wu @ wu) + r * wu.sum() ** 2), eigen[-1]))
    least = min(ps)
    if least <= 0:
        return 0.0
    # quantiles of every statistic at the least p, then P(all below them)
    cut = []
    for lam in eigen:
        low, high = 0.0, float(lam.sum() + 10 * lam.max())
        while sp.chi2_mixture_sf(high, lam, 800) > least:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if sp.chi2_mixture_sf(mid, lam, 800) > least else (low, mid)
        cut.append((low + high) / 2)
    z = root.sum(0)
    s = float(z @ z)
    unit = z / math.sqrt(s)
    proj = root @ unit
    rest = root @ (np.eye(m) - np.outer(unit, unit))
    lam0 = np.linalg.eigvalsh(rest.T @ rest)
    lam0 = lam0[lam0 > max(lam0.max(), 0) * 1e-8]
    cross = 4 * float(proj @ (rest @ rest.T) @ proj)
    mean0, var0 = lam0.sum(), 2 * (lam0**2).sum()
    tau = (1 - rho) * float(proj @ proj) + rho * s
    x, w = np.polynomial.legendre.leggauss(60)
    u = (x + 1) / 2 * 8.0
    dens = w * 4.0 * 2 * np.exp(-u * u / 2) / math.sqrt(2 * math.pi)
    total = 0.0
    for a, d in zip(u, dens):
        room = np.min((np.array(cut) - tau * a * a) / (1 - rho))
        if room <= 0 or not len(lam0):
            continue
        scaled = (room - mean0) * math.sqrt(var0 / (var0 + cross)) + mean0 if var0 else room
        total += d * (1 - sp.chi2_mixture_sf(scaled, lam0, 400))
    return float(min(1.0, max(least, 1 - total), least * len(rho)))


def set_tests(variants: DataFrame, covariance: DataFrame, by: str = "set_id", variant: str = "variant_id") -> DataFrame:
    """Burden, SKAT and SKAT-O by set: ``variants`` (set, variant, u, weight), ``covariance`` (set, row, col, v) with the diagonal and one triangle."""
    kind = dict(variants.dtypes)[by]
    a = variants.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(variant).alias("i"), "u", "weight"))).alias("s"))
    c = covariance.groupBy(by).agg(F.collect_list(F.struct("row", "col", "v")).alias("c"))
    names = ["variants", "burden_z", "burden_p", "skat_q", "skat_p", "skato_p"]

    def run(batches):
        for pdf in batches:
            rows = []
            for _, g in pdf.iterrows():
                place = {x["i"]: k for k, x in enumerate(g["s"])}
                cov = np.zeros((len(place), len(place)))
                for x in g["c"]:
                    if x["row"] in place and x["col"] in place:
                        cov[place[x["row"]], place[x["col"]]] = cov[place[x["col"]], place[x["row"]]] = x["v"]
                rows.append({by: g[by]} | set_statistics(np.array([x["u"] for x in g["s"]], float), cov, np.array([x["weight"] for x in g["s"]], float)))
            yield pd.DataFrame(rows, columns=[by, *names])

    return a.join(c, by).mapInPandas(run, f"`{by}` {kind}, variants long, burden_z double, burden_p double, skat_q double, skat_p double, skato_p double")

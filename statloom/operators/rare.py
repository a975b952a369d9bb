"""Rare-variant tests over cohorts: per-set kernels from scores and covariances, and signals conditioned on each other.

A set's variants are a bounded block: every function here works on one set in numpy, and ``by_set`` deals sets over the cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import special as sp
from statloom.operators import settests as st
from statloom.session import ship


def beta_weights(maf: np.ndarray, a: float, b: float) -> np.ndarray:
    m = np.clip(maf, 1e-12, 0.5)
    return np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * np.log(m) + (b - 1) * np.log1p(-m))


def cauchy(p: np.ndarray, w: np.ndarray | None = None) -> float:
    """Cauchy combination of p-values in numpy."""
    p = np.asarray(p, float)
    w = np.ones(len(p)) if w is None else np.asarray(w, float)
    live = np.isfinite(p) & (w > 0)
    p, w = p[live], w[live] / w[live].sum()
    if not len(p):
        return math.nan
    if (p <= 0).any():
        return math.nan if (p >= 1).any() else 0.0
    if (p >= 1).any():
        return 1.0
    t = float(np.where(p < 1e-8, w / (p * math.pi), w * np.tan(math.pi * (0.5 - np.maximum(p, 1e-8)))).sum())
    return 1 / (t * math.pi) if t > 1e15 else 0.5 - math.atan(t) / math.pi


def _burden(u, cov, w) -> float:
    v = float(w @ cov @ w)
    return float(2 * sp.normal_sf(abs(w @ u) / math.sqrt(v))) if v > 0 else 1.0


def _skat(u, cov, w) -> float:
    lam = np.linalg.eigvalsh(w[:, None] * cov * w[None, :])
    lam = lam[lam > max(lam.max(), 0) * 1e-10]
    return sp.chi2_mixture_sf(float(((w * u) ** 2).sum()), lam) if len(lam) else 1.0


def acat_v(u, cov, maf, mac, a: float, b: float, threshold: float = 10.0) -> float:
    """Variants over the count threshold one by one, the others as one burden, combined with weights w^2 maf (1 - maf)."""
    w = beta_weights(maf, a, b)
    few = mac <= threshold
    ps, weights = [], []
    v = np.diag(cov)
    for i in np.flatnonzero(~few):
        if v[i] > 0:
            ps.append(float(2 * sp.normal_sf(abs(u[i]) / math.sqrt(v[i]))))
            weights.append(w[i] ** 2 * maf[i] * (1 - maf[i]))
    if few.any():
        m = float(maf[few].mean())
        ps.append(_burden(u[few], cov[np.ix_(few, few)], w[few]))
        weights.append(float(beta_weights(np.array([m]), a, b)[0]) ** 2 * m * (1 - m))
    return cauchy(np.array(ps), np.array(weights)) if ps else 1.0


def acat_o(u, cov, maf, mac, threshold: float = 10.0) -> float:
    """Cauchy combination of kernel, burden and single-variant tests under the weights Beta(1, 25) and Beta(1, 1)."""
    ps = []
    for a, b in ((1, 25), (1, 1)):
        w = beta_weights(maf, a, b)
        ps += [_skat(u, cov, w), _burden(u, cov, w), acat_v(u, cov, maf, mac, a, b, threshold)]
    return cauchy(np.array(ps))


def variable_threshold(u, cov, maf, draws: int = 20_000, seed: int = 1) -> tuple[float, float]:
    """(largest |z|, p) of burdens under every frequency threshold; p from normal draws with the burdens' correlation, or Bonferroni beyond them."""
    cuts = np.unique(maf)
    rows = np.stack([(maf <= c).astype(float) for c in cuts])
    v = np.einsum("ij,jk,ik->i", rows, cov, rows)
    rows, v = rows[v > 0], v[v > 0]
    if not len(v):
        return 0.0, 1.0
    z = rows @ u / np.sqrt(v)
    top = float(np.abs(z).max())
    r = rows @ cov @ rows.T / np.sqrt(np.outer(v, v))
    if len(z) == 1:
        return top, float(2 * sp.normal_sf(top))
    vals, vecs = np.linalg.eigh(r)
    x = np.random.default_rng(seed).normal(size=(draws, len(z))) @ (vecs * np.sqrt(np.clip(vals, 0, None))).T
    over = int((np.abs(x).max(1) >= top).sum())
    bound = min(1.0, len(z) * float(2 * sp.normal_sf(top)))
    return top, min(bound, (over + 1) / (draws + 1)) if over else bound


def heterogeneous(us: list[np.ndarray], covs: list[np.ndarray], w: np.ndarray) -> tuple[float, float]:
    """(SKAT, SKAT-O) p-values that let effects differ between cohorts: statistics and kernels add up cohort by cohort."""
    q = sum(float(((w * u) ** 2).sum()) for u in us)
    lam = np.concatenate([np.linalg.eigvalsh(w[:, None] * c * w[None, :]) for c in covs])
    lam = lam[lam > max(lam.max(), 0) * 1e-10]
    skat = sp.chi2_mixture_sf(q, lam) if len(lam) else 1.0
    size = len(w) * len(us)
    k = np.zeros((size, size))
    for i, c in enumerate(covs):
        k[i * len(w) : (i + 1) * len(w), i * len(w) : (i + 1) * len(w)] = w[:, None] * c * w[None, :]
    return skat, st.skat_o(np.concatenate([w * u for u in us]), k)


def condition(u: np.ndarray, cov: np.ndarray, on: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Scores and covariance given the variants ``on``; a conditioned variant keeps its joint test against the others of ``on``."""
    if not on:
        return u.copy(), cov.copy()
    inv = np.linalg.pinv(cov[np.ix_(on, on)])
    return u - cov[:, on] @ inv @ u[on], cov - cov[:, on] @ inv @ cov[on, :]


def stepwise(z: np.ndarray, r: np.ndarray, groups: list, p_max: float = 5e-8, most: int = 10) -> tuple[list[int], bool]:
    """Signals by forward selection on conditional |z| with backward removal of what has lost its evidence; (indices, settled)."""
    chosen: list[int] = []
    seen: set[frozenset] = set()
    for _ in range(max(100, 10 * len(z))):
        if frozenset(chosen) in seen:
            return chosen, False
        seen.add(frozenset(chosen))
        joint = {}
        for i in chosen:
            uc, cc = condition(z, r, [j for j in chosen if j != i])
            joint[i] = abs(uc[i]) / math.sqrt(cc[i, i]) if cc[i, i] > 1e-10 else 0.0
        weak = [i for i in chosen if 2 * sp.normal_sf(joint[i]) > p_max]
        if weak:
            chosen.remove(min(weak, key=lambda i: joint[i]))
            continue
        uc, cc = condition(z, r, chosen)
        room = {g: most - sum(groups[i] == g for i in chosen) for g in set(groups)}
        own = [(abs(uc[i]) / math.sqrt(cc[i, i]), -i) for i in range(len(z)) if i not in chosen and room[groups[i]] > 0 and cc[i, i] > 1e-10]
        if not own or 2 * sp.normal_sf(max(own)[0]) > p_max:
            return chosen, True
        chosen.append(-max(own)[1])
    return chosen, False


def by_set(variants: DataFrame, covariance: DataFrame, set_col: str = "set_id", variant: str = "variant_id") -> DataFrame:
    """All tests of each set over cohorts: ``variants`` (set, variant, cohort, u, maf, mac), ``covariance`` (set, cohort, row, col, v).

    Homogeneous tests use sums over cohorts, the heterogeneous ones keep them apart; burden_fixed and burden_random pool per-cohort burdens.
    """
    ship(variants.sparkSession)
    kind = dict(variants.dtypes)[set_col]
    a = variants.groupBy(set_col).agg(F.collect_list(F.struct(F.col(variant).cast("string").alias("i"), F.col("cohort").cast("string").alias("c"), "u", "maf", "mac")).alias("s"))
    b = covariance.groupBy(set_col).agg(F.collect_list(F.struct(F.col("cohort").cast("string").alias("c"), F.col("row").cast("string").alias("row"), F.col("col").cast("string").alias("col"), "v")).alias("k"))
    names = ["variants", "cohorts", "burden", "skat", "skat_o", "acat_v", "acat_o", "vt", "het_skat", "het_skat_o", "burden_fixed", "burden_random"]

    def one(s, k):
        ids, cohorts = sorted({x["i"] for x in s}), sorted({x["c"] for x in s})
        at, co = {v: n for n, v in enumerate(ids)}, {v: n for n, v in enumerate(cohorts)}
        us, covs = np.zeros((len(cohorts), len(ids))), np.zeros((len(cohorts), len(ids), len(ids)))
        maf, mac, n = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
        for x in s:
            us[co[x["c"]], at[x["i"]]] = x["u"]
            maf[at[x["i"]]] += x["maf"]
            mac[at[x["i"]]] += x["mac"]
            n[at[x["i"]]] += 1
        maf /= n
        for x in k:
            if x["row"] in at and x["col"] in at and x["c"] in co:
                covs[co[x["c"]], at[x["row"]], at[x["col"]]] = covs[co[x["c"]], at[x["col"]], at[x["row"]]] = x["v"]
        u, cov, w = us.sum(0), covs.sum(0), beta_weights(maf, 1, 25)
        het = heterogeneous(list(us), list(covs), w)
        tops, vs = us @ w, np.einsum("i,cij,j->c", w, covs, w)
        tops, vs = tops[vs > 0], vs[vs > 0]
        eff, var = tops / vs, 1 / vs
        fixed = float(2 * sp.normal_sf(abs(tops.sum()) / math.sqrt(vs.sum()))) if len(vs) else 1.0
        random = fixed
        if len(vs) > 1:
            mean = tops.sum() / vs.sum()
            q = float((vs * (eff - mean) ** 2).sum())
            t2 = max(0.0, (q - (len(vs) - 1)) / (vs.sum() - (vs**2).sum() / vs.sum()))
            ww = 1 / (var + t2)
            random = float(2 * sp.normal_sf(abs((ww * eff).sum()) / math.sqrt(ww.sum())))
        return [len(ids), len(cohorts), _burden(u, cov, w), _skat(u, cov, w), st.skat_o(w * u, w[:, None] * cov * w[None, :]), acat_v(u, cov, maf, mac, 1, 25), acat_o(u, cov, maf, mac), variable_threshold(u, cov, maf)[1], *het, fixed, random]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([[g, *one(s, k)] for g, s, k in zip(pdf[set_col], pdf["s"], pdf["k"])], columns=[set_col, *names])

    schema = f"`{set_col}` {kind}, variants long, cohorts long, " + ", ".join(f"{n} double" for n in names[2:])
    return a.join(b, set_col).mapInPandas(run, schema)


def covariance_window(genotypes: DataFrame, null: DataFrame, window: int, scale: float = 1.0) -> DataFrame:
    """Banded score covariance (row, col, v) of variants within ``window``: mean-imputed, centred on the null model's samples.

    ``genotypes`` (variant_id, chromosome, position, sample_id, dosage); candidates by position bucket, sums over samples by join.
    """
    from statloom.operators.multiplicity import finite

    g = genotypes.join(null.select("sample_id"), "sample_id", "left_semi").withColumn("d", finite("dosage"))
    m = g.groupBy("variant_id", "chromosome", "position").agg(F.avg("d").alias("m"))
    x = g.join(m.select("variant_id", "m"), "variant_id").select("variant_id", "sample_id", (F.coalesce("d", "m") - F.col("m")).alias("x")).filter("x <> 0")
    a = m.select(F.col("variant_id").alias("row"), F.col("chromosome").alias("c"), F.col("position").alias("pa"), F.explode(F.array(F.floor(F.col("position") / window), F.floor(F.col("position") / window) + 1)).alias("k"))
    b = m.select(F.col("variant_id").alias("col"), F.col("chromosome").alias("c"), F.col("position").alias("pb"), F.floor(F.col("position") / window).alias("k"))
    pairs = a.join(b, ["c", "k"]).filter((F.col("pb") - F.col("pa")).between(0, window) & ((F.col("pa") < F.col("pb")) | (F.col("row") <= F.col("col")))).select("row", "col").distinct()
    j = pairs.join(x.select(F.col("variant_id").alias("row"), "sample_id", "x"), "row").join(x.select(F.col("variant_id").alias("col"), "sample_id", F.col("x").alias("y")), ["col", "sample_id"])
    return j.groupBy("row", "col").agg((F.sum(F.col("x") * F.col("y")) * F.lit(float(scale))).alias("v"))


def sliding_windows(variants: DataFrame, width: int, step: int) -> DataFrame:
    """(set_id, variant_id): each variant in every window [k * step, k * step + width) of its chromosome that holds it."""
    first = F.floor((F.col("position") - F.lit(width)) / F.lit(step)) + 1
    k = F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), F.floor(F.col("position") / F.lit(step)))).alias("k")
    return variants.select("variant_id", "chromosome", k).select(F.concat_ws(":", "chromosome", (F.col("k") * step).cast("string")).alias("set_id"), "variant_id")

"""Mendelian randomization: allele harmonization and estimators as moment sums over instruments.

Pairs of exposure and outcome only meet through an equi-join on the variant, never a cross join; estimates are one aggregate by pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from statloom.functions import pvalues as pv
from statloom.functions import special as sp
from statloom.session import materialize

_BASES = ("ACGT", "TGCA")


def complement(allele: Column) -> Column:
    return F.translate(F.upper(allele), *_BASES)


def harmonize(exposure: DataFrame, outcome: DataFrame, palindromic: str = "drop", eaf_tolerance: float = 0.08) -> DataFrame:
    """Outcome effects aligned to the exposure's effect allele, every exposure row kept with a ``status``.

    Both tables have variant, effect_allele, other_allele, beta, se and optionally eaf; the exposure may have more columns. Reasons, in this order:
    duplicate_exposure, duplicate_outcome, missing_outcome, zero_exposure_effect, allele_mismatch, palindromic; aligned rows
    are same, swapped, complement or complement_swapped. With ``palindromic='frequency'`` such variants stay if their
    frequency fits exactly one orientation.
    """
    extra = [c for c in exposure.columns if c not in ("variant", "effect_allele", "other_allele", "beta", "se", "eaf")]
    has = lambda df: F.col("eaf").cast("double") if "eaf" in df.columns else F.lit(None).cast("double")
    keys = [c for c in ("exposure",) if c in extra]
    x = exposure.select(*extra, "variant", F.upper("effect_allele").alias("xa"), F.upper("other_allele").alias("xo"), F.col("beta").alias("beta_x"), F.col("se").alias("se_x"), has(exposure).alias("eaf_x"))
    x = x.withColumn("_nx", F.count(F.lit(1)).over(W.partitionBy(*keys, "variant")))
    okeys = [c for c in ("outcome",) if c in outcome.columns]
    y = outcome.select(*okeys, "variant", F.upper("effect_allele").alias("ya"), F.upper("other_allele").alias("yo"), F.col("beta").alias("beta_y0"), F.col("se").alias("se_y"), has(outcome).alias("eaf_y"))
    own = W.partitionBy(*okeys, "variant")
    y = y.withColumn("_ny", F.count(F.lit(1)).over(own)).withColumn("_k", F.row_number().over(own.orderBy("beta_y0"))).filter("_k = 1").drop("_k")
    j = x.join(y, "variant", "left")
    xa, xo, ya, yo = (F.col(c) for c in ("xa", "xo", "ya", "yo"))
    same, swapped = (xa == ya) & (xo == yo), (xa == yo) & (xo == ya)
    csame, cswapped = (xa == complement(ya)) & (xo == complement(yo)), (xa == complement(yo)) & (xo == complement(ya))
    pal = complement(xa) == xo
    near = lambda f: F.coalesce(F.abs(F.col("eaf_x") - f) <= eaf_tolerance, F.lit(False))
    as_is = near(F.when(same, F.col("eaf_y")).otherwise(1 - F.col("eaf_y")))
    other = near(F.when(same, 1 - F.col("eaf_y")).otherwise(F.col("eaf_y")))
    fits = F.when(as_is & ~other, F.when(same, "same").otherwise("swapped")).when(other & ~as_is, F.when(same, "complement_swapped").otherwise("complement")).otherwise("palindromic")
    pal_status = F.lit("palindromic") if palindromic == "drop" else fits
    status = (
        F.when(F.col("_nx") > 1, "duplicate_exposure").when(F.col("_ny") > 1, "duplicate_outcome").when(F.col("beta_y0").isNull(), "missing_outcome").when(F.col("beta_x") == 0, "zero_exposure_effect")
        .when(~(same | swapped | csame | cswapped), "allele_mismatch").when(pal, pal_status).when(same, "same").when(swapped, "swapped").when(csame, "complement").otherwise("complement_swapped")
    )
    j = j.withColumn("status", status)
    sign = F.when(F.col("status").isin("same", "complement"), 1.0).when(F.col("status").isin("swapped", "complement_swapped"), -1.0)
    return j.withColumn("beta_y", sign * F.col("beta_y0")).select(*extra, *okeys, "variant", "beta_x", "se_x", "beta_y", "se_y", "status")


def instruments(harmonized: DataFrame) -> DataFrame:
    return harmonized.filter("beta_y is not null and se_y > 0")


def ivw(df: DataFrame, by: list[str], random: bool = False, minimum: int = 2) -> DataFrame:
    """Inverse-variance weighted ratio: b = sum wxy / sum wx^2 with w = 1 / se_y^2; random multiplies the variance by max(1, Q / (n - 1))."""
    w, x, y = 1 / (F.col("se_y") * F.col("se_y")), F.col("beta_x"), F.col("beta_y")
    s = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy"), F.avg(x * x / (F.col("se_x") * F.col("se_x"))).alias("mean_f")).filter(F.col("n") >= minimum)
    s = s.withColumn("estimate", F.try_divide("sxy", "sxx")).withColumn("q", F.greatest(F.lit(0.0), F.col("syy") - F.col("estimate") * F.col("sxy"))).withColumn("q_df", (F.col("n") - 1).cast("double"))
    scale = F.greatest(F.lit(1.0), F.col("q") / F.col("q_df")) if random else F.lit(1.0)
    s = s.withColumn("se", F.sqrt(scale / F.col("sxx"))).withColumn("statistic", F.col("estimate") / F.col("se"))
    return s.withColumn("p_value", pv.p_normal(F.col("statistic"))).withColumn("q_p", pv.p_chi2(F.col("q"), F.col("q_df"))).drop("sxx", "sxy", "syy")


def egger(df: DataFrame, by: list[str]) -> DataFrame:
    """Weighted regression with an intercept after turning every exposure effect positive; dispersion at least 1; I2_GX."""
    turn = F.signum("beta_x")
    d = df.withColumn("x", F.abs("beta_x")).withColumn("y", turn * F.col("beta_y")).withColumn("w", 1 / (F.col("se_y") * F.col("se_y")))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    g = x / F.col("se_y")
    gv = F.pow(F.col("se_x") / F.col("se_y"), F.lit(2))
    s = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy"),
        F.sum(1 / gv).alias("gw"), F.sum(g / gv).alias("gwx"), F.sum(g * g / gv).alias("gwxx"),
    ).filter("n >= 3")
    det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    s = s.withColumn("estimate", F.try_divide(F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy"), det)).withColumn("intercept", F.try_divide(F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy"), det))
    s = s.withColumn("q", F.greatest(F.lit(0.0), F.col("syy") - F.col("intercept") * F.col("sy") - F.col("estimate") * F.col("sxy")))
    scale = F.greatest(F.lit(1.0), F.col("q") / (F.col("n") - 2))
    s = s.withColumn("se", F.sqrt(scale * F.col("s") / det)).withColumn("intercept_se", F.sqrt(scale * F.col("sxx") / det))
    qg = F.col("gwxx") - F.col("gwx") * F.col("gwx") / F.col("gw")
    s = s.withColumn("i2_gx", F.greatest(F.lit(0.0), (qg - (F.col("n") - 1)) / qg)).withColumn("statistic", F.try_divide("estimate", "se"))
    s = s.withColumn("p_value", pv.p_t(F.col("statistic"), F.col("n") - 2)).withColumn("intercept_p", pv.p_t(F.try_divide("intercept", "intercept_se"), F.col("n") - 2))
    return s.select(*by, "n", "estimate", "se", "statistic", "p_value", "intercept", "intercept_se", "intercept_p", "q", "i2_gx")


def weighted_median(df: DataFrame, by: list[str]) -> DataFrame:
    """Median of the ratios with weights (x / se_y)^2, interpolated at half the weight between half-weight positions."""
    d = df.withColumn("ratio", F.col("beta_y") / F.col("beta_x")).withColumn("w", F.pow(F.col("beta_x") / F.col("se_y"), F.lit(2)))
    w = W.partitionBy(*by).orderBy("ratio", "variant")
    d = d.withColumn("total", F.sum("w").over(W.partitionBy(*by))).withColumn("at", (F.sum("w").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("w") / 2) / F.col("total"))
    d = d.withColumn("next_at", F.lead("at").over(w)).withColumn("next_ratio", F.lead("ratio").over(w)).withColumn("first", F.row_number().over(w) == 1)
    inside = (F.col("at") <= 0.5) & ((F.col("next_at") > 0.5) | F.col("next_at").isNull())
    value = F.when(F.col("next_at").isNull(), F.col("ratio")).otherwise(F.col("ratio") + (F.col("next_ratio") - F.col("ratio")) * (0.5 - F.col("at")) / (F.col("next_at") - F.col("at")))
    hit = F.when(inside, value).when(F.col("first") & (F.col("at") > 0.5), F.col("ratio"))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(hit).alias("estimate")).filter("n >= 3")


def leave_one_out(df: DataFrame, by: list[str]) -> DataFrame:
    """IVW without each instrument: the pair's sums minus the one."""
    w = 1 / (F.col("se_y") * F.col("se_y"))
    d = df.withColumn("xx", w * F.col("beta_x") * F.col("beta_x")).withColumn("xy", w * F.col("beta_x") * F.col("beta_y"))
    s = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("xx").alias("sxx"), F.sum("xy").alias("sxy")).filter("n >= 3")
    out = d.join(s, by) if by else d.crossJoin(F.broadcast(s))
    out = out.select(*by, F.col("variant").alias("left_out"), ((F.col("sxy") - F.col("xy")) / (F.col("sxx") - F.col("xx"))).alias("estimate"), F.sqrt(1 / (F.col("sxx") - F.col("xx"))).alias("se"))
    return out.withColumn("p_value", pv.p_normal(F.col("estimate") / F.col("se")))


def steiger(df: DataFrame, n_x: int, n_y: int) -> DataFrame:
    """Adds r2_x, r2_y (t^2 / (t^2 + n - 2)) and ``retained``: the instrument explains more of the exposure."""
    r2 = lambda b, s, n: F.pow(F.col(b) / F.col(s), F.lit(2)) / (F.pow(F.col(b) / F.col(s), F.lit(2)) + n - 2)
    d = df.withColumn("r2_x", r2("beta_x", "se_x", n_x)).withColumn("r2_y", r2("beta_y", "se_y", n_y))
    return d.withColumn("retained", F.col("r2_x") > F.col("r2_y"))


def presso(df: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Residuals about the median ratio: global chi-square, Bonferroni outliers, and how far the estimate moves without them."""
    d = df.withColumn("ratio", F.col("beta_y") / F.col("beta_x"))
    med = d.groupBy(*by).agg(F.percentile("ratio", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    d = d.join(med, by) if by else d.crossJoin(F.broadcast(med))
    d = d.withColumn("z", (F.col("beta_y") - F.col("median") * F.col("beta_x")) / F.sqrt(F.col("se_y") ** 2 + F.col("median") ** 2 * F.col("se_x") ** 2))
    d = d.withColumn("outlier", pv.p_normal(F.col("z")) * F.col("n") < alpha)
    w, x, y = 1 / (F.col("se_y") * F.col("se_y")), F.col("beta_x"), F.col("beta_y")
    keep = lambda c: F.sum(F.when(~F.col("outlier"), c))
    s = d.groupBy(*by).agg(F.first("n").alias("n"), F.sum(F.col("z") * F.col("z")).alias("statistic"), F.count_if("outlier").alias("outliers"), (F.sum(w * x * y) / F.sum(w * x * x)).alias("estimate"), F.try_divide(keep(w * x * y), keep(w * x * x)).alias("corrected"))
    s = s.withColumn("p_value", pv.p_chi2(F.col("statistic"), F.col("n") - 1))
    return s.withColumn("distortion_percent", 100 * F.try_divide(F.col("estimate") - F.col("corrected"), F.abs("corrected")))


def contamination_mixture(df: DataFrame, by: list[str], points: int = 401, extra: float = 0.01) -> DataFrame:
    """Profile likelihood over a grid of causal effects and shares of valid instruments; SE from the curvature at the top."""
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in by] + ["n long, estimate double, se double, valid_share double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, sx, sy = (pdf[c].to_numpy(float) for c in ("beta_x", "beta_y", "se_x", "se_y"))
        ratio = y / x
        span = max(np.ptp(ratio), 1e-6)
        grid = np.linspace(ratio.min() - span, ratio.max() + span, points)
        share = np.arange(0.05, 0.951, 0.05)
        var = (sy / x) ** 2
        ll = np.zeros((points, len(share)))
        step = max(1, 1_000_000 // ll.size)
        for at in range(0, len(x), step):  # some instruments at a time: the table of all of them does not fit
            r, v = ratio[at : at + step], var[at : at + step]
            density = lambda v: np.exp(-((r - grid[:, None]) ** 2) / (2 * v)) / np.sqrt(2 * np.pi * v)  # noqa: B023, E731
            good, bad = density(v), density(v + extra)
            for k, c in enumerate(share):
                ll[:, k] += np.log(c * good + (1 - c) * bad + 1e-300).sum(1)
        i, j = np.unravel_index(ll.argmax(), ll.shape)
        h = grid[1] - grid[0]
        curve = (ll[i - 1, j] - 2 * ll[i, j] + ll[i + 1, j]) / h**2 if 0 < i < points - 1 else np.nan
        se = float(1 / np.sqrt(-curve)) if curve < 0 else np.nan
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "n": [len(x)], "estimate": [grid[i]], "se": [se], "valid_share": [share[j]]})

    return df.groupBy(*by).applyInPandas(run, schema)


def multivariable(df: DataFrame, exposures: list[str], by: list[str] = (), intercept: bool = False) -> DataFrame:
    """Weighted regression of beta_y on several exposure effects (columns ``exposures``): moment sums by pair, small solves in numpy."""
    by = list(by)
    cols = (["_one"] if intercept else []) + exposures
    d = df.withColumn("_one", F.lit(1.0)).withColumn("_w", 1 / (F.col("se_y") * F.col("se_y")))
    sums = [F.sum(F.col("_w") * F.col(a) * F.col(b)).alias(f"x_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    sums += [F.sum(F.col("_w") * F.col(a) * F.col("beta_y")).alias(f"y_{i}") for i, a in enumerate(cols)]
    m = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_w") * F.col("beta_y") * F.col("beta_y")).alias("yy"), *sums)
    p = len(cols)
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in by] + ["n long, exposure string, estimate double, se double, q double"])

    def run(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                a = np.array([[r[f"x_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
                v = np.array([r[f"y_{i}"] for i in range(p)], float)
                if r["n"] <= p or np.linalg.matrix_rank(a) < p:
                    continue
                inv = np.linalg.inv(a)
                b = inv @ v
                q = max(0.0, float(r["yy"] - b @ v))
                scale = max(1.0, q / (r["n"] - p))
                out += [{**{c: r[c] for c in by}, "n": r["n"], "exposure": "(intercept)" if c == "_one" else c, "estimate": b[i], "se": float(np.sqrt(scale * inv[i, i])), "q": q} for i, c in enumerate(cols)]
            yield pd.DataFrame(out, columns=[*by, "n", "exposure", "estimate", "se", "q"])

    return m.mapInPandas(run, schema).withColumn("p_value", pv.p_normal(F.col("estimate") / F.col("se")))


def generalized_ivw(df: DataFrame, ld: DataFrame, by: list[str], random: bool = False) -> DataFrame:
    """IVW with correlated instruments: weights from the inverse of diag(se) R diag(se). ``ld`` has variant, other, r (both halves and the diagonal)."""
    both = df.join(ld, "variant").groupBy(*by, "variant").agg(F.first("beta_x").alias("beta_x"), F.first("beta_y").alias("beta_y"), F.first("se_y").alias("se_y"), F.collect_list(F.struct("other", "r")).alias("row"))
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in by] + ["n long, estimate double, se double, q double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("variant").reset_index(drop=True)
        place = {v: i for i, v in enumerate(pdf["variant"])}
        r = np.eye(len(pdf))
        for i, row in enumerate(pdf["row"]):
            for x in row:
                if x["other"] in place:
                    r[i, place[x["other"]]] = x["r"]
        x, y, s = (pdf[c].to_numpy(float) for c in ("beta_x", "beta_y", "se_y"))
        chol = np.linalg.cholesky(s[:, None] * r * s[None, :])
        u, v = np.linalg.solve(chol, x), np.linalg.solve(chol, y)
        b = (u @ v) / (u @ u)
        q = float(((v - b * u) ** 2).sum())
        scale = max(1.0, q / (len(x) - 1)) if random and len(x) > 1 else 1.0
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "n": [len(x)], "estimate": [b], "se": [float(np.sqrt(scale / (u @ u)))], "q": [q]})

    return both.groupBy(*by).applyInPandas(run, schema).withColumn("p_value", pv.p_normal(F.col("estimate") / F.col("se")))


def overlap_aware(df: DataFrame, by: list[str], covariance: str, rounds: int = 100) -> DataFrame:
    """Ratio estimate for samples that overlap: weights 1 / (se_y^2 + b^2 se_x^2 - 2 b c) with the effects' sampling covariance c, iterated in b.

    ``covariance`` is a column; beyond se_x se_y it is an error. Instruments of one pair are a bounded group.
    """
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in by] + ["n long, estimate double, se double, rounds int, converged boolean"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, sx, sy, c = (pdf[k].to_numpy(float) for k in ("beta_x", "beta_y", "se_x", "se_y", covariance))
        if (np.abs(c) > sx * sy).any():
            raise ValueError("a sampling covariance is larger than the errors allow")
        spread = lambda b: sy**2 + (b * sx) ** 2 - 2 * b * c
        w, settled, k = 1 / sy**2, False, 0
        b = (w * x * y).sum() / (w * x * x).sum()
        while k < rounds and not settled:
            k += 1
            w = 1 / spread(b)
            new = (w * x * y).sum() / (w * x * x).sum()
            settled, b = abs(new - b) <= 1e-10 * (1 + abs(b)), new
        return pd.DataFrame({**{v: [pdf[v].iloc[0]] for v in by}, "n": [len(x)], "estimate": [b], "se": [float(1 / np.sqrt((x * x / spread(b)).sum()))], "rounds": [k], "converged": [settled]})

    out = df.filter(F.col(covariance).isNotNull()).groupBy(*by).applyInPandas(run, schema).filter("n >= 2")
    return out.withColumn("p_value", pv.p_normal(F.col("estimate") / F.col("se")))


def joint_outcomes(df: DataFrame, by: list[str], correlation: pd.DataFrame, outcome: str = "outcome") -> DataFrame:
    """One exposure's ratio estimates on several outcomes tested together: chi-square of the estimates with their covariance.

    ``correlation`` is the outcomes' sampling correlation, labelled on both sides; outcomes share their instruments by ``variant``.
    """
    labels = list(correlation.index)
    r = correlation.loc[labels, labels].to_numpy(float)
    sums = df.filter(F.col(outcome).isin(labels)).groupBy(*by, "variant").agg(F.first("beta_x").alias("x"), *[F.max(F.when(F.col(outcome) == F.lit(o), F.col("beta_y"))).alias(f"y{i}") for i, o in enumerate(labels)], *[F.max(F.when(F.col(outcome) == F.lit(o), F.col("se_y"))).alias(f"s{i}") for i, o in enumerate(labels)]).dropna()
    k = len(labels)
    x = F.col("x")
    agg = sums.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x * F.col(f"y{i}") / (F.col(f"s{i}") * F.col(f"s{i}"))).alias(f"u{i}") for i in range(k)], *[F.sum(x * x / (F.col(f"s{i}") * F.col(f"s{j}"))).alias(f"m{i}_{j}") for i in range(k) for j in range(k)])
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in by] + ["n long, estimates array<double>, statistic double, df double"])

    def run(batches):
        for pdf in batches:
            rows = []
            for _, g in pdf.iterrows():
                m = np.array([[g[f"m{i}_{j}"] for j in range(k)] for i in range(k)], float)
                b = np.array([g[f"u{i}"] for i in range(k)], float) / np.diag(m)
                v = m * r / np.outer(np.diag(m), np.diag(m))
                rows.append({**{c: g[c] for c in by}, "n": g["n"], "estimates": b.tolist(), "statistic": float(b @ np.linalg.solve(v, b)), "df": float(k)})
            yield pd.DataFrame(rows, columns=[*by, "n", "estimates", "statistic", "df"])

    return agg.mapInPandas(run, schema).withColumn("p_value", pv.p_chi2(F.col("statistic"), F.col("df")))


def grid(exposures: DataFrame, outcomes: DataFrame, minimum: int = 3, threshold: float = 0.05, palindromic: str = "drop") -> tuple[DataFrame, DataFrame]:
    """All exposure-outcome pairs that share variants: an IVW screen of each, and full diagnostics of those under the threshold."""
    h = materialize(instruments(harmonize(exposures, outcomes, palindromic)))
    pair = ["exposure", "outcome"]
    screen = ivw(h, pair, minimum=minimum)
    screen = materialize(screen)
    hits = h.join(screen.filter(F.col("p_value") < threshold).select(*pair), pair)
    full = ivw(hits, pair, random=True, minimum=minimum).select(*pair, "n", F.col("estimate").alias("ivw"), F.col("se").alias("ivw_se"), "q", "mean_f")
    full = full.join(egger(hits, pair).select(*pair, F.col("estimate").alias("egger"), F.col("intercept"), "i2_gx"), pair, "left").join(weighted_median(hits, pair).select(*pair, F.col("estimate").alias("median")), pair, "left")
    return screen, full


def p_from_normal(z: float) -> float:
    return float(2 * sp.normal_sf(abs(z)))

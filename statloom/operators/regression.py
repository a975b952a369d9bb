"""Regression by distributed sufficient statistics.

One aggregate gives X'WX, X'Wz and what else a step needs; the p x p algebra is numpy on the driver, whose size depends on the number of terms
alone. Iterative fits make one pass over the data a step. Terms are columns; build them with ``statloom.plans.formula``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import pvalues as pv
from statloom.functions import special as sp
from statloom.operators.multiplicity import finite

ONE = "(Intercept)"


@dataclass
class Fit:
    """Coefficients with covariance and reference distribution (``df`` is infinite for the normal)."""

    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    df: float
    n: int
    extra: dict = field(default_factory=dict)

    def table(self) -> pd.DataFrame:
        se = np.sqrt(np.clip(np.diag(self.cov), 0, None))
        with np.errstate(all="ignore"):
            t = self.beta / se
        return pd.DataFrame({"term": self.terms, "estimate": self.beta, "se": se, "statistic": t, "p_value": np.exp(sp.t_logsf2(t, self.df))})

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.table())


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all columns are finite numbers; an empty result is an error."""
    columns = list(dict.fromkeys(c for c in columns if c != ONE))
    return df.select("*", *[finite(F.col(f"`{c}`")).alias(f"_f{i}") for i, c in enumerate(columns)]).dropna(subset=[f"_f{i}" for i in range(len(columns))]).drop(*[f"_f{i}" for i in range(len(columns))])


def _col(term: str) -> Column:
    return F.lit(1.0) if term == ONE else F.col(f"`{term}`").cast("double")


def moments(df: DataFrame, terms: list[str], targets: dict[str, Column], weight: Column | None = None, by: list[str] = ()):
    """Aggregate columns of X'WX (upper triangle, a{i}_{j}), X'Wt for every target (t{name}_{i}), and n."""
    w = weight if weight is not None else F.lit(1.0)
    x = [_col(t) for t in terms]
    aggs = [F.sum(w * x[i] * x[j]).alias(f"a{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    for name, t in targets.items():
        aggs += [F.sum(w * xi * t).alias(f"t{name}_{i}") for i, xi in enumerate(x)]
        aggs.append(F.sum(w * t * t).alias(f"s{name}"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), *aggs)


def gram(row, p: int) -> np.ndarray:
    a = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            a[i, j] = a[j, i] = row[f"a{i}_{j}"]
    return a


def solve(a: np.ndarray, v: np.ndarray):
    """(inverse, solution, rank) after scaling to unit diagonal; aliased terms get zero and an infinite variance."""
    d = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    s = a / d[:, None] / d[None, :]
    keep: list[int] = []
    for j in range(len(d)):
        own = [*keep, j]
        if np.diag(a)[j] > 0 and np.linalg.eigvalsh(s[np.ix_(own, own)])[0] > 1e-10:
            keep.append(j)
    inv = np.full(a.shape, np.nan)
    beta = np.zeros(len(d))
    part = np.linalg.inv(s[np.ix_(keep, keep)]) / d[keep][:, None] / d[keep][None, :]
    inv[np.ix_(keep, keep)] = part
    beta[keep] = part @ v[keep]
    return inv, beta, len(keep)


def _centres(df: DataFrame, terms: list[str], y: str, weight: Column | None) -> dict:
    w = weight if weight is not None else F.lit(1.0)
    cols = {t: (F.sum(w * _col(t)) / F.sum(w)).alias(f"m{i}") for i, t in enumerate([*terms, y]) if t != ONE}
    r = df.agg(*cols.values()).collect()[0]
    return {t: r[f"m{i}"] for i, t in enumerate([*terms, y]) if t != ONE}


def ols(df: DataFrame, y: str, terms: list[str], weight: str | None = None, offset: str | None = None) -> Fit:
    """Least squares in two passes: means first, so that the cross products of centred columns keep their digits."""
    d = complete(df, y, *terms, *([weight] if weight else []))
    w = F.col(weight) if weight else None
    centred = ONE in terms
    if offset:
        d = d.withColumn("_y", F.col(y) - F.col(offset))
        y = "_y"
    mean = _centres(d, terms, y, w) if centred else {}
    moved = d
    for i, t in enumerate([t for t in terms if t != ONE]):
        moved = moved.withColumn(f"_c{i}", _col(t) - F.lit(mean.get(t, 0.0)))
    names = [f"_c{i}" for i in range(len([t for t in terms if t != ONE]))]
    inner = ([ONE] if centred else []) + names
    r = moments(moved, inner, {"y": F.col(y).cast("double") - F.lit(mean.get(y, 0.0))}, w).collect()[0]
    p = len(inner)
    inv, beta, rank = solve(gram(r, p), np.array([r[f"ty_{i}"] for i in range(p)]))
    rss = max(0.0, r["sy"] - float(beta @ np.array([r[f"ty_{i}"] for i in range(p)])))
    tss = r["sy"]
    n, dof = int(r["n"]), int(r["n"]) - rank
    sigma2 = rss / dof if dof > 0 else float("nan")
    order = ([terms.index(ONE)] if centred else []) + [i for i, t in enumerate(terms) if t != ONE]
    out, cov = np.zeros(p), np.zeros((p, p))
    if centred:  # back to the uncentred intercept
        m = np.array([mean[t] for t in terms if t != ONE])
        back = np.eye(p)
        back[0, 1:] = -m
        live = np.nan_to_num(inv)
        beta = back @ beta
        beta[0] += mean[y]
        full = back @ live @ back.T
        full[np.ix_(np.isnan(np.diag(inv)), np.isnan(np.diag(inv)))] = np.nan
        inv = full
    for a, i in enumerate(order):
        out[i] = beta[a]
        for b, j in enumerate(order):
            cov[i, j] = inv[a, b] * sigma2
    return Fit(terms, out, cov, max(dof, 1), n, {"rss": rss, "sigma2": sigma2, "r2": 1 - rss / tss if tss else float("nan"), "rank": rank})


def ols_by(df: DataFrame, y: str, x: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Simple regression of y on x in each group, in closed form: slope, se, t, p and the status of groups that cannot be fitted."""
    d = df.select(*by, finite(y).alias("y"), finite(x).alias("x"), *( [F.col(weight).cast("double").alias("w")] if weight else [F.lit(1.0).alias("w")])).filter("y is not null and x is not null and w > 0")
    mean = d.groupBy(*by).agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mx"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my"))
    # deviations from the group's first row keep the sums small without a second pass
    base = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    if weight:
        j = d.join(mean, by) if by else d.crossJoin(F.broadcast(mean))
        dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
        base = j.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * dx * dx).alias("sxx"), F.sum(F.col("w") * dy * dy).alias("syy"), F.sum(F.col("w") * dx * dy).alias("sxy"))
    out = base.withColumn("estimate", F.when(F.col("sxx") > 0, F.try_divide("sxy", "sxx"))).withColumn("rss", F.greatest(F.lit(0.0), F.col("syy") - F.col("estimate") * F.col("sxy")))
    out = out.withColumn("df", (F.col("n") - 2).cast("double")).withColumn("se", F.when(F.col("n") > 2, F.sqrt(F.try_divide(F.try_divide(F.col("rss"), F.col("df")), F.col("sxx")))))
    out = out.withColumn("statistic", F.try_divide("estimate", "se")).withColumn("status", F.when(F.col("n") < 3, "too_few").when(F.col("sxx") <= 0, "constant").otherwise("ok"))
    return out.withColumn("p_value", pv.p_t(F.col("statistic"), F.col("df"))).select(*by, "n", "estimate", "se", "statistic", "df", "p_value", "status")


# -- generalised linear models -----------------------------------------------------------------------------------------------------

_EPS = 1e-10


class Family:
    """Mean, derivative and variance functions as columns, and the deviance of a row."""

    dispersion = False

    def start(self, y: Column) -> Column:
        return y

    def link(self, mu: Column) -> Column:
        return mu

    def mean(self, eta: Column) -> Column:
        return eta

    def slope(self, eta: Column, mu: Column) -> Column:
        return F.lit(1.0)

    def variance(self, mu: Column) -> Column:
        return F.lit(1.0)

    def deviance(self, y: Column, mu: Column) -> Column:
        return (y - mu) * (y - mu)

    def loglik(self, y: Column, mu: Column) -> Column | None:
        return None


class Gaussian(Family):
    dispersion = True


class Binomial(Family):
    def start(self, y):
        return (y + 0.5) / 2

    def link(self, mu):
        return F.log(mu / (1 - mu))

    def mean(self, eta):
        e = F.exp(-F.abs(eta))
        return F.least(F.lit(1 - _EPS), F.greatest(F.lit(_EPS), F.when(eta >= 0, 1 / (1 + e)).otherwise(e / (1 + e))))

    def slope(self, eta, mu):
        return mu * (1 - mu)

    def variance(self, mu):
        return mu * (1 - mu)

    def deviance(self, y, mu):
        return -2 * self.loglik(y, mu)

    def loglik(self, y, mu):
        return F.when(y > 0, y * F.log(mu)).otherwise(0.0) + F.when(y < 1, (1 - y) * F.log(1 - mu)).otherwise(0.0)


class Probit(Binomial):
    """Normal distribution function and quantile are not built in, so they come from pandas UDFs."""

    def link(self, mu):
        return pv.normal_quantile(mu)

    def mean(self, eta):
        @F.pandas_udf("double")
        def cdf(x: pd.Series) -> pd.Series:
            return pd.Series(np.clip(sp.normal_cdf(x), _EPS, 1 - _EPS))

        return cdf(eta)

    def slope(self, eta, mu):
        return F.greatest(F.lit(_EPS), F.exp(-eta * eta / 2) / math.sqrt(2 * math.pi))


class Poisson(Family):
    def start(self, y):
        return y + 0.1

    def link(self, mu):
        return F.log(mu)

    def mean(self, eta):
        return F.exp(F.least(F.lit(700.0), F.greatest(F.lit(-700.0), eta)))

    def slope(self, eta, mu):
        return mu

    def variance(self, mu):
        return mu

    def deviance(self, y, mu):
        return 2 * (F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu))

    def loglik(self, y, mu):
        return y * F.log(mu) - mu


class QuasiPoisson(Poisson):
    dispersion = True


class QuasiBinomial(Binomial):
    dispersion = True


class Gamma(Poisson):
    """Log link."""

    dispersion = True

    def variance(self, mu):
        return mu * mu

    def deviance(self, y, mu):
        return 2 * ((y - mu) / mu - F.log(y / mu))


class InverseGaussian(Poisson):
    """Log link."""

    dispersion = True

    def variance(self, mu):
        return mu * mu * mu

    def deviance(self, y, mu):
        return (y - mu) * (y - mu) / (mu * mu * y)


class NegativeBinomial(Poisson):
    """Log link, given size."""

    def __init__(self, theta: float):
        if not (math.isfinite(theta) and theta > 0):
            raise ValueError("the size must be positive and finite")
        self.theta = theta

    def variance(self, mu):
        return mu + mu * mu / self.theta

    def deviance(self, y, mu):
        return 2 * (F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y + self.theta) * F.log((y + self.theta) / (mu + self.theta)))


class Tweedie(Poisson):
    """Quasi-likelihood with log link and variance mu ** power; for powers 1 and 2 take quasi_poisson and gamma."""

    dispersion = True

    def __init__(self, power: float):
        if not math.isfinite(power) or power in (1, 2):
            raise ValueError("the power must be finite and neither 1 nor 2")
        self.power = power

    def variance(self, mu):
        return F.pow(mu, F.lit(self.power))

    def deviance(self, y, mu):
        p = self.power
        return 2 * (F.when(y > 0, F.pow(y, F.lit(2 - p)) / ((1 - p) * (2 - p))).otherwise(0.0) - y * F.pow(mu, F.lit(1 - p)) / (1 - p) + F.pow(mu, F.lit(2 - p)) / (2 - p))


FAMILIES = {"gaussian": Gaussian, "binomial": Binomial, "probit": Probit, "poisson": Poisson, "gamma": Gamma, "inverse_gaussian": InverseGaussian, "quasi_poisson": QuasiPoisson, "quasi_binomial": QuasiBinomial}


def family_of(family: str | Family) -> Family:
    """A family by name; ``negative_binomial(size)`` and ``tweedie(power)`` take their parameter in brackets."""
    if not isinstance(family, str):
        return family
    given = re.fullmatch(r"(negative_binomial|tweedie)\((.+)\)", family.strip())
    if given:
        return {"negative_binomial": NegativeBinomial, "tweedie": Tweedie}[given[1]](float(given[2]))
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family}")
    return FAMILIES[family]()


def _eta(terms: list[str], beta: np.ndarray, offset: str | None) -> Column:
    out = F.col(offset).cast("double") if offset else F.lit(0.0)
    for t, b in zip(terms, beta):
        out = out + _col(t) * F.lit(float(b))
    return out


def glm(df: DataFrame, y: str, terms: list[str], family: str | Family, weight: str | None = None, offset: str | None = None, tol: float = 1e-9, max_iter: int = 50) -> Fit:
    """Iteratively reweighted least squares with step halving on the deviance; one pass a step and one for each trial."""
    fam = family_of(family)
    if isinstance(fam, Gaussian):
        return ols(df, y, terms, weight, offset)
    d = complete(df, y, *terms, *([weight] if weight else []), *([offset] if offset else []))
    w0 = F.col(weight).cast("double") if weight else F.lit(1.0)
    off = F.col(offset).cast("double") if offset else F.lit(0.0)
    yc = F.col(y).cast("double")
    p = len(terms)

    def step(eta: Column, mu: Column):
        slope = fam.slope(eta, mu)
        r = moments(d, terms, {"z": eta - off + (yc - mu) / slope}, w0 * slope * slope / fam.variance(mu)).collect()[0]
        return solve(gram(r, p), np.array([r[f"tz_{i}"] for i in range(p)])), int(r["n"])

    def deviance(beta) -> float:
        v = d.agg(F.sum(w0 * fam.deviance(yc, fam.mean(_eta(terms, beta, offset))))).collect()[0][0]
        return float("inf") if v is None or math.isnan(v) else float(v)

    mu0 = fam.start(yc)
    (inv, beta, rank), n = step(fam.link(mu0), mu0)
    dev, converged = deviance(beta), False
    for _ in range(max_iter):
        eta = _eta(terms, beta, offset)
        (inv, new, rank), n = step(eta, fam.mean(eta))
        trial, halved = deviance(new), 0
        while trial > dev + 1e-10 * (1 + abs(dev)) and halved < 30:
            new, halved = (new + beta) / 2, halved + 1
            trial = deviance(new)
        moved, fell = np.abs(new - beta).max() / (1 + np.abs(beta).max()), abs(trial - dev) / (1 + abs(dev))
        beta, dev = new, trial
        if moved <= math.sqrt(tol) and fell <= tol:
            converged = True
            break
    eta = _eta(terms, beta, offset)
    mu = fam.mean(eta)
    (inv, _, rank), n = step(eta, mu)
    pearson = d.agg(F.sum(w0 * (yc - mu) * (yc - mu) / fam.variance(mu)), *([F.sum(w0 * fam.loglik(yc, mu))] if fam.loglik(yc, mu) is not None else [])).collect()[0]
    dof = max(1, n - rank)
    phi = pearson[0] / dof if fam.dispersion else 1.0
    return Fit(terms, beta, inv * phi, float(dof) if fam.dispersion else float("inf"), n, {"deviance": dev, "dispersion": phi, "converged": converged, "rank": rank, "pearson": pearson[0]})


def predict(df: DataFrame, fit: Fit, family: str | Family = "gaussian", name: str = "predicted", offset: str | None = None) -> DataFrame:
    """Mean predictions with the delta-method SE of the linear predictor."""
    fam = family_of(family)
    eta = _eta(fit.terms, fit.beta, offset)
    cov = np.nan_to_num(fit.cov)
    var = F.lit(0.0)
    for i, a in enumerate(fit.terms):
        for j, b in enumerate(fit.terms):
            var = var + _col(a) * _col(b) * F.lit(float(cov[i, j]))
    return df.withColumn(name, fam.mean(eta)).withColumn(f"{name}_link_se", F.sqrt(F.greatest(F.lit(0.0), var)))


def average_marginal_effect(df: DataFrame, fit: Fit, term: str, family: str | Family) -> tuple[float, float]:
    """Mean slope of the expected response in ``term`` and its delta-method SE (numerical derivative in the coefficients)."""
    fam = family_of(family)
    k = fit.terms.index(term)

    def effect(beta) -> Column:
        eta = _eta(fit.terms, beta, None)
        return F.avg(fam.slope(eta, fam.mean(eta)) * F.lit(float(beta[k])))

    cols, steps = [effect(fit.beta).alias("e")], []
    for i in range(len(fit.beta)):
        h = 1e-5 * max(1.0, abs(fit.beta[i]))
        steps.append(h)
        for s, name in ((h, "u"), (-h, "d")):
            b = fit.beta.copy()
            b[i] += s
            cols.append(effect(b).alias(f"{name}{i}"))
    r = df.agg(*cols).collect()[0]
    grad = np.array([(r[f"u{i}"] - r[f"d{i}"]) / (2 * h) for i, h in enumerate(steps)])
    return float(r["e"]), float(np.sqrt(grad @ np.nan_to_num(fit.cov) @ grad))


# -- instruments, robust and survey covariance -----------------------------------------------------------------------------------------


def _sandwich(d: DataFrame, terms: list[str], resid: Column, bread: np.ndarray, cluster: str | None, weight: Column | None = None) -> tuple[np.ndarray, int]:
    """bread * meat * bread with the meat from rows or from sums within clusters, and the number of those."""
    w = weight if weight is not None else F.lit(1.0)
    scores = [(w * _col(t) * resid).alias(f"u{i}") for i, t in enumerate(terms)]
    p = len(terms)
    if cluster:
        d = d.groupBy(cluster).agg(*[F.sum(w * _col(t) * resid).alias(f"u{i}") for i, t in enumerate(terms)])
    else:
        d = d.select(*scores)
    r = d.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]).collect()[0]
    return bread @ gram(r, p) @ bread, int(r["n"])


def ols_robust(df: DataFrame, y: str, terms: list[str], kind: str = "HC1", cluster: str | None = None) -> Fit:
    """Least squares with HC0, HC1, CR0 or CR1 covariance."""
    fit = ols(df, y, terms)
    d = complete(df, y, *terms)
    resid = F.col(y).cast("double") - _eta(terms, fit.beta, None)
    bread = np.nan_to_num(fit.cov / fit.extra["sigma2"])
    cov, groups = _sandwich(d, terms, resid, bread, cluster)
    n, p = fit.n, fit.extra["rank"]
    factor = {"HC0": 1.0, "CR0": 1.0, "HC1": n / (n - p), "CR1": groups / max(groups - 1, 1) * (n - 1) / (n - p)}[kind]
    return Fit(terms, fit.beta, cov * factor, float(groups - 1) if cluster else float("inf"), n, fit.extra)


def two_stage(df: DataFrame, y: str, exogenous: list[str], endogenous: list[str], instruments: list[str], kind: str = "HC1", cluster: str | None = None) -> Fit:
    """Two-stage least squares from one pass of cross products of (exogenous, endogenous, instruments, y)."""
    d = complete(df, y, *exogenous, *endogenous, *instruments)
    every = [*exogenous, *instruments, *endogenous]
    # centred columns keep the digits of the cross products; the intercept moves back at the end
    mean = _centres(d, every, y, None) if ONE in exogenous else {}
    names = [t if t == ONE else f"_c{i}" for i, t in enumerate(every)]
    moved = d.select("*", *[(_col(t) - F.lit(mean.get(t, 0.0))).alias(n) for t, n in zip(every, names) if t != ONE])
    yc = F.col(y).cast("double") - F.lit(mean.get(y, 0.0))
    r = moments(moved, names, {"y": yc}).collect()[0]
    a, v = gram(r, len(every)), np.array([r[f"ty_{i}"] for i in range(len(every))])
    z = list(range(len(exogenous) + len(instruments)))
    x = list(range(len(exogenous))) + list(range(len(z), len(every)))
    first = np.linalg.solve(a[np.ix_(z, z)], a[np.ix_(z, x)])
    xx = a[np.ix_(x, z)] @ first
    bread = np.linalg.inv(xx)
    beta = bread @ first.T @ v[z]
    terms = [*exogenous, *endogenous]
    resid = yc
    for i, b in zip(x, beta):
        resid = resid - _col(names[i]) * F.lit(float(b))
    fitted = moved
    for i in range(len(x)):
        col = F.lit(0.0)
        for j in z:
            col = col + _col(names[j]) * F.lit(float(first[j, i]))
        fitted = fitted.withColumn(f"_h{i}", col)
    cov, groups = _sandwich(fitted, [f"_h{i}" for i in range(len(x))], resid, bread, cluster)
    if mean:
        back = np.eye(len(x))
        one = terms.index(ONE)
        for i, t in enumerate(terms):
            if t != ONE:
                back[one, i] = -mean[t]
        beta, cov = back @ beta, back @ cov @ back.T
        beta[one] += mean[y]
    n, p = int(r["n"]), len(x)
    factor = {"HC0": 1.0, "CR0": 1.0, "HC1": n / (n - p), "CR1": groups / max(groups - 1, 1) * (n - 1) / (n - p)}[kind]
    # first-stage partial R2 and F of each endogenous term, given the exogenous ones
    partial = {}
    ex = list(range(len(exogenous)))
    for k, name in enumerate(endogenous):
        e = len(z) + k
        rss = lambda cols: a[e, e] - a[e, cols] @ np.linalg.solve(a[np.ix_(cols, cols)], a[cols, e]) if cols else a[e, e]
        short, full = rss(ex), rss(z)
        partial[name] = {"partial_r2": 1 - full / short, "f": (short - full) / len(instruments) / (full / (n - len(z)))}
    return Fit(terms, beta, cov * factor, float(groups - p) if cluster else float("inf"), n, {"first_stage": partial})


def survey(df: DataFrame, y: str, terms: list[str], family: str, weight: str, stratum: str, psu: str) -> Fit:
    """Design-based regression: weights scaled to mean 1; variance from the totals of primary sampling units within strata."""
    mean = df.agg(F.avg(weight)).collect()[0][0]
    d = complete(df, y, *terms, weight).withColumn("_sw", F.col(weight) / F.lit(float(mean)))
    fit = glm(d, y, terms, family, weight="_sw")
    fam = family_of(family)
    eta = _eta(terms, fit.beta, None)
    mu = fam.mean(eta)
    slope = fam.slope(eta, mu)
    r = moments(d, terms, {}, F.col("_sw") * slope * slope / fam.variance(mu)).collect()[0]
    p = len(terms)
    bread = np.linalg.inv(gram(r, p))
    score = F.col("_sw") * (F.col(y).cast("double") - mu) * slope / fam.variance(mu)
    t = d.groupBy(stratum, psu).agg(*[F.sum(score * _col(x)).alias(f"u{i}") for i, x in enumerate(terms)])
    s = t.groupBy(stratum).agg(F.count(F.lit(1)).cast("double").alias("m"), *[F.avg(f"u{i}").alias(f"b{i}") for i in range(p)], *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)])
    if s.filter("m < 2").limit(1).count():
        raise ValueError("a stratum has a single primary sampling unit")
    q = s.agg(F.sum("m").alias("units"), F.count(F.lit(1)).alias("strata"), *[F.sum(F.col("m") / (F.col("m") - 1) * (F.col(f"a{i}_{j}") - F.col("m") * F.col(f"b{i}") * F.col(f"b{j}"))).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]).collect()[0]
    return Fit(terms, fit.beta, bread @ gram(q, p) @ bread, float(q["units"] - q["strata"]), fit.n)


def mediation(df: DataFrame, y: str, treatment: str, mediator: str, covariates: list[str] = ()) -> dict:
    """Three least-squares fits: indirect = a * b with Sobel's SE, direct, total and the share mediated."""
    cov = [ONE, *covariates]
    a = ols(df, mediator, [*cov, treatment])
    b = ols(df, y, [*cov, treatment, mediator])
    c = ols(df, y, [*cov, treatment])
    ea, sa = a.beta[-1], math.sqrt(a.cov[-1, -1])
    eb, sb = b.beta[-1], math.sqrt(b.cov[-1, -1])
    indirect, se = ea * eb, math.hypot(eb * sa, ea * sb)
    return {"a": ea, "b": eb, "indirect": indirect, "indirect_se": se, "indirect_p": float(2 * sp.normal_sf(abs(indirect / se))), "direct": b.beta[-2], "total": c.beta[-1], "mediated": indirect / c.beta[-1]}


# -- penalised ---------------------------------------------------------------------------------------------------------------------------


def penalized_path(df: DataFrame, y: str, predictors: list[str], alpha: float = 1.0, lambdas: list[float] | None = None, n_lambda: int = 100, ratio: float = 1e-3, tol: float = 1e-10) -> pd.DataFrame:
    """Elastic net by coordinate descent on the standardised Gram matrix: one pass over the data for the whole path.

    Objective: RSS / (2n) + lambda * (alpha * |b|_1 + (1 - alpha) / 2 * |b|_2^2); the intercept is not penalised.
    """
    d = complete(df, y, *predictors)
    mean = _centres(d, predictors, y, None)
    for i, t in enumerate(predictors):
        d = d.withColumn(f"_c{i}", _col(t) - F.lit(mean[t]))
    names = [f"_c{i}" for i in range(len(predictors))]
    r = moments(d, names, {"y": F.col(y).cast("double") - F.lit(mean[y])}).collect()[0]
    p, n = len(names), int(r["n"])
    a, v = gram(r, p) / n, np.array([r[f"ty_{i}"] for i in range(p)]) / n
    s = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    a, v = a / s[:, None] / s[None, :], v / s
    if lambdas is None:
        top = np.abs(v).max() / max(alpha, 1e-3)
        top = top if top > 0 else 1.0
        lambdas = list(np.geomspace(top, top * ratio, n_lambda))
    b, rows = np.zeros(p), []
    for lam in lambdas:
        for _ in range(10_000):
            most = 0.0
            for j in range(p):
                rho = v[j] - a[j] @ b + a[j, j] * b[j]
                new = math.copysign(max(abs(rho) - lam * alpha, 0.0), rho) / (a[j, j] + lam * (1 - alpha))
                most = max(most, abs(new - b[j]))
                b[j] = new
            if most < tol:
                break
        beta = b / s
        row = {"lambda": lam, "nonzero": int((b != 0).sum()), "r2": float((2 * v @ b - b @ a @ b) / (r["sy"] / n)), ONE: mean[y] - sum(x * mean[t] for x, t in zip(beta, predictors))}
        rows.append(row | dict(zip(predictors, beta)))
    return pd.DataFrame(rows)


# -- scans: one response, many features ----------------------------------------------------------------------------------------------------


def scan(features: DataFrame, phenotype: DataFrame, y: str, covariates: list[str], sample: str = "sample_id", feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Least squares of ``y`` on covariates and each feature of a long table (feature, sample, value), covariates factored once.

    The covariates' orthonormal scores are computed on the (sample) table, so that each feature needs only centred sums of p + 2 products by
    (feature): x.x, x.r and x.q. Missing values take the feature's mean. Features that do not vary, or that the covariates explain but for 1e-12
    of their variation, are ``non_estimable``.
    """
    terms = [ONE, *covariates]
    d = complete(phenotype, y, *covariates)
    fit = ols(d, y, terms)
    r = moments(d, terms, {}).collect()[0]
    # scores of the covariates: orthonormal, as many as they have rank, so that repeated or constant covariates do no harm
    scale = np.sqrt(np.maximum(np.diag(gram(r, len(terms))), np.finfo(float).tiny))
    size, axes = np.linalg.eigh(gram(r, len(terms)) / np.outer(scale, scale))
    live = size > 1e-12 * size.max()
    factor = axes[:, live] / np.sqrt(size[live]) / scale[:, None]
    k = int(live.sum())
    q = []
    for i in range(k):
        col = F.lit(0.0)
        for j, t in enumerate(terms):
            col = col + _col(t) * F.lit(float(factor[j, i]))
        q.append(col.alias(f"q{i}"))
    null = d.select(F.col(sample).alias("_sample"), (F.col(y).cast("double") - _eta(terms, fit.beta, None)).alias("r"), *q)
    n, rank = fit.n, k
    x = features.select(F.col(feature).alias("feature_id"), F.col(sample).alias("_sample"), finite(value).alias("x")).join(null, "_sample")
    # co-moments are centred while they are summed, so a large mean costs no digits; missing entries count as the mean, that is zero
    own = lambda c: F.when(F.col("x").isNotNull(), F.col(c))
    called = F.count("x").cast("double")
    sums = x.groupBy("feature_id").agg(
        F.count("x").alias("called"), (F.var_pop("x") * called).alias("sxx"), (F.covar_pop("x", own("r")) * called).alias("sxr"), *[(F.covar_pop("x", own(f"q{i}")) * called).alias(f"xq{i}") for i in range(k)],
    )
    explained = F.lit(0.0)
    for i in range(k):
        explained = explained + F.col(f"xq{i}") * F.col(f"xq{i}")
    sums = sums.withColumn("left", F.col("sxx") - explained)
    dof = n - rank - 1
    ok = F.coalesce((F.col("sxx") > 0) & (F.col("left") > 1e-12 * F.col("sxx")), F.lit(False))
    out = sums.withColumn("beta", F.when(ok, F.try_divide("sxr", "left")))
    rss = F.greatest(F.lit(0.0), F.lit(float(fit.extra["rss"])) - F.col("beta") * F.col("sxr"))
    out = out.withColumn("standard_error", F.sqrt(F.try_divide(rss / F.lit(float(dof)), F.when(ok, F.col("left"))))).withColumn("statistic", F.try_divide("beta", "standard_error")).withColumn("df", F.lit(float(dof)))
    return out.withColumn("p_value", pv.p_t(F.col("statistic"), F.col("df"))).select("feature_id", "called", "beta", "standard_error", "statistic", "df", "p_value", F.when(ok, "ok").otherwise("non_estimable").alias("status"))


def score_scan(features: DataFrame, phenotype: DataFrame, y: str, covariates: list[str], family: str, sample: str = "sample_id", feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Score tests of each feature against one fitted null GLM: no refit, sums by feature only."""
    terms = [ONE, *covariates]
    fam = family_of(family)
    d = complete(phenotype, y, *covariates)
    fit = glm(d, y, terms, family)
    if not fit.extra.get("converged", True):
        raise ValueError("the null model did not converge")
    eta = _eta(terms, fit.beta, None)
    mu = fam.mean(eta)
    slope = fam.slope(eta, mu)
    null = d.select(F.col(sample).alias("_sample"), (slope * slope / fam.variance(mu)).alias("w"), ((F.col(y).cast("double") - mu) * slope / fam.variance(mu)).alias("u"), *[_col(t).alias(f"c{i}") for i, t in enumerate(terms)])
    r = moments(null, [f"c{i}" for i in range(len(terms))], {}, F.col("w")).collect()[0]
    inv = np.linalg.inv(gram(r, len(terms)))
    phi = fit.extra.get("dispersion", 1.0)
    x = features.select(F.col(feature).alias("feature_id"), F.col(sample).alias("_sample"), finite(value).alias("x")).filter("x is not null").join(null, "_sample")
    k = len(terms)
    s = x.groupBy("feature_id").agg(F.count(F.lit(1)).alias("called"), F.sum(F.col("x") * F.col("u")).alias("score"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("xx"), *[F.sum(F.col("w") * F.col("x") * F.col(f"c{i}")).alias(f"b{i}") for i in range(k)])
    var = F.col("xx")
    for i in range(k):
        for j in range(k):
            var = var - F.lit(float(inv[i, j])) * F.col(f"b{i}") * F.col(f"b{j}")
    s = s.withColumn("variance", var).withColumn("beta", F.try_divide("score", "variance")).withColumn("statistic", F.try_divide(F.col("score"), F.sqrt(F.greatest(F.lit(0.0), F.col("variance")) * F.lit(float(phi)))))
    ok = F.coalesce((F.col("variance") > 1e-12 * F.col("xx")) & (F.col("xx") > 0), F.lit(False))
    s = s.withColumn("p_value", pv.p_normal(F.col("statistic")))
    return s.select("feature_id", "called", "score", "variance", *[F.when(ok, F.col(c)).alias(c) for c in ("beta", "statistic", "p_value")], F.when(ok, "ok").otherwise("non_estimable").alias("status"))

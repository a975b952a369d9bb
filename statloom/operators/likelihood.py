"""Maximum likelihood over a distributed table.

A model is a function from parameters and columns (numpy arrays of one batch) to log-likelihoods of rows. Every step is one pass in which each
batch evaluates all the points the step needs, so that only a few numbers for each point travel. Covariances come from the numerical
Hessian. Grouped models get whole groups: rows are dealt by group first.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import special as sp
from statloom.operators import regression as rg
from statloom.session import ship


def totals(df: DataFrame, fn: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum over batches of the vector ``fn`` makes of each; Spark adds up one row for each entry and task."""
    ship(df.sparkSession)

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                v = np.asarray(fn(pdf), float)
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    rows = df.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def group_totals(df: DataFrame, by: str, fn: Callable[[pd.DataFrame, np.ndarray], np.ndarray]) -> np.ndarray:
    """As totals for rows that are dealt and sorted by group, with ``fn`` given many whole groups at a time and where each starts."""
    ship(df.sparkSession)

    def run(batches):
        total, rest = None, []  # rest: the rows so far of a group that may go on

        def add(parts, starts):
            nonlocal total
            v = np.asarray(fn(pd.concat(parts, ignore_index=True), starts), float)
            total = v if total is None else total + v

        cut = lambda keys: np.flatnonzero(np.diff(pd.factorize(keys, use_na_sentinel=False)[0])) + 1
        for pdf in batches:
            if not len(pdf):
                continue
            if rest and len(cut(pd.concat([rest[-1][by].iloc[-1:], pdf[by].iloc[:1]]))):
                add(rest, np.array([0]))
                rest = []
            cuts = cut(pdf[by])
            if len(cuts):
                add([*rest, pdf.iloc[: cuts[-1]]], np.concatenate([[0], cuts[:-1] + sum(map(len, rest))]))
                rest, pdf = [], pdf.iloc[cuts[-1] :]
            rest.append(pdf)
        if rest:
            add(rest, np.array([0]))
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    rows = df.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def maximize(df: DataFrame, columns: list[str], loglik: Callable, start: np.ndarray, names: list[str], group: str | None = None, tol: float = 1e-8, max_iter: int = 100) -> rg.Fit:
    """BFGS with numerical gradients; all points of a gradient and of a line search go through the table together.

    ``loglik(theta, data)`` gives log-likelihoods that are summed: of rows, or with ``group`` of the groups whose first rows are at ``_start``,
    where equal rows of a group come once, with their number ``_n``.
    """
    d = rg.complete(df.select(*columns, *([group] if group else [])), *[c for c in columns if dict(df.dtypes)[c] != "string"])
    if group:
        keys = list(dict.fromkeys([group, *columns]))
        d = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).repartition(group).sortWithinPartitions(group)
    d = d.persist()

    def evaluate(points: list[np.ndarray]) -> np.ndarray:
        def one(pdf, starts=None):
            data = {c: pdf[c].to_numpy(float) if pdf[c].dtype != object else pdf[c].to_numpy() for c in columns}
            if starts is not None:
                data |= {"_n": pdf["_n"].to_numpy(float), "_start": starts}
            with np.errstate(all="ignore"):
                return np.array([np.nan_to_num(np.sum(loglik(t, data)), nan=-1e300, neginf=-1e300, posinf=-1e300) for t in points])

        return totals(d, one) if group is None else group_totals(d, group, one)

    def spots(x):
        h = 1e-5 * np.maximum(1.0, np.abs(x))
        return [x, *[x + s * h[i] * np.eye(len(x))[i] for i in range(len(x)) for s in (1, -1)]], h

    def gradient(x):
        pts, h = spots(x)
        v = evaluate(pts)
        return v[0], np.array([(v[1 + 2 * i] - v[2 + 2 * i]) / (2 * h[i]) for i in range(len(x))])

    try:
        x = np.asarray(start, float)
        n = d.agg(F.sum("_n")).collect()[0][0] if group else d.count()
        value, g = gradient(x)
        inverse, converged = np.eye(len(x)) / max(1.0, np.abs(g).max()), False
        for _ in range(max_iter):
            step = inverse @ g
            if step @ g <= 0:
                inverse = np.eye(len(x)) / max(1.0, np.abs(g).max())
                step = inverse @ g
            scales = 2.0 ** -np.arange(0, 12)
            trial = evaluate([x + s * step for s in scales])
            best = int(trial.argmax())
            if trial[best] <= value:
                converged = np.abs(g).max() < 1e-3 * max(1.0, abs(value)) ** 0.5
                break
            new = x + scales[best] * step
            v2, g2 = gradient(new)
            s, y = new - x, g - g2
            if s @ y > 1e-12:
                rho = 1 / (s @ y)
                m = np.eye(len(x)) - rho * np.outer(s, y)
                inverse = m @ inverse @ m.T + rho * np.outer(s, s)
            done = abs(v2 - value) <= tol * (1 + abs(value)) and np.abs(s).max() <= 1e-6 * (1 + np.abs(x).max())
            x, value, g = new, v2, g2
            if done:
                converged = True
                break
        h = 1e-3 * np.maximum(0.1, np.abs(x))
        p, eye = len(x), np.eye(len(x))
        pts = [x + a * h[i] * eye[i] + b * h[j] * eye[j] for i in range(p) for j in range(i, p) for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1))]
        v = evaluate(pts)
        hess, k = np.zeros((p, p)), 0
        for i in range(p):
            for j in range(i, p):
                hess[i, j] = hess[j, i] = (v[k] - v[k + 1] - v[k + 2] + v[k + 3]) / (4 * h[i] * h[j])
                k += 4
        return rg.Fit(names, x, np.linalg.pinv(-hess), float("inf"), n, {"loglik": float(value), "converged": bool(converged), "aic": 2 * p - 2 * float(value)})
    finally:
        d.unpersist()


def _linear(theta, data, terms, at=0):
    eta = np.zeros(len(next(iter(data.values()))))
    for i, t in enumerate(terms):
        eta = eta + theta[at + i] * (1.0 if t == rg.ONE else data[t])
    return eta


def ordinal(df: DataFrame, y: str, terms: list[str], link: str = "logit") -> rg.Fit:
    """Cumulative link model of whole-number categories, every one of them observed; thresholds as log gaps, reported as thresholds."""
    counts = {r[0]: r["count"] for r in df.filter(F.col(y).isNotNull()).groupBy(y).count().limit(1000).collect()}
    values = sorted(counts)
    if values != list(range(int(values[0]), int(values[0]) + len(values))) or len(values) < 2:
        raise ValueError("categories must be consecutive whole numbers")
    share = np.cumsum([counts[v] for v in values])[:-1] / sum(counts.values())
    cdf = (lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))) if link == "logit" else sp.normal_cdf
    cut = np.log(share / (1 - share)) if link == "logit" else sp.normal_ppf(share)
    k, low = len(cut), values[0]

    def cuts(theta):
        return np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:k]))])

    def loglik(theta, data):
        c = np.concatenate([[-np.inf], cuts(theta), [np.inf]])
        j = (data[y] - low).astype(int)
        eta = _linear(theta, data, terms, k)
        return np.log(np.maximum(cdf(np.minimum(c[j + 1] - eta, 1e3)) - cdf(np.maximum(c[j] - eta, -1e3)), 1e-300))

    start = np.concatenate([[cut[0]], np.log(np.diff(cut)), np.zeros(len(terms))])
    names = [f"{int(v)}|{int(v) + 1}" for v in values[:-1]] + list(terms)
    fit = maximize(df, list(dict.fromkeys([y, *terms])), loglik, start, names)
    jac = np.eye(len(fit.beta))
    for a in range(1, k):
        jac[a, 0], jac[a, 1 : a + 1], jac[a, a] = 1.0, np.exp(fit.beta[1 : a + 1]), math.exp(fit.beta[a])
    fit.beta[:k] = cuts(fit.beta)
    fit.cov = jac @ fit.cov @ jac.T
    return fit


def censored(df: DataFrame, time: str, status: str, terms: list[str], family: str = "gaussian") -> rg.Fit:
    """Tobit and accelerated failure time models; status -1 left-censored, 0 exact, 1 right-censored. log scale is the last parameter."""
    log_time = family in ("lognormal", "weibull", "exponential")
    y = (lambda d: np.log(d[time])) if log_time else (lambda d: d[time])
    fixed = family == "exponential"

    def loglik(theta, data):
        s = 1.0 if fixed else math.exp(theta[-1])
        z = (y(data) - _linear(theta, data, terms)) / s
        if family in ("weibull", "exponential"):
            exact, over = z - np.exp(np.minimum(z, 700)), -np.exp(np.minimum(z, 700))
            under = np.log(-np.expm1(np.minimum(over, -1e-300)))
        else:
            exact, over, under = -z * z / 2 - 0.5 * math.log(2 * math.pi), sp.normal_logsf(z), sp.normal_logsf(-z)
        exact = exact - math.log(s) - (np.log(data[time]) if log_time else 0)
        return np.where(data[status] == 0, exact, np.where(data[status] > 0, over, under))

    d = df.withColumn("_y", F.log(time) if log_time else F.col(time).cast("double"))
    if d.filter(F.col(status) == 0).limit(2).count() < 2:
        raise ValueError("two exact observations are needed")
    first = rg.ols(d, "_y", terms)
    start = np.concatenate([first.beta, [] if fixed else [0.5 * math.log(max(first.extra["sigma2"], 1e-12))]])
    return maximize(df, list(dict.fromkeys([time, status, *[t for t in terms if t != rg.ONE]])), loglik, start, [*terms, *([] if fixed else ["log(scale)"])])


def beta_regression(df: DataFrame, y: str, terms: list[str], precision: list[str] = (rg.ONE,)) -> rg.Fit:
    """Shares in (0, 1): logit mean, log precision."""
    k = len(terms)

    def loglik(theta, data):
        mu = 1 / (1 + np.exp(-_linear(theta, data, terms)))
        phi = np.exp(np.clip(_linear(theta, data, precision, k), -30, 30))
        a, b = mu * phi, (1 - mu) * phi
        return sp.lgamma(phi) - sp.lgamma(a) - sp.lgamma(b) + (a - 1) * np.log(data[y]) + (b - 1) * np.log1p(-data[y])

    first = rg.ols(df.withColumn("_y", F.log(F.col(y) / (1 - F.col(y)))), "_y", terms)
    start = np.concatenate([first.beta, [2.0], np.zeros(len(precision) - 1)])
    return maximize(df, list(dict.fromkeys([y, *[t for t in [*terms, *precision] if t != rg.ONE]])), loglik, start, [*terms, *[f"precision:{t}" for t in precision]])


def zero_inflated(df: DataFrame, y: str, terms: list[str], zero: list[str] = (rg.ONE,), negative_binomial: bool = False) -> rg.Fit:
    """Counts with extra zeros: log mean, logit zero share, and with ``negative_binomial`` a log size."""
    k, m = len(terms), len(zero)

    def loglik(theta, data):
        v = data[y]
        mu = np.exp(np.clip(_linear(theta, data, terms), -30, 30))
        pi = 1 / (1 + np.exp(-_linear(theta, data, zero, k)))
        if negative_binomial:
            r = math.exp(min(theta[k + m], 30))
            base = sp.lgamma(v + r) - sp.lgamma(r) - sp.lgamma(v + 1) + r * np.log(r / (r + mu)) + v * np.log(mu / (r + mu))
        else:
            base = v * np.log(mu) - mu - sp.lgamma(v + 1)
        return np.where(v == 0, np.log(pi + (1 - pi) * np.exp(base)), np.log1p(-pi) + base)

    first = rg.glm(df, y, terms, "poisson")
    start = np.concatenate([first.beta, [-1.0], np.zeros(m - 1), [0.0] if negative_binomial else []])
    return maximize(df, list(dict.fromkeys([y, *[t for t in [*terms, *zero] if t != rg.ONE]])), loglik, start, [*terms, *[f"zero:{t}" for t in zero], *(["log(size)"] if negative_binomial else [])])


def negative_binomial(df: DataFrame, y: str, terms: list[str]) -> rg.Fit:
    """Log-linear negative binomial with its size."""
    k = len(terms)

    def loglik(theta, data):
        v, mu, r = data[y], np.exp(np.clip(_linear(theta, data, terms), -30, 30)), math.exp(min(theta[k], 30))
        return sp.lgamma(v + r) - sp.lgamma(r) - sp.lgamma(v + 1) + r * np.log(r / (r + mu)) + v * np.log(mu / (r + mu))

    first = rg.glm(df, y, terms, "poisson")
    return maximize(df, list(dict.fromkeys([y, *[t for t in terms if t != rg.ONE]])), loglik, np.append(first.beta, 0.0), [*terms, "log(size)"])


#: Categories that a multinomial fit takes at most; beyond, it raises.
MOST_CATEGORIES = 1000


def multinomial(df: DataFrame, y: str, terms: list[str]) -> rg.Fit:
    """Logits of every category against the first in order; more than ``MOST_CATEGORIES`` are refused, as each has parameters of its own."""
    values = sorted(r[0] for r in df.filter(F.col(y).isNotNull()).select(y).distinct().limit(MOST_CATEGORIES + 1).collect())
    if len(values) > MOST_CATEGORIES:
        raise ValueError(f"{y} has more than {MOST_CATEGORIES} categories")
    k = len(terms)

    def loglik(theta, data):
        eta = np.stack([np.zeros(len(data[y]))] + [_linear(theta, data, terms, k * c) for c in range(len(values) - 1)], 1)
        j = np.searchsorted(np.array(values), data[y])
        top = eta.max(1)
        return eta[np.arange(len(j)), j] - top - np.log(np.exp(eta - top[:, None]).sum(1))

    return maximize(df, list(dict.fromkeys([y, *[t for t in terms if t != rg.ONE]])), loglik, np.zeros(k * (len(values) - 1)), [f"{v}:{t}" for v in values[1:] for t in terms])


def rare_events(df: DataFrame, y: str, terms: list[str], prevalence: float | None = None) -> rg.Fit:
    """Logit with the leading small-sample bias removed, and with a known prevalence the intercept moved to it."""
    fit = rg.glm(df, y, terms, "binomial")
    d = rg.complete(df, y, *terms)
    fam = rg.Binomial()
    eta = rg._eta(terms, fit.beta, None)
    mu = fam.mean(eta)
    w = mu * (1 - mu)
    p = len(terms)
    q = F.lit(0.0)
    for i, a in enumerate(terms):
        for j, b in enumerate(terms):
            q = q + rg._col(a) * rg._col(b) * F.lit(float(fit.cov[i, j]))
    r = rg.moments(d, terms, {"xi": 0.5 * q * (2 * mu - 1)}, w).collect()[0]
    bias = np.linalg.solve(rg.gram(r, p), np.array([r[f"txi_{i}"] for i in range(p)]))
    n = fit.n
    beta = fit.beta - bias
    if prevalence is not None and rg.ONE in terms:
        ybar = d.agg(F.avg(y)).collect()[0][0]
        beta[terms.index(rg.ONE)] -= math.log((1 - prevalence) / prevalence * ybar / (1 - ybar))
    return rg.Fit(terms, beta, fit.cov * (n / (n + p)) ** 2, float("inf"), n, fit.extra)


def nonlinear(df: DataFrame, y: str, columns: list[str], mean: Callable, start: list[float], names: list[str], rounds: int = 100) -> rg.Fit:
    """Least squares for ``mean(theta, data)`` by damped Gauss-Newton; one pass a step."""
    d = rg.complete(df.select(y, *columns), y, *columns)
    x = np.asarray(start, float)
    p = len(x)

    def normal(theta, trial):
        def one(pdf):
            data = {c: pdf[c].to_numpy(float) for c in columns}
            h = 1e-6 * np.maximum(1.0, np.abs(theta))
            jac = np.stack([(mean(theta + h[i] * np.eye(p)[i], data) - mean(theta - h[i] * np.eye(p)[i], data)) / (2 * h[i]) for i in range(p)], 1)
            e = pdf[y].to_numpy(float) - mean(theta, data)
            return np.concatenate([[len(e), e @ e], jac.T @ e, (jac.T @ jac).ravel(), [((pdf[y].to_numpy(float) - mean(t, data)) ** 2).sum() for t in trial]])

        return totals(d, one)

    r = normal(x, [])
    for _ in range(rounds):
        a = r[2 + p : 2 + p + p * p].reshape(p, p)
        step = np.linalg.lstsq(a, r[2 : 2 + p], rcond=None)[0]
        trial = [x + step * 2.0**-k for k in range(10)]
        sse = normal(x, trial)[2 + p + p * p :]
        k = int(np.nanargmin(sse))
        if not sse[k] < r[1] * (1 - 1e-12):
            # the sum of squares is flat here, but a last whole step still adds digits to the coefficients
            if sse[0] <= r[1] * (1 + 1e-12):
                x = trial[0]
                r = normal(x, [])
            break
        x = trial[k]
        r = normal(x, [])
    n, dof = int(r[0]), int(r[0]) - p
    return rg.Fit(names, x, np.linalg.pinv(r[2 + p : 2 + p + p * p].reshape(p, p)) * r[1] / dof, float(dof), n, {"rss": float(r[1])})


def quantile(df: DataFrame, y: str, terms: list[str], tau: float = 0.5, rounds: int = 60) -> rg.Fit:
    """Quantile regression by smoothed check loss: majorised weighted least squares whose smoothing shrinks; one pass a step."""
    d = rg.complete(df, y, *terms)
    fit = rg.ols(d, y, terms)
    beta, p = fit.beta, len(terms)
    width = math.sqrt(max(fit.extra["sigma2"], 1e-12))
    yc = F.col(y).cast("double")
    for k in range(rounds):
        eps = max(width * 0.5**k, width * 1e-6)
        e = yc - rg._eta(terms, beta, None)
        w = 1 / (F.abs(e) + F.lit(eps))
        # the check loss is |e| / 2 + (tau - 1/2) e: the first part by weights, the second by a shift of the response
        r = rg.moments(d, terms, {"z": yc + F.lit(2 * tau - 1) / w}, w).collect()[0]
        _, new, _ = rg.solve(rg.gram(r, p), np.array([r[f"tz_{i}"] for i in range(p)]))
        moved = np.abs(new - beta).max()
        beta = new
        if moved < 1e-7 * (1 + np.abs(beta).max()) and eps <= width * 1e-5:
            break
    # sparsity by a kernel at zero
    h = width * 0.9 * fit.n ** (-1 / 5)
    e = yc - rg._eta(terms, beta, None)
    dens = F.exp(-e * e / (2 * h * h)) / (h * math.sqrt(2 * math.pi))
    inner = rg.gram(rg.moments(d, terms, {}, dens).collect()[0], p)
    outer = rg.gram(rg.moments(d, terms, {}).collect()[0], p)
    inv = np.linalg.pinv(inner)
    return rg.Fit(terms, beta, tau * (1 - tau) * inv @ outer @ inv, float("inf"), fit.n, {"tau": tau})


# -- grouped models ------------------------------------------------------------------------------------------------------------------------


def mixed_intercept(df: DataFrame, y: str, terms: list[str], group: str, reml: bool = True) -> rg.Fit:
    """Linear model with a random intercept by (restricted) likelihood in the variance ratio.

    One aggregate by group gives sizes and sums; each round evaluates a whole grid of ratios in one pass over those sums.
    """
    from statloom.session import materialize

    d = rg.complete(df, y, *terms)
    p = len(terms)
    g = materialize(d.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("sy"), *[F.sum(rg._col(t)).alias(f"s{i}") for i, t in enumerate(terms)]))
    r = rg.moments(d, terms, {"y": F.col(y).cast("double")}).collect()[0]
    xx, xy, yy, n = rg.gram(r, p), np.array([r[f"ty_{i}"] for i in range(p)]), r["sy"], int(r["n"])

    def profile(ratios):
        cols = []
        for k, lam in enumerate(ratios):
            w = F.lit(float(lam)) / (1 + F.lit(float(lam)) * F.col("n"))
            s = [F.col(f"s{i}") for i in range(p)] + [F.col("sy")]
            cols += [F.sum(w * s[i] * s[j]).alias(f"w{k}_{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]
            cols.append(F.sum(F.log(1 + F.lit(float(lam)) * F.col("n"))).alias(f"l{k}"))
        q = g.agg(*cols).collect()[0]
        out = []
        for k in range(len(ratios)):
            c = np.zeros((p + 1, p + 1))
            for i in range(p + 1):
                for j in range(i, p + 1):
                    c[i, j] = c[j, i] = q[f"w{k}_{i}_{j}"]
            a, v, t = xx - c[:p, :p], xy - c[:p, p], yy - c[p, p]
            beta = np.linalg.solve(a, v)
            rss = max(t - beta @ v, 1e-300)
            m = n - p if reml else n
            s2 = rss / m
            ll = -0.5 * (m * math.log(2 * math.pi * s2) + m + q[f"l{k}"] + (np.linalg.slogdet(a)[1] if reml else 0))
            out.append((ll, s2, beta, np.linalg.inv(a) * s2))
        return out

    grid = np.concatenate([[0.0], np.geomspace(1e-4, 1e3, 14)])
    low, high = 0.0, 1e3
    best = None
    for _ in range(14):
        found = profile(list(grid))
        k = int(np.argmax([f[0] for f in found]))
        best, lam = found[k], float(grid[k])
        low, high = float(grid[max(0, k - 1)]), float(grid[min(len(grid) - 1, k + 1)])
        if high - low < 1e-9 * (1 + lam):
            break
        grid = np.linspace(low, high, 9)
    ll, s2, beta, cov = best
    return rg.Fit(terms, beta, cov, float("inf"), n, {"loglik": ll, "residual_variance": s2, "group_variance": lam * s2, "icc": lam / (1 + lam)})


def gee(df: DataFrame, y: str, terms: list[str], cluster: str, family: str = "gaussian", correlation: str = "exchangeable", rounds: int = 50, tol: float = 1e-8) -> rg.Fit:
    """Generalised estimating equations with independence or exchangeable correlation and the sandwich covariance.

    With exchangeable correlation a cluster's inverse needs its size and sums of scaled rows only, so clusters are one aggregate, of any size.
    """
    fam = rg.family_of(family)
    d = rg.complete(df, y, *terms)
    p = len(terms)
    beta, rho = rg.glm(d, y, terms, family).beta, 0.0
    yc = F.col(y).cast("double")

    def sums(beta):
        eta = rg._eta(terms, beta, None)
        mu = fam.mean(eta)
        sd = F.sqrt(fam.variance(mu))
        z = d.select(cluster, ((yc - mu) / sd).alias("e"), *[(rg._col(t) * fam.slope(eta, mu) / sd).alias(f"x{i}") for i, t in enumerate(terms)])
        x = [F.col(f"x{i}") for i in range(p)]
        return z.groupBy(cluster).agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum("e").alias("se"), F.sum(F.col("e") * F.col("e")).alias("see"),
            *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(c * F.col("e")).alias(f"xe{i}") for i, c in enumerate(x)],
            *[F.sum(x[i] * x[j]).alias(f"xx{i}_{j}") for i in range(p) for j in range(i, p)],
        )

    for _ in range(rounds):
        c = sums(beta)
        m = c.agg(F.sum("n").alias("n"), F.sum("see").alias("ss"), F.sum(F.col("se") * F.col("se") - F.col("see")).alias("cross"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).collect()[0]
        phi = m["ss"] / (m["n"] - p)
        rho = m["cross"] / m["pairs"] / phi if correlation == "exchangeable" and m["pairs"] else 0.0
        k = F.lit(float(rho)) / (1 + (F.col("n") - 1) * F.lit(float(rho)))
        u = [(F.col(f"xe{i}") - k * F.col(f"s{i}") * F.col("se")) / F.lit(1 - rho) for i in range(p)]
        a = c.select(*[x.alias(f"u{i}") for i, x in enumerate(u)], *[((F.col(f"xx{i}_{j}") - k * F.col(f"s{i}") * F.col(f"s{j}")) / F.lit(1 - rho)).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)])
        r = a.agg(F.count(F.lit(1)).alias("clusters"), *[F.sum(f"u{i}").alias(f"g{i}") for i in range(p)], *[F.sum(f"h{i}_{j}").alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)], *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(p) for j in range(i, p)]).collect()[0]
        bread = np.linalg.inv(rg.gram(r, p))
        step = bread @ np.array([r[f"g{i}"] for i in range(p)])
        meat = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                meat[i, j] = meat[j, i] = r[f"m{i}_{j}"]
        beta = beta + step
        if np.abs(step).max() < tol * (1 + np.abs(beta).max()):
            break
    return rg.Fit(terms, beta, bread @ meat @ bread, float("inf"), int(m["n"]), {"rho": rho, "phi": phi, "clusters": int(r["clusters"])})


def glmm_intercept(df: DataFrame, y: str, terms: list[str], group: str, family: str = "binomial", nodes: int = 15) -> rg.Fit:
    """Random-intercept logistic or Poisson regression by adaptive Gauss-Hermite quadrature; the last parameter is log sd."""
    x, w = np.polynomial.hermite_e.hermegauss(nodes)
    w = w / math.sqrt(2 * math.pi)

    def rows(eta, v):
        if family == "binomial":
            return v * eta - np.logaddexp(0, eta)
        return v * eta - np.exp(np.minimum(eta, 50)) - sp.lgamma(v + 1)

    def loglik(theta, data):
        sd = math.exp(min(max(theta[-1], -10), 5))
        eta, v, n, starts = _linear(theta, data, terms), data[y], data["_n"], data["_start"]
        at = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(v))))
        by_group = lambda c: np.add.reduceat(n * c, starts)
        b = np.zeros(len(starts))
        for _ in range(25):  # the modes of the groups' effects (in units of sd)
            mu = 1 / (1 + np.exp(-(eta + sd * b[at]))) if family == "binomial" else np.exp(np.minimum(eta + sd * b[at], 50))
            var = mu * (1 - mu) if family == "binomial" else mu
            g, h = sd * by_group(v - mu) - b, sd * sd * by_group(var) + 1
            b = b + g / h
            if np.abs(g / h).max() < 1e-9:
                break
        s = 1 / np.sqrt(h)
        logs = np.array([by_group(rows(eta + sd * (b + s * k)[at], v)) - (b + s * k) ** 2 / 2 + k * k / 2 + math.log(c) + np.log(s) for k, c in zip(x, w)])
        top = logs.max(0)
        return top + np.log(np.exp(logs - top).sum(0))

    first = rg.glm(df, y, terms, family)
    return maximize(df, list(dict.fromkeys([y, *[t for t in terms if t != rg.ONE]])), loglik, np.append(first.beta, -0.5), [*terms, "log(sd)"], group=group)


def bspline(x: np.ndarray, knots: np.ndarray, degree: int = 3) -> np.ndarray:
    """B-spline basis by the recursion of de Boor."""
    x = np.clip(x, knots[degree], knots[-degree - 1] - 1e-12 * (knots[-1] - knots[0]))
    b = ((x[:, None] >= knots[None, :-1]) & (x[:, None] < knots[None, 1:])).astype(float)
    for d in range(1, degree + 1):
        n = len(knots) - d - 1
        left, right = knots[d : d + n] - knots[:n], knots[d + 1 : d + 1 + n] - knots[1 : 1 + n]
        a = np.where(left > 0, (x[:, None] - knots[None, :n]) / np.where(left > 0, left, 1), 0)
        c = np.where(right > 0, (knots[None, d + 1 : d + 1 + n] - x[:, None]) / np.where(right > 0, right, 1), 0)
        b = a * b[:, :n] + c * b[:, 1 : n + 1]
    return b


def gam(df: DataFrame, y: str, smooths: list[str], linear: list[str] = (), k: int = 12) -> dict:
    """Gaussian additive model: penalised splines with second-difference penalties, one smoothing parameter for each term by GCV.

    One pass for the cross products of all bases; everything after is p x p.
    """
    d = rg.complete(df.select(y, *smooths, *linear), y, *smooths, *linear)
    ends = d.agg(*[F.min(s).alias(f"a{i}") for i, s in enumerate(smooths)], *[F.max(s).alias(f"b{i}") for i, s in enumerate(smooths)]).collect()[0]
    knots = []
    for i in range(len(smooths)):
        a, b = float(ends[f"a{i}"]), float(ends[f"b{i}"])
        step = (b - a) / (k - 3)
        knots.append(a + step * np.arange(-3, k + 1))

    def design(pdf):
        parts = [np.ones((len(pdf), 1)), *[pdf[[t]].to_numpy(float) for t in linear]]
        return np.hstack(parts + [bspline(pdf[s].to_numpy(float), knots[i]) for i, s in enumerate(smooths)])

    m = 1 + len(linear) + k * len(smooths)

    def one(pdf):
        x, v = design(pdf), pdf[y].to_numpy(float)
        return np.concatenate([[len(v), v @ v], x.T @ v, (x.T @ x).ravel(), x.sum(0)])

    t = totals(d, one)
    n, yy, xy, xx, sums = t[0], t[1], t[2 : 2 + m], t[2 + m : 2 + m + m * m].reshape(m, m), t[2 + m + m * m :]
    diff = np.diff(np.eye(k), 2, axis=0)
    # identifiability: each smooth sums to zero over the data
    z = np.zeros((m, m - len(smooths)))
    z[: 1 + len(linear), : 1 + len(linear)] = np.eye(1 + len(linear))
    for i in range(len(smooths)):
        at, to = 1 + len(linear) + i * k, 1 + len(linear) + i * (k - 1)
        q = np.linalg.qr(np.concatenate([sums[at : at + k, None], np.eye(k)[:, : k - 1]], 1))[0]
        z[at : at + k, to : to + k - 1] = q[:, 1:]
    xx, xy = z.T @ xx @ z, z.T @ xy
    pens = []
    for i in range(len(smooths)):
        pen = np.zeros((m, m))
        at = 1 + len(linear) + i * k
        pen[at : at + k, at : at + k] = diff.T @ diff
        pens.append(z.T @ pen @ z)

    def solve(log_lam):
        a = xx + sum(math.exp(v) * s for v, s in zip(log_lam, pens)) + 1e-10 * np.eye(len(xx)) * np.trace(xx) / len(xx)
        inv = np.linalg.inv(a)
        b = inv @ xy
        edf = float(np.trace(inv @ xx))
        rss = float(yy - 2 * b @ xy + b @ xx @ b)
        return n * rss / (n - edf) ** 2, b, inv, edf, rss

    lam = np.zeros(len(smooths))
    for _ in range(4):  # coordinate search on a grid that narrows
        for i in range(len(smooths)):
            grid = lam[i] + np.linspace(-8, 12, 41) if _ == 0 else lam[i] + np.linspace(-1, 1, 21) / 2**_
            lam[i] = grid[int(np.argmin([solve(np.concatenate([lam[:i], [g], lam[i + 1 :]]))[0] for g in grid]))]
    gcv, b, inv, edf, rss = solve(lam)
    s2 = rss / (n - edf)
    coef = z @ b
    spans = {s: slice(1 + len(linear) + i * k, 1 + len(linear) + (i + 1) * k) for i, s in enumerate(smooths)}
    return {"coef": coef, "cov": z @ inv @ z.T * s2, "edf": edf, "gcv": gcv, "sigma2": s2, "lambda": np.exp(lam), "knots": dict(zip(smooths, knots)), "spans": spans, "n": int(n), "curve": lambda s, x: bspline(np.asarray(x, float), knots[smooths.index(s)]) @ coef[spans[s]]}


def loess(df: DataFrame, x: str, y: str, by: list[str], span: float = 0.75, degree: int = 1, points: int = 50) -> DataFrame:
    """Local regression with tricube weights at evenly spaced points of each series."""
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in by] + ["x double, fitted double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        at = np.linspace(a.min(), a.max(), points)
        q = max(degree + 1, int(math.ceil(span * len(a))))
        out = []
        for t in at:
            far = np.abs(a - t)
            h = max(np.partition(far, min(q, len(a)) - 1)[min(q, len(a)) - 1], 1e-12)
            w = np.clip(1 - (far / h) ** 3, 0, None) ** 3
            z = np.vander(a - t, degree + 1, increasing=True)
            s = np.sqrt(w)[:, None]
            out.append(np.linalg.lstsq(s * z, s[:, 0] * b, rcond=None)[0][0])
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * points for c in by}, "x": at, "fitted": out})

    return rg.complete(df.select(*by, x, y), x, y).groupBy(*by).applyInPandas(run, schema)


def kernel_regression(df: DataFrame, x: str, y: str, by: list[str], bandwidth: float, points: int = 50) -> DataFrame:
    """Nadaraya-Watson means with a Gaussian kernel."""
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in by] + ["x double, fitted double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        at = np.linspace(a.min(), a.max(), points)
        w = np.exp(-((at[:, None] - a[None, :]) ** 2) / (2 * bandwidth**2))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * points for c in by}, "x": at, "fitted": (w @ b) / np.maximum(w.sum(1), 1e-300)})

    return rg.complete(df.select(*by, x, y), x, y).groupBy(*by).applyInPandas(run, schema)


def sem(cov: np.ndarray, n: int, a_free: dict, s_free: dict, observed: list[int], size: int, a_fixed: dict = (), s_fixed: dict = (), rounds: int = 500) -> dict:
    """Structural equations in reticular form by maximum likelihood from a covariance matrix: free and fixed entries of paths A and covariances S."""
    names = [*a_free, *s_free]
    pick = np.zeros((len(observed), size))
    pick[np.arange(len(observed)), observed] = 1

    def implied(x):
        a, s = np.zeros((size, size)), np.zeros((size, size))
        for (i, j), v in dict(a_fixed).items():
            a[i, j] = v
        for (i, j), v in dict(s_fixed).items():
            s[i, j] = s[j, i] = v
        for (i, j), v in zip(a_free, x[: len(a_free)]):
            a[i, j] = v
        for (i, j), v in zip(s_free, x[len(a_free) :]):
            s[i, j] = s[j, i] = v
        b = np.linalg.inv(np.eye(size) - a)
        return pick @ b @ s @ b.T @ pick.T

    base = np.linalg.slogdet(cov)[1] + len(observed)

    def loss(x):
        m = implied(x)
        sign, logdet = np.linalg.slogdet(m)
        if sign <= 0 or np.linalg.eigvalsh(m)[0] <= 0:
            return 1e6
        return float(logdet + np.trace(np.linalg.solve(m, cov)) - base)

    def gradient(x):
        h = 1e-6
        return np.array([(loss(x + h * e) - loss(x - h * e)) / (2 * h) for e in np.eye(len(x))])

    x = np.array([*a_free.values(), *s_free.values()], float)
    inverse, g = np.eye(len(x)) * 0.1, gradient(x)
    for _ in range(rounds):
        step, t = -inverse @ g, 1.0
        while loss(x + t * step) > loss(x) + 1e-4 * t * (g @ step) and t > 1e-10:
            t /= 2
        new = x + t * step
        g2 = gradient(new)
        s, y = new - x, g2 - g
        if s @ y > 1e-14:
            r = 1 / (s @ y)
            m = np.eye(len(x)) - r * np.outer(s, y)
            inverse = m @ inverse @ m.T + r * np.outer(s, s)
        x, g = new, g2
        if np.abs(g).max() < 1e-7:
            break
    h = 1e-4
    hess = np.array([(gradient(x + h * e) - gradient(x - h * e)) / (2 * h) for e in np.eye(len(x))])
    se = np.sqrt(np.clip(np.diag(np.linalg.pinv(hess * (n - 1) / 2)), 0, None))
    k = len(observed)
    df_ = k * (k + 1) // 2 - len(x)
    chi2 = (n - 1) * loss(x)
    return {"estimates": dict(zip(names, x)), "se": dict(zip(names, se)), "chi2": chi2, "df": df_, "p_value": float(sp.chi2_sf(chi2, df_)) if df_ else float("nan")}

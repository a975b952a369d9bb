"""Time series and survival."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from statloom.functions import pvalues as pv
from statloom.functions import special as sp
from statloom.operators import ordered as od
from statloom.operators import regression as rg
from statloom.operators.multiplicity import finite
from statloom.session import materialize


def difference(df: DataFrame, by: list[str], time: str, value: str, lag: int = 1, name: str = "diff") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value, lag).over(W.partitionBy(*by).orderBy(time)))


def autocorrelation(df: DataFrame, by: list[str], time: str, value: str, lags: int = 10) -> DataFrame:
    """(by, lag, acf, n): biased autocorrelations, all lags in one window pass and one aggregate."""
    d = df.withColumn("_v", finite(value))
    m = d.groupBy(*by).agg(F.avg("_v").alias("_m"))
    d = d.join(m, by).withColumn("_c", F.col("_v") - F.col("_m"))
    w = W.partitionBy(*by).orderBy(time)
    d = d.select(*by, "_c", *[F.lag("_c", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    s = d.groupBy(*by).agg(F.count("_c").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_s"), *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.coalesce(f"_s{k}", F.lit(0.0)), "_s").alias("acf")) for k in range(1, lags + 1)])
    return s.select(*by, "n", F.inline(rows))


def partial_autocorrelation(acf: DataFrame, by: list[str]) -> DataFrame:
    """Durbin-Levinson on the autocorrelations of each series."""
    schema = ", ".join([f"`{c}` {dict(acf.dtypes)[c]}" for c in by] + ["lag int, pacf double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = pdf["acf"].to_numpy(float)
        phi, out = np.zeros(0), []
        for k in range(len(r)):
            num = r[k] - (phi * r[:k][::-1]).sum()
            den = 1 - (phi * r[:k]).sum()
            a = num / den if den else np.nan
            phi = np.append(phi - a * phi[::-1], a)
            out.append(a)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(r) for c in by}, "lag": pdf["lag"].to_numpy(), "pacf": out})

    return acf.groupBy(*by).applyInPandas(run, schema)


def ljung_box(acf: DataFrame, by: list[str], parameters: int = 0) -> DataFrame:
    s = acf.groupBy(*by).agg(F.first("n").cast("double").alias("n"), F.max("lag").alias("lags"), F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).alias("_q"))
    s = s.withColumn("statistic", F.col("n") * (F.col("n") + 2) * F.col("_q")).withColumn("df", (F.col("lags") - parameters).cast("double"))
    return s.withColumn("p_value", pv.p_chi2(F.col("statistic"), F.col("df"))).drop("_q")


def _nelder_mead(fn, x0, rounds: int = 2000, tol: float = 1e-10):
    n = len(x0)
    s = np.vstack([x0, x0 + np.eye(n) * 0.1])
    f = np.array([fn(x) for x in s])
    for _ in range(rounds):
        o = np.argsort(f, kind="stable")
        s, f = s[o], f[o]
        if abs(f[-1] - f[0]) <= tol * (1 + abs(f[0])) and np.abs(s - s[0]).max() < 1e-7:
            break
        c = s[:-1].mean(0)
        r = c + (c - s[-1])
        fr = fn(r)
        if fr < f[0]:
            e = c + 2 * (c - s[-1])
            fe = fn(e)
            s[-1], f[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < f[-2]:
            s[-1], f[-1] = r, fr
        else:
            k = c + 0.5 * (s[-1] - c)
            fk = fn(k)
            if fk < f[-1]:
                s[-1], f[-1] = k, fk
            else:
                s[1:] = s[0] + 0.5 * (s[1:] - s[0])
                f[1:] = [fn(x) for x in s[1:]]
    return s[0], f[0]


def arma_loglik(y: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[float, float]:
    """Exact Gaussian log-likelihood (variance profiled out) by the Kalman filter; NaN positions are missing. Also the variance."""
    m = max(len(ar), len(ma) + 1, 1)
    t = np.zeros((m, m))
    t[: len(ar), 0] = ar
    t[:-1, 1:] = np.eye(m - 1)
    r = np.zeros(m)
    r[0] = 1
    r[1 : len(ma) + 1] = ma
    q = np.outer(r, r)
    p = np.linalg.solve(np.eye(m * m) - np.kron(t, t), q.ravel()).reshape(m, m)
    a, logs, ss, n = np.zeros(m), 0.0, 0.0, 0
    for v in y:
        if not math.isnan(v):
            f = p[0, 0]
            if f <= 0:
                return -math.inf, math.nan
            e = v - a[0]
            logs, ss, n = logs + math.log(f), ss + e * e / f, n + 1
            k = p[:, 0] / f
            a, p = a + k * e, p - np.outer(k, p[0])
        a, p = t @ a, t @ p @ t.T + q
    s2 = ss / n
    return -0.5 * (n * math.log(2 * math.pi * s2) + logs + n), s2


def _stationary(x: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary polynomial from unbounded numbers: partial correlations by tanh, then Durbin-Levinson."""
    phi = np.zeros(0)
    for a in np.tanh(x):
        phi = np.append(phi - a * phi[::-1], a)
    return phi


def arima(df: DataFrame, by: list[str], time: str, value: str, order: tuple[int, int, int] = (1, 0, 0), horizon: int = 0) -> DataFrame:
    """Exact ARIMA(p, d, q) with a mean (if d = 0) by series; coefficients, variance, log-likelihood, AICc and forecasts."""
    p, d, q = order
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in by] + ["n long, ar array<double>, ma array<double>, mean double, sigma2 double, loglik double, aicc double, forecast array<double>"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(time)[value].to_numpy(float)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, **{k: [v] for k, v in fit_arima(y, p, d, q, horizon).items()}})

    return df.select(*by, time, value).groupBy(*by).applyInPandas(run, schema)


def fit_arima(y: np.ndarray, p: int, d: int, q: int, horizon: int = 0) -> dict:
    z = np.diff(y, d) if d else y
    mean0 = np.nanmean(z) if not d else 0.0
    scale = np.nanstd(z) or 1.0

    def unpack(x):
        return _stationary(x[:p]), -_stationary(x[p : p + q]), (mean0 + x[-1] * scale if not d else 0.0)

    def loss(x):
        ar, ma, mu = unpack(x)
        v = arma_loglik(z - mu, ar, ma)[0]
        return -v if math.isfinite(v) else 1e300

    x = np.zeros(p + q + (0 if d else 1))
    if len(x):
        x, _ = _nelder_mead(loss, x)
        x, _ = _nelder_mead(loss, x)
    ar, ma, mu = unpack(x) if len(x) else (np.zeros(0), np.zeros(0), 0.0)
    ll, s2 = arma_loglik(z - mu, ar, ma)
    n, k = int(np.isfinite(z).sum()), len(x) + 1
    aicc = -2 * ll + 2 * k + (2 * k * (k + 1) / (n - k - 1) if n > k + 1 else math.inf)
    return {"n": n, "ar": list(ar), "ma": list(ma), "mean": mu, "sigma2": s2, "loglik": ll, "aicc": aicc, "forecast": list(_forecast(y, z - mu, ar, ma, mu, d, horizon))}


def _forecast(y, z, ar, ma, mu, d, horizon):
    past, err = list(np.nan_to_num(z)), []
    for i in range(len(past)):
        hat = sum(a * past[i - k - 1] for k, a in enumerate(ar) if i > k) + sum(b * err[i - k - 1] for k, b in enumerate(ma) if i > k)
        err.append(past[i] - hat)
    out = []
    for _ in range(horizon):
        i = len(past)
        v = sum(a * past[i - k - 1] for k, a in enumerate(ar) if i > k) + sum(b * err[i - k - 1] for k, b in enumerate(ma) if i > k)
        past.append(v)
        err.append(0.0)
        out.append(v + mu)
    for k in range(d, 0, -1):
        last = np.diff(y, k - 1)[-1] if k > 1 else y[-1]
        out = list(last + np.cumsum(out))
    return out


def automatic_arima(df: DataFrame, by: list[str], time: str, value: str, most: tuple[int, int, int] = (2, 1, 2)) -> DataFrame:
    """The order of least AICc by series, over a grid; the differencing order is the one whose series has the least variance."""
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in by] + ["p int, d int, q int, aicc double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(time)[value].to_numpy(float)
        d = min(range(most[1] + 1), key=lambda k: np.nanvar(np.diff(y, k)) if k else np.nanvar(y))
        best = min(((fit_arima(y, p, d, q)["aicc"], p, q) for p in range(most[0] + 1) for q in range(most[2] + 1)))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "p": [best[1]], "d": [d], "q": [best[2]], "aicc": [best[0]]})

    return df.select(*by, time, value).groupBy(*by).applyInPandas(run, schema)


# -- survival -----------------------------------------------------------------------------------------------------------------------------


def risk_sets(df: DataFrame, time: str, event: str, terms: list[str] = (), eta=None, start: str | None = None, stratum: str | None = None) -> DataFrame:
    """At each event time of each stratum: deaths, and sums over the risk set of exp(eta), x exp(eta) and x x' exp(eta).

    Rows are first summed by time (map-side combine); the risk set is a running sum over the distinct times from the last, entries at ``start`` subtracted.
    """
    keys = [stratum] if stratum else []
    e = F.exp(eta) if eta is not None else F.lit(1.0)
    x = [F.col(t).cast("double") for t in terms]
    parts = {"r": e} | {f"x{i}": e * a for i, a in enumerate(x)} | {f"x{i}_{j}": e * a * x[j] for i, a in enumerate(x) for j in range(i, len(x))}
    dead = F.col(event).cast("int") == 1
    ends = df.groupBy(*keys, F.col(time).alias("t")).agg(F.count_if(dead).alias("deaths"), *[F.sum(v).alias(k) for k, v in parts.items()], *[F.sum(F.when(dead, v)).alias(f"d{k}") for k, v in parts.items()], *[F.sum(F.when(dead, a)).alias(f"s{i}") for i, a in enumerate(x)], F.count(F.lit(1)).alias("leaving"))
    order = [F.desc("t")]
    if start:
        begins = df.groupBy(*keys, F.col(start).alias("t")).agg(*[(-F.sum(v)).alias(k) for k, v in parts.items()], (-F.count(F.lit(1))).alias("leaving"))
        both = ends.withColumn("o", F.lit(1)).unionByName(begins.withColumn("o", F.lit(0)), allowMissingColumns=True)
        # going back in time: a row is at risk after its start, so rows that begin at t leave before t's own events are counted
        order = [F.desc("t"), F.asc("o")]
        ends = both
    run = od.running_sums(ends, {f"c{k}": F.col(k) for k in parts} | {"at_risk": F.col("leaving")}, order, keys)
    return run.filter("deaths > 0")


def kaplan_meier(df: DataFrame, time: str, event: str, by: list[str] = ()) -> DataFrame:
    """(by, t, at_risk, deaths, survival) at event times."""
    keys = list(by)
    r = df.groupBy(*keys, F.col(time).alias("t")).agg(F.count_if(F.col(event).cast("int") == 1).alias("deaths"), F.count(F.lit(1)).alias("n"))
    r = od.running_sums(r, {"at_risk": F.col("n")}, [F.desc("t")], keys).filter("deaths > 0")
    step = F.when(F.col("deaths") < F.col("at_risk"), F.log(1 - F.col("deaths") / F.col("at_risk"))).otherwise(0.0)
    r = od.running_sums(r, {"logs": step, "ended": (F.col("deaths") == F.col("at_risk")).cast("int")}, [F.asc("t")], keys)
    return r.withColumn("survival", F.when(F.col("ended") > 0, 0.0).otherwise(F.exp("logs"))).drop("n", "logs", "ended")


def cox(df: DataFrame, time: str, event: str, terms: list[str], ties: str = "efron", start: str | None = None, stratum: str | None = None, tol: float = 1e-9, max_iter: int = 30) -> rg.Fit:
    """Cox regression by Newton steps; one pass a step gives the log-likelihood, gradient and information from the risk-set sums."""
    need = [time, event, *terms, *([start] if start else [])]
    d = rg.complete(df, *need)
    centre = d.agg(*[F.avg(t).alias(f"m{i}") for i, t in enumerate(terms)]).collect()[0]
    for i, t in enumerate(terms):
        d = d.withColumn(f"_z{i}", F.col(t).cast("double") - F.lit(centre[f"m{i}"]))
    names = [f"_z{i}" for i in range(len(terms))]
    p = len(terms)
    d = materialize(d.select(time, event, *names, *([start] if start else []), *([stratum] if stratum else [])))  # one pass over the source; each step reads this
    s = d.filter(F.col(event).cast("int") == 1).agg(*[F.sum(n).alias(f"s{i}") for i, n in enumerate(names)], F.count(F.lit(1)).alias("n")).collect()[0]

    def evaluate(beta):
        eta = F.lit(0.0)
        for n, b in zip(names, beta):
            eta = eta + F.col(n) * F.lit(float(b))
        r = risk_sets(d, time, event, names, eta, start, stratum)
        # Efron: the k-th of m tied deaths sees k / m of the tied ones less
        steps = F.sequence(F.lit(0), F.col("deaths").cast("int") - 1) if ties == "efron" else F.array_repeat(F.lit(0), F.col("deaths").cast("int"))
        e = r.withColumn("k", F.explode(steps)).withColumn("f", F.col("k") / F.col("deaths"))
        less = lambda c: F.col(f"c{c}") - F.col("f") * F.col(f"d{c}")
        den = less("r")
        aggs = [F.sum(F.log(den)).alias("logs")]
        aggs += [F.sum(less(f"x{i}") / den).alias(f"g{i}") for i in range(p)]
        aggs += [F.sum(less(f"x{i}_{j}") / den - less(f"x{i}") * less(f"x{j}") / (den * den)).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]
        a = e.agg(*aggs).collect()[0]
        score = np.array([s[f"s{i}"] - a[f"g{i}"] for i in range(p)])
        ll = float(sum(b * s[f"s{i}"] for i, b in enumerate(beta)) - a["logs"])
        return ll, score, rg.gram(a, p), int(s["n"])

    beta = np.zeros(p)
    ll, g, info, events = evaluate(beta)
    null, converged = ll, False
    for _ in range(max_iter):
        step = np.linalg.solve(info, g)
        t = 1.0
        while True:
            new = evaluate(beta + t * step)
            if new[0] >= ll - 1e-10 * abs(ll) or t < 1e-8:
                break
            t /= 2
        moved = np.abs(t * step).max()
        beta, (ll, g, info, events) = beta + t * step, new
        if moved < tol * (1 + np.abs(beta).max()):
            converged = True
            break
    return rg.Fit(list(terms), beta, np.linalg.inv(info), float("inf"), events, {"loglik": ll, "null_loglik": null, "converged": converged, "lrt_p": float(sp.chi2_sf(2 * (ll - null), p))})


def log_rank(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """Log-rank test of two groups from risk-set counts."""
    levels = sorted(r[0] for r in df.select(group).distinct().limit(3).collect())
    if len(levels) != 2:
        raise ValueError("two groups are compared")
    d = df.withColumn("_g", (F.col(group) == F.lit(levels[1])).cast("double"))
    r = risk_sets(d, time, event, ["_g"])
    n, n1, m = F.col("cr"), F.col("cx0"), F.col("deaths")
    v = F.when(n > 1, m * (n1 / n) * (1 - n1 / n) * (n - m) / (n - 1)).otherwise(0.0)
    s = r.agg(F.sum(F.coalesce("s0", F.lit(0.0)) - m * n1 / n).alias("delta"), F.sum(v).alias("var"))
    s = s.withColumn("statistic", F.try_divide(F.col("delta") * F.col("delta"), F.col("var"))).withColumn("df", F.lit(1.0))
    return s.withColumn("p_value", pv.p_chi2(F.col("statistic"), F.col("df")))

"""Feature-wide models: principal components, surrogate variables, batch adjustment, moderated tests, count models, imputation.

Long rows (feature_id, sample_id, value). A design over samples is a bounded table; features are what is distributed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import pvalues as pv
from statloom.functions import special as sp
from statloom.operators.likelihood import totals
from statloom.operators.multiplicity import finite
from statloom.session import ship

#: A sample by sample matrix, where features outnumber the samples, lives on the driver up to this many samples.
MAX_SAMPLES = 20_000
#: With at most this many features, and no more of them than samples, components come from the features' side.
MAX_FEATURES = 2_048


def _rows(df: DataFrame, feature: str, sample: str, value: str, samples: list) -> DataFrame:
    """(feature_id, x): the values of a feature in the order of ``samples``, missing as NaN."""
    ship(df.sparkSession)
    place = df.sparkSession.createDataFrame([(s, i) for i, s in enumerate(samples)], f"_s {dict(df.dtypes)[sample]}, _i int")
    g = df.join(F.broadcast(place), df[sample] == place["_s"]).groupBy(F.col(feature).alias("feature_id")).agg(F.collect_list(F.struct("_i", finite(value).alias("v"))).alias("r"))
    n, kind = len(samples), dict(df.dtypes)[feature]

    def run(batches):
        for batch in batches:
            step = max(1, _CELLS // n)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = np.full((part.num_rows, n), np.nan)
                for row in range(part.num_rows):
                    i, v = part.column("r").slice(row, 1).flatten().flatten()
                    x[row, i.to_numpy()] = v.to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * n, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("feature_id"), lists], ["feature_id", "x"])

    return g.mapInArrow(run, f"feature_id {kind}, x array<double>")


#: Doubles of a matrix that a task works on at once.
_CELLS = 1_000_000


def _pieces(pdf: pd.DataFrame, n: int):
    """Some features at a time: their temporary matrices stay small however many samples there are."""
    step = max(1, _CELLS // max(n, 1))
    for at in range(0, len(pdf), step):
        yield pdf.iloc[at : at + step]


def samples_of(df: DataFrame, sample: str = "sample_id") -> list:
    return [r[0] for r in df.select(sample).distinct().orderBy(sample).collect()]


def _few(ids: list) -> list:
    if len(ids) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} samples and more than {MAX_FEATURES} features")
    return ids


def _by_sample(df: DataFrame, feature: str, sample: str, value: str, n: int) -> tuple[DataFrame, np.ndarray] | None:
    """Rows of samples over all features and the features' means, where the features' side is the smaller one."""
    names = [r[0] for r in df.select(feature).distinct().limit(MAX_FEATURES + 1).collect()]
    if len(names) > min(MAX_FEATURES, n):
        return None
    rows = _rows(df, sample, feature, value, sorted(names))

    def one(pdf):
        x = np.stack(pdf["x"])
        return np.concatenate([(~np.isnan(x)).sum(0), np.nansum(x, 0)])

    seen, sums = totals(rows, one).reshape(2, -1)
    return rows, sums / np.maximum(seen, 1)


def _centred(pdf: pd.DataFrame, means: np.ndarray) -> np.ndarray:
    return np.nan_to_num(np.stack(pdf["x"]) - means)


def _scored(rows: DataFrame, ids: list, k: int, fn) -> np.ndarray:
    """``k`` numbers for each sample, in the order of ``ids``."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"s": pdf["feature_id"], "v": list(fn(pdf))})

    place, out = {s: i for i, s in enumerate(ids)}, np.zeros((len(ids), k))
    got = rows.mapInPandas(run, f"s {dict(rows.dtypes)['feature_id']}, v array<double>").toPandas()
    if len(got):
        out[[place[s] for s in got["s"]]] = np.stack(got["v"])
    return out


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in pdf["x"]])
    m = np.nanmean(x, axis=1, keepdims=True)
    return np.where(np.isnan(x), m, x)


def pca(df: DataFrame, k: int = 10, feature: str = "feature_id", sample: str = "sample_id", value: str = "value", scale: bool = True) -> pd.DataFrame:
    """Sample scores of the leading components and their variance shares, from the Gram matrix of centred features: of the features, or of the samples if they are fewer."""
    ids = samples_of(df, sample)
    n = len(ids)
    side = _by_sample(df, feature, sample, value, n)
    if side is not None:
        rows, means = side
        m = len(means)
        gram = totals(rows, lambda pdf: (lambda x: x.T @ x)(_centred(pdf, means)).ravel()).reshape(m, m)
        sd = np.sqrt(np.diag(gram) / max(n - 1, 1)) if scale else np.ones(m)
        unit = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0)
        live = max(int((sd > 0).sum()), 1)
        gram = gram * unit * unit[:, None] / live
        vals, vecs = np.linalg.eigh(gram)
        order = np.argsort(-vals)[:k]
        turn = vecs[:, order] * unit[:, None] / math.sqrt(live)
        pc = np.zeros((n, min(k, n)))
        pc[:, : len(order)] = _scored(rows, ids, len(order), lambda pdf: _centred(pdf, means) @ turn)
        pc = pc * np.where(pc[np.abs(pc).argmax(0), np.arange(pc.shape[1])] < 0, -1, 1)
        out = pd.DataFrame({sample: ids, **{f"PC{i + 1}": pc[:, i] for i in range(pc.shape[1])}})
        out.attrs["share"] = np.pad(vals[order], (0, pc.shape[1] - len(order))) / max(gram.trace(), 1e-300)
        return out
    _few(ids)

    def one(pdf):
        x = _matrix(pdf)
        x = x - x.mean(1, keepdims=True)
        if scale:
            s = x.std(1, ddof=1, keepdims=True)
            x = x[s[:, 0] > 0] / s[s[:, 0] > 0]
        return np.concatenate([[len(x)], (x.T @ x).ravel()])

    t = totals(_rows(df, feature, sample, value, ids), one)
    vals, vecs = np.linalg.eigh(t[1:].reshape(n, n) / max(t[0], 1))
    order = np.argsort(-vals)[:k]
    vals, vecs = vals[order], vecs[:, order]
    vecs = vecs * np.where(vecs[np.abs(vecs).argmax(0), np.arange(vecs.shape[1])] < 0, -1, 1)
    out = pd.DataFrame({sample: ids, **{f"PC{i + 1}": vecs[:, i] * math.sqrt(max(vals[i], 0)) for i in range(len(order))}})
    out.attrs["share"] = vals / max((t[1:].reshape(n, n) / max(t[0], 1)).trace(), 1e-300)
    return out


def surrogate_variables(df: DataFrame, design: np.ndarray, null: np.ndarray | None = None, k: int | None = None, rounds: int = 5, feature: str = "feature_id", sample: str = "sample_id", value: str = "value", permutations: int = 20, seed: int = 1) -> np.ndarray:
    """Iteratively reweighted surrogate variables: components of features that follow hidden factors and not the design.

    ``design`` and ``null`` are rows in the order of ``samples_of``. The number of factors, if not given, is by permuted residuals of a
    bounded number of features with the smallest hash. Where features are fewer than samples all steps are algebra of their cross products.
    """
    ids = samples_of(df, sample)
    n = len(ids)
    null = np.ones((n, 1)) if null is None else null
    side = _by_sample(df, feature, sample, value, n)
    if side is None:
        _few(ids)
    rows = _rows(df, feature, sample, value, ids).persist()
    resid = lambda x, d: x - (x @ d) @ np.linalg.pinv(d.T @ d) @ d.T
    try:
        if k is None:
            head = _matrix(rows.orderBy(F.xxhash64("feature_id")).limit(2000).toPandas())
            r = resid(head, design)
            share = lambda m: (lambda s: s**2 / (s**2).sum())(np.linalg.svd(m, compute_uv=False))
            own, rng = share(r), np.random.default_rng(seed)
            top = np.zeros(len(own))
            for _ in range(permutations):
                mixed = np.stack([rng.permutation(v) for v in r])
                top += share(resid(mixed, design)) >= own
            p = np.maximum.accumulate((top + 1) / (permutations + 1))
            k = int((p <= 0.10).sum())
        if k == 0:
            return np.zeros((n, 0))
        if side is not None:
            return _surrogates_by_feature(*side, ids, design, null, k, rounds)

        def gram(weight):
            def one(pdf):
                x = _matrix(pdf)
                w = weight(x)[:, None]
                c = (x - x.mean(1, keepdims=True)) * w
                return (c.T @ c).ravel()

            vals, vecs = np.linalg.eigh(totals(rows, one).reshape(n, n))
            return vecs[:, np.argsort(-vals)[:k]]

        def f_p(x, full, small):
            a, b = (resid(x, full) ** 2).sum(1), (resid(x, small) ** 2).sum(1)
            d1, d2 = full.shape[1] - small.shape[1], n - full.shape[1]
            return sp.f_sf(((b - a) / d1) / np.maximum(a / d2, 1e-300), d1, d2)

        def r_gram():
            def one(pdf):
                c = resid(_matrix(pdf), design)
                return (c.T @ c).ravel()

            vals, vecs = np.linalg.eigh(totals(rows, one).reshape(n, n))
            return vecs[:, np.argsort(-vals)[:k]]

        sv = r_gram()
        for _ in range(rounds):
            def weight(x, sv=sv):
                hidden = f_p(x, np.hstack([null, sv]), null)
                biology = f_p(x, np.hstack([design, sv]), np.hstack([null, sv]))
                # posterior chances from uniform nulls: small p for hidden factors, large p for the design
                return np.clip(1 - hidden, 0, 1) * np.clip(biology, 0, 1)

            sv = gram(weight)
        return sv
    finally:
        rows.unpersist()


def _surrogates_by_feature(rows: DataFrame, means: np.ndarray, ids: list, design: np.ndarray, null: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """The same steps from the cross products of centred features x and of fixed columns e: every column over the samples is x' p + e q."""
    n, m, place = len(ids), len(means), {s: i for i, s in enumerate(ids)}
    e = np.hstack([np.ones((n, 1)), design, null])
    w = e.shape[1]

    def one(pdf):
        x, own = _centred(pdf, means), e[[place[s] for s in pdf["feature_id"]]]
        return np.concatenate([(x.T @ x).ravel(), (x.T @ own).ravel()])

    t = totals(rows, one)
    xx, xe, ee = t[: m * m].reshape(m, m), t[m * m :].reshape(m, w), e.T @ e
    fixed = lambda a, b: (np.zeros((m, b - a)), np.eye(w)[:, a:b])
    joined = lambda *f: tuple(np.hstack([c[i] for c in f]) for i in (0, 1))
    full0, small0 = fixed(1, 1 + design.shape[1]), fixed(1 + design.shape[1], w)
    # residuals are those of centred values where both models hold the constant
    spans = lambda d: np.allclose(d @ (np.linalg.pinv(d) @ e[:, 0]), 1, atol=1e-9)
    mu = np.zeros(m) if spans(design) and spans(null) else means

    def products(f):
        p, q = f
        return xx @ p + xe @ q + np.outer(mu, ee[0] @ q + xe[:, 0] @ p), p.T @ xx @ p + p.T @ xe @ q + q.T @ xe.T @ p + q.T @ ee @ q

    def squares(f):
        xf, ff = products(f)
        return np.maximum(np.diag(xx) + n * mu**2 - ((xf @ np.linalg.pinv(ff)) * xf).sum(1), 0)

    def root(gram):
        vals, vecs = np.linalg.eigh(gram)
        return vecs * np.sqrt(np.maximum(vals, 0))

    def leading(half):
        u, size, _ = np.linalg.svd(half)  # of the root: small weights keep their digits
        return u[:, :k] * np.where(size[:k] > 1e-14 * max(size[0], 1e-300), 1 / np.maximum(size[:k], 1e-300), 0)

    def f_p(full, small):
        a, b = squares(full), squares(small)
        d1, d2 = full[0].shape[1] - small[0].shape[1], n - full[0].shape[1]
        return sp.f_sf(((b - a) / d1) / np.maximum(a / d2, 1e-300), d1, d2)

    xd, dd = products(full0)
    back = np.linalg.pinv(dd)
    p = leading(root(xx + n * np.outer(mu, mu) - xd @ back @ xd.T))
    q = np.zeros((w, p.shape[1]))
    q[0] = mu @ p
    q[1 : 1 + design.shape[1]] -= back @ xd.T @ p
    sv, half = (p, q), root(xx)
    for _ in range(rounds):
        weight = np.clip(1 - f_p(joined(small0, sv), small0), 0, 1) * np.clip(f_p(joined(full0, sv), joined(small0, sv)), 0, 1)
        p = leading(half * weight[:, None]) * weight[:, None]
        sv = (p, np.zeros((w, p.shape[1])))
    p, q = sv
    return _scored(rows, ids, p.shape[1], lambda pdf: _centred(pdf, means) @ p + e[[place[s] for s in pdf["feature_id"]]] @ q)


def combat(df: DataFrame, batch: pd.Series, design: np.ndarray | None = None, reference=None, mean_only: bool = False, feature: str = "feature_id", sample: str = "sample_id", value: str = "value") -> DataFrame:
    """Empirical Bayes batch adjustment. ``batch`` is indexed by sample; ``design`` (without intercept) is kept. Result: (feature_id, sample_id, value).

    Features without variance in a batch pass through; a batch of one sample forces means only. Variances divide by n.
    """
    ids = samples_of(df, sample)
    lab = np.array([batch[s] for s in ids])
    levels = sorted(set(lab.tolist()))
    n = len(ids)
    ind = np.stack([(lab == b).astype(float) for b in levels], 1)
    full = np.hstack([ind] + ([design] if design is not None else []))
    sizes = ind.sum(0)
    mean_only = mean_only or sizes.min() < 2
    rows = _rows(df, feature, sample, value, ids)
    inv = np.linalg.pinv(full)
    ref = levels.index(reference) if reference is not None else None

    def standard(x):
        b = x @ inv.T
        grand = b[:, [ref]] if ref is not None else (b[:, : len(levels)] @ (sizes / n))[:, None]
        kept = b[:, len(levels) :] @ full[:, len(levels) :].T if design is not None else 0.0
        e = x - b @ full.T
        var = (e[:, lab == levels[ref]] ** 2).mean(1) if ref is not None else (e**2).mean(1)
        base = grand + kept
        ok = (var > 0) & np.all([x[:, lab == v].std(1) > 0 for v in levels if (lab == v).sum() > 1], axis=0)
        z = np.where(ok[:, None], (x - base) / np.sqrt(np.where(ok, var, 1))[:, None], 0)
        gamma = np.stack([z[:, lab == v].mean(1) for v in levels], 1)
        delta = np.stack([z[:, lab == v].var(1, ddof=1) if (lab == v).sum() > 1 else np.ones(len(z)) for v in levels], 1)
        return z, base, np.sqrt(np.where(ok, var, 1)), gamma, delta, ok

    def moments(pdf):
        total = 0
        for piece in _pieces(pdf, n):
            _, _, _, g, d, ok = standard(_matrix(piece))
            g, d = g[ok], d[ok]
            total = total + np.concatenate([[ok.sum()], g.sum(0), (g * g).sum(0), d.sum(0), (d * d).sum(0)])
        return total

    t, k = totals(rows, moments), len(levels)
    m = t[0]
    g1, d1 = t[1 : k + 1] / m, t[2 * k + 1 : 3 * k + 1] / m
    g2, d2 = (t[k + 1 : 2 * k + 1] - m * g1**2) / (m - 1), np.maximum((t[3 * k + 1 :] - m * d1**2) / (m - 1), 1e-12)
    a, b = (2 * d2 + d1**2) / d2, (d1 * d2 + d1**3) / d2
    kind, skind = dict(df.dtypes)[feature], dict(df.dtypes)[sample]

    names = np.array(ids, dtype=object if skind == "string" else None)

    def adjust(batches):
        for pdf in (piece for whole in batches for piece in _pieces(whole, n)):
            x = _matrix(pdf)
            z, base, sd, gamma, delta, ok = standard(x)
            out = z.copy()
            for i, v in enumerate(levels):
                if i == ref:
                    continue
                own = lab == v
                ni, g, d = own.sum(), gamma[:, i].copy(), delta[:, i].copy()
                if mean_only:
                    g, d = (ni * g2[i] * gamma[:, i] + g1[i]) / (ni * g2[i] + 1), np.ones(len(z))
                else:
                    for _ in range(200):
                        gn = (ni * g2[i] * gamma[:, i] + d * g1[i]) / (ni * g2[i] + d)
                        dn = (0.5 * ((z[:, own] - gn[:, None]) ** 2).sum(1) + b[i]) / (ni / 2 + a[i] - 1)
                        done = max(np.abs(gn - g).max(initial=0), np.abs(dn - d).max(initial=0)) < 1e-8
                        g, d = gn, dn
                        if done:
                            break
                out[:, own] = (z[:, own] - g[:, None]) / np.sqrt(d)[:, None]
            y = np.where(ok[:, None], out * sd[:, None] + base, x)
            if ref is not None:
                y[:, lab == levels[ref]] = x[:, lab == levels[ref]]
            yield pd.DataFrame({"feature_id": np.repeat(pdf["feature_id"].to_numpy(), n), "sample_id": np.tile(names, len(pdf)), "value": y.ravel()})

    return rows.mapInPandas(adjust, f"feature_id {kind}, sample_id {skind}, value double")


def _trigamma_inverse(x: float) -> float:
    y = 0.5 + 1 / x
    for _ in range(60):
        t = float(sp.trigamma(y))
        h = 1e-5 * y
        step = t * (1 - t / x) / float((sp.trigamma(y + h) - sp.trigamma(y - h)) / (2 * h))
        y += step
        if abs(step) < 1e-10 * y:
            break
    return y


def variance_prior(mean_log: float, var_log: float, df: float) -> tuple[float, float]:
    """(d0, s0^2) of a scaled F of sample variances from the mean and variance of their logs; 1e6 df where they vary less than chance."""
    e = mean_log - float(sp.digamma(df / 2)) + math.log(df / 2)
    extra = var_log - float(sp.trigamma(df / 2))
    if extra <= 0:
        return 1e6, math.exp(e)
    d0 = 2 * _trigamma_inverse(extra)
    return d0, math.exp(e + float(sp.digamma(d0 / 2)) - math.log(d0 / 2))


def moderated(df: DataFrame, design: np.ndarray, coef: int, feature: str = "feature_id", sample: str = "sample_id", value: str = "value", weights: DataFrame | None = None) -> DataFrame:
    """Least squares by feature with variances shrunk to a common prior: effect, t, df, p. Two passes: the prior's moments, then the tests."""
    ids = samples_of(df, sample)
    rows = _rows(df, feature, sample, value, ids)
    if weights is not None:
        rows = rows.join(_rows(weights, feature, sample, "weight", ids).withColumnRenamed("x", "w"), "feature_id")
    return _moderated(rows, design, coef)


def _moderated(rows: DataFrame, design: np.ndarray, coef: int) -> DataFrame:
    """``rows`` (feature_id, x) in the order of the design's rows, optionally with weights w."""
    n, p = design.shape
    dof = n - p
    kind = dict(rows.dtypes)["feature_id"]

    def fits(pdf):
        parts = [some(piece) for piece in _pieces(pdf, n)]
        return tuple(np.concatenate([part[i] for part in parts]) for i in range(3))

    def some(pdf):
        x = _matrix(pdf)
        if "w" not in pdf:
            inv = np.linalg.inv(design.T @ design)
            b = x @ design @ inv
            return b[:, coef], ((x - b @ design.T) ** 2).sum(1) / dof, np.full(len(x), inv[coef, coef])
        eff, s2, u = [], [], []
        for v, w in zip(x, pdf["w"]):
            w = np.asarray(w, float)
            inv = np.linalg.inv(design.T @ (w[:, None] * design))
            b = inv @ design.T @ (w * v)
            eff.append(b[coef])
            s2.append((w * (v - design @ b) ** 2).sum() / dof)
            u.append(inv[coef, coef])
        return np.array(eff), np.array(s2), np.array(u)

    def logs(pdf):
        _, s2, _ = fits(pdf)
        z = np.log(s2[s2 > 0])
        return np.array([len(z), z.sum(), (z * z).sum()])

    t = totals(rows, logs)
    d0, s0 = variance_prior(t[1] / t[0], (t[2] - t[1] ** 2 / t[0]) / (t[0] - 1), dof)

    def run(batches):
        for pdf in batches:
            eff, s2, u = fits(pdf)
            post = (d0 * s0 + dof * s2) / (d0 + dof)
            stat = eff / np.sqrt(post * u)
            yield pd.DataFrame({"feature_id": pdf["feature_id"], "effect": eff, "statistic": stat, "df": d0 + dof, "p_value": np.exp(sp.t_logsf2(stat, d0 + dof))})

    return rows.mapInPandas(run, f"feature_id {kind}, effect double, statistic double, df double, p_value double")


def size_factors(df: DataFrame, feature: str = "feature_id", sample: str = "sample_id", value: str = "value") -> DataFrame:
    """Median over features seen everywhere of count / geometric mean, by sample."""
    n = df.select(sample).distinct().count()
    g = df.filter(F.col(value) > 0).groupBy(feature).agg(F.avg(F.log(value)).alias("_m"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n)
    return df.join(g, feature).groupBy(sample).agg(F.exp(F.percentile(F.log(value) - F.col("_m"), F.lit(0.5))).alias("size_factor"))


def voom(df: DataFrame, design: np.ndarray, coef: int, feature: str = "feature_id", sample: str = "sample_id", value: str = "value") -> DataFrame:
    """Moderated tests of log counts per million with precision weights 1 / trend(mean log count)^4 of the root standard deviation."""
    ids = samples_of(df, sample)
    lib = df.groupBy(sample).agg(F.sum(value).cast("double").alias("_lib"))
    log = df.join(lib, sample).select(feature, sample, F.log2((F.col(value) + 0.5) * 1e6 / (F.col("_lib") + 1)).alias("value"))
    size = {r[sample]: r["_lib"] for r in lib.collect()}
    libs = np.array([size[s] for s in ids])
    n, p = design.shape
    inv = np.linalg.inv(design.T @ design)
    rows = _rows(log, feature, sample, "value", ids)
    shift = np.log2(libs + 1).mean() - math.log2(1e6)

    # the trend: mean root deviation in bins of mean log count, by sums
    def sums(pdf):
        total = np.zeros(600)
        for piece in _pieces(pdf, n):
            x = _matrix(piece)
            s = np.sqrt(np.sqrt(((x - x @ design @ inv @ design.T) ** 2).sum(1) / (n - p)))
            at = np.clip(((x.mean(1) + shift + 20) * 5).astype(int), 0, 299)
            total += np.concatenate([np.bincount(at, minlength=300), np.bincount(at, weights=s, minlength=300)])
        return total

    t = totals(rows, sums)
    count, total = t[:300], t[300:]
    live = np.flatnonzero(count)
    centre = (live + 0.5) / 5 - 20
    y = np.array([(count[live] * np.exp(-((centre - c) ** 2) / 2) @ (total[live] / count[live])) / (count[live] @ np.exp(-((centre - c) ** 2) / 2)) for c in centre])
    def weigh(batches):
        for pdf in (piece for whole in batches for piece in _pieces(whole, n)):
            x = _matrix(pdf)
            fitted = x @ design @ inv @ design.T + np.log2(libs + 1) - math.log2(1e6)
            yield pd.DataFrame({"feature_id": pdf["feature_id"], "x": pdf["x"], "w": list(1 / np.interp(fitted, centre, y) ** 4)})

    return _moderated(rows.mapInPandas(weigh, f"feature_id {dict(df.dtypes)[feature]}, x array<double>, w array<double>"), design, coef)


def nb_differential(df: DataFrame, design: np.ndarray, coef: int, feature: str = "feature_id", sample: str = "sample_id", value: str = "value", tol: float = 1e-8, rounds: int = 100) -> DataFrame:
    """Negative binomial tests by feature: moment dispersions shrunk on the log scale, IRLS with size-factor offsets, normal p."""
    ids = samples_of(df, sample)
    f = {r[sample]: r["size_factor"] for r in size_factors(df, feature, sample, value).collect()}
    offset = np.log(np.array([f.get(s, 1.0) for s in ids]))
    n, p = design.shape
    rows = _rows(df, feature, sample, value, ids)
    kind = dict(df.dtypes)[feature]

    def dispersion(x):
        scaled = x / np.exp(offset)
        mu = scaled.mean(1)
        noise = mu * np.exp(-offset).mean()
        return np.maximum(1e-8, (scaled.var(1, ddof=1) - noise) / np.maximum(mu, 1e-12) ** 2)

    def logs(pdf):
        z = np.concatenate([np.log(dispersion(_matrix(piece))) for piece in _pieces(pdf, n)])
        return np.array([len(z), z.sum(), (z * z).sum()])

    t = totals(rows, logs)
    mean, var = t[1] / t[0], max((t[2] - t[1] ** 2 / t[0]) / max(t[0] - 1, 1), 1e-12)
    noise = float(sp.trigamma((n - p) / 2))
    shrink = max(var - noise, 0.0) / var

    def run(batches):
        for pdf in (piece for whole in batches for piece in _pieces(whole, n)):
            x = _matrix(pdf)
            alpha = np.exp(mean + shrink * (np.log(dispersion(x)) - mean))
            out = []
            for v, a in zip(x, alpha):
                b = np.zeros(p)
                b[0] = math.log(max(v.mean(), 0.1))
                ok = False
                for _ in range(rounds):
                    eta = design @ b + offset
                    if np.abs(eta).max() >= 30:
                        break
                    mu = np.exp(eta)
                    w = mu / (1 + a * mu)
                    inv = np.linalg.pinv(design.T @ (w[:, None] * design))
                    step = inv @ design.T @ (w * (v - mu) / mu)
                    b = b + step
                    if np.abs(step).max() < tol * (1 + np.abs(b).max()):
                        ok = True
                        break
                se = math.sqrt(inv[coef, coef]) if ok else math.nan
                out.append((b[coef], se, b[coef] / se) if ok and se > 0 else (math.nan,) * 3)
            e, s, z = np.array(out).T
            yield pd.DataFrame({"feature_id": pdf["feature_id"], "effect": e, "se": s, "statistic": z, "dispersion": alpha, "p_value": np.where(np.isnan(z), np.nan, 2 * sp.normal_sf(np.abs(np.nan_to_num(z))))})

    return rows.mapInPandas(run, f"feature_id {kind}, effect double, se double, statistic double, dispersion double, p_value double")


def impute(df: DataFrame, columns: list[str], m: int = 5, rounds: int = 10, donors: int = 5, seed: int = 1) -> DataFrame:
    """Chained equations with predictive mean matching: ``m`` completed copies of a bounded table, one task each (column ``imputation``)."""
    copies = df.withColumn("imputation", F.explode(F.sequence(F.lit(1), F.lit(m))))
    schema = copies.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(pdf["imputation"].iloc[0])])
        x = pdf[columns].to_numpy(float)
        miss = np.isnan(x)
        for j in range(len(columns)):
            if miss[:, j].any():
                x[miss[:, j], j] = rng.choice(x[~miss[:, j], j], miss[:, j].sum())
        for _ in range(rounds):
            for j in range(len(columns)):
                if not miss[:, j].any():
                    continue
                z = np.hstack([np.ones((len(x), 1)), np.delete(x, j, 1)])
                seen = np.flatnonzero(~miss[:, j])
                own = rng.choice(seen, len(seen))
                a = z[own].T @ z[own]
                b = np.linalg.solve(a + 1e-5 * np.diag(np.diag(a) + 1e-12), z[own].T @ x[own, j])
                hat = z @ b
                order = seen[np.argsort(hat[seen], kind="stable")]
                at = np.searchsorted(hat[order], hat[miss[:, j]])
                low = np.clip(at - donors // 2, 0, max(0, len(order) - donors))
                pick = low + rng.integers(0, min(donors, len(order)), len(low))
                x[miss[:, j], j] = x[order[pick], j]
        return pdf.assign(**{c: x[:, j] for j, c in enumerate(columns)})

    return copies.groupBy("imputation").applyInPandas(run, schema)


def kinship(pedigree: DataFrame, max_depth: int = 64) -> DataFrame:
    """Kinship coefficients (a, b, value), a <= b, of related pairs: from founders down, generation by generation, by joins on parents."""
    from statloom.session import materialize

    p = pedigree.select("id", "sire", "dam")
    depth = materialize(p.filter("sire is null and dam is null").select("id", F.lit(0).alias("g")))
    known = depth
    for g in range(1, max_depth):
        up = p.join(known.select(F.col("id").alias("sire"), F.col("g").alias("gs")), "sire", "left").join(known.select(F.col("id").alias("dam"), F.col("g").alias("gd")), "dam", "left")
        ready = up.filter("(sire is null or gs is not null) and (dam is null or gd is not null)").join(known, "id", "left_anti").select("id", F.lit(g).alias("g"))
        ready = materialize(ready)
        if not ready.limit(1).count():
            break
        known = materialize(known.unionByName(ready))
    if known.count() < p.count():
        raise ValueError("the pedigree has a cycle or is too deep")
    half = lambda a, b, v: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), v)
    k = materialize(known.filter("g = 0").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.5).alias("value")))
    top = known.agg(F.max("g")).collect()[0][0]
    for g in range(1, (top or 0) + 1):
        new = p.join(known.filter(F.col("g") == g).select("id"), "id")
        both = k.filter("a <> b").select(F.col("b").alias("x"), F.col("a").alias("y"), "value").unionByName(k.select(F.col("a").alias("x"), F.col("b").alias("y"), "value"))
        parents = new.select("id", F.explode(F.array_compact(F.array("sire", "dam"))).alias("x"))
        with_old = parents.join(both, "x").groupBy("id", "y").agg((F.sum("value") / 2).alias("value"))
        own = new.join(both.select(F.col("x").alias("sire"), F.col("y").alias("dam"), F.col("value").alias("v")), ["sire", "dam"], "left").select("id", (F.lit(0.5) * (1 + F.coalesce("v", F.lit(0.0)))).alias("value"))
        # two of one generation: through both pairs of parents
        left = with_old.select(F.col("id").alias("i"), F.col("y").alias("x"), "value")
        sibs = left.join(parents.select(F.col("id").alias("j"), "x"), "x").filter("i < j").groupBy("i", "j").agg((F.sum("value") / 2).alias("value"))
        k = materialize(k.unionByName(with_old.select(*half(F.col("id"), F.col("y"), F.col("value")))).unionByName(own.select(F.col("id").alias("a"), F.col("id").alias("b"), "value")).unionByName(sibs.select(*half(F.col("i"), F.col("j"), F.col("value")))))
    return k


def pca_frame(df: DataFrame, **options) -> DataFrame:
    return df.sparkSession.createDataFrame(pca(df, **options))


def p_from_z(z):
    return pv.p_normal(z)

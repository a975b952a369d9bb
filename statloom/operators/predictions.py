"""Estimands from fitted models, and scores trained on one table and applied to another."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import special as sp
from statloom.operators import regression as rg


def _standardised(df: DataFrame, fit: rg.Fit, fam: rg.Family, settings: list[dict], beta_points: list[np.ndarray]) -> np.ndarray:
    """Mean expected response with columns held at each setting, at each coefficient vector; one pass."""
    cols = []
    for i, s in enumerate(settings):
        for j, b in enumerate(beta_points):
            eta = F.lit(0.0)
            for t, v in zip(fit.terms, b):
                x = F.lit(float(s[t])) if t in s else rg._col(t)
                eta = eta + x * F.lit(float(v))
            cols.append(F.avg(fam.mean(eta)).alias(f"m{i}_{j}"))
    r = df.agg(*cols).collect()[0]
    return np.array([[r[f"m{i}_{j}"] for j in range(len(beta_points))] for i in range(len(settings))])


def contrast(df: DataFrame, fit: rg.Fit, family: str | rg.Family, first: dict, second: dict | None = None, kind: str = "difference", alpha: float = 0.05) -> dict:
    """Expected response at ``first``, or its difference or ratio with ``second``; delta-method SE, ratios on the log scale."""
    fam = rg.family_of(family)
    settings = [first] + ([second] if second is not None else [])
    h = 1e-5 * np.maximum(1.0, np.abs(fit.beta))
    eye = np.eye(len(fit.beta))
    points = [fit.beta, *[fit.beta + s * h[i] * eye[i] for i in range(len(fit.beta)) for s in (1, -1)]]
    m = _standardised(df, fit, fam, settings, points)
    if second is None:
        v = m[0]
    else:
        v = np.log(m[0] / m[1]) if kind == "ratio" else m[0] - m[1]
    grad = np.array([(v[1 + 2 * i] - v[2 + 2 * i]) / (2 * h[i]) for i in range(len(h))])
    se = float(np.sqrt(grad @ np.nan_to_num(fit.cov) @ grad))
    q = float(sp.normal_ppf(1 - alpha / 2)) * se
    out = {"estimate": float(v[0]), "se": se, "ci_low": float(v[0] - q), "ci_high": float(v[0] + q), "statistic": float(v[0]) / se if se else math.nan}
    if kind == "ratio" and second is not None:
        out |= {"ratio": math.exp(out["estimate"]), "ratio_low": math.exp(out["ci_low"]), "ratio_high": math.exp(out["ci_high"])}
    out["p_value"] = float(2 * sp.normal_sf(abs(out["statistic"])))
    return out


def train_score(df: DataFrame, y: str, predictors: list[str], alpha: float = 0.0, folds: int = 5, key: str = "sample", n_lambda: int = 50) -> dict:
    """Elastic-net weights at the penalty of least cross-validated error; folds by the hash of the key.

    Each fold's path needs one pass over the others' rows; errors of the whole path are one aggregate over the fold's own.
    """
    d = df.withColumn("_fold", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)))
    whole = rg.penalized_path(d, y, predictors, alpha, n_lambda=n_lambda, ratio=1e-4)
    lambdas = list(whole["lambda"])
    errors = np.zeros(len(lambdas))
    for k in range(folds):
        path = rg.penalized_path(d.filter(F.col("_fold") != k), y, predictors, alpha, lambdas)
        cols = []
        for i, (_, r) in enumerate(path.iterrows()):
            e = F.col(y).cast("double") - F.lit(float(r[rg.ONE]))
            for p in predictors:
                e = e - F.col(p).cast("double") * F.lit(float(r[p]))
            cols.append(F.sum(e * e).alias(f"e{i}"))
        got = d.filter(F.col("_fold") == k).agg(*cols).collect()[0]
        errors += np.array([got[f"e{i}"] or 0.0 for i in range(len(lambdas))])
    best = int(errors.argmin())
    return {"lambda": lambdas[best], "intercept": float(whole[rg.ONE].iloc[best]), "weights": {p: float(whole[p].iloc[best]) for p in predictors}, "cv_error": errors / df.count()}


def apply_score(df: DataFrame, model: dict, name: str = "score") -> DataFrame:
    out = F.lit(model["intercept"])
    for p, w in model["weights"].items():
        out = out + F.col(p).cast("double") * F.lit(w)
    return df.withColumn(name, out)


def as_frame(spark, result: dict) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame([{k: float(v) for k, v in result.items() if np.isscalar(v)}]))

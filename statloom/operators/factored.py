"""Least squares from an orthogonal factor instead of cross products, and several outcomes on shared predictors.

The triangular factor of a tall table is found in two levels: every task factors its own rows batch by batch, and groups of tasks factor the stacked
triangles, so that what reaches the driver is at most ``GROUPS`` triangles of (terms + outcomes) squared, whatever the number of rows.
Digits are those of the columns, not of their squares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import special as sp
from statloom.operators import regression as rg

GROUPS = 16


def triangle(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """(R, rows): R'R equals the cross products of the columns (``(Intercept)`` is one everywhere) over the rows."""
    k = len(columns)

    def shrink(a: np.ndarray) -> np.ndarray:
        return np.linalg.qr(a, mode="r") if len(a) > k else a

    def factor(batches):
        kept, n = np.zeros((0, k)), 0
        for b in batches:
            kept, n = shrink(np.vstack([kept, b.to_numpy(float)])), n + len(b)
        if n:
            yield pd.DataFrame({"n": [n], "r": [kept.ravel().tolist()]})

    def stack(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = np.zeros((0, k))
        for r in pdf["r"]:
            kept = shrink(np.vstack([kept, np.asarray(r, float).reshape(-1, k)]))
        return pd.DataFrame({"n": [pdf["n"].sum()], "r": [kept.ravel().tolist()]})

    schema = "n long, r array<double>"
    parts = df.select(*[rg._col(c).alias(f"c{i}") for i, c in enumerate(columns)]).mapInPandas(factor, schema)
    parts = parts.withColumn("g", F.spark_partition_id() % GROUPS).groupBy("g").applyInPandas(lambda pdf: stack(pdf[["n", "r"]]), schema)
    got = parts.collect()  # at most GROUPS rows
    kept = np.vstack([np.asarray(r["r"], float).reshape(-1, k) for r in got]) if got else np.zeros((0, k))
    return np.linalg.qr(kept, mode="r"), int(sum(r["n"] for r in got))


def min_norm(df: DataFrame, y: str, terms: list[str]) -> rg.Fit:
    """Least squares of least norm: singular values up to max(rows, terms) * eps * the largest count as zero.

    With full rank this is ordinary least squares; otherwise coefficients of aliased terms share their effect instead of being left out, and the covariance
    is that of the estimable part. Rows with a missing or non-finite value are left out; a table without rows is an error.
    """
    d = rg.complete(df, y, *terms)
    r, n = triangle(d, [*terms, y])
    if not n:
        raise ValueError("no complete rows")
    p = len(terms)
    u, s, vt = np.linalg.svd(r[:, :p], full_matrices=False)
    live = s > max(n, p) * np.finfo(float).eps * (s.max() if len(s) else 0.0)
    rank = int(live.sum())
    back = vt[live].T / s[live]
    beta = back @ (u[:, live].T @ r[:, p])
    rss = float(np.sum((r[:, p] - r[:, :p] @ beta) ** 2))
    dof = n - rank
    sigma2 = rss / dof if dof > 0 else float("nan")
    return rg.Fit(list(terms), beta, sigma2 * back @ back.T, float(dof), n, {"rank": rank, "rss": rss, "sigma2": sigma2, "singular_values": s})


@dataclass
class MultiFit:
    """Coefficients (terms x outcomes), the residual covariance of the outcomes, and the inverse cross products of the terms."""

    terms: list[str]
    outcomes: list[str]
    beta: np.ndarray
    residual_cov: np.ndarray
    inverse: np.ndarray
    n: int
    df: float

    def table(self) -> pd.DataFrame:
        """(outcome, term, estimate, se, statistic, p_value): the rows of one fit for each outcome."""
        fits = [rg.Fit(self.terms, self.beta[:, j], self.inverse * self.residual_cov[j, j], self.df, self.n).table().assign(outcome=o) for j, o in enumerate(self.outcomes)]
        return pd.concat(fits, ignore_index=True)[["outcome", "term", "estimate", "se", "statistic", "p_value"]]

    def covariance_table(self) -> pd.DataFrame:
        """(a, b, covariance): residual covariances of the outcomes, a <= b in the order given."""
        rows = [(a, b, self.residual_cov[i, j]) for i, a in enumerate(self.outcomes) for j, b in enumerate(self.outcomes) if i <= j]
        return pd.DataFrame(rows, columns=["a", "b", "covariance"])


def multivariate(df: DataFrame, outcomes: list[str], terms: list[str]) -> MultiFit:
    """Least squares of several outcomes on shared terms in one pass; rows complete in all of them count. Aliased terms and too few rows are errors."""
    d = rg.complete(df, *outcomes, *terms)
    p = len(terms)
    r, n = triangle(d, [*terms, *outcomes])
    if n <= p:
        raise ValueError("more complete rows than terms are needed")
    x, z = r[:p, :p], r[:p, p:]
    size = np.abs(np.diag(x))
    if (size <= max(n, p) * np.finfo(float).eps * np.linalg.norm(r[:, :p], axis=0)).any():
        raise ValueError("terms are linearly dependent")
    inv = np.linalg.inv(x)
    left = r[p:, p:]
    return MultiFit(list(terms), list(outcomes), inv @ z, left.T @ left / (n - p), inv @ inv.T, n, float(n - p))


def multivariate_effect(fit: MultiFit, tested: list[str]) -> dict:
    """Wald test that ``tested`` terms have no effect on any outcome: chi-square with terms x outcomes degrees of freedom."""
    at = [fit.terms.index(t) for t in tested]
    b = fit.beta[at]
    stat = float(np.trace(np.linalg.solve(fit.inverse[np.ix_(at, at)], b) @ np.linalg.solve(fit.residual_cov, b.T)))
    k = len(at) * len(fit.outcomes)
    return {"statistic": stat, "df": k, "p_value": float(sp.chi2_sf(stat, k))}

"""P-values as columns: vectorised pandas UDFs over the distribution functions, for use after the heavy aggregation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import special


def _udf(fn):
    return F.pandas_udf(fn, "double")


def p_normal(z: Column) -> Column:
    """Two-sided normal p."""

    def run(z: pd.Series) -> pd.Series:
        return pd.Series(2 * special.normal_sf(z.abs())).where(z.notna().to_numpy())

    return _udf(run)(z)


def p_t(t: Column, df: Column) -> Column:
    """Two-sided t p."""

    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(special.np.exp(special.t_logsf2(t, df)))

    return _udf(run)(t, df.cast("double"))


def p_chi2(x: Column, df: Column) -> Column:
    def run(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(special.chi2_sf(x, df))

    return _udf(run)(x, df.cast("double"))


def p_f(x: Column, df1: Column, df2: Column) -> Column:
    def run(x: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
        return pd.Series(special.f_sf(x, df1, df2))

    return _udf(run)(x, df1.cast("double"), df2.cast("double"))


def neglog10_normal(z: Column) -> Column:
    """-log10 of the two-sided normal p, finite where p underflows."""

    def run(z: pd.Series) -> pd.Series:
        return pd.Series(-(special.np.log(2) + special.normal_logsf(z.abs())) / special.np.log(10))

    return _udf(run)(z)


def normal_quantile(p: Column) -> Column:
    def run(p: pd.Series) -> pd.Series:
        return pd.Series(special.normal_ppf(p))

    return _udf(run)(p)


def p_hypergeom(k: Column, good: Column, bad: Column, draws: Column) -> Column:
    """P(X >= k)."""

    def run(k: pd.Series, good: pd.Series, bad: pd.Series, draws: pd.Series) -> pd.Series:
        return pd.Series([special.math.exp(special.hypergeom_logsf(*x)) for x in zip(k, good, bad, draws)], dtype=float)

    return _udf(run)(k, good, bad, draws)

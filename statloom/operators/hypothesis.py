"""Hypothesis tests as grouped aggregates.

Every test takes ``by``: one test for each group, all in one plan, and without it one test over the table. Moments, counts and rank sums are
Spark aggregates; only tail probabilities leave the JVM, on one row for each test. Null and NaN values are left out pairwise.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from statloom.functions import exact as ex
from statloom.functions import pvalues as pv
from statloom.functions import special as sp
from statloom.operators.multiplicity import finite
from statloom.operators.ordered import average_ranks


def _clean(df: DataFrame, *values: str) -> DataFrame:
    for v in values:
        df = df.withColumn(v, finite(v))
    return df.dropna(subset=list(values))


def _one_sided(alternative: str, two: Column, statistic: Column) -> Column:
    """A p-value for the alternative from the two-sided one of a symmetric statistic."""
    if alternative == "two_sided":
        return two
    up = statistic > 0 if alternative == "greater" else statistic < 0
    return F.when(up, two / 2).otherwise(1 - two / 2)


# -- means --------------------------------------------------------------------------------------------------------------------------


def t_one_sample(df: DataFrame, value: str, mu: float = 0.0, by: list[str] = (), alternative: str = "two_sided") -> DataFrame:
    m = _clean(df, value).groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    out = m.withColumn("statistic", F.try_divide(F.col("mean") - F.lit(mu), F.sqrt(F.col("var") / F.col("n")))).withColumn("df", (F.col("n") - 1).cast("double"))
    return out.withColumn("p_value", _one_sided(alternative, pv.p_t(F.col("statistic"), F.col("df")), F.col("statistic")))


def t_paired(df: DataFrame, x: str, y: str, by: list[str] = (), alternative: str = "two_sided") -> DataFrame:
    return t_one_sample(_clean(df, x, y).withColumn("_d", F.col(x) - F.col(y)), "_d", 0.0, by, alternative)


def t_two_sample(df: DataFrame, value: str, group: str, first, second, by: list[str] = (), pooled: bool = False, alternative: str = "two_sided", alpha: float = 0.05) -> DataFrame:
    """Welch's or, with ``pooled``, Student's test of the group ``first`` against ``second``, with the interval of the difference."""
    d = _clean(df, value).filter(F.col(group).isin(first, second))
    side = lambda g: F.when(F.col(group) == F.lit(g), F.col(value))
    m = d.groupBy(*by).agg(*[f(side(g)).alias(f"{n}{k}") for k, g in ((1, first), (2, second)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    if pooled:
        df_ = (F.col("n1") + F.col("n2") - 2).cast("double")
        common = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / df_
        se = F.sqrt(common * (1 / F.col("n1") + 1 / F.col("n2")))
    else:
        a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
        se = F.sqrt(a + b)
        df_ = F.try_divide((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    out = m.withColumn("estimate", F.col("mean1") - F.col("mean2")).withColumn("se", se).withColumn("df", df_)
    out = out.withColumn("statistic", F.try_divide(F.col("estimate"), F.col("se")))
    out = out.withColumn("p_value", _one_sided(alternative, pv.p_t(F.col("statistic"), F.col("df")), F.col("statistic")))

    @F.pandas_udf("double")
    def critical(d: pd.Series) -> pd.Series:
        return pd.Series(sp.t_ppf(1 - alpha / 2, d))

    half = critical("df") * F.col("se")
    return out.withColumn("ci_low", F.col("estimate") - half).withColumn("ci_high", F.col("estimate") + half)


def variance_ratio(df: DataFrame, value: str, group: str, first, second, by: list[str] = (), alpha: float = 0.05) -> DataFrame:
    """F test of two variances, with the interval of their ratio; null where a side has fewer than two values or no spread."""
    d = _clean(df, value)
    side = lambda g: F.when(F.col(group) == F.lit(g), F.col(value))
    m = d.groupBy(*by).agg(F.count(side(first)).alias("n1"), F.var_samp(side(first)).alias("var1"), F.count(side(second)).alias("n2"), F.var_samp(side(second)).alias("var2"))
    out = m.withColumn("statistic", F.try_divide("var1", "var2")).withColumn("df1", (F.col("n1") - 1).cast("double")).withColumn("df2", (F.col("n2") - 1).cast("double"))
    p = pv.p_f(F.col("statistic"), F.col("df1"), F.col("df2"))
    out = out.withColumn("_p", p).withColumn("p_value", 2 * F.least("_p", 1 - F.col("_p"))).drop("_p")

    @F.pandas_udf("ci_low double, ci_high double")
    def interval(x: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.DataFrame:
        ok = x.notna() & (x > 0) & (df1 > 0) & (df2 > 0)
        a, b = df1.where(ok, 1.0).to_numpy(float), df2.where(ok, 1.0).to_numpy(float)
        x = x.where(ok).to_numpy(float)
        return pd.DataFrame({"ci_low": x / sp.f_ppf(1 - alpha / 2, a, b), "ci_high": x * sp.f_ppf(1 - alpha / 2, b, a)})

    bounds = out.withColumn("_c", interval("statistic", "df1", "df2")).select(*out.columns, "_c.*")
    return bounds.withColumn("ci_low", F.nanvl("ci_low", F.lit(None))).withColumn("ci_high", F.nanvl("ci_high", F.lit(None)))


def _moments(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    return _clean(df, value).filter(F.col(group).isNotNull()).groupBy(*by, group).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))


def anova(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    """One-way analysis of variance with equal variances."""
    g = _moments(df, value, group, by)
    s = g.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("within"), F.collect_list(F.struct("n", "m")).alias("g"))
    grand = F.col("nm") / F.col("n")
    s = s.withColumn("grand", grand).withColumn("between", F.aggregate("g", F.lit(0.0), lambda a, x: a + x["n"] * (x["m"] - F.col("grand")) * (x["m"] - F.col("grand"))))
    out = s.withColumn("df1", F.col("k") - 1).withColumn("df2", F.col("n") - F.col("k")).withColumn("statistic", F.try_divide(F.col("between") / F.col("df1"), F.col("within") / F.col("df2")))
    return out.withColumn("p_value", pv.p_f(F.col("statistic"), F.col("df1"), F.col("df2"))).drop("g", "nm", "grand")


def welch_anova(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    g = _moments(df, value, group, by).withColumn("w", F.col("n") / F.col("v"))
    s = g.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("m")).alias("swm"), F.collect_list(F.struct("n", "m", "w")).alias("g"))
    s = s.withColumn("centre", F.col("swm") / F.col("sw"))
    spread = F.aggregate("g", F.lit(0.0), lambda a, x: a + x["w"] * (x["m"] - F.col("centre")) * (x["m"] - F.col("centre")))
    tmp = F.aggregate("g", F.lit(0.0), lambda a, x: a + (1 - x["w"] / F.col("sw")) * (1 - x["w"] / F.col("sw")) / (x["n"] - 1)) / (F.col("k") * F.col("k") - 1)
    s = s.withColumn("tmp", tmp).withColumn("statistic", spread / (F.col("k") - 1) / (1 + 2 * (F.col("k") - 2) * F.col("tmp")))
    out = s.withColumn("df1", F.col("k") - 1).withColumn("df2", 1 / (3 * F.col("tmp")))
    return out.withColumn("p_value", pv.p_f(F.col("statistic"), F.col("df1"), F.col("df2"))).drop("g", "sw", "swm", "centre", "tmp")


def bartlett(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    g = _moments(df, value, group, by).withColumn("d", F.col("n") - 1)
    s = g.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("d").alias("sd"), F.sum(F.col("d") * F.col("v")).alias("ss"), F.sum(F.col("d") * F.log("v")).alias("sl"), F.sum(1 / F.col("d")).alias("si"))
    stat = (F.col("sd") * F.log(F.col("ss") / F.col("sd")) - F.col("sl")) / (1 + (F.col("si") - 1 / F.col("sd")) / (3 * (F.col("k") - 1)))
    out = s.withColumn("statistic", stat).withColumn("df", F.col("k") - 1)
    return out.withColumn("p_value", pv.p_chi2(F.col("statistic"), F.col("df"))).drop("sd", "ss", "sl", "si")


# -- counts -------------------------------------------------------------------------------------------------------------------------


def chi2_independence(df: DataFrame, row: str, col: str, by: list[str] = ()) -> DataFrame:
    """Pearson's chi-square of a two-way table of row counts, without continuity correction; empty cells count."""
    by = list(by)
    cells = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(*by, row, col).agg(F.count(F.lit(1)).cast("double").alias("o"))
    r = cells.groupBy(*by, row).agg(F.sum("o").alias("r"))
    c = cells.groupBy(*by, col).agg(F.sum("o").alias("c"))
    n = r.groupBy(*by).agg(F.sum("r").alias("n"), F.count(F.lit(1)).alias("rows"))
    k = c.groupBy(*by).agg(F.count(F.lit(1)).alias("cols"))
    # sum (o - e)^2 / e over all cells, empty ones too, is n * (sum o^2 / (r c) - 1)
    inner = cells.join(r, [*by, row]).join(c, [*by, col]).groupBy(*by).agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"))
    out = inner.join(n, by).join(k, by) if by else inner.crossJoin(n).crossJoin(k)
    out = out.withColumn("statistic", F.col("n") * (F.col("s") - 1)).withColumn("df", ((F.col("rows") - 1) * (F.col("cols") - 1)).cast("double"))
    return out.withColumn("p_value", pv.p_chi2(F.col("statistic"), F.col("df"))).drop("s")


def chi2_goodness(df: DataFrame, observed: str, expected: str, by: list[str] = (), estimated: int = 0) -> DataFrame:
    """Counts against expected shares or counts, which are scaled to the observed total."""
    s = df.groupBy(*by).agg(F.sum(observed).cast("double").alias("n"), F.sum(expected).cast("double").alias("e"), F.sum(F.col(observed) * F.col(observed) / F.col(expected)).alias("q"), F.count(F.lit(1)).alias("k"))
    out = s.withColumn("statistic", F.col("q") * F.col("e") / F.col("n") - F.col("n")).withColumn("df", (F.col("k") - 1 - estimated).cast("double"))
    return out.withColumn("p_value", pv.p_chi2(F.col("statistic"), F.col("df"))).drop("e", "q")


def cmh(df: DataFrame, row: Column, col: Column, stratum: str, by: list[str] = (), correct: bool = True) -> DataFrame:
    """Cochran-Mantel-Haenszel over 2 x 2 x K tables of two boolean columns, with the common odds ratio."""
    cell = lambda a, b: F.count_if((row == F.lit(a)) & (col == F.lit(b))).cast("double")
    t = df.groupBy(*by, stratum).agg(cell(True, True).alias("a"), cell(True, False).alias("b"), cell(False, True).alias("c"), cell(False, False).alias("d"))
    t = t.withColumn("n", F.col("a") + F.col("b") + F.col("c") + F.col("d")).filter("n > 1")
    r1, r2, c1, c2 = F.col("a") + F.col("b"), F.col("c") + F.col("d"), F.col("a") + F.col("c"), F.col("b") + F.col("d")
    s = t.groupBy(*by).agg(F.sum(F.col("a") - r1 * c1 / F.col("n")).alias("delta"), F.sum(r1 * r2 * c1 * c2 / (F.col("n") * F.col("n") * (F.col("n") - 1))).alias("var"), F.sum(F.col("a") * F.col("d") / F.col("n")).alias("up"), F.sum(F.col("b") * F.col("c") / F.col("n")).alias("down"), F.count(F.lit(1)).alias("strata"))
    half = F.when(F.abs("delta") >= 0.5, F.lit(0.5)).otherwise(F.lit(0.0)) if correct else F.lit(0.0)
    out = s.withColumn("statistic", F.try_divide(F.pow(F.abs("delta") - half, F.lit(2)), F.col("var"))).withColumn("odds_ratio", F.try_divide("up", "down")).withColumn("df", F.lit(1.0))
    return out.withColumn("p_value", pv.p_chi2(F.col("statistic"), F.col("df"))).drop("up", "down", "var", "delta")


def mcnemar(df: DataFrame, first: Column, second: Column, by: list[str] = (), correct: bool = True) -> DataFrame:
    s = df.groupBy(*by).agg(F.count_if(first & ~second).cast("double").alias("b"), F.count_if(~first & second).cast("double").alias("c"))
    yates = F.when(F.col("b") != F.col("c"), F.lit(1.0)).otherwise(F.lit(0.0)) if correct else F.lit(0.0)
    out = s.withColumn("statistic", F.try_divide(F.pow(F.abs(F.col("b") - F.col("c")) - yates, F.lit(2)), F.col("b") + F.col("c"))).withColumn("df", F.lit(1.0))
    return out.withColumn("p_value", pv.p_chi2(F.col("statistic"), F.col("df")))


def proportion(df: DataFrame, success: Column, group: str, by: list[str] = (), correct: bool = True, alpha: float = 0.05) -> DataFrame:
    """Equality of k proportions; the continuity correction applies to two groups only, and so does the interval of their difference (first less second)."""
    g = df.groupBy(*by, group).agg(F.count_if(success).cast("double").alias("x"), F.count(F.lit(1)).cast("double").alias("n"))
    s = g.groupBy(*by).agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum(1 / F.col("n")).alias("inv"), F.count(F.lit(1)).alias("k"), F.collect_list(F.struct(F.col(group).alias("g"), "x", "n")).alias("c"))
    s = s.withColumn("p", F.col("x") / F.col("n"))
    ordered = F.array_sort("c")
    delta = F.abs(ordered[0]["x"] / ordered[0]["n"] - F.get(ordered, F.lit(1))["x"] / F.get(ordered, F.lit(1))["n"])
    yates = F.when(F.col("k") == 2, F.least(F.lit(0.5), delta / F.col("inv"))).otherwise(F.lit(0.0)) if correct else F.lit(0.0)
    s = s.withColumn("y", yates)
    term = lambda o, e: F.pow(F.abs(o - e) - F.col("y"), F.lit(2)) / e
    stat = F.aggregate("c", F.lit(0.0), lambda a, c: a + term(c["x"], c["n"] * F.col("p")) + term(c["n"] - c["x"], c["n"] * (1 - F.col("p"))))
    out = s.withColumn("statistic", stat).withColumn("df", (F.col("k") - 1).cast("double"))
    share = lambda c: c["x"] / c["n"]
    spread = lambda c: share(c) * (1 - share(c)) / c["n"]
    a, b = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
    half = F.lit(float(sp.normal_ppf(1 - alpha / 2))) * F.sqrt(spread(a) + spread(b)) + F.col("y") * F.col("inv")
    two = F.col("k") == 2
    out = out.withColumn("difference", F.when(two, share(a) - share(b)))
    out = out.withColumn("ci_low", F.when(two, F.greatest(F.lit(-1.0), F.col("difference") - half))).withColumn("ci_high", F.when(two, F.least(F.lit(1.0), F.col("difference") + half)))
    return out.withColumn("p_value", pv.p_chi2(F.col("statistic"), F.col("df"))).select(*by, "k", "n", "p", "statistic", "df", "p_value", "difference", "ci_low", "ci_high")


def proportion_trend(df: DataFrame, success: Column, score: str, by: list[str] = ()) -> DataFrame:
    """Chi-square for a linear trend of proportions over ``score``."""
    g = df.groupBy(*by, score).agg(F.count_if(success).cast("double").alias("x"), F.count(F.lit(1)).cast("double").alias("n"))
    s = g.groupBy(*by).agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum(F.col(score) * F.col("x")).alias("sx"), F.sum(F.col(score) * F.col("n")).alias("sn"), F.sum(F.col(score) * F.col(score) * F.col("n")).alias("ssn"))
    p = F.col("x") / F.col("n")
    out = s.withColumn("statistic", F.pow(F.col("sx") - p * F.col("sn"), F.lit(2)) / (p * (1 - p) * (F.col("ssn") - F.col("sn") * F.col("sn") / F.col("n")))).withColumn("df", F.lit(1.0))
    return out.withColumn("p_value", pv.p_chi2(F.col("statistic"), F.col("df"))).select(*by, "n", "statistic", "df", "p_value")


def binomial_exact(df: DataFrame, success: Column, p0: float = 0.5, by: list[str] = (), alpha: float = 0.05) -> DataFrame:
    """Exact two-sided binomial test (sum of outcomes no likelier than the one seen) with the Clopper-Pearson interval."""
    s = df.groupBy(*by).agg(F.count_if(success).alias("x"), F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("p_value double, ci_low double, ci_high double")
    def test(x: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = [binomial_two_sided(int(a), int(b), p0) for a, b in zip(x, n)]
        low = [0.0 if a == 0 else float(sp.beta_ppf(alpha / 2, a, b - a + 1)) for a, b in zip(x, n)]
        high = [1.0 if a == b else float(sp.beta_ppf(1 - alpha / 2, a + 1, b - a)) for a, b in zip(x, n)]
        return pd.DataFrame({"p_value": rows, "ci_low": low, "ci_high": high})

    return s.withColumn("estimate", F.col("x") / F.col("n")).withColumn("_t", test("x", "n")).select(*by, "x", "n", "estimate", "_t.*")


def binomial_two_sided(x: int, n: int, p0: float) -> float:
    """Two-sided p by counting outcomes on the far side that are no likelier, found by bisection since the mass is unimodal."""
    if p0 in (0.0, 1.0):
        return float(x == n * p0)
    mass = lambda k: float(sp.binom_logpmf(k, n, p0))
    bound = mass(x) + 1e-7
    if x == n * p0:
        return 1.0
    if x < n * p0:
        low, high = math.ceil(n * p0), n + 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if mass(mid) <= bound else (mid + 1, high)
        return min(1.0, float(sp.binom_cdf(x, n, p0)) + (float(sp.binom_sf(low, n, p0)) if low <= n else 0.0))
    low, high = -1, math.floor(n * p0)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mass(mid) <= bound else (low, mid - 1)
    return min(1.0, float(sp.binom_sf(x, n, p0)) + (float(sp.binom_cdf(low, n, p0)) if low >= 0 else 0.0))


def poisson_rate(df: DataFrame, count: str, exposure: str, group: str, first, second, by: list[str] = ()) -> DataFrame:
    """Exact comparison of two rates: given the total, one count is binomial."""
    side = lambda g, c: F.sum(F.when(F.col(group) == F.lit(g), F.col(c)))
    s = df.groupBy(*by).agg(side(first, count).alias("x1"), side(first, exposure).alias("t1"), side(second, count).alias("x2"), side(second, exposure).alias("t2"))

    @F.pandas_udf("double")
    def test(a: pd.Series, t: pd.Series, b: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([binomial_two_sided(int(x), int(x + y), float(p / (p + q))) for x, p, y, q in zip(a, t, b, u)])

    return s.withColumn("rate_ratio", (F.col("x1") / F.col("t1")) / (F.col("x2") / F.col("t2"))).withColumn("p_value", test("x1", "t1", "x2", "t2"))


def fisher_2x2(df: DataFrame, row: Column, col: Column, by: list[str] = ()) -> DataFrame:
    """Fisher's exact test: two-sided p and the sample odds ratio."""
    cell = lambda a, b: F.count_if((row == F.lit(a)) & (col == F.lit(b)))
    t = df.groupBy(*by).agg(cell(True, True).alias("a"), cell(True, False).alias("b"), cell(False, True).alias("c"), cell(False, False).alias("d"))

    @F.pandas_udf("double")
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for w, x, y, z in zip(a, b, c, d):
            low, high = max(0, (w + y) - (y + z)), min(w + x, w + y)
            j = sp.np.arange(low, high + 1)
            logs = sp.log_choose(w + x, j) + sp.log_choose(y + z, w + y - j)
            mass = sp.np.exp(logs - logs.max())
            out.append(float(mass[mass <= mass[w - low] * (1 + 1e-7)].sum() / mass.sum()))
        return pd.Series(out)

    return t.withColumn("odds_ratio", F.try_divide(F.col("a") * F.col("d"), F.col("b") * F.col("c"))).withColumn("p_value", test("a", "b", "c", "d"))


# -- ranks ---------------------------------------------------------------------------------------------------------------------------


def _tie_sum(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """sum (t^3 - t) over tied values, for each group."""
    c = df.groupBy(*by, value).agg(F.count(F.lit(1)).cast("double").alias("t"))
    return c.groupBy(*by).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))


def _with_ties(out: DataFrame, d: DataFrame, value: str, by: list[str]) -> DataFrame:
    ties = _tie_sum(d, value, by)
    return out.join(ties, by) if by else out.crossJoin(ties)


def _exact_or(exact: bool | None, fn, otherwise: Column, *sizes: Column, statistic: str = "statistic") -> Column:
    """``fn(statistic, *sizes)`` without ties where ``exact`` (by default where all sizes are below ``ex.SMALL``), else ``otherwise``; needs the column ``ties``."""
    if exact is False:
        return otherwise

    @F.pandas_udf("double")
    def run(x: pd.Series, *n: pd.Series) -> pd.Series:
        return pd.Series([fn(a, *(int(c) for c in b)) if all(c > 0 for c in b) and not math.isnan(a) else math.nan for a, *b in zip(x, *n)], dtype=float)

    small = F.col("ties") == 0
    for n in sizes if exact is None else ():
        small &= n < ex.SMALL
    return F.when(small, run(F.when(small, F.col(statistic)), *[F.when(small, n).otherwise(0.0) for n in sizes])).otherwise(otherwise)


def rank_sum(df: DataFrame, value: str, group: str, first, second, by: list[str] = (), correct: bool = True, exact: bool | None = None) -> DataFrame:
    """Wilcoxon's rank sum W of ``first``: exact p without ties (by default with under 50 values on both sides), else the normal approximation with ties and continuity correction."""
    by = list(by)
    d = _clean(df, value).filter(F.col(group).isin(first, second)).select(*by, group, value)
    r = average_ranks(d, value, "r", by)
    s = r.groupBy(*by).agg(F.count_if(F.col(group) == F.lit(first)).cast("double").alias("n1"), F.count_if(F.col(group) == F.lit(second)).cast("double").alias("n2"), F.sum(F.when(F.col(group) == F.lit(first), F.col("r"))).alias("rs"))
    s = _with_ties(s, d, value, by)
    n = F.col("n1") + F.col("n2")
    s = s.withColumn("statistic", F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2).withColumn("centred", F.col("statistic") - F.col("n1") * F.col("n2") / 2)
    sigma = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    s = s.withColumn("z", F.try_divide(F.col("centred") - (F.signum("centred") * 0.5 if correct else F.lit(0.0)), sigma))  # null with one side only
    p = _exact_or(exact, lambda w, m, k: ex.two_sided(ex.rank_sums(m, k), w), pv.p_normal(F.col("z")), F.col("n1"), F.col("n2"))
    return s.withColumn("p_value", p).drop("rs", "centred", "ties")


def signed_rank(df: DataFrame, x: str, y: str | None = None, by: list[str] = (), correct: bool = True, exact: bool | None = None) -> DataFrame:
    """Wilcoxon's signed rank V of x (or x - y): exact p without ties and zeros (by default with under 50 values), else zeros dropped and the normal approximation."""
    by = list(by)
    d = _clean(df, x, *([y] if y else [])).withColumn("_d", F.col(x) - F.col(y) if y else F.col(x)).withColumn("_a", F.abs("_d")).select(*by, "_d", "_a")
    zeros = d.groupBy(*by).agg(F.count_if(F.col("_d") == 0).alias("zeros"))
    d = d.filter("_d <> 0")
    r = average_ranks(d, "_a", "r", by)
    s = r.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("r")).otherwise(0.0)).alias("statistic"))
    s = _with_ties(s, d, "_a", by)
    centred = F.col("statistic") - F.col("n") * (F.col("n") + 1) / 4
    sigma = F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48)
    s = s.withColumn("z", F.try_divide(centred - (F.signum(centred) * 0.5 if correct else F.lit(0.0)), sigma))
    s = (s.join(zeros, by) if by else s.crossJoin(zeros)).withColumn("ties", F.col("ties") + F.col("zeros"))  # either rules the exact way out
    p = _exact_or(exact, lambda v, n: ex.two_sided(ex.signed_ranks(n), v), pv.p_normal(F.col("z")), F.col("n"))
    return s.withColumn("p_value", p).drop("ties", "zeros")


def kruskal_wallis(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    by = list(by)
    d = _clean(df, value).filter(F.col(group).isNotNull()).select(*by, group, value)
    g = average_ranks(d, value, "r", by).groupBy(*by, group).agg(F.sum("r").alias("rs"), F.count(F.lit(1)).cast("double").alias("m"))
    s = g.groupBy(*by).agg(F.sum(F.col("rs") * F.col("rs") / F.col("m")).alias("q"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"))
    s = _with_ties(s, d, value, by)
    n = F.col("n")
    h = F.try_divide(12 * F.col("q") / (n * (n + 1)) - 3 * (n + 1), 1 - F.try_divide(F.col("ties"), n * n * n - n))
    return s.withColumn("statistic", h).withColumn("df", (F.col("k") - 1).cast("double")).withColumn("p_value", pv.p_chi2(F.col("statistic"), F.col("df"))).drop("q", "ties")


def friedman(df: DataFrame, value: str, treatment: str, block: str, by: list[str] = ()) -> DataFrame:
    """Friedman's test over complete blocks, with ties."""
    by = list(by)
    r = average_ranks(_clean(df, value).select(*by, treatment, block, value), value, "r", [*by, block])
    ties = _tie_sum(r, "r", [*by, block]).groupBy(*by).agg(F.sum("ties").alias("ties"))
    t = r.groupBy(*by, treatment).agg(F.sum("r").alias("rs"), F.count(F.lit(1)).cast("double").alias("b"))
    s = t.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("k"), F.max("b").alias("b"), F.sum("rs").alias("total"), F.sum(F.col("rs") * F.col("rs")).alias("squares"))
    s = s.join(ties, by) if by else s.crossJoin(ties)
    k, b = F.col("k"), F.col("b")
    stat = 12 * (F.col("squares") - F.col("total") * F.col("total") / k) / (b * k * (k + 1) - F.col("ties") / (k - 1))
    return s.withColumn("statistic", stat).withColumn("df", k - 1).withColumn("p_value", pv.p_chi2(F.col("statistic"), F.col("df"))).select(*by, "k", "b", "statistic", "df", "p_value")


def quade(df: DataFrame, value: str, treatment: str, block: str, by: list[str] = ()) -> DataFrame:
    """Quade's test: ranks within blocks, centred and weighted by the rank of the block's range."""
    by = list(by)
    d = _clean(df, value).select(*by, treatment, block, value)
    r = average_ranks(d, value, "r", [*by, block])
    span = average_ranks(d.groupBy(*by, block).agg((F.max(value) - F.min(value)).alias("range")), "range", "q", by).select(*by, block, "q")
    size = d.groupBy(*by).agg(F.countDistinct(treatment).cast("double").alias("_k"), F.countDistinct(block).cast("double").alias("_b"))
    r = r.join(span, [*by, block])
    r = r.join(size, by) if by else r.crossJoin(F.broadcast(size))
    r = r.withColumn("_s", F.col("q") * (F.col("r") - (F.col("_k") + 1) / 2))
    t = r.groupBy(*by, treatment).agg(F.sum("_s").alias("_st"), F.sum(F.col("_s") * F.col("_s")).alias("_a"), F.first("_k").alias("_k"), F.first("_b").alias("_b"))
    s = t.groupBy(*by).agg(F.sum("_a").alias("_a"), F.sum(F.col("_st") * F.col("_st")).alias("_sq"), F.first("_k").alias("_k"), F.first("_b").alias("_b"))
    between = F.col("_sq") / F.col("_b")
    s = s.withColumn("statistic", F.try_divide((F.col("_b") - 1) * between, F.col("_a") - between)).withColumn("df1", F.col("_k") - 1).withColumn("df2", (F.col("_b") - 1) * (F.col("_k") - 1))
    return s.withColumn("p_value", pv.p_f(F.col("statistic"), F.col("df1"), F.col("df2"))).select(*by, "statistic", "df1", "df2", "p_value")


def spearman(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Rank correlation (Pearson's of average ranks) with the t approximation."""
    by = list(by)
    d = _clean(df, x, y).select(*by, x, y)
    r = average_ranks(average_ranks(d, x, "rx", by), y, "ry", by)
    s = r.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.corr("rx", "ry").alias("estimate"))
    return _corr_test(s)


def _corr_test(s: DataFrame) -> DataFrame:
    s = s.withColumn("df", F.col("n") - 2).withColumn("statistic", F.try_divide(F.col("estimate") * F.sqrt("df"), F.sqrt(1 - F.col("estimate") * F.col("estimate"))))
    return s.withColumn("p_value", pv.p_t(F.col("statistic"), F.col("df")))


def pearson(df: DataFrame, x: str, y: str, by: list[str] = (), alpha: float = 0.05) -> DataFrame:
    """Pearson's correlation, t test and Fisher-z interval."""
    s = _corr_test(_clean(df, x, y).groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.corr(x, y).alias("estimate")))
    half = F.lit(float(sp.normal_ppf(1 - alpha / 2))) / F.sqrt(F.col("n") - 3)
    z = F.atanh("estimate")
    return s.withColumn("ci_low", F.tanh(z - half)).withColumn("ci_high", F.tanh(z + half))


def kendall(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Kendall's tau-b for each group, by merge counting in O(n log n); a group is held by one task."""
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in by] + ["n long, estimate double, z double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, tau, z = kendall_tau(pdf[x].to_numpy(float), pdf[y].to_numpy(float))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "n": [n], "estimate": [tau], "z": [z]})

    out = _clean(df, x, y).select(*by, x, y).groupBy(*by).applyInPandas(run, schema)
    return out.withColumn("p_value", pv.p_normal(F.col("z")))


def kendall_tau(x, y) -> tuple[int, float, float]:
    np = sp.np
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]

    def pairs(*cols):
        new = np.ones(n, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        t = np.diff(np.append(np.flatnonzero(new), n)).astype(float)
        return t

    tx, txy = pairs(x), pairs(x, y)
    _, rank = np.unique(y, return_inverse=True)
    ty = np.bincount(rank).astype(float)
    swaps, size, a = 0, 1, rank.copy()
    while size < n:  # merge sort that counts inversions, all runs of a pass together
        for lo in range(0, n, 2 * size):
            left, right = a[lo : lo + size], a[lo + size : lo + 2 * size]
            if len(right):
                swaps += int((len(left) - np.searchsorted(left, right, "right")).sum())
                a[lo : lo + len(left) + len(right)] = np.sort(a[lo : lo + len(left) + len(right)], kind="stable")
        size *= 2
    half = lambda t: (t * (t - 1) / 2).sum()
    total = n * (n - 1) / 2
    s = total - half(tx) - half(ty) + half(txy) - 2 * swaps
    den = math.sqrt((total - half(tx)) * (total - half(ty)))
    v0 = n * (n - 1) * (2 * n + 5)
    f = lambda t: (t * (t - 1) * (2 * t + 5)).sum()
    var = (v0 - f(tx) - f(ty)) / 18
    if n > 2:
        var += half(tx) * half(ty) * 2 / (n * (n - 1)) + (tx * (tx - 1) * (tx - 2)).sum() * (ty * (ty - 1) * (ty - 2)).sum() / (9 * n * (n - 1) * (n - 2))
    return n, s / den if den else float("nan"), s / math.sqrt(var) if var > 0 else float("nan")


def _kolmogorov(z):
    """Asymptotic P(sqrt(n) D >= z)."""
    k = sp.np.arange(1, 101)[None, :]
    upper = 2 * ((-1.0) ** (k - 1) * sp.np.exp(-2 * k * k * z[:, None] ** 2)).sum(1)
    return sp.np.where(z < 0.2, 1.0, sp.np.clip(upper, 0, 1))


def ks_one_sample(df: DataFrame, value: str, cdf: Column, by: list[str] = (), exact: bool | None = None) -> DataFrame:
    """Largest distance from a continuous distribution function, ``cdf`` in terms of ``value``: exact p without ties (by default under 100 values), else asymptotic."""
    by = list(by)
    d = _clean(df, value).select(*by, F.col(value).alias("_v"), cdf.alias("_f"))
    r = average_ranks(d, "_v", "r", by)
    last = F.col("r") + (F.col("r_ties") - 1) / 2
    size = d.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"))
    r = r.join(size, by) if by else r.crossJoin(F.broadcast(size))
    far = F.greatest(last / F.col("n") - F.col("_f"), F.col("_f") - (last - F.col("r_ties")) / F.col("n"))
    s = r.groupBy(*by).agg(F.max(far).alias("statistic"), F.first("n").alias("n"), F.max("r_ties").alias("most"))

    @F.pandas_udf("double")
    def p(d: pd.Series, n: pd.Series, most: pd.Series) -> pd.Series:
        far = _kolmogorov(d.to_numpy() * sp.np.sqrt(n.to_numpy()))
        use = [m == 1 and (exact or exact is None and k < ex.SAMPLE) for k, m in zip(n, most)]
        return pd.Series([ex.distance_one_sample(a, int(k)) if e else b for a, k, e, b in zip(d, n, use, far)], dtype=float)

    return s.withColumn("p_value", p("statistic", "n", "most")).drop("most")


def poisson_exact(df: DataFrame, count: str, exposure: str, rate: float = 1.0, by: list[str] = (), alpha: float = 0.05) -> DataFrame:
    """Exact two-sided test of a rate (sum of outcomes no likelier than the one seen) with the exact interval of the rate."""
    s = df.groupBy(*by).agg(F.sum(count).cast("long").alias("x"), F.sum(exposure).cast("double").alias("exposure"))

    @F.pandas_udf("p_value double, ci_low double, ci_high double")
    def test(x: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = [ex.poisson_two_sided(int(a), rate * b) for a, b in zip(x, t)]
        low = [0.0 if a == 0 else float(sp.chi2_ppf(alpha / 2, 2.0 * a)) / 2 / b for a, b in zip(x, t)]
        high = [float(sp.chi2_ppf(1 - alpha / 2, 2.0 * a + 2)) / 2 / b for a, b in zip(x, t)]
        return pd.DataFrame({"p_value": rows, "ci_low": low, "ci_high": high})

    return s.filter("x is not null and exposure > 0").withColumn("estimate", F.col("x") / F.col("exposure")).withColumn("_t", test("x", "exposure")).select(*by, "x", "exposure", "estimate", "_t.*")


def ks_two_sample(df: DataFrame, value: str, group: str, first, second, by: list[str] = (), exact: bool | None = None) -> DataFrame:
    """Largest distance of two distribution functions, over values counted once: exact p without ties (by default with n1 n2 under 10,000), else asymptotic."""
    from statloom.operators.ordered import running_sum

    by = list(by)
    d = _clean(df, value).filter(F.col(group).isin(first, second))
    c = d.groupBy(*by, value).agg(F.count_if(F.col(group) == F.lit(first)).alias("c1"), F.count_if(F.col(group) == F.lit(second)).alias("c2"))
    n = c.groupBy(*by).agg(F.sum("c1").cast("double").alias("n1"), F.sum("c2").cast("double").alias("n2"))
    r = running_sum(c, "c1", [value], "u1", by)
    r = running_sum(r, "c2", [value], "u2", by)
    r = r.join(n, by) if by else r.crossJoin(F.broadcast(n))
    s = r.groupBy(*by).agg(F.max(F.abs(F.try_divide("u1", "n1") - F.try_divide("u2", "n2"))).alias("statistic"), F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.max(F.col("c1") + F.col("c2")).alias("most"))

    @F.pandas_udf("double")
    def p(d: pd.Series, a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
        far = _kolmogorov((d * sp.np.sqrt(a * b / (a + b))).to_numpy())  # NaN with one side only
        use = [m == 1 and x > 0 and y > 0 and (exact or exact is None and x * y < ex.CELLS) for x, y, m in zip(a, b, most)]
        return pd.Series([ex.distance_two_sample(v, int(x), int(y)) if e else f for v, x, y, e, f in zip(d, a, b, use, far)], dtype=float)

    return s.withColumn("p_value", p("statistic", "n1", "n2", "most")).drop("most")


def ansari_bradley(df: DataFrame, value: str, group: str, first, second, by: list[str] = (), exact: bool | None = None) -> DataFrame:
    """AB = sum of min(rank, N + 1 - rank) over ``first``: exact p without ties (by default with under 50 values on both sides), else the normal approximation with ties."""
    by = list(by)
    d = _clean(df, value).filter(F.col(group).isin(first, second)).select(*by, group, value)
    size = d.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col(group) == F.lit(first)).cast("double").alias("m"))
    r = average_ranks(d, value, "r", by)
    r = r.join(size, by) if by else r.crossJoin(F.broadcast(size))
    r = r.withColumn("_s", F.least("r", F.col("n") + 1 - F.col("r")))
    s = r.groupBy(*by).agg(F.sum(F.when(F.col(group) == F.lit(first), F.col("_s"))).alias("statistic"), F.sum(F.col("_s") * F.col("_s")).alias("s2"), F.sum("_s").alias("s1"), F.first("n").alias("n"), F.first("m").alias("m"), F.max(F.col("r_ties") - 1).alias("ties"))
    n, m = F.col("n"), F.col("m")
    mean = m * F.col("s1") / n
    var = F.try_divide(m * (n - m), n * (n - 1)) * (F.col("s2") - F.col("s1") * F.col("s1") / n)
    s = s.withColumn("z", F.try_divide(F.col("statistic") - mean, F.sqrt(var)))  # null with one side only
    p = _exact_or(exact, lambda v, a, b: ex.two_sided(ex.ansari(a, b), v), pv.p_normal(F.col("z")), m, n - m)
    return s.withColumn("p_value", p).select(*by, "n", "m", "statistic", "z", "p_value")


def mood(df: DataFrame, value: str, group: str, first, second, by: list[str] = ()) -> DataFrame:
    """T = sum of (rank - (N + 1) / 2)^2 over ``first``, normal approximation."""
    by = list(by)
    d = _clean(df, value).filter(F.col(group).isin(first, second)).select(*by, group, value)
    size = d.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col(group) == F.lit(first)).cast("double").alias("m"))
    r = average_ranks(d, value, "r", by)
    r = r.join(size, by) if by else r.crossJoin(F.broadcast(size))
    s = r.groupBy(*by).agg(F.sum(F.when(F.col(group) == F.lit(first), F.pow(F.col("r") - (F.col("n") + 1) / 2, F.lit(2)))).alias("statistic"), F.first("n").alias("n"), F.first("m").alias("m"))
    n, m = F.col("n"), F.col("m")
    s = s.withColumn("z", F.try_divide(F.col("statistic") - m * (n * n - 1) / 12, F.sqrt(m * (n - m) * (n + 1) * (n + 2) * (n - 2) / 180)))
    return s.withColumn("p_value", pv.p_normal(F.col("z"))).select(*by, "n", "m", "statistic", "z", "p_value")


def fligner_killeen(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    """Normal scores of the ranks of absolute deviations from group medians."""
    by = list(by)
    d = _clean(df, value).select(*by, group, value)
    med = d.groupBy(*by, group).agg(F.percentile(value, F.lit(0.5)).alias("_med"))
    d = d.join(med, [*by, group]).withColumn("dev", F.abs(F.col(value) - F.col("_med"))).select(*by, group, "dev")
    size = d.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"))
    r = average_ranks(d, "dev", "r", by)
    r = r.join(size, by) if by else r.crossJoin(F.broadcast(size))
    r = r.withColumn("a", pv.normal_quantile((1 + F.col("r") / (F.col("n") + 1)) / 2))
    g = r.groupBy(*by, group).agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum("a").alias("sa"), F.sum(F.col("a") * F.col("a")).alias("saa"))
    s = g.groupBy(*by).agg(F.sum("m").alias("n"), F.sum("sa").alias("sa"), F.sum("saa").alias("saa"), F.sum(F.col("sa") * F.col("sa") / F.col("m")).alias("q"), F.count(F.lit(1)).alias("k"))
    mean = F.col("sa") / F.col("n")
    stat = (F.col("q") - F.col("n") * mean * mean) / ((F.col("saa") - F.col("n") * mean * mean) / (F.col("n") - 1))
    return s.withColumn("statistic", stat).withColumn("df", (F.col("k") - 1).cast("double")).withColumn("p_value", pv.p_chi2(F.col("statistic"), F.col("df"))).select(*by, "n", "k", "statistic", "df", "p_value")


def shapiro_wilk(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Shapiro-Wilk W by Royston's approximation, for groups of 3 to 5000 values."""
    schema = ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in by] + ["n long, statistic double, p_value double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, w, p = shapiro(pdf[value].to_numpy(float))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "n": [n], "statistic": [w], "p_value": [p]})

    return _clean(df, value).select(*by, value).groupBy(*by).applyInPandas(run, schema)


def shapiro(x) -> tuple[int, float, float]:
    np = sp.np
    x = np.sort(x)
    n = len(x)
    if n < 3 or n > 5000 or x[0] == x[-1]:
        return n, float("nan"), float("nan")
    m = sp.normal_ppf((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    c = m / math.sqrt((m * m).sum())
    u = 1 / math.sqrt(n)
    # Royston's polynomial coefficients.
    c1 = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0]
    c2 = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
    a = np.zeros(n)
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    else:
        an = c[-1] + np.polyval(c1, u)
        if n > 5:
            an1 = c[-2] + np.polyval(c2, u)
            phi = ((m * m).sum() - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * an1**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[[-1, 0, -2, 1]] = [an, -an, an1, -an1]
        else:
            phi = ((m * m).sum() - 2 * m[-1] ** 2) / (1 - 2 * an**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
            a[[-1, 0]] = [an, -an]
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    w = min(w, 1.0)
    if n == 3:
        return n, w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return n, w, 1e-99
        y = -math.log(gamma - y)
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        s = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        ln = math.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        s = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return n, w, float(sp.normal_sf((y - mu) / s))


def anova_power(groups: int, n: float, between: float, within: float, alpha: float = 0.05) -> float:
    """Power of a balanced one-way analysis of variance: a noncentral F tail as a Poisson mixture of beta tails."""
    np = sp.np
    df1, df2 = groups - 1, (n - 1) * groups
    nc = (groups - 1) * n * between / within
    crit = float(sp.f_ppf(1 - alpha, df1, df2))
    x = df1 * crit / (df1 * crit + df2)
    j = np.arange(0, int(nc / 2 + 12 * math.sqrt(nc / 2 + 1)) + 60)
    weight = np.exp(-nc / 2 + j * math.log(max(nc / 2, 1e-300)) - sp.lgamma(j + 1))
    return float(1 - (weight * sp.betainc(df1 / 2 + j, np.full(len(j), df2 / 2), np.full(len(j), x))).sum())


def effect_sizes(df: DataFrame, value: str, group: str, treated, control, by: list[str] = ()) -> DataFrame:
    """Mean difference and Hedges' g with their variances, treated against control."""
    side = lambda g: F.when(F.col(group) == F.lit(g), F.col(value))
    m = _clean(df, value).groupBy(*by).agg(*[f(side(g)).alias(f"{n}{k}") for k, g in ((1, treated), (2, control)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n1, n2 = F.col("n1"), F.col("n2")
    dof = n1 + n2 - 2
    d = (F.col("m1") - F.col("m2")) / F.sqrt(((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / dof)
    j = 1 - F.lit(3.0) / (4 * dof - 1)
    m = m.withColumn("md", F.col("m1") - F.col("m2")).withColumn("md_var", F.col("v1") / n1 + F.col("v2") / n2).withColumn("g", j * d)
    return m.withColumn("g_var", (n1 + n2) / (n1 * n2) + F.col("g") * F.col("g") / (2 * (n1 + n2)))


def ratio_effects(df: DataFrame, event: Column, group: str, treated, control, by: list[str] = ()) -> DataFrame:
    """Log odds ratio and log risk ratio with variances; null unless all cells are positive (no correction)."""
    cell = lambda g, e: F.count_if((F.col(group) == F.lit(g)) & (event if e else ~event)).cast("double")
    t = df.groupBy(*by).agg(cell(treated, True).alias("a"), cell(treated, False).alias("b"), cell(control, True).alias("c"), cell(control, False).alias("d"))
    full = (F.col("a") > 0) & (F.col("b") > 0) & (F.col("c") > 0) & (F.col("d") > 0)
    a, b, c, d = (F.col(x) for x in "abcd")
    t = t.withColumn("log_or", F.when(full, F.log(a * d / (b * c)))).withColumn("log_or_var", F.when(full, 1 / a + 1 / b + 1 / c + 1 / d))
    return t.withColumn("log_rr", F.when(full, F.log(a / (a + b) / (c / (c + d))))).withColumn("log_rr_var", F.when(full, 1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)))

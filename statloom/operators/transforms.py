"""Row transforms of features: winsorizing, z-scores, logs, M-values, rank-based normal scores.

All take long rows (feature, value) and work on finite values within a feature; a pipeline is text such as ``winsor_mad(k=4) | zscore()``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from statloom.functions import pvalues as pv
from statloom.operators.multiplicity import finite
from statloom.operators.ordered import average_ranks

# Fixed value: 1 / normal quantile(0.75).
MAD_SCALE = 1.482602218505602


def winsor(df: DataFrame, feature: str, value: str, lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """Clamp to the feature's quantiles (linear interpolation between order statistics)."""
    q = df.groupBy(feature).agg(F.percentile(finite(value), F.array(F.lit(lower), F.lit(upper))).alias("_q"))
    return df.join(q, feature).withColumn(value, F.when(finite(value).isNotNull(), F.least(F.greatest(finite(value), F.col("_q")[0]), F.col("_q")[1]))).drop("_q")


def winsor_mad(df: DataFrame, feature: str, value: str, k: float = 4.0) -> DataFrame:
    """Clamp to median -+ k scaled median absolute deviations; a feature whose deviation is zero stays as it is."""
    med = df.groupBy(feature).agg(F.percentile(finite(value), F.lit(0.5)).alias("_m"))
    d = df.join(med, feature)
    mad = d.groupBy(feature).agg((F.percentile(F.abs(finite(value) - F.col("_m")), F.lit(0.5)) * MAD_SCALE).alias("_s"))
    d = d.join(mad, feature)
    clamp = F.least(F.greatest(finite(value), F.col("_m") - k * F.col("_s")), F.col("_m") + k * F.col("_s"))
    return d.withColumn(value, F.when((F.col("_s") > 0) & finite(value).isNotNull(), clamp).otherwise(finite(value))).drop("_m", "_s")


def zscore(df: DataFrame, feature: str, value: str) -> DataFrame:
    m = df.groupBy(feature).agg(F.avg(finite(value)).alias("_m"), F.stddev_samp(finite(value)).alias("_s"))
    return df.join(m, feature).withColumn(value, F.try_divide(finite(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def log1p(df: DataFrame, feature: str, value: str) -> DataFrame:
    return df.withColumn(value, F.log1p(F.when(finite(value) > -1, finite(value))))


def log(df: DataFrame, feature: str, value: str, shift: float = 0.0, base: float = 2.718281828459045) -> DataFrame:
    x = finite(value) + F.lit(float(shift))
    return df.withColumn(value, F.log(F.when(x > 0, x)) / F.log(F.lit(float(base))))


def mvalue(df: DataFrame, feature: str, value: str, epsilon: float = 1e-6) -> DataFrame:
    """log2(b / (1 - b)) of shares kept within epsilon of 0 and 1."""
    b = F.when(finite(value).isNotNull(), F.least(F.greatest(finite(value), F.lit(epsilon)), F.lit(1 - epsilon)))
    return df.withColumn(value, F.log2(b / (1 - b)))


def normal_scores(df: DataFrame, feature: str, value: str) -> DataFrame:
    """Blom's rank-based inverse normal: quantile of (rank - 3/8) / (n + 1/4), ties averaged."""
    d = df.withColumn("_v", finite(value))
    n = d.groupBy(feature).agg(F.count("_v").alias("_n"))
    r = average_ranks(d, "_v", "_r", [feature]).join(n, feature)
    return r.withColumn(value, pv.normal_quantile((F.col("_r") - 0.375) / (F.col("_n") + 0.25))).drop("_v", "_n", "_r", "_r_ties")


REGISTRY = {"winsor": winsor, "winsor_mad": winsor_mad, "zscore": zscore, "log1p": log1p, "log": log, "mvalue": mvalue, "int": normal_scores}


def register(name: str, fn) -> None:
    """Add a transform: ``fn(df, feature, value, **options)`` returns df with ``value`` replaced."""
    REGISTRY[name] = fn


def parse(text: str) -> list[tuple[str, dict]]:
    out = []
    for part in text.split("|"):
        m = re.fullmatch(r"\s*(\w+)\s*\((.*)\)\s*", part)
        if not m or m[1] not in REGISTRY:
            raise ValueError(f"not a transform: {part.strip()!r}")
        options = {}
        for item in filter(None, (x.strip() for x in m[2].split(","))):
            key, mark, v = item.partition("=")
            if not mark:
                raise ValueError(f"options are name=value: {item!r}")
            options[key.strip()] = float(v)
        out.append((m[1], options))
    return out


def apply(df: DataFrame, pipeline: str, feature: str = "feature_id", value: str = "value") -> DataFrame:
    for name, options in parse(pipeline):
        df = REGISTRY[name](df, feature, value, **options)
    return df


def robust_qc(df: DataFrame, dataset: str, effect: str, cutoff: float = 100.0, min_features: int = 20, limit: float | None = None) -> DataFrame:
    """``excluded`` where |effect - median| / scale is over the cutoff (scale from MAD, else IQR), if the dataset has enough features."""
    e = df.withColumn("_e", finite(effect))
    m = e.groupBy(dataset).agg(F.percentile("_e", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), F.count("_e").alias("_n"))
    e = e.join(m, dataset)
    mad = e.groupBy(dataset).agg((F.percentile(F.abs(F.col("_e") - F.col("_q")[1]), F.lit(0.5)) * MAD_SCALE).alias("_mad"))
    e = e.join(mad, dataset)
    # Fixed value: interquartile range of the standard normal.
    scale = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise((F.col("_q")[2] - F.col("_q")[0]) / 1.348979500392164)
    far = (F.col("_n") >= min_features) & (scale > 0) & (F.abs(F.col("_e") - F.col("_q")[1]) / scale > cutoff)
    if limit is not None:
        far = far | (F.abs("_e") > limit)
    return e.withColumn("excluded", F.coalesce(far, F.lit(False))).drop("_e", "_q", "_n", "_mad")


def genomic_order(chromosome: str):
    """Sort key of chromosomes: numbers, then X, Y, mitochondrial, then others by name."""
    c = F.upper(F.regexp_replace(F.col(chromosome).cast("string"), "(?i)^chr", ""))
    return F.coalesce(c.try_cast("int"), F.when(c == "X", 23).when(c == "Y", 24).when(c.isin("M", "MT"), 25).otherwise(1000))


def regions(df: DataFrame, chromosome: str, position: str, estimate: str, p: str, feature: str, max_gap: int = 500, min_probes: int = 3, length: float = 200.0) -> DataFrame:
    """Gaps and islands of probes: a region ends where the gap is over ``max_gap``; signed Stouffer z with covariance exp(-distance / length).

    The covariances of all pairs of a region are summed from running sums inside stretches of 32 lengths and the stretches' totals before them.
    """
    w = W.partitionBy(chromosome).orderBy(position, feature)
    d = df.withColumn("_new", (F.col(position) - F.lag(position).over(w) > max_gap) | F.lag(position).over(w).isNull())
    d = d.withColumn("region", F.sum(F.col("_new").cast("long")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")
    tail = F.when(finite(p).isNotNull(), F.greatest(finite(p) / 2, F.lit(1e-300)))
    d = d.withColumn("z", F.signum(estimate) * -pv.normal_quantile(tail))
    s = d.groupBy(chromosome, "region").agg(F.count(F.lit(1)).alias("probes"), F.min(position).alias("start"), F.max(position).alias("end"), F.sum("z").alias("sum_z")).filter(F.col("probes") >= min_probes)
    keys, size = [chromosome, "region"], F.lit(float(length))
    own = d.join(s.select(*keys), keys).filter(F.col(position).isNotNull()).groupBy(*keys, F.col(position).cast("double").alias("_x")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    own = own.withColumn("_k", F.floor(F.col("_x") / (32 * size)))
    stretch = W.partitionBy(*keys, "_k")
    own = own.withColumn("_a", F.min("_x").over(stretch)).withColumn("_u", (F.col("_x") - F.col("_a")) / size)
    up, down = F.col("_n") * F.exp("_u"), F.col("_n") * F.exp(-F.col("_u"))
    own = own.withColumn("_pairs", down * F.coalesce(F.sum(up).over(stretch.orderBy("_x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    parts = own.groupBy(*keys, "_k").agg(F.first("_a").alias("_a"), F.sum(up).alias("_up"), F.sum(down).alias("_down"), F.sum("_pairs").alias("_pairs"), F.sum(F.col("_n") * F.col("_n")).alias("_same"))
    # from 26 stretches on, exp(-distance / length) is zero in a double
    before = F.collect_list(F.struct("_a", "_up")).over(W.partitionBy(*keys).orderBy("_k").rangeBetween(-26, -1))
    carried = F.aggregate(before, F.lit(0.0), lambda t, e: t + e["_up"] * F.exp((e["_a"] - F.col("_a")) / size))
    v = parts.withColumn("_carried", carried).groupBy(*keys).agg((F.sum("_same") + 2 * F.sum(F.col("_pairs") + F.col("_down") * F.col("_carried"))).alias("var"))
    out = s.join(v, keys, "left").withColumn("z", F.col("sum_z") / F.sqrt("var"))
    return out.withColumn("p_value", pv.p_normal(F.col("z")))

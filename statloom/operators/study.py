"""Study steps over association tables: standardising, replication, comparison, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from statloom.operators.multiplicity import bh, finite

# Statuses that count as tested.
TESTED = ("ok", "tested", "complete")


def bind(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns by the first alias that the table has (case-insensitively); a name without any is an error."""
    have = {c.lower(): c for c in df.columns}
    picks = []
    for name, options in aliases.items():
        hit = next((have[o.lower()] for o in [name, *options] if o.lower() in have), None)
        if hit is None:
            raise ValueError(f"no column for {name}")
        picks.append(F.col(f"`{hit}`").alias(name))
    return df.select(*picks)


def standardize(df: DataFrame, feature: str = "feature_id", beta: str = "beta", se: str = "se", p: str = "p_value", status: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(usable rows, excluded rows with a reason): finite beta, se > 0, p in [0, 1] or missing. Blank or repeated ids are errors."""
    d = df.select(F.trim(F.col(feature)).alias("feature_id"), finite(beta).alias("beta"), finite(se).alias("se"), finite(p).alias("p_value"), *([F.lower(status).alias("status")] if status else [F.lit("ok").alias("status")]))
    bad = d.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or feature_id = '' or feature_id is null").limit(1).count()
    if bad:
        raise ValueError("feature ids are blank or repeated")
    reason = F.when(~F.col("status").isin(*TESTED), "status").when(F.col("beta").isNull(), "beta").when(F.col("se").isNull() | (F.col("se") <= 0), "se").when((F.col("p_value") < 0) | (F.col("p_value") > 1), "p_value")
    d = d.withColumn("reason", reason)
    return d.filter("reason is null").drop("reason", "status"), d.filter("reason is not null")


def replicate(discovery: DataFrame, replication: DataFrame, feature: str, first: str, second: str) -> DataFrame:
    """Full outer join of two effect tables with where each feature is and whether signs agree."""
    j = discovery.select(feature, first).join(replication.select(feature, second), feature, "full")
    status = F.when(F.col(second).isNull(), "discovery_only").when(F.col(first).isNull(), "replication_only").when(F.signum(first) == F.signum(second), "same_sign").otherwise("opposite_sign")
    return j.withColumn("status", status)


def replication_test(discovery: DataFrame, replication: DataFrame, feature: str = "feature_id", alpha: float = 0.05, same_sign: bool = True, subset: bool = True) -> DataFrame:
    """Discovery hits by adjusted p, tested in replication: adjusted among the hits (or all results), with the sign rule."""
    d = bh(discovery, "p_value", feature, "discovery_q")
    hits = d.filter(F.col("discovery_q") < alpha).select(feature, F.col("beta").alias("beta_1"), "discovery_q")
    r = replication.select(feature, F.col("beta").alias("beta_2"), F.col("p_value").alias("p_2"))
    family = r.join(hits.select(feature), feature, "left_semi") if subset else r
    j = hits.join(bh(family, "p_2", feature, "replication_q"), feature, "left")
    ok = F.coalesce(F.col("replication_q") < alpha, F.lit(False))
    if same_sign:
        ok = ok & (F.signum("beta_1") == F.signum("beta_2"))
    return j.withColumn("replicated", F.coalesce(ok, F.lit(False)))


def rank_candidates(df: DataFrame, p: str, feature: str, by: list[str] = (), top: int | None = None) -> DataFrame:
    """Rank by (p, feature); a top-k report if ``top`` is given."""
    w = W.partitionBy(*by).orderBy(p, feature)
    out = df.withColumn("rank", F.row_number().over(w))
    return out if top is None else out.filter(F.col("rank") <= top)


def compare_effects(df: DataFrame, feature: str, cohort: str, effect: str, minimum: int = 3) -> DataFrame:
    """Correlation and sign agreement of every two cohorts over shared features; cohorts meet through a join on the feature."""
    a = df.select(feature, F.col(cohort).alias("first"), F.col(effect).alias("_a"))
    b = df.select(feature, F.col(cohort).alias("second"), F.col(effect).alias("_b"))
    j = a.join(b, feature).filter("first < second").groupBy("first", "second")
    same = (F.signum("_a") == F.signum("_b")).cast("double")
    return j.agg(F.count(F.lit(1)).alias("shared"), F.corr("_a", "_b").alias("r"), F.avg(same).alias("same_sign")).filter(F.col("shared") >= minimum)


def align(samples: DataFrame, other: DataFrame, key: str = "sample_id", required: bool = False) -> DataFrame:
    """Inner join on unique ids; with ``required`` every id of ``samples`` must be there. No common id is an error."""
    for df in (samples, other):
        if df.groupBy(key).count().filter(f"count > 1 or `{key}` is null").limit(1).count():
            raise ValueError("ids must be unique and not missing")
    if required and samples.join(other, key, "left_anti").limit(1).count():
        raise ValueError("an id has no match")
    out = samples.join(other, key)
    if not out.limit(1).count():
        raise ValueError("no common id")
    return out


def venn(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of both differences and of the intersection of two id sets."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full").agg(F.count_if(F.col("_b").isNull()).alias("first_only"), F.count_if(F.col("_a").isNull()).alias("second_only"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))

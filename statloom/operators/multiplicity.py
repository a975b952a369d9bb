"""Multiple testing: Benjamini-Hochberg, weighted, Yekutieli, independent weighting, hierarchical Bonferroni.

Missing p-values (null or NaN) take no part in a family and keep a null result, unless ``missing_as_one`` counts them with p = 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from statloom.functions.special import digamma
from statloom.operators.ordered import running_sum
from statloom.session import materialize


def finite(c: str | Column) -> Column:
    """The value, null for NaN and infinities."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def bh(df: DataFrame, p: str, key: str, out: str = "q", by: list[str] = (), factor: Column | None = None, missing_as_one: bool = False) -> DataFrame:
    """Adjusted p-values: the least p * m / rank from the row's rank on, at most 1. ``key`` breaks ties.

    With ``by`` each group is a family. Without, the family is the whole table and is ordered in two distributed passes.
    """
    by = list(by)
    value = finite(p)
    use = df.withColumn("_p", F.coalesce(value, F.lit(1.0)) if missing_as_one else value)
    tested, rest = use.filter("_p is not null"), use.filter("_p is null")
    if by:
        w = W.partitionBy(*by)
        ranked = tested.withColumn("_rank", F.row_number().over(w.orderBy("_p", key))).withColumn("_m", F.count(F.lit(1)).over(w))
        ranked = ranked.withColumn("_v", F.col("_p") * F.col("_m") / F.col("_rank") * (factor if factor is not None else F.lit(1.0)))
        ranked = ranked.withColumn(out, F.min("_v").over(w.orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, W.currentRow)))
    else:
        # one range partitioning serves ranks and running minima; a row for each partition carries counts and minima across
        ranged = materialize(tested.repartitionByRange("_p", key).withColumn("_part", F.spark_partition_id()))
        counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_m"))
        ranked = ranged.join(F.broadcast(before), "_part").withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy("_p", key)) + F.col("_before"))
        ranked = ranked.withColumn("_v", F.col("_p") * F.col("_m") / F.col("_rank") * (factor if factor is not None else F.lit(1.0)))
        least = ranked.groupBy("_part").agg(F.min("_v").alias("_least"))
        after = least.select("_part", F.min("_least").over(W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)).alias("_after"))
        own = F.min("_v").over(W.partitionBy("_part").orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, W.currentRow))
        ranked = ranked.withColumn(out, own).join(F.broadcast(after), "_part").withColumn(out, F.least(out, "_after")).drop("_part", "_before", "_after")
    ranked = ranked.withColumn(out, F.when(value.isNotNull(), F.least(out, F.lit(1.0)))) if missing_as_one else ranked.withColumn(out, F.least(out, F.lit(1.0)))
    return ranked.drop("_p", "_rank", "_m", "_v").unionByName(rest.drop("_p").withColumn(out, F.lit(None).cast("double")))


def by_adjust(df: DataFrame, p: str, key: str, out: str = "q") -> DataFrame:
    """Benjamini-Yekutieli: as bh, times the harmonic number of the family's size, which is digamma(m + 1) plus Euler's constant."""
    m = df.filter(finite(p).isNotNull()).count()
    harmonic = float(digamma(np.array([m + 1.0]))[0]) + float(np.euler_gamma)
    return bh(df, p, key, out, factor=F.lit(harmonic))


def weighted_bh(df: DataFrame, p: str, weight: str, key: str, out: str = "q") -> DataFrame:
    """Weights are scaled to mean 1, each p divided by its weight (at most 1), then bh. Weights must be positive."""
    mean = df.filter(finite(p).isNotNull()).agg(F.avg(weight)).collect()[0][0] or 1.0
    scaled = finite(p) * F.lit(float(mean)) / F.col(weight)
    shifted = df.withColumn("_wp", F.when(scaled.isNotNull(), F.least(F.lit(1.0), scaled)))  # least skips nulls
    return bh(shifted, "_wp", key, out).drop("_wp")


def independent_weighting(df: DataFrame, p: str, covariate: str, key: str, bins: int = 5, folds: int = 5, most: float = 3.0, lam: float = 0.5, out: str = "q") -> DataFrame:
    """Independent hypothesis weighting: covariate bins by order statistics; a bin's weight in a fold comes from the share of
    null p-values (Storey at ``lam``) that the other folds show in it; weights are clipped to [1 / most, most] and averaged to 1 in a fold.

    Adds bin, fold and weight. Folds go by the hash of the key.
    """
    n = df.count()
    placed = running_sum(df.withColumn("_one", F.lit(1)), "_one", [covariate, key], "_r").drop("_one")
    placed = placed.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("_r") - 1) * bins / F.lit(max(n, 1)))).cast("int")).drop("_r")
    placed = placed.withColumn("fold", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)).cast("int"))
    cell = placed.groupBy("bin", "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(finite(p) > lam).alias("high"))
    total = cell.groupBy("bin").agg(F.sum("n").alias("tn"), F.sum("high").alias("th"))
    others = cell.join(total, "bin").select("bin", "fold", "n", (F.col("tn") - F.col("n")).alias("on"), (F.col("th") - F.col("high")).alias("oh"))
    null_share = F.least(F.lit(1.0), (F.col("oh") + 1) / (F.lit(1 - lam) * F.greatest(F.col("on"), F.lit(1))))
    raw = others.withColumn("_w", F.least(F.lit(most), F.greatest(F.lit(1 / most), (1 - null_share) / null_share + F.lit(1e-3))))
    mean = F.sum(F.col("_w") * F.col("n")).over(W.partitionBy("fold")) / F.sum("n").over(W.partitionBy("fold"))
    weights = raw.withColumn("weight", F.col("_w") / mean).select("bin", "fold", "weight")
    return weighted_bh(placed.join(F.broadcast(weights), ["bin", "fold"]), p, "weight", key, out)


def hierarchical_bonferroni(nodes: DataFrame, node: str = "node", parent: str = "parent", p: str = "p", out: str = "adjusted", max_depth: int = 64) -> DataFrame:
    """Top-down: a node's p over its share of the leaves, never less than its parent's adjusted value, at most 1.

    Levels are joined one by one, as many rounds as the tree is deep.
    """
    edges = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(p).alias("p"))
    inner = edges.filter("parent is not null").select(F.col("parent").alias("node")).distinct()
    # leaves under each node: every leaf hands itself to all its ancestors
    carried = edges.join(inner, "node", "left_anti").select("node", F.col("node").alias("at"))
    total = carried.count()
    count, step = carried, carried
    for _ in range(max_depth):
        step = materialize(step.join(edges.select(F.col("node").alias("at"), F.col("parent").alias("up")), "at").filter("up is not null").select("node", F.col("up").alias("at")))
        if not step.limit(1).count():
            break
        count = count.unionByName(step)
    leaves = count.groupBy(F.col("at").alias("node")).agg(F.count(F.lit(1)).alias("leaves"))
    scaled = materialize(edges.join(leaves, "node").withColumn("v", F.least(F.lit(1.0), F.col("p") * F.lit(float(total)) / F.col("leaves"))))
    level = materialize(scaled.filter("parent is null").select("node", F.col("v").alias(out)))
    done = level
    for _ in range(max_depth):
        level = materialize(scaled.join(level.select(F.col("node").alias("parent"), F.col(out).alias("up")), "parent").select("node", F.greatest("v", "up").alias(out)))
        if not level.limit(1).count():
            break
        done = done.unionByName(level)
    return nodes.join(done, nodes[node] == done["node"], "left").drop(done["node"]).join(leaves.select(F.col("node").alias(node), "leaves"), node, "left") if node != "node" else nodes.join(done, "node", "left").join(leaves, "node", "left")

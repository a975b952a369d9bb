"""Order-dependent columns without a single-task sort: ranks, running sums and running minima over whole tables.

Rows are range-partitioned by the order, each partition works on its own rows, and the partitions' totals (one row for each partition) carry over.
With ``by`` the same happens inside groups through ordinary windows, which suits many groups of moderate size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from statloom.session import materialize

_P = "_part"


def _ranged(df: DataFrame, order: list) -> DataFrame:
    return materialize(df.repartitionByRange(*order).withColumn(_P, F.spark_partition_id()))


def running_sum(df: DataFrame, value: str, order: list[str], name: str, by: list[str] = ()) -> DataFrame:
    """``name``: the sum of ``value`` up to and including the row, in the order given (which must not have ties)."""
    if by:
        return df.withColumn(name, F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    ranged = _ranged(df, [F.col(c) for c in order])
    totals = ranged.groupBy(_P).agg(F.sum(value).alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(W.orderBy(_P).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(_P, "_before")
    own = F.sum(value).over(W.partitionBy(_P).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranged.withColumn(name, own).join(F.broadcast(before), _P).withColumn(name, F.col(name) + F.col("_before")).drop(_P, "_before")


def running_sums(df: DataFrame, values: dict, order: list, by: list[str] = ()) -> DataFrame:
    """As ``running_sum`` for several columns at once: ``values`` maps new names to columns, ``order`` holds sort columns without ties."""
    if by:
        w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in values.items()])
    ranged = _ranged(df, order)
    totals = ranged.groupBy(_P).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in values.items()])
    upto = W.orderBy(_P).rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    before = totals.select(_P, *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(f"_before_{n}") for n in values])
    own = W.partitionBy(_P).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = ranged.select("*", *[F.sum(c).over(own).alias(n) for n, c in values.items()]).join(F.broadcast(before), _P)
    return out.select(*df.columns, *[(F.coalesce(F.col(n), F.lit(0)) + F.col(f"_before_{n}")).alias(n) for n in values])


def average_ranks(df: DataFrame, value: str, name: str = "rank", by: list[str] = ()) -> DataFrame:
    """``df`` with the average rank of ``value`` (ties share the mean of their ranks) and the number of ties, ``name`` + '_ties'.

    Values are counted first (map-side combine), so ties cost one row each in the ordered step.
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias(f"{name}_ties"))
    upto = running_sum(counts, f"{name}_ties", [value], "_upto", by)
    ranked = upto.select(*by, value, f"{name}_ties", (F.col("_upto") - (F.col(f"{name}_ties") - 1) / 2).alias(name))
    return df.join(ranked, [*by, value])


def running_min_from_end(df: DataFrame, value: str, order: list[str], name: str) -> DataFrame:
    """``name``: the least ``value`` of the row and all rows after it."""
    ranged = _ranged(df, [F.col(c) for c in order])
    least = ranged.groupBy(_P).agg(F.min(value).alias("_least"))
    after = least.withColumn("_after", F.min("_least").over(W.orderBy(F.desc(_P)).rowsBetween(W.unboundedPreceding, -1))).select(_P, "_after")
    own = F.min(value).over(W.partitionBy(_P).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranged.withColumn(name, own).join(F.broadcast(after), _P).withColumn(name, F.least(name, "_after")).drop(_P, "_after")

"""Shared frame helpers: keyed documents, hot-key-safe joins, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.session import materialize, ship, shuffle_partitions

__all__ = ["components", "fresh", "keyed", "materialize", "parts", "ship", "shuffle_partitions", "slices", "table", "whole_rows"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, factor: int = 4) -> int:
    """How many hash parts blobs are dealt to: a few for each shuffle partition, so it follows the cluster's setting."""
    return factor * shuffle_partitions(spark)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_rows(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, one whole row for each key: of rows that repeat a key, the one whose text, then whose other columns as JSON sort first.

    Rows with a null key are left out, as documents are told apart by it. The pass that chooses runs only if a key is repeated.
    """
    rows = docs.filter(F.col(key).isNotNull())
    if not rows.groupBy(key).agg(F.count(F.lit(1)).alias(fresh(docs, "n"))).filter(F.col(fresh(docs, "n")) > 1).limit(1).count():
        return rows
    order = F.struct(F.col(text_col).isNull(), F.col(text_col), F.to_json(F.struct(*[F.col(c) for c in docs.columns])))
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), order).alias(fresh(docs, "row")))
    return first.select([F.col(fresh(docs, "row"))[c].alias(c) for c in docs.columns])


def keyed(docs: DataFrame, key: str = "doc_id", *columns: str) -> DataFrame:
    """``key`` as long and the named columns, one row for each key.

    Rows with a null key cannot be reported or linked and are left out. Rows that repeat a key count
    as one document, the one whose columns sort first (nulls last); the extra pass runs only if there are any.
    """
    columns = columns or ("text",)
    rows = docs.select(F.col(key).cast("long").alias(key), *columns).filter(F.col(key).isNotNull())
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if repeated:
        order = F.struct(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
        rows = rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])
    return rows


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: rows (node, root), root the smallest node reachable.

    Minimum labels travel along edges and then jump to their own label's label, so that the number of rounds grows with the
    logarithm of the longest chain. Every round is one aggregate with map-side combine and one join; the labels are written
    to the shared folder between rounds, nothing is collected. Nodes without an edge have no row.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    both = materialize(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root"))
    labels = materialize(labels)
    for _ in range(max_rounds):
        # the smallest label next to each node, hooked onto the node and onto the node's present root
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        seen = materialize(labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low")))
        # many nodes share a root: both joins on it read written tables, so that AQE can split a hot one
        hooks = materialize(seen.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("hook")))
        step = materialize(seen.join(hooks, seen["root"] == hooks["r"], "left").select("node", "root", F.least("low", F.coalesce("hook", "low")).alias("low")))
        jump = step.select(F.col("node").alias("at"), F.col("low").alias("far"))
        new = step.join(jump, step["low"] == jump["at"], "left").select("node", F.least("low", F.coalesce("far", "low")).alias("root"), F.col("root").alias("old"))
        new = materialize(new)
        changed = new.filter("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def slices(batches, rows: int = 256):
    """Smaller batches, so that what a task makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(schema))

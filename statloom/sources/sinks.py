"""Result tables: one DataFrame of ok, filtered and failed rows, adjusted and written at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.multiplicity import bh


def results(ok: DataFrame, filtered: DataFrame | None = None, failed: DataFrame | None = None, key: str = "feature_id", p: str = "p_value", reasons: str = "reasons") -> DataFrame:
    """The union with ``status``, ``filter_reason`` (reasons joined by ;), ``failure_reason`` and ``fdr_bh`` over the ok rows."""
    parts = [ok.withColumn("status", F.lit("ok")).withColumn("filter_reason", F.lit("")).withColumn("failure_reason", F.lit(""))]
    if filtered is not None:
        parts.append(filtered.withColumn("status", F.lit("filtered")).withColumn("filter_reason", F.array_join(reasons, ";")).drop(reasons).withColumn("failure_reason", F.lit("")))
    if failed is not None:
        parts.append(failed.withColumn("status", F.lit("failed")).withColumn("filter_reason", F.lit("")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return bh(out, p, key, "fdr_bh")


def write_table(df: DataFrame, path: str, missing: str = "NA") -> None:
    """Delimited text with a header; refuses to overwrite, and publishes by the job's commit."""
    text = df.select(*[F.coalesce(F.nanvl(F.col(f"`{c}`"), F.lit(None)).cast("string") if t in ("double", "float") else F.col(f"`{c}`").cast("string"), F.lit(missing)).alias(c) for c, t in df.dtypes])
    text.write.mode("errorifexists").csv(path, header=True, sep="," if path.endswith(".csv") else "\t")


def annotate(df: DataFrame, annotation: DataFrame, key: str, prefix: str = "annot_") -> DataFrame:
    """Left join of a table whose key is unique; unmatched text is empty."""
    if annotation.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError("annotation keys repeat")
    others = [c for c in annotation.columns if c != key]
    side = annotation.select(F.col(key), *[F.col(c).cast("string").alias(f"{prefix}{c}") for c in others])
    out = df.join(side, key, "left")
    return out.select(*df.columns, *[F.coalesce(F.col(f"{prefix}{c}"), F.lit("")).alias(f"{prefix}{c}") for c in others])

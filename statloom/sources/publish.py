"""Finished results: coefficient tables, one row for each variant event, and result folders that appear whole with a manifest of digests."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators import regression as rg
from statloom.operators.multiplicity import bh
from statloom.sources.sinks import write_table

# The columns of an event table, in order.
EVENTS = (
    "status", "id", "chromosome", "position", "ref", "alt", "called", "missing", "missing_rate", "mac", "maf", "info",
    "beta", "se", "statistic", "df", "p", "log10_p", "negative_log10_p", "filter_reason", "error_type", "message",
)


def coefficients(spark: SparkSession, fit: rg.Fit, transform: str | None = None) -> DataFrame:
    """One row for each term: status, term, beta, standard_error, statistic, degrees of freedom, partial_r2 (t statistics only), p_value and fdr_bh.

    The intercept takes no part in the adjustment and has no fdr_bh. ``transform`` names a column of exp(beta), such as odds_ratio. Numbers that
    are not finite are null.
    """
    t = fit.table()
    finite = np.isfinite(fit.df)
    square = t["statistic"] ** 2
    rows = t.assign(status="ok", df_numerator=1, df_denominator=fit.df if finite else np.nan, partial_r2=square / (square + fit.df) if finite else np.nan, tested=t["p_value"].where(t["term"] != rg.ONE), at=np.arange(len(t)))
    if transform:
        rows[transform] = np.exp(t["estimate"])
    names = ["status", "term", "beta", "standard_error", "statistic", "df_numerator", "df_denominator", "partial_r2", *([transform] if transform else []), "p_value"]
    d = spark.createDataFrame(rows.rename(columns={"estimate": "beta", "se": "standard_error"}))
    d = d.select(*[_number(F.col(c)).alias(c) if c not in ("status", "term", "df_numerator") else F.col(c) for c in [*names, "tested"]], "at")
    return bh(d, "tested", "term", "fdr_bh").orderBy("at").select(*names, "fdr_bh")


def _number(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def events(tested: DataFrame, excluded: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """All events under one header: ``tested`` estimates, ``excluded`` variants with their ``reasons`` (an array) and ``failed`` ones with error_type and message.

    Columns that an input lacks are null; others than the header's are dropped. ``log10_p`` and its negative come from ``p`` where they are not given.
    """
    parts = [(tested, "tested")] + ([(excluded, "excluded")] if excluded is not None else []) + ([(failed, "failure")] if failed is not None else [])
    out = None
    for d, status in parts:
        have = set(d.columns)
        if status == "excluded" and "reasons" in have:
            d, have = d.withColumn("filter_reason", F.array_join("reasons", ";")), have | {"filter_reason"}
        if status == "tested" and "p" in have:
            d = d if "log10_p" in have else d.withColumn("log10_p", F.when(F.col("p") > 0, F.log10("p")))
            d = d if "negative_log10_p" in have else d.withColumn("negative_log10_p", -F.col("log10_p"))
            have |= {"log10_p", "negative_log10_p"}
        rows = d.select(F.lit(status).alias("status"), *[F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in EVENTS[1:]])
        out = rows if out is None else out.unionByName(rows)
    return out


def write_events(path: str, tested: DataFrame, excluded: DataFrame | None = None, failed: DataFrame | None = None) -> None:
    """The events as delimited text (comma for ``.csv``, else tab); refuses to overwrite."""
    write_table(events(tested, excluded, failed), path, missing="")


def _files(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, sha256) of every file below ``path``; the files are read by the executors, each whole, so none may exceed 2 GB."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return d.select("path", "length", F.sha2("content", 256).alias("sha256")).select(F.col("path").alias("file"), "length", "sha256")


def write_manifest(spark: SparkSession, path: str, values: dict) -> None:
    """A JSON file with a schema version and a time; refuses to overwrite. Values are strings, numbers, lists or dictionaries of these."""
    at, fs = _files(spark, path)
    text = json.dumps({"schema_version": 1, "created": datetime.now(timezone.utc).isoformat()} | values, indent=2, default=str) + "\n"
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], operation: str, options: dict | None = None, inputs: list[str] = ()) -> dict:
    """A result folder that exists whole or not at all: each table as Parquet below its name, and ``manifest.json``.

    Everything is written beside the target first and moved in one rename; an existing target is an error, and after a failure nothing is left. The
    manifest holds the options, the digests of the input files and, relative to the folder, of all output files.
    """
    target, fs = _files(spark, path.rstrip("/"))
    if fs.exists(target):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging-{spark.sparkContext.applicationId}"
    started = datetime.now(timezone.utc).isoformat()
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{staging}/{name}")
        known = {f"{name}/{r['file'].rsplit('/', 1)[1]}": r["sha256"] for name in tables for r in digests(spark, f"{staging}/{name}").filter("file like '%.parquet'").collect()}
        read = {r["file"]: r["sha256"] for p in inputs for r in digests(spark, p).collect()}
        manifest = {"operation": operation, "started_at": started, "options": options or {}, "input_sha256": read, "output_sha256": known}
        write_manifest(spark, f"{staging}/manifest.json", manifest)
        if fs.exists(target) or not fs.rename(_files(spark, staging)[0], target):
            raise FileExistsError(path)
    except BaseException:
        fs.delete(_files(spark, staging)[0], True)
        raise
    return manifest

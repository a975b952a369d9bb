"""A feature-wide association from a formula: align, transform, filter, scan, annotate, adjust.

The router picks the scan by the response: least squares for numbers, score tests of one null model for binary or count responses; the covariates
are factored once and every feature costs one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators import genetics as ge
from statloom.operators import regression as rg
from statloom.operators import transforms as tr
from statloom.plans import formula as fm
from statloom.sources import sinks


def route(phenotype: DataFrame, response: str, family: str = "auto") -> str:
    if family != "auto":
        return family
    r = phenotype.agg(F.min(response).alias("a"), F.max(response).alias("b"), F.count_if(~F.col(response).isin(0.0, 1.0)).alias("n")).collect()[0]
    return "binomial" if r["n"] == 0 and r["a"] == 0 and r["b"] == 1 else "gaussian"


def associate(phenotype: DataFrame, features: DataFrame, formula: str, family: str = "auto", transform: str | None = None, order: str | None = None, variants: bool = False, annotation: DataFrame | None = None, **filters) -> DataFrame:
    """Result rows (ok, filtered, failed) with adjusted p for ``y ~ <omics> + covariates``.

    ``phenotype`` has sample_id; ``features`` are long rows (feature_id, sample_id, value). With ``variants`` values are dosages and ``filters`` go to
    the variant filter; excluded variants stay in the table with their reasons.
    """
    f = fm.parse(formula)
    if not f.omics or f.random or f.smooths or f.survival:
        raise ValueError("the scan takes y ~ <omics> + fixed covariates")
    d, names = fm.with_design(phenotype, f, order)
    covariates = [n for n in names if n != fm.INTERCEPT]
    d = rg.complete(d, f.response[0], *covariates)
    use = features.join(d.select("sample_id"), "sample_id", "left_semi")
    filtered = None
    if variants:
        stats = ge.variant_filters(ge.variant_statistics(use.withColumnRenamed("value", "dosage"), "feature_id"), **filters)
        bad = stats.filter(F.size("reasons") > 0)
        filtered = bad.select("feature_id", "called", "reasons")
        use = use.join(bad.select("feature_id"), "feature_id", "left_anti")
    if transform:
        use = tr.apply(use, transform)
    kind = route(d, f.response[0], family)
    if kind == "gaussian":
        out = rg.scan(use, d, f.response[0], covariates)
    else:
        out = rg.score_scan(use, d, f.response[0], covariates, kind)
    ok = out.filter("status = 'ok'").drop("status")
    failed = out.filter("status <> 'ok'").withColumn("failure_reason", F.col("status")).drop("status")
    table = sinks.results(ok, filtered, failed)
    return sinks.annotate(table, annotation, "feature_id") if annotation is not None else table

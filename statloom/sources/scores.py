"""Readers of score summaries: single-variant scores with windowed covariances, exports of a conditional scan, and key=value annotations of a VCF.

Text, gzipped or not. What breaks a file's contract is an error, found when the rows are read (checks that need a whole table run a job at once).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.sources.tables import delimited

# Tokens for a missing number in score files, required columns, and the two layouts of covariance rows (marker list, value list).
MISSING = ("NA", ".", "NaN")
REQUIRED = ("CHROM", "POS", "REF", "ALT", "N_INFORMATIVE", "U_STAT", "SQRT_V_STAT")
LAYOUTS = {4: (2, 3), 6: (4, 5)}
#: Covariances and variances are printed with few digits.
TOLERANCE = 2e-4


def _fail(bad: Column, message: str, otherwise: Column) -> Column:
    """``otherwise``, or an error. Filters may be evaluated in any order, so ``bad`` must be false on lines that are not data."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("string")).otherwise(otherwise.cast("string"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    data = (F.trim("value") != "") & ~F.col("value").rlike("^(#|CHROM)")
    return spark.read.text(path).filter(data).select(data.alias("data"), F.when(data, F.when(F.col("value").contains("\t"), F.split("value", "\t")).otherwise(F.split(F.trim("value"), r"\s+"))).alias("f"))


def metadata(spark: SparkSession, path: str) -> dict:
    """The ``##key=value`` declarations of a file."""
    rows = spark.read.text(path).filter(F.col("value").rlike("^##[^=]+=")).collect()
    return {k.strip(): v.strip() for k, v in (r[0][2:].split("=", 1) for r in rows)}


def _chromosome(c: Column) -> Column:
    return F.regexp_replace(c, "^chr", "")


def score_statistics(spark: SparkSession, path: str, min_call_rate: float = 0.0, min_hwe: float = 0.0) -> DataFrame:
    """(chromosome, position, ref, alt, samples, frequency, score, variance, status, call_rate, hwe): one row for each biallelic variant.

    ``status`` is ok, missing, monomorphic, qc_excluded or invalid_alleles; score and variance are null unless ok. A blank, ``.`` or ``0`` ALT is a
    monomorphic site of frequency 0. The file must declare ``##AnalyzedSamples``; repeated positions are an error.
    """
    samples = metadata(spark, path).get("AnalyzedSamples", "")
    if not samples.isdigit() or int(samples) < 1:
        raise ValueError(f"{path}: a positive ##AnalyzedSamples is required")
    head = spark.read.text(path).filter(F.col("value").rlike("^#*CHROM")).limit(1).collect()
    names = (head[0][0].lstrip("#") if head else "").split("\t" if head and "\t" in head[0][0] else None)
    lacking = [c for c in REQUIRED if c not in names]
    if lacking:
        raise ValueError(f"{path}: missing score columns {lacking}")
    text = lambda c: F.get("f", F.lit(names.index(c)))
    number = lambda c: F.when(~F.trim(text(c)).isin(*MISSING), text(c).cast("double")) if c in names else F.lit(None).cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    d = _lines(spark, path).select(
        "data", _chromosome(text("CHROM")).alias("chromosome"), text("POS").cast("long").alias("position"), text("REF").alias("ref"), F.when(text("ALT").isin(".", "0"), "").otherwise(text("ALT")).alias("alt"),
        number("N_INFORMATIVE").alias("samples"), number("ALL_AF" if "ALL_AF" in names else "AF").alias("af"), number("U_STAT").alias("u"), number("SQRT_V_STAT").alias("root"),
        number("CALL_RATE").alias("call_rate"), number("HWE_PVALUE").alias("hwe"), *[number(c).alias(c.lower()) for c in ("N_REF", "N_HET", "N_ALT")],
    )
    one = (F.col("n_het") == 0) & (((F.col("n_ref") > 0) & (F.col("n_alt") == 0)) | ((F.col("n_alt") > 0) & (F.col("n_ref") == 0))) & ~finite(F.col("u")) & ~finite(F.col("root"))
    blank = F.col("alt") == ""
    odd = blank & ~F.coalesce(F.col("af").isin(0.0, 1.0), F.lit(False)) & ~F.coalesce(one, F.lit(False))
    d = d.withColumn("odd", odd).withColumn("af", F.when(odd, F.lit(None)).when(blank, 0.0).otherwise(F.col("af")))
    qc = F.lit(True)
    if min_call_rate > 0:
        qc = qc & F.coalesce(F.col("call_rate") >= min_call_rate, F.lit(False))
    if min_hwe > 0:
        qc = qc & F.coalesce(F.col("hwe") >= min_hwe, F.lit(False))
    usable = finite(F.col("u")) & finite(F.col("root")) & (F.col("root") > 0)
    status = F.when(F.col("odd"), "invalid_alleles").when(~qc, "qc_excluded").when((F.col("samples") == 0) | F.col("af").isNull(), "missing")
    status = status.when(F.col("af").isin(0.0, 1.0), "monomorphic").when(~usable, "missing").otherwise("ok")
    endless = lambda c: F.coalesce(F.abs(F.col(c)) == F.lit(float("inf")), F.lit(False))
    rules = [
        (~F.col("ref").rlike("^[ACGT]+$") | (~blank & (~F.col("alt").rlike("^[ACGT]+$") | (F.col("alt") == F.col("ref")))), "only biallelic A/C/G/T alleles are read"),
        (F.col("samples").isNull() | (F.col("samples") < 0) | (F.col("samples") > int(samples)), "invalid informative sample count"),
        (~F.coalesce(F.col("af").between(0, 1), F.lit(True)), "invalid allele frequency"),
        (endless("u") | endless("root") | F.coalesce(F.col("root") < 0, F.lit(False)), "invalid score or variance"),
        (F.col("position").isNull() | ~F.col("position").between(1, 2**31 - 1), "position outside the genomic range"),
    ]
    broken = F.coalesce(*[F.when(F.col("data") & bad, F.lit(f"{path}: {message}")) for bad, message in rules])
    d = d.withColumn("broken", broken).withColumn("status", F.when(F.col("broken").isNotNull(), F.raise_error(F.col("broken")).cast("string")).otherwise(status))
    ok = F.col("status") == "ok"
    out = d.select("chromosome", "position", "ref", "alt", "samples", F.col("af").alias("frequency"), F.when(ok, F.col("u")).alias("score"), F.when(ok, F.col("root") * F.col("root")).alias("variance"), "status", "call_rate", "hwe")
    if out.groupBy("chromosome", "position").count().filter("count > 1").limit(1).count():
        raise ValueError(f"{path}: repeated or multiallelic positions")
    return out


def score_covariances(spark: SparkSession, path: str, samples: int) -> DataFrame:
    """(chromosome, a, b, covariance) with a <= b: pairs of positions within the windows, on the scale of the scores.

    Rows hold a list of markers and one of values, in either of two layouts. Values are per sample unless the file declares ``##CovarianceScale=score``. Pairs that
    are given twice must agree.
    """
    scale = 1.0 if metadata(spark, path).get("CovarianceScale") == "score" else float(samples)
    n = F.size("f")
    pick = lambda k: F.when(n == 4, F.get("f", F.lit(LAYOUTS[4][k]))).when(n == 6, F.get("f", F.lit(LAYOUTS[6][k]))).otherwise(_fail(F.col("data"), f"{path}: unsupported covariance layout", F.lit("")))
    d = _lines(spark, path).select("data", _chromosome(F.get("f", F.lit(0))).alias("chromosome"), F.get("f", F.lit(1)).cast("long").alias("i"), F.split(F.regexp_replace(pick(0), ",$", ""), ",").alias("at"), F.split(F.regexp_replace(pick(1), ",$", ""), ",").alias("v"))
    d = d.withColumn("at", F.when(F.size("at") == F.size("v"), F.col("at")).otherwise(F.array(_fail(F.col("data"), f"{path}: as many markers as values are needed", F.lit("")))))
    d = d.select("chromosome", "i", F.inline(F.arrays_zip("at", "v"))).select("chromosome", "i", F.col("at").cast("long").alias("j"), (F.col("v").cast("double") * F.lit(scale)).alias("c"))
    d = d.groupBy("chromosome", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.min("c").alias("covariance"), F.max("c").alias("most"))
    same = (F.col("most") - F.col("covariance")) <= TOLERANCE * F.greatest(F.abs("most"), F.abs("covariance"))
    bad = ~F.coalesce(same, F.lit(False)) | F.isnan("covariance") | (F.abs("covariance") == F.lit(float("inf")))
    return d.select("chromosome", "a", "b", _fail(bad, f"{path}: non-finite or inconsistent covariances", F.col("covariance")).cast("double").alias("covariance"))


def informative_covariances(scores: DataFrame, covariances: DataFrame) -> DataFrame:
    """Pairs of ok variants, with each diagonal held against the variance of the score; ok variants without a diagonal come with a null covariance."""
    ok = scores.filter("status = 'ok'").select("chromosome", "position", "variance")
    both = covariances.join(ok.select("chromosome", F.col("position").alias("a")), ["chromosome", "a"], "left_semi").join(ok.select("chromosome", F.col("position").alias("b")), ["chromosome", "b"], "left_semi")
    own = ok.select("chromosome", F.col("position").alias("a"), F.col("position").alias("b"), "variance").join(both, ["chromosome", "a", "b"], "left")
    bad = F.abs(F.col("covariance") - F.col("variance")) > TOLERANCE * F.greatest("variance", F.abs("covariance"))
    own = own.select("chromosome", "a", "b", _fail(F.coalesce(bad, F.lit(False)), "covariance diagonal and score variance disagree", F.col("covariance")).cast("double").alias("covariance"))
    return own.unionByName(both.filter("a <> b").select("chromosome", "a", "b", "covariance"))


def conditional_scores(spark: SparkSession, summary: str, covariance: str, manifest: str, variants: list[str]) -> tuple[DataFrame, DataFrame, dict]:
    """(scores, covariances, manifest) of the requested variants from one finished export of a conditional scan.

    The three files must agree: a complete manifest with a converged null model and its counts of variants and blocks; every scored row ok and of that null
    model; blocks numbered from 1 and no larger than declared. All variants asked for must lie in one covariance block, because the covariance between blocks is
    unknown, not zero; the diagonal must equal the score variance.
    """
    info = json.loads(spark.read.text(manifest, wholetext=True).collect()[0][0])
    for key, want in {"status": "complete", "null_converged": "true", "effect_allele": "ALT"}.items():
        if str(info.get(key)) != want:
            raise ValueError(f"{manifest}: {key} must be {want}")
    if len(set(variants)) != len(variants) or not variants:
        raise ValueError("name each requested variant once")
    d = delimited(spark, summary).filter(F.trim("score_variant_key") != "")
    d = d.select("status", "null_model_id", "conditioning_set_id", F.col("score_variant_key").alias("variant"), F.col("score_u").cast("double").alias("score"), F.col("score_variance").cast("double").alias("variance"), F.col("score_covariance_block").cast("long").alias("block"))
    wrong = (F.col("status") != "ok") | (F.col("null_model_id") != F.lit(str(info["null_model_id"]))) | (F.col("conditioning_set_id") != F.lit(str(info["conditioning_set_id"])))
    blocks = d.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("wrong"), F.countDistinct("variant").alias("different"))
    r = blocks.agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong"), F.count(F.lit(1)).alias("k"), F.min("block").alias("first"), F.max("block").alias("last"), F.max("n").alias("most"), F.sum("different").alias("different")).collect()[0]
    n, k = int(info["exported_variants"]), int(info["covariance_blocks"])
    if (r["n"] or 0) != n or r["k"] != k or r["wrong"] or (n and (r["first"] != 1 or r["last"] != k or r["different"] != n)) or (r["most"] or 0) > int(info["maximum_block_variants"]):
        raise ValueError(f"{summary}: rows, null model or blocks differ from the manifest")
    asked = d.filter(F.col("variant").isin(*variants)).select("variant", "score", "variance", "block")
    got = asked.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("block").alias("k"), F.min("block").alias("block")).collect()[0]
    if got["n"] != len(variants):
        raise ValueError("requested variants are absent")
    if got["k"] != 1:
        raise ValueError("requested variants lie in several covariance blocks")
    c = delimited(spark, covariance).filter((F.col("score_covariance_block").cast("long") == got["block"]) & F.col("variant_i").isin(*variants) & F.col("variant_j").isin(*variants))
    c = c.filter(F.col("null_model_id") == F.lit(str(info["null_model_id"]))).select(F.least("variant_i", "variant_j").alias("a"), F.greatest("variant_i", "variant_j").alias("b"), F.col("score_covariance").cast("double").alias("covariance")).distinct()
    held = c.join(asked.select(F.col("variant").alias("a"), "variance"), "a", "left")
    off = F.abs(F.col("covariance") - F.col("variance")) > 1e-8 * F.greatest(F.abs("covariance"), F.abs("variance"))
    r = held.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a", "b").alias("pairs"), F.count_if((F.col("a") == F.col("b")) & F.coalesce(off, F.lit(True))).alias("off")).collect()[0]
    if r["n"] != r["pairs"] or r["pairs"] != len(variants) * (len(variants) + 1) // 2 or r["off"]:
        raise ValueError(f"{covariance}: pairs are missing or repeated, or a diagonal differs from the score variance")
    return asked, c, info


def info_fields(spark: SparkSession, path: str) -> DataFrame:
    """(variant_id, chromosome, position, ref, alt, info): the INFO column of a VCF as a map; items without ``=`` are left out, of repeated keys the last counts."""
    f = F.split("value", "\t")
    field = lambda k: F.get(f, F.lit(k))
    d = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    items = F.filter(F.split(field(7), ";"), lambda x: F.instr(x, "=") > 0)
    d = d.select(field(2).alias("variant_id"), _chromosome(field(0)).alias("chromosome"), field(1).cast("long").alias("position"), field(3).alias("ref"), field(4).alias("alt"), items.alias("_items"))
    d = d.withColumn("_keys", F.array_distinct(F.transform("_items", lambda x: F.substring_index(x, "=", 1))))
    last = lambda k: F.element_at(F.filter("_items", lambda x: F.startswith(x, F.concat(k, F.lit("=")))), -1)
    values = F.transform("_keys", lambda k: F.regexp_replace(last(k), "^[^=]*=", ""))
    return d.withColumn("info", F.map_from_arrays("_keys", values)).drop("_items", "_keys")


def gene_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(variant_id, gene, consequence, protocol): a row for each ``Gene.<protocol>`` of INFO; a variant without one has a row of nulls."""
    d = info_fields(spark, path)
    names = F.filter(F.map_keys("info"), lambda k: k.startswith("Gene."))
    d = d.withColumn("protocol", F.explode_outer(F.transform(names, lambda k: F.substring(k, 6, 1000))))
    exonic = F.element_at("info", F.concat(F.lit("ExonicFunc."), F.col("protocol")))
    return d.select("variant_id", F.element_at("info", F.concat(F.lit("Gene."), F.col("protocol"))).alias("gene"), F.coalesce(F.when(exonic != ".", exonic), F.element_at("info", F.concat(F.lit("Func."), F.col("protocol")))).alias("consequence"), "protocol")

"""Readers of delimited tables, matrices, variants, gene sets and ontologies, as DataFrames of text or long rows.

Suffix decides the delimiter: ``.csv`` (also ``.csv.gz``) is comma, anything else tab. Headers are required, unique and not blank; a line with another number of
fields is an error.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens that mean missing in phenotypes and in cohort files.
PHENOTYPE_MISSING = ("", ".", "na", "n/a", "null", "nan")
COHORT_MISSING = ("", ".", "NA", "NaN")


def separator(path: str) -> str:
    return "," if path.lower().removesuffix(".gz").endswith(".csv") else "\t"


def header(spark: SparkSession, path: str) -> list[str]:
    line = spark.read.text(path).limit(1).collect()
    if not line:
        raise ValueError(f"{path} is empty")
    rows = spark.read.option("sep", separator(path)).option("quote", '"').option("escape", '"').csv(spark.createDataFrame([(line[0][0],)], "value string").rdd.map(lambda r: r[0])).collect()
    names = [("" if v is None else v).strip() for v in rows[0]]
    if names and names[0] == "":
        names[0] = "__row_name__"
    twice = [n for n, k in Counter(names).items() if k > 1]
    if "" in names or twice:
        raise ValueError(f"{path}: blank or repeated column names {twice}")
    return names


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; ragged rows fail."""
    names = header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(path, schema=schema, sep=separator(path), header=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=True, emptyValue="", ignoreLeadingWhiteSpace=False)


def number(c: Column, missing: tuple[str, ...] = PHENOTYPE_MISSING, fold: bool = True) -> Column:
    """Text as a number, null where missing; anything else, infinities too, is an error."""
    text = F.trim(c)
    key = F.lower(text) if fold else text
    value = text.try_cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(c.isNotNull() & ~key.isin(*missing), F.when(bad, F.raise_error(F.concat(F.lit("not a finite number: "), text)).cast("double")).otherwise(value))


def phenotype(spark: SparkSession, path: str, id_column: str, categorical: list[str] = ()) -> DataFrame:
    """``sample_id`` and typed columns: numeric where every present value is a number, otherwise text. Ids are unique and not blank."""
    df = delimited(spark, path)
    present = lambda c: F.when(~F.lower(F.trim(F.col(f"`{c}`"))).isin(*PHENOTYPE_MISSING), F.trim(F.col(f"`{c}`")))
    others = [c for c in df.columns if c != id_column]
    wrong = df.agg(*[F.count_if(present(c).isNotNull() & present(c).try_cast("double").isNull()).alias(f"n{i}") for i, c in enumerate(others)], F.count_if(F.trim(F.col(f"`{id_column}`")) == "").alias("blank"), F.count(F.lit(1)).alias("rows"), F.countDistinct(f"`{id_column}`").alias("ids")).collect()[0]
    if wrong["blank"] or wrong["rows"] != wrong["ids"]:
        raise ValueError("sample ids must be unique and not blank")
    cols = [present(c).alias(c) if wrong[f"n{i}"] or c in categorical else present(c).try_cast("double").alias(c) for i, c in enumerate(others)]
    return df.select(F.trim(F.col(f"`{id_column}`")).alias("sample_id"), *cols)


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """A feature by sample matrix as long rows (feature_id, sample_id, value); missing values are null."""
    df = delimited(spark, path)
    first, samples = df.columns[0], df.columns[1:]
    return df.unpivot([first], samples, "sample_id", "_v").select(F.col(f"`{first}`").alias("feature_id"), "sample_id", number(F.col("_v")).alias("value"))


# Leading genomic columns of a dosage matrix.
GENOMIC = ("id", "chromosome", "position", "ref", "alt")


def dosages(spark: SparkSession, path: str) -> DataFrame:
    """(variant_id, chromosome, position, ref, alt, sample_id, dosage) from a matrix with one or five leading columns."""
    df = delimited(spark, path)
    lead = 5 if tuple(c.lower() for c in df.columns[:5]) == GENOMIC else 1
    keys = df.columns[:lead]
    long = df.unpivot(list(keys), df.columns[lead:], "sample_id", "_v")
    meta = [F.col(f"`{keys[k]}`").alias(n) if k < lead else F.lit(None).cast("string").alias(n) for k, n in enumerate(("variant_id", "chromosome", "_position", "ref", "alt"))]
    return long.select(*meta, "sample_id", number(F.col("_v")).alias("dosage")).withColumn("position", F.col("_position").cast("long")).drop("_position")


def vcf(spark: SparkSession, path: str, info_quality: tuple[str, ...] = ("R2", "INFO", "DR2")) -> DataFrame:
    """One row for each variant, ALT allele and sample: dosage from DS, else counted in GT with any no-call missing.

    Text VCF, gzipped or not. A record with several ALT alleles gives one variant each, named id:alt; quality is the first of ``info_quality`` in [0, 1].
    """
    lines = spark.read.text(path)
    head = lines.filter(F.col("value").startswith("#CHROM")).limit(1).collect()
    if not head:
        raise ValueError(f"{path} has no #CHROM line")
    samples = head[0][0].split("\t")[9:]
    f = F.split("value", "\t")
    body = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(f.alias("f"))
    body = body.select(F.col("f")[0].alias("chromosome"), F.col("f")[1].cast("long").alias("position"), F.col("f")[2].alias("_id"), F.col("f")[3].alias("ref"), F.split(F.col("f")[4], ",").alias("_alts"), F.col("f")[7].alias("_info"), F.split(F.col("f")[8], ":").alias("_format"), F.slice("f", 10, 1_000_000_000).alias("_calls"))
    body = body.select("*", F.posexplode("_alts").alias("_k", "alt"))
    named = F.when((F.col("_id") == ".") | F.col("_id").isNull(), F.concat_ws(":", "chromosome", "position", "ref")).otherwise(F.col("_id"))
    body = body.withColumn("variant_id", F.when(F.size("_alts") > 1, F.concat_ws(":", named, "alt")).when(F.col("_id") == ".", F.concat_ws(":", named, "alt")).otherwise(named))
    quality = F.coalesce(*[F.when(q.between(0, 1), q) for q in (F.regexp_extract("_info", rf"(?:^|;){k}=([^;,]+)", 1).try_cast("double") for k in info_quality)])
    body = body.withColumn("quality", quality)
    at = lambda key: F.array_position("_format", F.lit(key)).cast("int")
    calls = body.select("variant_id", "chromosome", "position", "ref", "alt", "quality", "_k", at("DS").alias("_ds"), at("GT").alias("_gt"), F.posexplode("_calls").alias("_s", "_call"))
    parts = F.split("_call", ":")
    ds = F.when(F.col("_ds") > 0, F.get(F.split(F.get(parts, F.col("_ds") - 1), ","), F.col("_k")).try_cast("double"))
    gt = F.split(F.get(parts, F.col("_gt") - 1), r"[/|]")
    counted = F.when((F.col("_gt") > 0) & ~F.exists(gt, lambda a: a == F.lit(".")), F.size(F.filter(gt, lambda a: a == (F.col("_k") + 1).cast("string"))).cast("double"))
    names = F.array(*[F.lit(s) for s in samples])
    return calls.select("variant_id", "chromosome", "position", "ref", "alt", "quality", F.get(names, F.col("_s")).alias("sample_id"), F.coalesce(ds, counted).alias("dosage"))


def gmt(spark: SparkSession, path: str) -> DataFrame:
    """Gene sets as (set_id, name, gene), genes once a set."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(f[0].alias("set_id"), f[1].alias("name"), F.explode(F.array_distinct(F.slice(f, 3, 1_000_000_000))).alias("gene"))
    return rows.filter(F.trim("gene") != "")


def term_to_gene(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", separator(path))
    return spark.read.text(path).select(f[0].alias("set_id"), f[0].alias("name"), f[1].alias("gene")).filter("gene <> ''").distinct()


def gaf(spark: SparkSession, path: str) -> DataFrame:
    """Annotation file: (set_id, gene, qualifier, evidence) without NOT annotations."""
    f = F.split("value", "\t")
    return spark.read.text(path).filter(~F.col("value").startswith("!")).select(f[4].alias("set_id"), f[2].alias("gene"), f[3].alias("qualifier"), f[6].alias("evidence")).filter(~F.col("qualifier").contains("NOT"))


def obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terms (id, name, obsolete) and edges (child, parent) by is_a and part_of, from stanzas split by blank lines."""
    stanza = spark.read.option("lineSep", "\n\n").text(path).filter(F.trim("value").startswith("[Term]"))
    grab = lambda key: F.regexp_extract("value", rf"(?m)^{key}: (\S+)", 1)
    terms = stanza.select(grab("id").alias("id"), F.regexp_extract("value", r"(?m)^name: (.+)$", 1).alias("name"), F.col("value").rlike(r"(?m)^is_obsolete: true").alias("obsolete"))
    up = F.array_union(F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), 1), F.regexp_extract_all("value", F.lit(r"(?m)^relationship: part_of (\S+)"), 1))
    return terms, stanza.select(grab("id").alias("child"), F.explode(up).alias("parent"))


def cohort(spark: SparkSession, path: str, name: str, feature: str = "feature_id", effect: str = "beta", se: str = "se") -> DataFrame:
    """(feature, cohort, effect, se) of one cohort's summary; a repeated feature is an error."""
    df = delimited(spark, path).select(F.trim(F.col(f"`{feature}`")).alias("feature"), F.lit(name).alias("cohort"), number(F.col(f"`{effect}`"), COHORT_MISSING, False).alias("effect"), number(F.col(f"`{se}`"), COHORT_MISSING, False).alias("se"))
    if df.groupBy("feature").count().filter("count > 1").limit(1).count():
        raise ValueError(f"{path} repeats a feature")
    return df


def sparse_counts(spark: SparkSession, path: str) -> DataFrame:
    """Single-cell triplets (obs_id, feature_id, count): whole numbers from 0 on, each pair once."""
    df = delimited(spark, path)
    if tuple(df.columns) != ("obs_id", "feature_id", "count"):
        raise ValueError("columns must be obs_id, feature_id, count")
    df = df.withColumn("count", F.col("count").cast("long"))
    bad = df.groupBy("obs_id", "feature_id").agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("low")).filter("n > 1 or low < 0").limit(1).count()
    if bad:
        raise ValueError("a pair is repeated or a count is negative")
    return df


def square(spark: SparkSession, path: str) -> DataFrame:
    """A labelled square matrix as (row, col, value)."""
    df = delimited(spark, path)
    first = df.columns[0]
    return df.unpivot([first], df.columns[1:], "col", "_v").select(F.col(f"`{first}`").alias("row"), "col", number(F.col("_v")).alias("value"))


def pedigree(spark: SparkSession, path: str) -> DataFrame:
    """(family, id, sire, dam), unknown parents null; parents without a row become founders."""
    df = delimited(spark, path)
    names = {c.lower(): c for c in df.columns}
    pick = lambda *options: next((F.trim(F.col(f"`{names[o]}`")) for o in options if o in names), F.lit(None).cast("string"))
    unknown = lambda c: F.when(~c.isin("", "NA", "0", ".", "-9"), c)
    p = df.select(pick("family", "fid").alias("family"), pick("id", "iid", "individual").alias("id"), unknown(pick("sire", "father", "pat")).alias("sire"), unknown(pick("dam", "mother", "mat")).alias("dam"))
    parents = p.select("family", F.explode(F.array("sire", "dam")).alias("id")).filter("id is not null").distinct()
    missing = parents.join(p.select("family", "id"), (parents["id"] == p["id"]) & parents["family"].eqNullSafe(p["family"]), "left_anti")
    return p.unionByName(missing.select("family", "id", F.lit(None).cast("string").alias("sire"), F.lit(None).cast("string").alias("dam")))


def detect_format(path: str) -> str:
    low = path.lower().removesuffix(".gz")
    for suffix, kind in ((".vcf", "vcf"), (".bcf", "bcf"), (".bgen", "bgen"), (".bed", "plink"), (".csv", "csv"), (".tsv", "tsv"), (".txt", "tsv"), (".parquet", "parquet")):
        if low.endswith(suffix):
            return kind
    raise ValueError(f"unknown format: {path}")


def detect_omics(features: DataFrame, column: str = "feature_id") -> str:
    """variant, methylation or expression if 80 % of the first 1000 ids look like it, otherwise generic."""
    head = features.select(F.col(column).cast("string").alias("v")).limit(1000)
    kinds = {"variant": r"^(rs\d+|(chr)?[0-9XYM]+:\d+.*)$", "methylation": r"^cg\d+.*$", "expression": r"^ENS[A-Z]*\d+.*$"}
    r = head.agg(*[F.avg(F.col("v").rlike(p).cast("double")).alias(k) for k, p in kinds.items()]).collect()[0]
    return next((k for k in kinds if (r[k] or 0) >= 0.8), "generic")

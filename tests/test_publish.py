import hashlib
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import regression as rg
from statloom.sources import publish as pb


def _fit(df=20.0):
    return rg.Fit([rg.ONE, "x", "z"], np.array([5.0, 1.0, -0.5]), np.diag([1.0, 0.25, 0.09]), df, 23)


def test_coefficients_adjust_all_but_the_intercept(spark):
    got = pb.coefficients(spark, _fit(), "odds_ratio").toPandas()
    assert list(got.term) == [rg.ONE, "x", "z"] and got.odds_ratio[1] == pytest.approx(np.e)
    p = got.p_value.to_numpy()
    want = np.minimum(p[1:] * 2 / np.argsort(np.argsort(p[1:])).__add__(1), p[1:].max())
    assert np.isnan(got.fdr_bh[0]) and got.fdr_bh[1:].to_numpy() == pytest.approx(want)
    assert got.partial_r2[1] == pytest.approx(4 / 24) and (got.df_denominator == 20).all()
    got = pb.coefficients(spark, _fit(float("inf"))).toPandas()
    assert got.partial_r2.isna().all() and got.df_denominator.isna().all() and "odds_ratio" not in got


def test_events_share_one_header(spark, tmp_path):
    tested = spark.createDataFrame([("v1", "1", 5, 0.5, 0.01, "x")], "id string, chromosome string, position long, beta double, p double, other string")
    excluded = spark.createDataFrame([("v2", ["MAF_TOO_LOW", "HWE"])], "id string, reasons array<string>")
    failed = spark.createDataFrame([("v3", "Singular", 'a\t"b"')], "id string, error_type string, message string")
    got = {r.id: r for r in pb.events(tested, excluded, failed).collect()}
    assert tuple(got["v1"].asDict()) == pb.EVENTS and float(got["v1"].negative_log10_p) == pytest.approx(2)
    assert (got["v2"].status, got["v2"].filter_reason, got["v3"].status, got["v3"].error_type, got["v2"].p) == ("excluded", "MAF_TOO_LOW;HWE", "failure", "Singular", None)
    path = str(tmp_path / "e.tsv")
    pb.write_events(path, tested, excluded, failed)
    back = spark.read.csv(path, sep="\t", header=True, escape='"').toPandas().set_index("id")
    assert len(back) == 3 and "b" in back.message["v3"]
    with pytest.raises(Exception, match="exists"):
        pb.write_events(path, tested)


def test_a_result_folder_is_whole_or_absent(spark, tmp_path):
    path, source = str(tmp_path / "result"), tmp_path / "in.txt"
    source.write_text("abc")
    df = spark.createDataFrame(pd.DataFrame({"a": [1, 2]}))
    pb.publish(spark, path, {"one": df, "two": df.limit(0)}, "study", {"alpha": 0.05}, [str(source)])
    manifest = json.load(open(f"{path}/manifest.json"))
    assert manifest["operation"] == "study" and list(manifest["input_sha256"].values()) == [hashlib.sha256(b"abc").hexdigest()]
    for name, digest in manifest["output_sha256"].items():
        assert hashlib.sha256(open(f"{path}/{name}", "rb").read()).hexdigest() == digest
    assert {n.split("/")[0] for n in manifest["output_sha256"]} == {"one", "two"} and spark.read.parquet(f"{path}/one").count() == 2
    with pytest.raises(FileExistsError):
        pb.publish(spark, path, {"one": df}, "study")
    bad = df.select(F.raise_error(F.lit("stop")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        pb.publish(spark, str(tmp_path / "other"), {"one": df, "bad": bad}, "study")
    assert sorted(os.listdir(tmp_path)) == ["in.txt", "result"]

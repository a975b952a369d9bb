import gzip
import json

import pytest

from statloom.sources import scores as sc

HEAD = "##AnalyzedSamples=100\n##GenomeBuild=GRCh38\n#CHROM\tPOS\tREF\tALT\tN_INFORMATIVE\tAF\tCALL_RATE\tHWE_PVALUE\tU_STAT\tSQRT_V_STAT\tN_REF\tN_HET\tN_ALT\n"
ROWS = ["chr1\t10\tA\tG\t100\t0.2\t1\t0.5\t1.5\t2\t60\t40\t0", "chr1\t20\tC\t.\t100\t0\t1\t1\tNA\tNA\t100\t0\t0", "1\t30\tC\tT\t0\tNA\t0\tNA\tNA\tNA\t0\t0\t0", "1\t40\tC\tT\t90\t0.1\t0.9\t1e-9\t1\t3\t80\t10\t0", "1\t50\tC\t.\t90\t0.3\t0.9\t1\t1\t3\t80\t10\t0"]


def _write(path, text):
    with (gzip.open if str(path).endswith(".gz") else open)(path, "wt") as f:
        f.write(text)
    return str(path)


@pytest.mark.parametrize("name", ["s.txt", "s.txt.gz"])
def test_score_statistics(spark, tmp_path, name):
    path = _write(tmp_path / name, HEAD + "\n".join(ROWS) + "\n")
    got = {r.position: r for r in sc.score_statistics(spark, path, min_hwe=1e-6).collect()}
    assert [got[k].status for k in (10, 20, 30, 40, 50)] == ["ok", "monomorphic", "qc_excluded", "qc_excluded", "invalid_alleles"]
    assert (got[10].chromosome, got[10].score, got[10].variance, got[20].alt, got[20].frequency, got[40].score) == ("1", 1.5, 4.0, "", 0.0, None)
    got = {r.position: r.status for r in sc.score_statistics(spark, path).collect()}
    assert (got[30], got[40]) == ("missing", "ok")
    assert sc.metadata(spark, path)["GenomeBuild"] == "GRCh38"


@pytest.mark.parametrize("row", ["1\t60\tA\tA\t90\t0.3\t1\t1\t1\t1\t1\t1\t1", "1\t60\tA\tN\t90\t0.3\t1\t1\t1\t1\t1\t1\t1", "1\t60\tA\tG\t900\t0.3\t1\t1\t1\t1\t1\t1\t1", "1\t60\tA\tG\t90\t1.3\t1\t1\t1\t1\t1\t1\t1", "1\t10\tA\tT\t90\t0.3\t1\t1\t1\t1\t1\t1\t1", "1\t0\tA\tT\t90\t0.3\t1\t1\t1\t1\t1\t1\t1", "1\t60\tA\tT\t90\t0.3\t1\t1\t1\t-1\t1\t1\t1"])
def test_broken_scores_are_errors(spark, tmp_path, row):
    with pytest.raises(Exception, match="biallelic|sample count|frequency|repeated|range|score or variance"):
        sc.score_statistics(spark, _write(tmp_path / "s.txt", HEAD + ROWS[0] + "\n" + row + "\n")).collect()


def test_score_file_without_rows_or_samples(spark, tmp_path):
    assert sc.score_statistics(spark, _write(tmp_path / "s.txt", HEAD)).count() == 0
    with pytest.raises(ValueError):
        sc.score_statistics(spark, _write(tmp_path / "t.txt", HEAD.replace("##AnalyzedSamples=100\n", "")))


def test_covariances_in_both_layouts(spark, tmp_path):
    four = _write(tmp_path / "a.txt", "#CHROM\tCURRENT_POS\tMARKERS_IN_WINDOW\tCOV_MATRICES\nchr1\t10\t10,40,\t0.04,-0.01,\n1\t40\t40\t0.09\n")
    six = _write(tmp_path / "b.txt", "##CovarianceScale=score\nCHROM\tSTART_POS\tEND_POS\tNUM_MARKER\tMARKER_POS\tCOV\n1\t10\t40\t2\t10,40\t4,-1\n1\t40\t40\t1\t40\t9\n")
    want = {(10, 10): 4.0, (10, 40): -1.0, (40, 40): 9.0}
    scores = sc.score_statistics(spark, _write(tmp_path / "s.txt", HEAD + "\n".join(ROWS) + "\n"))
    for path in (four, six):
        c = sc.score_covariances(spark, path, 100)
        assert {(r.a, r.b): pytest.approx(r.covariance) for r in c.collect()} == want
        assert {(r.a, r.b): pytest.approx(r.covariance) for r in sc.informative_covariances(scores, c).collect()} == want
    off = _write(tmp_path / "c.txt", "1\t10\t10,40\t0.05,0\n1\t40\t40\t0.09\n")
    with pytest.raises(Exception, match="disagree"):
        sc.informative_covariances(scores, sc.score_covariances(spark, off, 100)).collect()
    for text, why in (("1\t10\t10,40\t0.05\n", "markers"), ("1\t10\t3\n", "layout"), ("1\t10\t40\t1\n1\t40\t10\t2\n", "inconsistent")):
        with pytest.raises(Exception, match=why):
            sc.score_covariances(spark, _write(tmp_path / "d.txt", text), 1).collect()


def _trio(tmp_path, **change):
    info = {"status": "complete", "null_converged": "true", "effect_allele": "ALT", "null_model_id": "n1", "conditioning_set_id": "none", "exported_variants": 3, "covariance_blocks": 2, "maximum_block_variants": 2} | change
    cols = "status\tscore_variant_key\tnull_model_id\tconditioning_set_id\tscore_u\tscore_variance\tscore_covariance_block\n"
    s = _write(tmp_path / "s.tsv", cols + "ok\t1:10:A:G\tn1\tnone\t1.5\t4\t1\nok\t1:20:A:G\tn1\tnone\t-1\t9\t1\nfiltered\t\t\t\t\t\t\nok\t1:90:C:T\tn1\tnone\t2\t5\t2\n")
    c = _write(tmp_path / "c.tsv", "variant_i\tvariant_j\tscore_covariance\tnull_model_id\tscore_covariance_block\n1:10:A:G\t1:10:A:G\t4\tn1\t1\n1:10:A:G\t1:20:A:G\t-1\tn1\t1\n1:20:A:G\t1:20:A:G\t9\tn1\t1\n1:90:C:T\t1:90:C:T\t6\tn1\t2\n")
    return s, c, _write(tmp_path / "m.json", json.dumps(info))


def test_conditional_scores(spark, tmp_path):
    files = _trio(tmp_path)
    scores, cov, info = sc.conditional_scores(spark, *files, ["1:10:A:G", "1:20:A:G"])
    assert {r.variant: r.score for r in scores.collect()} == {"1:10:A:G": 1.5, "1:20:A:G": -1.0} and info["null_model_id"] == "n1"
    assert sorted(r.covariance for r in cov.collect()) == [-1.0, 4.0, 9.0]
    for asked, why in ((["1:10:A:G", "1:90:C:T"], "several"), (["1:11:A:G"], "absent"), (["1:90:C:T"], "diagonal"), ([], "once")):
        with pytest.raises(ValueError, match=why):
            sc.conditional_scores(spark, *files, asked)
    for change in ({"status": "running"}, {"exported_variants": 4}, {"covariance_blocks": 1}, {"maximum_block_variants": 1}, {"null_model_id": "n2"}):
        with pytest.raises(ValueError):
            sc.conditional_scores(spark, *_trio(tmp_path, **change), ["1:10:A:G"])


def test_info_as_a_map(spark, tmp_path):
    path = _write(tmp_path / "a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nchr1\t5\tv1\tA\tG\t.\t.\tDP=3;FLAG;X=a=b;DP=4;Gene.ref=G1;Func.ref=exonic;ExonicFunc.ref=missense\n1\t6\tv2\tA\tG\t.\t.\tDP=1\n")
    got = {r.variant_id: r.info for r in sc.info_fields(spark, path).collect()}
    assert got["v1"]["DP"] == "4" and got["v1"]["X"] == "a=b" and "FLAG" not in got["v1"] and got["v2"] == {"DP": "1"}
    rows = {tuple(r) for r in sc.gene_annotations(spark, path).collect()}
    assert rows == {("v1", "G1", "missense", "ref"), ("v2", None, None, None)}

import gzip

import pytest
from pyspark.sql import functions as F

from statloom.plans import expression as ex
from statloom.plans import formula as fm
from statloom.sources import binary, sinks, tables
from statloom.streaming import scan as st


def test_formula_parts():
    f = fm.parse("y ~ a*b + offset(o) + (1 + x | g/h) + s(z) + <omics> - 1")
    assert f.response == ["y"] and not f.intercept and f.omics and f.offset == "o"
    assert f.terms == [("a",), ("b",), ("a", "b")] and f.smooths == [("s", ("z",))]
    assert [r.group for r in f.random] == [["g"], ["g", "h"]]
    assert fm.parse("Surv(start, stop, event) ~ x").survival
    for bad in ("y", "y ~ a*b*c", "y ~ (a", "y ~ <omics> + <omics>", "y ~ a:<omics>", "Surv(a) ~ b"):
        with pytest.raises(ValueError):
            fm.parse(bad)


def test_design_levels_are_first_seen(spark):
    df = spark.createDataFrame([(1, "z", 1.0), (2, "a", 2.0), (3, "m", 3.0)], "i int, c string, x double")
    assert [n for n, _ in fm.design(df, "x ~ c + x:c", "i")] == ["(Intercept)", "ca", "cm", "x:ca", "x:cm"]
    d, names = fm.with_design(df, "x ~ 0 + c", "i", "sum")
    assert [tuple(r) for r in d.orderBy("i").select(*names).collect()] == [(1.0, 0.0), (0.0, 1.0), (-1.0, -1.0)]


def test_expression_three_valued(spark):
    df = spark.createDataFrame([("0.001", "ok"), ("NA", "ok"), ("0.2", "bad"), ("0.01", "NA")], "p string, `my status` string")
    got = [r[0] for r in df.select(ex.condition("p < 0.05 && `my status` == 'ok'", df.columns)).collect()]
    assert got == [True, None, False, None]
    assert [r[0] for r in df.select(ex.condition("!(abs(-p) >= 1 - 0.5) || is_missing(p)", df.columns)).collect()] == [True] * 4
    out = ex.select(df, "p < bonferroni(0.05)", missing="exclude")
    assert sorted((r.p, r.selected) for r in out.collect()) == [("0.001", True), ("0.01", True), ("0.2", False)]
    with pytest.raises(ValueError):
        ex.select(df, "p < 1")
    for bad in ("p <", "p + 1", "nope == 1", "(p < 1", "f(p)"):
        with pytest.raises(ValueError):
            ex.condition(bad, df.columns)


def test_readers(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("IID\tage\tsex\ns1\t30\tm\ns2\tNA\tf\n")
    p = tables.phenotype(spark, str(tmp_path / "p.tsv"), "IID")
    assert dict(p.dtypes) == {"sample_id": "string", "age": "double", "sex": "string"}
    (tmp_path / "m.csv").write_text('id,s1,s2\n"g,1",1.5,.\ng2,2,3\n')
    assert sorted(map(tuple, tables.matrix(spark, str(tmp_path / "m.csv")).collect()), key=str) == [("g,1", "s1", 1.5), ("g,1", "s2", None), ("g2", "s1", 2.0), ("g2", "s2", 3.0)]
    (tmp_path / "bad.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError):
        tables.delimited(spark, str(tmp_path / "bad.csv"))
    with gzip.open(tmp_path / "v.vcf.gz", "wt") as f:
        f.write("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n1\t10\trs1\tA\tC,G\t.\t.\tR2=0.9\tGT\t0/1\t1|2\n1\t20\t.\tA\tT\t.\t.\tX=1\tGT:DS\t0/0:0.25\t./.:.\n")
    v = {(r.variant_id, r.sample_id): (r.dosage, r.quality) for r in tables.vcf(spark, str(tmp_path / "v.vcf.gz")).collect()}
    assert v == {("rs1:C", "a"): (1.0, 0.9), ("rs1:C", "b"): (1.0, 0.9), ("rs1:G", "a"): (0.0, 0.9), ("rs1:G", "b"): (1.0, 0.9), ("1:20:A:T", "a"): (0.25, None), ("1:20:A:T", "b"): (None, None)}
    (tmp_path / "s.gmt").write_text("set1\tfirst\ta\tb\ta\nset2\tsecond\tc\n")
    assert tables.gmt(spark, str(tmp_path / "s.gmt")).count() == 3
    (tmp_path / "o.obo").write_text("format-version: 1\n\n[Term]\nid: T:1\nname: root\n\n[Term]\nid: T:2\nname: leaf\nis_a: T:1 ! root\nis_obsolete: true\n")
    terms, edges = tables.obo(spark, str(tmp_path / "o.obo"))
    assert sorted((r.id, r.obsolete) for r in terms.collect()) == [("T:1", False), ("T:2", True)] and [tuple(r) for r in edges.collect()] == [("T:2", "T:1")]
    (tmp_path / "c.tsv").write_text("feature_id\tbeta\tse\nf1\t1\t.\n")
    assert [tuple(r) for r in tables.cohort(spark, str(tmp_path / "c.tsv"), "c1").collect()] == [("f1", "c1", 1.0, None)]
    (tmp_path / "ped.tsv").write_text("id\tsire\tdam\nx\ty\t0\n")
    assert tables.pedigree(spark, str(tmp_path / "ped.tsv")).count() == 2
    assert tables.detect_format("a.vcf.gz") == "vcf" and tables.detect_omics(spark.createDataFrame([("cg001",), ("cg002",)], "feature_id string")) == "methylation"


def test_binary(spark, tmp_path):
    (tmp_path / "g.bim").write_text("1\trs1\t0\t5\tA\tC\n1\trs2\t0\t6\tG\tT\n")
    (tmp_path / "g.fam").write_text("".join(f"f s{i} 0 0 0 -9\n" for i in range(5)))
    (tmp_path / "g.bed").write_bytes(b"\x6c\x1b\x01" + bytes([0b11100100, 0b00, 0b0, 0b10]))
    got = {(r.variant_id, r.sample_id): r.dosage for r in binary.plink(spark, str(tmp_path / "g")).collect()}
    assert got[("rs1", "s0")] == 2 and got[("rs1", "s1")] is None and got[("rs1", "s2")] == 1 and got[("rs1", "s3")] == 0 and got[("rs2", "s4")] == 1


def test_results_and_stream(spark, tmp_path):
    ok = spark.createDataFrame([("a", 0.01), ("b", 0.04)], "feature_id string, p_value double")
    filtered = spark.createDataFrame([("c", ["LOW", "RARE"])], "feature_id string, reasons array<string>")
    out = {r.feature_id: r for r in sinks.results(ok, filtered).collect()}
    assert out["a"].fdr_bh == pytest.approx(0.02) and out["c"].filter_reason == "LOW;RARE" and out["c"].fdr_bh is None
    sinks.write_table(ok, str(tmp_path / "out.csv"))
    with pytest.raises(Exception):
        sinks.write_table(ok, str(tmp_path / "out.csv"))
    pheno = spark.createDataFrame([(f"s{i}", float(i * i)) for i in range(8)], "sample_id string, y double")
    feats = spark.createDataFrame([(f"f{k}", f"s{i}", float((i * k) % 5)) for k in range(1, 4) for i in range(8)], "feature_id string, sample_id string, value double")
    feats.write.parquet(str(tmp_path / "in"))
    q = st.scan_stream(st.stream_features(spark, str(tmp_path / "in")), pheno, "y", [], str(tmp_path / "scan"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "scan")).count() == 3
    assert sinks.annotate(ok, spark.createDataFrame([("a", "gene")], "feature_id string, g string"), "feature_id").filter(F.col("annot_g") == "").count() == 1


@pytest.mark.parametrize("compression,bits,phased", [(0, 8, 0), (1, 8, 0), (1, 16, 1), (2, 11, 0)])
def test_bgen(spark, tmp_path, compression, bits, phased):
    import struct
    import zlib

    import numpy as np

    top = 2**bits - 1
    probs = [(top, 0), (0, top), (0, 0), (top // 4, top // 2)]
    flat = "".join(format(v, f"0{bits}b")[::-1] for p in probs for v in p)
    packed = np.packbits([int(c) for c in flat], bitorder="little").tobytes()
    block = struct.pack("<IHBB", 4, 2, 2, 2) + bytes([2, 2, 2, 2 | 128]) + bytes([phased, bits]) + packed
    body = block
    if compression == 1:
        body = struct.pack("<I", len(block)) + zlib.compress(block)
    elif compression == 2:
        zstandard = pytest.importorskip("zstandard")
        body = struct.pack("<I", len(block)) + zstandard.ZstdCompressor().compress(block)
    s = lambda t, w="<H": struct.pack(w, len(t)) + t.encode()
    variant = s("id1") + s("rs9") + s("7") + struct.pack("<IH", 1234, 2) + s("A", "<I") + s("G", "<I") + struct.pack("<I", len(body)) + body
    names = b"".join(s(f"p{i}") for i in range(4))
    samples = struct.pack("<II", 8 + len(names), 4) + names
    header = struct.pack("<III", 20, 2, 4) + b"bgen" + struct.pack("<I", compression | (2 << 2) | (1 << 31))
    (tmp_path / "x.bgen").write_bytes(struct.pack("<I", len(header) + len(samples)) + header + samples + variant * 2)
    rows = binary.bgen(spark, str(tmp_path / "x.bgen")).filter("sample_id <> 'none'").collect()
    assert len(rows) == 8 and {(r.variant_id, r.chromosome, r.position, r.ref, r.alt) for r in rows} == {("rs9", "7", 1234, "A", "G")}
    got = {r.sample_id: r.dosage for r in rows}
    want = [2 - sum(p) / top if phased else p[1] / top + 2 * (1 - sum(p) / top) for p in probs]
    assert [got["p0"], got["p1"], got["p2"]] == pytest.approx(want[:3]) and got["p3"] is None

"""Queries over transforms, variants, set tests, networks, space, cells, enrichment, series and survival."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from statloom.operators import genetics as ge
from statloom.operators import graphs as gr
from statloom.operators import meta, series, survival
from statloom.operators import settests as st
from statloom.operators import transforms as tr
from statloom.plans import expression as ex
from statloom.plans.model_queries import _DL, _EFFECTS, effects
from statloom.plans.registry import query, table

# -- transforms ---------------------------------------------------------------------------------------------------------------------------

_LONG = "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS f, unnest(embedding)::DOUBLE AS v FROM embeddings"


def _long(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("f", "v")).withColumn("v", F.col("v").cast("double"))


@query("transform_zscore", f"SELECT vec_id, f, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS v FROM ({_LONG}) WINDOW w AS (PARTITION BY f)", floats=("v",))
def transform_zscore(spark, sf):
    return tr.apply(_long(spark, sf), "zscore()", "f", "v").select("vec_id", "f", "v")


@query("transform_winsor", f"WITH d AS ({_LONG}), q AS (SELECT f, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM d GROUP BY f) SELECT vec_id, f, least(greatest(v, a), b) AS v FROM d JOIN q USING (f)", floats=("v",))
def transform_winsor(spark, sf):
    return tr.apply(_long(spark, sf), "winsor()", "f", "v").select("vec_id", "f", "v")


@query(
    "transform_winsor_mad",
    f"""WITH d AS ({_LONG}), q AS (SELECT f, median(v) AS m FROM d GROUP BY f), s AS (SELECT f, any_value(m) AS m, median(abs(v - m)) * 1.482602218505602 AS s FROM d JOIN q USING (f) GROUP BY f)
        SELECT vec_id, f, CASE WHEN s > 0 THEN least(greatest(v, m - 2 * s), m + 2 * s) ELSE v END AS v FROM d JOIN s USING (f)""",
    floats=("v",),
)
def transform_winsor_mad(spark, sf):
    return tr.apply(_long(spark, sf), "winsor_mad(k=2)", "f", "v").select("vec_id", "f", "v")


_ROWS = "SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS f, l_discount AS d, l_quantity AS q FROM lineitem"


def _rows(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("f"), F.col("l_discount").alias("d"), F.col("l_quantity").alias("q"))


@query("transform_mvalue", f"SELECT id, f, log2(least(greatest(d, 1e-6), 1 - 1e-6) / (1 - least(greatest(d, 1e-6), 1 - 1e-6))) AS d FROM ({_ROWS})", floats=("d",))
def transform_mvalue(spark, sf):
    return tr.apply(_rows(spark, sf), "mvalue()", "f", "d").select("id", "f", "d")


@query("transform_log1p", f"SELECT id, f, ln(1 + q) AS q FROM ({_ROWS})", floats=("q",))
def transform_log1p(spark, sf):
    return tr.apply(_rows(spark, sf), "log1p()", "f", "q").select("id", "f", "q")


@query("transform_log", f"SELECT id, f, ln(q + 0.5) / ln(10) AS q FROM ({_ROWS})", floats=("q",))
def transform_log(spark, sf):
    return tr.apply(_rows(spark, sf), "log(shift=0.5, base=10)", "f", "q").select("id", "f", "q")


@query("transform_normal_scores")
def transform_normal_scores(spark, sf):
    return tr.apply(_long(spark, sf), "int()", "f", "v").select("vec_id", "f", "v")


@query(
    "robust_effect_qc",
    f"""WITH e AS ({_EFFECTS}), m AS (SELECT nation, median(effect) AS m, count(*) AS n, quantile_cont(effect, 0.75) - quantile_cont(effect, 0.25) AS iqr FROM e GROUP BY 1),
        s AS (SELECT nation, median(abs(effect - m)) * 1.482602218505602 AS mad FROM e JOIN m USING (nation) GROUP BY 1)
        SELECT brand, nation, n >= 20 AND abs(effect - m) / CASE WHEN mad > 0 THEN mad ELSE iqr / 1.348979500392164 END > 3 AS excluded FROM (SELECT brand, nation, effect FROM e) JOIN m USING (nation) JOIN s USING (nation)""",
)
def robust_effect_qc(spark, sf):
    return tr.robust_qc(effects(spark, sf), "nation", "effect", cutoff=3.0).select("brand", "nation", "excluded")


@query(
    "ewas_regions",
    """WITH e AS (SELECT event_type AS c, CAST(floor(epoch(ts)) AS BIGINT) AS x, event_id FROM events), n AS (SELECT *, CASE WHEN x - lag(x) OVER w > 3600 OR lag(x) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY c ORDER BY x, event_id)),
       r AS (SELECT *, sum(new) OVER (PARTITION BY c ORDER BY x, event_id ROWS UNBOUNDED PRECEDING) AS region FROM n)
       SELECT c, CAST(region AS BIGINT) AS region, count(*) AS probes, min(x) AS start, max(x) AS "end" FROM r GROUP BY c, region HAVING count(*) >= 2""",
)
def ewas_regions(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("c"), F.unix_timestamp("ts").alias("x"), "event_id", (F.col("value") - 50).alias("b"), F.lit(0.01).alias("p"))
    return tr.regions(e, "c", "x", "b", "p", "event_id", max_gap=3600, min_probes=2, length=600.0).select("c", "region", "probes", "start", "end")


# -- variants: a pseudo-dosage from line numbers -------------------------------------------------------------------------------------------

_DOSE = "SELECT l_partkey AS variant_id, l_orderkey AS sample_id, (min(l_linenumber) % 3)::DOUBLE AS dosage FROM lineitem GROUP BY 1, 2"


def _doses(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("variant_id"), F.col("l_orderkey").alias("sample_id")).agg((F.min("l_linenumber") % 3).cast("double").alias("dosage"))


_STATS = f"""SELECT variant_id, count(*) AS called, sum(dosage) / (2 * count(*)) AS af, least(sum(dosage) / (2 * count(*)), 1 - sum(dosage) / (2 * count(*))) AS maf, coalesce(var_samp(dosage), 0) AS variance FROM ({_DOSE}) GROUP BY 1"""


@query("variant_statistics", f"SELECT variant_id, called, af, maf, 2 * called * maf AS mac, variance FROM ({_STATS})", floats=("af", "maf", "mac", "variance",))
def variant_statistics(spark, sf):
    return ge.variant_statistics(_doses(spark, sf)).select("variant_id", "called", "af", "maf", "mac", "variance")


@query(
    "variant_qc_filter",
    f"""SELECT variant_id, concat_ws(';', CASE WHEN maf < 0.3 THEN 'MAF_TOO_LOW' END, CASE WHEN 2 * called * maf < 15 THEN 'MAC_TOO_LOW' END, CASE WHEN NOT variance > 0 THEN 'MONOMORPHIC' END) AS reasons FROM ({_STATS})""",
)
def variant_qc_filter(spark, sf):
    return ge.variant_filters(ge.variant_statistics(_doses(spark, sf)), maf=(0.3, 0.5), mac=(15.0, float("inf"))).select("variant_id", F.array_join("reasons", ";").alias("reasons"))


@query("hwe_counts", f"SELECT variant_id, count(*) FILTER (dosage = 0) AS hom_ref, count(*) FILTER (dosage = 1) AS het, count(*) FILTER (dosage = 2) AS hom_alt FROM ({_DOSE}) GROUP BY 1")
def hwe_counts(spark, sf):
    return ge.hardy_weinberg(_doses(spark, sf)).select("variant_id", "hom_ref", "het", "hom_alt")


_PANEL = "SELECT f AS variant_id, vec_id AS sample_id, CASE WHEN v < -0.05 THEN 0 WHEN v < 0.05 THEN 1 ELSE 2 END::DOUBLE AS dosage FROM (" + _LONG + ")"


def _panel(spark, sf):
    v = F.col("v")
    return _long(spark, sf).select(F.col("f").alias("variant_id"), F.col("vec_id").alias("sample_id"), F.when(v < -0.05, 0.0).when(v < 0.05, 1.0).otherwise(2.0).alias("dosage"))


@query(
    "grm_pairs",
    f"""WITH d AS ({_PANEL}), s AS (SELECT variant_id, sum(dosage) / (2 * count(*)) AS p FROM d GROUP BY 1 HAVING var_samp(dosage) > 0 AND least(sum(dosage) / (2 * count(*)), 1 - sum(dosage) / (2 * count(*))) >= 0.01),
        z AS (SELECT variant_id, sample_id, (dosage - 2 * p) / sqrt(2 * p * (1 - p)) AS z FROM d JOIN s USING (variant_id))
        SELECT x.sample_id AS a, y.sample_id AS b, sum(x.z * y.z) / (SELECT count(*) FROM s) AS value FROM z x JOIN z y ON x.variant_id = y.variant_id AND x.sample_id <= y.sample_id GROUP BY 1, 2""",
    floats=("value",),
)
def grm_pairs(spark, sf):
    return ge.grm(_panel(spark, sf))


@query(
    "ld_pairs",
    f"SELECT x.variant_id AS a, y.variant_id AS b, corr(x.dosage, y.dosage) AS r FROM ({_PANEL}) x JOIN ({_PANEL}) y ON x.sample_id = y.sample_id AND x.variant_id < y.variant_id AND y.variant_id - x.variant_id <= 5 GROUP BY 1, 2",
    floats=("r",),
)
def ld_pairs(spark, sf):
    d = _panel(spark, sf).withColumn("chromosome", F.lit("1")).withColumn("position", F.col("variant_id").cast("long"))
    return ge.ld_pairs(d, 5).select("a", "b", "r")


@query("ld_clump")
def ld_clump(spark, sf):
    d = _panel(spark, sf).withColumn("chromosome", F.lit("1")).withColumn("position", F.col("variant_id").cast("long"))
    hits = d.groupBy("variant_id").agg((F.avg("dosage") / 2).alias("p_value"))
    return ge.clump(hits, ge.ld_pairs(d, 20), r2=0.01)


@query("prs_score", f"SELECT vec_id AS sample_id, sum(v * (f - 31.5)) AS score FROM ({_LONG}) GROUP BY 1", floats=("score",))
def prs_score(spark, sf):
    d = _long(spark, sf).select(F.col("f").alias("variant_id"), F.col("vec_id").alias("sample_id"), F.col("v").alias("dosage"))
    w = spark.range(64).select(F.col("id").cast("int").alias("variant_id"), (F.col("id") - 31.5).alias("weight"))
    return ge.polygenic_score(d, w).select("sample_id", "score")


_LBF = f"SELECT brand AS v, nation % 2 AS trait, (ln(1 - r) + r * z * z) / 2 AS l FROM (SELECT brand, nation, 0.04e10 / (0.04e10 + se * se) AS r, effect / se AS z FROM (SELECT brand, nation % 2 AS nation, sum(effect / (se * se)) / sum(1 / (se * se)) AS effect, sqrt(1 / sum(1 / (se * se))) AS se FROM ({_EFFECTS}) GROUP BY 1, 2))"


@query(
    "coloc_pairs",
    f"""WITH l AS ({_LBF}), a AS (SELECT x.v, x.l AS l1, y.l AS l2 FROM l x JOIN l y ON x.v = y.v WHERE x.trait = 0 AND y.trait = 1), s AS (SELECT count(*) AS n, sum(exp(l1)) AS s1, sum(exp(l2)) AS s2, sum(exp(l1 + l2)) AS s4 FROM a),
        h3 AS (SELECT sum(exp(x.l1 + y.l2)) AS s3 FROM a x JOIN a y ON x.v <> y.v), h AS (SELECT n, 1.0 AS h0, 1e-4 * s1 AS h1, 1e-4 * s2 AS h2, 1e-8 * s3 AS h3, 1e-5 * s4 AS h4 FROM s, h3)
        SELECT 0 AS g, n, h0 / (h0 + h1 + h2 + h3 + h4) AS h0, h1 / (h0 + h1 + h2 + h3 + h4) AS h1, h2 / (h0 + h1 + h2 + h3 + h4) AS h2, h3 / (h0 + h1 + h2 + h3 + h4) AS h3, h4 / (h0 + h1 + h2 + h3 + h4) AS h4 FROM h""",
    floats=("h0", "h1", "h2", "h3", "h4",),
)
def coloc_pairs(spark, sf):
    w = 1 / (F.col("se") * F.col("se"))
    e = effects(spark, sf).groupBy("brand", (F.col("nation") % 2).alias("trait")).agg((F.sum(F.col("effect") * w) / F.sum(w)).alias("effect"), F.sqrt(1 / F.sum(w)).alias("se"))
    e = e.select(F.lit(0).alias("g"), "trait", F.col("brand").alias("variant_id"), ge.approximate_lbf(F.col("effect"), F.col("se"), 0.04e10).alias("lbf"))
    return ge.coloc(e.filter("trait = 0"), e.filter("trait = 1"), ["g"]).drop("top")


@query("fine_map_loci")
def fine_map_loci(spark, sf):
    d = _panel(spark, sf)
    z = d.groupBy("variant_id").agg(((F.avg("dosage") - 1) * 20).alias("z")).select(F.lit(1).alias("locus"), F.col("variant_id").cast("string").alias("variant_id"), "z")
    ld = ge.ld_pairs(d.withColumn("chromosome", F.lit("1")).withColumn("position", F.col("variant_id").cast("long")), 64)
    ld = ld.select(F.lit(1).alias("locus"), F.col("a").cast("string").alias("row"), F.col("b").cast("string").alias("col"), "r")
    return ge.fine_map(z, ld, ["locus"], 60, signals=3)


# -- sets -----------------------------------------------------------------------------------------------------------------------------------

_PV = f"SELECT brand, nation, effect, se, 1 / (1 + power(effect / se, 2)) AS p FROM ({_EFFECTS})"


def _pv(spark, sf):
    return effects(spark, sf).withColumn("p", 1 / (1 + F.pow(F.col("effect") / F.col("se"), F.lit(2))))


@query(
    "acat_combine",
    f"SELECT brand, count(*) AS k, avg(CASE WHEN p < 1e-8 THEN 1 / (p * pi()) ELSE tan(pi() * (0.5 - p)) END) AS statistic, 0.5 - atan(avg(CASE WHEN p < 1e-8 THEN 1 / (p * pi()) ELSE tan(pi() * (0.5 - p)) END)) / pi() AS p_value FROM ({_PV}) WHERE p < 1 GROUP BY brand",
    floats=("statistic", "p_value",),
)
def acat_combine(spark, sf):
    return st.acat(_pv(spark, sf).filter("p < 1"), ["brand"], "p")


@query(
    "score_meta",
    f"SELECT brand AS variant_id, count(*) AS cohorts, sum(effect / (se * se)) AS u, sum(1 / (se * se)) AS v, sum(effect / (se * se)) / sqrt(sum(1 / (se * se))) AS statistic, string_agg(CASE WHEN effect > 0 THEN '+' WHEN effect < 0 THEN '-' ELSE '0' END, '' ORDER BY nation) AS direction FROM ({_EFFECTS}) GROUP BY 1",
    floats=("u", "v", "statistic",),
)
def score_meta(spark, sf):
    e = effects(spark, sf).select(F.col("brand").alias("variant_id"), F.col("nation").alias("cohort"), (F.col("effect") / (F.col("se") * F.col("se"))).alias("u"), (1 / (F.col("se") * F.col("se"))).alias("v"))
    return st.score_meta(e).select("variant_id", "cohorts", "u", "v", "statistic", "direction")


@query("set_tests_burden_skat")
def set_tests_burden_skat(spark, sf):
    d = _panel(spark, sf)
    y = d.select("sample_id").distinct().withColumn("y", F.col("sample_id") % 7)
    null = y.join(F.broadcast(y.agg(F.avg("y").alias("m"))), F.lit(True)).select("sample_id", (F.col("y") - F.col("m")).alias("r"))
    u = st.scores(d, null).withColumn("set_id", F.col("variant_id") % 4).withColumn("weight", F.lit(1.0))
    m = d.groupBy("variant_id").agg(F.avg("dosage").alias("m"))
    c = d.join(m, "variant_id").select("variant_id", "sample_id", (F.col("dosage") - F.col("m")).alias("c"))
    pairs = c.join(c.select(F.col("variant_id").alias("col"), "sample_id", F.col("c").alias("c2")), "sample_id").filter("variant_id <= col and variant_id % 4 = col % 4").groupBy("variant_id", "col").agg((F.sum(F.col("c") * F.col("c2")) * 4.0).alias("v"))
    return st.set_tests(u, pairs.select((F.col("variant_id") % 4).alias("set_id"), F.col("variant_id").alias("row"), "col", "v"))


# -- networks, space, cells -------------------------------------------------------------------------------------------------------------------


@query("corr_network", f"SELECT x.f AS a, y.f AS b, corr(x.v, y.v) AS r, count(*) AS n FROM ({_LONG}) x JOIN ({_LONG}) y ON x.vec_id = y.vec_id AND x.f < y.f GROUP BY 1, 2", floats=("r",))
def corr_network(spark, sf):
    return gr.correlation_pairs(_long(spark, sf), "vec_id", "f", "v")


@query(
    "diff_corr_fisher_z",
    f"""WITH d AS (SELECT * FROM ({_LONG})), c AS (SELECT x.vec_id % 2 AS g, x.f AS a, y.f AS b, corr(x.v, y.v) AS r, count(*) AS n FROM d x JOIN d y ON x.vec_id = y.vec_id AND x.f < y.f GROUP BY 1, 2, 3)
        SELECT p.a, p.b, (atanh(p.r) - atanh(q.r)) / sqrt(1.0 / (p.n - 3) + 1.0 / (q.n - 3)) AS statistic FROM c p JOIN c q ON p.a = q.a AND p.b = q.b WHERE p.g = 0 AND q.g = 1""",
    floats=("statistic",),
)
def diff_corr_fisher_z(spark, sf):
    d = _long(spark, sf).withColumn("g", F.col("vec_id") % 2)
    return gr.differential_correlation(d, "vec_id", "f", "v", "g", 0, 1).select("a", "b", "statistic")


def _trade(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("target")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


_TRADE = """SELECT 'c' || c_nationkey AS source, 's' || s_nationkey AS target, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""


@query(
    "rwr_propagation",
    f"""WITH RECURSIVE t AS ({_TRADE}), u AS (SELECT source AS a, target AS b, weight AS w FROM t UNION ALL SELECT target, source, weight FROM t), p AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS p FROM u),
        z AS (SELECT DISTINCT a AS node, CASE WHEN a = 'c1' THEN 1.0::DOUBLE ELSE 0 END AS s FROM u),
        r AS (SELECT 0 AS k, node, s AS score, 1.0::DOUBLE AS moved FROM z UNION ALL
            SELECT k, node, score, sum(abs(score - old)) OVER () FROM (
                SELECT k + 1 AS k, z.node, 0.3 * any_value(z.s) + 0.7 * sum(p * score) AS score, any_value(was) AS old
                FROM (SELECT r.k, a, b, p, r.score, o.score AS was FROM r JOIN p ON r.node = p.a JOIN r o ON o.node = p.b WHERE r.moved >= 1e-8 AND r.k < 200) JOIN z ON z.node = b GROUP BY k, z.node))
        SELECT node, score FROM r WHERE k = (SELECT max(k) FROM r)""",
    floats=("score",),
)
def rwr_propagation(spark, sf):
    return gr.random_walk(_trade(spark, sf), spark.createDataFrame([("c1",)], "node string"), tol=1e-8)


_PTS = "SELECT vec_id AS node, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS v, label FROM embeddings"
_EDGES = f"SELECT a.node AS source, b.node AS target, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS distance FROM ({_PTS}) a JOIN ({_PTS}) b ON a.node < b.node WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 0.03"


def _points(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("node"), *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("xyv")], "label")


@query("spatial_radius_edges", _EDGES, floats=("distance",))
def spatial_radius_edges(spark, sf):
    return gr.radius_edges(_points(spark, sf), 0.03)


@query(
    "knn_edges",
    f"""WITH e AS ({_EDGES}), d AS (SELECT source, target, distance FROM e UNION ALL SELECT target, source, distance FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY distance, target) AS k FROM d)
        SELECT DISTINCT least(source, target) AS source, greatest(source, target) AS target, distance FROM k WHERE k <= 3""",
    floats=("distance",),
)
def knn_edges(spark, sf):
    return gr.knn_edges(_points(spark, sf), 3, 0.03)


@query(
    "moran_geary",
    f"""WITH p AS ({_PTS}), e AS ({_EDGES}), m AS (SELECT avg(v) AS m, sum(v * v) - count(*) * avg(v) * avg(v) AS ss, count(*) AS n FROM p),
        s AS (SELECT count(*)::DOUBLE AS k, sum((a.v - m) * (b.v - m)) AS c, sum(power(a.v - b.v, 2)) AS q, any_value(n) AS n, any_value(ss) AS ss FROM e JOIN p a ON e.source = a.node JOIN p b ON e.target = b.node, m)
        SELECT 'v' AS feature_id, k AS edges, n * c / (k * ss) AS moran_i, (n - 1) * q / (2 * k * ss) AS geary_c FROM s""",
    floats=("edges", "moran_i", "geary_c",),
)
def moran_geary(spark, sf):
    p = _points(spark, sf)
    return gr.autocorrelation(gr.radius_edges(p, 0.03), p.select("node", F.lit("v").alias("feature_id"), F.col("v").alias("value")))


@query(
    "neighborhood_pairs",
    f"SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, count(*) AS edges FROM ({_EDGES}) e JOIN embeddings a ON e.source = a.vec_id JOIN embeddings b ON e.target = b.vec_id GROUP BY 1, 2",
)
def neighborhood_pairs(spark, sf):
    p = _points(spark, sf)
    return gr.neighborhood_pairs(gr.radius_edges(p, 0.03), p).select("a", "b", "edges")


_COUNTS = "SELECT user_id AS obs_id, event_type AS feature_id, count(*) AS count FROM events GROUP BY 1, 2"


def _counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("obs_id"), F.col("event_type").alias("feature_id")).agg(F.count(F.lit(1)).alias("count"))


@query(
    "sc_qc",
    f"""SELECT obs_id, library, features, m / library AS mito_share, concat_ws(';', CASE WHEN library < 60 THEN 'low_library' END, CASE WHEN features < 5 THEN 'low_features' END, CASE WHEN m / library > 0.21 THEN 'high_mitochondrial' END) AS reasons
        FROM (SELECT obs_id, CAST(sum(count) AS BIGINT) AS library, count(*) AS features, sum(CASE WHEN feature_id = 'click' THEN count ELSE 0 END)::DOUBLE AS m FROM ({_COUNTS}) GROUP BY 1)""",
    floats=("mito_share",),
)
def sc_qc(spark, sf):
    out = gr.cell_qc(_counts(spark, sf), spark.createDataFrame([("click",)], "feature_id string"), 60, 5, 0.21)
    return out.withColumn("reasons", F.array_join("reasons", ";"))


@query("sc_pseudobulk", "SELECT user_id % 4 AS sample, event_type AS feature_id, count(*) AS count FROM events GROUP BY 1, 2")
def sc_pseudobulk(spark, sf):
    c = _counts(spark, sf)
    cells = c.select("obs_id").distinct().withColumn("sample", F.col("obs_id") % 4)
    return gr.pseudobulk(c, cells, ["sample"])


@query(
    "sc_abundance",
    """WITH k AS (SELECT user_id AS sample, event_type AS label, count(*) AS k FROM events GROUP BY 1, 2), n AS (SELECT sample, sum(k) AS n FROM k GROUP BY 1)
       SELECT n.sample, t.label, coalesce(k, 0) AS k, CAST(n AS BIGINT) AS n, asin(sqrt(coalesce(k, 0) / n::DOUBLE)) AS value FROM n CROSS JOIN (SELECT DISTINCT label FROM k) t LEFT JOIN k ON k.sample = n.sample AND k.label = t.label""",
    floats=("value",),
)
def sc_abundance(spark, sf):
    return gr.relative_abundance(table(spark, sf, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("label")), "sample", "label")


@query(
    "sc_pathway_score",
    f"""WITH c AS ({_COUNTS}), l AS (SELECT obs_id, sum(count) AS lib FROM c GROUP BY 1), s AS (SELECT 'a' AS set_id, unnest(['click', 'view', 'nope']) AS g UNION ALL SELECT 'b', unnest(['purchase', 'click'])), m AS (SELECT * FROM s WHERE g IN (SELECT feature_id FROM c)),
        k AS (SELECT set_id, count(*) AS members FROM m GROUP BY 1 HAVING count(*) >= 2)
        SELECT l.obs_id, m.set_id, any_value(members) AS members, avg(log2((coalesce(count, 0) + 0.5) * 1e6 / (lib + 1))) AS score FROM l CROSS JOIN m JOIN k USING (set_id) LEFT JOIN c ON c.obs_id = l.obs_id AND c.feature_id = m.g GROUP BY 1, 2""",
    floats=("score",),
)
def sc_pathway_score(spark, sf):
    sets = spark.createDataFrame([("a", "click"), ("a", "view"), ("a", "nope"), ("b", "purchase"), ("b", "click")], "set_id string, gene string")
    return gr.pathway_score(_counts(spark, sf), sets)


# -- enrichment and joins ----------------------------------------------------------------------------------------------------------------------

_UNIVERSE = "SELECT p_partkey AS gene, p_brand AS set_id, p_size > 40 AS sel FROM part"


@query(
    "ora_enrichment",
    f"""WITH u AS ({_UNIVERSE}), t AS (SELECT count(*) AS n, count(*) FILTER (sel) AS k FROM u), s AS (SELECT set_id, count(*) AS size, count(*) FILTER (sel) AS overlap FROM u GROUP BY 1)
        SELECT set_id, size, overlap, size * k / n::DOUBLE AS expected, CASE WHEN (k - overlap) * (size - overlap) <> 0 THEN overlap * (n - size - k + overlap)::DOUBLE / ((k - overlap) * (size - overlap)) END AS odds_ratio, overlap / (size * k / n::DOUBLE) AS fold FROM s, t""",
    floats=("expected", "odds_ratio", "fold",),
)
def ora_enrichment(spark, sf):
    p = table(spark, sf, "part")
    return gr.over_representation(p.select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("gene")), p, F.col("p_size") > 40, "p_partkey").select("set_id", "size", "overlap", "expected", "odds_ratio", "fold")


_UP = """SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region"""


def _up(spark, sf):
    key = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    n = table(spark, sf, "nation").select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent"))
    s = table(spark, sf, "supplier").select(key("s", "s_suppkey").alias("child"), key("n", "s_nationkey").alias("parent"))
    return n.unionByName(s).unionByName(table(spark, sf, "region").select(key("r", "r_regionkey").alias("child"), F.lit("root").alias("parent")))


@query("ontology_closure", f"WITH RECURSIVE e AS ({_UP}), r AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT r.node, e.parent FROM r JOIN e ON r.ancestor = e.child) SELECT node, ancestor FROM r")
def ontology_closure(spark, sf):
    return gr.closure(_up(spark, sf))


@query("annotate_left_join", "SELECT p_partkey AS variant_id, s_suppkey AS gene, CASE WHEN s_suppkey IS NULL THEN 'not_found' ELSE 'annotated' END AS status FROM part LEFT JOIN supplier ON p_partkey = s_suppkey * 3")
def annotate_left_join(spark, sf):
    v = table(spark, sf, "part").select(F.col("p_partkey").alias("variant_id"))
    return ge.annotate_variants(v, table(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("variant_id"), F.col("s_suppkey").alias("gene")))


@query(
    "replication_join",
    f"""WITH e AS ({_EFFECTS}), d AS (SELECT * FROM e WHERE nation % 2 = 0), r AS (SELECT * FROM e WHERE nation % 2 = 1), m AS (SELECT brand, avg(effect) AS a FROM d GROUP BY 1), n AS (SELECT brand, avg(effect) AS b FROM r GROUP BY 1)
        SELECT coalesce(m.brand, n.brand) AS feature, a, b, CASE WHEN b IS NULL THEN 'discovery_only' WHEN a IS NULL THEN 'replication_only' WHEN sign(a) = sign(b) THEN 'same_sign' ELSE 'opposite_sign' END AS status FROM m FULL JOIN n ON m.brand = n.brand""",
    floats=("a", "b",),
)
def replication_join(spark, sf):
    from statloom.operators.study import replicate

    e = effects(spark, sf)
    half = lambda k, n: e.filter(F.col("nation") % 2 == k).groupBy(F.col("brand").alias("feature")).agg(F.avg("effect").alias(n))
    return replicate(half(0, "a"), half(1, "b"), "feature", "a", "b")


@query(
    "candidate_rank",
    f"SELECT brand, nation, row_number() OVER (PARTITION BY nation ORDER BY p, brand) AS rank FROM ({_PV}) QUALIFY rank <= 5",
)
def candidate_rank(spark, sf):
    from statloom.operators.study import rank_candidates

    return rank_candidates(_pv(spark, sf), "p", "brand", ["nation"], 5).select("brand", "nation", "rank")


@query(
    "effect_comparison",
    f"SELECT a.nation AS first, b.nation AS second, count(*) AS shared, corr(a.effect, b.effect) AS r, avg(CASE WHEN sign(a.effect) = sign(b.effect) THEN 1.0 ELSE 0 END) AS same_sign FROM ({_EFFECTS}) a JOIN ({_EFFECTS}) b ON a.brand = b.brand AND a.nation < b.nation GROUP BY 1, 2 HAVING count(*) >= 3",
    floats=("r", "same_sign",),
)
def effect_comparison(spark, sf):
    from statloom.operators.study import compare_effects

    return compare_effects(effects(spark, sf), "brand", "nation", "effect")


@query("selection_expression", f"SELECT brand, nation FROM ({_PV}) WHERE (p < 0.3 AND abs(effect) > 10) OR brand = 'Brand#11'")
def selection_expression(spark, sf):
    e = _pv(spark, sf)
    return e.filter(ex.condition("(p < 0.3 && abs(effect) > 10) || brand == 'Brand#11'", e.columns)).select("brand", "nation")


@query(
    "meta_prediction_interval",
    f"SELECT feature, k, estimate, se, estimate - 1.959963984540054 * sqrt(tau2 + se * se) AS pi_low, estimate + 1.959963984540054 * sqrt(tau2 + se * se) AS pi_high FROM ({_DL})",
    floats=("estimate", "se", "pi_low", "pi_high"),
)
def meta_prediction_interval(spark, sf):
    pooled = meta.pool(effects(spark, sf), "brand", "nation", "effect", "se", "dl")
    return meta.prediction_interval(pooled).select("feature", "k", "estimate", "se", "pi_low", "pi_high")


# -- series and survival ------------------------------------------------------------------------------------------------------------------------

_HOURLY = "SELECT event_type AS s, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS t, avg(value) AS v FROM events GROUP BY 1, 2"


def _hourly(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("s"), F.floor(F.unix_timestamp("ts") / 21600).alias("t")).agg(F.avg("value").alias("v"))


_ACF = f"""WITH d AS (SELECT s, t, v - avg(v) OVER (PARTITION BY s) AS c FROM ({_HOURLY})), l AS (SELECT d.s, k, c, lag(c, k) OVER (PARTITION BY d.s, k ORDER BY t) AS p FROM d, (SELECT unnest(range(1, 6)) AS k)),
    a AS (SELECT s, CAST(k AS INTEGER) AS lag, count(*) AS n, coalesce(sum(c * p), 0) / sum(c * c) AS acf FROM l GROUP BY s, k)"""


@query("acf_by_type", f"{_ACF} SELECT s, lag, n, acf FROM a", floats=("acf",))
def acf_by_type(spark, sf):
    return series.autocorrelation(_hourly(spark, sf), ["s"], "t", "v", 5).select("s", "lag", "n", "acf")


@query("acf_ljung_box", f"{_ACF} SELECT s, any_value(n) * (any_value(n) + 2.0) * sum(acf * acf / (n - lag)) AS statistic, 5.0::DOUBLE AS df FROM a GROUP BY s", floats=("statistic", "df",))
def acf_ljung_box(spark, sf):
    return series.ljung_box(series.autocorrelation(_hourly(spark, sf), ["s"], "t", "v", 5), ["s"]).select("s", "statistic", "df")


@query(
    "pacf_by_type",
    f"""{_ACF.replace("WITH", "WITH RECURSIVE", 1)}, w AS (SELECT s, list(acf ORDER BY lag) AS r FROM a GROUP BY s),
        p AS (SELECT s, r, 0 AS lag, []::DOUBLE[] AS phi, NULL::DOUBLE AS pacf FROM w UNION ALL
            SELECT s, r, lag + 1, list_append(list_transform(range(1, lag + 1), lambda j: phi[j] - pacf * phi[lag - j + 1]), pacf), pacf
            FROM (SELECT s, r, lag, phi, (r[lag + 1] - coalesce(list_sum(list_transform(range(1, lag + 1), lambda j: phi[j] * r[lag - j + 1])), 0)) / (1 - coalesce(list_sum(list_transform(range(1, lag + 1), lambda j: phi[j] * r[j])), 0)) AS pacf FROM p WHERE lag < 5))
        SELECT s, lag, pacf FROM p WHERE lag > 0""",
    floats=("pacf",),
)
def pacf_by_type(spark, sf):
    return series.partial_autocorrelation(series.autocorrelation(_hourly(spark, sf), ["s"], "t", "v", 5), ["s"])


@query("arima_by_type")
def arima_by_type(spark, sf):
    return series.arima(_hourly(spark, sf), ["s"], "t", "v", (1, 0, 1), horizon=3)


_SURV = "SELECT CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE) AS t, l_returnflag <> 'N' AS e, l_quantity AS x, l_linestatus AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _surv(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.datediff(F.col("l_shipdate"), F.col("o_orderdate")).cast("double").alias("t"), (F.col("l_returnflag") != "N").alias("e"), F.col("l_quantity").cast("double").alias("x"), F.col("l_linestatus").alias("g"))


@query(
    "cox_risk_sets",
    f"""WITH d AS ({_SURV}), c AS (SELECT t, count(*) FILTER (e) AS deaths, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM d GROUP BY t)
        SELECT t, deaths, CAST(sum(n) OVER w AS BIGINT) AS at_risk, sum(sx) OVER w AS cx0, sum(sxx) OVER w AS cx0_0 FROM c WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) QUALIFY deaths > 0""",
    floats=("t", "cx0", "cx0_0",),
)
def cox_risk_sets(spark, sf):
    return series.risk_sets(_surv(spark, sf), "t", "e", ["x"]).select("t", "deaths", "at_risk", "cx0", "cx0_0")


@query(
    "kaplan_meier",
    f"""WITH d AS ({_SURV}), c AS (SELECT g, t, count(*) FILTER (e) AS deaths, count(*) AS n FROM d GROUP BY g, t), r AS (SELECT g, t, deaths, CAST(sum(n) OVER (PARTITION BY g ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS at_risk FROM c QUALIFY deaths > 0)
        SELECT g, t, deaths, at_risk, CASE WHEN max(CASE WHEN deaths = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN deaths < at_risk THEN ln(1 - deaths / at_risk::DOUBLE) ELSE 0 END) OVER w) END AS survival FROM r WINDOW w AS (PARTITION BY g ORDER BY t ROWS UNBOUNDED PRECEDING)""",
    floats=("t", "survival",),
)
def kaplan_meier(spark, sf):
    return series.kaplan_meier(_surv(spark, sf), "t", "e", ["g"])


# Newton steps from zero; the risk sets are running sums over the times of a stratum, tied deaths count by Efron
_COX = f"""WITH RECURSIVE m AS (SELECT avg(x) AS centre FROM ({_SURV})), d AS (SELECT g, t, x::DOUBLE - centre AS x, count(*) AS n, count(*) FILTER (e) AS k FROM ({_SURV}), m GROUP BY ALL),
    r AS (SELECT 0 AS round, 0.0::DOUBLE AS b, NULL::DOUBLE AS info UNION ALL
        SELECT round + 1, b + sum(sx / m - s1 / s0) / sum(s2 / s0 - (s1 / s0) * (s1 / s0)), sum(s2 / s0 - (s1 / s0) * (s1 / s0))
        FROM (SELECT round, b, m, sx, r0 - f / m * d0 AS s0, r1 - f / m * d1 AS s1, r2 - f / m * d2 AS s2 FROM (SELECT *, unnest(range(m)) AS f FROM (
            SELECT round, b, m, sx, d0, d1, d2, sum(n0) OVER w AS r0, sum(n1) OVER w AS r1, sum(n2) OVER w AS r2
            FROM (SELECT round, b, g, t, sum(k)::BIGINT AS m, sum(k * x) AS sx, sum(k * h) AS d0, sum(k * h * x) AS d1, sum(k * h * x * x) AS d2, sum(n * h) AS n0, sum(n * h * x) AS n1, sum(n * h * x * x) AS n2
                FROM (SELECT round, b, g, t, x, n, k, exp(b * x) AS h FROM r, d WHERE round < 8) GROUP BY round, b, g, t)
            WINDOW w AS (PARTITION BY round, g ORDER BY t DESC ROWS UNBOUNDED PRECEDING))))
        GROUP BY round, b)"""


@query("cox_regression", f"{_COX} SELECT 'x' AS term, b AS estimate, sqrt(1 / info) AS se, b * sqrt(info) AS statistic FROM r WHERE round = 8", floats=("estimate", "se", "statistic"))
def cox_regression(spark, sf):
    return series.cox(_surv(spark, sf), "t", "e", ["x"], stratum="g").frame(spark).select("term", "estimate", "se", "statistic")


@query(
    "cox_residuals",
    """WITH d AS (SELECT l_orderkey, l_linenumber, CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE) AS t, CAST(l_returnflag <> 'N' AS INTEGER) AS e, l_linestatus AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        c AS (SELECT g, t, sum(e) AS m, count(*) AS k FROM d GROUP BY g, t), n AS (SELECT g, t, m, sum(k) OVER (PARTITION BY g ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n FROM c),
        h AS (SELECT g, t, sum(m / n::DOUBLE) OVER (PARTITION BY g ORDER BY t ROWS UNBOUNDED PRECEDING) AS hazard FROM n)
        SELECT l_orderkey, l_linenumber, e - hazard AS martingale FROM d JOIN h USING (g, t)""",
    floats=("martingale",),
)
def cox_residuals(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = j.select("l_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").cast("double").alias("t"), (F.col("l_returnflag") != "N").alias("e"), F.col("l_linestatus").alias("g"))
    return survival.cox_residuals(d, "t", "e", ties="breslow", stratum="g").select("l_orderkey", "l_linenumber", "martingale")


_FOLLOWED = "SELECT vec_id, CAST(vec_id % 97 + 1 AS DOUBLE) AS t, label > 3 AS e, embedding FROM embeddings"


@query(
    "cox_score_scan",
    f"""WITH d AS (SELECT t, e, generate_subscripts(embedding, 1) - 1 AS f, unnest(embedding)::DOUBLE AS x FROM ({_FOLLOWED})),
        m AS (SELECT f, avg(x) AS centre FROM d GROUP BY f), c AS (SELECT f, t, count(*) AS n, count(*) FILTER (e) AS k, sum(x - centre) AS s, sum((x - centre) * (x - centre)) AS ss, sum(x - centre) FILTER (e) AS sd FROM d JOIN m USING (f) GROUP BY f, t),
        r AS (SELECT f, n AS here, k, coalesce(sd, 0) AS sd, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(ss) OVER w AS ss FROM c WINDOW w AS (PARTITION BY f ORDER BY t DESC ROWS UNBOUNDED PRECEDING)),
        v AS (SELECT f, sum(here) AS called, sum(sd - k * s / n) AS score, sum(k * (ss / n - (s / n) * (s / n))) AS variance FROM r GROUP BY f)
        SELECT f AS feature_id, CAST(called AS BIGINT) AS called, score, variance, score / variance AS beta, score / sqrt(variance) AS statistic FROM v""",
    floats=("score", "variance", "beta", "statistic",),
)
def cox_score_scan(spark, sf):
    e = table(spark, sf, "embeddings")
    long = e.select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("feature_id", "value"))
    followed = e.select(F.col("vec_id").alias("sample_id"), (F.col("vec_id") % 97 + 1).cast("double").alias("t"), (F.col("label") > 3).alias("e"))
    return survival.cox_scan(long, followed, "t", "e", ties="breslow").select("feature_id", "called", "score", "variance", "beta", "statistic")


@query("cox_proportional_hazards")
def cox_proportional_hazards(spark, sf):
    d = _surv(spark, sf)
    fit = series.cox(d, "t", "e", ["x"], stratum="g")
    return spark.createDataFrame(survival.proportional_hazards(d, fit, "t", "e", stratum="g"))


@query(
    "log_rank",
    f"""WITH d AS ({_SURV}), c AS (SELECT t, count(*) FILTER (e) AS m, count(*) FILTER (e AND g = 'O') AS m1, count(*) AS k, count(*) FILTER (g = 'O') AS k1 FROM d GROUP BY t),
        r AS (SELECT m, m1, sum(k) OVER w AS n, sum(k1) OVER w AS n1 FROM c WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING))
        SELECT power(sum(m1 - m * n1 / n::DOUBLE), 2) / sum(CASE WHEN n > 1 THEN m * (n1 / n::DOUBLE) * (1 - n1 / n::DOUBLE) * (n - m) / (n - 1.0) ELSE 0 END) AS statistic FROM r WHERE m > 0""",
    floats=("statistic",), rest=False,
)
def log_rank(spark, sf):
    return series.log_rank(_surv(spark, sf), "t", "e", "g").select("statistic")


@query("genomic_factor")
def genomic_factor(spark, sf):
    e = effects(spark, sf).withColumn("trait", F.col("nation") % 4)
    w = e.groupBy("brand").pivot("trait", [0, 1, 2, 3]).agg(F.avg("effect")).dropna()
    r = w.agg(*[F.corr(str(i), str(j)).alias(f"c{i}{j}") for i in range(4) for j in range(4)]).collect()[0]
    s = np.array([[float(r[f"c{i}{j}"] or 0) * 0.5 + 0.5 * 0.36 + (0.3 if i == j else 0) for j in range(4)] for i in range(4)])
    out = ge.genomic_factor(s, np.eye(10) * 0.01)
    return spark.createDataFrame([(i, float(x), float(z)) for i, (x, z) in enumerate(zip(out["loadings"], out["se"]))], "trait int, loading double, se double")

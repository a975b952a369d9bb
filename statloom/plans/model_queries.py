"""Queries over pooling, Mendelian randomization and regression."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.operators import factored, meta, mr
from statloom.operators import regression as rg
from statloom.plans.registry import query, table

# per (brand, supplier nation): slope of price on discount
_EFFECTS = """SELECT p_brand AS brand, s_nationkey AS nation, count(*) AS n, regr_slope(l_extendedprice, l_discount) AS effect,
    sqrt((regr_syy(l_extendedprice, l_discount) - regr_slope(l_extendedprice, l_discount) * regr_sxy(l_extendedprice, l_discount)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_discount)) AS se
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 HAVING count(*) > 2 AND regr_sxx(l_extendedprice, l_discount) > 0"""


def effects(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand")), F.col("l_partkey") == F.col("p_partkey"))
    j = j.join(table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation")), F.col("l_suppkey") == F.col("s_suppkey"))
    fit = rg.ols_by(j, "l_extendedprice", "l_discount", ["brand", "nation"])
    return fit.filter("status = 'ok'").select("brand", "nation", "n", F.col("estimate").alias("effect"), "se")


@query("effects_by_brand_nation", f"SELECT brand, nation, n, effect, se FROM ({_EFFECTS})", floats=("effect", "se",))
def effects_by_brand_nation(spark, sf):
    return effects(spark, sf)


def _pooled(spark, sf, *how, **options):
    """Pooled over all nations, in the order of their keys."""
    nations = [r[0] for r in table(spark, sf, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    return meta.pool(effects(spark, sf), "brand", "nation", "effect", "se", *how, cohorts=nations, **options)


_POOL = f"""WITH e AS ({_EFFECTS}), s AS (SELECT brand, count(*) AS k, sum(1 / (se * se)) AS sw, sum(1 / power(se, 4)) AS sw2, sum(effect / (se * se)) / sum(1 / (se * se)) AS mu FROM e GROUP BY brand),
    q AS (SELECT brand, k, sw, sw2, mu, sum(power(effect - mu, 2) / (se * se)) AS q FROM e JOIN s USING (brand) GROUP BY ALL)"""


@query("meta_fixed", f"{_POOL} SELECT brand AS feature, k, mu AS estimate, sqrt(1 / sw) AS se, q, greatest(0, 100 * (q - (k - 1)) / q) AS i2, greatest(1, q / (k - 1)) AS h2 FROM q", floats=("estimate", "se", "q", "i2", "h2",))
def meta_fixed(spark, sf):
    return _pooled(spark, sf).select("feature", "k", "estimate", "se", "q", "i2", "h2")


_DL = f"""{_POOL}, t AS (SELECT *, greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM q)
    SELECT brand AS feature, any_value(t.k) AS k, any_value(tau2) AS tau2, sum(effect / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS estimate, sqrt(1 / sum(1 / (se * se + tau2))) AS se,
    any_value(direction) AS direction FROM e JOIN t USING (brand)
    JOIN (SELECT b.brand, string_agg(CASE WHEN effect > 0 THEN '+' WHEN effect < 0 THEN '-' WHEN effect = 0 THEN '0' ELSE '?' END, '' ORDER BY n_nationkey) AS direction
          FROM (SELECT DISTINCT brand FROM e) b CROSS JOIN nation LEFT JOIN e ON e.brand = b.brand AND nation = n_nationkey GROUP BY b.brand) USING (brand) GROUP BY brand"""


@query("meta_dl", _DL, floats=("tau2", "estimate", "se",))
def meta_dl(spark, sf):
    return _pooled(spark, sf, "dl").select("feature", "k", "tau2", "estimate", "se", "direction")


_HK = f"""{_POOL}, t AS (SELECT brand, greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM q),
    m AS (SELECT brand, count(*) AS k, any_value(tau2) AS tau2, sum(1 / (se * se + tau2)) AS w, sum(effect / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS estimate FROM e JOIN t USING (brand) GROUP BY brand),
    r AS (SELECT brand, sum(power(effect - estimate, 2) / (se * se + m.tau2)) / (any_value(k) - 1) AS scale FROM e JOIN m USING (brand) GROUP BY brand)
    SELECT brand AS feature, k, estimate, sqrt({{}} / w) AS se, estimate / sqrt({{}} / w) AS statistic FROM m JOIN r USING (brand)"""


@query("meta_hartung_knapp", _HK.format("scale", "scale"), floats=("estimate", "se", "statistic"))
def meta_hartung_knapp(spark, sf):
    return _pooled(spark, sf, "dl", "hk").select("feature", "k", "estimate", "se", "statistic")


@query("meta_modified_hartung_knapp", _HK.format("greatest(1, scale)", "greatest(1, scale)"), floats=("estimate", "se", "statistic"))
def meta_modified_hartung_knapp(spark, sf):
    return _pooled(spark, sf, "dl", "mhk").select("feature", "k", "estimate", "se", "statistic")


def _tau2_sql(above: str, top: str) -> str:
    """Studies e, and t with the tau2 of each brand by bisection: ``above`` holds, of sums over y and weights w, while tau2 is under the root, ``top`` is over it."""
    return f"""WITH RECURSIVE e AS ({_EFFECTS}),
        b AS (SELECT brand, 0 AS step, 0.0::DOUBLE AS low, {top}::DOUBLE AS high FROM e GROUP BY brand UNION ALL
            SELECT brand, step + 1, CASE WHEN {above} THEN any_value(low + high) / 2 ELSE low END, CASE WHEN {above} THEN high ELSE any_value(low + high) / 2 END
            FROM (SELECT *, sum(y * w) OVER (PARTITION BY brand) / sum(w) OVER (PARTITION BY brand) AS mu FROM (SELECT b.brand, step, low, high, effect AS y, 1 / (se * se + (low + high) / 2) AS w FROM b JOIN e USING (brand) WHERE step < 110))
            GROUP BY brand, step, low, high),
        t AS (SELECT brand, (low + high) / 2 AS tau2 FROM b WHERE step = 110)"""


@query(
    "meta_pm",
    f"""{_tau2_sql("sum(w * (y - mu) * (y - mu)) > count(*) - 1", "var_samp(effect)")}
        SELECT brand AS feature, count(*) AS k, any_value(tau2) AS tau2, sum(effect / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS estimate, sqrt(1 / sum(1 / (se * se + tau2))) AS se FROM e JOIN t USING (brand) GROUP BY brand""",
    floats=("tau2", "estimate", "se"),
)
def meta_pm(spark, sf):
    return _pooled(spark, sf, "pm").select("feature", "k", "tau2", "estimate", "se")


@query(
    "meta_reml",
    f"""{_tau2_sql("sum(w * w * (y - mu) * (y - mu)) - sum(w) + sum(w * w) / sum(w) > 0", "10 * var_samp(effect)")},
        m AS (SELECT brand, count(*) AS k, any_value(tau2) AS tau2, sum(1 / (se * se + tau2)) AS w, sum(effect / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS estimate FROM e JOIN t USING (brand) GROUP BY brand)
        SELECT brand AS feature, any_value(k) AS k, any_value(tau2) AS tau2, any_value(estimate) AS estimate, sqrt(sum(power(effect - estimate, 2) / (se * se + m.tau2)) / (any_value(k) - 1) / any_value(w)) AS se FROM e JOIN m USING (brand) GROUP BY brand""",
    floats=("tau2", "estimate", "se"),
)
def meta_reml(spark, sf):
    return _pooled(spark, sf, "reml", test="hk").select("feature", "k", "tau2", "estimate", "se")


@query(
    "meta_leave_one_out",
    f"""WITH e AS ({_EFFECTS}) SELECT a.brand AS feature, a.nation AS left_out, sum(b.effect / (b.se * b.se)) / sum(1 / (b.se * b.se)) AS estimate, sqrt(1 / sum(1 / (b.se * b.se))) AS se
        FROM e a JOIN e b ON a.brand = b.brand AND a.nation <> b.nation GROUP BY 1, 2""",
    floats=("estimate", "se",),
)
def meta_leave_one_out(spark, sf):
    return meta.leave_one_out(effects(spark, sf), "brand", "nation", "effect", "se").select("feature", "left_out", "estimate", "se")


@query(
    "meta_egger",
    f"""WITH e AS ({_EFFECTS}), c AS (SELECT brand, count(*) AS k, sum(1 / (se * se)) AS s, sum(1 / se) / sum(1 / (se * se)) AS mx, sum(effect / (se * se)) / sum(1 / (se * se)) AS my FROM e GROUP BY 1),
        r AS (SELECT brand, k, my, mx, s, sum((se - mx) * (effect - my) / (se * se)) / sum(power((se - mx) / se, 2)) AS slope, sum(power((se - mx) / se, 2)) AS sxx FROM e JOIN c USING (brand) GROUP BY ALL)
        SELECT brand AS feature, any_value(k) AS k, any_value(my - slope * mx) AS intercept, any_value(slope) AS slope, sqrt(sum(power((effect - my - slope * (se - mx)) / se, 2)) / (any_value(k) - 2) / any_value(sxx)) AS se
        FROM e JOIN r USING (brand) GROUP BY brand HAVING any_value(k) > 2""",
    floats=("k", "intercept", "slope", "se",),
)
def meta_egger(spark, sf):
    return meta.egger(effects(spark, sf), "brand", "effect", "se").select("feature", "k", "intercept", "slope", "se")


@query(
    "meta_regression",
    f"""WITH e AS (SELECT *, nation::DOUBLE AS x FROM ({_EFFECTS})), c AS (SELECT brand, sum(x / (se * se)) / sum(1 / (se * se)) AS mx, sum(effect / (se * se)) / sum(1 / (se * se)) AS my FROM e GROUP BY 1)
        SELECT brand AS feature, count(*) AS k, sum((x - mx) * (effect - my) / (se * se)) / sum(power((x - mx) / se, 2)) AS slope, sqrt(1 / sum(power((x - mx) / se, 2))) AS se FROM e JOIN c USING (brand) GROUP BY brand""",
    floats=("slope", "se",),
)
def meta_regression(spark, sf):
    e = effects(spark, sf).withColumn("x", F.col("nation").cast("double"))
    return meta.regression(e, "brand", "effect", "se", "x", tau2=0.0).filter("status = 'ok'").select("feature", "k", "slope", "se")


@query(
    "rubin_pool",
    f"""WITH e AS (SELECT *, effect AS est FROM ({_EFFECTS})), s AS (SELECT brand, count(*)::DOUBLE AS m, avg(est) AS estimate, avg(se * se) AS within, coalesce(var_samp(est), 0) AS between FROM e GROUP BY 1)
        SELECT brand, estimate, within, between, sqrt(within + (1 + 1 / m) * between) AS se, (m - 1) / power((1 + 1 / m) * between / (within + (1 + 1 / m) * between), 2) AS df FROM s""",
    floats=("estimate", "within", "between", "se", "df",),
)
def rubin_pool(spark, sf):
    return meta.rubin(effects(spark, sf), ["brand"], "effect", "se").select("brand", "estimate", "within", "between", "se", "df")


# variants are parts; exposures and outcomes are market regions' mean deviations of discount and tax
_MR = """SELECT p_partkey AS variant, s_nationkey % 5 AS trait, count(*) AS n, avg(l_discount) - 0.05 AS bx, stddev_samp(l_discount) / sqrt(count(*)) AS sx, avg(l_tax) - 0.04 AS by_, stddev_samp(l_tax) / sqrt(count(*)) AS sy,
    substr('ACGT', 1 + p_partkey % 4, 1) AS ea, substr('ACGT', 1 + (p_partkey // 4) % 4, 1) AS oa FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, p_partkey
    HAVING count(*) > 2 AND stddev_samp(l_discount) > 0 AND stddev_samp(l_tax) > 0"""
_HARM = f"""SELECT 'x' || a.trait AS exposure, 'y' || b.trait AS outcome, a.variant, a.bx AS x, a.sx, CASE WHEN a.variant % 3 = 0 THEN -1 ELSE 1 END * CASE WHEN a.variant % 3 = 0 THEN -1 ELSE 1 END * b.by_ AS y, b.sy
    FROM ({_MR}) a JOIN ({_MR}) b ON a.variant = b.variant WHERE a.ea <> a.oa AND a.ea <> translate(a.oa, 'ACGT', 'TGCA') AND a.bx <> 0"""


def _traits(spark, sf):
    # a mean of exactly 0.05 is zero or rounding noise by the order of addition, and ``a.bx <> 0`` keeps the noise: rows are added in the order of the file, as the SQL does on one thread
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_discount", "l_tax", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    j = lines.join(table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("trait")), F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(table(spark, sf, "part").select(F.col("p_partkey").alias("variant")), F.col("l_partkey") == F.col("variant"))
    own = W.partitionBy("variant", "trait").orderBy("_file", "_row")
    whole = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n = F.count(F.lit(1)).over(whole)
    se = lambda c: F.stddev_samp(c).over(whole) / F.sqrt(n)
    t = j.select("variant", "trait", n.alias("n"), (F.avg("l_discount").over(whole) - 0.05).alias("bx"), se("l_discount").alias("sx"), (F.avg("l_tax").over(whole) - 0.04).alias("by"), se("l_tax").alias("sy"), F.row_number().over(own).alias("_k"))
    t = t.filter("_k = 1 and n > 2 and sx > 0 and sy > 0").drop("_k")
    base = lambda e: F.substring(F.lit("ACGT"), (F.lit(1) + e % 4).cast("int"), F.lit(1))
    return t.withColumn("ea", base(F.col("variant"))).withColumn("oa", base(F.floor(F.col("variant") / 4))).filter("true")


def harmonized(spark, sf):
    t = _traits(spark, sf)
    x = t.select(F.concat(F.lit("x"), F.col("trait").cast("string")).alias("exposure"), F.col("variant"), F.col("ea").alias("effect_allele"), F.col("oa").alias("other_allele"), F.col("bx").alias("beta"), F.col("sx").alias("se"))
    flip = F.col("variant") % 3 == 0  # every third outcome effect is reported for the other allele
    y = t.select(F.concat(F.lit("y"), F.col("trait").cast("string")).alias("outcome"), F.col("variant"), F.when(flip, F.col("oa")).otherwise(F.col("ea")).alias("effect_allele"), F.when(flip, F.col("ea")).otherwise(F.col("oa")).alias("other_allele"), F.when(flip, -F.col("by")).otherwise(F.col("by")).alias("beta"), F.col("sy").alias("se"))
    return x, y


@query("mr_harmonize", f"SELECT exposure, outcome, variant, x AS beta_x, y AS beta_y FROM ({_HARM})", floats=("beta_x", "beta_y",))
def mr_harmonize(spark, sf):
    x, y = harmonized(spark, sf)
    return mr.instruments(mr.harmonize(x.filter("effect_allele <> other_allele"), y)).select("exposure", "outcome", "variant", "beta_x", "beta_y")


def _inst(spark, sf):
    x, y = harmonized(spark, sf)
    return mr.instruments(mr.harmonize(x.filter("effect_allele <> other_allele"), y))


@query(
    "mr_ivw",
    f"""WITH h AS ({_HARM}), b AS (SELECT exposure, outcome, count(*) AS n, sum(x * y / (sy * sy)) / sum(x * x / (sy * sy)) AS b, sum(x * x / (sy * sy)) AS sxx FROM h GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT h.exposure, h.outcome, any_value(n) AS n, any_value(b) AS estimate, sqrt(1 / any_value(sxx)) AS se, sum(power((y - b * x) / sy, 2)) AS q FROM h JOIN b USING (exposure, outcome) GROUP BY 1, 2""",
    floats=("estimate", "se", "q",),
)
def mr_ivw(spark, sf):
    return mr.ivw(_inst(spark, sf), ["exposure", "outcome"]).select("exposure", "outcome", "n", "estimate", "se", "q")


@query(
    "xwas_mr_grid",
    f"""WITH h AS ({_HARM}), b AS (SELECT exposure, outcome, count(*) AS n, sum(x * y / (sy * sy)) / sum(x * x / (sy * sy)) AS estimate, sqrt(1 / sum(x * x / (sy * sy))) AS se FROM h GROUP BY 1, 2 HAVING count(*) >= 3)
        SELECT exposure, outcome, n, estimate, se, estimate / se AS statistic FROM b""",
    floats=("estimate", "se", "statistic",),
)
def xwas_mr_grid(spark, sf):
    x, y = harmonized(spark, sf)
    screen, _ = mr.grid(x.filter("effect_allele <> other_allele"), y)
    return screen.select("exposure", "outcome", "n", "estimate", "se", "statistic")


@query(
    "mr_egger",
    f"""WITH h AS (SELECT exposure, outcome, abs(x) AS x, sign(x) * y AS y, 1 / (sy * sy) AS w FROM ({_HARM})), c AS (SELECT exposure, outcome, count(*) AS n, sum(w) AS s, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM h GROUP BY 1, 2 HAVING count(*) >= 3)
        SELECT exposure, outcome, any_value(n) AS n, sum(w * (x - mx) * (y - my)) / sum(w * power(x - mx, 2)) AS estimate, any_value(my) - sum(w * (x - mx) * (y - my)) / sum(w * power(x - mx, 2)) * any_value(mx) AS intercept
        FROM h JOIN c USING (exposure, outcome) GROUP BY 1, 2""",
    floats=("estimate", "intercept",),
)
def mr_egger(spark, sf):
    return mr.egger(_inst(spark, sf), ["exposure", "outcome"]).select("exposure", "outcome", "n", "estimate", "intercept")


@query(
    "mr_weighted_median",
    f"""WITH r AS (SELECT exposure, outcome, y / x AS r, power(x / sy, 2) AS w, variant FROM ({_HARM})),
        p AS (SELECT *, (sum(w) OVER (PARTITION BY exposure, outcome ORDER BY r, variant ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY exposure, outcome) AS a FROM r),
        n AS (SELECT *, lead(a) OVER w2 AS na, lead(r) OVER w2 AS nr, row_number() OVER w2 AS i, count(*) OVER (PARTITION BY exposure, outcome) AS n FROM p WINDOW w2 AS (PARTITION BY exposure, outcome ORDER BY r, variant))
        SELECT exposure, outcome, n, CASE WHEN a > 0.5 OR na IS NULL THEN r ELSE r + (nr - r) * (0.5 - a) / (na - a) END AS estimate FROM n
        WHERE n >= 3 AND ((a <= 0.5 AND (na > 0.5 OR na IS NULL)) OR (i = 1 AND a > 0.5))""",
    floats=("estimate",),
)
def mr_weighted_median(spark, sf):
    return mr.weighted_median(_inst(spark, sf), ["exposure", "outcome"]).select("exposure", "outcome", "n", "estimate")


@query(
    "mr_leave_one_out",
    f"""WITH h AS (SELECT * FROM ({_HARM}) WHERE exposure = 'x0' AND outcome = 'y1'), s AS (SELECT count(*) AS n, sum(x * x / (sy * sy)) AS sxx, sum(x * y / (sy * sy)) AS sxy FROM h)
        SELECT exposure, outcome, variant AS left_out, (sxy - x * y / (sy * sy)) / (sxx - x * x / (sy * sy)) AS estimate FROM h, s WHERE n >= 3""",
    floats=("estimate",),
)
def mr_leave_one_out(spark, sf):
    return mr.leave_one_out(_inst(spark, sf).filter("exposure = 'x0' and outcome = 'y1'"), ["exposure", "outcome"]).select("exposure", "outcome", "left_out", "estimate")


@query(
    "mr_steiger",
    f"""SELECT exposure, outcome, count(*) FILTER (power(x / sx, 2) / (power(x / sx, 2) + 998) > power(y / sy, 2) / (power(y / sy, 2) + 998) + 1e-9) AS retained, count(*) AS n FROM ({_HARM}) GROUP BY 1, 2""",
)
def mr_steiger(spark, sf):
    return mr.steiger(_inst(spark, sf), 1000, 1000).groupBy("exposure", "outcome").agg(F.count_if(F.col("r2_x") > F.col("r2_y") + 1e-9).alias("retained"), F.count(F.lit(1)).alias("n"))


@query("mr_presso")
def mr_presso(spark, sf):
    return mr.presso(_inst(spark, sf), ["exposure", "outcome"])


@query("mr_contamination_mixture")
def mr_contamination_mixture(spark, sf):
    # ratios over effects that are zero but for rounding would stretch the grid to 1e14
    return mr.contamination_mixture(_inst(spark, sf).filter(F.abs("beta_x") > 1e-12), ["exposure", "outcome"])


@query(
    "ols_simple",
    """SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS estimate,
       sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)) AS se FROM lineitem GROUP BY 1""",
    floats=("estimate", "se",),
)
def ols_simple(spark, sf):
    return rg.ols_by(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"]).select("l_returnflag", "n", "estimate", "se")


_TWO = """WITH m AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2 FROM lineitem),
    s AS (SELECT sum((l_quantity - m1) * (l_quantity - m1)) AS a, sum((l_quantity - m1) * (l_discount - m2)) AS b, sum((l_discount - m2) * (l_discount - m2)) AS c,
          sum((l_quantity - m1) * (l_extendedprice - my)) AS u, sum((l_discount - m2) * (l_extendedprice - my)) AS v, any_value(my) AS my, any_value(m1) AS m1, any_value(m2) AS m2 FROM lineitem, m),
    b AS (SELECT (c * u - b * v) / (a * c - b * b) AS b1, (a * v - b * u) / (a * c - b * b) AS b2, my, m1, m2 FROM s)"""


@query("ols_two_predictor", f"{_TWO} SELECT 'l_quantity' AS term, b1 AS estimate FROM b UNION ALL SELECT 'l_discount', b2 FROM b UNION ALL SELECT '(Intercept)', my - b1 * m1 - b2 * m2 FROM b", floats=("estimate",))
def ols_two_predictor(spark, sf):
    return rg.ols(table(spark, sf, "lineitem"), "l_extendedprice", [rg.ONE, "l_quantity", "l_discount"]).frame(spark).select("term", "estimate")


@query(
    "ols_weighted",
    """WITH m AS (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity) AS my, sum(l_quantity * l_discount) / sum(l_quantity) AS mx FROM lineitem),
       s AS (SELECT sum(l_quantity * (l_discount - mx) * (l_extendedprice - my)) / sum(l_quantity * power(l_discount - mx, 2)) AS b, any_value(my) AS my, any_value(mx) AS mx, sum(l_quantity * power(l_discount - mx, 2)) AS sxx, count(*) AS n FROM lineitem, m)
       SELECT 'l_discount' AS term, any_value(b) AS estimate, sqrt(sum(l_quantity * power(l_extendedprice - s.my - b * (l_discount - s.mx), 2)) / (any_value(n) - 2) / any_value(sxx)) AS se FROM lineitem, s""",
    floats=("estimate", "se",),
)
def ols_weighted(spark, sf):
    return rg.ols(table(spark, sf, "lineitem"), "l_extendedprice", [rg.ONE, "l_discount"], weight="l_quantity").frame(spark).filter("term = 'l_discount'").select("term", "estimate", "se")


@query(
    "ols_scan_features",
    """WITH d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS f FROM embeddings)
       SELECT f AS feature_id, count(*) AS called, regr_slope(label, x) AS beta, sqrt((regr_syy(label, x) - regr_slope(label, x) * regr_sxy(label, x)) / (count(*) - 2) / regr_sxx(label, x)) AS standard_error FROM d GROUP BY 1""",
    floats=("beta", "standard_error",),
)
def ols_scan_features(spark, sf):
    e = table(spark, sf, "embeddings")
    long = e.select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("feature_id", "value"))
    return rg.scan(long, e.select(F.col("vec_id").alias("sample_id"), "label"), "label", []).select("feature_id", "called", "beta", "standard_error")


_LINES = "SELECT l_discount::DOUBLE AS x, l_quantity::DOUBLE AS y0, l_extendedprice::DOUBLE AS y1, l_tax::DOUBLE AS y2 FROM lineitem"


def _lines(spark, sf):
    cols = {"x": "l_discount", "y0": "l_quantity", "y1": "l_extendedprice", "y2": "l_tax"}
    return table(spark, sf, "lineitem").select(*[F.col(c).cast("double").alias(n) for n, c in cols.items()])


@query(
    "multivariate_regression",
    " UNION ALL ".join(
        f"""SELECT '{y}' AS outcome, '{t}' AS term, {e} AS estimate, sqrt((regr_syy({y}, x) - regr_slope({y}, x) * regr_sxy({y}, x)) / (count(*) - 2) * {v}) AS se FROM ({_LINES})"""
        for y in ("y0", "y1", "y2") for t, e, v in (("(Intercept)", f"regr_intercept({y}, x)", "(1.0 / count(*) + avg(x) * avg(x) / regr_sxx(x, x))"), ("x", f"regr_slope({y}, x)", "1.0 / regr_sxx(x, x)"))
    ),
    floats=("estimate", "se",),
)
def multivariate_regression(spark, sf):
    fit = factored.multivariate(_lines(spark, sf), ["y0", "y1", "y2"], [rg.ONE, "x"])
    return spark.createDataFrame(fit.table()).select("outcome", "term", "estimate", "se")


@query(
    "residual_covariance",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, (covar_pop({a}, {b}) * count(*) - regr_slope({a}, x) * regr_sxy({b}, x)) / (count(*) - 2) AS covariance FROM ({_LINES})" for a, b in (("y0", "y0"), ("y0", "y1"), ("y0", "y2"), ("y1", "y1"), ("y1", "y2"), ("y2", "y2"))),
    floats=("covariance",),
)
def residual_covariance(spark, sf):
    return spark.createDataFrame(factored.multivariate(_lines(spark, sf), ["y0", "y1", "y2"], [rg.ONE, "x"]).covariance_table())


@query(
    "ols_min_norm",
    f"""WITH f AS (SELECT regr_intercept(y1, x) AS a, regr_slope(y1, x) AS b FROM ({_LINES}))
        SELECT '(Intercept)' AS term, a AS estimate FROM f UNION ALL SELECT 'x', b / 5 FROM f UNION ALL SELECT 'twice', 2 * b / 5 FROM f""",
    floats=("estimate",),
)
def ols_min_norm(spark, sf):
    """A term and its double: the least norm deals the slope b as b / 5 and 2 b / 5."""
    d = _lines(spark, sf).withColumn("twice", 2 * F.col("x"))
    return spark.createDataFrame(factored.min_norm(d, "y1", [rg.ONE, "x", "twice"]).table()).select("term", "estimate")


@query(
    "glm_scan_scores",
    """WITH d AS (SELECT CAST(label > 4 AS INTEGER) AS y, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS f FROM embeddings), p AS (SELECT avg(CAST(label > 4 AS INTEGER)) AS p FROM embeddings),
        s AS (SELECT f, count(*) AS called, sum(x * (y - p)) AS score, any_value(p * (1 - p)) * (sum(x * x) - sum(x) * sum(x) / count(*)) AS variance FROM d, p GROUP BY f)
        SELECT f AS feature_id, called, score, variance, score / variance AS beta, score / sqrt(variance) AS statistic, 'ok' AS status FROM s""",
    floats=("score", "variance", "beta", "statistic"),
)
def glm_scan_scores(spark, sf):
    e = table(spark, sf, "embeddings")
    long = e.select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("feature_id", "value"))
    return rg.score_scan(long, e.select(F.col("vec_id").alias("sample_id"), (F.col("label") > 4).cast("double").alias("y")), "y", [], "binomial").drop("p_value")


# Newton steps on the counts of each pair of predictors; the inverse of the 3 x 3 information is written out
_POISSON = """WITH RECURSIVE d AS (SELECT l_discount::DOUBLE AS x, l_tax::DOUBLE AS z, count(*) AS n, sum(l_linenumber)::DOUBLE AS s FROM lineitem GROUP BY 1, 2),
    r AS (SELECT 0 AS k, ln(sum(s) / sum(n)) AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, NULL::DOUBLE AS v0, NULL::DOUBLE AS v1, NULL::DOUBLE AS v2 FROM d UNION ALL
        SELECT k + 1, b0 + (c00 * g0 + c01 * g1 + c02 * g2) / det, b1 + (c01 * g0 + c11 * g1 + c12 * g2) / det, b2 + (c02 * g0 + c12 * g1 + c22 * g2) / det, c00 / det, c11 / det, c22 / det
        FROM (SELECT *, a11 * a22 - a12 * a12 AS c00, a02 * a12 - a01 * a22 AS c01, a01 * a12 - a02 * a11 AS c02, a00 * a22 - a02 * a02 AS c11, a01 * a02 - a00 * a12 AS c12, a00 * a11 - a01 * a01 AS c22,
                a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02) AS det
            FROM (SELECT k, b0, b1, b2, sum(m) AS a00, sum(m * x) AS a01, sum(m * z) AS a02, sum(m * x * x) AS a11, sum(m * x * z) AS a12, sum(m * z * z) AS a22, sum(s - m) AS g0, sum((s - m) * x) AS g1, sum((s - m) * z) AS g2
                FROM (SELECT r.*, x, z, s, n * exp(b0 + b1 * x + b2 * z) AS m FROM r, d WHERE k < 12) GROUP BY k, b0, b1, b2)))"""


@query(
    "glm_poisson",
    f"""{_POISSON} SELECT t.term, CASE t.i WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END AS estimate, sqrt(CASE t.i WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END) AS se
        FROM r, (VALUES (0, '(Intercept)'), (1, 'l_discount'), (2, 'l_tax')) t(i, term) WHERE k = 12""",
    floats=("estimate", "se"),
)
def glm_poisson(spark, sf):
    return rg.glm(table(spark, sf, "lineitem"), "l_linenumber", [rg.ONE, "l_discount", "l_tax"], "poisson").frame(spark).select("term", "estimate", "se")


# With a term for each of two groups a log link puts each group at its mean, whatever the family, so estimates and information have closed forms
_GROUP_FAMILIES = {
    "glm_negative_binomial": ("negative_binomial(3)", "l_linenumber::DOUBLE", "(m + m * m / 3)", False),
    "glm_tweedie": ("tweedie(1.5)", "l_extendedprice::DOUBLE / 1000", "power(m, 1.5)", True),
    "glm_gamma": ("gamma", "l_extendedprice::DOUBLE / 1000", "(m * m)", True),
    "glm_inverse_gaussian": ("inverse_gaussian", "l_extendedprice::DOUBLE / 1000", "(m * m * m)", True),
}


def _group_glm(name: str):
    family, y, variance, dispersion = _GROUP_FAMILIES[name]
    phi = f"(SELECT sum((y - m) * (y - m) / {variance}) / (count(*) - 2) FROM d JOIN g USING (x))" if dispersion else "1.0"

    @query(
        name,
        f"""WITH d AS (SELECT l_linestatus = 'O' AS x, {y} AS y FROM lineitem), g AS (SELECT x, count(*) AS n, avg(y) AS m FROM d GROUP BY x), w AS (SELECT x, ln(m) AS l, {phi} / (n * m * m / {variance}) AS v FROM g)
            SELECT CASE WHEN x THEN 'open' ELSE 'filled' END AS term, l AS estimate, sqrt(v) AS se FROM w""",
        floats=("estimate", "se"),
    )
    def run(spark, sf):
        value = F.col("l_linenumber").cast("double") if "linenumber" in y else F.col("l_extendedprice") / 1000
        d = table(spark, sf, "lineitem").select(value.alias("y"), *[(F.col("l_linestatus") == v).cast("double").alias(n) for n, v in (("open", "O"), ("filled", "F"))])
        return rg.glm(d, "y", ["open", "filled"], family).frame(spark).select("term", "estimate", "se")


for _name in _GROUP_FAMILIES:
    _group_glm(_name)


@query(
    "glm_logit_saturated",
    """WITH g AS (SELECT l_linestatus = 'O' AS x, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END) AS p FROM lineitem GROUP BY 1), a AS (SELECT ln(p / (1 - p)) AS l FROM g WHERE NOT x), b AS (SELECT ln(p / (1 - p)) AS l FROM g WHERE x)
       SELECT '(Intercept)' AS term, l AS estimate FROM a UNION ALL SELECT 'x', b.l - a.l FROM a, b""",
    floats=("estimate",),
)
def glm_logit_saturated(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_discount") > 0.05).cast("double").alias("y"), (F.col("l_linestatus") == "O").cast("double").alias("x"))
    return rg.glm(d, "y", [rg.ONE, "x"], "binomial").frame(spark).select("term", "estimate")


@query(
    "iv_2sls",
    """SELECT 'l_quantity' AS term, covar_samp(l_linenumber, l_extendedprice) / covar_samp(l_linenumber, l_quantity) AS estimate FROM lineitem""",
    floats=("estimate",),
)
def iv_2sls(spark, sf):
    return rg.two_stage(table(spark, sf, "lineitem"), "l_extendedprice", [rg.ONE], ["l_quantity"], ["l_linenumber"]).frame(spark).filter("term = 'l_quantity'").select("term", "estimate")


@query(
    "ols_robust_hc0",
    """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx FROM lineitem)
       SELECT 'l_quantity' AS term, sqrt(sum(power((l_quantity - mx) * (l_extendedprice - a - b * l_quantity), 2))) / any_value(sxx) AS se FROM lineitem, m""",
    floats=("se",),
)
def ols_robust_hc0(spark, sf):
    return rg.ols_robust(table(spark, sf, "lineitem"), "l_extendedprice", [rg.ONE, "l_quantity"], "HC0").frame(spark).filter("term = 'l_quantity'").select("term", "se")


@query(
    "ols_cluster_cr0",
    """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx FROM lineitem),
       c AS (SELECT l_suppkey, sum((l_quantity - mx) * (l_extendedprice - a - b * l_quantity)) AS u, any_value(sxx) AS sxx FROM lineitem, m GROUP BY 1)
       SELECT 'l_quantity' AS term, sqrt(sum(u * u)) / any_value(sxx) AS se FROM c""",
    floats=("se",),
)
def ols_cluster_cr0(spark, sf):
    return rg.ols_robust(table(spark, sf, "lineitem"), "l_extendedprice", [rg.ONE, "l_quantity"], "CR0", "l_suppkey").frame(spark).filter("term = 'l_quantity'").select("term", "se")


# Newton steps of the weighted logistic fit, then the spread of the units' score totals within strata between two copies of the inverse information
_SURVEY = """WITH RECURSIVE q AS (SELECT avg(l_quantity) AS q FROM lineitem), d AS (SELECT l_tax::DOUBLE AS x, CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0 END AS y, l_returnflag AS h, l_suppkey AS u, l_quantity / q AS w FROM lineitem, q),
    c AS (SELECT x, sum(w) AS w, sum(w * y) AS s FROM d GROUP BY x),
    r AS (SELECT 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS i00, 0.0::DOUBLE AS i01, 0.0::DOUBLE AS i11 UNION ALL
        SELECT k + 1, b0 + (a11 * g0 - a01 * g1) / det, b1 + (a00 * g1 - a01 * g0) / det, a11 / det, -a01 / det, a00 / det
        FROM (SELECT *, a00 * a11 - a01 * a01 AS det FROM (SELECT k, b0, b1, sum(w * p * (1 - p)) AS a00, sum(w * p * (1 - p) * x) AS a01, sum(w * p * (1 - p) * x * x) AS a11, sum(s - w * p) AS g0, sum((s - w * p) * x) AS g1
            FROM (SELECT k, b0, b1, x, w, s, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM r, c WHERE k < 12) GROUP BY k, b0, b1))),
    f AS (SELECT * FROM r WHERE k = 12), t AS (SELECT h, u, sum(w * (y - 1 / (1 + exp(-(b0 + b1 * x))))) AS u0, sum(w * (y - 1 / (1 + exp(-(b0 + b1 * x)))) * x) AS u1 FROM d, f GROUP BY h, u),
    v AS (SELECT sum(m * c00) AS v00, sum(m * c01) AS v01, sum(m * c11) AS v11 FROM (SELECT count(*) AS m, var_samp(u0) AS c00, covar_samp(u0, u1) AS c01, var_samp(u1) AS c11 FROM t GROUP BY h))"""


@query(
    "survey_logit",
    f"""{_SURVEY} SELECT '(Intercept)' AS term, b0 AS estimate, sqrt(i00 * i00 * v00 + 2 * i00 * i01 * v01 + i01 * i01 * v11) AS se FROM f, v UNION ALL
        SELECT 'l_tax', b1, sqrt(i01 * i01 * v00 + 2 * i01 * i11 * v01 + i11 * i11 * v11) FROM f, v""",
    floats=("estimate", "se"),
)
def survey_logit(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("y", (F.col("l_discount") > 0.05).cast("double"))
    fit = rg.survey(d, "y", [rg.ONE, "l_tax"], "binomial", "l_quantity", "l_returnflag", "l_suppkey")
    return fit.frame(spark).select("term", "estimate", "se")


@query(
    "mediation_sobel",
    """WITH x AS (SELECT l_quantity AS t, l_discount AS m, l_extendedprice AS y FROM lineitem),
       s AS (SELECT regr_sxx(y, t) AS tt, regr_sxy(m, t) AS tm, regr_sxx(y, m) AS mm, regr_sxy(y, t) AS ty, regr_sxy(y, m) AS my FROM x)
       SELECT tm / tt AS a, (tt * my - tm * ty) / (tt * mm - tm * tm) AS b, (tm / tt) * (tt * my - tm * ty) / (tt * mm - tm * tm) AS indirect, ty / tt AS total FROM s""",
    floats=("a", "b", "indirect", "total",), rest=False,
)
def mediation_sobel(spark, sf):
    r = rg.mediation(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", "l_discount")
    return spark.createDataFrame([(float(r["a"]), float(r["b"]), float(r["indirect"]), float(r["total"]))], "a double, b double, indirect double, total double")


@query("penalized_path")
def penalized_path(spark, sf):
    return spark.createDataFrame(rg.penalized_path(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], n_lambda=20))


@query("ame_logit")
def ame_logit(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("y", (F.col("l_discount") > 0.05).cast("double"))
    fit = rg.glm(d, "y", [rg.ONE, "l_tax"], "binomial")
    e, s = rg.average_marginal_effect(d, fit, "l_tax", "binomial")
    return spark.createDataFrame([("l_tax", e, s)], "term string, estimate double, se double")

"""Queries over the hypothesis tests, effect sizes and multiple testing."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import hypothesis as h
from statloom.operators import multiplicity as mt
from statloom.plans.registry import query, table

_AVGRANK = "(rank() OVER (PARTITION BY {p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0)"


def _rank(v: str, p: str = "1") -> str:
    return _AVGRANK.format(p=p, v=v)


@query(
    "ttest_welch_by_flag",
    """SELECT l_shipyear_mode AS l_linestatus, n1, n2, m1 - m2 AS estimate, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS statistic,
       power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) AS df FROM (
       SELECT l_linestatus AS l_shipyear_mode, count(*) FILTER (l_returnflag = 'A') AS n1, count(*) FILTER (l_returnflag = 'R') AS n2,
       avg(l_extendedprice) FILTER (l_returnflag = 'A') AS m1, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m2,
       var_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS v1, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS v2
       FROM lineitem GROUP BY l_linestatus) WHERE n1 > 1 AND n2 > 1""",
    floats=("estimate", "statistic", "df",),
)
def ttest_welch_by_flag(spark, sf):
    out = h.t_two_sample(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R", by=["l_linestatus"])
    return out.filter("n1 > 1 and n2 > 1").select("l_linestatus", "n1", "n2", "estimate", "statistic", "df")


@query(
    "anova_oneway_price",
    """WITH g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1),
       t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mu, sum((n - 1) * v) AS w FROM g)
       SELECT CAST(k - 1 AS DOUBLE) AS df1, CAST(n - k AS DOUBLE) AS df2, (SELECT sum(g.n * power(m - mu, 2)) FROM g) / (k - 1) / (w / (n - k)) AS statistic FROM t""",
    floats=("df1", "df2", "statistic",), rest=False,
)
def anova_oneway_price(spark, sf):
    return h.anova(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority").select("df1", "df2", "statistic")


@query(
    "anova_welch_price",
    """WITH g AS (SELECT count(*) AS n, avg(o_totalprice) AS m, count(*) / var_samp(o_totalprice) AS w FROM orders GROUP BY o_orderpriority),
       t AS (SELECT count(*) AS k, sum(w) AS sw, sum(w * m) / sum(w) AS c FROM g),
       u AS (SELECT k, sum(w * power(m - c, 2)) AS q, sum(power(1 - w / sw, 2) / (n - 1)) / (k * k - 1) AS tmp FROM g, t GROUP BY k)
       SELECT CAST(k - 1 AS DOUBLE) AS df1, 1 / (3 * tmp) AS df2, q / (k - 1) / (1 + 2 * (k - 2) * tmp) AS statistic FROM u""",
    floats=("df1", "df2", "statistic",), rest=False,
)
def anova_welch_price(spark, sf):
    return h.welch_anova(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority").select("df1", "df2", "statistic")


@query(
    "bartlett_acctbal",
    """WITH g AS (SELECT count(*) - 1 AS d, var_samp(c_acctbal) AS v FROM customer GROUP BY c_mktsegment)
       SELECT CAST(count(*) - 1 AS DOUBLE) AS df, (sum(d) * ln(sum(d * v) / sum(d)) - sum(d * ln(v))) / (1 + (sum(1.0 / d) - 1.0 / sum(d)) / (3.0 * (count(*) - 1))) AS statistic FROM g""",
    floats=("df", "statistic",), rest=False,
)
def bartlett_acctbal(spark, sf):
    return h.bartlett(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment").select("df", "statistic")


@query(
    "variance_ratio_price",
    """SELECT l_linestatus, var_samp(l_extendedprice) FILTER (l_returnflag = 'A') / var_samp(l_extendedprice) FILTER (l_returnflag = 'N') AS statistic
       FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'A') > 1 AND count(*) FILTER (l_returnflag = 'N') > 1""",
    floats=("statistic",),
)
def variance_ratio_price(spark, sf):
    out = h.variance_ratio(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "A", "N", by=["l_linestatus"])
    return out.filter("n1 > 1 and n2 > 1").select("l_linestatus", "statistic")


@query(
    "ttest_one_sample_discount",
    """SELECT l_returnflag, (avg(l_discount) - 0.05) / sqrt(var_samp(l_discount) / count(*)) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS df FROM lineitem GROUP BY 1""",
    floats=("statistic", "df",),
)
def ttest_one_sample_discount(spark, sf):
    return h.t_one_sample(table(spark, sf, "lineitem"), "l_discount", 0.05, by=["l_returnflag"]).select("l_returnflag", "statistic", "df")


@query(
    "ttest_paired_rates",
    """SELECT l_returnflag, avg(l_discount - l_tax) / sqrt(var_samp(l_discount - l_tax) / count(*)) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS df FROM lineitem GROUP BY 1""",
    floats=("statistic", "df",),
)
def ttest_paired_rates(spark, sf):
    return h.t_paired(table(spark, sf, "lineitem"), "l_discount", "l_tax", by=["l_returnflag"]).select("l_returnflag", "statistic", "df")


@query(
    "chisq_independence_flag_status",
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2),
       r AS (SELECT a, sum(o) AS r FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS k FROM c GROUP BY 1), n AS (SELECT sum(o) AS n FROM c)
       SELECT sum(power(coalesce(o, 0) - r * k / n, 2) / (r * k / n)) AS statistic, CAST((count(DISTINCT r.a) - 1) * (count(DISTINCT k.b) - 1) AS DOUBLE) AS df
       FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c ON c.a = r.a AND c.b = k.b""",
    floats=("statistic", "df",), rest=False,
)
def chisq_independence_flag_status(spark, sf):
    return h.chi2_independence(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select("statistic", "df")


@query(
    "chisq_goodness_segments",
    """WITH c AS (SELECT count(*) AS o FROM customer GROUP BY c_mktsegment), n AS (SELECT sum(o) / count(*) AS e FROM c)
       SELECT sum(power(o - e, 2) / e) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS df FROM c, n""",
    floats=("statistic", "df",), rest=False,
)
def chisq_goodness_segments(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("o")).withColumn("e", F.lit(1.0))
    return h.chi2_goodness(c, "o", "e").select("statistic", "df")


_FLAGS = "l_quantity > 25 AS x, l_discount > 0.05 AS y"


@query(
    "cmh_2x2xk",
    f"""WITH t AS (SELECT s, count(*) FILTER (x AND y) AS a, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c, count(*) FILTER (NOT x AND NOT y) AS d, count(*) AS n
        FROM (SELECT l_linenumber AS s, {_FLAGS} FROM lineitem) GROUP BY s HAVING count(*) > 1),
        u AS (SELECT sum(a - (a + b) * (a + c) / n) AS delta, sum((a + b) * (c + d) / n * ((a + c) / n) * ((b + d) / (n - 1))) AS v, sum(a * d / n) / sum(b * c / n) AS odds_ratio, count(*) AS strata
        FROM (SELECT s, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d, n::DOUBLE AS n FROM t))
        SELECT power(abs(delta) - CASE WHEN abs(delta) >= 0.5 THEN 0.5 ELSE 0 END, 2) / v AS statistic, odds_ratio, strata FROM u""",
    floats=("statistic", "odds_ratio",),
)
def cmh_2x2xk(spark, sf):
    return h.cmh(table(spark, sf, "lineitem"), F.col("l_quantity") > 25, F.col("l_discount") > 0.05, "l_linenumber").select("statistic", "odds_ratio", "strata")


@query(
    "mcnemar_flags",
    f"""SELECT l_returnflag, power(abs(b - c) - CASE WHEN b <> c THEN 1 ELSE 0 END, 2) / (b + c) AS statistic FROM (
        SELECT l_returnflag, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c FROM (SELECT l_returnflag, {_FLAGS} FROM lineitem) GROUP BY 1)""",
    floats=("statistic",),
)
def mcnemar_flags(spark, sf):
    return h.mcnemar(table(spark, sf, "lineitem"), F.col("l_quantity") > 25, F.col("l_discount") > 0.05, by=["l_returnflag"]).select("l_returnflag", "statistic")


@query(
    "proportion_two_groups",
    """WITH g AS (SELECT l_linestatus AS g, count(*) FILTER (l_discount > 0.05)::DOUBLE AS x, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
       s AS (SELECT sum(x) / sum(n) AS p, sum(1 / n) AS inv, max(x / n) - min(x / n) AS delta, count(*) AS k FROM g)
       SELECT sum(power(abs(x - n * p) - y, 2) / (n * p) + power(abs((n - x) - n * (1 - p)) - y, 2) / (n * (1 - p))) AS statistic FROM g, (SELECT p, least(0.5, delta / inv) AS y FROM s)""",
    floats=("statistic",), rest=False,
)
def proportion_two_groups(spark, sf):
    return h.proportion(table(spark, sf, "lineitem"), F.col("l_discount") > 0.05, "l_linestatus").select("statistic")


@query(
    "proportion_difference",
    """WITH g AS (SELECT l_linestatus AS g, count(*)::DOUBLE AS n, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END)::DOUBLE AS p FROM lineitem GROUP BY 1),
        d AS (SELECT a.p - b.p AS d, a.p * (1 - a.p) / a.n + b.p * (1 - b.p) / b.n AS v, 1 / a.n + 1 / b.n AS inv FROM g a JOIN g b ON a.g < b.g),
        h AS (SELECT d, 1.959963984540054 * sqrt(v) + least(0.5, abs(d) / inv) * inv AS half FROM d)
        SELECT d AS difference, greatest(-1, d - half) AS ci_low, least(1, d + half) AS ci_high FROM h""",
    floats=("difference", "ci_low", "ci_high"), rest=False,
)
def proportion_difference(spark, sf):
    return h.proportion(table(spark, sf, "lineitem"), F.col("l_discount") > 0.05, "l_linestatus").select("difference", "ci_low", "ci_high")


@query(
    "proportion_trend",
    """WITH g AS (SELECT l_linenumber AS s, count(*) FILTER (l_discount > 0.05)::DOUBLE AS x, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
       t AS (SELECT sum(x) / sum(n) AS p, sum(s * n) / sum(n) AS sbar FROM g)
       SELECT power(sum((s - sbar) * (x - n * p)), 2) / (any_value(p) * (1 - any_value(p)) * sum(n * power(s - sbar, 2))) AS statistic FROM g, t""",
    floats=("statistic",), rest=False,
)
def proportion_trend(spark, sf):
    return h.proportion_trend(table(spark, sf, "lineitem"), F.col("l_discount") > 0.05, "l_linenumber").select("statistic")


@query(
    "wilcoxon_rank_sum",
    f"""WITH r AS (SELECT event_type AS g, value AS v, {_rank("value")} AS r, count(*) OVER (PARTITION BY value) AS t FROM events WHERE event_type IN ('click', 'view')),
        s AS (SELECT count(*) FILTER (g = 'click') AS n1, count(*) FILTER (g = 'view') AS n2, sum(r) FILTER (g = 'click') AS rs, sum(t * t - 1.0) AS ties FROM r)
        SELECT rs - n1 * (n1 + 1) / 2.0 AS statistic, n1::DOUBLE AS n1, n2::DOUBLE AS n2, (c - sign(c) * 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z
        FROM (SELECT *, rs - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0 AS c FROM s)""",
    floats=("statistic", "n1", "n2", "z",), rest=False,
)
def wilcoxon_rank_sum(spark, sf):
    return h.rank_sum(table(spark, sf, "events"), "value", "event_type", "click", "view").select("statistic", "n1", "n2", "z")


@query(
    "wilcoxon_signed_rank",
    f"""WITH d AS (SELECT l_returnflag AS f, round(l_discount - l_tax, 2) AS d FROM lineitem WHERE round(l_discount - l_tax, 2) <> 0),
        r AS (SELECT f, d, {_rank("abs(d)", "f")} AS r FROM d)
        SELECT f AS l_returnflag, count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS statistic FROM r GROUP BY f""",
    floats=("n", "statistic",),
)
def wilcoxon_signed_rank(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("d", F.round(F.col("l_discount") - F.col("l_tax"), 2))
    return h.signed_rank(d, "d", by=["l_returnflag"]).select("l_returnflag", "n", "statistic")


@query(
    "kruskal_wallis",
    f"""WITH r AS (SELECT o_orderpriority AS g, {_rank("o_totalprice")} AS r, count(*) OVER (PARTITION BY o_totalprice) AS t FROM orders),
        s AS (SELECT sum(r) AS rs, count(*) AS m, sum(t * t - 1.0) AS ties FROM r GROUP BY g), u AS (SELECT sum(rs * rs / m) AS q, sum(m)::DOUBLE AS n, sum(ties) AS ties, count(*) AS k FROM s)
        SELECT (12 * q / (n * (n + 1)) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS statistic, CAST(k - 1 AS DOUBLE) AS df FROM u""",
    floats=("statistic", "df",), rest=False,
)
def kruskal_wallis(spark, sf):
    return h.kruskal_wallis(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority").select("statistic", "df")


_BLOCKS = """SELECT o_orderpriority AS b, l_returnflag AS t, avg(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""


def _blocks(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("o_orderpriority").alias("b"), F.col("l_returnflag").alias("t")).agg(F.avg("l_quantity").alias("v"))


@query(
    "friedman_blocks",
    f"""WITH r AS (SELECT b, t, {_rank("v", "b")} AS r FROM ({_BLOCKS})), s AS (SELECT sum(r) AS rs, count(*) AS b FROM r GROUP BY t)
        SELECT 12 * sum(power(rs - b * (k + 1) / 2.0, 2)) / (any_value(b) * k * (k + 1)) AS statistic, CAST(k - 1 AS DOUBLE) AS df FROM s, (SELECT count(*) AS k FROM s) GROUP BY k""",
    floats=("statistic", "df",), rest=False,
)
def friedman_blocks(spark, sf):
    return h.friedman(_blocks(spark, sf), "v", "t", "b").select("statistic", "df")


@query(
    "quade_blocks",
    f"""WITH x AS ({_BLOCKS}), r AS (SELECT b, t, {_rank("v", "b")} AS r FROM x), q AS (SELECT b, {_rank("range")} AS q FROM (SELECT b, max(v) - min(v) AS range FROM x GROUP BY b)),
        n AS (SELECT count(DISTINCT b)::DOUBLE AS nb, count(DISTINCT t)::DOUBLE AS k FROM x), s AS (SELECT t, q * (r - (k + 1) / 2) AS s, nb, k FROM r JOIN q USING (b), n),
        a AS (SELECT sum(s * s) AS a FROM s), bb AS (SELECT sum(st * st) / any_value(nb) AS bb, any_value(nb) AS nb, any_value(k) AS k FROM (SELECT t, sum(s) AS st, any_value(nb) AS nb, any_value(k) AS k FROM s GROUP BY t))
        SELECT (nb - 1) * bb / (a - bb) AS statistic, k - 1 AS df1, (nb - 1) * (k - 1) AS df2 FROM a, bb""",
    floats=("statistic", "df1", "df2",), rest=False,
)
def quade_blocks(spark, sf):
    return h.quade(_blocks(spark, sf), "v", "t", "b").select("statistic", "df1", "df2")


@query(
    "spearman_by_brand",
    f"""WITH r AS (SELECT p_brand, {_rank("l_quantity", "p_brand")} AS a, {_rank("l_extendedprice", "p_brand")} AS b FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT p_brand, count(*)::DOUBLE AS n, corr(a, b) AS estimate FROM r GROUP BY 1""",
    floats=("n", "estimate",),
)
def spearman_by_brand(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return h.spearman(j, "l_quantity", "l_extendedprice", by=["p_brand"]).select("p_brand", "n", "estimate")


@query(
    "pearson_fisher_z",
    """SELECT l_returnflag, r AS estimate, r * sqrt(n - 2) / sqrt(1 - r * r) AS statistic, tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)) AS ci_low, tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)) AS ci_high
       FROM (SELECT l_returnflag, count(*)::DOUBLE AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1)""",
    floats=("estimate", "statistic", "ci_low", "ci_high",),
)
def pearson_fisher_z(spark, sf):
    return h.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", by=["l_returnflag"]).select("l_returnflag", "estimate", "statistic", "ci_low", "ci_high")


@query(
    "kendall_by_type",
    """WITH a AS (SELECT * FROM (SELECT event_type AS g, value AS x, user_id AS y, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events)),
       p AS (SELECT a.g, sign(a.x - b.x) * sign(a.y - b.y) AS s, CASE WHEN a.x = b.x THEN 1 ELSE 0 END AS tx, CASE WHEN a.y = b.y THEN 1 ELSE 0 END AS ty FROM a JOIN a b ON a.g = b.g AND a.i < b.i)
       SELECT g AS event_type, sum(s) / sqrt((count(*) - sum(tx)) * (count(*) - sum(ty))::DOUBLE) AS estimate FROM p GROUP BY g""",
    floats=("estimate",),
)
def kendall_by_type(spark, sf):
    return h.kendall(table(spark, sf, "events").withColumn("u", F.col("user_id").cast("double")), "value", "u", by=["event_type"]).select("event_type", "estimate")


@query(
    "ks_two_sample",
    """WITH c AS (SELECT value AS v, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY 1),
       u AS (SELECT sum(a) OVER w / (SELECT sum(a) FROM c)::DOUBLE AS fa, sum(b) OVER w / (SELECT sum(b) FROM c)::DOUBLE AS fb FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))
       SELECT max(abs(fa - fb)) AS statistic FROM u""",
    floats=("statistic",), rest=False,
)
def ks_two_sample(spark, sf):
    return h.ks_two_sample(table(spark, sf, "events"), "value", "event_type", "click", "view").select("statistic")


@query(
    "ansari_bradley",
    f"""WITH r AS (SELECT event_type AS g, {_rank("value")} AS r, count(*) OVER () AS n FROM events WHERE event_type IN ('click', 'view'))
        SELECT sum(least(r, n + 1 - r)) AS statistic, count(*)::DOUBLE AS m, any_value(n)::DOUBLE AS n FROM r WHERE g = 'click'""",
    floats=("statistic", "m", "n",), rest=False,
)
def ansari_bradley(spark, sf):
    return h.ansari_bradley(table(spark, sf, "events"), "value", "event_type", "click", "view").select("statistic", "m", "n")


@query(
    "mood_scale",
    f"""WITH r AS (SELECT event_type AS g, {_rank("value")} AS r, count(*) OVER () AS n FROM events WHERE event_type IN ('click', 'view'))
        SELECT sum(power(r - (n + 1) / 2.0, 2)) AS statistic, (sum(power(r - (n + 1) / 2.0, 2)) - count(*) * (any_value(n) * any_value(n) - 1) / 12.0) /
        sqrt(count(*) * (any_value(n) - count(*)) * (any_value(n) + 1.0) * (any_value(n) + 2) * (any_value(n) - 2) / 180) AS z FROM r WHERE g = 'click'""",
    floats=("statistic", "z",), rest=False,
)
def mood_scale(spark, sf):
    return h.mood(table(spark, sf, "events"), "value", "event_type", "click", "view").select("statistic", "z")


# how many subsets of the ranks 1..k have m members and the sum s
_SUBSETS = """u AS (SELECT 0 AS k, 0 AS m, 0 AS s, 1.0::DOUBLE AS c, (SELECT max(n) FROM t WHERE exact)::BIGINT AS top
    UNION ALL SELECT k + 1, m + x, s + x * (k + 1), sum(c), any_value(top) FROM u, (VALUES (0), (1)) b(x) WHERE k < top GROUP BY ALL)"""
_TAIL = "least(1, 2 * least(sum(c) FILTER (s <= v), sum(c) FILTER (s >= v)) / sum(c)) AS p_value"


@query(
    "signed_rank_exact_by_nation",
    f"""WITH RECURSIVE r AS (SELECT s_nationkey AS f, s_acctbal AS d, {_rank("abs(s_acctbal)", "s_nationkey")} AS r FROM supplier WHERE s_acctbal <> 0),
        t AS (SELECT f, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS v, count(*) < 50 AND count(*) = count(DISTINCT abs(d)) AND f NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal = 0) AS exact FROM r GROUP BY f),
        {_SUBSETS}, p AS (SELECT f, {_TAIL} FROM t JOIN u ON u.k = t.n WHERE exact GROUP BY f, v)
        SELECT f AS s_nationkey, n::DOUBLE AS n, v AS statistic, p_value FROM t LEFT JOIN p USING (f)""",
    floats=("n", "statistic", "p_value",),
)
def signed_rank_exact_by_nation(spark, sf):
    """All nations; the p-value where the exact rule holds (small, without ties and zeros)."""
    s = table(spark, sf, "supplier")
    a = F.abs("s_acctbal")
    rule = s.groupBy("s_nationkey").agg(((F.count(F.lit(1)) < 50) & (F.count(F.lit(1)) == F.countDistinct(a)) & (F.min(a) > 0)).alias("exact"))
    return h.signed_rank(s, "s_acctbal", by=["s_nationkey"]).join(rule, "s_nationkey").select("s_nationkey", "n", "statistic", F.when(F.col("exact"), F.col("p_value")).alias("p_value"))


@query(
    "rank_sum_exact_by_nation",
    f"""WITH RECURSIVE r AS (SELECT s_nationkey AS f, s_acctbal AS d, s_suppkey % 2 = 0 AS even, {_rank("s_acctbal", "s_nationkey")} AS r FROM supplier),
        t AS (SELECT f, count(*) AS n, count(*) FILTER (even) AS m, sum(r) FILTER (even) AS v, count(*) < 50 AND count(*) = count(DISTINCT d) AND count(DISTINCT even) = 2 AS exact FROM r GROUP BY f),
        {_SUBSETS}, p AS (SELECT f, {_TAIL} FROM t JOIN u ON u.k = t.n AND u.m = t.m WHERE exact GROUP BY f, v)
        SELECT f AS s_nationkey, m::DOUBLE AS n1, (n - m)::DOUBLE AS n2, v - m * (m + 1) / 2 AS statistic, p_value FROM t LEFT JOIN p USING (f)""",
    floats=("n1", "n2", "statistic", "p_value",),
)
def rank_sum_exact_by_nation(spark, sf):
    """All nations, suppliers of even against those of odd number; the p-value where the exact rule holds (small, both sides, without ties)."""
    s = table(spark, sf, "supplier").withColumn("odd", F.col("s_suppkey") % 2)
    rule = s.groupBy("s_nationkey").agg(((F.count(F.lit(1)) < 50) & (F.count(F.lit(1)) == F.countDistinct("s_acctbal")) & (F.countDistinct("odd") == 2)).alias("exact"))
    out = h.rank_sum(s, "s_acctbal", "odd", 0, 1, by=["s_nationkey"]).join(rule, "s_nationkey")
    return out.select("s_nationkey", "n1", "n2", "statistic", F.when(F.col("exact"), F.col("p_value")).alias("p_value"))


@query(
    "ks_one_sample_price",
    """WITH c AS (SELECT l_returnflag, l_extendedprice AS v, count(*) AS k FROM lineitem GROUP BY 1, 2), t AS (SELECT max(l_extendedprice) + 1 AS top FROM lineitem),
       u AS (SELECT l_returnflag, v / top AS f, sum(k) OVER w AS upto, k, sum(k) OVER (PARTITION BY l_returnflag) AS n FROM c, t WINDOW w AS (PARTITION BY l_returnflag ORDER BY v ROWS UNBOUNDED PRECEDING))
       SELECT l_returnflag, any_value(n)::DOUBLE AS n, max(greatest(upto / n - f, f - (upto - k) / n)) AS statistic FROM u GROUP BY 1""",
    floats=("n", "statistic",),
)
def ks_one_sample_price(spark, sf):
    d = table(spark, sf, "lineitem")
    top = d.agg(F.max("l_extendedprice")).collect()[0][0]
    return h.ks_one_sample(d, "l_extendedprice", F.col("l_extendedprice") / F.lit(float(top) + 1), by=["l_returnflag"]).select("l_returnflag", "n", "statistic")


@query(
    "poisson_exact_by_nation",
    """WITH t AS (SELECT s_nationkey, count(*) AS x, 4.5::DOUBLE AS mu FROM supplier GROUP BY 1), p AS (SELECT s_nationkey, x, mu, k, exp(k * ln(mu) - mu - lgamma(k + 1)) AS m FROM (SELECT *, unnest(range(0, 2 * x + 100)) AS k FROM t)),
       o AS (SELECT s_nationkey, m AS own FROM p WHERE k = x)
       SELECT s_nationkey, any_value(x) AS x, any_value(x / mu) AS estimate, least(1, sum(m) FILTER (m <= own * (1 + 1e-7))) AS p_value FROM p JOIN o USING (s_nationkey) GROUP BY 1""",
    floats=("estimate", "p_value",),
)
def poisson_exact_by_nation(spark, sf):
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("c")).withColumn("t", F.lit(4.5))
    return h.poisson_exact(s, "c", "t", 1.0, by=["s_nationkey"]).select("s_nationkey", "x", "estimate", "p_value")


@query("fligner_killeen")
def fligner_killeen(spark, sf):
    return h.fligner_killeen(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")


@query("shapiro_by_user")
def shapiro_by_user(spark, sf):
    return h.shapiro_wilk(table(spark, sf, "events"), "value", by=["user_id"])


@query(
    "binomial_exact_by_flag",
    """SELECT l_returnflag, count(*) FILTER (l_discount > 0.05) AS x, count(*) AS n, count(*) FILTER (l_discount > 0.05) / count(*)::DOUBLE AS estimate FROM lineitem GROUP BY 1""",
    floats=("estimate",),
)
def binomial_exact_by_flag(spark, sf):
    return h.binomial_exact(table(spark, sf, "lineitem"), F.col("l_discount") > 0.05, 0.5, by=["l_returnflag"]).select("l_returnflag", "x", "n", "estimate")


@query(
    "poisson_rates",
    """SELECT l_linestatus, (count(*) FILTER (l_returnflag = 'A') / sum(l_quantity) FILTER (l_returnflag = 'A')) / (count(*) FILTER (l_returnflag = 'N') / sum(l_quantity) FILTER (l_returnflag = 'N')) AS rate_ratio
       FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) FILTER (l_returnflag = 'N') > 0""",
    floats=("rate_ratio",),
)
def poisson_rates(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("one", F.lit(1))
    both = d.groupBy("l_linestatus").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "N").alias("b")).filter("a > 0 and b > 0").select("l_linestatus")
    return h.poisson_rate(d.join(both, "l_linestatus"), "one", "l_quantity", "l_returnflag", "A", "N", by=["l_linestatus"]).select("l_linestatus", "rate_ratio")


@query(
    "fisher_exact_by_flag",
    f"""SELECT l_returnflag, count(*) FILTER (x AND y)::DOUBLE * count(*) FILTER (NOT x AND NOT y) / (count(*) FILTER (x AND NOT y)::DOUBLE * count(*) FILTER (NOT x AND y)) AS odds_ratio
        FROM (SELECT l_returnflag, {_FLAGS} FROM lineitem) GROUP BY 1""",
    floats=("odds_ratio",),
)
def fisher_exact_by_flag(spark, sf):
    return h.fisher_2x2(table(spark, sf, "lineitem"), F.col("l_quantity") > 25, F.col("l_discount") > 0.05, by=["l_returnflag"]).select("l_returnflag", "odds_ratio")


@query(
    "effect_sizes_md_g",
    """SELECT l_linenumber, m1 - m2 AS md, v1 / n1 + v2 / n2 AS md_var, (1 - 3.0 / (4 * (n1 + n2 - 2) - 1)) * (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS g FROM (
       SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A') AS n1, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS m1, var_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS v1,
       count(*) FILTER (l_returnflag = 'R') AS n2, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m2, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS v2 FROM lineitem GROUP BY 1)""",
    floats=("md", "md_var", "g",),
)
def effect_sizes_md_g(spark, sf):
    return h.effect_sizes(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R", by=["l_linenumber"]).select("l_linenumber", "md", "md_var", "g")


@query(
    "effect_sizes_or_rr",
    """SELECT l_linenumber, ln(a * d / (b * c)) AS log_or, 1 / a + 1 / b + 1 / c + 1 / d AS log_or_var, ln(a / (a + b) / (c / (c + d))) AS log_rr, 1 / a - 1 / (a + b) + 1 / c - 1 / (c + d) AS log_rr_var FROM (
       SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A' AND l_discount > 0.05)::DOUBLE AS a, count(*) FILTER (l_returnflag = 'A' AND l_discount <= 0.05)::DOUBLE AS b,
       count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.05)::DOUBLE AS c, count(*) FILTER (l_returnflag = 'R' AND l_discount <= 0.05)::DOUBLE AS d FROM lineitem GROUP BY 1)""",
    floats=("log_or", "log_or_var", "log_rr", "log_rr_var",),
)
def effect_sizes_or_rr(spark, sf):
    out = h.ratio_effects(table(spark, sf, "lineitem"), F.col("l_discount") > 0.05, "l_returnflag", "A", "R", by=["l_linenumber"])
    return out.select("l_linenumber", "log_or", "log_or_var", "log_rr", "log_rr_var")


# p-values for the multiplicity queries: a fixed function of the key
_P = "power(((l_orderkey * 7919 + l_linenumber * 104729) % 100003 + 1) / 100004.0, 3)"
_FAMILY = f"SELECT l_orderkey * 10 + l_linenumber AS id, {_P} AS p, l_quantity AS w FROM lineitem"
_BH = "min({v}) OVER (ORDER BY {p} DESC, id DESC ROWS UNBOUNDED PRECEDING)"


def _family(spark, sf):
    p = F.pow(((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 100003 + 1) / F.lit(100004.0), F.lit(3.0))
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), p.alias("p"), F.col("l_quantity").alias("w"))


_RANKED = f"SELECT *, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS m FROM ({_FAMILY})"


@query("bh_adjust", f"SELECT id, p, least(1, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM ({_RANKED})", floats=("p", "q",))
def bh_adjust(spark, sf):
    return mt.bh(_family(spark, sf), "p", "id").select("id", "p", "q")


@query("by_adjust", f"SELECT id, p, least(1, min(p * m / r * h) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM ({_RANKED}), (SELECT sum(1.0::DOUBLE / i) AS h FROM (SELECT row_number() OVER () AS i FROM lineitem))", floats=("p", "q",))
def by_adjust(spark, sf):
    return mt.by_adjust(_family(spark, sf), "p", "id").select("id", "p", "q")


@query(
    "weighted_bh",
    f"""SELECT id, p, least(1, min(wp * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (
        SELECT *, row_number() OVER (ORDER BY wp, id) AS r, count(*) OVER () AS m FROM (SELECT id, p, least(1.0, p * (SELECT avg(w) FROM ({_FAMILY})) / w) AS wp FROM ({_FAMILY})))""",
    floats=("p", "q",),
)
def weighted_bh(spark, sf):
    return mt.weighted_bh(_family(spark, sf), "p", "w", "id").select("id", "p", "q")


@query(
    "bh_by_family",
    f"""SELECT id, f, least(1, min(p * m / r) OVER (PARTITION BY f ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (
        SELECT *, row_number() OVER (PARTITION BY f ORDER BY p, id) AS r, count(*) OVER (PARTITION BY f) AS m FROM (SELECT id, p, id % 10 AS f FROM ({_FAMILY})))""",
    floats=("q",),
)
def bh_by_family(spark, sf):
    return mt.bh(_family(spark, sf).withColumn("f", F.col("id") % 10), "p", "id", by=["f"]).select("id", "f", "q")


@query("ihw_bh")
def ihw_bh(spark, sf):
    return mt.independent_weighting(_family(spark, sf), "p", "w", "id").select("id", "bin", "fold", "weight", "q")


_TREE = """SELECT 'root' AS node, NULL AS parent, 0.001::DOUBLE AS p UNION ALL SELECT 'r' || r_regionkey, 'root', (r_regionkey + 1) / 200.0 FROM region
           UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, (n_nationkey + 1) / 1000.0 FROM nation"""


def _tree(spark, sf):
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    root = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.001).alias("p"))
    r = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit("root").alias("parent"), ((F.col("r_regionkey") + 1) / 200.0).alias("p"))
    n = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), ((F.col("n_nationkey") + 1) / 1000.0).alias("p"))
    return root.unionByName(r).unionByName(n)


@query(
    "hierarchical_bonferroni",
    f"""WITH RECURSIVE t AS ({_TREE}), leaf AS (SELECT node FROM t WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)),
        up AS (SELECT node, node AS here FROM leaf UNION ALL SELECT up.node, t.parent FROM up JOIN t ON up.here = t.node WHERE t.parent IS NOT NULL),
        c AS (SELECT here AS node, count(*) AS leaves FROM up GROUP BY 1), v AS (SELECT t.node, parent, least(1, p * (SELECT count(*) FROM leaf) / leaves) AS v, leaves FROM t JOIN c USING (node)),
        d AS (SELECT node, v AS adjusted FROM v WHERE parent IS NULL UNION ALL SELECT v.node, greatest(v.v, d.adjusted) FROM v JOIN d ON v.parent = d.node)
        SELECT node, leaves, adjusted FROM d JOIN v USING (node)""",
    floats=("adjusted",),
)
def hierarchical_bonferroni(spark, sf):
    return mt.hierarchical_bonferroni(_tree(spark, sf)).select("node", "leaves", "adjusted")

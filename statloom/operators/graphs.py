"""Networks, space and cells: propagation, correlation networks, neighbour graphs, autocorrelation, single-cell summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from statloom.functions import pvalues as pv
from statloom.operators.multiplicity import bh, finite
from statloom.session import materialize


def random_walk(edges: DataFrame, seeds: DataFrame, restart: float = 0.3, tol: float = 1e-10, max_rounds: int = 200, src: str = "source", dst: str = "target", weight: str = "weight") -> DataFrame:
    """Random walk with restart on an undirected weighted graph: (node, score). ``seeds`` has node and optionally weight; one join a round."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), F.col(weight).cast("double").alias("w")).filter("a <> b and w > 0")
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    out = e.groupBy("a").agg(F.sum("w").alias("d"))
    step = materialize(e.join(out, "a").select("a", "b", (F.col("w") / F.col("d")).alias("p")))
    nodes = out.select(F.col("a").alias("node"))
    s = seeds.select("node", (F.col("weight").cast("double") if "weight" in seeds.columns else F.lit(1.0)).alias("s")).join(nodes, "node")
    total = s.agg(F.sum("s")).collect()[0][0]
    if not total:
        raise ValueError("no seed is in the graph")
    start = materialize(nodes.join(s.groupBy("node").agg((F.sum("s") / F.lit(float(total))).alias("s")), "node", "left").select("node", F.coalesce("s", F.lit(0.0)).alias("s")))
    now = start.select("node", "s", F.col("s").alias("score"))
    for _ in range(max_rounds):
        flow = step.join(now.select(F.col("node").alias("a"), "score"), "a").groupBy(F.col("b").alias("node")).agg(F.sum(F.col("p") * F.col("score")).alias("flow"))
        new = now.join(flow, "node", "left").select("node", "s", (F.lit(restart) * F.col("s") + F.lit(1 - restart) * F.coalesce("flow", F.lit(0.0))).alias("score"), F.col("score").alias("old"))
        new = materialize(new)
        moved = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).collect()[0][0]
        now = new.select("node", "s", "score")
        if moved < tol:
            break
    return now.select("node", "score")


def correlation_pairs(df: DataFrame, sample: str, feature: str, value: str) -> DataFrame:
    """Pearson's r of every two features over shared samples: (a, b, r, n) with a < b; features meet through a join on the sample."""
    x = df.select(F.col(sample).alias("s"), F.col(feature).alias("a"), finite(value).alias("x")).dropna()
    return x.join(x.select("s", F.col("a").alias("b"), F.col("x").alias("y")), "s").filter("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))


def differential_correlation(df: DataFrame, sample: str, feature: str, value: str, group: str, first, second) -> DataFrame:
    """Fisher's z of the difference of two groups' correlations, adjusted over all pairs."""
    one = correlation_pairs(df.filter(F.col(group) == F.lit(first)), sample, feature, value).select("a", "b", F.col("r").alias("r1"), F.col("n").alias("n1"))
    two = correlation_pairs(df.filter(F.col(group) == F.lit(second)), sample, feature, value).select("a", "b", F.col("r").alias("r2"), F.col("n").alias("n2"))
    safe = lambda c: F.atanh(F.greatest(F.lit(-1 + 1e-15), F.least(F.lit(1 - 1e-15), F.col(c))))
    j = one.join(two, ["a", "b"]).filter("n1 > 3 and n2 > 3").withColumn("statistic", (safe("r1") - safe("r2")) / F.sqrt(1 / (F.col("n1") - 3) + 1 / (F.col("n2") - 3)))
    j = j.withColumn("p_value", pv.p_normal(F.col("statistic"))).withColumn("pair", F.concat_ws("\t", "a", "b"))
    return bh(j, "p_value", "pair", "q").drop("pair")


# -- space ----------------------------------------------------------------------------------------------------------------------------


def radius_edges(points: DataFrame, radius: float, node: str = "node", x: str = "x", y: str = "y", compartment: str | None = None) -> DataFrame:
    """(source, target, distance), source < target, of points within ``radius`` and one compartment: candidates share or adjoin a grid cell."""
    keys = [compartment] if compartment else []
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius))).cast("long")
    a = points.select(*keys, F.col(node).alias("source"), F.col(x).alias("xa"), F.col(y).alias("ya"), cell(x).alias("i0"), cell(y).alias("j0"))
    a = a.withColumn("i", F.explode(F.sequence(F.col("i0") - 1, F.col("i0") + 1))).withColumn("j", F.explode(F.sequence(F.col("j0") - 1, F.col("j0") + 1))).drop("i0", "j0")
    b = points.select(*keys, F.col(node).alias("target"), F.col(x).alias("xb"), F.col(y).alias("yb"), cell(x).alias("i"), cell(y).alias("j"))
    d = F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))
    return a.join(b, [*keys, "i", "j"]).filter("source < target").withColumn("distance", d).filter(F.col("distance") <= radius).select(*keys, "source", "target", "distance")


def knn_edges(points: DataFrame, k: int, radius: float, node: str = "node", x: str = "x", y: str = "y", compartment: str | None = None) -> DataFrame:
    """Each point's k nearest by (distance, node) within ``radius``, made symmetric by union."""
    keys = [compartment] if compartment else []
    e = radius_edges(points, radius, node, x, y, compartment)
    both = e.unionByName(e.select(*keys, F.col("target").alias("source"), F.col("source").alias("target"), "distance"))
    near = both.withColumn("_k", F.row_number().over(W.partitionBy(*keys, "source").orderBy("distance", "target"))).filter(F.col("_k") <= k)
    return near.select(*keys, F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "distance").distinct()


def autocorrelation(edges: DataFrame, values: DataFrame, node: str = "node", feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Moran's I and Geary's C of each feature over undirected unweighted edges."""
    v = values.select(F.col(node).alias("n"), F.col(feature).alias("f"), finite(value).alias("v"))
    m = v.groupBy("f").agg(F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("ss"), F.count("v").cast("double").alias("n_nodes"))
    a = edges.select(F.col("source").alias("n"), "target").join(v, "n").select(F.col("target").alias("n"), "f", F.col("v").alias("va"))
    pairs = a.join(v, ["n", "f"]).join(F.broadcast(m.select("f", "mean")), "f")
    s = pairs.groupBy("f").agg(F.count(F.lit(1)).cast("double").alias("edges"), F.sum((F.col("va") - F.col("mean")) * (F.col("v") - F.col("mean"))).alias("cross"), F.sum((F.col("va") - F.col("v")) * (F.col("va") - F.col("v"))).alias("square"))
    j = s.join(m, "f")
    return j.select(F.col("f").alias(feature), "edges", F.try_divide(F.col("n_nodes") * F.col("cross"), F.col("edges") * F.col("ss")).alias("moran_i"), F.try_divide((F.col("n_nodes") - 1) * F.col("square"), 2 * F.col("edges") * F.col("ss")).alias("geary_c"))


#: Edges that a permutation test takes at most; beyond, it raises.
MOST_EDGES = 5_000_000


def moran_permutation(edges: DataFrame, values: DataFrame, permutations: int = 999, seed: int = 7, node: str = "node", feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Upper-tail permutation p (x + 1) / (B + 1) of Moran's I; features are distributed, the edge list is sent to each task.

    A permutation needs every edge, so the list is broadcast; more than ``MOST_EDGES`` are refused.
    """
    ids = edges.select("source", "target").limit(MOST_EDGES + 1).toPandas()
    if len(ids) > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges")
    shared = edges.sparkSession.sparkContext.broadcast((ids["source"].to_numpy(), ids["target"].to_numpy()))
    kind = dict(values.dtypes)[feature]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = pd.Index(pdf[node])
        e = np.stack([place.get_indexer(end) for end in shared.value], 1)
        e = e[(e >= 0).all(1)]
        v = pdf[value].to_numpy(float)
        v = v - v.mean()
        rng = np.random.default_rng([seed, abs(hash(str(pdf[feature].iloc[0]))) % (1 << 32)])
        stat = lambda u: float((u[e[:, 0]] * u[e[:, 1]]).sum())
        own = stat(v)
        over = sum(stat(rng.permutation(v)) >= own for _ in range(permutations))
        return pd.DataFrame({feature: [pdf[feature].iloc[0]], "moran_i": [len(v) * own / (len(e) * (v * v).sum())], "p_value": [(over + 1) / (permutations + 1)]})

    return values.groupBy(feature).applyInPandas(run, f"`{feature}` {kind}, moran_i double, p_value double")


def neighborhood_pairs(edges: DataFrame, labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """Edges by unordered pair of labels, with the count expected from label shares."""
    a = labels.select(F.col(node).alias("source"), F.col(label).alias("la"))
    b = labels.select(F.col(node).alias("target"), F.col(label).alias("lb"))
    j = edges.select("source", "target").join(a, "source").join(b, "target")
    c = j.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.count(F.lit(1)).alias("edges"))
    n = labels.groupBy(F.col(label).alias("l")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = j.count()
    size = n.agg(F.sum("n")).collect()[0][0] or 1.0
    c = c.join(F.broadcast(n.select(F.col("l").alias("a"), F.col("n").alias("na"))), "a").join(F.broadcast(n.select(F.col("l").alias("b"), F.col("n").alias("nb"))), "b")
    pairs = F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    return c.withColumn("expected", pairs / F.lit(size * (size - 1) / 2) * F.lit(float(total))).select("a", "b", "edges", "expected")


# -- cells --------------------------------------------------------------------------------------------------------------------------------


def cell_qc(counts: DataFrame, mitochondrial: DataFrame | None = None, min_library: int = 500, min_features: int = 200, max_mito: float = 0.2, cells: DataFrame | None = None) -> DataFrame:
    """Library, features and mitochondrial share by cell, with the reasons that exclude it. ``cells`` adds those without any count."""
    c = counts.filter("count > 0")
    if mitochondrial is not None:
        c = c.join(F.broadcast(mitochondrial.select("feature_id").withColumn("_mt", F.lit(True))), "feature_id", "left")
    else:
        c = c.withColumn("_mt", F.lit(None).cast("boolean"))
    s = c.groupBy("obs_id").agg(F.sum("count").alias("library"), F.count(F.lit(1)).alias("features"), F.sum(F.when(F.col("_mt"), F.col("count")).otherwise(0)).alias("mito"))
    if cells is not None:
        s = cells.select("obs_id").join(s, "obs_id", "left").fillna(0, ["library", "features", "mito"])
    share = F.coalesce(F.try_divide(F.col("mito"), F.col("library")), F.lit(0.0))
    zero = F.col("library") == 0
    checks = [F.when(zero, F.lit("zero_library")), F.when(~zero & (F.col("library") < min_library), F.lit("low_library")), F.when(F.col("features") < min_features, F.lit("low_features")), F.when(share > max_mito, F.lit("high_mitochondrial"))]
    return s.withColumn("mito_share", share).withColumn("reasons", F.array_compact(F.array(*checks))).drop("mito")


def pseudobulk(counts: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    return counts.join(cells.select("obs_id", *by), "obs_id").groupBy(*by, "feature_id").agg(F.sum("count").alias("count"))


def relative_abundance(cells: DataFrame, sample: str, label: str) -> DataFrame:
    """asin sqrt(k / n) of every label in every sample, zeros included."""
    k = cells.groupBy(sample, label).agg(F.count(F.lit(1)).alias("k"))
    n = cells.groupBy(sample).agg(F.count(F.lit(1)).alias("n"))
    every = n.crossJoin(F.broadcast(cells.select(label).distinct()))  # samples times labels is the size of the result
    return every.join(k, [sample, label], "left").select(sample, label, F.coalesce("k", F.lit(0)).alias("k"), "n").withColumn("value", F.asin(F.sqrt(F.col("k") / F.col("n"))))


def pathway_score(counts: DataFrame, sets: DataFrame, minimum: int = 2, unit: str = "obs_id") -> DataFrame:
    """Mean log2 counts per million (with half a count added) over a set's measured members; absent counts are zeros."""
    lib = counts.groupBy(unit).agg(F.sum("count").alias("lib"))
    measured = counts.select("feature_id").distinct()
    members = sets.join(measured, sets["gene"] == measured["feature_id"], "left_semi").select("set_id", F.col("gene").alias("feature_id")).distinct()
    size = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= minimum)
    present = counts.join(members, "feature_id").join(lib, unit).groupBy(unit, "set_id").agg(F.sum(F.log2((F.col("count") + 0.5) * 1e6 / (F.col("lib") + 1))).alias("s"), F.count(F.lit(1)).alias("k"))
    every = lib.crossJoin(F.broadcast(size))  # units times sets is the size of the result
    out = every.join(present, [unit, "set_id"], "left")
    zero = F.log2(F.lit(0.5) * 1e6 / (F.col("lib") + 1))
    return out.select(unit, "set_id", "members", ((F.coalesce("s", F.lit(0.0)) + (F.col("members") - F.coalesce("k", F.lit(0))) * zero) / F.col("members")).alias("score"))


# -- enrichment --------------------------------------------------------------------------------------------------------------------------


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", max_depth: int = 1000) -> DataFrame:
    """All (node, ancestor) pairs of an acyclic graph, by doubling: as many rounds as the logarithm of its depth. A cycle is an error."""
    reach = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).distinct()
    n = -1
    for _ in range(max(2, int(np.ceil(np.log2(max_depth))) + 1)):
        further = reach.alias("a").join(reach.alias("b"), F.col("a.ancestor") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"))
        reach = materialize(reach.unionByName(further).distinct())
        m = reach.count()
        if m == n:
            break
        n = m
    if reach.filter("node = ancestor").limit(1).count():
        raise ValueError("the graph has a cycle")
    return reach


def propagate(genes: DataFrame, edges: DataFrame, obsolete: DataFrame | None = None) -> DataFrame:
    """Gene annotations (set_id, gene) carried to every ancestor that is not obsolete."""
    up = genes.join(closure(edges).withColumnRenamed("node", "set_id"), "set_id").select(F.col("ancestor").alias("set_id"), "gene")
    out = genes.select("set_id", "gene").unionByName(up).distinct()
    return out if obsolete is None else out.join(obsolete.select(F.col("id").alias("set_id")), "set_id", "left_anti")


def over_representation(sets: DataFrame, universe: DataFrame, selected: Column, gene: str = "gene", min_size: int = 1, max_size: int = 10**9) -> DataFrame:
    """Hypergeometric upper tail of selected genes in each set, with expected count, odds ratio, fold and adjusted p."""
    u = universe.select(F.col(gene).alias("gene"), selected.alias("sel")).groupBy("gene").agg(F.max("sel").alias("sel"))
    t = u.agg(F.count(F.lit(1)).alias("n"), F.count_if("sel").alias("k")).collect()[0]
    n, k = t["n"], t["k"]
    s = sets.select("set_id", "gene").distinct().join(u, "gene").groupBy("set_id").agg(F.count(F.lit(1)).alias("size"), F.count_if("sel").alias("overlap")).filter(F.col("size").between(min_size, max_size))
    a, b, c = F.col("overlap"), F.lit(k) - F.col("overlap"), F.col("size") - F.col("overlap")
    d = F.lit(n) - F.col("size") - b
    s = s.withColumn("expected", F.col("size") * F.lit(k / n if n else 0.0)).withColumn("odds_ratio", F.try_divide(a * d, b * c)).withColumn("fold", F.try_divide(F.col("overlap"), F.col("expected")))
    s = s.withColumn("p_value", pv.p_hypergeom(F.col("overlap"), F.col("size"), F.lit(n) - F.col("size"), F.lit(k)))
    return bh(s, "p_value", "set_id", "q")


#: Genes of one platform are a bounded table; the trend over them is smoothed on the driver.
MAX_GENES = 500_000


def tricube_trend(selected: np.ndarray) -> np.ndarray:
    """Moving average over ranks with a tricube kernel that spans half of them, renormalised at the ends."""
    n = len(selected)
    half = n // 4
    if 2 * half + 1 > n:
        half -= 1
    if half <= 0:
        return selected.astype(float)
    width = 2 * half + 1
    d = np.abs(np.arange(-half, half + 1)) / half * width / (width + 1.0)
    kernel = (1 - d**3) ** 3
    return np.convolve(selected, kernel, "same") / np.convolve(np.ones(n), kernel, "same")


def probe_enrichment(sets: DataFrame, probes: DataFrame, selected: Column, separator: str = ";") -> DataFrame:
    """Over-representation corrected for probes per gene: probes that name several genes count in fractions, selection odds come from a trend
    over genes ranked by probes, and the tail is Wallenius' at the set's odds.

    ``probes`` has probe and genes (joined by ``separator``). Columns: size, hits, weighted (fractional hits), odds, p_value, q.
    """
    from statloom.functions import special as sp

    named = F.array_distinct(F.filter(F.transform(F.split("genes", separator), lambda g: F.trim(g)), lambda g: g != ""))
    p = probes.select("probe", named.alias("g"), F.coalesce(selected, F.lit(False)).alias("sel")).filter(F.size("g") > 0)
    long = p.select(F.explode("g").alias("gene"), (1 / F.size("g")).alias("w"), "sel")
    genes = long.groupBy("gene").agg(F.sum("w").alias("probes"), F.sum(F.when(F.col("sel"), F.col("w")).otherwise(0.0)).alias("hit"))
    table = genes.limit(MAX_GENES + 1).toPandas()
    if len(table) > MAX_GENES:
        raise ValueError(f"more than {MAX_GENES} genes")
    table["probes"] = table["probes"].round(12)
    table = table.sort_values(["probes", "gene"], kind="stable").reset_index(drop=True)
    chosen = (table["hit"] > 1e-12).to_numpy(float)
    table["chance"], table["sel"], table["w"] = tricube_trend(chosen), chosen > 0, np.minimum(1.0, table["hit"].round(12))
    universe = probes.sparkSession.createDataFrame(table[["gene", "chance", "sel", "w"]], "gene string, chance double, sel boolean, w double")
    n, k, total = len(table), int(chosen.sum()), float(table["chance"].sum())
    s = sets.select("set_id", "gene").distinct().join(universe, "gene").groupBy("set_id").agg(F.count(F.lit(1)).alias("size"), F.count_if("sel").alias("hits"), F.sum("w").alias("weighted"), F.sum("chance").alias("_in"))
    inside, outside = F.col("_in") / F.col("size"), F.try_divide(F.lit(total) - F.col("_in"), F.lit(n) - F.col("size"))
    s = s.withColumn("weighted", F.round("weighted", 12)).withColumn("odds", F.when((F.col("size") == n) | F.lit(k == 0), 1.0).otherwise(F.try_divide(inside, outside))).drop("_in")

    @F.pandas_udf("double")
    def tail(hits: pd.Series, size: pd.Series, odds: pd.Series) -> pd.Series:
        return pd.Series([sp.wallenius_sf(int(np.floor(a)), int(b), int(n - b), k, float(o)) for a, b, o in zip(hits, size, odds)])

    return bh(s.withColumn("p_value", tail("weighted", "size", "odds")), "p_value", "set_id", "q")


# -- networks by permutation, by sparse regression, and space by sample ---------------------------------------------------------------


def neighborhoods(edges: DataFrame, radius: int = 1, src: str = "source", dst: str = "target") -> DataFrame:
    """(node, near): nodes reached in one to ``radius`` steps of an undirected graph, without the node itself."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    e = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    reach = e.select(F.col("a").alias("node"), F.col("b").alias("near"))
    front = reach
    for _ in range(radius - 1):
        front = front.join(e.withColumnRenamed("a", "near"), "near").select("node", F.col("b").alias("near")).filter("node <> near").distinct()
        reach = materialize(reach.unionByName(front).distinct())
    return reach


def driver_permutation(edges: DataFrame, hits: DataFrame, radius: int = 1, permutations: int = 999, seed: int = 1) -> DataFrame:
    """Hits near each node against hits dealt at random among nodes of like degree (powers of two): p = (x + 1) / (B + 1), adjusted.

    Each permutation is a column of a hash order inside degree bins: labels move, the graph stays. Permutations are distributed.
    """
    near = materialize(neighborhoods(edges, radius))
    degree = neighborhoods(edges, 1).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    nodes = materialize(degree.join(hits.select(F.col("node")).distinct().withColumn("_hit", F.lit(1)), "node", "left").select("node", "degree", F.coalesce("_hit", F.lit(0)).alias("hit"), F.floor(F.log2("degree")).alias("bin")))
    quota = nodes.groupBy("bin").agg(F.sum("hit").alias("k"))
    seen = near.join(nodes.select(F.col("node").alias("near"), "hit"), "near").groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("hit").alias("observed"))
    deals = nodes.join(F.broadcast(quota), "bin").filter("k > 0").select("node", "bin", "k", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("run"))
    order = W.partitionBy("run", "bin").orderBy(F.xxhash64(F.lit(seed), "run", F.col("node").cast("string")), "node")
    dealt = deals.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.col("k")).select(F.col("node").alias("near"), "run")
    counts = near.join(dealt, "near").groupBy("node", "run").agg(F.count(F.lit(1)).alias("n"))
    over = counts.join(seen.select("node", "observed"), "node").filter(F.col("n") >= F.col("observed")).groupBy("node").agg(F.count(F.lit(1)).alias("x"))
    out = nodes.join(seen, "node").join(over, "node", "left")
    # permutations without any hit nearby reach an observed count of zero too
    x = F.when(F.col("observed") == 0, F.lit(permutations)).otherwise(F.coalesce("x", F.lit(0)))
    out = out.withColumn("p_value", (x + 1) / F.lit(permutations + 1.0)).select("node", "hit", "degree", "size", "observed", "p_value")
    return bh(out, "p_value", "node", "q")


def sparse_network(df: DataFrame, sample: str, feature: str, value: str, lam: float, rule: str = "and") -> DataFrame:
    """Neighbourhood selection: each feature regressed on all others with an L1 penalty on one shared correlation matrix; edges by AND or OR."""
    r = correlation_pairs(df, sample, feature, value)
    kind = dict(df.dtypes)[feature]
    ids = sorted(x[0] for x in df.select(feature).distinct().limit(5001).collect())
    if len(ids) > 5000:
        raise ValueError("more than 5000 features in one network")
    place = {v: i for i, v in enumerate(ids)}
    cor = np.eye(len(ids))
    for x in r.select("a", "b", "r").collect():
        cor[place[x["a"]], place[x["b"]]] = cor[place[x["b"]], place[x["a"]]] = x["r"]
    shared = df.sparkSession.sparkContext.broadcast((ids, cor))

    def fit(batches):
        names, c = shared.value
        for pdf in batches:
            rows = []
            for v in pdf["f"]:
                j = names.index(v)
                b = np.zeros(len(names))
                for _ in range(10_000):
                    most = 0.0
                    for i in range(len(names)):
                        if i == j:
                            continue
                        rho = c[i, j] - c[i] @ b + b[i]
                        new = np.sign(rho) * max(abs(rho) - lam, 0.0)
                        most = max(most, abs(new - b[i]))
                        b[i] = new
                    if most < 1e-9:
                        break
                rows += [(v, names[i], float(b[i])) for i in np.flatnonzero(np.abs(b) > 1e-10)]
            yield pd.DataFrame(rows, columns=["target", "source", "beta"])

    fits = df.select(F.col(feature).alias("f")).distinct().repartition(min(len(ids), 64)).mapInPandas(fit, f"target {kind}, source {kind}, beta double")
    g = fits.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("beta")).alias("s"))
    return g.filter(F.col("n") >= (2 if rule == "and" else 1)).select("a", "b", (F.col("s") / 2).alias("weight"))


def edge_fractions(edges: DataFrame, labels: DataFrame, sample: str = "sample_id", node: str = "node", label: str = "label") -> DataFrame:
    """asin sqrt of the share of a sample's edges that join two labels, zeros included; ready for a regression over samples."""
    a = labels.select(F.col(node).alias("source"), F.col(label).alias("la"), F.col(sample).alias("s"))
    b = labels.select(F.col(node).alias("target"), F.col(label).alias("lb"))
    c = edges.select("source", "target").join(a, "source").join(b, "target").groupBy("s", F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    n = c.groupBy("s").agg(F.sum("k").alias("n"))
    every = n.crossJoin(F.broadcast(c.select("a", "b").distinct()))  # samples times pairs of labels is the size of the result
    out = every.join(c, ["s", "a", "b"], "left").select(F.col("s").alias(sample), "a", "b", F.coalesce("k", F.lit(0)).alias("k"), "n")
    return out.withColumn("value", F.asin(F.sqrt(F.col("k") / F.col("n"))))


def distance_slopes(values: DataFrame, by: list[str], distance: str, value: str) -> DataFrame:
    """Least-squares slope of a feature on a distance in each group (sample and feature) of three observations or more."""
    s = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(value, distance).alias("slope"))
    return s.filter("n >= 3")

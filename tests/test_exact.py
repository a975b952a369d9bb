import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions import exact as ex
from statloom.functions import special as sp
from statloom.operators import hypothesis as h


def _counted(values):
    values = list(values)
    return np.bincount(values) / len(values)


@pytest.mark.parametrize("m, n", [(1, 1), (3, 5), (6, 4)])
def test_rank_distributions_against_all_arrangements(m, n):
    every = list(itertools.combinations(range(1, m + n + 1), m))
    assert ex.rank_sums(m, n) == pytest.approx(_counted(sum(c) - m * (m + 1) // 2 for c in every))
    got = ex.ansari(m, n)
    want = _counted(sum(min(i, m + n + 1 - i) for i in c) for c in every)
    assert got[: len(want)] == pytest.approx(want) and not got[len(want) :].any()
    signs = itertools.product((0, 1), repeat=n)
    assert ex.signed_ranks(n) == pytest.approx(_counted(int(np.dot(s, range(1, n + 1))) for s in signs))


def _distance(chosen, m, n):
    u = np.cumsum([i in chosen for i in range(m + n)])
    return np.abs(u / m - (np.arange(1, m + n + 1) - u) / n).max()


@pytest.mark.parametrize("m, n", [(1, 1), (4, 4), (3, 6)])
def test_two_sample_distance_against_all_arrangements(m, n):
    every = np.array([_distance(set(c), m, n) for c in itertools.combinations(range(m + n), m)])
    for d in np.unique(every.round(12)):
        assert ex.distance_two_sample(d, m, n) == pytest.approx((every >= d - 1e-9).mean())


def test_one_sample_distance():
    # for one value D = max(u, 1 - u); published critical values at 0.05 and 0.01
    assert ex.distance_one_sample(0.7, 1) == pytest.approx(0.6)
    assert [ex.distance_one_sample(d, n) for d, n in ((0.40925, 10), (0.48893, 10), (0.29408, 20))] == pytest.approx([0.05, 0.01, 0.05], rel=2e-3)


@pytest.mark.parametrize("x, mu", [(0, 3.2), (2, 6.5), (7, 7.0), (15, 6.5), (1, 0.4), (0, 0.0)])
def test_poisson_against_all_outcomes(x, mu):
    k = np.arange(200)
    mass = np.exp(k * np.log(mu) - mu - sp.lgamma(k + 1.0)) if mu else (k == 0).astype(float)
    assert ex.poisson_two_sided(x, mu) == pytest.approx(min(1.0, mass[mass <= mass[x] * (1 + 1e-7)].sum()), rel=1e-9)


def test_small_groups_are_exact_and_ties_are_not(spark):
    rows = [(g, s, float(v)) for g, values in (("a", ((1.0, 2.5, 7.0), (3.0, 8.0, 9.0, 10.0))), ("t", ((1.0, 2.0, 7.0), (2.0, 8.0, 9.0, 10.0)))) for s, side in enumerate(values) for v in side]
    df = spark.createDataFrame(rows, "g string, s int, v double")
    w = {r.g: r for r in h.rank_sum(df, "v", "s", 0, 1, by=["g"]).collect()}
    assert w["a"].p_value == pytest.approx(ex.two_sided(ex.rank_sums(3, 4), w["a"].statistic))
    assert w["t"].p_value == pytest.approx(2 * float(sp.normal_sf(abs(w["t"].z))))
    far = {r.g: r for r in h.rank_sum(df, "v", "s", 0, 1, by=["g"], exact=False).collect()}
    assert far["a"].p_value == pytest.approx(2 * float(sp.normal_sf(abs(far["a"].z))))
    ab = {r.g: r for r in h.ansari_bradley(df, "v", "s", 0, 1, by=["g"]).collect()}
    assert ab["a"].p_value == pytest.approx(ex.two_sided(ex.ansari(3, 4), ab["a"].statistic)) and ab["t"].p_value == pytest.approx(2 * float(sp.normal_sf(abs(ab["t"].z))))
    ks = {r.g: r for r in h.ks_two_sample(df, "v", "s", 0, 1, by=["g"]).collect()}
    assert ks["a"].p_value == pytest.approx(ex.distance_two_sample(ks["a"].statistic, 3, 4)) and 0 < ks["t"].p_value <= 1
    signed = spark.createDataFrame([("a", 1.0), ("a", -2.0), ("a", 3.0), ("a", 4.0), ("z", 1.0), ("z", 0.0), ("z", 2.0), ("z", 3.0)], "g string, d double")
    v = {r.g: r for r in h.signed_rank(signed, "d", by=["g"]).collect()}
    assert (v["a"].statistic, v["a"].p_value) == (8.0, pytest.approx(ex.two_sided(ex.signed_ranks(4), 8))) and v["z"].p_value == pytest.approx(2 * float(sp.normal_sf(abs(v["z"].z))))
    one = h.ks_one_sample(spark.createDataFrame([(0.1,), (0.4,), (0.7,), (None,)], "v double"), "v", F.col("v")).collect()[0]
    assert (one.n, one.statistic, one.p_value) == (3.0, pytest.approx(0.3), pytest.approx(ex.distance_one_sample(one.statistic, 3)))
    empty = spark.createDataFrame([], "g string, s int, v double")
    assert h.ks_one_sample(empty, "v", F.col("v"), by=["g"]).count() == 0 and h.rank_sum(empty, "v", "s", 0, 1, by=["g"]).count() == 0
    alone = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 2.0), ("b", 1, 3.0)], "g string, s int, v double")
    for test in (h.rank_sum, h.ansari_bradley, h.mood, h.ks_two_sample):  # groups with one side have no test, but do not fail
        got = test(alone, "v", "s", 0, 1, by=["g"]).select("g", "p_value").collect()
        assert len(got) == 2 and all(r.p_value is None or r.p_value != r.p_value for r in got), (test.__name__, got)
    assert h.signed_rank(alone, "v", by=["g"]).count() == 2 and h.kruskal_wallis(alone, "v", "s", by=["g"]).count() == 2
    rate = h.poisson_exact(spark.createDataFrame([(10, 4.0)], "x int, t double"), "x", "t").collect()[0]
    assert rate.ci_low < rate.estimate == 2.5 < rate.ci_high and rate.p_value == pytest.approx(ex.poisson_two_sided(10, 4.0))

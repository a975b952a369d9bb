import numpy as np
import pytest

from statloom.llm import embed_dedup as ed
from statloom.llm import registry


def brute(rows, threshold=0.93):
    ok = {}
    for i, v, l in rows:
        if v is not None and l is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            ok[i] = (x / np.abs(x).max(), l)
    ok = {i: (x / np.linalg.norm(x), l) for i, (x, l) in ok.items()}
    out = {i: [0, i] for i, _, _ in rows}
    root = {i: i for i in out}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(ok)
    for a in ids:
        for b in ids:
            if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= threshold:
                out[a][0] += 1
                out[b][0] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (n, find(i), find(i) == i) for i, (n, _) in out.items()}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("block", [256, 3])
def test_clusters_and_odd_vectors_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(30):
        center = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 14))):
            rows.append(((center + rng.normal(size=16) * 0.05).tolist(), int(rng.integers(0, 2))))
    rows += [(rows[0][0], 0)] * 12 + [([0.0] * 16, 0), (None, 0), (rows[0][0], None), ([float("nan")] * 16, 0), ([None] * 16, 0), ([], 0), ([1.0, 2.0], 0), ([2.0, 4.0], 0), ([1e300] * 16, 1), ([1e-300] * 16, 1)]
    rows = [(i * 7 - 20, v, l) for i, (v, l) in enumerate(rows)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, digest string, size int")
    assert got(ed.near_duplicates(frame, target=1.0)) == brute(rows)


def test_generated_table_recall_and_precision(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    df = registry.queries()["op4_embedding_dedup"](spark, sf)
    found, want = got(df), brute(rows)
    assert set(found) == set(want)
    assert all(found[i][0] <= want[i][0] for i in want)
    assert sum(n for n, *_ in found.values()) >= 0.9 * sum(n for n, *_ in want.values())
    assert ed.recall(spark.read.parquet(f"{sf}/embeddings.parquet"), df) >= 0.9


def test_hot_group_over_more_cells_than_visits_is_compared_exactly(spark, monkeypatch):
    monkeypatch.setattr(ed, "PER_CELL", 1)
    monkeypatch.setattr(ed, "EXACT_BLOCK", 200, raising=False)
    rng = np.random.default_rng(7)
    hot = rng.normal(size=64)
    rows = [((hot + rng.normal(size=64) * 0.2).tolist(), 0) for _ in range(500)] + [(rng.normal(size=64).tolist(), k % 2) for k in range(600)]
    rows = [(i * 3 + 1, v, l) for i, (v, l) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(ed.near_duplicates(frame)) == brute(rows)


def test_rare_links_outside_the_query_set_are_measured(spark, monkeypatch):
    monkeypatch.setattr(ed, "PER_CELL", 1)
    monkeypatch.setattr(ed, "QUERIES", 4)
    rng = np.random.default_rng(11)
    rows = [(rng.normal(size=32).tolist(), 0) for _ in range(400)]
    rows += [((np.array(v) + rng.normal(size=32) * 0.3).tolist(), 0) for v, _ in rows[:40]]
    rows = [(i, v, l) for i, (v, l) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(ed.near_duplicates(frame, target=1.0)) == brute(rows)


def test_small_groups_count_as_much_as_a_hot_one():
    n = np.zeros((100, ed.MOST_VISITS + 1), np.int64)
    n[0, 0], n[1:, 10] = 10**6, 3
    assert ed._need(n, 0.995) == (11, 1.0)


def test_sequence_is_the_order_of_summed_distances():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 10))
    index = ed.Index(x, 9)
    a, b = ed._distances(x[:, :5], index.first), ed._distances(x[:, 5:], index.second)
    total = (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
    seq = index.sequence(x, 12)
    assert np.allclose(np.take_along_axis(total, seq, 1), np.sort(total, axis=1)[:, :12])
    assert index.sequence(x, 500).shape[1] == 81


def test_empty_and_repeated(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)], "vec_id long, embedding array<float>, label int")
    assert got(ed.near_duplicates(frame)) == {1: (1, 1, True), 2: (1, 1, False)}
    assert ed.near_duplicates(frame.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert got(ed.near_duplicates(none)) == {1: (0, 1, True)}

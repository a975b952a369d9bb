import random

import numpy as np
import pytest

from statloom.llm import ngram_join as nj
from statloom.llm import registry

from .sql import duck, norm, same

SF = "/root/testdata/sf0.001"


def words(t):
    out = []
    for c in (t or "").translate({i: i + 32 for i in range(65, 91)}):
        if c in " \t\n\v\f\r":
            out.append(" ")
        else:
            out.append(c)
    return [w for w in "".join(out).split(" ") if w]


def brute(docs):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def texts(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["É", "ü"]
    base = [[rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 5, 6, 12, 40, 120]))] for _ in range(25)]
    shared = [rng.choice(vocab) for _ in range(30)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w += shared
        out.append((i * 3 + 1, rng.choice([" ", "\n", "  "]).join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in w)))
    return out + [(2, None), (5, "")]


@pytest.mark.parametrize("seed,leaf", [(1, 128), (2, 4), (3, 12)])
def test_random_near_copies_match_brute_force(spark, seed, leaf, monkeypatch):
    monkeypatch.setattr(nj, "LEAF", leaf)
    docs = texts(seed)
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, block string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.join(frame).collect()}
    assert got == brute(docs)
    kept = {r.doc_id for r in nj.keep_one(frame).collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_matches_sql(spark, sf):
    same(registry.queries()["op2_ngram_join"](spark, sf), registry.oracle_sql()["op2_ngram_join"], sf)


def test_node_bounds_never_drop_a_link():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 62, rng.integers(5, 300)).astype(np.uint64)
        for _ in range(4):
            keep = base[rng.random(len(base)) < rng.choice([0.85, 0.95, 1])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, rng.integers(0, 9)).astype(np.uint64)])))
    sets = [s for s in sets if len(s)]
    nodes = []
    for g in range(0, len(sets), 5):
        own = sets[g : g + 5]
        maps = np.stack([nj._bitmap(s) for s in own])
        size = np.array([len(s) for s in own])
        nodes.append(nj.Node(size.min(), size.max(), np.bitwise_or.reduce(maps), np.bitwise_and.reduce(maps), (size - nj._ones(maps)).max(), leaf=g // 5))
    found = {tuple(sorted(p)) for p in nj.traverse(nodes)}
    a, b = nj.linked(sets)
    assert len(a) and {tuple(sorted((x // 5, y // 5))) for x, y in zip(a.tolist(), b.tolist())} <= found
    assert len(found) < len(nodes) * (len(nodes) + 1) // 2


def test_empty_repeated_and_null_ids(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "A\tb"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.join(frame).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert nj.join(frame.limit(0)).count() == 0


def test_a_tree_leaves_the_links_of_any_two_sets():
    rng = np.random.default_rng(8)
    base = [np.unique(rng.integers(0, 1 << 62, rng.integers(5, 200)).astype(np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < 0.97], rng.integers(0, 1 << 62, 2).astype(np.uint64)])) for b in base for _ in range(5)]
    maps = np.stack([nj._bitmap(s) for s in sets])
    pairs = lambda found: {tuple(sorted(p)) for p in zip(*(x.tolist() for x in found))}
    assert pairs(nj.tree_links(sets, maps)) == pairs(nj.linked(sets)) != set()
    side = rng.random(len(sets)) < 0.5
    assert pairs(nj.tree_links(sets, maps, side)) == pairs(nj.linked(sets, side)) != set()


def test_pivots_spare_the_pairs_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(nj, "LEAF", 8)
    words = [f"w{k}" for k in range(200)]
    docs = [(i, " ".join(words[:i] + ["x"] + words[i:])) for i in range(100)] + [(500 + i, " ".join(["y"] * 3 + words[: 150 + i])) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nj.join(frame).collect()} == brute(docs)


def test_common_phrases_of_short_documents_make_no_block(spark):
    """Documents of which a third is common phrases, the rest their own: no candidates, except for the near copies among them."""
    rng = random.Random(11)
    phrases = [" ".join(f"p{k}x{j}" for j in range(9)) for k in range(12)]
    docs = []
    for i in range(400):
        own = [f"o{i}y{j}" for j in range(30)]
        docs.append((i, " ".join([*own[:10], rng.choice(phrases), *own[10:20], rng.choice(phrases), *own[20:]])))
    docs += [(1000 + i, t + " one") for i, t in docs[:20]]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    _, blocks = nj.classes(frame)
    assert max(r["count"] for r in blocks.groupBy("block").count().collect()) == 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in nj.join(frame).collect()} == brute(docs)


def test_runs_keep_sizes_that_can_link_together():
    size = np.unique(np.concatenate([np.arange(1, 400), np.random.default_rng(3).integers(400, 10**7, 400)]))
    code = nj._size_code(size)
    for a in range(0, len(size), 7):
        near = np.flatnonzero((100 * np.minimum(size[a], size) >= 80 * np.maximum(size[a], size)) & (size != size[a]))
        for b in near[:: max(1, len(near) // 5)]:
            own = np.array([1 << 8 | code[a], 2 << 8 | code[b]], np.uint64)
            token, met, count = nj._runs(np.array([9, 9], np.uint64), own)
            assert len(set(token.tolist())) == 1 and set(met.tolist()) == set(own.tolist()) and count.tolist() == [2, 2]
    own = np.array([1 << 8 | nj._size_code(np.array([50]))[0], 2 << 8 | nj._size_code(np.array([100]))[0]], np.uint64)
    assert not len(nj._runs(np.array([9, 9], np.uint64), own)[0])

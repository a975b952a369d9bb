import hashlib
import random

import pytest

from statloom.llm import registry, window_dedup as wd


def brute(docs):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for s in range(len(b) - 99):
            h = b[s : s + 100]
            if h in seen:
                mark[s : s + 100] = b"\x01" * 100
            else:
                seen.add(h)
        kept = bytes(x for x, m in zip(b, mark) if not m)
        runs = sum(1 for k, m in enumerate(mark) if m and (k == 0 or not mark[k - 1]))
        out[i] = (len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, docs):
    frame = spark.createDataFrame([(i, t, "x", b"0") for i, t in docs], "doc_id long, text string, key string, blob binary")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in wd.report(frame.repartition(5)).collect()}
    want = brute(docs)
    assert got == want, [(i, got[i], want[i]) for i in want if got[i] != want[i]][:5]


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéü ") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(rng.choice([10, 25, 60]))) for _ in range(8)]
    docs = []
    for i in range(n):
        bits = [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            bits.insert(rng.randrange(len(bits) + 1), rng.choice(passages))
        t = rng.choice([" ", "\n"]).join(bits)
        if docs and rng.random() < 0.3:
            t = rng.choice(docs)[1] or ""
            if t and rng.random() < 0.7:
                k = rng.randrange(len(t))
                t = t[:k] + rng.choice(["", "X", " and "]) + t[k + rng.randrange(2) :]
        docs.append((rng.randrange(1000) * 1000 + i, t))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_corpora_match_brute_force(spark, seed):
    check(spark, corpus(seed))


def test_periodic_short_and_odd_texts(spark):
    docs = [(1, "a" * 1000), (2, "a" * 99), (3, "a" * 100), (4, None), (5, ""), (6, "ab" * 300), (7, "ba" * 300), (8, "é" * 120), (-3, "b" + "ab" * 60), (9, "x" * 50 + "a" * 150 + "y" * 50), (2**40, "ab" * 300)]
    check(spark, docs)


def test_long_documents_are_cut(spark, monkeypatch):
    monkeypatch.setattr(wd, "STRETCH", 500)
    monkeypatch.setattr(wd.tx, "PIECE_BYTES", 300)
    data, offs = wd.tx.utf8(wd.pa.array(["q" * 10, "w" * 3000, ""]))
    assert sum(len(d) for _, d, _, _ in wd._stretches(data, offs)) >= 3010
    from statloom.llm import text

    rng = random.Random(9)
    t = "".join(rng.choice("abcd") for _ in range(3000))
    a, b = wd.tx.utf8(wd.pa.array([t]))
    whole, cut = [], []
    for i, piece, at, base in wd._stretches(a, b):
        doc, start, n, *_ = wd.segments(piece, at, wd._codes())
        cut += [s + base + k for s, c in zip(start, n) for k in range(c)]
    assert cut == list(range(2901)) and text.PIECE_BYTES == 300


def test_generated_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.queries()["op10_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()}
    assert got == brute([(r.doc_id, r.text) for r in table.collect()])


def test_empty_repeated_and_null_ids(spark):
    frame = spark.createDataFrame([(1, "z" * 150), (1, "z" * 150), (None, "z" * 150)], "doc_id long, text string")
    assert [(r.doc_id, r.n_removed) for r in wd.report(frame).collect()] == [(1, 149)]
    assert wd.report(frame.limit(0)).count() == 0
    kept = wd.dedup(spark.createDataFrame([(1, "k" * 100), (2, "k" * 101)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in kept} == {1: b"k" * 100, 2: b""}

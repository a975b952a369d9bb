import math
import zlib
from collections import Counter

import numpy as np
import pytest

from statloom.llm import lm_score as lm
from statloom.llm import registry

from .test_ngram_join import words

END = object()


def base(rows):
    count = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*words(t), END])
    n, v = sum(count.values()), len(count)
    out = {}
    for i, t in rows:
        w = [*words(t), END]
        out[i] = (i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
    return out


def compare(rows, got):
    want = base(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert abs(r.base_score - w[4]) < 1e-6 * max(1, abs(w[4]))
        assert r.score < 0 and math.isfinite(r.score)


@pytest.mark.parametrize("frequent", [1 << 17, 40])
def test_unigram_part_matches_brute_force(spark, frequent, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "É é\x0bX x"), (None, "the end")]
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, score int, held string").repartition(3)
    compare(rows, lm.score(frame).collect())


def sequential(model, text):
    """The model's score one decision at a time."""
    data = list(text.encode()) + [lm.END]
    w = np.tile(np.array(lm.START, np.float64), (lm.GATES, 1))
    total, at, block = 0.0, 0, lm.FIRST_BLOCK
    guesses, last, run = [], {}, 0
    for pos, symbol in enumerate(data):
        before = tuple(data[max(0, pos - lm.MATCH) : pos])
        guesses.append((last.get(before), min(run, lm.MATCH_RUN)))
        run = run + 1 if guesses[-1][0] == symbol else 0
        last[before] = symbol
    while at < len(data):
        step, seen = np.zeros_like(w), np.zeros(lm.GATES)
        for pos in range(at, min(at + block, len(data))):
            ctx = []
            for order in lm.ORDERS:
                h = order * 0x9E3779B1 & 0xFFFFFFFF
                for k in range(1, order + 1):
                    h = ((h ^ (data[pos - k] + 1 if pos >= k else 0)) * 0x85EBCA6B) & 0xFFFFFFFF
                    h ^= h >> 13
                ctx.append(h)
            s = data[pos]
            for k in range(model.depth[s]):
                mixed, bit, gate = model.mixed[s, k : k + 1], int(model.bit[s, k]), min(k, lm.GATES - 1)
                odds = np.array([float(t[int(lm._slot(np.array([c], np.uint32), mixed, b)[0])]) for t, c, b in zip(model.tables, ctx, lm.TABLE_BITS)] + [0.0])
                guess, right = guesses[pos]
                if guess is not None and model.depth[guess] > k and (model.bit[guess, :k] == model.bit[s, :k]).all():
                    odds[-1] = (1 if model.bit[guess, k] else -1) * lm.MATCH_ODDS * (right + 1)
                z = float(w[gate] @ odds)
                p = 1 / (1 + math.exp(-z))
                total += math.log10(p if bit else 1 - p)
                step[gate] += (bit - p) * odds
                seen[gate] += 1
        w += lm.RATE * step / np.sqrt(np.maximum(seen, 1))[:, None]
        at, block = at + block, min(2 * block, lm.LAST_BLOCK)
    return total


def test_batches_score_as_one_decision_at_a_time(spark):
    rows = [(i, f"Alpha beta {i} gämma delta " * (i % 5 * 6)) for i in range(30)] + [(99, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = lm.fit(frame)
    got = {r.doc_id: r.score for r in lm.score(frame, fitted).collect()}
    for i, t in rows[:8] + rows[-2:]:
        assert abs(got[i] - sequential(fitted.model, t or "")) < 1e-3 * max(1.0, abs(got[i])), i


def test_probabilities_of_the_next_symbol_add_up_to_one(spark):
    fitted = lm.fit(spark.createDataFrame([(i, "abc abd") for i in range(9)], "doc_id long, text string"))
    model = fitted.model
    # the decisions of all symbols after one context: every path's probability, summed
    odds = np.random.default_rng(0).normal(size=int(model.node.max()) + 1)
    p = 1 / (1 + np.exp(-odds))
    total = 0.0
    for s in range(257):
        path = [(int(model.node[s, k]), int(model.bit[s, k])) for k in range(model.depth[s])]
        total += math.prod(p[n] if b else 1 - p[n] for n, b in path)
    assert abs(total - 1) < 1e-9


def test_held_out_text_costs_less_than_raw_and_than_shuffled_bytes(spark):
    scored = registry.queries()["op7_lm_score"](spark, "/root/testdata/sf0.01")
    rows = [r for r in scored.collect() if r.held_out]
    mean = sum(r.bits_per_byte for r in rows) / len(rows)
    total = {r.held_out: r for r in lm.bits_per_byte(scored, "held_out").collect()}[True]
    print("held-out bits per byte: mean", mean, "total", total.bits_per_byte)
    assert mean < 3.2 and total.bits_per_byte < 3.2
    assert total.bits_per_byte == pytest.approx(sum(r.bits_per_byte * r.n_bytes for r in rows) / total.n_bytes)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) * 1.3


def test_tables_have_a_slot_for_each_decision_of_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(lm, "TABLE_BITS", (6, 6, 6))
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefghijklmnop"), 300)) for _ in range(150)]
    fitted = lm.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), held_out=(7, 9))
    model = fitted.model
    for o, order in ((1, 3), (2, 5)):
        met = set()
        for t in texts:
            data = [0] * order + [b + 1 for b in t.encode()] + [lm.END + 1]
            for i in range(order, len(data)):
                met |= {(*data[i - order : i], int(x)) for x in model.node[data[i] - 1, : model.depth[data[i] - 1]]}
        assert len(met) <= len(model.tables[o]) <= 8 * len(met)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(frame).count() == 0


def a_tree():
    return lm.code_tree(np.bincount(np.frombuffer(b"the quick brown fox jumps over the lazy dog, and the rest", np.uint8), minlength=257))


def test_equal_symbols_after_equal_contexts_are_counted_at_once(monkeypatch):
    """Counts are those of every decision of every symbol, but the work follows the different pairs of context and symbol."""
    tree = a_tree()
    texts = [b"", b"the lazy dog " * 300, "é the quick fox ".encode() * 200, b"x"]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = [np.zeros(2 << b, np.uint32) for b in (8, 12, 22)]
    symbols, _, contexts = lm._symbols(data, offs)
    for o, (context, bits) in enumerate(zip(contexts, (8, 12, 22))):
        for k in range(tree[0].max()):
            own = tree[0][symbols] > k
            slot = lm._slot(context[own], lm._mixed(tree[1])[symbols[own], k], bits)
            np.add.at(want[o], slot.astype(np.int64) * 2 + tree[2][symbols[own], k], 1)
    work, slots = [], lm._slot
    monkeypatch.setattr(lm, "_slot", lambda c, m, b: work.append(len(c)) or slots(c, m, b))
    counts = lm.Counts(tree, [8, 12, 22])
    counts.add(data, offs)
    counts.add(data[:0], np.zeros(1, np.int64))
    assert all((a == b).all() for a, b in zip(want, counts.tables))
    assert sum(work) < len(data)


def test_decisions_that_share_a_gate_are_scored_at_once(monkeypatch):
    calls, slots = [], lm._slot
    monkeypatch.setattr(lm, "_slot", lambda c, m, b: calls.append(len(c)) or slots(c, m, b))
    tree, text = a_tree(), bytes(range(256))
    model = lm.Model(tree, [np.zeros(1 << b, np.float32) for b in lm.TABLE_BITS])
    score = model.log10(np.frombuffer(text, np.uint8), np.array([0, 256]))
    # even odds and no matches: one bit a decision
    assert score[0] == pytest.approx(-tree[0].sum() * math.log10(2), rel=1e-6)
    blocks = int(np.log2(257 / lm.FIRST_BLOCK + 1)) + 1
    assert len(calls) <= blocks * lm.GATES * len(lm.ORDERS)


@pytest.mark.parametrize("n", [0, 1, 40, 5000])
def test_common_words_are_found(n):
    rng = np.random.default_rng(n)
    words = np.unique(np.append(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2), [np.uint64(2**64 - 1)] * min(n, 1)).astype(np.uint64))
    fitted = lm.Fitted(None, 0, 0, words, np.ones(len(words), np.int64))
    asked = np.concatenate([words, words + np.uint64(1), rng.integers(0, 2**63, 300).astype(np.uint64)])
    at, hit = fitted.find(asked)
    assert (hit == np.isin(asked, words)).all() and (words[at[hit]] == asked[hit]).all()

import hashlib
import random
import re

import pytest

from statloom.llm import decontaminate as dc
from statloom.llm import registry

from .sql import same

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, size):
    wins = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        n = min(size, len(w))
        for k in range(len(w) - n + 1):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                own = wins.get(tuple(w[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_random_texts_match_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "B", "ü", "c9", "É"]
    docs = [(i, "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "... !"), (63, "a " * 3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 4, 5, 7])))) for i in range(12)] + [(90, None), (None, "a b"), (11, "c9 c9 c9 c9")]
    items = [x for x in items if x[0] != 11] + [(11, "c9 c9 c9 c9"), (11, "c9 c9 c9 c9")]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.report(d, b, 4).collect()}
    want = brute(docs, items, 4)
    assert got == want
    kept = {r.doc_id for r in dc.clean(d, b, 4).collect()}
    assert kept == {i for i, w in want.items() if not w[4]}
    spans = {r.doc_id: r for r in dc.clean(d, b, 4, mode="spans").collect()}
    for i, t in docs:
        if want[i][4]:
            assert len(words(spans[i].text)) == want[i][0] - want[i][1]
        else:
            assert spans[i].text == t


def test_matches_sql(spark):
    same(registry.queries()["op3_decontaminate"](spark, "/root/testdata/sf0.001"), registry.oracle_sql()["op3_decontaminate"], "/root/testdata/sf0.001")


def test_shuffled_probe_gives_the_same(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 0)
    same(registry.queries()["op3_decontaminate"](spark, sf), registry.oracle_sql()["op3_decontaminate"], sf)


@pytest.mark.parametrize("which", ["docs", "items", "both"])
def test_empty_tables(spark, which):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    d = d.limit(0) if which != "items" else d
    b = b.limit(0) if which != "docs" else b
    got = dc.report(d, b).collect()
    assert len(got) == (1 if which == "items" else 0)
    assert all(r.n_hit == 0 and not r.contaminated for r in got)
    assert dc.clean(d, b).count() == len(got)


def test_repeated_ids_count_once(spark):
    d = spark.createDataFrame([(1, "x y"), (1, "a b"), (1, None), (None, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [(r.doc_id, r.n_hit) for r in dc.report(d, b).collect()] == [(1, 2)]


def test_rows_without_an_id_or_with_a_repeated_one_are_judged_by_their_text(spark):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    rows = [(None, "zero one two three four", 1), (None, "nothing here", 2), (7, "One, two; three four!", 3), (7, "clean text", 4), (8, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key int")
    assert sorted(r.text_key for r in dc.clean(docs, bench, 4).collect()) == [2, 4, 5]
    spans = {r.text_key: r.text for r in dc.clean(docs, bench, 4, mode="spans").collect()}
    assert spans == {1: "zero", 2: "nothing here", 3: "", 4: "clean text", 5: None}
    assert dc.clean(docs.limit(0), bench, 4).count() == 0 and dc.clean(docs, bench.limit(0), 4).count() == 5


def test_texts_are_read_and_parted_into_words_once(spark):
    docs = spark.createDataFrame([(1, "zero one two three four"), (2, None)], "doc_id long, doc_text string")
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    plan = dc.hits(docs, bench, 4, text_col="doc_text")[0]._jdf.queryExecution().optimizedPlan().toString()
    assert sum("split(" in line and "doc_text" in line for line in plan.splitlines()) == 1
    out = dc.report(docs, bench, 4, text_col="doc_text")
    assert "doc_text" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.doc_id, r.n_words, r.n_hit) for r in out.orderBy("doc_id").collect()] == [(1, 5, 4), (2, 0, 0)]


@pytest.mark.parametrize("limit", [dc.BROADCAST_BYTES, 0])
def test_windows_of_every_length_are_found_at_every_place(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", limit)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 14)] + [(20, "K İx Q"), (21, "k ix q")]
    docs, at = [], 0
    for n, text in items:
        for before in range(12):
            for after in (0, 1, 7):
                docs.append((at := at + 1, " ".join(["x"] * before + [text.upper() if n < 20 else text] + ["Yé"] * after)))
    docs += [(0, "i13w0 i13w1 i13w2 i13w3 i13w4 i13w5 i13w6 i13w7 i13w8"), (-1, "K İX q. K iX Q")]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items, 10)

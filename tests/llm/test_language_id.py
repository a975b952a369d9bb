import math

import numpy as np
import pytest

from statloom.llm import language_id as lid
from statloom.llm.registry import queries


def test_grams_do_not_cross_documents_and_follow_code_points():
    texts = ["Abé", "", "x€y", "😀z"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    points, starts = lid._code_points(data, np.cumsum([0] + [len(r) for r in raw]))
    assert [chr(c) for c in points if c] == list("abéx€y😀z")
    assert list(starts) == [0, 5, 7, 12]


def test_held_out_accuracy_and_repeatability(spark):
    q = queries()["op8_language_id"]
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in q(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [r for r in docs if got[r.doc_id].held_out]
    assert 0.15 < len(held) / len(docs) < 0.35
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    again = {r.doc_id: r for r in q(spark, sf).collect()}
    assert all(abs(again[i].score - got[i].score) < 1e-9 and again[i].lang_pred == got[i].lang_pred for i in got)


def test_nulls_empties_and_clashing_columns(spark):
    rows = [(1, "the cat and the hat", "en", 1.0, "a"), (2, "der hund und die katze", "de", 2.0, "b"), (3, None, "en", 0.0, "c"), (4, "", None, 0.0, "d"), (5, "123 -- !!", "de", 0.0, "e"), (None, "und die der", None, None, None), (1, "the the " * 20000, "en", 1.0, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    model = lid.fit(docs, held_out=None)
    got = lid.predict(docs, model).collect()
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert len(got) == 7 and {(3, "und"), (4, "und"), (5, "und"), (1, "en"), (2, "de"), (None, "de")} <= by
    nothing = lid.fit(docs.limit(0), held_out=None)
    assert {r.lang_pred for r in lid.predict(docs, nothing).collect()} == {"und"}
    assert lid.predict(docs.limit(0), model).count() == 0


def brute(train, texts, bits):
    """The classifier one document and one n-gram at a time."""
    def grams(text):
        points = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in text] + [0, 0]
        out = []
        for order in lid.ORDERS:
            for k in range(len(points) - order + 1):
                h = order * 0x9E3779B1 & 0xFFFFFFFF
                for p in points[k : k + order]:
                    h = (h ^ p) * 0x85EBCA6B & 0xFFFFFFFF
                    h ^= h >> 15
                out.append((h * 0xC2B2AE35 & 0xFFFFFFFF) >> 32 - bits)
        return out

    labels = sorted({label for label, _ in train})
    counts = {label: {} for label in labels}
    for label, text in train:
        for g in grams(text):
            counts[label][g] = counts[label].get(g, 0) + 1
    total = {label: sum(counts[label].values()) for label in labels}
    prior = {label: sum(x == label for x, _ in train) + 1 for label in labels}
    out = []
    for text in texts:
        own = grams(text)
        n = (len(text) + 2) * len(lid.ORDERS)
        e = [sum(math.log((counts[x].get(g, 0) + 0.05) / (total[x] + 0.05 * 2**bits)) for g in own) * min(1, 256 / n) + math.log(prior[x] / sum(prior.values())) for x in labels]
        p = [math.exp(x - max(e)) for x in e]
        out.append((labels[p.index(max(p))], max(p) / sum(p)))
    return out


def test_whole_query_matches_brute_force(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(40).collect()] + [(9001, "Ü" * 700, "fr"), (9002, "ab cd", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lid.predict(docs, lid.fit(docs)).collect()}
    learned = {r.doc_id for r in docs.filter(lid.learned_from("doc_id")).collect()}
    want = brute([(r[2], r[1]) for r in rows if r[0] in learned and r[2] is not None], [r[1] for r in rows], lid.BITS)
    for (i, *_), (label, p) in zip(rows, want):
        assert got[i].lang_pred == label and got[i].score == pytest.approx(p, abs=1e-3)


def test_every_label_is_learned_however_few_rows_or_many_labels(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(500)] + [(1000 + k, f"{chr(0x4E00 + k) * 30}", f"x{k:03d}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lid.fit(docs, held_out=None, max_rows=1)
    assert len(model.languages) == 301 and model.bits == lid.matrix_bits(301) < lid.BITS
    assert {r.lang_pred for r in lid.predict(docs, model).collect()} == {"en", *[f"x{k:03d}" for k in range(300)]}
    assert np.exp(model.log_prior[model.languages.index("en")]) == pytest.approx(501 / 1101)
    assert lid.matrix_bits(1 << 20) == lid.LEAST_BITS and lid.matrix_bits(4) == lid.BITS

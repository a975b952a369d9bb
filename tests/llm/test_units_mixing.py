import itertools
import random
import re

import pytest

from statloom.llm import mixing, registry, units

from .sql import duck, norm, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op6_substring_dedup", "op9_line_dedup", "op1_mix_sources"])
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_matches_sql(spark, name, sf):
    same(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf)


ROWS = [(1, "Same  line\nown 1\n\nsame line", "x"), (2, "SAME\tline\nown 2", None), (3, None, "x"), (4, "", "y"), (5, "own 1\nsame line\n", "x"), (6, "ü same line\nSame line", "y"), (6, "ü same line\nSame line", "y"), (7, "\n" * 3000, "y")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, s, "clash", 0) for i, t, s in rows], "doc_id long, text string, source string, kept string, pos int")


def test_repeats_keep_the_first(spark):
    got = {r.doc_id: r for r in units.drop_repeats(docs(spark), unit="line", min_run=1, min_unit=1).collect()}
    assert len(got) == 7
    assert got[1].kept == "Same  line\nown 1\n\n" and [tuple(s) for s in got[1].spans] == [(18, 27)]
    assert got[2].kept == "own 2" and [tuple(s) for s in got[2].spans] == [(0, 10)]
    assert got[3].kept is None and got[4].kept == "" and got[5].kept == "" and got[6].kept == "ü same line\n"
    assert got[7].kept == "\n" * 3000 and got[7].n_units == 0


PASSAGE = "The first sentence of a passage stands here. Of. And the second one has rather more words in it! Is this the end of it?"


def brute_repeats(rows, min_run, min_unit):
    """Runs of repeated sentences by their first places, one document after the other."""
    first, out = {}, {}
    for i, text in sorted(rows):
        place, parts = 0, []
        for part in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", text or ""):
            key = " ".join(re.findall(r"[^\x20\x09-\x0D]+", part)).lower()
            if key:
                parts.append((place, place + len(part), key.count(" ") + 1, first.setdefault(key, (i, place)) != (i, place)))
            place += len(part)
        runs = [list(g) for again, g in itertools.groupby(parts, key=lambda p: p[3]) if again]
        out[i] = [(g[0][0], g[-1][1]) for g in runs if sum(p[2] for p in g) >= min_run and max(p[2] for p in g) >= min_unit]
    return out


def test_a_passage_inside_longer_lines_goes_and_short_repeats_stay(spark):
    rows = [(1, f"One. {PASSAGE} Of. Two", "s"), (2, f"Before it. {PASSAGE}   Of. After it", "s"), (3, "Of. Of. Own text here.", "s"), (4, PASSAGE.upper().replace(" ", "\t"), "s"), (5, "in! in! in! " * 30, "s")]
    got = {r.doc_id: r for r in units.drop_repeats(docs(spark, rows)).collect()}
    want = brute_repeats([r[:2] for r in rows], units.MIN_RUN, units.MIN_UNIT)
    assert {i: [tuple(s) for s in r.spans] for i, r in got.items()} == want
    assert got[1].kept == rows[0][1] and got[2].kept == "Before it. After it" and got[3].spans == [] and got[5].spans == []
    assert len(got[4].spans) == 1


@pytest.mark.parametrize("kind", sorted(units.UNITS))
def test_units_are_the_whole_text(kind):
    for text in ("", "a\n\nb. c\n\n\n", "x" * 9 + "\n", "\n\n", "one! two?\nthree..", PASSAGE * 50):
        assert "".join(re.findall(units.UNITS[kind], text)) == text


def test_rare_keys_take_the_shuffled_way(spark, monkeypatch):
    monkeypatch.setattr(units, "HOT_KEYS", 1)
    same(registry.queries()["op6_substring_dedup"](spark, SF), registry.oracle_sql()["op6_substring_dedup"], SF)


def test_templates_generalise_fields(spark):
    rows = [(i, f"Error {i} at host{i}\nunique line of {chr(97 + i)}", "s") for i in range(5)]
    got = {r.doc_id: r.kept for r in units.drop_templates(docs(spark, rows), min_docs=3).collect()}
    assert got[0].startswith("Error 0") and all(got[i] == f"unique line of {chr(97 + i)}" for i in range(1, 5))
    gone = {r.doc_id: r.kept for r in units.drop_templates(docs(spark, rows), min_docs=3, keep_first=False).collect()}
    assert gone[0] == "unique line of a"
    assert all(len(r.spans) == 0 for r in units.drop_templates(docs(spark, rows), min_docs=6).collect())


def test_lines_without_digits_generalise_in_their_leaf(spark):
    rows = [(1, "cut line_17 at alice\nthe report of monday", "s"), (2, "cut line_9 at bob\nnone of this recurs", "s"), (3, "cut grass at alice", "s")]
    got = {r.doc_id: r.kept for r in units.drop_templates(docs(spark, rows), min_docs=2, values=1).collect()}
    assert got == {1: rows[0][1], 2: "none of this recurs", 3: rows[2][1]}
    assert {r.doc_id: r.kept for r in units.drop_templates(docs(spark, rows), min_docs=2, values=2).collect()} == {i: t for i, t, _ in rows}
    mixed = [(i, f"the of and {' '.join(random.Random(i).choices('abcdefghij', k=6))}", "s") for i in range(40)]
    assert all(not r.spans for r in units.drop_templates(docs(spark, mixed), min_docs=2, values=1).collect())  # prose in one leaf keeps too little


def test_long_templates_go_from_the_second_document_on(spark):
    long = "a long line of so many plain words that it is hardly met by chance in any two documents of a corpus at all"
    rows = [(1, f"{long}\nshort line", "s"), (2, f"{long.upper()}\nshort line", "s")]
    got = {r.doc_id: r.kept for r in units.drop_templates(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "short line"}


def test_edge_rows_match_sql(spark):
    frame = docs(spark, ROWS[:6] + ROWS[7:]).select("doc_id", "text", "source")
    pdf = frame.toPandas()
    ways = [(units.oracle_repeats(min_run=r, min_unit=u), lambda d, r=r, u=u: units.drop_repeats(d, min_run=r, min_unit=u)) for r, u in ((20, 4), (1, 1), (3, 2))]
    ways += [(units.oracle_templates(min_docs=2, values=v), lambda d, v=v: units.drop_templates(d, min_docs=2, values=v)) for v in (1, 10)]
    for sql, fn in ways:
        got = units.report(fn(frame))
        names, want = duck(sql, SF, {"documents": pdf})
        assert norm(got.columns, [tuple(r) for r in got.collect()]) == norm(names, want), sql
    got = mixing.mix(frame)
    names, want = duck(mixing.oracle(), SF, {"documents": pdf})
    assert norm(got.columns, [tuple(r) for r in got.collect()]) == norm(names, want)


@pytest.mark.parametrize("target", [mixing.Target(entropy=1.0, max_repeats=1.5), mixing.Target(entropy=0.5), mixing.Target(entropy=0.99, max_repeats=3, budget=2.5), mixing.Target(budget=9, max_repeats=2)])
def test_mix_meets_its_target(spark, target):
    table = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "case when doc_id % 3 = 0 then 'big' else source end as source")
    rows = mixing.mix(table, target).collect()
    names, want = duck(mixing.oracle(target, "mine"), SF, {"mine": table.toPandas()})
    assert norm(["block", "copies", "doc_id", "n_tokens", "source", "weight"], [(r.block, r.copies, r.doc_id, r.n_tokens, r.source, r.weight) for r in rows]) == norm(names, want)
    tokens, drawn = {}, {}
    for r in rows:
        tokens[r.source] = tokens.get(r.source, 0) + r.n_tokens
        drawn[r.source] = drawn.get(r.source, 0) + r.n_tokens * r.copies
    assert all(drawn[s] <= target.max_repeats * tokens[s] + 1e-6 for s in tokens)
    assert sum(drawn.values()) <= min(target.budget, target.max_repeats) * sum(tokens.values())


def test_many_sources_take_the_joined_way(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    same(registry.queries()["op1_mix_sources"](spark, SF), registry.oracle_sql()["op1_mix_sources"], SF)
    assert mixing.draws(mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"))).count() > 0


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    assert units.drop_repeats(none).count() == units.drop_templates(none).count() == mixing.mix(none).count() == 0
    blank = mixing.mix(docs(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [r.copies for r in blank] == [0, 0]

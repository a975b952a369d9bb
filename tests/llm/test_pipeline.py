import corpus_pipeline as cp
from statloom.llm import language_id, mixing, units

from .sql import duck, norm
from .test_decontaminate import brute as leaks
from .test_ngram_join import brute as near

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns

    one = cp.identify_language(spark, docs, SF)
    assert one.columns == columns
    pred = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    rows = [tuple(r) for r in one.collect()]
    assert {r[0] for r in rows} == {i for i, r in pred.items() if r.lang_pred != "und" and r.score >= cp.MIN_LANGUAGE_SCORE}
    assert len(rows) > 0.97 * len(pred)

    docs = spark.createDataFrame(rows, docs.schema)
    two = cp.drop_line_templates(spark, docs, SF)
    assert two.columns == columns
    names, want = duck(units.oracle_templates(min_docs=cp.TEMPLATE_DOCS, long_docs=cp.TEMPLATE_DOCS), SF, {"documents": docs.toPandas()})
    gone = {r[names.index("doc_id")]: r[names.index("n_removed")] for r in want}
    rows = two.collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    assert {i for i, n in gone.items() if not n} <= {r.doc_id for r in rows}

    docs = spark.createDataFrame([tuple(r) for r in rows], docs.schema)
    three = cp.join_near_duplicates(spark, docs, SF)
    assert three.columns == columns
    rows = three.collect()
    assert {r.doc_id for r in rows} == {i for i, (_, c) in near([(r.doc_id, r.text) for r in docs.collect()]).items() if c == i}

    docs = spark.createDataFrame([tuple(r) for r in rows], docs.schema)
    four = cp.decontaminate_documents(spark, docs, SF)
    assert four.columns == columns
    rows = four.collect()
    assert {r.doc_id for r in rows} == {i for i, w in leaks([(r.doc_id, r.text) for r in docs.collect()], bench, 10).items() if not w[4]}

    docs = spark.createDataFrame([tuple(r) for r in rows], docs.schema)
    five = cp.mix_sources(spark, docs, SF)
    names, want = duck(mixing.oracle(), SF, {"documents": docs.toPandas()})
    assert norm(five.columns, [tuple(r) for r in five.collect()]) == norm(names, want)


def test_whole_run_is_the_stages_in_turn(spark):
    got = cp.run(spark, SF).collect()
    assert len(got) > 20 and len({r.doc_id for r in got}) == len(got)
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontaminate", "mix_sources"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_null_and_repeated_ids_and_clashing_columns(spark):
    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    extra = [(None, "a text without an id that is long enough to have a language", "en", "src0", 1), (base[0][0], "zz later of two texts", "en", "src1", 2), (9001, None, "en", "src0", None), (9002, "", "en", "src0", 0)]
    names = ["lang_pred", "score", "lang_score", "letter", "_letter", "kept", "n", "row", "text_key", "words", "block", "size"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *names) for r in [*base, *extra, base[1]]], schema)
    left = docs
    for name, stage in cp.STAGES[:-1]:
        left = stage(spark, left, SF)
        rows = left.collect()
        assert left.columns == docs.columns, name
        assert len({r.doc_id for r in rows}) == len(rows) and all(r.doc_id is not None and r.text and [r[n] for n in names] == names for r in rows), name
        left = spark.createDataFrame(rows, schema)
        alone = [r.doc_id for r in stage(spark, docs, SF).collect()]  # each stage keeps the rules on its own
        assert len(set(alone)) == len(alone) and None not in alone, name
    assert left.count() > 5
    assert {r.doc_id: r.text for r in left.collect()}[base[0][0]] == min(base[0][1], "zz later of two texts")
    mixed = cp.mix_sources(spark, docs, SF).collect()
    assert len({r.doc_id for r in mixed}) == len(mixed) == 14

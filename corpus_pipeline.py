"""A corpus pipeline over ``documents``: language ID, line dedup, near-duplicate join, benchmark decontamination, mixing.

Each stage takes the documents that its predecessor kept and returns documents with the same columns; the last returns the mix, one
row for each document left with the number of passes in which it is drawn.

Defined results, for every stage: documents are told apart by ``doc_id``, so rows without one go; rows that repeat one count as the one
whose text, then whose other columns sort first, and stay whole. Columns that are not read may have any names and come back as they are. Null
and empty texts have no language and go in the first stage. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.llm import decontaminate, language_id, mixing, ngram_join, units
from statloom.llm.frames import fresh, whole_rows
from statloom.session import materialize

#: A document is rejected when no language can be determined, or when the best one is hardly likelier than a guess among a few: short clean texts stay.
MIN_LANGUAGE_SCORE = 0.3
#: Line templates go from this many documents on, however long: what two or three documents share is left to the near-duplicate join, from
#: which a copy that has already lost its shared lines would be hidden.
TEMPLATE_DOCS = 10


def identify_language(spark, docs, sf_dir):
    """Documents whose language the model is sure enough of; learned from the labels of those not held out."""
    docs = whole_rows(docs)
    names = (fresh(docs, "lang_pred"), fresh(docs, "lang_score"))
    found = language_id.predict(docs, language_id.fit(docs), keep=tuple(docs.columns), names=names)
    return found.filter((F.col(names[0]) != language_id.UNDETERMINED) & (F.col(names[1]) >= MIN_LANGUAGE_SCORE)).select(docs.columns)


def drop_line_templates(spark, docs, sf_dir):
    """Lines whose template recurs go, but for the first document that has it; documents of which nothing is left go too."""
    docs = whole_rows(docs)
    kept = fresh(docs, "kept")
    rebuilt = units.drop_templates(docs, min_docs=TEMPLATE_DOCS, long_docs=TEMPLATE_DOCS).select("doc_id", F.col("kept").alias(kept))
    rebuilt = rebuilt.filter(F.length(F.trim(F.coalesce(kept, F.lit("")))) > 0)
    columns = [F.col(kept).alias("text") if c == "text" else F.length(kept).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return docs.drop("text").join(rebuilt, "doc_id").select(columns)


def join_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates, the one of smallest id."""
    return ngram_join.keep_one(whole_rows(docs))


def decontaminate_documents(spark, docs, sf_dir):
    """Documents in which no window of the benchmark occurs."""
    return decontaminate.clean(whole_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs, sf_dir):
    """The mix: each document's source weight and the passes in which it is drawn."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_line_templates),
    ("ngram_join", join_near_duplicates),
    ("decontaminate", decontaminate_documents),
    ("mix_sources", mix_sources),
]

#: The first stage's classifier has no SQL; the stages are tested one by one against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages in order over documents, each one's result written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs

"""Queries of this subpackage: one for each operator, over its whole table, with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.llm import decontaminate, embed_dedup, language_id, lm_score, mixing, ngram_join, secrets, units, window_dedup
from statloom.llm.frames import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


@query("op5_secret_scan")
def op5_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.find_spans(table(spark, sf_dir, "documents")))


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    return language_id.predict(docs, model).select("doc_id", (~language_id.learned_from("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op3_decontaminate", decontaminate.oracle())
def op3_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


@query("op1_mix_sources", f"SELECT * REPLACE (round(weight, 9) AS weight) FROM ({mixing.oracle()})")
def op1_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 9))


@query("op6_substring_dedup", units.oracle_repeats())
def op6_substring_dedup(spark, sf_dir):
    return units.report(units.drop_repeats(table(spark, sf_dir, "documents")))


@query("op9_line_dedup", units.oracle_templates())
def op9_line_dedup(spark, sf_dir):
    return units.report(units.drop_templates(table(spark, sf_dir, "documents")))


@query("op2_ngram_join", ngram_join.oracle())
def op2_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents")).drop("class_id")


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, sf_dir):
    return window_dedup.report(table(spark, sf_dir, "documents"))


@query("op4_embedding_dedup")
def op4_embedding_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_lm_score")
def op7_lm_score(spark, sf_dir):
    return lm_score.score(table(spark, sf_dir, "documents"))

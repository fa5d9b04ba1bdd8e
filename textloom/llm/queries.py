"""Queries of this subpackage: each operator over its whole table, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from textloom.llm import bpe, chat, decontaminate, katzwords, langid, licenses, linededup, pii, rules, simhash
from textloom.runtime import spread


def _table(spark, sf_dir: str, name: str):
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return langid.identify_documents(_table(spark, sf_dir, "documents")).drop("text_hash")


def language_id_pages(spark, sf_dir):
    """The same operator where markup, suffix and hosts are; the text model is that of ``documents``."""
    model = langid.fit_text_model(_table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return langid.identify_pages(_table(spark, sf_dir, "pages"), model).drop("text_hash")


def op3_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"), report=True, whole=True)


def op5_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_katz_lm_scoring(spark, sf_dir):
    return katzwords.fit_and_score(_table(spark, sf_dir, "documents"))


def op7_pii_sanitisation(spark, sf_dir):
    return pii.sanitise(_table(spark, sf_dir, "documents"))


def op8_bpe_encode_decode(spark, sf_dir):
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return rules.quality(_table(spark, sf_dir, "documents"))


def op10_chat_perspectives(spark, sf_dir):
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_language_id,
        op3_benchmark_decontamination,
        op4_line_dedup,
        op5_license_scan,
        op6_katz_lm_scoring,
        op7_pii_sanitisation,
        op8_bpe_encode_decode,
        op9_quality_rules,
        op10_chat_perspectives,
        language_id_pages,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {
    "op5_license_scan": licenses.oracle(),
    "op9_quality_rules": rules.oracle(),
    "op10_chat_perspectives": chat.ORACLE,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

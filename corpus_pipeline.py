"""The corpus pipeline: STAGES over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, decontaminate, langid, linededup, simhash
from textloom.runtime import drop_path, drop_written_since, new_table_path, written_so_far


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null, empty and letterless ones that their source says nothing about,
    and noise. Repeated rows go together; an empty table stays empty; columns of any name are kept."""
    return langid.drop_rejected(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stand in an earlier document are cut out; every document stays.

    Null and empty texts stay as they are, very long ones are cut like others, rows that repeat id and text alike.
    ``n_chars`` is the new length; columns of any name are kept; an empty table stays empty.
    """
    return linededup.dedup_lines(docs, whole=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays.

    Documents are near-duplicates by their texts as they are, or as they were in ``documents`` before lines were cut
    out of them; so copies that differ in some lines are found though only these lines are left of them. Equal texts
    without words, such as copies that line dedup emptied, are a group too. The smallest id stays; rows without id or
    text stay; of rows that repeat an id one stays. Columns of any name are kept; an empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs, wordless=True, originals=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, with all rows that repeat their id and text.

    Null and empty texts stay, very long ones are searched whole; columns of any name are kept; an empty table stays
    empty.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) of the documents that are left, one row each.

    A null text has null results, an empty one no tokens, a very long one all of its tokens; repeated rows and null
    ids stay; other columns are left behind; an empty table gives an empty one.
    """
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``.

    What a stage has written for itself is deleted when its result is written, and that when the next one's is; the
    last stage's input stays, as its result is not written here.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_table_path(spark, f"pipeline-{name}")
        mark = written_so_far()
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_written_since(spark, mark)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, alignments and merges by rank can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None

"""From raw documents to token files: the stages in order, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainloom.llm import decontam, mixing, near_dup, quality, token_store
from chainloom.llm.runtime import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or that the isolation forest rejects go. A null or empty text has no words and goes;
    of repeated rows all stay or go alike; very long texts are read whole; an empty table stays empty; further
    columns stay, whatever their names."""
    return quality.kept_rows(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id. Rows with a null doc_id stay; texts
    without words are like no other and stay; of rows with equal id and text one stays; an empty table stays
    empty; further columns stay, whatever their names."""
    return near_dup.kept_rows(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item go. A null or empty text covers nothing and stays; rows with equal or null ids
    are judged by their own texts; without items all stay; an empty table stays empty; further columns
    stay, whatever their names."""
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, from never to three times. A null source is a source, last in order; a null
    or empty text has no words, and stays as often as its source's order says; repeated rows count each; an empty
    table stays empty; further columns stay, whatever their names."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture as token files, read back: doc_id, start, n_tokens, ids_crc32. A null or empty text is the end id alone; null ids
    come first; rows with one id stand next to each other; a text longer than a chunk is a chunk of its own;
    an empty table gives no rows; other columns are not read."""
    return token_store.token_output(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix_sources),
    ("token output", token_output),
]

#: The forest's verdict and the tokenizer are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage before it is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

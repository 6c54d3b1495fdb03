"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, source mixture, token files.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; it is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``. Tables may be empty and any column
may hold nulls: each stage does what its operator documents. Rows are told apart by doc_id and text: of rows that share an id
each is judged by its own text. A row with a null doc_id is never dropped as a duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import contamination, jaccard_join, mixture, quality, token_files
from spanloom.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust distance reject go."""
    return quality.quality_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or linked documents, the one with the smallest doc_id (and text hash, on ties) stays."""
    return jaccard_join.first_of_groups(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return contamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document taken more than once is as many rows."""
    return mixture.mixed_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what is read back from them."""
    from spanloom.llm.queries import tokenizer_path

    folder, _ = token_files.write_tokens(docs, tokenizer_path())
    return token_files.read_tokens(spark, folder)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_to_weights),
    ("token-ID / binary output", token_output),
]

#: SQL cannot express the robust fit, the cube method and the tokenizer. The tests hold each stage against brute force: verdicts
#: by least determinants, pairs of shingle sets, items in texts, totals of the mix, ids by the tokenizer on whole texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)

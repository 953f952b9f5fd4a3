"""From raw documents to a training mix, in stages that each apply one operator to all that the last
one kept: language identification, near duplicates, benchmark decontamination, secrets, mixing.

Every stage but the last returns the columns of ``documents``; the last returns what the mix takes:
doc_id, size, source_size, target, taken and source of every document of which words are taken.
Between stages the documents are written as Parquet to the shared folder and read again.

Defined results: a null text and a text without letters go in the first stage; rows with a null id stay
apart from all others and are neither copies nor leaks, but are masked and mixed; of rows that repeat an
id one stays; very long texts are worked on whole; a null source is a source of its own; an empty table
gives an empty result; columns beside those of ``documents`` are carried along to the mix, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlens.llm.decontaminate import decontaminate
from emberlens.llm.jaccard_join import one_of_each
from emberlens.llm.language_id import keep_identified
from emberlens.llm.mixing import mix
from emberlens.llm.secret_ledger import redact_documents
from emberlens.session import ship_package, table, write_table


#: Near copies of the stage: shingles of so many words, similar from so many hundredths on.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told go; of the others a null ``lang`` becomes the one found."""
    ship_package(spark)
    return keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar shingle sets the document with the smallest id stays."""
    ship_package(spark)
    return one_of_each(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes nothing of go; the others come with what it takes."""
    return mix(docs, table(spark, sf_dir, "labels")).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]

#: The first stage isn't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

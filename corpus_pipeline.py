"""Corpus pipeline: quality rules, near duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next stage's docs; all but the last return the columns of
documents. Stages judge their own input: later stages count over what earlier ones kept.
A stage's input is deleted once its output is written; the last stage reads its own files.

Defined cases: null, empty and short texts fail the quality rules and go; of rows that link
(also rows repeated or without a doc_id) one stays; rows that hold a benchmark item go;
repeated rows share the passes of their group; a null doc_id sorts first in the output; an
empty table gives no rows at any stage; columns beside those of documents are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlens.llm.common import forget, table, written
from runlens.llm.decontamination import decontaminated
from runlens.llm.jaccard_join import one_of_each
from runlens.llm.mixing import mixed_documents
from runlens.llm.quality import kept_documents
from runlens.llm.queries import tokenizer_path
from runlens.llm.token_output import read_documents, write_tokens


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return read_documents(spark, write_tokens(docs, tokenizer_path()))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID output", token_stage),
]

#: The hashed model, the similarity join and the tokenizer are beyond SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage")
        forget(before)  # deletes only work tables, never the documents
    out = STAGES[-1][1](spark, docs, sf_dir)
    forget(docs)
    return out

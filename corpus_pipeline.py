"""A training corpus from raw documents: five stages over the ``documents`` table.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; ``run`` writes every stage's result to the shared folder and reads it back.
Stages that run in Python bound the session's Arrow batches (``bound_batches``).
All stages but the last return the columns of ``documents``; the last adds the
token ids and the text decoded from them.

Defined results: rows with a null or letterless text go at the first stage; rows
with a null id pass the near-duplicate stage; an empty table gives an empty table;
extra columns of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brambleq.llm import bpe, decontaminate, language_id, line_dedup, simhash
from brambleq.llm._common import bound_batches, materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told."""
    bound_batches(spark)
    network = language_id.train(language_id.training_rows(docs.select("doc_id", "text", "lang")))
    return language_id.keep(docs, network)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that stand on many sites."""
    return line_dedup.clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (shingles of five words)."""
    bound_batches(spark)
    return simhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of the benchmark, and drop documents made mostly of them."""
    bound_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add ``ids`` and ``decoded``."""
    bound_batches(spark)
    return bpe.round_trip(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_boilerplate),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("BPE encoding and decoding", tokenise),
]

#: SQL cannot express the network of the first stage or the merges of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus from raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept
and returns documents, the last one the digest of the token files. Null texts, ids,
languages and sources, repeated rows, empty tables and further columns are treated
as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martlet.llm import decontaminate, language, minhash, mixing, token_files
from martlet.llm.common import saved, table
from martlet.llm.queries import MIX, WORD_BPE


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells; the others go."""
    return language.keep_identified(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return mixing.take(docs, MIX)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; returns doc_id, start, n_tokens, ids_crc32 of each text in them."""
    return token_files.encode_to_orc(docs, WORD_BPE)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: Compression, darts and byte pairs have no SQL form. The tests hold the stages near_duplicates, decontaminate and tokens
#: against brute force; language and mix are tested as operators (held-out accuracy, SQL), not as stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

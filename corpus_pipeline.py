"""Cleaning of a training corpus: five operators of campuslens.llm in a row.

Every stage reads all documents that the stage before kept, and all
stages but the last return the columns of ``documents``.

Defined cases: a document with a null, empty or blank text has no language
and goes in the first stage; repeated rows are one near-duplicate class, of
which one row stays; rows that share an id are documents of their own;
very long texts pass whole; an empty table gives an empty result; extra
columns are kept to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campuslens.llm import bpe, langid, minhash, paragraphs
from campuslens.llm import decontaminate as benchmark
from campuslens.llm.common import forget, read_table, saved


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language; the model learns from the labelled ones."""
    return langid.accepted(docs, langid.learn(langid.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (the one with the smallest id)."""
    return minhash.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs and passages that an earlier one has; ``n_chars`` follows
    the text, and a document of which nothing is left goes."""
    kept = paragraphs.without_duplicates(docs)
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns by place: they may be called anything
    text = F.col(names[docs.columns.index("text")])
    gone = F.col("gone.bytes") > 0
    left = kept.toDF(*names, "gone").where(~gone | (F.trim(text) != ""))
    return left.select(*(F.when(gone, F.length(text).cast("long")).otherwise(F.col(n)).alias(c) if c == "n_chars" else F.col(n).alias(c)
                         for n, c in zip(names, docs.columns, strict=True)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window of 10 words."""
    return benchmark.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings),
          ("decontaminate", decontaminate), ("tokens", tokens)]

#: SQL expresses neither the language model nor the banding nor BPE; tests/llm holds the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(spark)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Registered queries of the operators, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import ann as _ann
from . import bpe as _bpe
from . import conversations as _conversations
from . import decontaminate as _decontaminate
from . import langid as _langid
from . import minhash as _minhash
from . import paragraphs as _paragraphs
from . import phrases as _phrases
from . import quality as _quality
from . import substrings as _substrings
from . import tokencounts as _tokencounts
from . import tokenids as _tokenids
from . import urlfilter as _urlfilter
from ..session import scratch_path
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


@query("op8_decontaminate", _decontaminate.ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows of 10 words in every document."""
    out = _decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the ranks of a byte-level BPE, and the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = _bpe.encode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return _bpe.decode(ids, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the rows outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = _langid.learn(_langid.training_rows(docs.where(~held_out)))
    return _langid.predict(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")  # a null id is in neither fold


#: Verdict, host and path of the rules.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@query("op1_url_filter")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: by rule, else by the ratio of two character models."""
    judged = _urlfilter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "llr", "threshold")


@query("op5_nearest_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for every vector whose id is divisible by 50."""
    return _ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op2_minhash_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document (probability Jaccard of 5-word shingles, 0.8 or more)."""
    return _minhash.near_duplicates(read_table(spark, sf_dir, "documents")).drop("key")


@query("op6_paragraph_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the paragraphs and passages that an earlier one has."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = _paragraphs.without_duplicates(docs)
    return kept.select(
        "doc_id", F.coalesce(F.octet_length("text") + F.col("removed.bytes"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("removed.bytes").alias("n_removed"), F.col("removed.spans").alias("n_spans"),
        F.col("removed.first_docs").alias("first_doc_ids"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op3_importance_resampling")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight, and whether it is drawn; as many are as the labels call good."""
    labels = read_table(spark, sf_dir, "labels")
    share = labels.agg(F.avg("quality")).first()[0]
    return _quality.resample(read_table(spark, sf_dir, "documents"), labels.where("quality = 1").select("doc_id"),
                             1.0 if share is None else share)


@query("op7_substring_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes in 50-byte strings of earlier documents."""
    return _substrings.without_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_token_ids")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as range-coded records in order of doc_id and read back."""
    path = scratch_path(spark, "llm-token-ids")
    _tokenids.write_ids(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2,
                        cut_at_blanks=True)
    return _tokenids.with_crc32(_tokenids.read_ids(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


#: Tokens of a document beyond which it is over the limit.
TOKEN_LIMIT = 1024


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over the limit."""
    found = _tokencounts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` damaged by a hash of conversation and turn: dropped, emptied, cut off, repeated or of another role."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), blank) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    return conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy")


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation."""
    table = read_table(spark, sf_dir, "conversations")
    fixed = _conversations.repair(damaged(table))
    hashes = _conversations.digests(fixed.turns).select(F.col("conv_id").alias("d"), "sha256")
    verdicts = fixed.verdicts.withColumnRenamed("conv_id", "v")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    every = table.select("conv_id").distinct()
    return (every.join(verdicts, F.col("conv_id").eqNullSafe(F.col("v")), "left")
            .join(hashes, F.col("conv_id").eqNullSafe(F.col("d")), "left")
            .select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha256", F.lit(_conversations.EMPTY_SHA256)).alias("repaired_sha256")))


@query("op11_phrase_collocations", _phrases.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of 2 to 4 words in each language."""
    return _phrases.collocations(_phrases.frequent_phrases(read_table(spark, sf_dir, "documents")))

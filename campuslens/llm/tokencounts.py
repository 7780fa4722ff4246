"""Number of tokens of every text, without a shuffle of pre-tokens.

The length of a byte-level BPE text is the sum of the lengths of its
pre-tokens, and most occurrences are of few different pre-tokens.  So
lengths are looked up where the text is, in two tiers:

1. a compact table of the corpus's frequent pre-tokens, broadcast.  A
   first pass over all texts counts pre-tokens in every task, in a counter
   of bounded size; each task hands on its ``FREQUENT`` most frequent, and
   the best ``FREQUENT`` of their sums make the table: one block of UTF-8
   bytes, the end of each pre-token in it, and its length in tokens.  The
   bound holds at any size of the corpus.
2. what is not in it goes to the library, the different ones of a batch at
   once, and stays in a cache of the Python worker: two generations of
   ``CACHE`` entries, the older of which goes when the newer is full.

Both tiers hold lengths given by the library, so they decide the time
taken and never a count.  Only the tasks' bounded summaries are shuffled;
texts and their pre-tokens are not.

A text is first cut at the strings of the tokenizer's added tokens (each
is one token, as the library counts by default), then long stretches at a
blank between two word characters (a pre-token always starts there), so
that a very long text is worked on in pieces of about ``STRETCH``
characters.  Stretches of characters below U+0250 (but for the few white
space characters on which libraries differ) are split by a pattern of
explicit character ranges; all others by the tokenizer's own pre-tokenizer.

Defined cases: a null or empty text has no bytes and no tokens; each row
is counted on its own, so repeated rows give repeated results and a null
id is kept; very long texts are counted whole; there is nothing to tie
(equal counts at the end of the frequent table are taken in order of the
pre-token); an empty table gives an empty result; columns other than the
id and the text are ignored, whatever their names.  Tokenizers whose
definition has a normalizer, another pre-tokenizer than byte level with
the pattern of that pre-tokenizer, or an added token that takes in the
white space around it, are refused.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import portions

FREQUENT = 32_768  #: pre-tokens in the broadcast table, and in the summary of a task
COUNTED = 8 * FREQUENT  #: different pre-tokens that a task counts before it lets the rarest go
CACHE = 200_000  #: entries of a generation of a worker's cache
STRETCH = 1 << 16  #: characters matched at once
LONGEST = 256  #: characters of a pre-token that is counted or cached
TOGETHER = 20_000  #: misses encoded in one call

_BLANK = re.compile(r"(?<=\w) (?=\w)")
_LIMIT = 0x250  #: characters below it are split by the pattern of explicit ranges
_PLAIN = re.compile(f"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-{chr(_LIMIT - 1)}]*")


def _ranges(kind: str) -> str:
    """The characters below ``_LIMIT`` of one kind (``L`` letters, ``N`` numbers), for a character class."""
    found = [c for c in range(_LIMIT) if unicodedata.category(chr(c))[0] == kind]
    return "".join(re.escape(chr(c)) for c in found)


@lru_cache(maxsize=1)
def _pattern() -> re.Pattern[str]:
    letters, numbers = _ranges("L"), _ranges("N")
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+")


class Counting:
    """The tokenizer, how it splits texts, and the worker's cache of lengths."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        told = json.loads(definition)
        split = told.get("pre_tokenizer") or {}
        if told.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("not a byte-level tokenizer with the byte-level pattern and without a normalizer")
        added = told.get("added_tokens") or []
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError("an added token that takes in what is beside it")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.own = Tokenizer.from_str(definition)
        self.own.no_truncation()
        self.own.no_padding()
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.table: dict[str, int] = {}
        self.source: object = None

    def stretches(self, text: str) -> tuple[list[str], int]:
        """The text without its added tokens, in stretches that can be split apart; and the number of added tokens."""
        parts = self.special.split(text) if self.special else [text]
        out = []
        for part in parts:
            at = 0
            while len(part) - at > STRETCH:
                cut = _BLANK.search(part, at + STRETCH)
                if cut is None:
                    break
                out.append(part[at:cut.start()])
                at = cut.start()
            out.append(part[at:])
        return out, len(parts) - 1

    def split(self, stretch: str) -> list[str]:
        """The pre-tokens of a stretch."""
        if _PLAIN.fullmatch(stretch):
            return _pattern().findall(stretch)
        return [stretch[a:b] for _, (a, b) in self.own.pre_tokenizer.pre_tokenize_str(stretch)]

    def pretokens(self, text: str) -> tuple[Iterator[list[str]], int]:
        parts, special = self.stretches(text)
        return map(self.split, parts), special

    def lengths(self, wanted: list[str]) -> dict[str, int]:
        """The lengths of different pre-tokens, by the cache and then the library."""
        found, missing = {}, []
        for t in wanted:
            n = self.new.get(t) or self.old.get(t)
            if n:
                found[t] = n
            else:
                missing.append(t)
        for i in range(0, len(missing), TOGETHER):
            some = missing[i:i + TOGETHER]
            fresh = {t: len(e.ids) for t, e in zip(some, self.own.encode_batch_fast(some, add_special_tokens=False), strict=True)}
            found |= fresh
            self.new |= {t: n for t, n in fresh.items() if len(t) <= LONGEST}
            if len(self.new) > CACHE:
                self.old, self.new = self.new, {}
        return found

    def use(self, table: tuple[bytes, bytes, bytes]) -> None:
        """Take the broadcast table as first tier."""
        if self.source is not table:
            block, ends, sizes = table
            ends = np.frombuffer(ends, "<u4").tolist()
            self.table = {block[a:b].decode(): n for a, b, n in
                          zip([0, *ends], ends, np.frombuffer(sizes, "<u2").tolist())}
            self.source = table

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text."""
        known, out, late = self.table.get, [], []
        for i, text in enumerate(texts):
            total = 0
            if text:
                parts, total = self.pretokens(text)
                for tokens in parts:
                    sizes = list(map(known, tokens))
                    if None in sizes:
                        late.append((i, [t for t, n in zip(tokens, sizes) if n is None]))
                        total += sum(filter(None, sizes))
                    else:
                        total += sum(sizes)
            out.append(total)
        get = self.lengths(list(set(chain.from_iterable(m for _, m in late)))).__getitem__
        for i, tokens in late:
            out[i] += sum(map(get, tokens))
        return out




@lru_cache(maxsize=1)
def counting(definition: str) -> Counting:
    """One for each Python worker, so its cache lives from task to task."""
    return Counting(definition)


def frequent(docs: DataFrame, shared: Broadcast[str], text_col: str = "text") -> DataFrame:
    """``token`` and ``n``: the ``FREQUENT`` most frequent pre-tokens of all texts, as the tasks' bounded counters hold them."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = counting(shared.value), Counter()
        for b in portions(stream, 0):
            for text in b.column(0).to_pylist():
                if text:
                    for tokens in own.pretokens(text)[0]:
                        seen.update(tokens if max(map(len, tokens), default=0) <= LONGEST else
                                    [t for t in tokens if len(t) <= LONGEST])
                        if len(seen) > COUNTED:
                            seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = seen.most_common(FREQUENT)
        if top:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                                             ["token", "n"])

    seen = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token string, n long")
    return seen.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT)


def packed(lengths: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    """The compact table: bytes of the pre-tokens, where each ends, and its length.  Lengths beyond 16 bits are left to the second tier."""
    kept = {t.encode(): n for t, n in lengths.items() if n < 1 << 16}
    return (b"".join(kept), np.array(list(accumulate(map(len, kept))), "<u4").tobytes(),
            np.array(list(kept.values()), "<u2").tobytes())


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row, as the library gives them without
    added special tokens, truncation or padding."""
    context = docs.sparkSession.sparkContext
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    own, shared = counting(definition), context.broadcast(definition)
    top = [r["token"] for r in frequent(docs, shared, text_col).collect()]
    table = context.broadcast(packed(own.lengths(top)))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counting(shared.value)
        own.use(table.value)
        for b in portions(stream, 1):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(own.counts(b.column(1).to_pylist()), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), size.alias("n_bytes"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")

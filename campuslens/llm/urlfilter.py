"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule decides train two smoothed variable-order Markov models
over bytes, one of allowed and one of blocked URLs.  The probability of a
byte is interpolated (Witten-Bell) over contexts of 0 to ``ORDER`` bytes;
a context seen fewer than ``MIN_CONTEXT`` times is passed over, so the
order varies with the evidence.  A URL's score is the difference of the
two log-likelihoods per byte of host and path; the threshold is the one
of best balanced accuracy on a calibration fold (a fifth of the decided
URLs, by a hash of the URL) that the models have not seen.  With
the threshold set, the models that judge count all decided URLs.

The counts are a table keyed by class, order, context and byte, which
grows with the URLs; nothing is hashed or cut.  A byte's share of the
score depends on the ``ORDER`` bytes before it only, so the distinct
(context, byte) pairs of the URLs are joined to the counts, and the URLs
to the pairs.  Tables of at most ``MAX_BROADCAST_ROWS`` rows are
broadcast, others join by a shuffle.  Shares are summed as whole
multiples of 2^-40, so the order of the rows doesn't matter.

Defined cases: a null URL, or one without ``://``, has an empty host and
path, fits no rule and scores 0; with no decided URL of a class its model
is uniform; with an empty calibration fold the threshold is 0; equal best
thresholds go to the one nearest 0; repeated rows are each judged and
each count; columns other than the id and the URL are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, batches, bounded_broadcast, saved

ORDER = 4
SYMBOLS = 257  #: bytes and 256, before the start
MIN_CONTEXT = 4
MAX_RULES = 1000
MAX_BROADCAST_ROWS = 500_000
UNIT = 2.0 ** -40
BINS = 256  #: calibration scores are binned to 1/BINS nat

ALLOW, BLOCK = "allow", "block"

Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits; nulls if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule = verdict = F.when(F.lit(False), "")
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = rule.when(fits, h + p), verdict.when(fits, v)
    return rule, verdict


def _contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all bytes of all texts: their text's number, the byte, and the context of ``ORDER`` bytes as
    a number in base ``SYMBOLS``, whose last k digits are the context of k bytes."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    context = np.zeros(len(flat), np.int64)
    for k in range(1, ORDER + 1):
        back = np.zeros(len(flat), np.int64)
        back[k:] = flat[:-k] if k < len(flat) else back[k:]
        context += np.where(place >= k, back, SYMBOLS - 1) * SYMBOLS ** (k - 1)
    return owner, flat, context


def learn(labelled: DataFrame) -> DataFrame:
    """Counts from rows of ``text`` (binary) and ``good`` (boolean): how often each ``byte`` follows each
    ``context`` of ``k`` bytes in URLs of either class (``good`` and ``bad``)."""
    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, 20_000):
            texts, good = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            owner, byte, context = _contexts(texts)
            for k in range(ORDER + 1):
                key, n = np.unique((context % SYMBOLS ** k * 256 + byte) * 2 + good[owner], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), k, np.int32)), pa.array(key // 512), pa.array(key // 2 % 256),
                     pa.array(np.where(key % 2 == 1, n, 0)), pa.array(np.where(key % 2 == 0, n, 0))],
                    ["k", "context", "byte", "good", "bad"])

    parts = labelled.select("text", "good").mapInArrow(count, "k int, context long, byte long, good long, bad long")
    return saved(parts.groupBy("k", "context", "byte").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-counts")


def _shares(pairs: DataFrame, model: DataFrame) -> DataFrame:
    """``pairs`` (``context`` of ``ORDER`` bytes and ``byte``) with ``share``: the log of the ratio of the
    byte's probabilities in the two models, in multiples of ``UNIT``."""
    size = {r["k"]: r["count"] for r in model.groupBy("k").count().collect()}
    out = pairs.withColumns({"p_good": F.lit(1 / 256), "p_bad": F.lit(1 / 256)})
    for k in range(ORDER + 1):
        seen = model.where(F.col("k") == k).select(F.col("context").alias("at"), "byte", "good", "bad")
        contexts = seen.groupBy("at").agg(*(x for c in ("good", "bad") for x in (
            F.sum(c).alias(f"n_{c}"), F.count_if(F.col(c) > 0).alias(f"types_{c}"))))
        if size.get(k, 0) <= MAX_BROADCAST_ROWS:
            seen, contexts = F.broadcast(seen), F.broadcast(contexts)
        out = out.withColumn("at", F.col("context") % SYMBOLS ** k).join(contexts, "at", "left").join(seen, ["at", "byte"], "left")
        p = {f"p_{c}": F.when(F.col(f"n_{c}") >= MIN_CONTEXT, (F.coalesce(c, F.lit(0)) + F.col(f"types_{c}") * F.col(f"p_{c}")) / (
            F.col(f"n_{c}") + F.col(f"types_{c}"))).otherwise(F.col(f"p_{c}")) for c in ("good", "bad")}
        out = out.select("context", "byte", *(x.alias(c) for c, x in p.items()))
    return out.select("context", "byte", F.round((F.log("p_good") - F.log("p_bad")) / UNIT).cast("long").alias("share"))


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """The columns of ``urls`` (one is ``text``, binary) and ``llr``: the log-likelihood under the good model
    less that under the bad one, per byte; 0 for no bytes."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, 5_000):
            owner, byte, context = _contexts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(context), pa.array(byte)],
                                             ["id", "context", "byte"])

    def pair(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, 20_000):
            _, byte, context = _contexts(b.column(0).to_pylist())
            key = np.unique(context * 256 + byte)
            yield pa.RecordBatch.from_arrays([pa.array(key // 256), pa.array(key % 256)], ["context", "byte"])

    texts = saved(urls.select("text").distinct().select(F.md5("text").alias("id"), "text"), "url-texts")
    pairs = texts.select("text").mapInArrow(pair, "context long, byte long").distinct()
    shares = bounded_broadcast(saved(_shares(pairs, model), "url-shares"), MAX_BROADCAST_ROWS)
    total = texts.mapInArrow(run, "id string, context long, byte long").join(shares, ["context", "byte"]).groupBy("id").agg(
        F.sum("share").alias("total"))
    both = urls.select(F.struct("*").alias("row"), F.md5("text").alias("id")).join(total, "id", "left")
    length = F.greatest(F.octet_length("row.text"), F.lit(1))
    return both.select("row.*", (F.coalesce("total", F.lit(0)) * UNIT / length).alias("llr"))


def log_ratio(texts: list[bytes], model: DataFrame) -> np.ndarray:
    """``llr`` of each text."""
    rows = score(model.sparkSession.createDataFrame(list(enumerate(texts)), "i long, text binary"), model).collect()
    return np.array([r["llr"] for r in sorted(rows, key=lambda r: r["i"])])


def threshold(scored: DataFrame) -> float:
    """The ``llr`` from which on a URL is allowed, of best balanced accuracy on rows of ``good`` and ``llr``."""
    bins = scored.groupBy(F.floor(F.col("llr") * BINS).alias("bin")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("bin").collect()
    good, bad = sum(r["good"] for r in bins), sum(r["bad"] for r in bins)
    if not good or not bad:
        return 0.0
    best, allowed, blocked = [], good, 0
    for r in bins:  # the threshold at the lower edge of each bin
        best.append((-(allowed / good + blocked / bad), abs(r["bin"]), r["bin"]))
        allowed, blocked = allowed - r["good"], blocked + r["bad"]
    return min(best)[2] / BINS


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``llr``, ``threshold`` and ``verdict`` of every row."""
    host, path = host_and_path(F.col(url_col))
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, decided = longest_rule(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "decided": decided,
                           "text": F.concat("host", "path").cast("binary")})
    labelled = own.where("decided IS NOT NULL").select("text", (F.col("decided") == ALLOW).alias("good"))
    held = F.crc32("text") % 5 == 0
    model = learn(labelled.where(~held))
    at = threshold(score(labelled.where(held), model))
    scored = score(own, learn(labelled)).withColumn("threshold", F.lit(at))
    by_method = F.when(F.col("llr") >= at, ALLOW).otherwise(BLOCK)
    return scored.select("page_id", "host", "path", "rule", "llr", "threshold",
                         F.coalesce("decided", by_method).alias("verdict"))

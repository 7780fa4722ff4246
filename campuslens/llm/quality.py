"""Quality selection by importance resampling.

Texts are bags of hashed token n-grams (tokens are runs of word
characters or of other signs, in their own case; n = 1 and 2).  Two
generative models, of the target texts and of all (raw) texts, are the
smoothed frequencies of ``BUCKETS`` hash buckets.  A text's log weight is
the log ratio of its probabilities in the two models.  Adding Gumbel noise
to the log weights and keeping the k largest draws k texts without
replacement with probability in proportion to their weights.

The raw model counts every document.  The target model counts at most
``MAX_TARGET`` target documents, chosen by a hash of the id, so their ids
can be broadcast.  Both models have a fixed size.  The k-th largest key is
found by narrowing histograms, and no order over all rows is made.

Defined cases: null and empty texts have weight 0 (log) and take part; k
is the share times the number of rows, rounded; equal keys go to the
smaller id (a null id first), and of equal rows any; without target rows
both models are the same and the draw is uniform; an empty table gives an
empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .shingles import mix, portions, text_bytes

BUCKETS = 1 << 16
MAX_TARGET = 20_000
SMOOTH = 1.0
BINS = 4096
LAST = 4096  #: rows of the last bin that are put in order

_rng = np.random.default_rng(20240307)
_VALUES = _rng.integers(1, 1 << 63, 256, np.uint64)
_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 word, 2 other signs
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_POWERS = 1 << 16
_PW = np.cumprod(np.append(np.uint64(1), np.full(_POWERS - 1, 0x9E3779B97F4A7C15, np.uint64)))


def grams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every token and every pair of neighbouring tokens."""
    kind = _KIND[data]
    start = kind > 0
    start[1:] &= kind[1:] != kind[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    start[first] = kind[first] > 0
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(at[0], len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))
    value = np.where(kind[at[0]:] > 0, _VALUES[data[at[0]:]] * _PW[place & (_POWERS - 1)], np.uint64(0))
    token = mix(np.add.reduceat(value, at - at[0]))
    row = np.searchsorted(ends, at, "right") - 1
    pair = row[1:] == row[:-1]
    both = mix(token[:-1][pair] * np.uint64(0xD6E8FEB86659FD93) + token[1:][pair])
    bucket = np.concatenate([token, both]) % np.uint64(BUCKETS)
    return bucket.astype(np.int64), np.concatenate([row, row[1:][pair]])


def learn(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """The log ratio of the target and the raw model, for each bucket."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = own.join(F.broadcast(targets.withColumn("target", F.lit(True))), "id", "left").select(
        "text", F.coalesce("target", F.lit(False)).alias("target"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in portions(stream, 0):
            bucket, row = grams(*text_bytes(b.column(0)))
            good = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[row]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    counts = own.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # at most BUCKETS rows
    models = []
    for name in ("target", "raw"):
        c = np.full(BUCKETS, SMOOTH)
        c[counts.column("bucket").to_numpy()] += counts.column(name).to_numpy()
        models.append(c)
    if models[0].sum() == SMOOTH * BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(models[0] / models[0].sum()) - np.log(models[1] / models[1].sum())


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``log_weight`` and ``gumbel_key`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                         F.xxhash64(F.lit(seed), id_col, text_col).alias("noise"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(stream, 1):
            bucket, row = grams(*text_bytes(b.column(1)))
            weight = np.bincount(row, shared.value[bucket], b.num_rows).astype(float)
            even = (mix(b.column(2).to_numpy().view(np.uint64)) >> np.uint64(11)).astype(float) + 0.5
            gumbel = -np.log(-np.log(even * 2.0 ** -53))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weight), pa.array(weight + gumbel)],
                                             ["doc_id", "log_weight", "gumbel_key"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, log_weight double, gumbel_key double")


def with_top_k(rows: DataFrame, key: str, k: int, order: list) -> DataFrame:
    """``rows`` (stored ones) and ``kept``: whether the row is one of the k of largest ``key``; equal keys by ``order``."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    total = rows.count()
    if k <= 0 or k >= total:
        return rows.withColumn("kept", F.lit(k > 0))
    need, inside, value = k, F.lit(True), F.col(key)
    while True:
        part = F.least(F.floor((value - low) / (high - low) * BINS), F.lit(BINS - 1)) if high > low else F.lit(0)
        bins = rows.where(inside).groupBy(part.alias("bin")).agg(
            F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.desc("bin")).collect()
        for r in bins:
            if r["n"] >= need:
                break
            need -= r["n"]
        low, high, size = r["low"], r["high"], r["n"]
        inside = (value >= low) & (value <= high)
        if size <= LAST or low == high:
            break
    rank = F.row_number().over(Window.partitionBy("edge").orderBy(F.desc(key), *order))
    sure = rows.where(~inside).withColumn("kept", value > high)
    edge = rows.where(inside).withColumn("edge", F.lit(1)).withColumn("kept", rank <= need).drop("edge")
    return sure.union(edge)


def resample(docs: DataFrame, targets: DataFrame, share: float, seed: int = 17, id_col: str = "doc_id",
             text_col: str = "text", max_target: int = MAX_TARGET) -> DataFrame:
    """``doc_id``, ``log_weight``, ``gumbel_key`` and ``kept`` of every row; ``targets`` has the ids (its
    first column) of the target documents, ``share`` is the share of rows to keep."""
    ids = targets.select(F.col(targets.columns[0]).alias("id")).where("id IS NOT NULL").distinct()
    ids = saved(ids.orderBy(F.xxhash64("id"), "id").limit(max_target), "targets")
    rows = saved(weigh(docs, learn(docs, ids, id_col, text_col), seed, id_col, text_col), "weights")
    return with_top_k(rows, "gumbel_key", round(share * rows.count()), ["doc_id"])

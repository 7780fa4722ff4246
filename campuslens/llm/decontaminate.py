"""Benchmark decontamination: a broadcast hash set of test n-grams.

Only DataFrame and SQL functions are used.

A *window* is ``n`` consecutive words of a benchmark item; an item of
fewer words (but not none) is one window.  Every occurrence of a window
in a document marks its words as hit.

1.  Any occurrence of an L-word window covers an *aligned* g-word gram of
    the document, where g = ceil(L/2) and grams start at every
    (L-g+1)-th word.  So one scan hashes only the aligned grams of each
    document (a sixth of all positions for L=10) and looks them up in the
    broadcast set of all g-grams of the benchmark.
2.  Documents with a hit, usually few, are read again with every window
    position and joined on (hash, window text), which verifies each hit.

The gram set and window table have a checked row bound
(``max_broadcast_rows``); beyond it the same joins run as shuffle joins.

Defined cases: a null or empty text has no words; a null benchmark text
gives no window; an item with a null id still marks words but is not
counted in ``n_items``; item rows that share an id are one item; repeated
document rows are judged separately and each returns a row; an empty
benchmark leaves every document clean; columns other than the id and the
text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, LOWER, UPPER, bounded_broadcast, normal_words, row_key, saved

MAX_BROADCAST_ROWS = 2_000_000


def _plan(length: int) -> tuple[int, int]:
    """(gram size, stride) with which every run of ``length`` words holds an aligned gram."""
    gram = (length + 1) // 2
    return gram, length - gram + 1


def _grams(words, size: int, stride: int):
    """Hashes of the ``size``-grams that start at words 1, 1+stride, ..."""
    last = F.size(words) - size + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last, F.lit(stride)))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size)))


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """Distinct windows: ``length``, ``window`` (words joined by a space), ``hash``, ``items``."""
    items = benchmark.select(F.col(id_col).alias("item"), normal_words(F.col(text_col)).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(n)))
    one = items.select("item", "length", F.explode(F.expr(
        "transform(sequence(1, size(w) - length + 1), i -> slice(w, i, length))")).alias("words"))
    return (one.groupBy("length", F.array_join("words", " ").alias("window"), F.xxhash64("words").alias("hash"))
            .agg(F.collect_set(F.col("item").cast("string")).alias("items")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One row per document row: ``doc_id``, ``key`` (of the row's content), ``n_words``,
    ``n_hit``, ``n_items``, ``items`` (sorted text ids), ``hit_spans`` (maximal runs of hit
    words as [first, last] word numbers from 0) and ``contaminated``."""
    windows = saved(benchmark_windows(benchmark, n, item_col, item_text_col), "windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most n values
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = base.withColumn("key", row_key(F.col("doc_id"), F.col("text")))

    # 1. aligned grams against the broadcast set
    sets = [windows.where(F.col("length") == k).select(
        F.explode(F.expr(f"transform(sequence(1, {k - _plan(k)[0] + 1}), "
                         f"i -> xxhash64(slice(split(window, ' '), i, {_plan(k)[0]})))")).alias("gram"))
        for k in lengths]
    scan = base.select("doc_id", "key", normal_words(F.col("text")).alias("w"))
    grams = F.concat(*(F.coalesce(_grams(F.col("w"), *_plan(k)), F.array().cast("array<bigint>"))
                       for k in lengths)) if lengths else F.array().cast("array<bigint>")
    one = scan.select("doc_id", "key", F.greatest(F.size("w"), F.lit(0)).cast("long").alias("n_words"),
                      F.posexplode_outer(grams).alias("at", "gram"))
    if sets:
        all_grams = sets[0]
        for s in sets[1:]:
            all_grams = all_grams.union(s)
        known = bounded_broadcast(all_grams.distinct().withColumn("known", F.lit(True)), max_broadcast_rows)
        one = one.join(known, "gram", "left")
    else:
        one = one.withColumn("known", F.lit(None).cast("boolean"))
    scanned = saved(one.groupBy("doc_id", "key", "n_words").agg(
        F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, 1)).alias("copies"),
        F.coalesce(F.bool_or("known"), F.lit(False)).alias("maybe")), "scanned")

    # 2. every window position of the documents found
    found = base.join(scanned.where("maybe").select("key").distinct(), "key", "left_semi")
    found = found.dropDuplicates(["key"]).select("key", normal_words(F.col("text")).alias("w"))
    at = [found.where(F.size("w") >= k).select("key", F.lit(k).alias("length"), F.posexplode(F.expr(
        f"transform(sequence(1, size(w) - {k - 1}), i -> struct(xxhash64(slice(w, i, {k})) AS hash, "
        f"array_join(slice(w, i, {k}), ' ') AS window))")).alias("at", "x")).select(
            "key", "length", "at", "x.hash", "x.window") for k in lengths]
    if at:
        every = at[0]
        for a in at[1:]:
            every = every.union(a)
        hits = saved(every.join(bounded_broadcast(windows, max_broadcast_rows), ["length", "hash", "window"])
                     .select("key", "length", "at", "items"), "hits")
        words = hits.select("key", F.explode(F.expr("sequence(at, at + length - 1)")).alias("word")).distinct()
        runs = words.groupBy("key").agg(F.count("*").alias("n_hit"), F.sort_array(F.collect_list("word")).alias("word"))
        spans = runs.select("key", "n_hit", F.expr(
            "transform(filter(sequence(0, size(word) - 1), i -> i = 0 OR word[i] > word[i - 1] + 1), "
            "i -> word[i])").alias("first"), F.expr(
            "transform(filter(sequence(0, size(word) - 1), i -> i = size(word) - 1 OR word[i + 1] > word[i] + 1), "
            "i -> word[i])").alias("last"))
        spans = spans.select("key", "n_hit", F.expr("transform(arrays_zip(first, last), x -> array(x.first, x.last))")
                             .alias("hit_spans"))
        items = hits.select("key", F.explode("items").alias("item")).groupBy("key").agg(
            F.sort_array(F.collect_set("item")).alias("items"))
        out = scanned.join(spans, "key", "left").join(items, "key", "left")
    else:
        out = scanned.withColumns({"n_hit": F.lit(None).cast("long"), "items": F.lit(None).cast("array<string>"),
                                   "hit_spans": F.lit(None).cast("array<array<int>>")})
    out = out.withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    return out.select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("hit_spans", F.array().cast("array<array<int>>")).alias("hit_spans"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows (by id and text), all columns as they were."""
    bad = decontaminate(docs, benchmark, n, id_col, text_col).where("contaminated").select("key").distinct()
    own = docs.select(F.struct("*").alias("row"), row_key(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).alias("key"))
    return own.join(bad, "key", "left_anti").select("row.*")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_CLASS}')"

#: DuckDB SQL over a view ``documents`` (or another, by ``format``) and ``benchmark``.
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT item_id, len(w[1:10]) AS k, array_to_string(w[i:i + len(w[1:10]) - 1], ' ') AS window
  FROM (SELECT item_id, w, unnest(range(1, len(w) - len(w[1:10]) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS window
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
hit AS (SELECT p.doc_id, p.i, p.k, x.item_id FROM pos p JOIN win x ON p.k = x.k AND p.window = x.window),
hw AS (SELECT doc_id, count(*) AS n_hit FROM (
  SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS word FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

"""Phrase mining by dynamic itemset counting.

Phrases of 1 to 4 words are counted in each language over a table cut into
``SHARDS`` shards, which are scanned in turn, over and over.  Words are
counted from the first scan on.  A longer phrase is counted from the scan
after the one in which the second of its two subphrases (all words but the
last, all but the first) reached the threshold, so lengths are interleaved
in one scan, and until it has seen every shard once: its count is then
exact.  As a phrase occurs no more often than its parts, no frequent phrase
is missed.  The scans end when no subphrase that reached the threshold in
the last cycle is left.

A scan must know of any phrase in which scan it reached the threshold.  It
reads that from a broadcast table of one byte for each hash cell: the first
scan in which a phrase of that cell reached it.  The first scan fixes the
number of cells (``CELLS_PER_WORD`` for each different word of the first
shard, at most ``MAX_CELLS``).  Two phrases in one cell can only make a
longer phrase start early, and it starts equally early in all tasks, so it
too is counted over one whole cycle: hashes decide how much is counted and
never a count.  Beyond that bound more phrases are counted than needed, and
none is lost.

Tasks turn the words of a language into numbers and count by numbering pairs
of numbers; when ``TOGETHER`` words have been read the counts go on, so a
task's memory is bounded.  Counts are added up by phrase, not by language,
so a language with most of the rows is spread like any other.  The running
counts are a table in the shared folder, which each scan writes anew; a
phrase that ends its cycle below the threshold leaves it.  The table before
is emptied then.

Defined cases: a null or empty text has no words; a null language is
``und``; null ids do not matter, and repeated rows count each time; very
long texts are counted whole (a task holds the words of one text at a
time); ties are taken in byte order of the phrase; an empty table gives
empty results; columns other than the text and the language are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import emptied, forget, saved_at
from .shingles import portions

SHARDS = 2
LONGEST = 4  #: words of a phrase
THRESHOLD = 30
TOGETHER = 2_000_000  #: words counted at once
CELLS_PER_WORD = 4
MAX_CELLS = 1 << 26
NEVER = 255

#: Bytes between pieces, and blanks between words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_ENDS + BLANKS,
                         b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(PIECE_ENDS) + b" " * len(BLANKS))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, with ``\\n`` after each piece and empty words between blanks."""
    return text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a phrase from the hash of all but its last word and that of the last word."""
    h = (left ^ (left >> np.uint64(29))) * _FACTOR + right
    return (h ^ (h >> np.uint64(32))) * _FACTOR


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """The hash of each word, as a word of its language."""
    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def phrase_hash(lang: str, words: list[bytes]) -> int:
    """The hash of one phrase."""
    hashes = _hashes(lang, words)
    h = hashes[:1]
    for i in range(1, len(words)):
        h = _mix(h, hashes[i:i + 1])
    return int(h[0])


class Words:
    """The words of one language that a task has read and not yet counted: numbers in order, 0 for the end of a piece."""

    def __init__(self, lang: str) -> None:
        self.lang = lang
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.numbers[b"\n"], self.numbers[b""]
        self.read: list[np.ndarray] = []

    def add(self, words: list[bytes]) -> None:
        found = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.read += [found[found != 1], np.zeros(1, np.int32)]

    def counted(self, cells: np.ndarray | None, scan: int, shards: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
        """For each length: the phrases that are counted in this scan (large binary), the scan before the first in
        which they are, and their occurrences.  Length 0 is all words."""
        at = np.concatenate(self.read)
        names = pa.array(list(self.numbers), pa.large_binary())
        word = at > 0
        if not word.any():
            return
        if scan < shards:
            uses = np.bincount(at, minlength=len(names))
            uses[0] = 0
            some = np.flatnonzero(uses)
            yield 1, names.take(pa.array(some)), np.full(len(some), -1), uses[some]
            yield 0, pa.array([b""], pa.large_binary()), np.array([-1]), np.array([word.sum()])
        if cells is None:
            return
        mask = np.uint64(len(cells) - 1)
        hashes = _hashes(self.lang, list(self.numbers))
        # of the phrase one word shorter that starts at each place: its number, its hash, and the scan in which it reached the threshold
        number, shorter, key = at.astype(np.int64), names, hashes[at]
        reached = np.where(word, cells[(key & mask).astype(np.int64)], NEVER).astype(np.int16)
        for length in range(2, LONGEST + 1):
            if len(reached) < 2:
                return
            start = np.maximum(reached[:-1], reached[1:])
            late = at[length - 1:]
            key = _mix(key[:-1], hashes[late])
            active = (start < scan) & (start + shards >= scan)
            # a phrase that shares its cell with another can't have reached the threshold before its own first scan
            reached = cells[(key & mask).astype(np.int64)].astype(np.int16)
            reached = np.where((start < NEVER) & (reached < NEVER), np.maximum(reached, start + 1), NEVER)
            used = np.flatnonzero(active | (reached < NEVER))
            back, pairs = pd.factorize(number[:-1][used] << 32 | late[used])
            phrases = pc.binary_join_element_wise(shorter.take(pa.array(pairs >> 32)), names.take(pa.array(pairs & 0xFFFFFFFF)),
                                                  pa.scalar(b" ", pa.large_binary()))
            uses = np.bincount(back[active[used]], minlength=len(pairs))
            starts = np.zeros(len(pairs), np.int16)
            starts[back] = start[used]
            some = np.flatnonzero(uses)
            if len(some):
                yield length, phrases.take(pa.array(some)), starts[some], uses[some]
            number = np.zeros(len(start), np.int64)
            number[used] = back
            shorter = phrases


_COUNTS = "lang string, length int, phrase binary, start int, n long"


def _count(docs: DataFrame, scan: int, shards: int, cells: Broadcast[bytes] | None) -> DataFrame:
    """Occurrences of the phrases counted in scan ``scan`` (from 0), by task; ``start`` is the scan before a phrase's first."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if cells is None else np.frombuffer(cells.value, np.uint8)
        waiting: dict[str, Words] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in list(waiting):
                for length, phrases, start, n in waiting.pop(lang).counted(table, scan, shards):
                    for at in range(0, len(phrases), 1 << 16):
                        some = phrases.slice(at, 1 << 16)
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(pa.scalar(lang, pa.string()), len(some)), pa.array(np.full(len(some), length, np.int32)),
                             some.cast(pa.binary()), pa.array(start[at:at + len(some)].astype(np.int32)),
                             pa.array(n[at:at + len(some)].astype(np.int64))], ["lang", "length", "phrase", "start", "n"])

        read = 0
        for b in portions(stream, 1):
            texts: defaultdict[str, list[str]] = defaultdict(list)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    texts[lang].append(text)
            for lang, some in texts.items():
                words = words_of("\n".join(some).encode())
                if lang not in waiting:
                    waiting[lang] = Words(lang)
                waiting[lang].add(words)
                read += len(words)
            if read >= TOGETHER:
                yield from flush()
                read = 0
        yield from flush()

    mine = docs.where(F.pmod("shard", F.lit(shards)) == scan % shards).select("lang", "text")
    return mine.mapInArrow(run, _COUNTS)


def _new_cells(reached: DataFrame, size: int) -> np.ndarray:
    """The hash cells of phrases; at most one row for each cell comes to the driver, so the table's bound holds for them too."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            cells = [phrase_hash(lang, p.split(b" ")) & (size - 1) for lang, p in
                     zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32())], ["cell"])

    return reached.select("lang", "phrase").mapInArrow(run, "cell int").distinct().toArrow().column("cell").to_numpy()


def _size(words: int) -> int:
    return min(MAX_CELLS, 1 << max(10, (words * CELLS_PER_WORD - 1).bit_length()))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int | None = None,
                     shards: int | None = None) -> DataFrame:
    """lang, length, phrase (binary) and n of every phrase of 1 to 4 words with at least ``threshold`` occurrences in its
    language; and of length 0 the number of all words of the language."""
    threshold, shards = threshold or THRESHOLD, shards or SHARDS
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text.alias("text"), F.xxhash64(text).alias("shard"))
    state = state_path = table = shared = None
    scan, last_reached = 0, -1
    while scan <= last_reached + shards:
        if scan >= NEVER:
            raise ValueError(f"more than {NEVER} scans")
        seen = _count(source, scan, shards, shared).withColumn("before", F.lit(0).cast("long"))
        if state is not None:
            seen = seen.unionByName(state.where(_kept(scan - 1, shards, threshold)).withColumn("before", F.col("n")))
        # a task's phrases are different ones by far the most: rows are shuffled first and added up once
        key = "lang", "length", "phrase", "start"
        seen = seen.repartition(*key).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("before").alias("before"))
        old, old_path = state, state_path
        # the first scan keeps all words, whose number gives the size of the table
        state, state_path = saved_at(seen.where(_kept(scan, shards, threshold)) if scan else seen, "phrase-counts")
        if old is not None:
            emptied(old, old_path)
        # ``before`` is the count up to the scan before, so a phrase reaches the threshold once
        new = state.where(F.col("length").between(1, LONGEST - 1) & (F.col("n") >= threshold) & (F.col("before") < threshold))
        if table is None:
            table = np.full(_size(state.where("length = 1").count()), NEVER, np.uint8)
        cells = _new_cells(new, len(table))
        if len(cells):
            last_reached = scan
            table[cells] = np.minimum(table[cells], scan)
        if shared is not None:
            shared.destroy()
        shared = spark.sparkContext.broadcast(table.tobytes())
        forget(spark)
        scan += 1
    shared.destroy()
    return state.where((F.col("n") >= threshold) | (F.col("length") == 0)).select("lang", "length", "phrase", "n")


def _kept(scan: int, shards: int, threshold: int) -> Column:
    """What of the counts after a scan goes on: phrases whose cycle is not complete, and complete ones that count."""
    return (F.col("start") + shards > scan) | (F.col("n") >= threshold) | (F.col("length") == 0)


def collocations(found: DataFrame, first: int = 2000, shadow_percent: int = 80, scale: int = 2_000_000) -> DataFrame:
    """The ``first`` phrases of 2 or more words of each language by score, from what ``frequent_phrases`` found.

    A phrase of a occurrences cut in parts of l and r has the score floor(scale * a / (l + r)); its lowest counts (ties:
    the earliest cut).  A phrase inside a longer one that has at least ``shadow_percent`` of its occurrences goes."""
    def exact(c: str) -> Column:
        return F.col(c).cast("decimal(19,0)")

    known = found.where("length > 0").select("lang", "length", F.col("phrase").cast("string").alias("phrase"), "n")
    long_ = known.where("length > 1").withColumn("words", F.split("phrase", " "))

    def part(start: Column, size: Column) -> Column:
        return F.array_join(F.slice("words", start, size), " ")

    cuts = long_.select("lang", "phrase", F.col("n").alias("a"), "words", "length", F.explode(F.expr("sequence(1, length - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"),
                       part(F.col("k") + 1, F.col("length") - F.col("k")).alias("right"))
    lefts = known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    scored = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).withColumns(
        {"top": exact("a") * F.lit(scale), "parts": exact("l") + exact("r")}).withColumn("score", F.expr("top div parts"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    inside = long_.where("length > 2").select(
        "lang", "n", "words", "length", F.explode(F.expr("sequence(2, length - 1)")).alias("size")).select(
        "lang", "n", "words", "size", F.explode(F.expr("sequence(1, length - size + 1)")).alias("at"))
    shadows = inside.select("lang", part(F.col("at"), F.col("size")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = best.join(shadows, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * shadow_percent))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    totals = found.where("length = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


#: DuckDB SQL of ``collocations(frequent_phrases(documents))``.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
texts AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM texts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM texts GROUP BY lang),
cuts AS (
  SELECT lang, phrase, f, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:k], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS j FROM f WHERE k > 1)),
scored AS (
  SELECT c.lang, c.phrase, c.j, c.f AS a, l.f AS l, r.f AS r, 2000000 * c.f // (l.f + r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, f, array_to_string(ws[i.i:i.i + m.m - 1], ' ') AS phrase
  FROM (SELECT lang, f, k, string_split(phrase, ' ') AS ws FROM f WHERE k > 2),
       (SELECT unnest([1, 2, 3]) AS i) i, (SELECT unnest([2, 3]) AS m) m
  WHERE m.m < k AND i.i + m.m - 1 <= k),
longest AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM best b LEFT JOIN longest x ON x.lang = b.lang AND x.phrase = b.phrase
  WHERE x.f IS NULL OR 100 * x.f < 80 * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

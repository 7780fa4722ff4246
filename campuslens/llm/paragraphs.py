"""Substring dedup: paragraphs by MinHash banding, passages inside them by equal sentence runs.

Units
  *paragraph*: a line of at least ``min_words`` words, as its set of word
  shingles.
  *passage*: from every sentence start, the shortest run of whole
  sentences with at least ``min_words`` words, over line ends if need be.
  Where no sentence starts for ``min_words`` words, a word whose hash is
  the smallest of the ``RADIUS`` words on either side counts as a start.
  *seed*: ``min_words`` words, chosen by winnowing: of every ``WINDOW``
  neighbouring runs of ``min_words`` words of a text the one of smallest
  hash.  Marks play no part, so two texts with ``min_words + WINDOW - 1``
  (50) or more words in common share a seed there, whatever is around.
  *gram*: every run of ``min_words`` words that starts less than
  ``WINDOW`` words from a seed that another document has.  Those of a
  common run of 50 words or more make up the whole run, to the word.
  *text*: all words of a document, if they are ``min_words`` or more.

Clusters
  Paragraphs of equal sets are one node.  ``tune`` picks the fewest bands
  of the most rows for the recall wanted at the threshold; nodes that
  share a band are paired with the bucket's smallest node and with their
  predecessor in it, the exact Jaccard of the pairs is verified, and so is
  every pair of a bucket that still joins two components
  (``minhash.complete``).  The connected components are the clusters.  Passages, seeds, grams and texts
  with equal words are a cluster (128 bits of hash; all but grams looked up by some of the first 64).

Removal: of each cluster the units of its first document (by id) stay,
those of all other documents are cut out of their texts.

Defined cases: null and empty texts have no units and stay as they are;
rows equal in id and text are one document; rows that share only the id
are documents of their own; a null id sorts first; an empty table gives an
empty result; other columns are carried along untouched, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import Scratch, batches, cut, forget, has_bit, repeated_bits, saved
from .minhash import complete, marks, may_be_similar, pack
from .shingles import mix, portions, shingle_hashes, text_bytes, weighted, word_hashes

MIN_WORDS = 20
RADIUS = 8
WINDOW = 31
RUN, SEED, TEXT = 0, 1, 2  #: kinds of equal-words units
RECALL = 0.995
REGISTERS = 16
PART = 1000
PORTION = 1 << 19  #: bytes of text looked at together
SLICES = 2  #: of the hashes of units, looked at one after the other
SLICE_BYTES = 16 << 20  #: a smaller collection has a slice for each of these
GRAM_BYTES = 64  #: of text for each gram that is looked at together: what is shuffled at a time follows the text, however much of it is shared
FILTER_BITS = 27  #: of the filters that keep units without a partner from being shuffled (16 MB), at most
_ODD = 0xD6E8FEB86659FD93


def tune(threshold: float, recall: float = RECALL, registers: int = REGISTERS) -> tuple[int, int]:
    """(bands, rows): the most rows a band, then the fewest bands, with which a pair at the
    threshold shares a band with probability ``recall``, within a number of registers."""
    for rows in range(registers, 0, -1):
        for bands in range(1, registers // rows + 1):
            if 1 - (1 - threshold ** rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding has that recall")


def _breaks(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, bounds: np.ndarray, marks: bytes) -> np.ndarray:
    """For each word: is it the first of its row, or is a mark between it and the word before?"""
    count = np.append(0, np.cumsum(np.isin(data, np.frombuffer(marks, np.uint8)), dtype=np.int64))[starts]
    new = np.ones(len(starts), bool)
    new[1:] = count[1:] != count[:-1]
    new[bounds[:-1][bounds[:-1] < len(starts)]] = True
    return new


def _ends_of(starts: np.ndarray, ends: np.ndarray, word: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte at which the word ``word`` (one past a unit) of a row starts, or the row's end."""
    inside = word < bounds[row + 1]
    return np.where(inside, starts[np.minimum(word, len(starts) - 1)], ends[row + 1])


def _run_hashes(words: np.ndarray, s: np.ndarray, e: np.ndarray, salts: tuple[int, ...] = (1, 2)) -> list[np.ndarray]:
    """64-bit hashes, by salt, of the words from ``s`` up to ``e``, for each pair of these."""
    n, out = len(words), []
    for salt in salts:
        odd = np.uint64(_ODD + 2 * salt)
        power = np.cumprod(np.full(n, odd, np.uint64))
        back = np.cumprod(np.full(n, np.uint64(pow(int(odd), -1, 1 << 64)), np.uint64))
        total = np.append(np.uint64(0), np.cumsum(mix(words + np.uint64(salt)) * power, dtype=np.uint64))
        out.append(mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64)).view(np.int64))
    return out


def winnowed(grams: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest (and first) gram of every ``window`` neighbouring grams of a row, or of all
    grams of a row of fewer; ``bounds`` are the rows' bounds in ``grams``."""
    size = np.diff(bounds)
    first = np.arange(len(grams))[:max(len(grams) - window + 1, 0)]
    first = first[first + window <= np.repeat(bounds[1:], size)[:len(first)]]
    least, at, width = grams, np.arange(len(grams)), 1
    while width < window and len(first):  # the least of ``width`` neighbours and its place
        step = min(width, window - width)
        right = least[step:] < least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        width += step
    short = np.flatnonzero((size > 0) & (size < window))
    near = np.minimum(bounds[short][:, None] + np.arange(window), bounds[short + 1][:, None] - 1)
    few = bounds[short] + grams[near].argmin(axis=1) if len(short) else short
    return np.unique(np.concatenate([at[first], few]))


def _gram_starts(bounds: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of ``min_words`` words, and the rows' bounds in them."""
    size = np.maximum(np.diff(bounds) - min_words + 1, 0)
    ends = np.append(0, np.cumsum(size))
    return np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], size), ends


class Units:
    """The paragraphs or the ``passages`` (seeds and texts with them) of some texts; byte places count from
    the row's start."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, min_words: int, passages: bool = False, salts: tuple[int, ...] = (1, 2)):
        self.words, starts, bounds = word_hashes(data, ends)
        n, self.min_words = len(self.words), min_words
        row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        if not n:
            self.line_row = self.run_row = np.zeros(0, np.int64)
            return
        if passages:
            self._passages(data, ends, starts, bounds, row_of, salts)
            return
        first = np.flatnonzero(_breaks(data, ends, starts, bounds, b"\n"))
        last = np.append(first[1:], n)
        keep = last - first >= min_words
        self.first, self.last = first[keep], last[keep]
        self.line_row = row_of[self.first]
        line_ends = np.append(np.flatnonzero(data == 10), len(data))
        stop = line_ends[np.searchsorted(line_ends, starts[self.last - 1])]
        self.line_start = starts[self.first] - ends[self.line_row]
        self.line_end = np.minimum(stop, ends[self.line_row + 1]) - ends[self.line_row]

    def _passages(self, data: np.ndarray, ends: np.ndarray, starts: np.ndarray, bounds: np.ndarray, row_of: np.ndarray,
                  salts: tuple[int, ...]) -> None:
        n, min_words = len(self.words), self.min_words
        start = _breaks(data, ends, starts, bounds, b".!?\n")
        at = np.arange(n)
        since = at - np.maximum.accumulate(np.where(start, at, 0))
        far = np.flatnonzero(since >= min_words)
        if len(far):
            near = np.clip(far[:, None] + np.arange(-RADIUS, RADIUS + 1), bounds[row_of[far]][:, None],
                           bounds[row_of[far] + 1][:, None] - 1)
            start[far[self.words[far] == self.words[near].min(axis=1)]] = True
        s = np.flatnonzero(start)
        to = np.searchsorted(s, s + min_words)
        row = row_of[s]
        e = np.minimum(np.where(to < len(s), s[np.minimum(to, len(s) - 1)], n), bounds[row + 1])
        keep = e - s >= min_words
        s, e, row = s[keep], e[keep], row[keep]
        # seeds and texts
        gram, gram_bounds = _gram_starts(bounds, min_words)
        seed = gram[winnowed(_run_hashes(self.words, gram, gram + min_words, (1,))[0].view(np.uint64), gram_bounds)]
        whole = np.flatnonzero(np.diff(bounds) >= min_words)
        self.run_kind = np.repeat(np.array([RUN, SEED, TEXT], np.int8), [len(s), len(seed), len(whole)])
        self.run_row = np.concatenate([row, row_of[seed], whole])
        s, e = np.concatenate([s, seed, bounds[whole]]), np.concatenate([e, seed + min_words, bounds[whole + 1]])
        self.run_start = starts[s] - ends[self.run_row]
        self.run_end = _ends_of(starts, ends, e, self.run_row, bounds) - ends[self.run_row]
        self.run_hash = _run_hashes(self.words, s, e, salts)

    def sets(self, n: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Distinct shingles of all paragraphs, their bounds, and the node of each paragraph."""
        size = self.last - self.first
        words = self.words[np.repeat(self.first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        h, _, bounds = weighted(*shingle_hashes(words, np.append(0, np.cumsum(size)), n), len(size))
        parts = [np.add.reduceat(mix(h ^ np.uint64(salt)), bounds[:-1]) for salt in (11, 13)]
        raw = np.stack([*parts], axis=1).astype("<u8").tobytes()
        return h, bounds, [raw[i:i + 16] for i in range(0, len(raw), 16)]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))


def paragraph_units(source: DataFrame, n: int, min_words: int, registers: int) -> DataFrame:
    """``doc_id``, ``key``, ``start``, ``end``, ``node`` and ``sketch`` of every paragraph."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(stream, 2, PORTION):
            u = Units(*text_bytes(b.column(2)), min_words)
            if not len(u.line_row):
                continue
            h, bounds, nodes = u.sets(n)
            sketch = np.stack([np.minimum.reduceat(mix(h + np.uint64((1 + k) * _ODD % (1 << 64))), bounds[:-1])
                               for k in range(registers)], axis=1) >> np.uint64(32)
            raw = sketch.astype("<u4").tobytes()
            at = pa.array(u.line_row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(u.line_start, pa.int32()), pa.array(u.line_end, pa.int32()),
                 pa.array(nodes, pa.binary()), pa.array([raw[i:i + 4 * registers] for i in range(0, len(raw), 4 * registers)], pa.binary())],
                ["doc_id", "key", "start", "end", "node", "sketch"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, key long, start int, end int, node binary, sketch binary")


def passage_units(source: DataFrame, min_words: int, wanted: bytes, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``doc_id``, ``key``, ``start``, ``end``, ``hash`` and ``more`` (64 bits each) of the passages, seeds and
    texts whose hash has its bit in ``wanted``, and which of these each is (``unit``)."""
    shared = source.sparkSession.sparkContext.broadcast(np.frombuffer(wanted, np.uint8))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(stream, 2, PORTION):
            u = Units(*text_bytes(b.column(2)), min_words, True)
            if len(u.run_row):
                some = has_bit(shared.value, u.run_hash[0], filter_bits)
                at = pa.array(u.run_row[some])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(u.run_start[some], pa.int32()), pa.array(u.run_end[some], pa.int32()),
                     *(pa.array(h[some]) for h in u.run_hash), pa.array(u.run_kind[some])], ["doc_id", "key", "start", "end", "hash", "more", "unit"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, key long, start int, end int, hash long, more long, unit byte")


def _passage_hashes(source: DataFrame, min_words: int) -> DataFrame:
    """``hash`` of every passage, seed and text."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(stream, 0, PORTION):
            u = Units(*text_bytes(b.column(0)), min_words, True, (1,))
            if len(u.run_row):
                yield pa.RecordBatch.from_arrays([pa.array(u.run_hash[0])], ["hash"])

    return source.select("text").mapInArrow(run, "hash long")


def _with_seeds(source: DataFrame, common: DataFrame, filter_bits: int) -> DataFrame:
    """``doc_id``, ``key``, ``text`` and ``seeds`` (their first bytes) of the documents with seeds that others have, but for
    later copies of a whole text, which need no grams; and a guess at their ``grams``."""
    copies = common.where((F.col("unit") == TEXT) & _later()).select("key").distinct()
    seeds = common.where(F.col("unit") == SEED).join(copies, "key", "left_anti").groupBy("key").agg(F.collect_set("start").alias("seeds"))
    # a document has a hundred times the text of a unit or more; texts without seeds are not shuffled
    filter_bits = max(15, filter_bits - 4)
    shared = source.sparkSession.sparkContext.broadcast(np.frombuffer(
        repeated_bits(common.where(F.col("unit") == SEED).select(F.col("key").alias("hash")), filter_bits), np.uint8))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            yield b.filter(pa.array(has_bit(shared.value, b.column(1).to_numpy(), filter_bits)))

    some = source.mapInArrow(run, source.schema)
    return some.join(seeds, "key").select("doc_id", "key", "text", "seeds", F.least(
        F.size("seeds") * (WINDOW + 9), F.floor(F.octet_length("text") / 6).cast("int")).alias("grams"))


def gram_units(source: DataFrame, min_words: int) -> DataFrame:
    """``doc_id``, ``key``, ``start``, ``end``, ``hash`` and ``more`` of the grams around the seeds of every
    row of ``source``, which start at the bytes ``seeds``; those of a ``part`` of the ``parts`` of all hashes."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(stream, 2, PORTION):
            data, ends = text_bytes(b.column(2))
            words, starts, bounds = word_hashes(data, ends)
            gram, gram_bounds = _gram_starts(bounds, min_words)
            seeds = b.column(3).to_pylist()
            row = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
            seed = np.searchsorted(starts, np.concatenate([np.array(x, np.int64) for x in seeds]) + ends[row])
            at = seed - bounds[row] + gram_bounds[row]
            step = np.zeros(len(gram) + 1, np.int64)
            np.add.at(step, np.maximum(at - WINDOW + 1, gram_bounds[row]), 1)
            np.add.at(step, np.minimum(at + WINDOW, gram_bounds[row + 1]), -1)
            near = np.flatnonzero(np.cumsum(step[:-1]) > 0)
            part, parts = (np.uint64(b.column(i)[0].as_py()) for i in (4, 5))
            if parts > 1:
                near = near[_run_hashes(words, gram[near], gram[near] + min_words, (1,))[0].view(np.uint64) % parts == part]
            s, row = gram[near], np.searchsorted(gram_bounds, near, "right") - 1
            for x in range(0, len(s), 1 << 16):
                f, r = s[x:x + (1 << 16)], row[x:x + (1 << 16)]
                e, take = f + min_words, pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(starts[f] - ends[r], pa.int32()),
                     pa.array(_ends_of(starts, ends, e, r, bounds) - ends[r], pa.int32()),
                     *map(pa.array, _run_hashes(words, f, e))], ["doc_id", "key", "start", "end", "hash", "more"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, key long, start int, end int, hash long, more long")


def _of_several(units: DataFrame) -> DataFrame:
    """The units that several documents have, with the ``least`` of these: sorted by their hashes once, as hardly any
    group of equal ones is large enough to be counted before it is shuffled."""
    own, equal = F.struct("doc_id", "key"), Window.partitionBy("hash", "more")
    return units.withColumns({"least": F.min(own).over(equal), "last": F.max(own).over(equal)}).where(
        ~F.col("least").eqNullSafe(F.col("last"))).drop("last")


def _later() -> Column:
    return ~F.struct("doc_id", "key").eqNullSafe(F.struct("least.doc_id", "least.key"))


def _text_bytes(source: DataFrame) -> int:
    return source.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def extent(source: DataFrame) -> tuple[int, int]:
    """Bits of the filters (a bit for every 4 bytes of text or less) and number of slices: a small collection does with less of the
    driver's memory and fewer jobs."""
    return _extent(_text_bytes(source))


def _extent(total: int) -> tuple[int, int]:
    return min(FILTER_BITS, max(15, total.bit_length() - 2)), min(SLICES, 1 + total // SLICE_BYTES)


def _shared(units: DataFrame, scratch: Scratch, name: str, slices: int) -> list[DataFrame]:
    """The units (without their hashes) that several documents have, with the ``least`` document of each, a table for each
    slice of the hashes.  The shuffles of one slice are gone before those of the next."""
    found = []
    for i in range(slices):
        found.append(scratch.saved(_of_several(units.where(F.pmod("hash", F.lit(slices)) == i)).drop("hash", "more"), name))
        forget(units.sparkSession)
    return found


def _cut_runs(units: DataFrame) -> DataFrame:
    """``doc_id``, ``key``, ``start``, ``end`` and ``first_doc`` of the runs that touching units of later documents make up,
    where these have the same ``least`` document: a few rows where a row for each unit would take more than the text."""
    rows = units.where(_later()).select("doc_id", "key", "start", "end", F.col("least.doc_id").alias("first_doc"))
    rows = rows.repartition("key").sortWithinPartitions("key", "doc_id", "first_doc", "start", "end")

    def differ(column: pa.Array) -> np.ndarray:
        x, y = column.slice(1), column.slice(0, len(column) - 1)
        same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
        return ~same.to_numpy(zero_copy_only=False)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            if not b.num_rows:
                continue
            group = np.append(0, np.cumsum(reduce(np.logical_or, [differ(b.column(i)) for i in (0, 1, 4)]))).astype(np.int64) << 32
            start, end = (group + b.column(i).to_numpy() for i in (2, 3))
            end = np.maximum.accumulate(end)  # of the group, as the next is larger
            first = np.flatnonzero(np.append(True, (start[1:] > end[:-1]) | (group[1:] != group[:-1])))
            last = np.append(first[1:], len(start)) - 1
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(end[last] & 0xFFFFFFFF, pa.int32()),
                 b.column(4).take(at)], ["doc_id", "key", "start", "end", "first_doc"])

    return rows.mapInArrow(run, rows.schema)


def _node_texts(source: DataFrame, n: int, min_words: int, wanted: bytes, filter_bits: int) -> DataFrame:
    """``node``, ``mark`` and ``text`` of the paragraphs whose node has its bit in ``wanted``: the set is made of the text again
    where it is looked at, as it takes more than twice the room."""
    shared = source.sparkSession.sparkContext.broadcast(np.frombuffer(wanted, np.uint8))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(stream, 0, PORTION):
            data, ends = text_bytes(b.column(0))
            u = Units(data, ends, min_words)
            if len(u.line_row):
                h, bounds, nodes = u.sets(n)
                some = has_bit(shared.value, np.frombuffer(b"".join(nodes), ">u8")[::2].astype(np.uint64), filter_bits)
                at = list({nodes[i]: i for i in np.flatnonzero(some)}.values())
                start, end = (ends[u.line_row[at]] + x[at] for x in (u.line_start, u.line_end))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[i] for i in at], pa.binary()), pa.array(marks([h[bounds[i]:bounds[i + 1]] for i in at]), pa.binary()),
                     pa.array([data[x:y].tobytes() for x, y in zip(start, end, strict=True)], pa.binary())], ["node", "mark", "text"])

    return source.select("text").mapInArrow(run, "node binary, mark binary, text binary")


def _line_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The shingles of each paragraph, as ``Units.sets`` makes them."""
    words, _, bounds = word_hashes(*text_bytes(texts))
    h, _, bounds = weighted(*shingle_hashes(words, bounds, n), len(texts))
    return [h[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def _packed(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with the ``packed`` set of the paragraph in place of the last column, its text."""
    schema = StructType([*rows.schema.fields[:-1], StructField("packed", BinaryType())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(stream, len(schema) - 1, PORTION):
            sets = [pack(x, np.ones(len(x))) for x in _line_sets(b.column(len(schema) - 1), n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sets, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def _bands(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, 8192):
            sketch = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(b.num_rows, bands, rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (b.num_rows, bands))
            for i in range(rows):
                key = mix(key * np.uint64(_ODD) + sketch[:, :, i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64).ravel()), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), bands)))],
                ["bucket", "node"])

    return nodes.mapInArrow(run, "bucket long, node binary")


def _similar(pairs: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """The pairs whose exact Jaccard is ``threshold`` or more.  Texts are only sent for pairs whose marks allow that."""
    def with_both(pairs: DataFrame, column: str) -> DataFrame:
        own = texts.select("node", column)
        return pairs.join(own.withColumnsRenamed({"node": "a", column: "s"}), "a").join(
            own.withColumnsRenamed({"node": "b", column: "t"}), "b").select("a", "b", "s", "t")

    def hopeful(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, 8192):
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            keep = may_be_similar(x, y, threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    both = with_both(with_both(pairs, "mark").mapInArrow(hopeful, "a binary, b binary"), "text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(stream, 2, PORTION):
            keep = []
            for x, y in zip(_line_sets(b.column(2), n), _line_sets(b.column(3), n), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= threshold * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def _clusters(units: DataFrame, source: DataFrame, threshold: float, n: int, min_words: int, bands: int, rows: int,
              scratch: Scratch, filter_bits: int) -> DataFrame:
    """``node`` and ``cluster`` of the paragraphs that are like others of another set."""
    nodes = scratch.saved(units.select("node", "sketch").dropDuplicates(["node"]), "paragraph-nodes")
    own = Window.partitionBy("bucket")
    shared = scratch.saved(_bands(nodes, bands, rows).withColumn("count", F.count("*").over(own)).where("count > 1"), "paragraph-buckets")
    order = F.xxhash64("node", "bucket")
    part = Window.partitionBy("bucket", F.pmod(order, F.ceil(F.col("count") / PART))).orderBy(order, "node")
    placed = shared.withColumn("centre", F.min("node").over(own)).withColumn("before", F.lag("node").over(part))
    pairs = scratch.saved(placed.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).union(
        placed.where("before IS NOT NULL").select(F.least("before", "node").alias("a"), F.greatest("before", "node").alias("b")))
        .distinct(), "paragraph-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    forget(source.sparkSession)
    # the first 8 bytes of a node are a hash
    bits = repeated_bits(wanted.select(F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long").alias("hash")), filter_bits)
    texts = scratch.saved(_node_texts(source, n, min_words, bits, filter_bits).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "paragraph-texts")
    links = scratch.saved(_similar(pairs, texts, threshold, n), "paragraph-links")
    forget(source.sparkSession)
    return complete(shared.select("bucket", "node"), links, nodes, texts, threshold, scratch, partial(_packed, n=n)).withColumnRenamed("root", "cluster")


def duplicate_spans(docs: DataFrame, threshold: float = 0.8, n: int = 5, min_words: int = MIN_WORDS, recall: float = RECALL,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every paragraph and every run of touching passages to cut out: ``doc_id``, ``key``, ``start`` and ``end`` (bytes),
    ``kind``, and ``first_doc`` (the document whose unit stays)."""
    source = _source(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "paragraphs")
    total = _text_bytes(source)
    filter_bits, slices = _extent(total)
    # passages: the counts of the hashes alone, then the units behind those that repeat
    several = scratch.saved(_passage_hashes(source, min_words).groupBy("hash").count().where("count > 1").select("hash"), "passage-hashes")
    forget(docs.sparkSession)
    wanted = repeated_bits(several, filter_bits)
    again = scratch.saved(passage_units(source, min_words, wanted, filter_bits), "passages")
    slices_of = _shared(again, scratch, "passages-common", slices)
    scratch.emptied(several, again)
    common = reduce(DataFrame.union, slices_of)
    runs = [scratch.saved(_cut_runs(common), "passages-cut")]
    # grams around common seeds: made anew for each part of their hashes, as all together may take more than the text
    near = scratch.saved(_with_seeds(source, common, filter_bits), "gram-texts")
    parts = 1 + (near.agg(F.sum("grams")).first()[0] or 0) // max(SLICE_BYTES // GRAM_BYTES, total // GRAM_BYTES)
    grams = [gram_units(near.select("doc_id", "key", "text", "seeds", F.lit(i).alias("part"), F.lit(parts).alias("parts")), min_words)
             for i in range(parts)]
    scratch.emptied(*slices_of)
    forget(docs.sparkSession)
    for some in grams:
        runs.append(scratch.saved(_cut_runs(_of_several(some)), "grams-cut"))
        forget(docs.sparkSession)
    scratch.emptied(near)
    # paragraphs
    bands, rows = tune(threshold, recall)
    units = scratch.saved(paragraph_units(source, n, min_words, bands * rows), "paragraphs")
    clusters = scratch.saved(_clusters(units, source, threshold, n, min_words, bands, rows, scratch, filter_bits), "paragraph-clusters")
    forget(docs.sparkSession)
    of = units.select("doc_id", "key", "start", "end", "node").join(clusters, "node", "left").withColumn(
        "cluster", F.coalesce("cluster", "node"))
    least = F.min(F.struct("doc_id", "key")).over(Window.partitionBy("cluster"))
    lines = of.withColumn("least", least).select("doc_id", "key", "start", "end", "least", F.lit("paragraph").alias("kind"))
    found = saved(reduce(DataFrame.union, runs).select("doc_id", "key", "start", "end", F.lit("passage").alias("kind"), "first_doc").union(
        lines.where(_later()).select("doc_id", "key", "start", "end", "kind", F.col("least.doc_id").alias("first_doc"))), "spans")
    scratch.removed()
    return found


def _merged(spans: np.ndarray) -> list[list[int]]:
    """The maximal runs (start, end) of spans, each packed in a number (start * 2 ** 32 + end)."""
    spans = np.sort(spans)
    start, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    first = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return np.stack([start[first], end[np.append(first[1:], len(end)) - 1]], axis=1).tolist()


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated units cut out of the text, and a struct
    ``removed``: ``bytes``, ``spans`` (maximal runs) and ``first_docs`` (ids whose units stay)."""
    spans = duplicate_spans(docs, id_col=id_col, text_col=text_col, **options)
    by_doc = spans.groupBy("doc_id", "key").agg(
        F.collect_set(F.shiftleft(F.col("start").cast("long"), 32) + F.col("end")).alias("spans"), F.sort_array(F.collect_set("first_doc")).alias("first_docs"))
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"))
    both = own.join(by_doc.withColumnsRenamed({"doc_id": "d", "key": "k"}),
                    F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    both = both.select("row.*", F.struct("spans", "first_docs").alias("removed"))
    # the last column is ours, whatever the others are called
    at = docs.columns.index(text_col)
    kind = spans.schema["first_doc"].dataType.simpleString()
    removed = StructType.fromDDL(f"bytes long, spans long, first_docs array<{kind}>")
    schema = StructType([*docs.schema.fields, StructField("removed", removed, False)])
    names = [f"c{i}" for i in range(len(docs.columns) + 1)]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, 256):
            texts, spans, first_docs = b.column(at).to_pylist(), *b.column(b.num_columns - 1).flatten()
            kept, info = [], []
            for text, some, first in zip(texts, spans, first_docs.to_pylist(), strict=True):
                left, n_bytes, n_spans = text, 0, 0
                if text is not None and some.is_valid:
                    raw, n_bytes, n_spans = cut(text.encode(), _merged(some.values.to_numpy()))
                    left = raw.decode()
                kept.append(left)
                info.append({"bytes": n_bytes, "spans": n_spans, "first_docs": first or []})
            columns = list(b.columns[:-1])
            columns[at] = pa.array(kept, pa.string())
            ids = b.column(b.num_columns - 1).type.field("first_docs").type
            info = pa.array(info, pa.struct([("bytes", pa.int64()), ("spans", pa.int64()), ("first_docs", ids)]))
            yield pa.RecordBatch.from_arrays([*columns, info], names)

    return both.toDF(*names).mapInArrow(run, StructType(
        [StructField(x, f.dataType, f.nullable) for x, f in zip(names, schema.fields, strict=True)])).toDF(*schema.names)

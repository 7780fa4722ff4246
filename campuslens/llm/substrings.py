"""Exact substring dedup on the bytes of a collection, by its Burrows-Wheeler transform.

A byte goes if a string of ``length`` bytes over it also starts in a
document with a smaller id; strings do not cross documents.

The transform of all documents together would take as many rounds as the
longest document has bytes, each over the whole collection.  So the
collection is first cut into segments that can be transformed apart:

1.  Each window of ``length`` bytes has an *anchor*, the ``GRAM`` bytes in
    it of smallest hash.  Equal windows have equal anchors at equal
    places.  The windows that follow each other with one anchor are a
    segment; its bytes are some ``length`` to 2 * ``length`` - ``GRAM``.
2.  The hashes of all anchors, once for each document, meet by hash range.
    Those of several documents set bits of a filter of fixed size, with
    which the second scan leaves out the segments of all other anchors.  A
    filter that is too small for the collection lets more segments pass
    and changes no result.
3.  Segments meet by hash range of their anchors, equal ones once with
    their smallest id.  Where different segments share an anchor and the
    ``SIDE`` bytes before or after it, ``bwt.transform`` puts all their
    suffixes in order, column by column; the runs with ``length`` bytes in
    common are the equal windows, and their smallest id decides.
4.  What goes from each document is collected by document and cut out.

Segments travel packed, a record for each range and some ``FLUSH``
anchors of a task, in order of their documents.  Their places are a record
of their own that counts on the order of the segments; both have one
``tag``.  A task takes the segments of a range first and then the places
where they occur, record by record, so a segment that very many documents
share never has all its places in memory.

Defined cases: null and empty texts have no bytes; ids are taken as long
integers, a null id is smaller than all others; rows that share an id are
documents of their own, and neither's id is smaller; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import transform
from .common import batches, cut, forget
from .shingles import mix, portions, text_bytes

LENGTH = 50
GRAM = 24  #: shorter ones are shared by chance more often, longer ones are more
FLUSH = 1_000_000
WINDOWS = 1 << 19  #: windows judged together
PORTION = 1 << 17  #: bytes of text looked at together; `segments` needs some 100 times as many of memory
RANGE_BYTES = 2 << 20  #: text for each hash range
FILTER_BITS = 27
STRINGS = 2048  #: strings in one transform, or those of one anchor
_BLOCK = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_NULL = -(1 << 63)
_VALUES = np.random.default_rng(20240311).integers(1, 1 << 63, 256, np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class _Sums:
    """Hashes of any ranges of some bytes, from one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if not _POWERS or len(_POWERS[0][0]) < n:
            size = 1 << max(16, (n - 1).bit_length())
            _POWERS[0] = tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, x, np.uint64)))
                               for x in (_ODD, pow(_ODD, -1, 1 << 64)))
        power, self.back = _POWERS[0]
        self.sums = np.append(np.uint64(0), np.cumsum(_VALUES[data] * power[:len(data)], dtype=np.uint64))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def segments(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """All segments of the rows of ``data``: ``row``, ``start`` and ``end`` (places in ``data``), ``anchor``
    (its place), ``hash`` (of the anchor) and ``whole`` (hash of the segment)."""
    parts = []
    for lo in range(0, max(len(data) - length + 1, 0), _BLOCK):  # blocks of windows
        block = data[lo:lo + _BLOCK + length - 1]
        sums, n = _Sums(block), len(block)
        at = np.arange(n - gram + 1)
        low = np.uint64((1 << 24) - 1)
        key = sums.of(at, at + gram) & ~low | low - at.astype(np.uint64)
        least, span, wide = key, 1, length - gram + 1
        while 2 * span <= wide:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < wide:
            least = np.minimum(least[:len(least) - (wide - span)], least[wide - span:])
        anchor = (low - (least & low)).astype(np.int64)
        window = np.arange(len(anchor)) + lo
        row = np.searchsorted(ends, window, "right") - 1
        inside = window + length <= ends[row + 1]
        same = (anchor[1:] == anchor[:-1]) & inside[1:] & inside[:-1]
        first = np.flatnonzero(inside & ~np.append(False, same))
        last = np.flatnonzero(inside & ~np.append(same, False))
        a = anchor[first]
        parts.append({"row": row[first], "start": first + lo, "end": last + lo + length, "anchor": a + lo,
                      "hash": sums.of(a, a + gram), "whole": sums.of(first, last + length)})
    names = ("row", "start", "end", "anchor", "hash", "whole")
    return {x: np.concatenate([p[x] for p in parts]) if parts else
            np.zeros(0, np.uint64 if x in ("hash", "whole") else np.int64) for x in names}


def _range_hashes(data: np.ndarray, starts: np.ndarray, size: int, some: int = 1 << 11) -> np.ndarray:
    """Hashes of the ``size`` bytes from each start, some at a time."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(0, len(starts), some):
        at = starts[i:i + some]
        sums = _Sums(data[(at[:, None] + np.arange(size)).ravel()])
        first = np.arange(len(at)) * size
        out[i:i + some] = sums.of(first, first + size)
    return out


def _string_hashes(data: np.ndarray, ends: np.ndarray, some: int = 1 << 11) -> np.ndarray:
    """Hashes of the strings of ``data`` that end at ``ends``, some at a time."""
    out, starts = np.zeros(len(ends), np.uint64), np.append(0, ends[:-1])
    for i in range(0, len(ends), some):
        a, b = starts[i:i + some], ends[i:i + some]
        out[i:i + some] = _Sums(data[a[0]:b[-1]]).of(a - a[0], b - a[0])
    return out


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] places, and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``mark`` (32 bits of the text's hash, for rows that share an id) and ``text``."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("id"),
                       F.hash(text_col).alias("mark"), F.col(text_col).alias("text"))


def _ranges(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _repeated(source: DataFrame, length: int, gram: int, bits: int, filter_bits: int) -> np.ndarray:
    """A bit for each value of the first ``filter_bits`` bits of an anchor's hash, set if some anchor with
    it is in several documents (packed; of fixed size)."""
    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h = np.sort(np.concatenate(held))
            # an anchor twice is as good as many times
            h = h[~np.append([False, False], (h[2:] == h[1:-1]) & (h[1:-1] == h[:-2]))] if len(h) > 2 else h
            of = _ranges(h, bits)
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            rest = ((h << np.uint64(bits)) >> np.uint64(24)) if bits else h >> np.uint64(24)  # 40 bits beyond the range
            raw = rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(of[first]), pa.array([raw[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(h)), strict=True)],
                                               pa.binary())], ["range", "hashes"])

        for b in portions(stream, 0, PORTION):
            s = segments(*text_bytes(b.column(0)), length, gram)
            if len(s["hash"]):
                order = np.lexsort((s["row"], s["hash"]))
                h, row = s["hash"][order], s["row"][order]
                held.append(h[np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))])
                size += len(held[-1])
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint8).reshape(-1, 5)
        h = np.zeros((len(raw), 8), np.uint8)
        h[:, :5] = raw
        h = np.sort(h.view("<u8").ravel())
        again = h[1:][h[1:] == h[:-1]]
        own = np.zeros(1 << (filter_bits - bits), bool)
        own[(again >> np.uint64(40 - (filter_bits - bits))).astype(np.int64)] = True
        return pa.table({"range": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    met = source.select("text").mapInArrow(scan, "range long, hashes binary").groupBy("range").applyInArrow(
        meet, "range long, bits binary").toArrow()
    size = 1 << (filter_bits - bits)
    out = np.zeros((1 << filter_bits) // 8, np.uint8)
    for r, raw in zip(met.column("range").to_pylist(), met.column("bits").to_pylist(), strict=True):
        out[r * size // 8:(r + 1) * size // 8] = np.frombuffer(raw, np.uint8)
    return out


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers, the first bytes of all numbers of a column first, as these compress better."""
    raw = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(struct.pack(f"<{len(raw)}q", *map(len, raw)) + b"".join(raw))


def _unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(types), []
    for size, kind in zip(struct.unpack_from(f"<{len(types)}q", raw), types, strict=True):
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


_SEGMENTS = ("<u2", "u1", "<i8", "u1")  # size, anchor's place, smallest id (less the one before), bytes
_PLACES = ("<u4", "<i4", "<i4", "<i8", "<i4")  # count, document's number (less the one before), start; ids (so, too), marks


def _records(source: DataFrame, repeated: np.ndarray, length: int, gram: int, bits: int, filter_bits: int) -> DataFrame:
    """``range``, ``kind`` (0: segments, 1: their places), ``tag`` and ``packed``."""
    shared = source.sparkSession.sparkContext.broadcast(repeated)

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, docs, tag = 0, 0, TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            h, g, n, a, start, row, ids, marks = (np.concatenate([x[i] for x in held]) for i in range(8))
            offset = np.cumsum([0, *(len(x[9]) for x in held[:-1])])
            at = np.concatenate([x[8] + o for x, o in zip(held, offset, strict=True)])  # where each document begins
            data = np.concatenate([x[9] for x in held])
            held.clear()
            # documents by number, in order
            order = np.lexsort((marks, ids))
            new = np.append(True, (np.diff(ids[order]) != 0) | (np.diff(marks[order]) != 0))
            number = np.empty(len(ids), np.int32)
            number[order] = np.cumsum(new) - 1
            ids, marks, number = ids[order][new], marks[order][new], number[row]
            order = np.lexsort((number, g, h))
            h, g, n, a, start, row, number = (x[order] for x in (h, g, n, a, start, row, number))
            new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
            count = np.diff(np.append(new, len(h)))
            of = _ranges(h[new], bits)
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            for x, y in zip(first, np.append(first[1:], len(new)), strict=True):
                own = x + np.argsort(number[new[x:y]], kind="stable")
                c, each = new[own], count[own]
                places = _ragged(c, each)
                doc, of_doc = np.unique(number[places], return_inverse=True)
                begin, some = at[row[c]] + start[c], 1 << 13
                bytes_ = np.concatenate([data[_ragged(begin[i:i + some], n[c[i:i + some]].astype(np.int64))] for i in range(0, len(c), some)])
                rows = [_pack(n[c], a[c], np.diff(ids[number[c]], prepend=0), bytes_),
                        _pack(each.astype("<u4"), np.diff(of_doc.ravel(), prepend=0).astype("<i4"), start[places],
                              np.diff(ids[doc], prepend=0), marks[doc])]
                yield pa.RecordBatch.from_arrays([pa.array([int(of[x])] * 2, pa.int64()), pa.array([0, 1], pa.int32()),
                                                  pa.array([tag] * 2, pa.int64()), pa.array(rows, pa.binary())],
                                                 ["range", "kind", "tag", "packed"])

        for b in portions(stream, 2, PORTION):
            data, ends = text_bytes(b.column(2))
            s = segments(data, ends, length, gram)
            cell = (s["hash"] >> np.uint64(64 - filter_bits)).astype(np.int64)
            some = np.flatnonzero(shared.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1)
            s = {x: v[some] for x, v in s.items()}
            if len(some):
                held.append((s["hash"], s["whole"], (s["end"] - s["start"]).astype("<u2"), (s["anchor"] - s["start"]).astype("u1"),
                             (s["start"] - ends[s["row"]]).astype("<i4"), (s["row"] + docs).astype(np.int32),
                             b.column(0).to_numpy(), b.column(1).to_numpy(), ends[:-1], data))
                size += len(some) + len(data) // 64
                docs += b.num_rows
            if size > FLUSH // 2:
                yield from flush()
                size, docs, tag = 0, 0, tag + 1
        if size:
            yield from flush()

    return source.mapInArrow(scan, "range long, kind int, tag long, packed binary")


class _Range:
    """The segments of one hash range, each with the smallest id of every window."""

    def __init__(self, blobs: dict[int, bytes], length: int, gram: int):
        parts = [_unpack(b, *_SEGMENTS) for b in blobs.values()]
        size, anchor, data = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3))
        size, anchor = size.astype(np.int64), anchor.astype(np.int64)
        least = np.concatenate([np.cumsum(p[2]) for p in parts])
        ends = np.cumsum(size)
        start = ends - size
        g = _string_hashes(data, ends)
        order = np.lexsort((least, g))
        new = np.append(True, g[order][1:] != g[order][:-1])
        number = np.empty(len(g), np.int32)
        number[order] = np.cumsum(new) - 1
        #: which segment each one of a record is
        self.of = dict(zip(blobs, np.split(number, np.cumsum([len(p[0]) for p in parts])[:-1]), strict=True))
        order = order[new]
        size, anchor, least, start = (x[order] for x in (size, anchor, least, start))
        self.windows = size - length + 1
        self.first = np.cumsum(self.windows) - self.windows
        #: the smallest id of each window of each segment: its own, until an equal window has a smaller one
        self.least = np.repeat(least, self.windows)
        side = (length - gram) // 2
        # windows that begin SIDE bytes or more before the anchor all hold those bytes; the others hold as many after it
        before = np.flatnonzero(anchor >= side)
        after = np.flatnonzero(anchor - side + 1 < self.windows)
        lead = np.maximum(anchor[after] - side + 1, 0)
        key = np.concatenate([_range_hashes(data, start[before] + anchor[before] - side, side + gram) ^ np.uint64(1),
                              _range_hashes(data, start[after] + anchor[after], length - side)])
        string = np.concatenate([before, after])
        skip = np.concatenate([np.zeros(len(before), np.int64), lead])
        count = np.concatenate([np.minimum(self.windows[before], anchor[before] - side + 1), self.windows[after] - lead])
        order = np.argsort(key, kind="stable")
        key = key[order]
        alike = np.zeros(len(key), bool)
        alike[1:] = key[1:] == key[:-1]
        alike[:-1] |= alike[1:]
        order, key = order[alike], key[alike]
        string, skip, count = string[order], skip[order], count[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        lo = 0
        while lo < len(key):
            more = new[np.searchsorted(new, lo + STRINGS):]
            hi = int(more[0]) if len(more) else len(key)
            self._transform(data, start, string[lo:hi], skip[lo:hi], count[lo:hi], least, length)
            lo = hi

    def _transform(self, data, start, string, skip, count, least, length) -> None:
        s, o, common = (np.concatenate(x) for x in zip(*transform(data, start[string] + skip, count + length - 1), strict=True))
        keep = o < count[s]
        # a suffix too short for a window ends a run, as it can't have so much in common with the one before
        run = np.cumsum(common < length)
        s, o, run = s[keep], o[keep], run[keep]
        at = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        low = np.minimum.reduceat(least[string[s]], at)
        window = self.first[string[s]] + skip[s] + o
        self.least[window] = np.minimum(self.least[window], np.repeat(low, np.diff(np.append(at, len(run)))))

    def gone(self, tag: int, blob: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """Ids and marks of the documents of one record of places, and the spans that go from each (packed), for
        places with some ``WINDOWS`` windows at a time."""
        count, number, start, ids, marks = _unpack(blob, *_PLACES)
        at, number, ids = np.repeat(self.of[tag], count), np.cumsum(number, dtype=np.int64), np.cumsum(ids)
        order = np.lexsort((start, number))  # the segments of a document have no window in common
        at, number, start = at[order], number[order], start[order].astype(np.int64)
        upto = np.cumsum(self.windows[at])
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + WINDOWS, "right")))
            found = self._spans(at[lo:hi], number[lo:hi], start[lo:hi], ids, length)
            if found:
                yield ids[found[0]], marks[found[0]], found[1]
            lo = hi

    def _spans(self, at, number, start, ids, length) -> tuple[np.ndarray, list[bytes]] | None:
        """Numbers of documents and the spans that go from each, of places in order of document and start."""
        n = self.windows[at]
        window = _ragged(self.first[at], n)
        goes = self.least[window] < np.repeat(ids[number], n)
        place = (np.repeat(start - self.first[at], n) + window)[goes]
        doc = np.repeat(number, n)[goes]
        if not len(doc):
            return None
        new = np.append(True, (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + length))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        spans = np.stack([place[first], place[last] + length], axis=1).astype("<i4")
        owner = doc[first]
        each = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        return owner[each], [spans[x:y].tobytes() for x, y in zip(each, np.append(each[1:], len(owner)), strict=True)]


def repeated_spans(source: DataFrame, total_bytes: int, length: int, gram: int, filter_bits: int) -> DataFrame:
    """``id``, ``mark`` and ``spans`` (packed pairs of start and end), any number of rows a document."""
    bits = min(filter_bits - 3, 20, max(0, (max(1, total_bytes) // RANGE_BYTES).bit_length()))
    repeated = _repeated(source, length, gram, bits, filter_bits)
    forget(source.sparkSession)
    records = _records(source, repeated, length, gram, bits, filter_bits)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, blobs, ready = None, {}, None
        for b in stream:
            for r, kind, tag, blob in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                if r != number:
                    number, blobs, ready = r, {}, None
                if kind == 0:
                    blobs[tag] = blob.as_py()
                    continue
                if ready is None:
                    ready, blobs = _Range(blobs, length, gram), {}
                for ids, marks, spans in ready.gone(tag, blob.as_py(), length):
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), pa.array(spans, pa.binary())],
                                                     ["id", "mark", "spans"])

    # a task for each range, and no more: all records of a task are one Arrow batch
    return records.repartitionById(1 << bits, F.col("range").cast("int")).sortWithinPartitions("range", "kind").mapInArrow(
        work, "id long, mark int, spans binary")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, filter_bits: int = FILTER_BITS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes)."""
    if not 8 <= gram < length <= 150:
        raise ValueError("needs 8 <= gram < length <= 150")
    source = _source(docs, id_col, text_col)
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spans = repeated_spans(source, total, length, gram, filter_bits)
    spans = spans.groupBy(F.col("id").alias("i"), F.col("mark").alias("m")).agg(F.collect_list("spans").alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches(stream):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(
                [z.compress((x.as_py() or "").encode()) for x in b.column(3)], pa.binary())], ["doc_id", "id", "mark", "text"])

    def finish(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches(stream):
            rows = []
            for raw, found in zip(b.column(1), b.column(2), strict=True):
                text = z.decompress(raw.as_py())
                pairs = np.frombuffer(b"".join(found.as_py() or ()), "<i4").reshape(-1, 2)
                rows.append((len(text), *cut(text, pairs.tolist())))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([r[3] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    texts = source.withColumn("doc_id", F.col("id").cast(kind)).select(
        F.when(F.col("id") != _NULL, F.col("doc_id")).alias("doc_id"), "id", "mark", "text").mapInArrow(
        pack, f"doc_id {kind}, id long, mark int, text binary")
    both = texts.join(spans, (F.col("id") == F.col("i")) & (F.col("mark") == F.col("m")), "left")
    return both.select("doc_id", "text", "spans").mapInArrow(
        finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")

"""Token ids of a collection as compact binary records, and back.

``write_ids`` puts the documents in order of their id (a range shuffle),
encodes their texts, appends an end id to each, and writes the stream of
ids as records of the coder in ``rangecoder``.  A record holds some
``RECORD`` ids of whole documents and an index of them (ids, number of
tokens), so it can be read alone.  Records are rows of Parquet files,
numbered by partition and place: Spark commits a task's files at once and
writes them again if the task is lost.

``read_ids`` reads the files and returns the ids of each document with
the number of ids before it.  Only one number for each file partition
goes through the driver.

Texts may be cut at blanks (``cut_at_blanks``) for tokenizers that drop
white space before anything else, as the word-level BPE here does; the
parts are encoded by the library and kept in a cache of at most ``CACHE``
parts (emptied when full).  Other tokenizers get whole texts.

Defined cases: a null or empty text has the end id alone; documents are
in order of id, a null id first, rows that share an id in order of their
text's hash (equal rows one after the other); strings of special tokens in
a text get the ids that the library gives by default; very long texts are
encoded whole, part by part; an empty table gives an empty table; columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rangecoder
from .common import batches
from .shingles import portions

RECORD = 3_000_000
PART_BYTES = 16 << 20  #: text for each partition
CACHE = 300_000
TOGETHER = 2000  #: parts encoded in one call
_SCHEMA = "part int, place int, first long, n_ids long, n_docs long, record binary"


@lru_cache(maxsize=1)
def _tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    return Tokenizer.from_str(definition), {}


def encode_texts(definition: str, texts: list[str | None], cut_at_blanks: bool) -> list[bytes]:
    """The ids of each text as packed little-endian unsigned 32-bit numbers."""
    own, cache = _tokenizer(definition)

    if not cut_at_blanks:
        return [np.array(e.ids, "<u4").tobytes()
                for e in own.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    parts = [t.split(" ") if t else () for t in texts]
    if len(cache) > CACHE:
        cache.clear()
    new = list(set().union(*parts).difference(cache))
    for i in range(0, len(new), TOGETHER):  # one text of many parts, taken apart by where its tokens start
        some = new[i:i + TOGETHER]
        found = own.encode(" ".join(some), add_special_tokens=False)
        ends = np.searchsorted([a for a, _ in found.offsets], np.cumsum([len(w) + 1 for w in some])).tolist()
        raw = np.array(found.ids, "<u4").tobytes()
        cache.update((w, raw[4 * a:4 * b]) for w, a, b in zip(some, [0, *ends], ends))
    return [b"".join(map(cache.__getitem__, p)) for p in parts]


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, cut_at_blanks: bool = False,
              id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the records of ``docs`` to ``path``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = F.col("doc_id"), F.hash("text")
    ordered = source.repartitionByRange(max(1, -(-total // PART_BYTES)), *order).sortWithinPartitions(*order)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, first = TaskContext.get().partitionId(), 0, 0
        end = struct.pack("<I", end_id)
        ids: list[bytes] = []
        names: list[int | None] = []

        def flush() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            index = np.array([[x is None, x or 0, len(i) // 4] for x, i in zip(names, ids, strict=True)], "<i8")
            head = struct.pack("<Q", len(names)) + zlib.compress(index.tobytes(), 1)
            record = struct.pack("<Q", len(head)) + head + rangecoder.write(flat)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([len(flat)], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([record], pa.binary())],
                ["part", "place", "first", "n_ids", "n_docs", "record"])

        size = 0
        for b in portions(stream, 1):
            for name, raw in zip(b.column(0).to_pylist(), encode_texts(shared.value, b.column(1).to_pylist(), cut_at_blanks), strict=True):
                names.append(name)
                ids.append(raw + end)
                size += len(ids[-1]) // 4
            if size >= RECORD:
                yield flush()
                ids, names, place, first, size = [], [], place + 1, first + size, 0
        if names:
            yield flush()

    ordered.mapInArrow(run, _SCHEMA).write.parquet(path)


def _index(record: bytes) -> tuple[np.ndarray, int]:
    """The index of a record (null flag, id, number of ids) and where the ids begin."""
    size, = struct.unpack_from("<Q", record)
    return np.frombuffer(zlib.decompress(record[16:8 + size]), "<i8").reshape(-1, 3), 8 + size


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it) and ``ids`` (array of int) of every document."""
    records = spark.read.schema(_SCHEMA).parquet(path)
    parts = records.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before = dict(zip([r["part"] for r in parts], np.cumsum([0, *(r["n"] for r in parts)]).tolist()))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, 1):
            record = b.column(2)[0].as_py()
            index, at = _index(record)
            ids = rangecoder.read(record[at:])
            ends = np.cumsum(index[:, 2])
            starts = ends - index[:, 2] + before[b.column(0)[0].as_py()] + b.column(1)[0].as_py()
            step = 4096
            for lo in range(0, len(index), step):
                own = index[lo:lo + step]
                bounds = np.append(0, np.cumsum(own[:, 2]))
                flat = ids[ends[lo] - own[0, 2]:ends[lo + len(own) - 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[:, 1], pa.int64(), mask=own[:, 0] == 1), pa.array(starts[lo:lo + step], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))],
                    ["doc_id", "start", "ids"])

    return records.select("part", "first", "record").mapInArrow(run, "doc_id long, start long, ids array<int>")


def with_crc32(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` (of the ids as unsigned 32-bit little-endian numbers)."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            ids = b.column(2)
            flat, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends), pa.int64()),
                                              pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

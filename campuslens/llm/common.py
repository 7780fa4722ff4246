"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BLOCK = 4096  #: bytes of one bitmap that Spark builds

#: A word: digits, a-z (after lower-casing A-Z) and every character beyond ASCII.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def normal_words(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z only; null for a null text."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"({WORD_CLASS})"), 1)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    The later jobs start from the stored rows, so lost executors cost no
    recomputation and the shuffle files behind ``df`` are free to go.
    """
    return saved_at(df, name)[0]


def saved_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``saved``, with the folder, for a table that ``emptied`` removes later."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def emptied(df: DataFrame, path: str) -> None:
    """Write a table without rows over a stored one that no later job reads."""
    _no_rows(df.sparkSession, df.schema).write.mode("overwrite").parquet(path)


def _no_rows(spark: SparkSession, schema: StructType) -> DataFrame:
    """A table without rows; one made of a Python list starts a Python process for each core."""
    return spark.range(0, 0, 1, 1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


class Scratch:
    """Stored tables of one operator in a folder of their own, removed together once its result is stored."""

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        self.spark, self.folder = spark, scratch_path(spark, f"llm-{name}")
        self.tables: list[tuple[weakref.ref, str]] = []  # frames hold their lists of files in the driver: not kept from here

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        """As the function ``saved``, in this folder."""
        path = f"{self.folder}/{len(self.tables) + 1}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((weakref.ref(out), path))
        return out

    def emptied(self, *tables: DataFrame) -> None:
        """As the function ``emptied``, for tables of this folder."""
        for ref, path in self.tables:
            if (df := ref()) is not None and any(df is t for t in tables):
                emptied(df, path)

    def removed(self) -> None:
        """Overwrite the folder with a table without rows: no later job may read from it."""
        _no_rows(self.spark, StructType().add("gone", "integer")).write.mode("overwrite").parquet(self.folder)
        forget(self.spark)


def repeated_bits(hashes: DataFrame, bits: int) -> bytes:
    """A bit for each value of the first ``bits`` bits of a hash (``hash``, a long), set if a row has it.

    The size is fixed (2 ** ``bits`` / 8 bytes), so it may go through the driver to every task; where many rows
    set all bits it lets all hashes pass, so whatever it is used for needs an exact step behind it."""
    cell = F.shiftrightunsigned("hash", 64 - bits) + 1
    blocks = hashes.groupBy(F.bitmap_bucket_number(cell).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits")).toArrow()
    out = bytearray(max((1 << bits) // 8, _BLOCK))
    for block, part in zip(blocks.column("block").to_pylist(), blocks.column("bits"), strict=True):
        out[(block - 1) * _BLOCK:block * _BLOCK] = part.as_py()
    return bytes(out)


def has_bit(filter_bits: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes have their bit set in ``repeated_bits``."""
    cell = (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return (filter_bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def forget(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of frames that are gone: it learns of them when the
    driver's JVM collects its garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key(*cols: Column) -> Column:
    """128 bits of a row's content, as hex text."""
    return F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))


_MODEL: dict = {}  #: the model at hand in this Python process, by its key


def model_at_hand(key: tuple, build: Callable[[], object]) -> object:
    """The model of this Python process, built unless the one at hand has the key.  Spark uses a process again
    for other operators, so it holds one model only, of whichever operator runs."""
    if key not in _MODEL:
        _MODEL.clear()
        _MODEL[key] = build()
    return _MODEL[key]


def let_go() -> None:
    """Drop the model at hand: an operator without one runs in this Python process."""
    _MODEL.clear()


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows,
    else ``df`` itself, which the planner then joins by a shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def batches(stream: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows (documents may be long)."""
    for b in stream:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def cut(text: bytes, spans: Iterable[Iterable[int]]) -> tuple[bytes, int, int]:
    """The text without the spans (start, end), the bytes removed and the number of maximal runs removed."""
    out, at, removed, runs = [], 0, 0, 0
    for start, end in sorted(spans):
        if end <= at:
            continue
        if start > at or not runs:
            runs += 1
            out.append(text[at:start])
            at = max(at, start)
        removed += end - at
        at = end
    out.append(text[at:])
    return b"".join(out), removed, runs

"""Hashes of words and word shingles of whole Arrow columns, without Python strings.

Words are those of ``common.WORD_CLASS``: runs of digits, letters (A-Z
lower-cased) and non-ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .common import let_go

MAX_BYTES = 2 << 20
_POWERS = 1 << 16

_rng = np.random.default_rng(20240229)
#: A random value for each byte; 0 for bytes outside words.
_VALUES = _rng.integers(1, 1 << 63, 256, np.uint64)
_VALUES[65:91] = _VALUES[97:123]
_VALUES[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0
_BASE = np.full(_POWERS, 0x9E3779B97F4A7C15, np.uint64)
_BASE[0] = 1
_PW = np.cumprod(_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def portions(stream: Iterable[pa.RecordBatch], text_at: int, max_bytes: int = MAX_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts hold about ``max_bytes`` (or are one row)."""
    let_go()
    for b in stream:
        _, ends = text_bytes(b.column(text_at))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + max_bytes, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column of text (null: none) and the n + 1 bounds of its rows."""
    if texts.type == pa.large_string():
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first byte of every word, and the n + 1 bounds of the rows' words."""
    value = _VALUES[data]
    inside = value != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    start[first] = inside[first]
    starts = np.flatnonzero(start)
    bounds = np.searchsorted(starts, ends)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, bounds
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    total = np.add.reduceat(value[starts[0]:] * _PW[place & (_POWERS - 1)], starts - starts[0])
    return mix(total), starts, bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words of a row, and the row of each; a row of fewer words (but
    not none) has one shingle of all its words."""
    count = np.diff(bounds)
    rows = np.arange(len(count))
    runs = np.maximum(count - n + 1, 0)
    row = np.repeat(rows, runs)
    at = np.arange(len(row)) + np.repeat(bounds[:-1] - (np.cumsum(runs) - runs), runs)
    total = np.zeros(len(row), np.uint64)
    for i in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[at + i]
    short = rows[(count > 0) & (count < n)]
    if len(short):
        few = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            own = bounds[short] + i
            here = i < count[short]
            few[here] = few[here] * np.uint64(0xD6E8FEB86659FD93) + words[own[here]] + np.uint64(i + 1)
        total, row = np.concatenate([total, few]), np.concatenate([row, short])
    return mix(total), row


def weighted(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each row in ascending order, how often each occurs, and the rows' bounds."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(r[at], np.arange(rows + 1))

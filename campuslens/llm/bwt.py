"""The Burrows-Wheeler transform and common prefixes of a collection of strings, column by column.

Each round puts one more symbol of every string in place, from the last
symbol to the first: the suffix that a string got in the round before is
extended by the symbol to its left, and its place among all suffixes so
far follows from the rank of that symbol in the transform (an LF step).
So every round reads the transform and the common prefix lengths once in
order, finds the places of the new suffixes and the prefix lengths around
them, and writes both out again with the new entries merged in.

Columns of up to ``CHUNK`` entries stay in memory; longer ones are files
that are read and written in order, chunk by chunk, so memory holds one
chunk and a few numbers for each string.  The files are a task's own work
space: no other task reads them, and they go when the transform ends.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from functools import cache

import numpy as np

CHUNK = 1 << 22
_MOST = 255  #: common prefixes are counted up to here


class _Column:
    """Numbers written in order, then read in order any number of times."""

    def __init__(self, folder: Callable[[], str], dtype: type, chunk: int):
        self.folder, self.dtype, self.chunk = folder, np.dtype(dtype), chunk
        self.held: list[np.ndarray] = []
        self.size, self.file = 0, None

    def write(self, part: np.ndarray) -> None:
        self.held.append(part.astype(self.dtype, copy=False))
        self.size += len(part)
        if self.size > self.chunk:
            if self.file is None:
                handle, self.file = tempfile.mkstemp(dir=self.folder())
                os.close(handle)
            with open(self.file, "ab") as f:
                for x in self.held:
                    x.tofile(f)
            self.held = []

    def read(self) -> Iterator[np.ndarray]:
        if self.file is None:
            if len(self.held) > 1:
                self.held = [np.concatenate(self.held)]
            yield from self.held
            return
        with open(self.file, "rb") as f:
            while len(part := np.fromfile(f, self.dtype, self.chunk)):
                yield part

    def drop(self) -> None:
        if self.file is not None:
            os.unlink(self.file)


class _Carry:
    """What earlier chunks leave for the first occurrence of each symbol in a later one."""

    def __init__(self):
        self.seen, self.new, self.low = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, np.uint8)


def _find(symbols: np.ndarray, common: np.ndarray, new: np.ndarray, base: np.ndarray, carry: _Carry, last: bool):
    """For one chunk: the new entries (local places) that get extended, the places of their
    extensions, and the places and values of the prefix lengths that follow from them."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    count = np.bincount(symbols, minlength=256)
    group = np.cumsum(count) - count
    fresh = np.zeros(n, bool)
    fresh[new] = True
    t = np.flatnonzero(fresh[order])
    t = t[t >= count[0]]  # symbol 0 is a string's end
    of = symbols[order[t]].astype(np.int64)
    place = base[of] + t - group[of]
    # neighbours of equal symbol, one of them new: the later one's prefix length
    after = t + 1
    fresh_or_after = np.zeros(n, bool)
    fresh_or_after[t[t > group[of]]] = True
    fresh_or_after[after[after < group[of] + count[of]]] = True
    ends = np.flatnonzero(fresh_or_after)
    cuts = np.empty(2 * len(ends), np.int64)
    cuts[::2], cuts[1::2] = order[ends - 1] + 1, order[ends] + 1
    low = np.minimum.reduceat(np.append(common, np.uint8(_MOST)), cuts)[::2] if len(ends) else np.zeros(0, np.uint8)
    of_end = symbols[order[ends]].astype(np.int64)
    where = base[of_end] + ends - group[of_end]
    if carry.seen.any() or not last:
        here = np.flatnonzero(count)
        here = here[here > 0]
        if carry.seen.any():
            first = order[group[here]]
            to = np.minimum.accumulate(common)[first]
            joint = carry.seen[here] & (carry.new[here] | fresh[first])
            where = np.append(where, base[here[joint]])
            low = np.append(low, np.minimum(carry.low[here], to)[joint])
        if not last:
            tail = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(_MOST))
            carry.low = np.minimum(carry.low, tail[0])
            final = order[group[here] + count[here] - 1]
            carry.low[here], carry.new[here], carry.seen[here] = tail[final + 1], fresh[final], True
    base += count
    return order[t], place, where, np.minimum(low, _MOST - 1) + np.uint8(1)


def transform(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, folder: str | None = None,
              chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All suffixes of the strings ``data[starts[i]:starts[i] + sizes[i]]`` (bytes below 255) in order,
    in chunks: the number of the suffix's string, its first place in the string, and the length of the
    prefix it has in common with the suffix before (0 for the first; counted up to 255).

    Empty suffixes come first, one for each string.  Equal suffixes come in the order of the strings.
    """
    m = len(starts)
    if not m:
        return
    width = int(sizes.max()) + 1
    with ExitStack() as until_done:
        own = cache(lambda: until_done.enter_context(tempfile.TemporaryDirectory(dir=folder)))

        def column(dtype):
            return _Column(own, dtype, chunk)

        def symbol(string: np.ndarray, round_: int) -> np.ndarray:
            """The symbol (byte + 1) left of the suffix of ``round_`` symbols; 0 at the start."""
            at = sizes[string] - 1 - round_
            return np.where(at >= 0, data[np.maximum(starts[string] + at, 0) % max(len(data), 1)].astype(np.int64) + 1
                            if len(data) else 0, 0).astype(np.uint8)

        string = np.arange(m)
        place = np.arange(m)
        bwt, common, who = column(np.uint8), column(np.uint8), column(np.int32 if m * width < 1 << 31 else np.int64)
        now = symbol(string, 0)
        bwt.write(now)
        common.write(np.zeros(m, np.uint8))
        who.write(string * width + sizes)
        total = np.bincount(now, minlength=256)
        for round_ in range(width - 1):
            base = np.concatenate([[0], m + np.cumsum(total[1:]) - total[1:]])
            carry, found, at = _Carry(), [], 0
            for b, c in zip(bwt.read(), common.read(), strict=True):
                lo, hi = np.searchsorted(place, (at, at + len(b)))
                local, to, where, low = _find(b, c, place[lo:hi] - at, base, carry, at + len(b) >= bwt.size)
                found.append((string[lo + np.searchsorted(place[lo:hi] - at, local)], to, where, low))
                at += len(b)
            string, to, where, low = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(string):
                break
            order = np.argsort(to)
            string, place = string[order], to[order]
            order = np.argsort(where)
            where, low = where[order], low[order]
            now = symbol(string, round_ + 1)
            total += np.bincount(now, minlength=256)
            gap = place - np.arange(len(place))  # entries of the old columns before each new one
            merged = column(bwt.dtype), column(common.dtype), column(who.dtype)
            at, before = 0, 0
            for b, c, w in zip(bwt.read(), common.read(), who.read(), strict=True):
                hi = len(gap) if at + len(b) >= bwt.size else int(np.searchsorted(gap, at + len(b)))
                lo, size = before, len(b) + hi - before
                new = place[lo:hi] - (at + lo)
                old = np.ones(size, bool)
                old[new] = False
                for out, part, value in zip(merged, (b, c, w), (
                        now[lo:hi], 0, string[lo:hi] * width + (sizes[string[lo:hi]] - 1 - round_)), strict=True):
                    x = np.empty(size, out.dtype)
                    x[old] = part
                    x[new] = value
                    if out is merged[1]:
                        u, v = np.searchsorted(where, (at + lo, at + lo + size))
                        x[where[u:v] - (at + lo)] = low[u:v]
                    out.write(x)
                at, before = at + len(b), hi
            for x in (bwt, common, who):
                x.drop()
            bwt, common, who = merged
        for c, w in zip(common.read(), who.read(), strict=True):
            w = w.astype(np.int64)
            yield w // width, w % width, c

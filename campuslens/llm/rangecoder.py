"""Adaptive context-mixing range coder for token ids below 65,536.

A stream of ids is cut into blocks of ``BLOCK`` ids.  Each block starts
from a fresh model, so it can be decoded alone, and carries the CRC-32 of
its ids.  Blocks are coded side by side: every step codes the next id of
all blocks, with one array operation for all of them.

An id's probability mixes three predictions.  Hash tables of the block
hold the id that followed the last two ids (order 2) and the last id
(order 1), each with a confidence; order 0 is the frequency of the ids in
the record, kept in its head.  The weights of the three adapt with every
id, apart for each pair of confidences and for whether orders 1 and 2
agree.

The coder keeps 64 bits of ``low`` and ``width`` and puts out 32-bit
words; where a range straddles a word it is cut short, so no carry is
ever passed on.  All arithmetic is on integers, so decoding repeats it
exactly on any machine.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
LIMIT = 1 << 16
_MAGIC = b"TIDS\x01\0\0\0"
_T1, _T2 = 10, 11  #: bits of the order-1 and order-2 tables
_WEIGHT = 15  #: bits of the weights
_LEAST = 64  #: no weight is less
_FREQ = 18  #: bits of the order-0 frequencies
_TOTAL = 30  #: bits of the mixed probabilities
_U = np.uint64


class Order0:
    """Frequencies (of 2 ** 18) of the ids of a record; every id in it has at least 1."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids, sizes
        ends = np.cumsum(sizes)
        self.start, self.size = np.zeros(LIMIT, np.int64), np.zeros(LIMIT, np.int64)
        self.start[ids], self.size[ids] = ends - sizes, sizes
        self.inverse = np.repeat(ids, sizes).astype(np.int32)

    @classmethod
    def of(cls, ids: np.ndarray) -> Order0:
        count = np.bincount(ids, minlength=1)
        own = np.flatnonzero(count)
        sizes = np.maximum(1, count[own] * ((1 << _FREQ) - len(own)) // max(1, len(ids)))
        if len(own):
            sizes[sizes.argmax()] += (1 << _FREQ) - sizes.sum()
        return cls(own, sizes)


class _Model:
    """The predictions of orders 1 and 2 and the weights of some blocks."""

    def __init__(self, n: int):
        self.at1, self.at2, self.way = (np.arange(n) << b for b in (_T1, _T2, 5))
        self.one, self.two = np.zeros(n << _T1, np.int32), np.zeros(n << _T2, np.int32)  # id + 1, confidence
        self.hit2, self.hit1 = (np.full(n << 5, 1 << _WEIGHT - 2, np.int32) for _ in range(2))
        self.last = self.before = np.zeros(n, np.uint32)

    def shrink(self, n: int) -> None:
        """Only the first n blocks go on."""
        self.at1, self.at2, self.way, self.last, self.before = (
            x[:n] for x in (self.at1, self.at2, self.way, self.last, self.before))

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids that orders 1 and 2 predict (-1: none), and where, of 2 ** 30, order 1 and order 0 begin."""
        mixed = self.last * np.uint32(0x9E3779B1)
        self.i1 = self.at1 + (mixed >> np.uint32(32 - _T1))
        mixed += self.before * np.uint32(0x85EBCA6B)
        mixed *= np.uint32(0xC2B2AE35)
        self.i2 = self.at2 + (mixed >> np.uint32(32 - _T2))
        self.e1, self.e2 = self.one.take(self.i1), self.two.take(self.i2)
        id1, id2 = (self.e1 >> 2) - 1, (self.e2 >> 2) - 1
        self.iw = self.way + (((id1 == id2).astype(np.int32) << 4) | ((self.e2 & 3) << 2) | (self.e1 & 3))
        self.w2, self.w1 = self.hit2.take(self.iw), self.hit1.take(self.iw)
        first = self.w2.astype(np.int64)
        second = first + (((1 << _WEIGHT) - first) * self.w1 >> _WEIGHT)
        return id1, id2, first << _TOTAL - _WEIGHT, second << _TOTAL - _WEIGHT

    def learn(self, ids: np.ndarray, right1: np.ndarray, right2: np.ndarray) -> None:
        most = (1 << _WEIGHT) - _LEAST
        self.hit2[self.iw] = self.w2 + ((np.where(right2, most, _LEAST) - self.w2) >> 5)
        self.hit1[self.iw] = np.where(right2, self.w1, self.w1 + ((np.where(right1, most, _LEAST) - self.w1) >> 5))
        fresh = (ids + np.int32(1)) << 2
        self.one[self.i1] = np.where(right1, self.e1 + ((self.e1 & 3) < 3), fresh)
        self.two[self.i2] = np.where(right2, self.e2 + ((self.e2 & 3) < 3), fresh)
        self.before, self.last = self.last, ids.astype(np.uint32)


_LOW32, _32 = _U(0xFFFFFFFF), _U(32)


def _narrow(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The width of ranges of under 32 bits, cut at the end of their 32-bit word."""
    straddles = (low >> _32) != ((low + (width - _U(1))) >> _32)
    return np.where(straddles, (_LOW32 - (low & _LOW32)) + _U(1), width)


def _sized(blocks: list, sizes: list[int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of blocks, their sizes, and how many have more than i ids, for each step i."""
    size = np.array(sizes, np.int64)
    if (np.diff(size) > 0).any():
        raise ValueError("blocks must be in order of size, largest first")
    return len(blocks), size, np.searchsorted(-size, -np.arange(size[0]), "left")


def encode_blocks(blocks: list[np.ndarray], order0: Order0) -> list[bytes]:
    """The coded words of each block; blocks must be in order of size, largest first."""
    if not blocks:
        return []
    n, size, going = _sized(blocks, [len(b) for b in blocks])
    grid = np.zeros((int(size[0]), n), np.int32)
    for i, b in enumerate(blocks):
        grid[:len(b), i] = b
    model, out, number = _Model(n), [], np.arange(n)
    whole_low, whole_width = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    low, width = whole_low, whole_width
    for ids, n in zip(grid, going.tolist(), strict=True):
        if n < len(low):
            model.shrink(n)
            low, width = whole_low[:n], whole_width[:n]
        ids = ids[:n]
        id1, id2, first, second = model.predict()
        right1, right2 = ids == id1, ids == id2
        rest, at, freq = (1 << _TOTAL) - second, order0.start.take(ids), order0.size.take(ids)
        start = second + (at * rest >> _FREQ)
        end = second + ((at + freq) * rest >> _FREQ)
        start, end = np.where(right1, first, start), np.where(right1, second, end)
        start, end = np.where(right2, 0, start), np.where(right2, first, end)
        part = width >> _U(_TOTAL)
        low += part * start.astype(np.uint64)
        np.multiply(part, (end - start).astype(np.uint64), out=width)
        few = np.flatnonzero(width <= _LOW32)
        if len(few):
            x = low[few]
            out.append((few, (x >> _32).astype(np.uint32)))
            width[few] = _narrow(x, width[few]) << _32
            low[few] = x << _32
        model.learn(ids, right1, right2)
    out += [(number, (whole_low >> _32).astype(np.uint32)), (number, (whole_low & _LOW32).astype(np.uint32))]
    of, word = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
    raw = word[np.argsort(of, kind="stable")].astype("<u4").tobytes()
    ends = np.cumsum(np.bincount(of, minlength=len(number))) * 4
    return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def decode_blocks(payloads: list[bytes], sizes: list[int], order0: Order0) -> list[np.ndarray]:
    """The ids of each block; blocks must be in order of size, largest first."""
    if not payloads:
        return []
    n, size, going = _sized(payloads, sizes)
    words = np.append(np.frombuffer(b"".join(payloads), "<u4"), np.zeros(4, np.uint32)).astype(np.uint64)
    ends = np.cumsum([len(p) // 4 for p in payloads])
    at = np.append(0, ends[:-1])
    grid = np.zeros((int(size[0]), n), np.int32)
    model = _Model(n)
    low, width = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    code = words[at] << _32 | words[at + 1]
    at += 2
    for ids, n in zip(grid, going.tolist(), strict=True):
        if n < len(low):
            model.shrink(n)
            low, width, code, at = (x[:n] for x in (low, width, code, at))
        id1, id2, first, second = model.predict()
        part = width >> _U(_TOTAL)
        value = np.minimum((code - low) // part, _U((1 << _TOTAL) - 1)).astype(np.int64)
        rest = (1 << _TOTAL) - second
        place = (np.maximum(value - second + 1, 1) << _FREQ) - 1
        found = order0.inverse.take(place // rest)
        start0, freq = order0.start.take(found), order0.size.take(found)
        start, end = second + (start0 * rest >> _FREQ), second + ((start0 + freq) * rest >> _FREQ)
        by1, by2 = value < second, value < first
        now = np.where(by2, id2, np.where(by1, id1, found))
        start, end = np.where(by1, first, start), np.where(by1, second, end)
        start, end = np.where(by2, 0, start), np.where(by2, first, end)
        low += part * start.astype(np.uint64)
        np.multiply(part, (end - start).astype(np.uint64), out=width)
        few = np.flatnonzero(width <= _LOW32)
        if len(few):
            x = low[few]
            width[few] = _narrow(x, width[few]) << _32
            low[few] = x << _32
            code[few] = code[few] << _32 | words.take(at[few], mode="clip")
            at[few] += 1
        # what a damaged block makes of the tables is caught by its checksum
        model.learn(now, now == id1, now == id2)
        ids[:n] = now
    return [grid[:s, i] for i, s in enumerate(size)]


def write(ids: np.ndarray) -> bytes:
    """A stream of ids as one record: magic; block size, number of ids, of blocks and of different ids; the
    different ids (16 bits) and their order-0 frequencies (32 bits); the length of each block and the CRC-32
    of its ids as 32-bit numbers; the blocks.  All numbers are unsigned and little-endian."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < LIMIT:
        raise ValueError(f"ids must be at least 0 and under {LIMIT}")
    blocks = [ids[i:i + BLOCK] for i in range(0, len(ids), BLOCK)]
    order0 = Order0.of(ids)
    payloads = encode_blocks(blocks, order0)
    table = np.array([[len(p), zlib.crc32(b.astype("<u4").tobytes())] for p, b in zip(payloads, blocks, strict=True)],
                     "<u4").reshape(-1, 2)
    return b"".join([_MAGIC, struct.pack("<IQII", BLOCK, len(ids), len(blocks), len(order0.ids)),
                     order0.ids.astype("<u2").tobytes(), order0.sizes.astype("<u4").tobytes(), table.tobytes(), *payloads])


def read(record: bytes) -> np.ndarray:
    """The ids of a record; raises if a block's checksum doesn't hold."""
    if record[:8] != _MAGIC:
        raise ValueError("not a record of token ids")
    block, total, n, different = struct.unpack_from("<IQII", record, 8)
    at = 28
    order0 = Order0(np.frombuffer(record, "<u2", different, at).astype(np.int64),
                    np.frombuffer(record, "<u4", different, at + 2 * different).astype(np.int64))
    at += 6 * different
    table = np.frombuffer(record, "<u4", 2 * n, at).reshape(n, 2).astype(np.int64)
    ends = at + 8 * n + np.cumsum(table[:, 0])
    payloads = [record[b - s:b] for s, b in zip(table[:, 0].tolist(), ends.tolist(), strict=True)]
    blocks = decode_blocks(payloads, [min(block, total - i * block) for i in range(n)], order0)
    for i, (b, crc) in enumerate(zip(blocks, table[:, 1].tolist(), strict=True)):
        if zlib.crc32(b.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
    return np.concatenate(blocks) if blocks else np.zeros(0, np.int32)

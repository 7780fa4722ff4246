"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A piece (a match of the split pattern) starts as its bytes.  A segment
tree over the byte positions holds, at the leaf of each live token, the
rank of the pair it forms with the next live token, and in every inner
node the smallest (rank, position) below it: the root is the leftmost
pair of minimum rank.  A merge changes three leaves (the merged token,
its left neighbour, and the token that is gone), each a walk of
logarithmic length to the root.

Short pieces are encoded together: the trees of all pieces of one width
are the rows of one array and one step performs a merge in each of them.
Pieces over ``SHORT`` bytes take the same steps in a tree of their own.

Documents are cut at every blank that is followed by a character that is
not white space.  The pattern always starts a match there, so the parts
can be matched apart, and parts seen before in the same Python worker
are taken from a cache of at most ``CACHE`` parts (emptied when full).

Defined cases: a null or empty text has no ids and decodes to no bytes;
each row is encoded on its own, so repeated rows give repeated results;
an empty table gives an empty result; columns other than the id and the
text are ignored, whatever their names.  Decoding raises on an id that
the rank file lacks.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import batches, model_at_hand

SHORT = 128
CACHE = 800_000
_INF = np.int64(1) << 62


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in order of rank (which is the id)."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


class Model:
    """Tokens, the rank of every pair of tokens that merges, and the cache."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        if missing := [b for b in range(256) if bytes([b]) not in self.ids]:
            raise ValueError(f"no token for the bytes {missing}")
        self.bytes = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for i, t in enumerate(tokens):
            for at in range(1, len(t)):
                a, b = self.ids.get(t[:at]), self.ids.get(t[at:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.split = regex.compile(pattern)
        self.head: dict[str, bytes] = {}
        self.tail: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair (a, b); ``_INF`` where the two don't merge or b is -1."""
        key = a << 32 | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.merged[at], _INF)

    def encode_long(self, piece: bytes) -> list[int]:
        """One piece, in a tree of its own."""
        n, inf, get = len(piece), int(_INF), self.pairs.get
        width = 1 << max(n - 1, 1).bit_length()
        tok, after, before = self.bytes[np.frombuffer(piece, np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [inf] * (2 * width)
        for i in range(n - 1):
            if (r := get(tok[i] << 32 | tok[i + 1])) is not None:
                tree[width + i] = r * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i := i >> 1:
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    return
                tree[i] = low

        while tree[1] < inf:
            rank, i = divmod(tree[1], width)
            gone = after[i]
            right = after[gone]
            tok[i], after[i], tok[gone] = rank, right, -1
            put(gone, inf)
            r = None
            if right < n:
                before[right] = i
                r = get(rank << 32 | tok[right])
            put(i, inf if r is None else r * width + i)
            if (left := before[i]) >= 0:
                r = get(tok[left] << 32 | rank)
                put(left, inf if r is None else r * width + left)
        return [t for t in tok if t >= 0]

    def encode_short(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of at most ``width`` bytes (a power of two) together; ids as packed int32."""
        p = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, p)
        col = np.arange(width)
        live = col < size[:, None]
        tok = np.full((p, width + 1), -1, np.int64)
        tok[:, :width][live] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(col + 1, (p, width)).copy()
        before = np.broadcast_to(col - 1, (p, width)).copy()
        tree = np.full((p, 2 * width), _INF)
        first = self.ranks(np.maximum(tok[:, :-1], 0).ravel(), tok[:, 1:].ravel()).reshape(p, width)
        tree[:, width:] = np.where(first < _INF, first * width + col, _INF)
        for lo in (1 << k for k in reversed(range(width.bit_length() - 1))):
            tree[:, lo:2 * lo] = np.minimum(tree[:, 2 * lo:4 * lo:2], tree[:, 2 * lo + 1:4 * lo:2])

        def put(row, at, value):
            at = at + width
            tree[row, at] = value
            for _ in range(width.bit_length() - 1):
                at = at >> 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])

        row = np.flatnonzero(tree[:, 1] < _INF)
        while len(row):
            rank, i = np.divmod(tree[row, 1], width)
            gone = after[row, i]
            right = after[row, gone]  # width or a dead column: tok is -1 there
            tok[row, i], after[row, i] = rank, right
            tok[row, gone] = -1
            inside = right < size[row]
            before[row[inside], right[inside]] = i[inside]
            put(row, gone, _INF)
            r = self.ranks(rank, np.where(inside, tok[row, right], -1))
            put(row, i, np.where(r < _INF, r * width + i, _INF))
            left = before[row, i]
            has = left >= 0
            at, left = row[has], left[has]
            r = self.ranks(tok[at, left], rank[has])
            put(at, left, np.where(r < _INF, r * width + left, _INF))
            row = row[tree[row, 1] < _INF]
        kept = tok[:, :width] >= 0
        ends = np.cumsum(kept.sum(axis=1)) * 4
        packed = tok[:, :width][kept].astype("<i4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed little-endian int32 ids of distinct pieces."""
        out, widths = {}, {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (whole := self.ids.get(raw)) is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(raw) > SHORT:
                out[piece] = np.array(self.encode_long(raw), "<i4").tobytes()
            else:
                widths.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for width, group in widths.items():
            for at in range(0, len(group), 1 << 20 >> width.bit_length()):
                some = group[at:at + (1 << 20 >> width.bit_length())]
                out.update(zip((x for x, _ in some), self.encode_short([r for _, r in some], width), strict=True))
        return out

    def learn(self, head: set[str], tail: set[str]) -> None:
        """Fill the cache with the parts of some documents."""
        if len(self.head) + len(self.tail) > CACHE:
            self.head.clear()
            self.tail.clear()
        split, parts = self.split.findall, []
        for cache, words, blank in ((self.head, head, ""), (self.tail, tail, " ")):
            # letters alone are one match of the pattern, with or without the blank
            parts += [(cache, w, (blank + w,) if w.isalpha() else split(blank + w)) for w in words.difference(cache)]
        known = self.encode_pieces(list({x for _, _, found in parts for x in found}))
        for cache, part, found in parts:
            cache[part] = known[found[0]] if len(found) == 1 else b"".join(map(known.__getitem__, found))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        plain, whole = {}, {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if _NOT_PLAIN(text):
                whole[i] = self.split.findall(text)
            else:
                plain[i] = text.split(" ")
        self.learn({w[0] for w in plain.values()}.union(*whole.values()),
                   set().union(*(w[1:] for w in plain.values())))
        head, tail = self.head.__getitem__, self.tail.__getitem__
        out = [b""] * len(texts)
        for i, w in plain.items():
            out[i] = head(w[0]) + b"".join(map(tail, w[1:]))
        for i, pieces in whole.items():
            out[i] = b"".join(map(head, pieces))
        return out


#: A blank before white space or at the end: such texts are matched as a whole.
_NOT_PLAIN = re.compile(r" (?:\s|$)").search


def model(tokens: list[bytes], pattern: str) -> Model:
    """The model of this Python process, built once."""
    key = hashlib.sha256(b"\0".join(tokens) + pattern.encode()).hexdigest()
    return model_at_hand(("bpe", key), lambda: Model(tokens, pattern))


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, packed)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((load_ranks(ranks_path), pattern))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType([source.schema["doc_id"], StructField("ids", ArrayType(IntegerType(), False), False)])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(*shared.value)
        for b in batches(stream):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(own.encode(b.column(1).to_pylist()))], ["doc_id", "ids"])

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (binary) of every row of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    source = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    schema = StructType([*source.schema.fields, StructField("decoded", BinaryType(), False)])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for b in batches(stream):
            ids = b.column(1)
            flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
            if len(flat) and flat[ends[0]:ends[-1]].min(initial=0) < 0:
                raise ValueError("an id is below 0")
            decoded = [b"".join(map(token, flat[x:y].tolist())) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(decoded, pa.binary())],
                                             ["doc_id", "ids", "decoded"])

    return source.mapInArrow(run, schema)

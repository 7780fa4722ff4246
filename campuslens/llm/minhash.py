"""Near-duplicate documents: ProbMinHash, banding and verification.

Documents are weighted sets: their shingles of ``n`` words, weighted by
how often they occur.  Each shingle sends a Poisson process of rate equal
to its weight, whose arrivals fall on random ones of ``BANDS * ROWS``
registers; a register keeps the shingle that arrives first.  A document's
arrivals end when every register is taken by an earlier one.  Registers
agree between two documents with the probability Jaccard of their sets.

1.  Documents of equal weighted sets are one node.
2.  A band is ``ROWS`` registers; nodes that agree in a band share a
    bucket.  Buckets are never expanded into all pairs: each node is
    paired with the bucket's smallest node and with its predecessor in an
    order that differs by bucket (large buckets are cut at random into
    parts of about ``PART`` for that).
3.  Verification computes the exact probability Jaccard of a pair, in two
    waves: the most alike pair of each node, then pairs still in different
    components.
4.  In buckets whose nodes are then still of several components, blocks of
    nodes are compared in pairs, sketches first: every pair of different
    components whose registers allow a similarity near the threshold is
    verified, the most alike first, until its components are joined.  So
    no class is split by a link that a bucket holds, and no pairs are put
    out but the links that join components.

Sketches, buckets, shingles and links are tables throughout; nothing that
grows with the corpus reaches the driver.

Defined cases: a document without words is a class of its own and never a
duplicate; one of fewer than ``n`` words has one shingle of all of them;
repeated rows are in one class; a null id is carried along, and a class of
null ids only has a null class id; an empty table gives an empty result;
columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batches, forget, saved
from .components import components
from .shingles import mix, portions, shingle_hashes, text_bytes, weighted, word_hashes

BANDS, ROWS = 24, 5  #: a pair of similarity 0.8 shares a bucket with probability 0.9999
PART = 1000
SIGMAS = 3.5  #: a pair is left out if its share of equal registers is so many standard deviations too low
BLOCK, BLOCK_BYTES = 256, 4 << 20
LIGHT_BLOCK = 1024  #: nodes compared together without their sets
MARK = 256  #: bits of the mark of a set


def prob_minhash(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray, registers: int) -> np.ndarray:
    """The 32-bit values of the registers of every document (a row; 0 if it has no shingle)."""
    docs = len(bounds) - 1
    first = np.full(docs * registers, np.inf)
    kept = np.zeros(docs * registers, np.uint64)
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    state, time, rate = hashes.copy(), np.zeros(len(hashes)), weights.astype(np.float64)
    element = hashes
    while len(doc):
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log1p(-(state >> np.uint64(11)).astype(np.float64) * 2.0 ** -53) / rate
        place = doc * registers + (mix(state ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = first[place] == time
        kept[place[won]] = element[won]
        last = first.reshape(docs, registers).max(axis=1)
        on = time < last[doc]
        state, time, rate, doc, element = state[on], time[on], rate[on], doc[on], element[on]
    return (kept >> np.uint64(32)).astype("<u4").reshape(docs, registers)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two weighted sets (ascending hashes, weights): the sum over the common elements d of
    1 / sum over all e of max(x_e / x_d, y_e / y_d)."""
    if x.max(initial=1) == 1 and y.max(initial=1) == 1:  # plain sets: plain Jaccard
        both = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a) if len(b) else 0
        return both / max(1, len(a) + len(b) - both)
    every = np.union1d(a, b)
    wx, wy = np.zeros(len(every)), np.zeros(len(every))
    wx[np.searchsorted(every, a)], wy[np.searchsorted(every, b)] = x, y
    with np.errstate(divide="ignore"):
        ratio = wx / wy
    order = np.argsort(-ratio, kind="stable")
    ratio, wx, wy = ratio[order], wx[order], wy[order]
    # elements of at least the ratio of d count by x, the others by y
    upto = np.searchsorted(-ratio, -ratio, "right")
    sum_x, sum_y = np.append(0, np.cumsum(wx)), np.append(0, np.cumsum(wy))
    both = (wx > 0) & (wy > 0)
    return float((1 / (sum_x[upto][both] / wx[both] + (sum_y[-1] - sum_y[upto][both]) / wy[both])).sum())


def _shingled(batch: pa.RecordBatch, at: int, n: int):
    data, ends = text_bytes(batch.column(at))
    words, _, bounds = word_hashes(data, ends)
    return weighted(*shingle_hashes(words, bounds, n), batch.num_rows)


def least_alike(threshold: float, registers: int) -> float:
    """The share of equal registers under which a pair is not looked at."""
    return threshold - SIGMAS * (threshold * (1 - threshold) / registers) ** 0.5


def pack(h: np.ndarray, w: np.ndarray) -> bytes:
    return h.astype("<u8").tobytes() + w.astype("<u4").tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n)


def marks(sets: list[np.ndarray]) -> list[bytes]:
    """The size of each set of hashes (4 bytes) and, for each of ``MARK`` classes of hashes, a bit that says whether it has an
    odd number of them."""
    if not sets:
        return []
    size = np.array([len(x) for x in sets])
    cell = np.repeat(np.arange(len(sets)) * MARK, size) + (mix(np.concatenate(sets) ^ np.uint64(17)) % np.uint64(MARK)).astype(np.int64)
    bits = np.packbits(np.bincount(cell, minlength=len(sets) * MARK).reshape(len(sets), MARK) & 1, axis=1)
    return [n.tobytes() + x.tobytes() for n, x in zip(size.astype("<u4"), bits, strict=True)]


def may_be_similar(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of marks (rows of bytes) may be of sets with a Jaccard of ``threshold`` or more.  An element that only one set of a pair has
    changes one bit, so as many elements differ as bits do, or as the sizes do, at least; no other pair is that similar."""
    n, m = (np.ascontiguousarray(z[:, :4]).view("<u4").ravel().astype(np.int64) for z in (x, y))
    differ = np.maximum(np.bitwise_count(x[:, 4:] ^ y[:, 4:]).sum(axis=1, dtype=np.int64), np.abs(n - m))
    return differ <= (n + m) * (1 - threshold) / (1 + threshold) + 1e-6


def _node(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def sketches(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``key`` (hash of id and text), ``node`` (16 bytes; null without words) and ``sketch`` of every row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("key"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(stream, 1):
            h, w, bounds = _shingled(b, 1, n)
            sketch = prob_minhash(h, w, bounds, BANDS * ROWS)
            nodes = [_node(pack(h[x:y], w[x:y])) if y > x else None for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(nodes, pa.binary()), pa.array([s.tobytes() for s in sketch], pa.binary())],
                ["doc_id", "key", "node", "sketch"])

    return source.mapInArrow(run, f"doc_id {id_type}, key long, node binary, sketch binary")


def _buckets(nodes: DataFrame) -> DataFrame:
    """``bucket`` and ``node``, for every band."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, 4096):
            sketch = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(b.num_rows, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (b.num_rows, BANDS))
            for i in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sketch[:, :, i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64).ravel()), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))],
                ["bucket", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "bucket long, node binary")


def _pairs(shared: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of each node with its bucket's smallest node and with its predecessor."""
    of = shared.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("size"))
    rows = shared.join(of, "bucket")
    order = F.xxhash64("node", "bucket")
    part = Window.partitionBy("bucket", F.pmod(order, F.ceil(F.col("size") / PART))).orderBy(order, "node")
    rows = rows.withColumn("before", F.lag("node").over(part))
    stars = rows.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    chain = rows.where("before IS NOT NULL").select(F.least("before", "node").alias("a"), F.greatest("before", "node").alias("b"))
    return stars.union(chain).distinct()


def _estimated(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """``pairs`` with ``alike`` (share of equal registers), where that is ``least`` or more."""
    sketch = nodes.select("node", "sketch")
    both = pairs.join(sketch.withColumnsRenamed({"node": "a", "sketch": "s"}), "a").join(
        sketch.withColumnsRenamed({"node": "b", "sketch": "t"}), "b").select("a", "b", "s", "t")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, 8192):
            s, t = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u4").reshape(b.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((s == t).mean(axis=1))], ["a", "b", "alike"])

    return both.mapInArrow(run, "a binary, b binary, alike double").where(F.col("alike") >= least)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose exact probability Jaccard is ``threshold`` or more."""
    both = pairs.select("a", "b").join(sets.withColumnsRenamed({"node": "a", "packed": "s"}), "a").join(
        sets.withColumnsRenamed({"node": "b", "packed": "t"}), "b").select("a", "b", "s", "t")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, 1024):
            score = [probability_jaccard(*unpack(s.as_py()), *unpack(t.as_py()))
                     for s, t in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], ["a", "b", "similarity"])

    return both.mapInArrow(run, "a binary, b binary, similarity double").where(F.col("similarity") >= threshold - 1e-12)


def _sets(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``node`` and ``packed`` weighted set of the wanted nodes (``node``, ``doc_id`` of one of their rows)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = own.join(wanted.select("doc_id").distinct(), own["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(stream, 0):
            h, w, bounds = _shingled(b, 0, n)
            packed = [pack(h[x:y], w[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(p) for p in packed], pa.binary()), pa.array(packed, pa.binary())],
                                             ["node", "packed"])

    return own.select("text").mapInArrow(run, "node binary, packed binary").dropDuplicates(["node"])


def _in_different(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends have different roots (a node that is not in ``roots`` is its own)."""
    out = pairs.join(roots.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left").join(
        roots.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left")
    return out.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def complete(shared: DataFrame, links: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float,
             scratch: Scratch, packed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The components (``node``, ``root``) of ``links`` and of all links between nodes that share a bucket.

    ``shared``: ``bucket``, ``node``; ``nodes``: ``node``, ``sketch`` (packed 32-bit registers); ``sets``: ``node``,
    ``packed`` (weighted set, as ``pack`` makes it; or what the function ``packed`` makes that of, in the last column) and,
    where the sets are plain, ``mark`` (as ``marks`` makes it) or not."""
    roots = components(links, scratch)
    at = shared.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = at.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket", "x")
    at = scratch.saved(at.join(mixed, "bucket"), "mixed")
    if at.isEmpty():  # no bucket holds nodes of two components
        return roots
    across = scratch.saved(_across(at, nodes, sets, threshold, scratch, packed), "across")
    forget(at.sparkSession)
    if across.isEmpty():
        return roots
    # every node of a component is linked to its root already, which takes fewer rounds than its own links
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(across), scratch)


def _across(at: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch,
            packed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links (a, b) that join different components in open buckets; ``at``: ``bucket``, ``node``, ``root`` and
    ``x``, the bucket's smallest root.

    Components that meet in buckets form a group, of which all pairs of nodes of different components are compared
    twice: by their sketches and marks, which says what nodes may have a link at all, then those nodes by their sets.
    Comparing a pair of blocks by sets puts out one link at most for each two components that it joins."""
    groups = components(at.where("root <> x").select(F.col("root").alias("a"), F.col("x").alias("b")).distinct(), scratch)
    own = at.select("node", "root").distinct().join(groups.select(F.col("node").alias("root"), F.col("root").alias("group")), "root")
    own = own.join(nodes.select("node", "sketch"), "node")
    own = own.join(sets.select("node", "mark"), "node") if "mark" in sets.columns else own.withColumn("mark", F.lit(None).cast("binary"))
    own = scratch.saved(own.select("group", "root", "node", "sketch", "mark"), "open")
    forget(at.sparkSession)

    def hopeful(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, 1):
            if len(found := _hopeful(*(b.column(i)[0].values for i in (0, 1)), threshold)):
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["node"])

    some = scratch.saved(_block_pairs(own, ["node", "root", "sketch", "mark"], LIGHT_BLOCK, scratch).mapInArrow(
        hopeful, "node binary").distinct(), "hopeful")
    forget(at.sparkSession)
    own = own.join(some, "node").join(sets.select("node", sets.columns[-1]), "node").select("group", "root", "node", "sketch", sets.columns[-1])
    own = packed(own) if packed else own

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, 1):
            found = _joining(*(b.column(i)[0].as_py() for i in (0, 1)), threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()),
                                                  pa.array([y for _, y in found], pa.binary())], ["a", "b"])

    return _block_pairs(own, ["node", "root", "sketch", "packed"], BLOCK, scratch).mapInArrow(run, "a binary, b binary")


def _block_pairs(own: DataFrame, columns: list[str], block: int, scratch: Scratch) -> DataFrame:
    """A group is cut into blocks of about ``block`` nodes, blocks of one component where it is that large, and each pair
    of blocks is one record of ``rows_x`` and ``rows_y``, unless both hold the same one component."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    many = own.groupBy("group", "root").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).withColumn(
        "one", F.when(F.col("n") >= block, F.col("root")).otherwise(F.lit(bytearray())))
    parts = many.groupBy("group", "one").agg(F.ceil(F.greatest(
        F.sum("n") / block, F.sum("bytes") / BLOCK_BYTES)).alias("parts"))
    dealt = own.join(many.select("group", "root", "one"), ["group", "root"]).join(parts, ["group", "one"])
    blocks = scratch.saved(dealt.groupBy("group", "one", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")).agg(
        F.collect_list(F.struct(*columns)).alias("rows")), "blocks")  # about ``block`` rows
    forget(own.sparkSession)
    key = blocks.select("group", "one", "part")
    x, y = (key.withColumnsRenamed({"one": f"one_{i}", "part": f"part_{i}"}) for i in "xy")
    before = (F.struct("one_x", "part_x") < F.struct("one_y", "part_y")) & ((F.octet_length("one_x") == 0) | (F.col("one_x") != F.col("one_y")))
    same = (F.octet_length("one_x") == 0) & (F.struct("one_x", "part_x") == F.struct("one_y", "part_y"))
    pairs = x.join(y, "group").where(before | same)
    for i in "xy":
        pairs = pairs.join(blocks.withColumnsRenamed({"one": f"one_{i}", "part": f"part_{i}", "rows": f"rows_{i}"}),
                           ["group", f"one_{i}", f"part_{i}"])
    return pairs.select("rows_x", "rows_y")


def _alike(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The number of equal registers of each sketch of ``s`` and each of ``t``."""
    alike = np.zeros((len(s), len(t)), np.int16)
    for i in range(s.shape[1]):
        alike += s[:, i, None] == t[:, i]
    return alike


def _hopeful(xs: pa.StructArray, ys: pa.StructArray, threshold: float) -> list[bytes]:
    """Nodes of both blocks that may have a link to a node of another component in the other, by sketches and marks."""
    xs, ys = ({c: z.field(c).to_pylist() for c in ("node", "root", "sketch", "mark")} for z in (xs, ys))
    s, t = (np.frombuffer(b"".join(z["sketch"]), "<u4").reshape(len(z["sketch"]), -1) for z in (xs, ys))
    number = {r: i for i, r in enumerate({*xs["root"], *ys["root"]})}
    x, y = (np.array([number[r] for r in z["root"]]) for z in (xs, ys))
    i, j = np.nonzero((_alike(s, t) >= least_alike(threshold, s.shape[1]) * s.shape[1]) & (x[:, None] != y))
    if len(i) and xs["mark"][0] is not None:
        a, b = (np.frombuffer(b"".join(z["mark"]), np.uint8).reshape(len(z["mark"]), -1) for z in (xs, ys))
        keep = [may_be_similar(a[i[k:k + (1 << 16)]], b[j[k:k + (1 << 16)]], threshold) for k in range(0, len(i), 1 << 16)]
        i, j = (z[np.concatenate(keep)] for z in (i, j))
    return [*{xs["node"][k] for k in np.unique(i)} | {ys["node"][k] for k in np.unique(j)}]


def _joining(xs: list[dict], ys: list[dict], threshold: float) -> list[tuple[bytes, bytes]]:
    """Links between nodes of different components, the most alike first, until no more components join."""
    up: dict[bytes, bytes] = {}

    def top(r: bytes) -> bytes:
        while (u := up.get(r, r)) != r:
            r = u
        return r

    s, t = (np.frombuffer(b"".join(r["sketch"] for r in rows), "<u4").reshape(len(rows), -1) for rows in (xs, ys))
    alike = _alike(s, t)
    sets = [[unpack(r["packed"]) for r in rows] for rows in (xs, ys)]
    i, j = np.nonzero(alike >= least_alike(threshold, s.shape[1]) * s.shape[1])
    out = []
    for k in np.argsort(-alike[i, j], kind="stable"):
        x, y = xs[i[k]], ys[j[k]]
        a, b = top(x["root"]), top(y["root"])
        if a != b and probability_jaccard(*sets[0][i[k]], *sets[1][j[k]]) >= threshold - 1e-12:
            up[max(a, b)] = min(a, b)
            out.append((x["node"], y["node"]))
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id``, ``key`` (hash of id and text), ``class_id`` (the smallest id
    of its class), ``class_size`` (rows), ``n_texts`` (different weighted sets) and ``first`` (true for the
    rows of one document of the class)."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.saved(sketches(docs, n, id_col, text_col), "sketches")
    nodes = scratch.saved(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("sketch").alias("sketch")), "nodes")
    every = _buckets(nodes)
    several = every.groupBy("bucket").count().where("count > 1").select("bucket")
    shared = scratch.saved(every.join(several, "bucket"), "buckets")
    pairs = scratch.saved(_estimated(_pairs(shared), nodes, least_alike(threshold, BANDS * ROWS)), "pairs")
    wanted = shared.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    sets = scratch.saved(_sets(docs, wanted, n, id_col, text_col), "sets")
    forget(docs.sparkSession)

    best = pairs.groupBy("a").agg(F.max_by("b", "alike").alias("b")).union(
        pairs.groupBy("b").agg(F.max_by("a", "alike").alias("a")).select("a", "b")).distinct()
    links = scratch.saved(_verified(best, sets, threshold).select("a", "b"), "wave")
    roots = components(links, scratch)
    rest = _in_different(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), roots)
    links = scratch.saved(links.union(_verified(rest, sets, threshold).select("a", "b")), "wave")
    roots = complete(shared, links, nodes, sets, threshold, scratch)
    forget(docs.sparkSession)

    # classes
    whole = rows.select("doc_id", "key", "node").join(roots, "node", "left").select(
        "doc_id", "key", "node", F.coalesce("root", "node").alias("root"))
    sizes = whole.where("root IS NOT NULL").groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"),
        F.count_distinct("node").alias("n_texts"), F.min(F.struct("doc_id", "key")).alias("least"))
    out = whole.where("root IS NOT NULL").join(sizes, "root").withColumn(
        "first", F.struct("doc_id", "key").eqNullSafe(F.col("least")))
    alone = whole.where("root IS NULL").select(
        "doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
        F.lit(0).cast("long").alias("n_texts"), F.lit(True).alias("first"))
    out = saved(out.select("doc_id", "key", "class_id", "class_size", "n_texts", "first").union(alone), "classes")
    scratch.removed()
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The first document (by id) of each class, once if its row is repeated; all columns as they were."""
    first = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("first").select(
        F.col("doc_id").alias("first_id"), F.col("key").alias("first_key")).distinct()
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"))
    kept = own.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")), "left_semi")
    return kept.dropDuplicates(["id", "key"]).select("row.*")

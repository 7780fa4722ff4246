"""Nearest neighbours by few stable projections and kd-trees.

Vectors are scaled to length 1, where a large cosine is a small Euclidean
distance, and projected on ``M`` Gaussian (2-stable) directions: the
squared projected distance of two points is their squared distance times
a chi-square variable of ``M`` degrees of freedom.

Index: split planes fitted on a sample of ``SAMPLE`` rows deal every row
to a leaf of the projected space; leaves of over ``BLOCK`` rows (a vector
may be repeated any number of times) are dealt on by a hash of the id.  A
block of rows is one stored record, and gets a kd-tree of its own when it
is searched.

Search: queries lie in chunks of at most ``CHUNK`` of one leaf.  A chunk is
joined with the blocks of its own leaf first, which bounds the distance
of each query's k-th neighbour, and then with every block that the stop
test can't rule out.  In a block, kd-tree leaves come in order of their
projected distance; their points are verified on the original vectors
until the test holds: a point as near as the k-th best found would have
been projected nearer than what is left with probability ``CONFIDENCE``.

Defined cases: rows whose id or vector is null, or whose vector is empty,
zero, or holds a null or non-finite component, take no part, nor do vectors
that are not of the most frequent length (the longer one of a tie);
repeated equal rows count once; rows that share an id but not the vector
are rows of their own, but no row of the query's id is its neighbour;
equal scores go to the smaller id; an empty table gives an empty result;
columns other than the id and the vector are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, saved

M = 8  #: even: the chi-square distribution then has a closed form
SAMPLE = 8192
BLOCK = 8192
CHUNK = 256
LEAF = 64
CONFIDENCE = 0.99
_SLACK = 1e-9  #: rounding of projected distances of equal points


def chi_square_quantile(p: float, m: int) -> float:
    """The value that a chi-square variable of an even ``m`` stays below with probability ``p``."""
    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # else a square may overflow
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _project(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return _unit(vectors) @ directions


def split_planes(points: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level, the split dimension and value of each of its nodes (heap order)."""
    groups, planes = [points], []
    for _ in range(depth):
        dims, values, below = [], [], []
        for g in groups:
            dim = int(np.ptp(g, axis=0).argmax()) if len(g) else 0
            value = float(np.median(g[:, dim])) if len(g) else 0.0
            left = g[:, dim] < value
            dims.append(dim)
            values.append(value)
            below += [g[left], g[~left]]
        planes.append((np.array(dims), np.array(values)))
        groups = below
    return planes


def leaf_of(points: np.ndarray, planes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for dims, values in planes:
        node = node * 2 + (points[np.arange(len(points)), dims[node]] >= values[node])
    return node


class Block:
    """Rows with a kd-tree over their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray):
        vectors = vectors.astype(np.float64)
        points = _project(vectors, directions)
        parts = [np.arange(len(ids))]
        while max(map(len, parts)) > LEAF:
            halves = []
            for p in parts:
                if len(p) <= LEAF:
                    halves.append(p)
                    continue
                dim = int(np.ptp(points[p], axis=0).argmax())
                order = p[np.argpartition(points[p, dim], len(p) // 2)]
                halves += [order[:len(p) // 2], order[len(p) // 2:]]
            parts = halves
        order = np.concatenate(parts)
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.ends = np.cumsum([0, *map(len, parts)])
        self.low = np.array([self.points[a:b].min(axis=0) for a, b in zip(self.ends, self.ends[1:])])
        self.high = np.array([self.points[a:b].max(axis=0) for a, b in zip(self.ends, self.ends[1:])])

    def search(self, query_id: int, query: np.ndarray, point: np.ndarray, k: int, reach: float,
               bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k found; ``bound`` is a known score of a k-th neighbour (or -inf)."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        near = (gap * gap).sum(axis=1)
        order = np.argsort(near, kind="stable")
        norm = np.sqrt((query * query).sum())
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 1
        while at < len(order):
            kth = max(bound, scores[k - 1] if len(scores) >= k else -np.inf)
            radius = reach * max(0.0, 2 - 2 * kth) + _SLACK if kth > -np.inf else np.inf
            if near[order[at]] > radius:
                break
            some = order[at:at + step]
            rows = np.concatenate([np.arange(self.ends[i], self.ends[i + 1]) for i in some[near[some] <= radius]])
            away = self.points[rows] - point
            rows = rows[((away * away).sum(axis=1) <= radius) & (self.ids[rows] != query_id)]
            # row by row, so that equal vectors get equal scores
            found = (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * norm)
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, found])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            at, step = at + step, min(step * 2, 16)
        return ids, scores


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id`` and ``vec`` (array of double) of the rows that take part."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    own = own.where("id IS NOT NULL AND vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) "
                    "AND abs(x) < double('infinity')) AND exists(vec, x -> x <> 0)")
    top = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return own.where(F.size("vec") == (top["n"] if top else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """One record for each (leaf, part): ``count``, ``ids`` and ``vecs`` as packed numbers, repeated rows once."""
    sizes = rows.groupBy("leaf").count().withColumn("parts", F.ceil(F.col("count") / size)).select("leaf", "parts")
    dealt = rows.join(F.broadcast(sizes), "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, vecs = table.column("id").to_numpy(), _matrix(table.column("vec").combine_chunks())
        order = np.lexsort((*vecs.T[::-1], ids))
        ids, vecs = ids[order], vecs[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (vecs[1:] != vecs[:-1]).any(axis=1)
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()),
                         "count": pa.array([int(new.sum())], pa.int64()), "ids": pa.array([ids[new].tobytes()], pa.binary()),
                         "vecs": pa.array([vecs[new].tobytes()], pa.binary())})

    return dealt.select("leaf", "part", "id", "vec").groupBy("leaf", "part").applyInArrow(
        pack, "leaf long, part long, count long, ids binary, vecs binary")


def nearest(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            seed: int = 7, confidence: float = CONFIDENCE) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (cosine) of the k nearest found for each
    row for which ``is_query`` (a condition on the column ``id``) holds."""
    own = usable(rows, id_col, vec_col)
    sample = np.array([r[0] for r in own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()])
    result = "query_id long, vec_id long, score double"
    if not len(sample):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    directions = np.random.default_rng(seed).standard_normal((sample.shape[1], M))
    depth = max(0, math.ceil(math.log2(own.count() / BLOCK)))
    planes = split_planes(_project(sample, directions), depth)
    reach = chi_square_quantile(confidence, M)

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, 4096):
            leaf = leaf_of(_project(_matrix(b.column(1)), directions), planes)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *b.columns], ["leaf", "id", "vec"])

    dealt = own.mapInArrow(deal, "leaf long, id long, vec array<double>")
    blocks = saved(_packed(dealt, BLOCK), "ann-blocks").withColumn("block", F.struct("leaf", "part"))
    chunks = saved(_packed(dealt.where(is_query), CHUNK), "ann-chunks")

    def boxes(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, 1):
            points = _project(np.frombuffer(b.column(3)[0].as_py()).reshape(b.column(2)[0].as_py(), -1), directions)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([points.min(axis=0).tolist()]),
                                              pa.array([points.max(axis=0).tolist()])], ["leaf", "part", "low", "high"])

    box = blocks.select("leaf", "part", "count", "vecs").mapInArrow(
        boxes, "leaf long, part long, low array<double>, high array<double>")

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches(stream, 1):
            r = {n: c[0].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}
            if held is None or held[0] != (r["leaf"], r["part"]):
                held = (r["leaf"], r["part"]), Block(np.frombuffer(r["ids"], np.int64),
                                                     np.frombuffer(r["vecs"]).reshape(r["count"], -1), directions)
            ids, vecs = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_vecs"]).reshape(r["q_count"], -1)
            bounds, out = dict(zip(r["b_ids"] or (), r["b_scores"] or (), strict=True)), []
            for i, v, p in zip(ids.tolist(), vecs, _project(vecs, directions), strict=True):
                found = held[1].search(i, v, p, k, reach, bounds.get(i, -np.inf))
                out += [(i, x, s) for x, s in zip(found[0].tolist(), found[1].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"query_id": [x[0] for x in out], "vec_id": [x[1] for x in out],
                                              "score": [x[2] for x in out]},
                                             schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()),
                                                               ("score", pa.float64())]))

    def searched(pairs: DataFrame) -> DataFrame:
        return (pairs.join(blocks.select("leaf", "part", "count", "ids", "vecs"), ["leaf", "part"])
                .sortWithinPartitions("leaf", "part").mapInArrow(search, result))

    mine = chunks.select(F.col("leaf").alias("q_leaf"), F.col("part").alias("q_part"), F.col("count").alias("q_count"),
                         F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    at_home = mine.join(box.select("leaf", "part"), F.col("q_leaf") == F.col("leaf")).withColumns(
        {"b_ids": F.lit(None).cast("array<long>"), "b_scores": F.lit(None).cast("array<double>")})
    first = saved(searched(at_home), "ann-first")
    top = first.withColumn("n", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k)
    kth = top.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))

    # what a chunk knows: the k-th score of each of its queries, and the box they reach
    def unpack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(stream, 1):
            r = {n: c[0].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}
            points = _project(np.frombuffer(r["q_vecs"]).reshape(r["q_count"], -1), directions)
            ids = np.frombuffer(r["q_ids"], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), r["q_leaf"])), pa.array(np.full(len(ids), r["q_part"])), pa.array(ids),
                 pa.array(points.tolist(), pa.list_(pa.float64()))], ["q_leaf", "q_part", "query_id", "point"])

    one = mine.mapInArrow(unpack, "q_leaf long, q_part long, query_id long, point array<double>")
    one = one.join(kth, "query_id", "left").withColumn(
        "radius", F.when(F.col("kth").isNull(), F.lit(float("inf"))).otherwise(
            F.sqrt(reach * F.greatest(2 - 2 * F.col("kth"), F.lit(0.0)) + _SLACK)))
    known = saved(one.groupBy("q_leaf", "q_part").agg(
        F.collect_list(F.when(F.col("kth").isNotNull(), F.struct("query_id", "kth"))).alias("b"),
        F.array(*(F.min(F.col("point")[i] - F.col("radius")) for i in range(M))).alias("q_low"),
        F.array(*(F.max(F.col("point")[i] + F.col("radius")) for i in range(M))).alias("q_high")), "ann-known")
    # (chunk, block) numbers only, and only where the two boxes meet
    meets = F.expr("forall(zip_with(q_low, high, (a, b) -> a <= b), x -> x) AND "
                   "forall(zip_with(low, q_high, (a, b) -> a <= b), x -> x)")
    pairs = known.join(box, (F.col("q_leaf") != F.col("leaf")) & meets)
    away = pairs.select("q_leaf", "q_part", "leaf", "part", F.col("b.query_id").alias("b_ids"),
                        F.col("b.kth").alias("b_scores")).join(mine, ["q_leaf", "q_part"])
    every = first.union(searched(away)).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from campuslens.llm import minhash as M
from campuslens.llm.common import Scratch

from .conftest import words


def shingles(text, n=5):
    w = (text or "").lower().split()
    return collections.Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) or collections.Counter([tuple(w)] if w else [])


def similarity(x, y):
    every = set(x) | set(y)
    return sum(1 / sum(max(x[f] / x[e], y[f] / y[e]) for f in every) for e in set(x) & set(y))


def classes(texts):
    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and similarity(sets[a], sets[b]) >= 0.8 - 1e-12:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in texts}


def edited(text, seed, k):
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
    return " ".join(w)


def test_probability_jaccard_equals_its_definition():
    r = random.Random(1)
    for _ in range(50):
        x, y = ({k: r.choice([1, 1, 2, 5]) for k in r.sample(range(12), r.randint(1, 9))} for _ in "xy")
        a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
        got = M.probability_jaccard(a, np.array([x[int(k)] for k in a]), b, np.array([y[int(k)] for k in b]))
        assert got == pytest.approx(similarity(collections.Counter(x), collections.Counter(y)))


def test_registers_agree_with_the_probability_jaccard():
    h = np.sort(M.mix(np.arange(1, 250, dtype=np.uint64)))  # the upper half of an element's hash is its value
    a, b = h[:199], h[49:]
    wa, wb = np.where(np.arange(len(a)) % 3 == 0, 4, 1), np.where(np.arange(len(b)) % 5 == 0, 3, 1)
    s = M.prob_minhash(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, len(a), len(a) + len(b)]), 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(M.probability_jaccard(a, wa, b, wb), abs=0.03)


def test_classes_equal_brute_force_with_a_chain_and_a_large_group(docs, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)  # so that blocks are compared in pairs
    base = words(1, 120)
    texts = {i: edited(base, i, 1 + i % 5) for i in range(60)}
    texts |= {100 + i: words(200 + i, 80) for i in range(20)}
    texts |= {200: words(200, 80), 201: None, 202: "", 203: "two words", 204: "two words", 205: "two other", 206: "x y " * 50}
    chain = words(9, 100).split()
    texts |= {300 + i: " ".join(chain[4 * i:4 * i + 70]) for i in range(6)}
    got = {r.doc_id: r.class_id for r in M.near_duplicates(docs(list(texts.items()))).collect()}
    assert got == classes(texts)


def test_awkward_rows_and_one_of_each(awkward, docs):
    rows = M.near_duplicates(awkward).collect()
    assert len(rows) == 8 and {r.class_id for r in rows if r.doc_id == 6} == {6}
    kept = M.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6]
    assert M.near_duplicates(docs([])).collect() == []


def test_large_equal_group_has_one_class(docs):
    df = docs([(0, words(3, 60))]).select("text").crossJoin(docs([(0, "")]).sparkSession.range(2000).select(F.col("id").alias("doc_id")))
    got = M.near_duplicates(df).agg(F.count_distinct("class_id"), F.min("class_size")).first()
    assert tuple(got) == (1, 2000)


def test_components_are_sought_once_where_no_bucket_holds_two(spark, monkeypatch):
    calls, real = [], M.components
    monkeypatch.setattr(M, "components", lambda links, scratch: calls.append(1) or real(links, scratch))
    a, b, c = (bytes([i]) * 16 for i in (1, 2, 3))
    shared = spark.createDataFrame([(1, a), (1, b), (2, b), (2, c)], "bucket long, node binary")
    links = spark.createDataFrame([(a, b), (b, c)], "a binary, b binary")
    nodes, sets = (spark.createDataFrame([], f"node binary, {x} binary") for x in ("sketch", "packed"))
    found = M.complete(shared, links, nodes, sets, 0.8, Scratch(spark, "test"))
    assert sorted((bytes(r.node), bytes(r.root)) for r in found.collect()) == [(a, a), (b, a), (c, a)]
    assert len(calls) == 1


def test_marks_rule_out_no_similar_pair():
    r = np.random.default_rng(3)
    near, far = [], []
    for trial in range(400):
        size = int(r.integers(16, 900))
        x = r.integers(1, 1 << 63, size, np.uint64)
        y = x.copy()
        changed = r.choice(size, int(r.integers(0, 1 + size // 9 + 3)), replace=False)
        y[changed] = r.integers(1, 1 << 63, len(changed), np.uint64)
        y = np.unique(y[int(r.integers(0, 1 + size // 10)):])
        x = np.unique(x)
        common = len(np.intersect1d(x, y))
        if common >= 0.8 * (len(x) + len(y) - common):
            near.append((x, y))
        if size < 300:
            far.append((x, r.integers(1, 1 << 63, size, np.uint64)))
    both = [np.frombuffer(b"".join(M.marks([p[i] for p in near + far])), np.uint8).reshape(len(near) + len(far), -1) for i in (0, 1)]
    kept = M.may_be_similar(*both, 0.8)
    assert len(near) > 50 and kept[:len(near)].all() and not kept[len(near):].any()


def test_sets_are_only_sent_for_nodes_that_may_have_a_link(spark, monkeypatch):
    """Of a bucket of 30 components with equal sketches, the marks leave the two that are alike."""
    r = np.random.default_rng(9)
    sets = [np.sort(r.integers(1, 1 << 63, 60, np.uint64)) for _ in range(29)]
    sets.append(np.sort(np.append(sets[4][:-2], r.integers(1, 1 << 63, 2, np.uint64))))
    nodes = [bytes([i + 1]) * 16 for i in range(30)]
    frame = spark.createDataFrame([(n, bytearray(48), bytearray(m), bytearray(M.pack(x, np.ones(len(x))))) for n, m, x in
                                   zip(nodes, M.marks(sets), sets, strict=True)], "node binary, sketch binary, mark binary, packed binary")
    shared, links = frame.selectExpr("1L AS bucket", "node"), spark.createDataFrame([], "a binary, b binary")
    stored, sent = Scratch.saved, []

    def saved(self, df, name):
        out = stored(self, df, name)
        if name == "blocks" and "packed" in out.schema.simpleString():
            sent.extend(x.node for row in out.collect() for x in row.rows)
        return out
    monkeypatch.setattr(Scratch, "saved", saved)
    for columns in (["node", "mark", "packed"], ["node", "packed"]):
        sent.clear()
        roots = M.complete(shared, links, frame.select("node", "sketch"), frame.select(*columns), 0.8, Scratch(spark, "test"))
        assert {(bytes(x.node), bytes(x.root)) for x in roots.collect()} == {(nodes[4], nodes[4]), (nodes[29], nodes[4])}
        assert len(sent) == (2 if "mark" in columns else 30)

"""Nearest neighbours, decontamination, BPE, language identification, registration and the pipeline."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from campuslens.llm import ann, bpe, decontaminate, langid
from campuslens.llm.common import read_table
from campuslens.llm.queries import ORACLE, QUERIES

from .conftest import words

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


# ---- nearest neighbours

def nearest_by_hand(rows, k, queries):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    n = max({len(v) for _, v in ok}, key=lambda n: (sum(len(v) == n for _, v in ok), n))
    ok = sorted((i, v) for i, v in ok if len(v) == n)
    out = {}
    for q, v in ok:
        if q in queries:
            v = np.array(v)
            s = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12), i) for i, w in ok if i != q]
            out[q] = [i for _, i in sorted(s)[:k]]
    return out


def test_neighbours_with_awkward_vectors_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "CHUNK", 4)
    r = np.random.default_rng(3)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(90)]
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, None] + [0.0] * 6), (404, [float("nan")] * 8),
             (405, [float("inf")] * 8), (406, [1.0, 2.0]), (None, [1.0] * 8), (50, rows[50][1]), (407, [1e200] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit(1)).withColumn("vec", F.lit("x"))
    got = {}
    for x in ann.nearest(df, F.col("id") % 50 == 0, confidence=0.9999).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    want = nearest_by_hand(rows, 5, set(range(0, 2000, 50)))
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.99 * 5 * len(want)
    assert got[1000] == want[1000]  # ninety equal vectors: the smaller ids
    assert ann.nearest(df.where("vec_id IN (400, 402)"), F.col("id") % 50 == 0).collect() == []
    assert len(ann.nearest(df.where("vec_id IN (50, 51, 52)"), F.col("id") % 50 == 0).collect()) == 2


def test_recall_on_the_table(spark):
    rows = read_table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    want = nearest_by_hand([(r.vec_id, r.embedding) for r in rows], 5, {r.vec_id for r in rows if r.vec_id % 50 == 0})
    got = {}
    for x in QUERIES["op5_nearest_neighbours"](spark, SF).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


# ---- decontamination

def contamination_by_hand(docs, items, n=10):
    import re
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = {}
    for i, t in items:
        w = split(t)
        k = min(n, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[p:p + k]), set()).add(i)
    for _, t in docs:
        w, hit, found = split(t), set(), set()
        for window, ids in windows.items():
            for p in range(len(w) - len(window) + 1):
                if tuple(w[p:p + len(window)]) == window:
                    hit |= set(range(p, p + len(window)))
                    found |= ids
        yield len(w), len(hit), sorted(str(x) for x in found if x is not None)


@pytest.mark.parametrize("bound", [10 ** 6, 0])
def test_contamination_equals_brute_force(spark, docs, awkward, bound):
    items = [(1, words(1, 30)), (2, words(2, 10)), (3, "Three Little-words"), (4, "één"), (5, None), (6, " .,"), (10, words(1, 30)), (None, words(3, 12))]
    rows = [(1, words(9, 20) + " " + " ".join(words(1, 30).split()[5:25]) + " " + words(8, 20)), (2, "THREE little!words x één"),
            (3, words(2, 9)), (4, words(2, 10).replace(" ", "\n")), (5, None), (6, ""), (7, words(3, 12) * 2), (7, "één")]
    out = decontaminate.decontaminate(docs(rows), spark.createDataFrame(items, "item_id long, text string"), max_broadcast_rows=bound)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.items, sum(b - a + 1 for a, b in r.hit_spans)) for r in out.collect())
    want = sorted((i, n, h, x, h) for (i, _), (n, h, x) in zip(rows, contamination_by_hand(rows, items), strict=True))
    assert got == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.decontaminate(awkward, none).collect()] == [False] * 8
    assert decontaminate.clean_documents(awkward, none).columns == awkward.columns
    assert decontaminate.decontaminate(docs([]), none).collect() == []


def test_contaminated_rows_go_by_id_and_text(spark, docs):
    item = words(9, 15)
    rows = [(None, "before " + item), (None, words(10, 30)), (1, item + " after"), (1, words(11, 30)), (2, words(12, 30)), (None, None), (3, None)]
    left = decontaminate.clean_documents(docs(rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(str(r) for r in rows if item not in (r[1] or ""))


# ---- byte-level BPE

def test_ids_equal_the_library_and_come_back(spark, docs, awkward):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    alphabet = " \n\t  a'sé1٣中國　\x1c\x85​_.-!Zß́🙂\u0000ⅷ²"
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))) for i in range(500)]
    rows += [(1000, "ab" * 4000), (1001, " " * 900 + "x"), (1002, "<|endoftext|>"), (1003, None), (1004, "don't we'll"), (1004, "twice"), (1004, "twice")]
    df = docs(rows)
    got = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted((x.doc_id, x.ids, bytes(x.decoded)) for x in got) == sorted(
        (i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert bpe.encode(awkward, RANKS, public_tokenizers.PATTERN).count() == 8
    assert bpe.decode(bpe.encode(docs([]), RANKS, public_tokenizers.PATTERN), RANKS).collect() == []


def test_long_and_short_pieces_take_the_same_merges():
    model = bpe.Model(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    r = random.Random(2)
    pieces = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 100))).encode() for _ in range(200)]
    assert model.encode_short(pieces, 128) == [np.array(model.encode_long(p), "<i4").tobytes() for p in pieces]


# ---- language identification

def test_languages_on_the_held_out_fold(spark):
    truth = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    rows = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_words_then_ngrams_and_awkward_rows(spark, docs, awkward):
    rows = [("en", "the house and the garden")] * 3 + [("de", "das haus und der garten")] * 3 + [(None, "x"), ("fr", None)]
    train = spark.createDataFrame(rows, "lang string, text string").withColumn("doc_id", F.monotonically_increasing_id())
    model = langid.learn(langid.training_rows(train))
    scorer = langid.Scorer(model)
    assert model["langs"] == ["de", "en"]
    assert scorer.predict("the house")[0] == "en" and scorer.predict("haus und")[0] == "de"
    assert scorer.predict("hausgarten")[0] == "de" and scorer.predict("gardens")[0] == "en"  # unseen: by their n-grams
    for text in (None, "", " \n", "123 ²", "!!!"):
        assert scorer.predict(text) == ("und", 0.0)
    out = langid.predict(awkward, model).collect()
    assert len(out) == 8 and all(0 <= r.score <= 1 for r in out)
    assert langid.accepted(awkward, model).columns == awkward.columns
    nothing = langid.learn(train.limit(0).select("lang", "text"))
    assert {r.lang_pred for r in langid.predict(awkward, nothing).collect()} == {"und"}
    assert langid.predict(docs([]), model).collect() == []
    bounded = langid.training_rows(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("a").alias("text")),
                                   docs_per_lang=500).count()
    assert 400 < bounded < 600


# ---- registration and pipeline

def test_every_operator_has_a_query():
    for n in range(1, 11):
        assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1
    assert set(ORACLE) <= set(QUERIES)


def test_sql_of_decontamination(spark):
    from oracle_compare import digest, duck
    df = QUERIES["op8_decontaminate"](spark, SF)
    rel = duck(SF).execute(ORACLE["op8_decontaminate"])
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest([c[0] for c in rel.description], rel.fetchall())


def test_pipeline_stages_take_effect(spark, docs):
    import corpus_pipeline as C
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    item = read_table(spark, SF, "benchmark").first().text
    base = [words(100 + i, 90, 3000) for i in range(8)]
    passage = " ".join(w.capitalize() + ("." if k % 10 == 9 else "") for k, w in enumerate(words(50, 60, 3000).split()))
    texts = [*base, base[0], base[1] + " more", "", "12345", base[2] + " " + item, words(70, 50, 3000) + ".\n" + passage,
             words(71, 50, 3000) + ". " + passage]
    own = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], schema)
    at = own
    left = []
    for name, stage in C.STAGES:
        at = stage(spark, at, SF)
        at = C.saved(at, f"test-{name}")
        left.append({r.doc_id for r in at.select("doc_id").collect()})
        if name == "substrings":
            kept = {r.doc_id: r for r in at.collect()}
            assert passage in kept[13].text and passage not in kept[14].text and kept[14].n_chars == len(kept[14].text)
        if name != "tokens":
            assert at.columns == own.columns
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "substrings", "decontaminate", "tokens"]
    every = set(range(15))
    assert left[0] == every - {10, 11} and left[1] == left[0] - {8, 9} and left[2] == left[1] and left[3] == left[2] - {12}
    assert left[4] == left[3]


def test_pipeline_stages_with_any_rows_and_columns(spark, docs):
    import corpus_pipeline as C
    from .conftest import AWKWARD
    clash = {n: F.lit("x") for n in ("removed", "key", "a b", "spans", "row", "rest", "score")}
    rows = docs([(i, t, "en", "s", None if t is None else len(t)) for i, t in AWKWARD] + [(i, words(i, 80), "en", "s", 9) for i in range(20, 26)],
                "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash)
    for frame in (rows, rows.limit(0)):
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == frame.columns, name
            assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in frame.collect()}
        assert C.STAGES[-1][1](spark, frame, SF).count() == frame.count()


def test_op1_columns_and_op10_null_ids(spark):
    assert QUERIES["op1_url_filter"](spark, SF).columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert "held_out" in QUERIES["op10_language_id"](spark, SF).where("held_out IS NOT NULL").columns


def test_a_python_process_holds_one_model_only():
    import gc
    import weakref

    import pyarrow as pa

    from campuslens.llm import bpe, langid, shingles
    first = weakref.ref(bpe.model([bytes([i]) for i in range(256)], r"\S+|\s+"))
    assert first() is not None
    empty = (pa.array([], pa.string()), np.zeros((0, 1), np.float32))
    second = weakref.ref(langid._ready({"key": "k", "langs": ["en"], "tables": dict.fromkeys(range(langid.MAX_N + 1), empty)}))
    gc.collect()
    assert first() is None and second() is not None
    list(shingles.portions([], 0))  # an operator without a model
    gc.collect()
    assert second() is None

import numpy as np
from pyspark.sql import functions as F

from campuslens.llm import quality as Q

from .conftest import words


def test_weights_equal_counts_by_hand(docs):
    texts = {1: "good words here", 2: "good words there, yes", 3: "!!! BAD bad !!!", 4: None, 5: ""}
    df = docs(list(texts.items()))
    ids = df.where("doc_id <= 2").select(F.col("doc_id").alias("id"))
    got = {r.doc_id: r.log_weight for r in Q.weigh(df, Q.learn(df, ids, "doc_id", "text"), 1, "doc_id", "text").collect()}

    def buckets(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        return Q.grams(raw, np.array([0, len(raw)]))[0]
    target, raw = np.ones(Q.BUCKETS), np.ones(Q.BUCKETS)
    for i, t in texts.items():
        np.add.at(raw, buckets(t), 1)
        if i <= 2:
            np.add.at(target, buckets(t), 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for i, t in texts.items():
        assert abs(got[i] - ratio[buckets(t)].sum()) < 1e-9


def test_tokens_are_words_and_signs():
    raw = np.frombuffer("ab, ab ab!!".encode(), np.uint8)
    bucket, row = Q.grams(raw, np.array([0, len(raw)]))
    # ab | , | ab | ab | !! and four pairs of neighbours
    assert len(bucket) == 9 and bucket[0] == bucket[2] == bucket[3] and set(row) == {0}


def test_top_k_is_exact_with_ties(spark, monkeypatch):
    monkeypatch.setattr(Q, "LAST", 10)
    rows = [(i, float((i * 37) % 50)) for i in range(500)] + [(1000 + i, 7.0) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, g double")
    for k in (0, 1, 77, 123, 300, 599, 600, 1000):
        kept = {r.doc_id for r in Q.with_top_k(df, "g", k, ["doc_id"]).where("kept").collect()}
        assert kept == {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}


def test_good_texts_are_kept_and_rows_are_whole(docs, awkward):
    good = [(i, words(i, 60)) for i in range(80)]
    bad = [(100 + i, "$$$ WIN !!! %%% " * 20) for i in range(20)]
    out = Q.resample(docs(good + bad), docs(good[:40]).select("doc_id"), 0.8).collect()
    assert {r.doc_id for r in out if r.kept} == set(range(80)) and len(out) == 100
    assert len(Q.resample(awkward, awkward.select("doc_id"), 0.5).collect()) == 8
    assert Q.resample(docs([]), docs([]).select("doc_id"), 0.5).collect() == []
    assert sum(r.kept for r in Q.resample(docs(good), docs([]).select("doc_id"), 0.5).collect()) == 40

"""Phrases against plain counting, and the query against its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from campuslens.llm import phrases
from campuslens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
ROW = "doc_id long, text string, lang string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts_by_hand(rows):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
    return f, n


def ranked_by_hand(rows, threshold, first):
    f, n = counts_by_hand(rows)
    out = []
    for lang, c in f.items():
        c = {p: a for p, a in c.items() if a >= threshold}
        best = []
        for p, a in c.items():
            w = p.split(" ")
            if len(w) < 2:
                continue
            cut = [(2_000_000 * a // (c[" ".join(w[:k])] + c[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cut)
            longer = [b for q, b in c.items() if len(q.split(" ")) > len(w)
                      and f" {p} " in f" {q} " and 100 * b >= 80 * a]
            if not longer:
                best.append((-score, -a, p.encode(), c[" ".join(w[:k])], c[" ".join(w[k:])]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:first])]
    return sorted(out)


def found(df):
    return sorted((r["lang"], r["length"], bytes(r["phrase"]).decode(), r["n"]) for r in df.collect())


def wanted(rows, threshold):
    f, n = counts_by_hand(rows)
    some = [(lang, len(p.split(" ")), p, a) for lang, c in f.items() for p, a in c.items() if a >= threshold]
    return sorted(some + [(lang, 0, "", x) for lang, x in n.items() if x])


def corpus(seed, n=100, vocabulary=30):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice(["The", "a b", "c\td", "é", "x,y", "end.", "q\n", " "] + ["w%d" % min(r.randrange(1, vocabulary), r.randrange(1, vocabulary))] * 6)
                 for _ in range(r.randrange(60))]
        rows.append((i if i % 7 else None, " ".join(words) if i % 11 else None, r.choice(["en", "de", None, "und"])))
    return rows + rows[:20]


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLE["op11_phrase_collocations"]).fetchall()
    got = QUERIES["op11_phrase_collocations"](spark, SF)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


@pytest.mark.parametrize("shards,cells", [(1, 1 << 12), (2, 4), (3, 64)])
def test_counts_for_any_shards_and_cells(spark, monkeypatch, shards, cells):
    monkeypatch.setattr(phrases, "_size", lambda words: cells)
    monkeypatch.setattr(phrases, "TOGETHER", 500)
    rows = corpus(shards)
    df = spark.createDataFrame(rows, ROW)
    assert found(phrases.frequent_phrases(df, threshold=5, shards=shards)) == wanted(rows, 5)


def test_ranking_with_ties_shadows_and_clashing_columns(spark):
    rows = corpus(3, vocabulary=12)
    df = spark.createDataFrame(rows, ROW).withColumns({c: F.lit("x") for c in ("phrase", "n", "shard", "start", "length", "before", "rank")})
    got = phrases.collocations(phrases.frequent_phrases(df, threshold=4, shards=2), first=25)
    assert sorted(map(tuple, got.collect())) == ranked_by_hand(rows, 4, 25)


def test_numbers_beyond_64_bits(spark):
    big = 1 << 61
    rows = [("en", 0, b"", big), ("en", 1, b"a", big), ("en", 1, b"b", big - 1), ("en", 2, b"a b", big - 2)]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, length int, phrase binary, n long")).collect()
    assert [r["score"] for r in got] == [2_000_000 * (big - 2) // (2 * big - 1)]


def test_no_rows_and_a_long_text(spark):
    df = spark.createDataFrame([], ROW)
    none = phrases.frequent_phrases(df)
    assert none.collect() == [] and phrases.collocations(none).collect() == []
    rows = [(1, "one two three, " * 100_000, "en"), (2, "", "en"), (3, " \t.;", "de")]
    assert found(phrases.frequent_phrases(spark.createDataFrame(rows, ROW), shards=2)) == wanted(rows, 30)


def test_a_tasks_phrases_stay_in_arrow():
    w = phrases.Words("en")
    w.add(phrases.words_of("a b  c.a b é".encode()))
    cells = np.zeros(1024, np.uint8)
    found = {length: (p, dict(zip(p.to_pylist(), n.tolist()))) for length, p, _, n in w.counted(cells, 1, 2)}
    assert all(isinstance(p, pa.Array) for p, _ in found.values())
    assert found[1][1] == {b"a": 2, b"b": 2, b"c": 1, "é".encode(): 1} and found[0][1] == {b"": 6}
    assert found[2][1] == {b"a b": 2, b"b c": 1, "b é".encode(): 1}

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from campuslens.llm import substrings as S
from campuslens.llm.bwt import transform
from campuslens.llm.shingles import portions, text_bytes


def by_hand(rows, length):
    """{row number: (kept bytes, removed, runs)} by looking up every string."""
    least = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - length + 1):
            w = raw[p:p + length]
            least[w] = min(least.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if least[raw[p:p + length]] < doc_id:
                gone[p:p + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, bytes(b for b, g in zip(raw, gone, strict=True) if not g), sum(gone), runs))
    return out


def collection(seed, alphabet, n=25):
    r = random.Random(seed)
    pool = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 200))) for _ in range(12)]
    return [(i, "".join(r.choice(pool)[r.randint(0, 40):] for _ in range(r.randint(0, 5)))) for i in range(n)]


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in S.without_repeats(df, filter_bits=12, **options).collect())
    want = [(i, k, n, s) for i, k, n, s in by_hand(rows, options.get("length", 50))]
    assert got == sorted(want)


@pytest.mark.parametrize("seed,alphabet", [(1, "ab"), (2, "abcdefgh "), (3, "éß中a "), (4, "a")])
def test_bytes_that_go_equal_brute_force(spark, seed, alphabet):
    check(spark, collection(seed, alphabet))


def test_other_lengths_and_several_ranges(spark, monkeypatch):
    check(spark, collection(5, "abcd "), length=30, gram=12)
    monkeypatch.setattr(S, "RANGE_BYTES", 500)
    check(spark, collection(6, "abcdefgh "))


def test_rows_that_share_an_id_and_awkward_rows(spark, awkward, docs):
    shared = "x" * 20 + "0123456789" * 6
    check(spark, [(1, shared), (1, shared), (1, shared + "other"), (2, shared), (3, None), (4, "")])
    rows = S.without_repeats(awkward, filter_bits=12).collect()
    assert len(rows) == 8 and sum(r.n_removed for r in rows) == 0
    assert S.without_repeats(docs([]), filter_bits=12).collect() == []
    null_first = S.without_repeats(docs([(0, shared), (None, shared)]), filter_bits=12).collect()
    assert {r.doc_id: r.n_removed for r in null_first} == {None: 0, 0: len(shared)}


def test_a_long_text_and_a_string_in_very_many_documents(spark):
    common = hashlib.sha256(b"x").hexdigest()
    rows = [(i, f"{i:07d}" * 9 + common + f"{i * 7:07d}" * 9) for i in range(300)] + [(900, ("word " * 40_000) + common)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.without_repeats(df, filter_bits=12).collect()}
    assert got[0].n_removed == 0 and all(common.encode() not in bytes(got[i].kept) for i in range(1, 300))
    assert got[900].n_removed >= len(common) and got[900].n_bytes == 200_000 + len(common)


@pytest.mark.parametrize("chunk", [1 << 22, 50, 7])
def test_transform_puts_all_suffixes_in_order(chunk):
    r = random.Random(7)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 20))) for _ in range(60)]
    size = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    who, place, common = (np.concatenate(x) for x in zip(*transform(data, np.cumsum(size) - size, size, None, chunk), strict=True))
    order = sorted((s[k:], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
    assert list(zip(who.tolist(), place.tolist(), strict=True)) == [(i, k) for _, i, k in order]
    for (x, _, _), (y, _, _), c in zip(order[:-1], order[1:], common[1:], strict=True):
        assert c == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def test_places_of_a_record_are_judged_some_at_a_time():
    n, string = 200_000, np.frombuffer(hashlib.sha512(b"x").digest() + b"twelve bytes", np.uint8)
    segment = S._pack(np.array([76], "<u2"), np.array([26], "u1"), np.array([0]), string)
    places = S._pack(np.array([n], "<u4"), np.minimum(np.arange(n), 1).astype("<i4"), np.zeros(n, "<i4"),
                     np.minimum(np.arange(n), 1), np.zeros(n, "<i4"))
    ready = S._Range({7: segment}, 50, 24)
    tracemalloc.start()
    found = {}
    for ids, _, spans in ready.gone(7, places, 50):
        assert set(spans) == {np.array([0, 76], "<i4").tobytes()}
        found.update(dict.fromkeys(ids.tolist()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(found) == list(range(1, n))
    assert peak < 120e6  # all windows at once take 260 MB and more


def test_a_scan_of_long_batches_needs_little_memory():
    text = "".join(random.Random(3).choices("abcdefgh ", k=4000))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 300)], ["text"])
    S._POWERS.clear()
    tracemalloc.start()
    n = sum(len(S.segments(*text_bytes(b.column(0)), 50, 24)["hash"]) for b in portions([batch], 0, S.PORTION))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 300 * 100
    assert peak < 25e6  # 50 MB with 512 KB of text at a time

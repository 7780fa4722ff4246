import random

import numpy as np
import pytest

from campuslens.llm import paragraphs as P

from .conftest import words


def sentences(seed, n, size=2000):
    w = words(seed, 12 * n, size).split()
    return " ".join(" ".join(w[12 * i:12 * i + 12]).capitalize() + "." for i in range(n))


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = P.tune(threshold, 0.995, 16)
        assert 1 - (1 - threshold ** rows) ** bands >= 0.995 and bands * rows <= 16
    with pytest.raises(ValueError):
        P.tune(0.01, 0.999, 4)


def test_paragraphs_and_inline_passages_go_from_all_but_the_first(docs):
    paragraph, passage = words(1, 60), sentences(2, 6)
    near = paragraph.split()
    near[30] = "changed"  # Jaccard (56 - 5) / (56 + 5) > 0.8
    rows = {1: sentences(11, 4) + "\n" + paragraph, 2: sentences(12, 4) + "\n" + " ".join(near) + "\n" + sentences(13, 2),
            3: sentences(14, 3) + " " + passage + " " + sentences(15, 3), 4: sentences(16, 5) + " " + passage,
            5: passage + "\n" + sentences(17, 3), 6: sentences(18, 6), 7: "short line\nshort line", 8: "short line"}
    got = {r.doc_id: r for r in P.without_duplicates(docs(list(rows.items()))).collect()}
    for i in (1, 3, 6, 7, 8):
        assert got[i].text == rows[i] and got[i].removed.bytes == 0
    assert "changed" not in got[2].text and got[2].text.startswith(sentences(12, 4)) and got[2].removed.first_docs == [1]
    for i in (4, 5):
        assert passage not in got[i].text and got[i].removed.first_docs == [3]
        shared = passage.lower().replace(".", "").split()
        left = " ".join(got[i].text.lower().replace(".", "").split())
        assert not any(" ".join(shared[k:k + 20]) in left for k in range(len(shared) - 19))
    assert all(len(rows[i].encode()) == len(got[i].text.encode()) + got[i].removed.bytes for i in rows)


def test_similar_paragraphs_equal_brute_force(docs):
    base = words(5, 70)
    lines = {i: base.split() for i in range(30)}
    for i, w in lines.items():
        for k in range(i % 6):
            w[(17 * i + 11 * k) % 70] = f"x{i}y{k}"
    rows = {i: " ".join(w) for i, w in lines.items()} | {50 + i: words(60 + i, 40) for i in range(10)}

    def shingles(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    sets, up = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for a in rows:
        for b in rows:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    found = P.duplicate_spans(docs(list(rows.items()))).where("kind = 'paragraph'").collect()
    assert {r.doc_id: r.first_doc for r in found} == {i: top(i) for i in rows if top(i) != i}


def test_awkward_rows(awkward, docs):
    out = P.without_duplicates(awkward)
    assert out.columns == [*awkward.columns, "removed"]
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(r.text) for r in awkward.collect())
    assert P.without_duplicates(docs([])).collect() == []
    one = words(4, 40) + " " + "é" * 50_000
    got = {(r.doc_id, r.text) for r in P.without_duplicates(docs([(1, one), (1, one), (1, one + " x"), (None, words(4, 40))])).collect()}
    assert (None, words(4, 40)) in got  # a null id is first


def test_passages_without_marks_at_their_edges_go_whole(docs):
    """Passages of 51 to 70 words inside other text: no marks, and sentences of 30 and 40 words that they do not start."""
    r, rows, want = random.Random(8), [], {}
    for trial in range(90):
        size, per = 51 + trial % 20, (0, 30, 40)[trial % 3]

        def running(tag, n, at):  # words of its own, a mark after every ``per`` words
            return [f"{tag}x{r.randrange(10 ** 6)}" + ("." if per and (at + k) % per == per - 1 else "") for k in range(n)]
        passage = running(f"p{trial}", size, r.randrange(40))
        passage[-1] = passage[-1].rstrip(".")
        for copy in range(2):
            i = 1000 * copy + trial
            before, after = running(f"a{i}", r.randint(41, 70), 0), running(f"z{i}", r.randint(41, 70), r.randrange(1, 9))
            before[-1] = before[-1].rstrip(".")
            rows.append((i, " ".join(before + passage + after)))
            want[i] = before + (after if copy else passage + after)
    got = {x.doc_id: x.text.split() for x in P.without_duplicates(docs(rows)).collect()}
    assert got == want


def test_winnowing_leaves_no_window_out():
    r = np.random.default_rng(4)
    bounds = np.append(0, np.cumsum([0, 1, 30, 31, 200, 0, 75]))
    grams = r.integers(0, 50, bounds[-1]).astype(np.uint64)
    got = set(P.winnowed(grams, bounds).tolist())
    want = set()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        for i in range(a, max(b - P.WINDOW + 1, a + (b > a))):
            part = grams[i:min(i + P.WINDOW, b)]
            want.add(int(i + part.argmin()))
    assert got == want


def test_tables_of_a_step_are_emptied_before_the_next(spark, docs, monkeypatch):
    """Passages and their hashes hold no rows any more when the grams are looked for."""
    text = words(1, 120)
    rows = docs([(1, text), (2, "x y z " + text + " end"), (3, words(2, 90))])
    held, tables, grams = {}, [], P.gram_units
    stored = P.Scratch.saved

    def saved(self, df, name):
        out = stored(self, df, name)
        tables.append((name, out.inputFiles()[0].rsplit("/", 1)[0]))
        return out

    def looked(source, min_words):
        for name, path in tables:
            held[name] = held.get(name, 0) + spark.read.parquet(path).count()
        return grams(source, min_words)
    monkeypatch.setattr(P.Scratch, "saved", saved)
    monkeypatch.setattr(P, "gram_units", looked)
    gone = P.duplicate_spans(rows).where("doc_id = 2 AND kind = 'passage'").collect()
    assert held["passages"] == held["passage-hashes"] == 0 < held["passages-common"]
    assert (min(r.start for r in gone), max(r.end for r in gone)) == (6, 6 + len(text) + 1)


def test_a_small_collection_has_small_filters_and_few_jobs(docs, monkeypatch):
    used, real = [], P.repeated_bits
    monkeypatch.setattr(P, "repeated_bits", lambda hashes, bits: used.append(bits) or real(hashes, bits))
    text = words(1, 60)
    rows = docs([(1, text), (2, "before " * 3 + text), (3, words(2, 60))])
    got = {r.doc_id: r.removed.bytes for r in P.without_duplicates(rows).collect()}
    assert got[1] == got[3] == 0 and got[2] > 0
    assert used and max(used) <= 20
    assert P.extent(rows.select("text"))[1] == 1
    assert P.extent(docs([(1, None)]).select("text")) == (15, 1)


def test_units_of_several_documents_by_one_shuffle(spark):
    """Equal units of one document alone go, of several all stay with the first document, ties by key and nulls first."""
    rows = [(1, 10, 0, 7, 7), (1, 10, 4, 7, 7), (2, 20, 0, 7, 7), (3, 30, 0, 8, 8), (3, 30, 9, 8, 8), (4, 40, 0, 7, 8),
            (None, 50, 1, 9, 9), (5, 51, 2, 9, 9), (6, 60, 0, 5, 5), (6, 61, 0, 5, 5)]
    units = spark.createDataFrame(rows, "doc_id long, key long, start int, hash long, more long")
    found = P._of_several(units)
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.hash, r.key, r.start, r.least.key) for r in found.collect())
    assert got == [(5, 60, 0, 60), (5, 61, 0, 60), (7, 10, 0, 10), (7, 10, 4, 10), (7, 20, 0, 10), (9, 50, 1, 50), (9, 51, 2, 50)]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_packed_spans_become_maximal_runs():
    r = random.Random(5)
    for _ in range(50):
        spans = [(a, a + r.randrange(1, 30)) for a in (r.randrange(300) for _ in range(r.randrange(1, 40)))]
        gone = sorted(set().union(*(range(*s) for s in spans)))
        runs = [[a, a + 1] for a in gone[:1]]
        for a in gone[1:]:
            if a == runs[-1][1]:
                runs[-1][1] += 1
            else:
                runs.append([a, a + 1])
        assert P._merged(np.array([a << 32 | b for a, b in spans])) == runs


def test_common_runs_are_stored_as_runs_and_grams_in_parts(docs, monkeypatch):
    """A passage of 400 words is a row or a few in the stored tables, not one for each word, and the parts of the grams' hashes
    cut out the same words as all at once, whose documents they come from included."""
    stored, rows_of = P.Scratch.saved, {}

    def saved(self, df, name):
        out = stored(self, df, name)
        rows_of[name] = rows_of.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(P.Scratch, "saved", saved)
    a, b = words(31, 400, 10 ** 6), words(32, 400, 10 ** 6)
    own = {i: (words(40 + i, 60, 10 ** 6), words(50 + i, 60, 10 ** 6)) for i in range(4)}
    rows = docs([(0, f"{own[0][0]} {a} {own[0][1]}"), (1, f"{own[1][0]} {b} {own[1][1]}"),
                 (2, f"{own[2][0]} {a} {b} {own[2][1]}"), (3, f"{own[3][0]} {b} {own[3][1]}")])

    def cut():
        rows_of.clear()
        found = {r.doc_id: (r.text.split(), r.removed) for r in P.without_duplicates(rows).collect()}
        return found
    got = cut()
    assert sum(n for name, n in rows_of.items() if name.startswith(("grams", "passages-cut"))) < 300
    assert got[0][1].bytes == got[1][1].bytes == 0
    # the words over the edge of ``a`` and ``b`` are in no other document in a row, but each is in a passage
    for i, first in ((2, [0, 1]), (3, [1])):
        assert got[i][0] == " ".join(own[i]).split() and got[i][1].first_docs == first and got[i][1].spans == 1
    monkeypatch.setattr(P, "GRAM_BYTES", 1 << 20, raising=False)
    monkeypatch.setattr(P, "SLICE_BYTES", 500 << 20)
    seen = []
    real = P.gram_units
    monkeypatch.setattr(P, "gram_units", lambda source, min_words: seen.append(1) or real(source, min_words))
    assert cut() == got and len(seen) > 1


def test_runs_of_units_by_document_and_first_document(spark):
    rows = [(2, 20, s, s + 9, 1, 10) for s in range(0, 90, 3)] + [(2, 20, 200, 209, 1, 10), (2, 20, 209, 220, 1, 10), (2, 20, 50, 60, None, 5),
            (None, 7, 1, 4, 3, 30), (None, 7, 3, 9, 3, 30), (3, 20, 3, 5, 1, 10), (1, 10, 0, 9, 1, 10)]
    units = spark.createDataFrame(rows, "doc_id long, key long, start int, end int, l long, k long").selectExpr(
        "doc_id", "key", "start", "end", "struct(l AS doc_id, k AS key) AS least")
    got = sorted(map(tuple, P._cut_runs(units).collect()), key=str)
    assert got == sorted([(2, 20, 0, 96, 1), (2, 20, 200, 220, 1), (2, 20, 50, 60, None), (None, 7, 1, 9, 3), (3, 20, 3, 5, 1)], key=str)

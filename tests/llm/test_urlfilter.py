import numpy as np
import pytest

from campuslens.llm import urlfilter as U

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


URLS = [None, "", "nothing", "http://", "HTTP://WWW.Example.ORG/es/1?x=/de/", "http://example.org", "http://a.example.org/en/12#y",
        "http://badexample.org/es/2", "https://x.com/fr/1", "https://x.com/de/1", "https://com/de/", "x://y://z/fr/",
        "http://h.net?q=http://x.org/", "http://É.org/ñ", "ftp://x.org/a\nb?c", "http://x.com/en/1", "http://x.com/en/1"]


def test_hosts_paths_and_rules_as_by_hand(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rows = U.judge(df, RULES).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path = by_hand(URLS[r.page_id])
        fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_models_follow_witten_bell_over_counts(spark):
    good, bad = [b"aab", b"abab", b"aabb"] * 3, [b"zz", b"azz"] * 3
    rows = [(x, True) for x in good] + [(x, False) for x in bad]
    model = U.learn(spark.createDataFrame(rows, "text binary, good boolean"))

    def probability(texts, history, byte):
        p = 1 / 256
        for k in range(U.ORDER + 1):
            padded = [[256] * U.ORDER + list(t) for t in texts]
            here = ([256] * U.ORDER + list(history))[U.ORDER + len(history) - k:] if k else []
            after = [t[i] for t in padded for i in range(U.ORDER, len(t)) if t[i - k:i] == here]
            if len(after) >= U.MIN_CONTEXT:
                p = (after.count(byte) + len(set(after)) * p) / (len(after) + len(set(after)))
        return p

    for text in (b"aab", b"zzz", b"q", b"abz"):
        want = np.mean([np.log(probability(good, text[:i], text[i])) - np.log(probability(bad, text[:i], text[i]))
                        for i in range(len(text))])
        assert U.log_ratio([text], model)[0] == pytest.approx(want, abs=1e-6)


def test_learned_verdicts_separate_unruled_urls(spark):
    rows = [(i, f"http://site{i}.org/shop/item{i}") for i in range(300)] + [
        (1000 + i, f"http://site{i}.com/de/casino{i}") for i in range(300)] + [(5000, "http://x.net/shop/item7"), (5001, "http://x.net/de/casino8")]
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    assert got[5000].verdict == "allow" and got[5001].verdict == "block" and got[5000].rule is None


def test_empty_table_and_too_many_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(empty, RULES).collect() == []
    with pytest.raises(ValueError):
        U.judge(empty, [("allow", "x", "/")] * 1001)


def test_counts_are_those_of_real_contexts(spark):
    """More different contexts than any fixed number of cells, each counted on its own; all decided URLs count."""
    r = np.random.default_rng(6)
    texts = [bytes(x) for x in r.integers(0, 256, (4000, 60)).astype(np.uint8)]
    rows = [(x, i % 3 > 0) for i, x in enumerate(texts)]
    want = {True: {}, False: {}}
    for x, good in rows:
        for i in range(4, len(x)):
            key = x[i - 4:i + 1]
            want[good][key] = want[good].get(key, 0) + 1
    model = U.learn(spark.createDataFrame(rows, "text binary, good boolean"))
    inner = model.where(f"k = 4 AND context % 257 < 256 AND context div 257 % 257 < 256 AND "
                        f"context div {257 ** 2} % 257 < 256 AND context div {257 ** 3} < 256")
    one = inner.agg({"*": "count", "good": "sum", "bad": "sum"}).first()
    assert one["count(1)"] == len(want[True].keys() | want[False].keys()) > 200_000
    assert (one["sum(good)"], one["sum(bad)"]) == tuple(sum(want[c].values()) for c in (True, False))


def test_broadcast_and_shuffle_joins_score_alike(spark, monkeypatch):
    rows = [(b"site%d.org/a/%d" % (i % 7, i), i % 2 > 0) for i in range(60)]
    model = U.learn(spark.createDataFrame(rows, "text binary, good boolean"))
    texts = [b"site1.org/a/3", b"", b"other", b"site1.org/a/3"]
    got = U.log_ratio(texts, model)
    monkeypatch.setattr(U, "MAX_BROADCAST_ROWS", 0)
    assert (U.log_ratio(texts, model) == got).all() and got[1] == 0 and got[0] == got[3] != 0

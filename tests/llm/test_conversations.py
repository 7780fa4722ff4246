"""Conversation repair against a search over all edits."""

import heapq
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from campuslens.llm import conversations
from campuslens.llm.common import read_table
from campuslens.llm.queries import QUERIES, damaged

SF = "/root/testdata/sf0.01"
ROW = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """Cost, ASCII-least audit and repaired turns by searching edits in order of cost, then of letters.  ``rows`` are
    (role, text, delete only, cut off); the pattern is followed by the initials of the last turn."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, kept = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, kept
        if (i, last) in done:
            continue
        done.add((i, last))

        def go(letter, price, at, role, text):
            initial = role[:1]
            if initial in {"": "su", "s": "u", "u": "a", "a": "u"}[last] and initial:
                heapq.heappush(heap, (cost + price, audit + letter, at, initial, (*kept, f"{role}:{text}")))
        for role in ("user", "assistant"):
            go("I", 5, i, role, "")
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, kept))
            if not gone:
                go("K", 5 * cut, i + 1, role, text)
                for new in ("user", "assistant"):
                    go("R", 1 + 5 * cut, i + 1, new, text)


def by_hand(rows):
    """Verdicts and digest of one conversation's rows."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()[:16]))
    seen, told, marked = set(), [0, 0, 0], []
    for _, role, text in rows:
        core = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 0 if not core else 1 if (role, text) in seen else 2 if core[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            told[fault] += 1
        marked.append((role, text, fault in (0, 1), fault == 2))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, kept = cheapest(marked)
    return (gaps, *told, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def damage_by_hand(table):
    out = defaultdict(list)
    for c, t, r, x in table:
        out[c] = out[c]
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        row = (t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)
        out[c] += [row] * (2 if k == 3 else 1)
    return out


EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def repaired(spark, rows, schema=ROW):
    fixed = conversations.repair(spark.createDataFrame(rows, schema))
    hashes = {r[0]: r[1] for r in conversations.digests(fixed.turns).collect()}
    return {r[0]: (*r[1:], hashes.get(r[0], EMPTY[-1])) for r in fixed.verdicts.collect()}


def random_rows(seed, conversations_=40, longest=12):
    r = random.Random(seed)
    out = []
    for c in range(conversations_):
        for t in range(r.randrange(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "student", None, ""])
            text = r.choice(["", " \t", None, "Yes.", "No!", "cut off", "again.", f"own {r.random()}.", f"own {r.random()}"])
            out.append((c, r.choice([t, t, t, 2 * t, None]), role, text))
    return out


def grouped(rows):
    out = defaultdict(list)
    for c, *rest in rows:
        out[c].append(tuple(rest))
    return out


def test_query_equals_the_search(spark):
    table = [tuple(r) for r in read_table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = {c: by_hand(rows) if rows else EMPTY for c, rows in damage_by_hand(table).items()}
    got = QUERIES["op12_conversation_repair"](spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


@pytest.mark.parametrize("rows_of_a_chunk", [1, 3, 4096])
def test_random_rows_in_chunks_of_any_size(spark, monkeypatch, rows_of_a_chunk):
    monkeypatch.setattr(conversations, "ROWS", rows_of_a_chunk)
    rows = random_rows(rows_of_a_chunk)
    assert repaired(spark, rows) == {c: by_hand(r) for c, r in grouped(rows).items()}


def test_a_conversation_over_many_chunks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(conversations, "ROWS", 7)
    r = random.Random(2)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice([f"x {t}.", "cut", "same."])) for t in range(300)]
    rows += [(None, 5, "user", "Hello.")] * 50 + [(2, None, "assistant", "a."), (2, None, "user", "u.")]
    assert repaired(spark, rows) == {c: by_hand(x) for c, x in grouped(rows).items()}


def test_runs_by_powers_equal_row_by_row():
    r = random.Random(1)
    for _ in range(200):
        sym, n = r.randrange(16), r.randrange(1, 70)
        left = tuple(r.randrange(12) for _ in range(4))
        by_row = left
        for _ in range(n):
            by_row = conversations.before(conversations.power(sym, 0), by_row)
        assert conversations.run_before(sym, n, left) == by_row == conversations.before(conversations.run_matrix(sym, n), left)


def test_damage_extra_columns_long_texts_and_no_rows(spark):
    rows = random_rows(9) + [(99, 0, "user", "long " * 200_000 + "."), (99, 1, "assistant", "ok.")]
    table = spark.createDataFrame(rows, ROW)
    extra = table.withColumns({c: F.lit("x") for c in ("chunk", "row", "said", "kind", "fault", "copies", "state", "audit")})
    out = defaultdict(list)
    for x in damaged(extra).collect():
        out[x["conv_id"]].append((x["turn"], x["role"], x["text"]))
    assert {c: sorted(map(repr, x)) for c, x in out.items()} == {c: sorted(map(repr, x)) for c, x in damage_by_hand(rows).items() if x}
    fixed = conversations.repair(extra)
    assert {r[0]: r["audit"] for r in fixed.verdicts.collect()} == {c: by_hand(x)[6] for c, x in grouped(rows).items()}
    none = conversations.repair(table.limit(0))
    assert none.verdicts.collect() == [] and none.turns.collect() == [] and conversations.digests(none.turns).collect() == []

"""Repair of the turn structure of conversations by a run-length min-plus program.

A conversation is its rows in order of turn.  Each row has a symbol: the
kind of its role (system, user, assistant, other; by the first letter) and
its fault (none, blank, duplicate, truncated).  Editing is a walk over four
states (nothing yet, a system turn, a user turn or an assistant turn last)
whose steps are Keep (0), Rerole to user or assistant (1), Delete (2;
required for blank and duplicate rows) and Insert of an empty user or
assistant turn (5); a truncated row that stays adds 5.  The result must be
``(s?(ua)+)?`` by the roles' first letters.

A symbol is a 4x4 min-plus matrix.  Equal consecutive symbols are one run,
and a run of n rows is n's binary powers of that matrix, which every Python
worker computes once for each symbol.  The cheapest edits are then unrolled
row by row from the costs that remain, the ASCII-least letter first; the
letters so far fix the state, so this finds the ASCII-least audit.

Matrices multiply, so no task holds a conversation.  Rows are put in order
by ranges, a range is cut into chunks of at most ``ROWS`` rows, and each
chunk is one matrix.  The chunks of a conversation (one number pair for
``ROWS`` rows) then pass through a stream twice: backwards for the costs
that remain after each chunk, and forwards for the state in which each
begins.  Equal rows are counted before they are shuffled, and texts take
part by a hash of 128 bits only; a text is read again for the rows that stay.

Defined cases: a null role or text is one blank; rows of a null
conversation are one conversation; a null turn comes first; rows of one
turn are in order of role, then of a hash of role and text (equal rows one
after the other); very long texts pass whole, as hash and as text; a row
whose role has no first letter, or another than s, u and a, can be reroled
or deleted only; gaps beyond 64 bits are the largest long; an empty table
gives empty tables; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

ROWS = 4096  #: rows of a chunk

#: First letters of the kinds (other letters are kind 0), states, costs, white space, ends of a sentence.
KINDS = ("", "s", "u", "a")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
WHITE, STOPS = " \t\n\x0b\x0c\r", (".", "!", "?")
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

#: The state after an inserted or reroled turn, and after a kept turn of each kind (None: not legal there).
FILLED = (USER, USER, ASSISTANT, USER)
KEPT = ((None, SYSTEM, USER, None), (None, None, USER, None), (None, None, None, ASSISTANT), (None, None, USER, None))
#: Cost left after the last row, by state, and the turns then inserted.
END, END_INSERTS = (0, 2 * INSERT, INSERT, 0), (0, 2, 1, 0)
FAR = 1 << 60

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def symbol(kind: int, fault: int) -> int:
    return kind * 4 + fault


def _steps(sym: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Ways to use up a row of a symbol: letter, cost and next state, in ASCII order of the letter."""
    kind, fault = divmod(sym, 4)
    yield "D", DELETE, state
    if fault not in (BLANK, DUPLICATE):
        extra = CUT_OFF if fault == TRUNCATED else 0
        if (after := KEPT[state][kind]) is not None:
            yield "K", extra, after
        yield "R", REROLE + extra, FILLED[state]


def _times(a: Matrix, b: Matrix) -> Matrix:
    columns = tuple(zip(*b))
    return tuple(tuple(min(FAR, *(x + y for x, y in zip(row, col))) for col in columns) for row in a)


def _inserts() -> Matrix:
    """Cheapest cost of inserted turns alone, from state to state."""
    one = [[0 if s == t else FAR for t in range(4)] for s in range(4)]
    for s in range(4):
        one[s][FILLED[s]] = min(one[s][FILLED[s]], INSERT)
    once = tuple(map(tuple, one))
    return _times(once, once)


@lru_cache(maxsize=None)
def power(sym: int, k: int) -> Matrix:
    """The min-plus matrix of 2^k rows of a symbol, each with the inserts before it."""
    if k:
        half = power(sym, k - 1)
        return _times(half, half)
    row = [[FAR] * 4 for _ in range(4)]
    for s in range(4):
        for _, cost, t in _steps(sym, s):
            row[s][t] = min(row[s][t], cost)
    return _times(_inserts(), tuple(map(tuple, row)))


def run_matrix(sym: int, n: int) -> Matrix | None:
    """The matrix of a run of n rows."""
    out = None
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = power(sym, k) if out is None else _times(out, power(sym, k))
    return out


def before(matrix: Matrix, left: Vector) -> Vector:
    """Cost left before rows, given the cost left after them."""
    return tuple(min(a + b for a, b in zip(row, left)) for row in matrix)


def run_before(sym: int, n: int, left: Vector) -> Vector:
    for k in range(n.bit_length()):
        if n >> k & 1:
            left = before(power(sym, k), left)
    return left


@lru_cache(maxsize=1 << 16)
def choices(sym: int, left: Vector) -> tuple[tuple[tuple[str, int], ...], Vector]:
    """For one row and the cost left after it (least 0): from each state the letters of the best
    edits up to this row and the next state; and the cost left before the row (least 0)."""
    best = before(power(sym, 0), left)
    out = []
    for state in range(4):
        letters = ""
        while not letters or letters[-1] == "I":
            ways = [(letter, cost + left[t], t) for letter, cost, t in _steps(sym, state)]
            ways.insert(1, ("I", INSERT + best[FILLED[state]], FILLED[state]))
            letter, state = next((letter, t) for letter, cost, t in ways if cost == best[state])
            letters += letter
        out.append((letters, state))
    return tuple(out), _low(best)


def _low(v: Vector) -> Vector:
    m = min(v)
    return tuple(x - m for x in v)


def runs(items: list[tuple[int, int]]) -> list[list[int]]:
    """Equal consecutive symbols (symbol, rows) as one."""
    out: list[list[int]] = []
    for sym, n in items:
        if out and out[-1][0] == sym:
            out[-1][1] += n
        else:
            out.append([sym, n])
    return out


def chunk_matrix(items: list[tuple[int, int]]) -> Matrix:
    out = None
    for sym, n in runs(items):
        m = run_matrix(sym, n)
        out = m if out is None else _times(out, m)
    return out


def unroll(items: list[tuple[int, int]], left: Vector) -> tuple[list[tuple[tuple[str, int], ...]], Vector]:
    """The choices at every row of a chunk, given the cost left after it; and the cost left before it (least 0)."""
    out: list[tuple[tuple[str, int], ...]] = []
    left = _low(left)
    for sym, n in reversed(runs(items)):
        end, steps = _low(run_before(sym, n, left)), []
        for _ in range(n):
            step, left = choices(sym, left)
            steps.append(step)
        assert left == end
        out += steps
    return out[::-1], left


def walk(steps: list[tuple[tuple[str, int], ...]], state: int) -> tuple[list[str], int]:
    """The letters of each row from a state on, and the last state."""
    out = []
    for step in steps:
        letters, state = step[state]
        out.append(letters)
    return out, state


class Repair(NamedTuple):
    verdicts: DataFrame  #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    turns: DataFrame  #: conv_id, chunk, place (in order), role, text of every repaired turn


def _kind(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)


def _fault(text: Column) -> Column:
    """Blank or truncated, by the text alone."""
    core = F.rtrim(text, F.lit(WHITE))
    return F.when(core == "", BLANK).when(F.right(core, F.lit(1)).isin(*STOPS), NO_FAULT).otherwise(TRUNCATED)


def _rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, text without nulls in the last two, ``said`` (hash of both) and ``row`` (hash of all)."""
    blank = F.lit(" ")
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"))
    rows = rows.withColumn("said", _hash(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    place = F.to_json(F.struct("conv_id", "turn"), {"ignoreNullFields": "false"})
    return rows.withColumn("row", _hash(place, F.hex("said")))


def _hash(*parts: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256)), 1, 16)


def _ordered(rows: DataFrame) -> DataFrame:
    """Every different row once, in ranges of the order, with its fault and the number of its copies."""
    groups = rows.select("conv_id", "turn", "role", "said", "row", _kind(F.col("role")).alias("kind"),
                         _fault(F.col("text")).alias("fault"))
    groups = groups.groupBy(*groups.columns).agg(F.count("*").alias("copies"))
    # the first turn in which something was said, where that is not the only one
    seen = groups.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(
        F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("unplaced"), F.count("*").alias("n")).where("n > 1")
    again = F.when(F.col("unplaced"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    found = groups.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    fault = F.when((F.col("fault") != BLANK) & again, DUPLICATE).otherwise(F.col("fault"))
    order = F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("said")
    return (found.select("conv_id", "turn", "role", "said", "row", "kind", fault.alias("fault"), "copies")
            .repartitionByRange(*order).sortWithinPartitions(*order)
            .select("conv_id", "turn", "row", "kind", "fault", "copies"))


_ILLEGAL = frozenset((a, b) for a in range(4) for b in range(4)) - {(1, 2), (2, 3), (3, 2)}
_MATRIX = pa.list_(pa.int64())


def _chunks(ordered: DataFrame) -> DataFrame:
    """Chunks of at most ``ROWS`` rows of one conversation: items (symbol, rows, hash of the row or null),
    the matrix, and counts of the faults inside."""
    conv = ordered.schema["conv_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        now, started, size = None, False, 0
        items: list[tuple[int, int, bytes | None, int | None]] = []
        out: list[tuple] = []

        def close() -> None:
            nonlocal items, size, number
            told = [0] * 4
            illegal, turns, last_kind, last_turn, first_turn = 0, 0, None, None, None
            for sym, n, _, turn in items:
                kind, fault = divmod(sym, 4)
                told[fault] += n
                illegal += ((last_kind, kind) in _ILLEGAL) + (n - 1) * ((kind, kind) in _ILLEGAL)
                last_kind = kind
                if turn is not None and turn != last_turn:
                    turns, last_turn = turns + 1, turn
                    first_turn = turn if first_turn is None else first_turn
            plain = [i[:2] for i in items]
            out.append((now, part << 33 | number, [s for s, _ in plain], [n for _, n in plain], [i[2] for i in items],
                        [x for row in chunk_matrix(plain) for x in row], told[BLANK], told[DUPLICATE], told[TRUNCATED],
                        illegal, turns, first_turn, last_turn, items[0][0] // 4, items[-1][0] // 4))
            items, size, number = [], 0, number + 1

        def batch(schema: pa.DataType) -> pa.RecordBatch:
            types = [schema, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary()), _MATRIX,
                     *[pa.int64()] * 7, pa.int32(), pa.int32()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, _CHUNK_NAMES)

        kind_of_id = None
        for b in stream:
            kind_of_id = b.schema.field(0).type
            for c, turn, row, kind, fault, copies in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if items and (c != now or size >= ROWS):
                    close()
                now = c
                items.append((symbol(kind, fault), 1, row, turn))
                size += 1
                copies -= 1
                again = symbol(kind, BLANK if fault == BLANK else DUPLICATE)
                while copies:
                    if size >= ROWS:
                        close()
                    n = min(copies, ROWS - size)
                    items.append((again, n, None, turn))
                    size, copies = size + n, copies - n
                if len(out) >= 2000:
                    yield batch(kind_of_id)
        if items:
            close()
        if out:
            yield batch(kind_of_id)

    return ordered.mapInArrow(run, f"conv_id {conv}, " + _CHUNK_TYPES)


_CHUNK_TYPES = ("chunk long, syms array<int>, counts array<long>, hashes array<binary>, matrix array<long>, blank long, "
                "duplicate long, truncated long, illegal long, n_turns long, first_turn long, last_turn long, "
                "first_kind int, last_kind int")
_CHUNK_NAMES = ["conv_id", *(c.split()[0] for c in _CHUNK_TYPES.split(", "))]


def _stream(chunks: DataFrame, columns: list[str], schema: str, begin, step, descending: bool) -> DataFrame:
    """Pass the chunks of each conversation in order through ``step(carried, row)``, which gives the values to put
    out and what to carry on; ``begin`` is carried at first.  Only what is carried is in memory."""
    order = F.col("chunk").desc() if descending else F.col("chunk").asc()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, carried, first = None, begin, True
        for b in stream:
            out = []
            for c, chunk, *rest in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if first or c != now:
                    now, carried, first = c, begin, False
                values, carried = step(carried, rest)
                out.append((chunk, *values))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))

    schema = f"chunk long, {schema}"
    names = [f.split()[0] for f in schema.split(", ")]
    slim = chunks.select("conv_id", "chunk", *columns)
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, schema)


def _tail(left: Vector, row: list) -> tuple[tuple, Vector]:
    """Backwards: the cost left after the chunk, whether it is the last, and the cost left before it."""
    flat, = row
    ahead = before(tuple(tuple(flat[i:i + 4]) for i in (0, 4, 8, 12)), left or END)
    return (list(left or END), left is None, ahead[NOTHING]), ahead


def _head(carried: tuple | None, row: list) -> tuple[tuple, tuple]:
    """Forwards: the state in which the chunk begins, whether it begins the conversation, and what it shares with the
    chunk before it (an illegal pair, a turn)."""
    ends, first_kind, last_kind, first_turn, last_turn = row
    state, kind, turn = carried or (NOTHING, None, None)
    joint = int((kind, first_kind) in _ILLEGAL), int(turn is not None and turn == first_turn)
    return (state, carried is None, *joint), (ends[state], last_kind, turn if last_turn is None else last_turn)


def _solve(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits and last states of chunks, from each state in which they could begin."""
    for b in stream:
        audits, ends = [], []
        for syms, counts, left in zip(*(b.column(n).to_pylist() for n in ("syms", "counts", "left")), strict=True):
            steps, _ = unroll(list(zip(syms, counts)), tuple(left))
            found = [walk(steps, s) for s in range(4)]
            audits.append(["".join(letters) for letters, _ in found])
            ends.append([end for _, end in found])
        yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(audits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))],
                                         ["chunk", "audits", "ends"])


def _survivors(solved: DataFrame) -> DataFrame:
    """Every repaired turn: conv_id, chunk, place, ``row`` (null if inserted) and ``new_role`` (null if kept)."""
    conv = solved.schema["conv_id"].dataType.simpleString()
    names = (None, None, "user", "assistant")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            out = []
            for c, chunk, state, audit, syms, counts, hashes in zip(*(col.to_pylist() for col in b.columns), strict=True):
                rows = ((sym, h if i == 0 else None) for sym, n, h in zip(syms, counts, hashes, strict=True) for i in range(n))
                for place, letter in enumerate(audit):
                    if letter == "I":
                        state = FILLED[state]
                        out.append((c, chunk, place, None, names[state]))
                        continue
                    sym, h = next(rows)
                    if letter == "K":
                        state = KEPT[state][sym // 4]
                        out.append((c, chunk, place, h, None))
                    elif letter == "R":
                        state = FILLED[state]
                        out.append((c, chunk, place, h, names[state]))
            if out:
                types = b.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types, strict=True)],
                                                 ["conv_id", "chunk", "place", "row", "new_role"])

    return solved.select("conv_id", "chunk", "state", "audit", "syms", "counts", "hashes").mapInArrow(
        run, f"conv_id {conv}, chunk long, place long, row binary, new_role string")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """The cheapest repair of every conversation."""
    rows = _rows(turns, conv, turn, role, text)
    chunks = saved(_chunks(_ordered(rows)), "conversation-chunks")
    tails = saved(_stream(chunks, ["matrix"], "left array<long>, last boolean, cost long", None, _tail, descending=True),
                  "conversation-tails")
    answers = saved(chunks.select("chunk", "syms", "counts").join(tails.select("chunk", "left"), "chunk").mapInArrow(
        _solve, "chunk long, audits array<string>, ends array<int>"), "conversation-answers")
    ends = ["ends", "first_kind", "last_kind", "first_turn", "last_turn"]
    heads = saved(_stream(chunks.join(answers.select("chunk", "ends"), "chunk"), ends,
                          "state long, opens boolean, joint_pair long, joint_turn long", None, _head, descending=False),
                  "conversation-heads")
    state = F.col("state").cast("int")
    inserts = F.array(*(F.lit("I" * n) for n in END_INSERTS))[F.col("ends")[state]]
    audit = F.concat(F.col("audits")[state], F.when(F.col("last"), inserts).otherwise(""))
    solved = (chunks.join(tails.drop("left"), "chunk").join(heads, "chunk").join(answers, "chunk")
              .withColumn("audit", audit).drop("audits", "ends", "matrix"))
    span = (F.max("last_turn").cast("decimal(20,0)") - F.min("first_turn").cast("decimal(20,0)") + 1
            - F.sum(F.col("n_turns") - F.col("joint_turn")))
    pieces = F.array_sort(F.collect_list(F.struct("chunk", "audit")))
    verdicts = solved.groupBy("conv_id").agg(
        F.least(F.coalesce(span, F.lit(0)), F.lit((1 << 63) - 1)).cast("long").alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        F.sum(F.col("illegal") + F.col("joint_pair")).alias("illegal"), F.max(F.when(F.col("opens"), F.col("cost"))).alias("cost"),
        F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    texts = rows.groupBy("row").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    kept = _survivors(solved).join(texts, "row", "left")
    return Repair(verdicts, kept.select("conv_id", "chunk", "place", F.coalesce("new_role", "role").alias("role"),
                                        F.coalesce("text", F.lit("")).alias("text")))


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``sha256`` of each conversation's repaired ``role:text``, joined by line ends.  A hash takes its
    bytes one after the other, so a conversation's turns pass in order through one task, which holds one batch of them."""
    conv = turns.schema["conv_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for b in stream:
            done = []
            for c, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if running is None or c != now:
                    if running is not None:
                        done.append((now, running.hexdigest()))
                    now, running = c, hashlib.sha256(line)
                else:
                    running.update(b"\n")
                    running.update(line)
            kind = b.schema.field(0).type
            if done:
                yield _pairs(done, kind)
        if running is not None:
            yield _pairs([(now, running.hexdigest())], kind)

    lines = turns.select("conv_id", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"), "chunk", "place")
    return (lines.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "place").select("conv_id", "line")
            .mapInArrow(run, f"conv_id {conv}, sha256 string"))


def _pairs(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())],
                                      ["conv_id", "sha256"])

"""Order inside each key without a stored table or a task that holds a key.

``Window.partitionBy(key).orderBy(time)`` sorts all rows of a key in one
task.  Here the rows of a key are cut into segments of its order column
(days of a time, ``NUMBERS`` values of a number) and windowed by (key,
segment).  What a segment needs of the earlier ones is one row, its edge:

1. a summary of every (key, segment), a partial aggregate, so one row of a
   segment leaves each map task;
2. the edges: a window over the summaries of each key, in order;
3. rows and edges are united and windowed together, the edge first.

All of it is one lazy plan: building it starts no job and leaves nothing
behind.  A key with a third of all rows is spread over as many tasks as it
has segments; only its summaries, one row for a segment, meet in one task.
The rows are shuffled once, on (key, segment).

Keys and order columns may be NULL: NULL is a key like any other, and rows
whose order column is NULL are a segment of their own, after all others.
Columns are named by ``F.col``; the helper columns start with ``_seg_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000
NUMBERS = 65_536
SEGMENT, EDGE = "_seg_segment", "_seg_edge"

_ATOMIC = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def segment(df: DataFrame, by: str, width: int | None = None) -> Column:
    """The number of the segment that ``by`` falls in (NULL for NULL); grows with ``by``.

    ``width`` is in microseconds for times (a day if not given), days for dates (1) and values for numbers
    (``NUMBERS``).  Other types have one segment."""
    kind = df.schema[by].dataType
    if isinstance(kind, T.TimestampNTZType):
        at, step = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(by)), width or DAY_US
    elif isinstance(kind, T.TimestampType):
        at, step = F.unix_micros(F.col(by)), width or DAY_US
    elif isinstance(kind, T.DateType):
        at, step = F.unix_date(F.col(by)), width or 1
    elif isinstance(kind, T.NumericType):
        at, step = F.col(by), width or NUMBERS
    else:
        return F.when(F.col(by).isNotNull(), F.lit(0).cast("long"))
    return F.floor(at / F.lit(step)).cast("long")


def _order(df: DataFrame, keys: list[str], order: list[str]) -> list[tuple[str, bool]]:
    """The whole order: the named columns with NULL last, then every other plain column with NULL first."""
    rest = [f.name for f in df.schema.fields if f.name not in (*keys, *order) and isinstance(f.dataType, _ATOMIC)]
    return [(c, True) for c in order] + [(c, False) for c in rest]


def _sorted(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if last else F.col(c).asc_nulls_first() for c, last in order]


def _place(order: list[tuple[str, bool]]) -> list[Column]:
    """Fields whose struct compares as the order does (in a struct NULL is least)."""
    return [x for c, last in order for x in ([F.col(c).isNull()] if last else []) + [F.col(c)]]


def _summaries(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(F.col(SEGMENT).asc_nulls_last())


def with_edges(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows and the edges of their segments (``EDGE`` 0, before the rows of the segment)."""
    return rows.withColumn(EDGE, F.lit(1)).unionByName(edges.withColumn(EDGE, F.lit(0)), allowMissingColumns=True)


def in_segments(keys: list[str], order: list[Column]):
    """The window over a segment, edge first."""
    return Window.partitionBy(*keys, SEGMENT).orderBy(F.col(EDGE), *order)


def previous(df: DataFrame, keys: list[str], order: list[str], carry: list[str], prefix: str,
             width: int | None = None, before: DataFrame | None = None) -> DataFrame:
    """For each row the ``carry`` columns (as ``prefix`` + name) of the row before it in its key, by ``order`` with
    NULL last; ties by the other columns.  The first row of a key gets those of ``before`` (the keys, one row each,
    and the carried columns) if given, else NULL."""
    whole = _order(df, keys, order)
    rows = df.withColumn(SEGMENT, segment(df, order[0], width))
    if carry == order[:1]:  # the greatest value is the last row's, and needs no struct
        last = F.struct(F.max(carry[0]).alias(carry[0]))
    else:
        row = F.struct(*[x.alias(f"p{i}") for i, x in enumerate(_place(whole))], F.struct(*carry).alias("row"))
        last = F.max(row)["row"]
    ends = rows.groupBy(*keys, SEGMENT).agg(last.alias("_seg_last"))
    at = F.lag("_seg_last").over(_summaries(keys))
    if before is not None:
        ends = _joined(ends, before.select(*keys, F.struct(*carry).alias("_seg_before")), keys)
        at = F.coalesce(at, F.col("_seg_before"))
    edges = ends.select(*keys, SEGMENT, at.alias("_seg_at")).where("_seg_at IS NOT NULL").select(
        *keys, SEGMENT, *[F.col("_seg_at")[c].alias("_seg_" + c) for c in carry])
    both = with_edges(rows.withColumns({"_seg_" + c: F.col(c) for c in carry}), edges)
    w = in_segments(keys, _sorted(whole))
    shown = both.withColumns({prefix + c: F.lag("_seg_" + c).over(w) for c in carry})
    return shown.where(f"{EDGE} = 1").drop(SEGMENT, EDGE, *["_seg_" + c for c in carry])


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be NULL."""
    named = right.select(*[F.col(k).alias("_seg_k_" + k) for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col("_seg_k_" + k)) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return left.join(named, on, "left").drop(*["_seg_k_" + k for k in keys])


def row_number(df: DataFrame, keys: list[str], order: list[str], out: str, width: int | None = None) -> DataFrame:
    """1-based number of each row in its key, by ``order`` with NULL last; ties by the other columns."""
    rows = df.withColumn(SEGMENT, segment(df, order[0], width))
    counts = rows.groupBy(*keys, SEGMENT).agg(F.count("*").alias("_seg_rows"))
    earlier = F.sum("_seg_rows").over(_summaries(keys).rowsBetween(Window.unboundedPreceding, -1))
    edges = counts.select(*keys, SEGMENT, earlier.alias("_seg_n")).where("_seg_n IS NOT NULL")
    both = with_edges(rows.withColumn("_seg_n", F.lit(1).cast("long")), edges)
    w = in_segments(keys, _sorted(_order(df, keys, order))).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.sum("_seg_n").over(w)).where(f"{EDGE} = 1").drop(SEGMENT, EDGE, "_seg_n")

"""Sources and sinks.

Reads are Parquet (columnar, pushdown) or schema-declared JSON; writes go
to the caller's path, which on a cluster is shared storage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

CORRUPT = "_corrupt_record"


def list_sorted(df: DataFrame, cols: dict[str, str] | list[str], order_by: list) -> DataFrame:
    """Projected (and renamed: ``{source: output}``) listing in key order."""
    if isinstance(cols, dict):
        sel = [F.col(src).alias(dst) for src, dst in cols.items()]
    else:
        sel = [F.col(c) for c in cols]
    return df.select(*sel).orderBy(*[C.asc_pg(o) if isinstance(o, str) else o for o in order_by])


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType,
                   mode: str = "PERMISSIVE") -> tuple[DataFrame, DataFrame]:
    """Typed ingest of JSON lines.  Returns (rows, rejects): lines that are
    not JSON or do not fit the schema go to ``rejects`` with their raw
    text instead of silently becoming NULLs.

    Lines are read as text and parsed with ``from_json``, so the reject
    table can carry the raw line and be queried on its own."""
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])
    opts = {"mode": mode, "columnNameOfCorruptRecord": CORRUPT, **TEXT_OPTIONS}
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = lines.select(F.col("value"), F.from_json("value", full, opts).alias("_r"))
    bad_row = F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull()
    good = parsed.where(~bad_row).select(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])
    bad = parsed.where(bad_row).select(F.col("value").alias(CORRUPT))
    return good, bad


# Text formats keep microseconds (the writers' default stops at millis).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
TEXT_OPTIONS = {"timestampFormat": TS_FORMAT + "XXX", "timestampNTZFormat": TS_FORMAT}


def write_json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**TEXT_OPTIONS).json(path)


# Quotes are doubled inside quoted fields (RFC 4180), blanks are kept, and NULL has a mark of
# its own, so that it differs from an empty text.  (A text that is the mark itself reads as NULL.)
NULL_MARK = "\\N"
CSV_OPTIONS = {**TEXT_OPTIONS, "header": "true", "quote": '"', "escape": '"', "nullValue": NULL_MARK,
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row (the pages' export buttons)."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of ``export_csv``.  Records may span lines (texts with line
    ends), so a file is read by one task; the writer's number of files is
    the parallelism."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).option("multiLine", True).csv(path)


def chart_series(df: DataFrame, label: str, value: str, order_by: list | None = None) -> DataFrame:
    """(label, value) rows in chart order (``order_by`` columns, ascending
    with NULL last; default: the label)."""
    renamed = {label: "label", value: "value"}
    order = order_by or [label]
    extra = [o for o in order if o not in renamed]
    out = df.select(F.col(label).alias("label"), F.col(value).alias("value"), *extra)
    return out.orderBy(*[C.asc_pg(renamed.get(o, o)) for o in order]).select("label", "value")


def _search_predicate(df: DataFrame, search: str) -> Column:
    text = search.lower()
    return C.any_of([F.coalesce(F.lower(F.col(f.name).cast("string")), F.lit("")).contains(text)
                     for f in df.schema.fields
                     if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))])


SHALLOW = 10_000  #: rows up to which a page is sorted straight from the top
_PIVOTS, _SAMPLE = 16, 2_000
_ORDERED_TYPES = (T.StringType, T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def _after(order: list[tuple[str, bool]], schema: T.StructType, pivot: tuple) -> Column:
    """Whether a row comes after ``pivot`` in the page order (ascending: NULL first; descending: NULL last)."""
    found = F.lit(False)
    for (name, asc), value in reversed(list(zip(order, pivot, strict=True))):
        c, kind = F.col(f"`{name}`"), schema[name].dataType
        at = F.timestamp_micros(F.lit(value)) if isinstance(kind, T.TimestampType) else F.lit(value).cast(kind)
        if value is None:
            later, same = (c.isNotNull() if asc else F.lit(False)), c.isNull()
        else:
            later, same = F.coalesce(c > at, F.lit(False)) if asc else F.coalesce(c < at, F.lit(True)), c.eqNullSafe(at)
        found = later | (same & found)
    return found


def _around(rows: DataFrame, order: list[tuple[str, bool]], columns: list[Column], offset: int, size: int) -> tuple[DataFrame, int]:
    """Rows among which those at ``offset`` to ``offset + size`` are, and how many rows come before them.

    The bounds are narrowed as in a search for a quantile: some rows of a sample part the rest, one pass counts
    what lies between them, and the parts with the page go on."""
    def micros(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.unix_micros(c) if isinstance(rows.schema[name].dataType, T.TimestampType) else c

    inside, before, left = F.lit(True), 0, rows.count()
    while left > max(SHALLOW, 4 * size) and offset < before + left:
        some = rows.where(inside).sample(min(1.0, _SAMPLE / left)).limit(4 * _SAMPLE).orderBy(*columns)
        sample = [tuple(r) for r in some.select(*[micros(c).alias(f"c{i}") for i, (c, _) in enumerate(order)]).collect()]
        pivots = list(dict.fromkeys(sample[len(sample) * i // (_PIVOTS + 1)] for i in range(1, _PIVOTS + 1))) if sample else []
        tests = [_after(order, rows.schema, p) for p in pivots]
        part = sum((t.cast("int") for t in tests), F.lit(0))
        counts = dict(rows.where(inside).groupBy(part.alias("part")).count().collect())
        first = last = 0
        while first < len(pivots) and offset >= before + counts.get(first, 0):
            before += counts.get(first, 0)
            first = last = first + 1
        held = counts.get(first, 0)
        while last < len(pivots) and offset + size > before + held:
            last += 1
            held += counts.get(last, 0)
        if held == left:  # equal rows: no pivot parts them
            break
        if first > 0:
            inside = inside & tests[first - 1]
        if last < len(pivots):
            inside = inside & ~tests[last]
        left = held
    return rows.where(inside), before


def browse_page(df: DataFrame, search: str | None = None, sort: list[tuple[str, bool]] | None = None,
                page: int = 0, size: int = 10) -> DataFrame:
    """One page of a table view: case-insensitive text search over all
    columns, sort (ascending flag per column; NULL first when ascending,
    last when descending) completed by every other column so that pages
    never overlap, then ``offset``/``limit``.

    A page that ends within the first ``SHALLOW`` rows is a plain top-k.  For
    a later one its bounds are found first by counting (a few passes over the
    sort columns while the frame is built), and only the rows between them are
    sorted; so no task gets the pages before it.  Tables with array or struct
    columns, which have no literal to compare with, are sorted from the top."""
    out = df.where(_search_predicate(df, search)) if search else df
    order = list(sort or [])
    used = {c for c, _ in order}
    order += [(f.name, True) for f in df.schema.fields if f.name not in used and not isinstance(f.dataType, T.MapType)]
    columns = [F.col(f"`{c}`").asc_nulls_first() if asc else F.col(f"`{c}`").desc_nulls_last() for c, asc in order]
    offset = page * size
    if offset + size > SHALLOW and all(isinstance(df.schema[c].dataType, _ORDERED_TYPES) for c, _ in order):
        out, before = _around(out, order, columns, offset, size)
        offset -= before
    return out.orderBy(*columns).offset(offset).limit(size)


def write_by_day(df: DataFrame, path: str, ts: str, day_col: str = "dia") -> None:
    """Write an event table laid out by day (``partitionBy``), the Spark
    counterpart of the reference's indexes on its event tables: a filter
    on the day column prunes whole folders before any file is opened.
    Rows are range-partitioned on (day, time) before the write: each task
    covers a contiguous stretch of days (few files), and a day holding a
    large share of the rows is split over several tasks instead of one."""
    (df.withColumn(day_col, F.to_date(F.col(ts)))
     .repartitionByRange(F.col(day_col).asc_nulls_last(), F.col(ts).asc_nulls_last())
     .write.mode("overwrite").partitionBy(day_col).parquet(path))


def read_days(spark: SparkSession, path: str, start, end, day_col: str = "dia") -> DataFrame:
    """Rows of the days in [start, end] from a ``write_by_day`` table."""
    df = spark.read.parquet(path)
    return df.where(F.col(day_col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def write_snapshot(df: DataFrame, path: str) -> None:
    """Truncate-and-reload: the folder is replaced by ``df``."""
    df.write.mode("overwrite").parquet(path)


# Audit columns written for every recorded action (fixed: the reference's
# activity-log schema).
AUDIT_COLUMNS = ("id_usuario", "accion", "modulo", "detalle", "dispositivo", "ip", "resultado",
                 "duracion_segundos", "fecha_hora")


def audit_rows(actions: DataFrame, as_of) -> DataFrame:
    """Actions projected to the audit schema; a missing time is ``as_of``
    (the reference stamps NOW())."""
    cols = []
    for c in AUDIT_COLUMNS:
        if c == "fecha_hora":
            v = F.coalesce(F.col(c), F.lit(as_of).cast("timestamp_ntz")) if c in actions.columns \
                else F.lit(as_of).cast("timestamp_ntz")
        elif c in actions.columns:
            v = F.col(c)
        else:
            v = F.lit(None).cast("bigint" if c in ("id_usuario", "duracion_segundos") else "string")
        cols.append(v.alias(c))
    return actions.select(*cols)


def append_audit(actions: DataFrame, log_path: str, footprint_path: str, as_of,
                 run_id: str | None = None) -> str:
    """Each action goes to both the activity log and the footprint table.

    The projection is staged once in shared storage and copied from there
    to both tables, so they hold the same rows even if the input is not
    repeatable.  Each run writes its own ``run_id=<id>`` folder in both
    tables (overwrite), so re-running a failed run with the same id
    replaces its rows instead of appending them twice.  Returns the id."""
    from ..session import scratch_path
    spark = actions.sparkSession
    run = run_id or scratch_path(spark, "run").rsplit("-", 1)[-1]
    staging = scratch_path(spark, f"audit-staging-{run}")
    audit_rows(actions, as_of).write.mode("overwrite").parquet(staging)
    staged = spark.read.parquet(staging)
    staged.write.mode("overwrite").parquet(f"{log_path}/run_id={run}")
    staged.write.mode("overwrite").parquet(f"{footprint_path}/run_id={run}")
    return run

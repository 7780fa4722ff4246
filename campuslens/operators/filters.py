"""Projections, lookups and predicate operators.

All filters are plain Catalyst predicates, so equality and range
conditions on stored columns reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

# Column names that are never returned by a lookup (fixed: the reference
# stores credentials under these names).
SECRET_COLUMNS = ("contrasena", "password", "password_hash", "hash")


def get_by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Rows whose ``key`` equals ``value``; an empty frame means "not found"."""
    return df.where(F.col(key) == F.lit(value))


def find_by_unique(df: DataFrame, column: str, value, drop: tuple[str, ...] = SECRET_COLUMNS) -> DataFrame:
    """Lookup by a unique text column; credential columns are never selected."""
    keep = [c for c in df.columns if c.lower() not in drop]
    return df.where(F.col(column) == F.lit(value)).select(*keep)


def _opt(pred_fn, value):
    return None if value is None or value == "" else pred_fn(value)


def filter_activity(df: DataFrame, user=None, module=None, start=None, end=None,
                    user_col: str = "id_usuario", module_col: str = "modulo",
                    time_col: str = "fecha_hora") -> DataFrame:
    """AND of the given optional filters (empty or None = not applied),
    newest first with NULL times first (PostgreSQL ``DESC``).

    ``module`` is an ILIKE pattern taken as given: ``%`` and ``_`` in it
    act as wildcards, as in the reference."""
    pred = C.all_of([
        _opt(lambda v: F.col(user_col) == F.lit(v), user),
        _opt(lambda v: F.col(module_col).ilike(str(v)), module),
        _opt(lambda v: F.col(time_col) >= F.lit(v).cast("timestamp_ntz"), start),
        _opt(lambda v: F.col(time_col) <= F.lit(v).cast("timestamp_ntz"), end),
    ])
    return df.where(pred).orderBy(C.desc_pg(time_col))


def filter_wifi(df: DataFrame, start=None, end=None, classroom=None,
                time_col: str = "fecha", room_col: str = "id_aula") -> DataFrame:
    """Optional from / to / classroom filter, oldest first (NULL last)."""
    pred = C.all_of([
        _opt(lambda v: F.col(time_col) >= F.lit(v).cast("timestamp_ntz"), start),
        _opt(lambda v: F.col(time_col) <= F.lit(v).cast("timestamp_ntz"), end),
        _opt(lambda v: F.col(room_col) == F.lit(v), classroom),
    ])
    return df.where(pred).orderBy(C.asc_pg(time_col))


def attendance_filter(department=None, degree=None, date=None, dept_col="id_departamento",
                      degree_col="id_carrera", date_col="fecha") -> Column:
    """Predicate of the attendance listing's optional filters."""
    return C.all_of([
        _opt(lambda v: F.col(dept_col) == F.lit(v), department),
        _opt(lambda v: F.col(degree_col) == F.lit(v), degree),
        _opt(lambda v: F.col(date_col) == F.lit(v).cast("date"), date),
    ])


def filter_attendance(df: DataFrame, department=None, degree=None, date=None, **names) -> DataFrame:
    return df.where(attendance_filter(department, degree, date, **names))


def search_ci(df: DataFrame, column: str, pattern: str, id_col: str) -> DataFrame:
    """First row whose ``column`` ILIKE ``pattern``.  The reference takes
    an arbitrary first hit; here ties are broken by the id, so the answer
    is repeatable.  Top-1 is a map-side ``TakeOrderedAndProject``."""
    return df.where(F.col(column).ilike(pattern)).orderBy(F.col(id_col).asc_nulls_last()).limit(1)


def autocomplete(df: DataFrame, column: str, text: str | None, min_len: int = 2) -> DataFrame:
    """Rows whose ``column`` contains ``text`` (case-insensitive) when the
    input has at least ``min_len`` characters; otherwise no rows."""
    if text is None or len(text) < min_len:
        return df.limit(0)
    return df.where(F.lower(F.col(column)).contains(text.lower()))


def history_for_key(df: DataFrame, key: str, value, time_cols: list[str], asc: bool = True) -> DataFrame:
    """All rows of one key ordered by time (PostgreSQL NULL placement)."""
    order = [C.asc_pg(c) if asc else C.desc_pg(c) for c in time_cols]
    return df.where(F.col(key) == F.lit(value)).orderBy(*order)


def valid_at(df: DataFrame, start: str, end: str, as_of, latest_per: str | None = None) -> DataFrame:
    """Rows whose [start, end] contains ``as_of`` (both ends inclusive).

    With ``latest_per``, only the newest such row (greatest ``start``,
    ties by every column) of each ``latest_per`` value is kept, using a
    partial max-aggregation so a busy key never lands whole in one task.
    """
    t = F.lit(as_of).cast("timestamp_ntz")
    hit = df.where((F.col(start) <= t) & (F.col(end) >= t))
    if latest_per is None:
        return hit
    payload = [c for c in df.columns if c != latest_per]
    best = F.max(F.struct(C.newest_first_key(start).alias("k"), *[F.col(c) for c in payload])).alias("_best")
    return hit.groupBy(latest_per).agg(best).select(latest_per, *[F.col(f"_best.{c}").alias(c) for c in payload])


def wifi_severity(df: DataFrame, latency="latencia", signal="nivel_senal", jitter="jitter",
                  lat_hi=100, sig_lo=-80, jit_hi=30, out: str = "severidad") -> DataFrame:
    return df.withColumn(out, C.wifi_severity(latency, signal, jitter, lat_hi, sig_lo, jit_hi))


def joinable_classes(df: DataFrame, as_of, start="fecha_inicio", end="fecha_fin", state="estado",
                     running: str = "EN_CURSO", out: str = "se_puede_unir") -> DataFrame:
    """A class can be joined iff start <= as_of, (no end or as_of <= end)
    and its state is ``running``.  NULL start or state gives false."""
    t = F.lit(as_of).cast("timestamp_ntz")
    ok = (F.col(start) <= t) & (F.col(end).isNull() | (t <= F.col(end))) & (F.col(state) == F.lit(running))
    return df.withColumn(out, F.coalesce(ok, F.lit(False)))


def parse_coordinates(df: DataFrame, column: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """'3.71N, 8.67E' -> signed lat / lng doubles (S and W negative);
    text that does not parse gives NULLs."""
    return df.withColumn(lat, C.coordinate_lat(column)).withColumn(lng, C.coordinate_lng(column))


def default_nulls(df: DataFrame, defaults: dict) -> DataFrame:
    """Replace NULL (only NULL, not 0 or '') by a per-column default."""
    return df.select(*[
        F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
        for c in df.columns
    ])


def split_timestamp(df: DataFrame, ts: str, date_col: str = "fecha", time_col: str = "hora") -> DataFrame:
    """Timestamp -> date and time of day in whole seconds."""
    return df.withColumn(date_col, F.to_date(F.col(ts))).withColumn(time_col, C.seconds_of_day(ts))


def guest_list(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, C.guest_array(column))

"""Scalar column expressions shared by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``
so it stays inside whole-stage codegen; there are no Python UDFs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in km used by the map page's distance
# library (its public documentation gives 6371.0088).
EARTH_RADIUS_KM = 6371.0088


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def desc_pg(c) -> Column:
    """PostgreSQL ``DESC``: NULLs come first."""
    return col(c).desc_nulls_first()


def asc_pg(c) -> Column:
    """PostgreSQL ``ASC``: NULLs come last."""
    return col(c).asc_nulls_last()


def all_of(preds: list[Column]) -> Column:
    """AND of optional predicates; an empty list means no filter."""
    preds = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def any_of(preds: list[Column]) -> Column:
    preds = [p for p in preds if p is not None]
    return reduce(lambda a, b: a | b, preds) if preds else F.lit(False)


def newest_first_key(*cols) -> Column:
    """A struct whose ``max`` is the first row under ``ORDER BY c DESC`` in
    PostgreSQL, i.e. NULL counts as the largest value.

    Spark orders NULL below everything inside a struct, so each column is
    preceded by its NULL flag.  Taking ``max`` of this struct (plus the
    payload) is a partial-aggregation-friendly "latest row per key".
    """
    parts = []
    for c in cols:
        parts.append(col(c).isNull())
        parts.append(col(c))
    return F.struct(*parts)


def wifi_severity(latency, signal, jitter, lat_hi=100, sig_lo=-80, jit_hi=30) -> Column:
    """'high' when latency > lat_hi or signal < sig_lo, else 'medium' when
    jitter > jit_hi, else ''.  Comparisons with NULL are not true, so NULL
    metrics never raise an alert."""
    high = F.coalesce(col(latency) > lat_hi, F.lit(False)) | F.coalesce(col(signal) < sig_lo, F.lit(False))
    medium = F.coalesce(col(jitter) > jit_hi, F.lit(False))
    return F.when(high, F.lit("high")).when(medium, F.lit("medium")).otherwise(F.lit(""))


_COORD = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([NSns])\s*,\s*([0-9]+(?:\.[0-9]+)?)\s*([EWew])\s*$"


def coordinate_lat(text) -> Column:
    value = F.regexp_extract(col(text), _COORD, 1)
    hemi = F.upper(F.regexp_extract(col(text), _COORD, 2))
    num = value.try_cast("double")
    return F.when(hemi == "S", -num).when(hemi == "N", num)


def coordinate_lng(text) -> Column:
    value = F.regexp_extract(col(text), _COORD, 3)
    hemi = F.upper(F.regexp_extract(col(text), _COORD, 4))
    num = value.try_cast("double")
    return F.when(hemi == "W", -num).when(hemi == "E", num)


def haversine_km(lat1, lng1, lat2, lng2, radius_km: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance from built-in trigonometric functions."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dphi = p2 - p1
    dlmb = F.radians(col(lng2)) - F.radians(col(lng1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2 * radius_km) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def seconds_of_day(ts) -> Column:
    c = col(ts)
    return (F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c)).cast("int")).cast("int")


def minutes_between(earlier, later) -> Column:
    """(later - earlier) in minutes as a double; NULL if either is NULL.
    Exact to the microsecond and independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", col(earlier), col(later)).cast("double") / F.lit(60_000_000.0)


def semester_label(ts) -> Column:
    """'YYYY-S1' for months 1-6 else 'YYYY-S2'.  The reference's CONCAT
    skips NULL, so a NULL time gives '-S2' (the CASE falls to ELSE)."""
    c = col(ts)
    year = F.year(c).cast("string")
    half = F.when(F.month(c).between(1, 6), F.lit("-S1")).otherwise(F.lit("-S2"))
    return F.concat_ws("", year, half)


def trunc_to(ts, unit: str) -> Column:
    """DATE_TRUNC(unit, ts) as ``timestamp_ntz`` (Monday weeks).

    Done on the date part so the session zone does not matter.
    """
    return F.trunc(F.to_date(col(ts)), unit).cast("timestamp_ntz")


def guest_array(text) -> Column:
    """Comma text -> array of trimmed names; '' or NULL -> [].  As on the
    class page, only an empty text means "no guests": a text of blanks
    splits into one empty name."""
    c = col(text)
    parts = F.transform(F.split(c, ","), lambda x: F.trim(x))
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))

"""Window-style operators, top-k and the alert feed.

"Latest row per key" is a max-aggregation of a struct (partial
aggregation before the shuffle, so a key holding a third of the rows is
already reduced map-side).  Running numbers and "previous row" gaps use
the range-partitioned global order of ``plans.ordered`` instead of a
window with no partition, and the segments of ``plans.segmented`` instead
of a window over one hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import ordered, segmented


def latest_per_key(df: DataFrame, key: str, order: list[str], nulls: str = "first") -> DataFrame:
    """The newest row of each ``key`` by ``order`` descending.

    ``nulls="first"`` is PostgreSQL's ``DESC`` (a NULL time wins, as in
    the reference's ``DISTINCT ON``); ``"last"`` ignores NULL times when a
    real one exists.  Ties are broken by the remaining columns, so the
    result is repeatable (the reference's choice is arbitrary)."""
    rest = [c for c in df.columns if c != key and c not in order]
    if nulls == "first":
        k = C.newest_first_key(*order)
    else:
        k = F.struct(*[x for c in order for x in (F.col(c).isNotNull(), F.col(c))])
    best = F.max(F.struct(k.alias("_k"), *[F.col(c) for c in order + rest])).alias("_b")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_b.{c}").alias(c) for c in order + rest])


def top_n_by(df: DataFrame, order: list[Column], n: int = 50) -> DataFrame:
    """The first ``n`` rows under ``order`` (a ``TakeOrderedAndProject``:
    per-partition top-n, then a merge of n rows per partition)."""
    return df.orderBy(*order).limit(n)


def recent_alerts(alerts: DataFrame, n: int = 50, time: str = "timestamp", id_col: str = "id_alerta") -> DataFrame:
    """The newest ``n`` alerts (NULL time first, as PostgreSQL DESC)."""
    return top_n_by(alerts, [C.desc_pg(time), F.col(id_col).desc_nulls_last()], n)


# Medal marks of the ranking tables (positions 1, 2, 3).
MEDALS = ("🥇", "🥈", "🥉")


def rank_medals(df: DataFrame, key: str, alias: str = "total", first_seen: str | None = None) -> DataFrame:
    """Count per key, rank by count, medal for ranks 1-3.  Ties keep the
    order in which the keys first appear (``first_seen``, the page's
    stable sort over its history), then the key itself.

    The count is a grouped aggregate; the ranking runs on its result
    through the range-partitioned global order, so even a very large
    number of keys never lands in one task."""
    aggs = [F.count(F.lit(1)).alias(alias)]
    order = [F.col(alias).desc()]
    if first_seen:
        aggs.append(F.min(first_seen).alias("_first"))
        order.append(F.col("_first").asc_nulls_last())
    counts = df.groupBy(key).agg(*aggs)
    order.append(F.col(key).asc_nulls_last())
    ranked = ordered.global_row_number(counts, order, {alias, key, "_first"}, out="posicion")
    medal = F.when(F.col("posicion") == 1, F.lit(MEDALS[0])) \
        .when(F.col("posicion") == 2, F.lit(MEDALS[1])) \
        .when(F.col("posicion") == 3, F.lit(MEDALS[2])).otherwise(F.lit(""))
    return ranked.select(key, alias, "posicion", medal.alias("medalla"))


def running_visits(df: DataFrame, ts: str, by: str | None = None, id_col: str | None = None,
                   out: str = "visita") -> DataFrame:
    """Cumulative visit number over time (1, 2, ...), globally or per key.

    The global form numbers rows in a range-partitioned order
    (``plans.ordered``), the form per key by segments of time
    (``plans.segmented``), so neither the whole table nor a key with most
    of the rows is ever windowed in one task."""
    if by is not None:
        return segmented.row_number(df, [by], [ts] + ([id_col] if id_col else []), out)
    tie = [F.col(id_col).asc_nulls_last()] if id_col else []
    return ordered.global_row_number(df, [F.col(ts).asc_nulls_last(), *tie], {ts, id_col}, out=out)


def report_gaps(df: DataFrame, key: str, ts: str, minutes: float = 15, id_col: str | None = None,
                per_key: bool = True) -> DataFrame:
    """Minutes since the previous report and an alert flag (> ``minutes``).

    ``per_key=True`` compares each row with the previous row of the same
    key (what the alert text says); ``per_key=False`` compares consecutive
    rows of the whole table in time order (what the page's loop does).
    Rows are ordered by time ascending with NULL last (PostgreSQL ASC),
    then by ``id_col``.  A NULL time gives a NULL gap and no alert."""
    if per_key:
        prev = segmented.previous(df, [key], [ts] + ([id_col] if id_col else []), [ts], "_prev_")
    else:
        tie = [F.col(id_col).asc_nulls_last()] if id_col else []
        used = {ts, id_col} if id_col else {ts}
        prev = ordered.global_previous(df, [F.col(ts).asc_nulls_last(), *tie], used, [ts], prefix="_prev_")
    out = prev.withColumn("minutos", C.minutes_between("_prev_" + ts, ts))
    return out.withColumn("alerta", F.coalesce(F.col("minutos") > minutes, F.lit(False))).drop("_prev_" + ts)


def report_gaps_global(df: DataFrame, ts: str, minutes: float = 15, id_col: str | None = None,
                       key: str = "id_bus") -> DataFrame:
    """Gaps between consecutive rows of the whole table in time order (the
    page's loop); ``report_gaps(..., per_key=False)``."""
    return report_gaps(df, key, ts, minutes, id_col=id_col, per_key=False)


def route_path(stops: DataFrame, route: str = "id_ruta", order: str = "orden", stop: str = "id_parada") -> DataFrame:
    """Stops of each route in drawing order (``orden``, ties by stop id)
    with their 1-based step number ``paso``: the polyline the stop page
    draws, as rows.  Steps are numbered by segments of the order, so a
    route with a very large number of stops is still split across tasks
    and no per-route array is built."""
    return segmented.row_number(stops, [route], [order, stop], "paso")


def fleet_alerts(pos: DataFrame, max_speed: float = 60, gap: float = 15, per_bus: bool = False,
                 bus: str = "id_bus", speed: str = "velocidad", ts: str = "fecha_hora",
                 address: str = "direccion", id_col: str | None = "id_posicion") -> DataFrame:
    """One feed of (a) speed > ``max_speed``, (b) gap > ``gap`` minutes and
    (c) speed = 0 (stopped, with its address).  A row can raise several.

    The gap uses ``report_gaps`` (global by default, as the page's loop);
    the three alert kinds are built in one pass with ``explode`` of the
    non-null members of an array, which equals the union of three filters."""
    used = [c for c in pos.columns if c in (id_col, bus, ts, address, speed)]
    g = report_gaps(pos.select(*used), bus, ts, gap, id_col=id_col, per_key=per_bus)
    kinds = F.array(
        F.when(F.col(speed) > max_speed, F.struct(F.lit("exceso_velocidad").alias("tipo"),
                                                  F.col(speed).cast("double").alias("valor"))),
        F.when(F.col("alerta"), F.struct(F.lit("sin_reporte").alias("tipo"), F.col("minutos").alias("valor"))),
        F.when(F.col(speed) == 0, F.struct(F.lit("detenido").alias("tipo"), F.lit(None).cast("double").alias("valor"))),
    )
    keep = [c for c in [id_col, bus, ts, address] if c]
    return (g.select(*keep, F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("_a"))
            .select(*keep, F.col("_a.tipo").alias("tipo"), F.col("_a.valor").alias("valor")))

"""Aggregations, reports and KPI rows.

Every grouped aggregate here has a map-side partial step (hash-based, or
sort-based for the struct maxima), so a key holding a large share of the
rows is reduced before the shuffle.  KPI rows that the reference fetched
with several sequential queries are fused into one pass per table;
one-row results from other tables are combined as scalar subqueries
(each runs once; no join is planned).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def _scalar(df: DataFrame, column: str) -> Column:
    """A one-row aggregate used as a scalar subquery: Spark runs it once
    and inlines the value, so no join of one-row frames is planned."""
    return df.select(column).scalar()


def count_by_key(df: DataFrame, key: str, alias: str = "total") -> DataFrame:
    """COUNT(*) per key (NULL is a group), largest first, ties by key."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias(alias))
            .orderBy(F.col(alias).desc(), F.col(key).asc_nulls_last()))


def top_n(df: DataFrame, key: str, n: int, alias: str = "total") -> DataFrame:
    """The ``n`` most frequent keys; the sort is a per-partition top-n
    followed by a merge (``TakeOrderedAndProject``)."""
    return count_by_key(df, key, alias).limit(n)


def top_users(df: DataFrame, user: str = "id_usuario", n: int = 5) -> DataFrame:
    """Most active users, labelled ``Usuario <id>`` (a NULL user is a group
    and is labelled ``Usuario null``, as the page's template does)."""
    return (top_n(df, user, n)
            .select(F.concat(F.lit("Usuario "), F.coalesce(F.col(user).cast("string"), F.lit("null"))).alias("usuario"),
                    F.col(user), F.col("total")))


def radio_listeners(listens: DataFrame, programs: DataFrame, user: str = "usuario_id",
                    program: str = "id_programa", pid: str = "id", title: str = "titulo_programa") -> DataFrame:
    """Listeners per programme **title**: COUNT(user) of the inner join,
    NULL users skipped, programmes with the same title merged.

    The listening table is reduced to one row per programme id before the
    join (eager aggregation), so the join and the final shuffle see only
    programme-sized inputs."""
    per_program = listens.groupBy(program).agg(F.count(F.col(user)).alias("_n"))
    joined = per_program.join(programs.select(F.col(pid).alias(program), title), program, "inner")
    return (joined.groupBy(F.col(title).alias("programa"))
            .agg(F.sum("_n").cast("long").alias("oyentes"))
            .orderBy(F.col("oyentes").desc(), F.col("programa").asc_nulls_last()))


_GRAINS = {"week": "semana", "month": "mes", "quarter": "trimestre", "semester": "semestre"}


def audience(listens: DataFrame, grain: str, time: str = "fecha", program: str = "id_programa",
             seconds: str = "segundos_escuchados") -> DataFrame:
    """Plays and listened seconds per period and programme.

    ``week`` / ``month`` / ``quarter`` are DATE_TRUNC (Monday weeks) as a
    timestamp; ``semester`` is the 'YYYY-S1' / 'YYYY-S2' label.  Newest
    period first (NULL first, as PostgreSQL ``DESC``)."""
    if grain not in _GRAINS:
        raise ValueError(f"grain must be one of {sorted(_GRAINS)}")
    name = _GRAINS[grain]
    period = C.semester_label(time) if grain == "semester" else C.trunc_to(time, grain)
    return (listens.groupBy(period.alias(name), F.col(program))
            .agg(F.count(F.lit(1)).alias("total_reproducciones"),
                 F.sum(seconds).cast("long").alias("total_segundos"))
            .orderBy(C.desc_pg(name), F.col(program).asc_nulls_last()))


def footprint_kpis(df: DataFrame, as_of, minutes: int = 5, prefix: str = "Radio",
                   user: str = "id_usuario", module: str = "modulo", seconds: str = "duracion_segundos",
                   time: str = "fecha_hora") -> DataFrame:
    """One row: total actions, distinct users, distinct users active in
    (as_of - minutes, as_of], most used module ('-' if none; ties by
    name) and seconds spent in modules matching ``prefix%``
    (case-insensitive, 0 if none).

    The reference sends seven queries.  Here the table is read once: one
    aggregation with grouping sets (user) and (module), partially
    aggregated map-side and shuffled once, then one global aggregate over
    its small result.  ``grouping_id`` tells the per-user rows from the
    per-module rows."""
    t = F.lit(as_of).cast("timestamp_ntz")
    recent = (F.col(time) > t - F.expr(f"INTERVAL {int(minutes)} MINUTES")) & (F.col(time) <= t)
    radio = F.when(F.col(module).ilike(prefix + "%"), F.col(seconds))
    g = df.groupingSets([[user], [module]], user, module).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.coalesce(recent, F.lit(False))).alias("_recent"),
        F.sum(radio).alias("_radio"),
        F.grouping_id().alias("_gid"))
    by_user = F.col("_gid") == 1     # module rolled up
    by_module = F.col("_gid") == 2   # user rolled up
    top = F.min(F.when(by_module, F.struct((-F.col("_n")).alias("n"), F.col(module).isNull().alias("z"),
                                           F.col(module).alias("m"))))
    return g.agg(
        F.coalesce(F.sum(F.when(by_user, F.col("_n"))), F.lit(0)).cast("long").alias("total_acciones"),
        F.count(F.when(by_user, F.col(user))).alias("usuarios_activos"),
        F.count_if(by_user & F.col(user).isNotNull() & F.col("_recent")).alias("usuarios_conectados"),
        F.coalesce(F.sum(F.when(by_user, F.col("_radio"))), F.lit(0)).cast("long").alias("tiempo_radio"),
        F.coalesce(top["m"], F.lit("-")).alias("modulo_top"))


def attendance_kpis(att: DataFrame, professors: DataFrame, date, date_col: str = "fecha",
                    valid: str = "validacion") -> DataFrame:
    """On ``date``: validated and not-validated counts (NULL in neither),
    plus the number of professors.  One pass over attendance."""
    day = att.where(F.col(date_col) == F.lit(date).cast("date")).agg(
        F.count_if(F.col(valid) == F.lit(True)).alias("asistencias_hoy"),
        F.count_if(F.col(valid) == F.lit(False)).alias("no_validadas"))
    total = professors.agg(F.count(F.lit(1)).alias("total_profesores"))
    return day.select("*", _scalar(total, "total_profesores").alias("total_profesores"))


def attendance_by_day(att: DataFrame, n: int = 7, newest: bool = False, date_col: str = "fecha",
                      valid: str = "validacion") -> DataFrame:
    """Validated count per date.  As written in the reference this keeps
    the ``n`` **oldest** dates; ``newest=True`` keeps the latest ones."""
    order = C.desc_pg(date_col) if newest else C.asc_pg(date_col)
    return (att.where(F.col(valid) == F.lit(True)).groupBy(date_col)
            .agg(F.count(F.lit(1)).alias("total")).orderBy(order).limit(n))


def transport_kpis(buses: DataFrame, routes: DataFrame, passengers: DataFrame, alerts: DataFrame, date,
                   state: str = "EN SERVICIO", bus_state: str = "estado", pax_time: str = "fecha",
                   alert_time: str = "timestamp") -> DataFrame:
    """Buses in ``state``, routes, passengers on ``date``, alerts on ``date``."""
    d = F.lit(date).cast("date")
    a = buses.agg(F.count_if(F.col(bus_state) == F.lit(state)).alias("activos"))
    r = routes.agg(F.count(F.lit(1)).alias("rutas"))
    p = passengers.where(F.to_date(pax_time) == d).agg(F.count(F.lit(1)).alias("pasajeros_hoy"))
    al = alerts.where(F.to_date(alert_time) == d).agg(F.count(F.lit(1)).alias("alertas"))
    return a.select("activos", _scalar(r, "rutas").alias("rutas"), _scalar(p, "pasajeros_hoy").alias("pasajeros_hoy"),
                    _scalar(al, "alertas").alias("alertas"))


def transport_daily(buses: DataFrame, routes: DataFrame, alerts: DataFrame, date,
                    alert_time: str = "timestamp", in_service: str = "EN SERVICIO",
                    out_of_service: str = "FUERA DE SERVICIO") -> DataFrame:
    """The daily snapshot row: capacity sum, buses by state, routes,
    alerts that day, mean capacity (the reference calls it occupancy),
    mean route duration in seconds and one route name (the reference's
    unordered ``LIMIT 1``; here the smallest name, so it is repeatable)."""
    d = F.lit(date).cast("date")
    b = buses.agg(
        F.sum("capacidad").cast("long").alias("capacidad"),
        F.count_if(F.col("estado") == F.lit(in_service)).alias("buses_en_servicio"),
        F.count_if(F.col("estado") == F.lit(out_of_service)).alias("buses_fuera_servicio"),
        F.avg(F.col("capacidad").cast("double")).alias("ocupacion_promedio"))
    r = routes.agg(
        F.count(F.lit(1)).alias("rutas_activas"),
        F.avg((F.col("hora_fin") - F.col("hora_inicio")).cast("double")).alias("tiempo_promedio_llegada"),
        F.min("nombre").alias("ruta"))
    al = alerts.where(F.to_date(alert_time) == d).agg(F.count(F.lit(1)).alias("alertas_hoy"))
    rs = r.select(F.struct("rutas_activas", "tiempo_promedio_llegada", "ruta").alias("_r")).scalar()  # one pass
    return b.select(d.alias("fecha"), "capacidad", "buses_en_servicio", "buses_fuera_servicio",
                    rs["rutas_activas"].alias("rutas_activas"), _scalar(al, "alertas_hoy").alias("alertas_hoy"),
                    "ocupacion_promedio", rs["tiempo_promedio_llegada"].alias("tiempo_promedio_llegada"),
                    rs["ruta"].alias("ruta"))


def transport_latest(df: DataFrame, date_col: str = "fecha", id_col: str = "id_transporte",
                     fields=("buses_en_servicio", "rutas_activas", "capacidad", "alertas_hoy")) -> DataFrame:
    """KPIs of the newest snapshot row (date DESC with NULL first, then
    id DESC); zeros when the table is empty."""
    best = df.agg(F.max(F.struct(C.newest_first_key(date_col).alias("k"), F.col(id_col).alias("i"),
                                 *[F.col(f) for f in fields])).alias("_b"))
    return best.select(*[F.coalesce(F.col(f"_b.{f}"), F.lit(0)).cast("long").alias(f) for f in fields])


def fleet_kpis(pos: DataFrame, bus: str = "id_bus", speed: str = "velocidad", time: str = "fecha_hora") -> DataFrame:
    """Distinct buses (a NULL id counts as one value, as a JS Set does),
    rows, mean speed over all rows with NULL read as 0 (1 decimal), and
    the time of the last row in ascending time order.  PostgreSQL puts
    NULL times last, so any NULL time makes that value NULL."""
    per_bus = pos.groupBy(bus).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.coalesce(F.col(speed), F.lit(0))).alias("_s"),
        F.count_if(F.col(time).isNull()).alias("_nt"),
        F.max(time).alias("_mt"))
    agg = per_bus.agg(F.count(F.lit(1)).alias("buses"), F.sum("_n").cast("long").alias("recorridos"),
                      F.sum("_s").alias("_s"), F.sum("_nt").alias("_nt"), F.max("_mt").alias("_mt"))
    return agg.select(
        F.when(F.col("recorridos") > 0, F.col("buses")).otherwise(F.lit(0)).cast("long").alias("buses"),
        F.coalesce(F.col("recorridos"), F.lit(0)).cast("long").alias("recorridos"),
        F.round(F.col("_s") / F.col("recorridos"), 1).cast("double").alias("velocidad_media"),
        F.when(F.col("_nt") > 0, F.lit(None)).otherwise(F.col("_mt")).alias("ultima"))


def speed_by_route(pos: DataFrame, route: str = "id_ruta", speed: str = "velocidad") -> DataFrame:
    """Mean speed per route (1 decimal).  The page turns a route with any
    NULL speed into NaN; here NULLs are skipped and counted in
    ``null_rows``."""
    return (pos.groupBy(route).agg(
        F.round(F.avg(speed), 1).cast("double").alias("velocidad_media"),
        F.count_if(F.col(speed).isNull()).alias("null_rows"))
        .orderBy(F.col(route).asc_nulls_last()))


# The four class states of the video-class page.
CLASS_STATES = ("PROGRAMADA", "EN_CURSO", "FINALIZADA", "CANCELADA")


def class_states(df: DataFrame, states=CLASS_STATES, state: str = "estado") -> DataFrame:
    """Count of each listed state in one pass; states with no rows are 0."""
    return df.agg(*[F.count_if(F.col(state) == F.lit(s)).alias(s.lower()) for s in states])


def classes_per_month(df: DataFrame, start: str = "fecha_inicio") -> DataFrame:
    """Classes per start month as 'yyyy-MM' (the page's locale label is not
    reproduced); NULL start is its own group."""
    return (df.groupBy(F.date_format(F.col(start), "yyyy-MM").alias("mes"))
            .agg(F.count(F.lit(1)).alias("total")).orderBy(C.asc_pg("mes")))


def radio_kpis(listeners: DataFrame, programs: DataFrame, title: str = "titulo_programa",
               pid: str = "id") -> DataFrame:
    """Total listeners, mean per programme (1 decimal) and the top title,
    over all programme titles (those without listeners count as 0).  Ties
    go to the title of the smallest programme id, as the page keeps the
    programme listing's id order when it sorts.

    ``listeners`` is the output of ``radio_listeners`` (programa, oyentes)."""
    titles = programs.groupBy(F.col(title).alias("programa")).agg(F.min(pid).alias("_first_id"))
    per = titles.join(listeners, "programa", "left").select(
        "programa", "_first_id", F.coalesce(F.col("oyentes"), F.lit(0)).alias("oyentes"))
    top = F.min(F.struct((-F.col("oyentes")).alias("n"), F.col("_first_id"), F.col("programa")))
    return per.agg(
        F.coalesce(F.sum("oyentes"), F.lit(0)).cast("long").alias("total_oyentes"),
        F.round(F.coalesce(F.sum("oyentes") / F.count(F.lit(1)), F.lit(0.0)), 1).cast("double").alias("promedio_oyentes"),
        F.coalesce(top["programa"], F.lit("-")).alias("top_programa"))


def bounds(df: DataFrame, lat: str = "latitud", lng: str = "longitud", by: str | None = None) -> DataFrame:
    """Bounding box of a point set (optionally per group)."""
    aggs = [F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"),
            F.min(lng).alias("lng_min"), F.max(lng).alias("lng_max"), F.count(F.lit(1)).alias("puntos")]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


# --- statistics page (routes the page calls but the server lacks; the
# aggregate function is our reading of the page's columns) -------------


def _range(df: DataFrame, time: str, start=None, end=None) -> DataFrame:
    if start:
        df = df.where(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col(time) <= F.lit(end).cast("timestamp_ntz"))
    return df


def users_by_role(users: DataFrame, role: str = "rol") -> DataFrame:
    return users.groupBy(role).agg(F.count(F.lit(1)).alias("total")).orderBy(C.asc_pg(role))


def visits_per_day(visits: DataFrame, time: str = "fecha", start=None, end=None) -> DataFrame:
    return (_range(visits, time, start, end).groupBy(F.to_date(time).alias("fecha"))
            .agg(F.count(F.lit(1)).alias("total")).orderBy(C.asc_pg("fecha")))


def attendance_by_professor(att: DataFrame, professors: DataFrame, users: DataFrame, start=None, end=None,
                            time: str = "hora_entrada") -> DataFrame:
    """Attendance rows per professor name.  Counted per professor id first,
    then joined to the (smaller) professor and user tables."""
    per = _range(att, time, start, end).groupBy("id_profesor").agg(F.count(F.lit(1)).alias("_n"))
    named = (per.join(professors.select("id_profesor", "id_usuario"), "id_profesor")
             .join(users.select("id_usuario", F.col("nombre").alias("profesor")), "id_usuario"))
    return (named.groupBy("profesor").agg(F.sum("_n").cast("long").alias("asistencias"))
            .orderBy(F.col("asistencias").desc(), C.asc_pg("profesor")))


def environment_by_day(readings: DataFrame, sensors: DataFrame, types: DataFrame, columns: dict[str, str],
                       start=None, end=None, parameter: str | None = None) -> DataFrame:
    """Daily mean reading per sensor type, one column per listed type
    (``columns`` maps a type name to its output column).

    The sensor catalogue is cut to the listed types first, so the join
    drops all other readings before the one aggregation by day, whose
    partial step leaves a row per day and task to shuffle."""
    if parameter:
        columns = {k: v for k, v in columns.items() if v == parameter}
    r = readings.select("id_sensor", "fecha", "valor")
    if start:
        r = r.where(F.col("fecha") >= F.lit(start).cast("date"))
    if end:
        r = r.where(F.col("fecha") <= F.lit(end).cast("date"))
    wanted = types.where(F.col("nombre").isin(list(columns))).select("id_tipo", F.col("nombre").alias("_tipo"))
    kind = sensors.select("id_sensor", "id_tipo").join(wanted, "id_tipo").select("id_sensor", "_tipo")
    aggs = []
    for name, out in columns.items():
        value = F.when(F.col("_tipo") == name, F.col("valor"))
        aggs.append((F.sum(value).cast("double") / F.count(value)).alias(out))
    return r.join(kind, "id_sensor").groupBy("fecha").agg(*aggs).orderBy(C.asc_pg("fecha"))


def wifi_qos_series(wifi: DataFrame, start=None, end=None, time: str = "fecha") -> DataFrame:
    """Daily means of the Wi-Fi metrics under the page's labels."""
    def mean(c):
        return (F.sum(c).cast("double") / F.count(c)).alias
    df = _range(wifi, time, start, end)
    return (df.groupBy(F.to_date(time).alias("fecha")).agg(
        mean("latencia")("latencia"), mean("jitter")("jitter"), mean("ancho_banda")("velocidad"),
        mean("nivel_senal")("rssi"), mean("perdida_paquetes")("perdida"))
        .orderBy(C.asc_pg("fecha")))

"""Join operators.

No join here carries a broadcast hint: Catalyst's size estimate and
AQE's runtime statistics choose broadcast only for sides under
``spark.sql.autoBroadcastJoinThreshold`` and fall back to a shuffle join
otherwise, with AQE splitting skewed partitions.  Many-to-many bridges
are aggregated per parent *before* joining, so no join multiplies
bridge rows against each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .filters import attendance_filter


def student_directory(students: DataFrame, users: DataFrame) -> DataFrame:
    """Students with their user's name and e-mail (inner join), by id."""
    u = users.select("id_usuario", "nombre", "correo")
    return (students.join(u, "id_usuario", "inner")
            .select(F.col("id_estudiante").alias("id"), "nombre", "correo", "matricula", "id_usuario")
            .orderBy(F.col("id").asc_nulls_last()))


@dataclass(frozen=True)
class Bridge:
    """A many-to-many link table and the dimension it points to."""
    links: DataFrame
    dim: DataFrame
    key: str            # dimension id, present in both frames
    name: str = "nombre"
    out: str = ""        # output column name
    parent: str = "id_profesor"


def _names_per_parent(b: Bridge) -> DataFrame:
    """Distinct dimension names of each parent joined with ', ' in byte
    order (``string_agg(DISTINCT ...)``); NULL names are skipped.  The
    list per parent is bounded by the dimension's distinct names."""
    pairs = (b.links.select(b.parent, b.key).join(b.dim.select(b.key, b.name), b.key, "inner")
             .where(F.col(b.name).isNotNull()))
    # collect_set de-duplicates map-side (partial aggregation), so one
    # shuffle by parent suffices and a parent with a huge link list sends
    # at most its distinct names per partition.
    return pairs.groupBy(b.parent).agg(
        F.array_join(F.array_sort(F.collect_set(b.name)), ", ").alias(b.out))


def professor_directory(professors: DataFrame, users: DataFrame, bridges: list[Bridge],
                        pid: str = "id_profesor") -> DataFrame:
    """Each professor with user name and e-mail and, per bridge, the
    distinct linked names as one text ('' when none).

    The reference left-joins all bridges at once and groups afterwards,
    which multiplies the bridges' rows per professor; aggregating each
    bridge first gives the same text without that product."""
    base = professors.select(pid, "id_usuario").join(
        users.select("id_usuario", "nombre", "correo"), "id_usuario", "left")
    out = base.select(F.col(pid), "nombre", "correo")
    for b in bridges:
        out = out.join(_names_per_parent(b), pid, "left")
    cols = [F.col(pid).alias("id"), "nombre", "correo"] + [F.coalesce(F.col(b.out), F.lit("")).alias(b.out) for b in bridges]
    return out.select(*cols).orderBy(F.col("id").asc_nulls_last())


def professor_detail(professors: DataFrame, users: DataFrame, bridges: list[Bridge], id_value=None,
                     pid: str = "id_profesor") -> DataFrame:
    """Professor with name, e-mail, user id and, per bridge, the sorted
    array of linked ids (empty array when none)."""
    p = professors.select(pid, "id_usuario")
    if id_value is not None:
        p = p.where(F.col(pid) == F.lit(id_value))
    out = p.join(users.select("id_usuario", "nombre", "correo"), "id_usuario", "left")
    for b in bridges:
        links = b.links.select(b.parent, b.key)
        if id_value is not None:
            links = links.where(F.col(b.parent) == F.lit(id_value))
        ids = links.where(F.col(b.key).isNotNull()).groupBy(b.parent).agg(
            F.array_sort(F.collect_set(b.key)).alias(b.out))
        out = out.join(ids, pid, "left")
    cols = [F.col(pid).alias("id"), "nombre", "correo", "id_usuario"]
    for b in bridges:
        empty = F.array().cast(f"array<{dict(b.links.dtypes)[b.key]}>")
        cols.append(F.coalesce(F.col(b.out), empty).alias(b.out))
    return out.select(*cols)


def attendance_detail(att: DataFrame, professors: DataFrame, users: DataFrame, departments: DataFrame,
                      degrees: DataFrame, subjects: DataFrame, classrooms: DataFrame, how: str = "inner",
                      department=None, degree=None, date=None) -> DataFrame:
    """Attendance rows with professor, department, degree, subject and
    classroom names.  ``how="inner"`` is the listing (newest first, NULL
    first); ``how="left"`` keeps every attendance row (by id).  The
    optional filters are applied to attendance before any join.

    Professors get their names first, dimension to dimension, so the fact
    meets one named table and has no join on a user id that is NULL for
    every row without a professor."""
    a = att.where(attendance_filter(department, degree, date))
    prof = professors.select("id_profesor", F.col("id_usuario").alias("_u"))
    usr = users.select(F.col("id_usuario").alias("_u"), F.col("nombre").alias("profesor"))
    named = prof.join(usr, "_u", how).select("id_profesor", "profesor")
    j = (a.join(named, "id_profesor", how)
         .join(departments.select("id_departamento", F.col("nombre").alias("departamento")), "id_departamento", how)
         .join(degrees.select("id_carrera", F.col("nombre").alias("carrera")), "id_carrera", how)
         .join(subjects.select("id_asignatura", F.col("nombre").alias("asignatura")), "id_asignatura", how)
         .join(classrooms.select("id_aula", F.col("nombre").alias("aula")), "id_aula", how))
    out = j.select("id_asistencia", "profesor", "departamento", "carrera", "asignatura", "aula",
                   "fecha", "hora_entrada", "validacion", "codigo_qr")
    if how == "inner":
        return out.orderBy(C.desc_pg("fecha"), C.desc_pg("hora_entrada"))
    return out.orderBy(C.asc_pg("id_asistencia"))


def sensor_latest(sensors: DataFrame, types: DataFrame, rooms: DataFrame, readings: DataFrame) -> DataFrame:
    """Sensors with type and classroom name (inner joins) and their newest
    reading (date DESC, time DESC with NULL first; none -> NULLs).

    The newest reading per sensor is a max-aggregation of a struct with a
    partial step, so a sensor with a huge history is reduced map-side."""
    latest = readings.groupBy("id_sensor").agg(F.max(F.struct(
        C.newest_first_key("fecha", "hora").alias("k"), F.col("valor"), F.col("fecha"), F.col("hora"))).alias("_r"))
    latest = latest.select("id_sensor", F.col("_r.valor").alias("valor"),
                           F.col("_r.fecha").alias("fecha"), F.col("_r.hora").alias("hora"))
    s = (sensors.select("id_sensor", "id_tipo", "id_aula", "ubicacion")
         .join(types.select("id_tipo", F.col("nombre").alias("tipo")), "id_tipo", "inner")
         .join(rooms.select("id_aula", F.col("nombre").alias("aula")), "id_aula", "inner"))
    return (s.join(latest, "id_sensor", "left")
            .select("id_sensor", "tipo", "aula", "ubicacion", "valor", "fecha", "hora")
            .orderBy(F.col("id_sensor").asc_nulls_last()))


def key_set(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-NULL keys (partial aggregation before the shuffle)."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def tracked_rows(rows: DataFrame, key: str, *key_sets: DataFrame) -> DataFrame:
    """Rows whose ``key`` is in every given key set (nested ``IN``)."""
    out = rows
    for ks in key_sets:
        out = out.join(key_set(ks, key), key, "left_semi")
    return out


def passengers_by_route(routes: DataFrame, stops: DataFrame, passengers: DataFrame, buses: DataFrame,
                        positions: DataFrame) -> DataFrame:
    """The reference's count per route **name** of
    ``routes LEFT JOIN stops LEFT JOIN passengers ON <bus is tracked>``.

    The passenger condition mentions neither route nor stop, so that
    query equals, per name, (sum over its routes of max(stops, 1)) times
    the number of tracked passengers with a non-NULL id.  Computed in that
    factored form: no product of stops and passengers is built."""
    per_route = stops.groupBy("id_ruta").agg(F.count(F.lit(1)).alias("_k"))
    rows = (routes.select("id_ruta", "nombre").join(per_route, "id_ruta", "left")
            .groupBy(F.col("nombre").alias("ruta"))
            .agg(F.sum(F.greatest(F.coalesce(F.col("_k"), F.lit(0)), F.lit(1))).alias("_rows")))
    tracked = tracked_rows(passengers, "id_bus", buses, positions).agg(
        F.count(F.col("id_pasajero")).alias("_p"))
    # one number, evaluated once as a scalar subquery
    return rows.select("ruta", (F.col("_rows") * tracked.scalar()).cast("long").alias("pasajeros"))


_DAY_US = 86_400_000_000


def micros(c: str) -> Column:
    """Microseconds since 1970 on the wall clock; exact, and independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c))


def code_intervals(codes: DataFrame, room: str = "id_aula", code_id: str = "id_qr", valid_from: str = "fecha_generacion",
                   valid_to: str = "valido_hasta", width: int = 7 * _DAY_US) -> DataFrame:
    """Each room's time line cut into disjoint intervals with one code in force:
    ``_room``, ``_slice``, ``_start`` and ``_end`` (microseconds, inclusive) and
    ``_code`` (a struct of the code's columns).  The newest code (greatest start,
    then greatest id) whose window holds a time is in force.

    The time line is sliced every ``width`` microseconds first.  A code's window
    is clipped to each slice that it touches, and each (room, slice) is cut
    alone, so a room with very many codes is spread over its slices; an interval
    that goes on in the next slice is one piece in each.  In a slice codes are
    read in order of their start, so the codes still valid form a stack with the
    newest on top; a task holds the stack of one slice at a time.  At most two
    pieces come out for each code and slice."""
    kept = codes.select(F.col(room).alias("_room"), micros(valid_from).alias("_from"), micros(valid_to).alias("_to"),
                        F.col(code_id).alias("_id"), F.struct(*codes.columns).alias("_code"))
    kept = kept.where("_room IS NOT NULL AND _from <= _to").withColumn(
        "_slice", F.explode(F.sequence(_slice(F.col("_from"), width), _slice(F.col("_to"), width))))
    low = F.col("_slice") * F.lit(width)
    kept = kept.withColumns({"_start": F.greatest("_from", low), "_end": F.least("_to", low + F.lit(width - 1))})
    schema = kept.select("_room", "_slice", "_start", "_end", "_code").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack, at = None, [], 0
        for batch in batches:
            out: list[tuple] = []

            def run_until(limit: float) -> None:
                """Close what is in force before ``limit``."""
                nonlocal at
                while stack and at < limit:
                    _, end, code = stack[-1]
                    if end >= at:
                        out.append((*now, at, min(end, limit - 1), code))
                    if end >= limit:
                        break
                    at = max(at, end + 1)
                    stack.pop()

            rooms, slices, starts, ends = (batch.column(i).to_pylist() for i in range(4))
            for r, start, end, code in zip(zip(rooms, slices), starts, ends, batch.column(4), strict=True):
                if r != now:
                    run_until(_NEVER)
                    now, stack, at = r, [], start
                run_until(start)
                stack.append((start, end, code))
                at = start
            if out:
                yield _interval_batch(out, batch.schema)
        if stack:
            out = []
            run_until(_NEVER)
            yield _interval_batch(out, batch.schema)

    order = "_room", "_slice", "_from", F.col("_id").asc_nulls_first(), "_code"
    return (kept.repartition("_room", "_slice").sortWithinPartitions(*order)
            .select("_room", "_slice", "_start", "_end", "_code").mapInArrow(cut, schema))


def _slice(c: Column, width: int) -> Column:
    return F.floor(c / F.lit(width)).cast("long")


_NEVER = 1 << 62


def _interval_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], schema.field(i).type) for i in range(4)]
    columns.append(pa.array([r[4].as_py() for r in rows], schema.field(4).type))
    return pa.RecordBatch.from_arrays(columns, schema.names)


def validate_attendance(scans: DataFrame, codes: DataFrame, room: str = "id_aula", time: str = "hora_scan",
                        code: str = "codigo_qr", code_id: str = "id_qr", code_text: str = "codigo_qr",
                        valid_from: str = "fecha_generacion", valid_to: str = "valido_hasta",
                        subject: str = "id_asignatura", bucket_days: int = 7) -> DataFrame:
    """A verdict for every scan, one row each (equal scans too): among the
    room's codes whose window [from, to] contains the scan time (ends
    inclusive), take the newest (greatest ``from``, then greatest id); the
    scan is valid iff that code's text equals the scanned text.  No code ->
    invalid.  The code's id, text and (if the codes have it) subject are
    returned as ``id_qr_vigente``, ``codigo_vigente`` and ``asignatura_vigente``.

    Plan: the codes alone are cut into disjoint pieces with one code in force,
    each within one time slice of ``bucket_days`` (``code_intervals``).  So a
    scan meets one piece at most: one join on (room, slice) with the piece as a
    condition, whose output is a row per scan, with no regrouping.  When both
    sides are shuffled, AQE can split a (room, slice) that holds a large share
    of the scans."""
    return validate_in(scans, code_intervals(codes, room, code_id, valid_from, valid_to, bucket_days * _DAY_US), room, time,
                       code, code_id, code_text, subject, bucket_days)


def validate_in(scans: DataFrame, pieces: DataFrame, room: str = "id_aula", time: str = "hora_scan", code: str = "codigo_qr",
                code_id: str = "id_qr", code_text: str = "codigo_qr", subject: str = "id_asignatura",
                bucket_days: int = 7) -> DataFrame:
    """``validate_attendance`` with codes that ``code_intervals`` has cut before, in slices of ``bucket_days``."""
    s = scans.withColumn("_at", micros(time)).withColumn("_sb", _slice(F.col("_at"), bucket_days * _DAY_US))
    j = s.join(pieces, (F.col(room) == F.col("_room")) & (F.col("_sb") == F.col("_slice"))
               & F.col("_at").between(F.col("_start"), F.col("_end")), "left")
    found = [F.col("_code")[code_id].alias("id_qr_vigente"), F.col("_code")[code_text].alias("codigo_vigente")]
    if subject in pieces.schema["_code"].dataType.names:
        found.append(F.col("_code")[subject].alias("asignatura_vigente"))
    return j.select(*scans.columns, *found,
                    F.coalesce(F.col("_code")[code_text] == F.col(code), F.lit(False)).alias("valida"))


def record_attendance(scans: DataFrame, codes: DataFrame, attendance: DataFrame, professor: str = "id_profesor",
                      room: str = "id_aula", time: str = "hora_scan", code: str = "codigo_qr",
                      state: str = "estado") -> DataFrame:
    """The attendance rows that valid scans store, as the reference inserts
    them: department and degree of an earlier row of the professor (the
    smallest, for a repeatable result), the subject and id of the code in
    force, date and time of the scan, and the scan's state (true if the
    scans have none).  Invalid scans store nothing."""
    ok = validate_attendance(scans, codes, room, time, code).where("valida")
    earlier = attendance.where(F.col(professor).isNotNull()).groupBy(professor).agg(
        F.min("id_departamento").alias("id_departamento"), F.min("id_carrera").alias("id_carrera"))
    return ok.join(earlier, professor, "left").select(
        professor, "id_departamento", "id_carrera", F.col("asignatura_vigente").alias("id_asignatura"), room,
        F.to_date(time).alias("fecha"), F.col(time).alias("hora_entrada"),
        (F.col(state) if state in scans.columns else F.lit(True)).alias("validacion"),
        F.col(code).alias("codigo_qr"), F.col("id_qr_vigente").alias("id_qr"))


def lookup_value(df: DataFrame, dim: DataFrame, on: str, value: str, out: str | None = None) -> DataFrame:
    """Add ``value`` looked up in ``dim`` by ``on``.  The reference's
    scalar subquery takes an arbitrary first row (``LIMIT 1``); here the
    smallest value per key, so the result is repeatable.  ``dim`` is
    reduced to one row per key before the left join."""
    one = dim.where(F.col(on).isNotNull()).groupBy(on).agg(F.min(value).alias(out or value))
    return df.join(one, on, "left")


def walk_eta(points: DataFrame, buildings: DataFrame, dest: str = "destino", name: str = "nombre",
             lat: str = "lat", lng: str = "lng", b_lat: str = "lat", b_lng: str = "lng",
             b_id: str = "id_edificio", kmh: float = 5.0) -> DataFrame:
    """Great-circle distance (km, 2 decimals) and walking minutes at
    ``kmh`` (0 decimals) from each point to the building named in
    ``dest`` (case-insensitive).  Like the page's ``find``, the first
    building (smallest id) wins when several share a name."""
    b = (buildings.groupBy(F.lower(F.col(name)).alias("_name"))
         .agg(F.min(F.struct(F.col(b_id), F.col(b_lat).alias("_blat"), F.col(b_lng).alias("_blng"))).alias("_b"))
         .select("_name", F.col(f"_b.{b_id}").alias("_bid"), "_b._blat", "_b._blng"))
    j = points.join(b, F.lower(F.col(dest)) == F.col("_name"), "inner")
    d = C.haversine_km(F.col(lat), F.col(lng), F.col("_blat"), F.col("_blng"))
    return (j.withColumn("_d", d)
            .select(*points.columns, F.col("_bid").alias("id_edificio_destino"),
                    F.round(F.col("_d"), 2).alias("distancia_km"),
                    F.round(F.col("_d") / F.lit(kmh) * 60, 0).alias("minutos")))


def outer_missing(child: DataFrame, parent: DataFrame, on: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose key has no parent (``NOT EXISTS``)."""
    pk = parent_key or on
    keys = parent.select(F.col(pk).alias(on)).where(F.col(on).isNotNull()).distinct()
    return child.join(keys, on, "left_anti")

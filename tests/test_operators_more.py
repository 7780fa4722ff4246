"""More edge cases: NULL groups, empty parameters, missing partners."""

import datetime as dt
from decimal import Decimal

from campuslens.operators import aggregates as A
from campuslens.operators import filters as FL
from campuslens.operators import joins as J
from campuslens.sources import io


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_count_by_key_null_is_a_group_and_ties_by_key(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,), ("a",), ("b",)], "accion string")
    got = [(r.accion, r.total) for r in A.count_by_key(df, "accion").collect()]
    assert got == [("a", 2), ("b", 2), (None, 2)]


def test_top_users_labels_null_user(spark):
    df = spark.createDataFrame([(None,), (None,), (3,)], "id_usuario long")
    got = [(r.usuario, r.total) for r in A.top_users(df).collect()]
    assert got == [("Usuario null", 2), ("Usuario 3", 1)]


def test_filter_activity_empty_parameters_mean_no_filter(spark):
    df = spark.createDataFrame([(1, "Radio", ts("2024-01-01 10:00:00")), (2, "Mapa", None)],
                               "id_usuario long, modulo string, fecha_hora timestamp_ntz")
    assert FL.filter_activity(df, user="", module="", start="", end="").count() == 2
    first = FL.filter_activity(df).first()
    assert first.fecha_hora is None                      # DESC puts NULL first, as PostgreSQL
    assert [r.id_usuario for r in FL.filter_activity(df, module="r_dio").collect()] == [1]   # _ is a wildcard


def test_valid_at_latest_per_room(spark):
    df = spark.createDataFrame([
        (1, 5, ts("2024-01-01 00:00:00"), ts("2024-01-08 00:00:00")),
        (2, 5, ts("2024-01-03 00:00:00"), ts("2024-01-10 00:00:00")),
        (3, 5, ts("2024-01-03 00:00:00"), ts("2024-01-10 00:00:00")),   # tie on start: greater id
        (4, 6, ts("2024-01-09 00:00:00"), ts("2024-01-16 00:00:00")),   # not yet valid
    ], "id_qr long, id_aula long, desde timestamp_ntz, hasta timestamp_ntz")
    got = {r.id_aula: r.id_qr for r in FL.valid_at(df, "desde", "hasta", "2024-01-05 00:00:00", "id_aula").collect()}
    assert got == {5: 3}
    assert FL.valid_at(df, "desde", "hasta", "2024-01-08 00:00:00").count() == 3      # ends inclusive


def test_joinable_classes_open_end_and_nulls(spark):
    df = spark.createDataFrame([
        (1, ts("2024-01-01 00:00:00"), None, "EN_CURSO"),
        (2, ts("2024-01-01 00:00:00"), ts("2024-01-02 00:00:00"), "EN_CURSO"),
        (3, None, None, "EN_CURSO"),
        (4, ts("2024-01-01 00:00:00"), None, "PROGRAMADA"),
    ], "id long, fecha_inicio timestamp_ntz, fecha_fin timestamp_ntz, estado string")
    got = {r.id: r.se_puede_unir for r in FL.joinable_classes(df, "2024-01-05 00:00:00").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_sensor_latest_without_readings_and_null_date(spark):
    sensors = spark.createDataFrame([(1, 10, 1, "n"), (2, 10, 1, "s"), (3, 10, 9, "x")],
                                    "id_sensor long, id_aula long, id_tipo long, ubicacion string")
    types = spark.createDataFrame([(1, "CO2")], "id_tipo long, nombre string")
    rooms = spark.createDataFrame([(10, "A-1")], "id_aula long, nombre string")
    readings = spark.createDataFrame([
        (1, Decimal(400), dt.date(2024, 1, 2), 100),
        (1, Decimal(401), dt.date(2024, 1, 2), 200),
        (1, Decimal(999), None, 50),                      # NULL date sorts first under DESC
    ], "id_sensor long, valor decimal(18,4), fecha date, hora int")
    got = {r.id_sensor: (r.tipo, r.valor, r.fecha) for r in J.sensor_latest(sensors, types, rooms, readings).collect()}
    assert got == {1: ("CO2", Decimal("999.0000"), None), 2: ("CO2", None, None)}   # sensor 3 has no type


def test_attendance_kpis_null_in_neither(spark):
    att = spark.createDataFrame([(dt.date(2024, 1, 5), True), (dt.date(2024, 1, 5), None),
                                 (dt.date(2024, 1, 5), False), (dt.date(2024, 1, 6), True)],
                                "fecha date, validacion boolean")
    prof = spark.createDataFrame([(1,), (2,)], "id_profesor long")
    r = A.attendance_kpis(att, prof, "2024-01-05").first()
    assert (r.asistencias_hoy, r.no_validadas, r.total_profesores) == (1, 1, 2)


def test_radio_kpis_counts_programs_without_listeners(spark):
    listeners = spark.createDataFrame([("A", 3), ("B", 3)], "programa string, oyentes long")
    programs = spark.createDataFrame([(2, "A"), (1, "B"), (3, "C"), (4, "D")], "id long, titulo_programa string")
    r = A.radio_kpis(listeners, programs).first()
    assert (r.total_oyentes, r.promedio_oyentes, r.top_programa) == (6, 1.5, "B")   # tie: smallest id
    empty = A.radio_kpis(listeners.limit(0), programs.limit(0)).first()
    assert (empty.total_oyentes, empty.promedio_oyentes, empty.top_programa) == (0, 0.0, "-")


def test_transport_daily_counts_alerts_of_that_day_only(spark):
    buses = spark.createDataFrame([(1, 40, "EN SERVICIO"), (2, 20, "FUERA DE SERVICIO"), (3, 30, "otro")],
                                  "id_bus long, capacidad long, estado string")
    routes = spark.createDataFrame([(1, "Sur", 100, 400), (2, "Norte", 0, 100)],
                                   "id_ruta long, nombre string, hora_inicio int, hora_fin int")
    alerts = spark.createDataFrame([(1, ts("2024-01-15 08:00:00")), (2, ts("2024-01-16 00:00:00"))],
                                   "id_bus long, timestamp timestamp_ntz")
    r = A.transport_daily(buses, routes, alerts, "2024-01-15").first()
    assert (r.capacidad, r.buses_en_servicio, r.buses_fuera_servicio, r.rutas_activas, r.alertas_hoy,
            r.ocupacion_promedio, r.tiempo_promedio_llegada, r.ruta) == (90, 1, 1, 2, 1, 30.0, 200.0, "Norte")


def test_environment_by_day_parameter_filter(spark):
    readings = spark.createDataFrame([(1, Decimal(20), dt.date(2024, 1, 1)), (1, Decimal(22), dt.date(2024, 1, 1)),
                                      (2, Decimal(50), dt.date(2024, 1, 1))], "id_sensor long, valor decimal(18,4), fecha date")
    sensors = spark.createDataFrame([(1, 1), (2, 2)], "id_sensor long, id_tipo long")
    types = spark.createDataFrame([(1, "temperatura"), (2, "humedad")], "id_tipo long, nombre string")
    cols = {"temperatura": "temperatura", "humedad": "humedad"}
    r = A.environment_by_day(readings, sensors, types, cols).first()
    assert (r.temperatura, r.humedad) == (21.0, 50.0)
    only = A.environment_by_day(readings, sensors, types, cols, parameter="humedad")
    assert only.columns == ["fecha", "humedad"]


def test_tracked_rows_and_lookup_value(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id long, id_bus long")
    a = spark.createDataFrame([(10,), (20,), (None,)], "id_bus long")
    b = spark.createDataFrame([(10,)], "id_bus long")
    assert [r.id for r in J.tracked_rows(rows, "id_bus", a, b).collect()] == [1]
    dim = spark.createDataFrame([(10, 7), (10, 3), (None, 1)], "id_bus long, v long")
    got = {r.id: r.v for r in J.lookup_value(rows, dim, "id_bus", "v").collect()}
    assert got == {1: 3, 2: None, 3: None}


def test_list_sorted_and_chart_series(spark):
    df = spark.createDataFrame([(2, "b", 1.0), (1, "a", 2.0), (None, "c", 3.0)], "id long, n string, v double")
    assert [r.id for r in io.list_sorted(df, {"id": "id", "n": "nombre"}, ["id"]).collect()] == [1, 2, None]
    assert [tuple(r) for r in io.chart_series(df, "n", "v").collect()] == [("a", 2.0), ("b", 1.0), ("c", 3.0)]


def test_default_nulls_only_replaces_null(spark):
    df = spark.createDataFrame([(None, 0), (5, None)], "a long, b long")
    got = [tuple(r) for r in FL.default_nulls(df, {"a": -1, "b": 9}).collect()]
    assert got == [(-1, 0), (5, 9)]


def test_split_timestamp_end_of_day(spark):
    df = spark.createDataFrame([(ts("2024-01-01 23:59:59.999999"),)], "t timestamp_ntz")
    r = FL.split_timestamp(df, "t").first()
    assert (r.fecha, r.hora) == (dt.date(2024, 1, 1), 86399)


def test_update_keep_blank_reduces_repeated_changes(spark):
    from campuslens.operators import changes as CH
    base = spark.createDataFrame([(1, "Ana", "h1")], "id long, nombre string, pw string")
    ch = spark.createDataFrame([(1, "A1", "", 1), (1, "A2", None, 2)], "id long, nombre string, pw string, seq long")
    got = [tuple(r) for r in CH.update_keep_blank(base, ch, "id", ["nombre", "pw"], ["pw"], seq="seq").collect()]
    assert got == [(1, "A2", "h1")]
    ch2 = spark.createDataFrame([(1, "A1", "new", 1), (1, "A2", " ", 2)], "id long, nombre string, pw string, seq long")
    got = [tuple(r) for r in CH.update_keep_blank(base, ch2, "id", ["nombre", "pw"], ["pw"], seq="seq").collect()]
    assert got == [(1, "A2", "new")]
    got2 = CH.update_keep_blank(base, ch.drop("seq"), "id", ["nombre", "pw"], ["pw"]).collect()
    assert len(got2) == 1


def test_chart_series_orders_by_value_or_other_columns(spark):
    df = spark.createDataFrame([("a", 3.0, 2), ("b", 1.0, 1), ("c", 2.0, 3)], "n string, v double, k long")
    assert [r.label for r in io.chart_series(df, "n", "v", ["v"]).collect()] == ["b", "c", "a"]
    assert [r.label for r in io.chart_series(df, "n", "v", ["k"]).collect()] == ["b", "a", "c"]

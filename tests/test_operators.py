"""Operator tests on small hand-made frames: NULLs, ties, empty input and
the boundary values named in FIXTURES.md §5 (strict comparisons, so the
exact threshold never alerts)."""

import pytest
import datetime as dt
from decimal import Decimal


from campuslens.operators import aggregates as A
from campuslens.operators import changes as CH
from campuslens.operators import filters as FL
from campuslens.operators import joins as J
from campuslens.operators import quality as Q
from campuslens.operators import windows as W
from campuslens.sources import io


def ts(s):
    return dt.datetime.fromisoformat(s)


LISTEN_SCHEMA = "id long, id_programa long, usuario_id long, segundos_escuchados long, fecha timestamp_ntz"
PROGRAM_SCHEMA = "id long, titulo_programa string"


def seed_listens(spark):
    # seed rows of the reference's listening table, with fixed times
    return spark.createDataFrame([
        (1, 1, 10, 1800, ts("2026-07-10 10:05:00")),
        (2, 1, None, 600, ts("2026-07-10 10:10:00")),
        (3, 2, 12, 2700, ts("2026-07-11 18:00:00")),
        (4, 3, 15, 900, ts("2026-07-12 08:00:00")),
    ], LISTEN_SCHEMA)


def seed_programs(spark):
    return spark.createDataFrame([(1, "Voz Estudiantil"), (2, "Cultura Viva"), (3, "Noticias Campus")],
                                 PROGRAM_SCHEMA)


def test_seed_audience_and_listeners(spark):
    rep = {r.id_programa: (r.total_reproducciones, r.total_segundos)
           for r in A.audience(seed_listens(spark), "week").collect()}
    assert rep == {1: (2, 2400), 2: (1, 2700), 3: (1, 900)}
    lis = {r.programa: r.oyentes for r in A.radio_listeners(seed_listens(spark), seed_programs(spark)).collect()}
    assert lis == {"Voz Estudiantil": 1, "Cultura Viva": 1, "Noticias Campus": 1}


def test_radio_listeners_merges_titles(spark):
    progs = spark.createDataFrame([(1, "Same"), (2, "Same"), (3, "Other")], PROGRAM_SCHEMA)
    lis = {r.programa: r.oyentes for r in A.radio_listeners(seed_listens(spark), progs).collect()}
    assert lis == {"Same": 2, "Other": 1}


def test_semester_boundaries_and_null_time(spark):
    df = spark.createDataFrame([
        (1, 1, 1, 10, ts("2024-06-30 23:59:59")),
        (2, 1, 1, 10, ts("2024-07-01 00:00:00")),
        (3, 1, 1, 10, None),
    ], LISTEN_SCHEMA)
    got = sorted(r.semestre for r in A.audience(df, "semester").collect())
    assert got == ["-S2", "2024-S1", "2024-S2"]


def test_week_starts_monday(spark):
    df = spark.createDataFrame([
        (1, 1, 1, 10, ts("2024-01-07 23:00:00")),  # Sunday
        (2, 1, 1, 10, ts("2024-01-08 01:00:00")),  # Monday
    ], LISTEN_SCHEMA)
    weeks = sorted(r.semana for r in A.audience(df, "week").collect())
    assert weeks == [ts("2024-01-01 00:00:00"), ts("2024-01-08 00:00:00")]


ACT_SCHEMA = "id_usuario long, modulo string, duracion_segundos long, fecha_hora timestamp_ntz"


def test_footprint_kpis_window_and_empty(spark):
    as_of = "2024-01-15 12:00:00"
    df = spark.createDataFrame([
        (1, "Radio", 30, ts("2024-01-15 11:55:00")),   # exactly 5 min before: not connected (strict >)
        (2, "radio-live", 20, ts("2024-01-15 11:55:01")),
        (None, "Mapa", 5, ts("2024-01-15 11:59:00")),  # NULL user never counted
        (3, "Mapa", 1, ts("2024-01-15 12:00:01")),     # after as_of
    ], ACT_SCHEMA)
    r = A.footprint_kpis(df, as_of).collect()[0]
    assert (r.total_acciones, r.usuarios_activos, r.usuarios_conectados, r.tiempo_radio, r.modulo_top) == \
        (4, 3, 1, 50, "Mapa")
    empty = A.footprint_kpis(df.limit(0), as_of).collect()[0]
    assert (empty.total_acciones, empty.usuarios_activos, empty.tiempo_radio, empty.modulo_top) == (0, 0, 0, "-")


def test_wifi_severity_thresholds_are_strict(spark):
    df = spark.createDataFrame([
        (Decimal(100), Decimal(-80), Decimal(30)),
        (Decimal("100.01"), Decimal(-50), Decimal(0)),
        (Decimal(10), Decimal("-80.01"), Decimal(0)),
        (Decimal(10), Decimal(-50), Decimal("30.5")),
        (None, None, None),
    ], "latencia decimal(18,4), nivel_senal decimal(18,4), jitter decimal(18,4)")
    got = [r.severidad for r in FL.wifi_severity(df).collect()]
    assert got == ["", "high", "high", "medium", ""]


POS_SCHEMA = ("id_posicion long, id_bus long, id_ruta long, velocidad decimal(18,4), direccion string, "
              "fecha_hora timestamp_ntz")


def test_report_gaps_exact_fifteen_minutes_does_not_alert(spark):
    df = spark.createDataFrame([
        (1, 7, 1, Decimal(10), "a", ts("2024-01-01 10:00:00")),
        (2, 7, 1, Decimal(10), "a", ts("2024-01-01 10:15:00")),
        (3, 7, 1, Decimal(10), "a", ts("2024-01-01 10:30:00.000001")),
        (4, 8, 1, Decimal(10), "a", ts("2024-01-01 10:31:00")),
    ], POS_SCHEMA)
    per = {r.id_posicion: (r.minutos, r.alerta) for r in W.report_gaps(df, "id_bus", "fecha_hora", 15,
                                                                          id_col="id_posicion").collect()}
    assert per[1] == (None, False) and per[2] == (15.0, False) and per[3][1] is True and per[4] == (None, False)
    glob = {r.id_posicion: r.minutos for r in W.report_gaps(df, "id_bus", "fecha_hora", 15, id_col="id_posicion",
                                                            per_key=False).collect()}
    assert abs(glob[4] - 59.999999 / 60) < 1e-9


def test_fleet_alerts_boundaries(spark):
    df = spark.createDataFrame([
        (1, 1, 1, Decimal(60), "x", ts("2024-01-01 10:00:00")),      # exactly 60: no alert
        (2, 1, 1, Decimal("60.01"), "x", ts("2024-01-01 10:01:00")),
        (3, 1, 1, Decimal(0), "Av. Hassan II", ts("2024-01-01 10:02:00")),
        (4, 1, 1, None, "x", ts("2024-01-01 10:30:00")),             # gap 28 min
    ], POS_SCHEMA)
    got = sorted((r.id_posicion, r.tipo) for r in W.fleet_alerts(df).collect())
    assert got == [(2, "exceso_velocidad"), (3, "detenido"), (4, "sin_reporte")]


def test_latest_per_key_null_time_wins_like_postgres(spark):
    df = spark.createDataFrame([
        (1, 7, 1, Decimal(1), "a", ts("2024-01-01 10:00:00")),
        (2, 7, 1, Decimal(1), "a", None),
        (3, 8, 1, Decimal(1), "a", ts("2024-01-01 10:00:00")),
        (4, 8, 1, Decimal(1), "a", ts("2024-01-01 10:00:00")),  # tie: greater id wins
    ], POS_SCHEMA)
    got = {r.id_bus: r.id_posicion for r in W.latest_per_key(df, "id_bus", ["fecha_hora"]).collect()}
    assert got == {7: 2, 8: 4}
    last = {r.id_bus: r.id_posicion for r in W.latest_per_key(df, "id_bus", ["fecha_hora"], nulls="last").collect()}
    assert last[7] == 1


def test_global_row_number_with_hot_key(spark):
    # one key holds most rows; numbering must still be dense and ordered
    rows = [(i, 1 if i % 10 else 2, ts("2024-01-01 00:00:00") + dt.timedelta(seconds=i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id_visita long, usuario_id long, fecha_busqueda timestamp_ntz")
    out = W.running_visits(df, "fecha_busqueda", by="usuario_id", id_col="id_visita").collect()
    by_user = {}
    for r in sorted(out, key=lambda r: r.id_visita):
        by_user.setdefault(r.usuario_id, []).append(r.visita)
    for seq in by_user.values():
        assert seq == list(range(1, len(seq) + 1))
    glob = W.running_visits(df, "fecha_busqueda", id_col="id_visita").collect()
    assert sorted((r.id_visita, r.visita) for r in glob) == [(i, i + 1) for i in range(3000)]


def test_rank_medals_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 6), ("d", 5)], "lugar string, t long")
    got = [(r.lugar, r.posicion, r.medalla) for r in W.rank_medals(df, "lugar").orderBy("posicion").collect()]
    assert got == [("a", 1, "🥇"), ("b", 2, "🥈"), ("c", 3, "🥉"), ("d", 4, "")]
    # with the first-seen order, as the page's stable sort: b (t=1) before a (t=2), d (t=5) before c (t=6)
    got = [r.lugar for r in W.rank_medals(df, "lugar", first_seen="t").orderBy("posicion").collect()]
    assert got == ["b", "a", "d", "c"]


CODE_SCHEMA = "id_qr long, id_aula long, codigo_qr string, fecha_generacion timestamp_ntz, valido_hasta timestamp_ntz"
SCAN_SCHEMA = "id_profesor long, id_aula long, codigo_qr string, hora_scan timestamp_ntz"


def test_validate_attendance_windows_and_newest_code(spark):
    codes = spark.createDataFrame([
        (1, 5, "OLD", ts("2024-01-01 00:00:00"), ts("2024-01-08 00:00:00")),
        (2, 5, "NEW", ts("2024-01-05 00:00:00"), ts("2024-01-12 00:00:00")),  # overlaps: newest wins
        (3, 6, "R6", ts("2024-01-01 00:00:00"), ts("2024-01-08 00:00:00")),
    ], CODE_SCHEMA)
    scans = spark.createDataFrame([
        (1, 6, "R6", ts("2024-01-01 00:00:00")),   # exactly at start: valid
        (2, 6, "R6", ts("2024-01-08 00:00:00")),   # exactly at end: valid
        (3, 6, "R6", ts("2024-01-08 00:00:01")),   # after: invalid
        (4, 5, "OLD", ts("2024-01-06 00:00:00")),  # newer code in force: invalid
        (5, 5, "NEW", ts("2024-01-06 00:00:00")),
        (5, 5, "NEW", ts("2024-01-06 00:00:00")),  # an equal scan gets a verdict of its own
        (6, 9, "X", ts("2024-01-06 00:00:00")),    # room without codes
        (7, 5, None, ts("2024-01-06 00:00:00")),
    ], SCAN_SCHEMA)
    got = sorted((r.id_profesor, r.valida) for r in J.validate_attendance(scans, codes).collect())
    assert got == [(1, True), (2, True), (3, False), (4, False), (5, True), (5, True), (6, False), (7, False)]


def test_record_attendance_stores_the_reference_row(spark):
    codes = spark.createDataFrame([(8, 5, 33, "A", ts("2024-01-01 00:00:00"), ts("2024-01-08 00:00:00"))],
                                  "id_qr long, id_aula long, id_asignatura long, codigo_qr string, "
                                  "fecha_generacion timestamp_ntz, valido_hasta timestamp_ntz")
    scans = spark.createDataFrame([(1, 5, "A", ts("2024-01-02 09:30:00")), (2, 5, "A", ts("2024-01-02 10:00:00")),
                                   (1, 5, "B", ts("2024-01-02 11:00:00"))], SCAN_SCHEMA)
    before = spark.createDataFrame([(1, 4, 7), (1, 3, 9)], "id_profesor long, id_departamento long, id_carrera long")
    got = sorted(tuple(r) for r in J.record_attendance(scans, codes, before).collect())
    day = dt.date(2024, 1, 2)
    assert got == [(1, 3, 7, 33, 5, day, ts("2024-01-02 09:30:00"), True, "A", 8),
                   (2, None, None, 33, 5, day, ts("2024-01-02 10:00:00"), True, "A", 8)]


def test_professor_directory_no_links_and_distinct_names(spark):
    prof = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id_profesor long, id_usuario long")
    users = spark.createDataFrame([(10, "Ana", "a@x"), (20, "Luis", "l@x")], "id_usuario long, nombre string, correo string")
    links = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 9)], "id_profesor long, id_departamento long")
    dim = spark.createDataFrame([(1, "Fisica"), (2, "Arte"), (3, "Fisica")], "id_departamento long, nombre string")
    out = {r.id: (r.nombre, r.departamentos) for r in
           J.professor_directory(prof, users, [J.Bridge(links, dim, "id_departamento", out="departamentos")]).collect()}
    assert out == {1: ("Ana", "Arte, Fisica"), 2: ("Luis", ""), 3: (None, "")}
    det = {r.id: list(r.departamentos_ids) for r in
           J.professor_detail(prof, users, [J.Bridge(links, dim, "id_departamento", out="departamentos_ids")]).collect()}
    assert det == {1: [1, 2, 3], 2: [9], 3: []}


def test_passengers_by_route_factored_form(spark):
    routes = spark.createDataFrame([(1, "Norte"), (2, "Sur"), (3, "Norte"), (4, "Vacia")], "id_ruta long, nombre string")
    stops = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id_parada long, id_ruta long")
    pax = spark.createDataFrame([(1, 100), (2, 100), (3, 200), (None, 100)], "id_pasajero long, id_bus long")
    buses = spark.createDataFrame([(100,), (200,)], "id_bus long")
    pos = spark.createDataFrame([(100,), (None,)], "id_bus long")
    got = {r.ruta: r.pasajeros for r in J.passengers_by_route(routes, stops, pax, buses, pos).collect()}
    # Norte: (2 stops + route 3 with none -> 1) x 2 tracked non-null passengers
    assert got == {"Norte": 6, "Sur": 2, "Vacia": 2}


def test_apply_changes_in_order(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    ch = spark.createDataFrame([
        (1, 1, "U", "a1"), (1, 2, "U", "a2"),      # last update wins
        (2, 1, "D", None),
        (4, 1, "I", "d"),
        (5, 1, "U", "ghost"),                      # update of a missing key: nothing
        (3, 1, "D", None), (3, 2, "I", "c2"),      # delete then insert
        (6, 1, "I", "e"), (6, 2, "U", "e2"),       # insert then update: the row is there
        (2, 2, "U", "b2"),                         # delete then update: nothing comes back
    ], "k long, seq long, op string, v string")
    got = sorted((r.k, r.v) for r in CH.apply_changes(base, ch, "k").collect())
    assert got == [(1, "a2"), (3, "c2"), (4, "d"), (6, "e2")]


def test_update_keep_blank(spark):
    base = spark.createDataFrame([(1, "Ana", "h1"), (2, "Luis", "h2"), (3, "Eva", "h3")], "id long, nombre string, pw string")
    ch = spark.createDataFrame([(1, "Ana B", "  "), (2, None, None), (9, "x", "y")], "id long, nombre string, pw string")
    got = sorted(tuple(r) for r in CH.update_keep_blank(base, ch, "id", ["nombre", "pw"], ["pw"]).collect())
    assert got == [(1, "Ana B", "h1"), (2, None, "h2"), (3, "Eva", "h3")]


def test_insert_ignore_first_duplicate(spark):
    base = spark.createDataFrame([("a@x", "A")], "correo string, nombre string")
    new = spark.createDataFrame([("a@x", "A2", 1), ("b@x", "B2", 2), ("b@x", "B1", 1)], "correo string, nombre string, seq long")
    got = sorted(tuple(r) for r in CH.insert_ignore(base, new, "correo", seq="seq").collect())
    assert got == [("a@x", "A"), ("b@x", "B1")]


def test_insert_ignore_keeps_null_keys(spark):
    base = spark.createDataFrame([("a@x", "A"), (None, "N0")], "correo string, nombre string")
    new = spark.createDataFrame([(None, "N1", 1), (None, "N2", 2), ("a@x", "A2", 3)], "correo string, nombre string, seq long")
    got = sorted((r.nombre for r in CH.insert_ignore(base, new, "correo", seq="seq").collect()))
    assert got == ["A", "N0", "N1", "N2"]


def test_replace_links_with_empty_set(spark):
    bridge = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "id_profesor long, id_departamento long")
    new = spark.createDataFrame([(1, 3)], "id_profesor long, id_departamento long")
    touched = spark.createDataFrame([(2,)], "id_profesor long")
    got = sorted(tuple(r) for r in CH.replace_links(bridge, new, "id_profesor", touched).collect())
    assert got == [(1, 3)]


def test_assign_ids_after_max(spark):
    df = spark.createDataFrame([("c",), ("a",), ("b",)], "n string")
    existing = spark.createDataFrame([(41,), (7,)], "id long")
    got = sorted((r.n, r.id) for r in CH.assign_ids(df, ["n"], start_after=existing).collect())
    assert got == [("a", 42), ("b", 43), ("c", 44)]


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, "x", "admin"), (1, "y", None), (None, "z", "root"), (2, None, "profesor")],
                               "id long, n string, rol string")
    assert [r.id for r in Q.unique_violations(df, ["id"]).collect()] == [1]
    nn = {r.columna: r.nulos for r in Q.not_null_violations(df, ["id", "n"]).collect()}
    assert nn == {"id": 1, "n": 1}
    assert [r.rol for r in Q.check_violations(df, "rol", ["admin", "profesor", "estudiante"]).collect()] == ["root"]
    parent = spark.createDataFrame([(1,)], "id long")
    assert sorted(r.id for r in Q.fk_orphans(df, parent, "id").collect()) == [2]


def test_parse_coordinates_hemispheres(spark):
    df = spark.createDataFrame([("3.7166214N, 8.6740411E",), ("1.5S, 2.25W",), ("junk",)], "c string")
    got = [(r.lat, r.lng) for r in FL.parse_coordinates(df, "c").collect()]
    assert got == [(3.7166214, 8.6740411), (-1.5, -2.25), (None, None)]


def test_guest_list_and_autocomplete(spark):
    df = spark.createDataFrame([(" ana , luis,eva",), ("",), (None,), ("  ",)], "g string")
    got = [list(r.g) for r in FL.guest_list(df, "g").collect()]
    assert got == [["ana", "luis", "eva"], [], [], [""]]
    names = spark.createDataFrame([("Rectorado",), ("Biblioteca",)], "n string")
    assert FL.autocomplete(names, "n", "r").count() == 0
    assert [r.n for r in FL.autocomplete(names, "n", "BLIO").collect()] == ["Biblioteca"]


def test_walk_eta_known_distance(spark):
    pts = spark.createDataFrame([("Rectorado", 0.0, 0.0)], "destino string, lat double, lng double")
    b = spark.createDataFrame([(1, "RECTORADO", 0.0, 1.0), (2, "rectorado", 5.0, 5.0)],
                              "id_edificio long, nombre string, lat double, lng double")
    r = J.walk_eta(pts, b).collect()[0]
    assert r.id_edificio_destino == 1 and r.distancia_km == 111.2 and r.minutos == 1334.0


def test_transport_latest_empty_gives_zeros(spark):
    df = spark.createDataFrame([], "id_transporte long, fecha date, buses_en_servicio long, rutas_activas long, "
                                   "capacidad long, alertas_hoy long")
    r = A.transport_latest(df).collect()[0]
    assert tuple(r) == (0, 0, 0, 0)


def test_fleet_kpis_mean_counts_nulls_as_zero(spark):
    df = spark.createDataFrame([
        (1, 1, 1, Decimal(10), "a", ts("2024-01-01 10:00:00")),
        (2, 2, 1, None, "a", ts("2024-01-01 10:05:00")),
    ], POS_SCHEMA)
    r = A.fleet_kpis(df).collect()[0]
    assert (r.buses, r.recorridos, r.velocidad_media, r.ultima) == (2, 2, 5.0, ts("2024-01-01 10:05:00"))


def test_issue_weekly_codes_repeatable(spark):
    rooms = spark.createDataFrame([(1,), (2,), (2,)], "id_aula long")
    a = sorted(tuple(r) for r in CH.issue_weekly_codes(rooms, "2024-01-01", 2).collect())
    b = sorted(tuple(r) for r in CH.issue_weekly_codes(rooms, "2024-01-01", 2).collect())
    assert a == b and len(a) == 4
    assert a[0][4] - a[0][3] == dt.timedelta(days=7)


def test_cascade_delete(spark):
    region = spark.createDataFrame([(1,), (2,)], "r long")
    nation = spark.createDataFrame([(10, 1), (20, 2)], "n long, r long")
    cust = spark.createDataFrame([(100, 10), (200, 20)], "c long, n long")
    tables = {"region": region, "nation": nation, "customer": cust}
    fks = [("nation", "r", "region", "r"), ("customer", "n", "nation", "n")]
    out = CH.cascade_delete(tables, fks, "region", spark.createDataFrame([(1,)], "r long"))
    assert [r.c for r in out["customer"].collect()] == [200]
    assert [r.n for r in out["nation"].collect()] == [20]


def test_cascade_delete_keeps_other_links_of_a_two_column_key(spark):
    dept = spark.createDataFrame([(1,), (2,)], "d long")
    links = spark.createDataFrame([(10, 1), (10, 2), (11, 2), (12, None)], "p long, d long")
    out = CH.cascade_delete({"dept": dept, "links": links}, [("links", ["d"], "dept", ["d"])], "dept",
                            spark.createDataFrame([(1,)], "d long"))
    assert sorted(tuple(r) for r in out["links"].collect() if r.d) == [(10, 2), (11, 2)]
    assert out["links"].where("d IS NULL").count() == 1


def test_cascade_delete_through_two_ways_and_cycles(spark):
    a = spark.createDataFrame([(1,), (2,)], "a long")
    b = spark.createDataFrame([(1, 1), (2, 2)], "b long, a long")
    c = spark.createDataFrame([(1, 2, 1), (2, 1, 2), (3, 2, 2)], "c long, b long, a long")
    fks = [("c", "b", "b", "b"), ("c", "a", "a", "a"), ("b", "a", "a", "a")]
    out = CH.cascade_delete({"a": a, "b": b, "c": c}, fks, "a", spark.createDataFrame([(1,)], "a long"))
    assert [r.c for r in out["c"].collect()] == [3] and [r.b for r in out["b"].collect()] == [2]
    with pytest.raises(ValueError, match="cycle"):
        CH.cascade_delete({"a": a, "b": b}, [("a", "a", "b", "a"), ("b", "a", "a", "a")], "a",
                          spark.createDataFrame([(1,)], "a long"))


def test_mark_arrival_and_passenger_state(spark):
    foot = spark.createDataFrame([(1, 5, ts("2024-01-01 10:00:00")), (1, 6, ts("2024-01-01 11:00:00"))],
                                 "usuario_id long, edificio_id long, fecha_busqueda timestamp_ntz")
    arr = spark.createDataFrame([(1, 5, None)], "usuario_id long, edificio_id long, llegada timestamp_ntz")
    got = {r.edificio_id: (r.tiempo_llegada, r.mensaje_enviado)
           for r in CH.mark_arrival(foot, arr, "2024-01-02 00:00:00").collect()}
    assert got == {5: (ts("2024-01-02 00:00:00"), True), 6: (None, False)}
    early = spark.createDataFrame([(1, 6, ts("2024-01-01 10:59:59"))], "usuario_id long, edificio_id long, llegada timestamp_ntz")
    assert not [r for r in CH.mark_arrival(foot, early, "2024-01-02 00:00:00").collect() if r.mensaje_enviado]
    board = spark.createDataFrame([(1, 9), (2, 9)], "id_pasajero long, id_bus long")
    off = spark.createDataFrame([(2,)], "id_pasajero long")
    st = {r.id_pasajero: r.estado for r in CH.passenger_state(board, off).collect()}
    assert st == {1: "A BORDO", 2: "BAJADO"}


def test_attendance_by_day_oldest_as_written(spark):
    rows = [(dt.date(2024, 1, d), True) for d in range(1, 11)] + [(dt.date(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "fecha date, validacion boolean")
    got = [r.fecha.day for r in A.attendance_by_day(df).collect()]
    assert got == [1, 2, 3, 4, 5, 6, 7]
    assert [r.fecha.day for r in A.attendance_by_day(df, newest=True).collect()] == [10, 9, 8, 7, 6, 5, 4]


def test_browse_page_search_and_paging(spark):
    df = spark.createDataFrame([(i, f"name{i}") for i in range(30)], "id long, n string")
    page = [r.id for r in io.browse_page(df, search="NAME1", sort=[("id", True)], page=1, size=5).collect()]
    assert page == [14, 15, 16, 17, 18]

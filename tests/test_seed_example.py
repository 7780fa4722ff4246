"""Invented campus rows as a small end-to-end example.

The seed file inserts some department and degree names twice although
the schema declares them UNIQUE; the second insert is what
``insert_ignore`` resolves and what ``unique_violations`` reports.
"""

import datetime as dt

from campuslens.operators import changes as CH
from campuslens.operators import joins as J
from campuslens.operators import quality as Q

DEPTS = ["Química", "Letras", "Geología", "Marina"]
DEPTS_AGAIN = ["Química", "Letras", "Geología"]
DEGREES = ["Biología Marina", "Música", "Turismo", "Danza"]
DEGREES_AGAIN = ["Marina", "Turismo", "Danza"]
SUBJECTS = ["Matemáticas", "Física", "Historia"]


def rows(names, start=1):
    return [(start + i, n) for i, n in enumerate(names)]


def test_duplicate_seed_names_are_reported(spark):
    loaded = spark.createDataFrame(rows(DEPTS + DEPTS_AGAIN), "id_departamento long, nombre string")
    got = sorted((r.nombre, r.repeticiones) for r in Q.unique_violations(loaded, ["nombre"]).collect())
    assert got == [("Geología", 2), ("Letras", 2), ("Química", 2)]


def test_second_seed_load_with_insert_ignore(spark):
    base = spark.createDataFrame(rows(DEGREES), "id_carrera long, nombre string")
    again = spark.createDataFrame([(i, n, i) for i, n in rows(DEGREES_AGAIN, 5)], "id_carrera long, nombre string, seq long")
    out = CH.insert_ignore(base, again, "nombre", seq="seq")
    assert sorted(r.nombre for r in out.collect()) == sorted(DEGREES + ["Marina"])


def test_professor_directory_on_seed_links(spark):
    prof = spark.createDataFrame([(1, 11), (2, 12), (3, 13)], "id_profesor long, id_usuario long")
    users = spark.createDataFrame([(11, "Prof Uno", "p1@campus"), (12, "Prof Dos", "p2@campus")],
                                  "id_usuario long, nombre string, correo string")
    subjects = spark.createDataFrame(rows(SUBJECTS + ["Matemáticas", "Historia", "Física"]),
                                     "id_asignatura long, nombre string")
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "id_profesor long, id_asignatura long")
    out = {r.id: (r.nombre, r.asignaturas) for r in J.professor_directory(
        prof, users, [J.Bridge(links, subjects, "id_asignatura", out="asignaturas")]).collect()}
    assert out == {1: ("Prof Uno", "Física, Matemáticas"), 2: ("Prof Dos", "Historia"), 3: (None, "")}


def test_seed_qr_week_validates_scans(spark):
    # Aula 1's code is valid from 2026-07-28 to 2026-08-03 (dates, compared as midnight)
    codes = spark.createDataFrame(
        [(1, 1, "AULA1-SEMANA-2026-07-28", dt.datetime(2026, 7, 28), dt.datetime(2026, 8, 3))],
        "id_qr long, id_aula long, codigo_qr string, fecha_generacion timestamp_ntz, valido_hasta timestamp_ntz")
    scans = spark.createDataFrame([
        (1, 1, "AULA1-SEMANA-2026-07-28", dt.datetime(2026, 7, 30, 8, 0)),
        (1, 1, "AULA1-SEMANA-2026-07-28", dt.datetime(2026, 8, 3, 0, 0)),
        (1, 1, "AULA1-SEMANA-2026-07-28", dt.datetime(2026, 8, 3, 9, 0)),
        (1, 1, "OTRO", dt.datetime(2026, 7, 30, 8, 0)),
    ], "id_profesor long, id_aula long, codigo_qr string, hora_scan timestamp_ntz")
    got = sorted((r.hora_scan, r.codigo_qr, r.valida) for r in J.validate_attendance(scans, codes).collect())
    assert [v for _, _, v in got] == [True, False, True, False]

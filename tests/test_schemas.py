"""Declared rules on hand-made rows."""

import datetime as dt

import pytest

from campuslens import schemas as S


def test_row_rules_split_rows_and_say_why(spark):
    table = S.TABLES["accounts"]
    rows = [(1, 1, "ana", "x", "admin"), (2, None, None, "x", None), (3, 9, "u" * 51, "x", "dean"), (None, 1, "", "x", "profesor")]
    good, bad = S.split_rows(spark.createDataFrame(rows, table.struct()), table)
    assert [tuple(r) for r in good.collect()] == [rows[0]]
    assert {r.username: r.motivos for r in bad.collect()} == {
        None: ["not_null:username"], "u" * 51: ["length:username", "check:rol"], "": ["not_null:id_registro"]}


def test_report_counts_every_rule(spark):
    users = spark.createDataFrame([(1, "a", "m", None), (2, "b", "m", "f"), (2, None, None, "f")], S.TABLES["users"].struct())
    accounts = spark.createDataFrame([(1, 1, "a", "p", "admin"), (2, 7, "a", "p", "dean"), (2, 7, "b", "p", None), (3, None, None, None, None)],
                                     S.TABLES["accounts"].struct())
    got = {(r.tabla, r.regla, r.columnas): r.filas for r in S.constraint_report({"users": users, "accounts": accounts}).collect()}
    broken = {k: n for k, n in got.items() if n}
    assert broken == {("users", "not_null", "nombre"): 1, ("users", "not_null", "correo"): 1, ("users", "primary_key", "id_usuario"): 1,
                      ("users", "unique", "correo"): 1, ("accounts", "not_null", "username"): 1, ("accounts", "not_null", "password"): 1,
                      ("accounts", "check", "rol"): 1, ("accounts", "primary_key", "id_registro"): 1,
                      ("accounts", "unique", "username"): 1, ("accounts", "foreign_key", "id_usuario"): 2}


def test_empty_tables_absent_columns_and_parents(spark):
    links = spark.createDataFrame([], S.TABLES["prof_dept"].struct())
    got = S.constraint_report({"prof_dept": links, "users": spark.createDataFrame([(1,)], "id_usuario long")}).collect()
    assert {(r.tabla, r.regla, r.columnas, r.filas) for r in got} == {
        ("prof_dept", "not_null", "id_profesor", 0), ("prof_dept", "not_null", "id_departamento", 0),
        ("prof_dept", "primary_key", "id_profesor,id_departamento", 0),
        ("users", "not_null", "id_usuario", 0), ("users", "primary_key", "id_usuario", 0)}
    with pytest.raises(ValueError):
        S.constraint_report({})


def test_declared_types_read_times(spark):
    rows = [(1, 2, dt.datetime(2024, 1, 1, 9), 3, 60)]
    frame = spark.createDataFrame(rows, S.TABLES["listens"].struct())
    assert dict(frame.dtypes)["fecha"] == "timestamp_ntz" and [tuple(r) for r in frame.collect()] == rows

"""Declared schemas and constraints of the campus tables, and what follows from them.

``TABLES`` says of each table its columns (type, NOT NULL, greatest length,
allowed values), its keys and its foreign keys.  From that come

- ``struct`` -- the Spark schema for readers and streams;
- ``reasons`` -- the row rules a row breaks, as one column expression;
- ``split_rows`` -- good rows and rejects;
- ``constraint_report`` -- one line for every declared rule of a set of
  tables with the number of rows that break it.

The semantics are SQL's: NULL passes CHECK, length and FOREIGN KEY rules,
and a UNIQUE key with a NULL conflicts with nothing; a PRIMARY KEY is also
NOT NULL in each of its columns.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    length: int | None = None
    allowed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Table:
    fields: tuple[Field, ...]
    key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[tuple[str, str, str], ...] = ()  #: (column, parent table, parent column)

    def struct(self) -> T.StructType:
        """The Spark schema; columns stay nullable, as Spark does not enforce NOT NULL on files."""
        return reduce(lambda struct, f: struct.add(f.name, f.type), self.fields, T.StructType())

    def required(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields if f.required or f.name in self.key)


def _ids(*names: str) -> tuple[Field, ...]:
    return tuple(Field(n, "long") for n in names)


def _link(left: str, left_table: str, right: str, right_table: str) -> Table:
    return Table(_ids(left, right), (left, right), references=((left, left_table, left), (right, right_table, right)))


# Names, lengths, allowed values and references of the campus tables.
TABLES: dict[str, Table] = {
    "users": Table((*_ids("id_usuario"), Field("nombre", "string", True, 100), Field("correo", "string", True, 100),
                    Field("facultad", "string", length=100)), ("id_usuario",), (("correo",),)),
    "accounts": Table((*_ids("id_registro", "id_usuario"), Field("username", "string", True, 50),
                       Field("password", "string", True, 200),
                       Field("rol", "string", length=20, allowed=("admin", "profesor", "estudiante"))),
                      ("id_registro",), (("username",),), (("id_usuario", "users", "id_usuario"),)),
    "professors": Table(_ids("id_profesor", "id_usuario"), ("id_profesor",), references=(("id_usuario", "users", "id_usuario"),)),
    "students": Table((*_ids("id_estudiante", "id_usuario"), Field("matricula", "string", length=50)), ("id_estudiante",),
                      (("matricula",),), (("id_usuario", "users", "id_usuario"),)),
    "subjects": Table((*_ids("id_asignatura"), Field("nombre", "string", length=100)), ("id_asignatura",)),
    "departments": Table((*_ids("id_departamento"), Field("nombre", "string", True, 100)), ("id_departamento",), (("nombre",),)),
    "degrees": Table((*_ids("id_carrera"), Field("nombre", "string", True, 100)), ("id_carrera",), (("nombre",),)),
    "prof_dept": _link("id_profesor", "professors", "id_departamento", "departments"),
    "prof_degree": _link("id_profesor", "professors", "id_carrera", "degrees"),
    "prof_subject": _link("id_profesor", "professors", "id_asignatura", "subjects"),
    "buildings": Table((*_ids("id_edificio"), Field("nombre", "string", length=100), Field("ubicacion", "string", length=200)),
                       ("id_edificio",)),
    "classrooms": Table((*_ids("id_aula"), Field("nombre", "string", length=50), Field("capacidad", "integer"), *_ids("id_edificio")),
                        ("id_aula",), references=(("id_edificio", "buildings", "id_edificio"),)),
    "sensors": Table((*_ids("id_sensor"), Field("tipo", "string", length=50), *_ids("id_aula")), ("id_sensor",),
                     references=(("id_aula", "classrooms", "id_aula"),)),
    "wifi": Table((*_ids("id_wifi", "id_aula"), Field("usuarios_conectados", "integer"), Field("ancho_banda", "decimal(18,4)"),
                   Field("latencia", "decimal(18,4)"), Field("jitter", "decimal(18,4)"), Field("perdida_paquetes", "decimal(18,4)"),
                   Field("nivel_senal", "decimal(18,4)"), Field("fecha", "timestamp_ntz")), ("id_wifi",),
                  references=(("id_aula", "classrooms", "id_aula"),)),
    "programs": Table((*_ids("id"), Field("titulo_programa", "string", True, 150), Field("tipo_id", "string", True, 50),
                       Field("fecha_hora_inicio", "timestamp_ntz", True), Field("fecha_hora_fin", "timestamp_ntz", True),
                       Field("es_en_vivo", "boolean"), *_ids("locutor_id")), ("id",),
                      references=(("locutor_id", "professors", "id_profesor"),)),
    "listens": Table((*_ids("id", "id_programa"), Field("fecha", "timestamp_ntz"), *_ids("usuario_id"),
                      Field("segundos_escuchados", "long", True)), ("id",),
                     references=(("id_programa", "programs", "id"), ("usuario_id", "students", "id_estudiante"))),
    "qr_codes": Table((*_ids("id_qr", "id_aula"), Field("codigo_qr", "string", True, 255), Field("fecha_inicio", "date"),
                       Field("fecha_fin", "date")), ("id_qr",), (("codigo_qr",),), (("id_aula", "classrooms", "id_aula"),)),
    "prof_attendance": Table((*_ids("id_asistencia", "id_profesor", "id_qr"), Field("fecha", "timestamp_ntz"),
                              Field("estado", "string", length=20, allowed=("presente", "ausente"))), ("id_asistencia",),
                             references=(("id_profesor", "professors", "id_profesor"), ("id_qr", "qr_codes", "id_qr"))),
}


def _row_rules(table: Table, columns: list[str]) -> list[tuple[str, str, Column]]:
    """(rule, column, broken) of the rules that a row alone decides, for the columns there are."""
    rules = [("not_null", c, F.col(c).isNull()) for c in table.required() if c in columns]
    for f in table.fields:
        if f.name in columns and f.length is not None:
            rules.append(("length", f.name, F.coalesce(F.length(F.col(f.name)) > f.length, F.lit(False))))
        if f.name in columns and f.allowed:
            rules.append(("check", f.name, F.coalesce(~F.col(f.name).isin(*f.allowed), F.lit(False))))
    return rules


def reasons(table: Table, columns: list[str]) -> Column:
    """``rule:column`` of every row rule that a row breaks, in the order they are declared."""
    marks = [F.when(broken, F.lit(f"{rule}:{c}")) for rule, c, broken in _row_rules(table, columns)]
    return F.filter(F.array(*marks) if marks else F.array().cast("array<string>"), lambda x: x.isNotNull())


def split_rows(df: DataFrame, table: Table) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all row rules, and the others with ``motivos``, the rules they break."""
    marked = df.withColumn("motivos", reasons(table, df.columns))
    return marked.where(F.size("motivos") == 0).drop("motivos"), marked.where(F.size("motivos") > 0)


def _row_report(name: str, df: DataFrame, table: Table) -> DataFrame | None:
    """All row rules of a table in one pass."""
    rules = _row_rules(table, df.columns)
    if not rules:
        return None
    counts = df.agg(*[F.count_if(broken).alias(f"r{i}") for i, (_, _, broken) in enumerate(rules)])
    lines = F.array(*[F.struct(F.lit(name).alias("tabla"), F.lit(rule).alias("regla"), F.lit(c).alias("columnas"),
                               F.col(f"r{i}").alias("filas")) for i, (rule, c, _) in enumerate(rules)])
    return counts.select(F.inline(lines))


def _line(rows: DataFrame, name: str, rule: str, columns: str) -> DataFrame:
    return rows.select(F.lit(name).alias("tabla"), F.lit(rule).alias("regla"), F.lit(columns).alias("columnas"),
                       F.coalesce("n", F.lit(0)).cast("long").alias("filas"))


def _key_report(name: str, df: DataFrame, rule: str, key: tuple[str, ...]) -> DataFrame:
    """Rows beyond the first of each key; equal keys are counted before they are shuffled."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    extra = df.where(whole).groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("n"))
    return _line(extra.agg(F.sum("n").alias("n")), name, rule, ",".join(key))


def _reference_report(name: str, df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference has no parent.  References are counted first, so the anti-join has one row for
    each different value and a value that most rows share is one of them."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    orphans = values.join(parent.select(F.col(parent_column).alias("_v")), "_v", "left_anti")
    return _line(orphans.agg(F.sum("n").alias("n")), name, "foreign_key", column)


def constraint_report(tables: Mapping[str, DataFrame], declared: Mapping[str, Table] = TABLES) -> DataFrame:
    """tabla, regla, columnas, filas: how many rows break each declared rule of the given tables.

    Rules on columns that a table lacks, and references to tables that are not given, are left out.  Each table is
    read once for all its row rules; each key and each reference is one aggregate, the reference with one anti-join.
    An empty table gives zeros."""
    lines = []
    for name, df in tables.items():
        table = declared[name]
        rows = _row_report(name, df, table)
        if rows is not None:
            lines.append(rows)
        for rule, keys in (("primary_key", (table.key,)), ("unique", table.unique)):
            lines += [_key_report(name, df, rule, k) for k in keys if k and set(k) <= set(df.columns)]
        lines += [_reference_report(name, df, c, tables[p], pc) for c, p, pc in table.references
                  if c in df.columns and p in tables and pc in tables[p].columns]
    if not lines:
        raise ValueError("no declared rule applies to the given tables")
    return reduce(DataFrame.unionByName, lines)

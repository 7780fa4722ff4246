"""Driver tables reshaped into campus tables.

Each binding is a base table plus a list of SQL expressions (and an
optional row condition that *defines* the campus table, e.g. "alerts are
the error events").  The expressions are written in the SQL subset that
both Spark and DuckDB accept, so the same text builds the Spark input
(``selectExpr``) and the oracle's input (a CTE).  A binding only renames,
casts and derives columns row by row; it never aggregates, joins or
drops rows to make a query cheaper.  All operator work happens in the
library on the resulting frames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Fixed reference point used in place of NOW() / CURRENT_DATE so that
# results are repeatable.
AS_OF = "2024-01-15 12:00:00"
AS_OF_DATE = "1998-08-02"


def _dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


@dataclass(frozen=True)
class Binding:
    table: str
    exprs: tuple[str, ...]
    where: str | None = None
    doc: str = field(default="", compare=False)

    def sql(self) -> str:
        cond = f" WHERE {self.where}" if self.where else ""
        return f"SELECT {', '.join(self.exprs)} FROM {self.table}{cond}"


BINDINGS: dict[str, Binding] = {
    # activity log / footprint (huella_usuarios shape A)
    "activity": Binding("events", (
        "event_id AS id_registro",
        "CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS id_usuario",
        "event_type AS accion",
        "CASE WHEN event_type = 'view' THEN 'Radio' ELSE event_type END AS modulo",
        "props AS detalle",
        "CAST(floor(value) AS BIGINT) AS duracion_segundos",
        "ts AS fecha_hora",
    )),
    # radio listening statistics
    "listens": Binding("events", (
        "event_id AS id",
        "user_id % 25 AS id_programa",
        "CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS usuario_id",
        "CAST(floor(value) AS BIGINT) AS segundos_escuchados",
        "CASE WHEN event_id % 101 = 0 THEN NULL ELSE ts END AS fecha",
    )),
    "programs": Binding("nation", (
        "CAST(n_nationkey AS BIGINT) AS id",
        "n_name AS titulo_programa",
    )),
    # GPS positions of buses
    "positions": Binding("events", (
        "event_id AS id_posicion",
        "user_id AS id_bus",
        "user_id % 5 AS id_ruta",
        _dbl("3.7") + " + " + _dbl("value") + " / 10000 AS latitud",
        _dbl("8.7") + " + " + _dbl("user_id") + " / 100000 AS longitud",
        "CAST(CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0 "
        "ELSE value END AS DECIMAL(18,4)) AS velocidad",
        "event_type AS direccion",
        "CASE WHEN event_id % 997 = 0 THEN NULL ELSE ts END AS fecha_hora",
    )),
    "bus_alerts": Binding("events", (
        "event_id AS id_alerta",
        "user_id AS id_bus",
        "event_type AS tipo",
        "props AS descripcion",
        "ts AS timestamp",
    ), where="event_type = 'error'"),
    "buses": Binding("supplier", (
        "s_suppkey AS id_bus",
        "s_name AS numero",
        "CAST(floor(abs(s_acctbal)) AS BIGINT) AS capacidad",
        "CASE WHEN s_suppkey % 3 > 0 THEN 'EN SERVICIO' ELSE 'FUERA DE SERVICIO' END AS estado",
    )),
    "routes": Binding("region", (
        "CAST(r_regionkey AS BIGINT) AS id_ruta",
        "r_name AS nombre",
        "21600 + 600 * r_regionkey AS hora_inicio",
        "21600 + 600 * r_regionkey + 3600 + 60 * r_regionkey AS hora_fin",
    )),
    "stops": Binding("nation", (
        "CAST(n_nationkey AS BIGINT) AS id_parada",
        "CAST(n_regionkey AS BIGINT) AS id_ruta",
        "n_name AS nombre",
        _dbl("3.71") + " + " + _dbl("n_nationkey") + " / 1000 AS latitud",
        _dbl("8.66") + " + " + _dbl("n_nationkey") + " / 1000 AS longitud",
        "n_nationkey AS orden",
    )),
    "passengers": Binding("orders", (
        "o_orderkey AS id_pasajero",
        "o_custkey AS id_bus",
        "o_custkey AS id_usuario",
        "'A BORDO' AS estado",
        "o_orderdate AS fecha",
    )),
    "users": Binding("customer", (
        "c_custkey AS id_usuario",
        "c_name AS nombre",
        "lower(c_name) || '@campus.example' AS correo",
        "c_mktsegment AS rol",
        "'F' || CAST(c_nationkey AS STRING) AS facultad",
    )),
    "accounts": Binding("customer", (
        "c_custkey AS id_registro",
        "CASE WHEN c_custkey % 11 = 0 THEN -c_custkey ELSE c_custkey END AS id_usuario",
        "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN c_name || '/' || c_name || '/' || c_name ELSE c_name END AS username",
        "'p' || c_name AS password",
        "CASE c_custkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'profesor' WHEN 2 THEN 'estudiante' "
        "WHEN 3 THEN c_mktsegment END AS rol",
    )),
    "prof_attendance": Binding("orders", (
        "CAST(floor(o_orderkey / 2) AS BIGINT) AS id_asistencia",
        "o_custkey AS id_profesor",
        "o_orderkey + o_orderkey % 3 AS id_qr",
        "o_orderdate AS fecha",
        "CASE WHEN o_orderstatus = 'F' THEN 'presente' WHEN o_orderstatus = 'O' THEN 'ausente' ELSE o_orderpriority END AS estado",
    )),
    "students": Binding("orders", (
        "o_orderkey AS id_estudiante",
        "o_custkey AS id_usuario",
        "'M' || CAST(o_orderkey AS STRING) AS matricula",
    )),
    "professors": Binding("customer", (
        "c_custkey AS id_profesor",
        "c_custkey AS id_usuario",
    )),
    "departments": Binding("nation", (
        "CAST(n_nationkey AS BIGINT) AS id_departamento",
        "n_name AS nombre",
    )),
    "degrees": Binding("region", (
        "CAST(r_regionkey AS BIGINT) AS id_carrera",
        "r_name AS nombre",
    )),
    "subjects": Binding("part", (
        "p_partkey AS id_asignatura",
        "p_brand AS nombre",
    )),
    "prof_dept": Binding("orders", (
        "o_custkey AS id_profesor",
        "o_orderkey % 25 AS id_departamento",
    )),
    "prof_degree": Binding("orders", (
        "o_custkey AS id_profesor",
        "o_orderkey % 7 AS id_carrera",
    )),
    "prof_subject": Binding("orders", (
        "o_custkey AS id_profesor",
        "o_orderkey % 1000 AS id_asignatura",
    )),
    "classrooms": Binding("supplier", (
        "s_suppkey AS id_aula",
        "'Aula ' || CAST(s_suppkey AS STRING) AS nombre",
        "CAST(s_nationkey AS BIGINT) AS id_edificio",
    )),
    "attendance": Binding("orders", (
        "o_orderkey AS id_asistencia",
        "o_custkey AS id_profesor",
        "o_custkey % 30 AS id_departamento",
        "o_orderkey % 6 AS id_carrera",
        "o_orderkey % 2500 AS id_asignatura",
        "o_custkey % 120 AS id_aula",
        "CAST(o_orderdate AS DATE) AS fecha",
        "o_orderdate AS hora_entrada",
        "CASE WHEN o_orderstatus = 'F' THEN TRUE WHEN o_orderstatus = 'O' THEN FALSE ELSE NULL END AS validacion",
        "CAST(o_orderkey AS STRING) AS codigo_qr",
        "o_orderkey AS id_qr",
    )),
    "qr_codes": Binding("orders", (
        "o_orderkey AS id_qr",
        "o_custkey % 50 AS id_aula",
        "o_orderkey % 1000 AS id_asignatura",
        "'Q' || CAST(o_orderkey % 5 AS STRING) AS codigo_qr",
        "o_orderdate AS fecha_generacion",
        "o_orderdate + INTERVAL 7 DAY AS valido_hasta",
    )),
    "scans": Binding("lineitem", (
        "l_partkey AS id_profesor",
        "l_suppkey % 50 AS id_aula",
        "'Q' || CAST(l_orderkey % 5 AS STRING) AS codigo_qr",
        "l_shipdate AS hora_scan",
    )),
    "sensor_types": Binding("region", (
        "CAST(r_regionkey AS BIGINT) AS id_tipo",
        "r_name AS nombre",
    )),
    "sensors": Binding("part", (
        "p_partkey AS id_sensor",
        "p_partkey % 120 AS id_aula",
        "CAST(p_size % 6 AS BIGINT) AS id_tipo",
        "p_type AS ubicacion",
    )),
    "readings": Binding("lineitem", (
        "l_partkey AS id_sensor",
        "CAST(l_quantity AS DECIMAL(18,4)) AS valor",
        "CAST(l_shipdate AS DATE) AS fecha",
        "CAST(l_orderkey % 86400 AS INT) AS hora",
    )),
    "wifi": Binding("lineitem", (
        "l_suppkey AS id_aula",
        "l_linenumber AS usuarios_conectados",
        "CAST(l_extendedprice AS DECIMAL(18,4)) AS ancho_banda",
        "CAST(l_quantity * 3 AS DECIMAL(18,4)) AS latencia",
        "CAST(l_quantity AS DECIMAL(18,4)) AS jitter",
        "CAST(l_discount AS DECIMAL(18,4)) AS perdida_paquetes",
        "CAST(-40 - l_quantity AS DECIMAL(18,4)) AS nivel_senal",
        "l_shipdate AS fecha",
    )),
    "classes": Binding("orders", (
        "o_orderkey AS id_videoclase",
        "o_orderpriority AS titulo",
        "o_custkey AS profesor_id",
        "o_orderdate AS fecha_inicio",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate + INTERVAL 30 DAY END AS fecha_fin",
        "CASE WHEN o_orderstatus = 'F' THEN 'FINALIZADA' WHEN o_orderstatus = 'O' THEN 'EN_CURSO' "
        "ELSE 'PROGRAMADA' END AS estado",
    )),
    "guests": Binding("part", (
        "p_partkey AS id_videoclase",
        "CASE WHEN p_size % 9 = 0 THEN '' ELSE ' ' || p_name || ' , ' || p_brand || ',' || p_type END AS invitados",
    )),
    "transport_days": Binding("orders", (
        "o_orderkey AS id_transporte",
        "CAST(o_orderdate AS DATE) AS fecha",
        "CAST(floor(o_totalprice) AS BIGINT) AS capacidad",
        "o_custkey % 40 AS buses_en_servicio",
        "o_custkey % 7 AS buses_fuera_servicio",
        "o_orderkey % 5 AS rutas_activas",
        "o_orderkey % 11 AS alertas_hoy",
        _dbl("o_totalprice") + " / 1000 AS ocupacion_promedio",
        "o_orderpriority AS ruta",
    )),
    "buildings": Binding("nation", (
        "CAST(n_nationkey AS BIGINT) AS id_edificio",
        "n_name AS nombre",
        _dbl("3.71") + " + " + _dbl("n_nationkey") + " / 1000 AS lat",
        _dbl("8.66") + " + " + _dbl("n_nationkey") + " / 1000 AS lng",
        "CAST(CAST(3.71 + n_nationkey / 1000.0 AS DECIMAL(10,4)) AS STRING) || "
        "CASE WHEN n_nationkey % 4 = 1 THEN 'S' ELSE 'N' END || ', ' || "
        "CAST(CAST(8.66 + n_nationkey / 1000.0 AS DECIMAL(10,4)) AS STRING) || "
        "CASE WHEN n_nationkey % 5 = 2 THEN 'W' ELSE 'E' END AS coordenadas",
    )),
    # stops of many short routes (about 20 stops each), growing with ``part``
    "route_stops": Binding("part", (
        "p_partkey AS id_parada",
        "CAST(floor(p_partkey / 20) AS BIGINT) AS id_ruta",
        "p_name AS nombre",
        _dbl("3.7") + " + " + _dbl("p_retailprice") + " / 100000 AS latitud",
        _dbl("8.6") + " + " + _dbl("p_size") + " / 1000 AS longitud",
        "p_size AS orden",
    )),
    # building coordinates as text, some unparseable, growing with ``customer``
    "building_coords": Binding("customer", (
        "c_custkey AS id_edificio",
        "CASE WHEN c_custkey % 50 = 0 THEN 'sin coordenadas' ELSE "
        "CAST(c_custkey % 90 AS STRING) || '.' || lpad(CAST(c_custkey % 9973 AS STRING), 4, '0') || "
        "CASE WHEN c_acctbal < 0 THEN 's' ELSE 'N' END || ' , ' || "
        "CAST(c_nationkey AS STRING) || '.' || lpad(CAST(c_custkey % 997 AS STRING), 3, '0') || "
        "CASE WHEN c_custkey % 3 = 0 THEN 'W' ELSE 'E' END END AS coordenadas",
    )),
    # map searches (huella_usuarios shape B): a user looks up a building
    "map_visits": Binding("events", (
        "event_id AS id_visita",
        "user_id AS usuario_id",
        "user_id % 25 AS edificio_id",
        "'NATION_' || CAST(user_id % 25 AS STRING) AS destino",
        "ts AS fecha_busqueda",
        _dbl("3.70") + " + " + _dbl("value") + " / 10000 AS lat",
        _dbl("8.65") + " + " + _dbl("event_id % 100") + " / 10000 AS lng",
    )),
    "arrivals": Binding("events", (
        "user_id AS usuario_id",
        "user_id % 25 AS edificio_id",
        "ts AS llegada",
    ), where="event_type = 'purchase'"),
}


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Campus table ``name`` as a Spark DataFrame over the driver tables."""
    b = BINDINGS[name]
    df = read_table(spark, sf_dir, b.table)
    if b.where:
        df = df.where(b.where)
    return df.selectExpr(*b.exprs)


def cte(*names: str) -> str:
    """``WITH name AS (...) , ...`` clause for the DuckDB oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({BINDINGS[n].sql()})" for n in names) + "\n"

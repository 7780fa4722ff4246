"""Registered streaming queries.

Each key stages its bound input into a fresh folder under the shared
checkpoint directory (the stream's landing folder), runs the job with
``availableNow`` until the folder is drained, and returns the sink as a
DataFrame.  Oracles compare with the batch SQL on the same rows; for
windowed append jobs only windows closed by the final watermark count.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.bindings import AS_OF, BINDINGS, Binding, bind, cte
from ..plans.catalog import ORACLE, register
from ..session import scratch_path
from . import jobs

BINDINGS.update({
    "sensor_stream": Binding("events", (
        "user_id AS id_sensor",
        "CAST(value AS DECIMAL(18,4)) AS valor",
        "ts AS fecha_hora",
    )),
})


def _land(spark: SparkSession, sf: str, name: str, copies: int = 1):
    df = bind(spark, sf, name)
    path = scratch_path(spark, f"landing-{name}")
    for _ in range(copies):
        df.write.mode("append").parquet(path)
    return path, df.schema


def _paths(spark: SparkSession, name: str):
    return scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-checkpoint")


def _drain(q) -> None:
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@register("stream_readings", cte("sensor_stream") + """
SELECT id_sensor, valor, CAST(fecha_hora AS DATE) AS fecha,
       CAST(hour(fecha_hora) * 3600 + minute(fecha_hora) * 60 + second(fecha_hora) AS INTEGER) AS hora
FROM sensor_stream""")
def _stream_readings(spark, sf) -> DataFrame:
    src, schema = _land(spark, sf, "sensor_stream")
    out, ck = _paths(spark, "readings")
    _drain(jobs.start_stream_readings(spark, src, out, ck, schema))
    return spark.read.parquet(out)


@register("stream_latest_position", cte("positions") + """
SELECT id_bus, fecha_hora, id_posicion, id_ruta, latitud, longitud, velocidad, direccion FROM (
  SELECT *, row_number() OVER (PARTITION BY id_bus ORDER BY fecha_hora DESC, id_posicion DESC) AS rn
  FROM positions WHERE fecha_hora IS NOT NULL) WHERE rn = 1""")
def _stream_latest_position(spark, sf) -> DataFrame:
    src, schema = _land(spark, sf, "positions")
    out, ck = _paths(spark, "latest-position")
    _drain(jobs.start_stream_latest_position(spark, src, out, ck, schema))
    return jobs.read_snapshot(spark, out)


@register("stream_position_rejects", cte("positions") + "SELECT * FROM positions WHERE fecha_hora IS NULL")
def _stream_position_rejects(spark, sf) -> DataFrame:
    src, schema = _land(spark, sf, "positions")
    out, ck = _paths(spark, "position-rejects")
    _drain(jobs.start_stream_rejects(spark, src, out, ck, schema))
    return spark.read.parquet(out)


@register("stream_activity_by_module", cte("activity") + """
SELECT date_trunc('hour', fecha_hora) AS inicio, date_trunc('hour', fecha_hora) + INTERVAL 1 HOUR AS fin, modulo,
       CAST(count(*) AS BIGINT) AS total
FROM activity GROUP BY 1, 2, 3
HAVING date_trunc('hour', fecha_hora) + INTERVAL 1 HOUR <= (SELECT max(fecha_hora) FROM activity) - INTERVAL 10 MINUTE""")
def _stream_activity_by_module(spark, sf) -> DataFrame:
    src, schema = _land(spark, sf, "activity")
    out, ck = _paths(spark, "activity-by-module")
    _drain(jobs.start_stream_activity_by_module(spark, src, out, ck, schema))
    return spark.read.parquet(out)


@register("stream_connected_users", cte("activity") + """
, w AS (SELECT DISTINCT date_trunc('minute', fecha_hora) - to_minutes(k) AS inicio, id_usuario
        FROM activity, (SELECT unnest(range(0, 5)) AS k) WHERE id_usuario IS NOT NULL)
SELECT inicio, inicio + INTERVAL 5 MINUTE AS fin, CAST(count(*) AS BIGINT) AS usuarios FROM w
GROUP BY inicio
HAVING inicio + INTERVAL 5 MINUTE <= (SELECT max(fecha_hora) FROM activity) - INTERVAL 10 MINUTE""")
def _stream_connected_users(spark, sf) -> DataFrame:
    src, schema = _land(spark, sf, "activity")
    out, ck = _paths(spark, "connected-users")
    _drain(jobs.start_stream_connected_users(spark, src, out, ck, schema))
    return spark.read.parquet(out)


@register("stream_fleet_alerts", cte("positions") + """
SELECT id_posicion, id_bus, fecha_hora, direccion, 'exceso_velocidad' AS tipo, CAST(velocidad AS DOUBLE) AS valor
FROM positions WHERE velocidad > 60
UNION ALL SELECT id_posicion, id_bus, fecha_hora, direccion, 'detenido', NULL FROM positions WHERE velocidad = 0""")
def _stream_fleet_alerts(spark, sf) -> DataFrame:
    src, schema = _land(spark, sf, "positions")
    out, ck = _paths(spark, "fleet-alerts")
    _drain(jobs.start_stream_fleet_alerts(spark, src, out, ck, schema))
    return spark.read.parquet(out)


@register("stream_report_gaps", cte("positions") + """
, g AS (SELECT id_posicion, id_bus, fecha_hora,
          CAST(epoch_us(fecha_hora) - epoch_us(lag(fecha_hora) OVER (PARTITION BY id_bus ORDER BY fecha_hora, id_posicion))
               AS DOUBLE) / CAST(60000000 AS DOUBLE) AS minutos
        FROM positions WHERE fecha_hora IS NOT NULL AND id_bus IS NOT NULL)
SELECT *, coalesce(minutos > 15, false) AS alerta, false AS tardia FROM g""")
def _stream_report_gaps(spark, sf) -> DataFrame:
    src, schema = _land(spark, sf, "positions")
    out, ck = _paths(spark, "report-gaps")
    _drain(jobs.start_stream_report_gaps(spark, src, out, ck, schema))
    return spark.read.parquet(out).drop("batch_id")


@register("stream_wifi_severity", ORACLE["wifi_severity"])
def _stream_wifi_severity(spark, sf) -> DataFrame:
    src, schema = _land(spark, sf, "wifi")
    out, ck = _paths(spark, "wifi-severity")
    _drain(jobs.start_stream_wifi_severity(spark, src, out, ck, schema))
    return spark.read.parquet(out)


@register("stream_validate_attendance", ORACLE["validate_attendance"].replace(
    "SELECT * FROM scans UNION ALL SELECT * FROM scans WHERE id_profesor % 5 = 0", "SELECT * FROM scans"))
def _stream_validate_attendance(spark, sf) -> DataFrame:
    src, schema = _land(spark, sf, "scans")
    out, ck = _paths(spark, "validate-attendance")
    _drain(jobs.start_stream_validate_attendance(spark, src, out, ck, schema, bind(spark, sf, "qr_codes")))
    return spark.read.parquet(out).drop("batch_id")


@register("stream_attendance", ORACLE["stream_validate_attendance"])
def _stream_attendance(spark, sf) -> DataFrame:
    """Scans and codes land together in three time ranges, with a run from the checkpoint after each; a last scan and
    code of no room, far ahead, let the watermark pass all others."""
    scans, codes = bind(spark, sf, "scans"), bind(spark, sf, "qr_codes")
    scans_in, codes_in = scratch_path(spark, "landing-scans"), scratch_path(spark, "landing-codes")
    out, ck = _paths(spark, "attendance")
    low, high = scans.agg(F.min("hora_scan"), F.max("hora_scan")).first()
    edges = [low + (high - low) * i / 3 for i in (1, 2)] if low else []

    def land_range(df, time, i):
        part = F.lit(True)
        if i > 0:
            part &= F.col(time) > F.lit(edges[i - 1]).cast("timestamp_ntz")
        if i < len(edges):
            part &= F.col(time) <= F.lit(edges[i]).cast("timestamp_ntz")
        return df.where(part)

    rounds = [(land_range(scans, "hora_scan", i), land_range(codes, "fecha_generacion", i)) for i in range(len(edges) + 1)]
    ahead = F.lit((high or dt.datetime(2000, 1, 1)) + dt.timedelta(days=3650)).cast("timestamp_ntz")
    one = spark.range(1)

    def last(df, **known):
        return one.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    rounds.append((last(scans, id_aula=F.lit(-1), hora_scan=ahead),
                   last(codes, id_aula=F.lit(-1), fecha_generacion=ahead, valido_hasta=ahead)))
    for some_scans, some_codes in rounds:
        some_scans.write.mode("append").parquet(scans_in)
        some_codes.write.mode("append").parquet(codes_in)
        _drain(jobs.start_stream_attendance(spark, scans_in, codes_in, out, ck, scans.schema, codes.schema))
    return spark.read.parquet(out).drop("batch_id")


@register("stream_audit_fanout", ORACLE["append_audit"])
def _stream_audit_fanout(spark, sf) -> DataFrame:
    src, schema = _land(spark, sf, "activity")
    log, ck = _paths(spark, "audit-log")
    foot = scratch_path(spark, "audit-footprint")
    _drain(jobs.start_stream_audit_fanout(spark, src, log, foot, ck, schema, AS_OF))
    return spark.read.parquet(foot).drop("batch_id")


@register("stream_dedup_actions", cte("activity") + "SELECT * FROM activity")
def _stream_dedup_actions(spark, sf) -> DataFrame:
    src, schema = _land(spark, sf, "activity", copies=2)
    out, ck = _paths(spark, "dedup-actions")
    _drain(jobs.start_stream_dedup_actions(spark, src, out, ck, schema))
    return spark.read.parquet(out)


@register("stream_audience", cte("listens") + """
SELECT CAST(date_trunc('week', fecha) AS TIMESTAMP) AS semana, id_programa,
       CAST(count(*) AS BIGINT) AS total_reproducciones, CAST(sum(segundos_escuchados) AS BIGINT) AS total_segundos
FROM listens WHERE fecha IS NOT NULL GROUP BY 1, 2""")
def _stream_audience(spark, sf) -> DataFrame:
    src, schema = _land(spark, sf, "listens")
    out, ck = _paths(spark, "audience")
    _drain(jobs.start_stream_audience(spark, src, out, ck, schema))
    return jobs.read_audience(spark, out)

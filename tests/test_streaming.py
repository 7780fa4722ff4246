"""Streaming jobs across several micro-batches: each ``availableNow`` run
drains what has landed so far, so a second run after new files arrive is
a second batch with the first batch's state."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from campuslens.operators import joins as J
from campuslens.streaming import jobs

POS = ("id_posicion long, id_bus long, id_ruta long, latitud double, longitud double, velocidad decimal(18,4), "
       "direccion string, fecha_hora timestamp_ntz")
ACT = ("id_registro long, id_usuario long, accion string, modulo string, detalle string, duracion_segundos long, "
       "fecha_hora timestamp_ntz")


def t(s):
    return dt.datetime.fromisoformat(s)


def pos(i, bus, when, speed=10):
    return (i, bus, 1, 3.7, 8.7, Decimal(speed), "calle", t(when) if when else None)


def land(spark, rows, schema, path):
    df = spark.createDataFrame(rows, schema)
    df.write.mode("append").parquet(path)
    return df.schema


def test_report_gaps_state_across_batches(spark, scratch):
    src, out, ck = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ck"
    schema = land(spark, [pos(1, 1, "2024-01-01 10:00:00"), pos(2, 1, "2024-01-01 10:20:00"),
                          pos(3, 2, "2024-01-01 10:05:00")], POS, src)
    jobs.start_stream_report_gaps(spark, src, out, ck, schema).awaitTermination()
    land(spark, [pos(4, 1, "2024-01-01 10:10:00"), pos(5, 1, "2024-01-01 10:50:00"), pos(6, 3, None)], POS, src)
    jobs.start_stream_report_gaps(spark, src, out, ck, schema).awaitTermination()
    got = {r.id_posicion: (r.minutos, r.alerta, r.tardia) for r in spark.read.parquet(out).collect()}
    assert got == {1: (None, False, False), 2: (20.0, True, False), 3: (None, False, False),
                   4: (None, False, True), 5: (30.0, True, False)}


def test_latest_position_merges_batches(spark, scratch):
    src, out, ck = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ck"
    schema = land(spark, [pos(1, 1, "2024-01-01 10:00:00"), pos(2, 2, "2024-01-01 09:00:00")], POS, src)
    jobs.start_stream_latest_position(spark, src, out, ck, schema).awaitTermination()
    land(spark, [pos(3, 1, "2024-01-01 09:30:00"), pos(4, 3, "2024-01-01 11:00:00"), pos(5, 2, None)], POS, src)
    jobs.start_stream_latest_position(spark, src, out, ck, schema).awaitTermination()
    got = {r.id_bus: r.id_posicion for r in jobs.read_snapshot(spark, out).collect()}
    assert got == {1: 1, 2: 2, 3: 4}


def act(i, when, user=1, module="Radio"):
    return (i, user, "ver", module, "", 10, t(when))


def test_dedup_across_batches(spark, scratch):
    src, out, ck = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ck"
    schema = land(spark, [act(1, "2024-01-01 10:00:00")], ACT, src)
    jobs.start_stream_dedup_actions(spark, src, out, ck, schema).awaitTermination()
    land(spark, [act(1, "2024-01-01 10:00:00"), act(2, "2024-01-01 10:01:00")], ACT, src)
    jobs.start_stream_dedup_actions(spark, src, out, ck, schema).awaitTermination()
    assert sorted(r.id_registro for r in spark.read.parquet(out).collect()) == [1, 2]


def test_windowed_counts_drop_late_rows(spark, scratch):
    src, out, ck = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ck"
    schema = land(spark, [act(1, "2024-01-01 10:10:00"), act(2, "2024-01-01 12:30:00")], ACT, src)
    jobs.start_stream_activity_by_module(spark, src, out, ck, schema).awaitTermination()
    # 10:20 belongs to a window the watermark (12:20) has already closed: dropped
    land(spark, [act(3, "2024-01-01 10:20:00"), act(4, "2024-01-01 14:00:00")], ACT, src)
    q = jobs.start_stream_activity_by_module(spark, src, out, ck, schema)
    q.awaitTermination()
    assert jobs.late_rows(q) == 1
    got = sorted((r.inicio, r.total) for r in spark.read.parquet(out).collect())
    assert got[0] == (t("2024-01-01 10:00:00"), 1)
    assert (t("2024-01-01 12:00:00"), 1) in got


def test_connected_users_distinct_per_window(spark, scratch):
    src, out, ck = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ck"
    schema = land(spark, [act(1, "2024-01-01 10:00:30", user=1), act(2, "2024-01-01 10:01:30", user=1),
                          act(3, "2024-01-01 10:02:00", user=2), act(4, "2024-01-01 11:00:00", user=None),
                          act(5, "2024-01-01 11:00:00", user=3)], ACT, src)
    jobs.start_stream_connected_users(spark, src, out, ck, schema).awaitTermination()
    got = {r.inicio: r.usuarios for r in spark.read.parquet(out).collect()}
    assert got[t("2024-01-01 10:00:00")] == 2      # users 1 and 2, user 1 counted once
    assert got[t("2024-01-01 09:56:00")] == 1


def test_max_files_splits_batches(spark, scratch):
    src, out, ck = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ck"
    schema = None
    for i in range(3):
        schema = land(spark, [pos(10 + i, 1, f"2024-01-01 10:{i:02d}:00")], POS, src)
    q = jobs.start_stream_report_gaps(spark, src, out, ck, schema, max_files=1)
    q.awaitTermination()
    assert sum(1 for p in q.recentProgress if p["numInputRows"] > 0) == 3
    got = sorted((r.id_posicion, r.minutos) for r in spark.read.parquet(out).collect())
    assert got == [(10, None), (11, 1.0), (12, 1.0)]


SCAN = "id_profesor long, id_aula long, codigo_qr string, hora_scan timestamp_ntz"


def test_stream_validate_attendance_per_batch(spark, scratch):
    src, out, ck = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ck"
    codes = spark.createDataFrame([(1, 5, "A", t("2024-01-01 00:00:00"), t("2024-01-08 00:00:00"))],
                                  "id_qr long, id_aula long, codigo_qr string, fecha_generacion timestamp_ntz, "
                                  "valido_hasta timestamp_ntz")
    schema = land(spark, [(1, 5, "A", t("2024-01-02 09:00:00"))], SCAN, src)
    jobs.start_stream_validate_attendance(spark, src, out, ck, schema, codes).awaitTermination()
    land(spark, [(2, 5, "B", t("2024-01-02 09:00:00")), (3, 5, "A", t("2024-01-09 09:00:00"))], SCAN, src)
    jobs.start_stream_validate_attendance(spark, src, out, ck, schema, codes).awaitTermination()
    got = {r.id_profesor: r.valida for r in spark.read.parquet(out).collect()}
    assert got == {1: True, 2: False, 3: False}


CODE = "id_qr long, id_aula long, codigo_qr string, fecha_generacion timestamp_ntz, valido_hasta timestamp_ntz"


def _attendance_rounds(spark, folder, rounds):
    """Verdicts after scans and codes landed in rounds, with a run after each."""
    scans_in, codes_in, out, ck = (f"{folder}/{n}" for n in ("scans", "codes", "out", "ck"))
    for scans, codes in rounds:
        s, c = land(spark, scans, SCAN, scans_in), land(spark, codes, CODE, codes_in)
        q = jobs.start_stream_attendance(spark, scans_in, codes_in, out, ck, s, c)
        q.awaitTermination()
        assert q.exception() is None and jobs.late_rows(q) == 0
    return sorted(((r.id_profesor, r.id_qr_vigente, r.valida) for r in spark.read.parquet(out).collect()), key=str)


def test_stream_attendance_with_codes_issued_between_batches(spark, scratch):
    day = "2024-01-0{} 09:00:00".format
    codes = [(1, 5, "A", t(day(1)), t(day(8))), (2, 5, "B", t(day(3)), t(day(4))), (3, 6, "C", t(day(2)), t(day(3)))]
    scans = [(1, 5, "A", t(day(2))), (2, 5, "A", t(day(3))), (3, 5, "B", t(day(3))), (3, 5, "B", t(day(3))), (4, 6, "C", t(day(4))),
             (5, None, "A", t(day(4))), (6, 5, "A", t(day(5)))]
    end = ([(99, -1, "", t("2024-06-01 00:00:00"))], [(99, -1, "", t("2024-06-01 00:00:00"), t("2024-06-01 00:00:00"))])
    want = sorted([(1, 1, True), (2, 2, False), (3, 2, True), (3, 2, True), (4, None, False), (5, None, False), (6, 1, True)], key=str)
    assert _attendance_rounds(spark, f"{scratch}/one", [(scans, codes), end]) == want
    # the code in force on day 3 lands after the first scans of that day
    assert _attendance_rounds(spark, f"{scratch}/cut", [(scans[:3], codes[:1]), (scans[3:], codes[1:]), end]) == want


def test_stream_attendance_holds_a_row_for_each_scan_and_code(spark, scratch):
    """Codes valid at the same time are not paired with each scan, nor listed for each of their days."""
    hour = "2024-01-{:02d} {:02d}:00:00".format
    codes = [(i, 5, f"Q{i % 3}", t(hour(1 + i % 5, i % 24)), t(hour(6 + i % 2, i % 24))) for i in range(200)]
    scans = [(i, 5, f"Q{i % 3}", t(hour(1 + i % 7, (i * 7) % 24))) for i in range(200)]
    end = (99, -1, "", t("2024-06-01 00:00:00"))
    s, c = land(spark, [*scans, end], SCAN, f"{scratch}/scans"), land(spark, [*codes, (*end, end[-1])], CODE, f"{scratch}/codes")
    q = jobs.start_stream_attendance(spark, f"{scratch}/scans", f"{scratch}/codes", f"{scratch}/out", f"{scratch}/ck", s, c)
    q.awaitTermination()
    assert q.exception() is None
    want = J.validate_attendance(spark.createDataFrame(scans, SCAN), spark.createDataFrame(codes, CODE))
    got = spark.read.parquet(f"{scratch}/out").drop("batch_id")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert sum(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]) <= len(scans) + len(codes)


def test_stream_attendance_batch_run_again_and_late_rows(spark, scratch):
    day = "2024-01-0{} 09:00:00".format
    s, c = spark.createDataFrame([], SCAN).schema, spark.createDataFrame([], CODE).schema

    def rows(scans, codes):
        a, b = spark.createDataFrame(scans, s), spark.createDataFrame(codes, c)
        return a.select(F.struct("*").alias("scan"), F.lit(None).cast(c).alias("code")).union(
            b.select(F.lit(None).cast(s).alias("scan"), F.struct("*").alias("code")))
    run = jobs.attendance_batches(f"{scratch}/out", f"{scratch}/state", f"{scratch}/late", s, c, 3_600_000_000)
    batches = [rows([(1, 5, "A", t(day(2))), (2, 5, "B", t(day(4)))], [(1, 5, "A", t(day(1)), t(day(5)))]),
               rows([(3, 5, "A", t(day(3)))], [(2, 5, "B", t(day(4)), t(day(5)))]),
               rows([(4, 5, "A", t(day(1))), (5, 5, "B", t(day(6)))], [(3, 5, "C", t(day(7)), t(day(8)))])]
    for i, b in enumerate(batches):
        run(b, i)
        run(b, i)
    got = sorted((r.id_profesor, r.id_qr_vigente, r.valida) for r in spark.read.parquet(f"{scratch}/out").collect())
    assert got == [(1, 1, True), (2, 2, True), (3, 1, True)]
    assert [r.scan.id_profesor for r in spark.read.parquet(f"{scratch}/late").collect()] == [4]


def test_stream_attendance_refuses_longer_codes(spark, scratch):
    scans_in, codes_in = f"{scratch}/scans", f"{scratch}/codes"
    s = land(spark, [(1, 5, "A", t("2024-01-02 09:00:00"))], SCAN, scans_in)
    c = land(spark, [(1, 5, "A", t("2024-01-01 09:00:00"), t("2024-01-09 09:00:00"))], CODE, codes_in)
    q = jobs.start_stream_attendance(spark, scans_in, codes_in, f"{scratch}/out", f"{scratch}/ck", s, c)
    with pytest.raises(Exception, match="longer than 7 days"):
        q.awaitTermination()


def test_stream_audit_fanout_writes_both_tables(spark, scratch):
    src, log, foot, ck = f"{scratch}/in", f"{scratch}/log", f"{scratch}/foot", f"{scratch}/ck"
    schema = land(spark, [act(1, "2024-01-01 10:00:00")], ACT, src)
    jobs.start_stream_audit_fanout(spark, src, log, foot, ck, schema, "2024-01-15 12:00:00").awaitTermination()
    land(spark, [act(2, "2024-01-01 10:05:00")], ACT, src)
    jobs.start_stream_audit_fanout(spark, src, log, foot, ck, schema, "2024-01-15 12:00:00").awaitTermination()
    a = sorted(tuple(r) for r in spark.read.parquet(log).drop("batch_id").collect())
    b = sorted(tuple(r) for r in spark.read.parquet(foot).drop("batch_id").collect())
    assert a == b and len(a) == 2


def _land_in_time_order(spark, df, ts, path, parts=4):
    """Write ``df`` as ``parts`` files, one write per time range, so the
    file source sees them in time order (one file per micro-batch)."""
    ordered_rows = df.where(F.col(ts).isNotNull())
    q = ordered_rows.select(F.percentile_approx(F.unix_micros(F.col(ts).cast("timestamp")),
                                                [i / parts for i in range(1, parts)], 100000)).first()[0]
    edges = [None] + list(q) + [None]
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    for lo, hi in zip(edges, edges[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (micros > lo)
        if hi is not None:
            cond = cond & (micros <= hi)
        ordered_rows.where(cond).coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_stream_audience_equals_batch_over_several_batches(spark, scratch):
    from campuslens.operators import aggregates as A
    from campuslens.plans.bindings import bind
    listens = bind(spark, "/root/testdata/sf0.001", "listens")
    src, out, ck = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ck"
    schema = _land_in_time_order(spark, listens, "fecha", src)
    q = jobs.start_stream_audience(spark, src, out, ck, schema, max_files=1)
    q.awaitTermination()
    assert sum(1 for p in q.recentProgress if p["numInputRows"] > 0) == 4
    got = sorted(tuple(r) for r in jobs.read_audience(spark, out).collect())
    want = sorted(tuple(r) for r in A.audience(listens.where(F.col("fecha").isNotNull()), "week").collect())
    assert got == want


def test_stream_audience_rewrites_touched_weeks_and_replays(spark, scratch):
    import glob
    import os

    def file_times(week):
        return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{out}/dia_semana={week}/*/*.parquet")}
    out = f"{scratch}/out"
    merge = jobs.merge_into_partitions(out, ["semana", "id_programa"], "dia_semana",
                                       F.datediff("semana", F.lit("1970-01-01").cast("date")))
    monday, next_monday = t("2024-01-01 00:00:00"), t("2024-01-08 00:00:00")

    def batch(*rows):
        return spark.createDataFrame(rows, "semana timestamp_ntz, id_programa long, total_reproducciones long, total_segundos long")

    def now():
        return sorted(tuple(r) for r in jobs.read_audience(spark, out).collect())
    merge(batch((monday, 1, 1, 10), (monday, 2, 1, 5)), 0)
    first = file_times(19723)
    merge(batch((next_monday, 1, 1, 7)), 1)
    assert first and file_times(19723) == first      # the first week's files are as they were
    for _ in range(2):                               # a replayed batch changes nothing
        merge(batch((next_monday, 1, 3, 9), (next_monday, 4, 1, 1), (monday, 2, 2, 6)), 2)
        assert now() == [(monday, 1, 1, 10), (monday, 2, 2, 6), (next_monday, 1, 3, 9), (next_monday, 4, 1, 1)]
    merge(batch((monday, 1, 5, 50)), 3)
    assert now()[:2] == [(monday, 1, 5, 50), (monday, 2, 2, 6)] and len(now()) == 4


def test_every_play_is_counted_or_rejected(spark, scratch):
    from campuslens.plans.bindings import bind
    listens = bind(spark, "/root/testdata/sf0.001", "listens")
    listens.write.parquet(f"{scratch}/in")
    jobs.start_stream_audience(spark, f"{scratch}/in", f"{scratch}/out", f"{scratch}/ck", listens.schema).awaitTermination()
    jobs.start_stream_rejects(spark, f"{scratch}/in", f"{scratch}/rejects", f"{scratch}/ck2", listens.schema, "fecha").awaitTermination()
    plays = jobs.read_audience(spark, f"{scratch}/out").agg(F.sum("total_reproducciones")).first()[0]
    rejects = spark.read.parquet(f"{scratch}/rejects").count()
    assert rejects > 0 and plays + rejects == listens.count()


def test_stream_latest_position_equals_batch_over_several_batches(spark, scratch):
    from campuslens.operators import windows as W
    from campuslens.plans.bindings import bind
    pos = bind(spark, "/root/testdata/sf0.001", "positions")
    src, out, ck = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ck"
    schema = _land_in_time_order(spark, pos, "fecha_hora", src)
    jobs.start_stream_latest_position(spark, src, out, ck, schema, max_files=1).awaitTermination()
    cols = ["id_bus", "fecha_hora", "id_posicion"]
    got = sorted(tuple(r) for r in jobs.read_snapshot(spark, out).select(*cols).collect())
    want = sorted(tuple(r) for r in W.latest_per_key(pos.where(F.col("fecha_hora").isNotNull()), "id_bus",
                                                     ["fecha_hora"]).select(*cols).collect())
    assert got == want


def test_stream_report_gaps_equals_batch_over_several_batches(spark, scratch):
    from campuslens.operators import windows as W
    from campuslens.plans.bindings import bind
    pos = bind(spark, "/root/testdata/sf0.001", "positions")
    src, out, ck = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ck"
    schema = _land_in_time_order(spark, pos, "fecha_hora", src)
    jobs.start_stream_report_gaps(spark, src, out, ck, schema, max_files=1).awaitTermination()
    streamed = spark.read.parquet(out)
    assert streamed.where("tardia").count() == 0
    got = sorted((r.id_posicion, r.minutos, r.alerta) for r in streamed.collect())
    batch = W.report_gaps(pos.where(F.col("fecha_hora").isNotNull()), "id_bus", "fecha_hora", 15,
                          id_col="id_posicion")
    want = sorted((r.id_posicion, r.minutos, r.alerta) for r in batch.collect())
    assert got == want


def test_long_running_trigger_with_files_arriving(spark, scratch):
    src, out, ck = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ck"
    schema = land(spark, [pos(1, 1, "2024-01-01 10:00:00")], POS, src)
    q = jobs.start_stream_latest_position(spark, src, out, ck, schema, trigger={"processingTime": "1 second"})
    try:
        q.processAllAvailable()
        land(spark, [pos(2, 1, "2024-01-01 11:00:00"), pos(3, 2, "2024-01-01 09:00:00")], POS, src)
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.id_bus, r.id_posicion) for r in jobs.read_snapshot(spark, out).collect())
    assert got == [(1, 2), (2, 3)]

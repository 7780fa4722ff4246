"""Order inside keys by segments: against plain Python, without jobs, and with one hot key."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from campuslens.operators import changes as CH
from campuslens.operators import joins as J
from campuslens.operators import windows as W
from campuslens.plans import segmented
from campuslens.streaming import jobs

SF = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)
POS = "id_posicion long, id_bus long, fecha_hora timestamp_ntz"


def rows(seed, n=400, hot=0.5):
    r = random.Random(seed)
    out = [(i, 1 if r.random() < hot else r.choice([None, 2, 3, 4]),
            None if r.random() < 0.05 else START + timedelta(minutes=r.randrange(0, 60 * 24 * 20, 7))) for i in range(n)]
    return out + out[:25]


def in_order(data):
    by = defaultdict(list)
    for i, k, t in data:
        by[k].append((t is None, t or START, i, k, t))
    return {k: sorted(v) for k, v in by.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_previous_and_numbers_equal_plain_python(spark, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, POS)
    want, numbers = [], []
    for k, v in in_order(data).items():
        for n, (a, b) in enumerate(zip([None, *v], v)):
            want.append((b[2], k, b[4], a and a[4], a and a[2]))
            numbers.append((b[2], k, n + 1))
    got = segmented.previous(df, ["id_bus"], ["fecha_hora", "id_posicion"], ["fecha_hora", "id_posicion"], "p_")
    assert got.columns == [*df.columns, "p_fecha_hora", "p_id_posicion"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    one = segmented.previous(df, ["id_bus"], ["fecha_hora", "id_posicion"], ["fecha_hora"], "p_")
    assert sorted(map(repr, map(tuple, one.collect()))) == sorted(repr(w[:4]) for w in want)
    got = segmented.row_number(df, ["id_bus"], ["fecha_hora", "id_posicion"], "n").select("id_posicion", "id_bus", "n")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, numbers))


def test_segments_of_numbers_dates_and_text(spark):
    df = spark.createDataFrame([(1, v, str(v % 3), START.date() + timedelta(days=v)) for v in range(-20, 20)],
                               "k long, v long, s string, d date")
    for by, width in (("v", 7), ("d", 3), ("s", None)):
        got = segmented.row_number(df, ["k"], [by, "v"], "n", width).collect()
        assert [r["n"] for r in sorted(got, key=lambda r: (r[by], r["v"]))] == list(range(1, 41))


def test_a_value_before_the_first_row(spark):
    df = spark.createDataFrame(rows(3, 60), POS).where("fecha_hora IS NOT NULL")
    before = spark.createDataFrame([(1, START - timedelta(days=9)), (None, START - timedelta(days=8))], "id_bus long, fecha_hora timestamp_ntz")
    got = segmented.previous(df, ["id_bus"], ["fecha_hora", "id_posicion"], ["fecha_hora"], "p_", before=before).collect()
    firsts = {k: v[0] for k, v in in_order([(r["id_posicion"], r["id_bus"], r["fecha_hora"]) for r in got]).items()}
    first = {k: [r["p_fecha_hora"] for r in got if r["id_posicion"] == f[2]][0] for k, f in firsts.items()}
    known = {1: START - timedelta(days=9), None: START - timedelta(days=8)}
    assert {k: min(v for v in [x["p_fecha_hora"] for x in got if x["id_bus"] == k] if v is not None) if k in known else first[k]
            for k in first} == {k: known.get(k) for k in first}


@pytest.mark.parametrize("key", ["report_gaps_by_key", "running_visits_by_user", "fleet_alerts_per_bus", "change_report", "route_path"])
def test_building_starts_no_job_and_leaves_no_table(spark, key):
    E.queries()[key](spark, SF)  # schemas of the inputs are read here
    tables = set(t.name for t in spark.catalog.listTables("campuslens_scratch")) if spark.catalog.databaseExists("campuslens_scratch") else set()
    tracker, group = spark.sparkContext.statusTracker(), f"build-{key}"
    inputs = {}
    read = type(spark.read).parquet

    def cached(self, *paths, **options):
        spark.sparkContext.setJobGroup("inputs", "")
        if paths not in inputs:
            inputs[paths] = read(self, *paths, **options)
        spark.sparkContext.setJobGroup(group, "")
        return inputs[paths]

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(spark.read), "parquet", cached)
        spark.sparkContext.setJobGroup(group, "")
        out = E.queries()[key](spark, SF)
    assert list(tracker.getJobIdsForGroup(group)) == []
    spark.sparkContext.setJobGroup("", "")
    assert out.count() > 0
    left = set(t.name for t in spark.catalog.listTables("campuslens_scratch")) if spark.catalog.databaseExists("campuslens_scratch") else set()
    assert left == tables


def spread(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().collect()


def test_one_bus_with_all_rows_is_in_many_tasks(spark):
    hot = spark.createDataFrame([(i, 1, START + timedelta(hours=i)) for i in range(2000)], POS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r["count"] for r in spread(W.report_gaps(hot, "id_bus", "fecha_hora", id_col="id_posicion"))]
        assert len(parts) >= 4 and max(parts) < 1000
        changes = spark.createDataFrame([(1, i * 1000, "U", f"n{i}") for i in range(2000)], "k long, seq long, op string, v string")
        base = spark.createDataFrame([(1, "old")], "k long, v string")
        parts = [r["count"] for r in spread(CH.change_report(base, changes, "k"))]
        assert sum(parts) == 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


CODES = "id_qr long, id_aula long, codigo_qr string, fecha_generacion timestamp_ntz, valido_hasta timestamp_ntz"


def test_codes_of_one_room_are_cut_in_many_tasks_and_agree_with_plain_python(spark):
    r = random.Random(4)
    codes = []
    for i in range(300):
        at = START + timedelta(hours=r.randrange(24 * 60))
        codes.append((i, 5 if i % 3 else 6, f"c{i % 50}", at, at + timedelta(hours=r.choice([-1, 0, 5, 24 * 7, 24 * 30]))))
    scans = [(i, r.choice([5, 6, 7, None]), f"c{r.randrange(50)}",
              None if i % 40 == 0 else START + timedelta(hours=r.randrange(-50, 24 * 70))) for i in range(400)]
    c = spark.createDataFrame(codes, CODES)
    s = spark.createDataFrame(scans, "id_profesor long, id_aula long, codigo_qr string, hora_scan timestamp_ntz")
    want = []
    for p, room, text, at in scans:
        valid = [x for x in codes if at is not None and x[1] == room and x[3] <= at <= x[4]]
        best = max(valid, key=lambda x: (x[3], x[0])) if valid else (None, None, None)
        want.append((p, room, text, at, best[0], best[2], bool(valid) and best[2] == text))
    got = J.validate_attendance(s, c)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len(spread(J.code_intervals(c.where("id_aula = 5")))) >= 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_stream_gaps_are_the_same_for_any_cut_into_batches_and_rejects_are_kept(spark, scratch):
    data = sorted(rows(7, 200), key=lambda x: (x[2] is None, x[2] or START, x[0]))
    data = [(i, k, t) for n, (i, k, t) in enumerate(dict.fromkeys(data))]
    want = None
    for cut in (1, 3, 7):
        src, out, ck, bad = (f"{scratch}/{cut}-{n}" for n in ("in", "out", "ck", "bad"))
        size = -(-len(data) // cut)
        for n in range(cut):
            df = spark.createDataFrame(data[n * size:(n + 1) * size], POS).coalesce(1)
            df.write.mode("append").parquet(src)
            jobs.start_stream_report_gaps(spark, src, out, ck, df.schema, reject_path=bad).awaitTermination()
        got = spark.read.parquet(out).drop("batch_id")
        assert got.where("tardia").count() == 0
        assert got.count() + spark.read.parquet(bad).count() == len(data)
        found = sorted(map(repr, map(tuple, got.select("id_posicion", "id_bus", "fecha_hora", "minutos", "alerta").collect())))
        want = want or found
        assert found == want
    batch = W.report_gaps(spark.createDataFrame(data, POS).where("id_bus IS NOT NULL AND fecha_hora IS NOT NULL"), "id_bus",
                          "fecha_hora", id_col="id_posicion").select("id_posicion", "id_bus", "fecha_hora", "minutos", "alerta")
    assert sorted(map(repr, map(tuple, batch.collect()))) == want

"""Sources with rejects, the range-partitioned order helpers on awkward
inputs, and idempotent snapshot merges."""

import pytest
import datetime as dt
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from campuslens.plans import ordered
from campuslens.sources import io
from campuslens.streaming import jobs


def test_read_json_rows_splits_rejects(spark, scratch):
    path = os.path.join(scratch, "rows.json")
    with open(path, "w") as f:
        f.write('{"id_sensor": 1, "valor": 2.5, "fecha_hora": "2024-01-01T10:00:00.000001"}\n')
        f.write('{"id_sensor": "not a number", "valor": 1}\n')
        f.write('this is not json\n')
        f.write('{"id_sensor": 2, "valor": null, "fecha_hora": null}\n')
    schema = T.StructType([T.StructField("id_sensor", T.LongType()), T.StructField("valor", T.DoubleType()),
                           T.StructField("fecha_hora", T.TimestampNTZType())])
    rows, rejects = io.read_json_rows(spark, path, schema)
    got = sorted((r.id_sensor, r.valor, r.fecha_hora) for r in rows.collect())
    assert got == [(1, 2.5, dt.datetime(2024, 1, 1, 10, 0, 0, 1)), (2, None, None)]
    assert rejects.count() == 2


def test_csv_round_trip_keeps_microseconds(spark, scratch):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 10, 0, 0, 123456))], "id long, t timestamp_ntz")
    io.export_csv(df, f"{scratch}/csv")
    back = io.read_csv(spark, f"{scratch}/csv", df.schema).collect()
    assert back[0].t == dt.datetime(2024, 1, 1, 10, 0, 0, 123456)


def test_per_key_numbering_with_null_key_and_several_hot_keys(spark):
    rows = []
    for i in range(2000):
        key = None if i % 7 == 0 else (1 if i % 3 else 2)
        rows.append((i, key, i // 4))            # repeated times: ties broken by id
    df = spark.createDataFrame(rows, "id long, k long, t long")
    out = ordered.per_key_row_number(df, "k", [F.col("t").asc(), F.col("id").asc()], {"t", "id"}, out="n", n=5)
    seen = {}
    for r in sorted(out.collect(), key=lambda r: (r.t, r.id)):
        seen.setdefault(r.k, []).append(r.n)
    assert set(seen) == {None, 1, 2}
    for seq in seen.values():
        assert seq == list(range(1, len(seq) + 1))


def test_global_previous_on_ties_and_nulls(spark):
    df = spark.createDataFrame([(i, None if i == 5 else i // 3) for i in range(40)], "id long, t long")
    out = ordered.global_previous(df, [F.col("t").asc_nulls_last(), F.col("id").asc()], {"t", "id"}, ["id"], n=4)
    order = sorted(df.collect(), key=lambda r: (r.t is None, r.t if r.t is not None else 0, r.id))
    expect = {r.id: (order[i - 1].id if i else None) for i, r in enumerate(order)}
    assert {r.id: r.prev_id for r in out.collect()} == expect


def test_snapshot_merge_is_idempotent(spark, scratch):
    path = f"{scratch}/snap"
    merge = jobs.merge_into_snapshot(path, ["k"])
    merge(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), 0)
    batch = spark.createDataFrame([(2, "b2"), (3, "c")], "k long, v string")
    merge(batch, 1)
    merge(batch, 1)                                  # replay of the same batch
    got = sorted(tuple(r) for r in jobs.read_snapshot(spark, path).collect())
    assert got == [(1, "a"), (2, "b2"), (3, "c")]


def test_append_audit_rerun_is_idempotent(spark, scratch):
    acts = spark.createDataFrame([(1, "ver", "Radio", None)], "id_usuario long, accion string, modulo string, "
                                                               "fecha_hora timestamp_ntz")
    log, foot = f"{scratch}/log", f"{scratch}/foot"
    run = io.append_audit(acts, log, foot, "2024-01-15 12:00:00")
    io.append_audit(acts, log, foot, "2024-01-15 12:00:00", run_id=run)    # retry of the same run
    io.append_audit(acts, log, foot, "2024-01-15 12:00:00")                # a new run
    assert spark.read.parquet(log).count() == 2 and spark.read.parquet(foot).count() == 2
    row = spark.read.parquet(foot).first()
    assert row.fecha_hora == dt.datetime(2024, 1, 15, 12, 0) and row.dispositivo is None


def test_order_helpers_on_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "id long, k long, t long")
    one = spark.createDataFrame([(1, 7, 3)], "id long, k long, t long")
    order = [F.col("t").asc(), F.col("id").asc()]
    for df, n in ((empty, 0), (one, 1)):
        assert ordered.global_row_number(df, order, {"t", "id"}).count() == n
        assert ordered.global_previous(df, order, {"t", "id"}, ["t"]).count() == n
        assert ordered.per_key_row_number(df, "k", order, {"t", "id"}).count() == n
    assert ordered.global_row_number(one, order, {"t", "id"}).first().rn == 1
    assert ordered.global_previous(one, order, {"t", "id"}, ["t"]).first().prev_t is None


def test_ranges_stay_balanced_with_a_hot_key_and_repeated_times(spark):
    # a third of the rows share one key and one timestamp
    df = spark.range(30000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 97).alias("t"))
    r = ordered.ranged(df, [F.col("k").asc(), F.col("t").asc()], {"k", "t"}, n=8)
    sizes = [row.c for row in r.groupBy("_pid").agg(F.count(F.lit(1)).alias("c")).collect()]
    assert len(sizes) == 8
    assert max(sizes) <= 2 * (30000 / 8), sizes


def test_snapshot_keeps_two_slots(spark, scratch):
    path = f"{scratch}/snap2"
    merge = jobs.merge_into_snapshot(path, ["k"])
    for b in range(5):
        merge(spark.createDataFrame([(b % 3, f"v{b}")], "k long, v string"), b)
    assert sorted(os.listdir(path)) == ["slot=0", "slot=1"]
    got = sorted(tuple(r) for r in jobs.read_snapshot(spark, path).collect())
    assert got == [(0, "v3"), (1, "v4"), (2, "v2")]


def test_ranged_tables_live_in_scratch_database(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "id long, k long")
    out = ordered.global_row_number(df, [F.col("id").asc()], {"id"})
    assert out.count() == 50
    assert ordered.drop_ranged_tables(spark) >= 1
    assert ordered.drop_ranged_tables(spark) == 0


def test_checkpoint_dir_from_session_wins(spark):
    from campuslens.session import ensure_checkpoint_dir, scratch_path
    current = spark.conf.get("spark.checkpoint.dir")
    assert ensure_checkpoint_dir(spark, "/somewhere/else") == current      # never overridden once set
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(current.rstrip("/") + "/x-")


def test_csv_round_trip_of_awkward_texts(spark, scratch):
    rows = [(1, 'a "quoted" text'), (2, "two\nlines, one comma"), (3, ""), (4, None), (5, "  blanks  "), (6, "back\\slash\\")]
    df = spark.createDataFrame(rows, "id long, t string")
    io.export_csv(df, f"{scratch}/csv")
    assert sorted(tuple(r) for r in io.read_csv(spark, f"{scratch}/csv", df.schema).collect()) == rows


def test_no_folder_is_chosen_where_executors_have_disks_of_their_own(spark, monkeypatch):
    from campuslens import session

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    monkeypatch.delenv("CAMPUSLENS_CHECKPOINT_DIR", raising=False)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        Context.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.ensure_checkpoint_dir(Session())


def test_a_scratch_database_that_cannot_be_made_raises(spark, monkeypatch):
    from campuslens.plans import ordered

    class Broken:
        conf, sparkContext = spark.conf, spark.sparkContext

        @staticmethod
        def sql(text):
            raise ValueError("no catalog")

    with pytest.raises(ValueError, match="no catalog"):
        ordered._scratch_database(Broken())


def test_a_range_without_a_bucket_key_raises(spark, monkeypatch):
    from pyspark.sql import functions as F

    from campuslens.plans import ordered
    monkeypatch.setattr(ordered, "_bucket_keys", lambda spark, n: spark.createDataFrame([(0, 0)], "_pid long, _bk long"))
    with pytest.raises(Exception, match="no bucket key"):
        ordered.ranged(spark.range(100), [F.col("id").asc()], {"id"}, n=4)


def test_a_deep_page_is_that_of_the_whole_order(spark, monkeypatch):
    import datetime as dt
    import random

    from campuslens.sources import io
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b", "\u00e9", ""]), rng.choice([None, 1.5, -2.0, 7.25]), rng.randrange(40),
             dt.datetime(2024, 1, 1 + rng.randrange(3), rng.randrange(24))) for _ in range(1500)] + [("a", 1.5, 3, None)] * 300
    df = spark.createDataFrame(rows, "`a b` string, x double, n long, at timestamp").repartition(5)
    sort = [("a b", False), ("x", True)]

    def pages():
        return [[tuple(r) for r in io.browse_page(df, sort=sort, page=p, size=70).collect()] for p in (0, 3, 11, 25, 26)]
    plain = pages()
    monkeypatch.setattr(io, "SHALLOW", 50)
    monkeypatch.setattr(io, "_SAMPLE", 60)
    monkeypatch.setattr(io, "_PIVOTS", 5)
    assert pages() == plain and len(plain[3]) == 50 and plain[4] == []
    narrowed, before = io._around(df, sort + [("n", True), ("at", True)],
                                  [df["`a b`"].desc_nulls_last(), df.x.asc_nulls_first(), df.n.asc_nulls_first(), df["at"].asc_nulls_first()], 770, 70)
    assert before <= 770 < before + narrowed.count() < 1800

"""Structured Streaming versions of the ingest and alert jobs.

The reference inserts one row per HTTP call and pages poll; here each job
is a ``readStream`` over a folder of files with a declared schema and a
checkpointed sink.  Every ``start_*`` returns the running
``StreamingQuery``; pass ``trigger={"availableNow": True}`` to drain the
folder and stop (tests and the registered queries do that).

Event time: campus tables use ``timestamp_ntz``, but watermarks need
``timestamp``.  ``instant``/``wall`` convert between the two as if the
wall-clock time were UTC, so windows do not depend on the session zone.

Sinks that receive updates (latest position, running audience) are
merged into a snapshot kept in two alternating slots; each batch reads
the newest earlier snapshot and overwrites the other slot, so a re-run
of a batch after a failure rewrites the same slot (idempotent) and
storage stays at two snapshots.  Append-only sinks are Parquet with the checkpoint's
exactly-once log, or per-batch folders written by ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..operators import joins as J
from ..plans import segmented
from ..sources import io

AVAILABLE_NOW = {"availableNow": True}
# Every ``start_*`` takes ``max_files`` (``maxFilesPerTrigger``): the number
# of landed files per micro-batch, which bounds the batch size and so the
# rows one key can bring to one task in a batch.


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def instant(ts) -> Column:
    """``timestamp_ntz`` wall clock -> ``timestamp`` instant, read as UTC."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), C.col(ts)))


def wall(ts) -> Column:
    """``timestamp`` instant -> ``timestamp_ntz`` wall clock in UTC."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(C.col(ts)), _epoch())


def source(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark dropped as too late, summed over the progress
    reports the query still holds (``numRowsDroppedByWatermark``)."""
    total = 0
    for p in query.recentProgress:
        for op in p.get("stateOperators", []) if isinstance(p, dict) else p.stateOperators:
            n = op.get("numRowsDroppedByWatermark", 0) if isinstance(op, dict) else op.numRowsDroppedByWatermark
            total += int(n or 0)
    return total


def _start(writer, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()


# ------------------------------------------------------------- snapshot sinks


def _init_slots(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Create both snapshot slots empty if they do not exist yet (save mode
    ``ignore`` leaves existing slots untouched, e.g. on a restart)."""
    empty = spark.createDataFrame([], T.StructType(
        [f for f in schema.fields if f.name != "_batch"] + [T.StructField("_batch", T.LongType())]))
    for slot in (0, 1):
        empty.write.mode("ignore").parquet(f"{path}/slot={slot}")


def _slot_batches(spark: SparkSession, path: str) -> dict[int, int]:
    """Batch id held by each non-empty snapshot slot."""
    out = {}
    for slot in (0, 1):
        b = spark.read.parquet(f"{path}/slot={slot}").agg(F.max("_batch")).first()[0]
        if b is not None:
            out[slot] = int(b)
    return out


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest merged snapshot of an update-mode sink."""
    slots = _slot_batches(spark, path)
    slot = max(slots, key=slots.get) if slots else 0
    return spark.read.parquet(f"{path}/slot={slot}").drop("_batch")


def merge_into_snapshot(path: str, keys: list[str]):
    """``foreachBatch`` function: the batch's updated rows replace the rows
    of the same keys in the newest earlier snapshot, and the result is
    written to the other of two slots.  Storage stays at two snapshots;
    a replayed batch finds the same earlier snapshot and rewrites its own
    slot, so replays are idempotent."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _init_slots(spark, path, batch.schema)
        slots = {k: v for k, v in _slot_batches(spark, path).items() if v < batch_id}
        rows = batch.withColumn("_batch", F.lit(batch_id).cast("long"))
        if slots:
            prev_slot = max(slots, key=slots.get)
            prev = spark.read.parquet(f"{path}/slot={prev_slot}")
            new = (prev.join(batch.select(*keys), keys, "left_anti")
                   .withColumn("_batch", F.lit(batch_id).cast("long"))
                   .unionByName(rows.select(*prev.columns)))
            target = 1 - prev_slot
        else:
            new, target = rows, 0
        new.write.mode("overwrite").parquet(f"{path}/slot={target}")
    return merge


def merge_into_partitions(path: str, keys: list[str], part: str, part_of: Column):
    """``foreachBatch`` function: as ``merge_into_snapshot``, but only the partitions that the batch touches are
    read and rewritten.  ``part`` is the name of the partition column and ``part_of`` its value, a whole number.

    Each partition has two slots.  The batch's rows and the partition's other rows (of its newest earlier slot) go
    to the other slot, by one write that replaces just these folders.  All rows of a slot carry the batch that wrote
    it, so a replayed batch sees what it saw the first time and writes the same slots again."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn(part, part_of.cast("long")).persist()
        stored = T.StructType([*rows.schema.fields, T.StructField("_batch", T.LongType()), T.StructField("_slot", T.IntegerType())])
        spark.createDataFrame([], stored).write.mode("ignore").parquet(path)
        touched = rows.select(part).distinct()
        old = spark.read.schema(stored).parquet(path).join(touched, part, "left_semi").where(F.col("_batch") < batch_id)
        newest = old.groupBy(part).agg(F.max(F.struct("_batch", "_slot"))["_slot"].alias("_newest"))
        kept = (old.join(newest, part).where("_slot = _newest").join(rows.select(*keys), keys, "left_anti")
                .select(*rows.columns))
        merged = kept.unionByName(rows).join(newest, part, "left").select(
            *rows.columns, F.lit(batch_id).cast("long").alias("_batch"), (1 - F.coalesce("_newest", F.lit(1))).alias("_slot"))
        (merged.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(part, "_slot").parquet(path))
        rows.unpersist()
    return merge


def read_partitions(spark: SparkSession, path: str, schema: T.StructType, part: str) -> DataFrame:
    """The newest slot of every partition that ``merge_into_partitions`` wrote; ``schema`` is that of its batches."""
    stored = T.StructType([*schema.fields, T.StructField("_batch", T.LongType()), T.StructField(part, T.LongType()),
                           T.StructField("_slot", T.IntegerType())])
    rows = spark.read.schema(stored).parquet(path)
    newest = rows.groupBy(part).agg(F.max(F.struct("_batch", "_slot"))["_slot"].alias("_slot"))
    return rows.join(newest, [part, "_slot"], "left_semi").select(*schema.names)


def write_batch_folder(path: str, transform=None):
    """``foreachBatch`` function writing each batch to its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


# ------------------------------------------------------------- jobs


def start_stream_readings(spark, in_path, out_path, checkpoint, schema, max_files: int | None = None, trigger=AVAILABLE_NOW) -> StreamingQuery:
    """Sensor rows (id_sensor, valor, fecha_hora) -> date and time of day
    split -> appended to Parquet."""
    rows = source(spark, in_path, schema, max_files)
    out = rows.select("id_sensor", "valor", F.to_date("fecha_hora").alias("fecha"),
                      C.seconds_of_day("fecha_hora").alias("hora"))
    return _start(out.writeStream.format("parquet").option("path", out_path).outputMode("append"),
                  checkpoint, trigger)


def start_stream_rejects(spark, in_path, reject_path, checkpoint, schema, time_col="fecha_hora",
                         max_files: int | None = None, trigger=AVAILABLE_NOW) -> StreamingQuery:
    """Rows without an event time (they cannot be placed in time order)."""
    rows = source(spark, in_path, schema, max_files).where(F.col(time_col).isNull())
    return _start(rows.writeStream.format("parquet").option("path", reject_path).outputMode("append"),
                  checkpoint, trigger)


def start_stream_latest_position(spark, in_path, out_path, checkpoint, schema,
                                 max_files: int | None = None, trigger=AVAILABLE_NOW) -> StreamingQuery:
    """Current row per bus: a streaming max-aggregation (newest time, ties
    by position id) in update mode, merged into a snapshot per batch.
    Rows without a time are left to ``start_stream_rejects``.  The state
    holds one row per bus (a fleet-sized table)."""
    rows = source(spark, in_path, schema, max_files)
    timed = rows.where(F.col("fecha_hora").isNotNull())
    rest = [c for c in schema.fieldNames() if c not in ("id_bus", "fecha_hora", "id_posicion")]
    best = F.max(F.struct(F.col("fecha_hora"), F.col("id_posicion"), *[F.col(c) for c in rest])).alias("_b")
    latest = timed.groupBy("id_bus").agg(best).select(
        "id_bus", *[F.col(f"_b.{c}").alias(c) for c in ["fecha_hora", "id_posicion"] + rest])
    return _start(latest.writeStream.outputMode("update").foreachBatch(merge_into_snapshot(out_path, ["id_bus"])),
                  checkpoint, trigger)


def start_stream_activity_by_module(spark, in_path, out_path, checkpoint, schema, window="1 hour",
                                    watermark="10 minutes", max_files: int | None = None, trigger=AVAILABLE_NOW) -> StreamingQuery:
    """Actions per module per tumbling window; a window is written once the
    watermark passes its end (append mode); later rows are dropped."""
    rows = source(spark, in_path, schema, max_files).withColumn("_t", instant("fecha_hora")).withWatermark("_t", watermark)
    agg = rows.groupBy(F.window("_t", window).alias("w"), "modulo").agg(F.count(F.lit(1)).alias("total"))
    out = agg.select(wall("w.start").alias("inicio"), wall("w.end").alias("fin"), "modulo", "total")
    return _start(out.writeStream.format("parquet").option("path", out_path).outputMode("append"),
                  checkpoint, trigger)


def start_stream_connected_users(spark, in_path, out_path, checkpoint, schema, window="5 minutes",
                                 slide="1 minute", watermark="10 minutes", max_files: int | None = None, trigger=AVAILABLE_NOW) -> StreamingQuery:
    """Distinct users per sliding window.  Streaming ``countDistinct`` is not
    supported, so (window, user) pairs are de-duplicated with the watermark
    bounding their state, then counted per window (append mode)."""
    rows = (source(spark, in_path, schema, max_files).where(F.col("id_usuario").isNotNull())
            .withColumn("_t", instant("fecha_hora")).withWatermark("_t", watermark))
    pairs = rows.select(F.window("_t", window, slide).alias("w"), "id_usuario").dropDuplicates(["w", "id_usuario"])
    agg = pairs.groupBy("w").agg(F.count(F.lit(1)).alias("usuarios"))
    out = agg.select(wall("w.start").alias("inicio"), wall("w.end").alias("fin"), "usuarios")
    return _start(out.writeStream.format("parquet").option("path", out_path).outputMode("append"),
                  checkpoint, trigger)


def fleet_alert_rows(rows: DataFrame, max_speed: float = 60) -> DataFrame:
    """Stateless alerts of one position row: over ``max_speed`` and stopped."""
    kinds = F.array(
        F.when(F.col("velocidad") > max_speed, F.struct(F.lit("exceso_velocidad").alias("tipo"),
                                                        F.col("velocidad").cast("double").alias("valor"))),
        F.when(F.col("velocidad") == 0, F.struct(F.lit("detenido").alias("tipo"),
                                                 F.lit(None).cast("double").alias("valor"))))
    keep = ["id_posicion", "id_bus", "fecha_hora", "direccion"]
    return (rows.select(*keep, F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("_a"))
            .select(*keep, "_a.tipo", "_a.valor"))


def start_stream_fleet_alerts(spark, in_path, out_path, checkpoint, schema, max_speed=60,
                              max_files: int | None = None, trigger=AVAILABLE_NOW) -> StreamingQuery:
    out = fleet_alert_rows(source(spark, in_path, schema, max_files), max_speed)
    return _start(out.writeStream.format("parquet").option("path", out_path).outputMode("append"),
                  checkpoint, trigger)


def report_gap_batches(out_path: str, last_path: str, minutes: float = 15, reject_path: str | None = None):
    """``foreachBatch`` function of ``start_stream_report_gaps``.

    What a batch needs of the earlier ones is the last time of each bus, a
    snapshot like those of the update-mode sinks.  Gaps inside the batch come
    from ``plans.segmented``, so a bus that brings most of a backfill is
    spread over its days; the first report of each bus looks at the snapshot.
    A replayed batch reads the same earlier snapshot and writes the same
    folder and slot."""
    merge = merge_into_snapshot(last_path, ["id_bus"])

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        placed = F.col("fecha_hora").isNotNull() & F.col("id_bus").isNotNull()
        if reject_path:
            batch.where(~placed).write.mode("overwrite").parquet(f"{reject_path}/batch_id={batch_id}")
        rows = batch.where(placed).select("id_posicion", "id_bus", "fecha_hora")
        _init_slots(spark, last_path, rows.select("id_bus", "fecha_hora").schema)
        earlier = {k: v for k, v in _slot_batches(spark, last_path).items() if v < batch_id}
        if earlier:
            last = spark.read.parquet(f"{last_path}/slot={max(earlier, key=earlier.get)}").select("id_bus", "fecha_hora")
        else:
            last = spark.createDataFrame([], rows.select("id_bus", "fecha_hora").schema)
        marked = rows.join(last.withColumnRenamed("fecha_hora", "_last"), "id_bus", "left").withColumn(
            "tardia", F.coalesce(F.col("fecha_hora") < F.col("_last"), F.lit(False))).drop("_last")
        on_time = marked.where("NOT tardia")
        gaps = segmented.previous(on_time, ["id_bus"], ["fecha_hora", "id_posicion"], ["fecha_hora"], "_prev_", before=last)
        gaps = gaps.withColumn("minutos", C.minutes_between("_prev_fecha_hora", "fecha_hora")).drop("_prev_fecha_hora")
        out = gaps.unionByName(marked.where("tardia").withColumn("minutos", F.lit(None).cast("double")))
        out = out.withColumn("alerta", F.coalesce(F.col("minutos") > minutes, F.lit(False)))
        out.select("id_posicion", "id_bus", "fecha_hora", "minutos", "alerta", "tardia").write.mode("overwrite").parquet(
            f"{out_path}/batch_id={batch_id}")
        merge(on_time.groupBy("id_bus").agg(F.max("fecha_hora").alias("fecha_hora")), batch_id)
    return run


def start_stream_report_gaps(spark, in_path, out_path, checkpoint, schema, minutes=15, max_files: int | None = None,
                             trigger=AVAILABLE_NOW, reject_path: str | None = None) -> StreamingQuery:
    """Per-bus gap alert.  The last seen time of each bus is kept between batches (a snapshot beside the
    checkpoint, one row a bus); inside a batch a bus's rows are taken in order of time, split by day
    (``report_gap_batches``), so no task holds a bus.  A row older than the bus's last time is marked
    ``tardia`` and gets no gap.  Rows without a time or a bus cannot be ordered: they go to ``reject_path``
    if one is given.  Read the result with ``spark.read.parquet(out_path).drop("batch_id")``."""
    rows = source(spark, in_path, schema, max_files)
    run = report_gap_batches(out_path, f"{checkpoint}-last", minutes, reject_path)
    return _start(rows.writeStream.foreachBatch(run), checkpoint, trigger)


def start_stream_wifi_severity(spark, in_path, out_path, checkpoint, schema, max_files: int | None = None, trigger=AVAILABLE_NOW) -> StreamingQuery:
    out = source(spark, in_path, schema, max_files).withColumn("severidad", C.wifi_severity("latencia", "nivel_senal", "jitter"))
    return _start(out.writeStream.format("parquet").option("path", out_path).outputMode("append"),
                  checkpoint, trigger)


def start_stream_validate_attendance(spark, in_path, out_path, checkpoint, schema, codes: DataFrame,
                                     max_files: int | None = None, trigger=AVAILABLE_NOW) -> StreamingQuery:
    """Each micro-batch of scans is validated against the (static) code
    table with the batch operator ``validate_attendance``."""
    scans = source(spark, in_path, schema, max_files)
    fn = write_batch_folder(out_path, lambda b: J.validate_attendance(b, codes))
    return _start(scans.writeStream.foreachBatch(fn), checkpoint, trigger)


_MARK = "batch long, watermark long, last_scan long, last_code long"


def attendance_batches(out_path: str, state_path: str, late_path: str, scan_schema: T.StructType, code_schema: T.StructType, delay: int):
    """``foreachBatch`` function of ``start_stream_attendance``; a row of a batch holds a ``scan`` or a ``code`` (structs).

    Kept between batches, in two alternating slots as for the snapshots: the scans that still wait, the codes that are
    still of use, and a row with the watermark.  That row is written last, so a batch that is run again starts from the
    slot that it started from the first time and writes the same slot and folders."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = {}
        for slot in (0, 1):
            place = f"{state_path}/slot={slot}/mark"
            spark.createDataFrame([], _MARK).write.mode("ignore").parquet(place)
            mark = spark.read.schema(_MARK).parquet(place).first()
            if mark and mark["batch"] < batch_id:
                marks[slot] = mark.asDict()
        slot = max(marks, key=lambda s: marks[s]["batch"], default=1)
        was, before, mine = marks.get(slot, {}), f"{state_path}/slot={slot}", f"{state_path}/slot={1 - slot}"

        batch.write.mode("overwrite").parquet(f"{mine}/rows")
        rows = spark.read.schema(batch.schema).parquet(f"{mine}/rows")
        times = {"scan": J.micros("scan.hora_scan"), "code": J.micros("code.fecha_generacion")}
        late, found = was.get("watermark"), rows.agg(*(F.max(t).alias(n) for n, t in times.items())).first()
        newest = {n: max((x for x in (was.get(f"last_{n}"), found[n]) if x is not None), default=None) for n in times}
        passed = late
        if None not in newest.values():  # a stream without a row so far holds the watermark back
            passed = max(x for x in (late, min(newest.values()) - delay) if x is not None)

        def known(name: str, schema: T.StructType) -> DataFrame:
            on_time = F.lit(True) if late is None else times[name] > late
            fresh = rows.where(F.col(name).isNotNull() & on_time).select(f"{name}.*")
            return spark.read.schema(schema).parquet(f"{before}/{name}s").union(fresh) if was else fresh

        scans, codes = known("scan", scan_schema), known("code", code_schema)
        never = F.lit(False)
        due = never if passed is None else J.micros("hora_scan") <= passed
        started = never if passed is None else J.micros("fecha_generacion") <= passed
        ended = never if passed is None else J.micros("valido_hasta") <= passed
        J.validate_attendance(scans.where(due), codes.where(started)).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        if late is not None:
            rows.where(F.coalesce(*times.values()) <= late).write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
        scans.where(~due).write.mode("overwrite").parquet(f"{mine}/scans")
        codes.where(~ended).write.mode("overwrite").parquet(f"{mine}/codes")
        spark.createDataFrame([(batch_id, passed, newest["scan"], newest["code"])], _MARK).coalesce(1).write.mode("overwrite").parquet(f"{mine}/mark")
    return run


def start_stream_attendance(spark, scans_path, codes_path, out_path, checkpoint, scan_schema, code_schema, validity="7 days",
                            delay="1 hour", max_files: int | None = None, trigger=AVAILABLE_NOW, late_path: str | None = None) -> StreamingQuery:
    """Verdicts of ``validate_attendance`` for scans and codes that both arrive as streams.

    A scan is judged when the watermark (``delay`` behind the slower stream) has passed its time: no code can come
    any more that starts before it, so the verdict doesn't depend on how the rows were cut into batches.  Until then
    it waits in a table beside the checkpoint (``attendance_batches``).  A code may be valid for ``validity`` at most
    (a longer one stops the query with an error) and leaves its table when no scan of its time can come.  The scans that
    are due meet the codes cut into disjoint pieces, so a scan meets one code however many are valid at its time.
    Each scan gets its verdict, also one equal to another, and also after a restart.

    Rows later than the watermark are not judged: they go to ``late_path`` (``<checkpoint>-late`` if none is given),
    as ``scan`` or ``code``.  Scans without a time cannot be judged: see
    ``start_stream_rejects(..., time_col="hora_scan")``.  Read the result with ``spark.read.parquet(out_path).drop("batch_id")``."""
    wait = spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {delay}"))).first()[0]
    scans = source(spark, scans_path, scan_schema, max_files).where("hora_scan IS NOT NULL")
    codes = source(spark, codes_path, code_schema, max_files).where("fecha_generacion <= valido_hasta")
    too_long = instant("valido_hasta") > instant("fecha_generacion") + F.expr(f"INTERVAL {validity}")
    error = F.raise_error(F.lit(f"a code is valid for longer than {validity}")).cast(code_schema["valido_hasta"].dataType)
    codes = codes.withColumn("valido_hasta", F.when(too_long, error).otherwise(F.col("valido_hasta")))
    both = scans.select(F.struct("*").alias("scan"), F.lit(None).cast(code_schema).alias("code")).union(
        codes.select(F.lit(None).cast(scan_schema).alias("scan"), F.struct("*").alias("code")))
    run = attendance_batches(out_path, f"{checkpoint}-state", late_path or f"{checkpoint}-late", scan_schema, code_schema, wait)
    return _start(both.writeStream.foreachBatch(run), checkpoint, trigger)


def start_stream_audit_fanout(spark, in_path, log_path, footprint_path, checkpoint, schema, as_of,
                              max_files: int | None = None, trigger=AVAILABLE_NOW) -> StreamingQuery:
    """Each action goes to the activity log and the footprint table.  The
    batch is staged once and copied to both, each under its batch id, so
    a replayed batch rewrites the same folders."""
    def fan(batch: DataFrame, batch_id: int) -> None:
        stage = f"{checkpoint}-staging/batch_id={batch_id}"
        io.audit_rows(batch, as_of).write.mode("overwrite").parquet(stage)
        staged = batch.sparkSession.read.parquet(stage)
        staged.write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")
        staged.write.mode("overwrite").parquet(f"{footprint_path}/batch_id={batch_id}")
    return _start(source(spark, in_path, schema, max_files).writeStream.foreachBatch(fan), checkpoint, trigger)


def start_stream_dedup_actions(spark, in_path, out_path, checkpoint, schema, key="id_registro",
                               watermark="1 day", max_files: int | None = None, trigger=AVAILABLE_NOW) -> StreamingQuery:
    """Drop repeated deliveries of the same action id arriving within the
    watermark delay of each other (the reference double-writes)."""
    rows = source(spark, in_path, schema, max_files).withColumn("_t", instant("fecha_hora")).withWatermark("_t", watermark)
    out = rows.dropDuplicatesWithinWatermark([key]).drop("_t")
    return _start(out.writeStream.format("parquet").option("path", out_path).outputMode("append"),
                  checkpoint, trigger)


def start_stream_audience(spark, in_path, out_path, checkpoint, schema, watermark="1 day",
                          max_files: int | None = None, trigger=AVAILABLE_NOW) -> StreamingQuery:
    """Running weekly plays and seconds per programme.  Weekly windows are
    offset by 4 days from the epoch (a Thursday), so they start on Monday
    like DATE_TRUNC('week').  Update mode; a batch rewrites the weeks it
    touches only.  Read the result with ``read_audience``; plays without a
    time are left to ``start_stream_rejects(..., time_col="fecha")``."""
    rows = (source(spark, in_path, schema, max_files).withColumn("_t", instant("fecha"))
            .withWatermark("_t", watermark))
    agg = rows.groupBy(F.window("_t", "7 days", "7 days", "4 days").alias("w"), "id_programa").agg(
        F.count(F.lit(1)).alias("total_reproducciones"),
        F.sum("segundos_escuchados").cast("long").alias("total_segundos"))
    out = agg.select(wall("w.start").alias("semana"), "id_programa", "total_reproducciones", "total_segundos")
    merge = merge_into_partitions(out_path, ["semana", "id_programa"], "dia_semana", F.datediff("semana", F.lit("1970-01-01").cast("date")))
    return _start(out.writeStream.outputMode("update").foreachBatch(merge), checkpoint, trigger)


def read_audience(spark: SparkSession, path: str, programme: str = "long") -> DataFrame:
    """The running audience that ``start_stream_audience`` keeps; ``programme`` is the type of its ids."""
    schema = T.StructType().add("semana", "timestamp_ntz").add("id_programa", programme)
    schema = schema.add("total_reproducciones", "long").add("total_segundos", "long")
    return read_partitions(spark, path, schema, "dia_semana")

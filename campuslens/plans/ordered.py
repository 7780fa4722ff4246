"""Global order without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one
task.  The reference computes running numbers and "previous row" gaps
over a whole table (or over one bus that may hold a large share of the
rows), so these helpers split the order into ranges instead:

1. ``repartitionByRange(n, order)`` with an explicit ``n`` and a sort
   inside each range on the order plus every other column.
2. The position inside a range comes from ``monotonically_increasing_id``
   (it encodes the partition id in the upper bits).  The ranged frame is
   written once to the shared checkpoint folder as a table bucketed with
   exactly one range per bucket (bucket key values chosen by their Spark
   hash), so range ids and positions are read, not recomputed, and the
   per-range steps need no further exchange and stay balanced.
3. Per-range row counts and last values form a table of at most ``n``
   rows.  Prefix sums / "previous range" values over that table are the
   only single-partition step, and its size is bounded by ``n``; it is
   broadcast back.

Balanced ranges hold even when one key or one timestamp carries a large
share of the rows, because the range bounds are sampled from the full
(unique-ified) order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, scratch_path

_ATOMIC = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType,
           T.TimestampNTZType, T.BinaryType)


def _tie_break(df: DataFrame, used: set[str]) -> list[Column]:
    return [F.col(f.name).asc_nulls_first() for f in df.schema.fields
            if f.name not in used and isinstance(f.dataType, _ATOMIC)]


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _bucket_keys(spark, n: int) -> DataFrame:
    """For each range id p in [0, n), a long value whose Spark bucket id
    (``pmod(hash(v), n)``, the function bucketed tables use) is exactly p.
    Bucketing on these values puts every range in its own bucket; bucketing
    on the range id itself would hash several ranges into one bucket and
    give that task several times the average load.  Candidates are the
    first 40n integers (a bucket is missed with probability about e^-40);
    the result has n rows."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # Spark Connect: no context; one cache entry per session object
        app = str(id(spark))
    key = (app, n)
    if key not in _BUCKET_KEYS:
        cand = spark.range(0, 40 * n).select(
            F.col("id").alias("_bk"), F.pmod(F.hash(F.col("id")), F.lit(n)).cast("long").alias("_pid"))
        # depends only on n: computed once per application and kept (n rows)
        _BUCKET_KEYS[key] = cand.groupBy("_pid").agg(F.min("_bk").alias("_bk")).persist()
    return _BUCKET_KEYS[key]


_BUCKET_KEYS: dict[tuple[str, int], DataFrame] = {}


def _required(bucket: str) -> Column:
    return F.when(F.col(bucket).isNull(), F.raise_error(F.lit("a range has no bucket key")).cast("long")).otherwise(
        F.col(bucket))


def ranged(df: DataFrame, order: list[Column], used: set[str], n: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, with ``_pid`` (range
    id), ``_local`` (0-based position inside the range) and ``_bk`` (the
    bucket key: one bucket per range)."""
    n = _partitions(df, n)
    full = list(order) + _tie_break(df, used)
    r = df.repartitionByRange(n, *full).sortWithinPartitions(*full)
    pid = F.spark_partition_id().cast("long")
    r = r.select("*", pid.alias("_pid"),
                 (F.monotonically_increasing_id() - F.shiftleft(pid, 33)).alias("_local"))
    # n rows; a missed range id (not expected) is an error, never another range's bucket
    keys = _bucket_keys(df.sparkSession, n)
    r = r.join(F.broadcast(keys), "_pid", "left").withColumn("_bk", _required("_bk"))
    # Range ids and positions come from nondeterministic expressions; two
    # reads of the same lineage may be planned differently, so the frame
    # is written once (Parquet, in the shared checkpoint folder) and every
    # later step reads the same ids.  This also cuts the lineage, so a lost
    # executor never forces the range shuffle to be redone.
    # The table is bucketed with one range per bucket, so the later
    # per-range steps (the in-range ``lag``, per-range counts and last
    # values), which group on ``_bk``, find their input already clustered
    # and balanced and plan no exchange.  Each write task holds one range,
    # so the bucketed write adds no shuffle either.
    spark = df.sparkSession
    path = scratch_path(spark, "ranged")
    name = f"{_scratch_database(spark)}.ranged_" + path.rsplit("-", 1)[-1]
    r.write.format("parquet").option("path", path).bucketBy(n, "_bk").saveAsTable(name)
    return spark.table(name)


SCRATCH_DB = "campuslens_scratch"


def _scratch_database(spark) -> str:
    """The catalog database holding ranged tables (external tables whose
    files live in the shared checkpoint folder).  A catalog in which it
    cannot be created raises."""
    location = ensure_checkpoint_dir(spark).rstrip("/") + "/" + SCRATCH_DB
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {SCRATCH_DB} LOCATION '{location}'")
    return SCRATCH_DB


def drop_ranged_tables(spark) -> int:
    """Unregister the ranged tables of this session's catalog once the
    queries reading them have run (their files stay in the checkpoint
    folder, which the cluster's retention cleans).  Returns the count."""
    names = [t.name for t in spark.catalog.listTables(SCRATCH_DB)] if spark.catalog.databaseExists(SCRATCH_DB) else []
    for t in names:
        spark.sql(f"DROP TABLE IF EXISTS {SCRATCH_DB}.{t}")
    return len(names)


def global_row_number(df: DataFrame, order: list[Column], used: set[str], out: str = "rn",
                      n: int | None = None) -> DataFrame:
    """1-based row number over the whole frame in ``order``."""
    r = ranged(df, order, used, n)
    counts = r.groupBy("_bk", "_pid").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    # at most n rows: one per range
    return (r.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_local") + 1)
            .drop("_pid", "_local", "_off", "_bk"))


def global_previous(df: DataFrame, order: list[Column], used: set[str], carry: list[str],
                    prefix: str = "prev_", n: int | None = None) -> DataFrame:
    """For each row, the ``carry`` columns of the row just before it in
    ``order`` over the whole frame (NULL for the first row)."""
    r = ranged(df, order, used, n)
    w = Window.partitionBy("_bk", "_pid").orderBy("_local")
    inner = r.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in carry])
    last = r.groupBy("_bk", "_pid").agg(F.max(F.struct(F.col("_local"), *[F.col(c) for c in carry])).alias("_last"))
    wb = Window.orderBy("_pid")
    bound = last.select("_pid", *[F.lag(F.col("_last")[c]).over(wb).alias("_b_" + c) for c in carry])
    # ``bound`` has one row per non-empty range (at most n rows)
    out = inner.join(F.broadcast(bound), "_pid", "left")
    for c in carry:
        out = out.withColumn(prefix + c, F.when(F.col("_local") == 0, F.col("_b_" + c)).otherwise(F.col(prefix + c)))
    return out.drop("_pid", "_local", "_bk", *["_b_" + c for c in carry])


def per_key_row_number(df: DataFrame, key: str, order: list[Column], used: set[str], out: str = "rn",
                       n: int | None = None) -> DataFrame:
    """1-based row number inside each ``key`` in ``order``, for any key
    size.  Ranges are cut on (key, order), so a key holding most rows spans
    many ranges.  Inside a range the position comes from a window on the
    (bucketed) range id and key, which needs no exchange.  Rows of the
    key in earlier ranges are added from a carry table.

    Only a key that crosses a range boundary has rows in an earlier range,
    and each boundary is crossed by at most one key.  The carry table
    therefore has at most n rows and is broadcast."""
    r = ranged(df, [F.col(key).asc_nulls_last(), *order], used | {key}, n)
    pos = r.withColumn("_pos", F.row_number().over(Window.partitionBy("_bk", "_pid", key).orderBy("_local")))
    per = r.groupBy("_bk", "_pid", key).agg(F.count(F.lit(1)).alias("_c"))
    ends = r.groupBy("_bk", "_pid").agg(F.min(F.struct(F.col("_local"), F.col(key).alias("k")))["k"].alias("_first"),
                                 F.max(F.struct(F.col("_local"), F.col(key).alias("k")))["k"].alias("_last"))
    # keys at either end of a range: at most 2n values
    edge = ends.select(F.col("_first").alias("_e")).union(ends.select(F.col("_last").alias("_e"))).distinct()
    span = per.join(F.broadcast(edge), F.col(key).eqNullSafe(F.col("_e")), "left_semi")
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = (span.select(F.col("_pid").alias("_cp"), F.col(key).alias("_ck"), F.sum("_c").over(before).alias("_prior"))
             .where(F.col("_prior") > 0))
    j = pos.join(F.broadcast(carry), (F.col("_pid") == F.col("_cp")) & F.col(key).eqNullSafe(F.col("_ck")), "left")
    return (j.withColumn(out, F.col("_pos") + F.coalesce(F.col("_prior"), F.lit(0)))
            .drop("_pid", "_local", "_bk", "_pos", "_cp", "_ck", "_prior"))

"""Session construction and shared-storage helpers.

Library code never creates a session on its own; callers pass one in.
``build_session`` is for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
LOCAL_FOLDER = "/tmp/campuslens-checkpoints"  #: only for a local master


def build_session(master: str | None = None, cpus: int | None = None,
                  shuffle_partitions: int | None = None,
                  app_name: str = "campuslens") -> SparkSession:
    """A session configured the way the operators expect.

    AQE is on (runtime coalescing, skew-join splitting, broadcast switch),
    the session zone is UTC so that streaming windows (which need zoned
    timestamps) line up with the batch results on ``timestamp_ntz`` data.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or cpus
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CAMPUSLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.streaming.forceDeleteTempCheckpointLocation", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster's ``spark.checkpoint.dir`` always wins, then the folder the
    application set on its context, then ``fallback`` and the environment
    variable ``CAMPUSLENS_CHECKPOINT_DIR`` (both chosen by the caller).  If
    none is set, a folder on this machine is used only where driver and
    executors are one process; any other master raises, because executors
    would each write to a disk of their own.  The folder is registered with
    the session so ``DataFrame.checkpoint`` uses it too.
    """
    context = _context(spark)
    current = spark.conf.get(CHECKPOINT_KEY, None)
    if current:
        if context is not None and context.getCheckpointDir() is None:
            context.setCheckpointDir(current)
        return current
    set_on_context = context.getCheckpointDir() if context is not None else None
    if set_on_context:
        # the application chose a folder with SparkContext.setCheckpointDir;
        # its parent is the shared folder it named (Spark adds a subfolder)
        base = set_on_context.rstrip("/").rsplit("/", 1)[0]
        spark.conf.set(CHECKPOINT_KEY, base)
        return base
    path = fallback or os.environ.get("CAMPUSLENS_CHECKPOINT_DIR")
    if not path:
        master = context.master if context is not None else "a remote session"
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"{master}: set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        path = LOCAL_FOLDER
    spark.conf.set(CHECKPOINT_KEY, path)
    if context is not None:
        context.setCheckpointDir(path)
    return path


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None for a Spark Connect
    session, which has none (the folder is then read from the conf only)."""
    try:
        return spark.sparkContext
    except Exception:
        return None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never reused)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"

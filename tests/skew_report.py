"""Task balance under a hot key, read from Spark's event log.

Runs the per-bus operators on positions where one bus holds a third of
the rows, with the event log written to a fresh scratch folder, then
prints per stage: tasks, the largest task's input records and its share
of the stage's records.  A balanced plan keeps every share near 1/tasks
even though one key has a third of the rows.

    python tests/skew_report.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main(sf_dir: str = "/root/testdata/sf0.1") -> None:
    from pyspark.sql import SparkSession

    from campuslens.operators import windows as W
    from campuslens.plans.bindings import BINDINGS, Binding, bind
    from campuslens.session import ensure_checkpoint_dir

    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (SparkSession.builder.master("local[8]").appName("skew-report")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", scratch)
             .config("spark.eventLog.compress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, os.path.join(scratch, "checkpoints"))

    base = BINDINGS["positions"]
    BINDINGS["positions_hot_bus"] = Binding(base.table, tuple(
        "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS id_bus" if e == "user_id AS id_bus" else e
        for e in base.exprs))
    jobs = {
        "latest_per_key": lambda: W.latest_per_key(bind(spark, sf_dir, "positions_hot_bus"), "id_bus", ["fecha_hora"]),
        "report_gaps_by_key": lambda: W.report_gaps(bind(spark, sf_dir, "positions_hot_bus"), "id_bus", "fecha_hora",
                                                    15, id_col="id_posicion"),
        "running_visits_by_bus": lambda: W.running_visits(bind(spark, sf_dir, "positions_hot_bus"), "fecha_hora",
                                                          by="id_bus", id_col="id_posicion"),
    }
    for name, build in jobs.items():
        spark.sparkContext.setJobDescription(name)
        build().write.format("noop").mode("overwrite").save()
    spark.stop()

    stages: dict[int, dict] = {}
    for path in glob.glob(os.path.join(scratch, "eventlog*", "events_*")) + glob.glob(os.path.join(scratch, "local-*")):
        if not os.path.isfile(path):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerTaskEnd":
                    continue
                metrics = ev.get("Task Metrics") or {}
                recs = (metrics.get("Input Metrics", {}).get("Records Read", 0)
                        + metrics.get("Shuffle Read Metrics", {}).get("Total Records Read", 0))
                st = stages.setdefault(ev["Stage ID"], {"tasks": 0, "records": [], "ms": []})
                st["tasks"] += 1
                st["records"].append(recs)
                st["ms"].append(ev["Task Info"]["Finish Time"] - ev["Task Info"]["Launch Time"])
    print("| stage | tasks | records | largest task records | largest share | slowest task ms |")
    print("|---|---|---|---|---|---|")
    for sid in sorted(stages):
        st = stages[sid]
        total = sum(st["records"])
        if total < 1000:      # skip the per-range / metadata stages
            continue
        top = max(st["records"])
        print(f"| {sid} | {st['tasks']} | {total} | {top} | {top / total:.2f} | {max(st['ms'])} |")


if __name__ == "__main__":
    main(*sys.argv[1:])

"""Shuffle volume of the main steps, as they would run when no side is small enough to broadcast.

Runs the cleaning batch, the marts, D4 and A16 on ``sf_dir`` with broadcasting switched off and
Spark's event log written to a fresh folder, then prints per step: shuffle stages, how many of
them write at least half as many records as there are order lines ("line-size"), and the records
written to shuffle. This is the table of README "Plan review at 100 TB".

    python scripts/shuffle_report.py [sf_dir] [event_log_dir]
"""

from __future__ import annotations

import collections
import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillroll.operators import quality  # noqa: E402
from tillroll.plans import segments  # noqa: E402
from tillroll.plans.batch import CleaningBatch  # noqa: E402
from tillroll.session import local_session  # noqa: E402
from tillroll.sources.tables import fixture_tables  # noqa: E402


def run_steps(sf_dir: str, log_dir: str) -> int:
    spark = local_session(8, shuffle_partitions=16, driver_memory="16g", extra={
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.eventLog.enabled": "true",
        "spark.eventLog.dir": "file://" + log_dir,
        "spark.eventLog.compress": "false",
    })
    p = CleaningBatch(spark, lambda stage: fixture_tables(spark, sf_dir, stage), key=f"shuffles:{time.time()}")
    sc = spark.sparkContext

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    steps = [
        ("C1-C7 reconcile + enrich", lambda: p.integrated_orders()),
        ("C8-C9 multi-store insert", lambda: p.multi_store_insert()),
        ("C11 EXCEPT", lambda: p.finalised_records()),
        ("C12 repairs", lambda: p.clean_fact()),
        ("M1 customer_360", lambda: p.customer_360()),
        ("M2 orders_360", lambda: p.orders_360()),
        ("M3 store_360", lambda: p.store_360()),
        ("D4 cumulative lines", lambda: noop(quality.cumulative_lines(p.store_fixed()))),
        ("A16 revenue segments", lambda: noop(segments.revenue_segments(p.customer_360()))),
    ]
    for name, fn in steps:
        sc.setJobDescription("STEP " + name)
        fn()
    sc.setJobDescription(None)
    lines = p.t.orders.count()
    spark.stop()
    return lines


def report(log_dir: str, lines: int) -> None:
    stage_step: dict[int, str] = {}
    out: dict[str, list[int]] = collections.OrderedDict()
    for path in glob.glob(os.path.join(log_dir, "*")):
        files = sorted(glob.glob(os.path.join(path, "events*"))) if os.path.isdir(path) else [path]
        for f in files:
            for line in open(f, encoding="utf-8"):
                e = json.loads(line)
                if e["Event"] == "SparkListenerJobStart":
                    desc = (e.get("Properties") or {}).get("spark.job.description") or ""
                    for sid in e["Stage IDs"]:
                        stage_step[sid] = desc
                elif e["Event"] == "SparkListenerStageCompleted":
                    info = e["Stage Info"]
                    desc = stage_step.get(info["Stage ID"], "")
                    if not desc.startswith("STEP "):
                        continue
                    acc = {a["Name"]: a.get("Value") for a in info.get("Accumulables", [])}
                    records = int(acc.get("internal.metrics.shuffle.write.recordsWritten") or 0)
                    row = out.setdefault(desc[5:], [0, 0, 0])
                    if records:
                        row[0] += 1
                        row[1] += records >= lines // 2
                        row[2] += records
    print(f"order lines: {lines}")
    for name, (stages, big, records) in out.items():
        print(f"{name:28s} shuffle stages={stages:3d} line-size={big} records={records / 1e6:.2f} M")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="tillroll-eventlog-")
    report(log_dir, run_steps(sf_dir, log_dir))


if __name__ == "__main__":
    main()

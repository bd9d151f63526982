"""Time each job's Spark stages from the event log (no UI involved).

    python tools/profile_stages.py <sf_dir> [key ...]

Writes the event log to a fresh scratch folder and prints, per query, wall
time, number of Spark jobs and stages, and the slowest stages.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.plans.registry import QUERIES  # noqa: E402
from tessera.session import build_session  # noqa: E402


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    wanted = argv[1:] or list(QUERIES)
    log_dir = tempfile.mkdtemp(prefix="run-evlog-", dir="/tmp")
    spark = build_session(
        "local[8]", shuffle_partitions=16,
        extra={"spark.eventLog.enabled": "true", "spark.eventLog.compress": "false",
               "spark.eventLog.dir": f"file://{log_dir}"},
    )
    wall = {}
    for name in wanted:
        spark.sparkContext.setJobDescription(name)
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        wall[name] = time.perf_counter() - t0
    spark.stop()
    paths = sorted(p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p))
    job_desc, stage_job, stages = {}, {}, {}
    lines = [line for p in paths for line in open(p)]
    for line in lines:
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerJobStart":
            desc = (ev.get("Properties") or {}).get("spark.job.description", "?")
            job_desc[ev["Job ID"]] = desc
            for sid in ev.get("Stage IDs", []):
                stage_job[sid] = ev["Job ID"]
        elif kind == "SparkListenerStageCompleted":
            info = ev["Stage Info"]
            if "Completion Time" in info and "Submission Time" in info:
                stages[info["Stage ID"]] = (
                    info["Completion Time"] - info["Submission Time"], info["Number of Tasks"], info["Stage Name"][:60]
                )
    per = defaultdict(list)
    jobs = defaultdict(set)
    for sid, (ms, ntask, sname) in stages.items():
        desc = job_desc.get(stage_job.get(sid), "?")
        per[desc].append((ms, ntask, sid, sname))
        jobs[desc].add(stage_job.get(sid))
    for name in wanted:
        st = sorted(per[name], reverse=True)
        print(f"{name}: wall={wall[name]:.2f}s jobs={len(jobs[name])} stages={len(st)} stage_ms_sum={sum(s[0] for s in st)}")
        for ms, ntask, sid, sname in st[:4]:
            print(f"    {ms:6d}ms tasks={ntask:4d} stage={sid} {sname}")


if __name__ == "__main__":
    main(sys.argv[1:])

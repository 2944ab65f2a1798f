"""Per-stage times of one registered query, from Spark's event log.

Usage: python tools/stage_times.py QUERY [sf_dir]
The event log goes to a fresh scratch folder; the Spark UI stays off.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    import zstandard

    from tallyspark.plans.catalog import Q
    from tallyspark.session import get_session
    name = sys.argv[1]
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    logdir = tempfile.mkdtemp(prefix="run-")
    spark = get_session("local[8]", 16, extra={"spark.driver.memory": "16g", "spark.eventLog.enabled": "true",
                                               "spark.eventLog.dir": logdir})
    Q["pile_totals"](spark, sf).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobDescription("TARGET")
    t0 = time.time()
    Q[name](spark, sf).write.format("noop").mode("overwrite").save()
    print(f"{name}: {time.time() - t0:.2f}s")
    spark.stop()
    f = glob.glob(os.path.join(logdir, "*", "events_*"))[0]
    raw = open(f, "rb")
    stream = zstandard.ZstdDecompressor().stream_reader(raw) if f.endswith(".zstd") else raw
    jobs, target, start = {}, set(), None
    for line in io.TextIOWrapper(stream, encoding="utf-8"):
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            if e.get("Properties", {}).get("spark.job.description") == "TARGET":
                target.add(e["Job ID"])
                start = start or e["Submission Time"]
            for s in e["Stage IDs"]:
                jobs[s] = e["Job ID"]
        elif e["Event"] == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            if jobs.get(si["Stage ID"]) in target:
                d = (si["Completion Time"] - si["Submission Time"]) / 1000
                print(f"stage {si['Stage ID']:4d} job {jobs[si['Stage ID']]:3d} tasks {si['Number of Tasks']:4d} "
                      f"{d:6.2f}s  at +{(si['Submission Time'] - start) / 1000:6.2f}s  {si['Stage Name'][:40]}")


if __name__ == "__main__":
    main()

"""Time the named queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores; BENCH_QUERIES (comma-separated)
restricts the run. A query is stopped after BENCH_QUERY_SECONDS, and none begins after
BENCH_SECONDS; such queries are listed under "stopped" and "left" and have no figure. Every figure
is written to the error stream as it comes. Checkpoints go to BENCH_CHECKPOINTS, else to the
warehouse.
"""

import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tunetrail.plans.queries import QUERIES  # noqa: E402
from tunetrail.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ONLY = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
QUERY_SECONDS = float(os.environ.get("BENCH_QUERY_SECONDS", "240"))
SECONDS = float(os.environ.get("BENCH_SECONDS", "1500"))


def timed(spark, name):
    """Seconds of one query, or None if it was stopped; jobs are cancelled until the query gives up."""
    over = threading.Event()

    def stop():
        if not over.wait(QUERY_SECONDS):
            while not over.wait(1):
                spark.sparkContext.cancelAllJobs()

    watch = threading.Thread(target=stop, daemon=True)
    start = time.perf_counter()
    watch.start()
    try:
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    except Exception:
        if time.perf_counter() - start < QUERY_SECONDS:
            raise
        return None
    finally:
        over.set()
        watch.join()
    return round(time.perf_counter() - start, 3)


def main():
    conf = {"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.showConsoleProgress": "false"}
    if "BENCH_CHECKPOINTS" in os.environ:
        conf["spark.checkpoint.dir"] = os.environ["BENCH_CHECKPOINTS"]
    spark = build_session("bench", f"local[{CPUS}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds, stopped, left = {}, [], []
    began = time.perf_counter()
    for name in ONLY or QUERIES:
        if time.perf_counter() - began > SECONDS:
            left.append(name)
            continue
        took = timed(spark, name)
        print(name, "stopped" if took is None else took, file=sys.stderr, flush=True)
        if took is None:
            stopped.append(name)
        else:
            seconds[name] = took
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
                      "stopped": stopped, "left": left}))
    spark.stop()


if __name__ == "__main__":
    main()

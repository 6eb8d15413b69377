"""Headline queries, timed: median of 5 runs after a warm-up, at $BENCH_SF_DIR on local[$BENCH_CPUS].
Prints one JSON line."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from basalt.plans.base import run_sql  # noqa: E402
from basalt.plans.registry import QUERIES  # noqa: E402
from basalt.session import session  # noqa: E402

SQL = {
    "count_star": "SELECT count(*) AS n FROM lineitem",
    "point_query": "SELECT * FROM orders WHERE o_orderkey = 777",
    "range_scan": "SELECT * FROM orders WHERE o_orderkey BETWEEN 1000 AND 1099",
    "group_by_avg": "SELECT o_custkey, avg(o_totalprice) AS a FROM orders GROUP BY o_custkey",
    "filter_sort_limit": "SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC LIMIT 20",
    "sum_where": "SELECT sum(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F'",
    "join_two_tables": "SELECT c_name, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000",
}
NAMED = ["pricing_summary", "join_five_tables", "win_top_n", "agg_cube", "as_of_join", "ts_bucket_aggregates", "fts_bm25_any", "vector_knn"]


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "5"))
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    jobs = {k: (lambda s, d, t=t: run_sql(s, d, t)) for k, t in SQL.items()} | {k: QUERIES[k] for k in NAMED}
    for name, job in jobs.items():
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            job(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()

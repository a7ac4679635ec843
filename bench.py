"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs three times, from the tables to the last row; its figure is
the median.  ``bars_daily`` is part of all others: what they take beyond it is
their own.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from barwright.plans import catalogue
from barwright.session import build_session

HEADLINE = ("bars_daily", "indicator_set", "ema20", "structure_events", "order_blocks", "scores", "exit_fixed", "wf", "threshold_sweep", "selected_trades", "corr_pairs", "exit_trailing", "ml_gate")
RUNS = 3


def seconds(spark, name: str, d: str) -> float:
    began = time.time()
    catalogue.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
    spark.catalog.clearCache()
    return time.time() - began


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["bars_daily"](spark, d).count()  # starts the session up
    runs = {name: [seconds(spark, name, d) for _ in range(RUNS)] for name in HEADLINE}
    took = {name: round(median(x), 3) for name, x in runs.items()}
    own = {name: round(max(took[name] - took["bars_daily"], 0), 3) for name in HEADLINE[1:]}
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "beyond_bars_daily": own, "sf": d}))


if __name__ == "__main__":
    main()

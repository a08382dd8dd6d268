"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from terravox.plans import QUERIES  # noqa: E402
from terravox.session import build_session, ship_package  # noqa: E402

HEADLINE = [
    "cap_percentile_vs_null",
    "p2_percent_anomaly",
    "a8_area_weighted_quantile",
    "g37_spherical_smoothing",
    "g6_cost_field_calibrated",
    "g9_site_cost",
    "g10_path_price",
    "g16_corridor_widths",
    "g17_bottleneck_field",
    "c5_ensemble_class",
    "g24_components",
    "g35_axis_coherence",
    "w4_deflections",
    "a28_chain_gaps",
    "u3_linked_sets",
    "t1_spearman",
    "t3_mann_whitney",
    "c15_model_comparison",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    spark.range(1000).selectExpr("sum(id)").collect()
    times, rows = {}, {}
    for name in HEADLINE:
        t = time.time()
        df = QUERIES[name].run(spark, sf)
        # The noop sink runs the whole plan and keeps every column, without a collect.
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        rows[name] = seen.get["n"]
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rows": rows, "sf": os.path.basename(sf.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()

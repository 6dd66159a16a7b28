"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the median counts. Results are
written to the ``noop`` sink, so every row is computed and none is moved to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mapshelf.session import build_session, ship_package  # noqa: E402
from workloads import registry  # noqa: E402

HEADLINE = [
    "region_counts", "region_counts_big", "region_subset", "region_join_lines",
    "range_query_simple", "range_query_dateline", "range_query_lines", "view_feature",
    "summary_points", "summary_by_user", "summary_trips", "break_trips", "viz_features",
    "grid_partition", "str_partition", "zcurve_partition", "rsgrove_partition", "pruned_partitions",
    "assign_tiles", "tile_rollup", "tile_counts", "tile_raster",
    "catalog_search", "catalog_update", "catalog_list", "remaining_stages", "clean_links", "submission_rows",
    "to_geojson", "to_wkt", "read_csv_points", "read_index", "indexed_range_query", "ingest_dataset",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark, os.path.dirname(os.path.abspath(registry.__file__)))
    queries, times = registry.queries(), {}

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in names:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()

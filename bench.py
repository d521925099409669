"""Headline-query benchmark.

Runs each headline query over the tables in ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line.  Each
query is fully executed with the ``noop`` sink (every row computed, nothing
collected to the driver); the time is the best of ``$BENCH_REPEAT`` runs
(default 2: the first run also warms that query's code paths).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from relief.plans import catalog  # noqa: E402
from relief.plans.compose import PRODUCTS, product  # noqa: E402
from relief.schema import Grid  # noqa: E402
from relief.session import ensure_checkpoint_dir, local_session, scratch_path  # noqa: E402
from relief.sources import layers  # noqa: E402

# every named product of SURVEY section 2.10 (P9 is the point lookup k4) plus the
# core operators behind them
HEADLINE = [
    "p1_color",
    "p2_grey",
    "p3_contour",
    "p4_hillshade",
    "p5_aspect",
    "p6_slope",
    "p7_color_hillshade",
    "p8_hand",
    "k4_point_value",
    "p10_flood_summary",
    "p11_viewshed_mask",
    "p12_viewshed_polygons",
    "p13_fixed_cell_viewshed",
    "f1_slope",
    "v2_viewshed_r2",
    "z1_regions",
]


def large_raster(spark, side: int = 4096, tile: int = 256) -> tuple[str, Grid]:
    """A stored layer of ``side`` x ``side`` cells."""
    grid = Grid(0.0, 0.0, 1.0, 1.0, tile, tile)
    n = side // tile
    keys = spark.range(n * n, numPartitions=n).select((F.col("id") % n).cast("int").alias("col"), F.expr(f"cast(id div {n} as int)").alias("row"))
    gx, gy = (lambda i: F.col("col") * tile + i % tile), (lambda i: F.col("row") * tile + F.floor(i / tile))
    height = lambda i: F.floor(250 + 200 * F.sin(gx(i) / 97) * F.cos(gy(i) / 61) + (gx(i) * 7919 + gy(i) * 104729) % 50)
    data = F.transform(F.sequence(F.lit(0), F.lit(tile * tile - 1)), lambda i: F.when((gx(i) + gy(i)) % 997 != 0, height(i).cast("double")))
    path = scratch_path(spark, "bench")
    layers.write_layer(keys.withColumn("data", data), path, "large", 15, grid)
    return path, grid


def bench_large(spark, repeat: int) -> dict[str, float]:
    path, grid = large_raster(spark)
    times = {}
    for name in PRODUCTS:
        if name == "hand":
            continue
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            product(name, layers.read_layer(spark, path, "large", 15), grid).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    names = only or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="relief-bench")
    ensure_checkpoint_dir(spark)
    # warm-up: JVM, Python workers, parquet footers
    catalog.QUERIES["k4_point_value"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    errors = {}
    for name in names:
        best = None
        try:
            for _ in range(repeat):
                t0 = time.perf_counter()
                catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                best = dt if best is None else min(best, dt)
        except Exception as exc:  # a failing query must not hide the others' numbers
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
        times[name] = round(best, 3) if best is not None else None
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(v for v in times.values() if v is not None), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
    }
    if not only:
        try:
            out["raster_4096"] = bench_large(spark, repeat)
        except Exception as exc:
            errors["raster_4096"] = f"{type(exc).__name__}: {str(exc)[:200]}"
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

"""Join strategy for request-derived sides whose size Catalyst cannot estimate.

An exploded request side (polygon covers, ray samples) is estimated by
Catalyst from its *input* size, not from the ``explode`` fan-out, so a static
broadcast decision could ship an unbounded table to every executor.  Instead
the caller computes a proven upper bound of the side's row count with one
aggregate over the (small) request table -- e.g. the sum of polygon
bounding-box cells -- and only when ``bound * row_bytes`` is below
``relief.broadcastMaxBytes`` (default 64 MiB) the side is broadcast, so the big
layer streams through without a shuffle.  Beyond the bound the join is a
shuffle join on the cell index; AQE's skew-join split handles hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BYTES = 64 * 1024 * 1024


def max_broadcast_bytes(df: DataFrame) -> int:
    v = df.sparkSession.conf.get("relief.broadcastMaxBytes", None)
    return int(v) if v else DEFAULT_MAX_BYTES


def row_bound(requests: DataFrame, per_request_rows: Column) -> int:
    """One small aggregate over the request table: sum of per-request row bounds."""
    v = requests.agg(F.sum(per_request_rows.cast("double")).alias("n")).first()["n"]
    return int(v or 0)


def join_bounded(
    big: DataFrame, small: DataFrame, on: list[str], bound_rows: int, row_bytes: int, prune=None
) -> DataFrame:
    """Inner join of an exploded request side to a big layer: broadcast when the proven
    bound fits (the layer streams, no shuffle), else a sort-merge join (spills, and AQE
    splits skewed partitions).  ``prune(big) -> big`` first drops the layer's cells that
    no request can touch, so only those are shuffled."""
    if bound_rows * row_bytes <= max_broadcast_bytes(small):
        return big.join(F.broadcast(small), on)
    if prune is not None:
        big = prune(big)
    return big.join(small.hint("merge"), on)


def prune_to_tiles(cells: DataFrame, tile_keys: DataFrame, grid, bound_keys: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Keep only the cells of tiles in ``tile_keys(*keys, col, row)`` -- the layer query's
    spatial predicate as a semi-join on the tile key.  The distinct key set is broadcast
    when its proven bound (``bound_keys`` rows) fits, else shuffled."""
    from relief.functions.geo import tile_key

    col, row = tile_key(grid, "gx", "gy")
    k = tile_keys.select(*keys, "col", "row").distinct()
    k = F.broadcast(k) if bound_keys * 16 <= max_broadcast_bytes(cells) else k
    return cells.withColumn("_col", col).withColumn("_row", row).join(
        k.withColumnRenamed("col", "_col").withColumnRenamed("row", "_row"), [*keys, "_col", "_row"], "left_semi"
    ).drop("_col", "_row")

"""Zonal statistics and lookups (K1-K5).

K1-K3 follow the reference's flood statistics: every raster cell whose centre is
inside the polygon counts toward ``total`` (NODATA included); a cell is flooded
when ``value < level``; its depth class is ``ceil((level - value) / step)``,
0 when not flooded.  Ratios are HALF_UP to 4 decimals.

Polygons become row spans cut at tile borders, which meet the packed tiles with
one equi-join on (col, row); a span's cells are a slice of the tile's array, counted
where the tile is.  Neither side of the join is cells.  The spans are written once, so
Catalyst knows their size: few are broadcast to the layer's scan, many are
shuffled to the touched tiles (AQE splits a tile that many requests touch).
``groupBy(id, class)`` is partially aggregated before its
shuffle, so a polygon holding a third of all cells sends only one partial row
per (task, class).  The per-polygon roll-up then works on class rows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relief.functions.geo import map_to_grid_x, map_to_grid_y, polygon_area, tile_key
from relief.operators.rasterize import polygon_spans, tile_spans
from relief.operators.tiles import dense, few_tiles
from relief.schema import Grid, KeyBounds
from relief.session import stored


def flood_classes(requests: DataFrame, tiles: DataFrame, grid: Grid, bounds: KeyBounds | None = None) -> DataFrame:
    """K1+K2: ``(id, class, cells)``.

    ``requests``: ``(id, rings, level, step)`` in the grid's CRS, ``step > 0``
    (see :func:`relief.sources.requests.flood_requests`).  ``tiles``: ``(col, row, data)``; ``bounds``: their key bounds, to
    which polygons are clipped."""
    spans = polygon_spans(requests.select("id", "rings", "level", "step"), grid, carry=("level", "step"), bounds=bounds)
    spans = stored(tile_spans(spans, grid, ("id", "level", "step")))
    touched = stored(spans.select("col", "row").distinct())
    held = tiles.select("col", "row", "data").join(touched, ["col", "row"], "left_semi").join(spans, ["col", "row"])
    cells = held.select("id", "level", "step", F.explode(F.slice("data", F.col("at") + 1, F.col("cells"))).alias("value"))
    depth_class = F.when(
        F.col("value") < F.col("level"), F.ceil((F.col("level") - F.col("value")) / F.col("step"))
    ).otherwise(F.lit(0))
    return cells.groupBy("id", depth_class.cast("int").alias("class")).agg(F.count(F.lit(1)).alias("cells"))


def half_up_ratio(n, total, scale: int = 4):
    """HALF_UP ratio at ``scale`` decimals; NULL when total is 0 or NULL."""
    return F.round(F.try_divide(n.cast("double"), F.when(total > 0, total).cast("double")), scale)


def flood_summary(requests: DataFrame, tiles: DataFrame, grid: Grid, bounds: KeyBounds | None = None) -> DataFrame:
    """K3 / P10: one row per request ``(id, area, total, flooded, coverage, intervals)``.

    A request whose polygon covers no raster cell keeps its row with total 0 and
    NULL ratios.  ``intervals`` is MAP<STRING, DOUBLE> class -> share of cells, in the order of the classes.
    """
    classes = flood_classes(requests, tiles, grid, bounds)
    per = classes.groupBy("id").agg(
        F.sum("cells").alias("total"),
        F.sum(F.when(F.col("class") > 0, F.col("cells")).otherwise(F.lit(0))).alias("flooded"),
        F.array_sort(F.collect_list(F.struct("class", "cells"))).alias("_classes"),
    )
    out = requests.select("id", polygon_area("rings").alias("area")).join(per, "id", "left")
    total = F.coalesce(F.col("total"), F.lit(0)).cast("bigint")
    intervals = F.when(
        total > 0,
        F.map_from_entries(
            F.transform(
                "_classes",
                lambda c: F.struct(c["class"].cast("string"), half_up_ratio(c["cells"], F.col("total"))),
            )
        ),
    )
    return out.select(
        "id",
        "area",
        total.alias("total"),
        F.coalesce(F.col("flooded"), F.lit(0)).cast("bigint").alias("flooded"),
        half_up_ratio(F.col("flooded"), F.col("total")).alias("coverage"),
        intervals.alias("intervals"),
    )


def flood_class_shares(requests: DataFrame, tiles: DataFrame, grid: Grid, bounds: KeyBounds | None = None) -> DataFrame:
    """K2 in long form: ``(id, class, cells, ratio)`` -- the intervals map as rows."""
    classes = flood_classes(requests, tiles, grid, bounds)
    w = Window.partitionBy("id")
    return classes.select(
        "id", "class", "cells", half_up_ratio(F.col("cells"), F.sum("cells").over(w)).alias("ratio")
    )


def point_values(points: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """K4 on cells: ``(id, gx, gy, value)``; a point off the raster or on NODATA gets NULL."""
    p = points.select("id", map_to_grid_x(grid, "x").alias("gx"), map_to_grid_y(grid, "y").alias("gy"))
    return p.join(cells.select("gx", "gy", "value"), ["gx", "gy"], "left").select("id", "gx", "gy", "value")


def point_values_tiles(points: DataFrame, tiles: DataFrame, grid: Grid) -> DataFrame:
    """K4 on packed tiles: equi-join on the tile key, then one array access.

    The tile table is never shuffled for a small request table: Catalyst sees the
    request side's size and broadcasts it when it is under the session's
    ``autoBroadcastJoinThreshold`` (AQE re-checks at run time)."""
    gx = map_to_grid_x(grid, "x")
    gy = map_to_grid_y(grid, "y")
    col, row = tile_key(grid, gx, gy)
    p = points.select("id", gx.alias("gx"), gy.alias("gy"), col.alias("col"), row.alias("row"))
    t = tiles.select("col", "row", "data")
    j = p.join(t, ["col", "row"], "left")
    idx = (F.col("gy") - F.col("row") * grid.tile_rows) * grid.tile_cols + (F.col("gx") - F.col("col") * grid.tile_cols)
    return j.select("id", "gx", "gy", F.try_element_at("data", (idx + 1).cast("int")).alias("value"))


def quantile_ranks(data: np.ndarray, classes: int) -> np.ndarray:
    """K5 of tiles (``k x cells``, NaN = NODATA): equal-count class 0..classes, ties share the lowest, NaN for NODATA."""
    n = (~np.isnan(data)).sum(axis=1)
    held = np.sort(data, axis=1)  # NaN sorts last
    out = np.full(data.shape, np.nan)
    for k in np.flatnonzero(n).tolist():
        rank = np.searchsorted(held[k, : n[k]], data[k], side="left")
        out[k] = np.where(np.isnan(data[k]), np.nan, rank * classes // max(1, n[k] - 1))
    return out


def tile_quantile_class(tiles: DataFrame, grid: Grid, classes: int = 254, keys: tuple[str, ...] = ()) -> DataFrame:
    """K5: ``(*keys, col, row, data)``, per-tile equal-count class index 0..classes of every cell (NULL for NODATA).

    ``class = ((rank - 1) * classes) div (n - 1)`` over the tile's valid cells ordered by value.  One Arrow pass over packed
    tiles: a tile is ranked by its own sorted array, without a shuffle."""
    size = grid.tile_size
    schema = T.StructType([tiles.schema[c] for c in (*keys, "col", "row")] + [T.StructField("data", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in few_tiles(batches, grid):
            ranks = quantile_ranks(dense(rb.column("data"), size), classes).reshape(-1)
            offsets = pa.array(np.arange(0, len(ranks) + 1, size, dtype=np.int32))
            data = pa.ListArray.from_arrays(offsets, pa.array(np.nan_to_num(ranks).astype(np.int32), mask=np.isnan(ranks)))
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in (*keys, "col", "row")), data], [*keys, "col", "row", "data"])

    return tiles.select(*keys, "col", "row", F.col("data").cast("array<double>").alias("data")).mapInArrow(run, schema)

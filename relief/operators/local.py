"""Local (cell-wise) operators over whole layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relief.functions.local import flood_depth
from relief.schema import Grid


def map_cells(cells: DataFrame, f: Callable[[Column], Column], out: str = "value") -> DataFrame:
    """L1 on cells: ``value <- f(value)``."""
    return cells.withColumn(out, f(F.col("value")))


def map_tiles(tiles: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """L1 on packed tiles: ``transform(data, f)`` -- no explode, no shuffle."""
    return tiles.withColumn("data", F.transform("data", f))


def combine_cells(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], how: str = "inner") -> DataFrame:
    """L2 on cells: join on the cell index, ``value <- f(a.value, b.value)``."""
    j = a.select("gx", "gy", F.col("value").alias("_a")).join(
        b.select("gx", "gy", F.col("value").alias("_b")), ["gx", "gy"], how
    )
    return j.select("gx", "gy", f(F.col("_a"), F.col("_b")).alias("value"))


def combine_tiles(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], keys=("col", "row")) -> DataFrame:
    """L2 on packed tiles: join on the tile key, ``zip_with`` the arrays (same shape)."""
    j = a.select(*keys, F.col("data").alias("_a")).join(b.select(*keys, F.col("data").alias("_b")), list(keys))
    return j.select(*keys, F.zip_with("_a", "_b", f).alias("data"))


def override_cells(cells: DataFrame, overrides: DataFrame) -> DataFrame:
    """Set the value of given cells ``(gx, gy, value)``; others unchanged.  Several
    overrides of one cell resolve to the largest (one row per cell, always)."""
    o = overrides.groupBy("gx", "gy").agg(F.max("value").alias("_o"))
    return cells.join(o, ["gx", "gy"], "left").select(
        "gx", "gy", F.when(F.col("_o").isNotNull(), F.col("_o")).otherwise(F.col("value")).alias("value")
    )


def flood_depth_tiles(
    requests: DataFrame, depth_tiles: DataFrame, extent_tiles: DataFrame, grid: Grid
) -> DataFrame:
    """L9 for tile requests ``(id, col, row, level)``: both layers' tiles are looked up by key
    (inner join: a missing pair gives no row), then combined cell by cell.

    Result: ``(id, col, row, level, gx, gy, value)`` cells of each requested tile."""
    r = requests.select("id", "col", "row", "level")
    d = depth_tiles.select("col", "row", F.col("data").alias("_d"))
    e = extent_tiles.select("col", "row", F.col("data").alias("_e"))
    j = r.join(d, ["col", "row"]).join(e, ["col", "row"])
    z = j.select(
        "id", "col", "row", "level",
        F.posexplode(F.arrays_zip(F.col("_d").alias("d"), F.col("_e").alias("e"))).alias("pos", "p"),
    )
    return z.select(
        "id", "col", "row", "level",
        (F.col("col") * grid.tile_cols + F.col("pos") % grid.tile_cols).cast("bigint").alias("gx"),
        (F.col("row") * grid.tile_rows + F.expr(f"pos div {grid.tile_cols}")).cast("bigint").alias("gy"),
        flood_depth(F.col("p.d"), F.col("p.e"), F.col("level")).alias("value"),
    )

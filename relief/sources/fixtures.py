"""Rasters and request tables derived from the driver's tables.

``orders.o_orderkey`` is dense (0..n-1) at every scale factor, so it is the cell
index of a 128-column raster.  Elevations are whole numbers, so Spark and the
SQL oracle compute identical values.  Everything here is a projection or an
aggregation of the given tables, so its size grows with them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relief.functions.geo import EARTH_RADIUS
from relief.schema import Grid, KeyBounds
from relief.sources.tables import table

# Fixed values of the fixture layout (see FIXTURES.md).
RASTER_COLS = 128
FIXTURE_GRID = Grid(xmin=-7420000.0, ymax=5775000.0, cell_w=10.0, cell_h=10.0, tile_cols=32, tile_rows=32)
FIXTURE_ZOOM = 15

# Vertex offsets (grid units) of the concave U-shaped flood polygon,
# one per supplier, anchored at (cx, cy); those near the last column or row reach over the raster's edge.  The area in square
# metres is no whole number, so that its truncation survives a reprojection.
U_SHAPE = [
    (0.25, 0.25), (20.25, 2.2537), (20.25, 18.25), (12.25, 18.25), (12.25, 8.25),
    (6.25, 8.25), (6.25, 18.25), (0.25, 18.25), (0.25, 0.25),
]


def raster_rows(spark: SparkSession, sf_dir: str) -> Column:
    """Rows of the raster, as a scalar subquery: requests spread over all of them at every scale factor."""
    return table(spark, sf_dir, "orders", "o_orderkey").select(F.expr(f"max(o_orderkey) div {RASTER_COLS} + 1")).scalar()


def key_bounds(spark: SparkSession, sf_dir: str) -> KeyBounds:
    """Tile keys of the whole raster."""
    last = table(spark, sf_dir, "orders", "o_orderkey").agg(F.max("o_orderkey")).first()[0] or 0
    g = FIXTURE_GRID
    return KeyBounds(0, 0, (RASTER_COLS - 1) // g.tile_cols, last // RASTER_COLS // g.tile_rows)


def _cell_index() -> tuple:
    k = F.col("o_orderkey")
    return (k % RASTER_COLS).alias("gx"), F.expr(f"o_orderkey div {RASTER_COLS}").alias("gy")


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation with NODATA (NULL where ``o_custkey % 37 = 0``)."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    value = F.when(F.col("o_custkey") % 37 == 0, F.lit(None)).otherwise(F.floor(F.col("o_totalprice") / 1000))
    return o.select(*_cell_index(), value.cast("double").alias("value"))


def dsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface model: ground plus a 'building height' from the order's line quantities."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    q = (
        table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity")
        .groupBy("l_orderkey")
        .agg(F.floor(F.sum("l_quantity") / 10).alias("q"))
    )
    j = o.join(q, o.o_orderkey == q.l_orderkey, "left")
    value = F.floor(F.col("o_totalprice") / 1000) + F.coalesce(F.col("q"), F.lit(0))
    return j.select(*_cell_index(), value.cast("double").alias("value"))


def hand_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height above nearest drainage, with the flood rule's special values 0 and -1, and NODATA."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    c = F.col("o_custkey")
    value = (
        F.when(c % 17 == 0, F.lit(None).cast("double"))
        .when(c % 11 == 0, F.lit(0.0))
        .when(c % 13 == 0, F.lit(-1.0))
        .otherwise(F.floor(F.col("o_totalprice") / 25000).cast("double"))
    )
    return o.select(*_cell_index(), value.alias("value"))


def hand_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return o.select(*_cell_index(), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("value"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point requests in EPSG:3857; some fall outside the raster."""
    c = table(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"),
        (F.lit(FIXTURE_GRID.xmin) + (k * 37 % 1280)).alias("x"),
        (F.lit(FIXTURE_GRID.ymax) - (k * 53 % (raster_rows(spark, sf_dir) * 10 + 100))).alias("y"),
    )


def flood_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One U-shaped polygon per supplier in map coordinates, with its flood level and step."""
    s = table(spark, sf_dir, "supplier", "s_suppkey")
    k = F.col("s_suppkey")
    cx = (k * 29 % RASTER_COLS).cast("double")
    cy = (k * 17 % raster_rows(spark, sf_dir)).cast("double")
    g = FIXTURE_GRID
    ring = F.array(
        *[
            F.struct(
                (F.lit(g.xmin) + (cx + F.lit(ox)) * F.lit(g.cell_w)).alias("x"),
                (F.lit(g.ymax) - (cy + F.lit(oy)) * F.lit(g.cell_h)).alias("y"),
            )
            for ox, oy in U_SHAPE
        ]
    )
    return s.select(
        k.alias("id"),
        F.array(ring).alias("rings"),
        (F.lit(2.0) + (k % 5) * F.lit(3.0)).alias("level"),
        F.lit(2.0).alias("step"),
    )


def flood_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons as GeoJSON request strings (``geom``) in lon/lat, the reference's request shape."""
    p = flood_polygons(spark, sf_dir)
    lon, lat = (lambda v: F.degrees(v["x"] / EARTH_RADIUS)), (lambda v: F.degrees(2 * F.atan(F.exp(v["y"] / EARTH_RADIUS)) - math.pi / 2))
    coords = F.transform("rings", lambda r: F.transform(r, lambda v: F.array(lon(v), lat(v))))
    geom = F.to_json(F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")))
    return p.select(
        "id",
        F.lit(FIXTURE_ZOOM).alias("zoom"),
        "level",
        "step",
        geom.alias("geom"),
        F.lit(None).cast("string").alias("collection"),
    )


def observers(spark: SparkSession, sf_dir: str, radius: int = 20, height: float = 200.0) -> DataFrame:
    """One observer per supplier, placed on a cell centre, in map coordinates."""
    s = table(spark, sf_dir, "supplier", "s_suppkey")
    k = F.col("s_suppkey")
    g = FIXTURE_GRID
    ox = (k * 37 % RASTER_COLS).cast("double")
    oy = (k * 53 % raster_rows(spark, sf_dir)).cast("double")
    return s.select(
        k.alias("id"),
        (F.lit(g.xmin) + (ox + 0.5) * F.lit(g.cell_w)).alias("x"),
        (F.lit(g.ymax) - (oy + 0.5) * F.lit(g.cell_h)).alias("y"),
        F.lit(float(height)).alias("height"),
        F.lit(int(radius)).alias("radius"),
        F.lit(float(radius) * g.cell_w).alias("buff"),
    )


def tile_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tile request (key + flood level) per supplier, as the tile routes receive them."""
    s = table(spark, sf_dir, "supplier", "s_suppkey")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("id"),
        (k % 4).cast("int").alias("col"),
        ((k * 7 + 1) % F.ceil(raster_rows(spark, sf_dir) / FIXTURE_GRID.tile_rows)).cast("int").alias("row"),
        ((k % 10) + F.lit(1.0)).alias("level"),
    )

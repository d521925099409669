"""Geometry column expressions (G1, G3, G4, G8).  All JVM built-ins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from relief.schema import Grid

# Fixed value: radius of the Web Mercator sphere (EPSG:3857), metres.
EARTH_RADIUS = 6378137.0


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lonlat_to_mercator(lon: Column | str, lat: Column | str) -> Column:
    """G1: EPSG:4326 (lon, lat) -> EPSG:3857 struct<x, y>."""
    lon, lat = _c(lon), _c(lat)
    x = F.radians(lon) * F.lit(EARTH_RADIUS)
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * F.lit(EARTH_RADIUS)
    return F.struct(x.alias("x"), y.alias("y"))


def reproject_rings(rings: Column | str, src_crs: str = "EPSG:4326") -> Column:
    """Every vertex of ARRAY<ARRAY<STRUCT<x,y>>> to EPSG:3857."""
    rings = _c(rings)
    if src_crs.upper() == "EPSG:3857":
        return rings
    if src_crs.upper() != "EPSG:4326":
        raise ValueError(f"unsupported crs {src_crs}")
    return F.transform(rings, lambda r: F.transform(r, lambda p: lonlat_to_mercator(p["x"], p["y"])))


def map_to_grid_x(grid: Grid, x: Column | str) -> Column:
    """Column index of the cell holding map x (half-open cells, floor)."""
    return F.floor((_c(x) - F.lit(grid.xmin)) / F.lit(grid.cell_w)).cast("bigint")


def map_to_grid_y(grid: Grid, y: Column | str) -> Column:
    """Row index, measured from the top edge (gy grows south)."""
    return F.floor((F.lit(grid.ymax) - _c(y)) / F.lit(grid.cell_h)).cast("bigint")


def tile_key(grid: Grid, gx: Column | str, gy: Column | str) -> tuple[Column, Column]:
    """The tile holding a cell; a plain equi-join key, never a spatial theta join."""
    col = F.floor(_c(gx) / F.lit(grid.tile_cols)).cast("int")
    row = F.floor(_c(gy) / F.lit(grid.tile_rows)).cast("int")
    return col, row


def morton(col: Column | str, row: Column | str) -> Column:
    """Morton (Z-order) code of a key: the bits of both indices in turn, so that near keys have near codes.  Indices from
    -2^30 to 2^30 - 1."""

    def spread(x: Column) -> Column:
        x = _c(x).cast("bigint") + F.lit(1 << 30)
        # Masks of the classic bit interleaving of 32 bits into every second one of 64.
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    return spread(col).bitwiseOR(F.shiftleft(spread(row), 1))


def tile_extent(grid: Grid, col: Column | str, row: Column | str) -> Column:
    """Map extent of a tile key."""
    col, row = _c(col), _c(row)
    w = grid.tile_cols * grid.cell_w
    h = grid.tile_rows * grid.cell_h
    xmin = F.lit(grid.xmin) + col * F.lit(w)
    ymax = F.lit(grid.ymax) - row * F.lit(h)
    return F.struct(
        xmin.alias("xmin"), (ymax - F.lit(h)).alias("ymin"), (xmin + F.lit(w)).alias("xmax"), ymax.alias("ymax")
    )


def ring_area(ring: Column) -> Column:
    """Unsigned shoelace area of one ring, shifted to its first vertex so that
    products of 7e6-sized map coordinates keep their digits."""
    n = F.size(ring)
    x0 = ring[0]["x"]
    y0 = ring[0]["y"]
    twice = F.aggregate(
        F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))),
        F.lit(0.0),
        lambda acc, i: acc
        + F.when(
            i < n - 1,
            (F.get(ring, i)["x"] - x0) * (F.get(ring, i + 1)["y"] - y0)
            - (F.get(ring, i + 1)["x"] - x0) * (F.get(ring, i)["y"] - y0),
        ).otherwise(F.lit(0.0)),
    )
    return F.abs(twice) / 2


def polygon_area(rings: Column | str) -> Column:
    """Planar area (outer ring minus holes), truncated to BIGINT like ``toInt``."""
    rings = _c(rings)
    holes = F.aggregate(F.slice(rings, 2, 1 << 30), F.lit(0.0), lambda acc, r: acc + ring_area(r))
    return F.when(F.size(rings) > 0, (ring_area(rings[0]) - holes).cast("bigint"))


def point_rect_dist2(px: Column, py: Column, ext: Column) -> Column:
    """Squared distance from a point to a rectangle (0 inside), used by G7."""
    dx = F.greatest(ext["xmin"] - px, F.lit(0.0), px - ext["xmax"])
    dy = F.greatest(ext["ymin"] - py, F.lit(0.0), py - ext["ymax"])
    return dx * dx + dy * dy

"""Fixed schemas and the grid (layout) descriptor.

Nothing is inferred: every table the library reads or writes has a declared
StructType here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(XY))

EXTENT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])
KEY_BOUNDS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("col_min", "row_min", "col_max", "row_max")])

LAYERS = T.StructType(
    [
        T.StructField("layer", T.StringType()),
        T.StructField("zoom", T.IntegerType()),
        T.StructField("crs", T.StringType()),
        T.StructField("cell_type", T.StringType()),
        T.StructField("nodata", T.DoubleType()),
        T.StructField("extent", EXTENT),
        T.StructField("tile_cols", T.IntegerType()),
        T.StructField("tile_rows", T.IntegerType()),
        T.StructField("key_bounds", KEY_BOUNDS),
        T.StructField("tiles", T.LongType()),
        T.StructField("valid_cells", T.LongType()),
        T.StructField("value_min", T.DoubleType()),
        T.StructField("value_max", T.DoubleType()),
        T.StructField("version", T.StringType()),
    ]
)

TILES = T.StructType(
    [
        T.StructField("layer", T.StringType()),
        T.StructField("zoom", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("data", T.ArrayType(T.DoubleType())),
    ]
)

CELLS = T.StructType(
    [
        T.StructField("gx", T.LongType()),
        T.StructField("gy", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)

POINTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)

FLOOD_REQUESTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("zoom", T.IntegerType()),
        T.StructField("level", T.DoubleType()),
        T.StructField("step", T.DoubleType()),
        T.StructField("geom", T.StringType()),
        T.StructField("collection", T.StringType()),
    ]
)

POLYGONS = T.StructType([T.StructField("id", T.LongType()), T.StructField("rings", RINGS)])

OBSERVERS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("radius", T.IntegerType()),
        T.StructField("buff", T.DoubleType()),
    ]
)

COLORMAPS = T.StructType([T.StructField("name", T.StringType()), T.StructField("definition", T.StringType())])


@dataclass(frozen=True)
class KeyBounds:
    """Least and greatest tile keys of a layer: four numbers on the driver, so predicates on them reach the scan."""

    col_min: int
    row_min: int
    col_max: int
    row_max: int


@dataclass(frozen=True)
class Grid:
    """Affine layout of one layer: map <-> grid transform and the tile size.

    ``gx`` grows east from ``xmin``; ``gy`` grows south from ``ymax``.
    Tile key ``(col, row)`` holds cells ``col*tile_cols .. +tile_cols-1``.
    The values are plain constants, so every expression built from them is
    folded by Catalyst and stays inside whole-stage codegen.
    """

    xmin: float
    ymax: float
    cell_w: float
    cell_h: float
    tile_cols: int
    tile_rows: int
    crs: str = "EPSG:3857"

    @property
    def tile_size(self) -> int:
        return self.tile_cols * self.tile_rows

    def tile_extent(self, col: int, row: int) -> tuple[float, float, float, float]:
        """G3 on the driver for a single key (tests only)."""
        x0 = self.xmin + col * self.tile_cols * self.cell_w
        y1 = self.ymax - row * self.tile_rows * self.cell_h
        return (x0, y1 - self.tile_rows * self.cell_h, x0 + self.tile_cols * self.cell_w, y1)

import math

import pytest
from pyspark.sql import functions as F

from relief.operators import focal, tiles
from relief.schema import Grid

G16 = Grid(xmin=0.0, ymax=0.0, cell_w=1.0, cell_h=1.0, tile_cols=4, tile_rows=4)


def plane(dx, dy, n=8):
    # z grows by dx per column east and dy per row south
    return [[10.0 * (dx * c + dy * r) + 100.0 for c in range(n)] for r in range(n)]


def centre_value(df, gx=3, gy=3):
    return df.where((F.col("gx") == gx) & (F.col("gy") == gy)).first()["value"]


# falling direction -> (dx, dy) gradient making that the downslope side, D8 code, aspect
DIRS = {
    "E": (-1, 0, 1, 90.0), "SE": (-1, -1, 2, 135.0), "S": (0, -1, 4, 180.0), "SW": (1, -1, 8, 225.0),
    "W": (1, 0, 16, 270.0), "NW": (1, 1, 32, 315.0), "N": (0, 1, 64, 0.0), "NE": (-1, 1, 128, 45.0),
}


@pytest.mark.parametrize("name", list(DIRS))
def test_planes_aspect_and_flow(raster, name):
    dx, dy, code, bearing = DIRS[name]
    cells = raster(plane(dx, dy))
    assert centre_value(focal.focal_cells(cells, "flowdir")) == code
    assert centre_value(focal.focal_cells(cells, "aspect")) == pytest.approx(bearing, abs=1e-9)


def test_slope_of_plane(raster):
    cells = raster(plane(1, 0))
    # gradient 10 per cell of size 3 -> atan(10/3)
    assert centre_value(focal.focal_cells(cells, "slope", cell_size=3.0)) == pytest.approx(math.degrees(math.atan(10 / 3)))


def test_flat_and_peak_and_pit(raster):
    flat = raster([[5.0] * 5 for _ in range(5)])
    assert centre_value(focal.focal_cells(flat, "aspect"), 2, 2) == -1.0
    assert centre_value(focal.focal_cells(flat, "flowdir"), 2, 2) is None
    assert centre_value(focal.focal_cells(flat, "hillshade"), 2, 2) == pytest.approx(127 * math.cos(math.radians(30)))
    pit = raster([[9.0, 9, 9], [9, 1, 9], [9, 9, 9]])
    assert centre_value(focal.focal_cells(pit, "flowdir"), 1, 1) is None
    peak = raster([[1.0, 2, 1], [2, 9, 2], [1, 2, 1]])
    # steepest drop: diagonals (8/sqrt2 = 5.66) < orthogonals (7): tie among E,S,W,N -> smallest code E
    assert centre_value(focal.focal_cells(peak, "flowdir"), 1, 1) == 1


def test_nodata_window_and_median(raster):
    r = raster([[1.0, 2, 3], [4, None, 6], [7, 8, 100]])
    assert centre_value(focal.focal_cells(r, "slope"), 1, 1) is None
    assert centre_value(focal.focal_cells(r, "median"), 1, 1) == 5.0  # mean of 4 and 6
    only = raster([[None, None], [None, None]])
    assert focal.focal_cells(only, "median").where("value is not null").count() == 0


@pytest.mark.parametrize("op", ["slope", "aspect", "hillshade", "flowdir", "median"])
@pytest.mark.parametrize("tile", [2, 4, 8])
def test_halo_equals_scatter_and_tiling_invariant(spark, raster, op, tile):
    import random

    rnd = random.Random(7)
    rows = [[float(rnd.randint(0, 20)) if rnd.random() > 0.05 else None for _ in range(12)] for _ in range(10)]
    cells = raster(rows)
    g = Grid(0.0, 0.0, 1.0, 1.0, tile, tile)
    t = tiles.pack(cells, g)
    a = tiles.unpack(focal.focal_tiles(t, g, op), g).join(cells.select("gx", "gy"), ["gx", "gy"])
    b = focal.focal_cells(cells, op)
    got = {(r.gx, r.gy): r.value for r in a.collect()}
    exp = {(r.gx, r.gy): r.value for r in b.collect()}
    assert got.keys() == exp.keys()
    for k, v in exp.items():
        assert (v is None and got[k] is None) or got[k] == pytest.approx(v, abs=1e-9)


def test_halo_without_diagonals_loses_corners(spark, raster):
    rows = [[float(c + r) for c in range(8)] for r in range(8)]
    cells = raster(rows)
    t = tiles.pack(cells, G16)
    a = tiles.unpack(focal.focal_tiles(t, G16, "slope", diagonals=False), G16)
    # the cell at a tile corner (3,3) misses its diagonal neighbour (4,4) -> NULL
    assert centre_value(a, 3, 3) is None
    assert centre_value(tiles.unpack(focal.focal_tiles(t, G16, "slope"), G16), 3, 3) is not None

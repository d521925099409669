"""Products by name: halo planning, several layers and zooms in one job, parameters, malformed colour maps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relief.operators import focal, tiles
from relief.plans import compose
from relief.plans.compose import Plan, product, run_plan
from relief.schema import Grid

G = Grid(0.0, 0.0, 1.0, 1.0, 4, 4)


def layer(spark, raster, rows, name="dem", zoom=15):
    return tiles.pack(raster(rows), G).select(F.lit(name).alias("layer"), F.lit(zoom).alias("zoom"), "col", "row", "data")


def random_rows(seed, w=13, h=10):
    rnd = random.Random(seed)
    return [[None if rnd.random() < 0.06 else float(rnd.randint(0, 500)) for _ in range(w)] for _ in range(h)]


def cells(t, keys=("layer", "zoom")):
    return {(*[r[k] for k in keys], r.gx, r.gy): r.value for r in tiles.unpack(t, G, keys).collect()}


def test_a_halo_of_two_equals_two_exchanges(spark, raster):
    t = layer(spark, raster, random_rows(1))
    plan = Plan([compose.focal("median"), compose.local(lambda v: v * 2), compose.focal("slope")], compose.T.DoubleType())
    assert plan.halo == 2
    once = cells(run_plan(plan, t, G))
    twice = focal.focal_tiles(tiles.pack(tiles.unpack(focal.focal_tiles(t, G, "median", keys=("layer", "zoom")), G, ("layer", "zoom")), G, ("layer", "zoom")), G, "slope", keys=("layer", "zoom"), zfactor=2.0)
    want = cells(twice)
    # beyond the stored tiles there is nothing, in one exchange or two
    inner = {k for k in want if 1 <= k[2] < 15 and 1 <= k[3] < 11}
    assert all((once[k] is None) == (want[k] is None) and (want[k] is None or abs(once[k] - want[k]) < 1e-9) for k in inner)


def test_halos_of_any_width(spark, raster):
    rows = random_rows(2, 16, 12)
    whole = np.array([[np.nan if v is None else v for v in r] for r in rows])
    for width in (1, 2, 4):
        around = np.pad(whole, width, constant_values=np.nan)
        h = tiles.halo(tiles.pack(raster(rows), G), G, width=width)
        for batch in h.toArrow().to_batches():
            got = tiles.padded(batch, G, width)
            for k, (c, r) in enumerate(zip(batch.column("col").to_pylist(), batch.column("row").to_pylist(), strict=True)):
                assert np.array_equal(got[k], around[4 * r : 4 * r + 4 + 2 * width, 4 * c : 4 * c + 4 + 2 * width], equal_nan=True)
    with pytest.raises(ValueError, match="wider than a tile"):
        tiles.halo(tiles.pack(raster(rows), G), G, width=5)


def test_layers_and_zooms_in_one_job(spark, raster):
    parts = [layer(spark, raster, random_rows(3), "a", 15), layer(spark, raster, random_rows(4), "a", 14), layer(spark, raster, random_rows(5), "b", 9)]
    together = parts[0].unionByName(parts[1]).unionByName(parts[2])
    for name in ("hillshade", "contour", "grey", "color-hillshade"):
        got = cells(product(name, together, G))
        want = {}
        for p in parts:
            want |= cells(product(name, p, G))
        assert got == want
        if name == "contour":  # no interval for zoom 9
            assert {v for k, v in got.items() if k[0] == "b"} == {None} and any(v is not None for k, v in got.items() if k[1] == 14)


def test_parameters_names_and_malformed_maps(spark, raster):
    t = layer(spark, raster, random_rows(6))
    north, south = (cells(product("hillshade", t, G, azimuth=a)) for a in (0.0, 180.0))
    assert north != south
    assert set(cells(product("color", t, G, colormap="1000:0f")).values()) == {15, 0}
    assert set(cells(product("color", t, G, colormap="nonsense")).values()) == {None}
    with pytest.raises(ValueError, match="there are color"):
        product("render", t, G)
    with pytest.raises(TypeError):
        product("slope", t, G, azimuth=3.0)
    with pytest.raises(ValueError, match="no depth layer"):
        product("slope", t, G, depth=t)
    with pytest.raises(ValueError, match="a depth layer"):
        product("hand", t, G, level=3.0)


def test_hand_of_two_layers(spark, raster):
    extent, depth = random_rows(7, 8, 8), random_rows(8, 8, 8)
    extent = [[None if v is None else v % 4 - 1 for v in r] for r in extent]
    depth = [[None if v is None else v % 3 for v in r] for r in depth]
    got = cells(product("hand", layer(spark, raster, extent, "extent"), G, depth=layer(spark, raster, depth, "depth").where("col = 0"), level=1.0, colormap="0:1;1:2;5:3"))
    colour = lambda v: 1 if v <= 0 else 2 if v <= 1 else 3
    want = {}
    for y in range(8):
        for x in range(4):  # the depth layer lacks the other tiles
            e, d = extent[y][x], depth[y][x]
            flooded = e is not None and d is not None and e != 0 and -1 < e <= 1.0
            want["extent", 15, x, y] = colour(1.0 - d) if flooded else 0
    assert got == want


def test_an_empty_layer(spark, raster):
    t = layer(spark, raster, random_rows(6)).limit(0)
    for name in set(compose.PRODUCTS) - {"hand"}:
        assert product(name, t, G).collect() == []

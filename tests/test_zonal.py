import math
import random

import pytest
from pyspark.sql import functions as F

from relief.operators import zonal
from relief.operators.rasterize import polygon_spans, polygon_tile_keys, rasterize
from relief.operators.tiles import pack, unpack
from relief.schema import Grid, KeyBounds

G = Grid(xmin=0.0, ymax=100.0, cell_w=1.0, cell_h=1.0, tile_cols=4, tile_rows=4)


def poly(spark, rings, pid=1, level=5.0, step=2.0):
    return spark.createDataFrame([(pid, rings, level, step)], "id long, rings array<array<struct<x:double,y:double>>>, level double, step double")


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def brute(rings, gx, gy):
    px, py = gx + 0.5, 100.0 - (gy + 0.5)
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
                inside = not inside
    return inside


def test_rasterize_with_hole_matches_brute_force(spark):
    rings = [square(0.2, 80.3, 9.7, 99.6), square(3.1, 85.2, 6.4, 94.9)]
    got = {(r.gx, r.gy) for r in rasterize(poly(spark, rings), G).collect()}
    exp = {(x, y) for x in range(12) for y in range(22) if brute(rings, x, y)}
    assert got == exp and len(exp) > 0


def test_concave_and_unclosed_ring(spark):
    u = [(0.25, 99.75), (20.25, 97.75), (20.25, 81.75), (12.25, 81.75), (12.25, 91.75), (6.25, 91.75), (6.25, 81.75), (0.25, 81.75)]
    got = {(r.gx, r.gy) for r in rasterize(poly(spark, [u]), G).collect()}
    exp = {(x, y) for x in range(25) for y in range(25) if brute([u + [u[0]]], x, y)}
    assert got == exp


def test_thin_polygon_has_no_cell(spark):
    thin = [square(2.6, 50.0, 2.9, 60.0)]
    assert rasterize(poly(spark, thin), G).count() == 0


def test_flood_summary_micro(spark, raster):
    cells = raster([[1.0, 2.0, 9.0], [None, 4.0, 5.0], [0.0, 6.0, 3.0]])
    # raster rows gy 0..2 are y 100..97; cover the whole 3x3
    req = poly(spark, [square(0.0, 97.0, 3.0, 100.0)], level=5.0, step=2.0)
    s = zonal.flood_summary(req, pack(cells, G), G).first()
    # values < 5: 1,2,4,0,3 -> flooded 5 of 9 (NODATA counted in total, not flooded)
    assert (s.total, s.flooded, s.area) == (9, 5, 9)
    assert s.coverage == pytest.approx(0.5556)
    # classes: ceil((5-v)/2): 1->2, 2->2, 4->1, 0->3, 3->1; others 0 (4 cells incl. NODATA)
    assert s.intervals == {"0": 0.4444, "1": 0.2222, "2": 0.2222, "3": 0.1111}


def test_request_outside_keeps_row(spark, raster):
    cells = raster([[1.0]])
    s = zonal.flood_summary(poly(spark, [square(50.0, 10.0, 60.0, 20.0)]), pack(cells, G), G).first()
    assert (s.total, s.flooded, s.coverage, s.intervals) == (0, 0, None, None)


def test_point_on_tile_border_and_outside(spark, raster):
    from relief.operators import tiles

    cells = raster([[float(x + 10 * y) for x in range(8)] for y in range(8)])
    pts = spark.createDataFrame([(1, 4.0, 96.0), (2, 3.999, 96.0), (3, 100.0, 50.0)], "id long, x double, y double")
    a = {r.id: r.value for r in zonal.point_values(pts, cells, G).collect()}
    b = {r.id: r.value for r in zonal.point_values_tiles(pts, tiles.pack(cells, G), G).collect()}
    assert a == b == {1: 44.0, 2: 43.0, 3: None}


def test_quantile_class_ties(spark, raster):
    cells = raster([[1.0, 1.0, 2.0, 3.0], [None] * 4])
    t = unpack(zonal.tile_quantile_class(pack(cells, G), G, 3), G)
    assert {(r.gx, r.gy): r.value for r in t.where("gy < 2").collect()} == {(0, 0): 0, (1, 0): 0, (2, 0): 2, (3, 0): 3} | {(x, 1): None for x in range(4)}
    one = unpack(zonal.tile_quantile_class(pack(raster([[7.0]]), G), G, 254), G)
    assert {r.value for r in one.collect()} == {0, None}


def random_polygon(rnd):
    """A star-shaped ring with one inside it."""
    cx, cy, n = rnd.uniform(-5, 45), rnd.uniform(60, 105), rnd.randint(3, 9)
    angles = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
    far = [rnd.uniform(2, 25) for _ in range(n)]
    rings = [[(cx + s * f * math.cos(a), cy + s * f * math.sin(a)) for a, f in zip(angles, far, strict=True)] for s in (1.0, 0.4)]
    return [r + r[:1] for r in rings]


def test_flood_classes_equal_brute_force_and_clip_to_the_layer(spark, raster):
    rnd = random.Random(9)
    rows = [[None if rnd.random() < 0.2 else float(rnd.randint(0, 9)) for _ in range(18)] for _ in range(14)]
    tiles = pack(raster(rows), G).where("not (col = 1 and row = 2)")  # one tile is missing
    polys = [random_polygon(rnd) for _ in range(40)] + [[square(-500.0, -500.0, 500.0, 500.0)]]
    req = spark.createDataFrame([(i, p, 5.0, 2.0) for i, p in enumerate(polys)], "id long, rings array<array<struct<x:double,y:double>>>, level double, step double")
    bounds = KeyBounds(0, 0, 4, 3)
    held = {(r.col, r.row) for r in tiles.select("col", "row").collect()}
    want = {}
    for i, p in enumerate(polys):
        for c, r in held:
            for x in range(4 * c, 4 * c + 4):
                for y in range(4 * r, 4 * r + 4):
                    if brute(p, x, y):
                        v = rows[y][x] if y < 14 and x < 18 else None
                        k = math.ceil((5.0 - v) / 2.0) if v is not None and v < 5 else 0
                        want[i, k] = want.get((i, k), 0) + 1
    for b in (None, bounds):
        got = {(r.id, r["class"]): r.cells for r in zonal.flood_classes(req, tiles, G, b).collect()}
        assert got == want
    spans = polygon_spans(req, G, bounds=bounds).agg(F.min("gx_lo"), F.max("gx_hi"), F.min("gy"), F.max("gy")).first()
    assert tuple(spans) == (0, 19, 0, 15)


def meets(rings, c, r):
    """Does a polygon meet tile (c, r)?  Every edge clipped to the tile, or the tile's centre inside."""
    edges = [((x1 / 4, (100 - y1) / 4), (x2 / 4, (100 - y2) / 4)) for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:])]
    inside = False
    for (u1, v1), (u2, v2) in edges:
        t0, t1 = 0.0, 1.0
        for a, d, lo in ((u1, u2 - u1, c), (v1, v2 - v1, r)):
            if d == 0:
                t0, t1 = (t0, t1) if lo <= a <= lo + 1 else (2.0, 1.0)
            else:
                p, q = sorted(((lo - a) / d, (lo + 1 - a) / d))
                t0, t1 = max(t0, p), min(t1, q)
        if t0 <= t1:
            return True
        if (v1 > r + 0.5) != (v2 > r + 0.5) and c + 0.5 < u1 + (r + 0.5 - v1) * (u2 - u1) / (v2 - v1):
            inside = not inside
    return inside


def test_polygon_tiles_are_exact(spark):
    rnd = random.Random(4)
    polys = [random_polygon(rnd) for _ in range(60)]
    polys.append([[(0.5, 99.5), (0.5, 40.5), (30.5, 40.5), (30.5, 43.5), (3.5, 43.5), (3.5, 99.5), (0.5, 99.5)]])  # an L
    df = spark.createDataFrame(list(enumerate(polys)), "id long, rings array<array<struct<x:double,y:double>>>")
    got = {}
    for r in polygon_tile_keys(df, G).collect():
        got.setdefault(r.id, set()).add((r.col, r.row))
    for i, p in enumerate(polys):
        assert got[i] == {(c, r) for c in range(-10, 25) for r in range(-10, 30) if meets(p, c, r)}
    assert len(got[60]) == 22 < 15 * 8  # not the bounding box
    clipped = polygon_tile_keys(df, G, bounds=KeyBounds(1, 0, 5, 6))
    assert {(r.id, r.col, r.row) for r in clipped.collect()} == {(i, c, r) for i, keys in got.items() for c, r in keys if 1 <= c <= 5 and 0 <= r <= 6}

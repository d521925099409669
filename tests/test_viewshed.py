import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relief.operators import visibility as V
from relief.operators.tiles import pack, raster_from_array, unpack
from relief.schema import Grid


def grid_result(df, n):
    rows = {(r.gx, r.gy): r.vis for r in df.collect()}
    return [[rows.get((x, y)) for x in range(n)] for y in range(n)]


def obs(spark, ox, oy, oz, r):
    return spark.createDataFrame([(1, ox, oy, float(oz), r)], "id long, ox long, oy long, oz double, radius int")


def test_three_by_three_literal_exact(spark):
    df = spark.createDataFrame([([0, 1, 0, 0, 0, 0, 0, 0, 0],)], "a array<int>")
    cells = raster_from_array(df, "a", 3)
    assert grid_result(V.viewshed_exact(obs(spark, 0, 0, 0, 2), cells), 3) == [[1, 1, 0], [1, 1, 0], [1, 1, 1]]


def test_plane_all_visible(spark, raster):
    cells = raster([[0.0] * 9 for _ in range(9)])
    for f in (V.viewshed_r2, V.viewshed_exact):
        res = grid_result(f(obs(spark, 4, 4, 1.0, 4), cells), 9)
        assert all(v == 1 for row in res for v in row)


def test_wall_blocks(spark, raster):
    rows = [[0.0] * 9 for _ in range(9)]
    for y in range(9):
        rows[y][6] = 50.0
    cells = raster(rows)
    for f in (V.viewshed_r2, V.viewshed_exact):
        res = grid_result(f(obs(spark, 2, 4, 1.0, 6), cells), 9)
        assert res[4][6] == 1 and res[4][7] == 0 and res[4][8] == 0
        assert res[4][3] == 1


def test_nodata_neither_blocks_nor_answers(spark, raster):
    rows = [[0.0] * 5 for _ in range(5)]
    rows[2][3] = None
    cells = raster(rows)
    res = grid_result(V.viewshed_r2(obs(spark, 0, 2, 1.0, 4), cells), 5)
    assert res[2][3] is None and res[2][4] == 1


def ring_by_ring(z, ox, oy, oz, radius):
    """V4 by its definition, cell by cell: ``z`` maps (x, y) to a value or None."""
    looks, vis = {}, {(ox, oy): 1}
    for k in range(1, radius + 1):
        for dy in range(-k, k + 1):
            for dx in range(-k, k + 1):
                if max(abs(dx), abs(dy)) != k:
                    continue
                along, t = (dx, dy) if abs(dx) >= abs(dy) else (dy, dx)
                low = t * (k - 1) // k
                rest = t * (k - 1) - low * k

                def inside(offset):
                    step = (k - 1) * (1 if along > 0 else -1)
                    return looks.get((step, offset) if abs(dx) >= abs(dy) else (offset, step))

                a, b = inside(low), inside(low + (rest > 0))
                if rest == 0 or b is None:
                    h = a
                elif a is None:
                    h = b
                else:
                    h = a * (1 - rest / k) + b * (rest / k)
                value = z.get((ox + dx, oy + dy))
                looks[dx, dy] = h
                if value is not None:
                    slope = (value - oz) / math.sqrt(k * k + t * t)
                    vis[ox + dx, oy + dy] = int(h is None or slope >= h)
                    looks[dx, dy] = slope if h is None else max(h, slope)
    return vis


@pytest.mark.parametrize("tile", [4, 16])
def test_approx_equals_the_ring_recursion(spark, raster, tile):
    rnd = random.Random(tile)
    rows = [[None if rnd.random() < 0.15 else float(rnd.randint(0, 12)) for _ in range(21)] for _ in range(17)]
    rows[8] = [None] * 21  # a wall of NODATA
    z = {(x, y): rows[y][x] for y in range(17) for x in range(21)}
    grid = Grid(0.0, 0.0, 1.0, 1.0, tile, tile)
    watchers = [(i, rnd.randint(0, 20), rnd.randint(0, 16), float(rnd.randint(3, 15)), rnd.randint(0, 20)) for i in range(30)]
    watchers += [(100 + i, 3, 3, 5.0 + i, 4) for i in range(70)]  # more than share a window
    o = spark.createDataFrame(watchers, "id long, ox long, oy long, oz double, radius int")
    t = V.viewshed_approx(o, pack(raster(rows), grid), grid)
    got = {}
    for r in unpack(t, grid, ("id",), keep_nodata=False).collect():
        got.setdefault(r.id, {})[r.gx, r.gy] = int(r.value)
    for i, ox, oy, oz, radius in watchers:
        want = ring_by_ring(z, ox, oy, oz, radius)
        assert got[i] == want
        # every valid cell within the radius has an answer
        assert want.keys() == {(x, y) for (x, y), v in z.items() if max(abs(x - ox), abs(y - oy)) <= radius and (v is not None or (x, y) == (ox, oy))}


def test_approx_answers_beyond_walls_of_nodata(spark, raster):
    """Only two far cells are valid: no ray of a coarse set need reach them, but both have an answer."""
    rows = [[None] * 33 for _ in range(33)]
    rows[0][1], rows[31][32], rows[16][16] = 5.0, 5.0, 0.0
    grid = Grid(0.0, 0.0, 1.0, 1.0, 8, 8)
    got = unpack(V.viewshed_approx(obs(spark, 16, 16, 1.0, 16), pack(raster(rows), grid), grid), grid, ("id",), keep_nodata=False)
    assert {(r.gx, r.gy): r.value for r in got.collect()} == {(1, 0): 1.0, (32, 31): 1.0, (16, 16): 1.0}


def test_approx_of_plane_wall_and_empty(spark, raster):
    grid = Grid(0.0, 0.0, 1.0, 1.0, 4, 4)
    look = lambda o, cells: grid_result(unpack(V.viewshed_approx(o, pack(cells, grid), grid), grid, ("id",), keep_nodata=False).withColumn("vis", F.col("value").cast("int")), 9)
    assert all(v == 1 for row in look(obs(spark, 4, 4, 1.0, 4), raster([[0.0] * 9 for _ in range(9)])) for v in row)
    rows = [[0.0] * 9 for _ in range(9)]
    for y in range(9):
        rows[y][6] = 50.0
    res = look(obs(spark, 2, 4, 1.0, 6), raster(rows))
    assert res[4][6] == 1 and res[4][7] == 0 and res[4][8] == 0 and res[4][3] == 1
    assert V.viewshed_approx(obs(spark, 2, 4, 1.0, 6).limit(0), pack(raster(rows), grid), grid).count() == 0
    # an observer off all tiles still sees its own cell
    far = unpack(V.viewshed_approx(obs(spark, 500, 500, 1.0, 2), pack(raster(rows), grid), grid), grid, ("id",), keep_nodata=False).collect()
    assert [(r.gx, r.gy, r.value) for r in far] == [(500, 500, 1.0)]


def test_median_of_masks_equals_the_focal_median(spark, raster):
    from relief.operators import focal

    rnd = random.Random(2)
    rows = [[None if rnd.random() < 0.2 else float(rnd.randint(0, 9)) for _ in range(16)] for _ in range(12)]
    grid = Grid(0.0, 0.0, 1.0, 1.0, 4, 4)
    o, t = obs(spark, 6, 6, 4.0, 16), pack(raster(rows), grid)
    plain = V.viewshed_approx(o, t, grid)
    want = unpack(focal.focal_tiles(plain, grid, "median", keys=("id",)), grid, ("id",)).withColumnRenamed("value", "m")
    want = want.join(unpack(plain, grid, ("id",), keep_nodata=False), ["id", "gx", "gy"])  # a cell without an answer has no median
    got = unpack(V.viewshed_approx(o, t, grid, median=True), grid, ("id",), keep_nodata=False)
    assert {(r.gx, r.gy): r.value for r in got.collect()} == {(r.gx, r.gy): r.m for r in want.collect()}


def test_too_large_a_window_says_so(spark, raster, monkeypatch):
    from relief.operators.visibility import _window

    monkeypatch.setattr(V, "WINDOW_CELLS", 10)
    held = pa.table({"col": pa.array([0], pa.int32()), "row": pa.array([0], pa.int32()), "data": pa.array([[0.0] * 16])})
    members = pa.table({"id": [1], "ox": [0], "oy": [0], "oz": [1.0], "radius": pa.array([3], pa.int32())})
    with pytest.raises(ValueError, match="viewshed_r2"):
        list(_window(members, held, Grid(0.0, 0.0, 1.0, 1.0, 4, 4), False, False, None))


def test_tiles_of_an_observer_stay_inside_its_extent(spark):
    o = spark.createDataFrame([(0, 5, 5, 1_000_000, 0, 0, 31, 70)], "id long, ox long, oy long, radius int, bx0 long, by0 long, bx1 long, by1 long")
    got = {(r.col, r.row) for r in V.observer_tile_keys(o, Grid(0.0, 0.0, 1.0, 1.0, 32, 32)).collect()}
    assert got == {(0, 0), (0, 1), (0, 2)}


def test_observer_product_answers_every_selected_cell(spark):
    """A wide raster: the selected tiles reach farther than the request's radius of 2 cells."""
    grid = Grid(xmin=0.0, ymax=160.0, cell_w=10.0, cell_h=10.0, tile_cols=8, tile_rows=8)
    cells = spark.createDataFrame([(x, y, 0.0) for x in range(32) for y in range(16)], "gx long, gy long, value double")
    o = spark.createDataFrame([(1, 125.0, 85.0, 1.0, 2, 20.0), (2, 5.0, 5.0, 1.0, 0, 20.0)], "id long, x double, y double, height double, radius int, buff double")
    tiles = {1: {(1, 0), (1, 1)}, 2: {(0, 1)}}  # rows count from ymax
    want = {(i, x, y) for i in tiles for x in range(32) for y in range(16) if (x // 8, y // 8) in tiles[i]}
    got = unpack(V.observer_viewshed(o, cells, pack(cells, grid), grid), grid, ("id",), keep_nodata=False).collect()
    assert {(r.id, r.gx, r.gy) for r in got} == want and all(r.value == 1 for r in got)


def test_rays_of_one_observer_are_many_tasks(spark):
    o = spark.createDataFrame([(0, 50, 50, 1.0, 50)], "id long, ox long, oy long, oz double, radius int").coalesce(1)
    tasks = V.ray_samples(o).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def many_samples(spark, monkeypatch, sector):
    """Observers, a raster with NODATA and the limits of a run whose samples are too many to broadcast."""
    rng = random.Random(11)
    cells = spark.createDataFrame([(x, y, None if rng.random() < 0.1 else float(rng.randint(0, 30))) for x in range(70) for y in range(90)], "gx long, gy long, value double")
    rows = [(k, rng.randrange(70), rng.randrange(90), float(rng.randint(20, 60)), rng.choice([1, 5, 40, 75])) for k in range(6)]
    monkeypatch.setattr(V, "SECTOR_SAMPLES", sector)
    return spark.createDataFrame([*rows, (9, 5, 5, 20.0, 0)], "id long, ox long, oy long, oz double, radius int"), cells


@pytest.mark.parametrize("sector", [100, 1 << 16])
@pytest.mark.parametrize("clip", [False, True])
def test_values_by_tile_equal_values_by_cell(spark, monkeypatch, sector, clip):
    o, cells = many_samples(spark, monkeypatch, sector)
    if clip:
        o = o.select("*", F.lit(0).alias("bx0"), F.lit(0).alias("by0"), F.lit(69).alias("bx1"), F.lit(89).alias("by1"))
    grid = Grid(xmin=0.0, ymax=0.0, cell_w=1.0, cell_h=1.0, tile_cols=32, tile_rows=16)
    keyed = o.select("id").crossJoin(cells).withColumn("value", F.col("value") + F.col("id") * (F.col("gx") % 3))
    cases = [dict(prune_grid=grid), dict(ray_step=3), dict(keyed=True)]
    results = []
    for limit in (1 << 30, 1):
        spark.conf.set("relief.broadcastMaxBytes", str(limit))
        try:
            results.append([sorted(map(tuple, V.viewshed_r2(o, keyed if c.get("keyed") else cells, **c).collect())) for c in cases])
        finally:
            spark.conf.unset("relief.broadcastMaxBytes")
    assert results[0] == results[1] and all(len(r) > 1000 for r in results[0])


def test_samples_are_not_shuffled_by_cell(spark, monkeypatch):
    """A row per sample went through the join's shuffle, the window's and nearly all of the last group's."""
    o, cells = many_samples(spark, monkeypatch, 1 << 16)
    spark.conf.set("relief.broadcastMaxBytes", "1")
    try:
        plan = V.viewshed_r2(o, cells)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("relief.broadcastMaxBytes")
    assert "hashpartitioning(gx#" not in plan and "hashpartitioning(id#" in plan

import pytest
from pyspark.sql import functions as F

from relief.operators import vectorize as Z
from relief.sources.fixtures import FIXTURE_GRID


def test_ring_region_with_hole(raster):
    ring = [[1.0] * 5, [1.0, 0, 0, 0, 1], [1.0, 0, 2, 0, 1], [1.0, 0, 0, 0, 1], [1.0] * 5]
    lab = Z.regions(raster(ring), segment=2)
    summ = {r.value: r.cells for r in Z.region_summary(lab).collect()}
    assert summ == {1.0: 16, 0.0: 8, 2.0: 1}
    rings = Z.region_rings(lab).where(F.col("value") == 1.0).orderBy("ring").collect()
    assert [r.hole for r in rings] == [False, True]
    area = sum((1 if not r.hole else -1) * abs(sum(x0 * y1 - x1 * y0 for x0, y0, x1, y1 in zip(r.xs, r.ys, r.xs[1:], r.ys[1:]))) / 2 for r in rings)
    assert area == 16


def test_checkerboard_is_all_singletons(raster):
    cb = [[float((x + y) % 2) for x in range(6)] for y in range(6)]
    lab = Z.regions(raster(cb), segment=4)
    assert Z.region_summary(lab).count() == 36


def test_snake_connects_across_segments(raster):
    # a serpentine path of 1s: one region, long diameter
    rows = [[0.0] * 9 for _ in range(9)]
    for y in range(0, 9, 2):
        for x in range(9):
            rows[y][x] = 1.0
    for y in range(1, 9, 4):
        rows[y][8] = 1.0
    for y in range(3, 9, 4):
        rows[y][0] = 1.0
    lab = Z.regions(raster(rows), segment=3)
    ones = Z.region_summary(lab).where("value = 1.0").collect()
    assert len(ones) == 1 and ones[0].cells == 5 * 9 + 4 and ones[0].region == 0


def test_nodata_only_has_no_regions(raster):
    lab = Z.regions(raster([[None, None], [None, None]]))
    assert lab.count() == 0


def test_polygon_geojson(raster):
    lab = Z.regions(raster([[3.0, 3.0], [3.0, None]]))
    g = Z.region_polygons(lab, FIXTURE_GRID).first().geojson
    assert '"type":"Polygon"' in g and '"value":3.0' in g


def traced(rows):
    """Rings of every region by plain tracing of unit sides: {region: [corners from the least (y, x), outer ring first]}."""
    value = {(x, y): v for y, row in enumerate(rows) for x, v in enumerate(row) if v is not None}
    region, out = {}, {}
    for y, x in sorted((y, x) for x, y in value):
        if (x, y) in region:
            continue
        todo, region[x, y] = [(x, y)], y * 2**32 + x
        while todo:
            a, b = todo.pop()
            for c in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if value.get(c) == value[a, b] and c not in region:
                    region[c] = region[x, y]
                    todo.append(c)
    for name in set(region.values()):
        sides = {}
        for (x, y), r in region.items():
            if r == name:
                for dx, dy, a, b in ((0, -1, (x, y), (x + 1, y)), (1, 0, (x + 1, y), (x + 1, y + 1)), (0, 1, (x + 1, y + 1), (x, y + 1)), (-1, 0, (x, y + 1), (x, y))):
                    if region.get((x + dx, y + dy)) != name:
                        sides.setdefault(a, []).append(b)
        rings = []
        while sides:
            start = min(sides, key=lambda p: (p[1], p[0]))
            ring, cur, before = [], start, None
            while True:
                ahead = sides[cur]
                right = None if before is None else (cur[0] - (cur[1] - before[1]), cur[1] + (cur[0] - before[0]))
                nxt = right if right in ahead else ahead[0]
                ahead.remove(nxt)
                if not ahead:
                    del sides[cur]
                ring.append(cur)
                before, cur = cur, nxt
                if cur == start:
                    break
            n = len(ring)
            corners = [p for i, p in enumerate(ring) if (ring[i - 1][0] == p[0]) != (p[0] == ring[(i + 1) % n][0])]
            area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(corners, corners[1:] + corners[:1], strict=True))) / 2
            rings.append((-area, corners[0][1], corners[0][0], corners + corners[:1]))
        out[name] = [r[3] for r in sorted(rings)]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rings_equal_plain_tracing(raster, seed):
    import random

    rnd = random.Random(seed)
    rows = [[float(rnd.random() < 0.3) if rnd.random() > 0.03 else None for _ in range(23)] for _ in range(19)]
    want = traced(rows)
    lab = Z.regions(raster(rows), segment=(4, 7, 64)[seed])
    got = {}
    for r in Z.region_rings(lab).orderBy("region", "ring").collect():
        assert r.hole == (r.ring > 0)
        got.setdefault(r.region, []).append(list(zip(r.xs, r.ys, strict=True)))
    assert got == want and any(len(rings) > 1 for rings in want.values())


def test_chains_close_whatever_the_blocks(raster):
    import random

    rnd = random.Random(11)
    rows = [[float(rnd.random() < 0.35) for _ in range(40)] for _ in range(30)]
    runs = Z.regions(raster(rows), segment=8).select("region", "value", "gy", F.col("gx").alias("gx0"), F.col("gx").alias("gx1"))
    edges = Z.outline_edges(runs).cache()

    def rings(block):
        out = []
        for r in Z.closed_chains(edges, block=block).collect():
            pts = list(zip(r.ys, r.xs, strict=True))
            at = pts.index(min(pts))
            out.append((r.region, pts[at:] + pts[:at]))
        return sorted(out)

    once = rings(256)
    assert rings(1) == once and rings(5) == once and len(once) > 50


def test_outlines_of_runs_and_of_cells_are_equal(raster):
    from relief.operators.tiles import pack
    from relief.schema import Grid

    rows = [[1.0, 1, 1, 2], [1.0, None, 1, 2], [1.0, 1, 1, 1], [3.0, 3, 1, 3]]
    g = Grid(0.0, 0.0, 1.0, 1.0, 2, 2)
    cells = raster(rows)
    runs = Z.region_runs(pack(cells, g), g)
    key = lambda df: sorted((r.region, r.value, r.geojson) for r in Z.region_polygons(df, FIXTURE_GRID).collect())
    assert key(runs) == key(Z.regions(cells, segment=2)) and len(key(runs)) == 4
    assert {r.region: r.cells for r in Z.region_summary(runs).collect()} == {0: 10, 3: 2, 3 * 2**32: 2, 3 * 2**32 + 3: 1}


def reach(edges):
    """Plain union-find: vertex -> least vertex of its component."""
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_equal_union_find(spark):
    """All graphs in one job, the graph's number as key; the first one has a leaf with two centres."""
    import random

    graphs = [[(4, 3), (4, 1), (5, 3), (5, 2)]]
    for seed in range(50):
        rnd = random.Random(seed)
        graphs.append([(max(e), min(e)) for e in ((rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(25)) if e[0] != e[1]])
    rows = [(g, u, v) for g, edges in enumerate(graphs) for u, v in set(edges)]
    got = Z.components(spark.createDataFrame(rows, "g int, u long, v long"), ("g",)).collect()
    labels = {}
    for r in got:
        assert (r.g, r.u) not in labels  # one label per vertex
        labels[r.g, r.u] = r.label
    for g, edges in enumerate(graphs):
        for x, least in reach(edges).items():
            assert labels.get((g, x), x) == least


def test_regions_across_blocks_with_any_key_type(raster):
    import random

    rnd = random.Random(5)
    cells = raster([[float(rnd.randint(0, 1)) for _ in range(15)] for _ in range(15)])
    whole = {(r.gx, r.gy): r.region for r in Z.regions(cells, segment=64).collect()}
    for kind in ("int", "string", "bigint"):
        keyed = cells.withColumn("id", F.lit("7").cast(kind))
        got = Z.regions(keyed, keys=("id",), segment=4).collect()
        assert {(r.gx, r.gy): r.region for r in got} == whole and len(got) == len(whole)

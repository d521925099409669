import json

import pytest
from pyspark.sql import functions as F

from relief.functions.color import classify_ge, classify_le, classify_requests, colormap_literal, grey_rgba, parse_colormap, shade_blend
from relief.functions.geo import lonlat_to_mercator, morton
from relief.operators import tiles
from relief.schema import Grid, KeyBounds
from relief.sources import layers
from relief.sources.requests import flood_requests, point_requests

G = Grid(0.0, 0.0, 1.0, 1.0, 4, 4)


def test_point_requests_validation(spark):
    df = spark.createDataFrame(
        [(1, 45.0, -66.0, None, None), (2, None, None, 10.0, 20.0), (3, 45.0, None, None, None), (4, 1.0, 2.0, 3.0, 4.0)],
        "id long, lat double, lon double, x double, y double",
    )
    ok, bad = point_requests(df)
    assert sorted(r.id for r in ok.collect()) == [1, 2] and sorted(r.id for r in bad.collect()) == [3, 4]
    p = ok.where("id = 1").first()
    assert abs(p.x - (-7347086.392356)) < 1e-3 and abs(p.y - 5621521.486192) < 1e-3


def test_geojson_requests(spark):
    poly = json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]})
    coll = json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[5, 5], [6, 5], [6, 6], [5, 5]]]}},
    ]})
    df = spark.createDataFrame(
        [(1, 17, 2.0, 1.0, poly, None), (2, 17, 2.0, 1.0, None, coll), (3, 17, 2.0, 1.0, poly, coll), (4, 17, 2.0, 0.0, poly, None)],
        "id long, zoom int, level double, step double, geom string, collection string",
    )
    ok, bad = flood_requests(df, src_crs="EPSG:3857")
    got = {r.id: r.rings for r in ok.collect()}
    assert set(got) == {1, 2} and got[2][0][0].x == 5.0
    assert sorted(r.id for r in bad.collect()) == [3, 4]


def test_colormap_parse_and_classify(spark):
    df = spark.createDataFrame([(v,) for v in (None, -5.0, 0.0, 10.0, 11.0, 99.0)], "v double")
    cm = colormap_literal("0:ff000000 ; 10:00ff0000;20:0000ff00")
    got = [r.c for r in df.select(classify_le("v", cm).alias("c")).collect()]
    assert got == [0, 0xFF000000, 0xFF000000, 0x00FF0000, 0x0000FF00, 0x0000FF00]
    got = [r.c for r in df.select(classify_ge("v", cm).alias("c")).collect()]
    assert got == [0, 0xFF000000, 0xFF000000, 0x00FF0000, 0x00FF0000, 0x0000FF00]
    bad = spark.createDataFrame([("1:zz",), ("1:ff:2",), ("x:ff",)], "d string")
    assert all(r.m is None for r in bad.select(parse_colormap("d").alias("m")).collect())


def test_grey_ramp_and_blend(spark):
    df = spark.range(1).select(
        grey_rgba(F.lit(0), 254).alias("g0"), grey_rgba(F.lit(127), 254).alias("g127"), grey_rgba(F.lit(1), 1).alias("w"),
        shade_blend(F.lit(0xFF804020), F.lit(255)).alias("b0"), shade_blend(F.lit(0xFF804020), F.lit(225)).alias("b1"),
    ).first()
    assert (df.g0, df.g127, df.w) == (0x000000FF, 0x808080FF, 0xFFFFFFFF)
    assert df.b0 == 0xFF804020 and df.b1 == 0xFF622202


def test_mercator_origin(spark):
    r = spark.range(1).select(lonlat_to_mercator(F.lit(0.0), F.lit(0.0)).alias("p")).first().p
    assert abs(r.x) < 1e-9 and abs(r.y) < 1e-9


def test_pack_unpack_roundtrip(spark, raster):
    cells = raster([[float(x * y) if (x + y) % 5 else None for x in range(6)] for y in range(5)])
    t = tiles.pack(cells, G)
    assert t.count() == 4 and t.select(F.size("data")).first()[0] == 16
    back = tiles.unpack(t, G, keep_nodata=False)
    assert sorted(back.collect()) == sorted(cells.where("value is not null").collect())


def test_layer_store_and_its_catalogue(spark, raster, tmp_path):
    cells = raster([[float(x * y) if (x + y) % 5 else None for x in range(6)] for y in range(5)])
    t, path = tiles.pack(cells, G), str(tmp_path / "pyramid")
    layers.write_layer(t, path, "dem", 15, G, nodata=-1.0)
    layers.write_layer(t.where("col = 0"), path, "dem", 14, G)
    r = layers.read_layer(spark, path, "dem", 15)
    assert r.count() == 4 and r.columns == ["layer", "zoom", "col", "row", "data"]
    assert sorted(tiles.unpack(r, G, keep_nodata=False).collect()) == sorted(cells.where("value is not null").collect())
    plan = r._jdf.queryExecution().executedPlan().toString()
    pf = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert all(f"isnotnull({c}#" in pf for c in ("layer", "zoom", "version")) and "= dem)" in pf
    entry = layers.layer_entry(spark, path, "dem", 15)
    assert layers.entry_bounds(entry) == KeyBounds(0, 0, 1, 1) and layers.entry_grid(entry) == G
    valid = cells.where("value is not null")
    assert (entry.tiles, entry.valid_cells, entry.value_min, entry.value_max) == (4, valid.count(), 0.0, valid.agg(F.max("value")).first()[0])
    assert layers.read_catalogue(spark, path).count() == 2
    # the catalogue of tiles that are in no store is the same
    names = [c for c in entry.asDict() if c not in ("version", "nodata")]
    assert layers.layer_metadata(t, G, "dem", 15).select(*names).first() == layers.read_catalogue(spark, path).where("zoom = 15").select(*names).first()
    req = spark.createDataFrame([("dem", 15, 0, 0), ("dem", 15, 5, 5), ("dem", 15, 1, 1), ("dem", 15, None, 1)], "layer string, zoom int, col int, row int")
    for found in (layers.lookup_tiles(req, r), layers.lookup_stored(req, path, "dem", 15)):
        assert {(x.col, x.row): x.data is not None for x in found.collect()} == {(0, 0): True, (5, 5): False, (1, 1): True, (None, 1): False}
    assert layers.within_key_bounds(req, layers.read_catalogue(spark, path)).count() == 2


def test_a_layer_is_replaced_whole_and_a_failed_write_leaves_no_trace(spark, tmp_path):
    path = str(tmp_path / "pyramid")
    one = spark.range(6).select(F.col("id").cast("int").alias("col"), F.lit(0).alias("row"), F.array_repeat(F.lit(1.0), 16).alias("data"))
    layers.write_layer(one, path, "dem", 15, G)
    broken = one.withColumn("data", F.when(F.col("col") == 5, F.raise_error(F.lit("lost")).cast("array<double>")).otherwise(F.array_repeat(F.lit(2.0), 16)))
    with pytest.raises(Exception, match="lost"):
        layers.write_layer(broken, path, "dem", 15, G)
    assert {r.data[0] for r in layers.read_layer(spark, path, "dem", 15).collect()} == {1.0}
    layers.write_layer(one.where("col < 2").withColumn("data", F.array_repeat(F.lit(3.0), 16)), path, "dem", 15, G)
    assert [r.data[0] for r in layers.read_layer(spark, path, "dem", 15).collect()] == [3.0, 3.0]
    assert layers.layer_entry(spark, path, "dem", 15).tiles == 2
    layers.write_layer(one.limit(0), path, "dem", 15, G)
    assert layers.read_layer(spark, path, "dem", 15).count() == 0 and layers.entry_bounds(layers.layer_entry(spark, path, "dem", 15)) is None
    with pytest.raises(ValueError, match="no layer"):
        layers.read_layer(spark, path, "dsm", 15)


def test_a_lookup_of_ten_tiles_opens_few_files(spark, tmp_path):
    path, g = str(tmp_path / "pyramid"), Grid(0.0, 0.0, 1.0, 1.0, 1, 1)
    keys = spark.range(256 * 128).select((F.col("id") % 256 - 100).cast("int").alias("col"), F.expr("cast(id div 256 as int)").alias("row"))
    layers.write_layer(keys.withColumn("data", F.array((F.col("col") * 1000 + F.col("row")).cast("double"))), path, "big", 3, g)

    def files(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()

    asked = [(i, "big", 3, -60 + i, 40) for i in range(9)] + [(9, "big", 3, 150, 120), (10, "big", 3, 900, 900)]
    req = spark.createDataFrame(asked, "id int, layer string, zoom int, col int, row int")
    few = files(layers.read_layer(spark, path, "big", 3, layers.touched_blocks(req)))
    whole = files(layers.read_layer(spark, path, "big", 3))
    assert whole >= 30 and few <= 6
    got = {r.id: r.data for r in layers.lookup_stored(req, path, "big", 3).collect()}
    assert got == {i: ([c * 1000.0 + r] if i < 10 else None) for i, _, _, c, r in asked}


def test_morton_codes_keep_neighbours_near(spark):
    df = spark.range(64).select((F.col("id") % 8 - 4).cast("int").alias("c"), F.expr("cast(id div 8 - 4 as int)").alias("r"))
    codes = {(x.c, x.r): x.m for x in df.select("c", "r", morton("c", "r").alias("m")).collect()}
    assert len(set(codes.values())) == 64
    spread = lambda v: sum((v + (1 << 30) >> k & 1) << 2 * k for k in range(31))
    assert all(m == spread(c) | spread(r) << 1 for (c, r), m in codes.items())


def test_stitch_fills_missing_tiles_with_nodata(spark, raster):
    rows = [[float(10 * y + x) if (x + y) % 7 else None for x in range(9)] for y in range(10)]
    t = tiles.pack(raster(rows), G).where("not (col = 1 and row = 1)")
    got = {(r.gx, r.gy): r.value for r in tiles.stitch(t, G, KeyBounds(0, 0, 2, 2)).collect()}
    inside = lambda x, y: x < 9 and y < 10 and not (x // 4 == 1 and y // 4 == 1)
    assert got == {(x, y): rows[y][x] if inside(x, y) else None for x in range(12) for y in range(12)}
    assert tiles.crop_tiles(t, G, 3, 2, 5, 9).where("value is not null").count() == sum(rows[y][x] is not None and inside(x, y) for x in range(3, 6) for y in range(2, 10))


def test_requests_with_their_own_colour_maps(spark):
    maps = spark.createDataFrame([("a", "0:ff ; 10:0A"), ("bad", "0:ff;x:1"), ("bad2", "0"), ("none", None)], "name string, definition string")
    rows = [(1, "a", -3.0), (2, "a", 0.5), (3, "a", 99.0), (4, "a", None), (5, "bad", 1.0), (6, "bad2", 1.0), (7, "missing", 1.0), (8, None, 1.0), (9, "none", 1.0)]
    values = spark.createDataFrame(rows, "id long, name string, value double")
    assert {r.id: r.color for r in classify_requests(values, maps).collect()} == {1: 255, 2: 10, 3: 10, 4: 0, 5: None, 6: None, 7: None, 8: None, 9: None}
    assert {r.id: r.color for r in classify_requests(values, maps, at_least=True).where("id < 5").collect()} == {1: 255, 2: 255, 3: 10, 4: 0}


def test_sinks_write_parquet_and_json(spark, raster, tmp_path):
    cells = raster([[1.0, 2.0], [3.0, None]])
    t = tiles.pack(cells, G).select(F.lit("dem").alias("layer"), F.lit(15).alias("zoom"), "col", "row", "data")
    layers.write_tiles(t, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("zoom = 15").count() == 1
    layers.write_json(cells.where("value is not null"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_reproject_polygon_area(spark):
    import math

    from relief.functions.geo import polygon_area, reproject_rings

    sq = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]
    df = spark.createDataFrame([(sq,)], "rings array<array<struct<x:double,y:double>>>")
    a = df.select(polygon_area(reproject_rings("rings", "EPSG:4326")).alias("a")).first().a
    r = 6378137.0
    exp = (r * math.radians(1.0)) * (r * math.log(math.tan(math.pi / 4 + math.radians(1.0) / 2)))
    assert abs(a - int(exp)) <= 1


def test_override_and_crop(spark, raster):
    from relief.operators.local import override_cells

    cells = raster([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])
    o = spark.createDataFrame([(1, 1, 50.0)], "gx long, gy long, value double")
    got = {(r.gx, r.gy): r.value for r in override_cells(cells, o).collect()}
    assert got[(1, 1)] == 50.0 and got[(0, 0)] == 1.0 and len(got) == 6
    assert tiles.crop(cells, 1, 0, 2, 0).count() == 2


def test_geojson_all_polygons(spark):
    from relief.sources.requests import geojson_all_polygons

    coll = json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [3, 3]}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[5, 5], [6, 5], [6, 6], [5, 5]]]}},
    ]})
    df = spark.createDataFrame([(1, coll)], "id long, collection string")
    got = [(r.feature, r.rings[0][0].x) for r in geojson_all_polygons(df).orderBy("feature").collect()]
    assert got == [(0, 0.0), (1, 5.0)]


def test_malformed_polygons_reject_their_own_rows_only(spark):
    from relief.sources.requests import flood_requests

    good = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]]]}'
    bad = ['{"type":"Polygon","coordinates":[[[0,0],[4],[4,4],[0,0]]]}', '{"type":"Polygon","coordinates":[[]]}', '{"type":"Polygon","coordinates":[[[0,0],[1,1],[0,0]]]}', '{"type":"Polygon","coordinates":[]}', "{", '{"type":"Point"}']
    rows = [(i, 15, 1.0, 1.0, g, None) for i, g in enumerate([good, *bad])]
    valid, rejected = flood_requests(spark.createDataFrame(rows, "id int, zoom int, level double, step double, geom string, collection string"), src_crs="EPSG:3857")
    assert [r.id for r in valid.collect()] == [0]
    assert sorted(r.id for r in rejected.collect()) == list(range(1, 1 + len(bad)))


def test_contour_levels_truncate_towards_zero(spark):
    from pyspark.sql import functions as F

    from relief.functions.local import contour_quantise

    row = spark.range(1).select(contour_quantise(F.lit(-7.0), 15, integer_layer=True).alias("a"), contour_quantise(F.lit(7.0), 15, integer_layer=True).alias("b")).first()
    assert (row.a, row.b) == (-1.0, 1.0)


def test_ray_steps_beyond_the_int_range(spark):
    from pyspark.sql import functions as F

    from relief.operators.visibility import _nearest

    row = spark.range(1).select(_nearest(F.lit(40_000), F.lit(39_999), F.lit(40_000)).alias("x")).first()
    assert row.x == 39_999

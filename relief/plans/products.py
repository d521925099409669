"""Named products (P1-P13): compositions of the operators over whole layers and
request tables.  Each takes ``(spark, sf_dir)`` inputs through the fixture
sources and returns a DataFrame; none runs an action."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relief.functions import color as Y
from relief.functions import local as L
from relief.functions.geo import lonlat_to_mercator, map_to_grid_x, map_to_grid_y, morton, polygon_area, tile_key
from relief.functions.local import zero_to_nodata
from relief.operators import focal, tiles, zonal
from relief.operators import vectorize as Z
from relief.operators import visibility as V
from relief.operators.local import combine_cells, combine_tiles, flood_depth_tiles, map_cells, map_tiles, override_cells
from relief.operators.rasterize import polygon_tile_keys
from relief.plans.compose import product
from relief.session import cut_lineage, scratch_path
from relief.sources import fixtures as fx
from relief.sources import layers as S
from relief.sources.requests import flood_requests, geojson_first_polygon_rings, point_requests
from relief.streaming.requests import start_point_value_stream

G = fx.FIXTURE_GRID


def hand_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HAND extent layer, packed."""
    return tiles.pack(fx.hand_extent(spark, sf_dir), G)


def flood_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: GeoJSON flood requests in lon/lat -> reprojected polygons -> flood statistics per request; the intervals as a JSON
    object of class and share, in the order of the classes."""
    valid, _rejected = flood_requests(fx.flood_requests(spark, sf_dir))
    out = zonal.flood_summary(valid, hand_tiles(spark, sf_dir), G, fx.key_bounds(spark, sf_dir))
    return out.withColumn("intervals", F.to_json(F.transform_values("intervals", lambda _, v: v.cast("decimal(5,4)"))))


def flood_class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = flood_requests(fx.flood_requests(spark, sf_dir))
    return zonal.flood_class_shares(valid, hand_tiles(spark, sf_dir), G, fx.key_bounds(spark, sf_dir))


def point_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of the HAND layer under each point request."""
    return zonal.point_values(fx.points(spark, sf_dir), fx.hand_extent(spark, sf_dir), G)


# --- terrain products on packed tiles (P1-P8) --------------------------------------


ZOOM = fx.FIXTURE_ZOOM


def dem_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 ingest: the DEM packed into tiles (the stored layer form)."""
    return tiles.pack(fx.dem(spark, sf_dir), G)


def rendered(spark: SparkSession, sf_dir: str, name: str, out: str = "color", kind: str = "bigint", **params) -> DataFrame:
    """A product of the DEM by name, unpacked at the end: ``(gx, gy, out)``."""
    t = product(name, _layered(dem_tiles(spark, sf_dir)), G, **params)
    return tiles.unpack(t, G).select("gx", "gy", F.col("value").cast(kind).alias(out))


def hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile requests (key + level) -> flood depth from the two HAND layers -> colour."""
    depth = _layered(tiles.pack(fx.hand_depth(spark, sf_dir), G), "hand_depth")
    asked = fx.tile_requests(spark, sf_dir).select("id", "col", "row", "level").join(_layered(hand_tiles(spark, sf_dir), "hand"), ["col", "row"])
    t = product("hand", asked, G, depth=depth, carry=("id", "level"), level="level")
    return tiles.unpack(t, G, ("id",)).select("id", "gx", "gy", F.col("value").alias("color"))


def stored_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + P7: the DEM written to a layer store, read back through its catalogue, rendered by name."""
    path = stored_dem(spark, sf_dir)
    grid = S.entry_grid(S.layer_entry(spark, path, "dem", ZOOM))
    t = product("color-hillshade", S.read_layer(spark, path, "dem", ZOOM), grid)
    return tiles.unpack(t, grid).select("gx", "gy", F.col("value").alias("color"))


def focal_layer(spark: SparkSession, sf_dir: str, op: str, **kw) -> DataFrame:
    """F1-F5 over the whole DEM (tile path), doubles rounded to 6 decimals."""
    c = tiles.unpack(focal.focal_tiles(dem_tiles(spark, sf_dir), G, op, **kw), G)
    return c.select("gx", "gy", F.round("value", 6).alias("value"))


# --- visibility products (V2-V5, P11) ------------------------------------------------


def _observers(spark: SparkSession, sf_dir: str, radius: int, height: float = 200.0) -> DataFrame:
    return V.observer_cells(fx.observers(spark, sf_dir, radius, height), fx.dem(spark, sf_dir), G)


def viewshed_r2(spark: SparkSession, sf_dir: str, radius: int = 20) -> DataFrame:
    """V2 for every supplier observer on the DEM."""
    return V.viewshed_r2(_observers(spark, sf_dir, radius), fx.dem(spark, sf_dir), prune_grid=G)


def viewshed_exact(spark: SparkSession, sf_dir: str, radius: int = 6) -> DataFrame:
    """V3 for every supplier observer on the DEM."""
    return V.viewshed_exact(_observers(spark, sf_dir, radius), fx.dem(spark, sf_dir), prune_grid=G)


def viewshed_approx(spark: SparkSession, sf_dir: str, radius: int = 20) -> DataFrame:
    """V4 for every supplier observer on the DEM."""
    t = V.viewshed_approx(_observers(spark, sf_dir, radius), dem_tiles(spark, sf_dir), G)
    return _seen(t).select("id", "gx", "gy", F.col("value").cast("int").alias("vis"))


def _seen(t: DataFrame) -> DataFrame:
    return tiles.unpack(t, G, ("id",), keep_nodata=False)


def observer_viewshed(spark: SparkSession, sf_dir: str, median: bool = False) -> DataFrame:
    """V5: DEM observer heights, DSM surface within ``buff``; packed, per observer."""
    surface = tiles.pack(fx.dsm(spark, sf_dir), G)
    return V.observer_viewshed(fx.observers(spark, sf_dir), fx.dem(spark, sf_dir), surface, G, median)


def viewshed_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 -> 3x3 focal median per observer -> black/white ramp colour."""
    m = _seen(observer_viewshed(spark, sf_dir, median=True))
    return m.select("id", "gx", "gy", Y.grey_rgba(F.round("value").cast("int"), 1).alias("color"))


# --- vectorize (Z1-Z3, P12) ----------------------------------------------------------


def dem_classes(spark: SparkSession, sf_dir: str, interval: float = 100.0) -> DataFrame:
    """The DEM quantised to elevation bands (L1), the input of the region queries."""
    d = fx.dem(spark, sf_dir)
    return d.select("gx", "gy", F.floor(F.col("value") / interval).cast("double").alias("value"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected regions of equal elevation band: ``(region, value, cells)``."""
    return Z.region_summary(Z.region_runs(tiles.pack(dem_classes(spark, sf_dir), G), G))


def region_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z2+Z3: one GeoJSON polygon (with holes) per elevation-band region."""
    return Z.region_polygons(Z.region_runs(tiles.pack(dem_classes(spark, sf_dir), G), G), G)


def viewshed_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 -> median 3x3, an even split counting as visible as in P11 -> 0 becomes NODATA -> regions per observer ->
    GeoJSON."""
    m = map_tiles(observer_viewshed(spark, sf_dir, median=True), lambda v: zero_to_nodata(F.round(v)))
    return Z.region_polygons(Z.region_runs(m, G, ("id",)), G, ("id",))


# --- sources, geometry and local rows registered on their own -------------------------


def _layered(t: DataFrame, layer: str = "dem", zoom: int = ZOOM) -> DataFrame:
    return t.select(F.lit(layer).alias("layer"), F.lit(zoom).alias("zoom"), *(c for c in t.columns if c not in ("layer", "zoom")))


def stored_dem(spark: SparkSession, sf_dir: str) -> str:
    """A new layer store with the DEM, beside the checkpoints."""
    path = scratch_path(spark, "store")
    S.write_layer(dem_tiles(spark, sf_dir), path, "dem", ZOOM, G, cell_type="int32", nodata=-2147483648.0)
    return path


def _tile_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tile request per supplier; keys deliberately run past the layer's bounds on all sides."""
    s = fx.table(spark, sf_dir, "supplier", "s_suppkey")
    k = F.col("s_suppkey")
    rows = F.ceil(fx.raster_rows(spark, sf_dir) / G.tile_rows)
    return s.select(
        k.alias("id"), F.lit("dem").alias("layer"), F.lit(ZOOM).alias("zoom"),
        (k % 6 - 1).cast("int").alias("col"), (k * 7 % (rows + 2) - 1).cast("int").alias("row"),
    )


def tile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed lookup in a stored layer; the tile's cells as text (``x`` = NODATA), NULL for a missing key."""
    j = S.lookup_stored(_tile_requests(spark, sf_dir), stored_dem(spark, sf_dir), "dem", ZOOM)
    cells = F.array_join(F.transform("data", lambda v: F.coalesce(v.cast("bigint").cast("string"), F.lit("x"))), " ")
    return j.select("id", "col", "row", F.size(F.array_compact("data")).alias("valid_cells"), F.when(F.col("data").isNotNull(), cells).alias("cells"))


def layer_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the stored catalogue's row of the DEM, flattened."""
    m = S.read_catalogue(spark, stored_dem(spark, sf_dir))
    return m.select(
        "layer", "zoom", "crs", "cell_type", "nodata", "tile_cols", "tile_rows",
        "extent.xmin", "extent.ymin", "extent.xmax", "extent.ymax",
        "key_bounds.col_min", "key_bounds.row_min", "key_bounds.col_max", "key_bounds.row_max",
        "tiles", "valid_cells", "value_min", "value_max",
    )


def key_bounds_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile requests kept only when inside the stored layer's key bounds."""
    meta = S.read_catalogue(spark, stored_dem(spark, sf_dir))
    return S.within_key_bounds(_tile_requests(spark, sf_dir), meta).select("id", "col", "row")


def array_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored tile's array as a raster of its own, row-major, 32 columns wide."""
    return tiles.raster_from_array(dem_tiles(spark, sf_dir), "data", G.tile_cols, keep=("col", "row"))


def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flood summaries written as JSON lines and read back with a declared schema."""
    path = scratch_path(spark, "json")
    S.write_json(flood_summary(spark, sf_dir), path)
    return spark.read.schema("id bigint, area bigint, total bigint, flooded bigint, coverage double, intervals string").json(path)


def request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point requests as files, answered by a stream that ends when it has read them; its answers and rejects."""
    root = scratch_path(spark, "stream")
    k = F.col("id")
    fx.points(spark, sf_dir).select("id", F.when(k % 7 != 0, F.col("x")).alias("x"), "y").write.json(f"{root}/requests")
    query = start_point_value_stream(spark, f"{root}/requests", hand_tiles(spark, sf_dir), G, f"{root}/answers", f"{root}/rejects", f"{root}/state")
    query.awaitTermination()
    answers = spark.read.schema("id bigint, gx bigint, gy bigint, value double").parquet(f"{root}/answers/batch=*")
    rejects = spark.read.schema("id bigint, reason string").parquet(f"{root}/rejects/batch=*")
    return answers.withColumn("reason", F.lit(None).cast("string")).unionByName(rejects, allowMissingColumns=True)


def point_request_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5+G1: a request table mixing (lat, lon), (x, y) and malformed rows."""
    c = fx.table(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey")
    kind = k % 3
    lat = (k * 53 % 1700) / 10.0 - 85.0
    lon = (k * 37 % 3600) / 10.0 - 180.0
    req = c.select(
        k.alias("id"),
        F.when(kind == 0, lat).when(kind == 2, lat).alias("lat"),
        F.when(kind == 0, lon).alias("lon"),
        F.when(kind == 1, F.lit(fx.FIXTURE_GRID.xmin) + k).alias("x"),
        F.when(kind == 1, F.lit(fx.FIXTURE_GRID.ymax) - k).alias("y"),
    )
    ok, bad = point_requests(req)
    return ok.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.lit(True).alias("valid")).unionByName(
        bad.select("id", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(False).alias("valid"))
    )


def reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: lon/lat of every customer to Web Mercator (4 decimals)."""
    c = fx.table(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey")
    p = lonlat_to_mercator((k * 37 % 3600) / 10.0 - 180.0, (k * 53 % 1700) / 10.0 - 85.0)
    return c.select(k.alias("id"), F.round(p["x"], 4).alias("x"), F.round(p["y"], 4).alias("y"))


def collection_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First Polygon of a FeatureCollection per supplier (a LineString comes first,
    the supplier's flood polygon second, a square third), its vertex count and area."""
    p = fx.flood_polygons(spark, sf_dir)
    ring = F.col("rings")[0]
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(
        F.lit("LineString").alias("type"), F.transform(ring, lambda v: F.array(v["x"], v["y"])).alias("coordinates")).alias("geometry")))
    poly = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(
        F.lit("Polygon").alias("type"), F.transform("rings", lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))).alias("coordinates")).alias("geometry")))
    coll = F.concat(F.lit('{"type":"FeatureCollection","features":['), line, F.lit(","), poly, F.lit("]}"))
    r = p.select("id", geojson_first_polygon_rings(coll).alias("rings"))
    return r.select("id", F.size(F.col("rings")[0]).alias("vertices"), polygon_area("rings").alias("area"))


def pack_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of the DEM with their valid-cell count and sum (unpacked back)."""
    t = dem_tiles(spark, sf_dir)
    c = tiles.unpack(t, G, keep_nodata=False)
    col = F.floor(F.col("gx") / G.tile_cols).cast("int").alias("col")
    row = F.floor(F.col("gy") / G.tile_rows).cast("int").alias("row")
    return c.groupBy(col, row).agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"))


def polygon_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile keys that each flood polygon intersects, and those of polygons forty times as large (L- and U-shaped in tiles)."""
    p = fx.flood_polygons(spark, sf_dir)
    small = polygon_tile_keys(p, G).withColumn("scale", F.lit(1))
    x0, y0 = F.lit(G.xmin), F.lit(G.ymax)
    large = p.withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda v: F.struct((x0 + (v["x"] - x0) * 40.0).alias("x"), (y0 + (v["y"] - y0) * 40.0).alias("y")))))
    return small.unionByName(polygon_tile_keys(large, G).withColumn("scale", F.lit(40)))


def buffer_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles whose rectangle touches each observer's 200 m buffer disk."""
    return V.tiles_within(fx.observers(spark, sf_dir, 20), G)


def combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: cell-wise DSM - DEM (object heights), NODATA where the DEM is NODATA."""
    return combine_cells(fx.dsm(spark, sf_dir), fx.dem(spark, sf_dir), lambda a, b: a - b)


def combine_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 on packed tiles: the same, tile by tile."""
    dsm = tiles.pack(fx.dsm(spark, sf_dir), G)
    return tiles.unpack(combine_tiles(dsm, dem_tiles(spark, sf_dir), lambda a, b: a - b), G)


def observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: observer grid cell and elevation (DEM + height)."""
    return _observers(spark, sf_dir, 20).select("id", "ox", "oy", "oz")


def fixed_cell_viewshed(spark: SparkSession, sf_dir: str, oy: int = 5, height: float = 0.0) -> DataFrame:
    """V2 from one cell over the whole DEM -- the first valid cell of row ``oy``,
    radius = the raster's largest index (every cell is inside the square).  The
    observer is one aggregate over the raster, joined back to its own cell (a
    one-row side, so the broadcast is bounded by construction)."""
    dem = fx.dem(spark, sf_dir)
    first = dem.agg(
        F.min(F.when((F.col("gy") == oy) & F.col("value").isNotNull(), F.col("gx"))).alias("gx"),
        F.greatest(F.max("gx"), F.max("gy")).cast("int").alias("radius"),
        F.min("gx").alias("bx0"), F.min("gy").alias("by0"), F.max("gx").alias("bx1"), F.max("gy").alias("by1"),
    ).select("gx", F.lit(oy).cast("bigint").alias("gy"), "radius", "bx0", "by0", "bx1", "by1")
    obs = dem.join(F.broadcast(first), ["gx", "gy"]).select(
        F.lit(0).cast("bigint").alias("id"),
        F.col("gx").alias("ox"),
        F.col("gy").alias("oy"),
        (F.col("value") + F.lit(height)).alias("oz"),
        "radius", "bx0", "by0", "bx1", "by1",
    )
    return V.viewshed_r2(obs, dem, prune_grid=G)


def fixed_cell_approx(spark: SparkSession, sf_dir: str, x: int = 20, y: int = 20, height: float = 2.0) -> DataFrame:
    """P13, the approximate half: V4 inside the tile under each point request, from cell (x, y) of that tile; a tile that many
    points ask for is answered once, with their number."""
    col, row = tile_key(G, map_to_grid_x(G, "x"), map_to_grid_y(G, "y"))
    asked = fx.points(spark, sf_dir).groupBy(col.alias("col"), row.alias("row")).agg(F.count(F.lit(1)).alias("requests"))
    t = dem_tiles(spark, sf_dir).join(asked, ["col", "row"])
    ground = F.get("data", F.lit(y * G.tile_cols + x))
    obs = t.where(ground.isNotNull()).select(
        morton("col", "row").alias("id"), (F.col("col") * G.tile_cols + x).cast("bigint").alias("ox"), (F.col("row") * G.tile_rows + y).cast("bigint").alias("oy"),
        (ground + F.lit(height)).alias("oz"), (F.lit(G.xmin) + (F.col("col") + 0.5) * (G.tile_cols * G.cell_w)).alias("px"),
        (F.lit(G.ymax) - (F.col("row") + 0.5) * (G.tile_rows * G.cell_h)).alias("py"), F.lit(1.0).alias("buff"), "requests",
    )
    obs = cut_lineage(obs)
    seen = _seen(V.viewshed_approx(obs, dem_tiles(spark, sf_dir), G)).join(obs.select("id", "requests"), "id")
    return seen.select("gx", "gy", F.col("value").cast("int").alias("vis"), "requests")


# --- local, crop, quantile and neighbourhood rows registered on their own -------------


def exaggerated(spark: SparkSession, sf_dir: str, zoom: int = ZOOM) -> DataFrame:
    """L3: DEM times the hillshade exaggeration of a zoom level (6 decimals)."""
    return map_cells(fx.dem(spark, sf_dir), lambda v: F.round(L.exaggerate(v, zoom), 6))


def contour_levels(spark: SparkSession, sf_dir: str, zoom: int = ZOOM) -> DataFrame:
    """L4: DEM divided by the zoom's contour interval."""
    return map_cells(fx.dem(spark, sf_dir), lambda v: L.contour_quantise(v, zoom))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEM 0..500 -> 1..254, truncated to INT."""
    return fx.dem(spark, sf_dir).select("gx", "gy", L.normalize("value", 0, 500, 1, 254).alias("value"))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DSM where the DEM has data, 0 where the DEM is NODATA (join on the cell index)."""
    j = fx.dsm(spark, sf_dir).join(fx.dem(spark, sf_dir).select("gx", "gy", F.col("value").alias("m")), ["gx", "gy"])
    return j.select("gx", "gy", L.mask_nodata("value", "m", 0.0).alias("value"))


def zero_as_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAND extent with 0 turned into NODATA."""
    return map_cells(fx.hand_extent(spark, sf_dir), zero_to_nodata)


def overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The DEM with every observer's cell set to its elevation (DEM + height)."""
    o = _observers(spark, sf_dir, 20).select(F.col("ox").alias("gx"), F.col("oy").alias("gy"), F.col("oz").alias("value"))
    return override_cells(fx.dem(spark, sf_dir), o)


def flood_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flood depth of every requested tile (id, gx, gy, value)."""
    depth = tiles.pack(fx.hand_depth(spark, sf_dir), G)
    ext = tiles.pack(fx.hand_extent(spark, sf_dir), G)
    return flood_depth_tiles(fx.tile_requests(spark, sf_dir), depth, ext, G).select("id", "gx", "gy", "value")


def cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: the stitched DEM tiles cropped to an inclusive window."""
    return tiles.crop_tiles(dem_tiles(spark, sf_dir), G, 30, 4, 97, 90)


def stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: the DEM without every fifth tile, stitched over its key grid: the gaps are NODATA."""
    t = dem_tiles(spark, sf_dir).where((F.col("col") + 2 * F.col("row")) % 5 != 3)
    return tiles.stitch(t, G, fx.key_bounds(spark, sf_dir))


def colormap_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour map per supplier (every fourth malformed in one of several ways, every tenth unknown), and a value of the
    DEM per customer, classified by its supplier's map."""
    s = fx.table(spark, sf_dir, "supplier", "s_suppkey")
    k = F.col("s_suppkey")
    good = F.concat((k % 90).cast("string"), F.lit(":ff0000ff ; "), (k % 90 + 100).cast("string"), F.lit(":00FF00;"), (k % 90 + 250).cast("string"), F.lit(".5:80c06000"))
    bad = F.when(k % 16 == 0, F.lit("10:xyz;20:ff")).when(k % 16 == 4, F.lit("10;20:ff")).when(k % 16 == 8, F.lit("10:ff:1")).otherwise(F.lit("ten:ff"))
    maps = s.where(k % 10 != 9).select(k.cast("string").alias("name"), F.when(k % 4 == 0, bad).otherwise(good).alias("definition"))
    n = s.agg(F.max("s_suppkey") + 1).scalar()
    c = fx.table(spark, sf_dir, "customer", "c_custkey")
    cell = F.col("c_custkey")
    values = c.select(cell.alias("id"), (cell % n).cast("string").alias("name"), (cell % fx.RASTER_COLS).alias("gx"), F.expr(f"c_custkey div {fx.RASTER_COLS}").alias("gy"))
    values = values.join(fx.dem(spark, sf_dir), ["gx", "gy"], "left")
    return Y.classify_requests(values.select("id", "name", "value"), maps)


def quantile_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: per-tile equal-count class (0..254) of every cell of the DEM's tiles, NULL for NODATA."""
    t = zonal.tile_quantile_class(dem_tiles(spark, sf_dir), G, 254)
    return tiles.unpack(t, G).withColumnRenamed("value", "class")


def point_tile_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5 + K4 on packed tiles: the value under each point, from the one tile that holds it."""
    return zonal.point_values_tiles(fx.points(spark, sf_dir), hand_tiles(spark, sf_dir), G)


def neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the nine window values of every DEM cell (scatter form)."""
    return focal.neighbourhood_cells(fx.dem(spark, sf_dir))

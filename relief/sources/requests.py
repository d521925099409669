"""Request tables: point requests (S5) and GeoJSON polygon requests.

The reference answers one HTTP request at a time and rejects a malformed one
with status 400.  Here a request table is split into answerable rows and a
reject DataFrame in one pass; parsing is ``from_json`` with a declared schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relief.functions.geo import lonlat_to_mercator, reproject_rings
from relief.session import stored

_POLY_COORDS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
POLYGON_JSON = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", _POLY_COORDS)])
COLLECTION_JSON = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("type", T.StringType()),
                        T.StructField("geometry", POLYGON_JSON),
                    ]
                )
            ),
        ),
    ]
)


def point_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exactly (lat, lon) -> reprojected to EPSG:3857, or exactly (x, y); anything else is rejected.

    Returns ``(valid(id, x, y), rejected(original columns))``."""
    has = {c: F.col(c).isNotNull() for c in ("lat", "lon", "x", "y")}
    geo = has["lat"] & has["lon"] & ~has["x"] & ~has["y"]
    xy = ~has["lat"] & ~has["lon"] & has["x"] & has["y"]
    merc = lonlat_to_mercator("lon", "lat")
    tagged = requests.select(
        "*",
        F.when(geo, merc["x"]).when(xy, F.col("x")).alias("_x"),
        F.when(geo, merc["y"]).when(xy, F.col("y")).alias("_y"),
        (geo | xy).alias("_ok"),
    )
    valid = tagged.where("_ok").select("id", F.col("_x").alias("x"), F.col("_y").alias("y"))
    rejected = tagged.where(~F.col("_ok")).drop("_x", "_y", "_ok")
    return valid, rejected


def _rings_of(poly: Column) -> Column:
    """Rings of a parsed polygon; NULL unless it has a ring, every ring four positions, and every position two numbers."""
    rings = poly["coordinates"]
    position = lambda p: F.coalesce(F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull(), F.lit(False))
    sound = (F.size(rings) > 0) & F.forall(rings, lambda r: F.coalesce((F.size(r) >= 4) & F.forall(r, position), F.lit(False)))
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    return F.when(F.coalesce(sound, F.lit(False)), points)


def geojson_polygon_rings(geom: Column | str) -> Column:
    """GeoJSON Polygon string -> ARRAY<ARRAY<STRUCT<x,y>>>; anything else -> NULL."""
    g = F.from_json(F.col(geom) if isinstance(geom, str) else geom, POLYGON_JSON)
    return F.when(g["type"] == "Polygon", _rings_of(g))


def geojson_first_polygon_rings(collection: Column | str) -> Column:
    """First Polygon feature of a FeatureCollection; none -> NULL."""
    c = F.from_json(F.col(collection) if isinstance(collection, str) else collection, COLLECTION_JSON)
    polys = F.filter(c["features"], lambda f: f["geometry"]["type"] == "Polygon")
    return F.when(F.size(polys) > 0, _rings_of(F.try_element_at(polys, F.lit(1))["geometry"]))


def geojson_all_polygons(requests: DataFrame, collection: str = "collection") -> DataFrame:
    """S7 with ``all=True``: one row per Polygon feature, with its ordinal."""
    c = F.from_json(F.col(collection), COLLECTION_JSON)
    return requests.select("*", F.posexplode(F.filter(c["features"], lambda f: f["geometry"]["type"] == "Polygon")).alias("feature", "f")).select(
        "*", _rings_of(F.col("f")["geometry"]).alias("rings")
    ).drop("f")


def flood_requests(requests: DataFrame, src_crs: str = "EPSG:4326") -> tuple[DataFrame, DataFrame]:
    """S6+S7+G2: ``(id, zoom, level, step, geom|collection)`` -> ``(id, zoom, level, step, rings)``.

    Exactly one of ``geom``/``collection`` must be set and yield a polygon, and
    ``step`` must be positive; other rows go to the reject DataFrame.  The JSON is parsed once: both results read the
    written table of checked requests."""
    geom_set = F.col("geom").isNotNull()
    coll_set = F.col("collection").isNotNull()
    rings = F.when(geom_set & ~coll_set, geojson_polygon_rings("geom")).when(
        coll_set & ~geom_set, geojson_first_polygon_rings("collection")
    )
    tagged = requests.select("*", reproject_rings(rings, src_crs).alias("rings"))
    ok = F.coalesce(F.col("rings").isNotNull() & (F.size("rings") > 0) & (F.col("step") > 0) & F.col("level").isNotNull(), F.lit(False))
    tagged = stored(tagged.withColumn("_ok", ok))
    valid = tagged.where("_ok").select("id", "zoom", "level", "step", "rings")
    rejected = tagged.where("not _ok").drop("rings", "_ok")
    return valid, rejected
